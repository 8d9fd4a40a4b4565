"""Fixed values of the news stack: words, phrases, rules and priors, in the order in which they apply."""

STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to")
PHRASES = (("consumer price index", "cpi"), ("quarterly results", "earnings"), ("share repurchase", "buyback"), ("stock repurchase", "buyback"))
TOKENS = {
    "acquired": "acquire", "acquires": "acquire", "acquiring": "acquire", "acquisition": "acquire", "acquisitions": "acquire", "agreed": "agree", "agrees": "agree",
    "announced": "announce", "announces": "announce", "increased": "increase", "increases": "increase", "merger": "acquire", "mergers": "acquire", "results": "earnings", "rises": "increase", "rose": "increase",
}
ACRONYMS = ("CEO", "CFO", "CPI", "ECB", "EU", "FDA", "FED", "FOMC", "GDP", "SEC", "UK", "US", "USA")

_BANKS = ("federal reserve", "fed", "central bank", "fomc", "ecb", "bank of england")
#: (subtype, phrases, phrases of which one must also stand, confidence); the first that fits is taken.
RULES = (
    ("SYSTEMIC.EXCHANGE_OUTAGE", ("exchange outage", "trading outage", "exchange unavailable"), (), 0.95),
    ("SYSTEMIC.BANK_FAILURE", ("bank failure", "bank collapse", "bank seized"), (), 0.95),
    ("SYSTEMIC.MARKET_DISRUPTION", ("market disruption", "marketwide halt", "market wide halt"), (), 0.9),
    ("GEOPOLITICAL.SANCTION", ("sanction", "sanctions", "sanctioned"), (), 0.92),
    ("GEOPOLITICAL.TRADE_RESTRICTION", ("trade restriction", "trade ban", "import ban", "export ban", "tariff"), (), 0.88),
    ("GEOPOLITICAL.CONFLICT", ("armed conflict", "military strike", "invasion", "ceasefire"), (), 0.9),
    ("GEOPOLITICAL.ELECTION", ("election", "election result", "election results"), (), 0.82),
    ("REGULATORY.ANTITRUST", ("antitrust", "competition probe"), (), 0.94),
    ("REGULATORY.EXPORT_CONTROL", ("export control", "export restriction", "export license restriction"), (), 0.93),
    ("REGULATORY.ENFORCEMENT", ("enforcement action", "regulatory fine", "regulator charges", "sec charges"), (), 0.9),
    ("REGULATORY.APPROVAL", ("regulatory approval", "fda approval", "regulator approves"), (), 0.9),
    ("RATE.CENTRAL_BANK_DECISION", ("interest rate decision", "rate decision", "raises interest rates", "cuts rates"), _BANKS, 0.94),
    ("RATE.CENTRAL_BANK_SPEECH", ("speech", "remarks", "testimony"), _BANKS, 0.86),
    ("MACRO.CPI", ("cpi", "consumer price index"), (), 0.96),
    ("MACRO.JOBS", ("jobs report", "nonfarm payroll", "non farm payroll", "unemployment report"), (), 0.92),
    ("MACRO.GDP", ("gross domestic product", "gdp"), (), 0.94),
    ("MACRO.RETAIL_SALES", ("retail sales",), (), 0.93),
    ("COMPANY.GUIDANCE", ("guidance", "forecast", "outlook"), (), 0.88),
    ("COMPANY.EARNINGS", ("earnings", "quarterly results", "financial results"), (), 0.9),
    ("COMPANY.MERGER_ACQUISITION", ("acquire", "acquired", "acquires", "acquiring", "acquisition", "merger", "agrees to buy", "to acquire"), (), 0.92),
    ("COMPANY.BUYBACK", ("buyback", "share repurchase", "stock repurchase"), (), 0.9),
    ("COMPANY.DIVIDEND", ("dividend",), (), 0.86),
    ("COMPANY.CAPITAL_RAISE", ("capital raise", "stock offering", "share offering", "debt offering"), (), 0.87),
    ("COMPANY.MANAGEMENT", ("chief executive", "ceo resigns", "ceo appointed", "management change"), (), 0.85),
    ("COMPANY.LEGAL", ("lawsuit", "litigation", "sued", "legal settlement"), (), 0.84),
    ("COMPANY.PRODUCT", ("product launch", "launches product", "new product"), (), 0.82),
    ("COMPANY.SEC_FILING", ("sec filing", "form 10 k", "form 10 q", "form 8 k"), (), 0.9),
)
#: By source type, where no rule fits.
FALLBACKS = {"SEC": ("COMPANY.SEC_FILING", 0.65), "MACRO_CALENDAR": ("MACRO.OTHER", 0.35), "CENTRAL_BANK": ("RATE.OTHER", 0.35), "GOVERNMENT": ("REGULATORY.OTHER", 0.25), "GLOBAL_NEWS": ("GEOPOLITICAL.OTHER", 0.2)}
FALLBACK = ("COMPANY.OTHER", 0.15)

CREDIBILITY = {"SEC": 0.96, "GOVERNMENT": 0.95, "CENTRAL_BANK": 0.95, "COMPANY_RELEASE": 0.88, "MACRO_CALENDAR": 0.85, "WIRE": 0.82, "FINANCIAL_NEWS": 0.78, "GLOBAL_NEWS": 0.65, "OTHER": 0.5, "SPECULATIVE": 0.35, "SOCIAL": 0.25}
SEVERITY = {"COMPANY": 0.4, "SECTOR": 0.5, "MACRO": 0.55, "GEOPOLITICAL": 0.65, "REGULATORY": 0.6, "MARKET_STRUCTURE": 0.65, "SYSTEMIC": 0.8, "COMMODITY": 0.55, "CURRENCY": 0.55, "RATE": 0.6}
SEVERITY_OF = {
    "COMPANY.EARNINGS": 0.7, "COMPANY.GUIDANCE": 0.6, "COMPANY.MERGER_ACQUISITION": 0.75, "COMPANY.CAPITAL_RAISE": 0.65, "COMPANY.BUYBACK": 0.45, "MACRO.CPI": 0.7, "MACRO.JOBS": 0.65, "MACRO.GDP": 0.65,
    "RATE.CENTRAL_BANK_DECISION": 0.75, "GEOPOLITICAL.CONFLICT": 0.9, "GEOPOLITICAL.SANCTION": 0.8, "REGULATORY.APPROVAL": 0.65, "REGULATORY.ENFORCEMENT": 0.75, "SYSTEMIC.BANK_FAILURE": 0.95, "SYSTEMIC.EXCHANGE_OUTAGE": 0.85, "SYSTEMIC.MARKET_DISRUPTION": 0.9,
}
TAU_HOURS = {"COMPANY": 6, "SECTOR": 12, "MACRO": 6, "GEOPOLITICAL": 48, "REGULATORY": 24, "MARKET_STRUCTURE": 4, "SYSTEMIC": 48, "COMMODITY": 24, "CURRENCY": 12, "RATE": 12}
TAU_HOURS_OF = {"COMPANY.EARNINGS": 12, "COMPANY.MERGER_ACQUISITION": 72, "COMPANY.BUYBACK": 24, "MACRO.CPI": 12, "RATE.CENTRAL_BANK_DECISION": 24, "GEOPOLITICAL.CONFLICT": 96, "GEOPOLITICAL.SANCTION": 72, "SYSTEMIC.BANK_FAILURE": 96}
STATE_UNCERTAINTY = {"NEW": 0.8, "DEVELOPING": 0.7, "UPDATED": 0.5, "CONFIRMED": 0.15, "RESOLVED": 0.1, "RETRACTED": 1.0}
#: Source types whose report confirms an event of these types.
OFFICIAL = {"COMPANY_RELEASE": ("COMPANY",), "SEC": ("COMPANY", "REGULATORY"), "GOVERNMENT": ("GEOPOLITICAL", "MACRO", "REGULATORY", "SYSTEMIC"), "CENTRAL_BANK": ("MACRO", "RATE")}
#: By relation: the way it is walked, what becomes of a sign, and the event types for which it is kept (none named: all).
POLICIES = (
    ("OWNS_OR_ISSUES", "FORWARD", "PRESERVE", ()),
    ("COMPETITOR", "BOTH", "UNKNOWN", ()),
    ("CUSTOMER_OF", "FORWARD", "UNKNOWN", ()),
    ("SUPPLIER_TO", "FORWARD", "UNKNOWN", ()),
    ("MEMBER_OF_SECTOR", "REVERSE", "PRESERVE", ("SECTOR",)),
    ("MEMBER_OF_INDUSTRY", "REVERSE", "PRESERVE", ("SECTOR",)),
    ("LOCATED_IN", "REVERSE", "PRESERVE", ("GEOPOLITICAL",)),
    ("OPERATES_IN", "REVERSE", "PRESERVE", ("GEOPOLITICAL",)),
    ("EXPOSED_TO_COMMODITY", "REVERSE", "UNKNOWN", ()),
    ("EXPOSED_TO_CURRENCY", "REVERSE", "UNKNOWN", ()),
    ("REGULATED_BY", "REVERSE", "PRESERVE", ("REGULATORY",)),
    ("MACRO_SENSITIVE_TO", "REVERSE", "UNKNOWN", ()),
    ("OTHER", "FORWARD", "UNKNOWN", ()),
)
