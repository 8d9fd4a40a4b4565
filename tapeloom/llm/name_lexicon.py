"""Fixed values for names: short forms, titles and familiar forms in general use, whatever entities there are."""

#: Legal forms, each with the spellings that mean it.
LEGAL_FORMS = {
    "ag": ("ag",),
    "asa": ("asa",),
    "company": ("company", "co"),
    "corporation": ("corporation", "corp", "co"),
    "gmbh": ("gmbh",),
    "group": ("group", "grp", "gp"),
    "holdings": ("holdings", "holding", "hldgs", "hldg"),
    "incorporated": ("incorporated", "inc"),
    "limited": ("limited", "ltd"),
    "llc": ("llc",),
    "llp": ("llp",),
    "oyj": ("oyj",),
    "plc": ("plc",),
    "pty": ("pty",),
    "sa": ("sa",),
    "sas": ("sas",),
    "spa": ("spa",),
    "srl": ("srl",),
}
#: Short forms of words in organisations' names beyond plain beginnings of three letters or more.
SHORT_FORMS = {
    "academy": ("acad",),
    "administration": ("admin",),
    "advisors": ("adv",),
    "aerospace": ("aero",),
    "agency": ("agcy",),
    "agricultural": ("agri", "agric"),
    "airlines": ("air", "airl"),
    "american": ("amer", "am"),
    "associates": ("assoc", "assocs"),
    "association": ("assn", "assoc"),
    "atlantic": ("atl",),
    "authority": ("auth",),
    "automotive": ("auto", "autom"),
    "bancorp": ("banc",),
    "bank": ("bk",),
    "biotechnology": ("biotech",),
    "board": ("bd", "brd"),
    "brewing": ("brew",),
    "british": ("brit",),
    "brothers": ("bros",),
    "building": ("bldg",),
    "capital": ("cap",),
    "cement": ("cem",),
    "center": ("ctr",),
    "central": ("cent", "ctrl"),
    "centre": ("ctr",),
    "chemicals": ("chem", "chems"),
    "college": ("coll",),
    "commerce": ("comm",),
    "commission": ("comm", "commn"),
    "committee": ("comm", "cttee"),
    "communications": ("comm", "comms"),
    "construction": ("constr", "const"),
    "consulting": ("consult",),
    "council": ("cncl",),
    "credit": ("cr",),
    "defence": ("def",),
    "department": ("dept", "dep"),
    "development": ("dev", "devt"),
    "distribution": ("dist", "distr"),
    "economic": ("econ",),
    "economics": ("econ",),
    "education": ("educ", "edu"),
    "electric": ("elec",),
    "electrical": ("elec",),
    "electronics": ("elec", "elecs", "electr"),
    "energy": ("en",),
    "engineering": ("eng", "engg", "engrg"),
    "enterprises": ("ent", "entr"),
    "entertainment": ("ent",),
    "environment": ("env",),
    "environmental": ("env",),
    "equipment": ("equip", "eqpt"),
    "estates": ("est",),
    "european": ("eur", "euro"),
    "exchange": ("exch", "xch"),
    "exploration": ("expl",),
    "federal": ("fed",),
    "federation": ("fed",),
    "finance": ("fin",),
    "financial": ("fin", "fncl"),
    "foods": ("fds",),
    "foreign": ("for",),
    "foundation": ("fdn", "found"),
    "general": ("gen", "genl"),
    "global": ("glbl",),
    "government": ("govt", "gov"),
    "healthcare": ("hlth", "health"),
    "hospital": ("hosp",),
    "hotels": ("htls",),
    "industrial": ("ind", "indl"),
    "industries": ("ind", "inds"),
    "information": ("info",),
    "infrastructure": ("infra",),
    "institute": ("inst",),
    "instruments": ("instr",),
    "insurance": ("ins",),
    "international": ("intl",),
    "investment": ("inv", "invt"),
    "investments": ("inv", "invs", "invts"),
    "laboratories": ("lab", "labs"),
    "logistics": ("log", "logs", "lgstcs"),
    "machinery": ("mach",),
    "management": ("mgmt", "mgt"),
    "manufacturing": ("manuf", "mfg"),
    "marine": ("mar",),
    "maritime": ("mar",),
    "marketing": ("mktg",),
    "markets": ("mkts",),
    "materials": ("mat", "matls"),
    "media": ("med",),
    "medical": ("med",),
    "metals": ("met", "mtls"),
    "mining": ("min", "mng"),
    "ministry": ("min",),
    "monetary": ("mon",),
    "motors": ("mtrs",),
    "mutual": ("mut",),
    "national": ("natl", "nat"),
    "networks": ("net", "ntwks"),
    "northern": ("nthn",),
    "office": ("off",),
    "organisation": ("org",),
    "organization": ("org",),
    "pacific": ("pac",),
    "partners": ("ptnrs",),
    "partnership": ("ptnrship",),
    "payments": ("pymts",),
    "petroleum": ("petr", "petro"),
    "pharmaceuticals": ("pharma", "pharm"),
    "plastics": ("plas",),
    "power": ("pwr",),
    "products": ("prod", "prods"),
    "properties": ("prop", "props"),
    "publishing": ("pub", "publ"),
    "railroad": ("rr",),
    "railway": ("rly", "rlwy", "ry"),
    "railways": ("rlwys", "rly", "rail", "rwys"),
    "regulatory": ("reg",),
    "republic": ("rep",),
    "research": ("res", "rsch"),
    "reserve": ("res",),
    "resources": ("res", "rsrcs"),
    "retail": ("ret",),
    "royal": ("ryl",),
    "savings": ("sav",),
    "science": ("sci",),
    "sciences": ("sci",),
    "scientific": ("sci",),
    "sector": ("sec",),
    "securities": ("sec", "secs"),
    "semiconductors": ("semi", "semis"),
    "service": ("svc", "serv"),
    "services": ("svcs", "serv", "svc"),
    "shipping": ("ship", "shpg"),
    "society": ("soc",),
    "software": ("sw", "soft"),
    "solutions": ("soln", "solns"),
    "southern": ("sthn",),
    "standard": ("std",),
    "stores": ("strs",),
    "systems": ("sys",),
    "technologies": ("tech", "techs"),
    "technology": ("tech",),
    "telecom": ("tel",),
    "telecommunications": ("telecom", "telecoms", "tel"),
    "textiles": ("tex", "txtls"),
    "trade": ("trd",),
    "trading": ("trdg",),
    "transport": ("trans", "transp"),
    "transportation": ("trans", "transp"),
    "treasury": ("treas",),
    "trust": ("tr", "tst"),
    "university": ("univ",),
    "utilities": ("util", "utils"),
    "ventures": ("vent",),
    "water": ("wtr",),
    "western": ("wstn",),
    "wireless": ("wrls",),
}
#: Short forms that stand for several words.
EXPANSIONS = {
    "cb": ("central", "bank"),
    "mfa": ("ministry", "foreign", "affairs"),
    "moa": ("ministry", "agriculture"),
    "mod": ("ministry", "defence"),
    "moe": ("ministry", "education"),
    "mof": ("ministry", "finance"),
    "moh": ("ministry", "health"),
    "moi": ("ministry", "interior"),
    "moj": ("ministry", "justice"),
    "mol": ("ministry", "labour"),
    "mot": ("ministry", "trade"),
}
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "professor", "doctor")
SILENT = ("the", "of", "and")
#: Familiar forms of given names.
FAMILIAR = {
    "aaron": ("ron", "ronnie"),
    "abigail": ("abby", "gail", "abbie"),
    "abraham": ("abe", "bram"),
    "adam": ("ad",),
    "adelaide": ("addie", "della"),
    "adrian": ("ade",),
    "agnes": ("aggie", "nessa"),
    "alan": ("al",),
    "albert": ("al", "bert", "bertie"),
    "alexander": ("alex", "sasha", "sandy", "al", "lex", "xander"),
    "alfred": ("alf", "alfie", "fred"),
    "alice": ("allie",),
    "alison": ("ali", "allie"),
    "amanda": ("mandy",),
    "amelia": ("amy", "millie"),
    "andrea": ("andie",),
    "andrew": ("andy", "drew"),
    "angela": ("angie",),
    "ann": ("annie", "nan", "nancy"),
    "anna": ("annie", "ania", "anya"),
    "anthony": ("tony", "ant", "antony"),
    "antonio": ("tony", "toni", "tonio"),
    "arnold": ("arnie",),
    "arthur": ("art", "artie"),
    "augustus": ("gus", "augie"),
    "barbara": ("barb", "barbie", "babs", "bobbie"),
    "bartholomew": ("bart",),
    "beatrice": ("bea", "trixie", "bee"),
    "benedict": ("ben",),
    "benjamin": ("ben", "benny", "benji"),
    "bernard": ("bernie",),
    "bradley": ("brad",),
    "carlos": ("carlitos", "charlie"),
    "caroline": ("carrie", "caro", "lina"),
    "carolyn": ("carrie", "lyn"),
    "catherine": ("kate", "cathy", "katie", "kathy", "cate", "kitty", "kat", "kit"),
    "cecilia": ("celia", "cissy"),
    "charles": ("charlie", "chuck", "chas", "carl"),
    "charlotte": ("charlie", "lottie", "lotte"),
    "christian": ("chris",),
    "christina": ("chris", "chrissy", "tina", "christie"),
    "christine": ("chris", "chrissy", "tina", "christie"),
    "christopher": ("chris", "kit", "topher"),
    "clarence": ("clare",),
    "clifford": ("cliff",),
    "constance": ("connie",),
    "cornelius": ("neil", "corny"),
    "cynthia": ("cindy",),
    "daniel": ("dan", "danny"),
    "david": ("dave", "davey", "davy"),
    "deborah": ("deb", "debbie", "debby", "debra"),
    "dennis": ("den", "denny"),
    "dmitri": ("dima", "mitya"),
    "dominic": ("dom", "nick"),
    "donald": ("don", "donnie"),
    "dorothy": ("dot", "dottie", "dolly"),
    "douglas": ("doug",),
    "edith": ("edie",),
    "edmund": ("ed", "eddie", "ned", "ted"),
    "edward": ("ed", "eddie", "ned", "ted", "teddy", "eddy"),
    "edwin": ("ed", "eddie"),
    "eleanor": ("ellie", "nell", "nora", "nellie", "ella"),
    "elizabeth": ("liz", "beth", "betty", "lizzie", "eliza", "libby", "bess", "betsy", "lisa", "elsie"),
    "emily": ("em", "emmy", "millie"),
    "emma": ("em", "emmy"),
    "ernest": ("ernie",),
    "eugene": ("gene",),
    "evelyn": ("eve", "evie"),
    "ferdinand": ("ferdie", "nando"),
    "fernando": ("nando", "fer"),
    "florence": ("flo", "florrie", "flossie"),
    "frances": ("fran", "fanny", "frankie", "francie"),
    "francis": ("frank", "frankie", "fran"),
    "francisco": ("paco", "pancho", "kiko", "frank", "cisco", "fran", "curro"),
    "franklin": ("frank",),
    "frederick": ("fred", "freddie", "freddy", "fritz", "rick"),
    "gabriel": ("gabe",),
    "gabrielle": ("gabby",),
    "geoffrey": ("geoff", "jeff"),
    "george": ("georgie", "geordie"),
    "gerald": ("gerry", "jerry", "ger"),
    "gerard": ("gerry",),
    "gilbert": ("gil", "bert"),
    "giovanni": ("gianni", "vanni"),
    "giuseppe": ("beppe", "peppe"),
    "gregory": ("greg",),
    "guillermo": ("memo", "guille"),
    "gustav": ("gus",),
    "hannah": ("nan",),
    "harold": ("harry", "hal"),
    "harriet": ("hattie",),
    "heinrich": ("heinz", "heini"),
    "helen": ("nell", "ellie", "lena"),
    "henry": ("harry", "hank", "hal"),
    "herbert": ("herb", "bert"),
    "howard": ("howie",),
    "hugo": ("hugh", "hughie"),
    "ignacio": ("nacho",),
    "ingrid": ("inga", "inge"),
    "irene": ("rene",),
    "isaac": ("ike", "zac"),
    "isabel": ("bella", "izzy", "bel", "belle"),
    "isabella": ("bella", "izzy", "bel", "belle"),
    "ivan": ("vanya", "van"),
    "jacob": ("jake",),
    "jacqueline": ("jackie",),
    "james": ("jim", "jimmy", "jamie", "jem"),
    "janet": ("jan",),
    "jason": ("jay",),
    "jeffrey": ("jeff",),
    "jennifer": ("jen", "jenny", "jenn", "jennie"),
    "jeremy": ("jerry", "jem"),
    "jerome": ("jerry",),
    "jessica": ("jess", "jessie"),
    "joan": ("joanie",),
    "joanna": ("jo",),
    "johannes": ("hans", "jo", "johan", "john", "jan", "hannes"),
    "john": ("jack", "johnny", "jock"),
    "jonathan": ("jon", "jonny", "nathan"),
    "jose": ("pepe", "joe", "chepe", "pepito"),
    "joseph": ("joe", "joey", "jo"),
    "josephine": ("jo", "josie"),
    "joshua": ("josh",),
    "juan": ("juanito",),
    "judith": ("judy", "judi"),
    "julia": ("julie", "jules"),
    "julian": ("jules",),
    "katharine": ("kate", "kathy", "katie", "kat", "kit", "kitty", "kay"),
    "katherine": ("kate", "kathy", "katie", "kat", "kit", "kitty", "kay", "cathy", "cate"),
    "kathleen": ("kathy", "kath", "kay", "katie"),
    "kenneth": ("ken", "kenny"),
    "kimberly": ("kim",),
    "kristina": ("kris", "tina"),
    "lawrence": ("larry", "laurie", "lars", "lawrie"),
    "leonard": ("len", "lenny", "leo"),
    "leonardo": ("leo", "nardo"),
    "leslie": ("les",),
    "lewis": ("lew",),
    "lillian": ("lil", "lily"),
    "louis": ("lou", "louie"),
    "louise": ("lou",),
    "lucille": ("lucy",),
    "luis": ("lucho",),
    "madeleine": ("maddie",),
    "manuel": ("manolo", "manny"),
    "marcus": ("marc",),
    "margaret": ("maggie", "peggy", "meg", "marge", "margie", "greta", "peg", "madge"),
    "maria": ("mia", "masha", "mitzi"),
    "marianne": ("mary",),
    "marjorie": ("marge", "margie"),
    "martha": ("patty", "marty"),
    "martin": ("marty",),
    "mary": ("molly", "polly", "mamie"),
    "matilda": ("tilly", "mattie"),
    "matthew": ("matt", "matty"),
    "maximilian": ("max",),
    "maxwell": ("max",),
    "melanie": ("mel",),
    "melissa": ("mel", "missy", "lissa"),
    "michael": ("mike", "mick", "mickey", "misha", "micky", "mikey"),
    "michelle": ("shelly",),
    "mikhail": ("misha",),
    "miriam": ("mimi",),
    "mitchell": ("mitch",),
    "mohammed": ("mo",),
    "montgomery": ("monty",),
    "nancy": ("nan",),
    "natalia": ("natasha", "nat"),
    "natalie": ("nat",),
    "nathan": ("nate", "nat"),
    "nathaniel": ("nate", "nat"),
    "nicholas": ("nick", "nicky", "nico", "klaus", "cole"),
    "nikolai": ("kolya",),
    "norman": ("norm",),
    "oliver": ("ollie", "noll"),
    "olivia": ("liv", "livvy"),
    "oscar": ("ozzie", "oz", "ossie"),
    "pamela": ("pam",),
    "patricia": ("pat", "trish", "patty", "tricia", "patsy", "trisha", "patti"),
    "patrick": ("pat", "paddy", "rick"),
    "pavel": ("pasha",),
    "penelope": ("penny",),
    "percival": ("percy",),
    "peter": ("pete",),
    "philip": ("phil", "pip"),
    "phillip": ("phil", "pip"),
    "phyllis": ("phyl",),
    "priscilla": ("cilla",),
    "quentin": ("quin", "quint"),
    "rachel": ("rach",),
    "raymond": ("ray",),
    "rebecca": ("becky", "becca"),
    "reginald": ("reg", "reggie", "rex"),
    "richard": ("dick", "rick", "rich", "richie", "ricky", "rickie"),
    "robert": ("bob", "rob", "bobby", "robbie", "bert", "bobbie", "robby"),
    "roberto": ("beto", "berto"),
    "roderick": ("rod", "roddy"),
    "rodney": ("rod",),
    "roger": ("rodge",),
    "ronald": ("ron", "ronnie"),
    "rosemary": ("rosie", "rose"),
    "rudolf": ("rudi", "rolf"),
    "rupert": ("rupe",),
    "russell": ("russ",),
    "samantha": ("sam", "sammy"),
    "samuel": ("sam", "sammy"),
    "sarah": ("sally", "sadie"),
    "sebastian": ("seb", "bastian"),
    "sergei": ("seryozha",),
    "sidney": ("sid",),
    "simon": ("si",),
    "sophia": ("sophie",),
    "stanley": ("stan",),
    "stephanie": ("steph", "stevie"),
    "stephen": ("steve", "stevie"),
    "steven": ("steve", "stevie"),
    "stuart": ("stu",),
    "susan": ("sue", "susie", "suzy", "suzie", "susy"),
    "sylvia": ("syl",),
    "terence": ("terry",),
    "teresa": ("terry", "tess", "tessa"),
    "theodore": ("theo", "ted", "teddy", "dora"),
    "theresa": ("terry", "tess", "tessa"),
    "thomas": ("tom", "tommy", "thom"),
    "timothy": ("tim", "timmy"),
    "tobias": ("toby",),
    "ursula": ("ulla", "uschi", "ursel", "ursi"),
    "valentine": ("val",),
    "valerie": ("val",),
    "veronica": ("ronnie", "vera"),
    "victoria": ("vicky", "vic", "tori", "vicki", "vickie", "tory"),
    "vincent": ("vince", "vinny"),
    "virginia": ("ginny", "ginger"),
    "vladimir": ("volodya", "vova"),
    "walter": ("walt", "wally"),
    "wilfred": ("wilf", "fred"),
    "wilhelm": ("willi", "willy"),
    "william": ("bill", "will", "billy", "willy", "willie", "liam", "billie"),
    "winifred": ("winnie", "freda"),
    "yekaterina": ("katya",),
    "yvonne": ("von", "vonnie", "evie"),
    "zachary": ("zach", "zack", "zac"),
    "zoe": ("zo",),
}
