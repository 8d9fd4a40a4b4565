"""Scores of event revisions and the state of instruments, from what was known at each revision's time.

A revision is scored against the messages of its event that had been processed when it became available, and against the revision
before it. What repeats is reduced to its first appearance before any join, so a revision meets the distinct sources,
entities and terms of its event and not its messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.functions import taxonomy as t
from tapeloom.operators import known_at, news

#: The weights of the parts of novelty, confidence and uncertainty.
NOVELTY = {"token_change": 0.40, "new_sources": 0.10, "new_entities": 0.15, "new_instruments": 0.15, "new_confirmation": 0.20}
CONFIDENCE = {"credibility": 0.30, "corroboration": 0.15, "classifier": 0.20, "entity_confidence": 0.15, "exposure_confidence": 0.15, "confirmed": 0.05}
UNCERTAINTY = {"state_uncertainty": 0.35, "dispersion": 0.15, "speculative_only": 0.25, "unconfirmed": 0.15, "unresolved": 0.20, "entity_deficit": 0.10, "direction_conflict": 0.30}
LINK_CONFIDENCE = 0.95
#: Of an instrument's link: magnitude, relevance.
DIRECT, INDIRECT = (1.0, 1.0), (0.7, 0.8)
RISKS = {"COMPANY": "company", "SECTOR": "sector", "MACRO": "macro", "RATE": "macro", "CURRENCY": "macro", "COMMODITY": "macro", "GEOPOLITICAL": "geopolitical", "REGULATORY": "regulatory"}
RISK_NAMES = ("company", "sector", "macro", "geopolitical", "regulatory", "systemic")
#: What opposing signs add to an instrument's uncertainty, and the influence below which an event is over.
CONTRADICTION, LEAST_INFLUENCE = 0.35, 0.01


def with_previous(revisions: DataFrame) -> DataFrame:
    """Revisions with the time and state of the one before them in their event; null for the first."""
    w = Window.partitionBy("event_id").orderBy("revision_number", "revision_id")
    return revisions.withColumns({"before_at": F.lag("available_at").over(w), "before_state": F.lag("event_state").over(w), "is_first": F.lag("revision_id").over(w).isNull()})


def _known(revisions: DataFrame, firsts: DataFrame) -> DataFrame:
    """Each revision with what of its event had appeared by then; `old` says that it had when the revision before became available."""
    j = revisions.select("revision_id", "event_id", "available_at", "before_at", "event_type").join(firsts, "event_id").where(F.col("first") <= F.col("available_at"))
    return j.withColumn("old", F.coalesce(F.col("first") <= F.col("before_at"), F.lit(False)))


def exposures(revisions: DataFrame, messages: DataFrame, links: DataFrame) -> DataFrame:
    """(revision_id, instrument_id, is_direct, magnitude, relevance, confidence): the instruments to which the entities of an event known by then were linked then; direct links go first."""
    entities = messages.where("entity_id IS NOT NULL").groupBy("event_id", "entity_id").agg(F.min("process_time").alias("first"))
    looks = _known(revisions, entities).select("revision_id", "entity_id", "available_at").withColumn("look", F.concat_ws("|", "revision_id", "entity_id"))
    direct = F.col("relationship_type") == "PRIMARY_EQUITY"
    packed = links.withColumn("link", F.struct("instrument_id", F.coalesce(direct, F.lit(False)).alias("is_direct"), "confidence"))
    hit = known_at.match_known(looks, "look", "entity_id", "available_at", known_at.validity_history(packed, "entity_id", "link", "valid_from", "valid_to"))
    found = hit.join(looks.select("look", "revision_id"), "look").select("revision_id", "value.*")
    best = found.groupBy("revision_id", "instrument_id").agg(F.max(F.struct("is_direct", "confidence")).alias("b")).select("revision_id", "instrument_id", "b.*")
    return best.select("revision_id", "instrument_id", "is_direct", F.when(F.col("is_direct"), DIRECT[0]).otherwise(INDIRECT[0]).alias("magnitude"), F.when(F.col("is_direct"), DIRECT[1]).otherwise(INDIRECT[1]).alias("relevance"), "confidence")


def evidence(revisions: DataFrame, messages: DataFrame, exposed: DataFrame) -> DataFrame:
    """All parts of a revision's scores, one row a revision.

    revisions: (revision_id, event_id, revision_number, available_at, event_type, event_subtype, event_state, severity).
    messages: (event_id, news_id, process_time, source, source_type, entity_id, provider_tickers, provider_entities, tokens, class_confidence, direction).
    """
    r = with_previous(revisions)
    said = messages.where("event_id IS NOT NULL")
    by_source = said.groupBy("event_id", F.lower("source").alias("name"), "source_type").agg(F.min("process_time").alias("first"))
    known = _known(r, by_source).withColumns({"prior": news.prior(t.CREDIBILITY, F.col("source_type"), 0.5), "official": news.official(F.col("source_type"), F.col("event_type"))})
    each = known.groupBy("revision_id", "name").agg(F.max("prior").alias("prior"), F.max("old").alias("old"), F.max_by("source_type", "prior").alias("kind"), F.max("official").alias("official"), F.max(F.col("official") & F.col("old")).alias("official_before"))
    sources = each.groupBy("revision_id").agg(
        F.count("*").alias("n_sources"), F.count(F.when(~F.col("old"), 1)).alias("n_new_sources"), (1 - F.product(1 - F.col("prior"))).alias("credibility"), (F.max("prior") - F.min("prior")).alias("dispersion"),
        F.min(F.coalesce(F.col("kind") == "SPECULATIVE", F.lit(False))).alias("speculative"), F.max("official").alias("official"), F.max("official_before").alias("official_before"),
    )
    entities = _known(r, said.where("entity_id IS NOT NULL").groupBy("event_id", "entity_id").agg(F.min("process_time").alias("first"))).groupBy("revision_id").agg(F.count("*").alias("n_entities"), F.count(F.when(~F.col("old"), 1)).alias("n_new_entities"))
    terms = F.concat(F.transform(F.coalesce("provider_tickers", F.array().cast("array<string>")), lambda x: F.concat(F.lit("t:"), F.lower(x))), F.transform(F.coalesce("provider_entities", F.array().cast("array<string>")), lambda x: F.concat(F.lit("e:"), F.lower(x))))
    named = _known(r, said.select("event_id", "process_time", F.explode(terms).alias("term")).where("term IS NOT NULL").groupBy("event_id", "term").agg(F.min("process_time").alias("first"))).groupBy("revision_id").agg(F.count("*").alias("n_terms"))
    instruments = exposed.groupBy("revision_id").agg(F.collect_set("instrument_id").alias("instruments"), F.avg("confidence").alias("exposure_confidence"))
    marks = r.select("event_id", F.col("available_at").alias("at"), F.lit(1).alias("mark"), F.col("revision_id").alias("id"), F.lit(None).cast("array<string>").alias("tokens"), F.lit(None).cast("double").alias("classifier"), F.lit(None).cast("double").alias("direction"))
    heads = said.select("event_id", F.col("process_time").alias("at"), F.lit(0).alias("mark"), F.col("news_id").alias("id"), "tokens", F.col("class_confidence").alias("classifier"), "direction")
    w = Window.partitionBy("event_id").orderBy("at", "mark", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("mark") == 0, F.struct("tokens", "classifier", "direction")), ignorenulls=True).over(w)
    head = marks.unionByName(heads).withColumn("latest", latest).where("mark = 1").select(F.col("id").alias("revision_id"), "latest.*")
    j = r.join(sources, "revision_id", "left").join(entities, "revision_id", "left").join(named, "revision_id", "left").join(instruments, "revision_id", "left").join(head, "revision_id")
    in_order = Window.partitionBy("event_id").orderBy("revision_number", "revision_id")
    none = F.array().cast("array<string>")
    return j.withColumns({c: F.coalesce(c, none) for c in ("instruments", "tokens")}).withColumns({"instruments_before": F.coalesce(F.lag("instruments").over(in_order), none), "tokens_before": F.coalesce(F.lag("tokens").over(in_order), none)})


def _whole(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def scores(parts: DataFrame) -> DataFrame:
    """One row a revision: (revision_id, event_id, credibility, sentiment, surprise, severity, novelty, confidence, uncertainty, ...) beside the parts they are made of.

    Surprise is null, as no table holds an expectation. Without a message known by then there is no source, and credibility is 0.
    """
    size = lambda a, b: F.size(F.array_except(a, b)) / F.greatest(F.size(a), F.lit(1))
    union = F.size(F.array_union("tokens", "tokens_before"))
    confirmed = F.coalesce((F.col("event_state") == "CONFIRMED") & F.col("official"), F.lit(False))
    confirmed_before = F.coalesce((F.col("before_state") == "CONFIRMED") & F.col("official_before"), F.lit(False))
    n_entities = _whole("n_entities")
    e = parts.withColumns({
        "credibility": F.coalesce("credibility", F.lit(0.0)), "classifier": F.coalesce("classifier", F.lit(0.0)), "sentiment": F.coalesce("direction", F.lit(0.0)), "surprise": F.lit(None).cast("double"),
        "severity": F.coalesce("severity", news.severity(F.col("event_subtype"))),
        "token_change": F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("tokens", "tokens_before")) / union),
        "new_sources": _whole("n_new_sources") / F.greatest(_whole("n_sources"), F.lit(1)), "new_entities": _whole("n_new_entities") / F.greatest(n_entities, F.lit(1)), "new_instruments": size("instruments", "instruments_before"),
        "new_confirmation": (confirmed & ~confirmed_before).cast("double"), "confirmed": confirmed.cast("double"), "unconfirmed": (~confirmed).cast("double"),
        "corroboration": F.least(F.greatest(_whole("n_sources") - 1, F.lit(0)) / 2.0, F.lit(1.0)), "entity_confidence": F.when(n_entities > 0, LINK_CONFIDENCE).otherwise(0.0), "exposure_confidence": F.coalesce("exposure_confidence", F.lit(0.0)),
        "state_uncertainty": news.prior(t.STATE_UNCERTAINTY, F.col("event_state")), "dispersion": F.coalesce("dispersion", F.lit(0.0)), "speculative_only": F.coalesce(F.col("speculative").cast("double"), F.lit(0.0)),
        "unresolved": F.when(_whole("n_terms") == 0, 0.0).otherwise(1 - F.least(n_entities / F.col("n_terms"), F.lit(1.0))), "entity_deficit": F.when(n_entities > 0, 1 - LINK_CONFIDENCE).otherwise((_whole("n_terms") > 0).cast("double")), "direction_conflict": F.lit(0.0),
    })
    total = lambda weights: m.convex(*[(F.col(c), w) for c, w in weights.items()])
    return e.withColumns({"novelty": F.when(F.col("is_first"), 1.0).otherwise(total(NOVELTY)), "confidence": total(CONFIDENCE), "uncertainty": news.noisy_or(F.array(*[F.col(c) * w for c, w in UNCERTAINTY.items()]))})


def intensity(*factors: Column) -> Column:
    """The product of magnitude, relevance, severity, novelty, credibility, confidence and decay."""
    out = F.lit(1.0)
    for f in factors:
        out = out * f
    return out


def risk(magnitude: Column, relevance: Column, severity: Column, uncertainty: Column, credibility: Column, confidence: Column, decay: Column) -> Column:
    """Little evidence and much doubt lower a risk by half at most each."""
    return magnitude * relevance * severity * decay * (0.5 + 0.25 * credibility + 0.25 * confidence) * (0.5 + 0.5 * uncertainty)


def active(scored: DataFrame, exposed: DataFrame, as_of: Column) -> DataFrame:
    """One row an instrument and event in force at a time: the event's latest revision known then, unless retracted or faded, by its strongest exposure (direct before indirect)."""
    w = Window.partitionBy("event_id").orderBy(F.desc("available_at"), F.desc("revision_number"), F.desc("revision_id"))
    latest = scored.where(F.col("available_at") <= as_of).withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")
    fade = news.decay((F.unix_micros(as_of) - F.unix_micros("available_at")) / 1e6, news.tau_hours(F.col("event_subtype")) * 3600)
    live = latest.withColumn("decay", fade).where((F.col("event_state") != "RETRACTED") & (F.col("decay") >= LEAST_INFLUENCE))
    e = live.withColumnRenamed("confidence", "belief").join(exposed, "revision_id")
    mag, rel, d = F.col("magnitude"), F.col("relevance"), F.col("decay")
    i = intensity(mag, rel, F.col("severity"), F.col("novelty"), F.col("credibility"), F.col("belief"), d)
    return e.withColumns({"intensity": i, "signed": i * F.col("sentiment"), "risk": risk(mag, rel, F.col("severity"), F.col("uncertainty"), F.col("credibility"), F.col("belief"), d), "newness": F.col("novelty") * mag * rel * d, "weight": mag * rel * d, "bucket": news.prior(RISKS, F.col("event_type"), "systemic")})


def states(in_force: DataFrame) -> DataFrame:
    """The state of each instrument: signed intensities, a risk a bucket, novelty, uncertainty, confidence, and the events behind them."""
    union = lambda x: 1 - F.product(1 - x)
    signs = F.count_distinct(F.when(F.col("sentiment") != 0, F.signum("sentiment")))
    g = in_force.groupBy("instrument_id").agg(
        F.sum(F.greatest("signed", F.lit(0.0))).alias("positive_intensity"), F.sum(F.abs(F.least("signed", F.lit(0.0)))).alias("negative_intensity"),
        *[union(F.when(F.col("bucket") == b, F.col("risk")).otherwise(0.0)).alias(f"{b}_risk") for b in RISK_NAMES],
        union(F.col("newness")).alias("novelty_intensity"), union(F.col("uncertainty") * F.col("weight")).alias("doubt"), signs.alias("signs"),
        F.coalesce(F.try_divide(F.sum(F.col("belief") * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias("confidence"),
        F.count("*").alias("n_events"), F.count(F.when(F.col("is_direct"), 1)).alias("n_direct"), F.count(F.when(~F.col("is_direct"), 1)).alias("n_indirect"),
    )
    return g.withColumn("uncertainty", F.when(F.col("signs") > 1, 1 - (1 - F.col("doubt")) * (1 - CONTRADICTION)).otherwise(F.col("doubt"))).drop("doubt", "signs")


def flow(in_force: DataFrame, messages: DataFrame, as_of: Column) -> DataFrame:
    """(instrument_id, volume, acceleration): the messages of the events in force that were known then, of a day; the rate of the last quarter of an hour less that of the hour before it, an hour."""
    at, p, minute = F.unix_micros(as_of), F.unix_micros("process_time"), 60_000_000
    named = in_force.select("instrument_id", "event_id").distinct().join(messages.where(F.col("process_time") <= as_of).select("event_id", "news_id", "process_time"), "event_id")
    within = lambda low, high: F.count_distinct(F.when((p > at - low * minute) & (p <= at - high * minute), F.col("news_id")))
    g = named.groupBy("instrument_id").agg(within(1440, 0).alias("volume"), within(15, 0).alias("recent"), within(75, 15).alias("prior"))
    return g.select("instrument_id", "volume", (F.col("recent") * 4.0 - F.col("prior")).alias("acceleration"))
