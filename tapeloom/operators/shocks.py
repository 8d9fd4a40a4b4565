"""Shocks of one-sided trading: what they moved, how the book came back, how one compares with the one before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m

LEAST_AGGRESSION, LEAST_VOLUME, LEAST_LEVELS = 0.5, 100.0, 1
PAIR_EVENTS, PAIR_SECONDS, PAIR_RATIO = 500, 60, (0.5, 2.0)


def reconcile(executions: DataFrame, trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Book executions beside trade prints by trade id: BOOK_ONLY, TRADE_ONLY, MATCHED, or UNRESOLVED without an id; and who owns the volume."""
    b = executions.select(*keys, "trade_id", F.col("event_id").alias("book_event"), F.col("quantity").alias("book_qty"))
    t = trades.select(*keys, "trade_id", F.col("event_id").alias("trade_event"), F.col("quantity").alias("trade_qty"), F.col("aggressor_side").alias("side"))
    j = b.join(t, [*keys, "trade_id"], "full_outer")
    status = F.when(F.col("trade_id").isNull(), "UNRESOLVED").when(F.col("trade_event").isNull(), "BOOK_ONLY").when(F.col("book_event").isNull(), "TRADE_ONLY").otherwise("MATCHED")
    return j.withColumn("status", status)


def observations(reconciled: DataFrame) -> DataFrame:
    """One row a volume: a matched pair counts once, by its trade; a book-only execution has no known aggressor."""
    owned = F.when(F.col("status") == "BOOK_ONLY", F.col("book_qty")).when(F.col("status").isin("MATCHED", "TRADE_ONLY"), F.col("trade_qty"))
    side = F.when(F.col("status") == "BOOK_ONLY", "UNKNOWN").otherwise(F.coalesce("side", F.lit("UNKNOWN")))
    return reconciled.withColumns({"volume": owned, "aggressor": side}).where("volume IS NOT NULL")


def at_indices(shocks: DataFrame, states: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """One row a shock and offset: the state that many events after its end (null if there is none), and the baseline before its start."""
    base = states.select("instrument", (F.col("event_index") + 1).alias("first_index"), F.col("mid").alias("mid0"), F.col("depth").alias("depth0"), F.col("at_us").alias("at0"))
    s = shocks.join(base, ["instrument", "first_index"])
    inside = shocks.select("instrument", "shock_id", F.explode(F.sequence("first_index", "last_index")).alias("event_index")).join(states.select("instrument", "event_index", "depth"), ["instrument", "event_index"]).groupBy("shock_id").agg(F.min("depth").alias("least"))
    s = s.join(inside, "shock_id").withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("event_index", F.col("last_index") + F.col("offset"))
    later = states.select("instrument", "event_index", F.col("mid").alias("mid1"), F.col("depth").alias("depth1"), F.col("at_us").alias("at1"))
    return s.join(later, ["instrument", "event_index"], "left")


def impacts(rows: DataFrame) -> DataFrame:
    raw = F.col("mid1") - F.col("mid0")
    di = m.directional(F.col("direction"), raw)
    return rows.select("shock_id", "instrument", "direction", F.col("offset").alias("horizon"), F.col("mid1").isNotNull().alias("available"), raw.alias("impact"), di.alias("directional_impact"), m.over(F.abs(raw), F.col("volume")).alias("volume_impact"), m.over(F.abs(raw), F.col("aggression")).alias("aggression_impact"), m.effectiveness(di, F.col("aggression")).alias("effectiveness"))


def resiliency(rows: DataFrame) -> DataFrame:
    least = F.least("least", "depth0")
    rr = m.replenishment_ratio(F.col("depth0"), least, F.col("depth1"))
    return rows.select("shock_id", "instrument", F.col("offset").alias("horizon"), rr.alias("ratio"), ((F.col("at1") - F.col("end_us")) / 1e6).alias("seconds"))


def first_passage(ratios: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(shock_id, threshold, events, seconds): the first horizon at which the ratio reaches each threshold."""
    e = ratios.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    hit = F.col("ratio") >= F.col("threshold")
    return e.groupBy("shock_id", "threshold").agg(F.min(F.when(hit, F.col("horizon"))).alias("events"), F.min_by("seconds", F.when(hit, F.col("horizon"))).alias("seconds"))


def classify(aggression: Column, volume: Column, levels: Column) -> Column:
    """The thresholds that fail; none means a candidate. Bounds are inclusive."""
    reasons = F.array(F.when(aggression.isNull(), "NO_AGGRESSION").when(aggression < LEAST_AGGRESSION, "AGGRESSION"), F.when(volume < LEAST_VOLUME, "VOLUME"), F.when(levels < LEAST_LEVELS, "LEVELS"))
    return F.array_compact(reasons)


def nearest_prior(shocks: DataFrame, within_events: int = PAIR_EVENTS, within_seconds: float = PAIR_SECONDS, look_back: int = 50) -> DataFrame:
    """Each shock with the nearest earlier one it can be compared with.

    Comparable: same instrument, segment and direction, ended before, near in events and time, and of like aggression. What isn't
    comparable is passed over, so the choice comes after the judgement. Event windows of `within_events` are buckets, and a shock
    meets only those of its own and the previous bucket.
    """
    bucket = F.floor(F.col("last_index") / within_events)
    prior = shocks.select("instrument", "segment", "direction", F.explode(F.array(bucket, bucket + 1)).alias("b"), F.col("shock_id").alias("prior_id"), F.col("last_index").alias("prior_last"), F.col("end_us").alias("prior_end"), F.col("aggression").alias("prior_aggression"))
    now = shocks.withColumn("b", F.floor(F.col("first_index") / within_events))
    ratio = m.over(F.col("aggression"), F.col("prior_aggression"))
    ok = (F.col("prior_last") < F.col("first_index")) & (F.col("first_index") - F.col("prior_last") <= within_events) & (F.col("start_us") - F.col("prior_end") <= within_seconds * 1_000_000) & ratio.between(*PAIR_RATIO)
    j = now.join(prior, ["instrument", "segment", "direction", "b"]).where(ok)
    w = Window.partitionBy("shock_id").orderBy(F.desc("prior_last"), "prior_id")
    return j.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("shock_id", "prior_id", "instrument", "direction", (F.col("first_index") - F.col("prior_last")).alias("events_between"))


def pair_findings(shocks: DataFrame) -> DataFrame:
    """All reasons why each shock can't be compared with the one directly before it in its market."""
    w = Window.partitionBy("instrument").orderBy("first_index")
    b = {c: F.lag(c).over(w) for c in ("direction", "segment", "last_index", "end_us", "aggression")}
    ratio = m.over(F.col("aggression"), b["aggression"])
    reasons = F.array_compact(F.array(F.when(b["direction"] != F.col("direction"), "DIRECTION"), F.when(b["segment"] != F.col("segment"), "STRUCTURAL_BREAK"), F.when(F.col("first_index") - b["last_index"] > PAIR_EVENTS, "EVENT_DISTANCE"), F.when(F.col("start_us") - b["end_us"] > PAIR_SECONDS * 1_000_000, "TIME_DISTANCE"), F.when(~ratio.between(*PAIR_RATIO), "AGGRESSION_RATIO")))
    return shocks.select("shock_id", F.lag("shock_id").over(w).alias("prior_id"), reasons.alias("reasons")).where("prior_id IS NOT NULL")
