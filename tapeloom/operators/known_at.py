"""Attributes as they were known at an event's time.

Every attribute has its own history of changes, turned into half-open intervals [known_from, known_to). An attribute is
matched to the events on its own; afterwards the matches are pivoted back to one row an event, so attributes that change
at different times never multiply into wide versions.

The match is an equi-join. An interval is cut into at most 2 * (BASE - 1) cells on each level of a time grid (4 h, 32 h,
256 h ...), an event looks up the one cell of each level that it lies in, and the bounds decide the rest. Neither a key with
many events nor one with many changes ever meets all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID_US = 4 * 3_600_000_000
BASE = 8
#: The buckets by which the search for the next change is spread, in grid cells.
SPREAD_CELLS = 6 * 32


def _cell(c: Column) -> Column:
    return F.call_function("div", c - F.pmod(c, F.lit(GRID_US)), F.lit(GRID_US))


def change_history(df: DataFrame, key: str, value: str | Column, known_from: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Changes of one attribute as (key, value, known_from, known_to), times in microseconds, known_to null for the last.

    Of changes at the same time the one greatest in `order`, then in value, counts. Rows without key, time or value tell nothing
    and are left out (so a null is no change of the value known before). Repeated rows count once. The next change is
    looked for within a bucket of time first and then over buckets, so a key with very many changes is no single sort.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.col(key).alias("key"), v.alias("value"), F.unix_micros(known_from).alias("known_from"), F.struct(*order, v.alias("value_")).alias("rank")).where("key IS NOT NULL AND value IS NOT NULL AND known_from IS NOT NULL")
    best = rows.groupBy("key", "known_from").agg(F.max_by("value", "rank").alias("value"))
    bucketed = best.withColumn("bucket", _cell(F.col("known_from")) - F.pmod(_cell(F.col("known_from")), F.lit(SPREAD_CELLS)))
    firsts = bucketed.groupBy("key", "bucket").agg(F.min("known_from").alias("first"))
    after = firsts.select("key", "bucket", F.lead("first").over(Window.partitionBy("key").orderBy("bucket")).alias("after"))
    within = F.lead("known_from").over(Window.partitionBy("key", "bucket").orderBy("known_from"))
    return bucketed.withColumn("next", within).join(after, ["key", "bucket"]).select("key", "value", "known_from", F.coalesce("next", "after").alias("known_to"))


def validity_history(df: DataFrame, key: str, value: str, valid_from: str, valid_to: str) -> DataFrame:
    """Rows with a validity of their own as (key, value, known_from, known_to); a null bound is open.

    Overlapping or repeated validities of the same key and value become one, so a value is never matched twice. Rows
    whose validity is empty, or that lack key or value, are left out.
    """
    low, high = -(2**63), 2**63 - 1
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.coalesce(F.unix_micros(valid_from), F.lit(low)).alias("a"), F.coalesce(F.unix_micros(valid_to), F.lit(high)).alias("b"))
    rows = rows.where("key IS NOT NULL AND value IS NOT NULL AND a < b").distinct()
    w = Window.partitionBy("key", "value").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("opens", (reach.isNull() | (F.col("a") > reach)).cast("int")).withColumn("island", F.sum("opens").over(w))
    merged = islands.groupBy("key", "value", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.select("key", "value", F.when(F.col("a") > low, F.col("a")).alias("known_from"), F.when(F.col("b") < high, F.col("b")).alias("known_to"))


def time_span(events: DataFrame, at: str) -> tuple[int, int] | None:
    """The first and last grid cell of the events: two numbers, whatever their count."""
    m = F.unix_micros(at)
    low, high = events.agg(F.min(m), F.max(m)).first()
    return None if low is None else (low // GRID_US, high // GRID_US)


def _on_level(level: int) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))


def match_known(events: DataFrame, event_id: str, key: str, at: str, history: DataFrame, span: tuple[int, int] | None = None) -> DataFrame:
    """(event_id, value) of every value of the event's key whose interval holds the event's time.

    Events without key or time match nothing. event_id is expected to be unique; a repeated one gives its rows again.
    """
    span = span or time_span(events, at) or (0, 0)
    levels = max(1, math.ceil(math.log(span[1] - span[0] + 1, BASE)))
    lo = F.greatest(F.coalesce(_cell(F.col("known_from")), F.lit(span[0])), F.lit(span[0])) - F.lit(span[0])
    hi = F.least(F.coalesce(_cell(F.col("known_to") - 1), F.lit(span[1])), F.lit(span[1])) - F.lit(span[0]) + 1
    cut = history.withColumn("lo0", lo).withColumn("hi0", hi).where("lo0 < hi0")
    pieces = []
    for level in range(levels):
        a, b = F.col(f"lo{level}"), F.col(f"hi{level}")
        top = level == levels - 1
        up = F.expr(f"lo{level} + pmod(-lo{level}, {BASE}L)")
        down = F.expr(f"hi{level} - pmod(hi{level}, {BASE}L)")
        left_to = b if top else F.least(up, b)
        right_from = b if top else F.greatest(down, left_to)
        runs = F.concat(F.when(a < left_to, F.sequence(a, left_to - 1)).otherwise(F.array().cast("array<bigint>")), F.when(right_from < b, F.sequence(right_from, b - 1)).otherwise(F.array().cast("array<bigint>")))
        pieces.append(F.transform(runs, _on_level(level)))
        cut = cut.withColumn(f"lo{level + 1}", F.expr(f"(lo{level} + pmod(-lo{level}, {BASE}L)) div {BASE}L")).withColumn(f"hi{level + 1}", F.expr(f"(hi{level} - pmod(hi{level}, {BASE}L)) div {BASE}L"))
        if not top:  # what is left for the next level lies between
            cut = cut.withColumn(f"hi{level + 1}", F.greatest(F.col(f"lo{level + 1}"), F.col(f"hi{level + 1}")))
    cells = cut.select("key", "value", "known_from", "known_to", F.explode(F.concat(*pieces)).alias("c")).select(F.xxhash64("key", "c.level", "c.cell").alias("spot"), "key", "value", "known_from", "known_to")
    moment = F.unix_micros(at)
    looks = F.array(*[F.xxhash64(F.col("k"), F.lit(level), F.expr(f"(cell - pmod(cell, {BASE**level}L)) div {BASE**level}L")) for level in range(levels)])
    probes = events.select(F.col(event_id).alias("event"), F.col(key).alias("k"), moment.alias("at")).where("k IS NOT NULL AND at IS NOT NULL")
    probes = probes.withColumn("cell", _cell(F.col("at")) - F.lit(span[0])).select("event", "k", "at", F.explode(looks).alias("spot"))
    hit = (F.col("k") == F.col("key")) & (F.col("known_from").isNull() | (F.col("known_from") <= F.col("at"))) & (F.col("known_to").isNull() | (F.col("at") < F.col("known_to")))
    return probes.join(cells, "spot").where(hit).select(F.col("event").alias(event_id), "value")


def as_known(events: DataFrame, event_id: str, at: str, histories: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """(event_id, one string column an attribute): histories gives each attribute its key column and change history.

    Every event comes out once; what wasn't known by then is null. A value that became known later is never used.
    """
    span = time_span(events, at)
    long = None
    for name, (key, history) in histories.items():
        one = match_known(events, event_id, key, at, history, span).select(event_id, F.lit(name).alias("attribute"), F.col("value").cast("string").alias("value"))
        long = one if long is None else long.unionByName(one)
    every = events.select(event_id, F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value"))
    return every.unionByName(long).groupBy(event_id).agg(*[F.max(F.when(F.col("attribute") == name, F.col("value"))).alias(name) for name in histories])
