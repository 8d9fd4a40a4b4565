"""Liquidity behind trading: replenishment after executions, credibility of orders, toxicity of flow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import market as m

EPISODE_GAP = 2
EPISODE = "stream long, side string, price double, opened long, closed long, added double, executed double, withdrawn double, complete boolean"


def _replenish(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, eligible, current, owner = None, set(), {}, {}
        done: list[dict] = []

        def batch_of() -> pa.RecordBatch:
            names = ["stream", "side", "price", "opened", "closed", "added", "executed", "withdrawn", "complete"]
            types = (pa.int64(), pa.utf8(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            out = pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in zip(names, types, strict=True)], names=names)
            done.clear()
            return out

        def finish() -> None:
            every = {id(e): e for e in current.values()} | {id(e): e for parts in owner.values() for e, _ in parts if e is not None}
            done.extend(sorted(every.values(), key=lambda e: (e["opened"], e["side"], e["price"])))

        for batch in batches:
            for key, seq, order, action, side, price, added, executed, withdrawn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != stream:
                    if stream is not None:
                        finish()
                        yield batch_of()
                    stream, eligible, current, owner = key, set(), {}, {}
                level = (side, price)
                if added > 0 and level not in eligible:
                    owner.setdefault(order, []).append([None, added])
                elif added > 0:
                    e = current.get(level)
                    if e is None or seq - e["closed"] > gap or e["hit"]:
                        if e is not None and e["open"] <= 1e-12:
                            done.append(e)
                        e = current[level] = {"stream": key, "side": side, "price": price, "opened": seq, "closed": seq, "added": 0.0, "executed": 0.0, "withdrawn": 0.0, "complete": True, "hit": False, "open": 0.0}
                    e["closed"] = seq
                    e["added"] += added
                    e["open"] += added
                    if action == "MODIFY":
                        e["complete"] = False
                    owner.setdefault(order, []).append([e, added])
                taken, what = (executed, "executed") if executed > 0 else (withdrawn, "withdrawn")
                if taken > 0:
                    parts = owner.get(order, [])
                    while taken > 1e-12 and parts:
                        e, rest = parts[0]
                        part = min(rest, taken)
                        taken -= part
                        if e is not None:
                            e[what] += part
                            e["open"] -= part
                            e["hit"] |= what == "executed"
                        if rest - part <= 1e-12:
                            parts.pop(0)
                            if e is not None and e["open"] <= 1e-12 and current.get((e["side"], e["price"])) is not e:
                                done.append(e)
                        else:
                            parts[0][1] = rest - part
                    if not parts:
                        owner.pop(order, None)
                if executed > 0:
                    eligible.add(level)
            if len(done) > 10_000:
                yield batch_of()
        if stream is not None:
            finish()
        yield batch_of()

    return run


def replenishment(trans: DataFrame, gap: int = EPISODE_GAP) -> DataFrame:
    """Episodes of liquidity added at prices where an execution took place before.

    Additions at most `gap` events apart belong together until one of them is executed. What is later executed or
    withdrawn of an order is taken from its additions, first in first out; a raised order makes its episode incomplete,
    as not all that it shows was added there. One pass over each stream's sorted transitions.
    """
    t = trans.where("error IS NULL").select(F.col("stream").cast("long"), F.col("sequence").cast("long"), F.col("order_id").cast("string"), "action", "side", F.coalesce("post_price", "pre_price").cast("double").alias("price"), *[F.col(c).cast("double") for c in ("added", "executed", "withdrawn")])
    return t.repartition("stream").sortWithinPartitions("stream", "sequence").mapInArrow(_replenish(gap), EPISODE)


def attacked_orders(trans: DataFrame, window: Column) -> DataFrame:
    """Orders that stood at a window's start and were touched in it: what was there, executed, withdrawn, left."""
    g = trans.where("error IS NULL").withColumn("window", window).groupBy("stream", "window", "order_id").agg(F.min_by("pre_qty", "sequence").alias("before"), F.sum("executed").alias("executed"), F.sum("withdrawn").alias("withdrawn"), F.max_by("post_qty", "sequence").alias("after"))
    return g.where("before > 0").withColumn("survived", m.over(F.col("after").cast("double"), F.col("before").cast("double")))


def order_credibility(life: DataFrame) -> Column:
    """Of an order: executed, long-lived, still there, not withdrawn."""
    return m.convex((F.col("executed_share"), 0.4), (m.saturation(F.col("lifetime_s"), 30.0), 0.2), (m.over(F.col("remaining").cast("double"), F.col("largest").cast("double")), 0.2), (1 - F.col("withdrawn_share"), 0.2))


TOXICITY_WEIGHTS = (("flow", 0.2), ("shocks", 0.15), ("impact", 0.15), ("failure", 0.15), ("withdrawal", 0.1), ("spread", 0.1), ("volatility", 0.15))


def toxicity(df: DataFrame) -> DataFrame:
    """The weighted sum of the seven components, or the names of those that are missing; never a part of it."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c.upper()) for c, _ in TOXICITY_WEIGHTS]))
    return df.withColumns({"missing": F.array_join(missing, ","), "toxicity": m.convex(*[(F.col(c), w) for c, w in TOXICITY_WEIGHTS])})
