"""Sequence analytics over the events of one market: windows, runs, segments, episodes, forward paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tapeloom.functions import market as m


def ordered(key: str | Sequence[str], *order: str) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*order)


def event_index(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Every event of a market counts, whatever its kind."""
    return df.withColumn("event_index", (F.row_number().over(ordered(key, *order)) - 1).cast("long"))


def flow_sums(side: Column, quantity: Column) -> dict[str, Column]:
    return {f"{s.lower()}_volume": F.coalesce(F.sum(F.when(side == s, quantity)), F.lit(0.0)) for s in ("BUY", "SELL", "UNKNOWN")} | {f"{s.lower()}_count": F.count(F.when(side == s, 1)) for s in ("BUY", "SELL", "UNKNOWN")}


def aggressive_flow(df: DataFrame, key: str, side: str = "side", quantity: str = "qty") -> DataFrame:
    sums = flow_sums(F.col(side), F.col(quantity))
    out = df.groupBy(key).agg(*[c.alias(n) for n, c in sums.items()])
    return out.withColumn("signed_volume", F.col("buy_volume") - F.col("sell_volume"))


def rolling_flow(df: DataFrame, key: str, order: str, n: int, side: str = "side", quantity: str = "qty") -> DataFrame:
    """Flow of the last n events at each event."""
    w = ordered(key, order).rowsBetween(-(n - 1), 0)
    signed = F.when(F.col(side) == "BUY", F.col(quantity)).when(F.col(side) == "SELL", -F.col(quantity)).otherwise(F.lit(0.0))
    unknown = F.coalesce(F.sum(F.when(F.col(side) == "UNKNOWN", F.col(quantity))).over(w), F.lit(0.0))
    known = F.sum(F.abs(signed)).over(w)
    net = F.sum(signed).over(w)
    return df.select(key, order, net.alias("net_flow"), m.flow_persistence(net, known).alias("persistence"), m.share(unknown, known + unknown).alias("unknown_share"), m.share(known, known + unknown).alias("coverage"), m.flow_direction(net).alias("direction"))


def segments(df: DataFrame, key: str, order: str, is_boundary: Column) -> DataFrame:
    """A segment ends before each boundary."""
    return df.withColumn("segment", F.sum(is_boundary.cast("int")).over(ordered(key, order)).cast("long"))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, first, last, length): maximal runs of equal consecutive values."""
    w = ordered(key, order)
    changed = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1))
    numbered = df.withColumn("changed", F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("run", F.sum("changed").over(w))
    return numbered.groupBy(key, "run").agg(F.first(value).alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def latest_run(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return runs(df, key, order, value).groupBy(key).agg(F.max_by("value", "run").alias("value"), F.max_by("length", "run").alias("length"))


def sequence_check(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, is_reset: Column) -> DataFrame:
    """Each event's status against the one before: FIRST, OK, DUPLICATE, REGRESSION, GAP; a reset may bridge a gap."""
    before = F.lag(number).over(ordered(list(keys), *order))
    n = F.col(number)
    status = F.when(before.isNull(), "FIRST").when(n == before, "DUPLICATE").when(n < before, "REGRESSION").when((n > before + 1) & ~is_reset, "GAP").otherwise("OK")
    return df.withColumn("sequence_status", status)


def forward(df: DataFrame, key: str, order: str, value: str, horizons: Sequence[int]) -> DataFrame:
    """One row an event and horizon: the later value, the path's extremes and when they are reached; null where the path isn't whole.

    The path includes the event itself, so its maximum is never below the start; of equal extremes the first counts.
    """
    w = ordered(key, order)
    columns = []
    for h in horizons:
        path = w.rowsBetween(0, h)
        whole = F.count(value).over(path) == h + 1
        best, worst = F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("at"))).over(path), F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("at"))).over(path)
        columns.append(F.struct(F.lit(h).alias("horizon"), F.when(whole, F.lead(value, h).over(w)).alias("later"), F.when(whole, best["v"]).alias("highest"), F.when(whole, -best["at"]).alias("highest_at"), F.when(whole, worst["v"]).alias("lowest"), F.when(whole, worst["at"]).alias("lowest_at")))
    return df.withColumn("fs", F.array(*columns)).withColumn("f", F.explode("fs")).select(key, order, value, "f.*")


def backward(df: DataFrame, key: str, order: str, value: str, horizons: Sequence[int]) -> DataFrame:
    """One row an event and horizon: return since h events ago and root mean square of the h single returns."""
    w = ordered(key, order)
    step = df.withColumn("step", m.over(F.col(value) - F.lag(value).over(w), F.lag(value).over(w)))
    columns = []
    for h in horizons:
        then = F.lag(value, h).over(w)
        back = w.rowsBetween(-(h - 1), 0)
        columns.append(F.struct(F.lit(h).alias("horizon"), m.over(F.col(value) - then, then).alias("back_return"), F.when(then.isNotNull() & (F.count("step").over(back) == h), F.sqrt(F.avg(F.col("step") * F.col("step")).over(back))).alias("realized_volatility")))
    return step.withColumn("bs", F.array(*columns)).withColumn("b", F.explode("bs")).select(key, order, "b.*")


EPISODE = "instrument long, direction string, first_index long, last_index long, n_executions int, volume double, start_us long, end_us long"


def _fold_episodes(max_gap: int, max_gap_us: int, max_events: int, max_us: int, max_count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        out: list[tuple] = []

        def end() -> None:
            if now is not None:
                out.append((now[0], now[1], now[3], now[4], now[7], now[8], now[5], now[6]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = (pa.int64(), pa.utf8(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["instrument", "direction", "first_index", "last_index", "n_executions", "volume", "start_us", "end_us"])
            out.clear()
            return batch

        for batch in batches:
            for inst, segment, side, index, at, qty in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side not in ("BUY", "SELL"):
                    if now is not None and now[0] == inst:
                        end()
                        now = None
                    continue
                goes_on = (
                    now is not None and now[0] == inst and now[1] == side and now[2] == segment and index - now[4] - 1 <= max_gap and at - now[6] <= max_gap_us
                    and index - now[3] + 1 <= max_events and at - now[5] <= max_us and (max_count is None or now[7] < max_count)
                )
                if goes_on:
                    now[4], now[6], now[7], now[8] = index, at, now[7] + 1, now[8] + qty
                else:
                    end()
                    now = [inst, side, segment, index, index, at, at, 1, qty]
            if len(out) > 10_000:
                yield flush()
        end()
        yield flush()

    return run


def episodes(df: DataFrame, max_gap: int = 4, max_gap_us: int = 50_000, max_events: int = 20, max_us: int = 250_000, max_count: int | None = None) -> DataFrame:
    """Executions (instrument, segment, side, event_index, at_us, qty) to episodes of one direction.

    An episode goes on while direction and segment stay, at most max_gap other events and max_gap_us lie between, and
    it spans at most max_events events, max_us and max_count executions from its first. UNKNOWN ends it. The spans are
    counted from the first member, so this is a fold: one pass over each market's sorted events with a constant state.
    """
    narrow = df.select(F.col("instrument").cast("long"), F.col("segment").cast("long"), "side", F.col("event_index").cast("long"), F.col("at_us").cast("long"), F.col("qty").cast("double")).where("side IS NOT NULL")
    return narrow.repartition("instrument").sortWithinPartitions("instrument", "event_index").mapInArrow(_fold_episodes(max_gap, max_gap_us, max_events, max_us, max_count), EPISODE)


def paired_islands(df: DataFrame, max_gap: int, max_gap_us: int) -> DataFrame:
    """The part of episodes() that looks at neighbours only, as gaps and islands."""
    w = ordered("instrument", "event_index")
    e = df.where("side IS NOT NULL")
    same = (F.lag("side").over(w) == F.col("side")) & (F.lag("segment").over(w) == F.col("segment")) & (F.col("event_index") - F.lag("event_index").over(w) - 1 <= max_gap) & (F.col("at_us") - F.lag("at_us").over(w) <= max_gap_us)
    marked = e.withColumn("opens", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("island", F.sum("opens").over(w)).where("side <> 'UNKNOWN'")
    return marked.groupBy("instrument", "island", F.col("side").alias("direction")).agg(F.min("event_index").alias("first_index"), F.max("event_index").alias("last_index"), F.count("*").alias("n_executions"), F.sum("qty").alias("volume"))


def consecutive_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], over: Sequence[str]) -> DataFrame:
    """Numbers the runs of records that agree in keys, in file order within `over`."""
    w = Window.partitionBy(*over).orderBy(*order)
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    first = F.row_number().over(w) == 1
    return df.withColumn("opens", F.when(first, 1).otherwise((~same).cast("int"))).withColumn("group_number", F.sum("opens").over(w)).drop("opens")
