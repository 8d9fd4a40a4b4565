"""From provider records to market events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.sequences import consecutive_groups

STREAM = ("publisher_id", "instrument_id", "channel_id")
FLAGS = {"maybe_bad_book": 4, "bad_ts_recv": 8, "mbp": 16, "snapshot": 32, "top_of_book": 64, "last": 128}
RECORD_TYPE = 160


def has_flag(name: str, flags: Column | None = None) -> Column:
    return (F.col("flags") if flags is None else flags).bitwiseAND(FLAGS[name]) != 0


def shape_error(price: str = "price", size: str = "size") -> Column:
    priced = F.col("action").isin("A", "C", "M", "T", "F")
    return (
        F.when(F.col("rtype") != RECORD_TYPE, "RECORD_TYPE")
        .when(~F.col("side").isin("A", "B", "N"), "SIDE")
        .when(priced & (F.coalesce(F.col(price), F.lit(0)) <= 0), "PRICE")
        .when(priced & (F.coalesce(F.col(size), F.lit(0)) <= 0), "SIZE")
        .when((F.col("action") == "R") & (F.col("side") != "N"), "RESET_SIDE")
        .when(F.col("ts_event") > F.col("ts_recv"), "CLOCKS")
        .when(has_flag("maybe_bad_book") | has_flag("mbp") | has_flag("top_of_book"), "UNSUPPORTED_FLAG")
        .when(has_flag("bad_ts_recv") & ~has_flag("snapshot"), "BAD_RECEIPT")
    )


def decode_price(fixed: Column) -> Column:
    """Fixed-point prices count units of 1e-9."""
    return (fixed.cast("decimal(28,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(38,9)")


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) for c in sorted(columns)]), 256)


def sequence_findings(df: DataFrame, order: str) -> DataFrame:
    """GAP, REGRESSION or OK against the stream's last sequence; of snapshot rows only the last moves it on."""
    moves = ~has_flag("snapshot") | has_flag("last")
    w = Window.partitionBy(*STREAM).orderBy(order)
    before = F.last(F.when(moves, F.col("sequence")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = F.col("sequence")
    return df.withColumn("finding", F.when(before.isNull() | has_flag("snapshot"), "OK").when(n < before, "REGRESSION").when(n > before + 1, "GAP").otherwise("OK"))


def to_events(df: DataFrame, order: str) -> DataFrame:
    """Runs of records with one sequence become book and trade events, trades after book events.

    A cancel is an execution if its run has a trade and a fill of the same order; fills and notices tell nothing else.
    """
    g = consecutive_groups(df, ["sequence"], [order], STREAM)
    w = Window.partitionBy(*STREAM, "group_number")
    g = g.withColumns({"has_trade": F.max((F.col("action") == "T").cast("int")).over(w) == 1, "filled": F.max((F.col("action") == "F").cast("int")).over(Window.partitionBy(*STREAM, "group_number", "order_id")) == 1})
    a = F.col("action")
    kind = F.when(a == "A", "ADD").when(a == "M", "MODIFY").when(a == "R", "RESET").when((a == "C") & F.col("has_trade") & F.col("filled"), "EXECUTE").when(a == "C", "CANCEL").when(a == "T", "TRADE")
    aggressor = F.when(a == "T", F.when(F.col("side") == "A", "SELL").when(F.col("side") == "B", "BUY").otherwise("UNKNOWN"))
    e = g.withColumns({"event": kind, "aggressor": aggressor}).where("event IS NOT NULL")
    dense = F.row_number().over(Window.partitionBy(*STREAM).orderBy("group_number", (F.col("event") == "TRADE").cast("int"), order)) - 1
    return e.withColumn("event_sequence", dense.cast("long"))


def session(at: Column, zone: str, open_: str = "09:30:00", close: str = "16:00:00", pre: str = "04:00:00", after: str = "20:00:00") -> Column:
    """PREMARKET, REGULAR, AFTER_HOURS or CLOSED by the exchange's own clock; starts belong to what begins."""
    clock = F.date_format(F.from_utc_timestamp(at, zone), "HH:mm:ss.SSSSSS")
    return F.when((clock >= pre) & (clock < open_), "PREMARKET").when((clock >= open_) & (clock < close), "REGULAR").when((clock >= close) & (clock < after), "AFTER_HOURS").otherwise("CLOSED")


def process_time(received: Column, exchange: Column, offset_us: int | None = None) -> Column:
    """Receipt, or exchange time plus an offset; null where that would be before receipt."""
    if offset_us is None:
        return received
    later = F.timestamp_micros(F.unix_micros(exchange) + offset_us)
    return F.when(later >= received, later)
