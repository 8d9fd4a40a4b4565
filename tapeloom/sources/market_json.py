"""Market events from JSON (one object with `events`) or JSON lines. A record that doesn't hold fails the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVENT = (
    "message_type string, message_id string, instrument string, venue_code string, sequence_stream string, exchange_timestamp string, received_timestamp string, processed_timestamp string, sequence long, "
    "operation string, book_side string, limit_price string, size string, provider_order_id string, provider_trade_id string, trade_price string, trade_size string, aggressor string, best_bid_price string, best_bid_size string, best_ask_price string, best_ask_size string"
)
KINDS = {"book_update": "BOOK", "trade_print": "TRADE", "top_quote": "QUOTE"}


def read_market(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """The events in market order: stream, sequence, clocks, kind, id."""
    lines = path.endswith(".jsonl") if lines is None else lines
    if lines:
        e = spark.read.schema(_EVENT).option("mode", "FAILFAST").json(path)
    else:
        root = spark.read.schema(f"schema_version string, events array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in _EVENT.split(','))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
        versioned = root.select(F.when(F.col("schema_version").isNull(), F.raise_error(F.lit("schema_version is required"))).otherwise(F.col("events")).alias("events"))
        e = versioned.select(F.explode("events").alias("e")).select("e.*")
    amount = lambda c: F.col(c).cast("decimal(20,6)")
    kind = F.coalesce(*[F.when(F.col("message_type") == k, v) for k, v in KINDS.items()])
    out = e.select(
        F.col("message_id").alias("event_id"), kind.alias("event_kind"), F.col("instrument").alias("instrument_id"), F.col("venue_code").alias("venue"), F.col("sequence_stream").alias("sequence_stream_id"), F.col("sequence").alias("sequence_number"),
        *[F.to_timestamp(a).alias(b) for a, b in (("exchange_timestamp", "exchange_time"), ("received_timestamp", "receive_time"), ("processed_timestamp", "process_time"))],
        F.col("operation").alias("book_action"), "book_side", F.coalesce(amount("limit_price"), amount("trade_price")).alias("price"), F.coalesce(amount("size"), amount("trade_size")).alias("quantity"), F.col("provider_order_id").alias("order_id"), F.col("provider_trade_id").alias("trade_id"), F.col("aggressor").alias("aggressor_side"),
        *[amount(c).alias(c) for c in ("best_bid_price", "best_bid_size", "best_ask_price", "best_ask_size")],
    )
    priced = F.col("event_kind").isin("BOOK", "TRADE") & (F.coalesce("book_action", F.lit("")) != "RESET")
    problem = (
        F.when(F.col("event_kind").isNull(), "unknown message_type")
        .when((F.col("exchange_time") > F.col("receive_time")) | (F.col("receive_time") > F.col("process_time")), "times out of order")
        .when(F.coalesce("sequence_number", F.lit(-1)) < 0, "negative sequence")
        .when(priced & (F.coalesce("price", F.lit(0)) <= 0), "price")
        .when(priced & (F.coalesce("book_action", F.lit("")) != "DELETE") & (F.coalesce("quantity", F.lit(0)) <= 0), "quantity")
        .when(F.col("best_bid_price") > F.col("best_ask_price"), "crossed quote")
    )
    checked = out.withColumn("event_id", F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("market event "), F.coalesce("event_id", F.lit("?")), F.lit(": "), problem))).otherwise(F.col("event_id")))
    rank = F.when(F.col("event_kind") == "BOOK", 0).when(F.col("event_kind") == "TRADE", 1).otherwise(2)
    return checked.orderBy("instrument_id", "venue", "sequence_stream_id", "sequence_number", "exchange_time", "receive_time", "process_time", rank, "event_id")
