"""The stateful operators over Structured Streaming.

Books, clusters and accepted messages come out as from their batch forms, for input in order or within its lateness bound.
Period counts and news flow are the plain windowed sums: they close a period by the watermark of the whole stream, where the
batch form judges each receipt against its own period.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tapeloom.operators import news, seen_ranges
from tapeloom.operators.book import SNAPSHOT, Book, exact_levels, scaled


def first_copies(stream: DataFrame, bound: str = "24 hours") -> DataFrame:
    """One row a message of those that come within `bound` of each other; state older than that is dropped."""
    item = F.nullif(F.regexp_replace("provider_item_id", r"^[ \t\r\n]+|[ \t\r\n]+$", ""), F.lit(""))
    key = F.when(item.isNotNull(), F.concat(F.lit("i"), item)).otherwise(F.concat(F.lit("c"), F.col("content_hash")))
    return stream.withColumn("message_", key).withWatermark("receive_time", bound).dropDuplicatesWithinWatermark(["source", "message_"]).drop("message_")


def accept_batches(stream: DataFrame, accepted: str, seen: str, checkpoint: str) -> StreamingQuery:
    """Deliveries against ranges seen in all earlier ones, without a time bound.

    Each micro-batch reads the merged ranges as the one before it left them and writes its own, and what is new, under its number, so
    a replayed one overwrites itself. The ranges before the last are removed, so neither plan nor folder grows with the batches.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{seen}/state={number - 1}") if number else None
        carry = [c for c in batch.columns if c != "news_id"]
        kept = seen_ranges.mark_copies(batch, carry=carry, seen=known).where("kept").drop("kept")
        kept.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        own = seen_ranges.seen_ranges(batch)
        seen_ranges.merge_ranges(own if known is None else known.unionByName(own)).write.mode("overwrite").parquet(f"{seen}/state={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{seen}/state={number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def period_counts(stream: DataFrame, key: str, event_time: str, cutoff: str = "2 hours", period: str = "1 hour") -> DataFrame:
    """Counts and traded volume by period of event time, corrected until the watermark has passed the period by the cut-off."""
    return stream.withWatermark(event_time, cutoff).groupBy(F.window(event_time, period).alias("w"), key).agg(F.count("*").alias("n"), F.sum("quantity").alias("volume")).select(key, F.col("w.start").alias("period_start"), "n", "volume")


def news_flow(stream: DataFrame, window: str = "15 minutes", slide: str = "5 minutes", bound: str = "1 hour") -> DataFrame:
    return stream.withWatermark("process_time", bound).groupBy(F.window("process_time", window, slide).alias("w"), "source").agg(F.size(F.collect_set("content_hash")).alias("volume")).select("source", F.col("w.end").alias("as_of"), "volume")


def _cluster(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    clusterer = pickle.loads(state.get[0]) if state.exists else news.Clusterer(key[0].split(".")[0])
    rows = pd.concat(list(parts)).sort_values(["process_time", "news_id"], kind="stable")
    out = [(r.news_id, *clusterer.add(r.news_id, r.process_time.timestamp(), set(r.tokens), set(r.anchors), r.source, bool(r.confirms))) for r in rows.itertuples()]
    state.update((pickle.dumps(clusterer),))
    frame = pd.DataFrame(out, columns=["news_id", "decision", "event_key", "revision_number", "event_state"])
    yield frame.astype({"revision_number": "Int32"})


def cluster(stream: DataFrame) -> DataFrame:
    """Online clustering by subtype; the state holds the events of the last 36 h. Batches must come in the order of process_time."""
    return stream.groupBy("subtype").applyInPandasWithState(_cluster, news.CLUSTERED, "state binary", "append", "NoTimeout")


def _book(k: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = pickle.loads(state.get[0]) if state.exists else Book()
        rows = pd.concat(list(parts)).sort_values("sequence")
        out = [(key[0], r.sequence, *book.step(k, r.order_id, r.action, r.side, *(None if pd.isna(x) else int(x) for x in (r.price, r.qty)))) for r in rows.itertuples()]
        state.update((pickle.dumps(book),))
        yield pd.DataFrame(out, columns=["stream", "sequence", "bids", "asks", "error"])

    return run


def snapshots(stream: DataFrame, k: int = 5) -> DataFrame:
    """Books kept across micro-batches, one a stream; batches must come in the order of sequence."""
    return exact_levels(scaled(stream).groupBy("stream").applyInPandasWithState(_book(k), SNAPSHOT, "state binary", "append", "NoTimeout"))
