"""News records from JSON files: good rows typed, the others apart with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import identity, text
from tapeloom.functions.taxonomy import CREDIBILITY

NAMESPACE = "d938d8ab-8e1f-5f98-a21e-a3f98a1f1b7a"
_RECORD = (
    "struct<provider:string,source_category:string,provider_record_id:string,title:string,content:string,link:string,published_at:string,received_at:string,processed_at:string,"
    "symbols:array<string>,mentioned_entities:array<string>,language:string>"
)
#: A time without an offset names no instant.
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def _instant(c: str) -> Column:
    return F.when(F.col(c).rlike(_ZONED), F.try_to_timestamp(F.col(c)))


def read_news(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, failures). Each file holds an object with a list `records`; a file without one fails the read.

    A record that is no object fails as RECORD_TYPE, one whose values don't hold as VALIDATION, each by itself. The
    records are kept as text first, so one that doesn't fit the schema can't spoil its neighbours.
    """
    files = spark.read.schema("records string, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    listed = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.from_json("records", "array<string>").alias("records"))
    checked = listed.select("file", F.when(F.col("records").isNull(), F.raise_error(F.lit("a news file must hold a list of records"))).otherwise(F.col("records")).alias("records"))
    rows = checked.select("file", F.posexplode("records").alias("index", "json")).withColumn("r", F.from_json("json", _RECORD))
    flat = rows.select("file", "index", "json", "r.*")
    flat = flat.withColumns({"event_time": _instant("published_at"), "receive_time": _instant("received_at"), "process_time": _instant("processed_at")})
    is_object = F.coalesce(F.trim("json").startswith("{"), F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    problem = (
        F.when(~is_object, "RECORD_TYPE: not an object")
        .when(blank("provider"), "VALIDATION: provider")
        .when(~F.coalesce(F.col("source_category").isin(*CREDIBILITY), F.lit(False)), "VALIDATION: source_category")
        .when(blank("title"), "VALIDATION: title")
        .when(F.col("event_time").isNull() | F.col("receive_time").isNull() | F.col("process_time").isNull(), "VALIDATION: times need an offset")
        .when((F.col("receive_time") < F.col("event_time")) | (F.col("process_time") < F.col("receive_time")), "VALIDATION: times out of order")
    )
    flat = flat.withColumn("problem", problem)
    metadata = F.coalesce(F.get_json_object("json", "$.metadata"), F.lit("{}"))
    items = flat.where("problem IS NULL").select(
        identity.uuid5(NAMESPACE, F.concat_ws(":", "file", "index")).alias("news_id"), F.trim("provider").alias("source"), F.col("source_category").alias("source_type"), F.col("provider_record_id").alias("provider_item_id"),
        F.trim("title").alias("headline"), F.col("content").alias("body"), F.col("link").alias("url"), "event_time", "receive_time", "process_time", text.tickers(F.col("symbols")).alias("provider_tickers"),
        F.coalesce("mentioned_entities", F.array().cast("array<string>")).alias("provider_entities"), "language", metadata.alias("raw_metadata"),
        identity.content_hash(F.col("provider"), F.col("title"), F.col("content"), F.col("link"), F.col("event_time")).alias("content_hash"),
    )
    return items, flat.where("problem IS NOT NULL").select("file", F.col("index").alias("record_index"), F.col("provider_record_id").alias("provider_reference"), "problem")
