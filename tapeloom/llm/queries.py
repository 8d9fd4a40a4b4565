"""The queries p3, p6, p7 and p8, and the SQL some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import byte_bpe, leakage, mojibake, names
from tapeloom.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_names(table(spark, folder, "entity_aliases"), table(spark, folder, "entities"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).select("alias_id", "entity_id")


def p3_spellings(spark: SparkSession, folder: str) -> DataFrame:
    linked = _links(spark, folder).join(table(spark, folder, "entity_aliases").select("alias_id", "alias_key"), "alias_id")
    return linked.groupBy("entity_id").agg(F.count("*").alias("n_rows"), F.countDistinct("alias_key").alias("n_spellings"), F.max("cost").alias("farthest"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_texts(table(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode_texts(docs).withColumn("n_ids", F.size("ids"))
    decoded = byte_bpe.decode_ids(encoded).withColumnRenamed("text", "decoded")
    return docs.join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_tilings(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, folder, "documents"))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restore_garbled(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {"p3_found": p3_found, "p3_spellings": p3_spellings, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_tilings": p7_tilings, "p8_found": p8_found, "p8_restored": p8_restored}

ORACLE: dict[str, str] = {
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p7_found": r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(text, '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(text, '[\p{L}\p{Nd}]+') FROM eval_items WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT side, id, lower(array_to_string(w[k : k + 11], ' ')) AS piece FROM words, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS k))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM windows d JOIN windows i USING (piece) WHERE d.side = 'd' AND i.side = 'i'""",
}
