"""Point-in-time reads: what was valid, known or latest at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Half-open validity; a null bound is open."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_to.isNull() | (valid_to > at))


def latest_as_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], known: str, at: Column) -> DataFrame:
    """Of each key the newest row known by then."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.where(F.col(known) <= at).withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def scan_as_of(df: DataFrame, known: str, at: Column, order: Sequence[str]) -> DataFrame:
    return df.where(F.col(known) <= at).orderBy(*order)


def forward_asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """For each row of left the first row of right with the same key at or after its time: one sort of both sides together.

    Columns of left stay; `value` and right_at of the match are added as null where there is none.
    """
    a = left.select(key, F.col(left_at).alias("at_"), F.struct(*left.columns).alias("row_"), F.lit(None).cast(right.schema[value].dataType).alias("value_"), F.lit(None).cast(right.schema[right_at].dataType).alias("when_"))
    b = right.select(F.col(key), F.col(right_at).alias("at_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), F.col(value).alias("value_"), F.col(right_at).alias("when_"))
    # backwards in time, so that the frame only ever grows; of rows of right at the same time the least value counts
    w = Window.partitionBy(key).orderBy(F.desc("at_"), F.col("row_").isNotNull(), F.desc("value_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.last(F.when(F.col("row_").isNull(), F.struct("value_", "when_")), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("hit_", hit).where("row_ IS NOT NULL").select("row_.*", F.col("hit_.value_").alias(value), F.col("hit_.when_").alias(right_at))


def resolve(typed: DataFrame, names: DataFrame, key: str, target: str) -> DataFrame:
    """Names looked up by key: RESOLVED with the one target, AMBIGUOUS, or NOT_FOUND; one row an input row."""
    known = names.groupBy(key).agg(F.countDistinct(target).alias("n_"), F.min(target).alias("target_"))
    joined = typed.join(known, key, "left")
    status = F.when(F.col("n_").isNull(), "NOT_FOUND").when(F.col("n_") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return joined.withColumn("status", status).withColumn(target, F.when(F.col("n_") == 1, F.col("target_"))).drop("n_", "target_")
