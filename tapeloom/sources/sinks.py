"""Writing results so that a second run changes nothing."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConflictError(ValueError):
    """What is stored under the same key differs."""


def save_snapshot(df: DataFrame, path: str, key: str) -> int:
    """Append the keys that aren't stored yet; stored ones must be equal, row for row. Returns the number of new keys.

    Keys are compared by count and an order-free checksum of their rows, so nothing but aggregates is shuffled.
    """
    spark = df.sparkSession
    columns = sorted(df.columns)

    def sums(x: DataFrame) -> DataFrame:
        return x.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))

    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if not exists:
        df.write.parquet(path)
        return df.select(key).distinct().count()
    both = sums(df).alias("a").join(sums(spark.read.parquet(path)).alias("b"), key, "left")
    bad = both.where("b.n IS NOT NULL AND (a.n <> b.n OR a.h <> b.h)").select(key).limit(5).collect()
    if bad:
        raise ConflictError(f"stored rows differ for {[r[0] for r in bad]}")
    new = both.where("b.n IS NULL").select(key)
    count = new.count()
    if count:
        df.join(new, key, "left_semi").select(*df.columns).write.mode("append").parquet(path)
    return count


def export_lines(df: DataFrame, manifest: dict, order: list[str], path: str) -> None:
    """JSON lines: the manifest, then the rows in order, keys sorted, decimals as strings, nulls explicit. Parts are sorted by range; their names keep the order."""
    columns = {c: F.col(c).cast("string") if t.startswith("decimal") else F.col(c) for c, t in df.dtypes}
    body = F.to_json(F.struct(*[v.alias(c) for c, v in sorted({**columns, "record_type": F.lit("research_observation")}.items())]), {"ignoreNullFields": "false"})
    head = df.sparkSession.createDataFrame([(json.dumps({"record_type": "dataset_manifest", "value": manifest}, sort_keys=True, separators=(",", ":"), ensure_ascii=False),)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(body.alias("value")).write.mode("overwrite").text(f"{path}/rows")


def write_artifacts(files: dict[str, bytes], root: str, name: str) -> Path:
    """The files under root/name; an existing folder is reused only if every byte agrees."""
    folder = Path(root) / name
    if folder.exists():
        stored = {p.name: p.read_bytes() for p in folder.iterdir()}
        if stored != files:
            raise ConflictError(f"{folder} holds other files or other content")
        return folder
    folder.mkdir(parents=True)
    for file, content in files.items():
        (folder / file).write_bytes(content)
    return folder
