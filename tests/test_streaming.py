import pytest
from pyspark.sql import functions as F

from tapeloom.operators import book as b
from tapeloom.operators import news, seen_ranges
from tapeloom.streaming import streams

BOOK = "stream long, sequence long, order_id string, action string, side string, price double, qty double, at_us long"
NEWS = "news_id string, subtype string, process_time timestamp, tokens array<string>, anchors array<string>, source string, confirms boolean"


def in_batches(spark, rows, schema, folder, n=3):
    """The rows as n files, read one a micro-batch in order."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


ORDERS = [(1, i, str(i // 3 + (i % 3 == 1 and i > 40) * 1000), ("ADD", "MODIFY", "EXECUTE")[i % 3], "BID", 10.0 - (i // 3) % 4, 5.0, i) for i in range(60)]


def test_books(spark, tmp_path):
    got = drained(streams.snapshots(in_batches(spark, ORDERS, BOOK, tmp_path / "b"), 3), "books")
    want = b.snapshots(spark.createDataFrame(ORDERS, BOOK), 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_clusters(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(f"n{i:03d}", "COMPANY.EARNINGS" if i % 4 else "MACRO.CPI", datetime(2023, 1, 1) + timedelta(hours=i), [f"t{i % 5}", "x"], [f"a{i % 5}"], f"s{i % 3}", i % 7 == 0) for i in range(60)]
    got = drained(streams.cluster(in_batches(spark, rows, NEWS, tmp_path / "n")), "clusters")
    want = news.cluster(spark.createDataFrame(rows, NEWS))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


RAW = "news_id string, source string, provider_item_id string, content_hash string, receive_time timestamp"


def test_copies(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(f"n{i:03d}", "S", None if i % 11 == 0 else f" ab-{i % 20:x}", f"h{i % 13}", datetime(2023, 1, 1) + timedelta(minutes=i)) for i in range(90)]
    want = {r.news_id for r in seen_ranges.mark_copies(spark.createDataFrame(rows, RAW)).where("kept").collect()}
    assert {r.news_id for r in drained(streams.first_copies(in_batches(spark, rows, RAW, tmp_path / "r")), "copies").collect()} == want
    q = streams.accept_batches(in_batches(spark, rows, RAW, tmp_path / "r2"), str(tmp_path / "kept"), str(tmp_path / "seen"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r.news_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == want


@pytest.mark.parametrize("late_minutes,counted", [(30, True), (600, False)])
def test_periods(spark, tmp_path, late_minutes, counted):
    from datetime import datetime, timedelta

    t0 = datetime(2023, 1, 2)
    schema = "k string, t timestamp, quantity double"
    rows = [("a", t0, 1.0), ("a", t0 + timedelta(hours=20), 1.0), ("a", t0 + timedelta(hours=20), 1.0), ("a", t0 + timedelta(hours=20) - timedelta(minutes=late_minutes), 1.0)]
    out = drained(streams.period_counts(in_batches(spark, rows, schema, tmp_path / f"p{late_minutes}", len(rows)), "k", "t"), f"periods{late_minutes}", "update")
    assert (out.agg(F.countDistinct("period_start")).first()[0] == 3) == counted
