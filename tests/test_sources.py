import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.structural_csv import MBO_FIELDS, split_lines
from tapeloom.run import main
from tapeloom.sources import market_json, mbo_csv, news_json, sinks


def record(**changes):
    base = {"provider": "Wire", "source_category": "WIRE", "provider_record_id": "1", "title": "Title", "content": None, "link": None, "published_at": "2023-01-01T10:00:00+01:00", "received_at": "2023-01-01T09:00:01Z", "processed_at": "2023-01-01T09:00:02Z", "symbols": [" abc ", "ABC", ""], "mentioned_entities": ["X"], "language": "en", "metadata": {"a": [1]}}
    return base | changes


def test_news(spark, tmp_path):
    records = [record(), record(published_at="2023-01-01T10:00:00"), record(title=" "), 5, record(source_category="NOPE"), record(received_at="2022-01-01T00:00:00Z"), record(extra={"deep": 1})]
    (tmp_path / "n.json").write_text(json.dumps({"records": records}))
    items, failures = news_json.read_news(spark, str(tmp_path / "n.json"))
    got = items.collect()
    assert len(got) == 2 and got[0].provider_tickers == ["ABC"] and got[0].event_time == got[1].event_time and json.loads(got[0].raw_metadata) == {"a": [1]}
    assert {r.record_index: r.problem.split(":")[0] for r in failures.collect()} == {1: "VALIDATION", 2: "VALIDATION", 3: "RECORD_TYPE", 4: "VALIDATION", 5: "VALIDATION"}
    (tmp_path / "bad.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="list of records"):
        news_json.read_news(spark, str(tmp_path / "bad.json"))[0].collect()


def event(**changes):
    return {"message_type": "trade_print", "message_id": "m1", "instrument": "i", "venue_code": "V", "sequence_stream": "s", "exchange_timestamp": "2023-01-01T00:00:00Z", "received_timestamp": "2023-01-01T00:00:01Z", "processed_timestamp": "2023-01-01T00:00:02Z", "sequence": 1, "trade_price": "1.50", "trade_size": "2", "aggressor": "BUY"} | changes


def test_market(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1", "events": [event(sequence=2), event(sequence=1, message_id="m0")]}))
    assert [(r.event_id, str(r.price), r.event_kind) for r in market_json.read_market(spark, str(tmp_path / "m.json")).collect()] == [("m0", "1.500000", "TRADE"), ("m1", "1.500000", "TRADE")]
    (tmp_path / "m.jsonl").write_text(json.dumps(event()) + "\n")
    assert market_json.read_market(spark, str(tmp_path / "m.jsonl")).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": "1", "events": [event(trade_price="-1")]}))
    with pytest.raises(Exception, match="price"):
        market_json.read_market(spark, str(tmp_path / "bad.json")).collect()


def test_mbo_files(spark, tmp_path):
    line = "1673366141000046003,1673366140999324002,160,2,439,C,B,263.33,100,1,b1,128,1000,7,DCN"
    text = ",".join(MBO_FIELDS) + "\n" + line + "\n" + "broken\n"
    (tmp_path / "a.csv").write_text(text)
    valid, rejects = split_lines(mbo_csv.read_lines(spark, str(tmp_path / "a.csv")))
    assert valid.count() == 1 and rejects.first().reason == "column_count"
    found = mbo_csv.file_identities(spark, str(tmp_path / "a.csv"))
    want = spark.createDataFrame([("a.csv", hashlib.sha256(text.encode()).hexdigest(), len(text))], "file_name string, sha256 string, bytes long")
    assert mbo_csv.identity_differences(found, want).count() == 0
    assert {r.finding for r in mbo_csv.identity_differences(found, want.withColumn("bytes", F.lit(1).cast("long"))).collect()} == {"MISSING", "UNEXPECTED"}


def test_snapshots_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert sinks.save_snapshot(df, path, "k") == 2
    assert sinks.save_snapshot(df.unionByName(spark.createDataFrame([("c", 4)], "k string, v int")), path, "k") == 1
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(sinks.ConflictError):
        sinks.save_snapshot(spark.createDataFrame([("a", 1), ("a", 9)], "k string, v int"), path, "k")


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, "x")], "id string, n int, s string").withColumn("d", F.lit("1.50").cast("decimal(10,2)"))
    sinks.export_lines(df, {"rows": 2}, ["id"], str(tmp_path / "o"))
    lines = [json.loads(x) for p in sorted((tmp_path / "o/rows").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == [{"d": "1.50", "id": "a", "n": 2, "record_type": "research_observation", "s": "x"}, {"d": "1.50", "id": "b", "n": 1, "record_type": "research_observation", "s": None}]


def test_experiment(spark, tmp_path):
    spec = {"data": "/root/testdata/sf0.001", "least_train": 200, "test": 100, "block": 20, "permutations": 9, "seed": 3, "hypotheses": [{"name": "h1", "side": "BUY"}, {"name": "h2", "side": "SELL"}]}
    (tmp_path / "x.json").write_text(json.dumps(spec))
    args = ["--experiment", str(tmp_path / "x.json"), "--output-root", str(tmp_path / "out")]
    assert main([*args, "--dry-run"]) == 0
    assert main(args) == 0 and main(args) == 0  # the second run agrees byte for byte
    (folder,) = (tmp_path / "out").iterdir()
    assert len(list(folder.iterdir())) == 6
    results = json.loads((folder / "results.json").read_text())
    assert [r["status"] for r in results] == ["RUN", "RUN"] and all(0 < r["p_value"] <= r["bh"] <= 1 for r in results)
    (tmp_path / "bad.json").write_text(json.dumps(spec | {"hypotheses": []}))
    assert main(["--experiment", str(tmp_path / "bad.json")]) == 1
