"""Queries that do the whole of a job whose first form, compared with SQL, does a part."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tapeloom.operators import news, research
from tapeloom.plans import news_queries as q
from tapeloom.plans import research_queries as rq

LINKS = "link_id string, entity_id string, instrument_id string, valid_from timestamp, valid_to timestamp"
NEWS = "news_id string, source string, source_type string, headline string, body string, process_time timestamp, provider_tickers array<string>, provider_entities array<string>, entity_id string"


def at(hour, day=2):
    return datetime(2023, 1, day, hour, tzinfo=UTC)


def message(n, hour, headline="", body=None, tickers=(), names=(), entity=None):
    return (n, "s", "NEWSWIRE", headline, body, at(hour), list(tickers), list(names), entity)


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_links_at_each_message(spark, tmp_path):
    links = [("l1", "e1", "i1", at(10), None), ("l2", "e1", "i2", None, at(12))]
    news = [message(f"n{h}", h, entity="e1") for h in (9, 10, 11, 12)] + [message("x", 9)]
    write(spark, tmp_path, raw_news=(news, NEWS), entity_instrument_links=(links, LINKS))
    (row,) = q.jn3_each(spark, str(tmp_path)).collect()  # l1 counts at 10, 11 and 12, l2 at 9, 10 and 11
    assert (row.n_links, row.n_messages, row.n_instruments) == (6, 4, 2)


def test_all_tiers(spark, tmp_path):
    entities = [("e1", "Orvalon Mining Limited", ["Orvalon Mining"]), ("e2", "Skedi Foods plc", ["SFP"]), ("e3", "Velmoria", [])]
    news = [
        message("n1", 9, "Skedi Foods plc hires", "Orvalon Mining follows; no word from ORV"),
        message("n2", 11, "Quiet day", "only ORV moved"),
        message("n3", 9, "Quiet day", "only ORV moved"),
        message("n4", 11, "Velmoria: SFP up", None, ["orv"], ["skedi foods PLC"]),
    ]
    write(spark, tmp_path, raw_news=(news, NEWS), entities=(entities, "entity_id string, canonical_name string, aliases array<string>"), instruments=([("i1", "ORV")], "instrument_id string, ticker string"), entity_instrument_links=([("l1", "e1", "i1", at(10), None)], LINKS))
    got = {tuple(r) for r in q.nw4_tiers(spark, str(tmp_path)).collect()}
    assert got == {("n1", "e2", 4, 0.9, True), ("n1", "e1", 5, 0.85, False), ("n2", "e1", 6, 0.8, True), ("n4", "e1", 1, 1.0, True), ("n4", "e2", 2, 0.95, False), ("n4", "e3", 4, 0.9, False)}
    assert {tuple(r) for r in q.jn13_short(spark, str(tmp_path)).collect()} == {("n1", "e1"), ("n1", "e2"), ("n4", "e2"), ("n4", "e3")}


def test_short_last_block(spark):
    n, size = 11, 4
    label, hit = [i * i for i in range(n)], [i % 3 == 1 for i in range(n)]
    rows = spark.createDataFrame([(i, i // size, i % size, float(label[i]), hit[i]) for i in range(n)], "rank long, block long, place long, label double, hit boolean")
    sizes = research.block_sizes(n, size)
    assert sizes == [4, 4, 3] and research.block_sizes(3, 50) == [3]
    orders = research.block_orders(len(sizes), 8, 3)
    got = {r.permutation: r.statistic for r in research.permuted_means(rows, orders, F.col("hit"), sizes).collect()}
    for p, order in enumerate(orders):
        moved = [label[i] for b in order for i in range(b * size, min(n, b * size + size))]
        kept = [x for x, h in zip(moved, hit, strict=True) if h]
        assert abs(got[p] - sum(kept) / len(kept)) < 1e-9


def test_late_recovery_and_all_labels(spark, monkeypatch):
    depth = [100.0] * 5 + [40.0] + [60.0] * 40 + [100.0] * 300
    states = spark.createDataFrame([("m", i, i, i * 1_000_000, "BUY", 10.0 + i % 7, d) for i, d in enumerate(depth)], "instrument string, event_index long, event_id long, at_us long, side string, mid double, depth double")
    monkeypatch.setattr(rq, "states", lambda *_: states)
    got = {(r.event_id, r.horizon): r.reversal for r in rq.QUERIES["rs4_labels_all_horizons"](spark, "").collect()}
    assert {h for _, h in got} == {10, 25, 50, 100, 250} and got[0, 250] == round(-(250 % 7) / 10, 8) and got[340, 10] is None

    after = spark.createDataFrame([("s", 25, 0.2, 25.0), ("s", 50, 1.0, 50.0)], "shock_id string, horizon int, ratio double, seconds double")
    monkeypatch.setattr(rq, "_after", lambda spark, folder, horizons: after.where(F.col("horizon").isin(*horizons)))
    monkeypatch.setattr(rq.shocks, "resiliency", lambda x: x)
    assert {r.threshold: r.events for r in rq.QUERIES["sr9_wn13_recovery_all_horizons"](spark, "").collect()}[1.0] == 50


def test_fold_exceptions_are_the_folds(spark):
    """Without writing training rows out, the same roles come out as from all of them."""
    import random

    rng = random.Random(8)
    at, index, rows = 0, {}, []
    for i in range(400):
        market = rng.choice("aaab")
        index[market] = index.get(market, -1) + 1
        at += rng.randrange(3)
        rows.append((i, market, index[market], at, index[market] + rng.randrange(1, 9)))
    df = spark.createDataFrame(rows, "id long, market string, i long, at long, label_end long")
    order = ["at", "market", "i", "id"]
    for train, test in ((100, 50), (7, 120), (399, 10), (500, 10)):
        want = research.embargo_and_purge(research.folds(df, order, train, test), "market", "i", "label_end", 4)
        got, sums = research.fold_exceptions(df, order, train, test, "market", "i", "label_end", 4, "id")
        assert {(r.fold, r.role, r.id) for r in got.collect()} == {(r.fold, r.role, r.id) for r in want.where("role <> 'TRAIN'").collect()}
        assert {(r.fold, r.role, r.n, r.total) for r in sums.collect()} == {(r.fold, r.role, r.n, r.total) for r in want.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("id").alias("total")).collect()}


def test_hashed_orders(spark):
    moves = research.hashed_orders(spark, 23, 5, 40, 3).collect()
    by = {}
    for r in moves:
        by.setdefault(r.permutation, []).append((r.start, 5 if r.block < 4 else 3))
    assert len(by) == 40 and len({tuple(sorted(x)) for x in by.values()}) > 1
    for starts in by.values():
        at = 0
        for start, size in sorted(starts):
            assert start == at
            at += size
        assert at == 23


def test_candidates_without_pairs(spark):
    """The counts are those of all pairs; no operator's rows grow with items times events."""
    import random

    rng = random.Random(5)
    mentions = [(rng.choice(["e1", "e2", "e3", None]), rng.choice("ab"), rng.randrange(60)) for _ in range(60)]
    items = [(f"n{rng.randrange(90)}" if i else None, rng.choice(["a", "b", None]), rng.randrange(90) or None, rng.choice(["e1", "e2", None])) for i in range(120)]
    frames = spark.createDataFrame(items, "news_id string, source string, at long, own string"), spark.createDataFrame(mentions, "event_id string, source string, at long")
    want = {}
    for news_id, source, when, own in items:
        for event, by, then in mentions:
            if source == by and when is not None and 0 <= when - then <= 7:
                found, hit = want.setdefault(news_id, (set(), set()))
                found |= {event} - {None}
                hit.add(event is not None and own == event)
    assert {tuple(r) for r in news.candidates(*frames, 7).collect()} == {(n, len(f), any(h)) for n, (f, h) in want.items()}

    many = spark.range(2000).select(F.lit("s").alias("source"), F.col("id").alias("at"), F.col("id").cast("string").alias("event_id"))
    asked = many.select(F.col("event_id").alias("news_id"), "source", "at", F.col("event_id").alias("own"))
    out = news.candidates(asked, many, 10_000)
    assert out.agg(F.sum("n_candidates"), F.min(F.col("own_among_them").cast("int"))).first() == (2000 * 2001 // 2, 1)
    seen = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    out.collect()
    plans, most = [out._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        plans += list(seen(p.children())) + ([p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else [])
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    assert 2000 <= most < 20_000


def test_packed_means(spark):
    """Without a row a label and permutation, the statistics of permuted_means() over the same orders."""
    n, size, count, seed = 2003, 5, 12, 3
    rows = spark.range(n).select(F.col("id").alias("rank"), F.floor(F.col("id") / size).alias("block"), (F.col("id") % size).alias("place"), F.when(F.col("id") % 11 != 4, F.sin("id") * 10).alias("label"), F.when(F.col("id") % 13 != 5, F.col("id") % 3 == 1).alias("hit"))
    want = research.permuted_means(rows, research.hashed_orders(spark, n, size, count, seed), F.col("hit"))
    pieces = research.packed(rows.repartition(7), ["rank"], F.col("label"), F.col("hit"))
    assert pieces.count() <= 8
    got = {r.permutation: r.statistic for r in research.packed_means(pieces, size, count, seed).collect()}
    assert len(got) == count and all(abs(got[r.permutation] - r.statistic) < 1e-9 for r in want.collect())
    observed = rows.where("hit").agg(F.avg("label")).first()[0]
    assert abs(pieces.agg(F.sum("total") / F.sum("hits")).first()[0] - observed) < 1e-12
    turns = [r.t for r in spark.range(20).select(F.xxhash64(F.lit(seed), F.lit(4), "id").alias("t")).collect()]
    assert research.turns(20, 4, seed).tolist() == turns
    nothing = research.packed(rows.where("rank < 0"), ["rank"], F.col("label"), F.col("hit"))
    assert research.packed_means(nothing, size, count, seed).count() == 0
    assert research.packed_means(research.packed(rows.where("rank < 3"), ["rank"], F.col("label"), F.col("rank") > 5), size, count, seed).count() == 0


def test_p_value_without_rows_a_permutation(spark, monkeypatch):
    """rs11_12 gives what p_value() gives of all rows, and writes out no row a label and permutation."""
    states = spark.range(3000).select(F.col("id").alias("event_id"), F.col("id").alias("at_us"), (F.col("id") % 3).alias("instrument"), (100 + F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("mid"), F.when(F.col("id") % 7 < 3, "BUY").alias("side"))
    monkeypatch.setattr(rq, "states", lambda *_: rq.s.event_index(states, "instrument", "at_us", "event_id"))
    monkeypatch.setattr(rq, "market_states", lambda *_: states, raising=False)
    rows, n, size = rq._blocks(spark, "")
    observed = rows.where("side = 'BUY'").agg(F.avg("label")).first()[0]
    want = research.p_value(observed, research.permuted_means(rows, research.hashed_orders(spark, n, size, rq.PERMUTATIONS, rq.SEED), F.col("side") == "BUY")).first()
    monkeypatch.setattr(research, "permuted_means", None)
    got = rq.rs11_12(spark, "").first()
    assert n == 2970 and all(abs(x - y) < 1e-9 for x, y in zip(got, want, strict=True))
