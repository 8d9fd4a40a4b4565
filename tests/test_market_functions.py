import math
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import identity, text
from tapeloom.functions import market as m
from tapeloom.operators import book, news, research, shocks
from tapeloom.operators import sequences as s


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_book_measures(spark):
    d = F.lit
    got = one(
        spark,
        micro=m.microprice(d(100.0), d(150.0), d(100.01), d(200.0)),
        none=m.microprice(d(100.0), d(0.0), d(100.01), d(0.0)),
        obi=m.imbalance(F.array(d(200.0), d(300.0)), F.array(d(150.0), d(250.0)), 2),
        empty=m.imbalance(F.array().cast("array<double>"), F.array().cast("array<double>"), 2),
        depth=m.weighted_depth(F.array(d(200.0), d(300.0))),
        rr=m.replenishment_ratio(d(900.0), d(600.0), d(700.0)),
        flat=m.replenishment_ratio(d(900.0), d(900.0), d(900.0)),
        unknown=m.bounded_failure(d(None).cast("double")),
    )
    assert math.isclose(got["micro"], (100.01 * 150 + 100.0 * 200) / 350)
    assert got["none"] is None and got["flat"] is None and got["unknown"] is None
    assert math.isclose(got["obi"], 1 / 9) and got["empty"] == 0.0
    assert got["depth"] == 350.0 and math.isclose(got["rr"], 1 / 3)


def test_trend_and_components(spark):
    got = one(spark, a=m.trend(F.lit(1e-6)), b=m.trend(F.lit(-0.1)), c=m.trend(F.lit(0.1)), d=m.impact_component(F.lit(1.0), F.lit(-2.0)), e=m.impact_component(F.lit(0.0), F.lit(0.0)), f=m.bounded_excess(F.lit(0.5)), g=m.bounded_excess(F.lit(3.0)), h=m.flow_direction(F.lit(0.0)))
    assert got == {"a": "STABLE", "b": "WEAKENING", "c": "STRENGTHENING", "d": 0.0, "e": 0.0, "f": 0.0, "g": 2 / 3, "h": "NEUTRAL"}
    with pytest.raises(ValueError):
        m.convex((F.lit(1.0), 0.5))


def test_uuid5(spark):
    space = "f137d5c2-53a8-4dcf-a112-d48e3cc54d8e"
    names = ["", "a", "ü|漢", "x" * 5000, None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.uuid5(space, F.col("n")).alias("u"))
    for r in df.collect():
        assert r.u == (None if r.n is None else str(uuid.uuid5(uuid.UUID(space), r.n)))


def test_normal_form(spark):
    texts = ["ﬁnal  Consumer Price Index!", "Share-repurchase… STRASSE straße", "so­ft ​", "", None, "ＡＢＣ １２"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normal_form(F.col("t")).alias("n"), text.tokens(text.normal_form(F.col("t"))).alias("k"))
    got = {r.t: (r.n, r.k) for r in df.collect()}
    assert got[texts[0]][0] == "final cpi"
    assert got[texts[1]][0] == "buyback strasse strasse"
    assert got[texts[2]][0] == "soft" and got[""][0] == "" and got[None][0] is None
    assert got[texts[5]][0] == "abc 12"
    assert spark.createDataFrame([("The merger rose",)], "t string").select(text.tokens(text.normal_form(F.col("t")))).first()[0] == ["acquire", "increase"]


def test_classes(spark):
    rows = [("Antitrust suit and guidance", "WIRE", "REGULATORY.ANTITRUST"), ("Fed official in remarks", "WIRE", "RATE.CENTRAL_BANK_SPEECH"), ("Remarks at dinner", "WIRE", "COMPANY.OTHER"), ("nothing", "SEC", "COMPANY.SEC_FILING"), ("Quarterly results", "WIRE", "COMPANY.EARNINGS"), ("unsuedx", "GOVERNMENT", "REGULATORY.OTHER")]
    df = spark.createDataFrame(rows, "t string, s string, want string").withColumn("got", text.classify(text.normal_form(F.col("t")), F.col("s"))["subtype"])
    assert all(r.got == r.want for r in df.collect())


def test_noisy_or(spark):
    assert math.isclose(one(spark, x=news.noisy_or(F.array(F.lit(0.2), F.lit(0.3))))["x"], 0.44)
    assert one(spark, x=news.noisy_or(F.array().cast("array<double>")))["x"] == 0.0


def test_corrections(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    got = {r.k: (round(r.bonferroni, 9), round(r.bh, 9)) for r in research.corrections(df, "f", "p", "k").collect()}
    assert got == {"a": (0.03, 0.03), "b": (0.12, 0.04), "c": (0.09, 0.04)}


def test_exact_median_and_rank(spark):
    df = spark.createDataFrame([("a", Decimal(x)) for x in ("1.10", "2.20", "3.30", "3.30")] + [("b", Decimal("5"))] + [("c", None)], "k string, v decimal(20,6)")
    assert {r.k: r.median for r in research.exact_median(df, ["k"], "v").collect()} == {"a": Decimal("2.75"), "b": Decimal(5)}
    assert {r.k: r.percentile for r in research.nearest_rank(df, ["k"], "v", "0.5").collect()} == {"a": Decimal("2.2"), "b": Decimal(5)}


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "v int, i int").repartition(5)
    assert [r["rank"] for r in research.global_rank(df, ["v", "i"]).orderBy("v", "i").collect()] == list(range(1000))
    assert research.global_rank(df.limit(0), ["v"]).count() == 0


def test_permutation_by_hand(spark):
    rows = [(b, p, float(b * 10 + p), p == 0) for b in range(4) for p in range(3)]
    df = spark.createDataFrame(rows, "block long, place long, label double, hit boolean")
    orders = research.block_orders(4, 20, 7)
    got = {r.permutation: r.statistic for r in research.permuted_means(df.where("block < 4"), orders, F.col("hit")).collect()}
    assert got == {i: sum(b * 10 for b in o) / 4 for i, o in enumerate(orders)}
    half = {r.permutation: r.statistic for r in research.permuted_means(df, orders, F.col("hit") & (F.col("block") < 2)).collect()}
    assert half == {i: sum(b * 10 for b in o[:2]) / 2 for i, o in enumerate(orders)}


EVENTS = "stream long, sequence long, order_id string, action string, side string, price double, qty double, at_us long"


def test_book_by_windows_and_replay_agree(spark):
    import random

    rng, live, rows = random.Random(11), {}, []
    for seq in range(600):
        kind = rng.random()
        if kind < 0.01:
            rows.append((1, seq, None, "RESET", None, None, 0.0, seq))
            live = {}
        elif kind < 0.45 or not live:
            o = f"o{seq}"
            live[o] = [rng.choice(["BID", "ASK"]), 0.0, float(rng.randrange(1, 9))]
            live[o][1] = 99.0 - rng.randrange(5) if live[o][0] == "BID" else 101.0 + rng.randrange(5)
            rows.append((1, seq, o, "ADD", *live[o], seq))
        else:
            o = rng.choice(sorted(live))
            side, price, qty = live[o]
            what = rng.choice(["MODIFY", "CANCEL", "EXECUTE", "DELETE"])
            if what == "MODIFY":
                live[o][2] = float(rng.randrange(1, 9))
                live[o][1] = price + rng.choice([-1, 0, 1]) if 90 < price < 98 or price > 102 else price
                rows.append((1, seq, o, what, *live[o], seq))
            else:
                part = qty if what == "DELETE" else float(rng.randrange(1, int(qty) + 1))
                rows.append((1, seq, o, what, side, price, part, seq))
                live[o][2] -= part
                if live[o][2] <= 0:
                    del live[o]
    df = spark.createDataFrame(rows, EVENTS)
    trans = book.transitions(df)
    assert trans.where("error IS NOT NULL").count() == 0 == book.snapshots(df).where("error IS NOT NULL AND error <> 'CROSSED'").count()
    levels = {(r.side, r.price): (r.depth, r.orders) for r in book.final_levels(book.depth_changes(trans)).collect()}
    want = {}
    for side, price, qty in live.values():
        q, n = want.get((side, price), (0.0, 0))
        want[side, price] = (q + qty, n + 1)
    assert levels == want
    last = book.snapshots(df, 100).orderBy(F.desc("sequence")).first()
    assert {(side, x["price"]): (x["qty"], x["orders"]) for side, xs in (("BID", last.bids), ("ASK", last.asks)) for x in xs} == want


def test_errors_leave_the_book(spark):
    rows = [(1, 0, "a", "ADD", "BID", 10.0, 5.0, 0), (1, 1, "a", "ADD", "BID", 10.0, 5.0, 1), (1, 2, "b", "CANCEL", "BID", 10.0, 1.0, 2), (1, 3, "a", "EXECUTE", "BID", 10.0, 9.0, 3), (1, 4, "a", "EXECUTE", "BID", 11.0, 1.0, 4), (1, 5, "a", "CANCEL", "ASK", 10.0, 1.0, 5), (1, 6, "a", "EXECUTE", "BID", 10.0, 2.0, 6)]
    got = book.snapshots(spark.createDataFrame(rows, EVENTS)).orderBy("sequence").collect()
    assert [r.error for r in got] == [None, "DUPLICATE_ORDER", "UNKNOWN_ORDER", "EXCESS_QUANTITY", "PRICE_MISMATCH", "SIDE_MISMATCH", None]
    assert [r.bids[0]["qty"] for r in got] == [5.0] * 6 + [3.0]
    steps = book.transitions(spark.createDataFrame(rows, EVENTS)).orderBy("sequence").collect()
    assert [r.error for r in steps] == [r.error for r in got] and [r.post_qty for r in steps] == [5, 5, 0, 5, 5, 5, 3]


def test_failed_events_change_nothing(spark):
    rows = [(1, 0, "a", "ADD", "BID", 10.0, 10.0, 0), (1, 1, "a", "CANCEL", "BID", 10.0, 15.0, 1), (1, 2, "a", "EXECUTE", "BID", 10.0, 4.0, 2), (1, 3, "b", "ADD", "ASK", 9.99, 1.0, 3), (1, 4, "c", "ADD", "ASK", 10.0, 1.0, 4), (1, 5, "c", "MODIFY", "ASK", 9.5, 1.0, 5), (1, 6, "b", "DELETE", "ASK", None, None, 6)]
    df = spark.createDataFrame(rows, EVENTS)
    shots = book.snapshots(df)
    assert [r.error for r in shots.orderBy("sequence").collect()] == [None, "EXCESS_QUANTITY", None, "CROSSED", None, "CROSSED", "UNKNOWN_ORDER"]
    trans = book.transitions(df, shots.where("error = 'CROSSED'"))
    got = {r.sequence: r for r in trans.collect()}
    assert [float(got[i].post_qty) for i in range(3)] == [10, 10, 6] and [float(got[i].withdrawn) for i in range(3)] == [0, 0, 0] and got[6].error == "UNKNOWN_ORDER"
    assert {(r.side, float(r.price)): (float(r.depth), r.orders) for r in book.final_levels(book.depth_changes(trans)).collect()} == {("BID", 10.0): (6, 1), ("ASK", 10.0): (1, 1)}
    life = {r.order_id: r for r in book.lifecycles(trans).collect()}
    assert set(life) == {"a", "c"} and life["a"].balanced and life["a"].executed_share == 0.4


def test_episodes_by_hand(spark):
    import random

    rng = random.Random(4)
    rows, at = [], 0
    for i in range(500):
        at += rng.choice([1_000, 20_000, 60_000])
        rows.append((7, i // 120, rng.choice(["BUY", "BUY", "SELL", "UNKNOWN", None]), i, at, 1.0))
    df = spark.createDataFrame(rows, "instrument long, segment long, side string, event_index long, at_us long, qty double")
    got = sorted((r.first_index, r.last_index, r.direction, r.n_executions) for r in s.episodes(df).collect())
    want, cur = [], []
    for r in [r for r in rows if r[2] is not None]:
        if r[2] == "UNKNOWN":
            cur = cur and want.append(cur) or []
            continue
        if cur and not (cur[-1][2] == r[2] and cur[-1][1] == r[1] and r[3] - cur[-1][3] - 1 <= 4 and r[4] - cur[-1][4] <= 50_000 and r[3] - cur[0][3] + 1 <= 20 and r[4] - cur[0][4] <= 250_000):
            want.append(cur)
            cur = []
        cur.append(r)
    want += [cur] if cur else []
    assert got == sorted((c[0][3], c[-1][3], c[0][2], len(c)) for c in want if c)


def test_first_passage(spark):
    df = spark.createDataFrame([("s", h, r, float(h)) for h, r in ((2, 0.3), (3, 0.6), (4, 0.8), (5, 1.0))], "shock_id string, horizon int, ratio double, seconds double")
    assert sorted((r.threshold, r.events) for r in shocks.first_passage(df, (0.25, 0.5, 0.75, 1.0, 2.0)).collect()) == [(0.25, 2), (0.5, 3), (0.75, 4), (1.0, 5), (2.0, None)]


def test_nothing_ahead_changes_features(spark):
    rows = [(1, i, 100 + (i * 37 % 11) / 10, "BUY" if i % 2 else "SELL", float(i % 5)) for i in range(60)]
    schema = "instrument long, event_index long, mid double, side string, qty double"
    whole, cut = (spark.createDataFrame(r, schema) for r in (rows, rows[:40]))
    for f in (lambda d: s.backward(d, "instrument", "event_index", "mid", (10,)), lambda d: s.rolling_flow(d, "instrument", "event_index", 20)):
        assert {str(r) for r in f(cut).collect()} <= {str(r) for r in f(whole).collect()}


def test_clusters(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2023, 1, 1)
    rows = [
        ("a", "COMPANY.EARNINGS", t0, ["x", "y", "z"], ["abc"], "S", False), ("b", "COMPANY.EARNINGS", t0 + timedelta(minutes=5), ["x", "y", "z"], ["abc"], "T", False), ("c", "COMPANY.EARNINGS", t0 + timedelta(minutes=9), ["x", "y", "z"], ["def"], "T", False),
        ("d", "COMPANY.EARNINGS", t0 + timedelta(hours=1), ["x", "y", "z"], ["abc"], "U", True), ("e", "COMPANY.EARNINGS", t0 + timedelta(hours=60), ["x", "y", "z"], ["abc"], "U", True), ("f", "COMPANY.GUIDANCE", t0, ["x", "y", "z"], ["abc"], "S", False),
    ]
    df = spark.createDataFrame(rows, "news_id string, subtype string, process_time timestamp, tokens array<string>, anchors array<string>, source string, confirms boolean")
    got = {r.news_id: (r.decision, r.event_key, r.revision_number, r.event_state) for r in news.cluster(df).collect()}
    assert got == {"a": ("NEW_EVENT", "a", 1, "NEW"), "b": ("CLUSTERED", "a", 2, "DEVELOPING"), "c": ("NEW_EVENT", "c", 1, "NEW"), "d": ("CLUSTERED", "a", 3, "CONFIRMED"), "e": ("NEW_EVENT", "e", 1, "NEW"), "f": ("NEW_EVENT", "f", 1, "NEW")}
