from tapeloom.operators import attacks as at
from tapeloom.operators import book

EVENTS = "stream long, sequence long, order_id string, action string, side string, price double, qty double, at_us long"


def test_by_hand(spark):
    rows = [
        ("a", "ADD", "ASK", 10.0, 8.0), ("b", "ADD", "ASK", 10.1, 6.0), ("c", "ADD", "BID", 9.9, 5.0),
        ("a", "EXECUTE", "ASK", 10.0, 3.0), ("a", "EXECUTE", "ASK", 10.0, 5.0), ("b", "EXECUTE", "ASK", 10.1, 2.0),
        ("d", "ADD", "ASK", 10.0, 4.0), ("b", "MODIFY", "ASK", 10.2, 4.0), ("e", "ADD", "ASK", 10.3, 9.0), ("c", "CANCEL", "BID", 9.9, 1.0), ("d", "CANCEL", "ASK", 10.0, 99.0),
    ]
    df = spark.createDataFrame([(1, i, o, a, s, p, q, i) for i, (o, a, s, p, q) in enumerate(rows)], EVENTS)
    trans, shots = book.transitions(df), book.snapshots(df, at.LEVELS)
    found = at.attacks(trans)
    assert [(r.start, r.end, r.direction, r.n, r.volume) for r in found.collect()] == [(3, 5, "BUY", 3, 10.0)]
    levels = at.met_levels(found, shots)
    assert {(r.book_side, r.level, float(r.price), r.base) for r in levels.collect()} == {("ASK", 1, 10.0, 8.0), ("ASK", 2, 10.1, 6.0), ("BID", 1, 9.9, 5.0)}
    recovered = at.level_recoveries(levels, book.depth_changes(trans), (1, 2, 25))
    assert {(r.level, r.horizon): (r.least, r.later, r.ratio) for r in recovered.collect()} == {(1, 1): (0, 4, 0.5), (1, 2): (0, 4, 0.5), (1, 25): (0, 4, 0.5), (2, 1): (4, 4, 0), (2, 2): (4, 0, -2), (2, 25): (4, 0, -2)}
    got = {r.horizon: r for r in at.support(recovered).collect()}
    assert abs(got[1].near_touch - 0.5 / 1.5) < 1e-12 and abs(got[2].near_touch - (0.5 - 1) / 1.5) < 1e-12 and abs(got[2].deep_support + 1 / (0.5 + 1e-6)) < 1e-9
    flow = {r.book_side: r for r in at.region_flow(levels, trans).collect()}
    assert (flow["ASK"].added, flow["ASK"].withdrawn, flow["ASK"].executed, flow["ASK"].attacked) == (4, 4, 10, True)
    assert (flow["BID"].added, flow["BID"].withdrawn, flow["BID"].executed, flow["BID"].attacked) == (0, 1, 0, False)
    toxic = at.toxicity(found, at.tape(shots, trans), at.support(recovered), at.region_flow(levels, trans)).collect()
    assert toxic[0].toxicity is None and toxic[0].missing == "IMPACT,SPREAD,VOLATILITY"
    one = at.credibility(found, trans).collect()[0]
    assert one.n_orders == 2 and abs(one.credibility - (8 * (0.5 + 0.25) + 6 * (0.5 * 2 / 6 + 0.25 * 4 / 6 + 0.25)) / 14) < 1e-9
    assert at.comparisons(found, at.toxicity(found, at.tape(shots, trans), at.support(recovered), at.region_flow(levels, trans)), at.credibility(found, trans)).count() == 0


def test_nothing(spark):
    df = spark.createDataFrame([], EVENTS)
    trans, shots = book.transitions(df), book.snapshots(df, 3)
    levels = at.met_levels(at.attacks(trans), shots)
    assert at.region_flow(levels, trans).count() == 0 == at.support(at.level_recoveries(levels, book.depth_changes(trans))).count()


def test_one_pass(spark):
    """One pass over each stream gives what the joined frames give, with events that don't fit, would cross or reset the book."""
    import random

    rng = random.Random(11)
    rows = []
    for stream in range(4):
        live = {}
        for i in range(700):
            order, what = f"o{rng.randrange(60)}", rng.random()
            side, price, qty = live.get(order, (rng.choice(["BID", "ASK"]), None, 0))
            if what < 0.004:
                rows.append((stream, i, None, "RESET", None, None, None, i))
                live = {}
            elif qty <= 0 or what < 0.05:
                price = round(100 + (-1 if side == "BID" else 1) * rng.randrange(0 if stream < 2 else -1, 6) / 100, 2)
                rows.append((stream, i, order, "ADD", side, price, q := float(rng.randrange(1, 9)), i))
                live.setdefault(order, (side, price, q)) if qty > 0 else live.update({order: (side, price, q)})
            elif what < 0.3:
                moved = round(price + rng.choice([0, 0, 0.01, -0.01]) * (stream > 1), 2)
                rows.append((stream, i, order, "MODIFY", side, moved, q := float(rng.randrange(1, 9)), i))
                live[order] = (side, moved, q)
            else:
                action = "EXECUTE" if what < 0.75 else rng.choice(["CANCEL", "DELETE"])
                q = float(rng.randrange(1, 9)) if what < 0.4 else max(1.0, qty / 2)
                rows.append((stream, i, order, action, side, price, q, i))
                if q <= qty or action == "DELETE":
                    live[order] = (side, price, 0 if action == "DELETE" else qty - q)
        if stream == 3:
            rows = [r for r in rows if r[0] < 3 or r[1] % 41]  # places without an event
    df = spark.createDataFrame(rows, EVENTS).cache()
    trans, shots = book.transitions(df).cache(), book.snapshots(df, at.LEVELS).cache()
    assert shots.where("error = 'CROSSED'").count() > 5 and trans.where("error IS NOT NULL").count() > 5
    found = at.attacks(trans).cache()
    levels = at.met_levels(found, shots)
    toxic = at.toxicity(found, at.tape(shots, trans), at.support(at.level_recoveries(levels, book.depth_changes(trans))), at.region_flow(levels, trans))
    parts = ["flow", "shocks", "impact", "failure", "withdrawal", "spread", "volatility", "toxicity", "credibility"]
    want = {r.attack_id: r for r in toxic.join(at.credibility(found, trans), "attack_id", "left").collect()}
    got = {r.attack_id: r for r in at.scored(at.measured(df)).collect()}
    assert want.keys() == got.keys() and len(want) > 60
    for k, w in want.items():
        g = got[k]
        assert g.missing == w.missing and all((g[c] is None) == (w[c] is None) and (w[c] is None or abs(g[c] - w[c]) < 1e-9) for c in parts), (k, g, w)
    assert at.compared(at.scored(at.measured(df))).count() == at.comparisons(found, toxic, at.credibility(found, trans)).count() > 50
    assert at.measured(df.where("stream < 0")).count() == 0
