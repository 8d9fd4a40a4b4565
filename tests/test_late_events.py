import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.operators.late_events import HOUR_US, FingerBTree, corrected_periods, first_receipts, partials

T0 = datetime(2023, 1, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 5), st.integers(0, 9)), max_size=120))
def test_tree_against_dict(steps):
    tree, plain, floor = FingerBTree(2, fan_out=3), defaultdict(lambda: [0, 0]), 0
    for key, n, dice in steps:
        if dice == 0:
            floor = max(floor, key // 2)
            want = sorted((k, v) for k, v in plain.items() if k < floor)
            assert tree.evict_below(floor) == want
            for k, _ in want:
                del plain[k]
        elif key >= floor:
            tree.insert(key, [n, 2 * n])
            plain[key] = [a + b for a, b in zip(plain[key], [n, 2 * n], strict=True)]
        lo, hi = sorted((key, n * 11))
        assert tree.window(lo, hi) == [sum(v[i] for k, v in plain.items() if lo <= k < hi) for i in (0, 1)]
    assert tree.items() == sorted(plain.items())


def by_hand(rows, cutoff_hours):
    first = {}
    for e, g, at, received, q in rows:
        if e is not None and (e not in first or (received if received is not None else 1e18) < (first[e][2] if first[e][2] is not None else 1e18)):
            first[e] = (g, at, received, q)
    out = defaultdict(lambda: [0, 0, Decimal(0), Decimal(0)])
    for g, at, received, q in first.values():
        if g is None or at is None or received is None:
            continue
        p = at // 3600
        late = received >= (p + 1) * 3600
        if received < (p + 1 + cutoff_hours) * 3600:
            out[g, p][late] += 1
            out[g, p][2 + late] += q or 0
    return dict(out)


def test_periods(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        at = rng.choice([rng.randrange(-7200, 200000), 3600, 7199, None])
        received = None if rng.random() < 0.02 else (at or 0) + rng.choice([0, 1, 3600, 7200, 10800, rng.randrange(0, 20000)])
        rows.append((rng.choice([None, f"e{rng.randrange(2500)}"]), "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), at, received, rng.choice([None, Decimal("1.25")])))
    facts = {}
    rows = [(e, *facts.setdefault(e, (g, at)), r, facts.setdefault(("q", e), q)) for e, g, at, r, q in rows]  # copies differ in receipt only
    stamp = lambda s: None if s is None else T0 + timedelta(seconds=s)
    df = spark.createDataFrame([(e, g, stamp(a), stamp(r), q, "clash") for e, g, a, r, q in rows], "e string, g string, a timestamp, r timestamp, q decimal(20,6), tick string")
    events = first_receipts(df, "e", "r", ["g", "a", "q"])
    got = corrected_periods(partials(events, "f", "g", "a", "r", F.col("q"), 2 * HOUR_US)).collect()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) // 3600
    assert {(x.group_key, x.period - base): [x.n_in_time, x.n_late, x.volume_in_time, x.volume_late] for x in got} == by_hand(rows, 2)
    assert corrected_periods(partials(events.limit(0), "f", "g", "a", "r", F.col("q"), 2 * HOUR_US)).count() == 0
