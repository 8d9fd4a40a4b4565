from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.operators.seen_ranges import SeenRanges, copies, mark_copies, seen_ranges

T0 = datetime(2023, 1, 1)
SCHEMA = "news_id string, source string, provider_item_id string, content_hash string, receive_time timestamp, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, p, h, None if t is None else T0 + timedelta(seconds=t), "x") for i, s, p, h, t in rows], SCHEMA)


def by_hand(rows):
    groups = {}
    for i, s, p, h, t in rows:
        p = (p or "").strip(" \t\r\n")
        key = ("i", s, p) if p else ("c", s, h) if h is not None else ("n", i)
        groups.setdefault(key, []).append((t is None, t, i))
    return {x[2] for g in groups.values() for x in sorted(g)[1:]}


ROWS = [
    ("a", "S", "AB/0012", "h", 5), ("b", "S", " AB/0012\t", "h", 3), ("c", "S", "AB/12", "h", 1), ("d", "T", "AB/0012", "h", 1),
    ("e", "S", "ab/0012", "h", 1), ("f", "S", None, "h", 9), ("g", "S", "", "h", 8), ("h", "S", " ", "h", 8), ("i", "S", None, None, 8),
    ("j", "S", None, None, 8), ("k", "S", "x-1f", "h", 2), ("l", "S", "x-1f", "h", 2), ("m", "S", "x-01f", "h", 2), ("n", None, "7", "h", 2),
    ("o", None, "7", "h", None), ("p", "", "7", "h", None), ("q", "S", "odd name", "h", 4), ("r", "S", "odd name", "z", 3),
    ("s", "S", "9" * 25, "h", 1), ("t", "S", "9" * 25, "h", 1), ("u", "S", "1048575", "h", 1), ("v", "S", "1048576", "h", 1), ("w", "S", "1048576", "h", 0),
    ("x", "S", "id\n5", "h", 1), ("y", "S", "id\n5", "h", 0), ("z", "S", "q" * 100000 + "1", "h", 0), ("zz", "S", "q" * 100000 + "1", "h", 1),
]


def test_rules(spark):
    df = frame(spark, ROWS)
    assert {r[0] for r in copies(df).collect()} == by_hand(ROWS)
    marked = mark_copies(df, carry=["source"]).collect()
    assert len(marked) == len(ROWS) and {r.news_id for r in marked if not r.kept} == by_hand(ROWS)


def test_empty_and_hot(spark):
    assert copies(frame(spark, [])).count() == 0
    rows = [(f"{i:05d}", "S", "7" if i % 3 == 0 else str(i // 2), "h", -i) for i in range(6000)]
    assert {r[0] for r in copies(frame(spark, rows).repartition(7)).collect()} == by_hand(rows)


def test_later_batch(spark):
    rows = [(f"{i:05d}", "S", f"n{i % 700}" if i % 5 else f"word{'x' * (i % 9)}", "h", i) for i in range(2000)]
    early, late = rows[:900], rows[900:]
    seen = seen_ranges(frame(spark, early))
    kept = mark_copies(frame(spark, early)).where("kept").count() + mark_copies(frame(spark, late), seen=seen).where("kept").count()
    assert kept == len(rows) - len(by_hand(rows))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=12), max_size=8))
def test_ranges(batches):
    seen, plain = SeenRanges(), set()
    for b in batches:
        got = seen.accept(np.array(b, np.int64))
        want = []
        for x in b:
            want.append(x not in plain)
            plain.add(x)
        assert got.tolist() == want
        assert (seen.start[1:] > seen.end[:-1]).all()
        assert {x for s, e in zip(seen.start, seen.end, strict=True) for x in range(s, e)} == plain
