import random
from datetime import datetime, timedelta

from tapeloom.operators.known_at import as_known, change_history, match_known, validity_history

T0 = datetime(2023, 1, 1)


def stamp(h):
    return None if h is None else T0 + timedelta(hours=h)


def test_intervals(spark):
    rng = random.Random(3)
    links = [("k" if i % 3 else rng.choice("ab"), f"v{rng.randrange(60)}", rng.choice([None, rng.uniform(-50, 900)]), rng.choice([None, rng.uniform(0, 2000)])) for i in range(400)] + [(None, "v", None, None), ("k", None, None, None)]
    links += links[:20]
    events = [(str(i), rng.choice(["k", "k", "a", "b", "zz", None]), rng.choice([None, rng.uniform(0, 1500)])) for i in range(500)]
    ldf = spark.createDataFrame([(k, v, stamp(a), stamp(b)) for k, v, a, b in links], "key string, value string, f timestamp, t timestamp")
    edf = spark.createDataFrame([(i, k, stamp(t), 1) for i, k, t in events], "id string, key string, at timestamp, value int")
    got = [tuple(r) for r in match_known(edf, "id", "key", "at", validity_history(ldf, "key", "value", "f", "t")).collect()]
    # timestamps hold microseconds, so the bounds are compared as such
    want = {(i, v) for i, k, t in events if t is not None for lk, v, a, b in links if lk is not None and lk == k and v is not None and (a is None or stamp(a) <= stamp(t)) and (b is None or stamp(t) < stamp(b))}
    assert len(got) == len(set(got)) and set(got) == want
    assert match_known(edf.limit(0), "id", "key", "at", validity_history(ldf, "key", "value", "f", "t")).count() == 0
    assert match_known(edf, "id", "key", "at", validity_history(ldf.limit(0), "key", "value", "f", "t")).count() == 0


def test_last_known(spark):
    rng = random.Random(4)
    changes = [("hot" if i % 3 == 0 else f"k{rng.randrange(9)}", rng.choice([None, float(rng.randrange(2000))]), rng.randrange(4), rng.choice(["NEW", "OLD", None]), rng.choice([None, rng.random()])) for i in range(600)]
    changes += changes[:30]
    events = [(i, rng.choice(["hot", f"k{rng.randrange(10)}", None]), rng.choice([None, float(rng.randrange(2100))])) for i in range(300)]
    cdf = spark.createDataFrame([(k, stamp(t), n, s, v) for k, t, n, s, v in changes], "key string, at timestamp, n int, state string, value double")
    edf = spark.createDataFrame([(i, k, stamp(t)) for i, k, t in events], "id int, k string, at timestamp")
    got = {r.id: (r.state, r.value) for r in as_known(edf, "id", "at", {"state": ("k", change_history(cdf, "key", "state", "at", ("n",))), "value": ("k", change_history(cdf, "key", "value", "at", ("n",)))}).collect()}

    def last(k, t, f):
        known = [(c[1], c[2], c[f]) for c in changes if c[0] == k and c[1] is not None and c[f] is not None and t is not None and c[1] <= t]
        return str(max(known)[2]) if known else None

    assert got == {i: (last(k, t, 3), last(k, t, 4)) for i, k, t in events}
