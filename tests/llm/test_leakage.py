import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm.leakage import ItemIndex, leaked_items, running_hashes, words_of

LEAST = 12


def by_hand(docs, items, least=LEAST):
    out = set()
    for d, t in docs:
        windows = {tuple(w[i : i + least]) for w in [words_of(t or "")] for i in range(len(w) - least + 1)}
        out |= {(d, i) for i, u in items for w in [words_of(u or "")] if any(tuple(w[k : k + least]) in windows for k in range(len(w) - least + 1))}
    return out


def test_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["É", "漢字", "x1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (53, "same " * 30)]
    docs = [(100 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)] + [(1, None), (2, ""), (3, "same, " * 5000), (4, "SAME " * 11)]
    for k in range(30):
        passage = rng.choice(items[:12])[1].split()
        a, n = rng.randrange(20), rng.randrange(9, 20)
        sep = rng.choice([" ", ", ", "\r\n", " – "])
        docs.append((200 + k, "head " + sep.join(passage[a : a + n]).upper() + " tail"))
    ddf = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string")
    idf = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    results = [{(r.doc_id, r.item_id): tuple(r) for r in leaked_items(ddf, idf, item_words=n).collect()} for n in (2_000_000, 0)]
    assert results[0] == results[1] and set(results[0]) == by_hand(docs, items)
    assert results[0][3, 53][2:] == (1, 30, 30, 1.0, "WHOLE")
    assert leaked_items(ddf.limit(0), idf).count() == 0 and leaked_items(ddf, idf.limit(0)).count() == 0


def test_reordered_passages():
    a, b = [" ".join(f"{x}{i}" for i in range(20)) for x in "ab"]
    index = ItemIndex([("i", f"{a} {b}")], LEAST)
    assert list(index.tilings(f"{b} and {a}")) == [("i", 2, 20, 40, 1.0, "REORDERED")]
    assert list(index.tilings(f"{a}, then {b}")) == [("i", 2, 20, 40, 1.0, "WHOLE")]
    assert list(index.tilings(f"x {b} y")) == [("i", 1, 20, 20, 0.5, "PART")]


def test_least_coverage(spark):
    a, b = [" ".join(f"{x}{i}" for i in range(20)) for x in "ab"]
    docs = spark.createDataFrame([(1, f"{b} and {a}"), (2, a), (3, f"{a} {b}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{a} {b}"), (8, a)], "item_id long, text string")
    for words in (2_000_000, 0):
        got = {(r.doc_id, r.item_id): r.extent for r in leaked_items(docs, items, item_words=words, least_coverage=0.8).collect()}
        assert got == {(1, 7): "REORDERED", (3, 7): "WHOLE", (1, 8): "WHOLE", (2, 8): "WHOLE", (3, 8): "WHOLE"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.integers(1, 6))
def test_hashes_tell_windows_apart(values, width):
    h = running_hashes(np.array(values, np.uint64), width)
    windows = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(h) == len(windows)
    assert len(set(h.tolist())) == len(set(windows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.sampled_from("ab"), max_size=30))
def test_tiles(text, item):
    index = ItemIndex([(0, " ".join(item))], 3)
    got = list(index.tilings(" ".join(text)))
    shared = {tuple(text[i : i + 3]) for i in range(len(text) - 2)} & {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
    assert bool(got) == bool(shared)
    for _, tiles, longest, covered, coverage, _ in got:
        assert 3 <= longest <= covered <= len(item) and tiles * 3 <= covered and coverage == covered / len(item)
