"""Evaluation items that stand in corpus texts, whole, in part or with their passages in another order.

Greedy string tiling: windows of `least` words that a text and an item share are the seeds, found by a running
Karp-Rabin hash. Seeds on one diagonal grow into maximal matches, compared word by word; the longest match that
overlaps nothing marked becomes a tile, what is left of the others goes back in the queue, and so on. The tiles' share of the item is its
coverage, whatever their order; it says whether the item leaked whole, in another order or in part, and pairs of less coverage can be left out.

Items of up to ITEM_WORDS words together are laid out once and broadcast, and texts never leave their place. Beyond that the
windows of both sides are joined by their hash, and only texts with a shared window are looked at again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage

LEAST_WORDS = 12
#: The most words of items that are broadcast; some 40 bytes each.
ITEM_WORDS = 2_000_000
WORDS = regex.compile(r"[\p{L}\p{Nd}]+").findall
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: The share of an item from which on it leaked as a whole.
WHOLE = 0.8
#: Items looked at together in one text, where windows were joined.
TOGETHER = 1000
PAIRS = "item_id {item}, tiles int, longest int, covered int, coverage double, extent string"


def words_of(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, in lower case."""
    found = WORDS(text)
    return "\n".join(found).lower().split("\n") if found else []


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1  # never 0, which stands for a word in no item


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            factors = np.full(n, BASE, np.uint64)
            factors[0] = 1
            inverse = np.full(n, INVERSE, np.uint64)
            inverse[0] = 1
            self.up, self.down = np.cumprod(factors), np.cumprod(inverse)
        return self.up, self.down


POWERS = Powers()


def running_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of `width` codes, from running sums."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = POWERS(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return (sums[width:] - sums[:n]) * down[:n]


def tile(text: np.ndarray, item: np.ndarray, at_text: np.ndarray, at_item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, start in text, start in item) from the seeds' positions, longest first."""
    diagonal = at_text - at_item
    order = np.lexsort((at_text, diagonal))
    d, t = diagonal[order], at_text[order]
    cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1] + 1))))
    last = np.concatenate((cut[1:], [len(t)])) - 1
    queue: list[tuple[int, int, int]] = []

    def push(free: np.ndarray, a: int, b: int) -> None:
        """Runs of at least `least` true places become matches."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= least:
                heapq.heappush(queue, (lo - hi, a + lo, b + lo))

    for first, end in zip(cut.tolist(), last.tolist(), strict=True):
        a, b, size = int(t[first]), int(t[first] - d[first]), int(t[end] - t[first]) + least
        push(text[a : a + size] == item[b : b + size], a, b)
    marked_text, marked_item, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    while queue:
        size, a, b = heapq.heappop(queue)
        size = -size
        taken = marked_text[a : a + size] | marked_item[b : b + size]
        if taken.any():
            push(~taken, a, b)
            continue
        marked_text[a : a + size] = marked_item[b : b + size] = True
        tiles.append((size, a, b))
    return tiles


class ItemIndex:
    """The items' words and the hashes of their windows, sorted."""

    def __init__(self, items: list[tuple[object, str]], least: int) -> None:
        self.least, self.ids = least, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.codes = []
        hashes, owner, place = [], [], []
        for k, (_, text) in enumerate(items):
            codes = np.fromiter((self.vocabulary.setdefault(w, _code(w)) for w in words_of(text)), np.uint64)
            h = running_hashes(codes, least)
            self.codes.append(codes)
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int64))
            place.append(np.arange(len(h), dtype=np.int64))
        every = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owner, np.int64), (place, np.int64))]
        order = np.argsort(every[0], kind="stable")
        self.hash, self.owner, self.place = (x[order] for x in every)

    def tilings(self, text: str) -> Iterator[tuple[object, int, int, int, float, str]]:
        """(item, tiles, longest, covered, coverage, extent): WHOLE, REORDERED (as much, but not in the item's order) or PART."""
        get = self.vocabulary.get
        codes = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        if len(codes) < self.least or not len(self.hash):
            return
        unknown = np.concatenate(([0], np.cumsum(codes == 0)))
        whole = np.flatnonzero(unknown[self.least :] == unknown[: -self.least])
        if not len(whole):
            return
        h = running_hashes(codes, self.least)[whole]
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = high - low
        if not n.any():
            return
        at = np.repeat(whole, n)
        seed = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner, place = self.owner[seed], self.place[seed]
        order = np.argsort(owner, kind="stable")
        at, owner, place = at[order], owner[order], place[order]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)], strict=True):
            k = int(owner[lo])
            tiles = tile(codes, self.codes[k], at[lo:hi], place[lo:hi], self.least)
            if tiles:
                covered = sum(s for s, _, _ in tiles)
                share = covered / len(self.codes[k])
                places = [b for _, _, b in sorted(tiles, key=lambda x: x[1])]
                yield self.ids[k], len(tiles), max(s for s, _, _ in tiles), covered, share, "PART" if share < WHOLE else "WHOLE" if places == sorted(places) else "REORDERED"


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _batch(ids: list, rows: list, id_type: pa.DataType, item_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = (item_type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.utf8())
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc", "item_id", "tiles", "longest", "covered", "coverage", "extent"])


def _windows(df: DataFrame, id_column: str, text: str, least: int) -> DataFrame:
    """(owner, window): the distinct window hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(codes) > 1_000_000:
                    codes.clear()
                h = np.unique(running_hashes(np.fromiter((codes.setdefault(w, _code(w)) for w in words_of(t)), np.uint64), least))
                ids.extend([i] * len(h))
                out.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["owner", "window"])

    return df.select(df[id_column].alias("owner"), df[text].alias("t")).where("t IS NOT NULL").mapInArrow(run, f"owner {_kind(df, id_column)}, window long")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, item_words: int = ITEM_WORDS, least_coverage: float = 0.0) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, coverage, extent) of each pair that shares `least` or more consecutive words, if its tiles cover `least_coverage` of the item.

    Null texts and texts or items of fewer words share nothing; repeated texts and items each have their own rows. Texts are read
    whole. Extra columns aren't read, whatever their names.
    """
    known = items.select(items[item_id].alias("item"), items[item_text].alias("t")).where("t IS NOT NULL")
    total = known.agg(F.sum(F.size(F.split("t", r"\s+")).cast("long")), F.sum(F.length("t"))).first()
    context = docs.sparkSession.sparkContext
    kind, of_item = _kind(docs, doc_id), _kind(items, item_id)
    schema = f"doc {kind}, " + PAIRS.format(item=of_item)
    narrow = docs.select(docs[doc_id].alias("doc"), docs[doc_text].alias("t")).where("t IS NOT NULL")
    if (total[0] or 0) <= item_words and (total[1] or 0) <= 20 * item_words:
        packed = context.broadcast([(r.item, r.t) for r in known.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(packed.value, least)
            for batch in batches:
                ids, rows = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for row in index.tilings(t):
                        ids.append(i)
                        rows.append(row)
                yield _batch(ids, rows, batch.schema.field(0).type, ITEM_TYPES.get(of_item, pa.utf8()))

        out = narrow.mapInArrow(run, schema)
    else:
        # each side's windows are distinct within a text; a window shared by very many texts is spread over salts of the texts
        salts = 16
        ours = _windows(docs, doc_id, doc_text, least).withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(salts)))
        theirs = _windows(items, item_id, item_text, least).select(F.col("owner").alias("item"), "window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        pairs = cut_lineage(ours.join(theirs, ["window", "salt"]).select(F.col("owner").alias("doc"), "item").distinct())
        both = pairs.join(narrow, "doc").join(known.withColumnRenamed("t", "item_text"), "item").select("doc", "t", "item", "item_text")
        both = both.repartition("doc", F.pmod(F.xxhash64("item"), F.lit(salts))).sortWithinPartitions("doc", "t")

        def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows, at = [], [], 0
                docs_, texts, items_, item_texts = (c.to_pylist() for c in batch.columns)
                while at < len(docs_):  # the items of a text, so that it is split into words once
                    end = at + 1
                    while end < len(docs_) and end - at < TOGETHER and (docs_[end], texts[end]) == (docs_[at], texts[at]):
                        end += 1
                    for row in ItemIndex(list(zip(items_[at:end], item_texts[at:end], strict=True)), least).tilings(texts[at]):
                        ids.append(docs_[at])
                        rows.append(row)
                    at = end
                yield _batch(ids, rows, batch.schema.field(0).type, batch.schema.field(2).type)

        out = both.mapInArrow(run_pairs, schema)
    out = out.where(F.col("coverage") >= least_coverage) if least_coverage > 0 else out
    return out.withColumnRenamed("doc", doc_id).withColumnRenamed("item_id", item_id)


ITEM_TYPES = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "bigint": pa.int64(), "string": pa.utf8()}
