"""Encoding of texts by a byte-level BPE vocabulary, in linear time, and decoding.

Merging pairs by rank looks at a piece again and again. Here the longest tokens at each position come from one pass of an Aho-Corasick
automaton, and a token is accepted if merging by rank would leave a boundary between it and the token before; this
is decided by walking down the merges on both sides of the boundary, and kept in a table of pairs. Where no token
fits, the last one is taken back and a shorter one tried; a position found dead isn't entered again, which keeps
the work linear. The result is the merges' own, token by token.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The folder of the public vocabularies; a parameter of everything below.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: how text is split before the merges. White space is Unicode's, as in the vocabulary's own library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces of which the ids are kept, and the longest that are.
CACHED_PIECES, CACHED_LENGTH = 500_000, 40


def _byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes the bytes: printable ones as they are, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary in which a merged token's id grows with the rank of its merge."""

    def __init__(self, content: bytes) -> None:
        model = json.loads(content)["model"]
        letter = _byte_letters()
        self.tokens: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in model["vocab"].items() if all(c in letter for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.left = {i: i for i in self.tokens}
        self.right = dict(self.left)
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            self.left[whole], self.right[whole], self.pair[a, b] = a, b, whole
        self.size = {i: len(t) for i, t in self.tokens.items()}
        merged = set(self.pair.values())
        ids = {t: i for i, t in self.tokens.items() if len(t) == 1 or i in merged}
        self.longest_prefix = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
            self.longest_prefix[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT).findall
        n = max(self.tokens) + 1
        sizes = np.zeros(n, np.int64)
        for i, k in self.size.items():
            sizes[i] = k
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(n)), np.uint8)

    def fits(self, a: int, b: int) -> bool:
        """Merging by rank leaves a boundary between tokens a and b that stand side by side.

        The boundary is crossed if some pair of parts that touch at it merges before both have grown further. Going
        back in time, the side that was merged last is taken apart first; `bound` is the rank before which a merge across would have come.
        """
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        x, y, bound, out = a, b, 1 << 62, True
        while True:
            across = self.pair.get((x, y))
            if across is not None and across < bound:
                out = False
                break
            whole_x, whole_y = self.left[x] == x, self.left[y] == y
            if whole_x and whole_y:
                break
            if not whole_x and (whole_y or x > y):
                bound, x = x, self.right[x]
            else:
                bound, y = y + 1, self.left[y]
        if len(self.compatible) > 4_000_000:
            self.compatible.clear()
        self.compatible[a, b] = out
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        longest = [-1] * len(text)
        size = self.size
        for end, token in self.automaton.iter(text):
            start = end + 1 - size[token]
            if longest[start] < 0 or size[longest[start]] < size[token]:
                longest[start] = token
        alive = bytearray(b"\1") * (len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            before = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if alive[end] and (before < 0 or self.fits(before, token)):
                    break
                token = self.longest_prefix[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(text) else -1
            else:
                alive[at] = 0
                last = out.pop()
                at -= size[last]
                token = self.longest_prefix[last]
        return out

    def encode_into(self, text: str, out: array) -> None:
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= CACHED_LENGTH:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        i = np.fromiter(ids, np.int64)
        start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(maxsize=2)
def load(content: bytes) -> ByteBPE:
    return ByteBPE(content)


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> bytes:
    with open(f"{folder}/{name}.json", "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): every document once, without special tokens (their strings in a text are ordinary text).

    Null and empty texts have an empty list. Texts are read whole; rows stay where they are, without a shuffle. The
    vocabulary file (a fixed few MB) is read once and broadcast, so executors need no copy of it.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        for batch in batches:
            ids, offsets = array("i"), array("i", [0])
            for t in batch.column(1):
                if t.is_valid:
                    bpe.encode_into(t.as_py(), ids)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc"), docs[text].alias("text")).mapInArrow(run, f"doc {kind}, ids array<int>").withColumnRenamed("doc", doc_id)


def decode_ids(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, text): what the ids stand for; a null list gives a null, bytes that are no UTF-8 the replacement character."""
    content = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.utf8())], names=["doc", "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(encoded[doc_id].alias("doc"), encoded[ids].alias("ids")).mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", doc_id)
