"""Passages decoded in another encoding than they were written in: finding them and putting the original back.

Every distinct clean word of the corpus is garbled along every chain of encodings, and the units of the documents are
joined with these forms by hash. A unit is a word (letters and non-ASCII characters) or a bare run of non-ASCII characters, so a
name that stands nowhere else in the corpus is still found by the letters it shares with other words. A word is clean
if it stands in a document of which no unit is sound UTF-8 read as something else and no character is lost. Forms of several
bytes a letter prove themselves; forms by a chain of one-byte encodings can look like other words, so they need length
and either a look that no word has where the original has none (however often they stand in the corpus), or an original
that stands in at least as many distinct texts as they do. What a chain has lost (U+FFFD) comes back only as a whole word
for which the corpus has one original alone.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage, default_parallelism

LOST = "�"


def _pass_through(error: UnicodeError) -> tuple[str | bytes, int]:
    """Bytes that an encoding leaves undefined stand for the control characters of the same number, and back."""
    piece = error.object[error.start : error.end]
    if isinstance(error, UnicodeDecodeError):
        return piece.decode("latin-1"), error.end
    if all(0x80 <= ord(c) <= 0x9F for c in piece):
        return bytes(map(ord, piece)), error.end
    raise error


codecs.register_error("tapeloom-pass", _pass_through)

#: The encodings by script. Text is written in one and read in another; UTF-8 is read as any of them, once or twice over.
WESTERN = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman")
CENTRAL = ("cp1250", "iso8859-2", "cp852")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
OTHER = ("cp1253", "cp1254", "cp1257")
EASTERN = ("gbk", "big5", "euc_kr", "cp932", "euc_jp")
READ_AS = (*WESTERN, *CENTRAL, *CYRILLIC, *OTHER, *EASTERN)
ONE_BYTE = (*WESTERN, *CENTRAL, *CYRILLIC, *OTHER)
#: As what a passage in an older encoding is usually taken; and by any other of its own script or a Western one, which counts only for forms that look wrong or, between Eastern encodings, are rarer.
USUAL = (
    ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp866", "cp1251"), ("cp866", "cp1252"),
    ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859-2", "latin-1"), ("iso8859-2", "cp1252"), ("cp852", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
    ("cp932", "cp1252"), ("cp932", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"),
)
LEGACY = tuple(dict.fromkeys((
    *USUAL, *permutations(CYRILLIC, 2), *permutations(EASTERN, 2), *product((*CYRILLIC, *CENTRAL, *OTHER, *EASTERN), ("cp1252", "latin-1")), *product(("cp437", "cp850", "mac_roman"), ("cp1252", "latin-1")), *product(("cp1252",), ("cp437", "cp850", "mac_roman")),
)))
LOSSY = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp932")

Step = tuple[str, str, str]
PASS = "tapeloom-pass"
CHAINS: tuple[tuple[Step, ...], ...] = (
    *((("utf-8", d, how),) for d in ONE_BYTE for how in (PASS, "replace", "ignore")),
    *((("utf-8", d, how),) for d in EASTERN for how in ("replace", "ignore")),
    *((("utf-8", d, PASS), ("utf-8", e, how)) for d, e in product(ONE_BYTE, repeat=2) for how in ((PASS, "replace", "ignore") if d == e else (PASS,))),
    *((("utf-8", d, PASS), ("utf-8", e, "replace")) for d, e in product(ONE_BYTE, EASTERN)),
    *(((e, d, "replace" if d in EASTERN else PASS),) for e, d in LEGACY),
    *(((e, d, PASS), ("utf-8", f, PASS)) for e in (*CYRILLIC, *CENTRAL) for d in ("cp1252", "latin-1") for f in ("cp1252", "latin-1")),
    *(((e, "utf-8", "replace"),) for e in LOSSY),
)
#: What a byte is in each one-byte encoding, undefined ones being control characters.
LETTERS_OF = {e: "".join(bytes([b]).decode(e, PASS) for b in range(256)) for e in ONE_BYTE}
#: Shorter forms of a chain of legacy encodings prove nothing, and of fewer letters nothing lost comes back.
LEAST_LEGACY, LEAST_LEFT = 4, 2

NON_ASCII = re.compile("[\x80-\U0010ffff]+")
WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")
PLAIN = re.compile("[\u0370-\u052f]+")
CONTROL = re.compile(f"[\x80-\x9f{LOST}]")


def garble(word: str, chain: tuple[Step, ...]) -> str | None:
    for written, read, how in chain:
        try:
            word = word.encode(written, PASS if written != "utf-8" else "strict").decode(read, how)
        except UnicodeError:
            return None
    return word


def garble_all(words: list[str], chain: tuple[Step, ...], done: dict[tuple[Step, ...], tuple[list[int], list[str]]]) -> tuple[list[int], list[str]]:
    """garble() of all words at once, each with its place among them; a line feed keeps them apart, and none of the encodings has one inside a letter."""
    if chain in done:
        return done[chain]
    (written, read, how), first = chain[-1], chain[:-1]
    places, texts = garble_all(words, first, done) if first else (list(range(len(words))), words)
    key = (*first, (written, "", ""))
    if key not in done:  # what was written is the same, whatever it is read as
        try:
            "\n".join(texts).encode(written, "strict")
            done[key] = places, texts
        except UnicodeError:
            sound = [(i, t) for i, t in zip(places, texts, strict=True) if garble(t, ((written, "latin-1", "strict"),)) is not None]
            done[key] = [i for i, _ in sound], [t for _, t in sound]
    places, texts = done[key]
    data = "\n".join(texts).encode(written, PASS if written != "utf-8" else "strict")
    out = (codecs.charmap_decode(data, "strict", LETTERS_OF[read])[0] if how == PASS and read in LETTERS_OF else data.decode(read, how)).split("\n")
    if len(out) != len(texts):  # a letter took the line feed in
        out = [garble(t, chain[-1:]) or "" for t in texts]
    if not first and written == "utf-8" and how == PASS:
        done[chain] = places, out
    return places, out


#: Quotation marks and signs that no text has between two letters, besides all symbols and number signs.
_NEVER_INSIDE = set("¿¡„‚§¶†‡")


def looks_wrong(word: str) -> bool:
    """It has a symbol between letters, a capital beyond ASCII after a small letter, or four Latin letters beyond ASCII on end; a mere row of one or two characters doesn't count."""
    if len(set(word)) < 3:
        return False
    accents, kind, inside = 0, "", False  # kind: of the last letter; inside: only symbols since then
    for c in word:
        if c.isalpha():
            if inside or kind == "small" and c >= "\x80" and c.isupper():
                return True
            kind = "small" if c.islower() else "other"
            accents = accents + 1 if c >= "\x80" and unicodedata.name(c, "").startswith("LATIN ") else 0
            if accents > 3:
                return True
        elif kind and (c in _NEVER_INSIDE or unicodedata.category(c) in ("Sm", "Sc", "Sk", "So", "No", "Cc")):
            accents, inside = 0, True
        else:
            accents, kind, inside = 0, "", False
    return False


def units_of(text: str) -> set[str]:
    """The words and runs of a text that hold anything but ASCII; lone characters only if they mark a loss."""
    out = set()
    for w in WORD.findall(text):
        if not w.isascii():
            if len(w) > 1:
                out.add(w)
            out.update(r for r in NON_ASCII.findall(w) if len(r) > 1 or r == LOST)
    return out


def proves_itself(unit: str) -> bool:
    """Read back as it may have been written, it is sound UTF-8, which clean text is not; but for some Cyrillic and Greek words, by chance."""
    if CONTROL.search(unit):
        return True
    if len(unit) > 2 and (unit.islower() or unit.isupper() or unit[1:].islower()) and PLAIN.fullmatch(unit):
        return False
    for read in ONE_BYTE:
        try:
            unit.encode(read, PASS).decode("utf-8")
        except UnicodeError:
            continue
        return True
    return False


#: Buckets of the table that tells which forms can be met: as many whatever the corpus, a byte each.
BUCKETS_BITS = 22


def bucket(unit: str) -> int:
    return zlib.crc32(unit.encode("utf-8", "surrogatepass")) >> 32 - BUCKETS_BITS


def forms(words: list[str], met: bytes | None = None) -> Iterator[tuple[int, str, str, str, int]]:
    """(place of the word, form as it would stand in a text, the word's part that it stands for, strength, rank) along all chains, each once a rank.

    Strength is "strong" if the form proves itself, "wrong" if it only looks like no word while the original does, else "usual" or
    "rare" by its chain. A form that looks like a word while the original looks like none is no form. Rank is 0 for usual chains, else 1.
    met: by bucket(), whether any text has a unit there; a form of another bucket can't be met and is left out.
    """
    done: dict = {}
    seen: set[tuple[int, str, str, int]] = set()
    sound: dict[int, bool] = {}
    judged: dict[str, bool] = {}
    for chain in CHAINS:
        places, out = garble_all(words, chain, done)
        parts = [(i, w, True) for i, w in zip(places, out, strict=True) if met is None or met[zlib.crc32(w.encode("utf-8", "surrogatepass")) >> 32 - BUCKETS_BITS]]
        rank = int(len(chain) > 1 or chain[0][:2] not in USUAL and (chain[0][0] != "utf-8" or chain[0][1] in EASTERN))
        eastern = chain[-1][1] in EASTERN
        if not {chain[0][0], *(read for _, read, _ in chain)}.isdisjoint(EASTERN):  # they put ASCII into a word; then its pieces are what a text shows as units
            pieces = ((i, w, {*NON_ASCII.findall(w), *WORD.findall(w)}) for i, w in zip(places, out, strict=True) if not w.isascii() and any(c < "\x80" for c in w))
            parts.extend((i, x, False) for i, w, cut in pieces for x in cut if x != w and (met is None or met[bucket(x)]))
        for i, form, whole in parts:
            word = words[i]
            if form == word or form.isascii():
                continue
            kind = "strong" if chain[0][0] == "utf-8" or len(chain) > 1 or LOST in form else "usual" if chain[0][:2] in USUAL else "rare"
            original = word if whole else ""
            if (i, form, kind + original, rank) in seen:
                continue
            seen.add((i, form, kind + original, rank))
            lost, foreign = form.count(LOST), sum(c >= "\x80" for c in form)
            if lost:
                if whole and (len(form) - lost >= LEAST_LEFT or chain[0][0] == "utf-8" and foreign > lost):
                    yield i, form, original, kind, rank
            elif kind == "strong":
                if foreign > 1 or eastern and whole and len(form) >= LEAST_LEGACY:
                    yield i, form, original, kind, rank
            elif len(form) >= LEAST_LEGACY and (foreign > 2 or any(c < "\x80" for c in form)):
                if i not in sound:
                    sound[i] = not looks_wrong(word)
                if form not in judged:
                    judged[form] = looks_wrong(form)
                if sound[i] and judged[form]:
                    yield i, form, original, "wrong", rank
                elif kind == "usual" and (sound[i] or judged[form]) or chain[0][0] in EASTERN and chain[0][1] in EASTERN:
                    yield i, form, original, kind, rank


def _emit_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    proven: dict[str, bool] = {}
    for batch in batches:
        ids, copies, units, clean, lone = [], [], [], [], Counter()
        for doc, text, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text and not text.isascii():
                own = units_of(text)
                if len(proven) > 500_000:
                    proven.clear()
                garbled = False
                for u in own:
                    if u not in proven:
                        proven[u] = proves_itself(u)
                    garbled |= proven[u]
                ids.extend([doc] * len(own))
                copies.extend([copy] * len(own))
                units.extend(own)
                clean.extend([not garbled] * len(own))
                if not garbled:
                    lone.update(set(text))
        alone = sorted(c for c in lone if c >= "\xa0")
        texts = [0] * len(ids) + [lone[c] for c in alone]
        ids.extend([None] * len(alone))
        copies.extend([None] * len(alone))
        units.extend(alone)
        clean.extend([True] * len(alone))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(copies, pa.int64()), pa.array(units, pa.utf8()), pa.array(clean, pa.bool_()), pa.array(texts, pa.int64())], names=["doc", "copy", "unit", "clean", "texts"])


def _emit_forms(met: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not proves_itself(w)]
            # a form that several chains lead to counts once a word
            rows = [(f, o, s, r, pairs[i][1]) for i, f, o, s, r in forms([w for w, _ in pairs], met.value)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.utf8()), pa.array(columns[1], pa.utf8()), pa.array(columns[2], pa.utf8()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64())], names=["form", "original", "strength", "rank", "common"])

    return run


#: Copies of the (small) table of hits, over which a unit that stands in very many documents is spread.
SALT = 16


def document_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, copy, unit, clean, texts), each unit once a document, copy being a hash of the text and clean whether none of its units proves itself garbled; and
    once an Arrow batch, with doc and copy null, each character of clean texts that may stand alone, and in how many of them: "ł" proves "Ĺ‚" though the word around it is new."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("copy")).where("text IS NOT NULL").mapInArrow(_emit_units, f"doc {kind}, copy long, unit string, clean boolean, texts long")


def garbled_units(units: DataFrame) -> DataFrame:
    """(unit, original) of the units that are a garbled form of a clean word or have lost a character; original is empty where a unit is only a
    piece of a word, or has lost what can't be told.

    Units are counted by distinct texts, so copies of a text have no say in which of two spellings is the clean one. Which
    buckets of a hash table of fixed size have units is gathered first, so that forms no text has needn't be moved.
    """
    counted = cut_lineage(units.groupBy("unit").agg((F.count_distinct("copy") + F.sum("texts")).alias("n"), F.max("clean").alias("clean")))
    used = counted.select(F.shiftright(F.crc32(F.encode("unit", "UTF-8")), 32 - BUCKETS_BITS).cast("int").alias("b")).distinct().toArrow()
    met = np.zeros(1 << BUCKETS_BITS, np.uint8)
    met[used.column(0).to_numpy()] = 1
    sent = units.sparkSession.sparkContext.broadcast(met.tobytes())
    table = counted.where("clean").select("unit", "n").repartition(default_parallelism(units.sparkSession)).mapInArrow(_emit_forms(sent), "form string, original string, strength string, rank int, common long")
    table = table.groupBy("form", "original", "strength", "rank").agg(F.sum("common").alias("common"))
    enough = F.when(F.col("strength") == "usual", F.col("common") >= F.col("n")).otherwise((F.col("strength") != "rare") | (F.col("common") > F.col("n")))
    hits = cut_lineage(counted.join(table, counted.unit == table.form).where(enough).groupBy("unit", "original").agg(F.min("rank").alias("rank"), F.max("common").alias("common")))
    # an original that is a form of another word itself is none: what stands behind it is
    behind = hits.where("original <> ''").select(F.col("unit").alias("original"), F.col("original").alias("behind"), F.col("common").alias("more"))
    seen = hits.join(behind, "original", "left").where("behind IS NULL OR behind <> unit")
    seen = seen.select("unit", F.coalesce("behind", "original").alias("original"), F.coalesce("more", "common").alias("common"), (F.col("rank") + F.when(F.col("behind").isNotNull(), 2).otherwise(0)).alias("far"))
    seen = seen.unionByName(hits.select("unit", F.lit("").alias("original"), F.lit(0).cast("long").alias("common"), F.lit(9).alias("far")))
    seen = seen.unionByName(counted.where(F.col("unit").contains(LOST)).select("unit", F.lit("").alias("original"), F.lit(0).cast("long").alias("common"), F.lit(9).alias("far")))
    best = F.min(F.struct(F.col("original") == "", "far", -F.col("common"), "original")).alias("best")
    nearest = F.min(F.when(F.col("original") != "", F.col("far"))).over(Window.partitionBy("unit"))
    one = seen.withColumn("nearest", nearest).groupBy("unit").agg(best, F.count_distinct(F.when((F.col("original") != "") & (F.col("far") == F.col("nearest")), F.col("original"))).alias("n_"))
    return one.select("unit", F.when(F.col("unit").contains(LOST) & (F.col("n_") > 1), "").otherwise(F.col("best.original")).alias("original"))


def document_hits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, original) of all garbled units, each once a document.

    Null, empty and ASCII-only texts have none, texts are read whole, and repeated texts are judged alike. Other columns
    of docs aren't read. The units are materialised once in the checkpoint folder, as they are counted and looked up.
    """
    units = cut_lineage(document_units(docs, doc_id, text))
    hits = garbled_units(units).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = units.where("doc IS NOT NULL").select("doc", "unit").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALT)).cast("int"))
    return salted.join(hits, ["unit", "salt"]).select(F.col("doc").alias(doc_id), "unit", "original")


def find_garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The doc_id of each document with a garbled passage, restorable or not, once."""
    return document_hits(docs, doc_id, text).select(doc_id).distinct()


def put_back(text: str, pairs: dict[str, str]) -> str:
    """Words first, then what is left in bare runs."""
    text = WORD.sub(lambda m: pairs.get(m[0]) or m[0], text)
    return NON_ASCII.sub(lambda m: pairs.get(m[0]) or m[0], text)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, whole = [], []
        for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            new = put_back(text, {p["unit"]: p["original"] for p in pairs if p["original"]})
            out.append(new)
            whole.append(LOST not in new and units_of(new).isdisjoint(p["unit"] for p in pairs))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.utf8()), pa.array(whole)], names=["doc", "restored", "complete"])


def restore_garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, complete) of the documents with garbled passages: originals put back where the corpus knows them. A text that keeps a lost character isn't complete."""
    kind = docs.schema[doc_id].dataType.simpleString()
    per_doc = document_hits(docs, doc_id, text).groupBy(doc_id).agg(F.collect_list(F.struct("unit", "original")).alias("pairs"))
    joined = docs.select(doc_id, text).join(per_doc, doc_id)
    out = joined.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), "pairs").mapInArrow(_restore, f"doc {kind}, restored string, complete boolean")
    return out.withColumnRenamed("doc", doc_id)
