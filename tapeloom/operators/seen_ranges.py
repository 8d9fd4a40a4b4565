"""One copy of each message out of at-least-once delivery, by ranges of producer sequence numbers already seen.

An identifier such as ``AB/2023/0000343``, ``ab-17e`` or ``1419`` is a template and a number, so the messages of one
(source, template) are points on a line, and what has been accepted is a handful of disjoint ranges instead of a set of
keys. Identifiers that carry no such number, and messages without one (known by their content hash), are looked up by
their exact key.

Two passes. The first looks at each Arrow batch where it lies and settles the copies within it, so a message or source
that holds a third of all rows shrinks to at most one survivor a batch before anything is shuffled. The second brings the survivors
of one block of 2^20 numbers together, sorted by receipt, and runs the same acceptance over the sorted stream; a busy
source is thereby spread over its blocks, and a task holds no more than the ranges of the block it is in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = " \t\r\n"
BLOCK_BITS = 20
#: Numbers longer than these are taken as malformed and go by exact key; both fit in 63 bits.
DECIMAL_ID, HEX_ID = r"\A(?P<p>(?:.|\n)*?)(?P<d>[0-9]{1,18})\z", r"\A(?P<p>(?:.|\n)*-)(?P<d>[0-9a-f]{1,15})\z"


class SeenRanges:
    """Disjoint half-open ranges of accepted numbers, sorted; touching ranges are merged."""

    def __init__(self) -> None:
        self.start = np.zeros(0, np.int64)
        self.end = np.zeros(0, np.int64)

    def covered(self, numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.start, numbers, side="right") - 1
        out = at >= 0
        out[out] = self.end[at[out]] > numbers[out]
        return out

    def add(self, start: np.ndarray, end: np.ndarray) -> None:
        start, end = np.concatenate((self.start, start)), np.concatenate((self.end, end))
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        first = np.concatenate(([True], start[1:] > reach[:-1])) if len(start) else np.zeros(0, bool)
        self.start = start[first]
        self.end = reach[np.concatenate((first[1:], [True]))] if len(start) else reach

    def accept(self, numbers: np.ndarray) -> np.ndarray:
        """Which of the numbers, in the order given, are met for the first time; those are added."""
        distinct, first = np.unique(numbers, return_index=True)
        fresh = ~self.covered(distinct)
        out = np.zeros(len(numbers), bool)
        out[first[fresh]] = True
        new = distinct[fresh]
        if len(new):
            opens = np.concatenate(([True], np.diff(new) > 1))
            closes = np.concatenate((opens[1:], [True]))
            self.add(new[opens], new[closes] + 1)
        return out

    def keep_from(self, bound: int) -> None:
        """Forget the ranges that end at or below bound."""
        keep = self.end > bound
        self.start, self.end = self.start[keep], self.end[keep]


def _identify(source: pa.Array, item: pa.Array, content: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(key, number). number >= 0: the key names source and template. -1: the key is exact. -2: not to be identified.

    Equal keys and numbers mean equal identifiers: the width is part of the template where digits start with a zero.
    """
    text = lambda a: pc.cast(a, pa.large_utf8())
    source, item, content = text(source), pc.utf8_trim(text(item), WHITE), text(content)
    constant = lambda x: pa.scalar(x, pa.large_utf8())
    join = lambda *a: pc.binary_join_element_wise(*a, constant("\0"))
    whose = pc.if_else(pc.is_null(source), constant("0"), pc.binary_join_element_wise(constant("1"), pc.fill_null(source, ""), constant("")))
    named = pc.fill_null(pc.not_equal(item, ""), False)
    hexa, deci = pc.extract_regex(item, HEX_ID), pc.extract_regex(item, DECIMAL_ID)
    is_hex = np.asarray(pc.and_(named, pc.is_valid(hexa)))
    is_dec = np.asarray(pc.and_(named, pc.is_valid(deci))) & ~is_hex
    pick = pa.array(is_hex)
    prefix = pc.fill_null(pc.if_else(pick, pc.struct_field(hexa, "p"), pc.struct_field(deci, "p")), "")
    digits = pc.fill_null(pc.if_else(pick, pc.struct_field(hexa, "d"), pc.struct_field(deci, "d")), "")
    size = pc.utf8_length(digits)
    padded = pc.and_(pc.starts_with(digits, "0"), pc.greater(size, 1))
    width = pc.cast(pc.if_else(padded, pc.cast(size, pa.int64()), 0), pa.large_utf8())
    number = np.full(len(item), -1, np.int64)
    if is_dec.any():
        number[is_dec] = np.asarray(pc.cast(digits.filter(pa.array(is_dec)), pa.int64()))
    if is_hex.any():
        number[is_hex] = [int(x, 16) for x in digits.filter(pick).to_pylist()]
    sequence = join(pc.if_else(pick, constant("h"), constant("d")), whose, width, prefix)
    exact = join(constant("x"), whose, pc.fill_null(item, ""))
    hashed = join(constant("c"), whose, pc.fill_null(content, ""))
    key = pc.if_else(pa.array(number >= 0), sequence, pc.if_else(named, exact, hashed))
    number[~np.asarray(named) & np.asarray(pc.is_null(content))] = -2
    return key, number


def _settle_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The first pass: columns source, item, content, id, received, then what is carried."""
    key, number = _identify(batch.column(0), batch.column(1), batch.column(2))
    order = np.asarray(pc.sort_indices(pa.table({"t": batch.column(4), "i": batch.column(3)}), [("t", "ascending"), ("i", "ascending")]))
    first = np.ones(len(order), bool)
    code = np.asarray(pc.dictionary_encode(key).indices).astype(np.int64)
    group, block = code[order], number[order] >> BLOCK_BITS
    in_sequence = number[order] >= 0
    if in_sequence.any():
        at = np.flatnonzero(in_sequence)
        _, slot = np.unique(np.stack((group[at], block[at])), axis=1, return_inverse=True)
        point = (slot.reshape(-1).astype(np.int64) << (BLOCK_BITS + 1)) | (number[order][at] & ((1 << BLOCK_BITS) - 1))
        first[order[at]] = SeenRanges().accept(point)
    exact = np.flatnonzero(number[order] == -1)
    if len(exact):
        lookup = np.ones(len(exact), bool)
        lookup[:] = False
        lookup[np.unique(group[exact], return_index=True)[1]] = True
        first[order[exact]] = lookup
    again = pa.array(~first)
    none = pa.scalar(None, pa.large_utf8())
    settled = pa.array(~first | (number == -2))
    return pa.RecordBatch.from_arrays(
        [pc.cast(pc.if_else(settled, none, key), pa.utf8()), pc.if_else(settled, pa.scalar(None, pa.int64()), pa.array(number)), pc.invert(again), *batch.columns[3:]],
        names=["key", "number", "kept", *batch.schema.names[3:]],
    )


def _settle_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second pass: rows with a key are sorted by key, block and receipt. reach, if not null, marks a range of an earlier run."""
    seen, slot, last = SeenRanges(), 0, None
    for batch in batches:
        key, number = batch.column(0), np.asarray(pc.fill_null(batch.column(1), -2))
        reach = np.asarray(pc.fill_null(batch.column(2), -1))
        kept = np.asarray(batch.column(3)).copy()
        live = np.flatnonzero(number != -2)
        if len(live):
            code = np.asarray(pc.dictionary_encode(key.take(pa.array(live))).indices).astype(np.int64)
            block = number[live] >> BLOCK_BITS  # -1 for exact keys
            turn = np.concatenate(([False], (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
            head = (key[int(live[0])].as_py(), int(block[0]))
            if last is not None and head != last:
                slot += 1
            slots = slot + np.cumsum(turn)
            base = slots << (BLOCK_BITS + 1)
            point = base | np.where(block >= 0, number[live] & ((1 << BLOCK_BITS) - 1), 0)
            state = reach[live] >= 0
            if state.any():
                seen.add(point[state], point[state] + reach[live][state] - number[live][state])
            kept[live[~state]] = seen.accept(point[~state])
            slot, last = int(slots[-1]), (key[int(live[-1])].as_py(), int(block[-1]))
            seen.keep_from(int(base[-1]))
        rows = reach < 0
        out = [pa.array(kept), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(out, names=["kept", *batch.schema.names[4:]]).filter(pa.array(rows))


def _columns(df: DataFrame, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in fields])


def _first_pass(df: DataFrame, row_id: str, source: str, item_id: str, content_hash: str, received: str, carry: Sequence[str]) -> DataFrame:
    fields = [("source_", df[source].cast("string")), ("item_", df[item_id].cast("string")), ("content_", df[content_hash].cast("string")), ("id_", df[row_id]), ("received_", df[received]), *[(f"carry_{i}", df[c]) for i, c in enumerate(carry)]]
    narrow = _columns(df, fields)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("number", T.LongType()), T.StructField("kept", T.BooleanType()), *narrow.schema.fields[3:]])
    return narrow.mapInArrow(lambda it: map(_settle_batch, it), schema)


def mark_copies(df: DataFrame, row_id: str = "news_id", source: str = "source", item_id: str = "provider_item_id", content_hash: str = "content_hash", received: str = "receive_time", carry: Sequence[str] = (), seen: DataFrame | None = None) -> DataFrame:
    """Every row as (row_id, *carry, kept): kept is true for exactly one row of each message.

    Two rows are one message if source and identifier agree (outer white space apart; case and all else counts). Rows
    without an identifier (null or blank) are one message if source and content hash agree. The earliest receipt is
    kept, on ties the smallest row_id; rows without a receipt come last. A null source is a source of its own. Rows with
    neither identifier nor content hash can't be compared and are all kept. An empty table gives an empty one; columns
    other than those named aren't read, whatever their names.

    seen: ranges of earlier runs, as from seen_ranges(); what they cover isn't kept again.
    """
    first = _first_pass(df, row_id, source, item_id, content_hash, received, carry)
    tail = [c for c in first.columns if c not in ("key", "number", "kept")]
    first = first.select("key", "number", F.lit(None).cast("long").alias("reach"), "kept", *tail)
    if seen is not None:
        types = dict(first.dtypes)
        first = first.unionByName(seen.select("key", F.col("range_start").alias("number"), F.col("range_end").alias("reach"), F.lit(True).alias("kept"), *[F.lit(None).cast(types[c]).alias(c) for c in tail]))
    block = F.shiftright("number", BLOCK_BITS)
    spread = F.when(F.col("key").isNull(), F.xxhash64("id_")).otherwise(F.xxhash64("key", block))
    ordered = first.repartition(spread).sortWithinPartitions("key", block, F.col("reach").isNull(), F.col("received_").asc_nulls_last(), "id_")
    schema = T.StructType([T.StructField("kept", T.BooleanType()), *[first.schema[c] for c in tail]])
    out = ordered.mapInArrow(_settle_sorted, schema)
    return out.select(F.col("id_").alias(row_id), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "kept")


def seen_ranges(df: DataFrame, row_id: str = "news_id", source: str = "source", item_id: str = "provider_item_id", content_hash: str = "content_hash", received: str = "receive_time") -> DataFrame:
    """What has been seen as (key, range_start, range_end), ranges half-open, disjoint and cut at blocks; exact keys have the range [-1, 0)."""
    from pyspark.sql import Window

    first = _first_pass(df, row_id, source, item_id, content_hash, received, ()).where("key IS NOT NULL").select("key", "number").distinct()
    block = F.shiftright("number", BLOCK_BITS).alias("block")
    islands = first.select("key", "number", block).withColumn("island", F.col("number") - F.row_number().over(Window.partitionBy("key", "block").orderBy("number")))
    return islands.groupBy("key", "block", "island").agg(F.min("number").alias("range_start"), (F.max("number") + 1).alias("range_end")).select("key", "range_start", "range_end")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of several runs as one disjoint set; those that overlap or touch within a block become one."""
    from pyspark.sql import Window

    block = F.shiftright("range_start", BLOCK_BITS).alias("block")
    w = Window.partitionBy("key", "block").orderBy("range_start", "range_end")
    reach = F.max("range_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.select("key", "range_start", "range_end", block).withColumn("opens", (reach.isNull() | (F.col("range_start") > reach)).cast("int")).withColumn("island", F.sum("opens").over(w))
    return islands.groupBy("key", "block", "island").agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).select("key", "range_start", "range_end")


def copies(df: DataFrame, **columns: str) -> DataFrame:
    """The row ids to drop."""
    row_id = columns.get("row_id", "news_id")
    return mark_copies(df, **columns).where("NOT kept").select(row_id)
