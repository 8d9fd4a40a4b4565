"""Datasets for research: labels, walk-forward folds, purge and embargo, block permutations, corrections."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from itertools import accumulate, permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage, default_parallelism


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the row's place (from 0) in the order of all rows, without bringing them into one task.

    Rows are sorted by ranges; the ranges' sizes (one number a partition) give each its first place. The sorted rows are
    materialised once, as ranges are drawn from a sample and must not be drawn twice.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(default_parallelism(spark), *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumns({"pid_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()}))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("pid_").count().collect()):
        offsets.append((r["pid_"], before))
        before += r["count"]
    shift = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "pid_ int, shift_ long"))  # one row a partition
    return placed.join(shift, "pid_").withColumn(name, F.col("shift_") + F.col("row_").bitwiseAND((1 << 33) - 1)).drop("pid_", "row_", "shift_")


def _fold_count(n: int, least_train: int, step: int) -> int:
    return max(0, -(-(n - least_train) // step))


def folds(observations: DataFrame, order: Sequence[str], least_train: int, test: int, step: int | None = None, rolling: int | None = None) -> DataFrame:
    """(fold, role, *columns): chronological folds with all earlier (or the last `rolling`) observations as training, written out.

    The folds a row belongs to follow from its rank by arithmetic, so no row meets any other. With all earlier rows as training, what is written
    out grows with rows times folds; fold_exceptions() gives the same without the training rows.
    """
    step = step or test
    ranked = global_rank(observations, order)
    total = ranked.agg(F.max("rank")).first()[0]
    count = _fold_count(0 if total is None else total + 1, least_train, step)
    r, none = F.col("rank"), F.array().cast("array<bigint>")

    def run(low: Column, high: Column) -> Column:
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(count - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    tests = run(F.floor((r - least_train - test) / step) + 1, F.floor((r - least_train) / step))
    trains = run(F.floor((r - least_train) / step) + 1, F.lit(count - 1).cast("long") if rolling is None else F.floor((r - least_train + rolling) / step))
    tagged = ranked.withColumn("f", F.explode(F.concat(F.transform(tests, lambda k: F.struct(k.alias("fold"), F.lit("TEST").alias("role"))), F.transform(trains, lambda k: F.struct(k.alias("fold"), F.lit("TRAIN").alias("role"))))))
    return tagged.select(F.col("f.fold").cast("int").alias("fold"), "f.role", *observations.columns)


def fold_exceptions(observations: DataFrame, order: Sequence[str], least_train: int, test: int, market: str, index: str, label_end: str, embargo_events: int, total: str) -> tuple[DataFrame, DataFrame]:
    """Folds over all earlier rows without writing these out: (the rows tested, embargoed or purged in each fold, sums by fold and role).

    The first has (fold, role, *columns), TEST, EMBARGOED or PURGED; all other rows before a fold's first test row are its training. The second has
    (fold, role, n, sum of `total`) of all four roles. Rules as in embargo_and_purge(). A row trains from one fold on, so what a fold's training is comes
    from running sums over folds; purged are only rows whose label is as near to the market's first test row as labels reach, and these meet it by
    buckets of that width.
    """
    ranked = cut_lineage(global_rank(observations, order))
    n, reach = ranked.agg(F.count("*"), F.max(F.col(label_end) - F.col(index))).first()
    count, width = _fold_count(n, least_train, test), max(1, (reach or 0) + 1)
    from_fold = F.greatest(F.floor((F.col("rank") - least_train) / test) + 1, F.lit(0))
    rows = ranked.withColumn("from_fold", from_fold)
    tested = rows.where(F.col("rank") >= least_train).withColumn("fold", F.floor((F.col("rank") - least_train) / test))
    marks = rows.groupBy(market, F.col("from_fold").alias("k")).agg(F.max(index).alias("last")).withColumn("asked", F.lit(0))
    asked = tested.select(market, F.col("fold").alias("k")).distinct().select(market, "k", F.lit(None).cast(rows.schema[index].dataType).alias("last"), F.lit(1).alias("asked"))
    w = Window.partitionBy(market).orderBy("k", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marks.unionByName(asked).withColumn("last_train", F.max("last").over(w)).where("asked = 1").select(market, F.col("k").alias("fold"), "last_train")
    gap = F.col(index) - F.col("last_train")
    judged = tested.join(last, [market, "fold"]).withColumn("role", F.when((gap > 0) & (gap <= embargo_events), "EMBARGOED").otherwise("TEST"))
    first = judged.where("role = 'TEST'").groupBy(market, "fold").agg(F.min(index).alias("first_test"))
    bucket = lambda c: F.floor(c / width)
    near = first.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("first_test") - width), bucket(F.col("first_test"))))))
    purged = rows.withColumn("bucket", bucket(F.col(index))).join(near, [market, "bucket"]).where((F.col("from_fold") <= F.col("fold")) & (F.col(label_end) >= F.col("first_test"))).withColumn("role", F.lit("PURGED"))
    exceptions = judged.select("fold", "role", *observations.columns).unionByName(purged.select("fold", "role", *observations.columns))
    own = exceptions.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum(total).alias("total"))
    chunks = rows.groupBy(F.col("from_fold").alias("fold")).agg(F.count("*").alias("n"), F.sum(total).alias("total"))
    over = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a fold
    before = chunks.where(F.col("fold") < count).select("fold", F.sum("n").over(over).alias("n"), F.sum("total").over(over).alias("total"))
    less = own.where("role = 'PURGED'").select("fold", F.col("n").alias("n0"), F.col("total").alias("total0"))
    train = before.join(less, "fold", "left").select("fold", F.lit("TRAIN").alias("role"), (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"), (F.col("total") - F.coalesce("total0", F.lit(0))).alias("total"))
    return exceptions, own.unionByName(train.where("n > 0"))


def embargo_and_purge(tagged: DataFrame, market: str, index: str, label_end: str, embargo_events: int) -> DataFrame:
    """Roles after both rules: a test row too close behind its market's last training row is EMBARGOED, a training row
    whose label reaches into its market's remaining test rows is PURGED."""
    w = Window.partitionBy("fold", market)
    last_train = F.max(F.when(F.col("role") == "TRAIN", F.col(index))).over(w)
    gap = F.col(index) - last_train
    e = tagged.withColumn("kept", F.when((F.col("role") == "TEST") & (gap > 0) & (gap <= embargo_events), "EMBARGOED").otherwise(F.col("role")))
    first_test = F.min(F.when(F.col("kept") == "TEST", F.col(index))).over(w)
    return e.withColumn("role", F.when((F.col("kept") == "TRAIN") & (F.col(label_end) >= first_test), "PURGED").otherwise(F.col("kept"))).drop("kept")


#: The most orders that are enumerated.
MOST_EXACT = 10_000


def block_orders(n_blocks: int, count: int, seed: int) -> list[list[int]]:
    """Seeded shuffles of a few blocks as lists; for blocks as many as the data has, hashed_orders()."""
    rng = random.Random(seed)
    orders = []
    for _ in range(count):
        order = list(range(n_blocks))
        rng.shuffle(order)
        orders.append(order)
    return orders


def every_order(n_blocks: int) -> list[list[int]]:
    """All orders of the blocks, if they are MOST_EXACT at most."""
    if math.factorial(n_blocks) > MOST_EXACT:
        raise ValueError(f"{n_blocks} blocks have more than {MOST_EXACT} orders")
    return [list(o) for o in permutations(range(n_blocks))]


def block_sizes(n: int, size: int) -> list[int]:
    """The sizes of the blocks that n rows fall into, the last one as short as it comes."""
    return [min(size, n - start) for start in range(0, n, size)]


def hashed_orders(spark: SparkSession, n: int, size: int, count: int, seed: int) -> DataFrame:
    """(permutation, block, start): `count` seeded orders of the blocks of n rows, each with the rank at which a block then starts.

    A block's turn is its hash with the permutation's number, so the orders are made where they are used and nothing but n passes the driver.
    """
    blocks = spark.range(-(-n // size)).select(F.col("id").alias("block"), F.least(F.lit(size).cast("long"), n - F.col("id") * size).alias("size_"))
    each = blocks.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("turn_", F.xxhash64(F.lit(seed), "permutation", "block"))
    before = Window.partitionBy("permutation").orderBy("turn_", "block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("permutation", "block", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("start"))


def permuted_means(rows: DataFrame, orders: list[list[int]] | DataFrame, condition: Column, sizes: Sequence[int] | None = None) -> DataFrame:
    """(permutation, statistic): the mean label where the condition holds, labels moved with whole blocks.

    rows: (block, place, label, ...); blocks are of equal length unless their sizes are given or orders is a table as from hashed_orders(). Then rows have their rank
    too, and a block starts where those before it in the new order end. Every row goes to
    its block's new position and meets the condition there by an equi-join, so nothing but sums is gathered. Orders as lists are for few blocks.
    """
    spark = rows.sparkSession
    if isinstance(orders, DataFrame) or sizes is not None:
        moves = orders
        if not isinstance(orders, DataFrame):
            starts = [(p, source, start) for p, order in enumerate(orders) for source, start in zip(order, accumulate((sizes[b] for b in order), initial=0))]
            moves = spark.createDataFrame(starts, "permutation int, block long, start long")
        labels = rows.select(F.col("block").cast("long"), "place", "label").join(moves, "block").select("permutation", (F.col("start") + F.col("place")).alias("rank"), "label")
        return labels.join(rows.where(condition).select("rank"), "rank").groupBy("permutation").agg(F.avg("label").alias("statistic"))
    moves = spark.createDataFrame([(p, source, target) for p, order in enumerate(orders) for target, source in enumerate(order)], "permutation int, block long, target long")
    labels = rows.select(F.col("block").cast("long"), "place", "label").join(moves, "block")
    where = rows.where(condition).select(F.col("block").cast("long").alias("target"), "place")
    return labels.join(where, ["target", "place"]).groupBy("permutation").agg(F.avg("label").alias("statistic"))


#: Rows that are packed together, about.
PIECE = 1 << 16
_PIECE = "pid int, position long, n int, labels binary, flags binary, total double, hits long"
_MASK64 = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), types, strict=True)], names=names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, position = TaskContext.get().partitionId(), 0
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            label, hit = batch.column(0).slice(start, PIECE), batch.column(1).slice(start, PIECE)
            known = label.is_valid().to_numpy(zero_copy_only=False)
            hit = hit.fill_null(False).to_numpy(zero_copy_only=False)
            x = np.where(known, label.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            both = known & hit
            yield _record(_PIECE, [(pid, position, len(x), x.tobytes(), (hit + 2 * known).astype("u1").tobytes(), float(x[both].sum()), int(both.sum()))])
            position += len(x)


def packed(df: DataFrame, order: Sequence[str], label: Column, condition: Column) -> DataFrame:
    """Labels and whether the condition holds, in the order of all rows, as arrays of pieces of a partition: nine bytes a row are all that is kept."""
    df = df.select(*order, label.cast("double").alias("label_"), condition.alias("hit_"))
    ranged = df.repartitionByRange(default_parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.select("label_", "hit_").mapInArrow(_pack, _PIECE))


def _fmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
    return h ^ (h >> np.uint64(32))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    h = (seed + np.uint64(_P5 + 4)) ^ np.uint64((value & 0xFFFFFFFF) * _P1 & _MASK64)
    return _fmix(_rotl(h, 23) * np.uint64(_P2) + np.uint64(_P3))


def turns(n_blocks: int, permutation: int, seed: int) -> np.ndarray:
    """xxhash64(seed, permutation, block) of each block, as Spark has it and hashed_orders() sorts by."""
    at = _hash_int(permutation, _hash_int(seed, np.array([42], "u8")))
    h = (at + np.uint64(_P5 + 8)) ^ (_rotl(np.arange(n_blocks, dtype="u8") * np.uint64(_P2), 31) * np.uint64(_P1))
    return _fmix(_rotl(h, 27) * np.uint64(_P1) + np.uint64(_P4)).view("i8")


def packed_means(pieces: DataFrame, size: int, count: int, seed: int) -> DataFrame:
    """(permutation, statistic) as of permuted_means() with the orders of hashed_orders(), from the pieces of packed().

    A task makes some permutations' orders by itself and looks up, for every label, whether the condition holds where it goes; that is one bit a label and
    permutation, and all that is sent to the labels. A task holds the condition's bits and one order of the blocks.
    """
    spark = pieces.sparkSession
    before, n = {}, 0
    for r in sorted(pieces.groupBy("pid").agg(F.sum("n").alias("n")).collect()):
        before[r["pid"]] = n
        n += r["n"]
    n_blocks, tasks = -(-n // size), default_parallelism(spark)
    groups = max(1, min(count, 2 * tasks))
    span = size * max(1, 4 * PIECE // size)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, position, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = before[pid] + position
                hit = np.concatenate([np.zeros(start % 8, "u1"), np.frombuffer(flags, "u1") & 1])
                yield _record("start long, bits binary", [(start // 8, np.packbits(hit).tobytes())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, position, m, labels, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, end = before[pid] + position, before[pid] + position + m
                first = at
                while at < end:
                    stop = min(end, (at // span + 1) * span)
                    yield _record(_PART, [(at // span, -1, at % span, labels[8 * (at - first) : 8 * (stop - first)], flags[at - first : stop - first])])
                    at = stop

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = np.zeros(0, "u1"), set()
        for batch in batches:
            for group, start, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not mine:
                    held = np.zeros(-(-n // 8), "u1")
                mine.add(group)
                part = np.frombuffer(part, "u1")
                held[start : start + len(part)] |= part
        for permutation in (p for group in sorted(mine) for p in range(group, count, groups)):
            order = np.argsort(turns(n_blocks, permutation, seed), kind="stable")
            sizes = np.full(n_blocks, size, "i8")
            sizes[-1] = n - (n_blocks - 1) * size
            shift = np.empty(n_blocks, "i8")
            shift[order] = np.cumsum(sizes[order]) - sizes[order]
            shift -= np.arange(n_blocks, dtype="i8") * size
            for low in range(0, n, span):
                high = min(n, low + span)
                to = np.repeat(shift[low // size : -(-high // size)], size)[: high - low] + np.arange(low, high)
                there = (held[to >> 3] >> (7 - (to & 7)).astype("u1")) & 1
                yield _record(_PART, [(low // span, permutation, 0, np.packbits(there).tobytes(), None)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, x, known = None, np.zeros(span), np.zeros(span, bool)
        for batch in batches:
            out = []
            for chunk, permutation, at, part, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != whose:
                    whose, known[:] = chunk, False
                if permutation < 0:
                    x[at : at + len(flags)] = np.frombuffer(part)
                    known[at : at + len(flags)] = (np.frombuffer(flags, "u1") & 2) > 0
                    continue
                hit = np.unpackbits(np.frombuffer(part, "u1"), count=min(span, n - chunk * span)).astype(bool)
                both = hit & known[: len(hit)]
                out.append((permutation, float(x[: len(hit)][both].sum()), int(both.sum()), int(hit.sum())))
            yield _record("permutation int, total double, known long, hits long", out)

    masks = pieces.select("pid", "position", "flags").mapInArrow(bits, "start long, bits binary").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "start", "bits")
    found = masks.repartition(groups, "group").mapInArrow(look, _PART)
    labels = pieces.select("pid", "position", "n", "labels", "flags").mapInArrow(cut, _PART)
    sums = labels.unionByName(found).repartition(tasks, "chunk").sortWithinPartitions("chunk", "permutation").mapInArrow(add, "permutation int, total double, known long, hits long")
    return sums.groupBy("permutation").agg(*[F.sum(c).alias(c) for c in ("total", "known", "hits")]).where("hits > 0").select("permutation", F.try_divide("total", "known").alias("statistic"))


_PART = "chunk long, permutation int, at long, labels binary, flags binary"


def p_value(observed: float, null: DataFrame, exact: bool = False, alternative: str = "GREATER") -> DataFrame:
    """Share of permutations at least as extreme (ties count); with one added to both unless all orders were tried.

    GREATER and LESS look at one side, TWO_SIDED at the distance from the null's mean. Beside it the null's mean, deviation and nearest-rank percentiles, the effect
    and, unless nothing varies, the standardized effect.
    """
    if alternative not in ("GREATER", "LESS", "TWO_SIDED"):
        raise ValueError(alternative)
    s, slack = F.col("statistic"), 1e-12  # sums of the same numbers in another order are ties
    mean = null.agg(F.avg("statistic")).first()[0] if alternative == "TWO_SIDED" else None
    extreme = {"GREATER": s >= observed - slack, "LESS": s <= observed + slack, "TWO_SIDED": F.abs(s - (mean or 0.0)) >= abs(observed - (mean or 0.0)) - slack}[alternative]
    k, n = F.count(F.when(extreme, 1)), F.count("*")
    p = k / n if exact else (k + 1) / (n + 1)
    sd = F.stddev_pop("statistic")
    ordered = F.array_sort(F.collect_list("statistic"))  # as many as there are permutations
    rank = lambda q: F.get(ordered, (F.greatest(F.ceil(F.lit(q).cast("decimal(4,3)") * n.cast("decimal(20,0)")), F.lit(1)) - 1).cast("int"))
    return null.agg(p.alias("p_value"), n.alias("n_permutations"), F.avg("statistic").alias("null_mean"), sd.alias("null_sd"), F.when(sd > 1e-15, (F.lit(observed) - F.avg("statistic")) / sd).alias("standardized"), (F.lit(observed) - F.avg("statistic")).alias("effect"), rank("0.05").alias("p5"), rank("0.5").alias("p50"), rank("0.95").alias("p95"))


def corrections(tests: DataFrame, family: str, p: str, key: str) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg within each family."""
    everything = Window.partitionBy(family)
    n = F.count("*").over(everything)
    ranked = tests.withColumns({"m": n, "rank": F.row_number().over(everything.orderBy(p, key))})
    down = everything.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a running minimum from the end
    raw = F.col(p) * F.col("m") / F.col("rank")
    return ranked.withColumn("raw", raw).withColumns({"bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("m")), "bh": F.least(F.lit(1.0), F.min("raw").over(down))}).drop("m", "raw")


def exact_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The middle value, or the mean of the two middle ones, kept exact for decimals; by rank, so no group is gathered."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"r": F.row_number().over(w.orderBy(value)), "n": F.count("*").over(w)})
    middle = ranked.where((F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.floor(F.col("n") / 2) + 1))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: str) -> DataFrame:
    """The nearest-rank percentile: the value of rank ceil(share * n), the share a decimal so the rank is exact."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"r": F.row_number().over(w.orderBy(value)), "n": F.count("*").over(w)})
    wanted = F.greatest(F.ceil(F.lit(share).cast("decimal(10,6)") * F.col("n").cast("decimal(20,0)")), F.lit(1))
    return ranked.where(F.col("r") == wanted).select(*keys, F.col(value).alias("percentile"))


def tail_difference(df: DataFrame, feature: str, label: str, key: str, share: float) -> DataFrame:
    """Mean label of the upper less that of the lower share of rows by feature, at least one row each."""
    ranked = global_rank(df.where(F.col(feature).isNotNull()), [feature, key])
    n = ranked.count()
    k = max(1, math.floor(n * share))
    return ranked.agg((F.avg(F.when(F.col("rank") >= n - k, F.col(label))) - F.avg(F.when(F.col("rank") < k, F.col(label)))).alias("difference"))
