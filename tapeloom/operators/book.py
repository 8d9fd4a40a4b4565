"""Order-level books: transitions, depth by windows, replayed snapshots, lifecycles.

Events are (stream, sequence, order_id, action, side, price, qty, at_us). ADD opens an order, MODIFY sets its quantity and price, CANCEL and EXECUTE
take quantity away, DELETE removes what is left, RESET empties the stream's book. An event that doesn't fit changes nothing.
Prices and quantities are exact to a millionth: whole millionths inside, decimal(20,6) outside.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m

TERMINAL = ("EXECUTED", "CANCELLED", "DELETED", "RESET", "OBSERVATION_END")


EXACT = "decimal(20,6)"
_MILLION = 1_000_000


def _scaled(c: str) -> Column:
    """Whole millionths."""
    return (F.col(c).cast(EXACT) * _MILLION).cast("long").alias(c)


def fault(live: bool, old_side: str | None, old_price: int | None, old_qty: int, action: str, side: str | None, price: int | None, qty: int) -> str | None:
    """Why an event doesn't fit its order; a price that isn't given is no mismatch."""
    if action == "ADD":
        return "DUPLICATE_ORDER" if live else None
    if not live:
        return "UNKNOWN_ORDER"
    if side != old_side:
        return "SIDE_MISMATCH"
    if action != "MODIFY" and price is not None and price != old_price:
        return "PRICE_MISMATCH"
    return "EXCESS_QUANTITY" if action in ("CANCEL", "EXECUTE") and qty > old_qty else None


_STEP = "stream long, epoch long, sequence long, order_id string, life int, action string, side string, at_us long, pre_price long, post_price long, pre_qty long, post_qty long, added long, executed long, withdrawn long, error string"
_STEP_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.utf8(), pa.int32(), pa.utf8(), pa.utf8(), *[pa.int64()] * 8, pa.utf8())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whose, life, side_of, now_price, now_qty = None, 0, None, None, 0
    for batch in batches:
        out = []
        for stream, epoch, order, sequence, action, side, price, qty, at, crossed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (stream, epoch, order) != whose:
                whose, life, side_of, now_price, now_qty = (stream, epoch, order), 0, None, None, 0
            qty = qty or 0
            error = "CROSSED" if crossed else fault(now_qty > 0, side_of, now_price, now_qty, action, side, price, qty)
            pre_price, pre_qty, added, executed, withdrawn = now_price, now_qty, 0, 0, 0
            if error is None:
                if action == "ADD":
                    life, side_of, pre_price, now_price, now_qty, added = life + 1, side, None, price, qty, qty
                elif action == "MODIFY":
                    added, withdrawn = max(qty - now_qty, 0), max(now_qty - qty, 0)
                    now_price, now_qty = price, qty
                elif action == "EXECUTE":
                    executed, now_qty = qty, now_qty - qty
                else:
                    withdrawn = now_qty if action == "DELETE" else qty
                    now_qty -= withdrawn
            out.append((stream, epoch, sequence, order, life, action, side, at, pre_price, now_price, pre_qty, now_qty, added, executed, withdrawn, error))
        c = list(zip(*out, strict=True)) or [()] * 16
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, _STEP_TYPES, strict=True)], names=[x.split(" ")[0] for x in _STEP.split(", ")])


def transitions(events: DataFrame, crossed: DataFrame | None = None) -> DataFrame:
    """Each order event with the order's price and quantity before and after, what it added, executed and withdrew, and what is wrong with it.

    Only the RESETs of a stream bear on an order's events besides these themselves, so orders are folded each by itself,
    spread over all tasks by (stream, epoch, order). What would cross the book can't be told from one order; the
    (stream, sequence) of such events, as snapshots() names them, are given as `crossed`. Failed events come out with what is
    wrong, and as much after them as before; all of them are reported.
    """
    resets = events.where("action = 'RESET'").groupBy("stream").agg(F.array_sort(F.collect_list(F.col("sequence").cast("long"))).alias("resets"))
    e = events.where("action <> 'RESET'").join(resets, "stream", "left")
    e = e.withColumn("epoch", F.coalesce(F.size(F.filter("resets", lambda r: r < F.col("sequence"))), F.lit(0)).cast("long"))
    if crossed is not None:
        e = e.join(crossed.select("stream", "sequence", F.lit(True).alias("crossed")).distinct(), ["stream", "sequence"], "left")
    else:
        e = e.withColumn("crossed", F.lit(False))
    e = e.select(F.col("stream").cast("long"), "epoch", F.col("order_id").cast("string"), F.col("sequence").cast("long"), "action", "side", _scaled("price"), _scaled("qty"), F.col("at_us").cast("long"), F.coalesce("crossed", F.lit(False)).alias("crossed"))
    steps = e.repartition("stream", "epoch", "order_id").sortWithinPartitions("stream", "epoch", "order_id", "sequence").mapInArrow(_fold, _STEP)
    exact = ("pre_price", "post_price", "pre_qty", "post_qty", "added", "executed", "withdrawn")
    return steps.withColumns({c: (F.col(c).cast("decimal(20,0)") / F.lit(_MILLION).cast("decimal(7,0)")).cast(EXACT) for c in exact}).withColumn("order_id", F.col("order_id").cast(events.schema["order_id"].dataType))


def first_errors(trans: DataFrame) -> DataFrame:
    """A strict replay would stop here: the first offence of each stream."""
    return trans.where("error IS NOT NULL").groupBy("stream").agg(F.min_by("error", "sequence").alias("error"), F.min("sequence").alias("sequence"), F.count("*").alias("n_errors"))


def depth_changes(trans: DataFrame) -> DataFrame:
    """(stream, epoch, side, price, sequence, depth, orders): a level's depth after each event that touches it."""
    steps = F.array(F.struct(F.col("pre_price").alias("price"), (-F.col("pre_qty")).alias("d"), F.when(F.col("pre_qty") > 0, -1).otherwise(0).alias("n")), F.struct(F.col("post_price").alias("price"), F.col("post_qty").alias("d"), F.when(F.col("post_qty") > 0, 1).otherwise(0).alias("n")))
    moved = trans.where("error IS NULL").withColumn("steps", steps).withColumn("s", F.explode("steps")).where("s.price IS NOT NULL")
    net = moved.groupBy("stream", "epoch", "side", F.col("s.price").alias("price"), "sequence").agg(F.sum("s.d").alias("d"), F.sum("s.n").alias("n"))
    w = Window.partitionBy("stream", "epoch", "side", "price").orderBy("sequence")
    return net.select("stream", "epoch", "side", "price", "sequence", F.sum("d").over(w).alias("depth"), F.sum("n").over(w).alias("orders"))


def final_levels(depth: DataFrame) -> DataFrame:
    """Levels that are open at the end of each stream's last epoch."""
    last = depth.groupBy("stream", "epoch", "side", "price").agg(F.max_by("depth", "sequence").alias("depth"), F.max_by("orders", "sequence").alias("orders"))
    newest = Window.partitionBy("stream")
    return last.withColumn("newest", F.max("epoch").over(newest)).where("epoch = newest AND depth > 0").drop("newest", "epoch")


def top_levels(levels: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("stream", "side").orderBy(F.when(F.col("side") == "BID", -F.col("price")).otherwise(F.col("price"))))
    return levels.withColumn("level", rank).where(F.col("level") <= k)


def book_features(levels: DataFrame, k: int = 5) -> DataFrame:
    """Touch, spread, mid, microprice, imbalance and weighted depths of each stream from its levels."""
    top = top_levels(levels, k).withColumns({c: F.col(c).cast("double") for c in ("price", "depth")})

    def sizes(side: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("level", "depth")))), lambda x: x["depth"])

    def touch(side: str, what: str) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("level") == 1), F.col(what)))

    b = top.groupBy("stream").agg(sizes("BID").alias("bids"), sizes("ASK").alias("asks"), touch("BID", "price").alias("bid"), touch("BID", "depth").alias("bid_size"), touch("ASK", "price").alias("ask"), touch("ASK", "depth").alias("ask_size"))
    bid, ask, bs, az = (F.col(x) for x in ("bid", "ask", "bid_size", "ask_size"))
    return b.select("stream", "bid", "ask", m.spread(bid, ask).alias("spread"), m.mid(bid, ask).alias("mid"), m.microprice(bid, bs, ask, az).alias("microprice"), m.imbalance(F.col("bids"), F.col("asks"), k).alias("imbalance"), m.weighted_depth(F.col("bids")).alias("weighted_bid"), m.weighted_depth(F.col("asks")).alias("weighted_ask"))


def lifecycles(trans: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """One row an order's life: totals, terminal reason, lifetime and the identity added = executed + withdrawn + remaining.

    resets: (stream, epoch) of the epochs that a RESET ended; orders open then are cut off by it, others by the end of observation.
    """
    g = trans.where("error IS NULL").groupBy("stream", "epoch", "order_id", "life").agg(
        F.first("side").alias("side"), F.min("sequence").alias("opened"), F.max("sequence").alias("last_event"), F.sum("added").alias("added"), F.sum("executed").alias("executed"), F.sum("withdrawn").alias("withdrawn"),
        F.max("post_qty").alias("largest"), F.max_by("post_qty", "sequence").alias("remaining"), F.max_by("action", "sequence").alias("last_action"), F.count(F.when(F.col("action") == "MODIFY", 1)).alias("modifies"),
        F.count(F.when(F.col("action") == "EXECUTE", 1)).alias("executions"), F.count(F.when((F.col("action") == "MODIFY") & (F.col("pre_price") != F.col("post_price")), 1)).alias("price_changes"), F.min("at_us").alias("opened_us"), F.max("at_us").alias("closed_us"),
    )
    closed = F.when(F.col("last_action") == "EXECUTE", "EXECUTED").when(F.col("last_action") == "DELETE", "DELETED").otherwise("CANCELLED")
    if resets is not None:
        g = g.join(resets.select("stream", "epoch", F.lit(True).alias("was_reset")), ["stream", "epoch"], "left")
        censored = F.when(F.col("was_reset"), "RESET").otherwise("OBSERVATION_END")
    else:
        censored = F.lit("OBSERVATION_END")
    return g.withColumn("reason", F.when(F.col("remaining") <= 0, closed).otherwise(censored)).withColumns(
        {"balanced": F.col("added") == F.col("executed") + F.col("withdrawn") + F.col("remaining"), "executed_share": m.over(F.col("executed").cast("double"), F.col("added").cast("double")), "withdrawn_share": m.over(F.col("withdrawn").cast("double"), F.col("added").cast("double")), "lifetime_s": (F.col("closed_us") - F.col("opened_us")) / 1e6}
    ).drop("was_reset")


class Book:
    """The orders and levels of one stream, in whole millionths."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.orders: dict[str, tuple[str, int, int]] = {}
        self.levels: dict[str, dict[int, tuple[int, int]]] = {"BID": {}, "ASK": {}}

    def _move(self, side: str, price: int, qty: int, n: int) -> None:
        q, c = self.levels[side].get(price, (0, 0))
        if c + n <= 0:
            self.levels[side].pop(price, None)
        else:
            self.levels[side][price] = (q + qty, c + n)

    def _put(self, order: str, old: tuple[str, int, int] | None, now: tuple[str, int, int] | None) -> None:
        if old:
            self._move(*old[:2], -old[2], -1)
            del self.orders[order]
        if now and now[2] > 0:
            self._move(*now, 1)
            self.orders[order] = now

    def apply(self, order: str, action: str, side: str, price: int | None, qty: int | None) -> str | None:
        """What is wrong with the event; if anything is, the book stays as it was. Equal prices on both sides don't cross."""
        if action == "RESET":
            self.clear()
            return None
        old = self.orders.get(order)
        error = fault(old is not None, *(old or (None, None, 0)), action, side, price, qty or 0)
        if error:
            return error
        now = (side, price, qty) if action in ("ADD", "MODIFY") else (side, old[1], 0 if action == "DELETE" else old[2] - qty)
        self._put(order, old, now)
        if action in ("ADD", "MODIFY") and self.levels["BID"] and self.levels["ASK"]:
            other = min(self.levels["ASK"]) if side == "BID" else max(self.levels["BID"])
            if price > other if side == "BID" else price < other:
                self._put(order, self.orders.get(order), old)
                return "CROSSED"
        return None

    def top(self, k: int) -> tuple[list[dict], list[dict]]:
        pick = {"BID": heapq.nlargest, "ASK": heapq.nsmallest}
        return tuple([{"price": p, "qty": self.levels[s][p][0], "orders": self.levels[s][p][1]} for p in pick[s](k, self.levels[s])] for s in ("BID", "ASK"))

    def step(self, k: int, *event) -> tuple[list[dict], list[dict], str | None]:
        error = self.apply(*event)
        return *self.top(k), error


SNAPSHOT = "stream long, sequence long, bids array<struct<price:long,qty:long,orders:int>>, asks array<struct<price:long,qty:long,orders:int>>, error string"
_LEVEL = pa.list_(pa.struct([("price", pa.int64()), ("qty", pa.int64()), ("orders", pa.int32())]))


def _replay(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, book = None, Book()
        for batch in batches:
            out = []
            for key, seq, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != stream:
                    stream, book = key, Book()
                out.append((key, seq, *book.step(k, *event)))
            c = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], _LEVEL), pa.array(c[3], _LEVEL), pa.array(c[4], pa.utf8())], names=["stream", "sequence", "bids", "asks", "error"])

    return run


def snapshots(events: DataFrame, k: int = 5) -> DataFrame:
    """The first k levels of each side after every event, by replay: one pass over each stream's sorted events.

    An event that doesn't fit the book, or would cross it, is named in `error` and leaves the book as it was.
    """
    return exact_levels(scaled(events).repartition("stream").sortWithinPartitions("stream", "sequence").mapInArrow(_replay(k), SNAPSHOT))


def scaled(events: DataFrame) -> DataFrame:
    """What the replay reads."""
    return events.select(F.col("stream").cast("long"), F.col("sequence").cast("long"), F.col("order_id").cast("string"), "action", "side", _scaled("price"), _scaled("qty"))


def exact_levels(raw: DataFrame) -> DataFrame:
    exact = lambda x: (x.cast("decimal(20,0)") / F.lit(_MILLION).cast("decimal(7,0)")).cast(EXACT)
    return raw.withColumns({side: F.transform(side, lambda x: F.struct(exact(x["price"]).alias("price"), exact(x["qty"]).alias("qty"), x["orders"].alias("orders"))) for side in ("bids", "asks")})
