"""Attacks on one side of a book: what they took, how each price they met came back, what was added and withdrawn there, and how one compares with the one before.

An attack is a run of executions against one side. Prices are those that stood before it; what happens at other prices is no
recovery of these. Look-ups by sequence are equi-joins: on the sequence itself, or on buckets of SPAN events.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.operators import liquidity
from tapeloom.operators.book import _MILLION, Book, fault, scaled

GAP, LEAST, LEVELS, AFTER = 4, 2, 3, 25
FLOW_EVENTS, SHOCKS, VOLATILITY_EVENTS = 50, 4, 20
SPAN = 64
WEIGHTS = (1.0, 0.5, 0.25)
LEVEL_HORIZONS = (5, 10, 25)


def attacks(trans: DataFrame, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """(attack_id, stream, side, direction, start, end, n, volume): runs of at least `least` executions against a side, at most `gap` events apart."""
    e = trans.where("action = 'EXECUTE' AND error IS NULL")
    w = Window.partitionBy("stream", "side").orderBy("sequence")
    opens = F.when(F.col("sequence") - F.lag("sequence").over(w) <= gap, 0).otherwise(1)
    runs = e.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w)).groupBy("stream", "side", "run").agg(F.min("sequence").alias("start"), F.max("sequence").alias("end"), F.count("*").alias("n"), F.sum("executed").cast("double").alias("volume"), F.min("at_us").alias("start_us"))
    return runs.where((F.col("n") >= least) & (F.col("start") > 0)).select(F.concat_ws(":", "stream", "side", "start").alias("attack_id"), "stream", "side", F.when(F.col("side") == "ASK", "BUY").otherwise("SELL").alias("direction"), "start", "end", "n", "volume", "start_us")


def met_levels(found: DataFrame, shots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(attack_id, ..., book_side, level, price, base): the first levels of both sides as they stood before each attack."""
    before = shots.select("stream", (F.col("sequence") + 1).alias("start"), "bids", "asks")
    j = found.join(before, ["stream", "start"])
    pick = lambda side, name: j.select(*found.columns, F.lit(name).alias("book_side"), F.posexplode(F.slice(side, 1, levels)).alias("place", "x"))
    return pick("bids", "BID").unionByName(pick("asks", "ASK")).select(*found.columns, "book_side", (F.col("place") + 1).alias("level"), F.col("x.price").alias("price"), F.col("x.qty").cast("double").alias("base"))


def _near(levels: DataFrame, moves: DataFrame, after: int) -> DataFrame:
    """Levels with what moved at their price from the attack's start to `after` events past its end; each move once. Levels without a move stay, with nulls."""
    first, last = F.floor(F.col("start") / SPAN), F.floor((F.col("end") + after) / SPAN)
    spread = levels.withColumn("bucket", F.explode(F.sequence(first, last)))
    there = moves.withColumn("bucket", F.floor(F.col("sequence") / SPAN)).withColumnRenamed("side", "book_side")
    hit = spread.join(there, ["stream", "book_side", "price", "bucket"]).where((F.col("sequence") >= F.col("start")) & (F.col("sequence") <= F.col("end") + after)).drop("bucket")
    return levels.join(hit.drop("stream", "side", "direction", "start", "end", "n", "volume", "start_us", "price", "base"), ["attack_id", "book_side", "level"], "left")


def level_recoveries(levels: DataFrame, depths: DataFrame, horizons: Sequence[int] = LEVEL_HORIZONS) -> DataFrame:
    """(attack_id, level, price, base, least, horizon, later, ratio) of the attacked side: the share of what a price lost that stood there again; null where it lost nothing."""
    own = levels.where("book_side = side")
    moved = _near(own, depths.select("stream", "side", "price", "sequence", F.col("depth").cast("double").alias("depth")), max(horizons))
    inside = F.col("sequence") <= F.col("end")
    g = moved.groupBy("attack_id", "level").agg(
        F.first("price").alias("price"), F.first("base").alias("base"), F.min(F.when(inside, F.col("depth"))).alias("low"),
        *[F.max_by("depth", F.when(F.col("sequence") <= F.col("end") + h, F.col("sequence"))).alias(f"later_{h}") for h in horizons],
    )
    each = g.withColumn("h", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col(f"later_{h}"), F.col("base")).alias("later")) for h in horizons])))
    least = F.least("base", F.coalesce("low", "base"))
    return each.select("attack_id", "level", "price", "base", least.alias("least"), "h.horizon", "h.later", m.replenishment_ratio(F.col("base"), least, F.col("h.later")).alias("ratio"))


def support(recoveries: DataFrame, weights: Sequence[float] = WEIGHTS, epsilon: float = m.EPSILON) -> DataFrame:
    """(attack_id, horizon, near_touch, deep_support, ratio): the weighted mean recovery of the levels that lost anything, that of the deeper ones against the first, and the recovery of all depth together."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("level"))
    r, known = F.col("ratio"), F.col("ratio").isNotNull()
    first = F.max(F.when(F.col("level") == 1, r))
    deep = F.sum(F.when((F.col("level") > 1) & known, w * r))
    g = recoveries.groupBy("attack_id", "horizon").agg(
        m.over(F.sum(F.when(known, w * r)), F.sum(F.when(known, w))).alias("near_touch"), m.over(deep, first + epsilon).alias("deep_support"), F.sum("base").alias("base"), F.sum("least").alias("least"), F.sum("later").alias("later")
    )
    return g.select("attack_id", "horizon", "near_touch", "deep_support", m.replenishment_ratio(F.col("base"), F.col("least"), F.col("later")).alias("ratio"))


def region_effects(trans: DataFrame) -> DataFrame:
    """(stream, side, price, sequence, added, withdrawn, executed): a change of price withdraws all from the old price and adds all at the new one."""
    act, moved = F.col("action"), F.col("pre_price") != F.col("post_price")
    zero = F.lit(0).cast("decimal(20,6)")
    at = lambda price, added, withdrawn, executed: F.struct(F.col(price).alias("price"), added.alias("added"), withdrawn.alias("withdrawn"), executed.alias("executed"))
    effects = (
        F.when(act == "ADD", F.array(at("post_price", F.col("post_qty"), zero, zero)))
        .when((act == "MODIFY") & moved, F.array(at("post_price", F.col("post_qty"), zero, zero), at("pre_price", zero, F.col("pre_qty"), zero)))
        .otherwise(F.array(at("pre_price", F.col("added"), F.col("withdrawn"), F.col("executed"))))
    )
    return trans.where("error IS NULL").withColumn("x", F.explode(effects)).select("stream", "side", "sequence", "x.*")


def region_flow(levels: DataFrame, trans: DataFrame, after: int = AFTER, epsilon: float = m.EPSILON) -> DataFrame:
    """(attack_id, book_side, attacked, added, withdrawn, executed, net, normalized, pressure) at the prices that stood before, up to `after` events past the attack."""
    moved = _near(levels, region_effects(trans), after)
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c)
    g = moved.groupBy("attack_id", "book_side").agg(F.first(F.col("book_side") == F.col("side")).alias("attacked"), total("added"), total("withdrawn"), total("executed"))
    both = F.col("added") + F.col("withdrawn") + epsilon
    return g.withColumns({"net": F.col("added") - F.col("withdrawn"), "normalized": (F.col("added") - F.col("withdrawn")) / both, "pressure": F.col("withdrawn") / both})


def tape(shots: DataFrame, trans: DataFrame) -> DataFrame:
    """(stream, sequence, mid, spread, flow, volatility) after each event: persistence of the flow of executions and root mean square of the mid's steps, over the last events."""
    ex = trans.where("action = 'EXECUTE' AND error IS NULL").select("stream", "sequence", F.when(F.col("side") == "ASK", F.col("executed")).otherwise(-F.col("executed")).cast("double").alias("signed"))
    bid, ask = F.get("bids", F.lit(0))["price"].cast("double"), F.get("asks", F.lit(0))["price"].cast("double")
    t = shots.select("stream", "sequence", m.mid(bid, ask).alias("mid"), m.spread(bid, ask).alias("spread")).join(ex, ["stream", "sequence"], "left")
    w = Window.partitionBy("stream").orderBy("sequence")
    step = F.col("mid") / F.lag("mid").over(w) - 1
    t = t.withColumn("step", step)
    last = w.rowsBetween(-(FLOW_EVENTS - 1), 0)
    flow = m.flow_persistence(F.sum("signed").over(last), F.sum(F.abs("signed")).over(last))
    full = F.count("step").over(w.rowsBetween(-(VOLATILITY_EVENTS - 1), 0)) == VOLATILITY_EVENTS
    return t.select("stream", "sequence", "mid", "spread", flow.alias("flow"), F.when(full, F.sqrt(F.avg(F.col("step") * F.col("step")).over(w.rowsBetween(-(VOLATILITY_EVENTS - 1), 0)))).alias("volatility"))


def _at(states: DataFrame, sequence: Column, suffix: str, *columns: str) -> DataFrame:
    return states.select("stream", sequence.alias("look_"), *[F.col(c).alias(f"{c}_{suffix}") for c in columns])


def toxicity(found: DataFrame, states: DataFrame, recovered: DataFrame, flows: DataFrame) -> DataFrame:
    """(attack_id, the seven components, missing, toxicity) of each attack, from what was known AFTER events past it; no score if a component is missing.

    Impact is measured against the attack before it on the same side, spread and volatility against what they were before its start, replenishment
    and withdrawal at the prices that stood then.
    """
    seq = F.col("sequence")
    before = found.join(_at(states, seq + 1, "0", "mid", "spread", "volatility").withColumnRenamed("look_", "start"), ["stream", "start"], "left")
    during = before.join(_at(states, seq, "1", "flow").withColumnRenamed("look_", "end"), ["stream", "end"], "left")
    later = during.join(_at(states, seq - AFTER, "2", "mid", "spread", "volatility").withColumnRenamed("look_", "end"), ["stream", "end"], "left")
    ratio = recovered.where(F.col("horizon") == AFTER).select("attack_id", "ratio")
    pressure = flows.where("attacked").select("attack_id", F.col("pressure").alias("withdrawal"))
    return scored(later.join(ratio, "attack_id", "left").join(pressure, "attack_id", "left")).select("attack_id", "stream", "side", "start", *[c for c, _ in liquidity.TOXICITY_WEIGHTS], "missing", "toxicity")


def scored(a: DataFrame) -> DataFrame:
    """The components, missing and toxicity of attacks with what was measured of each (mid_0, mid_2, ..., flow_1, ratio, withdrawal)."""
    own, recent = Window.partitionBy("stream", "side").orderBy("start"), Window.partitionBy("stream").orderBy("start", "side").rowsBetween(-(SHOCKS - 1), 0)
    sign = F.when(F.col("direction") == "BUY", 1).otherwise(-1)
    a = a.withColumn("shocks", F.abs(F.sum(sign).over(recent)) / F.count("*").over(recent))  # by stream first: that serves both
    a = a.withColumn("directional", m.directional(F.col("direction"), F.col("mid_2") - F.col("mid_0")))
    a = a.withColumn("directional_before", F.lag("directional").over(own))
    return liquidity.toxicity(a.withColumns({"flow": F.col("flow_1"), "impact": m.impact_component(F.col("directional_before"), F.col("directional")), "failure": m.bounded_failure(F.col("ratio")), "spread": m.bounded_excess(m.baseline_ratio(F.col("spread_0"), F.col("spread_2"))), "volatility": m.bounded_excess(m.baseline_ratio(F.col("volatility_0"), F.col("volatility_2")))}))


def credibility(found: DataFrame, trans: DataFrame) -> DataFrame:
    """(attack_id, credibility, n_orders): of the attacked side's orders that were touched in the attack or up to AFTER events past it, how much was executed, stayed, and wasn't withdrawn of what stood at its start, weighted by that."""
    t = trans.where("error IS NULL").select("stream", "side", "sequence", "order_id", "life", F.col("pre_qty").cast("double").alias("pre_qty"), F.col("post_qty").cast("double").alias("post_qty"), F.col("executed").cast("double").alias("executed"), F.col("withdrawn").cast("double").alias("withdrawn"), "at_us")
    first, last = F.floor(F.col("start") / SPAN), F.floor((F.col("end") + AFTER) / SPAN)
    spread = found.select("attack_id", "stream", "side", "start", "end", F.explode(F.sequence(first, last)).alias("bucket"))
    j = spread.join(t.withColumn("bucket", F.floor(F.col("sequence") / SPAN)), ["stream", "side", "bucket"]).where((F.col("sequence") >= F.col("start")) & (F.col("sequence") <= F.col("end") + AFTER))
    g = j.groupBy("attack_id", "order_id", "life").agg(F.min_by("pre_qty", "sequence").alias("before"), F.sum("executed").alias("executed"), F.sum("withdrawn").alias("withdrawn"), F.max_by("post_qty", "sequence").alias("after")).where("before > 0")
    share = lambda c: F.least(F.col(c) / F.col("before"), F.lit(1.0))
    score = m.convex((share("executed"), 0.5), (share("after"), 0.25), (1 - share("withdrawn"), 0.25))
    return g.groupBy("attack_id").agg((F.sum(F.col("before") * score) / F.sum("before")).alias("credibility"), F.count("*").alias("n_orders"))


def comparisons(found: DataFrame, toxic: DataFrame, credible: DataFrame) -> DataFrame:
    """(attack_id, before_id, d_credibility, d_toxicity, reason) of each attack and the one before it on the same side; a difference is null, with the reason, where either is unknown."""
    return compared(found.select("attack_id", "stream", "side", "start").join(toxic.select("attack_id", "toxicity"), "attack_id", "left").join(credible.select("attack_id", "credibility"), "attack_id", "left"))


def compared(j: DataFrame) -> DataFrame:
    """comparisons() of attacks that have their toxicity and credibility."""
    w = Window.partitionBy("stream", "side").orderBy("start")
    b = j.withColumns({f"{c}_before": F.lag(c).over(w) for c in ("attack_id", "toxicity", "credibility")}).where("attack_id_before IS NOT NULL")
    dc, dt = F.col("credibility") - F.col("credibility_before"), F.col("toxicity") - F.col("toxicity_before")
    return b.select("attack_id", F.col("attack_id_before").alias("before_id"), dc.alias("d_credibility"), dt.alias("d_toxicity"), F.concat_ws(",", F.when(dc.isNull(), "CREDIBILITY_UNKNOWN"), F.when(dt.isNull(), "TOXICITY_UNKNOWN")).alias("reason"))


class _Run:
    """An attack as it goes on, with what stood before it."""

    __slots__ = ("end", "flow", "levels", "n", "start", "tape")

    def __init__(self, start: int, levels: list[tuple[int, int]], tape: tuple) -> None:
        self.start, self.end, self.n, self.levels, self.tape, self.flow = start, start, 0, levels, tape, None


class _Stream:
    """One stream's events in turn: its orders as transitions() has them, its book as snapshots() has it, and the attacks not yet measured.

    The two differ only after an event that would cross the book, which snapshots() leaves out; from there to the next RESET a Book goes beside the orders.
    What no open attack reaches back to is dropped.
    """

    def __init__(self, stream: int) -> None:
        self.stream, self.last, self.mid, self.spread = stream, None, None, None
        self.steps, self.signed, self.net, self.gross = deque(maxlen=VOLATILITY_EVENTS), deque([0] * FLOW_EVENTS), 0, 0
        self.log: dict[str, tuple[list[int], list[tuple]]] = {}
        self.runs: dict[str, deque[_Run]] = {}
        self.clear()

    def clear(self) -> None:
        self.orders: dict[str, tuple] = {}
        self.levels: dict[str, dict[int, list[int]]] = {"BID": {}, "ASK": {}}
        self.best: dict[str, int | None] = {"BID": None, "ASK": None}
        self.book: Book | None = None

    def _fork(self) -> None:
        self.book = Book()
        for order, (_, side, price, qty) in self.orders.items():
            self.book._put(order, None, (side, price, qty))

    def _top(self, side: str) -> list[tuple[int, int]]:
        levels = self.book.levels[side] if self.book else self.levels[side]
        return [(p, levels[p][0]) for p in (heapq.nlargest if side == "BID" else heapq.nsmallest)(LEVELS, levels)]

    def _volatility(self) -> float | None:
        return math.sqrt(sum([x * x for x in self.steps]) / VOLATILITY_EVENTS) if len(self.steps) == VOLATILITY_EVENTS and None not in self.steps else None

    def _move(self, side: str, price: int, qty: int, n: int) -> int:
        levels = self.levels[side]
        level = levels.get(price)
        if level is None:
            level = levels[price] = [0, 0]
            best = self.best[side]
            if best is None or (price > best if side == "BID" else price < best):
                self.best[side] = price
        level[0] += qty
        level[1] += n
        if level[1] <= 0:
            del levels[price]
            if self.best[side] == price:
                self.best[side] = (max if side == "BID" else min)(levels, default=None)
        return level[0]

    def step(self, sequence: int, order: str, action: str, side: str, price: int | None, qty: int | None, out: list[tuple]) -> None:
        signed, run = 0, None
        if action == "RESET":
            self.clear()
        else:
            qty = qty or 0
            life, side_of, now, held = self.orders.get(order, (0, None, None, 0))
            error = fault(held > 0, side_of, now, held, action, side, price, qty)
            if error is None and self.book is None and price is not None and action in ("ADD", "MODIFY"):
                other = self.best["ASK" if side == "BID" else "BID"]
                if other is not None and (price > other if side == "BID" else price < other):
                    self._fork()
            if error is None and action == "EXECUTE":
                runs = self.runs.setdefault(side, deque())
                if runs and sequence - runs[-1].end <= GAP:
                    run = runs[-1]
                else:
                    there = self.last == sequence - 1
                    run = _Run(sequence, self._top(side) if there else [], (self.mid, self.spread, self._volatility()) if there else (None, None, None))
                    runs.append(run)
                run.end, run.n = sequence, run.n + 1
                signed = qty if side == "ASK" else -qty
            if self.book is not None:
                self.book.apply(order, action, side, price, qty)
            if error is None:
                before, left, added, executed, withdrawn = now, held, 0, 0, 0
                if action == "ADD":
                    life, before, now, left, added = life + 1, None, price, qty, qty
                elif action == "MODIFY":
                    added, withdrawn, now, left = max(qty - held, 0), max(held - qty, 0), price, qty
                elif action == "EXECUTE":
                    executed, left = qty, held - qty
                else:
                    withdrawn = held if action == "DELETE" else qty
                    left = held - withdrawn
                self.orders[order] = (life, side, now, left)
                here = there = None
                if now is not None and now == before:
                    here = there = self._move(side, now, left - held, (left > 0) - (held > 0))
                else:
                    if before is not None:
                        here = self._move(side, before, -held, -(held > 0))
                    if now is not None:
                        there = self._move(side, now, left, int(left > 0))
                seen, rows = self.log.setdefault(side, ([], []))
                seen.append(sequence)
                rows.append((order, life, action, before, now, held, left, added, executed, withdrawn, here, there))
                if len(seen) > 4096:
                    self._trim(side)
        if self.book is None:
            bid, ask = self.best["BID"], self.best["ASK"]
        else:
            bid, ask = max(self.book.levels["BID"], default=None), min(self.book.levels["ASK"], default=None)
        mid = spread = None
        if bid is not None and ask is not None:
            mid, spread = (bid / _MILLION + ask / _MILLION) / 2, ask / _MILLION - bid / _MILLION
        self.steps.append(mid / self.mid - 1 if mid is not None and self.mid is not None else None)
        gone = self.signed.popleft()
        self.signed.append(signed)
        self.net, self.gross = self.net + signed - gone, self.gross + abs(signed) - abs(gone)
        self.last, self.mid, self.spread = sequence, mid, spread
        if run is not None:
            run.flow = abs(self.net) / self.gross if self.gross else 0.0
        for which, runs in self.runs.items():
            while runs and runs[0].end + AFTER <= sequence:
                self._measure(which, runs.popleft(), out)

    def _trim(self, side: str) -> None:
        seen, rows = self.log[side]
        runs = self.runs.get(side)
        cut = bisect_left(seen, runs[0].start) if runs else len(seen)
        if 2 * cut >= len(seen):
            del seen[:cut], rows[:cut]

    def _measure(self, side: str, run: _Run, out: list[tuple]) -> None:
        if run.n < LEAST or run.start <= 0:
            return
        later = (self.mid, self.spread, self._volatility()) if self.last == run.end + AFTER else (None, None, None)
        seen, rows = self.log[side]
        base = dict(run.levels)
        low, then, added, withdrawn, touched = dict(base), dict(base), 0, 0, {}
        for i in range(bisect_left(seen, run.start), bisect_right(seen, run.end + AFTER)):
            order, life, action, before, now, held, left, more, executed, less, here, there = rows[i]
            t = touched.get((order, life))
            if t is None:
                touched[order, life] = [held, executed, less, left]
            else:
                t[1] += executed
                t[2] += less
                t[3] = left
            for price, depth in ((before, here), (now, there)):
                if price in base and depth is not None:
                    then[price] = depth
                    if seen[i] <= run.end and depth < low[price]:
                        low[price] = depth
            if action == "ADD":
                added += left if now in base else 0
            elif action == "MODIFY" and before is not None and now is not None and before != now:
                added += left if now in base else 0
                withdrawn += held if before in base else 0
            elif before in base:
                added += more
                withdrawn += less
        ratio = pressure = credible = None
        if base:
            lost = sum(base.values()) - sum(low.values())
            ratio = (sum(then.values()) - sum(low.values())) / lost if lost else None
            pressure = withdrawn / _MILLION / (added / _MILLION + withdrawn / _MILLION + m.EPSILON)
        stood = [t for t in touched.values() if t[0] > 0]
        if stood:
            credible = sum([q * (0.5 * min(x / q, 1.0) + 0.25 * min(z / q, 1.0) + 0.25 * (1 - min(w / q, 1.0))) for q, x, w, z in stood]) / sum([t[0] for t in stood])
        out.append((self.stream, side, run.start, run.end, *run.tape, run.flow, *later, ratio, pressure, credible))

    def close(self, out: list[tuple]) -> None:
        for side, runs in self.runs.items():
            for run in runs:
                self._measure(side, run, out)


_MEASURED = "stream long, side string, start long, end long, mid_0 double, spread_0 double, volatility_0 double, flow_1 double, mid_2 double, spread_2 double, volatility_2 double, ratio double, withdrawal double, credibility double"
_MEASURED_TYPES = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "string": pa.utf8(), "double": pa.float64()}[c.split(" ")[1]]) for c in _MEASURED.split(", ")])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out: list[tuple] = []
        for stream, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or stream != now.stream:
                if now is not None:
                    now.close(out)
                now = _Stream(stream)
            now.step(*event, out)
        yield _measured_batch(out)
    if now is not None:
        out = []
        now.close(out)
        yield _measured_batch(out)


def _measured_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(_MEASURED_TYPES), _MEASURED_TYPES, strict=True)], schema=_MEASURED_TYPES)


def measured(events: DataFrame) -> DataFrame:
    """(attack_id, stream, side, direction, start, end, what scored() reads, credibility) in one pass over each stream's sorted events.

    The same as attacks() with tape(), level_recoveries(), region_flow() and credibility() joined to it, but only attacks leave the pass; no event is written out.
    """
    got = scaled(events).repartition("stream").sortWithinPartitions("stream", "sequence").mapInArrow(_replay, _MEASURED)
    return got.withColumns({"attack_id": F.concat_ws(":", "stream", "side", "start"), "direction": F.when(F.col("side") == "ASK", "BUY").otherwise("SELL")})
