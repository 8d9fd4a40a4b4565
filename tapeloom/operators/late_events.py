"""Aggregates by event time that late arrivals correct up to a cut-off.

Arrivals are first folded into partials by (group, period, arrival tick), a tick being the largest step that divides
both period and cut-off, so whether a partial is in time, late or too late is decided without looking at single events.
One task then replays the partials of a group in order of arrival into a finger B-tree keyed by event time: it is
entered at its newest leaf, so an event in order costs a step and a late one climbs only as far as it is late; every
insert adds to the partials of its ancestors. When arrival time passes a period's cut-off, all periods that are closed
by it are cut from the tree's left side in one go, and come out as final.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from decimal import Decimal, localcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
#: Groups are split into stretches of event time, so no task has to hold or replay the whole history of a busy group.
STRETCH_PERIODS = 24 * 32
FAN_OUT = 16

Partial = list[int]


class _Node:
    __slots__ = ("keys", "values", "kids", "parent", "total")

    def __init__(self, width: int, parent: _Node | None = None) -> None:
        self.keys: list[int] = []
        self.values: list[Partial] = []
        self.kids: list[_Node] = []
        self.parent = parent
        self.total = [0] * width


class FingerBTree:
    """Sums by key. Each node holds the sum of its subtree; the newest leaf is kept at hand as the finger."""

    def __init__(self, width: int, fan_out: int = FAN_OUT) -> None:
        self.width, self.fan_out = width, fan_out
        self.root = self.finger = _Node(width)

    def insert(self, key: int, delta: Partial) -> None:
        node = self.finger
        while node.parent is not None and key <= node.parent.keys[-1]:
            node = node.parent
        while True:
            at = bisect_left(node.keys, key)
            if at < len(node.keys) and node.keys[at] == key:
                node.values[at] = [a + b for a, b in zip(node.values[at], delta, strict=True)]
                break
            if not node.kids:
                node.keys.insert(at, key)
                node.values.insert(at, list(delta))
                break
            node = node.kids[at]
        up: _Node | None = node
        while up is not None:
            up.total = [a + b for a, b in zip(up.total, delta, strict=True)]
            up = up.parent
        while len(node.keys) > self.fan_out:
            node = self._split(node)

    def _sum(self, node: _Node) -> Partial:
        return [sum(x) for x in zip([0] * self.width, *node.values, *(k.total for k in node.kids), strict=True)]

    def _split(self, node: _Node) -> _Node:
        mid = len(node.keys) // 2
        right = _Node(self.width, node.parent)
        key, value = node.keys[mid], node.values[mid]
        right.keys, right.values, right.kids = node.keys[mid + 1 :], node.values[mid + 1 :], node.kids[mid + 1 :]
        del node.keys[mid:], node.values[mid:], node.kids[mid + 1 :]
        for kid in right.kids:
            kid.parent = right
        parent = node.parent
        if parent is None:
            parent = self.root = _Node(self.width)
            parent.total = list(node.total)
            parent.kids = [node]
            node.parent = right.parent = parent
        at = parent.kids.index(node)
        parent.keys.insert(at, key)
        parent.values.insert(at, value)
        parent.kids.insert(at + 1, right)
        node.total, right.total = self._sum(node), self._sum(right)
        if self.finger is node:
            self.finger = right
        return parent

    def window(self, low: int, high: int) -> Partial:
        """The sum over low <= key < high; subtrees inside count by their partial."""

        def over(node: _Node, lo: int | None, hi: int | None) -> Partial:
            if lo is None and hi is None:
                return node.total
            a = 0 if lo is None else bisect_left(node.keys, lo)
            b = len(node.keys) if hi is None else bisect_left(node.keys, hi)
            out = [sum(x) for x in zip([0] * self.width, *node.values[a:b], strict=True)]
            for i in range(a, b + 1) if node.kids else ():
                part = over(node.kids[i], lo if i == a else None, hi if i == b else None)
                out = [x + y for x, y in zip(out, part, strict=True)]
            return out

        return over(self.root, low, high)

    def _items(self, node: _Node) -> Iterator[tuple[int, Partial]]:
        for i, key in enumerate(node.keys):
            if node.kids:
                yield from self._items(node.kids[i])
            yield key, node.values[i]
        if node.kids:
            yield from self._items(node.kids[-1])

    def items(self) -> list[tuple[int, Partial]]:
        return list(self._items(self.root))

    def evict_below(self, bound: int) -> list[tuple[int, Partial]]:
        """Cut off all keys below bound, whole subtrees at once, and return them in order."""
        gone: list[tuple[int, Partial]] = []
        path, node = [], self.root
        while True:
            at = bisect_left(node.keys, bound)
            for i in range(at):
                if node.kids:
                    gone.extend(self._items(node.kids[i]))
                gone.append((node.keys[i], node.values[i]))
            del node.keys[:at], node.values[:at], node.kids[:at]
            path.append(node)
            if not node.kids:
                break
            node = node.kids[0]
        if not gone:
            return gone
        for node in reversed(path):
            if node.kids and not node.kids[0].keys and not node.kids[0].kids:  # nothing is left of the oldest child
                if node.keys:
                    orphan_key, orphan = node.keys.pop(0), node.values.pop(0)
                    node.kids.pop(0)
                    self._put_first(node.kids[0], orphan_key, orphan)
                else:
                    node.kids = []
            node.total = self._sum(node)
        while not self.root.keys and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
        node = self.root
        while node.kids:
            node = node.kids[-1]
        self.finger = node
        gone.sort(key=lambda x: x[0])
        return gone

    def _put_first(self, node: _Node, key: int, value: Partial) -> None:
        while True:
            node.total = [a + b for a, b in zip(node.total, value, strict=True)]
            if not node.kids:
                break
            node = node.kids[0]
        node.keys.insert(0, key)
        node.values.insert(0, value)


FINAL = "feed string, group_key string, period long, n_in_time long, n_late long, volume_in_time decimal(38,6), volume_late decimal(38,6)"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by feed, group, stretch and tick; every period that had an event before its cut-off comes out once."""
    tree, whose, now, out = FingerBTree(4), None, None, []

    def close(bound: int | None) -> None:
        for period, sums in tree.evict_below(bound) if bound is not None else tree.items():
            out.append((*whose[:2], period, *sums))

    def batch_of() -> pa.RecordBatch:
        with localcontext() as context:
            context.prec = 60
            cols = list(zip(*out, strict=True)) or [()] * 7
            money = [pa.array([Decimal(x).scaleb(-6) for x in c], pa.decimal128(38, 6)) for c in cols[5:]]
        plain = [pa.array(c, t) for c, t in zip(cols[:5], (pa.utf8(), pa.utf8(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays([*plain, *money], names=["feed", "group_key", "period", "n_in_time", "n_late", "volume_in_time", "volume_late"])

    for batch in batches:
        for feed, group, stretch, period, tick, ticks, grace, n, volume in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (feed, group, stretch) != whose:
                if whose is not None:
                    close(None)
                tree, whose, now = FingerBTree(4), (feed, group, stretch), None
            if tick != now:
                now = tick
                close((tick - grace) // ticks)  # the periods with (period + 1) * ticks + grace <= tick
            end = (period + 1) * ticks
            if tick < end:
                tree.insert(period, [n, 0, int(volume), 0])
            elif tick < end + grace:
                tree.insert(period, [0, n, 0, int(volume)])
        if len(out) > 10_000:
            yield batch_of()
    if whose is not None:
        close(None)
    yield batch_of()


def partials(events: DataFrame, feed: str, group: str, event_time: str, receive_time: str, volume: Column, cutoff_us: int, period_us: int = HOUR_US) -> DataFrame:
    """Events (each once) as counts and volumes by group, period and arrival tick. Rows that lack group, event time or receipt have no place and are left out."""
    tick = math.gcd(period_us, cutoff_us)
    placed = events.where(F.col(group).isNotNull() & F.col(event_time).isNotNull() & F.col(receive_time).isNotNull())
    period = F.expr(f"(unix_micros({event_time}) - pmod(unix_micros({event_time}), {period_us}L)) div {period_us}L")
    arrival = F.expr(f"(unix_micros({receive_time}) - pmod(unix_micros({receive_time}), {tick}L)) div {tick}L")
    grouped = placed.groupBy(F.col(group).alias("group_key"), period.alias("period"), arrival.alias("tick")).agg(F.count("*").alias("n"), F.sum(volume.cast("decimal(28,6)")).alias("volume"))
    return grouped.select(F.lit(feed).alias("feed"), "group_key", "period", "tick", F.lit(period_us // tick).alias("ticks"), F.lit(cutoff_us // tick).alias("grace"), "n", F.coalesce("volume", F.lit(0)).cast("decimal(38,6)").alias("volume"))


def corrected_periods(parts: DataFrame) -> DataFrame:
    """Partials (several feeds may be united) to one FINAL row for each period with an event received before its cut-off.

    n_in_time and volume_in_time are what was known at the period's end, n_late and volume_late what came after it and
    before the cut-off; what came later changes nothing. An empty table gives an empty one.
    """
    stretch = F.expr(f"(period - pmod(period, {STRETCH_PERIODS}L)) div {STRETCH_PERIODS}L")
    whole = F.expr("CAST(CAST(volume * 1000000BD AS DECIMAL(38,0)) AS STRING)")
    ready = parts.select("feed", "group_key", stretch.alias("stretch"), "period", "tick", "ticks", "grace", "n", whole.alias("volume"))
    ordered = ready.repartition("feed", "group_key", "stretch").sortWithinPartitions("feed", "group_key", "stretch", "tick", "period")
    return ordered.mapInArrow(_replay, FINAL)


def first_receipts(events: DataFrame, event_id: str, receive_time: str, carry: list[str]) -> DataFrame:
    """One row for each event_id, as received first; rows without an event_id can't be told apart and are left out."""
    earliest = F.min(F.struct(F.coalesce(receive_time, F.timestamp_micros(F.lit(2**63 - 1))).alias("at"), *carry))
    return events.where(F.col(event_id).isNotNull()).groupBy(event_id).agg(earliest.alias("first")).select(event_id, F.col("first.at").alias(receive_time), *[F.col(f"first.{c}").alias(c) for c in carry])
