"""Scalar market measures as column expressions. Whatever has no denominator is null, never zero or imputed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
#: Weights by level from the touch.
DEPTH_WEIGHTS = (1.0, 0.5, 0.25, 0.125, 0.0625)


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def elapsed_seconds(start: Column, end: Column, signed: bool = False) -> Column:
    """Exact seconds between two timestamps; null if they run backwards, unless signed."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)")
    return seconds if signed else F.when(micros >= 0, seconds)


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    return over(ask * bid_size + bid * ask_size, bid_size + ask_size)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def imbalance(bid_sizes: Column, ask_sizes: Column, levels: int) -> Column:
    """(bids - asks) / (bids + asks) over the first levels; zero for an empty book."""
    b, a = _sum(F.slice(bid_sizes, 1, levels)), _sum(F.slice(ask_sizes, 1, levels))
    return F.coalesce(over(b - a, b + a), F.lit(0.0))


def weighted_depth(sizes: Column, weights: tuple[float, ...] = DEPTH_WEIGHTS) -> Column:
    """Sizes by level times falling weights; levels beyond the weights count nothing."""
    w = F.array(*[F.lit(x) for x in weights])
    return _sum(F.zip_with(F.slice(sizes, 1, len(weights)), w, lambda s, x: F.coalesce(s * x, F.lit(0.0))))


def directional(direction: Column, change: Column) -> Column:
    """A rise counts for BUY, a fall for SELL."""
    return F.when(direction == "BUY", change).when(direction == "SELL", -change)


def replenishment_ratio(baseline: Column, least: Column, later: Column) -> Column:
    """Share of the lost depth that came back, not clamped; null if none was lost."""
    return over(later - least, baseline - least)


def effectiveness(impact: Column, aggression: Column, epsilon: float = EPSILON) -> Column:
    return impact / (aggression + epsilon)


def relative_change(first: Column, second: Column, epsilon: float = EPSILON) -> Column:
    return (second - first) / (F.abs(first) + epsilon)


def trend(change: Column, tolerance: float = EPSILON) -> Column:
    """The band of stability includes its bounds."""
    return F.when(change < -tolerance, "WEAKENING").when(change > tolerance, "STRENGTHENING").when(change.isNotNull(), "STABLE")


def absorption(ratio: Column, effect: Column, epsilon: float = EPSILON) -> Column:
    return ratio / (F.abs(effect) + epsilon)


def flow_persistence(net: Column, gross: Column) -> Column:
    return F.coalesce(over(F.abs(net), gross), F.lit(0.0))


def flow_direction(net: Column, tolerance: float = 0.0) -> Column:
    return F.when(net > tolerance, "BUY").when(net < -tolerance, "SELL").when(net.isNotNull(), "NEUTRAL")


def share(part: Column, whole: Column) -> Column:
    """part / whole, zero of nothing."""
    return F.coalesce(over(part, whole), F.lit(0.0))


def at_least(value: Column, low: float) -> Column:
    """greatest() passes over nulls; here what is unknown stays unknown."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def impact_magnitude_ratio(before: Column, now: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(now) / F.when(F.abs(before) == 0, F.lit(epsilon)).otherwise(F.abs(before))


def impact_component(before: Column, now: Column, epsilon: float = EPSILON) -> Column:
    up = at_least(now, 0.0)
    whole = F.abs(before) + up
    return up / F.when(whole == 0, F.lit(epsilon)).otherwise(whole)


def bounded_failure(ratio: Column) -> Column:
    return at_least(1 - at_least(ratio, 0.0), 0.0)


def baseline_ratio(baseline: Column, now: Column, epsilon: float = EPSILON) -> Column:
    """Expansion of a spread or jump of a volatility against its baseline."""
    return now / F.when(baseline == 0, F.lit(epsilon)).otherwise(baseline)


def bounded_positive(value: Column) -> Column:
    return value / (1 + value)


def bounded_excess(ratio: Column) -> Column:
    return bounded_positive(at_least(ratio - 1, 0.0))


def saturation(value: Column, tau: float) -> Column:
    return 1 - F.exp(-value / tau)


def speed(delay: Column, tau: float) -> Column:
    return F.exp(-delay / tau)


def convex(*weighted: tuple[Column, float]) -> Column:
    """A weighted sum; the weights must add up to one."""
    if abs(sum(w for _, w in weighted) - 1) > 1e-12:
        raise ValueError("weights must add up to one")
    total = F.lit(0.0)
    for value, weight in weighted:
        total = total + value * weight
    return total
