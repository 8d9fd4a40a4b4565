"""Queries of provider records, shocks, market measures and research statistics, each with the SQL it is compared with."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.operators import asof, late_events, provider, research, shocks, structural_csv
from tapeloom.operators import sequences as s
from tapeloom.plans.frames import STATES, market_states, states
from tapeloom.plans.problems import _MBO
from tapeloom.plans.sequence_queries import SEGMENTED, _segmented
from tapeloom.session import cut_lineage
from tapeloom.tables import table


def _records(spark, folder):
    return structural_csv.split_lines(table(spark, folder, "databento_mbo_fixture"))[0]


def pv1(spark, folder):
    return _records(spark, folder).groupBy(provider.shape_error().alias("finding")).agg(F.count("*").alias("n"))


def pv2(spark, folder):
    r = _records(spark, folder).withColumn("fixed", (F.col("price") * 1_000_000_000).cast("decimal(28,0)"))
    return r.select("record_id", provider.decode_price(F.col("fixed")).cast("decimal(20,6)").alias("price"))


def pv3(spark, folder):
    r = _records(spark, folder)
    return r.groupBy("publisher_id").agg(*[F.count(F.when(provider.has_flag(f), 1)).alias(f) for f in provider.FLAGS])


def pv4(spark, folder):
    r = _records(spark, folder).withColumn("print", provider.fingerprint("ts_recv", "ts_event", "publisher_id", "instrument_id", "action", "side", "price", "size", "order_id", "sequence"))
    return r.groupBy("print").agg(F.min("record_id").alias("first_record"), F.count("*").alias("n")).where("n > 1").drop("print")


def pv5(spark, folder):
    return provider.sequence_findings(_records(spark, folder), "record_id").groupBy("publisher_id", "finding").agg(F.count("*").alias("n"))


def pv6(spark, folder):
    return provider.to_events(_records(spark, folder), "record_id").select("record_id", "event", "aggressor")


def pv7(spark, folder):
    return provider.to_events(_records(spark, folder), "record_id").select("record_id", "event_sequence")


def pv8(spark, folder):
    r = _records(spark, folder)
    return r.select("record_id", F.unix_micros(provider.process_time(F.col("ts_recv"), F.col("ts_event"))).alias("at_receipt"), F.unix_micros(provider.process_time(F.col("ts_recv"), F.col("ts_event"), 500)).alias("offset_us"))


def pv9(spark, folder):
    w = s.ordered(list(provider.STREAM), "record_id")
    r = _records(spark, folder).withColumn("session", provider.session(F.col("ts_event"), "America/New_York"))
    changed = F.coalesce(F.lag("session").over(w) != F.col("session"), F.lit(False))
    return r.withColumn("boundary", F.when(F.col("action") == "R", "RESET").when(changed, "SESSION").otherwise("NONE")).groupBy("boundary", "session").agg(F.count("*").alias("n"))


def pv10(spark, folder):
    r = provider.sequence_findings(_records(spark, folder), "record_id").withColumn("shape", provider.shape_error())
    return r.agg(F.count("shape").alias("n_shape"), F.count(F.when(F.col("finding") == "REGRESSION", 1)).alias("n_regressions"), F.count(F.when(F.col("finding") == "GAP", 1)).alias("n_gaps"), (F.count("shape") + F.count(F.when(F.col("finding") != "OK", 1)) == 0).alias("passes"))


def fn11(spark, folder):
    r = _records(spark, folder)
    return r.select("record_id", provider.session(F.col("ts_event"), "America/New_York").alias("session"))


def fn12(spark, folder):
    return _records(spark, folder).select("record_id", F.unix_micros("ts_recv").alias("recv_us"))


def ag10(spark, folder):
    files = table(spark, folder, "databento_mbo_fixture").select("record_id", "file_name")
    r = _records(spark, folder).join(files, "record_id")
    return r.groupBy("file_name").agg(F.count("*").alias("n"), F.min(F.unix_micros("ts_event")).alias("first_us"), F.max(F.unix_micros("ts_event")).alias("last_us"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.array_sort(F.collect_set("publisher_id")).alias("publishers"), F.array_sort(F.collect_set("action")).alias("actions"))


def jn12(spark, folder):
    """Provider symbols that map to exactly one instrument."""
    r = _records(spark, folder).select("publisher_id", "symbol").distinct()
    i = table(spark, folder, "instruments").select(F.col("ticker").alias("symbol"), "instrument_id")
    return asof.resolve(r, i, "symbol", "instrument_id")


def _firsts(spark, folder):
    e = table(spark, folder, "raw_market_events")
    return late_events.first_receipts(e, "event_id", "receive_time", ["instrument_id", "venue", "event_kind", "book_action", "trade_id", "quantity", "aggressor_side", "sequence_number"])


def _reconciled(spark, folder):
    e = _firsts(spark, folder)
    keys = ["instrument_id", "venue"]
    ex = e.where("event_kind = 'BOOK' AND book_action = 'EXECUTE'")
    newest = ex.withColumn("nth", F.row_number().over(s.Window.partitionBy(*keys, "trade_id").orderBy(F.desc("sequence_number"), F.desc("event_id")))).where("nth = 1 OR trade_id IS NULL")
    return shocks.reconcile(newest, e.where("event_kind = 'TRADE'"), keys)


def jn8(spark, folder):
    return _reconciled(spark, folder).groupBy("venue", "status").agg(F.count("*").alias("n"))


def sr1(spark, folder):
    return shocks.observations(_reconciled(spark, folder)).groupBy("instrument_id", "aggressor").agg(F.count("*").alias("n"), F.sum("volume").cast("decimal(28,6)").alias("volume"))


def _depths(df):
    return df.withColumn("depth", (F.lit(200) + 10 * (F.col("event_id") % 37)).cast("double"))


GAP_US, PAIR_S = 24 * 3600 * 1_000_000, 30 * 86400


def _shocks(spark, folder):
    seg = _depths(_segmented(spark, folder))
    isl = s.paired_islands(seg, 4, GAP_US)
    spans = seg.groupBy("instrument", "event_index").agg(F.first("at_us").alias("at"), F.first("segment").alias("segment"))
    j = isl.join(spans.select("instrument", F.col("event_index").alias("first_index"), F.col("at").alias("start_us"), "segment"), ["instrument", "first_index"]).join(spans.select("instrument", F.col("event_index").alias("last_index"), F.col("at").alias("end_us")), ["instrument", "last_index"])
    before = seg.select("instrument", (F.col("event_index") + 1).alias("first_index"), F.col("depth").alias("d0"))
    j = j.join(before, ["instrument", "first_index"]).withColumn("aggression", m.over(F.col("volume"), F.col("d0")))
    return j.withColumn("shock_id", F.concat_ws(":", "instrument", "first_index")).drop("island", "d0")


SHOCK_HORIZONS, RECOVERY_HORIZONS, THRESHOLDS = (1, 5, 10, 25), (5, 10, 25), (0.25, 0.5, 0.75, 1.0)
#: All horizons of the inventory; the queries compared with SQL have the shorter ones above.
ALL_SHOCK_HORIZONS, ALL_RECOVERY_HORIZONS, ALL_LABELS = (1, 5, 10, 25, 50, 100), (5, 10, 25, 50, 100), (10, 25, 50, 100, 250)


def sr2(spark, folder):
    return _shocks(spark, folder).select("shock_id", F.round("aggression", 8).alias("aggression"), F.round(m.over(F.col("volume"), F.col("n_executions")), 6).alias("average_size"), F.round(m.over(F.col("volume"), (F.col("end_us") - F.col("start_us")) / 1e6), 8).alias("rate"))


def sr3(spark, folder):
    """Price levels touched by each shock, and those at which trading stopped with it."""
    seg = _segmented(spark, folder).where("side IN ('BUY', 'SELL')")
    inside = _shocks(spark, folder).select("shock_id", "instrument", F.explode(F.sequence("first_index", "last_index")).alias("event_index")).join(seg.select("instrument", "event_index", "mid"), ["instrument", "event_index"])
    return inside.groupBy("shock_id").agg(F.countDistinct("mid").alias("touched"), F.round(F.max("mid") - F.min("mid"), 6).alias("reach"))


def sr5(spark, folder):
    x = _shocks(spark, folder)
    return x.select("shock_id", F.array_join(shocks.classify(F.col("aggression"), F.col("volume"), F.lit(1)), ",").alias("failed"))


def sr6(spark, folder):
    x = _shocks(spark, folder)
    status = F.when(F.size(shocks.classify(F.col("aggression"), F.col("volume"), F.lit(1))) == 0, "SHOCK_CANDIDATE").otherwise("BELOW_THRESHOLDS")
    return x.groupBy("direction", status.alias("status")).agg(F.count("*").alias("n"))


def _after(spark, folder, horizons):
    return shocks.at_indices(_shocks(spark, folder), _depths(states(spark, folder)), horizons)


def sr7(spark, folder, horizons=SHOCK_HORIZONS):
    i = shocks.impacts(_after(spark, folder, horizons))
    return i.select("shock_id", "horizon", "available", *[F.round(c, 8).alias(c) for c in ("impact", "directional_impact", "volume_impact", "aggression_impact")])


def sr8(spark, folder, horizons=RECOVERY_HORIZONS):
    return shocks.resiliency(_after(spark, folder, horizons)).select("shock_id", "horizon", F.round("ratio", 8).alias("ratio"))


def sr9(spark, folder, horizons=RECOVERY_HORIZONS):
    r = shocks.resiliency(_after(spark, folder, horizons))
    return shocks.first_passage(r, THRESHOLDS).select("shock_id", "threshold", "events", F.round("seconds", 6).alias("seconds"))


def jn9(spark, folder):
    return shocks.nearest_prior(_shocks(spark, folder), within_seconds=PAIR_S)


def sr10(spark, folder):
    return shocks.pair_findings(_shocks(spark, folder)).select("shock_id", "prior_id", F.array_join("reasons", ",").alias("reasons"))


def sr11(spark, folder, horizons=RECOVERY_HORIZONS):
    """Change of effectiveness and resiliency between the shocks of a pair, by horizon; both must be known."""
    x = _after(spark, folder, horizons)
    e = shocks.impacts(x).select("shock_id", "horizon", "effectiveness").join(shocks.resiliency(x).select("shock_id", "horizon", "ratio"), ["shock_id", "horizon"])
    p = shocks.nearest_prior(_shocks(spark, folder), within_seconds=PAIR_S).select("shock_id", "prior_id")
    j = p.join(e, "shock_id").join(e.select(F.col("shock_id").alias("prior_id"), "horizon", F.col("effectiveness").alias("e1"), F.col("ratio").alias("r1")), ["prior_id", "horizon"]).where("effectiveness IS NOT NULL AND e1 IS NOT NULL")
    de = F.col("effectiveness") - F.col("e1")
    a1, a2 = m.absorption(F.col("r1"), F.col("e1")), m.absorption(F.col("ratio"), F.col("effectiveness"))
    return j.select("shock_id", "horizon", F.round(de, 8).alias("d_effectiveness"), F.round(m.relative_change(F.col("e1"), F.col("effectiveness")), 6).alias("relative"), m.trend(de).alias("trend"), F.round(F.col("ratio") - F.col("r1"), 8).alias("d_ratio"), F.round(a2 - a1, 3).alias("d_absorption"))


def rs3(spark, folder, horizons=RECOVERY_HORIZONS):
    return sr11(spark, folder, horizons).where("d_effectiveness < 0 AND d_ratio > 0").select("shock_id", "horizon")


def jn11(spark, folder):
    """The first state of the same instrument at or after each shock's end plus a delay."""
    sh = _shocks(spark, folder).select("shock_id", "instrument", (F.col("end_us") + 1_000_000).alias("ready_us"))
    st = states(spark, folder).select("instrument", F.col("at_us").alias("anchor_us"), "event_index")
    return asof.forward_asof(sh, st, "instrument", "ready_us", "anchor_us", "event_index").select("shock_id", "anchor_us", "event_index")


def jn10(spark, folder):
    """Trades in the five events after each shock."""
    sh = _shocks(spark, folder)
    near = sh.select("shock_id", "instrument", F.explode(F.sequence(F.col("last_index") + 1, F.col("last_index") + 5)).alias("event_index"))
    return near.join(states(spark, folder), ["instrument", "event_index"]).groupBy("shock_id").agg(F.count("*").alias("n_events"), F.count("side").alias("n_trades"))


def fn13(spark, folder):
    q = table(spark, folder, "raw_market_events").where("event_kind = 'QUOTE'")
    d = {c: F.col(c).cast("double") for c in ("best_bid_price", "best_bid_size", "best_ask_price", "best_ask_size")}
    b, bs, a, az = d.values()
    return q.select("event_id", "receive_time", F.round(m.spread(b, a), 6).alias("spread"), F.round(m.mid(b, a), 6).alias("mid"), F.round(m.microprice(b, bs, a, az), 6).alias("microprice"))


def _ratios(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"), F.col("l_quantity").alias("q"))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def fn22_25(spark, folder):
    x, y, q = F.col("x"), F.col("y"), F.col("q")
    return _ratios(spark, folder).select(*_KEYS, F.round(m.replenishment_ratio(q, q * x / 2, q * y), 8).alias("replenishment"), F.round(m.effectiveness(x - y, q), 8).alias("effect"), F.round(m.relative_change(x, y), 4).alias("relative"), m.trend(y - x).alias("trend"), F.round(m.absorption(x, y), 3).alias("absorption"))


def fn26(spark, folder):
    x, y, q = F.col("x"), F.col("y"), F.col("q")
    return _ratios(spark, folder).select(*_KEYS, *[F.round(c, 6).alias(n) for n, c in {
        "magnitude_ratio": m.impact_magnitude_ratio(x, y) / 1e6, "component": m.impact_component(x - 0.5, y - 0.4), "failure": m.bounded_failure(x * 2), "raw_failure": 1 - x, "provision": q - x, "normalized": m.share(q - x, q + x), "pressure": m.share(x, q + x),
        "spread_ratio": m.baseline_ratio(x, y) / 1e6, "bounded": m.bounded_positive(y), "excess": m.bounded_excess(x * 3), "interaction": x * y, "interaction_rest": x * (1 - y), "lifetime": m.saturation(q, 30.0), "cycles": m.saturation(x, 2.0), "speed": m.speed(q, 5.0),
        "composite": m.convex((m.bounded_positive(x), 0.2), (m.bounded_positive(y), 0.15), (m.bounded_failure(x), 0.15), (m.bounded_excess(q), 0.15), (x / (1 + x), 0.1), (y / (1 + y), 0.1), (m.share(x, x + y), 0.15)),
    }.items()])


def ag13(spark, folder):
    e = table(spark, folder, "raw_market_events").where("event_kind = 'TRADE'")
    return research.exact_median(e, ["instrument_id"], "price").select("instrument_id", F.col("median").cast("decimal(20,7)").alias("median"))


def ag16(spark, folder):
    e = table(spark, folder, "raw_market_events").where("event_kind = 'TRADE'")
    return research.nearest_rank(e, ["instrument_id"], "price", "0.9")


def ag14(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.covar_pop("l_quantity", "l_discount"), 6).alias("covariance"), F.round(F.stddev_pop("l_quantity"), 6).alias("deviation"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("l_tax") > 0.04, F.col("l_quantity"))), 6).alias("conditional"))


def ag15(spark, folder):
    o = table(spark, folder, "orders")
    return research.tail_difference(o, "o_totalprice", "o_custkey", "o_orderkey", 0.2).select(F.round("difference", 6).alias("difference"))


def ag17(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("fold"), "o_orderstatus").agg(F.avg("o_totalprice").alias("stat"), F.count("*").alias("w"))
    return o.groupBy("o_orderstatus").agg(F.round(F.sum(F.col("stat") * F.col("w")) / F.sum("w"), 4).alias("pooled"))


def ag9(spark, folder):
    st = states(spark, folder)
    return st.agg(F.round(F.avg(F.col("side").isNotNull().cast("double")), 6).alias("coverage"), F.round(F.avg((F.col("side") == "UNKNOWN").cast("double")), 6).alias("unknown_share"), F.countDistinct("instrument").alias("n_markets"))


LABEL = 10


def _labelled(spark, folder):
    f = s.forward(states(spark, folder), "instrument", "event_index", "mid", (LABEL,))
    return f.join(states(spark, folder).select("instrument", "event_index", "event_id", "at_us", "side"), ["instrument", "event_index"])


def rs1_2(spark, folder):
    """Features known at each state: the return and volatility behind it, and nothing from ahead."""
    b = s.backward(states(spark, folder), "instrument", "event_index", "mid", (10,))
    f = s.rolling_flow(states(spark, folder), "instrument", "event_index", 20)
    return b.join(f, ["instrument", "event_index"]).select("instrument", "event_index", F.round("back_return", 8).alias("back_return"), F.round("realized_volatility", 8).alias("volatility"), F.round("persistence", 6).alias("persistence"))


def rs4(spark, folder):
    r = _labelled(spark, folder).where("side IN ('BUY', 'SELL')")
    reversal = F.when(F.col("side") == "BUY", -1).otherwise(1) * (F.col("later") - F.col("mid")) / F.col("mid")
    reason = F.when(F.col("later").isNull(), "MISSING_FUTURE_EVENT")
    return r.select("event_id", (F.round(reversal, 8) + 0.0).alias("reversal"), (reversal > 0).alias("success"), F.round((F.col("highest") - F.col("mid")) / F.col("mid"), 8).alias("favourable"), reason.alias("unavailable"))


def rs4_all(spark, folder):
    """As rs4, one row an event and horizon."""
    f = s.forward(states(spark, folder), "instrument", "event_index", "mid", ALL_LABELS)
    r = f.join(states(spark, folder).select("instrument", "event_index", "event_id", "side"), ["instrument", "event_index"]).where("side IN ('BUY', 'SELL')")
    reversal = F.when(F.col("side") == "BUY", -1).otherwise(1) * (F.col("later") - F.col("mid")) / F.col("mid")
    reason = F.when(F.col("later").isNull(), "MISSING_FUTURE_EVENT")
    return r.select("event_id", "horizon", (F.round(reversal, 8) + 0.0).alias("reversal"), (reversal > 0).alias("success"), F.round((F.col("highest") - F.col("mid")) / F.col("mid"), 8).alias("favourable"), reason.alias("unavailable"))


def rs4_gaps(spark, folder):
    """As rs4_all; a label that reaches past the last event, or over a structural break, is unavailable, for the first of these reasons."""
    st = _segmented(spark, folder).select("instrument", "event_index", "event_id", "side", "segment")
    f = s.forward(states(spark, folder), "instrument", "event_index", "mid", ALL_LABELS)
    later = st.select("instrument", F.col("event_index").alias("end_index"), F.col("segment").alias("end_segment"))
    r = f.join(st, ["instrument", "event_index"]).where("side IN ('BUY', 'SELL')").withColumn("end_index", F.col("event_index") + F.col("horizon")).join(later, ["instrument", "end_index"], "left")
    reason = F.when(F.col("later").isNull(), "MISSING_FUTURE_EVENT").when(F.col("end_segment") != F.col("segment"), "STRUCTURAL_GAP")
    reversal = F.when(reason.isNull(), F.when(F.col("side") == "BUY", -1).otherwise(1) * (F.col("later") - F.col("mid")) / F.col("mid"))
    best = F.when(reason.isNull(), (F.col("highest") - F.col("mid")) / F.col("mid"))
    return r.select("event_id", "horizon", (F.round(reversal, 8) + 0.0).alias("reversal"), (reversal > 0).alias("success"), F.round(best, 8).alias("favourable"), reason.alias("unavailable"))


def rs5(spark, folder):
    r = _labelled(spark, folder)
    return r.agg(F.count("*").alias("n"), F.count("later").alias("n_labelled"), F.countDistinct("instrument").alias("n_markets"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))


TRAIN, TEST = 4000, 1500


ORDER = ["at_us", "instrument", "event_index", "event_id"]


def _ended(spark, folder):
    return _labelled(spark, folder).where("later IS NOT NULL").select("event_id", "instrument", "event_index", "at_us", (F.col("event_index") + LABEL).alias("label_end"))


def _folded(spark, folder):
    return research.folds(_ended(spark, folder), ORDER, TRAIN, TEST)


def _exceptions(spark, folder):
    return research.fold_exceptions(_ended(spark, folder), ORDER, TRAIN, TEST, "instrument", "event_index", "label_end", 5, "event_id")


def rs6(spark, folder):
    return _folded(spark, folder).select("fold", "role", "event_id")


def rs7_8(spark, folder):
    return _exceptions(spark, folder)[1].select(F.col("fold").cast("int").alias("fold"), "role", "n", F.col("total").alias("checksum"))


BLOCK, PERMUTATIONS, SEED = 50, 99, 1729


def rs9(spark, folder):
    r = _labelled(spark, folder).where("later IS NOT NULL")
    return r.select("event_id", F.floor(F.col("event_index") / 25).alias("block"))


#: Blocks whose orders are all tried.
FEW = 5


def _blocks(spark, folder, size=None):
    """All labelled rows with their block and place, the last block as short as it comes, their number and the blocks' size (0: FEW blocks in all)."""
    r = _labelled(spark, folder).where("later IS NOT NULL").select("event_id", "at_us", "instrument", "side", (F.col("later") - F.col("mid")).alias("label"))
    ranked = research.global_rank(r, ["at_us", "instrument", "event_id"])
    n, size = ranked.count(), BLOCK if size is None else size
    if size == 0:
        size = max(1, -(-n // FEW))
    return ranked.select("event_id", "side", F.floor(F.col("rank") / size).alias("block"), (F.col("rank") % size).alias("place"), "rank", "label"), n, size


def _pieces(spark, folder):
    """What _blocks() has, packed: the labels as in _labelled() from one window a market."""
    w = s.ordered("instrument", "at_us", "event_id")
    path = w.rowsBetween(0, LABEL)
    st = market_states(spark, folder).select("event_id", "at_us", "instrument", "mid", (F.col("side") == "BUY").alias("buy"))
    r = st.withColumns({"later": F.lead("mid", LABEL).over(w), "whole": F.count("mid").over(path) == LABEL + 1}).where("whole AND later IS NOT NULL")
    return research.packed(r, ["at_us", "instrument", "event_id"], F.col("later") - F.col("mid"), F.col("buy"))


def rs10(spark, folder):
    return research.packed_means(_pieces(spark, folder), BLOCK, PERMUTATIONS, SEED)


def _exact(spark, folder):
    rows, n, size = _blocks(spark, folder, 0)
    sizes = research.block_sizes(n, size)
    return rows, research.permuted_means(rows, research.every_order(len(sizes)), F.col("side") == "BUY", sizes)


def rs10_exact(spark, folder):
    """The null distribution over all orders of a few blocks."""
    return _exact(spark, folder)[1].groupBy(F.round("statistic", 9).alias("statistic")).agg(F.count("*").alias("n"))


def rs11_exact(spark, folder):
    """The p-value of each alternative from all orders."""
    rows, null = _exact(spark, folder)
    null = cut_lineage(null)
    observed = rows.where("side = 'BUY'").agg(F.avg("label")).first()[0] or 0.0
    out = None
    for alternative in ("GREATER", "LESS", "TWO_SIDED"):
        one = research.p_value(observed, null, True, alternative).withColumn("alternative", F.lit(alternative))
        out = one if out is None else out.unionByName(one)
    return out.select("alternative", "n_permutations", *[F.round(c, 9).alias(c) for c in ("p_value", "null_mean", "null_sd", "effect", "p5", "p50", "p95")])


def rs11_12(spark, folder):
    pieces = _pieces(spark, folder)
    total, hits = pieces.agg(F.sum("total"), F.sum("hits")).first()
    return research.p_value(total / hits if hits else 0.0, research.packed_means(pieces, BLOCK, PERMUTATIONS, SEED))


def rs13_wn12(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", (F.abs("c_acctbal") / 20000).alias("p"))
    r = research.corrections(c, "c_nationkey", "p", "c_custkey")
    return r.select("c_custkey", F.round("bonferroni", 7).alias("bonferroni"), F.round("bh", 7).alias("bh"))


def rs14(spark, folder):
    """Each hypothesis (a side) by fold and pooled over them (fold -1), weighted by their rows; where there is too little it says so."""
    f = _exceptions(spark, folder)[0].where("role = 'TEST'").select(F.col("fold").cast("int").alias("fold"), "event_id")
    lab = _labelled(spark, folder).select("event_id", "side", (F.col("later") - F.col("mid")).alias("label"))
    g = f.join(lab, "event_id").groupBy(F.coalesce("side", F.lit("NONE")).alias("hypothesis"), "fold").agg(F.count("*").alias("n"), F.avg("label").alias("mean"))
    pooled = g.groupBy("hypothesis").agg(F.lit(-1).alias("fold"), F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    g = g.unionByName(pooled.select(*g.columns)).select("hypothesis", "fold", "n", F.round("mean", 8).alias("statistic"))
    return g.withColumn("status", F.when(F.col("n") < 2, "UNAVAILABLE").otherwise("RUN"))


def prj1(spark, folder, horizons=SHOCK_HORIZONS):
    i = shocks.impacts(_after(spark, folder, horizons))
    return i.groupBy("shock_id").agg(*[F.round(F.max(F.when(F.col("horizon") == h, F.col("directional_impact"))), 8).alias(f"impact_h{h}") for h in horizons])


def tk3(spark, folder):
    """Of each shock's market the two most aggressive others, and whether they are too close to tell."""
    w = s.Window.partitionBy("instrument").orderBy(F.desc("aggression"), "shock_id")
    r = _shocks(spark, folder).withColumns({"nth": F.row_number().over(w), "next": F.lead("aggression").over(w)}).where("nth = 1")
    return r.select("instrument", "shock_id", F.coalesce(F.col("aggression") - F.col("next") < 0.05, F.lit(False)).alias("ambiguous"))


def tk5(spark, folder):
    """The last four shocks up to each: how one-sided they were and how long the latest run is."""
    w = s.Window.partitionBy("instrument").orderBy("first_index").rowsBetween(-3, 0)
    sign = F.when(F.col("direction") == "BUY", 1).otherwise(-1)
    return _shocks(spark, folder).select("shock_id", F.count("*").over(w).alias("n"), F.round(F.abs(F.sum(sign).over(w)) / F.count("*").over(w), 6).alias("persistence"))


def sr15(spark, folder):
    """Volume on each side in the ten events after a shock, kept apart by direction."""
    sh = _shocks(spark, folder)
    near = sh.select("shock_id", "instrument", "direction", F.explode(F.sequence(F.col("last_index") + 1, F.col("last_index") + 10)).alias("event_index"))
    j = near.join(states(spark, folder), ["instrument", "event_index"])
    return j.groupBy("shock_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("side") == F.col("direction"), F.col("qty"))), F.lit(0.0)), 6).alias("with_it"), F.round(F.coalesce(F.sum(F.when(F.col("side") != F.col("direction"), F.col("qty"))), F.lit(0.0)), 6).alias("against_it"))


QUERIES = {
    **{f"{name}_all_horizons": partial(query, horizons=ALL_SHOCK_HORIZONS) for name, query in (("sr7_fn21_impacts", sr7), ("prj1_wide", prj1))},
    **{f"{name}_all_horizons": partial(query, horizons=ALL_RECOVERY_HORIZONS) for name, query in (("sr8_resiliency", sr8), ("sr9_wn13_recovery", sr9), ("sr11_sr17_comparison", sr11), ("rs3_failed_aggression", rs3))},
    "rs4_labels_all_horizons": rs4_all, "rs4_labels_and_gaps": rs4_gaps,
    "pv1_shape": pv1, "pv2_price": pv2, "pv3_flags": pv3, "pv4_fingerprints": pv4, "pv5_sequences": pv5, "pv6_events": pv6, "pv7_dense_sequence": pv7, "pv8_process_time": pv8, "pv9_boundaries": pv9, "pv10_gate": pv10, "fn11_sessions": fn11, "fn12_timestamps": fn12, "ag10_inspection": ag10, "jn12_mapping": jn12,
    "jn8_reconcile": jn8, "sr1_observations": sr1, "sr2_sr4_aggression": sr2, "sr3_reach": sr3, "sr5_thresholds": sr5, "sr6_status": sr6, "sr7_fn21_impacts": sr7, "sr8_resiliency": sr8, "sr9_wn13_recovery": sr9, "jn9_nearest_prior": jn9, "sr10_pair_findings": sr10, "sr11_sr17_comparison": sr11, "jn10_flow_after": sr15, "rs3_failed_aggression": rs3, "jn10_range": jn10, "jn11_forward_asof": jn11,
    "fn13_quotes": fn13, "fn22_fn25_ratios": fn22_25, "fn26_fn28_measures": fn26, "ag9_quality": ag9, "ag13_median": ag13, "ag14_moments": ag14, "ag15_tails": ag15, "ag16_percentile": ag16, "ag17_pooled": ag17,
    "rs1_rs2_features": rs1_2, "rs4_labels": rs4, "rs5_manifest": rs5, "rs6_folds": rs6, "rs7_rs8_st4_purge": rs7_8, "rs9_blocks": rs9, "rs10_permutations": rs10, "rs10_every_order": rs10_exact, "rs11_alternatives": rs11_exact, "rs11_rs12_p_value": rs11_12, "rs13_wn12_corrections": rs13_wn12, "rs14_hypotheses": rs14, "prj1_wide": prj1, "tk3_margin": tk3, "tk5_last_shocks": tk5,
}

# SQL

_REC = _MBO + ", rec AS (SELECT record_id, recv_us, event_us, action, f[7] AS side, CASE WHEN price <> '' THEN CAST(CAST(price AS DOUBLE) AS DECIMAL(38,9)) END AS price, TRY_CAST(f[3] AS BIGINT) AS rtype, TRY_CAST(f[4] AS BIGINT) AS publisher_id, TRY_CAST(f[5] AS BIGINT) AS instrument_id, TRY_CAST(f[9] AS BIGINT) AS size, TRY_CAST(f[10] AS BIGINT) AS channel_id, f[11] AS order_id, TRY_CAST(f[12] AS BIGINT) AS flags, CAST(seq AS BIGINT) AS sequence, f[15] AS symbol FROM judged WHERE reason IS NULL)"
_PVK = "publisher_id, instrument_id, channel_id"
_SHAPE = "CASE WHEN rtype <> 160 THEN 'RECORD_TYPE' WHEN side NOT IN ('A', 'B', 'N') THEN 'SIDE' WHEN action IN ('A', 'C', 'M', 'T', 'F') AND coalesce(price, 0) <= 0 THEN 'PRICE' WHEN action IN ('A', 'C', 'M', 'T', 'F') AND coalesce(size, 0) <= 0 THEN 'SIZE' WHEN action = 'R' AND side <> 'N' THEN 'RESET_SIDE' WHEN event_us > recv_us THEN 'CLOCKS' WHEN flags & 4 <> 0 OR flags & 16 <> 0 OR flags & 64 <> 0 THEN 'UNSUPPORTED_FLAG' WHEN flags & 8 <> 0 AND flags & 32 = 0 THEN 'BAD_RECEIPT' END"
_FIND = f", sq AS (SELECT *, last_value(CASE WHEN flags & 32 = 0 OR flags & 128 <> 0 THEN sequence END IGNORE NULLS) OVER (PARTITION BY {_PVK} ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM rec), fd AS (SELECT *, CASE WHEN b IS NULL OR flags & 32 <> 0 THEN 'OK' WHEN sequence < b THEN 'REGRESSION' WHEN sequence > b + 1 THEN 'GAP' ELSE 'OK' END AS finding FROM sq)"
_EVENTS = f", gr AS (SELECT *, sum(CASE WHEN sequence = b THEN 0 ELSE 1 END) OVER (PARTITION BY {_PVK} ORDER BY record_id) AS g FROM (SELECT *, lag(sequence) OVER (PARTITION BY {_PVK} ORDER BY record_id) AS b FROM rec)), gg AS (SELECT *, bool_or(action = 'T') OVER (PARTITION BY {_PVK}, g) AS t, bool_or(action = 'F') OVER (PARTITION BY {_PVK}, g, order_id) AS f FROM gr), pe AS (SELECT *, CASE action WHEN 'A' THEN 'ADD' WHEN 'M' THEN 'MODIFY' WHEN 'R' THEN 'RESET' WHEN 'C' THEN CASE WHEN t AND f THEN 'EXECUTE' ELSE 'CANCEL' END WHEN 'T' THEN 'TRADE' END AS event FROM gg)"
_CLOCK = "strftime(to_timestamp(event_us / 1e6) AT TIME ZONE 'America/New_York', '%H:%M:%S.%f')"
_SESSION = f"CASE WHEN {_CLOCK} >= '04:00:00' AND {_CLOCK} < '09:30:00' THEN 'PREMARKET' WHEN {_CLOCK} >= '09:30:00' AND {_CLOCK} < '16:00:00' THEN 'REGULAR' WHEN {_CLOCK} >= '16:00:00' AND {_CLOCK} < '20:00:00' THEN 'AFTER_HOURS' ELSE 'CLOSED' END"
_RECON = """firsts AS (SELECT event_id, arg_min(struct_pack(i := instrument_id, v := venue, k := event_kind, a := book_action, t := trade_id, q := quantity, s := aggressor_side, n := sequence_number), receive_time) AS s FROM raw_market_events GROUP BY event_id),
flat AS (SELECT event_id, s.i AS instrument_id, s.v AS venue, s.k AS kind, s.a AS act, s.t AS trade_id, s.q AS quantity, s.s AS side, s.n AS n FROM firsts),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, venue, trade_id ORDER BY n DESC, event_id DESC) AS nth FROM flat WHERE kind = 'BOOK' AND act = 'EXECUTE') WHERE nth = 1 OR trade_id IS NULL),
tr AS (SELECT * FROM flat WHERE kind = 'TRADE'),
rc AS (SELECT coalesce(ex.instrument_id, tr.instrument_id) AS instrument_id, coalesce(ex.venue, tr.venue) AS venue, coalesce(ex.trade_id, tr.trade_id) AS trade_id, ex.event_id AS b, tr.event_id AS t, ex.quantity AS bq, tr.quantity AS tq, tr.side FROM ex FULL JOIN tr ON ex.instrument_id = tr.instrument_id AND ex.venue = tr.venue AND ex.trade_id = tr.trade_id),
recon AS (SELECT *, CASE WHEN trade_id IS NULL THEN 'UNRESOLVED' WHEN t IS NULL THEN 'BOOK_ONLY' WHEN b IS NULL THEN 'TRADE_ONLY' ELSE 'MATCHED' END AS status FROM rc)"""
SHOCKS = SEGMENTED + f""",
dep AS (SELECT *, CAST(200 + 10 * (event_id % 37) AS DOUBLE) AS depth FROM segmented),
e AS (SELECT *, lag(side) OVER w = side AND lag(segment) OVER w = segment AND event_index - lag(event_index) OVER w - 1 <= 4 AND at_us - lag(at_us) OVER w <= {GAP_US} AS same FROM dep WHERE side IS NOT NULL WINDOW w AS (PARTITION BY instrument ORDER BY event_index)),
isl AS (SELECT *, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY event_index) AS island FROM e),
sh0 AS (SELECT instrument, side AS direction, min(event_index) AS first_index, max(event_index) AS last_index, count(*) AS n_executions, sum(qty) AS volume, min(at_us) AS start_us, max(at_us) AS end_us, min(segment) AS segment FROM isl WHERE side <> 'UNKNOWN' GROUP BY instrument, island, side),
shocks AS (SELECT s.*, s.volume / b.depth AS aggression, b.depth AS depth0, b.mid AS mid0, b.at_us AS at0, s.instrument || ':' || s.first_index AS shock_id FROM sh0 s JOIN dep b ON b.instrument = s.instrument AND b.event_index = s.first_index - 1)"""


def _after_sql(horizons) -> str:
    return (
        SHOCKS + ", least AS (SELECT shock_id, min(depth) AS least FROM shocks s JOIN dep d ON d.instrument = s.instrument AND d.event_index BETWEEN s.first_index AND s.last_index GROUP BY shock_id), "
        f"aft AS (SELECT s.*, h AS horizon, d.mid AS mid1, d.depth AS depth1, d.at_us AS at1, l.least FROM shocks s JOIN least l USING (shock_id) CROSS JOIN (SELECT unnest([{', '.join(map(str, horizons))}]) AS h) LEFT JOIN dep d ON d.instrument = s.instrument AND d.event_index = s.last_index + h), "
        "im AS (SELECT *, mid1 - mid0 AS impact, CASE direction WHEN 'BUY' THEN mid1 - mid0 ELSE mid0 - mid1 END AS di, (depth1 - least(least, depth0)) / nullif(depth0 - least(least, depth0), 0) AS ratio, (at1 - end_us) / 1e6 AS seconds FROM aft)"
    )


_FAILED = "array_to_string(list_filter([CASE WHEN aggression IS NULL THEN 'NO_AGGRESSION' WHEN aggression < 0.5 THEN 'AGGRESSION' END, CASE WHEN volume < 100 THEN 'VOLUME' END], lambda x: x IS NOT NULL), ',')"
_PAIRS = f"pairs AS (SELECT * FROM (SELECT a.shock_id, b.shock_id AS prior_id, a.instrument, a.direction, a.first_index - b.last_index AS events_between, row_number() OVER (PARTITION BY a.shock_id ORDER BY b.last_index DESC, b.shock_id) AS nth FROM shocks a JOIN shocks b ON a.instrument = b.instrument AND a.segment = b.segment AND a.direction = b.direction AND b.last_index < a.first_index AND a.first_index - b.last_index <= 500 AND a.start_us - b.end_us <= {PAIR_S * 1_000_000} AND a.aggression / b.aggression BETWEEN 0.5 AND 2.0) WHERE nth = 1)"
_CMP_OF = lambda horizons: f"WITH {_after_sql(horizons)}, {_PAIRS}, ef AS (SELECT shock_id, horizon, di / (aggression + 1e-6) AS e, ratio AS r FROM im), cmp AS (SELECT p.shock_id, a.horizon, round(a.e - b.e, 8) AS d_effectiveness, round((a.e - b.e) / (abs(b.e) + 1e-6), 6) AS relative, CASE WHEN a.e - b.e < -1e-6 THEN 'WEAKENING' WHEN a.e - b.e > 1e-6 THEN 'STRENGTHENING' ELSE 'STABLE' END AS trend, round(a.r - b.r, 8) AS d_ratio, round(a.r / (abs(a.e) + 1e-6) - b.r / (abs(b.e) + 1e-6), 3) AS d_absorption FROM pairs p JOIN ef a ON a.shock_id = p.shock_id JOIN ef b ON b.shock_id = p.prior_id AND b.horizon = a.horizon WHERE a.e IS NOT NULL AND b.e IS NOT NULL)"
_CMP, _CMP_ALL = _CMP_OF(RECOVERY_HORIZONS), _CMP_OF(ALL_RECOVERY_HORIZONS)
_LAB = STATES + f", lab AS (SELECT *, lead(mid, {LABEL}) OVER w AS later, CASE WHEN lead(mid, {LABEL}) OVER w IS NOT NULL THEN max(mid) OVER (PARTITION BY instrument ORDER BY event_index ROWS BETWEEN CURRENT ROW AND {LABEL} FOLLOWING) END AS highest FROM states WINDOW w AS (PARTITION BY instrument ORDER BY event_index))"
_FOLD = _LAB + f", rk AS (SELECT *, event_index + {LABEL} AS label_end, row_number() OVER (ORDER BY at_us, instrument, event_index, event_id) - 1 AS r FROM lab WHERE later IS NOT NULL), nf AS (SELECT unnest(range(0, greatest(0, CAST(ceil((count(*) - {TRAIN}) / {TEST}) AS BIGINT)))) AS fold FROM rk), fo AS (SELECT fold, CASE WHEN r < {TRAIN} + fold * {TEST} THEN 'TRAIN' ELSE 'TEST' END AS role, rk.* FROM nf JOIN rk ON r < {TRAIN} + (fold + 1) * {TEST})"
_PURGE = _FOLD + ", em AS (SELECT *, event_index - max(CASE role WHEN 'TRAIN' THEN event_index END) OVER (PARTITION BY fold, instrument) AS gap FROM fo), kp AS (SELECT *, CASE WHEN role = 'TEST' AND gap > 0 AND gap <= 5 THEN 'EMBARGOED' ELSE role END AS kept FROM em), pg AS (SELECT *, CASE WHEN kept = 'TRAIN' AND label_end >= min(CASE kept WHEN 'TEST' THEN event_index END) OVER (PARTITION BY fold, instrument) THEN 'PURGED' ELSE kept END AS final FROM kp)"
#: All 120 orders of five blocks, each label put at its block's new start plus its place.
_NULL = f"WITH {_LAB}, lb AS (SELECT side, later - mid AS label, row_number() OVER (ORDER BY at_us, instrument, event_id) - 1 AS r, greatest(1, (count(*) OVER () + {FEW - 1}) // {FEW}) AS size, count(*) OVER () AS n FROM lab WHERE later IS NOT NULL), bk AS (SELECT *, r // size AS b, r % size AS place FROM lb), bs AS (SELECT b, count(*) AS w FROM bk GROUP BY b), " + (
    "od AS (SELECT row_number() OVER (ORDER BY a.b, c.b, d.b, e.b) AS p, [a.b, c.b, d.b, e.b, f.b] AS o FROM bs a JOIN bs c ON c.b <> a.b JOIN bs d ON d.b NOT IN (a.b, c.b) JOIN bs e ON e.b NOT IN (a.b, c.b, d.b) JOIN bs f ON f.b NOT IN (a.b, c.b, d.b, e.b)), "
    "ps AS (SELECT p, unnest(o) AS b, generate_subscripts(o, 1) AS k FROM od), st AS (SELECT p, ps.b, coalesce(sum(w) OVER (PARTITION BY p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ps JOIN bs USING (b)), "
    "nul AS (SELECT p, avg(x.label) AS statistic FROM bk x JOIN st ON st.b = x.b JOIN bk y ON y.r = start + x.place WHERE y.side = 'BUY' GROUP BY p), ob AS (SELECT avg(label) AS obs FROM bk WHERE side = 'BUY')"
)
_R = "r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS x, l_tax * 10 AS y, l_quantity AS q FROM lineitem)"
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_MEDIAN = "SELECT instrument_id, price, row_number() OVER (PARTITION BY instrument_id ORDER BY price) AS r, count(*) OVER (PARTITION BY instrument_id) AS n FROM raw_market_events WHERE event_kind = 'TRADE' AND price IS NOT NULL"

ORACLE = {
    "pv1_shape": _REC + f" SELECT {_SHAPE} AS finding, count(*) AS n FROM rec GROUP BY ALL",
    "pv2_price": _REC + " SELECT record_id, CAST(price AS DECIMAL(20,6)) AS price FROM rec",
    "pv3_flags": _REC + " SELECT publisher_id, " + ", ".join(f"count(*) FILTER (flags & {v} <> 0) AS {k}" for k, v in provider.FLAGS.items()) + " FROM rec GROUP BY publisher_id",
    "pv4_fingerprints": _REC + " SELECT min(record_id) AS first_record, count(*) AS n FROM rec GROUP BY recv_us, event_us, publisher_id, instrument_id, action, side, price, size, order_id, sequence HAVING count(*) > 1",
    "pv5_sequences": _REC + _FIND + " SELECT publisher_id, finding, count(*) AS n FROM fd GROUP BY ALL",
    "pv6_events": _REC + _EVENTS + " SELECT record_id, event, CASE WHEN action = 'T' THEN CASE side WHEN 'A' THEN 'SELL' WHEN 'B' THEN 'BUY' ELSE 'UNKNOWN' END END AS aggressor FROM pe WHERE event IS NOT NULL",
    "pv7_dense_sequence": _REC + _EVENTS + f" SELECT record_id, row_number() OVER (PARTITION BY {_PVK} ORDER BY g, CASE event WHEN 'TRADE' THEN 1 ELSE 0 END, record_id) - 1 AS event_sequence FROM pe WHERE event IS NOT NULL",
    "pv8_process_time": _REC + " SELECT record_id, recv_us AS at_receipt, CASE WHEN event_us + 500 >= recv_us THEN event_us + 500 END AS offset_us FROM rec",
    "pv9_boundaries": _REC + f", se AS (SELECT *, {_SESSION} AS session FROM rec), bo AS (SELECT *, lag(session) OVER (PARTITION BY {_PVK} ORDER BY record_id) AS b FROM se) SELECT CASE WHEN action = 'R' THEN 'RESET' WHEN b <> session THEN 'SESSION' ELSE 'NONE' END AS boundary, session, count(*) AS n FROM bo GROUP BY ALL",
    "pv10_gate": _REC + _FIND + f", x AS (SELECT *, {_SHAPE} AS shape FROM fd) SELECT count(shape) AS n_shape, count(*) FILTER (finding = 'REGRESSION') AS n_regressions, count(*) FILTER (finding = 'GAP') AS n_gaps, count(shape) + count(*) FILTER (finding <> 'OK') = 0 AS passes FROM x",
    "fn11_sessions": _REC + f" SELECT record_id, {_SESSION} AS session FROM rec",
    "fn12_timestamps": _REC + " SELECT record_id, recv_us FROM rec",
    "ag10_inspection": _REC + " SELECT file_name, count(*) AS n, min(event_us) AS first_us, max(event_us) AS last_us, min(sequence) AS low, max(sequence) AS high, list_sort(list(DISTINCT publisher_id)) AS publishers, list_sort(list(DISTINCT action)) AS actions FROM rec JOIN databento_mbo_fixture USING (record_id) GROUP BY file_name",
    "jn12_mapping": _REC + ", x AS (SELECT DISTINCT publisher_id, symbol FROM rec) SELECT publisher_id, symbol, CASE WHEN instrument_id IS NULL THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS status, instrument_id FROM x LEFT JOIN instruments ON ticker = symbol",
    "jn8_reconcile": f"WITH {_RECON} SELECT venue, status, count(*) AS n FROM recon GROUP BY ALL",
    "sr1_observations": f"WITH {_RECON}, o AS (SELECT instrument_id, CASE status WHEN 'BOOK_ONLY' THEN 'UNKNOWN' ELSE coalesce(side, 'UNKNOWN') END AS aggressor, CASE status WHEN 'BOOK_ONLY' THEN bq WHEN 'UNRESOLVED' THEN NULL ELSE tq END AS volume FROM recon) SELECT instrument_id, aggressor, count(*) AS n, CAST(sum(volume) AS DECIMAL(28,6)) AS volume FROM o WHERE volume IS NOT NULL GROUP BY ALL",
    "sr2_sr4_aggression": f"WITH {SHOCKS} SELECT shock_id, round(aggression, 8) AS aggression, round(volume / n_executions, 6) AS average_size, round(volume / nullif((end_us - start_us) / 1e6, 0), 8) AS rate FROM shocks",
    "sr3_reach": f"WITH {SHOCKS} SELECT shock_id, count(DISTINCT d.mid) AS touched, round(max(d.mid) - min(d.mid), 6) AS reach FROM shocks s JOIN dep d ON d.instrument = s.instrument AND d.event_index BETWEEN s.first_index AND s.last_index WHERE d.side IN ('BUY', 'SELL') GROUP BY shock_id",
    "sr5_thresholds": f"WITH {SHOCKS} SELECT shock_id, {_FAILED} AS failed FROM shocks",
    "sr6_status": f"WITH {SHOCKS} SELECT direction, CASE WHEN {_FAILED} = '' THEN 'SHOCK_CANDIDATE' ELSE 'BELOW_THRESHOLDS' END AS status, count(*) AS n FROM shocks GROUP BY ALL",
    "sr7_fn21_impacts": f"WITH {_after_sql(SHOCK_HORIZONS)} SELECT shock_id, horizon, mid1 IS NOT NULL AS available, round(impact, 8) AS impact, round(di, 8) AS directional_impact, round(abs(impact) / nullif(volume, 0), 8) AS volume_impact, round(abs(impact) / nullif(aggression, 0), 8) AS aggression_impact FROM im",
    "sr8_resiliency": f"WITH {_after_sql(RECOVERY_HORIZONS)} SELECT shock_id, horizon, round(ratio, 8) AS ratio FROM im",
    "sr9_wn13_recovery": f"WITH {_after_sql(RECOVERY_HORIZONS)}, th AS (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS threshold) SELECT shock_id, threshold, min(horizon) FILTER (ratio >= threshold) AS events, round(arg_min(seconds, horizon) FILTER (ratio >= threshold), 6) AS seconds FROM im CROSS JOIN th GROUP BY shock_id, threshold",
    "jn9_nearest_prior": f"WITH {SHOCKS}, {_PAIRS} SELECT shock_id, prior_id, instrument, direction, events_between FROM pairs",
    "sr10_pair_findings": f"WITH {SHOCKS}, l AS (SELECT *, lag(shock_id) OVER w AS prior_id, lag(direction) OVER w AS d0, lag(segment) OVER w AS s0, lag(last_index) OVER w AS l0, lag(end_us) OVER w AS e0, lag(aggression) OVER w AS a0 FROM shocks WINDOW w AS (PARTITION BY instrument ORDER BY first_index)) SELECT shock_id, prior_id, array_to_string(list_filter([CASE WHEN d0 <> direction THEN 'DIRECTION' END, CASE WHEN s0 <> segment THEN 'STRUCTURAL_BREAK' END, CASE WHEN first_index - l0 > 500 THEN 'EVENT_DISTANCE' END, CASE WHEN start_us - e0 > 60000000 THEN 'TIME_DISTANCE' END, CASE WHEN NOT aggression / a0 BETWEEN 0.5 AND 2.0 THEN 'AGGRESSION_RATIO' END], lambda x: x IS NOT NULL), ',') AS reasons FROM l WHERE prior_id IS NOT NULL",
    "sr11_sr17_comparison": _CMP + " SELECT * FROM cmp",
    "jn10_flow_after": f"WITH {SHOCKS} SELECT shock_id, round(coalesce(sum(d.qty) FILTER (d.side = s.direction), 0), 6) AS with_it, round(coalesce(sum(d.qty) FILTER (d.side <> s.direction), 0), 6) AS against_it FROM shocks s JOIN dep d ON d.instrument = s.instrument AND d.event_index BETWEEN s.last_index + 1 AND s.last_index + 10 GROUP BY shock_id",
    "rs3_failed_aggression": _CMP + " SELECT shock_id, horizon FROM cmp WHERE d_effectiveness < 0 AND d_ratio > 0",
    "jn10_range": f"WITH {SHOCKS} SELECT shock_id, count(*) AS n_events, count(d.side) AS n_trades FROM shocks s JOIN dep d ON d.instrument = s.instrument AND d.event_index BETWEEN s.last_index + 1 AND s.last_index + 5 GROUP BY shock_id",
    "jn11_forward_asof": f"WITH {SHOCKS} SELECT s.shock_id, d.at_us AS anchor_us, d.event_index FROM (SELECT shock_id, instrument, end_us + 1000000 AS ready FROM shocks) s ASOF LEFT JOIN dep d ON s.instrument = d.instrument AND s.ready <= d.at_us",
    "fn13_quotes": "WITH q AS (SELECT event_id, receive_time, best_bid_price::DOUBLE AS b, best_bid_size::DOUBLE AS bs, best_ask_price::DOUBLE AS a, best_ask_size::DOUBLE AS az FROM raw_market_events WHERE event_kind = 'QUOTE') SELECT event_id, receive_time, round(a - b, 6) AS spread, round((b + a) / 2, 6) AS mid, round((a * bs + b * az) / nullif(bs + az, 0), 6) AS microprice FROM q",
    "fn22_fn25_ratios": f"WITH {_R} SELECT {_K}, round((q * y - q * x / 2) / nullif(q - q * x / 2, 0), 8) AS replenishment, round((x - y) / (q + 1e-6), 8) AS effect, round((y - x) / (abs(x) + 1e-6), 4) AS relative, CASE WHEN y - x < -1e-6 THEN 'WEAKENING' WHEN y - x > 1e-6 THEN 'STRENGTHENING' ELSE 'STABLE' END AS trend, round(x / (abs(y) + 1e-6), 3) AS absorption FROM r",
    "fn26_fn28_measures": f"WITH {_R}, c AS (SELECT *, greatest(y - 0.4::DOUBLE, 0) AS up, abs(x - 0.5::DOUBLE) + greatest(y - 0.4::DOUBLE, 0) AS wh, greatest(x * 3 - 1, 0) AS ex, greatest(q - 1, 0) AS eq FROM r) SELECT {_K}, round(abs(y) / CASE WHEN x = 0 THEN 1e-6::DOUBLE ELSE abs(x) END / 1e6::DOUBLE, 6) AS magnitude_ratio, round(up / CASE WHEN wh = 0 THEN 1e-6::DOUBLE ELSE wh END, 6) AS component, round(1 - least(greatest(x * 2, 0), 1), 6) AS failure, round(1 - x, 6) AS raw_failure, round(q - x, 6) AS provision, round(coalesce((q - x) / nullif(q + x, 0), 0), 6) AS normalized, round(coalesce(x / nullif(q + x, 0), 0), 6) AS pressure, "
    "round(y / CASE WHEN x = 0 THEN 1e-6::DOUBLE ELSE x END / 1e6::DOUBLE, 6) AS spread_ratio, round(y / (1 + y), 6) AS bounded, round(ex / (1 + ex), 6) AS excess, round(x * y, 6) AS interaction, round(x * (1 - y), 6) AS interaction_rest, round(1 - exp(-q / 30), 6) AS lifetime, round(1 - exp(-x / 2), 6) AS cycles, round(exp(-q / 5), 6) AS speed, "
    "round(x / (1 + x) * 0.2::DOUBLE + y / (1 + y) * 0.15::DOUBLE + (1 - least(greatest(x, 0), 1)) * 0.15::DOUBLE + eq / (1 + eq) * 0.15::DOUBLE + x / (1 + x) * 0.1::DOUBLE + y / (1 + y) * 0.1::DOUBLE + coalesce(x / nullif(x + y, 0), 0) * 0.15::DOUBLE, 6) AS composite FROM c",
    "ag9_quality": f"WITH {STATES} SELECT round(avg(CASE WHEN side IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(CASE side WHEN 'UNKNOWN' THEN 1.0::DOUBLE WHEN 'BUY' THEN 0 WHEN 'SELL' THEN 0 END), 6) AS unknown_share, count(DISTINCT instrument) AS n_markets FROM states",
    "ag13_median": f"WITH k AS ({_MEDIAN}) SELECT instrument_id, CAST((min(price)::DECIMAL(30,8) + max(price)::DECIMAL(30,8)) * 0.5 AS DECIMAL(20,7)) AS median FROM k WHERE r = (n + 1) // 2 OR r = n // 2 + 1 GROUP BY instrument_id",
    "ag14_moments": "SELECT l_returnflag, round(covar_pop(l_quantity, l_discount), 6) AS covariance, round(stddev_pop(l_quantity), 6) AS deviation, round(avg(l_quantity), 6) AS mean, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(avg(CASE WHEN l_tax > 0.04 THEN l_quantity END), 6) AS conditional FROM lineitem GROUP BY l_returnflag",
    "ag15_tails": "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT round(avg(CASE WHEN r >= n - greatest(1, floor(n * 0.2)) THEN o_custkey END) - avg(CASE WHEN r < greatest(1, floor(n * 0.2)) THEN o_custkey END), 6) AS difference FROM r",
    "ag16_percentile": f"WITH k AS ({_MEDIAN}) SELECT instrument_id, price AS percentile FROM k WHERE r = greatest(1, (n * 9 + 9) // 10)",
    "ag17_pooled": "WITH g AS (SELECT year(o_orderdate) AS fold, o_orderstatus, avg(o_totalprice) AS stat, count(*) AS w FROM orders GROUP BY ALL) SELECT o_orderstatus, round(sum(stat * w) / sum(w), 4) AS pooled FROM g GROUP BY o_orderstatus",
    "rs1_rs2_features": f"WITH {STATES}, st AS (SELECT *, (mid - lag(mid) OVER w) / lag(mid) OVER w AS step, CASE side WHEN 'BUY' THEN qty WHEN 'SELL' THEN -qty ELSE 0 END AS sg FROM states WINDOW w AS (PARTITION BY instrument ORDER BY event_index)) SELECT instrument, event_index, round((mid - lag(mid, 10) OVER w) / lag(mid, 10) OVER w, 8) AS back_return, CASE WHEN lag(mid, 10) OVER w IS NOT NULL THEN round(sqrt(avg(step * step) OVER (PARTITION BY instrument ORDER BY event_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), 8) END AS volatility, round(coalesce(abs(sum(sg) OVER v) / nullif(sum(abs(sg)) OVER v, 0), 0), 6) AS persistence FROM st WINDOW w AS (PARTITION BY instrument ORDER BY event_index), v AS (PARTITION BY instrument ORDER BY event_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "rs4_labels": f"WITH {_LAB} SELECT event_id, round(CASE side WHEN 'BUY' THEN -1 ELSE 1 END * (later - mid) / mid, 8) + 0.0::DOUBLE AS reversal, CASE side WHEN 'BUY' THEN -1 ELSE 1 END * (later - mid) / mid > 0 AS success, round((highest - mid) / mid, 8) AS favourable, CASE WHEN later IS NULL THEN 'MISSING_FUTURE_EVENT' END AS unavailable FROM lab WHERE side IN ('BUY', 'SELL')",
    "rs5_manifest": f"WITH {_LAB} SELECT count(*) AS n, count(later) AS n_labelled, count(DISTINCT instrument) AS n_markets, min(at_us) AS first_us, max(at_us) AS last_us FROM lab",
    "rs6_folds": f"WITH {_FOLD} SELECT fold, role, event_id FROM fo",
    "rs7_rs8_st4_purge": f"WITH {_PURGE} SELECT fold, final AS role, count(*) AS n, sum(event_id) AS checksum FROM pg GROUP BY fold, final",
    "rs9_blocks": f"WITH {_LAB} SELECT event_id, event_index // 25 AS block FROM lab WHERE later IS NOT NULL",
    "rs13_wn12_corrections": "WITH r AS (SELECT c_custkey, c_nationkey, abs(c_acctbal) / 20000 AS p, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) / 20000, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer) SELECT c_custkey, round(least(1, p * m), 7) AS bonferroni, round(least(1, min(p * m / k) OVER (PARTITION BY c_nationkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 7) AS bh FROM r",
    "rs14_hypotheses": f"WITH {_PURGE}, h AS (SELECT coalesce(side, 'NONE') AS hypothesis, fold, later - mid AS label FROM pg WHERE final = 'TEST') SELECT hypothesis, coalesce(fold, -1)::INT AS fold, count(*) AS n, round(avg(label), 8) AS statistic, CASE WHEN count(*) < 2 THEN 'UNAVAILABLE' ELSE 'RUN' END AS status FROM h GROUP BY GROUPING SETS ((hypothesis, fold), (hypothesis))",
    "rs10_every_order": _NULL + " SELECT round(statistic, 9) AS statistic, count(*) AS n FROM nul GROUP BY ALL",
    "rs11_alternatives": _NULL + ", q AS (SELECT statistic, row_number() OVER (ORDER BY statistic) AS r FROM nul), s AS (SELECT avg(statistic) AS m, stddev_pop(statistic) AS sd, count(*) AS k FROM nul), a AS (SELECT unnest(['GREATER', 'LESS', 'TWO_SIDED']) AS alternative) "
    "SELECT alternative, k AS n_permutations, round((SELECT count(*) FILTER (CASE alternative WHEN 'GREATER' THEN statistic >= obs - 1e-12 WHEN 'LESS' THEN statistic <= obs + 1e-12 ELSE abs(statistic - m) >= abs(obs - m) - 1e-12 END) FROM nul) / k, 9) AS p_value, round(m, 9) AS null_mean, round(sd, 9) AS null_sd, round(obs - m, 9) AS effect, "
    "(SELECT round(statistic, 9) FROM q WHERE r = (k + 19) // 20) AS p5, (SELECT round(statistic, 9) FROM q WHERE r = (k + 1) // 2) AS p50, (SELECT round(statistic, 9) FROM q WHERE r = (k * 19 + 19) // 20) AS p95 FROM a, s, ob",
    "prj1_wide": f"WITH {_after_sql(SHOCK_HORIZONS)} SELECT shock_id, " + ", ".join(f"round(max(di) FILTER (horizon = {h}), 8) AS impact_h{h}" for h in SHOCK_HORIZONS) + " FROM im GROUP BY shock_id",
    "tk3_margin": f"WITH {SHOCKS}, r AS (SELECT *, row_number() OVER w AS nth, lead(aggression) OVER w AS nxt FROM shocks WINDOW w AS (PARTITION BY instrument ORDER BY aggression DESC, shock_id)) SELECT instrument, shock_id, coalesce(aggression - nxt < 0.05, false) AS ambiguous FROM r WHERE nth = 1",
    "tk5_last_shocks": f"WITH {SHOCKS} SELECT shock_id, count(*) OVER w AS n, round(abs(sum(CASE direction WHEN 'BUY' THEN 1 ELSE -1 END) OVER w) / count(*) OVER w, 6) AS persistence FROM shocks WINDOW w AS (PARTITION BY instrument ORDER BY first_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
}
ORACLE |= {
    f"{name}_all_horizons": ORACLE[name].replace(_after_sql(of), _after_sql(every))
    for name, of, every in (("sr7_fn21_impacts", SHOCK_HORIZONS, ALL_SHOCK_HORIZONS), ("sr8_resiliency", RECOVERY_HORIZONS, ALL_RECOVERY_HORIZONS), ("sr9_wn13_recovery", RECOVERY_HORIZONS, ALL_RECOVERY_HORIZONS))
}
ORACLE |= {
    "sr11_sr17_comparison_all_horizons": _CMP_ALL + " SELECT * FROM cmp",
    "rs3_failed_aggression_all_horizons": _CMP_ALL + " SELECT shock_id, horizon FROM cmp WHERE d_effectiveness < 0 AND d_ratio > 0",
    "prj1_wide_all_horizons": f"WITH {_after_sql(ALL_SHOCK_HORIZONS)} SELECT shock_id, " + ", ".join(f"round(max(di) FILTER (horizon = {h}), 8) AS impact_h{h}" for h in ALL_SHOCK_HORIZONS) + " FROM im GROUP BY shock_id",
    "rs4_labels_all_horizons": f"WITH {SEGMENTED}, hz AS (SELECT unnest([{', '.join(map(str, ALL_LABELS))}]) AS horizon), ends AS (SELECT a.*, horizon, b.mid AS later, b.segment AS s1 FROM segmented a CROSS JOIN hz LEFT JOIN segmented b ON b.instrument = a.instrument AND b.event_index = a.event_index + horizon WHERE a.side IN ('BUY', 'SELL')), "
    "path AS (SELECT e.event_id, e.horizon, max(x.mid) AS highest FROM ends e JOIN segmented x ON x.instrument = e.instrument AND x.event_index BETWEEN e.event_index AND e.event_index + e.horizon GROUP BY ALL), "
    "why AS (SELECT *, CASE WHEN later IS NULL THEN 'MISSING_FUTURE_EVENT' END AS reason FROM ends JOIN path USING (event_id, horizon)), rv AS (SELECT *, CASE WHEN reason IS NULL THEN CASE side WHEN 'BUY' THEN -1 ELSE 1 END * (later - mid) / mid END AS r FROM why) "
    "SELECT event_id, horizon, round(r, 8) + 0.0::DOUBLE AS reversal, r > 0 AS success, CASE WHEN reason IS NULL THEN round((highest - mid) / mid, 8) END AS favourable, reason AS unavailable FROM rv",
    "rs4_labels_and_gaps": f"WITH {SEGMENTED}, hz AS (SELECT unnest([{', '.join(map(str, ALL_LABELS))}]) AS horizon), ends AS (SELECT a.*, horizon, b.mid AS later, b.segment AS s1 FROM segmented a CROSS JOIN hz LEFT JOIN segmented b ON b.instrument = a.instrument AND b.event_index = a.event_index + horizon WHERE a.side IN ('BUY', 'SELL')), "
    "path AS (SELECT e.event_id, e.horizon, max(x.mid) AS highest FROM ends e JOIN segmented x ON x.instrument = e.instrument AND x.event_index BETWEEN e.event_index AND e.event_index + e.horizon GROUP BY ALL), "
    "why AS (SELECT *, CASE WHEN later IS NULL THEN 'MISSING_FUTURE_EVENT' WHEN s1 <> segment THEN 'STRUCTURAL_GAP' END AS reason FROM ends JOIN path USING (event_id, horizon)), rv AS (SELECT *, CASE WHEN reason IS NULL THEN CASE side WHEN 'BUY' THEN -1 ELSE 1 END * (later - mid) / mid END AS r FROM why) "
    "SELECT event_id, horizon, round(r, 8) + 0.0::DOUBLE AS reversal, r > 0 AS success, CASE WHEN reason IS NULL THEN round((highest - mid) / mid, 8) END AS favourable, reason AS unavailable FROM rv",
}
