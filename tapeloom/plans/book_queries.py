"""Queries of the order book, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import attacks as at
from tapeloom.operators import book as b
from tapeloom.operators import liquidity as lq
from tapeloom.plans.frames import book_events, book_sql
from tapeloom.session import cut_lineage


def plain(df: DataFrame) -> DataFrame:
    """Exact numbers as doubles, as the SQL has them."""
    return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")})


def _trans(spark, folder, broken=False):
    return b.transitions(book_events(spark, folder, broken))


def _levels(spark, folder):
    return b.final_levels(b.depth_changes(_trans(spark, folder)))


def ob1(spark, folder):
    return plain(_trans(spark, folder).select("stream", "sequence", "action", "pre_price", "post_price", "pre_qty", "post_qty"))


def ob2_depth(spark, folder):
    return plain(b.depth_changes(_trans(spark, folder)).drop("epoch"))


def ob2_snapshots(spark, folder):
    """The touch after every event, by replay; its SQL has it from the levels' depth by windows."""
    s = b.snapshots(book_events(spark, folder), 1)
    return plain(s.groupBy("stream").agg(F.count("*").alias("n_events"), F.count("error").alias("n_errors"), F.max("sequence").alias("last"), F.max_by(F.get("bids", 0)["price"], "sequence").alias("bid"), F.max_by(F.get("bids", 0)["qty"], "sequence").alias("bid_qty"), F.max_by(F.get("asks", 0)["price"], "sequence").alias("ask"), F.max_by(F.get("asks", 0)["orders"], "sequence").alias("ask_orders")))


def ob3(spark, folder):
    return plain(b.first_errors(_trans(spark, folder, True)))


def ob4(spark, folder):
    f = b.book_features(_levels(spark, folder))
    return plain(f.select("stream", "bid", "ask", *[F.round(c, 8).alias(c) for c in ("spread", "mid", "microprice")]))


def ob5(spark, folder):
    return plain(_trans(spark, folder, True).select("stream", "epoch", "sequence", "life", "added", "executed", "withdrawn"))


def ob6(spark, folder):
    events = book_events(spark, folder, True)
    t = b.transitions(events)
    resets = events.where("action = 'RESET'").select("stream", (F.row_number().over(b.Window.partitionBy("stream").orderBy("sequence")) - 1).alias("epoch"))
    return plain(b.lifecycles(t, resets).groupBy("stream", "reason").agg(F.count("*").alias("n")))


def ob7(spark, folder):
    return plain(b.lifecycles(_trans(spark, folder)).groupBy("stream").agg(F.count("*").alias("n"), F.count(F.when(F.col("balanced"), 1)).alias("n_balanced"), F.round(F.avg("executed_share"), 8).alias("executed_share"), F.round(F.avg("withdrawn_share"), 8).alias("withdrawn_share"), F.round(F.avg("lifetime_s"), 6).alias("lifetime_s")))


def ag7(spark, folder):
    return plain(_levels(spark, folder))


def ag11(spark, folder):
    return plain(b.lifecycles(_trans(spark, folder)).select("stream", "order_id", "added", "executed", "withdrawn", "largest", "remaining", "modifies", "executions", "price_changes"))


def tk2(spark, folder):
    return plain(b.top_levels(_levels(spark, folder), 5))


def fn14_15(spark, folder):
    f = b.book_features(_levels(spark, folder))
    return plain(f.select("stream", *[F.round(c, 8).alias(c) for c in ("imbalance", "weighted_bid", "weighted_ask")]))


def ag12(spark, folder):
    """Quantity-weighted credibility of each side: what was executed of what was shown, and the depth that is worth."""
    life = b.lifecycles(_trans(spark, folder)).withColumn("score", F.coalesce("executed_share", F.lit(0.0)))
    return plain(life.groupBy("stream", "side").agg(F.round(F.try_divide(F.sum(F.col("largest").cast("double") * F.col("score")), F.sum(F.col("largest").cast("double"))), 8).alias("credibility"), F.round(F.sum(F.col("remaining").cast("double") * (1 - F.col("withdrawn_share"))), 6).alias("credible_depth"), F.round(F.try_divide(F.sum("withdrawn").cast("double"), F.sum("added").cast("double")), 8).alias("withdrawn_fraction")))


QUERIES = {"ob1_transitions": ob1, "ob2_depth": ob2_depth, "ob2_snapshots": ob2_snapshots, "ob3_errors": ob3, "ob4_touch": ob4, "ob5_lifecycle_steps": ob5, "ob6_terminal_reasons": ob6, "ob7_accounting": ob7, "ag7_levels": ag7, "ag11_lifecycle_totals": ag11, "tk2_top_levels": tk2, "fn14_fn15_depth": fn14_15, "ag12_side_credibility": ag12}

_B, _X = f"WITH RECURSIVE {book_sql()}", f"WITH RECURSIVE {book_sql(True)}"
_LIFE = ", life AS (SELECT stream, epoch, order_id, life, any_value(side) AS side, sum(added) AS added, sum(executed) AS executed, sum(withdrawn) AS withdrawn, max(post_qty) AS largest, arg_max(post_qty, sequence) AS remaining, arg_max(action, sequence) AS last_action, count(*) FILTER (action = 'MODIFY') AS modifies, count(*) FILTER (action = 'EXECUTE') AS executions, count(*) FILTER (action = 'MODIFY' AND pre_price <> post_price) AS price_changes, (max(at_us) - min(at_us)) / 1e6 AS lifetime_s FROM trans WHERE error IS NULL GROUP BY stream, epoch, order_id, life)"
_TOUCH = ", touch AS (SELECT stream, max(price) FILTER (side = 'BID' AND level = 1) AS bid, max(depth) FILTER (side = 'BID' AND level = 1) AS bid_size, max(price) FILTER (side = 'ASK' AND level = 1) AS ask, max(depth) FILTER (side = 'ASK' AND level = 1) AS ask_size, max(orders) FILTER (side = 'ASK' AND level = 1) AS ask_orders FROM top GROUP BY stream)"
_W = "CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 WHEN 4 THEN 0.125 WHEN 5 THEN 0.0625 END"

ORACLE = {
    "ob1_transitions": _B + " SELECT stream, sequence, action, pre_price, post_price, pre_qty, post_qty FROM trans",
    "ob2_depth": _B + " SELECT stream, side, price, sequence, depth, orders FROM depths",
    "ob2_snapshots": _B + _TOUCH + ", n AS (SELECT stream, count(*) AS n_events, max(sequence) AS last FROM book GROUP BY stream) SELECT stream, n_events, 0 AS n_errors, last, bid, bid_size AS bid_qty, ask, ask_orders FROM n LEFT JOIN touch USING (stream)",
    "ob3_errors": _X + " SELECT stream, arg_min(error, sequence) AS error, min(sequence) AS sequence, count(*) AS n_errors FROM trans WHERE error IS NOT NULL GROUP BY stream",
    "ob4_touch": _B + _TOUCH + " SELECT stream, bid, ask, round(ask - bid, 8) AS spread, round((bid + ask) / 2, 8) AS mid, round((ask * bid_size + bid * ask_size) / nullif(bid_size + ask_size, 0), 8) AS microprice FROM touch",
    "ob5_lifecycle_steps": _X + " SELECT stream, epoch, sequence, life, added, executed, withdrawn FROM trans",
    "ob6_terminal_reasons": _X + _LIFE + ", r AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY sequence) - 1 AS epoch FROM book WHERE action = 'RESET') SELECT stream, CASE WHEN remaining <= 0 THEN CASE last_action WHEN 'EXECUTE' THEN 'EXECUTED' WHEN 'DELETE' THEN 'DELETED' ELSE 'CANCELLED' END WHEN r.epoch IS NOT NULL THEN 'RESET' ELSE 'OBSERVATION_END' END AS reason, count(*) AS n FROM life LEFT JOIN r USING (stream, epoch) GROUP BY ALL",
    "ob7_accounting": _B + _LIFE + " SELECT stream, count(*) AS n, count(*) FILTER (abs(added - executed - withdrawn - remaining) < 1e-9) AS n_balanced, round(avg(executed / added), 8) AS executed_share, round(avg(withdrawn / added), 8) AS withdrawn_share, round(avg(lifetime_s), 6) AS lifetime_s FROM life GROUP BY stream",
    "ag7_levels": _B + " SELECT stream, side, price, depth, orders FROM levels",
    "ag11_lifecycle_totals": _B + _LIFE + " SELECT stream, order_id, added, executed, withdrawn, largest, remaining, modifies, executions, price_changes FROM life",
    "tk2_top_levels": _B + " SELECT * FROM top WHERE level <= 5",
    "fn14_fn15_depth": _B + f", f AS (SELECT stream, coalesce(sum(depth) FILTER (side = 'BID' AND level <= 5), 0) AS b, coalesce(sum(depth) FILTER (side = 'ASK' AND level <= 5), 0) AS a, coalesce(sum(depth * {_W}) FILTER (side = 'BID' AND level <= 5), 0) AS wb, coalesce(sum(depth * {_W}) FILTER (side = 'ASK' AND level <= 5), 0) AS wa FROM top GROUP BY stream) SELECT stream, round(coalesce((b - a) / nullif(b + a, 0), 0), 8) AS imbalance, round(wb, 8) AS weighted_bid, round(wa, 8) AS weighted_ask FROM f",
    "ag12_side_credibility": _B + _LIFE + " SELECT stream, side, round(sum(largest * executed / added) / sum(largest), 8) AS credibility, round(sum(remaining * (1 - withdrawn / added)), 6) AS credible_depth, round(sum(withdrawn) / sum(added), 8) AS withdrawn_fraction FROM life GROUP BY stream, side",
}


def sr12(spark, folder):
    return plain(lq.replenishment(_trans(spark, folder)))


def sr13(spark, folder):
    life = b.lifecycles(_trans(spark, folder))
    return plain(life.select("stream", "order_id", F.round(lq.order_credibility(life), 8).alias("credibility")))


def sr14(spark, folder):
    a = lq.attacked_orders(_trans(spark, folder), F.floor(F.col("sequence") / 200))
    return plain(a.groupBy("stream", "window").agg(F.count("*").alias("n"), F.round(F.sum("before"), 6).alias("before"), F.round(F.sum("executed"), 6).alias("executed"), F.round(F.sum("withdrawn"), 6).alias("withdrawn"), F.round(F.avg("survived"), 8).alias("survived")))


QUERIES |= {"sr12_replenishment": sr12, "sr13_credibility": sr13, "sr14_attacked_orders": sr14}
ORACLE |= {
    "sr13_credibility": _B + _LIFE + " SELECT stream, order_id, round(0.4::DOUBLE * (executed / added) + 0.2::DOUBLE * (1 - exp(-lifetime_s / 30)) + 0.2::DOUBLE * (remaining / largest) + 0.2::DOUBLE * (1 - withdrawn / added), 8) AS credibility FROM life",
    "sr14_attacked_orders": _B + ", g AS (SELECT stream, sequence // 200 AS window_id, order_id, arg_min(pre_qty, sequence) AS before, sum(executed) AS executed, sum(withdrawn) AS withdrawn, arg_max(post_qty, sequence) AS after FROM trans GROUP BY ALL) SELECT stream, window_id AS window, count(*) AS n, round(sum(before), 6) AS before, round(sum(executed), 6) AS executed, round(sum(withdrawn), 6) AS withdrawn, round(avg(after / before), 8) AS survived FROM g WHERE before > 0 GROUP BY ALL",
}


def _attacked(spark, folder):
    """Transitions, snapshots of three levels, attacks and the levels that they met, each made once."""
    events = book_events(spark, folder)
    trans, shots = cut_lineage(b.transitions(events)), cut_lineage(b.snapshots(events, at.LEVELS))
    found = cut_lineage(at.attacks(trans))
    return trans, shots, found, at.met_levels(found, shots)


def _recoveries(spark, folder):
    trans, _, _, levels = _attacked(spark, folder)
    return at.level_recoveries(levels, b.depth_changes(trans))


def _toxic(spark, folder):
    trans, shots, found, levels = _attacked(spark, folder)
    recovered = at.support(at.level_recoveries(levels, b.depth_changes(trans)))
    return trans, found, at.toxicity(found, at.tape(shots, trans), recovered, at.region_flow(levels, trans))


def sr8_levels(spark, folder):
    """How each price that an attack met came back, by horizon."""
    return plain(_recoveries(spark, folder).select("attack_id", "level", "price", "base", "least", "horizon", F.round("ratio", 8).alias("ratio")))


def fn23(spark, folder):
    return at.support(_recoveries(spark, folder)).select("attack_id", "horizon", *[(F.round(c, 6) + 0.0).alias(c) for c in ("near_touch", "deep_support", "ratio")])


def sr15(spark, folder):
    trans, _, _, levels = _attacked(spark, folder)
    return at.region_flow(levels, trans).select("attack_id", "book_side", "attacked", *[F.round(c, 6).alias(c) for c in ("added", "withdrawn", "executed", "net", "normalized", "pressure")])


def sr16(spark, folder):
    """Toxicity of each attack with its seven components, from the replayed book."""
    return _toxic(spark, folder)[2].select("attack_id", "missing", *[F.round(c, 6).alias(c) for c in ("flow", "shocks", "impact", "failure", "withdrawal", "spread", "volatility", "toxicity")])


def sr17(spark, folder):
    c = at.compared(at.scored(at.measured(book_events(spark, folder))))
    return c.select("attack_id", "before_id", F.round("d_credibility", 6).alias("d_credibility"), F.round("d_toxicity", 6).alias("d_toxicity"), "reason")


QUERIES |= {"sr8_levels": sr8_levels, "fn23_support": fn23, "sr15_region_flow": sr15, "sr16_toxicity": sr16, "sr17_deltas": sr17}

#: Attacks and the levels before them, from the touch at every event: the latest depth of each price by then.
_ATT = _B + """, exs AS (SELECT *, sum(opens) OVER (PARTITION BY stream, side ORDER BY sequence) AS run FROM (SELECT *, CASE WHEN sequence - lag(sequence) OVER (PARTITION BY stream, side ORDER BY sequence) <= 4 THEN 0 ELSE 1 END AS opens FROM trans WHERE action = 'EXECUTE' AND error IS NULL)),
att AS (SELECT stream || ':' || side || ':' || min(sequence) AS attack_id, stream, side, CASE side WHEN 'ASK' THEN 'BUY' ELSE 'SELL' END AS direction, min(sequence) AS s, max(sequence) AS e, count(*) AS n FROM exs GROUP BY stream, side, run HAVING count(*) >= 2 AND min(sequence) > 0),
prices AS (SELECT DISTINCT stream, side, price FROM depths),
look AS (SELECT a.attack_id, a.stream, a.side AS own, a.direction, a.s, a.e, p.side AS book_side, p.price FROM att a JOIN prices p USING (stream)),
asof0 AS (SELECT l.*, d.depth AS base FROM look l ASOF JOIN depths d ON l.stream = d.stream AND l.book_side = d.side AND l.price = d.price AND l.s - 1 >= d.sequence),
lev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attack_id, book_side ORDER BY CASE book_side WHEN 'BID' THEN -price ELSE price END) AS level FROM asof0 WHERE base > 0) WHERE level <= 3),
hs AS (SELECT unnest([5, 10, 25]) AS horizon),
rec AS (SELECT attack_id, level, price, base, horizon, least(base, coalesce((SELECT min(d.depth) FROM depths d WHERE d.stream = lev.stream AND d.side = lev.book_side AND d.price = lev.price AND d.sequence BETWEEN lev.s AND lev.e), base)) AS least,
  coalesce((SELECT arg_max(d.depth, d.sequence) FROM depths d WHERE d.stream = lev.stream AND d.side = lev.book_side AND d.price = lev.price AND d.sequence BETWEEN lev.s AND lev.e + horizon), base) AS later FROM lev, hs WHERE book_side = own),
rr AS (SELECT *, (later - least) / nullif(base - least, 0) AS ratio, CASE level WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM rec),
sup AS (SELECT attack_id, horizon, sum(w * ratio) / nullif(sum(w) FILTER (ratio IS NOT NULL), 0) AS near_touch, sum(w * ratio) FILTER (level > 1) / nullif(max(ratio) FILTER (level = 1) + 1e-6::DOUBLE, 0) AS deep_support, (sum(later) - sum(least)) / nullif(sum(base) - sum(least), 0) AS ratio FROM rr GROUP BY ALL),
eff AS (SELECT stream, side, sequence, post_price AS price, post_qty AS added, 0::DOUBLE AS withdrawn, 0::DOUBLE AS executed FROM trans WHERE error IS NULL AND (action = 'ADD' OR action = 'MODIFY' AND pre_price <> post_price) UNION ALL SELECT stream, side, sequence, pre_price, 0, pre_qty, 0 FROM trans WHERE error IS NULL AND action = 'MODIFY' AND pre_price <> post_price
  UNION ALL SELECT stream, side, sequence, pre_price, added, withdrawn, executed FROM trans WHERE error IS NULL AND NOT (action = 'ADD' OR action = 'MODIFY' AND pre_price <> post_price)),
flw AS (SELECT attack_id, book_side, book_side = own AS attacked, coalesce(sum(f.added), 0) AS added, coalesce(sum(f.withdrawn), 0) AS withdrawn, coalesce(sum(f.executed), 0) AS executed FROM lev LEFT JOIN eff f ON f.stream = lev.stream AND f.side = lev.book_side AND f.price = lev.price AND f.sequence BETWEEN lev.s AND lev.e + 25 GROUP BY ALL)"""
#: The touch after each event, from the runs of depth that each price had.
_TOX = _ATT + """, life AS (SELECT stream, side, price, depth, sequence AS s0, lead(sequence) OVER (PARTITION BY stream, side, price ORDER BY sequence) AS s1 FROM depths), evs AS (SELECT stream, sequence FROM book),
tch AS (SELECT e.stream, e.sequence, max(l.price) FILTER (l.side = 'BID') AS bid, min(l.price) FILTER (l.side = 'ASK') AS ask FROM evs e LEFT JOIN life l ON l.stream = e.stream AND l.depth > 0 AND l.s0 <= e.sequence AND (l.s1 IS NULL OR l.s1 > e.sequence) GROUP BY ALL),
tp AS (SELECT t.stream, t.sequence, (bid + ask) / 2 AS mid, ask - bid AS spread, CASE WHEN x.side = 'ASK' THEN x.executed WHEN x.side = 'BID' THEN -x.executed END AS g FROM tch t LEFT JOIN (SELECT * FROM trans WHERE action = 'EXECUTE' AND error IS NULL) x USING (stream, sequence)),
t2 AS (SELECT *, mid / lag(mid) OVER (PARTITION BY stream ORDER BY sequence) - 1 AS step FROM tp),
t3 AS (SELECT stream, sequence, mid, spread, coalesce(abs(sum(g) OVER f) / nullif(sum(abs(g)) OVER f, 0), 0) AS flow, CASE WHEN count(step) OVER v = 20 THEN sqrt(avg(step * step) OVER v) END AS vol FROM t2 WINDOW f AS (PARTITION BY stream ORDER BY sequence ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), v AS (PARTITION BY stream ORDER BY sequence ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ta AS (SELECT a.*, b.spread AS sp0, b.vol AS v0, c.flow, d.spread AS sp2, d.vol AS v2, CASE direction WHEN 'BUY' THEN d.mid - b.mid ELSE b.mid - d.mid END AS di FROM att a LEFT JOIN t3 b ON b.stream = a.stream AND b.sequence = a.s - 1 LEFT JOIN t3 c ON c.stream = a.stream AND c.sequence = a.e LEFT JOIN t3 d ON d.stream = a.stream AND d.sequence = a.e + 25),
tb AS (SELECT *, lag(di) OVER (PARTITION BY stream, side ORDER BY s) AS di0, abs(sum(CASE direction WHEN 'BUY' THEN 1 ELSE -1 END) OVER q) / count(*) OVER q AS shocks FROM ta WINDOW q AS (PARTITION BY stream ORDER BY s, side ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
tc AS (SELECT tb.*, p.ratio, f.withdrawn / (f.added + f.withdrawn + 1e-6::DOUBLE) AS withdrawal, sp2 / CASE WHEN sp0 = 0 THEN 1e-6::DOUBLE ELSE sp0 END AS xs, v2 / CASE WHEN v0 = 0 THEN 1e-6::DOUBLE ELSE v0 END AS xv FROM tb LEFT JOIN sup p ON p.attack_id = tb.attack_id AND p.horizon = 25 LEFT JOIN flw f ON f.attack_id = tb.attack_id AND f.attacked),
td AS (SELECT *, CASE WHEN di0 IS NOT NULL AND di IS NOT NULL THEN greatest(di, 0) / CASE WHEN abs(di0) + greatest(di, 0) = 0 THEN 1e-6::DOUBLE ELSE abs(di0) + greatest(di, 0) END END AS impact, CASE WHEN ratio IS NOT NULL THEN greatest(1 - greatest(ratio, 0), 0) END AS failure, CASE WHEN xs IS NOT NULL THEN greatest(xs - 1, 0) / (1 + greatest(xs - 1, 0)) END AS spr, CASE WHEN xv IS NOT NULL THEN greatest(xv - 1, 0) / (1 + greatest(xv - 1, 0)) END AS vola FROM tc),
tox AS (SELECT *, array_to_string(list_filter([CASE WHEN flow IS NULL THEN 'FLOW' END, CASE WHEN shocks IS NULL THEN 'SHOCKS' END, CASE WHEN impact IS NULL THEN 'IMPACT' END, CASE WHEN failure IS NULL THEN 'FAILURE' END, CASE WHEN withdrawal IS NULL THEN 'WITHDRAWAL' END, CASE WHEN spr IS NULL THEN 'SPREAD' END, CASE WHEN vola IS NULL THEN 'VOLATILITY' END], lambda x: x IS NOT NULL), ',') AS missing,
  flow * 0.2::DOUBLE + shocks * 0.15::DOUBLE + impact * 0.15::DOUBLE + failure * 0.15::DOUBLE + withdrawal * 0.1::DOUBLE + spr * 0.1::DOUBLE + vola * 0.15::DOUBLE AS toxicity FROM td)"""
ORACLE |= {
    "sr8_levels": _ATT + " SELECT attack_id, level, price, base, least, horizon, round(ratio, 8) AS ratio FROM rr",
    "fn23_support": _ATT + " SELECT attack_id, horizon, round(near_touch, 6) + 0.0::DOUBLE AS near_touch, round(deep_support, 6) + 0.0::DOUBLE AS deep_support, round(ratio, 6) + 0.0::DOUBLE AS ratio FROM sup",
    "sr15_region_flow": _ATT + " SELECT attack_id, book_side, attacked, round(added, 6) AS added, round(withdrawn, 6) AS withdrawn, round(executed, 6) AS executed, round(added - withdrawn, 6) AS net, round((added - withdrawn) / (added + withdrawn + 1e-6::DOUBLE), 6) AS normalized, round(withdrawn / (added + withdrawn + 1e-6::DOUBLE), 6) AS pressure FROM flw",
    "sr16_toxicity": _TOX + " SELECT attack_id, missing, round(flow, 6) AS flow, round(shocks, 6) AS shocks, round(impact, 6) AS impact, round(failure, 6) AS failure, round(withdrawal, 6) AS withdrawal, round(spr, 6) AS spread, round(vola, 6) AS volatility, round(toxicity, 6) AS toxicity FROM tox",
    "sr17_deltas": _TOX + ", tg AS (SELECT attack_id, order_id, life, arg_min(pre_qty, sequence) AS q, sum(executed) AS x, sum(withdrawn) AS w, arg_max(post_qty, sequence) AS z FROM att a JOIN trans t ON t.stream = a.stream AND t.side = a.side AND t.sequence BETWEEN a.s AND a.e + 25 WHERE error IS NULL GROUP BY ALL HAVING arg_min(pre_qty, sequence) > 0), "
    "cr AS (SELECT attack_id, sum(q * (0.5::DOUBLE * least(x / q, 1) + 0.25::DOUBLE * least(z / q, 1) + 0.25::DOUBLE * (1 - least(w / q, 1)))) / sum(q) AS c FROM tg GROUP BY attack_id), "
    "pr AS (SELECT tox.attack_id, lag(tox.attack_id) OVER w AS before_id, c - lag(c) OVER w AS dc, toxicity - lag(toxicity) OVER w AS dt FROM tox LEFT JOIN cr USING (attack_id) WINDOW w AS (PARTITION BY stream, side ORDER BY s)) "
    "SELECT attack_id, before_id, round(dc, 6) AS d_credibility, round(dt, 6) AS d_toxicity, concat_ws(',', CASE WHEN dc IS NULL THEN 'CREDIBILITY_UNKNOWN' END, CASE WHEN dt IS NULL THEN 'TOXICITY_UNKNOWN' END) AS reason FROM pr WHERE before_id IS NOT NULL",
}
