"""Queries of the sequence operators, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import sequences as s
from tapeloom.plans.frames import STATES, states
from tapeloom.tables import table

HORIZONS = (1, 5, 10, 25)
DAY_US = 86_400_000_000


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _segmented(spark, folder):
    st = states(spark, folder)
    day = F.col("at_us") - F.pmod(F.col("at_us"), F.lit(DAY_US))
    w = s.ordered("instrument", "event_index")
    boundary = (F.coalesce(F.lag(day).over(w) != day, F.lit(False))) | (F.col("event_type") == "signup")
    return s.segments(st.withColumn("bound", boundary), "instrument", "event_index", F.col("bound"))


SEGMENTED = STATES + f""",
segmented AS (
  SELECT *, CAST(sum(CASE WHEN bound THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY event_index) AS BIGINT) AS segment
  FROM (SELECT *, coalesce(lag(at_us // {DAY_US}) OVER (PARTITION BY instrument ORDER BY event_index) <> at_us // {DAY_US}, false) OR event_type = 'signup' AS bound FROM states))"""

_STREAM = ["instrument_id", "venue", "sequence_stream_id"]


def _market(spark, folder):
    return table(spark, folder, "raw_market_events")


def ag6(spark, folder):
    return _rounded(s.aggressive_flow(states(spark, folder), "instrument"), "buy_volume", "sell_volume", "unknown_volume", "signed_volume", digits=4)


def wn3(spark, folder):
    return _rounded(s.rolling_flow(states(spark, folder), "instrument", "event_index", 20), "net_flow", "persistence", "unknown_share", "coverage")


def wn4(spark, folder):
    return _rounded(s.paired_islands(_segmented(spark, folder), 4, 4 * 3600 * 1_000_000), "volume", digits=4).drop("island")


def wn4_episodes(spark, folder):
    return s.episodes(_segmented(spark, folder), max_gap=4, max_gap_us=4 * 3600 * 1_000_000, max_us=12 * 3600 * 1_000_000)


def wn5(spark, folder):
    return _segmented(spark, folder).select("event_id", "segment")


def wn6(spark, folder):
    return states(spark, folder).select("event_id", "event_index")


def wn7_wn8(spark, folder):
    return s.forward(states(spark, folder), "instrument", "event_index", "mid", HORIZONS)


def wn9(spark, folder):
    return s.forward(states(spark, folder), "instrument", "event_index", "mid", (10,)).groupBy("instrument").agg(F.count("later").alias("n_whole"), F.count(F.when(F.col("later").isNull(), 1)).alias("n_cut"))


def wn10(spark, folder):
    return _rounded(s.backward(states(spark, folder), "instrument", "event_index", "mid", (10, 25)), "back_return", "realized_volatility", digits=8)


def wn11(spark, folder):
    trades = states(spark, folder).where("side IN ('BUY', 'SELL')")
    return s.latest_run(trades, "instrument", "event_index", "side").withColumnRenamed("value", "direction")


def wn2(spark, folder):
    events = _market(spark, folder)
    checked = s.sequence_check(events, _STREAM, ["receive_time", "process_time", "event_id"], "sequence_number", F.coalesce(F.col("book_action") == "RESET", F.lit(False)))
    return checked.groupBy("venue", "sequence_status").agg(F.count("*").alias("n"))


def tk1(spark, folder):
    kind = F.when(F.col("event_kind") == "BOOK", 0).when(F.col("event_kind") == "TRADE", 1).otherwise(2)
    w = s.ordered(_STREAM, "sequence_number", "exchange_time", "receive_time", "process_time", "kind", "event_id")
    return _market(spark, folder).withColumn("kind", kind).withColumn("position", F.row_number().over(w)).select("event_id", "receive_time", "position")


def wn14(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type")
    return s.consecutive_groups(e, ["event_type"], ["at_us", "event_id"], ["user_id"]).groupBy("user_id", "group_number", "event_type").agg(F.count("*").alias("n"))


def wn15(spark, folder):
    """A session that reopens after another one has begun."""
    seg = states(spark, folder).withColumn("session", F.pmod(F.floor(F.col("at_us") / F.lit(3_600_000_000)), F.lit(6)))
    islands = s.runs(seg, "instrument", "event_index", "session")
    return islands.groupBy("instrument", F.col("value").alias("session")).agg(F.count("*").alias("n_islands")).withColumn("reopened", F.col("n_islands") > 1)


QUERIES = {
    "ag6_aggressive_flow": ag6, "wn2_sequence_status": wn2, "wn3_rolling_flow": wn3, "wn4_islands": wn4, "wn4_episodes": wn4_episodes, "wn5_segments": wn5, "wn6_event_index": wn6,
    "wn7_wn8_forward": wn7_wn8, "wn9_whole_range": wn9, "wn10_backward": wn10, "wn11_latest_run": wn11, "tk1_market_order": tk1, "wn14_groups": wn14, "wn15_sessions": wn15,
}

_SIGNED = "CASE side WHEN 'BUY' THEN qty WHEN 'SELL' THEN -qty ELSE 0 END"


def _forward_sql(h):
    w = f"OVER (PARTITION BY instrument ORDER BY event_index ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)"
    return (
        f"SELECT instrument, event_index, mid, {h} AS horizon, CASE WHEN count(mid) {w} = {h + 1} THEN lead(mid, {h}) OVER (PARTITION BY instrument ORDER BY event_index) END AS later, "
        f"CASE WHEN count(mid) {w} = {h + 1} THEN max(mid) {w} END AS highest, CASE WHEN count(mid) {w} = {h + 1} THEN event_index + list_position(list(mid) {w}, max(mid) {w}) - 1 END AS highest_at, "
        f"CASE WHEN count(mid) {w} = {h + 1} THEN min(mid) {w} END AS lowest, CASE WHEN count(mid) {w} = {h + 1} THEN event_index + list_position(list(mid) {w}, min(mid) {w}) - 1 END AS lowest_at FROM states"
    )


def _backward_sql(h):
    return (
        f"SELECT instrument, event_index, {h} AS horizon, round((mid - lag(mid, {h}) OVER w) / lag(mid, {h}) OVER w, 8) AS back_return, "
        f"CASE WHEN lag(mid, {h}) OVER w IS NOT NULL THEN round(sqrt(avg(step * step) OVER (PARTITION BY instrument ORDER BY event_index ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)), 8) END AS realized_volatility "
        "FROM (SELECT *, (mid - lag(mid) OVER v) / lag(mid) OVER v AS step FROM states WINDOW v AS (PARTITION BY instrument ORDER BY event_index)) WINDOW w AS (PARTITION BY instrument ORDER BY event_index)"
    )


_RUNS = "SELECT *, sum(CASE WHEN {v} IS DISTINCT FROM b OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY event_index) AS run FROM (SELECT *, lag({v}) OVER w AS b, row_number() OVER w AS n FROM {t} WINDOW w AS (PARTITION BY instrument ORDER BY event_index))"

ORACLE = {
    "ag6_aggressive_flow": f"WITH {STATES} SELECT instrument, " + ", ".join(f"round(coalesce(sum(qty) FILTER (side = '{x}'), 0), 4) AS {x.lower()}_volume, count(*) FILTER (side = '{x}') AS {x.lower()}_count" for x in ("BUY", "SELL", "UNKNOWN"))
    + f", round(sum({_SIGNED}), 4) AS signed_volume FROM states GROUP BY instrument",
    "wn2_sequence_status": "SELECT venue, sequence_status, count(*) AS n FROM (SELECT venue, CASE WHEN b IS NULL THEN 'FIRST' WHEN sequence_number = b THEN 'DUPLICATE' WHEN sequence_number < b THEN 'REGRESSION' WHEN sequence_number > b + 1 AND coalesce(book_action, '') <> 'RESET' THEN 'GAP' ELSE 'OK' END AS sequence_status "
    "FROM (SELECT *, lag(sequence_number) OVER (PARTITION BY instrument_id, venue, sequence_stream_id ORDER BY receive_time, process_time, event_id) AS b FROM raw_market_events)) GROUP BY ALL",
    "wn3_rolling_flow": f"WITH {STATES}, f AS (SELECT instrument, event_index, sum({_SIGNED}) OVER w AS net, sum(abs({_SIGNED})) OVER w AS known, coalesce(sum(CASE WHEN side = 'UNKNOWN' THEN qty END) OVER w, 0) AS unknown FROM states WINDOW w AS (PARTITION BY instrument ORDER BY event_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) "
    "SELECT instrument, event_index, round(net, 6) AS net_flow, round(coalesce(abs(net) / nullif(known, 0), 0), 6) AS persistence, round(coalesce(unknown / nullif(known + unknown, 0), 0), 6) AS unknown_share, round(coalesce(known / nullif(known + unknown, 0), 0), 6) AS coverage, CASE WHEN net > 0 THEN 'BUY' WHEN net < 0 THEN 'SELL' ELSE 'NEUTRAL' END AS direction FROM f",
    "wn4_islands": f"WITH {SEGMENTED}, e AS (SELECT *, lag(side) OVER w = side AND lag(segment) OVER w = segment AND event_index - lag(event_index) OVER w - 1 <= 4 AND at_us - lag(at_us) OVER w <= 14400000000 AS same FROM segmented WHERE side IS NOT NULL WINDOW w AS (PARTITION BY instrument ORDER BY event_index)), "
    "i AS (SELECT *, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY event_index) AS island FROM e) SELECT instrument, side AS direction, min(event_index) AS first_index, max(event_index) AS last_index, count(*) AS n_executions, round(sum(qty), 4) AS volume FROM i WHERE side <> 'UNKNOWN' GROUP BY instrument, island, side",
    "wn5_segments": f"WITH {SEGMENTED} SELECT event_id, segment FROM segmented",
    "wn6_event_index": f"WITH {STATES} SELECT event_id, event_index FROM states",
    "wn7_wn8_forward": f"WITH {STATES} " + " UNION ALL ".join(_forward_sql(h) for h in HORIZONS),
    "wn9_whole_range": f"WITH {STATES} SELECT instrument, count(*) FILTER (event_index + 10 < n) AS n_whole, count(*) FILTER (event_index + 10 >= n) AS n_cut FROM (SELECT *, count(*) OVER (PARTITION BY instrument) AS n FROM states) GROUP BY instrument",
    "wn10_backward": f"WITH {STATES} " + " UNION ALL ".join(_backward_sql(h) for h in (10, 25)),
    "wn11_latest_run": f"WITH {STATES}, t AS (SELECT * FROM states WHERE side IN ('BUY', 'SELL')), r AS ({_RUNS.format(v='side', t='t')}), l AS (SELECT instrument, max(run) AS run FROM r GROUP BY instrument) SELECT instrument, any_value(side) AS direction, count(*) AS length FROM r JOIN l USING (instrument, run) GROUP BY instrument",
    "tk1_market_order": "SELECT event_id, receive_time, row_number() OVER (PARTITION BY instrument_id, venue, sequence_stream_id ORDER BY sequence_number, exchange_time, receive_time, process_time, CASE event_kind WHEN 'BOOK' THEN 0 WHEN 'TRADE' THEN 1 ELSE 2 END, event_id) AS position FROM raw_market_events",
    "wn14_groups": "SELECT user_id, group_number, event_type, count(*) AS n FROM (SELECT user_id, event_type, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS group_number FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY ALL",
    "wn15_sessions": f"WITH {STATES}, t AS (SELECT *, (at_us // 3600000000) % 6 AS session FROM states), r AS ({_RUNS.format(v='session', t='t')}) SELECT instrument, session, count(DISTINCT run) AS n_islands, count(DISTINCT run) > 1 AS reopened FROM r GROUP BY instrument, session",
}
