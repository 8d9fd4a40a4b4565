"""The queries p1, p2, p4 and p5, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import known_at, late_events, seen_ranges, structural_csv
from tapeloom.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return structural_csv.split_lines(table(spark, folder, "databento_mbo_fixture"))[1]


def p1_valid(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = structural_csv.split_lines(table(spark, folder, "databento_mbo_fixture"))
    return valid.selectExpr("record_id", "unix_micros(ts_recv) AS recv_us", "unix_micros(ts_event) AS event_us", "action", "side", "CAST(price AS DECIMAL(20,6)) AS price", "size", "order_id", "sequence", "symbol")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen_ranges.copies(table(spark, folder, "raw_news"))


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    kept = seen_ranges.mark_copies(table(spark, folder, "raw_news"), carry=["source", "batch_id"]).where("kept")
    return kept.groupBy("source", "batch_id").count().withColumnRenamed("count", "messages")


MARKET_CUTOFF_US = 2 * late_events.HOUR_US
NEWS_CUTOFF_US = 24 * late_events.HOUR_US


def _hours(spark: SparkSession, folder: str) -> DataFrame:
    market = table(spark, folder, "raw_market_events").select("event_id", "instrument_id", "exchange_time", "receive_time", F.when(F.col("event_kind") == "TRADE", F.col("quantity")).alias("traded"))
    events = late_events.first_receipts(market, "event_id", "receive_time", ["instrument_id", "exchange_time", "traded"])
    news = seen_ranges.mark_copies(table(spark, folder, "raw_news"), carry=["source", "event_time", "receive_time"]).where("kept")
    return late_events.corrected_periods(
        late_events.partials(events, "raw_market_events", "instrument_id", "exchange_time", "receive_time", F.col("traded"), MARKET_CUTOFF_US).unionByName(
            late_events.partials(news, "raw_news", "source", "event_time", "receive_time", F.lit(0), NEWS_CUTOFF_US)
        )
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _hours(spark, folder).where("n_late > 0").selectExpr("feed", "group_key", f"period * {late_events.HOUR_US // 1_000_000} AS period_start")


def p4_hours(spark: SparkSession, folder: str) -> DataFrame:
    return _hours(spark, folder).selectExpr("feed", "group_key", f"period * {late_events.HOUR_US // 1_000_000} AS period_start", "n_in_time", "n_in_time + n_late AS n_events", "volume_in_time", "CAST(volume_in_time + volume_late AS DECIMAL(38,6)) AS volume")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    news = table(spark, folder, "raw_news").select("news_id", "entity_id", "event_id", "process_time").where("entity_id IS NOT NULL AND event_id IS NOT NULL")
    links = known_at.validity_history(table(spark, folder, "entity_instrument_links"), "entity_id", "link_id", "valid_from", "valid_to")
    revisions = known_at.change_history(table(spark, folder, "canonical_event_revisions"), "event_id", "revision_id", "available_at", ("revision_number",))
    span = known_at.time_span(news, "process_time")
    linked = known_at.match_known(news, "news_id", "entity_id", "process_time", links, span).withColumnRenamed("value", "link_id")
    revised = known_at.match_known(news, "news_id", "event_id", "process_time", revisions, span).withColumnRenamed("value", "revision_id")
    return linked.join(revised, "news_id")


def p5_attributes(spark: SparkSession, folder: str) -> DataFrame:
    news = table(spark, folder, "raw_news").select("news_id", "event_id", "process_time")
    changes = table(spark, folder, "canonical_event_revisions")
    history = {name: ("event_id", known_at.change_history(changes, "event_id", name, "available_at", ("revision_number",))) for name in ("event_state", "severity", "event_subtype")}
    return known_at.as_known(news, "news_id", "process_time", history).withColumn("severity", F.col("severity").cast("double"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_valid": p1_valid, "p2_found": p2_found, "p2_kept": p2_kept, "p4_found": p4_found, "p4_hours": p4_hours, "p5_found": p5_found, "p5_attributes": p5_attributes}

_FIELDS = r"""'"(?:[^"]|"")*"|[^",]*'"""
_MBO = rf"""
WITH lines AS (SELECT record_id, coalesce(raw_line, '') AS line FROM databento_mbo_fixture),
read AS (
  SELECT record_id, regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS sound,
    regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1) AS raw FROM lines),
fields AS (
  SELECT record_id, sound, len(raw) AS n,
    list_transform(raw, lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END, E' \t\r\n')) AS f FROM read),
named AS (
  SELECT record_id, sound, n, f, f[1] AS recv, f[2] AS event, upper(f[6]) AS action, f[8] AS price, f[14] AS seq FROM fields),
timed AS (
  SELECT *, {{recv}} AS recv_us, {{event}} AS event_us,
    regexp_full_match(seq, '[0-9]+') AND coalesce(TRY_CAST(seq AS HUGEINT) < 9223372036854775808::HUGEINT, false) AS seq_ok,
    regexp_full_match(price, '\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') AND regexp_matches(price, '^[^eE]*[1-9]')
      OR price = '' AND action IN ('R', 'N') AS price_ok
  FROM named),
judged AS (
  SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 15 THEN 'column_count'
    WHEN recv_us IS NULL OR recv_us < event_us THEN 'ts_recv'
    WHEN NOT regexp_full_match(action, '[ACMRTFN]') THEN 'action' WHEN NOT price_ok THEN 'price' WHEN NOT seq_ok THEN 'sequence' END AS reason
  FROM timed)
"""


def _micros(c: str) -> str:
    iso = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
    return (
        f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN CASE WHEN TRY_CAST({c} AS HUGEINT) < 9223372036854775808::HUGEINT THEN CAST(TRY_CAST({c} AS HUGEINT) // 1000 AS BIGINT) END "
        f"WHEN regexp_full_match({c}, '{iso}') THEN epoch_us(TRY_CAST(replace(regexp_extract({c}, '^(.*?)(Z|[+-][0-9:]+)$', 1), 'T', ' ') AS TIMESTAMP)) "
        f"- CASE WHEN {c} LIKE '%Z' THEN 0 ELSE CASE WHEN {c}[-6] = '-' THEN -1 ELSE 1 END * (CAST({c}[-5:-4] AS BIGINT) * 60 + CAST({c}[-2:-1] AS BIGINT)) * 60000000 END END"
    )


_MBO = _MBO.replace("{recv}", _micros("recv")).replace("{event}", _micros("event"))

_MESSAGES = r"""
WITH marked AS (
  SELECT *, row_number() OVER (PARTITION BY source, CASE WHEN trim(coalesce(provider_item_id, ''), E' \t\r\n') <> '' THEN 'i' || trim(provider_item_id, E' \t\r\n')
    ELSE 'c' || content_hash END ORDER BY receive_time, news_id) AS nth FROM raw_news)
"""

_HOURS = (
    _MESSAGES
    + """,
receipts AS (
  SELECT event_id, arg_min(struct_pack(k := instrument_id, t := exchange_time, q := CASE WHEN event_kind = 'TRADE' THEN quantity END), receive_time) AS s, min(receive_time) AS received
  FROM raw_market_events GROUP BY event_id),
events AS (
  SELECT 'raw_market_events' AS feed, s.k AS group_key, epoch_us(s.t) AS happened, epoch_us(received) AS received, s.q AS q, 2 AS hours FROM receipts
  UNION ALL SELECT 'raw_news', source, epoch_us(event_time), epoch_us(receive_time), NULL, 24 FROM marked WHERE nth = 1),
placed AS (SELECT *, happened // 3600000000 * 3600 AS period_start, received >= (happened // 3600000000 + 1) * 3600000000 AS late, received >= (happened // 3600000000 + 1 + hours) * 3600000000 AS too_late FROM events)
"""
)
_REVISED = """
WITH changes AS (SELECT event_id, available_at, revision_number, revision_id, event_state, severity, event_subtype FROM canonical_event_revisions)
"""


def _last(c: str) -> str:
    return f"(SELECT arg_max({c}, struct_pack(a := available_at, r := revision_number, v := {c})) FROM changes c WHERE c.event_id = n.event_id AND c.available_at <= n.process_time AND {c} IS NOT NULL)"


ORACLE: dict[str, str] = {
    "p4_found": _HOURS + "SELECT DISTINCT feed, group_key, period_start FROM placed WHERE late AND NOT too_late",
    "p4_hours": _HOURS + "SELECT feed, group_key, period_start, count(*) FILTER (NOT late) AS n_in_time, count(*) AS n_events, CAST(coalesce(sum(q) FILTER (NOT late), 0) AS DECIMAL(38,6)) AS volume_in_time, CAST(coalesce(sum(q), 0) AS DECIMAL(38,6)) AS volume "
    "FROM placed WHERE NOT too_late GROUP BY ALL",
    "p5_found": "SELECT DISTINCT news_id, link_id, revision_id FROM (SELECT n.news_id, l.link_id, r.revision_id, row_number() OVER (PARTITION BY n.news_id, l.link_id ORDER BY r.available_at DESC, r.revision_number DESC, r.revision_id DESC) AS nth FROM raw_news n "
    "JOIN entity_instrument_links l ON l.entity_id = n.entity_id AND (l.valid_from IS NULL OR l.valid_from <= n.process_time) AND (l.valid_to IS NULL OR n.process_time < l.valid_to) "
    "JOIN canonical_event_revisions r ON r.event_id = n.event_id AND r.available_at <= n.process_time) WHERE nth = 1",
    "p5_attributes": _REVISED + f"SELECT news_id, {_last('event_state')} AS event_state, {_last('severity')} AS severity, {_last('event_subtype')} AS event_subtype FROM raw_news n",
    "p1_found": _MBO + "SELECT record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_valid": _MBO + "SELECT record_id, recv_us, event_us, action, f[7] AS side, CAST(CASE WHEN price = '' THEN NULL WHEN regexp_matches(price, '[eE]') THEN CAST(price AS DOUBLE) ELSE CAST(price AS DECIMAL(20,6)) END AS DECIMAL(20,6)) AS price, "
    "TRY_CAST(f[9] AS BIGINT) AS size, f[11] AS order_id, CAST(seq AS BIGINT) AS sequence, f[15] AS symbol FROM judged WHERE reason IS NULL",
    "p2_found": _MESSAGES + "SELECT news_id FROM marked WHERE nth > 1",
    "p2_kept": _MESSAGES + "SELECT source, batch_id, count(*) AS messages FROM marked WHERE nth = 1 GROUP BY ALL",
}
