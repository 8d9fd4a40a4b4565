"""The driver's tables seen as the project's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.sequences import event_index
from tapeloom.tables import table


def market_states(spark: SparkSession, folder: str) -> DataFrame:
    """events as market states: one market a user, a purchase is a BUY, a click a SELL, an error an UNKNOWN, the rest quotes."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    side = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "click", "SELL").when(F.col("event_type") == "error", "UNKNOWN")
    return e.select("event_id", F.col("user_id").alias("instrument"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type", side.alias("side"), F.col("value").alias("qty"), (F.lit(100) + k / 100.0).alias("mid"))


def states(spark: SparkSession, folder: str) -> DataFrame:
    """market_states() with each event's place in its market."""
    return event_index(market_states(spark, folder), "instrument", "at_us", "event_id")


STATES = """
states AS (
  SELECT event_id, user_id AS instrument, epoch_us(ts) AS at_us, event_type, CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'click' THEN 'SELL' WHEN 'error' THEN 'UNKNOWN' END AS side,
    value AS qty, 100 + CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS mid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index
  FROM events)"""


def book_events(spark: SparkSession, folder: str, broken: bool = False) -> DataFrame:
    """lineitem as order events: a stream a supplier, a line opens an order, is changed if its tax is high, and ends by its flag.

    broken: with orders cancelled once more after their end, and a RESET in every tenth stream.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    li = table(spark, folder, "lineitem").withColumn("rn", F.row_number().over(w).cast("long"))
    idx = F.col("l_partkey") % 50
    bid = F.col("l_linestatus") == "F"

    def price(level):
        return F.when(bid, 100 - level * 0.01).otherwise(100.01 + level * 0.01)

    changes = F.col("l_tax") > 0.04
    later_qty = F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity") + 5).otherwise(F.col("l_quantity") / 2)
    later_idx = F.when(F.col("l_partkey") % 3 == 0, idx + 1).otherwise(idx)
    q2 = F.when(changes, later_qty).otherwise(F.col("l_quantity"))
    i2 = F.when(changes, later_idx).otherwise(idx)
    final = F.when(F.col("l_partkey") % 4 == 1, q2 / 2).otherwise(q2)

    def event(when, offset, action, level, qty):
        return F.when(when, F.struct((F.col("rn") * 3 + offset).alias("ordinal"), action.alias("action"), F.round(price(level), 2).alias("price"), qty.alias("qty")))

    ends = F.col("l_returnflag").isin("A", "R")
    events = [event(F.lit(True), 0, F.lit("ADD"), idx, F.col("l_quantity")), event(changes, 4, F.lit("MODIFY"), later_idx, later_qty), event(ends, 8, F.when(F.col("l_returnflag") == "A", "EXECUTE").otherwise("CANCEL"), i2, final)]
    if broken:
        events.append(event(ends & (F.col("l_orderkey") % 97 == 0), 9, F.lit("CANCEL"), i2, F.lit(1000.0)))
        events.append(event((F.col("l_suppkey") % 10 == 0) & (F.col("rn") == 100), 10, F.lit("RESET"), idx, F.lit(0.0)))
    flat = li.withColumn("es", F.array_compact(F.array(*events))).withColumn("e", F.explode("es"))
    out = flat.select(F.col("l_suppkey").alias("stream"), F.col("rn").alias("order_id"), F.when(bid, "BID").otherwise("ASK").alias("side"), "e.*")
    seq = Window.partitionBy("stream").orderBy("ordinal", "order_id")
    return out.withColumn("sequence", (F.row_number().over(seq) - 1).cast("long")).withColumn("at_us", F.col("ordinal") * 1000).drop("ordinal")


def book_sql(broken: bool = False) -> str:
    q2 = "CASE WHEN l_tax > 0.04 THEN CASE WHEN l_partkey % 2 = 0 THEN l_quantity + 5 ELSE l_quantity / 2 END ELSE l_quantity END"
    i2 = "CASE WHEN l_tax > 0.04 AND l_partkey % 3 = 0 THEN l_partkey % 50 + 1 ELSE l_partkey % 50 END"
    price = "round(CASE WHEN l_linestatus = 'F' THEN 100 - ({i}) * 0.01::DOUBLE ELSE 100.01::DOUBLE + ({i}) * 0.01::DOUBLE END, 2)"
    parts = [
        f"SELECT *, 3 * rn AS ordinal, 'ADD' AS action, {price.format(i='l_partkey % 50')} AS price, l_quantity AS qty FROM li",
        f"SELECT *, 3 * rn + 4, 'MODIFY', {price.format(i=i2)}, {q2} FROM li WHERE l_tax > 0.04",
        f"SELECT *, 3 * rn + 8, CASE l_returnflag WHEN 'A' THEN 'EXECUTE' ELSE 'CANCEL' END, {price.format(i=i2)}, CASE WHEN l_partkey % 4 = 1 THEN ({q2}) / 2 ELSE {q2} END FROM li WHERE l_returnflag IN ('A', 'R')",
    ]
    if broken:
        parts.append(f"SELECT *, 3 * rn + 9, 'CANCEL', {price.format(i=i2)}, 1000 FROM li WHERE l_returnflag IN ('A', 'R') AND l_orderkey % 97 = 0")
        parts.append("SELECT *, 3 * rn + 10, 'RESET', 0, 0 FROM li WHERE l_suppkey % 10 = 0 AND rn = 100")
    return (
        "li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem), "
        f"ev AS ({' UNION ALL '.join(parts)}), "
        "book AS (SELECT l_suppkey AS stream, rn AS order_id, CASE l_linestatus WHEN 'F' THEN 'BID' ELSE 'ASK' END AS side, action, price, CAST(qty AS DOUBLE) AS qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY ordinal, rn) - 1 AS sequence, ordinal * 1000 AS at_us FROM ev), "
        "ep AS (SELECT * FROM (SELECT *, sum(CASE action WHEN 'RESET' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY sequence) AS epoch FROM book) WHERE action <> 'RESET'), "
        "nx AS (SELECT *, row_number() OVER (PARTITION BY stream, epoch, order_id ORDER BY sequence) AS k FROM ep), "
        "fold AS (SELECT DISTINCT stream, epoch, order_id, 0::BIGINT AS k, 0::BIGINT AS life, NULL::BIGINT AS sequence, NULL::VARCHAR AS action, NULL::VARCHAR AS side, NULL::BIGINT AS at_us, NULL::DOUBLE AS qty, NULL::DOUBLE AS pre_price, NULL::DOUBLE AS post_price, 0::DOUBLE AS pre_qty, 0::DOUBLE AS post_qty, NULL::VARCHAR AS error, NULL::VARCHAR AS opened FROM nx "
        "UNION ALL SELECT stream, epoch, order_id, k, life0 + CASE WHEN err IS NULL AND action = 'ADD' THEN 1 ELSE 0 END, sequence, action, side, at_us, qty, CASE WHEN err IS NULL AND action = 'ADD' THEN NULL ELSE p0 END, CASE WHEN err IS NULL AND action IN ('ADD', 'MODIFY') THEN price ELSE p0 END, q0, "
        "CASE WHEN err IS NOT NULL THEN q0 WHEN action IN ('ADD', 'MODIFY') THEN qty WHEN action = 'DELETE' THEN 0 ELSE q0 - qty END, err, CASE WHEN err IS NULL AND action = 'ADD' THEN side ELSE side0 END "
        "FROM (SELECT e.*, f.life AS life0, f.post_qty AS q0, f.post_price AS p0, f.opened AS side0, CASE WHEN e.action = 'ADD' AND f.post_qty > 0 THEN 'DUPLICATE_ORDER' WHEN e.action <> 'ADD' AND f.post_qty <= 0 THEN 'UNKNOWN_ORDER' WHEN e.action <> 'ADD' AND e.side <> f.opened THEN 'SIDE_MISMATCH' WHEN e.action IN ('CANCEL', 'EXECUTE', 'DELETE') AND e.price <> f.post_price THEN 'PRICE_MISMATCH' WHEN e.action IN ('CANCEL', 'EXECUTE') AND e.qty > f.post_qty THEN 'EXCESS_QUANTITY' END AS err "
        "FROM fold f JOIN nx e ON e.stream = f.stream AND e.epoch = f.epoch AND e.order_id = f.order_id AND e.k = f.k + 1)), "
        "trans AS (SELECT stream, epoch, sequence, order_id, life, action, side, at_us, pre_price, post_price, pre_qty, post_qty, error, CASE WHEN error IS NULL AND action IN ('ADD', 'MODIFY') THEN greatest(post_qty - pre_qty, 0) ELSE 0 END AS added, CASE WHEN error IS NULL AND action = 'EXECUTE' THEN qty ELSE 0 END AS executed, "
        "CASE WHEN error IS NULL AND action IN ('CANCEL', 'DELETE', 'MODIFY') THEN greatest(pre_qty - post_qty, 0) ELSE 0 END AS withdrawn FROM fold WHERE k > 0), "
        "moves AS (SELECT stream, epoch, side, price, sequence, sum(d) AS d, sum(n) AS n FROM (SELECT stream, epoch, side, pre_price AS price, sequence, -pre_qty AS d, CASE WHEN pre_qty > 0 THEN -1 ELSE 0 END AS n FROM trans WHERE pre_price IS NOT NULL AND error IS NULL "
        "UNION ALL SELECT stream, epoch, side, post_price, sequence, post_qty, CASE WHEN post_qty > 0 THEN 1 ELSE 0 END FROM trans WHERE post_price IS NOT NULL AND error IS NULL) GROUP BY ALL), "
        "depths AS (SELECT stream, epoch, side, price, sequence, sum(d) OVER w AS depth, sum(n) OVER w AS orders FROM moves WINDOW w AS (PARTITION BY stream, epoch, side, price ORDER BY sequence)), "
        "levels AS (SELECT stream, side, price, depth, orders FROM (SELECT stream, epoch, side, price, arg_max(depth, sequence) AS depth, arg_max(orders, sequence) AS orders, max(epoch) OVER (PARTITION BY stream) AS newest FROM depths GROUP BY stream, epoch, side, price) WHERE epoch = newest AND depth > 0), "
        "top AS (SELECT *, row_number() OVER (PARTITION BY stream, side ORDER BY CASE side WHEN 'BID' THEN -price ELSE price END) AS level FROM levels)"
    )
