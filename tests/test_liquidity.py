from pyspark.sql import functions as F

from tapeloom.operators import book, liquidity

EVENTS = "stream long, sequence long, order_id string, action string, side string, price double, qty double, at_us long"
ROWS = [
    (1, 0, "a", "ADD", "BID", 10.0, 100.0), (1, 1, "a", "EXECUTE", "BID", 10.0, 40.0),  # 10.0 becomes eligible
    (1, 2, "b", "ADD", "BID", 10.0, 30.0), (1, 4, "c", "ADD", "BID", 10.0, 20.0),  # one episode: gap of two
    (1, 5, "b", "EXECUTE", "BID", 10.0, 25.0), (1, 6, "d", "ADD", "BID", 10.0, 5.0),  # hit, so a new episode
    (1, 7, "b", "CANCEL", "BID", 10.0, 5.0), (1, 8, "c", "DELETE", "BID", 10.0, None),
    (1, 20, "a", "MODIFY", "BID", 10.0, 70.0), (1, 21, "a", "CANCEL", "BID", 10.0, 65.0),  # raised by 10, which goes last: incomplete
    (1, 22, "e", "ADD", "ASK", 11.0, 9.0), (2, 0, "a", "ADD", "BID", 10.0, 1.0),  # nothing was executed at these prices
]


def test_replenishment(spark):
    df = spark.createDataFrame([(*r, r[1]) for r in ROWS], EVENTS).withColumn("qty", F.coalesce("qty", F.lit(0.0)))
    got = sorted((r.opened, r.closed, r.added, r.executed, r.withdrawn, r.complete) for r in liquidity.replenishment(book.transitions(df)).collect())
    assert got == [(2, 4, 50.0, 25.0, 25.0, True), (6, 6, 5.0, 0.0, 0.0, True), (20, 20, 10.0, 0.0, 5.0, False)]
    assert liquidity.replenishment(book.transitions(df.limit(0))).count() == 0


def test_toxicity_is_whole_or_nothing(spark):
    names = [n for n, _ in liquidity.TOXICITY_WEIGHTS]
    df = spark.createDataFrame([(1, *[1.0] * 7), (2, *[0.5] * 6, None)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: (r.missing, r.toxicity) for r in liquidity.toxicity(df).collect()}
    assert got[1][0] == "" and abs(got[1][1] - 1.0) < 1e-12 and got[2] == ("VOLATILITY", None)
