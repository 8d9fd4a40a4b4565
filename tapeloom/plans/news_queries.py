"""Queries of the news stack, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import identity, market, text
from tapeloom.functions import taxonomy as t
from tapeloom.operators import asof, known_at, news, scores
from tapeloom.session import cut_lineage
from tapeloom.tables import table

AS_OF = "2023-01-07 12:00:00"
FIRST_INCOMING_BATCH = 5
EXCHANGE, ASSET = "XKAL", "EQUITY"
NAMESPACE = "f137d5c2-53a8-4dcf-a112-d48e3cc54d8e"


def _ts(value: str):
    return F.lit(value).cast("timestamp")


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_news")


def normed(spark: SparkSession, folder: str) -> DataFrame:
    r = raw(spark, folder).withColumn("text", F.concat("headline", F.coalesce(F.concat(F.lit(" "), "body"), F.lit(""))))
    r = r.withColumns({"h": text.normal_form(F.col("headline")), "n": text.normal_form(F.col("text"))})
    r = r.withColumn("c", text.classify(F.col("n"), F.col("source_type")))
    return r.withColumns({"subtype": F.col("c.subtype"), "class_confidence": F.col("c.confidence")})


def src5(spark, folder):
    r = raw(spark, folder)
    old = r.where(F.col("batch_id") < FIRST_INCOMING_BATCH)
    items = old.where("provider_item_id IS NOT NULL").select("source", "provider_item_id").distinct().withColumn("has_item", F.lit(True))
    hashes = old.select("content_hash").distinct().withColumn("has_hash", F.lit(True))
    new = r.where(F.col("batch_id") >= FIRST_INCOMING_BATCH)
    return new.join(items, ["source", "provider_item_id"], "left").join(hashes, "content_hash", "left").select("news_id", F.coalesce("has_item", F.lit(False)).alias("exists_item"), F.coalesce("has_hash", F.lit(False)).alias("exists_hash"))


def src6(spark, folder):
    return asof.scan_as_of(raw(spark, folder), "process_time", _ts(AS_OF), ["process_time", "news_id"]).select("news_id", "process_time")


def src7(spark, folder):
    m = table(spark, folder, "raw_market_events")
    return m.where((F.col("venue") == "XBRU") & (F.col("sequence_stream_id") == "XBRU-ch0") & F.col("sequence_number").between(3, 40) & (F.col("process_time") <= _ts(AS_OF))).select("event_id", "instrument_id", "sequence_number", "process_time")


def _statuses(spark, folder):
    return news.insert_statuses(raw(spark, folder), F.col("batch_id") >= FIRST_INCOMING_BATCH)


def snk1(spark, folder):
    return _statuses(spark, folder).select("news_id", "status")


def snk3(spark, folder):
    s = _statuses(spark, folder)
    return s.agg(F.count("*").alias("received"), F.count(F.when(F.col("status") == "INSERTED", 1)).alias("inserted"), F.count(F.when(F.col("status") != "INSERTED", 1)).alias("duplicate"))


def snk2(spark, folder):
    m = table(spark, folder, "raw_market_events")
    payload = F.struct(*[c for c in m.columns if c != "event_id"])
    by_id = Window.partitionBy("event_id").orderBy("receive_time", "process_time")
    by_seq = Window.partitionBy("instrument_id", "venue", "sequence_stream_id", "sequence_number").orderBy("receive_time", "process_time", "event_id")
    e = m.withColumns({"nth": F.row_number().over(by_id), "same": F.first(payload).over(by_id).eqNullSafe(payload), "holder": F.first("event_id").over(by_seq)})
    status = F.when((F.col("nth") > 1) & F.col("same"), "DUPLICATE_EVENT").when(F.col("nth") > 1, "CONFLICTING_EVENT_ID").when(F.col("holder") != F.col("event_id"), "CONFLICTING_SEQUENCE").otherwise("INSERTED")
    return e.groupBy("venue", status.alias("status")).agg(F.count("*").alias("n"))


def _revisions(spark, folder):
    return table(spark, folder, "canonical_event_revisions").dropDuplicates(["revision_id"])


def snk5(spark, folder):
    w = Window.partitionBy("event_id").orderBy("revision_number")
    r = _revisions(spark, folder)
    b = r.select("event_id", "revision_number", F.lag("revision_number").over(w).alias("n0"), "available_at", F.lag("available_at").over(w).alias("a0"), "event_type", F.lag("event_type").over(w).alias("t0"), "source_names", F.lag("source_names").over(w).alias("s0"))
    first = F.col("n0").isNull()
    return b.select("event_id", "revision_number", F.coalesce(F.col("revision_number") == F.coalesce("n0", F.lit(0)) + 1, F.lit(False)).alias("next_number"), (first | (F.col("available_at") >= F.col("a0"))).alias("monotonic"), (first | F.col("event_type").eqNullSafe(F.col("t0"))).alias("same_type"), (first | (F.size(F.array_except(F.col("s0"), F.col("source_names"))) == 0)).alias("sources_kept"), (F.size(F.array_except(F.col("source_names"), F.coalesce("s0", F.array().cast("array<string>")))) > 0).alias("source_added"))


def snk5_owners(spark, folder):
    """Messages that more than one event claims; there must be none."""
    return raw(spark, folder).where("event_id IS NOT NULL").groupBy("news_id").agg(F.countDistinct("event_id").alias("n_events"), F.count("*").alias("n_rows")).groupBy((F.col("n_events") == 1).alias("one_event")).agg(F.count("*").alias("n"))


def jn2_listed(spark, folder):
    """As jn2, among the shares of one exchange alone."""
    r = raw(spark, folder).select("news_id", F.explode(text.tickers(F.col("provider_tickers"))).alias("k"))
    i = table(spark, folder, "instruments").where((F.col("exchange") == EXCHANGE) & (F.col("asset_type") == ASSET)).select("instrument_id", F.upper(F.trim("ticker")).alias("k"))
    return asof.resolve(r, i, "k", "instrument_id")


def jn1_normal(spark, folder):
    """As jn1, by the normal form of names."""
    a = table(spark, folder, "entity_aliases").select("alias_id", text.normal_form(F.col("alias")).alias("k"))
    names = _names(spark, folder).select("entity_id", F.col("name").alias("k"))
    return asof.resolve(a, names, "k", "entity_id").select("alias_id", "status", "entity_id")


def val1(spark, folder):
    late = F.col("receive_time") < F.col("event_time")
    return raw(spark, folder).groupBy("source").agg(F.count(F.when(late, 1)).alias("n_before_event"), F.count(F.when(F.col("process_time") < F.col("receive_time"), 1)).alias("n_before_receipt"))


def val2(spark, folder):
    m = table(spark, folder, "raw_market_events")
    a = F.col("book_action")
    reset = a == "RESET"
    error = (
        F.when((F.col("event_kind") == "BOOK") & reset & (F.col("book_side").isNotNull() | F.col("price").isNotNull() | F.col("quantity").isNotNull()), "RESET_WITH_FIELDS")
        .when((F.col("event_kind") == "BOOK") & ~reset & (F.col("book_side").isNull() | F.col("price").isNull()), "NO_SIDE_OR_PRICE")
        .when((F.col("event_kind") == "BOOK") & a.isin("ADD", "MODIFY", "CANCEL", "EXECUTE") & (F.coalesce(F.col("quantity"), F.lit(0)) <= 0), "NO_QUANTITY")
        .when((F.col("event_kind") == "BOOK") & (a == "DELETE") & F.col("quantity").isNotNull(), "DELETE_WITH_QUANTITY")
        .when((F.col("event_kind") == "BOOK") & (a != "EXECUTE") & F.col("trade_id").isNotNull(), "TRADE_ID_WITHOUT_EXECUTE")
        .when((F.col("event_kind") == "QUOTE") & (F.col("best_bid_price") > F.col("best_ask_price")), "CROSSED_QUOTE")
        .otherwise("OK")
    )
    return m.groupBy("event_kind", error.alias("finding")).agg(F.count("*").alias("n"))


def val3(spark, folder):
    e = raw(spark, folder)
    return e.groupBy("source_type").agg(F.count(F.when(F.trim("headline") == "", 1)).alias("n_blank"), F.count(F.when(~F.col("source_type").isin(*t.CREDIBILITY), 1)).alias("n_unknown_type"), F.count(F.when(F.length("content_hash") != 64, 1)).alias("n_bad_hash"))


def val4(spark, folder):
    return raw(spark, folder).select("news_id", text.tickers(F.col("provider_tickers")).alias("tickers"))


def val5(spark, folder):
    m = table(spark, folder, "raw_market_events").where("event_kind = 'TRADE'")
    i = table(spark, folder, "instruments").select("instrument_id", F.col("tick_size").cast("decimal(20,6)").alias("tick"))
    off = F.col("tick").isNotNull() & (F.col("price") % F.col("tick") != 0)
    return m.join(i, "instrument_id").groupBy("instrument_id").agg(F.count("*").alias("n"), F.count(F.when(off, 1)).alias("n_off_tick"))


def flt1(spark, folder):
    links = table(spark, folder, "entity_instrument_links").dropDuplicates(["link_id", "valid_from", "valid_to"])
    return links.where(asof.valid_at(F.col("valid_from"), F.col("valid_to"), _ts(AS_OF))).groupBy("entity_id").agg(F.count("*").alias("n_links"), F.round(F.max("confidence"), 6).alias("best"))


def flt2(spark, folder):
    m = table(spark, folder, "raw_market_events")
    start, end = _ts("2023-01-05 00:00:00"), _ts("2023-01-08 00:00:00")
    w = Window.partitionBy("instrument_id").orderBy(F.desc("exchange_time"), F.desc("event_id"), F.desc("receive_time"))
    warm = m.where(F.col("exchange_time") < start).withColumn("nth", F.row_number().over(w)).where("nth <= 5").drop("nth").withColumn("part", F.lit("WARM_UP"))
    inside = m.where((F.col("exchange_time") >= start) & (F.col("exchange_time") < end)).withColumn("part", F.lit("RESEARCH"))
    return warm.unionByName(inside).groupBy("instrument_id", "part").agg(F.count("*").alias("n"), F.min("exchange_time").alias("first"))


def jn1(spark, folder):
    a = table(spark, folder, "entity_aliases").select("alias_id", F.lower(F.trim("alias")).alias("k"))
    e = table(spark, folder, "entities")
    names = e.select("entity_id", F.lower("canonical_name").alias("k")).unionByName(e.select("entity_id", F.explode("aliases").alias("k")).withColumn("k", F.lower("k")))
    return asof.resolve(a, names, "k", "entity_id").select("alias_id", "status", "entity_id")


def jn2(spark, folder):
    r = raw(spark, folder).select("news_id", F.explode(text.tickers(F.col("provider_tickers"))).alias("k"))
    i = table(spark, folder, "instruments").select("instrument_id", F.upper(F.trim("ticker")).alias("k"))
    return asof.resolve(r, i, "k", "instrument_id")


def jn3(spark, folder):
    r = raw(spark, folder).where("entity_id IS NOT NULL").select("entity_id", F.to_date("process_time").alias("day")).distinct().withColumn("at", F.col("day").cast("timestamp"))
    links = table(spark, folder, "entity_instrument_links").dropDuplicates(["link_id", "valid_from", "valid_to"])
    j = r.join(links, "entity_id").where(asof.valid_at(F.col("valid_from"), F.col("valid_to"), F.col("at")))
    return j.groupBy("day").agg(F.count("*").alias("n_links"), F.countDistinct("instrument_id").alias("n_instruments"))


def jn3_each(spark, folder):
    """As jn3, but each message is matched to the links at its own time, and the day only sums up: links and instruments by message, then by day."""
    r = raw(spark, folder).select("news_id", "entity_id", "process_time")
    links = table(spark, folder, "entity_instrument_links")
    valid = known_at.validity_history(links.withColumn("link", F.struct("link_id", "instrument_id")), "entity_id", "link", "valid_from", "valid_to")
    hits = known_at.match_known(r, "news_id", "entity_id", "process_time", valid).join(r.select("news_id", F.to_date("process_time").alias("day")), "news_id")
    return hits.groupBy("day").agg(F.count("*").alias("n_links"), F.countDistinct("news_id").alias("n_messages"), F.countDistinct("value.instrument_id").alias("n_instruments"))


def jn7(spark, folder):
    w = Window.partitionBy("event_id").orderBy("revision_number")
    r = _revisions(spark, folder).withColumns({"before": F.lag("revision_id").over(w), "new_sources": F.size(F.array_except("source_names", F.coalesce(F.lag("source_names").over(w), F.array().cast("array<string>"))))})
    return r.select("revision_id", "before", "new_sources")


def jn5(spark, folder):
    """The events with a revision in the 36 h before each message that names its source."""
    items = raw(spark, folder).select("news_id", "source", F.unix_micros("process_time").alias("at"), F.col("event_id").alias("own"))
    r = _revisions(spark, folder).select("event_id", F.unix_micros("available_at").alias("at"), F.explode(F.array_distinct("source_names")).alias("source"))
    return news.candidates(items, r, news.HORIZON_S * 1_000_000)


def wn1(spark, folder):
    return asof.latest_as_of(_revisions(spark, folder), ["event_id"], ["available_at", "revision_number", "revision_id"], "available_at", _ts(AS_OF)).select("event_id", "revision_id", "revision_number", "event_state")


def flt3(spark, folder):
    latest = asof.latest_as_of(_revisions(spark, folder), ["event_id"], ["available_at", "revision_number", "revision_id"], "available_at", _ts(AS_OF))
    d = news.decay((F.unix_micros(_ts(AS_OF)) - F.unix_micros("available_at")) / 1e6, news.tau_hours(F.col("event_subtype")) * 3600)
    return latest.withColumn("decay", F.round(d, 8)).where("event_state <> 'RETRACTED' AND decay >= 0.01").select("event_id", "decay")


def ag5(spark, folder):
    at, p = F.unix_micros(_ts(AS_OF)), F.unix_micros("process_time")
    m = 60_000_000

    def window(low, high):
        return F.countDistinct(F.when((p > at - low * m) & (p <= at - high * m), F.col("content_hash")))

    f = raw(spark, folder).groupBy("source").agg(window(24 * 60, 0).alias("volume"), window(15, 0).alias("recent"), window(75, 15).alias("prior"))
    return f.withColumn("acceleration", F.col("recent") * 4.0 - F.col("prior"))


def ag8(spark, folder):
    r = raw(spark, folder).where("event_id IS NOT NULL")
    return news.independent_sources(r, "event_id")


def ag1(spark, folder):
    r = news.independent_sources(raw(spark, folder).where("event_id IS NOT NULL"), "event_id")
    return r.groupBy("event_id").agg(F.round(1 - F.product(1 - F.col("credibility")), 8).alias("credibility"))


def ag2(spark, folder):
    links = table(spark, folder, "entity_instrument_links")
    weight = F.when(F.col("relationship_type") == "PRIMARY_EQUITY", 2.0).otherwise(1.0)
    return links.groupBy("entity_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("confidence") * weight), F.sum(weight)), F.lit(0.0)), 8).alias("confidence"))


def st(spark, folder):
    w = Window.partitionBy("event_id").orderBy("revision_number")
    before = F.coalesce(F.lag("source_names").over(w), F.array().cast("array<string>"))
    r = _revisions(spark, folder).withColumn("s0", before)
    return r.select("revision_id", F.round(text.jaccard(F.col("source_names"), F.col("s0")), 8).alias("jaccard"), F.array_distinct(F.concat("s0", "source_names")).alias("united"), F.round(text.new_fraction(F.col("source_names"), F.col("s0")), 8).alias("new_fraction"))


def fn1(spark, folder):
    return normed(spark, folder).select("news_id", F.col("h").alias("normal"))


def fn2(spark, folder):
    return normed(spark, folder).select("news_id", text.tokens(F.col("h")).alias("tokens"))


def fn3(spark, folder):
    return raw(spark, folder).select("news_id", text.anchors(F.col("provider_tickers"), F.concat("headline", F.coalesce(F.concat(F.lit(" "), "body"), F.lit("")))).alias("anchors"))


def fn4(spark, folder):
    return normed(spark, folder).select("news_id", "subtype", F.col("class_confidence").alias("confidence"))


def fn5(spark, folder):
    return raw(spark, folder).select("news_id", identity.content_hash(F.col("source"), F.col("headline"), F.col("body"), F.col("url"), F.col("event_time")).alias("hash"))


def fn6(spark, folder):
    return normed(spark, folder).select("news_id", text.direction(F.col("subtype"), F.col("h")).alias("direction"))


def fn7(spark, folder):
    i = table(spark, folder, "instruments")
    return i.select("instrument_id", F.upper(F.trim("ticker")).alias("ticker_key"), F.regexp_replace(F.lower("ticker"), "[^a-z0-9]", "").alias("comparison_key"))


def fn8(spark, folder):
    r = raw(spark, folder)
    return r.select("news_id", market.elapsed_seconds(F.col("event_time"), F.col("receive_time")).alias("delay_s"), market.elapsed_seconds(F.col("process_time"), F.col("event_time"), True).alias("signed_s"))


def fn9(spark, folder):
    r = _revisions(spark, folder)
    s = (F.unix_micros(_ts(AS_OF)) - F.unix_micros("available_at")) / 1e6
    return r.select("revision_id", F.round(news.decay(s, news.tau_hours(F.col("event_subtype")) * 3600), 8).alias("decay"), F.round(F.greatest(F.lit(0.0), 1 - F.abs(s) / news.HORIZON_S), 8).alias("proximity"))


def fn16(spark, folder):
    """Intensity, risk and novelty of each instrument's events in force at a time, from all their factors."""
    e = _in_force(spark, folder)
    return e.select("instrument_id", "event_id", *[F.round(c, 8).alias(c) for c in ("intensity", "signed", "risk", "newness")])


def fn29(spark, folder):
    return raw(spark, folder).select("news_id", identity.uuid5(NAMESPACE, F.concat_ws("|", "source", "news_id")).alias("uuid"))


def nw1(spark, folder):
    """Similarity of each message to the one before it in its event."""
    w = Window.partitionBy("event_id").orderBy("process_time", "news_id")
    r = normed(spark, folder).where("event_id IS NOT NULL").select("event_id", "news_id", "process_time", "subtype", text.tokens(F.col("h")).alias("tokens"), text.anchors(F.col("provider_tickers"), F.col("text")).alias("anchors"))
    r = r.withColumns({"t0": F.lag("tokens").over(w), "a0": F.lag("anchors").over(w), "p0": F.lag("process_time").over(w), "s0": F.lag("subtype").over(w)}).where("p0 IS NOT NULL")
    age = (F.unix_micros("process_time") - F.unix_micros("p0")) / 1e6
    same = F.col("subtype") == F.col("s0")
    shared = F.size(F.array_intersect("anchors", "a0")) > 0
    guarded = ~same | (age > news.HORIZON_S) | (F.col("subtype").startswith("COMPANY.") & ~shared)
    score = 0.55 * text.jaccard(F.col("tokens"), F.col("t0")) + 0.25 * text.jaccard(F.col("anchors"), F.col("a0")) + 0.1 * F.greatest(F.lit(0.0), 1 - age / news.HORIZON_S) + F.when(same, 0.1).otherwise(0.0)
    return r.select("news_id", F.round(F.when(guarded, 0.0).otherwise(score), 6).alias("similarity"))


def nw2(spark, folder):
    r = normed(spark, folder).select("news_id", "subtype", "process_time", text.tokens(F.col("h")).alias("tokens"), text.anchors(F.col("provider_tickers"), F.col("text")).alias("anchors"), "source", news.official(F.col("source_type"), news.event_type(F.col("subtype"))).alias("confirms"))
    return news.cluster(r)


def nw4(spark, folder):
    """The entity a message names first by tier: the provider's ticker, the provider's entity, a name in capitals in the text."""
    r = raw(spark, folder)
    i = table(spark, folder, "instruments").select(F.upper("ticker").alias("k"), F.col("instrument_id").alias("target"))
    e = table(spark, folder, "entities").select(F.lower("canonical_name").alias("k"), F.col("entity_id").alias("target"))
    one = r.select("news_id", F.posexplode(text.tickers(F.col("provider_tickers"))).alias("place", "k")).join(i, "k").select("news_id", "target", F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"), "place")
    two = r.select("news_id", F.posexplode(F.col("provider_entities")).alias("place", "k")).withColumn("k", F.lower(F.trim("k"))).join(e, "k").select("news_id", "target", F.lit(2).alias("tier"), F.lit(0.95).alias("confidence"), "place")
    words = F.array_distinct(F.regexp_extract_all("headline", F.lit(r"\b[A-Z][A-Z0-9.-]{1,7}\b"), F.lit(0)))
    six = r.select("news_id", F.posexplode(words).alias("place", "k")).join(i, "k").select("news_id", "target", F.lit(6).alias("tier"), F.lit(0.8).alias("confidence"), "place")
    every = one.unionByName(two).unionByName(six)
    w = Window.partitionBy("news_id", "target").orderBy("tier", F.desc("confidence"), "place")
    ranked = every.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    primary = F.row_number().over(Window.partitionBy("news_id").orderBy("tier", "place", "target")) == 1
    return ranked.select("news_id", "target", "tier", "confidence", ((F.col("tier") == 1) | primary).alias("is_primary"))


def _graph(spark, folder):
    n, s = table(spark, folder, "nation"), table(spark, folder, "supplier")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"), F.lit(0.8).alias("magnitude"), F.lit(0.9).alias("confidence"))
    home = s.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"), (F.lit(0.5) + (F.col("s_suppkey") % 5) / 10.0).alias("magnitude"), F.lit(0.9).alias("confidence"))
    rivals = n.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("b"), F.lit(0.3).alias("magnitude"), F.lit(0.7).alias("confidence"))
    reverse = up.unionByName(home).select(F.col("b").alias("src"), F.col("a").alias("dst"), "magnitude", "confidence")
    both = rivals.select(F.col("a").alias("src"), F.col("b").alias("dst"), "magnitude", "confidence").unionByName(rivals.select(F.col("b").alias("src"), F.col("a").alias("dst"), "magnitude", "confidence"))
    return reverse.unionByName(both)


def _paths(spark, folder):
    starts = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"), F.lit(1.0).alias("magnitude"), F.lit(1.0).alias("confidence"))
    return news.traverse(starts, _graph(spark, folder), 3)


def nw5(spark, folder):
    return _paths(spark, folder).select("start", F.concat_ws(">", "nodes").alias("path"), F.round("magnitude", 8).alias("magnitude"), F.round("confidence", 8).alias("confidence"), "depth")


def nw6(spark, folder):
    p = _paths(spark, folder).select(identity.uuid5(NAMESPACE, F.concat_ws("|", "start", F.concat_ws("|", "nodes"))).alias("path_id"))
    return p.unionByName(p).dropDuplicates(["path_id"])


def ag3(spark, folder):
    p = _paths(spark, folder).where("node LIKE 's%'").select(F.col("node"), F.when(F.col("start") == "r1", -1.0).otherwise(1.0).alias("sign"), "magnitude", "confidence", F.pow(F.lit(0.8), "depth").alias("relevance"), F.concat_ws(">", "nodes").alias("path_id"))
    out = news.materialise(p, "node")
    return out.withColumns({c: F.round(c, 8) for c in ("magnitude", "confidence", "relevance")})


def tk4(spark, folder):
    p = _paths(spark, folder).where("node LIKE 's%'").withColumn("path", F.concat_ws(">", "nodes"))
    w = Window.partitionBy("node").orderBy((F.col("depth") > 2).cast("int"), F.desc(F.round("magnitude", 10)), F.desc(F.round("confidence", 10)), "path")
    return p.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("node", "path")


def nw9(spark, folder):
    r = _revisions(spark, folder)
    return r.select("revision_id", news.tau_hours(F.col("event_subtype")).alias("tau_hours"), news.severity(F.col("event_subtype")).alias("prior"))


def _messages(spark, folder):
    r = normed(spark, folder).where("event_id IS NOT NULL")
    return r.select("event_id", "news_id", "process_time", "source", "source_type", "entity_id", "provider_tickers", "provider_entities", text.tokens(F.col("h")).alias("tokens"), "class_confidence", text.direction(F.col("subtype"), F.col("h")).alias("direction"))


def _scored(spark, folder):
    """The scores of all revisions and the exposures they had when they became available."""
    revisions, messages = _revisions(spark, folder), cut_lineage(_messages(spark, folder))
    exposed = cut_lineage(scores.exposures(scores.with_previous(revisions), messages, table(spark, folder, "entity_instrument_links")))
    return scores.scores(scores.evidence(revisions, messages, exposed)), exposed, messages


def _in_force(spark, folder):
    scored, exposed, _ = _scored(spark, folder)
    return scores.active(scored, exposed, _ts(AS_OF))


def nw10(spark, folder):
    """The state of each instrument at a time, from the events in force then."""
    scored, exposed, messages = _scored(spark, folder)
    live = cut_lineage(scores.active(scored, exposed, _ts(AS_OF)))
    out = scores.states(live).join(scores.flow(live, messages, _ts(AS_OF)), "instrument_id", "left").withColumns({"volume": F.coalesce("volume", F.lit(0)), "acceleration": F.coalesce("acceleration", F.lit(0.0))})
    return out.select("instrument_id", "n_events", "n_direct", "n_indirect", "volume", "acceleration", *[F.round(c, 6).alias(c) for c in ("positive_intensity", "negative_intensity", *(f"{b}_risk" for b in scores.RISK_NAMES), "novelty_intensity", "uncertainty", "confidence")])


def jn4(spark, folder):
    """Relations out of and into each node, as valid at a time."""
    links = table(spark, folder, "entity_instrument_links").where(asof.valid_at(F.col("valid_from"), F.col("valid_to"), _ts(AS_OF))).select("link_id", "entity_id", "instrument_id").distinct()
    out = links.select(F.col("entity_id").alias("node"), F.lit("OUT").alias("way"))
    return out.unionByName(links.select(F.col("instrument_id").alias("node"), F.lit("IN").alias("way"))).groupBy("node", "way").agg(F.count("*").alias("n"))


def jn6(spark, folder):
    """Of each event the latest revision known at a time, with the exposures that revision had when it became available."""
    latest = asof.latest_as_of(_revisions(spark, folder), ["event_id"], ["available_at", "revision_number", "revision_id"], "available_at", _ts(AS_OF)).select("event_id", "revision_id")
    exposed = scores.exposures(scores.with_previous(_revisions(spark, folder)), _messages(spark, folder), table(spark, folder, "entity_instrument_links"))
    return latest.join(exposed, "revision_id").select("instrument_id", "event_id", "revision_id", "is_direct", F.round("confidence", 8).alias("confidence"))


def jn13(spark, folder):
    texts = normed(spark, folder).select("news_id", "n")
    names = table(spark, folder, "entities").select("entity_id", text.normal_form(F.col("canonical_name")).alias("name"))
    return news.mentions(texts, "news_id", "n", names, "entity_id", "name")


def fn20(spark, folder):
    r = _revisions(spark, folder).select("revision_id", "event_type", F.explode(F.array(*[F.lit(x[0]) for x in t.POLICIES])).alias("relation"))
    return r.select("revision_id", "relation", (news.policy_direction(F.col("relation"), F.col("event_type"), F.lit(-1.0)) * 0.5).alias("exposure"))


def nw7(spark, folder):
    """Revisions that a run up to then has not processed."""
    r = _revisions(spark, folder)
    return r.join(r.where(F.col("available_at") <= _ts(AS_OF)).select("revision_id"), "revision_id", "left_anti").select("revision_id")


def nw8(spark, folder):
    """All scores of each revision with the parts they are made of."""
    s, _, _ = _scored(spark, folder)
    parts = dict.fromkeys(("credibility", "sentiment", "severity", "novelty", "confidence", "uncertainty", *scores.NOVELTY, *scores.CONFIDENCE, *scores.UNCERTAINTY))
    return s.select("revision_id", *[F.round(F.col(c).cast("double"), 8).alias(c) for c in parts])


def _names(spark, folder):
    """(name, entity_id, canonical) of all names and official short names, in normal form."""
    e = table(spark, folder, "entities")
    every = e.select("entity_id", F.col("canonical_name").alias("typed"), F.lit(True).alias("canonical")).unionByName(e.select("entity_id", F.explode("aliases").alias("typed"), F.lit(False).alias("canonical")))
    return every.select("entity_id", text.normal_form(F.col("typed")).alias("name"), "canonical").where("name <> ''")


def jn13_short(spark, folder):
    """As jn13, with the official short names."""
    return news.mentions(normed(spark, folder).select("news_id", "n"), "news_id", "n", _names(spark, folder), "entity_id", "name")


def nw4_tiers(spark, folder):
    """As nw4, but by entity and with the names in the text: provider's ticker, provider's entity, name in the text, short name in the text, ticker in headline or body.

    A ticker means the one entity its instrument belongs to at the message's time. What means several means none. Of an
    entity's links the first tier stays; primary are all provider tickers, or else the first link of the message. The
    tier of context phrases (3) needs sectors and countries of events, which no table holds.
    """
    r = cut_lineage(normed(spark, folder).select("news_id", "process_time", "text", "n", "provider_tickers", "provider_entities"))
    instruments = table(spark, folder, "instruments").groupBy(F.upper(F.trim("ticker")).alias("k")).agg(F.countDistinct("instrument_id").alias("n_"), F.min("instrument_id").alias("instrument_id")).where("n_ = 1").drop("n_")
    owned = known_at.validity_history(table(spark, folder, "entity_instrument_links"), "instrument_id", "entity_id", "valid_from", "valid_to")
    names = cut_lineage(_names(spark, folder).groupBy("name").agg(F.countDistinct("entity_id").alias("n_"), F.min("entity_id").alias("target"), F.max("canonical").alias("canonical")).where("n_ = 1").drop("n_"))
    bare = lambda c: F.replace(text.normal_form(F.col(c)), F.lit(" "), F.lit(""))

    def owners(typed, tier, confidence):
        seen = typed.groupBy("news_id", "k").agg(F.min("place").alias("place"), F.first("process_time").alias("process_time"))
        seen = seen.join(instruments, "k").withColumn("look", F.concat_ws("|", "news_id", "k"))
        one = known_at.match_known(seen, "look", "instrument_id", "process_time", owned).groupBy("look").agg(F.countDistinct("value").alias("n_"), F.min("value").alias("target")).where("n_ = 1")
        return seen.join(one, "look").select("news_id", "target", F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"), F.struct(F.lit(tier).alias("step"), F.col("place").cast("int").alias("place"), F.lit("").alias("name")).alias("turn"), bare("k").alias("matched"))

    one = owners(r.select("news_id", "process_time", F.posexplode(text.tickers(F.col("provider_tickers"))).alias("place", "k")), 1, 1.0)
    two = r.select("news_id", F.posexplode("provider_entities").alias("place", "k")).withColumn("name", text.normal_form(F.col("k"))).join(names, "name")
    two = two.select("news_id", "target", F.lit(2).alias("tier"), F.lit(0.95).alias("confidence"), F.struct(F.lit(2).alias("step"), F.col("place").cast("int").alias("place"), F.lit("").alias("name")).alias("turn"), bare("k").alias("matched"))
    spoken = news.mentions(r, "news_id", "n", names.withColumn("key", F.col("name")), "key", "name").withColumnRenamed("key", "name").join(names, "name")
    spoken = spoken.select("news_id", "target", F.when(F.col("canonical"), 4).otherwise(5).alias("tier"), F.when(F.col("canonical"), 0.9).otherwise(0.85).alias("confidence"), F.struct(F.lit(4).alias("step"), (-F.size(F.split("name", " "))).alias("place"), "name").alias("turn"), bare("name").alias("matched"))
    first = Window.partitionBy("news_id", "target").orderBy("tier", F.desc("confidence"), "turn")
    named = cut_lineage(one.unionByName(two).unionByName(spoken))
    taken = named.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("news_id", "matched").unionByName(r.select("news_id", F.explode(text.tickers(F.col("provider_tickers"))).alias("k")).select("news_id", bare("k").alias("matched")))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][A-Z0-9.-]{1,7}\b"), F.lit(0)))
    six = owners(r.select("news_id", "process_time", F.posexplode(words).alias("place", "k")).withColumn("matched", bare("k")).join(taken, ["news_id", "matched"], "left_anti"), 6, 0.8)
    ordered = named.unionByName(six).withColumn("turn_", F.row_number().over(Window.partitionBy("news_id").orderBy("turn", "target")))
    ranked = ordered.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return ranked.select("news_id", "target", "tier", "confidence", ((F.col("tier") == 1) | (F.col("turn_") == 1)).alias("is_primary"))


QUERIES = {
    "snk5_owners": snk5_owners, "jn2_listed": jn2_listed, "jn1_normal_form": jn1_normal, "jn3_links_at_messages": jn3_each, "jn13_mentions_short": jn13_short, "nw4_entity_tiers": nw4_tiers, "jn4_relations": jn4, "jn6_exposed": jn6, "jn13_mentions": jn13, "fn20_prj2_direction": fn20, "nw7_unprocessed": nw7, "nw8_scores": nw8,
    "src5_exists": src5, "src6_scan_as_of": src6, "src7_stream_scan": src7, "snk1_insert_status": snk1, "snk2_market_status": snk2, "snk3_summary": snk3, "snk5_invariants": snk5,
    "val1_causality": val1, "val2_shape": val2, "val3_ranges": val3, "val4_tickers": val4, "val5_tick": val5, "flt1_valid_links": flt1, "flt2_scope": flt2, "flt3_active": flt3,
    "jn1_alias": jn1, "jn2_ticker": jn2, "jn3_links_as_of": jn3, "jn5_candidates": jn5, "jn7_previous": jn7, "wn1_latest": wn1, "ag1_noisy_or": ag1, "ag2_weighted_mean": ag2, "ag3_exposure": ag3, "ag5_news_flow": ag5, "ag8_sources": ag8,
    "st1_st3_sets": st, "fn1_normal_form": fn1, "fn2_tokens": fn2, "fn3_anchors": fn3, "fn4_classes": fn4, "fn5_content_hash": fn5, "fn6_direction": fn6, "fn7_keys": fn7, "fn8_elapsed": fn8, "fn9_fn10_decay": fn9, "fn16_fn18_intensity": fn16, "fn29_uuid5": fn29,
    "nw1_similarity": nw1, "nw2_nw3_clusters": nw2, "nw4_entity_links": nw4, "nw5_fn19_paths": nw5, "nw6_path_ids": nw6, "tk4_strongest": tk4, "nw9_priors": nw9, "nw10_ag4_state": nw10,
}

# SQL

_AT = f"TIMESTAMPTZ '{AS_OF}+00'"
_REV = "rev AS (SELECT DISTINCT ON (revision_id) * FROM canonical_event_revisions)"


def _norm(x: str) -> str:
    out = f"' ' || trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for phrase, short in t.PHRASES:
        out = f"replace({out}, ' {phrase} ', ' {short} ')"
    return f"trim({out})"


def _has(phrases) -> str:
    def short(p):
        for a, b in t.PHRASES:
            p = f" {p} ".replace(f" {a} ", f" {b} ").strip()
        return p

    return "(" + " OR ".join(f"contains(' ' || n || ' ', ' {short(p)} ')" for p in phrases) + ")"


def _case(rows, default) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows) + f" ELSE {default} END"


_RULES = [(_has(p) + (f" AND {_has(c)}" if c else ""), s, k) for s, p, c, k in t.RULES] + [(f"source_type = '{k}'", s, c) for k, (s, c) in t.FALLBACKS.items()]
NORMED = (
    f"nf AS (SELECT *, {_norm('headline')} AS h, {_norm('text')} AS n FROM (SELECT *, headline || coalesce(' ' || body, '') AS text FROM raw_news)), "
    f"normed AS (SELECT *, {_case([(c, repr(s)) for c, s, _ in _RULES], repr(t.FALLBACK[0]))} AS subtype, {_case([(c, str(k)) for c, _, k in _RULES], t.FALLBACK[1])}::DOUBLE AS confidence FROM nf)"
)


def _lookup(values, key, default="NULL") -> str:
    return _case([(f"{key} = '{k}'", v) for k, v in values.items()], default) + "::DOUBLE"


def _by_subtype(special, general) -> str:
    return f"coalesce({_lookup(special, 'event_subtype')}, {_lookup(general, 'split_part(event_subtype, chr(46), 1)')})"


_TAU = _by_subtype(t.TAU_HOURS_OF, t.TAU_HOURS)
_SEV = _by_subtype(t.SEVERITY_OF, t.SEVERITY)
_AGE = f"(epoch_us({_AT}) - epoch_us(available_at)) / 1e6"
_DECAY = f"CASE WHEN {_AGE} >= 0 THEN exp(-({_AGE}) / ({_TAU} * 3600)) END"
_LATEST = f"latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY available_at DESC, revision_number DESC, revision_id DESC) AS nth FROM rev WHERE available_at <= {_AT}) WHERE nth = 1)"
_VALID = f"(valid_from IS NULL OR valid_from <= {_AT}) AND (valid_to IS NULL OR valid_to > {_AT})"
_TICKERS = "list_distinct_ordered"
_ORDERED_TICKERS = "(SELECT coalesce(list(k ORDER BY p), []) FROM (SELECT k, min(p) AS p FROM (SELECT upper(trim(x)) AS k, p FROM (SELECT unnest({c}) AS x, generate_subscripts({c}, 1) AS p)) WHERE k <> '' GROUP BY k))"
_STATUS = f"""st AS (SELECT *, provider_item_id IS NOT NULL AND row_number() OVER (PARTITION BY source, provider_item_id ORDER BY inc, process_time, news_id) > 1 AS d1, row_number() OVER (PARTITION BY content_hash ORDER BY inc, process_time, news_id) > 1 AS d2
  FROM (SELECT *, batch_id >= {FIRST_INCOMING_BATCH} AS inc FROM raw_news)),
status AS (SELECT *, CASE WHEN d1 THEN 'DUPLICATE_PROVIDER_ITEM' WHEN d2 THEN 'DUPLICATE_CONTENT' ELSE 'INSERTED' END AS status FROM st WHERE inc)"""
_CRED = _lookup(t.CREDIBILITY, "source_type", 0.5)
_IND = f"ind AS (SELECT event_id, source, source_type, credibility FROM (SELECT *, row_number() OVER (PARTITION BY event_id, lower(source) ORDER BY credibility DESC, process_time, news_id) AS nth FROM (SELECT *, {_CRED} AS credibility FROM raw_news WHERE event_id IS NOT NULL)) WHERE nth = 1)"
_TOKENS = "list_sort(list_distinct(list_transform(list_filter(string_split({h}, ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(map(repr, t.STOPWORDS)) + ")), lambda w: " + _case([(f"w = '{k}'", repr(v)) for k, v in t.TOKENS.items()], "w") + ")))"
_ANCHORS = (
    "list_sort(list_distinct(CASE WHEN len(list_filter(provider_tickers, lambda x: trim(x) <> '')) > 0 THEN list_transform(list_filter(provider_tickers, lambda x: trim(x) <> ''), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) "
    "ELSE list_transform(list_filter(regexp_extract_all({x}, '\\b[A-Z][A-Z0-9.-]{{1,7}}\\b'), lambda w: w NOT IN (" + ", ".join(map(repr, t.ACRONYMS)) + ")), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')) END))"
)
_SHA = "substr(sha1(unhex('" + NAMESPACE.replace("-", "") + "') || encode({x})), {a}, {n})"


def _uuid(x: str) -> str:
    d = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({x}))"
    return f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({d}, 17, 1)), 1) || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


_EDGES = """up AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b, 0.8::DOUBLE AS m, 0.9::DOUBLE AS c FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.5::DOUBLE + (s_suppkey % 5) / 10.0::DOUBLE, 0.9 FROM supplier),
rivals AS (SELECT 'n' || n_nationkey AS a, 'n' || ((n_nationkey + 1) % 25) AS b FROM nation),
edges AS (SELECT b AS src, a AS dst, m, c FROM up UNION ALL SELECT a, b, 0.3::DOUBLE, 0.7::DOUBLE FROM rivals UNION ALL SELECT b, a, 0.3::DOUBLE, 0.7::DOUBLE FROM rivals),
paths AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, ['r' || r_regionkey] AS nodes, 1::DOUBLE AS magnitude, 1::DOUBLE AS confidence, 0 AS depth FROM region
  UNION ALL SELECT start, dst, list_append(nodes, dst), magnitude * m * 0.7::DOUBLE, confidence * c, depth + 1 FROM paths JOIN edges ON node = src WHERE depth < 3 AND NOT list_contains(nodes, dst))"""

_UNC = _lookup(t.STATE_UNCERTAINTY, "event_state")
_OFFICIAL = "coalesce(" + " OR ".join(f"(source_type = '{k}' AND event_type IN ({', '.join(map(repr, v))}))" for k, v in t.OFFICIAL.items()) + ", false)"
_DIRECTION = f"CASE WHEN subtype = 'COMPANY.BUYBACK' THEN 1 WHEN subtype = 'COMPANY.DIVIDEND' AND {_has(('suspends dividend', 'suspend dividend', 'cuts dividend', 'cancels dividend')).replace('|| n ||', '|| h ||')} THEN -1 WHEN subtype LIKE 'REGULATORY.%' AND {_has(('rejects', 'rejection', 'denies', 'denied')).replace('|| n ||', '|| h ||')} THEN -1 WHEN subtype = 'REGULATORY.APPROVAL' THEN 1 WHEN subtype = 'GEOPOLITICAL.SANCTION' THEN -1 ELSE 0 END::DOUBLE"
#: Each rule by itself: what a revision knew is what its event's messages said by the time it became available.
_SCORES = f"""WITH {NORMED}, {_REV},
msg AS (SELECT event_id, news_id, process_time, source, source_type, entity_id, provider_tickers, provider_entities, {_TOKENS.format(h='h')} AS tokens, confidence AS classifier, {_DIRECTION} AS direction, {_CRED} AS prior FROM normed WHERE event_id IS NOT NULL),
rp AS (SELECT *, lag(available_at) OVER w AS before_at, lag(event_state) OVER w AS before_state, lag(revision_id) OVER w AS before_id FROM rev WINDOW w AS (PARTITION BY event_id ORDER BY revision_number, revision_id)),
said AS (SELECT r.revision_id, r.event_type, r.available_at, coalesce(m.process_time <= r.before_at, false) AS old, m.* FROM rp r JOIN msg m ON m.event_id = r.event_id AND m.process_time <= r.available_at),
src AS (SELECT revision_id, lower(source) AS name, max(prior) AS prior, bool_or(old) AS old, arg_max(source_type, prior) AS kind, bool_or({_OFFICIAL}) AS official, bool_or({_OFFICIAL} AND old) AS official_before FROM said GROUP BY ALL),
srcs AS (SELECT revision_id, count(*) AS n, count(*) FILTER (NOT old) AS fresh, 1 - product(1 - prior) AS credibility, max(prior) - min(prior) AS dispersion, bool_and(coalesce(kind = 'SPECULATIVE', false)) AS speculative, bool_or(official) AS official, bool_or(official_before) AS official_before FROM src GROUP BY revision_id),
ent AS (SELECT revision_id, entity_id, any_value(available_at) AS available_at, bool_or(old) AS old FROM said WHERE entity_id IS NOT NULL GROUP BY revision_id, entity_id),
ents AS (SELECT revision_id, count(*) AS n, count(*) FILTER (NOT old) AS fresh FROM ent GROUP BY revision_id),
terms AS (SELECT revision_id, count(DISTINCT term) AS n FROM (SELECT revision_id, unnest(list_concat(list_transform(coalesce(provider_tickers, []), lambda x: 't:' || lower(x)), list_transform(coalesce(provider_entities, []), lambda x: 'e:' || lower(x)))) AS term FROM said) GROUP BY revision_id),
expo AS (SELECT revision_id, instrument_id, bool_or(direct) AS is_direct, arg_max(confidence, CASE WHEN direct THEN 10 ELSE 0 END + confidence) AS confidence FROM (SELECT e.revision_id, l.instrument_id, coalesce(l.relationship_type = 'PRIMARY_EQUITY', false) AS direct, l.confidence FROM ent e JOIN entity_instrument_links l USING (entity_id) WHERE (valid_from IS NULL OR valid_from <= available_at) AND (valid_to IS NULL OR valid_to > available_at)) GROUP BY revision_id, instrument_id),
ins AS (SELECT revision_id, list(DISTINCT instrument_id) AS instruments, avg(confidence) AS exposure_confidence FROM expo GROUP BY revision_id),
head AS (SELECT revision_id, arg_max(struct_pack(t := tokens, c := classifier, d := direction), struct_pack(p := process_time, n := news_id)) AS x FROM said GROUP BY revision_id),
a0 AS (SELECT rp.*, coalesce(srcs.n, 0) AS n_sources, coalesce(srcs.fresh, 0) AS n_fresh, coalesce(credibility, 0) AS credibility, coalesce(dispersion, 0) AS dispersion, coalesce(speculative::INT, 0) AS speculative_only, coalesce(official, false) AND event_state = 'CONFIRMED' AS conf, coalesce(official_before, false) AND coalesce(before_state, '') = 'CONFIRMED' AS conf0,
  coalesce(ents.n, 0) AS n_entities, coalesce(ents.fresh, 0) AS n_new_entities, coalesce(terms.n, 0) AS n_terms, coalesce(instruments, []) AS ins, coalesce(exposure_confidence, 0) AS exposure_confidence, coalesce(x.t, []) AS tok, coalesce(x.c, 0) AS classifier, coalesce(x.d, 0) AS sentiment
  FROM rp LEFT JOIN srcs USING (revision_id) LEFT JOIN ents USING (revision_id) LEFT JOIN terms USING (revision_id) LEFT JOIN ins USING (revision_id) LEFT JOIN head USING (revision_id)),
a1 AS (SELECT *, coalesce(lag(ins) OVER w, []) AS ins0, coalesce(lag(tok) OVER w, []) AS tok0 FROM a0 WINDOW w AS (PARTITION BY event_id ORDER BY revision_number, revision_id)),
a2 AS (SELECT * REPLACE (coalesce(severity, {_SEV}) AS severity), coalesce(1 - len(list_intersect(tok, tok0)) / nullif(len(list_distinct(list_concat(tok, tok0))), 0), 0) AS token_change, n_fresh / greatest(n_sources, 1) AS new_sources, n_new_entities / greatest(n_entities, 1) AS new_entities, len(list_filter(ins, lambda x: NOT list_contains(ins0, x))) / greatest(len(ins), 1) AS new_instruments,
  (conf AND NOT conf0)::INT AS new_confirmation, conf::INT AS confirmed, (NOT conf)::INT AS unconfirmed, least(greatest(n_sources - 1, 0) / 2.0::DOUBLE, 1) AS corroboration, CASE WHEN n_entities > 0 THEN 0.95::DOUBLE ELSE 0 END AS entity_confidence, {_UNC} AS state_uncertainty,
  CASE WHEN n_terms = 0 THEN 0 ELSE 1 - least(n_entities / n_terms, 1) END AS unresolved, CASE WHEN n_entities > 0 THEN 1 - 0.95::DOUBLE WHEN n_terms > 0 THEN 1 ELSE 0 END AS entity_deficit, 0 AS direction_conflict FROM a1),
scored AS (SELECT *, CASE WHEN before_id IS NULL THEN 1 ELSE 0.4::DOUBLE * token_change + 0.1::DOUBLE * new_sources + 0.15::DOUBLE * new_entities + 0.15::DOUBLE * new_instruments + 0.2::DOUBLE * new_confirmation END AS novelty,
  0.3::DOUBLE * credibility + 0.15::DOUBLE * corroboration + 0.2::DOUBLE * classifier + 0.15::DOUBLE * entity_confidence + 0.15::DOUBLE * exposure_confidence + 0.05::DOUBLE * confirmed AS confidence,
  1 - (1 - 0.35::DOUBLE * state_uncertainty) * (1 - 0.15::DOUBLE * dispersion) * (1 - 0.25::DOUBLE * speculative_only) * (1 - 0.15::DOUBLE * unconfirmed) * (1 - 0.2::DOUBLE * unresolved) * (1 - 0.1::DOUBLE * entity_deficit) AS uncertainty FROM a2)"""
_FORCE = _SCORES + f""",
live AS (SELECT *, {_DECAY} AS decay FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY available_at DESC, revision_number DESC, revision_id DESC) AS nth FROM scored WHERE available_at <= {_AT}) WHERE nth = 1 AND event_state <> 'RETRACTED'),
f0 AS (SELECT live.*, instrument_id, is_direct, CASE WHEN is_direct THEN 1 ELSE 0.7::DOUBLE END AS mag, CASE WHEN is_direct THEN 1 ELSE 0.8::DOUBLE END AS rel FROM live JOIN expo USING (revision_id) WHERE decay >= 0.01),
force AS (SELECT *, mag * rel * severity * novelty * credibility * confidence * decay AS intensity, mag * rel * severity * decay * (0.5::DOUBLE + 0.25::DOUBLE * credibility + 0.25::DOUBLE * confidence) * (0.5::DOUBLE + 0.5::DOUBLE * uncertainty) AS risk, novelty * mag * rel * decay AS newness, mag * rel * decay AS weight,
  CASE WHEN event_type = 'COMPANY' THEN 'company' WHEN event_type = 'SECTOR' THEN 'sector' WHEN event_type IN ('MACRO', 'RATE', 'CURRENCY', 'COMMODITY') THEN 'macro' WHEN event_type = 'GEOPOLITICAL' THEN 'geopolitical' WHEN event_type = 'REGULATORY' THEN 'regulatory' ELSE 'systemic' END AS bucket FROM f0)"""
ORACLE = {
    "jn4_relations": f"WITH l AS (SELECT DISTINCT link_id, entity_id, instrument_id FROM entity_instrument_links WHERE {_VALID}) SELECT node, way, count(*) AS n FROM (SELECT entity_id AS node, 'OUT' AS way FROM l UNION ALL SELECT instrument_id, 'IN' FROM l) GROUP BY ALL",
    "jn6_exposed": _SCORES + f" SELECT instrument_id, event_id, revision_id, is_direct, round(expo.confidence, 8) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY available_at DESC, revision_number DESC, revision_id DESC) AS nth FROM rev WHERE available_at <= {_AT}) l JOIN expo USING (revision_id) WHERE nth = 1",
    "jn13_mentions": f"WITH {NORMED}, e AS (SELECT entity_id, {_norm('canonical_name')} AS k FROM entities) SELECT news_id, e.entity_id FROM nf JOIN e ON contains(' ' || n || ' ', ' ' || k || ' ') WHERE k <> ''",
    "fn20_prj2_direction": f"WITH {_REV}, p AS (SELECT unnest([" + ", ".join(f"{{'r': '{r}', 'd': '{d}', 'k': '{k[0] if k else ''}'}}" for r, _, d, k in t.POLICIES) + "]) AS p) SELECT revision_id, p.r AS relation, CASE WHEN p.d = 'PRESERVE' AND (p.k = '' OR p.k = event_type) THEN -0.5 ELSE 0 END::DOUBLE AS exposure FROM rev CROSS JOIN p",
    "nw7_unprocessed": f"WITH {_REV} SELECT revision_id FROM rev WHERE NOT available_at <= {_AT}",
    "nw8_scores": _SCORES + " SELECT revision_id, " + ", ".join(f"round({c}::DOUBLE, 8) AS {c}" for c in dict.fromkeys(("credibility", "sentiment", "severity", "novelty", "confidence", "uncertainty", *scores.NOVELTY, *scores.CONFIDENCE, *scores.UNCERTAINTY))) + " FROM scored",
    "src5_exists": f"SELECT news_id, EXISTS (SELECT 1 FROM raw_news o WHERE o.batch_id < {FIRST_INCOMING_BATCH} AND o.source = r.source AND o.provider_item_id = r.provider_item_id) AS exists_item, EXISTS (SELECT 1 FROM raw_news o WHERE o.batch_id < {FIRST_INCOMING_BATCH} AND o.content_hash = r.content_hash) AS exists_hash FROM raw_news r WHERE batch_id >= {FIRST_INCOMING_BATCH}",
    "src6_scan_as_of": f"SELECT news_id, process_time FROM raw_news WHERE process_time <= {_AT}",
    "src7_stream_scan": f"SELECT event_id, instrument_id, sequence_number, process_time FROM raw_market_events WHERE venue = 'XBRU' AND sequence_stream_id = 'XBRU-ch0' AND sequence_number BETWEEN 3 AND 40 AND process_time <= {_AT}",
    "snk1_insert_status": f"WITH {_STATUS} SELECT news_id, status FROM status",
    "snk2_market_status": "WITH p AS (SELECT *, hash(instrument_id, event_kind, venue, sequence_stream_id, sequence_number, exchange_time, receive_time, process_time, price, quantity) AS h, row_number() OVER w AS nth, first_value(event_id) OVER (PARTITION BY instrument_id, venue, sequence_stream_id, sequence_number ORDER BY receive_time, process_time, event_id) AS holder FROM raw_market_events WINDOW w AS (PARTITION BY event_id ORDER BY receive_time, process_time)), "
    "q AS (SELECT *, first_value(h) OVER (PARTITION BY event_id ORDER BY receive_time, process_time) = h AS same FROM p) SELECT venue, CASE WHEN nth > 1 AND same THEN 'DUPLICATE_EVENT' WHEN nth > 1 THEN 'CONFLICTING_EVENT_ID' WHEN holder <> event_id THEN 'CONFLICTING_SEQUENCE' ELSE 'INSERTED' END AS status, count(*) AS n FROM q GROUP BY ALL",
    "snk3_summary": f"WITH {_STATUS} SELECT count(*) AS received, count(*) FILTER (status = 'INSERTED') AS inserted, count(*) FILTER (status <> 'INSERTED') AS duplicate FROM status",
    "snk5_invariants": f"WITH {_REV}, b AS (SELECT *, lag(revision_number) OVER w AS n0, lag(available_at) OVER w AS a0, lag(event_type) OVER w AS t0, lag(source_names) OVER w AS s0 FROM rev WINDOW w AS (PARTITION BY event_id ORDER BY revision_number)) SELECT event_id, revision_number, revision_number = coalesce(n0, 0) + 1 AS next_number, n0 IS NULL OR available_at >= a0 AS monotonic, n0 IS NULL OR event_type = t0 AS same_type, n0 IS NULL OR list_has_all(source_names, s0) AS sources_kept, len(list_filter(source_names, lambda x: NOT list_contains(coalesce(s0, []), x))) > 0 AS source_added FROM b",
    "val1_causality": "SELECT source, count(*) FILTER (receive_time < event_time) AS n_before_event, count(*) FILTER (process_time < receive_time) AS n_before_receipt FROM raw_news GROUP BY source",
    "val2_shape": "SELECT event_kind, CASE WHEN event_kind = 'BOOK' AND book_action = 'RESET' AND (book_side IS NOT NULL OR price IS NOT NULL OR quantity IS NOT NULL) THEN 'RESET_WITH_FIELDS' WHEN event_kind = 'BOOK' AND book_action <> 'RESET' AND (book_side IS NULL OR price IS NULL) THEN 'NO_SIDE_OR_PRICE' WHEN event_kind = 'BOOK' AND book_action IN ('ADD', 'MODIFY', 'CANCEL', 'EXECUTE') AND coalesce(quantity, 0) <= 0 THEN 'NO_QUANTITY' "
    "WHEN event_kind = 'BOOK' AND book_action = 'DELETE' AND quantity IS NOT NULL THEN 'DELETE_WITH_QUANTITY' WHEN event_kind = 'BOOK' AND book_action <> 'EXECUTE' AND trade_id IS NOT NULL THEN 'TRADE_ID_WITHOUT_EXECUTE' WHEN event_kind = 'QUOTE' AND best_bid_price > best_ask_price THEN 'CROSSED_QUOTE' ELSE 'OK' END AS finding, count(*) AS n FROM raw_market_events GROUP BY ALL",
    "val3_ranges": "SELECT source_type, count(*) FILTER (trim(headline) = '') AS n_blank, count(*) FILTER (source_type NOT IN (" + ", ".join(map(repr, t.CREDIBILITY)) + ")) AS n_unknown_type, count(*) FILTER (length(content_hash) <> 64) AS n_bad_hash FROM raw_news GROUP BY source_type",
    "val4_tickers": "WITH x AS (SELECT news_id, upper(trim(unnest(provider_tickers))) AS k, generate_subscripts(provider_tickers, 1) AS p FROM raw_news), y AS (SELECT news_id, k, min(p) AS p FROM x WHERE k <> '' GROUP BY news_id, k), z AS (SELECT news_id, list(k ORDER BY p) AS tickers FROM y GROUP BY news_id) SELECT news_id, coalesce(tickers, []) AS tickers FROM raw_news LEFT JOIN z USING (news_id)",
    "val5_tick": "SELECT instrument_id, count(*) AS n, count(*) FILTER (tick IS NOT NULL AND price % tick <> 0) AS n_off_tick FROM raw_market_events JOIN (SELECT instrument_id, CAST(tick_size AS DECIMAL(20,6)) AS tick FROM instruments) USING (instrument_id) WHERE event_kind = 'TRADE' GROUP BY instrument_id",
    "flt1_valid_links": f"SELECT entity_id, count(*) AS n_links, round(max(confidence), 6) AS best FROM (SELECT DISTINCT ON (link_id, valid_from, valid_to) * FROM entity_instrument_links) WHERE {_VALID} GROUP BY entity_id",
    "flt2_scope": "WITH m AS (SELECT *, CASE WHEN exchange_time < TIMESTAMPTZ '2023-01-05 00:00:00+00' THEN 'WARM_UP' WHEN exchange_time < TIMESTAMPTZ '2023-01-08 00:00:00+00' THEN 'RESEARCH' END AS part FROM raw_market_events), w AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, part ORDER BY exchange_time DESC, event_id DESC, receive_time DESC) AS nth FROM m WHERE part IS NOT NULL) SELECT instrument_id, part, count(*) AS n, min(exchange_time) AS first FROM w WHERE part = 'RESEARCH' OR nth <= 5 GROUP BY ALL",
    "flt3_active": f"WITH {_REV}, {_LATEST} SELECT event_id, round({_DECAY}, 8) AS decay FROM latest WHERE event_state <> 'RETRACTED' AND round({_DECAY}, 8) >= 0.01",
    "jn1_alias": "WITH names AS (SELECT lower(canonical_name) AS k, entity_id FROM entities UNION SELECT lower(unnest(aliases)), entity_id FROM entities), g AS (SELECT k, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM names GROUP BY k) SELECT alias_id, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN e END AS entity_id FROM entity_aliases LEFT JOIN g ON k = lower(trim(alias))",
    "jn2_ticker": "WITH x AS (SELECT DISTINCT news_id, upper(trim(unnest(provider_tickers))) AS k FROM raw_news) SELECT x.k, news_id, CASE WHEN instrument_id IS NULL THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS status, instrument_id FROM x LEFT JOIN instruments i ON upper(trim(i.ticker)) = x.k WHERE x.k <> ''",
    "jn3_links_as_of": "WITH r AS (SELECT DISTINCT entity_id, CAST(process_time AT TIME ZONE 'UTC' AS DATE) AS day FROM raw_news WHERE entity_id IS NOT NULL), l AS (SELECT DISTINCT ON (link_id, valid_from, valid_to) * FROM entity_instrument_links) SELECT day, count(*) AS n_links, count(DISTINCT instrument_id) AS n_instruments FROM r JOIN l USING (entity_id) WHERE (valid_from IS NULL OR valid_from <= CAST(day AS TIMESTAMP) AT TIME ZONE 'UTC') AND (valid_to IS NULL OR valid_to > CAST(day AS TIMESTAMP) AT TIME ZONE 'UTC') GROUP BY day",
    "jn5_candidates": f"WITH {_REV}, r AS (SELECT DISTINCT event_id, available_at, unnest(source_names) AS source FROM rev) SELECT news_id, count(DISTINCT r.event_id) AS n_candidates, bool_or(coalesce(i.event_id = r.event_id, false)) AS own_among_them FROM raw_news i JOIN r ON i.source = r.source AND available_at <= process_time AND epoch_us(process_time) - epoch_us(available_at) <= {news.HORIZON_S * 1_000_000} GROUP BY news_id",
    "snk5_owners": "SELECT n_events = 1 AS one_event, count(*) AS n FROM (SELECT news_id, count(DISTINCT event_id) AS n_events FROM raw_news WHERE event_id IS NOT NULL GROUP BY news_id) GROUP BY ALL",
    "jn2_listed": f"WITH x AS (SELECT DISTINCT news_id, upper(trim(unnest(provider_tickers))) AS k FROM raw_news), i AS (SELECT * FROM instruments WHERE exchange = '{EXCHANGE}' AND asset_type = '{ASSET}') SELECT x.k, news_id, CASE WHEN instrument_id IS NULL THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS status, instrument_id FROM x LEFT JOIN i ON upper(trim(i.ticker)) = x.k WHERE x.k <> ''",
    "jn1_normal_form": f"WITH names AS (SELECT {_norm('canonical_name')} AS k, entity_id FROM entities UNION SELECT {_norm('a')}, entity_id FROM (SELECT unnest(aliases) AS a, entity_id FROM entities)), g AS (SELECT k, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM names WHERE k <> '' GROUP BY k), al AS (SELECT alias_id, {_norm('alias')} AS k FROM entity_aliases) SELECT alias_id, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN e END AS entity_id FROM al LEFT JOIN g USING (k)",
    "jn7_previous": f"WITH {_REV} SELECT revision_id, lag(revision_id) OVER w AS before, len(list_filter(list_distinct(source_names), lambda x: NOT list_contains(coalesce(s0, []), x))) AS new_sources FROM (SELECT *, lag(source_names) OVER (PARTITION BY event_id ORDER BY revision_number) AS s0 FROM rev) WINDOW w AS (PARTITION BY event_id ORDER BY revision_number)",
    "wn1_latest": f"WITH {_REV}, {_LATEST} SELECT event_id, revision_id, revision_number, event_state FROM latest",
    "ag1_noisy_or": f"WITH {_IND} SELECT event_id, round(1 - product(1 - credibility), 8) AS credibility FROM ind GROUP BY event_id",
    "ag2_weighted_mean": "SELECT entity_id, round(coalesce(sum(confidence * w) / nullif(sum(w), 0), 0), 8) AS confidence FROM (SELECT *, CASE relationship_type WHEN 'PRIMARY_EQUITY' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM entity_instrument_links) GROUP BY entity_id",
    "ag3_exposure": f"WITH RECURSIVE {_EDGES}, p AS (SELECT node, CASE start WHEN 'r1' THEN -1.0 ELSE 1.0 END AS sign, magnitude, confidence, power(0.8::DOUBLE, depth) AS relevance, array_to_string(nodes, '>') AS path_id FROM paths WHERE node LIKE 's%') SELECT node, round(1 - product(1 - magnitude), 8) AS magnitude, round(1 - product(1 - confidence), 8) AS confidence, round(max(relevance), 8) AS relevance, CASE WHEN count(DISTINCT sign) = 1 THEN min(sign) ELSE 0 END::DOUBLE AS direction, count(DISTINCT sign) > 1 AS conflict, arg_min(path_id, struct_pack(a := -magnitude, b := -confidence, c := path_id)) AS strongest, count(*) AS n_paths FROM p GROUP BY node",
    "ag5_news_flow": "SELECT source, volume, recent, prior, recent * 4.0::DOUBLE - prior AS acceleration FROM (SELECT source, " + ", ".join(f"count(DISTINCT CASE WHEN epoch_us(process_time) > epoch_us({_AT}) - {a * 60_000_000} AND epoch_us(process_time) <= epoch_us({_AT}) - {b * 60_000_000} THEN content_hash END) AS {n}" for n, a, b in (("volume", 1440, 0), ("recent", 15, 0), ("prior", 75, 15))) + " FROM raw_news GROUP BY source)",
    "ag8_sources": f"WITH {_IND} SELECT event_id, source, source_type, credibility FROM ind",
    "st1_st3_sets": f"WITH {_REV}, b AS (SELECT revision_id, source_names AS s, coalesce(lag(source_names) OVER (PARTITION BY event_id ORDER BY revision_number), []) AS s0 FROM rev), i AS (SELECT *, len(list_intersect(s, s0)) AS shared_n, len(list_distinct(list_concat(s, s0))) AS all_n FROM b) SELECT revision_id, round(CASE all_n WHEN 0 THEN 0 ELSE shared_n / all_n END, 8) AS jaccard, list_concat(s0, list_filter(s, lambda x: NOT list_contains(s0, x))) AS united, round(len(list_filter(list_distinct(s), lambda x: NOT list_contains(s0, x))) / greatest(len(list_distinct(s)), 1), 8) AS new_fraction FROM i",
    "fn1_normal_form": f"WITH {NORMED} SELECT news_id, h AS normal FROM nf",
    "fn2_tokens": f"WITH {NORMED} SELECT news_id, {_TOKENS.format(h='h')} AS tokens FROM nf",
    "fn3_anchors": f"SELECT news_id, {_ANCHORS.format(x='text')} AS anchors FROM (SELECT *, headline || coalesce(' ' || body, '') AS text FROM raw_news)",
    "fn4_classes": f"WITH {NORMED} SELECT news_id, subtype, confidence FROM normed",
    "fn5_content_hash": "WITH f AS (SELECT news_id, event_time, " + ", ".join(f"regexp_replace(replace(replace({c}, E'\\r\\n', E'\\n'), E'\\r', E'\\n'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS {c}" for c in ("body", "headline", "source", "url")) + f" FROM raw_news) SELECT news_id, sha256('{{\"body\":' || coalesce(to_json(body)::VARCHAR, 'null') || ',\"event_time\":\"' || strftime(event_time AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || 'Z\",\"headline\":' || to_json(headline)::VARCHAR || ',\"policy\":\"{identity.CONTENT_POLICY}\",\"source\":' || to_json(source)::VARCHAR || ',\"url\":' || coalesce(to_json(url)::VARCHAR, 'null') || '}}') AS hash FROM f",
    "fn6_direction": f"WITH {NORMED}, d AS (SELECT news_id, subtype, h AS n FROM normed) SELECT news_id, CASE WHEN subtype = 'COMPANY.BUYBACK' THEN 1 WHEN subtype = 'COMPANY.DIVIDEND' AND {_has(('suspends dividend', 'suspend dividend', 'cuts dividend', 'cancels dividend'))} THEN -1 WHEN subtype LIKE 'REGULATORY.%' AND {_has(('rejects', 'rejection', 'denies', 'denied'))} THEN -1 WHEN subtype = 'REGULATORY.APPROVAL' THEN 1 WHEN subtype = 'GEOPOLITICAL.SANCTION' THEN -1 ELSE 0 END::DOUBLE AS direction FROM d",
    "fn7_keys": "SELECT instrument_id, upper(trim(ticker)) AS ticker_key, regexp_replace(lower(ticker), '[^a-z0-9]', '', 'g') AS comparison_key FROM instruments",
    "fn8_elapsed": "SELECT news_id, CASE WHEN receive_time >= event_time THEN CAST((epoch_us(receive_time) - epoch_us(event_time)) / 1000000.0 AS DECIMAL(20,6)) END AS delay_s, CAST((epoch_us(event_time) - epoch_us(process_time)) / 1000000.0 AS DECIMAL(20,6)) AS signed_s FROM raw_news",
    "fn9_fn10_decay": f"WITH {_REV} SELECT revision_id, round({_DECAY}, 8) AS decay, round(greatest(0, 1 - abs({_AGE}) / {news.HORIZON_S}), 8) AS proximity FROM rev",
    "fn16_fn18_intensity": _FORCE + " SELECT instrument_id, event_id, round(intensity, 8) AS intensity, round(intensity * sentiment, 8) AS signed, round(risk, 8) AS risk, round(newness, 8) AS newness FROM force",
    "fn29_uuid5": f"SELECT news_id, {_uuid('source || chr(124) || news_id')} AS uuid FROM raw_news",
    "nw1_similarity": f"WITH {NORMED}, r AS (SELECT event_id, news_id, process_time, subtype, {_TOKENS.format(h='h')} AS t, {_ANCHORS.format(x='text')} AS a FROM normed WHERE event_id IS NOT NULL), l AS (SELECT *, lag(t) OVER w AS t0, lag(a) OVER w AS a0, lag(process_time) OVER w AS p0, lag(subtype) OVER w AS s0 FROM r WINDOW w AS (PARTITION BY event_id ORDER BY process_time, news_id)), "
    f"g AS (SELECT *, (epoch_us(process_time) - epoch_us(p0)) / 1e6 AS age, len(list_intersect(t, t0)) AS ti, len(list_distinct(list_concat(t, t0))) AS tu, len(list_intersect(a, a0)) AS ai, len(list_distinct(list_concat(a, a0))) AS au FROM l WHERE p0 IS NOT NULL) SELECT news_id, round(CASE WHEN subtype <> s0 OR age > {news.HORIZON_S} OR (subtype LIKE 'COMPANY.%' AND ai = 0) THEN 0 ELSE 0.55::DOUBLE * coalesce(ti / nullif(tu, 0), 0) + 0.25::DOUBLE * coalesce(ai / nullif(au, 0), 0) + 0.1::DOUBLE * greatest(0, 1 - age / {news.HORIZON_S}) + 0.1::DOUBLE END, 6) AS similarity FROM g",
    "nw4_entity_links": "WITH i AS (SELECT upper(ticker) AS k, instrument_id AS target FROM instruments), e AS (SELECT lower(canonical_name) AS k, entity_id AS target FROM entities), a AS (SELECT news_id, upper(trim(unnest(provider_tickers))) AS k, generate_subscripts(provider_tickers, 1) AS place FROM raw_news), "
    "b AS (SELECT news_id, lower(trim(unnest(provider_entities))) AS k, generate_subscripts(provider_entities, 1) AS place FROM raw_news), w AS (SELECT news_id, regexp_extract_all(headline, '\\b[A-Z][A-Z0-9.-]{1,7}\\b') AS ws FROM raw_news), c AS (SELECT news_id, unnest(ws) AS k, generate_subscripts(ws, 1) AS place FROM w), "
    "u AS (SELECT news_id, target, 1 AS tier, 1.0::DOUBLE AS confidence, place FROM a JOIN i USING (k) UNION ALL SELECT news_id, target, 2, 0.95, place FROM b JOIN e USING (k) UNION ALL SELECT news_id, target, 6, 0.8, place FROM c JOIN i USING (k)), "
    "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY news_id, target ORDER BY tier, confidence DESC, place) AS nth FROM u) WHERE nth = 1) SELECT news_id, target, tier, confidence, tier = 1 OR row_number() OVER (PARTITION BY news_id ORDER BY tier, place, target) = 1 AS is_primary FROM r",
    "nw5_fn19_paths": f"WITH RECURSIVE {_EDGES} SELECT start, array_to_string(nodes, '>') AS path, round(magnitude, 8) AS magnitude, round(confidence, 8) AS confidence, depth FROM paths",
    "nw6_path_ids": f"WITH RECURSIVE {_EDGES}, q AS (SELECT start || '|' || array_to_string(nodes, '|') AS x FROM paths) SELECT DISTINCT {_uuid('x')} AS path_id FROM q",
    "tk4_strongest": f"WITH RECURSIVE {_EDGES}, p AS (SELECT node, array_to_string(nodes, '>') AS path, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN depth > 2 THEN 1 ELSE 0 END, round(magnitude, 10) DESC, round(confidence, 10) DESC, array_to_string(nodes, '>')) AS nth FROM paths WHERE node LIKE 's%') SELECT node, path FROM p WHERE nth = 1",
    "nw9_priors": f"WITH {_REV} SELECT revision_id, {_TAU} AS tau_hours, {_SEV} AS prior FROM rev",
    "nw10_ag4_state": _FORCE + f""", fl AS (SELECT instrument_id, count(DISTINCT news_id) FILTER (age < 86400) AS volume, count(DISTINCT news_id) FILTER (age < 900) AS recent, count(DISTINCT news_id) FILTER (age >= 900 AND age < 4500) AS prior FROM (SELECT instrument_id, news_id, (epoch_us({_AT}) - epoch_us(process_time)) / 1e6 AS age FROM force JOIN msg USING (event_id) WHERE process_time <= {_AT}) GROUP BY instrument_id)
    SELECT instrument_id, count(*) AS n_events, count(*) FILTER (is_direct) AS n_direct, count(*) FILTER (NOT is_direct) AS n_indirect, coalesce(any_value(volume), 0) AS volume, coalesce(any_value(recent) * 4.0::DOUBLE - any_value(prior), 0) AS acceleration, round(sum(greatest(intensity * sentiment, 0)), 6) AS positive_intensity, round(sum(abs(least(intensity * sentiment, 0))), 6) AS negative_intensity, """ + ", ".join(f"round(1 - product(CASE bucket WHEN '{b}' THEN 1 - risk ELSE 1 END), 6) AS {b}_risk" for b in scores.RISK_NAMES) + """, round(1 - product(1 - newness), 6) AS novelty_intensity,
    round(CASE WHEN count(DISTINCT CASE WHEN sentiment <> 0 THEN sign(sentiment) END) > 1 THEN 1 - product(1 - uncertainty * weight) * 0.65::DOUBLE ELSE 1 - product(1 - uncertainty * weight) END, 6) AS uncertainty, round(coalesce(sum(confidence * weight) / nullif(sum(weight), 0), 0), 6) AS confidence FROM force LEFT JOIN fl USING (instrument_id) GROUP BY instrument_id""",
}
