"""The news stack: insert statuses, clustering into events, entity links, exposure along relations, scores."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import taxonomy as t
from tapeloom.session import cut_lineage


def insert_statuses(rows: DataFrame, is_incoming: Column) -> DataFrame:
    """What becomes of each incoming row, against all rows before it by (process_time, news_id): the provider's item counts before the content, that before the id."""

    def earlier(*keys: str) -> Column:
        present = F.lit(True)
        for k in keys:
            present = present & F.col(k).isNotNull()
        # rows without the key are no group of their own; each stands alone
        alone = F.when(~present, F.xxhash64("news_id", "process_time"))
        return F.when(present, F.row_number().over(Window.partitionBy(*keys, alone).orderBy(F.col("incoming"), "process_time", "news_id")) > 1).otherwise(F.lit(False))

    e = rows.withColumn("incoming", is_incoming)
    status = F.when(earlier("source", "provider_item_id"), "DUPLICATE_PROVIDER_ITEM").when(earlier("content_hash"), "DUPLICATE_CONTENT").when(earlier("news_id"), "DUPLICATE_NEWS_ID").otherwise("INSERTED")
    return e.withColumn("status", status).where("incoming").drop("incoming")


def prior(values: dict[str, float], key: Column, default: float | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(m, key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def event_type(subtype: Column) -> Column:
    return F.split(subtype, r"\.")[0]


def tau_hours(subtype: Column) -> Column:
    return F.coalesce(prior(t.TAU_HOURS_OF, subtype), prior(t.TAU_HOURS, event_type(subtype))).cast("double")


def severity(subtype: Column) -> Column:
    return F.coalesce(prior(t.SEVERITY_OF, subtype), prior(t.SEVERITY, event_type(subtype)))


def decay(seconds: Column, tau_seconds: Column) -> Column:
    """Null before the event was known."""
    return F.when(seconds >= 0, F.exp(-seconds / tau_seconds))


def noisy_or(values: Column) -> Column:
    """1 - product(1 - x) of an array; zero for an empty one."""
    return 1 - F.aggregate(values, F.lit(1.0), lambda a, x: a * (1 - x))


def independent_sources(rows: DataFrame, key: str) -> DataFrame:
    """One row a key and source name (case apart): the highest prior, of equal ones the earliest."""
    e = rows.withColumn("credibility", prior(t.CREDIBILITY, F.col("source_type"), 0.5))
    w = Window.partitionBy(key, F.lower("source")).orderBy(F.desc("credibility"), "process_time", "news_id")
    return e.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").select(key, "source", "source_type", "credibility")


def official(source_type: Column, kind: Column) -> Column:
    out = F.lit(False)
    for s, kinds in t.OFFICIAL.items():
        out = out | ((source_type == s) & kind.isin(*kinds))
    return F.coalesce(out, F.lit(False))


HORIZON_S = 36 * 3600
THRESHOLD, MARGIN = 0.55, 0.05
WEIGHTS = {"headline": 0.55, "anchor": 0.25, "time": 0.1, "type": 0.1}
CLUSTERED = "news_id string, decision string, event_key string, revision_number int, event_state string"


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


class Clusterer:
    """Online clustering of one kind of news: what has not been seen for HORIZON_S is forgotten."""

    def __init__(self, kind: str) -> None:
        self.company = kind == "COMPANY"
        self.events: dict[str, dict] = {}
        self.by_anchor: dict[str, set[str]] = defaultdict(set)

    def forget(self, at: float) -> None:
        for key in [k for k, e in self.events.items() if at - e["at"] > HORIZON_S]:
            for a in self.events.pop(key)["anchors"]:
                self.by_anchor[a].discard(key)

    def add(self, news_id: str, at: float, tokens: set, anchors: set, source: str, confirms: bool) -> tuple[str, str | None, int | None, str | None]:
        self.forget(at)
        keys = set().union(*(self.by_anchor[a] for a in anchors if a in self.by_anchor)) if anchors else set(self.events)
        scored = []
        for k in keys:
            e = self.events[k]
            if (anchors and e["anchors"] and not anchors & e["anchors"]) or (self.company and not anchors & e["anchors"]):
                continue
            score = WEIGHTS["headline"] * _jaccard(tokens, e["tokens"]) + WEIGHTS["anchor"] * _jaccard(anchors, e["anchors"]) + WEIGHTS["time"] * max(0.0, 1 - (at - e["at"]) / HORIZON_S) + WEIGHTS["type"]
            if score >= THRESHOLD:
                scored.append((-score, k))
        scored.sort()
        if len(scored) > 1 and scored[1][0] - scored[0][0] < MARGIN:
            return "AMBIGUOUS", None, None, None
        if scored:
            key = scored[0][1]
            e = self.events[key]
            new = source not in e["sources"]
            if e["state"] != "CONFIRMED":
                e["state"] = "CONFIRMED" if new and confirms else "DEVELOPING" if new else "UPDATED"
            e.update(at=at, tokens=tokens, anchors=e["anchors"] | anchors, sources=e["sources"] | {source}, revision=e["revision"] + 1)
        else:
            key = news_id
            self.events[key] = e = {"at": at, "tokens": tokens, "anchors": set(anchors), "sources": {source}, "revision": 1, "state": "NEW"}
        for a in anchors:
            self.by_anchor[a].add(key)
        return "CLUSTERED" if e["revision"] > 1 else "NEW_EVENT", key, e["revision"], e["state"]


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whose, clusterer = None, None
    for batch in batches:
        out = []
        for subtype, session, news_id, at, tokens, anchors, source, confirms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (subtype, session) != whose:
                whose, clusterer = (subtype, session), Clusterer(subtype.split(".")[0])
            out.append((news_id, *clusterer.add(news_id, at / 1e6, set(tokens), set(anchors), source, confirms)))
        c = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.utf8()), pa.array(c[1], pa.utf8()), pa.array(c[2], pa.utf8()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.utf8())], names=["news_id", "decision", "event_key", "revision_number", "event_state"])


def cluster(news: DataFrame) -> DataFrame:
    """(news_id, decision, event_key, revision_number, event_state) for rows (news_id, subtype, process_time, tokens, anchors, source, confirms).

    Rows are taken by (process_time, news_id). Events of different subtypes never meet, nor do events more than
    HORIZON_S apart, so a subtype is split wherever it is silent for longer; each piece is one pass over sorted rows with
    a state of what is still within reach. An event is named by its first news_id.
    """
    at = F.unix_micros("process_time")
    w = Window.partitionBy("subtype").orderBy("process_time", "news_id")
    quiet = F.coalesce((at - F.lag(at).over(w)) > HORIZON_S * 1_000_000, F.lit(True)).cast("int")
    e = news.withColumn("quiet", quiet).withColumn("session", F.sum("quiet").over(w)).select("subtype", "session", "news_id", at.alias("at"), "tokens", "anchors", "source", "confirms")
    return e.repartition("subtype", "session").sortWithinPartitions("subtype", "session", "at", "news_id").mapInArrow(_cluster, CLUSTERED)


PATH = ("start", "node", "nodes", "magnitude", "confidence", "depth")


def traverse(starts: DataFrame, edges: DataFrame, depth: int, decay_factor: float = 0.7) -> DataFrame:
    """All simple paths of at most `depth` edges: (start, node, nodes, magnitude, confidence, depth).

    starts: (start, magnitude, confidence). edges: (src, dst, magnitude, confidence), one row a direction in which they
    may be walked. Each step is a join with the edges; a node already on the path isn't entered again.
    """
    step = starts.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), "magnitude", "confidence", F.lit(0).alias("depth"))
    e = edges.select(F.col("src").alias("node"), "dst", F.col("magnitude").alias("m"), F.col("confidence").alias("c"))
    every = step
    for d in range(1, depth + 1):
        step = step.join(e, "node").where(~F.array_contains("nodes", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("magnitude") * F.col("m") * decay_factor).alias("magnitude"), (F.col("confidence") * F.col("c")).alias("confidence"), F.lit(d).alias("depth"))
        every = every.unionByName(step)
    return every


def materialise(paths: DataFrame, key: str) -> DataFrame:
    """Paths (key, sign, magnitude, confidence, relevance, path_id) to one exposure a key: noisy-or of magnitude and confidence, the common sign or 0, the strongest path."""
    signs = F.collect_set(F.when(F.col("sign") != 0, F.signum("sign")))
    return paths.groupBy(key).agg(
        (1 - F.product(1 - F.col("magnitude"))).alias("magnitude"), (1 - F.product(1 - F.col("confidence"))).alias("confidence"), F.max("relevance").alias("relevance"),
        F.when(F.size(signs) == 1, F.element_at(signs, 1)).otherwise(0.0).alias("direction"), (F.size(signs) > 1).alias("conflict"),
        F.min_by("path_id", F.struct(-F.col("magnitude"), -F.col("confidence"), F.col("path_id"))).alias("strongest"), F.count("*").alias("n_paths"),
    )


def policy_direction(relation: Column, kind: Column, sign: Column) -> Column:
    """The sign of an event as it arrives over a relation: kept, turned, or 0 where the relation says nothing for its type."""
    out = F.lit(0.0)
    for name, _, what, kinds in reversed(t.POLICIES):
        applies = (relation == name) & (kind.isin(*kinds) if kinds else F.lit(True))
        if what != "UNKNOWN":
            out = F.when(applies, sign if what == "PRESERVE" else -sign).otherwise(out)
    return out


def mentions(texts: DataFrame, text_id: str, normal: str, names: DataFrame, name_id: str, name: str) -> DataFrame:
    """(text_id, name_id) of the names that stand in a text as whole words, both in normal form.

    A text is read as all its runs of as many words as names have, and these meet the names by an equi-join, so no
    text is held against every name. The longest name's number of words comes first, as one number.
    """
    keyed = names.select(F.col(name_id).alias("n_"), F.col(name).alias("phrase")).where("phrase IS NOT NULL AND phrase <> ''").distinct()
    sizes = sorted(r[0] for r in keyed.select(F.size(F.split("phrase", " "))).distinct().collect())
    words = F.split(normal, " ")
    runs = F.concat(*[F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), _run(words, k))).otherwise(F.array().cast("array<string>")) for k in sizes]) if sizes else F.array().cast("array<string>")
    spread = texts.where(F.col(normal).isNotNull()).withColumn("phrases_", F.array_distinct(runs)).select(text_id, F.explode("phrases_").alias("phrase"))
    return spread.join(keyed, "phrase").select(text_id, F.col("n_").alias(name_id)).distinct()


def _run(words: Column, k: int):
    return lambda i: F.array_join(F.slice(words, i, k), " ")


#: Microseconds of a cell in which candidates() counts row by row.
CELL_US = 3_600_000_000


def candidates(items: DataFrame, mentions: DataFrame, horizon: int) -> DataFrame:
    """(news_id, n_candidates, own_among_them): the distinct events that the item's source mentioned at most `horizon` before it; items without a mention are left out.

    items: (news_id, source, at, own); mentions: (event_id, source, at). Items don't meet their events: an event's mentions by a source count as one where
    they reach into each other, so the events in reach are those begun less those ended, a running sum by source. Whole cells are summed up first, so that
    a source isn't one task. Only an id that stands for several sources or times is joined with its events.
    """
    items, mentions = (x.where("source IS NOT NULL AND at IS NOT NULL") for x in (items, mentions))
    item, at = F.col("item"), F.col("at")
    nobody = F.lit(None).cast(items.schema["news_id"].dataType)
    both = mentions.select("source", "event_id", "at", F.lit(False).alias("item"), nobody.alias("news_id")).unionByName(items.select("source", F.col("own").alias("event_id"), "at", F.lit(True).alias("item"), "news_id"))
    earlier = Window.partitionBy("source", "event_id").orderBy("at", "item").rowsBetween(Window.unboundedPreceding, -1)
    b = both.withColumn("last", F.max(F.when(~item, at)).over(earlier))
    reached, known = F.coalesce(at - F.col("last") <= horizon, F.lit(False)), F.col("event_id").isNotNull()
    row = lambda when, n: F.struct(when.alias("at"), F.lit(n).cast("long").alias("all"), (known.cast("long") * n).alias("events"), (known & reached).alias("own"))
    span = F.array(row(F.when(reached, F.col("last") + horizon + 1).otherwise(at), 1), row(at + horizon + 1, -1))
    marks = b.select("source", "item", "news_id", F.explode(F.when(item, F.array(row(at, 0))).otherwise(span)).alias("x")).select("source", "item", "news_id", "x.*")
    marks = marks.withColumn("cell", F.floor(at / CELL_US))

    counts = ("all", "events")
    cells = marks.groupBy("source", "cell").agg(*[F.sum(c).alias(c) for c in counts])
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("source", "cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in counts])
    inside = Window.partitionBy("source", "cell").orderBy("at", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = marks.withColumns({c: F.sum(c).over(inside) for c in counts}).where("item").join(base, ["source", "cell"])
    asked = asked.select("news_id", "source", "at", "own", *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in counts])

    place = F.struct("source", "at")
    ids = cut_lineage(asked.groupBy("news_id").agg(F.max("events").alias("n_candidates"), F.max("own").alias("own_among_them"), F.max("all").alias("all"), (F.min(place) != F.max(place)).alias("several")).where("all > 0").drop("all"))
    once = ids.where("NOT several").drop("several")
    several = ids.where("several").select(F.col("news_id").alias("id_"))
    if several.isEmpty():
        return once
    cell = lambda c: F.floor(c / horizon)
    some = items.join(several, F.col("news_id").eqNullSafe(F.col("id_")), "left_semi").withColumn("cell", cell(at))
    near = mentions.select("source", "event_id", at.alias("then"), F.explode(F.array(cell(at), cell(at) + 1)).alias("cell"))
    pairs = some.join(near, ["source", "cell"]).where((F.col("then") <= at) & (at - F.col("then") <= horizon))
    return once.unionByName(pairs.groupBy("news_id").agg(F.countDistinct("event_id").alias("n_candidates"), F.max(F.coalesce(F.col("own") == F.col("event_id"), F.lit(False))).alias("own_among_them")))
