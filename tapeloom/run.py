"""python -m tapeloom.run --experiment FILE [--dry-run] [--output-root DIR]: a research experiment from its specification to its artifacts."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import research
from tapeloom.operators import sequences as s
from tapeloom.plans.frames import states
from tapeloom.session import build_session
from tapeloom.sources.sinks import write_artifacts


@dataclass(frozen=True)
class Experiment:
    """One specification. `data` and `output_root` say where, not what, and so don't count for the hash."""

    data: str
    horizon: int = 10
    least_train: int = 4000
    test: int = 1500
    embargo_events: int = 5
    block: int = 50
    permutations: int = 99
    seed: int = 0
    output_root: str = "artifacts"
    hypotheses: tuple[dict, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        for name in ("horizon", "least_train", "test", "block", "permutations"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        names = [h.get("name") for h in self.hypotheses]
        if not names or len(set(names)) != len(names) or None in names:
            raise ValueError("hypotheses need distinct names")
        if bad := [h for h in self.hypotheses if h.get("side") not in ("BUY", "SELL", "UNKNOWN")]:
            raise ValueError(f"a hypothesis looks at one side of trading: {bad}")

    @property
    def hash(self) -> str:
        neutral = {k: v for k, v in asdict(self).items() if k not in ("data", "output_root")}
        return hashlib.sha256(json.dumps(neutral, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load(path: str) -> Experiment:
    given = json.loads(Path(path).read_text())
    return Experiment(**{**given, "hypotheses": tuple(given.get("hypotheses", ()))})


def evaluate(spark: SparkSession, x: Experiment) -> dict[str, bytes]:
    """The artifacts' content. Only sums and test results reach the driver."""
    st = states(spark, x.data)
    lab = s.forward(st, "instrument", "event_index", "mid", (x.horizon,)).join(st.select("instrument", "event_index", "event_id", "at_us", "side"), ["instrument", "event_index"])
    lab = lab.where("later IS NOT NULL").select("event_id", "instrument", "event_index", "at_us", "side", (F.col("later") - F.col("mid")).alias("label"), (F.col("event_index") + x.horizon).alias("label_end"))
    order = ["at_us", "instrument", "event_index", "event_id"]
    _, by_role = research.fold_exceptions(lab, order, x.least_train, x.test, "instrument", "event_index", "label_end", x.embargo_events, "event_id")
    roles = [r.asDict() for r in by_role.select("fold", "role", "n").orderBy("fold", "role").collect()]
    ranked = research.global_rank(lab, order)
    n_rows = ranked.count()
    n = -(-n_rows // x.block)
    rows = ranked.select("side", F.floor(F.col("rank") / x.block).alias("block"), (F.col("rank") % x.block).alias("place"), "rank", "label")
    orders = research.hashed_orders(spark, n_rows, x.block, x.permutations, x.seed)
    results = []
    for h in x.hypotheses:
        condition = F.col("side") == h["side"]
        seen = rows.where(condition).agg(F.count("*").alias("n"), F.avg("label").alias("m")).first()
        if seen["n"] < 2:
            results.append({"name": h["name"], "status": "UNAVAILABLE", "n": seen["n"]})
            continue
        r = research.p_value(seen["m"], research.permuted_means(rows, orders, condition)).first().asDict()
        results.append({"name": h["name"], "status": "RUN", "n": seen["n"], "statistic": round(seen["m"], 10), **{k: None if v is None else round(v, 10) for k, v in r.items()}})
    tested = [r for r in results if r["status"] == "RUN"]
    if tested:
        df = research.corrections(spark.createDataFrame([("all", r["name"], r["p_value"]) for r in tested], "family string, name string, p double"), "family", "p", "name")
        for c in df.collect():
            next(r for r in results if r["name"] == c["name"]).update(bonferroni=c["bonferroni"], bh=c["bh"])
    dump = lambda v: (json.dumps(v, sort_keys=True, indent=1) + "\n").encode()
    report = "\n".join([f"# Experiment {x.hash[:12]}", "", "| hypothesis | status | n | statistic | p | BH |", "| --- | --- | --- | --- | --- | --- |", *[f"| {r['name']} | {r['status']} | {r['n']} | {r.get('statistic')} | {r.get('p_value')} | {r.get('bh')} |" for r in results], ""])
    neutral = {k: v for k, v in asdict(x).items() if k not in ("data", "output_root")}
    return {"experiment.json": dump(neutral), "folds.json": dump(roles), "results.json": dump(results), "quality.json": dump({"n_labelled": n_rows, "n_blocks": n}), "manifest.json": dump({"hash": x.hash, "files": ["experiment.json", "folds.json", "quality.json", "results.json", "report.md"]}), "report.md": report.encode()}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tapeloom.run")
    parser.add_argument("--experiment", required=True)
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--output-root")
    args = parser.parse_args(argv)
    try:
        x = load(args.experiment)
        spark = SparkSession.getActiveSession() or build_session("tapeloom-run")
        if args.dry_run:
            n = states(spark, x.data).count()
            print(json.dumps({"hash": x.hash, "events": n}))
            return 0
        print(write_artifacts(evaluate(spark, x), args.output_root or x.output_root, x.hash))
        return 0
    except (ValueError, OSError, TypeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
