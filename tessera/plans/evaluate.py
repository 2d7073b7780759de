"""Expected facts of small source trees checked against an analysis.

    python -m tessera.plans.evaluate FOLDER     # every folder in it that has an expected.json; exit code 1 if any regressed
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint
from ..operators import architecture
from ..operators.summary import estimated_tokens
from ..staging import Stages
from .analysis import Repositories, repositories

EXPECTED = "expected.json"
# The shape of an expected.json.
_EDGE, _CUT = "struct<from:string,to:string,kind:string>", "struct<from:string,to:string,references:long>"
ITEMS = {"cycle": "array<array<string>>", "component": "array<string>", "edge": f"array<{_EDGE}>", "module": "array<string>", "cut": f"array<{_CUT}>"}
EXPECTATIONS = f"status string, expect struct<cycles:array<array<string>>,components:array<string>,edges:array<{_EDGE}>,metrics:struct<score:int,dimensionCount:int>,narration:struct<maxEstimatedTokens:long,modules:array<string>,cycleCuts:array<{_CUT}>>>"


def outcome(status: Column, passed: Column) -> Column:
    """expected-pass: PASS or REGRESSION; known-failure: FIXED or KNOWN-FAIL."""
    known = status == "known-failure"
    return F.when(known & passed, "FIXED").when(known, "KNOWN-FAIL").when(passed, "PASS").otherwise("REGRESSION")


def met(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected (any columns, kind, fact) with ok: whether the fact is there. More facts may be. found: kind, fact, and the columns
    that expected shares with it."""
    key = [c for c in found.columns if c in expected.columns]
    return expected.join(found.select(*key).distinct().withColumn("ok", F.lit(True)), key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def verdicts(checks: DataFrame, statuses: DataFrame) -> DataFrame:
    """name, checks, passed, outcome of each of statuses (name, status): one without checks doesn't pass. checks: name, ok."""
    per = checks.groupBy("name").agg(F.count("*").alias("checks"), F.bool_and("ok").alias("all_ok"))
    out = statuses.join(per, "name", "left").select("name", "status", F.coalesce("checks", F.lit(0)).cast("long").alias("checks"), F.coalesce("all_ok", F.lit(False)).alias("passed"))
    return out.select("name", "checks", "passed", outcome(F.col("status"), F.col("passed")).alias("outcome"))


def tally(found: DataFrame) -> DataFrame:
    """outcome, n and the share of all."""
    per = found.groupBy("outcome").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("of")))).select("outcome", "n", (F.col("n") / F.col("of")).alias("share"))  # one row


def facts(r: Repositories, contexts: DataFrame) -> DataFrame:
    """repo_id, kind, fact: what expectations may name, as tables; nothing is collected. contexts: the repositories' summaries."""
    edge = F.concat_ws(" ", "src_path", "kind", "dst_path")
    cycles = r.cycles.select("repo_id", F.lit("cycle").alias("kind"), fingerprint(F.col("files")).alias("fact"))
    names = r.symbols.where("kind = 'component'").select("repo_id", F.lit("component").alias("kind"), F.col("name").alias("fact"))
    edges = architecture.edge_paths(r.edges, r.files).select("repo_id", F.lit("edge").alias("kind"), edge.alias("fact"))
    x = F.col("context")
    modules = F.transform(x["modules"], lambda m: F.struct(F.lit("module").alias("kind"), m["path"].alias("fact")))
    cuts = F.transform(F.filter(x["cycles"], lambda c: c["suggestedCut"].isNotNull()), lambda c: F.struct(F.lit("cut").alias("kind"), cut_text(c["suggestedCut"]).alias("fact")))
    told = contexts.select("repo_id", F.inline(F.concat(modules, cuts)))
    return cycles.unionByName(names).unionByName(edges).unionByName(told)


def cut_text(c: Column) -> Column:
    return F.concat_ws(" ", c["from"], c["to"], c["references"].cast("string"))


def wanted(expected: DataFrame) -> DataFrame:
    """repo_id, kind, fact of expected (repo_id, expect)."""
    e, n = F.col("expect"), F.col("expect.narration")
    every = lambda xs, kind, text: F.transform(F.coalesce(xs, F.array().cast(ITEMS[kind])), lambda v: F.struct(F.lit(kind).alias("kind"), text(v).alias("fact")))
    return expected.select("repo_id", F.inline(F.concat(
        every(e["cycles"], "cycle", fingerprint),
        every(e["components"], "component", lambda v: v),
        every(e["edges"], "edge", lambda v: F.concat_ws(" ", v["from"], v["kind"], v["to"])),
        every(n["modules"], "module", lambda v: v),
        every(n["cycleCuts"], "cut", cut_text),
    )))


def checks(r: Repositories, expected: DataFrame) -> DataFrame:
    """repo_id, what, ok of expected (repo_id, expect): listed facts must exist, more may; scores, numbers of dimensions and tokens."""
    contexts = r.contexts()
    facts_met = met(wanted(expected), facts(r, contexts)).select("repo_id", F.concat_ws(" ", "kind", "fact").alias("what"), "ok")
    e = expected.join(r.metrics.select("repo_id", "score"), "repo_id", "left").join(contexts.select("repo_id", estimated_tokens(F.col("context")).alias("tokens")), "repo_id", "left")
    one = lambda wish, what, ok: F.when(wish.isNotNull(), F.struct(F.lit(what).alias("what"), ok.alias("ok")))
    m, most = F.col("expect.metrics"), F.col("expect.narration.maxEstimatedTokens")
    numbers = F.array_compact(F.array(
        one(m["score"], "score", m["score"] == F.coalesce("score", F.lit(0))),
        one(m["dimensionCount"], "dimensions", m["dimensionCount"] == F.when(F.col("score").isNull(), 0).otherwise(3)),
        one(most, "tokens", F.col("tokens") <= most),
    ))
    return facts_met.unionByName(e.select("repo_id", F.inline(numbers)))


def folders(root: str) -> list[str]:
    """Folders under root that have an expected.json, by name."""
    return [os.path.join(root, d) for d in sorted(os.listdir(root)) if os.path.isfile(os.path.join(root, d, EXPECTED))]


def evaluate_all(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(verdicts, checks: name, what, ok) of folders with an expected.json, all in one plan."""
    names = [(os.path.basename(os.path.normpath(f)), os.path.abspath(f)) for f in roots]
    r = repositories(spark.createDataFrame(names, "repo_id string, root string"))
    read = F.from_json("text", EXPECTATIONS)
    expected = r.settings.where(F.col("path") == EXPECTED).select("repo_id", F.coalesce(read["status"], F.lit("expected-pass")).alias("status"), read["expect"].alias("expect"))
    done = Stages(spark, "checks").put(checks(r, expected).withColumnRenamed("repo_id", "name"), "checks")
    return verdicts(done, expected.select(F.col("repo_id").alias("name"), "status")), done


def evaluate(spark: SparkSession, folder: str) -> tuple[str, list[tuple[str, bool]]]:
    """(outcome, checks) of one folder."""
    found, done = evaluate_all(spark, [folder])
    return found.first()["outcome"], [(r["what"], r["ok"]) for r in done.orderBy("what").collect()]


def main(argv: list[str] | None = None) -> int:
    """1 if any folder has regressed, 0 otherwise."""
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("folder")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera-evaluate").getOrCreate()
    found, done = evaluate_all(spark, folders(args.folder))
    rows = found.orderBy("name").collect()
    missing: dict = {}
    for x in done.where("not ok").orderBy("name", "what").collect():
        missing.setdefault(x["name"], []).append(x["what"])
    for r in rows:
        print(f"{r['outcome']:<12}{r['name']}")
        for x in missing.get(r["name"], ()):
            print(f"            missing: {x}")
    for t in tally(found).orderBy("outcome").collect():
        print(f"{t['n']:>4} {t['outcome']} ({t['share']:.0%})")
    return int(any(r["outcome"] == "REGRESSION" for r in rows))


if __name__ == "__main__":
    raise SystemExit(main())
