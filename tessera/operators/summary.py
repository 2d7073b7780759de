"""A bounded summary of an analysis, with the number of rows that each list leaves out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reading_order, token_estimate
from ..schema import NARRATION
from .rules import grouped_findings

# The longest lists of a summary.
MODULES, HOTSPOTS, CYCLES, CYCLE_FILES, RULES, SAMPLES = 12, 15, 10, 8, 12, 3


def hotspots(files: DataFrame, edges: DataFrame, most: int | None = HOTSPOTS) -> DataFrame:
    """repo_id, path, line_count, complexity, inbound, outbound by complexity + 3 * inbound, ties by path in reading order; imports only.
    With most, so many of each repository."""
    imports = edges.where("kind = 'import'")
    ins = imports.groupBy("repo_id", F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
    outs = imports.groupBy("repo_id", F.col("src").alias("id")).agg(F.count("*").alias("outbound"))
    t = files.join(ins, ["repo_id", "id"], "left").join(outs, ["repo_id", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    t = t.select("repo_id", "path", "line_count", "complexity", zero("inbound"), zero("outbound"))
    w = Window.partitionBy("repo_id").orderBy(F.desc(F.col("complexity") + 3 * F.col("inbound")), *reading_order(F.col("path")))
    t = t.withColumn("ordinal", F.row_number().over(w))
    return t.where(F.col("ordinal") <= most) if most else t


def scale(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, files, symbols, components, edges; also of a repository that lacks some."""
    f = files.groupBy("repo_id").agg(F.count("*").alias("files"))
    s = symbols.groupBy("repo_id").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "component").alias("components"))
    e = edges.groupBy("repo_id").agg(F.count("*").alias("edges"))
    t = f.join(s, "repo_id", "full").join(e, "repo_id", "full")
    return t.select("repo_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "symbols", "components", "edges")))


def left_out(n: Column, most: int) -> Column:
    return F.greatest(F.lit(0), n - most).cast("long")


@dataclass(frozen=True)
class Limits:
    modules: int = MODULES
    hotspots: int = HOTSPOTS
    cycles: int = CYCLES
    cycle_files: int = CYCLE_FILES
    rules: int = RULES
    samples: int = SAMPLES


def _top(rows: DataFrame, most: int | None, **fields: Column) -> tuple[DataFrame, DataFrame]:
    """(repo_id, the first rows by ordinal as an array of structs; repo_id, number of all rows). Rows beyond the limit aren't collected."""
    x = F.struct("ordinal", F.struct(*(c.alias(k) for k, c in fields.items())).alias("x"))
    few = rows if most is None else rows.where(F.col("ordinal") <= most)
    return few.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["x"]).alias("xs")), rows.groupBy("repo_id").agg(F.count("*").alias("n"))


def contexts(repos: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, stacks: DataFrame, metrics: DataFrame, directories: DataFrame, layer_rows: DataFrame, cycles: DataFrame, cuts: DataFrame, findings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """repo_id, context: a bounded summary of each of repos (repo_id), and how many rows each of its lists leaves out. A cut is of the whole cycle,
    only its display is trimmed. findings: those of the rules, cycles aside."""
    c = F.col
    lists = {
        "modules": _top(directories, limits.modules, path=c("path"), responsibility=c("responsibility"), files=c("files"), inbound=c("inbound"), outbound=c("outbound")),
        "layers": _top(layer_rows, None, name=c("name"), dependsOn=c("depends_on")),
        "hotspots": _top(hotspots(files, edges, None), limits.hotspots, path=c("path"), lineCount=c("line_count"), complexity=c("complexity"), inbound=c("inbound"), outbound=c("outbound")),
        "cycles": _top(
            cycles.join(cuts.withColumnRenamed("cycle", "ordinal"), ["repo_id", "ordinal"], "left").withColumn("ordinal", c("ordinal") + 1), limits.cycles,
            files=F.slice("files", 1, limits.cycle_files), totalFiles=F.size("files"), suggestedCut=F.when(c("src").isNotNull(), F.struct(c("src").alias("from"), c("dst").alias("to"), c("refs").alias("references"))),
        ),
        "findings": _top(grouped_findings(findings, limits.samples, None, ("repo_id",)), limits.rules, rule=c("rule"), severity=c("severity"), count=c("count"), samples=c("samples")),
    }
    out = repos.select("repo_id").join(scale(files, symbols, edges), "repo_id", "left").join(metrics, "repo_id", "left")
    own_stack = stacks.select("repo_id", F.struct("framework", c("build_tool").alias("buildTool"), c("state_management").alias("stateManagement"), "router").alias("stack"))
    out = out.join(own_stack, "repo_id", "left")
    sizes = F.struct(*(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("files", "symbols", "components", "edges")))
    told = F.when(c("score").isNull(), F.struct(F.lit(0).alias("score"), F.create_map().cast("map<string,int>").alias("dimensions"))).otherwise(F.struct("score", F.create_map(*(x for k in ("complexity", "coupling", "typing") for x in (F.lit(k), c(k)))).alias("dimensions")))
    out = out.select("repo_id", "stack", sizes.alias("scale"), told.alias("metrics"))
    for name, (few, n) in lists.items():
        out = out.join(few.withColumnRenamed("xs", name), "repo_id", "left").join(n.withColumnRenamed("n", f"n_{name}"), "repo_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(few.schema["xs"].dataType)))
    left = {"modules": limits.modules, "hotspots": limits.hotspots, "cycles": limits.cycles, "findings": limits.rules}
    truncated = F.struct(*(left_out(F.coalesce(f"n_{k}", F.lit(0)), most).alias("findingRules" if k == "findings" else k) for k, most in left.items()))
    return out.select("repo_id", F.struct("stack", "scale", "metrics", *lists, truncated.alias("truncated")).alias("context"))


def narration(text: Column) -> Column:
    """A model's account of a summary, as a struct of a fixed schema; null where the text isn't such an account."""
    told = F.from_json(text, NARRATION)
    whole = told["summary"].isNotNull() & told["layering"].isNotNull() & told["risks"].isNotNull()
    fit = F.forall(told["risks"], lambda r: F.coalesce(r["severity"].isin("high", "medium", "low"), F.lit(False)) & r["title"].isNotNull())
    return F.when(whole & fit, told)


def snapshot(metrics: dict, stack: dict, scale_row: dict) -> dict:
    """What a checkpoint keeps of a run: single values and counts, no lists of rows."""
    return {"framework": stack.get("framework"), "buildTool": stack.get("buildTool"), "score": metrics["score"]} | scale_row


def estimated_tokens(context: Column) -> Column:
    """Of a summary, as the JSON that a model is given; what is null isn't written."""
    return token_estimate(F.to_json(context))
