"""Rule predicates over file contents, and finding tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import JS_SPACE, line_count

# The signs of a bypass, the longest file without a finding, the messages.
BYPASS = ("eslint-disable", "@ts-ignore")
MOST_LINES = 500
HOOK_MESSAGE = "疑似在条件分支中调用 Hook，请人工确认"
BYPASS_MESSAGE = "文件包含 lint/type 检查绕过指令"
LARGE_MESSAGE = "文件超过 {} 行，建议拆分职责"

_START = "(?<![A-Za-z0-9_])"


def conditional_hook(path: Column, content: Column) -> Column:
    """A component file that calls a hook and has one somewhere after a condition's opening brace: coarse by design."""
    call = rf"{_START}use[A-Z][A-Za-z0-9_]*{JS_SPACE}*\("
    branch = rf"{_START}(?:if|for|while){JS_SPACE}*\([^)]*\)[^{{]*\{{(?s:.*)use[A-Z]"
    return F.regexp_like(path, F.lit(r"\.(tsx|jsx)$")) & F.regexp_like(content, F.lit(call)) & F.regexp_like(content, F.lit(branch))


def bypasses(content: Column, signs: tuple[str, ...] = BYPASS) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(content, F.lit(s)) for s in signs))


def too_long(content: Column, most: int = MOST_LINES) -> Column:
    return line_count(content) > most


def frontend_findings(contents: DataFrame, signs: tuple[str, ...] = BYPASS, most: int = MOST_LINES) -> DataFrame:
    """Findings of all rules in one pass. contents: repo_id, path, content; other columns are carried."""

    def one(rule: str, severity: str, message: str, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))

    path, content = F.col("path"), F.col("content")
    found = F.array_compact(F.array(
        one("react-hooks-condition", "error", HOOK_MESSAGE, conditional_hook(path, content)),
        one("lint-bypass", "warning", BYPASS_MESSAGE, bypasses(content, signs)),
        one("large-file", "warning", LARGE_MESSAGE.format(most), too_long(content, most)),
    ))
    rest = [c for c in contents.columns if c not in ("content", "path")]
    return contents.select(*rest, "path", F.explode(found).alias("x")).select(*rest, "x.rule", "x.severity", "x.message", F.array("path").alias("files"), F.array().cast("array<string>").alias("evidence"))


def grouped_findings(findings: DataFrame, samples: int = 3, rules: int | None = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """rule, severity of the first, count, the first samples, by count. findings: rule, severity, files, ordinal. With by, in groups of
    these columns, with the rule's place (ordinal) in its group."""
    key, first = [*by, "rule"], F.coalesce(F.element_at("files", 1), F.lit(""))
    kept = findings.select(*key, "severity", "ordinal", first.alias("sample"))
    out = kept.groupBy(*key).agg(F.min_by("severity", "ordinal").alias("severity"), F.count("*").alias("count"), F.min("ordinal").alias("first"))
    # the few first of each salted part, then of each rule: no task holds a rule
    part = Window.partitionBy(*key, "salt").orderBy("ordinal")
    w = Window.partitionBy(*key).orderBy("ordinal")
    few = kept.withColumn("salt", F.pmod(F.xxhash64("ordinal"), F.lit(256))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= samples)
    top = few.withColumn("n", F.row_number().over(w)).where(F.col("n") <= samples).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "sample"))).alias("xs"))
    out = out.join(top, key).select(*key, "severity", "count", F.transform("xs", lambda x: x["sample"]).alias("samples"), "first")
    if by:
        out = out.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "first")))
        return out.where(F.col("ordinal") <= rules) if rules else out
    out = out.orderBy(F.desc("count"), "first")
    return out.limit(rules) if rules else out
