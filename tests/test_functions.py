"""Column functions on the inputs where engines differ."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars as fn
from tessera.operators import metrics, retrieval, rules, summary
from tessera.plans.report import escape_html


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "n"), [("", 1), ("a\n", 2), ("a\r\nb", 2), ("\n\n", 3)])
def test_line_count(spark, text, n):
    assert one(spark, fn.line_count(F.col("t")), t=text) == n


@pytest.mark.parametrize(("text", "n"), [("éif (x) ? if(a) && motif ifé", 6), ("a?.b ?? c", 4), ("case_x catch", 2), ("", 1)])
def test_complexity_has_ascii_boundaries(spark, text, n):
    assert one(spark, fn.complexity(F.col("t")), t=text) == n


def test_rules_know_script_spaces(spark):
    assert one(spark, rules.conditional_hook(F.col("p"), F.col("t")), p="a.tsx", t="useX (1); if (x) { useY")
    assert not one(spark, rules.conditional_hook(F.col("p"), F.col("t")), p="a.ts", t="useX(1); if (x) { useY")
    assert not one(spark, rules.too_long(F.col("t")), t="\n" * 499) and one(spark, rules.too_long(F.col("t")), t="\n" * 500)


def test_scores_round_half_up_and_clamp(spark):
    assert [one(spark, fn.to_score(F.col("v")), v=v) for v in (87.5, -3.0, 120.0, 0.49)] == [88, 0, 100, 0]


def test_paths(spark):
    assert one(spark, fn.ignored(F.col("p")), p="a/node_modules/b.ts") and not one(spark, fn.ignored(F.col("p")), p="src/dist.ts")
    assert one(spark, fn.top_folder(F.col("p")), p="a.ts") == "a.ts" and one(spark, fn.top_folder(F.col("p")), p="") == "."
    assert one(spark, fn.language(F.col("p")), p="x/Y.TSX") == "tsx" and one(spark, fn.language(F.col("p")), p="x.mts") is None


def test_stack_priorities():
    assert metrics.parse_package("null") == metrics.parse_package("[]") == metrics.parse_package("{") == metrics.parse_package(None) == []
    assert metrics.parse_package('{"dependencies": {"vue": "3"}, "peerDependencies": {"vue": "2"}}') == [(0, "vue", "3"), (2, "vue", "2")]


def test_stack_row(spark):
    files = spark.createDataFrame([("r", "src/app/page.tsx"), ("r", "b.vue")], "repo_id string, path string")
    deps = metrics.merged_dependencies(spark.createDataFrame([("r", 0, "react", "1"), ("r", 1, "react", "2"), ("r", 0, "vite", "5"), ("r", 0, "zustand", "4")], "repo_id string, rank int, name string, version string"))
    row = metrics.stack(files, deps).first()
    assert (row["framework"], row["framework_version"], row["build_tool"], list(row["state_management"]), row["router"]) == ("React", "2", "Vite", ["Zustand"], None)
    assert row["confidence"] == 0.7 + 3 * 0.06 and row["evidence"][-1] == "App Router entry detected"


def test_narration_schema(spark):
    good = '{"summary": "s", "layering": [], "risks": [{"title": "t", "severity": "high", "rationale": "r", "suggestion": "x", "relatedPaths": []}]}'
    assert one(spark, summary.narration(F.col("t")), t=good)["summary"] == "s"
    assert one(spark, summary.narration(F.col("t")), t='{"summary": "s"}') is None and one(spark, summary.narration(F.col("t")), t="no") is None


def test_relation_bonus_and_barrels(spark):
    assert one(spark, retrieval.relation_bonus(F.col("n")), n=300) == 25 and one(spark, retrieval.relation_bonus(F.lit(None).cast("long")), n=1) == 0


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="找订单组件 abAB_-19", max_size=20))
def test_query_terms_of_any_question(spark, text):
    runs = "".join(c if "一" <= c <= "龥" else " " for c in text).split()
    pairs = [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
    code = "".join(c if c in "abAB_-19" else " " for c in text).lower().split()
    words = [w for w in (x.lstrip("_-19") for x in code) if len(w) > 1] + pairs
    want = [w for w in dict.fromkeys(words) if w and len(w) <= retrieval.LONGEST_TERM and w not in retrieval.STOP_WORDS]
    plan = retrieval.parse_query(spark, text)
    near = [v for k, vs in retrieval.CONCEPTS.items() if k in text for v in vs]
    assert plan["terms"] == want and plan["concepts"] == list(dict.fromkeys(near + want)) and (plan["symbol_kinds"] == ["component"]) == ("组件" in text)


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="a<>&\"'; é", max_size=20))
def test_escape_agrees_with_the_driver(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(fn.html_escape(F.col("t")).alias("x")).first()["x"] == escape_html(text)
