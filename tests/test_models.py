"""A model as narrator and planner, with clients that answer from memory."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.plans import models
from tessera.plans.analysis import plan_query

TOLD = {"summary": "s", "layering": [{"layer": "ui", "role": "r"}], "risks": [{"title": "t", "severity": "low", "rationale": "a", "suggestion": "b", "relatedPaths": ["x.ts"]}]}
PLAN = {"concepts": ["order"], "symbol_kinds": ["hook"], "relation_kinds": ["import"], "terms": []}


def test_settings_of_a_model():
    assert models.Model.from_environment({}) is None and models.Model.from_environment({"OPENAI_API_KEY": "", "TESSERA_MODEL": "m"}) is None
    m = models.Model.from_environment({"OPENAI_API_KEY": "k1"})
    assert (m.key, m.name, m.address) == ("k1", models.DEFAULT_NAME, None) and "k1" not in repr(m)
    m = models.Model.from_environment({"OPENAI_API_KEY": "k1", "OPENAI_BASE_URL": "http://gate", "TESSERA_MODEL": "m"})
    assert (m.name, m.address) == ("m", "http://gate")


def test_narrator_gets_the_whole_summary_and_is_checked(spark):
    asked, model = [], models.Model("k")
    answers = iter([json.dumps(TOLD), '{"summary": "s"}', "no"])
    tell = models.narrator(spark, model, lambda *x: asked.append(x) or next(answers))
    context = {"stack": None, "cycles": [{"files": ["a.ts"], "totalFiles": 9}], "truncated": {"cycles": 2}}
    assert tell(context) == TOLD
    assert asked[0][:2] == (model, models.NARRATOR) and json.loads(asked[0][2].split("\n", 1)[1]) == context
    for _ in range(2):
        with pytest.raises(ValueError):
            tell(context)
    assert models.narrator(spark, None, lambda *x: "") is None


def test_planner_falls_back_to_the_rules(spark):
    answers = iter([json.dumps(PLAN), '{"concepts": ["x"]}', '{"concepts": [null], "symbol_kinds": [], "relation_kinds": [], "terms": []}'])
    plan = models.planner(spark, models.Model("k"), lambda model, system, query: next(answers))
    assert plan_query(spark, "找订单组件", plan) == PLAN
    for _ in range(2):
        assert plan_query(spark, "找订单组件", plan) == retrieval.parse_query(spark, "找订单组件")
    assert models.planner(spark, None, lambda *x: "") is None


def test_requests_of_many_summaries(spark):
    t = spark.createDataFrame([("a", (1, None)), ("b", (2, "x"))], "repo_id string, context struct<files:int,framework:string>")
    rows = t.select("repo_id", models.narrator_messages(F.col("context")).alias("m")).orderBy("repo_id").collect()
    assert [json.loads(r["m"]["message"].split("\n", 1)[1]) for r in rows] == [{"files": 1}, {"files": 2, "framework": "x"}]
    assert {r["m"]["system"] for r in rows} == {models.NARRATOR}
