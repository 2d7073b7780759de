"""A language model as narrator and planner: its settings, the messages that it gets, and the check of its answers.

The engine has no network client of its own: ``Client`` is the caller's, (model, system message, message) to the answer's text. Without a
key there is no model, and the analysis goes on without.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators import summary

DEFAULT_NAME = "gpt-4o-mini"
PLAN = "concepts array<string>, symbol_kinds array<string>, relation_kinds array<string>, terms array<string>"
NARRATOR = """你负责向前端团队解释一份静态分析摘要。
- 摘要是唯一的事实来源；摘要没有写到的，不要补充。
- 环、复杂度和建议切点是算好的结果：说明它们的影响和处理次序，不要自己另算。
- truncated 是每个列表省略的条数，totalFiles 是一个环的全部文件数；列出来的只是其中一部分。
- 每条建议都要写明改哪个文件、怎么改。
答案是一个 JSON 对象：summary（字符串），layering（layer, role 的数组），risks（title, severity, rationale, suggestion, relatedPaths 的数组，severity 为 high、medium 或 low，先处理的在前）。"""
PLANNER = "把用户关于代码的问题改写成检索计划，只回答一个 JSON 对象，四个键都是字符串数组：concepts（业务概念与同义词），symbol_kinds（符号类型），relation_kinds（关系类型），terms（全文关键词）。"


@dataclass(frozen=True)
class Model:
    key: str = field(repr=False)
    name: str = DEFAULT_NAME
    address: str | None = None

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Model | None:
        """From OPENAI_API_KEY, OPENAI_BASE_URL and TESSERA_MODEL; None without a key."""
        env = os.environ if env is None else env
        key = env.get("OPENAI_API_KEY")
        return cls(key, env.get("TESSERA_MODEL") or DEFAULT_NAME, env.get("OPENAI_BASE_URL") or None) if key else None


Client = Callable[[Model, str, str], str]


def narrator_messages(context: Column) -> Column:
    """struct of system and message for a summary, so that a table of summaries becomes a table of requests."""
    return F.struct(F.lit(NARRATOR).alias("system"), F.concat(F.lit("分析摘要：\n"), F.to_json(context)).alias("message"))


def plan_of(answer: Column) -> Column:
    """A model's plan as a struct; null where the text is no such plan."""
    plan = F.from_json(answer, PLAN)
    whole = F.lit(True)
    for name in ("concepts", "symbol_kinds", "relation_kinds", "terms"):
        whole = whole & plan[name].isNotNull() & F.coalesce(F.forall(plan[name], lambda x: x.isNotNull()), F.lit(False))
    return F.when(whole, plan)


def _checked(spark: SparkSession, answer: str, of: Callable[[Column], Column]) -> dict:
    row = spark.range(1).select(of(F.lit(answer)).alias("x")).first()["x"]
    if row is None:
        raise ValueError("the model's answer isn't of the schema")
    return row.asDict(recursive=True)


def narrator(spark: SparkSession, model: Model | None, client: Client) -> Callable[[dict], dict] | None:
    """For ``Options.narrator``; None without a model. An answer of another schema raises, and the report goes on without."""
    if model is None:
        return None
    return lambda context: _checked(spark, client(model, NARRATOR, "分析摘要：\n" + json.dumps(context, ensure_ascii=False, separators=(",", ":"))), summary.narration)


def planner(spark: SparkSession, model: Model | None, client: Client) -> Callable[[str], dict] | None:
    """For ``Options.planner``; None without a model. An answer of another schema raises, and the rules make the plan."""
    if model is None:
        return None
    return lambda query: _checked(spark, client(model, PLANNER, query), plan_of)
