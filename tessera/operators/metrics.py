"""Maintainability scores and stack detection."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import language_label, to_score

# Libraries by which parts of a stack are known, in order of priority.
FRAMEWORKS = (("next", "Next.js"), ("nuxt", "Nuxt"), ("react", "React"), ("vue", "Vue"))
BUILD_TOOLS = (("vite", "Vite"), ("webpack", "Webpack"), ("@rspack/core", "Rspack"))
STATE = ((("@reduxjs/toolkit", "redux"), "Redux"), (("zustand",), "Zustand"), (("pinia",), "Pinia"))
ROUTERS = (("react-router", "React Router"), ("react-router-dom", "React Router"), ("vue-router", "Vue Router"))
APP_ENTRIES = ("src/app/page.tsx", "app/page.tsx")


def maintainability(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per repo_id of files: complexity, coupling and typing scores, and the mean of the rounded three.
    A repository without files has no row: score 0 and no dimensions (see metrics_of)."""
    f = files.groupBy("repo_id").agg(F.count("*").alias("n"), F.avg("complexity").alias("c"), F.count_if(F.startswith("language", F.lit("ts"))).alias("typed"))
    e = edges.where("kind = 'import'").join(files.select("repo_id", F.col("id").alias("src")).distinct(), ["repo_id", "src"], "left_semi").groupBy("repo_id").agg(F.count("*").alias("m"))
    t = f.join(e, "repo_id", "left")
    t = t.select("repo_id", to_score(100 - 5 * F.col("c")).alias("complexity"), to_score(100 - 10 * F.coalesce("m", F.lit(0)) / F.col("n")).alias("coupling"), to_score(100 * F.col("typed") / F.col("n")).alias("typing"))
    return t.withColumn("score", F.floor((F.col("complexity") + F.col("coupling") + F.col("typing")) / 3 + 0.5).cast("int"))


def first_of(deps: Column, choices: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first library that a map of dependencies has; null without."""
    out = F.lit(None).cast("string")
    for name, label in reversed(choices):
        out = F.when(has(deps, name), label).otherwise(out)
    return out


def has(deps: Column, name: str) -> Column:
    return F.coalesce(F.element_at(deps, F.lit(name)) != "", F.lit(False))


def state_libraries(deps: Column) -> Column:
    def any_of(names: tuple[str, ...]) -> Column:
        out = has(deps, names[0])
        for n in names[1:]:
            out = out | has(deps, n)
        return out

    return F.array_compact(F.array(*(F.when(any_of(names), label) for names, label in STATE)))


def confidence(framework: Column, signals: Column) -> Column:
    return F.when(framework.isNotNull(), F.least(F.lit(0.99), F.lit(0.7) + signals * F.lit(0.06))).otherwise(F.lit(0.25))


def merged_dependencies(parts: DataFrame) -> DataFrame:
    """One map per repo_id; of a library in several sections the one of the last rank counts. parts: repo_id, rank, name, version."""
    one = parts.groupBy("repo_id", "name").agg(F.max_by("version", "rank").alias("version"))
    return one.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "version")))).alias("deps"))


def parse_package(text: str | None) -> list[tuple[int, str, str]]:
    """(rank, library, version) of a package description; nothing of one that is missing, broken or no object."""
    try:
        pkg = json.loads(text) if text else {}
    except ValueError:
        pkg = {}
    if not isinstance(pkg, dict):
        return []
    out = []
    for rank, section in enumerate(("dependencies", "devDependencies", "peerDependencies")):
        deps = pkg.get(section)
        out += [(rank, str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in (deps.items() if isinstance(deps, dict) else ())]
    return out


def package_rows(texts: DataFrame) -> DataFrame:
    """repo_id, rank, name, version of repo_id, text: what package descriptions list; nothing of those that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, *x) for r, t in zip(b["repo_id"], b["text"], strict=True) for x in parse_package(t)]
            yield pd.DataFrame(rows, columns=["repo_id", "rank", "name", "version"])

    return texts.select("repo_id", "text").mapInPandas(run, "repo_id string, rank int, name string, version string")


def stack(files: DataFrame, deps: DataFrame) -> DataFrame:
    """One row per repo_id of files. deps: repo_id, deps (a map)."""
    ranked = files.select("repo_id", "path", language_label(F.col("path")).alias("label"))
    labels = ranked.groupBy("repo_id", "label").agg(F.min(F.struct(F.collate("path", "UNICODE").alias("c"), "path")).alias("first")).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("ls"))
    entry = files.groupBy("repo_id").agg(F.bool_or(F.col("path").isin(*APP_ENTRIES)).alias("app"))
    t = labels.join(entry, "repo_id").join(deps, "repo_id", "left").withColumn("deps", F.coalesce("deps", F.create_map().cast("map<string,string>")))
    d = F.col("deps")
    t = t.select("repo_id", "app", "deps", F.transform("ls", lambda x: x["label"]).alias("language"), first_of(d, FRAMEWORKS).alias("framework"), first_of(d, BUILD_TOOLS).alias("build_tool"), state_libraries(d).alias("state_management"), first_of(d, ROUTERS).alias("router"))
    version = F.when(F.col("framework") == "React", F.element_at("deps", F.lit("react"))).when(F.col("framework") == "Vue", F.element_at("deps", F.lit("vue")))
    signals = F.col("framework").isNotNull().cast("int") + F.col("build_tool").isNotNull().cast("int") + F.size("state_management") + F.col("router").isNotNull().cast("int")
    named = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("package.json: "), F.col(c)))
    evidence = F.array_compact(F.array(named("framework"), named("build_tool"), F.when(F.col("app"), "App Router entry detected")))
    return t.select("repo_id", "framework", version.alias("framework_version"), "build_tool", "state_management", "language", "router", confidence(F.col("framework"), signals).alias("confidence"), evidence.alias("evidence"))
