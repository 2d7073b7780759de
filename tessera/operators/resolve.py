"""Module resolution as a ranked join: each specifier becomes its ordered candidates, and the best ranked file wins."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tree import in_reading_order, ordinal
from ..staging import Stages
from .packages import configurations, package_paths

# What may stand for a missing suffix, and index files of folders.
SUFFIXES = (".ts", ".tsx", ".d.ts", ".js", ".jsx")
INDEXES = ("index.ts", "index.tsx", "index.d.ts", "index.js", "index.jsx")
VUE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".vue")
VUE_INDEXES = ("index.ts", "index.tsx", "index.js", "index.vue")
#: A written suffix and the sources that may have been compiled to it.
REPLACED = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


@dataclass
class Surroundings:
    """What specifiers are resolved by, of all repositories at once. settings and links: see packages. elsewhere (repo_id, path): files
    that are there but weren't scanned; paths of those outside a repository's root start with "..". roots (repo_id, root): with it,
    candidates outside a root are looked up on the disk that tasks share."""

    settings: DataFrame
    links: DataFrame
    elsewhere: DataFrame
    roots: DataFrame | None = None

    @classmethod
    def none(cls, spark: SparkSession) -> Surroundings:
        empty = lambda *cs: spark.createDataFrame([], ", ".join(f"{c} string" for c in cs))
        return cls(empty("repo_id", "path", "text"), empty("repo_id", "path", "target"), empty("repo_id", "path"))


def outside_files(paths: DataFrame, around: Surroundings) -> DataFrame:
    """elsewhere, with those of paths (repo_id, path) that leave the tree and are on the disk."""
    if around.roots is None:
        return around.elsewhere

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[os.path.isfile(os.path.join(r, p)) for r, p in zip(b["root"], b["path"], strict=True)]][["repo_id", "path"]]

    asked = paths.where(F.startswith("path", F.lit("../"))).select("repo_id", "path").distinct().join(around.roots, "repo_id")
    return around.elsewhere.select("repo_id", "path").unionByName(asked.select("repo_id", "path", "root").mapInPandas(run, "repo_id string, path string"))


def _norm(path: str) -> str:
    return posixpath.normpath(path).lstrip("/")


def _files(base: str) -> list[str]:
    out = [base] if posixpath.splitext(base)[1] else []
    stem, suffix = posixpath.splitext(base)
    out += [stem + s for s in REPLACED.get(suffix, ())]
    out += [base + s for s in SUFFIXES]
    return out + [posixpath.join(base, x) for x in INDEXES]


def candidates(spec: str, source: str, config: dict, exact: Iterable[str] = (), loose: Iterable[str] = ()) -> list[str]:
    """Paths from the repository's root, best first; those that leave it start with "..". Sources never resolve to single-file components;
    these resolve relative specifiers only. config: baseUrl, paths, base; exact and loose: what packages say of the specifier."""
    folder = posixpath.dirname(source)
    if source.lower().endswith(".vue"):
        if not spec.startswith("."):
            return []
        base = posixpath.normpath(posixpath.join(folder, spec))
        found = [base, *(base + s for s in VUE_SUFFIXES), *(posixpath.join(base, x) for x in VUE_INDEXES)]
    elif spec.startswith("."):
        found = _files(posixpath.join(folder, spec))
    else:
        root, found = config.get("baseUrl"), []
        paths = config.get("paths") or {}
        named = [p for p in paths if p == spec]
        wild = sorted((p for p in paths if "*" in p and spec.startswith(p.split("*")[0]) and spec.endswith(p.split("*")[1]) and len(spec) >= len(p) - 1), key=lambda p: -len(p.split("*")[0]))
        for pattern in named or wild[:1]:
            head, _, tail = pattern.partition("*")
            middle = spec[len(head) : len(spec) - len(tail)] if "*" in pattern else ""
            for target in paths[pattern]:
                found += _files(posixpath.join(config.get("base") or root or "", target.replace("*", middle)))
        if root is not None and not spec.startswith("#"):
            found += _files(posixpath.join(root, spec))
        for path in exact:
            stem, suffix = posixpath.splitext(path)
            found += [stem + s for s in REPLACED.get(suffix, ())] + [path]
        for path in loose:
            found += _files(path)
    seen = dict.fromkeys(p for p in map(_norm, found) if p and p != "." and (source.lower().endswith(".vue") or not p.lower().endswith(".vue")))
    return list(seen)


def with_candidates(specs: DataFrame, around: Surroundings) -> DataFrame:
    """Distinct repo_id, path, spec with candidates. Configurations are joined as a table, a row a repository."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for spec, path, base_url, base, paths, exact, loose in zip(b["spec"], b["path"], b["base_url"], b["base"], b["paths"], b["exact"], b["loose"], strict=True):
                config = {"baseUrl": base_url, "base": base, "paths": {k: list(v) for k, v in paths.items()} if paths is not None else {}}
                found.append(candidates(spec, path, config, exact if exact is not None else (), loose if loose is not None else ()))
            yield b[["repo_id", "path", "spec"]].assign(candidates=found)

    pairs = specs.select("repo_id", "path", "spec").distinct()
    packaged = package_paths(pairs, around.settings, around.links)
    rows = pairs.join(packaged, ["repo_id", "path", "spec"], "left").join(configurations(around.settings, around.links), "repo_id", "left")
    return rows.select("repo_id", "path", "spec", "base_url", "base", "paths", "exact", "loose").mapInPandas(run, "repo_id string, path string, spec string, candidates array<string>")


def ranked_match(ranked: DataFrame, files: DataFrame, key: list[str], exact_only: DataFrame | None = None) -> DataFrame:
    """key and the best target. An exact path beats one that agrees but for case; then the better rank; of files that differ in case alone
    the last in reading order. ranked: repo_id, rank, candidate and the key; files, and exact_only, which match by the exact path alone: repo_id, id, path."""
    whole = files.select("repo_id", "id", "path")
    exact = ranked.join((whole.unionByName(exact_only) if exact_only is not None else whole).select("repo_id", F.col("path").alias("candidate"), F.col("id").alias("target")), ["repo_id", "candidate"])
    lower = files.groupBy("repo_id", F.lower("path").alias("low")).agg(F.max_by("id", F.struct(F.collate("path", "UNICODE").alias("c"), "path")).alias("target"))
    loose = ranked.withColumn("low", F.lower("candidate")).join(lower, ["repo_id", "low"])
    both = exact.select(*key, "rank", "target", F.lit(0).alias("loose")).unionByName(loose.select(*key, "rank", "target", F.lit(1).alias("loose")))
    return both.groupBy(*key).agg(F.min_by("target", F.struct("loose", "rank")).alias("target"))


def matched(specs: DataFrame, files: DataFrame, around: Surroundings) -> DataFrame:
    """repo_id, path, spec, target (a scanned file's id, or null), outside: whether the specifier resolves to a file outside the tree. What
    resolves to a file that a scan leaves out, or to nothing, has neither. A file that is there takes a specifier from worse candidates,
    scanned or not."""
    made = Stages(files.sparkSession, "resolve").put(with_candidates(specs, around), "candidates")
    ranked = made.select("repo_id", "path", "spec", F.posexplode("candidates").alias("rank", "candidate"))
    key = ["repo_id", "path", "spec"]
    beyond = outside_files(ranked.select("repo_id", F.col("candidate").alias("path")), around)
    beyond = beyond.select("repo_id", F.concat(F.lit("/"), "path").alias("id"), "path")  # ids of scanned files have no slash in front
    found = ranked_match(ranked, files, key, beyond)
    other = F.startswith("target", F.lit("/"))
    return made.select(*key).join(found, key, "left").select(*key, F.when(~other, F.col("target")).alias("target"), F.coalesce(F.startswith("target", F.lit("/../")), F.lit(False)).alias("outside"))


def dependency_edges(fact_rows: DataFrame, files: DataFrame, around: Surroundings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, unresolved specifiers, resolved specifiers). unresolved: repo_id, path, spec, outside (it resolves to a file outside the
    tree; other ones are packages, files that a scan leaves out, or nowhere). Import edges: static ones, re-exports, then dynamic ones of a
    file, then render edges; a file's edge to itself is none."""
    deps = fact_rows.where("rec in ('import', 'export', 'dynamic')").select("repo_id", "file_id", "path", "rec", "pos", "spec", "start_line")
    every = matched(deps, files, around)
    resolved, unresolved = every.where("target is not null").drop("outside"), every.where("target is null").drop("target")
    hits = deps.join(resolved, ["repo_id", "path", "spec"])
    section = F.array_position(F.array(*map(F.lit, ("import", "export", "dynamic"))), F.col("rec")).cast("int")
    imports = hits.where("target <> file_id").select("repo_id", F.col("file_id").alias("src"), F.col("target").alias("dst"), F.lit("import").alias("kind"), F.col("path").alias("file"), F.col("start_line").alias("line"), section.alias("section"), "pos")
    local = fact_rows.where("rec = 'name'").join(resolved, ["repo_id", "path", "spec"])
    local = local.groupBy("repo_id", "file_id", "name").agg(F.max_by("target", "pos").alias("target"))  # the last import of a name counts
    tags = fact_rows.where("rec = 'tag'").select("repo_id", "file_id", "path", F.split_part("name", F.lit("."), F.lit(1)).alias("name"), "pos", "start_line").where(F.regexp_like("name", F.lit("^[A-Z]")))
    drawn = tags.join(local, ["repo_id", "file_id", "name"]).where("target <> file_id")
    renders = drawn.groupBy("repo_id", "file_id", "path", "target").agg(F.min(F.struct("pos", "start_line")).alias("x"))
    renders = renders.select("repo_id", F.col("file_id").alias("src"), F.col("target").alias("dst"), F.lit("render").alias("kind"), F.col("path").alias("file"), F.col("x.start_line").alias("line"), F.lit(4).alias("section"), F.col("x.pos").alias("pos"))
    at = in_reading_order(files.select("repo_id", "id", "path")).select("repo_id", F.col("id").alias("src"), "place")
    every = imports.unionByName(renders).join(at, ["repo_id", "src"])
    edges = every.select("repo_id", "src", "dst", "kind", F.struct("file", "line").alias("location"), ordinal(F.col("file"), F.col("place"), F.col("section"), F.col("pos")).alias("ordinal"))
    return edges, unresolved, resolved
