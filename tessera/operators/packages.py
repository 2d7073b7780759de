"""Compiler configurations and package descriptions of many repositories, as tables that specifiers are joined with.

settings (repo_id, path, text): JSON files by their path from the repository's root. links (repo_id, path, target): links to folders, as
workspaces make them in node_modules; a target that leaves the tree starts with "..". Nothing is held by the driver: chains of
configurations are followed level by level, packages are found by a join of the folders above a file with what is installed there.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Stages

# Names of configurations, best first; conditions that a bundler's import meets; entries of a package without exports, best first.
CONFIGURATIONS = ("tsconfig.json", "jsconfig.json")
CONDITIONS = frozenset(("import", "types", "default"))
ENTRIES = ("types", "typings", "main")
INSTALLED = "node_modules"
#: Levels of configurations that extend others.
MOST_LEVELS = 64
PLACES = "array<array<struct<at:string,tail:string>>>"


def parse_json(text: str | None) -> dict:
    """An object with comments and closing commas; {} where it can't be read."""
    if not text:
        return {}
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    kept = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept)
    try:
        found = json.loads(kept)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def folders_above(folder: str) -> list[str]:
    """The folder, those above it, and the root (an empty name)."""
    parts = [p for p in folder.split("/") if p]
    return ["/".join(parts[:k]) for k in range(len(parts), -1, -1)]


def split_package(spec: str) -> tuple[str, str]:
    """(name, the rest) of a bare specifier; names with a scope have two parts."""
    parts = spec.split("/")
    n = 2 if spec.startswith("@") else 1
    return "/".join(parts[:n]), "/".join(parts[n:])


def joined(*parts: str) -> str:
    path = posixpath.normpath(posixpath.join(*(p for p in parts if p), "."))
    return "" if path == "." else path


# --- configurations ------------------------------------------------------------------------------------------------------


def parents_of(path: str, spec: str) -> list[dict]:
    """Where a configuration that another at path extends may be, best first: a tail below a folder that may be a link, or a whole path."""
    folder = posixpath.dirname(path)
    if spec.startswith((".", "/")):
        at = joined(folder, spec.lstrip("/") if spec.startswith("/") else spec)
        return [{"at": None, "tail": at}, {"at": None, "tail": at + ".json"}]
    name, rest = split_package(spec)
    tails = [rest, rest + ".json", rest + "/tsconfig.json"] if rest else ["tsconfig.json"]
    return [{"at": joined(f, INSTALLED, name), "tail": t} for f in folders_above(folder) for t in tails]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"], strict=True):
            whole = parse_json(text)
            options = whole.get("compilerOptions")
            options = options if isinstance(options, dict) else {}
            up = whole.get("extends", ())
            base, paths = options.get("baseUrl"), options.get("paths")
            kept = {str(k): [str(x) for x in v] for k, v in paths.items() if isinstance(v, list)} if isinstance(paths, dict) else None
            rows.append((joined(posixpath.dirname(path), base) if isinstance(base, str) else None, kept, posixpath.dirname(path), [parents_of(path, x) for x in ([up] if isinstance(up, str) else up) if isinstance(x, str)]))
        own = pd.DataFrame(rows, columns=["base_url", "paths", "folder", "parents"], index=b.index)
        yield pd.concat([b[["repo_id", "path", "key", "above"]], own], axis=1)


def configurations(settings: DataFrame, links: DataFrame) -> DataFrame:
    """repo_id, base_url, paths, base of the configuration at each root with those it extends: its own options first, then those of what
    it extends last. base_url and base, the folder that targets of paths start from, are paths from the root, which is an empty name.
    A configuration that extends itself in the end is taken once; one that isn't there, or can't be read, gives nothing."""
    stages = Stages(settings.sparkSession, "configurations")
    rank = F.array_position(F.array(*map(F.lit, CONFIGURATIONS)), F.col("path"))
    first = settings.where(F.col("path").isin(*CONFIGURATIONS)).groupBy("repo_id").agg(F.min_by(F.struct("path", "text"), rank).alias("x"))
    level = first.select("repo_id", "x.path", "x.text", F.array().cast("array<int>").alias("key"), F.array("x.path").alias("above"))
    found = []
    for k in range(MOST_LEVELS):
        own = stages.put(level.mapInPandas(_parsed, f"repo_id string, path string, key array<int>, above array<string>, base_url string, paths map<string,array<string>>, folder string, parents {PLACES}"), f"level{k}")
        found.append(own)
        up = own.select("repo_id", "key", "above", F.size("parents").alias("n"), F.posexplode("parents").alias("i", "places"))
        if up.isEmpty():
            break
        # keys sort as options win: a configuration before all that it extends, the last of these first
        each = up.select("repo_id", "above", F.concat("key", F.array((F.col("n") - 1 - F.col("i")).cast("int"))).alias("key"), F.posexplode("places").alias("rank", "place"))
        at = each.join(links.select("repo_id", F.col("path").alias("at"), "target"), (each["repo_id"] == links["repo_id"]) & (F.col("place.at") == F.col("at")), "left").drop(links["repo_id"])
        whole = at.select("repo_id", "above", "key", "rank", F.concat_ws("/", F.coalesce("target", "place.at"), "place.tail").alias("path"))
        hit = whole.join(settings.select("repo_id", "path", "text"), ["repo_id", "path"]).groupBy("repo_id", "key").agg(F.min_by(F.struct("path", "text", "above"), "rank").alias("x"))
        level = hit.where(~F.array_contains("x.above", F.col("x.path"))).select("repo_id", "x.path", "x.text", "key", F.array_append("x.above", F.col("x.path")).alias("above"))
    every = reduce(DataFrame.unionByName, found)
    best = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.struct(c, "folder")), F.when(F.col(c).isNotNull(), F.col("key"))).alias(f"of_{c}")
    one = every.groupBy("repo_id").agg(best("base_url"), best("paths"))
    return one.select("repo_id", F.col("of_base_url.base_url").alias("base_url"), F.col("of_paths.paths").alias("paths"), F.coalesce("of_base_url.base_url", "of_paths.folder").alias("base"))


# --- packages ------------------------------------------------------------------------------------------------------------


def condition_target(tree, star: str) -> list[str] | None:
    """The targets of an entry of exports or imports, best first: of an object the first key that is met and leads anywhere, of a list
    all. None where nothing is met; [] where the entry is closed (null)."""
    if tree is None:
        return []
    if isinstance(tree, str):
        return [tree.replace("*", star)]
    if isinstance(tree, list):
        every = [t for t in (condition_target(x, star) for x in tree) if t]
        return [x for t in every for x in t] or None
    if isinstance(tree, dict):
        for key, below in tree.items():
            if key in CONDITIONS and (found := condition_target(below, star)) is not None:
                return found
    return None


def matching_entry(entries: dict, request: str) -> tuple[object, str] | None:
    """(entry, what the star stands for) of a request: its own name, else the pattern with the longest head."""
    if request in entries and "*" not in request:
        return entries[request], ""
    best = None
    for key in entries:
        head, star, tail = key.partition("*")
        fits = star and request.startswith(head) and request != head and request.endswith(tail) and len(request) >= len(key)
        if fits and (best is None or (len(head), len(key)) > (len(best.partition("*")[0]), len(best))):
            best = key
    if best is None:
        return None
    head, _, tail = best.partition("*")
    return entries[best], request[len(head) : len(request) - len(tail)]


def targets(text: str | None, kind: str, request: str) -> dict:
    """What a package's description makes of a request: files (paths from its folder, exactly these or what was compiled to them), loose
    (paths that lack a suffix or an index), again (specifiers of other packages). kind: package, self or import (of its own imports)."""
    whole = parse_json(text)
    out: dict = {"files": [], "loose": [], "again": []}
    table = whole.get("imports" if kind == "import" else "exports")
    if table is None:
        if kind == "package":
            rest = request[2:]
            out["loose"] = [rest] if rest else [*(whole[e] for e in ENTRIES if isinstance(whole.get(e), str)), ""]
        return out
    if kind != "import" and not (isinstance(table, dict) and all(k.startswith(".") for k in table)):
        table = {".": table}  # an entry for the package itself
    hit = matching_entry(table, request) if isinstance(table, dict) else None
    for target in (condition_target(*hit) if hit else None) or ():
        if target.startswith("./"):
            out["files"].append(target[2:])
        elif kind == "import" and not target.startswith((".", "/", "#")):
            out["again"].append(target)
    return out


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folders in which the package of a specifier may be described, best first."""
    for b in batches:
        rows = []
        for repo, path, spec in zip(b["repo_id"], b["path"], b["spec"], strict=True):
            if spec.startswith((".", "/")) or not spec or path.lower().endswith(".vue"):
                continue
            above = folders_above(posixpath.dirname(path))
            if spec.startswith("#"):
                rows += [(repo, path, spec, "import", k, f, spec, None) for k, f in enumerate(above)]
                continue
            name, rest = split_package(spec)
            request = f"./{rest}" if rest else "."
            rows += [(repo, path, spec, "self", k, f, request, name) for k, f in enumerate(above)]
            rows += [(repo, path, spec, "package", k, joined(f, INSTALLED, name), request, name) for k, f in enumerate(above)]
        yield pd.DataFrame(rows, columns=["repo_id", "path", "spec", "kind", "rank", "at", "request", "name"])


def package_paths(specs: DataFrame, settings: DataFrame, links: DataFrame, deep: bool = True) -> DataFrame:
    """repo_id, path, spec, exact and loose: the paths from the root that a specifier names by a package or by its own package's imports,
    best first. specs: repo_id, path, spec, distinct. The nearest folder that has the package counts, and where that
    closes the request nothing else does. An import that leads to another package is followed once."""
    stages = Stages(specs.sparkSession, "packages")
    asked = specs.mapInPandas(_asked, "repo_id string, path string, spec string, kind string, rank int, at string, request string, name string")
    real = asked.join(links.select("repo_id", F.col("path").alias("at"), "target"), ["repo_id", "at"], "left").withColumn("real", F.coalesce("target", "at"))
    described = settings.where(F.regexp_like("path", F.lit("(^|/)package\\.json$"))).select("repo_id", F.regexp_replace("path", "/?package\\.json$", "").alias("real"), F.col("text").alias("manifest"))
    there = real.join(described.select("repo_id", "real", F.lit(True).alias("described")), ["repo_id", "real"], "left").where("described or target is not null")
    near = there.groupBy("repo_id", "path", "spec", "kind").agg(F.min_by(F.struct("real", "request", "name"), "rank").alias("x")).select("repo_id", "path", "spec", "kind", "x.*")
    near = stages.put(near, "near")  # read twice, and its joins are of all folders above a file
    # each description answers each request once
    requests = near.select("repo_id", "real", "kind", "request", "name").distinct().join(described, ["repo_id", "real"], "left")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, at, kind, request, name, text in zip(b["repo_id"], b["real"], b["kind"], b["request"], b["name"], b["manifest"], strict=True):
                own = kind != "self" or parse_json(text).get("name") == name
                t = targets(text, kind, request) if own else {"files": [], "loose": [], "again": []}
                rows.append((repo, at, kind, request, name, [joined(at, x) for x in t["files"]], [joined(at, x) for x in t["loose"]], t["again"]))
            yield pd.DataFrame(rows, columns=["repo_id", "real", "kind", "request", "name", "exact", "loose", "again"])

    answered = requests.mapInPandas(answer, "repo_id string, real string, kind string, request string, name string, exact array<string>, loose array<string>, again array<string>")
    same = [near[c].eqNullSafe(answered[c]) for c in ("repo_id", "real", "kind", "request", "name")]
    out = near.join(answered, reduce(lambda a, b: a & b, same)).select(near["repo_id"], "path", "spec", near["kind"], "exact", "loose", "again")
    if deep:
        out = stages.put(out, "out")
        further = out.where(F.size("again") > 0).select("repo_id", "path", F.col("spec").alias("own"), F.explode("again").alias("spec"))
        beyond = package_paths(further.select("repo_id", "path", "spec").distinct(), settings, links, deep=False)
        more = further.join(beyond, ["repo_id", "path", "spec"]).select("repo_id", "path", F.col("own").alias("spec"), F.lit("import").alias("kind"), "exact", "loose")
        out = out.drop("again").unionByName(more)
    # what a package says of itself comes before what is installed
    flat = lambda c: F.flatten(F.transform("xs", lambda x: x[c])).alias(c)
    each = out.groupBy("repo_id", "path", "spec").agg(F.sort_array(F.collect_list(F.struct((F.col("kind") == "package").alias("late"), "exact", "loose"))).alias("xs"))
    return each.select("repo_id", "path", "spec", flat("exact"), flat("loose"))
