"""Source trees of many repositories as tables. Folders are listed level by level, each by a task: the driver holds no path but the roots.
Built-in file sources hide names that start with an underscore, so tasks list and read; the roots are on a disk that all of them see."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import IGNORED_ENDINGS, IGNORED_FOLDERS, LANGUAGES, complexity, content_hash, decoded, file_id, language, line_count, reading_order
from ..staging import Stages

OUTPUT_FOLDER, INSTALLED = ".tessera", "node_modules"
#: Levels of folders, and bytes that a task reads before it passes them on.
MOST_LEVELS, READ_AHEAD = 1_000, 32 << 20
LISTED = "repo_id string, root string, path string, kind string, target string"


def entries(root: str, path: str, kind: str) -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, target) of what a folder holds: source, setting (JSON), folder, installed (packages), link (of a package). Ignored
    folders and names with a leading dot are left out; of installed packages only their descriptions and links are told."""
    for e in sorted(os.scandir(os.path.join(root, path)), key=lambda e: e.name):
        own = f"{path}/{e.name}" if path else e.name
        suffix = os.path.splitext(e.name)[1][1:].lower()
        if e.name.startswith("."):
            continue
        if kind == "installed":
            if e.is_symlink() and e.is_dir():
                target = os.path.relpath(os.path.realpath(e.path), os.path.realpath(root)).replace(os.sep, "/")
                yield own, "link", target
                if (target.startswith("..") or INSTALLED in target.split("/")) and os.path.isfile(os.path.join(e.path, "package.json")):
                    yield f"{target}/package.json", "setting", None
            elif e.is_dir() and e.name.startswith("@"):
                yield own, "installed", None
            elif e.is_dir():
                yield from ((f"{own}/{x.name}", "setting", None) for x in os.scandir(e.path) if x.name.endswith(".json") and x.is_file())
        elif e.is_dir(follow_symlinks=False):
            if e.name == INSTALLED:
                yield own, "installed", None
            elif e.name not in IGNORED_FOLDERS and e.name != OUTPUT_FOLDER:
                yield own, "folder", None
        elif e.is_file() and suffix == "json":
            yield own, "setting", None
        elif e.is_file() and suffix in LANGUAGES and not e.name.endswith(IGNORED_ENDINGS):
            yield own, "source", None


def listing(roots: DataFrame, stages: Stages) -> DataFrame:
    """repo_id, root, path, kind (source, setting or link), target. roots: repo_id, root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for repo, root, path, kind in zip(b["repo_id"], b["root"], b["path"], b["kind"], strict=True):
                yield pd.DataFrame([(repo, root, *x) for x in entries(root, path, kind)], columns=["repo_id", "root", "path", "kind", "target"])

    level, found = roots.select("repo_id", "root", F.lit("").alias("path"), F.lit("folder").alias("kind")), []
    for k in range(MOST_LEVELS):
        seen = stages.put(level.repartition("repo_id", "path").mapInPandas(run, LISTED), f"level{k}")
        found.append(seen.where("kind in ('source', 'setting', 'link')"))
        level = seen.where("kind in ('folder', 'installed')").select("repo_id", "root", "path", "kind")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
    raise RuntimeError("folders are nested too deep")


def with_bytes(paths: DataFrame) -> DataFrame:
    """repo_id, path, raw of files. paths: repo_id, root, path. Tasks pass on what they have read as soon as it is large."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for repo, root, path in zip(b["repo_id"], b["root"], b["path"], strict=True):
                with open(os.path.join(root, path), "rb") as f:
                    rows.append((repo, path, f.read()))
                size += len(rows[-1][2])
                if size > READ_AHEAD:
                    yield pd.DataFrame(rows, columns=["repo_id", "path", "raw"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["repo_id", "path", "raw"])

    return paths.select("repo_id", "root", "path").repartition("repo_id", "path").mapInPandas(run, "repo_id string, path string, raw binary")


def scan(roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, contents, settings, links) of repositories. roots: repo_id, root (a folder's absolute path)."""
    stages = Stages(roots.sparkSession, "scan")
    found = listing(roots, stages)
    files, contents = file_tables(with_bytes(found.where("kind = 'source'")))
    settings = with_bytes(found.where("kind = 'setting'")).select("repo_id", "path", decoded(F.col("raw")).alias("text"))
    return files, contents, stages.put(settings, "settings"), found.where("kind = 'link'").select("repo_id", "path", "target")


def require_folder(root: str) -> str:
    """The absolute path of a folder that exists: nothing is made where none is."""
    if not root:
        raise ValueError("root is required")
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a folder: {root}")
    return os.path.abspath(root)


def file_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw: repo_id, path, raw bytes."""
    rows = raw.withColumns({"language": language(F.col("path")), "content": decoded(F.col("raw"))}).where("language is not null")
    files = rows.select("repo_id", file_id(F.col("path")).alias("id"), "path", "language", F.octet_length("raw").cast("long").alias("size"), content_hash(F.col("content")).alias("content_hash"), line_count(F.col("content")).alias("line_count"), complexity(F.col("content")).alias("complexity"))
    return files, rows.select("repo_id", "path", "content")


def in_reading_order(files: DataFrame, column: str = "place") -> DataFrame:
    """files with their place in their repository, from 0 on: by path as people sort names, then by code points. Only what files has is
    sorted, not what is found in them."""
    w = Window.partitionBy("repo_id").orderBy(*reading_order(F.col("path")))
    return files.withColumn(column, F.row_number().over(w).cast("long") - 1)


def ordinal(path: Column, place: Column, section: Column, pos: Column) -> Column:
    """One number for the order of what is found in files: sources before single-file components, then the file's place, the section
    (below 16) and the position (below 2 ** 28) in it. It needs no sort of its own."""
    vue = F.when(F.endswith(F.lower(path), F.lit(".vue")), F.lit(1 << 62)).otherwise(F.lit(0))
    return (vue.cast("long") + F.shiftleft(place.cast("long"), 32) + F.shiftleft(section.cast("long"), 28) + pos).cast("long")
