"""Symbols, dependencies, imported names and markup tags of source files, by one Arrow-batched pass over the contents.

The pass gives facts of one shape (rec says which); kinds and edges are made from them by built-in functions and joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import callable_kind, class_kind, variable_kind
from ..sources.tree import in_reading_order, ordinal
from .lexer import Lines, scan

FACTS = "repo_id string, file_id string, path string, rec string, pos int, name string, what string, exported boolean, start_line int, end_line int, base string, init string, callee string, spec string"
_SCHEMA = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split() for x in FACTS.split(", "))])

# How single-file components are read.
VUE_IMPORT = re.compile(r"(?:import\s+(?:[\s\S]*?\s+from\s+)?|export\s+[\s\S]*?\s+from\s+)['\"]([^'\"]+)['\"]")
VUE_SYMBOL = re.compile(r"\b(export\s+)?(?:async\s+)?(function|class|interface|type|const|let|var)\s+([A-Za-z_$][\w$]*)", re.ASCII)


def facts_of(path: str, content: str) -> list[dict]:
    """rec is symbol, import, export, dynamic, name (an imported name) or tag; pos is the order within rec."""
    line = Lines(content)
    out: list[dict] = []
    if path.lower().endswith(".vue"):
        for k, m in enumerate(VUE_SYMBOL.finditer(content)):
            out.append({"rec": "vue-symbol", "pos": k, "name": m[3], "what": m[2], "exported": m[1] is not None, "start_line": line(m.start()), "end_line": line(m.start())})
        for k, m in enumerate(VUE_IMPORT.finditer(content)):
            out.append({"rec": "import", "pos": k, "spec": m[1], "start_line": line(m.start())})
        return out
    module = scan(content, path.lower().endswith((".tsx", ".jsx")))
    for k, s in enumerate(module.symbols):
        out.append({"rec": "symbol", "pos": k, "name": s.name, "what": s.what, "exported": s.exported, "start_line": line(s.start), "end_line": line(max(s.start, s.end - 1)), "base": s.base, "init": s.init, "callee": s.callee})
    for rec, rows in (("import", module.imports), ("export", module.exports), ("dynamic", module.dynamic)):
        out += [{"rec": rec, "pos": k, "spec": spec, "start_line": line(at)} for k, (spec, at) in enumerate(rows)]
    out += [{"rec": "name", "pos": k, "name": name, "spec": spec} for k, (name, spec) in enumerate(module.names)]
    out += [{"rec": "tag", "pos": k, "name": name, "start_line": line(at)} for k, (name, at) in enumerate(module.tags)]
    return out


def facts(files: DataFrame, contents: DataFrame) -> DataFrame:
    """files: repo_id, id, path; contents: repo_id, path, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, file_id, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "file_id", "path", "content")), strict=True):
                rows += [{"repo_id": repo, "file_id": file_id, "path": path} | f for f in facts_of(path, content or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    joined = contents.join(files.select("repo_id", F.col("id").alias("file_id"), "path"), ["repo_id", "path"])
    # dealt by number, so that small trees aren't put together into one task either: reading code costs far more than moving it
    tasks = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.select("repo_id", "file_id", "path", "content").repartition(tasks, "repo_id", "path").mapInArrow(run, FACTS)


def symbols(fact_rows: DataFrame, files: DataFrame) -> DataFrame:
    """With kinds. Order: sources before single-file components, then path in reading order, then place."""
    place = in_reading_order(files.select("repo_id", "id", "path")).select("repo_id", F.col("id").alias("file_id"), "place")
    s = fact_rows.where("rec in ('symbol', 'vue-symbol')").join(place, ["repo_id", "file_id"])
    vue = F.when(F.col("what") == "function", "component").otherwise("variable")
    own = F.when(F.col("what") == "function", callable_kind(F.col("name"))).when(F.col("what") == "class", class_kind(F.col("base")))
    own = own.when(F.col("what") == "variable", variable_kind(F.col("name"), F.col("init"), F.coalesce("callee", F.lit("")))).otherwise(F.col("what"))
    kind = F.when(F.col("rec") == "vue-symbol", vue).otherwise(own)
    at = ordinal(F.col("path"), F.col("place"), F.lit(0), F.col("pos"))
    return s.select("repo_id", F.concat_ws(":", "file_id", "name").alias("id"), "file_id", "name", kind.alias("kind"), "exported", "start_line", "end_line", at.alias("ordinal"))
