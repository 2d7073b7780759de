"""The engine's operators over the driver's tables: adapters that make repository-model relations of them, one query per
operator, and the SQL that must give the same rows.

Adapters: documents as files; users as files of a hop graph, with a repository for each quarter of a day, or for cycles each day (a hop goes from an event to the next one of its
type and repository); parts as small source files with imports, declarations and markup; links of pages as specifiers; capitalised words as symbols;
events as the progress log. Adapters only make tables: what a query is named after is a function of the engine.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as fn
from .operators import questions as question_tables
from .operators import architecture, extract, graph, metrics, packages, resolve, retrieval, rules, summary
from .plans import evaluate, report
from .plans.store import Store
from .sources.tree import in_reading_order
from .schema import EVENTS
from .staging import Stages, shared_dir
from .streaming import events as ev
from .streaming import log, states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MOST_LINES, SIGNS = 20, ("License", "@")
CONCEPTS = ("order", "the", "ing", "ción", "schen", "eaux", "was")
QUERY = "找订单 the Hook ing_was"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# --- documents as files -------------------------------------------------------------------------------------------------


def doc_path() -> Column:
    ext = F.element_at(F.array(*map(F.lit, ("ts", "tsx", "js", "jsx", "vue"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext))


def doc_contents(spark: SparkSession, sf: str, before: Column | None = None) -> DataFrame:
    text = F.col("text") if before is None else F.concat(before, "text")
    return t(spark, sf, "documents").select(F.col("lang").alias("repo_id"), "doc_id", doc_path().alias("path"), text.alias("content"))


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    c = doc_contents(spark, sf)
    return c.select("repo_id", "doc_id", fn.file_id(F.col("path")).alias("id"), "path", fn.language(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size"), fn.content_hash(F.col("content")).alias("content_hash"), fn.line_count(F.col("content")).alias("line_count"), fn.complexity(F.col("content")).alias("complexity"))


DOCS = """docs AS (SELECT lang AS repo_id, doc_id, source || '/' || lang || '/' || doc_id || '.' ||
  CASE doc_id % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'tsx' WHEN 2 THEN 'js' WHEN 3 THEN 'jsx' ELSE 'vue' END AS path, text AS content FROM documents)"""
HOOK = "if (a) { useThing(1) } "
DOCS_CODE = DOCS.replace("text AS content", f"CASE WHEN doc_id % 3 = 0 THEN '{HOOK}' ELSE '' END || text AS content")
LINES = "CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT)"
BRANCHES = r"""CAST(len(regexp_extract_all(content, '\b(?:if|for|while|case|catch)\b|&&|\|\||\?')) + 1 AS BIGINT)"""


@query(f"""WITH {DOCS} SELECT doc_id, sha1(path) AS id, path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS content_hash, {LINES} AS line_count FROM docs""")
def file_facts(spark, sf):
    return doc_files(spark, sf).select("doc_id", "id", "path", "size", "content_hash", F.col("line_count").cast("long").alias("line_count"))


@query(f"WITH {DOCS} SELECT doc_id, {BRANCHES} AS complexity FROM docs")
def complexity(spark, sf):
    return doc_files(spark, sf).select("doc_id", F.col("complexity").cast("long").alias("complexity"))


_SHAPED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'a/dist/' ELSE 'lib/' END || replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '.min.js' WHEN 1 THEN '.TS' WHEN 2 THEN '.jsx' WHEN 3 THEN '.json' ELSE '.vue' END AS path FROM part"


def shaped_paths(spark, sf):
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*map(F.lit, ("src/", "node_modules/", "a/dist/", "lib/"))), (k % 4 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".min.js", ".TS", ".jsx", ".json", ".vue"))), (k % 5 + 1).cast("int"))
    return t(spark, sf, "part").select("p_partkey", F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("_")), ending).alias("path"))


@query(f"SELECT p_partkey, path FROM ({_SHAPED}) WHERE NOT (path LIKE 'node_modules/%' OR path LIKE '%/dist/%' OR path LIKE '%.min.js' OR path LIKE '%.bundle.js')")
def ignore_filter(spark, sf):
    return shaped_paths(spark, sf).where(~fn.ignored(F.col("path")))


@query(f"SELECT p_partkey, path, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS language FROM ({_SHAPED}) WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('ts','tsx','js','jsx','vue')")
def lang_from_ext(spark, sf):
    return shaped_paths(spark, sf).withColumn("language", fn.language(F.col("path"))).where("language is not null")


@query(f"WITH {DOCS} SELECT repo_id, CASE WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'TypeScript' WHEN path LIKE '%.vue' THEN 'Vue SFC' ELSE 'JavaScript' END AS label, count(*) AS n FROM docs GROUP BY 1, 2")
def language_set(spark, sf):
    return doc_contents(spark, sf).groupBy("repo_id", fn.language_label(F.col("path")).alias("label")).agg(F.count("*").alias("n"))


_OFFSET = "CAST(length(content) * (doc_id % 101) // 100 AS BIGINT)"


@query(f"WITH {DOCS} SELECT doc_id, CAST(length(left(content, {_OFFSET})) - length(replace(left(content, {_OFFSET}), chr(10), '')) + 1 AS BIGINT) AS line FROM docs")
def line_of(spark, sf):
    """Offsets from the beginning to the end of whole texts."""
    offset = F.call_function("div", F.char_length("content") * (F.col("doc_id") % 101), F.lit(100)).cast("int")
    return doc_contents(spark, sf).select("doc_id", fn.line_of(F.col("content"), offset).cast("long").alias("line"))


@query("SELECT s_suppkey, regexp_replace(s_name || '/a-b.tsx', '[^A-Za-z0-9_]', '_', 'g') AS node FROM supplier")
def mermaid_id(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", fn.mermaid_id(F.concat("s_name", F.lit("/a-b.tsx"))).alias("node"))


@query("SELECT s_suppkey, CAST(floor(least(100.0, greatest(0.0, s_acctbal / 50)) + 0.5) AS BIGINT) AS score FROM supplier")
def to_score(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", fn.to_score(F.col("s_acctbal") / 50).cast("long").alias("score"))


@query(f"WITH {DOCS} SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path COLLATE en, path) - 1 AS place FROM docs")
def path_rank(spark, sf):
    return in_reading_order(doc_contents(spark, sf).select("repo_id", "path"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def html_escape(spark, sf):
    return t(spark, sf, "pages").select("page_id", fn.html_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, CAST(ceil((length(h) + length(h) - length(regexp_replace(h, '[\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 3.0) AS BIGINT) AS tokens FROM (SELECT page_id, html || repeat(chr(128512), CAST(page_id % 4 AS INT)) AS h FROM pages)")
def token_estimate(spark, sf):
    more = F.repeat(F.lit("\U0001f600"), (F.col("page_id") % 4).cast("int"))
    return t(spark, sf, "pages").select("page_id", fn.token_estimate(F.concat("html", more)).alias("tokens"))


#: Each document's file is bound to the next three of its language and source.
DOC_EDGES = """nexts AS (SELECT lang AS repo_id, doc_id, v.k, CASE v.k WHEN 3 THEN 'render' ELSE 'import' END AS kind, CASE v.k WHEN 1 THEN lead(doc_id, 1) OVER w WHEN 2 THEN lead(doc_id, 2) OVER w ELSE lead(doc_id, 3) OVER w END AS to_id FROM documents, (VALUES (1), (2), (3)) AS v(k) WINDOW w AS (PARTITION BY lang, source, v.k ORDER BY doc_id)),
  doc_edges AS (SELECT n.repo_id, sha1(a.path) AS src, sha1(b.path) AS dst, b.path AS dst_path, n.kind, n.doc_id * 3 + n.k AS ordinal FROM nexts n JOIN docs a ON a.doc_id = n.doc_id JOIN docs b ON b.doc_id = n.to_id)"""


def doc_edges(spark, sf):
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    d = t(spark, sf, "documents").select("lang", "source", "doc_id", fn.file_id(doc_path()).alias("src"))
    ways = F.array(*(F.struct(F.lit(k).alias("k"), F.lead("src", k).over(w).alias("dst")) for k in (1, 2, 3)))
    e = d.withColumn("x", ways).select(F.col("lang").alias("repo_id"), "src", "doc_id", F.explode("x").alias("x")).where("x.dst is not null")
    return e.select("repo_id", "src", F.col("x.dst").alias("dst"), F.when(F.col("x.k") == 3, "render").otherwise("import").alias("kind"), (F.col("doc_id") * 3 + F.col("x.k")).alias("ordinal"))


# --- rules ---------------------------------------------------------------------------------------------------------------

_CODE = "code AS (SELECT page_id, 'p' || page_id || CASE WHEN page_id % 3 = 0 THEN '.tsx' ELSE '.ts' END AS path, CASE page_id % 4 WHEN 0 THEN 'if (a) { useThing(b) }' WHEN 1 THEN 'useThing (1); while(x) y { z useOther' WHEN 2 THEN 'reuseX(); if (a) { b }' ELSE 'for (;;) { }' END || html AS content FROM pages)"


def page_code(spark, sf):
    k = F.col("page_id")
    start = F.element_at(F.array(*map(F.lit, ("if (a) { useThing(b) }", "useThing (1); while(x) y { z useOther", "reuseX(); if (a) { b }", "for (;;) { }"))), (k % 4 + 1).cast("int"))
    return t(spark, sf, "pages").select("page_id", F.concat(F.lit("p"), k.cast("string"), F.when(k % 3 == 0, ".tsx").otherwise(".ts")).alias("path"), F.concat(start, "html").alias("content"))


@query(rf"WITH {_CODE} SELECT page_id, path FROM code WHERE path LIKE '%.tsx' AND regexp_matches(content, '\buse[A-Z]\w*\s*\(') AND regexp_matches(content, '\b(if|for|while)\s*\([^)]*\)[^{{]*\{{(?s:.*)use[A-Z]')")
def rule_hooks(spark, sf):
    return page_code(spark, sf).where(rules.conditional_hook(F.col("path"), F.col("content"))).select("page_id", "path")


@query(f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE contains(content, 'License') OR contains(content, '@')")
def rule_lint_bypass(spark, sf):
    return doc_contents(spark, sf).where(rules.bypasses(F.col("content"), SIGNS)).select("doc_id", "path")


@query(f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE {LINES} > {MOST_LINES}")
def rule_large_file(spark, sf):
    return doc_contents(spark, sf).where(rules.too_long(F.col("content"), MOST_LINES)).select("doc_id", "path")


_HOOKS = r"regexp_matches(path, '\.(tsx|jsx)$') AND regexp_matches(content, '\buse[A-Z]\w*\s*\(') AND regexp_matches(content, '\b(if|for|while)\s*\([^)]*\)[^{]*\{(?s:.*)use[A-Z]')"
_FOUND = f"""{DOCS_CODE}, found AS (SELECT doc_id, path, 'lint-bypass' AS rule, 'warning' AS severity FROM docs WHERE contains(content, 'License') OR contains(content, '@')
  UNION ALL SELECT doc_id, path, 'large-file', 'warning' FROM docs WHERE {LINES} > {MOST_LINES}
  UNION ALL SELECT doc_id, path, 'react-hooks-condition', 'error' FROM docs WHERE {_HOOKS})"""


def doc_findings(spark, sf):
    return rules.frontend_findings(doc_contents(spark, sf, F.when(F.col("doc_id") % 3 == 0, F.lit(HOOK)).otherwise("")), SIGNS, MOST_LINES)


@query(f"WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS k FROM found) SELECT rule, min(severity) AS severity, count(*) AS count, string_agg(path, '|' ORDER BY doc_id) FILTER (k <= 3) AS samples FROM r GROUP BY rule")
def finding_groups(spark, sf):
    found = doc_findings(spark, sf).withColumnRenamed("doc_id", "ordinal")
    return rules.grouped_findings(found).select("rule", "severity", "count", joined(F.col("samples")).alias("samples"))


@query(f"WITH {_FOUND} SELECT doc_id, path, rule FROM found UNION ALL SELECT doc_id, path, 'short' FROM docs WHERE length(content) < 40")
def findings_union(spark, sf):
    short = doc_contents(spark, sf, F.when(F.col("doc_id") % 3 == 0, F.lit(HOOK)).otherwise("")).where(F.char_length("content") < 40).select("doc_id", "path", F.lit("short").alias("rule"))
    return doc_findings(spark, sf).select("doc_id", F.element_at("files", 1).alias("path"), "rule").unionByName(short)


@query(f"WITH {_FOUND} SELECT count(*) FILTER (severity <> 'info') AS risks FROM found")
def risk_count(spark, sf):
    return doc_findings(spark, sf).agg(F.count_if(F.col("severity") != "info").alias("risks"))


# --- symbols -------------------------------------------------------------------------------------------------------------

SYMBOLS = f"""{DOCS}, words AS (SELECT repo_id, doc_id, path, unnest(list_distinct(regexp_extract_all(content, '[A-Z][A-Za-z]{{3,}}'))) AS name FROM docs),
  symbols AS (SELECT repo_id, doc_id, sha1(path) AS file_id, name, CASE WHEN name LIKE 'Th%' THEN 'component' WHEN name LIKE 'An%' THEN 'hook' ELSE 'function' END AS kind,
    row_number() OVER (PARTITION BY doc_id ORDER BY name) AS ordinal FROM words)"""


def doc_symbols(spark, sf):
    words = doc_contents(spark, sf).select("repo_id", "doc_id", fn.file_id(F.col("path")).alias("file_id"), F.explode(F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Z][A-Za-z]{3,}"), F.lit(0))))).alias("name"))
    kind = F.when(F.startswith("name", F.lit("Th")), "component").when(F.startswith("name", F.lit("An")), "hook").otherwise("function")
    return words.select("repo_id", "doc_id", "file_id", "name", kind.alias("kind"), F.row_number().over(Window.partitionBy("doc_id").orderBy("name")).cast("long").alias("ordinal"))


_NAMES = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'use' || upper(left(p_name, 1)) || substr(p_name, 2) WHEN 1 THEN upper(left(p_name, 1)) || substr(p_name, 2) ELSE p_name END AS name FROM part"


def part_names(spark, sf):
    k, big = F.col("p_partkey"), F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 99))
    return t(spark, sf, "part").select("p_partkey", "p_type", F.when(k % 3 == 0, F.concat(F.lit("use"), big)).when(k % 3 == 1, big).otherwise(F.col("p_name")).alias("name"))


@query(f"SELECT p_partkey, name, CASE WHEN regexp_matches(name, '^use[A-Z]') THEN 'hook' WHEN regexp_matches(name, '^[A-Z]') THEN 'component' ELSE 'function' END AS kind FROM ({_NAMES})")
def classify_callable(spark, sf):
    return part_names(spark, sf).select("p_partkey", "name", fn.callable_kind(F.col("name")).alias("kind"))


@query(rf"""WITH n AS ({_NAMES}), i AS (SELECT n.*, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'function' WHEN 2 THEN 'call' ELSE 'other' END AS init, CASE WHEN p_partkey % 5 < 2 THEN 'React.memo' ELSE 'create' END AS callee FROM n)
SELECT p_partkey, name, CASE WHEN init = 'function' THEN CASE WHEN regexp_matches(name, '^use[A-Z]') THEN 'hook' WHEN regexp_matches(name, '^[A-Z]') THEN 'component' ELSE 'function' END
 WHEN init = 'call' THEN CASE WHEN regexp_matches(callee, '\b(memo|forwardRef|observer|styled)\b') AND regexp_matches(name, '^[A-Z]') THEN 'component' WHEN regexp_matches(name, '^use[A-Z]') THEN 'hook' ELSE 'variable' END ELSE 'variable' END AS kind FROM i""")
def classify_variable(spark, sf):
    k = F.col("p_partkey")
    init = F.element_at(F.array(*map(F.lit, ("none", "function", "call", "other"))), (k % 4 + 1).cast("int"))
    callee = F.when(k % 5 < 2, "React.memo").otherwise("create")
    return part_names(spark, sf).select("p_partkey", "name", fn.variable_kind(F.col("name"), init, callee).alias("kind"))


_BASES = "CASE p_partkey % 7 WHEN 0 THEN 'React.Component' WHEN 1 THEN 'Component' WHEN 2 THEN 'PureComponent<P>' WHEN 3 THEN 'Componentish' WHEN 4 THEN 'a.PureComponent' WHEN 5 THEN 'MyComponent' END"


@query(rf"SELECT p_partkey, CASE WHEN regexp_matches({_BASES}, '(^|\.)(Component|PureComponent)\b') THEN 'component' ELSE 'class' END AS kind FROM part")
def classify_class(spark, sf):
    base = F.element_at(F.array(*map(F.lit, ("React.Component", "Component", "PureComponent<P>", "Componentish", "a.PureComponent", "MyComponent", None))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t(spark, sf, "part").select("p_partkey", fn.class_kind(base).alias("kind"))


# --- source files --------------------------------------------------------------------------------------------------------

#: A source file for each part, of a repository of every twentieth; k is the part's number. Of four files the last is a single-file component.
CODE = """import Alpha, {{ beta as Gamma }} from './p{20}';
export * from "./P{40}";
import 'react';
import Self, {{ Other as Beta }} from './p{0}';
import type {{ Q }} from '@/p{80}';
import '../../far/p{0}';
export function useThing{0}() {{ return import('./p{60}') }}
export const View{0} = () => <Alpha><Gamma.Item/><Self/><div/><Alpha/></Alpha>;
class Old{0} extends React.Component {{}}
interface I{0} {{}}
const a{0} = memo(x), useB{0} = call();
"""
VUE = """<script>
import A from './p{20}'
import './p{23}.vue'
export function go{0}() {{}}
const x{0} = 1
</script>
"""
CODE_CONFIG = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}'
_EXTS = ("tsx", "ts", "jsx", "vue")


def _fill(text: str) -> Column:
    """The text with each number in braces replaced by the part's own number plus it."""
    pieces = []
    for k, piece in enumerate(re.split(r"(?<!\{)\{(\d+)\}(?!\})", text)):
        pieces.append((F.col("p_partkey") + int(piece)).cast("string") if k % 2 else F.lit(piece.replace("{{", "{").replace("}}", "}")))
    return F.concat(*pieces)


def code_rows(spark, sf):
    """repo_id, path, content of the parts' files; plain TypeScript has no markup."""
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    plain = "".join(x for x in CODE.splitlines(keepends=True) if "<Alpha>" not in x)
    content = F.when(ext == "vue", _fill(VUE)).when(ext == "ts", _fill(plain)).otherwise(_fill(CODE))
    return t(spark, sf, "part").select(F.concat(F.lit("r"), (F.col("p_partkey") % 20).cast("string")).alias("repo_id"), F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"), content.alias("content"))


def code_tables(spark, sf):
    c = code_rows(spark, sf)
    files = c.select("repo_id", fn.file_id(F.col("path")).alias("id"), "path")
    return files, Stages(spark, "code").put(extract.facts(files, c), "facts")


_CODE_FILES = """cf AS (SELECT p_partkey AS k, 'r' || (p_partkey % 20) AS repo_id, ['tsx', 'ts', 'jsx', 'vue'][p_partkey % 4 + 1] AS ext, 'src/p' || p_partkey || '.' || ['tsx', 'ts', 'jsx', 'vue'][p_partkey % 4 + 1] AS path FROM part),
  placed AS (SELECT *, sha1(path) AS id, row_number() OVER (PARTITION BY repo_id ORDER BY path COLLATE en, path) - 1 AS place FROM cf)"""
# (name, kind, exported, line in markup files, line in plain ones, position) of what a file declares: functions, classes, interfaces, then variables
_DECLARED = """declared AS (SELECT * FROM (VALUES ('useThing', 'hook', true, 7, 7, 0), ('Old', 'component', false, 9, 8, 1), ('I', 'interface', false, 10, 9, 2), ('View', 'component', true, 8, NULL, 3), ('a', 'variable', false, 11, 10, 4), ('useB', 'hook', false, 11, 10, 5)) AS v(name, kind, exported, line, plain_line, pos)),
  declared_vue AS (SELECT * FROM (VALUES ('go', 'component', true, 4, 0), ('x', 'variable', false, 5, 1)) AS v(name, kind, exported, line, pos))"""


@query(f"""WITH {_CODE_FILES}, {_DECLARED}
SELECT repo_id, id || ':' || name || k AS id, name || k AS name, kind, exported, CAST(CASE WHEN ext = 'ts' THEN plain_line ELSE line END AS BIGINT) AS start_line, CAST(place * (1::BIGINT << 32) + CASE WHEN ext = 'ts' AND pos > 3 THEN pos - 1 ELSE pos END AS BIGINT) AS ordinal FROM placed, declared WHERE ext <> 'vue' AND NOT (ext = 'ts' AND plain_line IS NULL)
UNION ALL SELECT repo_id, id || ':' || name || k, name || k, kind, exported, CAST(line AS BIGINT), CAST((1::BIGINT << 62) + place * (1::BIGINT << 32) + pos AS BIGINT) FROM placed, declared_vue WHERE ext = 'vue'""")
def module_symbols(spark, sf):
    files, facts = code_tables(spark, sf)
    return extract.symbols(facts, files).select("repo_id", "id", "name", "kind", "exported", F.col("start_line").cast("long").alias("start_line"), "ordinal")


# (kind of fact, position, specifier before the number, number's distance, after it, line in markup files, line in plain ones)
_REFERRED = """referred AS (SELECT * FROM (VALUES ('import', 0, './p', 20, '', 1, 1), ('export', 0, './P', 40, '', 2, 2), ('import', 1, 'react', NULL, '', 3, 3), ('import', 2, './p', 0, '', 4, 4), ('import', 3, '@/p', 80, '', 5, 5), ('import', 4, '../../far/p', 0, '', 6, 6), ('dynamic', 0, './p', 60, '', 7, 7)) AS v(rec, pos, head, far, tail, line, plain_line)),
  referred_vue AS (SELECT * FROM (VALUES (0, './p', 20, '', 2), (1, './p', 23, '.vue', 3)) AS v(pos, head, far, tail, line)),
  refs AS (SELECT k, repo_id, ext, path, id, place, rec, pos, head || coalesce(CAST(k + far AS VARCHAR), '') || tail AS spec, k + far AS to_k, head, line FROM placed, referred WHERE ext <> 'vue'
    UNION ALL SELECT k, repo_id, ext, path, id, place, 'import', pos, head || (k + far) || tail, k + far, head, line FROM placed, referred_vue WHERE ext = 'vue')"""


@query(f"WITH {_CODE_FILES}, {_REFERRED} SELECT repo_id, path, rec, pos, spec, line FROM refs")
def link_extract(spark, sf):
    """Static imports, re-exports and dynamic imports of source files."""
    _, facts = code_tables(spark, sf)
    return facts.where("rec in ('import', 'export', 'dynamic')").select("repo_id", "path", "rec", "pos", "spec", F.col("start_line").alias("line"))


def code_edges(spark, sf):
    files, facts = code_tables(spark, sf)
    return resolve.dependency_edges(facts, files, code_surroundings(spark, sf))


def code_surroundings(spark, sf) -> resolve.Surroundings:
    """Each repository's configuration; outside its root there is a file for each even part."""
    k = F.col("p_partkey")
    repo = F.concat(F.lit("r"), (k % 20).cast("string")).alias("repo_id")
    parts = t(spark, sf, "part")
    settings = parts.select(repo).distinct().select("repo_id", F.lit("tsconfig.json").alias("path"), F.lit(CODE_CONFIG).alias("text"))
    far = parts.where(k % 2 == 0).select(repo, F.concat(F.lit("../far/p"), k.cast("string"), F.lit(".ts")).alias("path"))
    return resolve.Surroundings(settings, resolve.Surroundings.none(spark).links, far)


# a target is the file of the number in the same repository, which no source finds as a single-file component, and such a component only with its suffix or another
# kind's; the number is at a distance that the repository shares, but for the component's last import
_TARGETS = f"""{_CODE_FILES}, {_REFERRED}, hits AS (SELECT r.*, f.id AS target, f.path AS target_path FROM refs r JOIN placed f ON f.repo_id = r.repo_id AND f.k = r.to_k WHERE r.head IN ('./p', './P', '@/p') AND (r.ext = 'vue' OR f.ext <> 'vue'))"""


@query(f"WITH {_TARGETS} SELECT repo_id, path, spec, target_path AS target FROM hits")
def resolve_exact(spark, sf):
    files, facts = code_tables(spark, sf)
    _, _, found = resolve.dependency_edges(facts, files, code_surroundings(spark, sf))
    return found.join(files.select("repo_id", F.col("id").alias("target"), F.col("path").alias("target_path")), ["repo_id", "target"]).select("repo_id", "path", "spec", F.col("target_path").alias("target"))


@query(f"WITH {_TARGETS} SELECT repo_id, path, spec, head = '../../far/p' AND k % 2 = 0 AS outside FROM refs r WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = r.path AND h.spec = r.spec)")
def unresolved(spark, sf):
    return code_edges(spark, sf)[1]


_SECTION = "CASE rec WHEN 'import' THEN 1 WHEN 'export' THEN 2 WHEN 'dynamic' THEN 3 END"
_AT = "CAST(CASE WHEN ext = 'vue' THEN 1::BIGINT << 62 ELSE 0 END + place * (1::BIGINT << 32) + {} * (1::BIGINT << 28) + {} AS BIGINT)"


@query(f"WITH {_TARGETS} SELECT repo_id, id AS src, target AS dst, path AS file, CAST(CASE WHEN ext = 'ts' THEN line ELSE line END AS BIGINT) AS line, {_AT.format(_SECTION, 'pos')} AS ordinal FROM hits WHERE target <> id")
def edges_clean(spark, sf):
    """Import edges: those of a file to itself are none."""
    e = code_edges(spark, sf)[0].where("kind = 'import'")
    return e.select("repo_id", "src", "dst", "location.file", F.col("location.line").cast("long").alias("line"), "ordinal")


@query(f"WITH {_TARGETS} SELECT repo_id, id AS src, target AS dst, CAST(8 AS BIGINT) AS line, {_AT.format(4, 0)} AS ordinal FROM hits WHERE rec = 'import' AND pos = 0 AND ext IN ('tsx', 'jsx')")
def first_render(spark, sf):
    """Render edges: one for each file that a file's tags name, at the first such tag (the opening ones come first); self-references are none."""
    e = code_edges(spark, sf)[0].where("kind = 'render'")
    return e.select("repo_id", "src", "dst", F.col("location.line").cast("long").alias("line"), "ordinal")


@query("SELECT CAST(c_custkey AS VARCHAR) AS repo_id, v.rank, v.name, replace(v.version, '#', CAST(c_custkey AS VARCHAR)) AS version FROM customer JOIN (VALUES (0, 0, 'vue', '^3.#'), (0, 0, 'a', '1'), (0, 1, 'vite', '5'), (4, 2, 'react', '18')) AS v(kind, rank, name, version) ON c_custkey % 5 = v.kind")
def package_sections(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(F.lit('{"dependencies": {"vue": "^3.'), k.cast("string"), F.lit('", "a": 1}, "devDependencies": {"vite": "5"}}')))
    text = text.when(k % 5 == 1, "[]").when(k % 5 == 2, '{"dependencies": ').when(k % 5 == 4, '{"dependencies": null, "peerDependencies": {"react": "18"}}')
    return metrics.package_rows(t(spark, sf, "customer").select(k.cast("string").alias("repo_id"), text.alias("text")))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS repo_id, CASE WHEN s_suppkey % 3 < 2 THEN 'app' || s_suppkey END AS base_url, CASE WHEN s_suppkey % 3 < 2 THEN '@/*|' || CASE s_suppkey % 3 WHEN 0 THEN 'src//x/*' ELSE 'last/*' END || s_suppkey END AS paths FROM supplier")
def config_options(spark, sf):
    """Compiler configurations: with comments and closing commas; extending others by a path and by a package behind a link, of which
    the last wins; broken ones give nothing."""
    k = F.col("s_suppkey").cast("string")
    here = t(spark, sf, "supplier").select("s_suppkey", k.alias("repo_id"))
    text = F.concat(F.lit('{ // names\n "compilerOptions": { /* root */ "baseUrl": "./app'), k, F.lit('", "paths": {"@/*": ["src//x/*'), k, F.lit('",],}, } }'))
    first = F.when(F.col("s_suppkey") % 3 == 0, text).when(F.col("s_suppkey") % 3 == 1, '{"extends": ["./conf/near", "@cfg/base/strict"]}').otherwise('{"compilerOptions": ')
    near = F.concat(F.lit('{"extends": "../tsconfig.json", "compilerOptions": {"baseUrl": "../app'), k, F.lit('/.", "paths": {"~/*": ["near/*"]}}}'))
    strict = F.concat(F.lit('{"compilerOptions": {"paths": {"@/*": ["last/*'), k, F.lit('"]}}}'))
    each = F.array(*(F.struct(F.lit(path).alias("path"), text.alias("text")) for path, text in (("tsconfig.json", first), ("conf/near.json", near), ("cfgs/base/strict.json", strict))))
    settings = here.select("repo_id", F.inline(each))
    links = here.select("repo_id", F.lit("node_modules/@cfg/base").alias("path"), F.lit("cfgs/base").alias("target"))
    found = packages.configurations(settings, links)
    return found.select("repo_id", "base_url", F.when(F.col("paths").isNotNull(), joined(F.concat(F.map_keys("paths"), F.flatten(F.map_values("paths"))))).alias("paths"))


# --- resolution ----------------------------------------------------------------------------------------------------------

LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS spec FROM pages),
  targets AS (SELECT DISTINCT split_part(url, '/', 4) AS path FROM pages WHERE split_part(url, '/', 4) <> '')"""


def page_links(spark, sf):
    return t(spark, sf, "pages").select(F.lit("web").alias("repo_id"), "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("spec"))


def page_targets(spark, sf):
    p = F.split_part("url", F.lit("/"), F.lit(4))
    return t(spark, sf, "pages").select(F.lit("web").alias("repo_id"), p.alias("path")).where("path <> ''").distinct().withColumn("id", F.concat(F.lit("t:"), "path"))


@query(f"WITH {LINKS}, low AS (SELECT lower(path) AS low, max(path) AS path FROM targets GROUP BY 1) SELECT page_id, spec, coalesce(e.path, l.path) AS target FROM links LEFT JOIN targets e ON e.path = spec LEFT JOIN low l ON l.low = lower(spec) WHERE coalesce(e.path, l.path) IS NOT NULL")
def resolve_ci(spark, sf):
    ranked = page_links(spark, sf).select("repo_id", "spec").distinct().select("repo_id", "spec", F.lit(0).alias("rank"), F.col("spec").alias("candidate"))
    found = resolve.ranked_match(ranked, page_targets(spark, sf), ["repo_id", "spec"])
    return page_links(spark, sf).join(found, ["repo_id", "spec"]).select("page_id", "spec", F.substring("target", 3, 999).alias("target"))


_RANKED = f"""WITH {LINKS}, specs AS (SELECT DISTINCT spec FROM links), c AS (SELECT spec, 0 AS rank, spec AS cand FROM specs UNION ALL SELECT spec, 1, left(spec, 2) FROM specs UNION ALL SELECT spec, 2, right(spec, 2) FROM specs),
 m AS (SELECT spec, rank, 0 AS loose, path FROM c JOIN targets ON cand = path UNION ALL SELECT spec, rank, 1, max(path) FROM c JOIN targets ON lower(cand) = lower(path) GROUP BY 1, 2, 3)"""


def ranked_links(spark, sf):
    specs = page_links(spark, sf).select("repo_id", "spec").distinct()
    cands = F.array("spec", F.left("spec", F.lit(2)), F.right("spec", F.lit(2)))
    return specs.select("repo_id", "spec", F.posexplode(cands).alias("rank", "candidate"))


@query(_RANKED + " SELECT spec, arg_min(path, loose * 10 + rank) AS target FROM m GROUP BY spec")
def resolve_ranked(spark, sf):
    found = resolve.ranked_match(ranked_links(spark, sf), page_targets(spark, sf), ["repo_id", "spec"])
    return found.select("spec", F.substring("target", 3, 999).alias("target"))


#: A package for each customer, in its nation's repository: exports with conditions, a list, a closed pattern and an open one; its own imports.
MANIFEST = """{{"name": "@acme/ui{0}", "exports": {{".": {{"node": "./no.js", "import": {{"types": "./src/index.ts", "default": "./dist/index.js"}}}}, "./internal/*": null, "./*": ["lib/bad", {{"browser": "./b.js"}}, "./src/*.js"]}},
 "imports": {{"#lib/*": "./lib/*.ts", "#base": {{"node": "./none.ts", "default": "@acme/base"}}}}}}"""
BASE_MANIFEST = '{"name": "@acme/base", "main": "./dist/main.js", "types": "src/main.ts"}'
# where a specifier stands (an app, or the package itself), the specifier, and the path that it names in the repository; {} is the customer's number
_ASKED = (("apps/a{}.ts", "@acme/ui{}", "packages/ui{}/src/index.ts"), ("apps/a{}.ts", "@acme/ui{}/button", "packages/ui{}/src/button.ts"), ("apps/a{}.ts", "@acme/ui{}/internal/x", None), ("apps/a{}.ts", "@acme/base", "packages/base/src/main.ts"), ("apps/a{}.ts", "#lib/fmt", None),
  ("packages/ui{}/src/index.ts", "#lib/fmt", "packages/ui{}/lib/fmt.ts"), ("packages/ui{}/src/index.ts", "#base", "packages/base/src/main.ts"), ("packages/ui{}/src/index.ts", "@acme/ui{}/button", "packages/ui{}/src/button.ts"), ("packages/ui{}/src/index.ts", "@acme/base/deep", None))
_ASKED_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in _ASKED)
_NAMED = "replace({}, '{{}}', CAST(c_custkey AS VARCHAR))".format


@query(f"""WITH asked AS (SELECT * FROM (VALUES {_ASKED_SQL}) AS v(path, spec, target)), x AS (SELECT 'n' || c_nationkey AS repo_id, c_custkey % 3 = 2 AND path LIKE 'apps/%' AND spec LIKE '@acme/ui%' AS away, {_NAMED('path')} AS path, {_NAMED('spec')} AS spec, {_NAMED('target')} AS target FROM customer, asked)
SELECT repo_id, path, spec, CASE WHEN NOT away THEN target END AS target, away AND spec LIKE '%/button' AS outside FROM x""")
def resolve_packages(spark, sf):
    """Specifiers of workspaces: by conditions, patterns and links, by a package's own imports, and of itself; every third package is
    linked from outside the tree, where only its button is."""
    k = F.col("c_custkey").cast("string")
    here = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo_id"))
    named = lambda text: F.replace(F.lit(text), F.lit("{}"), k)
    rows = lambda *texts: here.select("repo_id", F.explode(F.array(*map(named, texts))).alias("path"))
    manifest = F.replace(F.lit(MANIFEST.replace("{0}", "<>").replace("{{", "{").replace("}}", "}")), F.lit("<>"), k)
    files = rows("apps/a{}.ts", "packages/ui{}/src/index.ts", "packages/ui{}/src/button.ts", "packages/ui{}/lib/fmt.ts").unionByName(here.select("repo_id", F.lit("packages/base/src/main.ts").alias("path")).distinct())
    files = files.select("repo_id", fn.file_id(F.col("path")).alias("id"), "path")
    away = F.col("c_custkey") % 3 == 2
    one = here.select("repo_id", F.lit("packages/base/package.json").alias("path"), F.lit(BASE_MANIFEST).alias("text")).distinct()
    settings = here.select("repo_id", named("packages/ui{}/package.json").alias("path"), manifest.alias("text")).unionByName(here.where(away).select("repo_id", named("../shared/ui{}/package.json").alias("path"), manifest.alias("text"))).unionByName(one)
    links = here.select("repo_id", named("node_modules/@acme/ui{}").alias("path"), F.when(away, named("../shared/ui{}")).otherwise(named("packages/ui{}")).alias("target")).unionByName(here.select("repo_id", F.lit("node_modules/@acme/base").alias("path"), F.lit("packages/base").alias("target")).distinct())
    elsewhere = here.where(away).select("repo_id", named("../shared/ui{}/src/button.ts").alias("path"))
    specs = here.select("repo_id", F.inline(F.array(*(F.struct(named(p).alias("path"), named(s).alias("spec")) for p, s, _ in _ASKED))))
    found = resolve.matched(specs, files, resolve.Surroundings(settings, links, elsewhere))
    return found.join(files.select("repo_id", F.col("id").alias("target"), F.col("path").alias("target_path")), ["repo_id", "target"], "left").select("repo_id", "path", "spec", F.col("target_path").alias("target"), "outside")


# --- hop graph -----------------------------------------------------------------------------------------------------------

_LAYERS = ", ".join(f"'{x}'" for x in architecture.LAYERS)
_REPO = "'d' || day(ts) || 'q' || (hour(ts) // 6)"
HOPS = f"""hops AS (SELECT {_REPO} AS repo_id, event_id AS ordinal, user_id AS a, lead(user_id) OVER (PARTITION BY {_REPO}, event_type ORDER BY ts, event_id) AS b, event_type FROM events),
  edges AS (SELECT repo_id, 'u' || a AS src, 'u' || b AS dst, CASE event_type WHEN 'view' THEN 'render' WHEN 'error' THEN 'call' ELSE 'import' END AS kind, ordinal FROM hops WHERE a <> b),
  files AS (SELECT {_REPO} AS repo_id, 'u' || user_id AS id, coalesce([{_LAYERS}][user_id % 9 + 1], CASE user_id % 9 WHEN 7 THEN 'app' ELSE 'Misc' END) || '/u' || user_id || CASE user_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.js' END AS path, count(*) AS line_count, CAST(sum(event_id) % 10 + 1 AS BIGINT) AS complexity, user_id % 3 < 2 AS typed FROM events GROUP BY 1, user_id),
  placed AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path COLLATE en, path) AS place FROM files)"""
REACH = f"""WITH RECURSIVE {HOPS}, e AS (SELECT DISTINCT repo_id, src, dst FROM edges WHERE kind = 'import'),
  reach AS (SELECT repo_id, src, dst FROM e UNION SELECT r.repo_id, r.src, e.dst FROM reach r JOIN e ON r.repo_id = e.repo_id AND r.dst = e.src),
  member AS (SELECT x.repo_id, x.src AS id, least(x.src, min(x.dst)) AS component FROM reach x JOIN reach y ON x.repo_id = y.repo_id AND x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY x.repo_id, x.src)"""
_PATHS = ", named AS (SELECT m.repo_id, m.component, m.id, f.path FROM member m JOIN files f ON f.repo_id = m.repo_id AND f.id = m.id)"


#: The same with a repository for each day of the month: components, loops and cuts lose no hop between its quarters.
_DAY_REPO = "'d' || day(ts)"
DAY_REACH = REACH.replace(_REPO, _DAY_REPO)


def _day() -> Column:
    return F.concat(F.lit("d"), F.dayofmonth("ts").cast("string"))


def _quarter() -> Column:
    """A repository for each six hours."""
    return F.concat(F.lit("d"), F.dayofmonth("ts").cast("string"), F.lit("q"), F.floor(F.hour("ts") / 6).cast("string"))


def hop_edges(spark, sf, repo: Callable[[], Column] = _quarter):
    w = Window.partitionBy(repo(), "event_type").orderBy("ts", "event_id")
    e = t(spark, sf, "events").select(repo().alias("repo_id"), F.col("event_id").alias("ordinal"), F.col("user_id").alias("a"), F.lead("user_id").over(w).alias("b"), "event_type")
    node = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    kind = F.when(F.col("event_type") == "view", "render").when(F.col("event_type") == "error", "call").otherwise("import")
    return e.where("a <> b").select("repo_id", node("a").alias("src"), node("b").alias("dst"), kind.alias("kind"), "ordinal")


def hop_files(spark, sf, repo: Callable[[], Column] = _quarter):
    u = t(spark, sf, "events").groupBy(repo().alias("repo_id"), "user_id").agg(F.count("*").alias("line_count"), (F.sum("event_id") % 10 + 1).alias("complexity"))
    k, s = F.col("user_id"), F.col("user_id").cast("string")
    folder = F.element_at(F.array(*map(F.lit, (*architecture.LAYERS, "app", "Misc"))), (k % 9 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("ts", "tsx", "js"))), (k % 3 + 1).cast("int"))
    return u.select("repo_id", F.concat(F.lit("u"), s).alias("id"), F.concat(folder, F.lit("/u"), s, F.lit("."), ext).alias("path"), ext.alias("language"), "line_count", "complexity")


def hop_cycles(spark, sf, repo: Callable[[], Column] = _quarter, **how):
    return graph.components(hop_files(spark, sf, repo), hop_edges(spark, sf, repo), **how)


_SCC_END = " SELECT repo_id, path, min(path) OVER (PARTITION BY repo_id, component) AS first_path, count(*) OVER (PARTITION BY repo_id, component) AS members FROM named"


def _members(c):
    # the least path of a component once, not for each of its rows
    each = c.select("repo_id", "files", F.array_min("files").alias("first_path"), F.size("files").cast("long").alias("members"))
    return each.select("repo_id", F.explode("files").alias("path"), "first_path", "members")


@query(DAY_REACH + _PATHS + _SCC_END)
def scc(spark, sf):
    return _members(hop_cycles(spark, sf, _day))


@query(DAY_REACH + _PATHS + _SCC_END)
def scc_joined(spark, sf):
    """By joins alone, as for repositories that outgrow a task."""
    return _members(hop_cycles(spark, sf, _day, most_edges=0, loops=False))


@query(DAY_REACH + _PATHS + " SELECT repo_id, string_agg(path, ' | ' ORDER BY path) AS fingerprint FROM named GROUP BY repo_id, component")
def scc_fingerprint(spark, sf):
    return hop_cycles(spark, sf, _day).select("repo_id", fn.fingerprint(F.col("files")).alias("fingerprint"))


@query(DAY_REACH + """, inner_e AS (SELECT e.repo_id, e.src, e.dst, a.component FROM e JOIN member a ON a.repo_id = e.repo_id AND a.id = e.src JOIN member b ON b.repo_id = e.repo_id AND b.id = e.dst WHERE a.component = b.component),
  walk AS (SELECT repo_id, component, src AS head, dst AS tip, 1 AS n FROM inner_e UNION SELECT w.repo_id, w.component, w.head, i.dst, w.n + 1 FROM walk w JOIN inner_e i ON i.repo_id = w.repo_id AND i.src = w.tip WHERE w.tip <> w.head AND w.n < 40)
SELECT repo_id, head AS id, CAST(min(n) AS BIGINT) AS hops FROM walk WHERE tip = head GROUP BY 1, 2""")
def shortest_loop(spark, sf):
    """For every node on a cycle the length of a shortest loop through it."""
    return graph.loops_of_nodes(hop_edges(spark, sf, _day).where("kind = 'import'"))


@query(DAY_REACH + _PATHS + " SELECT repo_id, 'import-cycle' AS rule, 'error' AS severity, '发现循环依赖，涉及 ' || count(*) || ' 个文件' AS message, string_agg(path, ' | ' ORDER BY path) AS files FROM named GROUP BY repo_id, component")
def cycle_findings(spark, sf):
    return graph.cycle_findings(hop_cycles(spark, sf, _day)).select("repo_id", "rule", "severity", "message", fn.fingerprint(F.col("files")).alias("files"))


@query(DAY_REACH + _PATHS + """, inside AS (SELECT d.repo_id, a.component, a.path AS src, b.path AS dst, d.ordinal FROM edges d JOIN named a ON a.repo_id = d.repo_id AND a.id = d.src JOIN named b ON b.repo_id = d.repo_id AND b.id = d.dst WHERE d.kind = 'import' AND a.component = b.component),
  pairs AS (SELECT repo_id, component, src, dst, count(*) AS refs, min(ordinal) AS first FROM inside GROUP BY 1, 2, 3, 4),
  r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, component ORDER BY refs, first) AS k FROM pairs) SELECT repo_id, src, dst, refs FROM r WHERE k = 1""")
def cycle_cut(spark, sf):
    cuts = graph.cycle_cuts(hop_cycles(spark, sf, _day), architecture.edge_paths(hop_edges(spark, sf, _day), hop_files(spark, sf, _day)))
    return cuts.select("repo_id", "src", "dst", "refs")


_COMPONENT = "own AS (SELECT repo_id, id FROM files WHERE complexity > 5)"


@query(f"WITH {HOPS}, {_COMPONENT} SELECT e.ordinal, a.path AS src, b.path AS dst FROM edges e JOIN own x ON x.repo_id = e.repo_id AND x.id = e.src JOIN own y ON y.repo_id = e.repo_id AND y.id = e.dst JOIN files a ON a.repo_id = e.repo_id AND a.id = e.src JOIN files b ON b.repo_id = e.repo_id AND b.id = e.dst")
def component_topology(spark, sf):
    files = hop_files(spark, sf)
    symbols = files.where("complexity > 5").select("repo_id", F.col("id").alias("file_id"), F.lit("component").alias("kind"))
    return architecture.component_topology(files, symbols, hop_edges(spark, sf)).select("ordinal", "src", "dst")


@query(f"WITH {HOPS} SELECT e.ordinal, coalesce(a.path, e.src) AS src_path, coalesce(b.path, e.dst) AS dst_path FROM edges e LEFT JOIN (SELECT * FROM files WHERE complexity > 3) a ON a.repo_id = e.repo_id AND a.id = e.src LEFT JOIN (SELECT * FROM files WHERE complexity > 3) b ON b.repo_id = e.repo_id AND b.id = e.dst")
def edge_paths(spark, sf):
    return architecture.edge_paths(hop_edges(spark, sf), hop_files(spark, sf).where("complexity > 3")).select("ordinal", "src_path", "dst_path")


_HOT = f"""WITH {HOPS}, i AS (SELECT repo_id, dst AS id, count(*) AS n FROM edges WHERE kind = 'import' GROUP BY 1, 2), o AS (SELECT repo_id, src AS id, count(*) AS n FROM edges WHERE kind = 'import' GROUP BY 1, 2),
  h AS (SELECT f.repo_id, f.path, f.complexity, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM files f LEFT JOIN i ON i.repo_id = f.repo_id AND i.id = f.id LEFT JOIN o ON o.repo_id = f.repo_id AND o.id = f.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY complexity + 3 * inbound DESC, path COLLATE en, path) AS ordinal FROM h)"""


@query(_HOT + " SELECT repo_id, path, complexity, inbound, outbound, ordinal FROM r WHERE ordinal <= 15")
def hotspots(spark, sf):
    h = summary.hotspots(hop_files(spark, sf), hop_edges(spark, sf))
    return h.select("repo_id", "path", "complexity", "inbound", "outbound", F.col("ordinal").cast("long").alias("ordinal"))


_ID = "regexp_replace({}, '[^A-Za-z0-9_]', '_', 'g')"


@query(f"""WITH {HOPS} SELECT repo_id, CAST(1 AS BIGINT) AS section, CAST(0 AS BIGINT) AS ordinal, '  ' || {_ID.format("path")} || '["' || path || '"]' AS line FROM files
UNION ALL SELECT e.repo_id, 2, e.ordinal, '  ' || {_ID.format("a.path")} || ' --> ' || {_ID.format("b.path")} FROM edges e JOIN files a ON a.repo_id = e.repo_id AND a.id = e.src JOIN files b ON b.repo_id = e.repo_id AND b.id = e.dst WHERE e.kind = 'import'""")
def mermaid_lines(spark, sf):
    lines = architecture.file_mermaid(hop_files(spark, sf), hop_edges(spark, sf))
    return lines.select("repo_id", F.col("section").cast("long").alias("section"), "ordinal", "line")


# --- structure -----------------------------------------------------------------------------------------------------------

_DIRS = f"""WITH {HOPS}, f AS (SELECT *, split_part(path, '/', 1) AS folder FROM placed), x AS (SELECT e.repo_id, a.folder AS af, b.folder AS bf FROM edges e JOIN f a ON a.repo_id = e.repo_id AND a.id = e.src JOIN f b ON b.repo_id = e.repo_id AND b.id = e.dst WHERE a.folder <> b.folder),
  s AS (SELECT repo_id, folder, count(*) AS files, min(place) AS first FROM f GROUP BY 1, 2), i AS (SELECT repo_id, bf AS folder, count(*) AS n FROM x GROUP BY 1, 2), o AS (SELECT repo_id, af AS folder, count(*) AS n FROM x GROUP BY 1, 2),
  d AS (SELECT s.repo_id, s.folder AS path, s.files, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound, row_number() OVER (PARTITION BY s.repo_id ORDER BY s.files DESC, s.first) AS ordinal FROM s LEFT JOIN i ON i.repo_id = s.repo_id AND i.folder = s.folder LEFT JOIN o ON o.repo_id = s.repo_id AND o.folder = s.folder)"""
_DOES = "CASE path " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in architecture.RESPONSIBILITIES.items()) + f" ELSE '{architecture.UNKNOWN}' END"


@query(_DIRS + f" SELECT repo_id, path, {_DOES} AS responsibility, files, inbound, outbound, ordinal FROM d")
def directories(spark, sf):
    d = architecture.directories(hop_files(spark, sf), hop_edges(spark, sf))
    return d.withColumn("ordinal", F.col("ordinal").cast("long"))


_LAYERED = f"""WITH {HOPS}, f AS (SELECT repo_id, id, split_part(path, '/', 1) AS folder FROM files), p AS (SELECT e.repo_id, a.folder AS name, b.folder AS dep, min(e.ordinal) AS first FROM edges e JOIN f a ON a.repo_id = e.repo_id AND a.id = e.src JOIN f b ON b.repo_id = e.repo_id AND b.id = e.dst
  WHERE e.kind = 'import' AND a.folder <> b.folder AND a.folder IN ({_LAYERS}) GROUP BY 1, 2, 3), layer AS (SELECT DISTINCT repo_id, folder AS name, list_position([{_LAYERS}], folder) AS n FROM f WHERE folder IN ({_LAYERS}))"""


@query(_LAYERED + ", g AS (SELECT repo_id, name, string_agg(dep, '|' ORDER BY first) AS deps FROM p GROUP BY 1, 2) SELECT l.repo_id, l.name, coalesce(g.deps, '') AS depends_on FROM layer l LEFT JOIN g ON g.repo_id = l.repo_id AND g.name = l.name")
def layers(spark, sf):
    found = architecture.layers(hop_files(spark, sf), hop_edges(spark, sf))
    return found.select("repo_id", "name", joined(F.col("depends_on")).alias("depends_on"))


@query(_LAYERED + """, met AS (SELECT repo_id, name, n, 0 AS pos FROM layer UNION ALL SELECT p.repo_id, p.dep, l.n, row_number() OVER (PARTITION BY p.repo_id, p.name ORDER BY first) FROM p JOIN layer l ON l.repo_id = p.repo_id AND l.name = p.name),
  lines AS (SELECT DISTINCT repo_id, 0 AS section, 0 AS n, 0 AS pos, 'graph TD' AS line FROM layer UNION ALL SELECT repo_id, 1, min(n * 1000 + pos), 0, '  ' || name || '["' || name || '"]' FROM met GROUP BY repo_id, name
    UNION ALL SELECT p.repo_id, 2, l.n, row_number() OVER (PARTITION BY p.repo_id, p.name ORDER BY first), '  ' || p.name || ' --> ' || p.dep FROM p JOIN layer l ON l.repo_id = p.repo_id AND l.name = p.name)
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY section, n, pos) AS line_no, line FROM lines""")
def layer_mermaid(spark, sf):
    found = architecture.layer_mermaid(architecture.layers(hop_files(spark, sf), hop_edges(spark, sf)))
    return found.select("repo_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH {HOPS}, c AS (SELECT repo_id, count(*) AS n, avg(complexity) AS c, floor(100.0 * count(*) FILTER (typed) / count(*) + 0.5) AS typing FROM files GROUP BY 1), e AS (SELECT repo_id, count(*) AS m FROM edges WHERE kind = 'import' GROUP BY 1),
  s AS (SELECT c.repo_id, floor(least(100, greatest(0, 100 - 5 * c.c)) + 0.5) AS complexity, floor(least(100, greatest(0, 100 - 10 * coalesce(e.m, 0) / c.n)) + 0.5) AS coupling, typing FROM c LEFT JOIN e USING (repo_id))
SELECT repo_id, CAST(complexity AS BIGINT) AS complexity, CAST(coupling AS BIGINT) AS coupling, CAST(typing AS BIGINT) AS typing, CAST(floor((complexity + coupling + typing) / 3 + 0.5) AS BIGINT) AS score FROM s""")
def maintainability(spark, sf):
    m = metrics.maintainability(hop_files(spark, sf), hop_edges(spark, sf))
    return m.select("repo_id", *(F.col(c).cast("long").alias(c) for c in ("complexity", "coupling", "typing", "score")))


@query(f"WITH {SYMBOLS}, {DOC_EDGES}, f AS (SELECT repo_id, count(*) AS files FROM docs GROUP BY 1), s AS (SELECT repo_id, count(*) AS symbols, count(*) FILTER (kind = 'component') AS components FROM symbols GROUP BY 1) SELECT f.repo_id, files, coalesce(symbols, 0) AS symbols, coalesce(components, 0) AS components, coalesce(edges, 0) AS edges FROM f LEFT JOIN s USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS edges FROM doc_edges GROUP BY 1) USING (repo_id)")
def scale_counts(spark, sf):
    return summary.scale(doc_files(spark, sf), doc_symbols(spark, sf), doc_edges(spark, sf))


@query(_DIRS + " SELECT repo_id, CAST(greatest(0, count(*) - 3) AS BIGINT) AS modules FROM d GROUP BY 1")
def truncation(spark, sf):
    d = architecture.directories(hop_files(spark, sf), hop_edges(spark, sf))
    return d.groupBy("repo_id").agg(summary.left_out(F.count("*"), 3).alias("modules"))


_FEW = summary.Limits(modules=3, hotspots=4, cycles=1, cycle_files=5, rules=2, samples=2)


@query(REACH + f""", dirs AS (WITH {_DIRS.split(HOPS + ", ")[1]} SELECT * FROM d), hot AS (WITH {_HOT.split(HOPS + ", ")[1]} SELECT * FROM r),
  comp AS (SELECT m.repo_id, m.component, count(*) AS n, min(p.place) AS first, list(p.path ORDER BY p.place) AS paths FROM member m JOIN placed p ON p.repo_id = m.repo_id AND p.id = m.id GROUP BY 1, 2),
  cyc AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY first) AS ordinal FROM comp),
  pairs AS (SELECT d.repo_id, a.component, x.path AS src, y.path AS dst, count(*) AS refs, min(d.ordinal) AS first FROM edges d JOIN member a ON a.repo_id = d.repo_id AND a.id = d.src JOIN member b ON b.repo_id = d.repo_id AND b.id = d.dst JOIN files x ON x.repo_id = d.repo_id AND x.id = d.src JOIN files y ON y.repo_id = d.repo_id AND y.id = d.dst WHERE d.kind = 'import' AND a.component = b.component GROUP BY 1, 2, 3, 4),
  cut AS (SELECT repo_id, component, src || '>' || dst || '>' || refs AS cut FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, component ORDER BY refs, first) AS k FROM pairs) WHERE k = 1),
  found AS (SELECT repo_id, 'r' || CAST(substr(id, 2) AS BIGINT) % 3 AS rule, CAST(substr(id, 2) AS BIGINT) AS ordinal, path, row_number() OVER (PARTITION BY repo_id, CAST(substr(id, 2) AS BIGINT) % 3 ORDER BY CAST(substr(id, 2) AS BIGINT)) AS k FROM files),
  ruled AS (SELECT repo_id, rule || ':' || count(*) || ':' || string_agg(path, ',' ORDER BY ordinal) FILTER (k <= 2) AS said, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, min(ordinal)) AS k FROM found GROUP BY repo_id, rule),
  a1 AS (SELECT repo_id, string_agg(path || ':' || files, '|' ORDER BY ordinal) FILTER (ordinal <= 3) AS modules, greatest(0, count(*) - 3) AS n FROM dirs GROUP BY 1), a2 AS (SELECT repo_id, string_agg(path || ':' || inbound, '|' ORDER BY ordinal) FILTER (ordinal <= 4) AS hotspots, greatest(0, count(*) - 4) AS n FROM hot GROUP BY 1),
  a3 AS (SELECT c.repo_id, max(array_to_string(c.paths[:5], ',') || '/' || c.n || '/' || cut.cut) FILTER (ordinal <= 1) AS cycles, greatest(0, count(*) - 1) AS n FROM cyc c LEFT JOIN cut ON cut.repo_id = c.repo_id AND cut.component = c.component GROUP BY 1), a4 AS (SELECT repo_id, string_agg(said, '|' ORDER BY k) FILTER (k <= 2) AS rules, greatest(0, count(*) - 2) AS n FROM ruled GROUP BY 1)
SELECT a1.repo_id, modules, hotspots, coalesce(cycles, '') AS cycles, rules, a1.n || '|' || a2.n || '|' || coalesce(a3.n, 0) || '|' || a4.n AS left_out FROM a1 JOIN a2 USING (repo_id) LEFT JOIN a3 USING (repo_id) JOIN a4 USING (repo_id)""")
def summaries(spark, sf):
    """The bounded summary of each repository, with all its limits, and what they leave out."""
    stages = Stages(spark, "summaries")
    files, edges = stages.put(hop_files(spark, sf), "files"), stages.put(hop_edges(spark, sf), "edges")
    cycles = stages.put(graph.components(files, edges), "cycles")
    number = F.substring("id", 2, 20).cast("long")
    found = files.select("repo_id", F.concat(F.lit("r"), (number % 3).cast("string")).alias("rule"), F.lit("warning").alias("severity"), F.array("path").alias("files"), number.alias("ordinal"))
    none = files.select("repo_id", F.col("id").alias("file_id"), F.lit("variable").alias("kind"))
    stacks = files.select("repo_id").distinct().select("repo_id", *(F.lit(None).cast("string").alias(c) for c in ("framework", "build_tool", "router")), F.array().cast("array<string>").alias("state_management"))
    cuts = graph.cycle_cuts(cycles, architecture.edge_paths(edges, files))
    made = summary.contexts(stacks, files, none, edges, stacks, metrics.maintainability(files, edges), architecture.directories(files, edges), architecture.layers(files, edges), cycles, cuts, found, _FEW)
    x = F.col("context")
    pairs = lambda c, *ks: joined(F.transform(x[c], lambda m: F.concat_ws(":", *(m[k].cast("string") for k in ks))))
    cut = lambda c: F.concat_ws(">", c["from"], c["to"], c["references"].cast("string"))
    cycle = joined(F.transform(x["cycles"], lambda c: F.concat_ws("/", joined(c["files"], ","), c["totalFiles"].cast("string"), cut(c["suggestedCut"]))))
    said = joined(F.transform(x["findings"], lambda r: F.concat_ws(":", r["rule"], r["count"].cast("string"), joined(r["samples"], ","))))
    left = F.concat_ws("|", *(x["truncated"][k].cast("string") for k in ("modules", "hotspots", "cycles", "findingRules")))
    return made.select("repo_id", pairs("modules", "path", "files").alias("modules"), pairs("hotspots", "path", "inbound").alias("hotspots"), cycle.alias("cycles"), said.alias("rules"), left.alias("left_out"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 3 > 0 THEN least(CAST(0.99 AS DOUBLE), CAST(0.7 AS DOUBLE) + (p_size % 6) * CAST(0.06 AS DOUBLE)) ELSE CAST(0.25 AS DOUBLE) END, 6) AS confidence FROM part")
def confidence(spark, sf):
    known = F.when(F.col("p_size") % 3 > 0, "x")
    return t(spark, sf, "part").select("p_partkey", F.round(metrics.confidence(known, F.col("p_size") % 6), 6).alias("confidence"))


_DEPS = "deps AS (SELECT o_custkey % 200 AS repo, CASE o_orderkey % 7 WHEN 0 THEN 'next' WHEN 1 THEN 'nuxt' WHEN 2 THEN 'react' WHEN 3 THEN 'vue' WHEN 4 THEN 'vite' WHEN 5 THEN 'zustand' ELSE 'vue-router' END AS name, o_orderkey % 3 AS rank, o_orderkey AS k FROM orders)"


def order_deps(spark, sf):
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, ("next", "nuxt", "react", "vue", "vite", "zustand", "vue-router"))), (k % 7 + 1).cast("int"))
    d = t(spark, sf, "orders").select((F.col("o_custkey") % 200).cast("string").alias("repo_id"), name.alias("name"), (k % 3 * F.lit(10_000_000_000) + k).alias("rank"), k.cast("string").alias("version"))
    return metrics.merged_dependencies(d)


@query(f"WITH {_DEPS} SELECT CAST(repo AS VARCHAR) AS repo_id, CASE WHEN bool_or(name = 'next') THEN 'Next.js' WHEN bool_or(name = 'nuxt') THEN 'Nuxt' WHEN bool_or(name = 'react') THEN 'React' WHEN bool_or(name = 'vue') THEN 'Vue' END AS framework, CASE WHEN bool_or(name = 'vite') THEN 'Vite' END AS build_tool, CASE WHEN bool_or(name = 'zustand') THEN 'Zustand' ELSE '' END AS state, CASE WHEN bool_or(name = 'vue-router') THEN 'Vue Router' END AS router FROM deps GROUP BY 1")
def priority_pick(spark, sf):
    d = F.col("deps")
    return order_deps(spark, sf).select("repo_id", metrics.first_of(d, metrics.FRAMEWORKS).alias("framework"), metrics.first_of(d, metrics.BUILD_TOOLS).alias("build_tool"), joined(metrics.state_libraries(d)).alias("state"), metrics.first_of(d, metrics.ROUTERS).alias("router"))


@query(f"WITH {_DEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY rank DESC, k DESC) AS n FROM deps) SELECT CAST(repo AS VARCHAR) AS repo_id, name, CAST(k AS VARCHAR) AS version FROM r WHERE n = 1")
def map_merge_last_win(spark, sf):
    return order_deps(spark, sf).select("repo_id", F.explode("deps").alias("name", "version"))


# --- retrieval -----------------------------------------------------------------------------------------------------------

_QUERIES = "q AS (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' 找订单组件' WHEN 1 THEN ' 登录 useCart' WHEN 2 THEN ' 权限' ELSE '' END AS query FROM conversations)"


def questions(spark, sf):
    more = F.element_at(F.array(*map(F.lit, (" 找订单组件", " 登录 useCart", " 权限", ""))), (F.col("conv_id") % 4 + 1).cast("int"))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", more).alias("query"))


_BIGRAMS = "CASE WHEN length(x) <= 2 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) END"
_STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_TERMS = f"list_filter(list_concat(regexp_extract_all(lower(query), '[a-z][a-z0-9_-]+'), flatten(list_transform(regexp_extract_all(query, '[一-龥]+'), lambda x: {_BIGRAMS}))), lambda w: length(w) <= 12 AND w NOT IN ({_STOPS}))"


@query(f"WITH {_QUERIES}, w AS (SELECT conv_id, turn, unnest({_TERMS}) AS term FROM q) SELECT DISTINCT conv_id, turn, term FROM w")
def query_terms(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", F.explode(retrieval.query_terms(F.col("query"))).alias("term")).distinct()


@query(f"WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '找' WHEN 1 THEN '订单' WHEN 2 THEN '找订单组件' ELSE '购物车列表' END AS x FROM supplier) SELECT s_suppkey, array_to_string({_BIGRAMS}, '|') AS grams FROM s")
def char_bigrams(spark, sf):
    run = F.element_at(F.array(*map(F.lit, ("找", "订单", "找订单组件", "购物车列表"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t(spark, sf, "supplier").select("s_suppkey", joined(retrieval.char_bigrams(run)).alias("grams"))


_CONCEPT_ROWS = ", ".join(f"('{k}', '{v}')" for k, vs in retrieval.CONCEPTS.items() for v in vs)


@query(f"WITH {_QUERIES}, c AS (SELECT * FROM (VALUES {_CONCEPT_ROWS}) AS v(k, word)) SELECT DISTINCT conv_id, turn, word AS concept FROM q JOIN c ON contains(query, k)")
def concept_expand(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", F.explode(F.array_distinct(retrieval.synonyms(F.col("query")))).alias("concept"))


_HITS = " || ".join(f"CASE WHEN contains(lower(path || chr(10) || content), '{c}') THEN '|{c}' ELSE '' END" for c in CONCEPTS)


@query(f"WITH {DOCS} SELECT doc_id, substr(hits, 2) AS hits FROM (SELECT doc_id, {_HITS} AS hits FROM docs) WHERE hits <> ''")
def text_hits(spark, sf):
    files = doc_contents(spark, sf).select("repo_id", F.col("doc_id").alias("id"), "path")
    found = retrieval.text_hits(files, doc_contents(spark, sf), list(CONCEPTS))
    return found.select(F.col("id").alias("doc_id"), joined(F.col("hits")).alias("hits"))


_ANY_NAMED = " OR ".join(f"contains(lower(name), '{c}')" for c in CONCEPTS)


@query(f"WITH {SYMBOLS} SELECT file_id, count(*) AS n, arg_max(name, ordinal) AS symbol FROM symbols WHERE kind IN ('component', 'hook') AND ({_ANY_NAMED}) GROUP BY 1")
def symbol_hits(spark, sf):
    found = retrieval.symbol_hits(doc_symbols(spark, sf), list(CONCEPTS), ["component", "hook"])
    return found.select(F.col("id").alias("file_id"), "n", "symbol")


@query(f"WITH {HOPS} SELECT e.repo_id, e.src AS id, CAST(least(count(*), 5) * 5 AS BIGINT) AS bonus FROM edges e JOIN files f ON f.repo_id = e.repo_id AND f.id = e.dst WHERE e.kind <> 'call' GROUP BY 1, 2")
def relation_bonus(spark, sf):
    files = hop_files(spark, sf)
    found = retrieval.relation_hits(hop_edges(spark, sf), files, files.select("repo_id", "id"), ["import", "render"])
    return found.select("repo_id", "id", retrieval.relation_bonus(F.col("total")).cast("long").alias("bonus"))


@query(f"""WITH {HOPS}, d AS (SELECT e.repo_id, e.src AS id, f.path, min(e.ordinal) AS first FROM edges e JOIN files f ON f.repo_id = e.repo_id AND f.id = e.dst WHERE e.kind <> 'call' GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY first) AS k FROM d) SELECT repo_id, id, string_agg(path, '|' ORDER BY k) AS related FROM r WHERE k <= 8 GROUP BY 1, 2""")
def related_paths(spark, sf):
    files = hop_files(spark, sf)
    found = retrieval.relation_hits(hop_edges(spark, sf), files, files.select("repo_id", "id"), ["import", "render"])
    return found.select("repo_id", "id", joined(F.col("related")).alias("related"))


_WORDS = ("order", "checkout", "purchase", "trade", "订单", "hook", "the", "ing_was")
_SAID = " || ".join(f"CASE WHEN contains(lower(path || chr(10) || content), '{c}') THEN '|文本命中：{c}' ELSE '' END" for c in _WORDS)
_COUNT = " + ".join(f"CAST(contains(lower(path || chr(10) || content), '{c}') AS INT)" for c in _WORDS)
_SYM = " OR ".join(f"contains(lower(name), '{c}')" for c in _WORDS)


@query(f"""WITH {SYMBOLS}, {DOC_EDGES}, x AS (SELECT sha1(path) AS id, path, 10 * ({_COUNT}) AS s, {_SAID} AS said FROM docs), y AS (SELECT file_id AS id, 25 * count(*) AS s, arg_max(name, ordinal) AS symbol, repeat('|符号命中：hook', count(*)) AS said FROM symbols WHERE kind = 'hook' AND ({_SYM}) GROUP BY 1),
  base AS (SELECT x.*, coalesce(y.s, 0) AS ys, y.symbol, coalesce(y.said, '') AS ysaid FROM x LEFT JOIN y USING (id) WHERE x.s + coalesce(y.s, 0) > 0),
  rk AS (SELECT src AS id, kind, count(*) AS n, min(ordinal) AS first FROM doc_edges GROUP BY 1, 2), r AS (SELECT id, 5 * least(sum(n), 5) AS s, string_agg('|关系命中：' || kind || CASE WHEN n > 1 THEN ' × ' || n ELSE '' END, '' ORDER BY first) AS said FROM rk GROUP BY 1),
  near AS (SELECT src AS id, string_agg(dst_path, '|' ORDER BY ordinal) AS related FROM doc_edges GROUP BY 1)
SELECT path, symbol, CAST(base.s + ys + coalesce(r.s, 0) AS BIGINT) AS score, substr(base.said || ysaid || coalesce(r.said, ''), 2) AS reasons, coalesce(related, '') AS related FROM base LEFT JOIN r USING (id) LEFT JOIN near USING (id) ORDER BY score DESC, base.s = 0, path COLLATE en, path LIMIT 30""")
def hybrid_retrieve(spark, sf):
    plan = retrieval.parse_query(spark, QUERY)
    found = retrieval.retrieve(plan, doc_files(spark, sf), doc_symbols(spark, sf), doc_edges(spark, sf), doc_contents(spark, sf))
    return found.select("path", "symbol", "score", joined(F.col("reasons")).alias("reasons"), joined(F.col("related_paths")).alias("related"))


@query(f"""WITH {_QUERIES}, a AS (SELECT conv_id, turn, query || CASE conv_id % 3 WHEN 0 THEN ' Hook' WHEN 1 THEN ' 调用' ELSE ' hook' END AS query FROM q) SELECT conv_id, turn, CASE WHEN contains(query, '组件') THEN 'component' WHEN contains(query, 'Hook') OR contains(query, 'hook') THEN 'hook' ELSE 'component|hook|function|class|variable' END AS symbol_kinds,
  CASE WHEN contains(query, '调用') THEN 'call|import|uses-hook' ELSE 'import|call|render|uses-hook|uses-store' END AS relation_kinds FROM a""")
def plan_kinds(spark, sf):
    more = F.element_at(F.array(*map(F.lit, (" Hook", " 调用", " hook"))), (F.col("conv_id") % 3 + 1).cast("int"))
    plan = retrieval.query_plan(F.concat("query", more))
    return questions(spark, sf).select("conv_id", "turn", plan.alias("p")).select("conv_id", "turn", joined(F.col("p.symbol_kinds")).alias("symbol_kinds"), joined(F.col("p.relation_kinds")).alias("relation_kinds"))


_ALL_KINDS = "['component', 'hook', 'function', 'class', 'variable']"


@query(f"""WITH {SYMBOLS}, {DOC_EDGES}, {_QUERIES}, a AS (SELECT conv_id * 1000 + turn AS key, query || CASE conv_id % 3 WHEN 0 THEN ' Hook' WHEN 1 THEN ' 调用' ELSE ' hook' END AS query FROM q),
  c AS (SELECT * FROM (VALUES {_CONCEPT_ROWS}) AS v(k, word)), w AS (SELECT DISTINCT key, word FROM (SELECT key, word FROM a JOIN c ON contains(query, k) UNION ALL SELECT key, unnest({_TERMS}) FROM a)),
  p AS (SELECT key, CASE WHEN contains(query, '组件') THEN ['component'] WHEN contains(query, 'Hook') OR contains(query, 'hook') THEN ['hook'] ELSE {_ALL_KINDS} END AS kinds, contains(query, '调用') AS called FROM a),
  wanted AS (SELECT DISTINCT word FROM w), hit AS (SELECT doc_id, word FROM docs, wanted WHERE contains(lower(path || chr(10) || content), word)),
  texts AS (SELECT key, doc_id, 10 * count(*) AS s FROM w JOIN hit USING (word) GROUP BY 1, 2),
  names AS (SELECT DISTINCT name FROM symbols), named AS (SELECT name, word FROM names, wanted WHERE contains(lower(name), word)),
  syms AS (SELECT key, doc_id, 25 * count(*) AS s FROM (SELECT DISTINCT w.key, s.doc_id, s.ordinal FROM w JOIN named n USING (word) JOIN symbols s ON s.name = n.name JOIN p ON p.key = w.key WHERE list_contains(p.kinds, s.kind)) GROUP BY 1, 2),
  base AS (SELECT key, doc_id, coalesce(t.s, 0) + coalesce(y.s, 0) AS s, t.s IS NULL AS late FROM texts t FULL JOIN syms y USING (key, doc_id)),
  e AS (SELECT src, count(*) AS every, count(*) FILTER (kind = 'import') AS imports FROM doc_edges GROUP BY 1),
  scored AS (SELECT d.repo_id, b.key, d.path, b.s + 5 * least(CASE WHEN p.called THEN coalesce(e.imports, 0) ELSE coalesce(e.every, 0) END, 5) AS score, b.late FROM base b JOIN docs d ON d.doc_id = b.doc_id JOIN p ON p.key = b.key LEFT JOIN e ON e.src = sha1(d.path)),
  r AS (SELECT repo_id, key, path, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY repo_id, key ORDER BY score DESC, late, path COLLATE en, path) AS rank FROM scored) SELECT * FROM r WHERE rank <= 30""")
def retrieve_questions(spark, sf):
    """All questions against all files of each repository: the best thirty of each."""
    more = F.element_at(F.array(*map(F.lit, (" Hook", " 调用", " hook"))), (F.col("conv_id") % 3 + 1).cast("int"))
    asked = questions(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("key"), retrieval.query_plan(F.concat("query", more)).alias("plan"))
    found = question_tables.retrieve_all(asked, doc_files(spark, sf), doc_symbols(spark, sf), doc_edges(spark, sf), doc_contents(spark, sf))
    return found.withColumn("rank", F.col("rank").cast("long"))


# --- events --------------------------------------------------------------------------------------------------------------

LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_type AS node, CASE WHEN event_type = 'error' AND value > 200 THEN 'error' WHEN value > 30 THEN 'end' ELSE 'start' END AS phase, CAST(floor(value) AS BIGINT) AS duration_ms, props AS detail FROM events)"""


def event_log(spark, sf):
    return as_log(t(spark, sf, "events"))


def as_log(events: DataFrame) -> DataFrame:
    phase = F.when((F.col("event_type") == "error") & (F.col("value") > 200), "error").when(F.col("value") > 30, "end").otherwise("start")
    return events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("node"), phase.alias("phase"), F.floor("value").cast("long").alias("duration_ms"), F.col("props").alias("detail"))


_FOLD = f"WITH {LOG}, s AS (SELECT run_id, node, arg_max(CASE phase WHEN 'start' THEN 'running' WHEN 'end' THEN 'done' ELSE 'error' END, seq) AS status, arg_max(duration_ms, seq) AS duration_ms, min(seq) AS first_seq FROM log GROUP BY 1, 2)"


@query(_FOLD + " SELECT * FROM s")
def progress_fold(spark, sf):
    return ev.node_states(event_log(spark, sf)).drop("detail")


@query(_FOLD + " SELECT run_id, count(*) FILTER (status <> 'running') || '/11' AS label FROM s GROUP BY 1")
def progress_label(spark, sf):
    return ev.progress_label(ev.node_states(event_log(spark, sf)))


@query(f"WITH {LOG} SELECT run_id, arg_max(node, seq) AS current_step FROM log WHERE phase = 'start' GROUP BY 1")
def current_step(spark, sf):
    return ev.current_step(event_log(spark, sf))


_STATUS = f"WITH {LOG}, st AS (SELECT run_id, CASE WHEN bool_or(phase = 'error') THEN 'failed' WHEN bool_or(node = 'purchase' AND phase = 'end' AND duration_ms > 200) THEN 'completed' ELSE 'running' END AS status, max(seq) AS started FROM log GROUP BY 1)"


def closing() -> Column:
    return (F.col("node") == "purchase") & (F.col("phase") == "end") & (F.col("duration_ms") > 200)


def _status(spark, sf):
    return ev.run_status(event_log(spark, sf), closing())


@query(_STATUS + " SELECT run_id, status FROM st")
def run_status(spark, sf):
    return _status(spark, sf)


@query(_STATUS + " SELECT run_id, status FROM st WHERE status = 'running' UNION ALL (SELECT run_id, status FROM st WHERE status <> 'running' ORDER BY started DESC, run_id LIMIT 20)")
def run_retention(spark, sf):
    started = event_log(spark, sf).groupBy("run_id").agg(F.max("seq").alias("started"))
    return ev.retained_runs(_status(spark, sf).join(started, "run_id")).select("run_id", "status")


@query(f"WITH {LOG} SELECT run_id, max(seq) AS seq, arg_max(detail, seq) AS state FROM log GROUP BY 1")
def checkpoint_upsert(spark, sf):
    rows = event_log(spark, sf).select("run_id", "seq", F.lit("").alias("updated_at"), F.col("detail").alias("state"))
    return ev.latest_checkpoints(rows).select("run_id", "seq", "state")


@query(_FOLD.replace("min(seq) AS first_seq", "arg_max(detail, seq) AS detail, min(seq) AS first_seq") + " SELECT * FROM s")
def stream_progress(spark, sf):
    """The fold of the log read as a stream until what is there is read, to files."""
    return states.last_nodes(states.fold(event_stream(spark, sf), "progress", most_finished=None))


def event_stream(spark, sf) -> DataFrame:
    """The events as a stream, from a file or a folder of files."""
    return as_log(spark.readStream.schema(t(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*"))


@query(_STATUS + " SELECT run_id, status FROM st WHERE status = 'running' UNION ALL (SELECT run_id, status FROM st WHERE status <> 'running' ORDER BY started DESC, run_id LIMIT 20)")
def stream_retention(spark, sf):
    """Running runs and the newest finished ones, of a stream's state that forgets all others."""
    rows = states.fold(event_stream(spark, sf), "retention", closing=closing())
    return ev.retained_runs(states.kept_runs(rows)).select("run_id", "status")


@query(f"WITH {LOG} SELECT seq, 'event: ' || phase || chr(10) || 'data: ' || '{{\"node\":\"' || node || '\",\"seq\":' || seq || '}}' || chr(10) || chr(10) AS frame FROM log")
def sse_frames(spark, sf):
    return event_log(spark, sf).select("seq", fn.sse_frame(F.col("phase"), F.to_json(F.struct("node", "seq"))).alias("frame"))


@query("SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE ((ms + 50) // 1000) || '.' || (((ms + 50) // 100) % 10) || 's' END AS label FROM (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS ms FROM events)")
def elapsed_fmt(spark, sf):
    ms = F.floor(F.col("value") * 37).cast("long")
    return t(spark, sf, "events").select("event_id", fn.duration_label(ms).alias("label"))


_VERDICTS = """checks AS (SELECT c.c_nationkey AS n, c.c_nationkey % 3 > 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AS ok FROM customer c),
  per AS (SELECT n, count(*) AS checks, bool_and(ok) AS ok FROM checks GROUP BY 1),
  verdicts AS (SELECT n_name AS name, coalesce(checks, 0) AS checks, coalesce(ok, false) AS passed, n_nationkey % 2 = 1 AS known FROM nation LEFT JOIN per ON n = n_nationkey),
  outcomes AS (SELECT name, checks, passed, CASE WHEN known THEN CASE WHEN passed THEN 'FIXED' ELSE 'KNOWN-FAIL' END WHEN passed THEN 'PASS' ELSE 'REGRESSION' END AS outcome FROM verdicts)"""


def nation_checks(spark, sf):
    """Customers are facts that a nation's suite expects; those with orders are found, and all of two nations in three."""
    c = t(spark, sf, "customer").join(t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name")), "c_nationkey")
    expected = c.select("name", F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("fact"))
    found = t(spark, sf, "orders").select(F.lit("customer").alias("kind"), F.col("o_custkey").cast("string").alias("fact"))
    known = t(spark, sf, "customer").where("c_nationkey % 3 > 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("fact"))
    return evaluate.met(expected, found.unionByName(known))


def nation_verdicts(spark, sf):
    status = F.when(F.col("n_nationkey") % 2 == 1, "known-failure").otherwise("expected-pass")
    return evaluate.verdicts(nation_checks(spark, sf), t(spark, sf, "nation").select(F.col("n_name").alias("name"), status.alias("status")))


@query(f"WITH {_VERDICTS} SELECT name, checks, passed, outcome FROM outcomes")
def expect_check(spark, sf):
    return nation_verdicts(spark, sf)


@query(f"WITH {_VERDICTS} SELECT outcome, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM outcomes) AS share FROM outcomes GROUP BY 1")
def outcome_tally(spark, sf):
    return evaluate.tally(nation_verdicts(spark, sf))


# --- stored tables, logs and reports -------------------------------------------------------------------------------------


@query("SELECT path, repo_id, sha256(content || CASE WHEN repo_id = 'en' THEN '!' ELSE '' END) AS content_hash, repo_id = 'en' AS new FROM (SELECT lang AS repo_id, source || '/' || lang || '/' || doc_id || '.' || ['ts', 'tsx', 'js', 'jsx', 'vue'][doc_id % 5 + 1] AS path, text AS content FROM documents)")
def stored_files(spark, sf):
    """The file index after one repository has been analysed again, and which of its files had changed before that."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    first = doc_files(spark, sf).select("repo_id", "path", "content_hash")
    store.replace_files(first)
    again = doc_contents(spark, sf).where("repo_id = 'en'").select("repo_id", "path", fn.content_hash(F.concat("content", F.lit("!"))).alias("content_hash"))
    both = again.unionByName(first.where("repo_id <> 'en'"))
    changed = Stages(spark, "changed").put(store.changed(both).select("repo_id", "path", F.lit(True).alias("new")), "rows")
    store.replace_files(again)
    return store.files().join(changed, ["repo_id", "path"], "left").select("path", F.col("repo_id").cast("string").alias("repo_id"), "content_hash", F.coalesce("new", F.lit(False)).alias("new"))


@query("SELECT n_name AS id, 't' || k AS generated_at, '{\"nation\":' || n_nationkey || ',\"k\":' || k || '}' AS payload, r_name AS repo_id, CASE k WHEN 1 THEN '{\"k\":1}' ELSE '{\"k\":0}' END AS state FROM nation JOIN region ON r_regionkey = n_regionkey, (VALUES (0), (1)) AS v(k)")
def stored_runs(spark, sf):
    """Two commits of a run and a checkpoint for each nation: runs are added, nothing is replaced."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    here = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for k in (0, 1):
        payload = F.to_json(F.struct(F.col("n_nationkey").alias("nation"), F.lit(k).alias("k")))
        runs = here.select(F.col("n_name").alias("id"), F.lit(f"t{k}").alias("generated_at"), payload.alias("payload"), F.col("r_name").alias("repo_id"))
        store.commit(runs=runs, checkpoints=here.select(F.concat("n_name", F.lit(f"-{k}")).alias("run_id"), F.lit(k).alias("seq"), F.lit("").alias("updated_at"), F.to_json(F.struct(F.lit(k).alias("k"))).alias("state")))
    states_ = store.checkpoints().select(F.substring_index("run_id", "-", 1).alias("id"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("generated_at"), "state")
    return store.runs().join(states_, ["id", "generated_at"]).select("id", "generated_at", "payload", "repo_id", "state")


_NATION_LOG = """nation_log AS (SELECT n_name AS run_id, CAST(seq AS BIGINT) AS seq, CASE WHEN seq < 2 THEN 'scan' ELSE 'render' END AS node, CASE WHEN seq % 2 = 0 THEN 'start' WHEN seq = 3 AND n_nationkey % 3 = 0 THEN 'error' ELSE 'end' END AS phase, CASE WHEN seq % 2 = 1 THEN CASE WHEN seq = 3 AND n_nationkey % 3 = 0 THEN 'broken' ELSE 'n' || n_nationkey END END AS detail
  FROM nation, (VALUES (0), (1), (2), (3)) AS v(seq) WHERE NOT (n_nationkey % 3 = 2 AND seq = 3))"""


def nation_log(spark, sf) -> DataFrame:
    """The log of a run for each nation: of three one fails in its last step, one ends, and one is still in it. Tasks write it to the shared
    folder, and a stream from the log's own source copies it to a table: in two goes, the second from where the first ended."""
    k = F.col("n_nationkey")
    made = t(spark, sf, "nation").select(F.col("n_name").alias("run_id"), k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("seq")).where("not (k % 3 = 2 and seq = 3)")
    broken = (F.col("k") % 3 == 0) & (F.col("seq") == 3)
    phase = F.when(F.col("seq") % 2 == 0, "start").when(broken, "error").otherwise("end")
    detail = F.when(F.col("seq") % 2 == 1, F.when(broken, "broken").otherwise(F.concat(F.lit("n"), F.col("k").cast("string"))))
    rows = made.select("run_id", "seq", F.when(F.col("seq") < 2, "scan").otherwise("render").alias("node"), phase.alias("phase"), F.lit("t").alias("at"), F.lit(None).cast("long").alias("duration_ms"), detail.alias("detail"))
    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for part in ("seq < 2", "seq >= 2"):
        log.write(rows.where(part), f"{root}/events")
        states.written(log.stream(spark, f"{root}/events"), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema(EVENTS).parquet(f"{root}/rows")


@query(f"WITH {_NATION_LOG} SELECT run_id, seq, node, phase, detail FROM nation_log")
def event_log_files(spark, sf):
    return nation_log(spark, sf).select("run_id", "seq", "node", "phase", "detail")


@query(f"""WITH {_NATION_LOG} SELECT run_id, seq AS n, 'progress' AS name, '{{{{"node":"' || node || '","phase":"' || phase || '","seq":' || seq || '}}}}' AS payload FROM nation_log
UNION ALL SELECT n_name, 4, 'done', '{{{{"status":"' || CASE n_nationkey % 3 WHEN 0 THEN 'failed' ELSE 'completed' END || '"}}}}' FROM nation WHERE n_nationkey % 3 < 2""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}"))
def sse_replay(spark, sf):
    rows = nation_log(spark, sf)
    return ev.replayed_frames(rows, ev.run_status(rows))


_TOP = "top AS (SELECT n_name, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'warning' ELSE 'error' END AS severity FROM nation)"


@query(f"""WITH {_TOP} SELECT '# {report.TITLE}' || chr(10) || chr(10) || '生成时间：t' || chr(10) || chr(10) || '## 技术栈' || chr(10) || '- 框架：Vue' || chr(10) || '- 构建工具：{report.UNKNOWN}' || chr(10) || '- 置信度：0.76' || chr(10) || '- 证据：a；b' || chr(10) || chr(10)
  || '## 指标' || chr(10) || '- 总分：7' || chr(10) || '- coupling: 9' || chr(10) || chr(10) || '## 架构解读' || chr(10) || chr(10) || '_{report.NO_MODEL}_' || chr(10) || chr(10) || '## Findings' || chr(10)
  || (SELECT string_agg('- [' || severity || '] m' || n_nationkey || '（' || n_name || ', x.ts）', chr(10) ORDER BY n_nationkey) FROM top) || chr(10) || chr(10) || '## Mermaid' || chr(10) || '```mermaid' || chr(10) || 'graph TD' || chr(10) || '```' AS text""")
def report_markdown(spark, sf):
    """The report of a result row: its findings are a table, and the text is made by Spark."""
    k = F.col("n_nationkey")
    found = t(spark, sf, "nation").select(k.alias("ordinal"), F.when(k % 2 == 1, "error").otherwise("warning").alias("severity"), F.concat(F.lit("m"), k.cast("string")).alias("message"), F.array("n_name", F.lit("x.ts")).alias("files"))
    rows = found.agg(F.array_sort(F.collect_list(F.struct("ordinal", "severity", "message", "files"))).alias("findings"))
    parts = rows.select(F.to_json(F.struct(F.lit("t").alias("generatedAt"), F.from_json(F.lit('{"framework": "Vue", "confidence": 0.76, "evidence": ["a", "b"]}'), "framework string, confidence double, evidence array<string>").alias("stack"),
        F.from_json(F.lit('{"score": 7, "dimensions": {"coupling": 9}}'), "score int, dimensions map<string,int>").alias("metrics"), "findings", F.lit("graph TD").alias("mermaid"))).alias("result"))
    return report.markdown_rows(parts)
