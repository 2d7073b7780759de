"""Column functions of the repository model, all of them built-in expressions that stay in generated code.

Word boundaries are spelled out with ASCII classes: the engine's own ``\\b`` follows Unicode, source code keywords don't.
Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes and their languages.
LANGUAGES = {"ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "vue": "vue"}
# Folders and file name endings that a scan leaves out.
IGNORED_FOLDERS = ("node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", ".output", ".turbo", "storybook-static", "coverage")
IGNORED_ENDINGS = (".min.js", ".bundle.js")

_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
BRANCHES = rf"{_BEFORE}(?:if|for|while|case|catch){_AFTER}|&&|\|\||\?"
#: White space as JavaScript has it.
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def file_id(path: Column) -> Column:
    return F.sha1(path.cast("binary"))


def content_hash(content: Column) -> Column:
    """Of the decoded text. Bytes that aren't UTF-8 are to be replaced first (decoded())."""
    return F.sha2(content.cast("binary"), 256)


def decoded(raw: Column) -> Column:
    """Text of bytes; invalid sequences become U+FFFD, a byte order mark stays."""
    return F.make_valid_utf8(raw.cast("string"))


def line_count(content: Column) -> Column:
    """Pieces between line ends; an empty file has one, a closing line end adds one."""
    return (F.char_length(content) - F.char_length(F.translate(content, "\n", "")) + 1).cast("int")


def complexity(content: Column) -> Column:
    return (F.regexp_count(content, F.lit(BRANCHES)) + 1).cast("int")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Null where the suffix isn't one of source code."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path))


def ignored(path: Column, folders: tuple[str, ...] = IGNORED_FOLDERS, endings: tuple[str, ...] = IGNORED_ENDINGS) -> Column:
    inside = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, folders)))
    out = inside
    for ending in endings:
        out = out | F.endswith(path, F.lit(ending))
    return out


def language_label(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".ts")) | F.endswith(path, F.lit(".tsx")), "TypeScript").when(F.endswith(path, F.lit(".vue")), "Vue SFC").otherwise("JavaScript")


def callable_kind(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit("^use[A-Z]")), "hook").when(F.regexp_like(name, F.lit("^[A-Z]")), "component").otherwise("function")


def variable_kind(name: Column, init_kind: Column, callee: Column) -> Column:
    """init_kind: none, function (arrow or function expression), call or other. callee: text called."""
    wrapped = F.regexp_like(callee, F.lit(rf"{_BEFORE}(?:memo|forwardRef|observer|styled){_AFTER}")) & F.regexp_like(name, F.lit("^[A-Z]"))
    called = F.when(wrapped, "component").when(F.regexp_like(name, F.lit("^use[A-Z]")), "hook").otherwise("variable")
    return F.when(init_kind == "function", callable_kind(name)).when(init_kind == "call", called).otherwise("variable")


def class_kind(base: Column) -> Column:
    return F.when(F.regexp_like(F.coalesce(base, F.lit("")), F.lit(rf"(^|\.)(Component|PureComponent){_AFTER}")), "component").otherwise("class")


def reading_order(path: Column) -> list[Column]:
    """Sort columns: as people sort names, then by code points."""
    return [F.collate(path, "UNICODE"), path]


def first_path(path: Column) -> Column:
    """The first of a group by reading order, as an aggregate."""
    return F.min(F.struct(F.collate(path, "UNICODE").alias("c"), path.alias("p")))["p"]


def line_of(content: Column, offset: Column) -> Column:
    """Line number of a zero-based offset."""
    return line_count(F.substring(content, F.lit(1), offset))


def mermaid_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def to_score(value: Column) -> Column:
    """Clamped to 0..100, then rounded half up."""
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value.cast("double"))) + 0.5).cast("int")


def top_folder(path: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(path, F.lit("/"), F.lit(1)), F.lit("")), F.lit("."))


def utf16_length(text: Column) -> Column:
    """Characters beyond the basic plane count twice."""
    return F.char_length(text) + F.char_length(text) - F.char_length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""))


def token_estimate(text: Column, per_token: int = 3) -> Column:
    return F.ceil(utf16_length(text) / per_token).cast("long")


def fingerprint(items: Column) -> Column:
    """Of a set: sorted and joined."""
    return F.array_join(F.array_sort(items), " | ")


def html_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def sse_frame(name: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), payload, F.lit("\n\n"))


def duration_label(ms: Column) -> Column:
    """Milliseconds below a second, seconds with one decimal, rounded half up, from there on."""
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms.cast("double") / 1000))
