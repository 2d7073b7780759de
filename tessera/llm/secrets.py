"""Secrets in texts, and multipart credentials linked by an interval join; DataFrame functions only.

Base kinds are found by a pattern each, leftmost and not overlapping: ``assign`` (a named value of six characters or
more), ``access`` (an access identifier) and ``hex`` (a long lower-case hexadecimal run). These are reported always.

Weak kinds are reported only when complementary parts of one credential stand together: ``secret`` is a run of 32 or more
base64 characters that mixes letters and digits and is in no base span, ``endpoint`` is a host name with a service-like shape or a URL. An access
identifier, a secret and an endpoint are the three parts. The scope of an access identifier is the interval of ``scope``
characters around it. A secret is linked when it meets the scope of an access identifier; an endpoint when it meets the
scope of an access identifier that also has a secret, weak or base, in its scope.

The interval join runs without pairs: in each document the parts are sorted by start, and each part looks up the nearest
part of the wanted kind before and after it. An interval meets another of the kind within the scope exactly when it
meets the nearest one, so nothing is lost, and the work grows with the number of parts alone.

Only rows for found parts are moved: texts stay where they are read. Positions are code points, ends exclusive. They are
running sums of the lengths of the pieces between matches and of the matches.

Defined cases: a null or empty text has no spans and the hash of the empty string; each of several rows with one id (or a
null id) is a document of its own if its text differs, and rows that agree in id and text get the same result each; an
empty table gives no rows; equal starts are sorted by kind as listed; extra columns are ignored by the
query and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, free_name

# The base patterns and the least lengths of what they must capture.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: a shorter match holds no longer one
HEX = "[0-9a-f]{24,}"
SECRET = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = "https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?<![A-Za-z0-9@._-])(?:[a-z0-9-]+\\.){1,20}(?:com|net|org|io|cloud|dev|internal|example)(?![A-Za-z0-9_-])"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
PATTERNS = (ASSIGN, ACCESS, HEX, SECRET, ENDPOINT)
SCOPE = 400


def _found(text: Column, rank: int) -> Column:
    """Array of (kind rank, gap before in characters, match) for one pattern: the gaps and matches alternate."""
    pattern = F.lit(PATTERNS[rank])
    gaps, hits = F.split(text, PATTERNS[rank], -1), F.regexp_extract_all(text, pattern, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), x["hit"].alias("hit")))


def parts(df: DataFrame) -> DataFrame:
    """doc_id, text_key, rank, start, end, hit of every match of every pattern, base and weak; failing assignments dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = F.coalesce(F.regexp_like(text, F.lit(ASSIGN + "|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/]{32}")), F.lit(False))
    # weak parts alone can't be reported without an access identifier
    weak = F.contains(text, F.lit("AKIA"))
    arrays = [_found(text, r) for r in range(3)] + [F.when(weak, _found(text, r)).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,hit:string>>")) for r in (3, 4)]
    rows = df.select("doc_id", "text").where(likely).select("doc_id", F.xxhash64(text).alias("text_key"), F.explode(F.concat(*arrays)).alias("x")).select("doc_id", "text_key", "x.*").distinct()
    w = Window.partitionBy("doc_id", "text_key", "rank").orderBy("i")
    ends = F.sum(F.col("gap") + F.char_length("hit")).over(w).cast("long")
    rows = rows.withColumn("end", ends).withColumn("start", F.col("end") - F.char_length("hit"))
    keeps = F.when(F.col("rank") == 0, F.char_length(F.regexp_extract("hit", ASSIGN, 2)) >= ASSIGN_LEAST).otherwise(F.lit(True))
    return rows.where(keeps).select("doc_id", "text_key", "rank", "start", "end", "hit")


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Keeps base parts, and weak parts whose complements stand in scope; adds access_start, the identifier each is linked to.
    rows: doc_id, text_key, rank, start, end, hit."""
    key = ["doc_id", "text_key"]
    before = Window.partitionBy(*key).orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy("start", "rank", "end").rowsBetween(1, Window.unboundedFollowing)

    def near(cond: Column) -> tuple[Column, Column]:
        """(there is such a part within the scope, the start of the nearest)"""
        last_end = F.max(F.when(cond, F.col("end"))).over(before)
        last = F.max(F.when(cond, F.col("start"))).over(before)
        next_ = F.min(F.when(cond, F.col("start"))).over(after)
        back, ahead = F.col("start") - last_end, next_ - F.col("end")
        near_back, near_ahead = F.coalesce(back <= scope, F.lit(False)), F.coalesce(ahead <= scope, F.lit(False))
        return near_back | near_ahead, F.when(near_back & (~near_ahead | (back <= ahead)), last).when(near_ahead, next_)

    # a weak secret inside a base span is that span
    base_end = F.max(F.when(F.col("rank") < 3, F.col("end"))).over(before)
    base_next = F.min(F.when(F.col("rank") < 3, F.col("start"))).over(after)
    rows = rows.withColumn("covered", (F.col("rank") >= 3) & (F.coalesce(base_end > F.col("start"), F.lit(False)) | F.coalesce(base_next < F.col("end"), F.lit(False))))
    rows = rows.where(~F.col("covered"))
    is_access, is_secret = F.col("rank") == 1, F.col("rank").isin(0, 2, 3)
    has_access, access_start = near(is_access)
    has_secret, _ = near(is_secret)
    rows = rows.withColumns({"has_access": has_access, "access_start": access_start, "has_secret": has_secret})
    paired, paired_start = near(is_access & F.col("has_secret"))
    rows = rows.withColumns({"paired": paired, "paired_start": paired_start})
    keep = (F.col("rank") < 3) | ((F.col("rank") == 3) & F.col("has_access")) | ((F.col("rank") == 4) & F.col("paired"))
    at = F.when(F.col("rank") == 1, F.col("start")).when(F.col("rank") == 4, F.col("paired_start")).otherwise(F.col("access_start"))
    return rows.where(keep).select(*key, "rank", "start", "end", "hit", at.alias("access_start"))


def scan(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, n_assign, n_access, n_hex, n_weak and found: the spans in order, as structs with the matched text.
    Only documents with a span have a row."""
    rank_is = lambda r: F.count_if(F.col("rank") == r)
    one = F.struct("start", "rank", "end", "hit", "access_start")
    return link(parts(df), scope).groupBy("doc_id", "text_key").agg(rank_is(0).alias("n_assign"), rank_is(1).alias("n_access"), rank_is(2).alias("n_hex"), F.count_if(F.col("rank") > 2).alias("n_weak"), F.array_sort(F.collect_list(one)).alias("found"))


def span_list(found: Column, base_only: bool = False) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    chosen = F.filter(found, lambda x: x["rank"] < 3) if base_only else found
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of df: doc_id, the counts, base_sha256 and spans. Texts are not moved."""
    hits = Stages(df.sparkSession, "secrets").put(scan(df, scope), "found")
    every = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    h = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_assign", "n_access", "n_hex", "n_weak", span_list(F.col("found"), True).alias("base"), span_list(F.col("found")).alias("spans"))
    out = every.join(h, every["doc_id"].eqNullSafe(h["hit_id"]) & (every["text_key"] == h["hit_key"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *map(zero, ("n_assign", "n_access", "n_hex", "n_weak")), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(df: DataFrame, scope: int = SCOPE, mark: str = "<{}>") -> DataFrame:
    """df with every span of its texts replaced by the mark of its kind. Overlapping spans are replaced as one, by the mark of
    the first. All columns of df are kept; null texts stay null."""
    hit = free_name(df, "hit")
    hits = Stages(df.sparkSession, "secrets").put(scan(df, scope), "found").select(F.struct("doc_id", "text_key", "found").alias(hit))
    found = F.col(hit)["found"]
    out = df.join(hits, F.col("doc_id").eqNullSafe(F.col(hit)["doc_id"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hit)["text_key"]), "left")
    marks = F.array(*(F.lit(mark.format(k)) for k in KINDS))
    none = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.element_at(marks, x["rank"] + 1))
        return F.struct(F.when(x["start"] >= acc["at"], more).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], x["end"]).alias("at"))

    cleaned = F.aggregate(found, none, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    text = F.when(found.isNotNull() & F.col("text").isNotNull(), cleaned).otherwise(F.col("text")).alias("text")
    return out.select(*[text if c == "text" else F.col(c) for c in df.columns])
