"""I-Match fingerprints over randomised lexicon subsets; DataFrame functions only.

Terms are the words of the text in lower case. A term's hash gives its slot, one of 2 ** 24; the lexicon is the set of
slots whose inverse document frequency, counted over all documents, lies in the chosen band. It is a bitmap of 2 MB at any
size of the corpus. A document's terms in the lexicon are made distinct and sorted by slot, and each lexicon subset, a range
of slots and so a random share of the terms, is hashed: one hash per subset, none where it holds no term. The subsets come
in levels of 1/16, 1/128, 1/1024 and 1/8192 of all terms: short texts meet in the wide ones and long texts, of which some
term nearly always changes, in the narrow ones. The wide ones cover all slots, so every term of the lexicon is in one of
them. A text without lexicon terms gets the hash of its words as they stand.

The likeness of two fingerprints is the share of equal hashes among the subsets that either text has terms in, at the
level where it is largest and rests on ``least`` subsets; with fewer anywhere, over all levels together.

Moving data: one pass counts document frequencies (hashes only, pre-aggregated); one shuffle of the texts brings each
document next to its successor. Ranges of ids, cut so that they hold like numbers of documents, are the shuffle's keys, so that the
windows run in it without another one.

Defined cases: null text: as empty; empty text: the fingerprint of no words; one document is its own successor; a null
doc_id comes after all others; rows with one id stand in the order of their texts' hashes; of more than ``EQUAL`` rows with one
id and text the last is worked out among its neighbours, and the others, which are each their own successor, once per
``PER_ENTRY`` of them, wherever a task is free; equal texts have equal fingerprints; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Stages

SLOT_BITS = 24
MIN_IDF, MAX_IDF, LEAST_DOCS = 3.0, 12.0, 2
#: (bits of a range's width, first start, number) of each level's ranges of slots, which follow upon each other.
LEVELS = ((20, 0, 16), (17, 1 << 22, 12), (14, 2 << 22, 12), (11, 3 << 22, 12))
LEAST = 3
DOCS_PER_RANGE, LEAST_RANGES, MOST_RANGES, PER_BOUND = 500, 64, 100_000, 20
EQUAL, PER_ENTRY = 16, 10_000


def slots(text: Column) -> Column:
    """The distinct slots of a text's words."""
    words = F.array_remove(F.split(F.lower(text), f"[{SPACE}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - SLOT_BITS).cast("int")))


def lexicon(docs: DataFrame, n_docs: int, min_idf: float, max_idf: float) -> DataFrame:
    """One row, one column ``words``: the bitmap of the slots in the band, 64 to a word."""
    most, least = n_docs * 2.718281828459045**-min_idf, max(LEAST_DOCS, n_docs * 2.718281828459045**-max_idf)
    df = docs.select(F.explode(slots(F.col("text"))).alias("slot")).groupBy("slot").count()
    band = df.where((F.col("count") <= max(most, LEAST_DOCS)) & (F.col("count") >= least))
    bits = band.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    every = docs.sparkSession.range((1 << SLOT_BITS) // 64).select(F.col("id").cast("int").alias("word"))
    full = every.join(bits, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return full.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("words"))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def hashes(terms: Column) -> list[Column]:
    """For each level the array of its subsets' hashes, null where a subset is empty. terms: sorted slots in the lexicon."""

    def parts(own: Column, bits: int, first: int | Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.filter(own, lambda s: F.shiftright(s - first, bits) == i))

    def level(bits: int, first: int, n: int) -> Column:
        if n << bits == 1 << SLOT_BITS:  # all slots: in two steps, by quarters
            quarter = lambda q: let(F.filter(terms, lambda s: F.shiftright(s, SLOT_BITS - 2) == q), lambda own: parts(own, bits, F.shiftleft(q, SLOT_BITS - 2), n // 4))
            found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), quarter))
        else:
            found = let(F.filter(terms, lambda s: (s >= first) & (s < first + (n << bits))), lambda own: parts(own, bits, first, n))
        return F.transform(found, lambda x: F.when(F.size(x) > 0, F.xxhash64(x)))

    return [level(*x) for x in LEVELS]


def written(levels: Column, plain: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits of each subset's hash, or a minus; or the words' hash."""
    one = lambda h: F.coalesce(F.right(F.lpad(F.hex(h), 16, "0"), F.lit(8)), F.lit("-"))
    text = F.array_join(F.transform(F.flatten(levels), one), ".")
    return F.lower(F.when(F.exists(F.flatten(levels), lambda h: h.isNotNull()), text).otherwise(F.concat(F.lit("w"), F.hex(plain))))


def likeness(a: Column, b: Column, a_text: Column, b_text: Column, least: int = LEAST) -> Column:
    """Of two arrays of levels; the written fingerprints decide where neither text has lexicon terms."""
    same = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: F.coalesce(e, F.lit(False))))
    any_ = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p, q)), lambda e: e.isNotNull()))
    each = F.zip_with(a, b, lambda x, y: F.struct(same(x, y).alias("same"), any_(x, y).alias("of")))
    best = F.array_max(F.transform(F.filter(each, lambda e: e["of"] >= least), lambda e: e["same"] / e["of"]))
    total = F.aggregate(each, F.struct(F.lit(0).alias("same"), F.lit(0).alias("of")), lambda acc, e: F.struct((acc["same"] + e["same"]).alias("same"), (acc["of"] + e["of"]).alias("of")))
    return F.coalesce(best, F.when(total["of"] > 0, total["same"] / total["of"]), (a_text == b_text).cast("double"), F.lit(0.0))


def range_of(key: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are at most the key, by bisection."""
    most = 1 << (MOST_RANGES - 1).bit_length()
    steps = F.array(*(F.lit(most >> k) for k in range(1, most.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def neighbours(docs: DataFrame, stages: Stages) -> tuple[DataFrame, int]:
    """(every document with its range (part), its place there and the text of its successor in descending order of
    ids, the last one's successor being the first; the number of documents). Guests, the first of the next range, stand at the end of each
    range. Ranges hold like numbers of documents, whatever the ids: they are cut by (id, hash of the text), so rows of one id, or
    without an id, are spread as well. Equal rows beyond ``EQUAL`` are two kinds of row: the last, and the others with their number
    (copies) and a part below 0."""
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.withColumn("key", key)
    keys = stages.put(keyed.groupBy("key").count(), "keys")
    n_docs = keys.agg(F.sum("count")).first()[0] or 0
    equal = stages.put(keys.where(F.col("count") > EQUAL), "equal")
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n_docs // DOCS_PER_RANGE))
    every = max(1, n_docs // (ranges * PER_BOUND))
    # what is drawn here decides only where ranges begin, about PER_BOUND keys to a range
    drawn = keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).agg(F.array_sort(F.collect_list("key")).alias("xs"))
    gap = F.greatest(F.lit(1), F.floor(F.size("xs") / ranges).cast("int"))
    bounds = stages.put(drawn.select(F.array_distinct(F.filter("xs", lambda x, i: (i > 0) & (i % gap == 0))).alias("bounds")), "bounds")
    with_part = lambda df: df.withColumn("bounds", bounds.scalar()).withColumn("part", range_of(F.col("key"), F.col("bounds")).cast("long")).drop("bounds")
    heads = with_part(keys).groupBy("part").agg(F.max("key").alias("first"))
    order = Window.orderBy(F.desc("part"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most MOST_RANGES rows, of three numbers each
    heads = stages.put(heads.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("head")).select(F.col("part").alias("to"), "head"), "heads")
    wanted = heads.select(F.col("head").alias("key")).union(equal.select("key")).distinct()
    # one row of each key, the copies of a key being put together before they move
    picked = stages.put(keyed.join(wanted, "key").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")), "picked")
    rows = with_part(keyed.join(equal.select("key"), "key", "left_anti").select("doc_id", "text", "key"))
    many = equal.join(picked, "key")
    last = with_part(many.select("doc_id", "text", "key"))
    entries = many.withColumn("entry", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 2) / PER_ENTRY))))
    copies = F.least(F.lit(PER_ENTRY), F.col("count") - 1 - F.col("entry") * PER_ENTRY).cast("int")
    others = entries.select("doc_id", "text", "key", (-1 - F.pmod(F.xxhash64("key", "entry"), F.lit(1 << 62))).alias("part"), copies.alias("copies"))
    guests = heads.join(picked, F.col("key") == F.col("head")).select("doc_id", "text", "key", F.col("to").alias("part"))
    both = [df.withColumns({"guest": F.lit(df is guests), **({} if df is others else {"copies": F.lit(1)})}) for df in (rows, last, others, guests)]
    both = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3])
    w = Window.partitionBy("part").orderBy("guest", F.desc("key"))
    return both.withColumns({"place": F.row_number().over(w), "next_text": F.when(F.col("part") >= 0, F.lead("text").over(w))}), n_docs


def fingerprints(df: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    stages = Stages(df.sparkSession, "imatch")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, n_docs = neighbours(docs, stages)
    words = stages.put(lexicon(docs, n_docs, min_idf, max_idf), "lexicon")
    stages.drop("keys")
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.when(F.col("guest"), F.lit("")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.coalesce("next_text", "text"), F.lit(1), cut)))
    plain = lambda c: F.xxhash64(F.array_join(F.filter(F.split(F.lower(c), f"[{SPACE}]+"), lambda w: w != ""), " "))
    rows = rows.select("part", "place", "guest", "copies", "doc_id", "text", edited.alias("edited"))
    key = ["part", "place", "guest", "copies", "doc_id", n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), plain(F.col("text")).alias("plain"), plain(F.col("edited")).alias("edited_plain")]
    rows = rows.select(*key, slots(F.col("text")).alias("a"), slots(F.col("edited")).alias("b"))
    # lambdas may hold no subquery, so the bitmap is a column here; as all are named once, Spark makes it one projection with
    # that above, the subquery in the column's place, and no row carries it
    named = [c for c in rows.columns if c not in ("a", "b")]
    rows = rows.withColumn("bitmap", words.scalar()).select(*named, in_lexicon([F.col("a"), F.col("b")], F.col("bitmap")).alias("terms"))
    out = rows.select("*", F.array(*hashes(F.col("terms")[0])).alias("a"), F.array(*hashes(F.col("terms")[1])).alias("b")).drop("terms")
    out = out.withColumns({"fingerprint": written(F.col("a"), F.col("plain")), "edited_fingerprint": written(F.col("b"), F.col("edited_plain"))})
    w = Window.partitionBy("part").orderBy("place")
    own = F.col("part") < 0  # equal rows, each its own successor
    out = out.withColumns({"next_a": F.when(~own, F.lead("a").over(w)), "next_fingerprint": F.when(~own, F.lead("fingerprint").over(w))})
    near = likeness(F.col("a"), F.col("b"), F.col("fingerprint"), F.col("edited_fingerprint"))
    near_next = likeness(F.col("a"), F.coalesce("next_a", "a"), F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint"))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), near_next.alias("near_next")]
    out = out.where(~F.col("guest")).select(*columns, "copies")
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "copy")


def in_lexicon(terms: list[Column], bitmap: Column) -> Column:
    """An array of the terms that are in the lexicon, sorted, for each of the arrays."""
    inside = lambda words, s: F.getbit(F.element_at(words, F.shiftright(s, 6) + 1), s.bitwiseAND(F.lit(63))) == 1
    return let(bitmap, lambda words: F.array(*[F.sort_array(F.filter(x, lambda s: inside(words, s))) for x in terms]))
