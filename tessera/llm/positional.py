"""Benchmark decontamination by a distributed positional inverted index.

The index keeps a posting (text, position, term) for every word of the documents that some phrase holds too. Phrases are looked up rarest
term first: the list of a phrase's rarest term gives starts, that is positions less the term's offset; the list of its second rarest term,
adjusted by its offset, is intersected with these; what is left meets the lists of the other terms. Matches are exact: every term of a
phrase is compared at its own position. Terms in any order within a span of words are found by proximity().

Only built-in functions and joins. Texts are read once and never shuffled; postings carry 128 bits of the text's hash, so that the
copies of a text are looked up once and each row gets its text's result. What stands for the benchmark (its terms, its windows) is
broadcast where a count of its rows is at most BROADCAST_ROWS, else joined as any table; the results are the same.

Defined cases: a null text has no words, as has one of signs alone; a phrase without words occurs nowhere; rows of equal id stay rows of
their own; benchmark rows of one id are one item, and those without an id are one item that is counted but not listed; empty tables give no
rows, or documents without hits; columns beyond doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

#: Words: digits, letters, and all beyond ASCII. Upper-case letters are lowered after the cut, which moves no boundary.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Rows of the largest table that is broadcast: some 60 MB of a hash table.
BROADCAST_ROWS = 500_000
TEXT = ["k1", "k2"]


def cut(text: Column) -> Column:
    """The words of a text, letters as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def lowered(word: Column) -> Column:
    """A to Z in lower case; other letters stay."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _small(df: DataFrame) -> DataFrame:
    """df, a stage table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """item_id, phrase: each item's sequences of so many words; the whole of an item of fewer, none of one without words."""
    words = items.select("item_id", F.transform(cut(F.col("text")), lowered).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(length)))).alias("phrase"))


class Index:
    """The postings of documents for the terms of phrases.

    phrases (pid, phrase): the distinct ones. terms (tid, term). rows: postings (k1, k2, pos from 1, tid), and for each document row one
    at pos 0 with its doc_id and n_words. counts (tid, n): rows that each list holds."""

    def __init__(self, docs: DataFrame, phrases: DataFrame, stages: Stages):
        """docs: doc_id, text; phrases: phrase, an array of lowered words."""
        self.stages = stages
        self.phrases = stages.put(phrases.select("phrase").where(F.size("phrase") > 0).distinct().select(F.monotonically_increasing_id().alias("pid"), "phrase"), "phrases")
        self.terms = stages.put(self.phrases.select(F.explode("phrase").alias("term")).distinct().select(F.monotonically_increasing_id().alias("tid"), "term"), "terms")
        keyed = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(11), "text").alias("k2"), "doc_id", cut(F.col("text")).alias("w"))
        # the first place, before the words, is the document's own row
        each = keyed.select(*TEXT, "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
        found = each.withColumn("term", lowered(F.col("word"))).join(_small(self.terms), "term", "left").where("pos = 0 or tid is not null")
        first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
        rows = stages.put(found.select(*TEXT, "pos", "tid", first("doc_id"), first("n_words")), "postings")
        self.documents = rows.where("pos = 0").select(*TEXT, "doc_id", F.col("n_words").cast("long").alias("n_words"))
        self.postings = rows.where("pos > 0").select(*TEXT, "pos", "tid")
        self.counts = stages.put(self.postings.groupBy("tid").agg(F.count("*").alias("n")), "counts")

    def ranked(self) -> DataFrame:
        """pid, n_terms, terms: (n, offset, tid) of each phrase whose terms all occur, rarest first."""
        each = self.phrases.select("pid", F.size("phrase").alias("n_terms"), F.posexplode("phrase").alias("offset", "term")).join(self.terms, "term").join(self.counts, "tid")
        lists = each.groupBy("pid", "n_terms").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "tid"))).alias("terms"))
        return lists.where(F.size("terms") == F.col("n_terms"))


def phrase_matches(index: Index) -> DataFrame:
    """k1, k2, pid, start, n_terms: where each phrase occurs in each distinct text, as a stage table."""
    stages, postings = index.stages, index.postings
    ranked = stages.put(index.ranked().select("pid", "n_terms", *(F.get("terms", F.lit(i)).alias(f"t{i + 1}") for i in range(2)), F.slice("terms", 3, 1 << 30).alias("others")), "ranked")
    rarest = _small(ranked.select("pid", "n_terms", "t1"))
    hits = postings.join(rarest, F.col("tid") == F.col("t1.tid")).select(*TEXT, "pid", "n_terms", (F.col("pos") - F.col("t1.offset")).alias("start"))
    hits = stages.put(hits.where("start >= 1").distinct(), "first")
    # the second list: only of terms that are second for some phrase
    own = stages.put(ranked.where("t2 is not null").select(F.col("t2.tid").alias("tid")).distinct(), "seconds")
    lists = postings.join(_small(own), "tid", "left_semi")
    wanted = hits.where("n_terms > 1").join(_small(ranked.select("pid", "t2")), "pid").select(*TEXT, "pid", "n_terms", "start", (F.col("start") + F.col("t2.offset")).alias("pos"), F.col("t2.tid").alias("tid"))
    both = stages.put(wanted.join(lists, [*TEXT, "pos", "tid"]).select(*TEXT, "pid", "n_terms", "start").distinct(), "second")
    # the other lists: only those of texts that still have a start
    texts = stages.put(both.where("n_terms > 2").select(*TEXT).distinct(), "texts")
    left = postings.join(_small(texts), TEXT, "left_semi")
    more = both.where("n_terms > 2").join(_small(ranked.select("pid", "others")), "pid").select(*TEXT, "pid", "n_terms", "start", F.explode("others").alias("x"))
    more = more.select(*TEXT, "pid", "n_terms", "start", (F.col("start") + F.col("x.offset")).alias("pos"), F.col("x.tid").alias("tid"))
    met = more.join(left, [*TEXT, "pos", "tid"]).groupBy(*TEXT, "pid", "n_terms", "start").agg(F.count_distinct("pos").alias("met"))
    whole = met.where(F.col("met") == F.col("n_terms") - 2).drop("met")
    out = [hits.where("n_terms = 1"), both.where("n_terms = 2"), whole]
    cols = [*TEXT, "pid", "start", "n_terms"]
    found = stages.put(out[0].select(*cols).unionByName(out[1].select(*cols)).unionByName(out[2].select(*cols)), "matches")
    stages.drop("first", "second", "seconds", "texts")
    return found


def proximity(index: Index, within: int) -> DataFrame:
    """k1, k2, pid, start: the places from which on all distinct terms of a phrase stand, in any order, within so many words, the first
    of them at start. Texts are narrowed by the phrase's rarest term first."""
    ranked = index.stages.put(index.ranked().select("pid", F.transform("terms", lambda x: x["tid"]).alias("tids")), "near")
    rarest = _small(ranked.select("pid", F.get("tids", F.lit(0)).alias("tid")))
    texts = index.postings.join(rarest, "tid").select(*TEXT, "pid").distinct()
    wanted = texts.join(_small(ranked), "pid").select(*TEXT, "pid", F.size(F.array_distinct("tids")).alias("n"), F.explode(F.array_distinct("tids")).alias("tid"))
    each = wanted.join(index.postings, [*TEXT, "tid"]).select(*TEXT, "pid", "n", "tid", "pos").distinct()
    ahead = Window.partitionBy(*TEXT, "pid").orderBy("pos").rangeBetween(0, within - 1)
    return each.withColumn("seen", F.size(F.collect_set("tid").over(ahead))).where("seen = n").select(*TEXT, "pid", F.col("pos").alias("start"))


def covered(matches: DataFrame) -> DataFrame:
    """k1, k2, n_hit: words of a text inside any match."""
    longest = matches.groupBy(*TEXT, "start").agg((F.col("start") + F.max("n_terms")).alias("end"))
    before = Window.partitionBy(*TEXT).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), "start")))
    return longest.select(*TEXT, new.alias("new")).groupBy(*TEXT).agg(F.sum("new").cast("long").alias("n_hit"))


def report(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text): the words inside any occurrence
    of a window of a benchmark item (item_id, text), and the items that have one."""
    stages = Stages(docs.sparkSession, "positional")
    own = stages.put(windows(benchmark, length), "windows")
    index = Index(docs, own, stages)
    found = phrase_matches(index)
    of_item = stages.put(own.join(index.phrases, "phrase").select("pid", "item_id").distinct(), "items")
    pairs = found.select(*TEXT, "pid").distinct().join(_small(of_item), "pid").select(*TEXT, "item_id").distinct()
    items = pairs.groupBy(*TEXT).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    # a table of its own: the join of two tables is one that Spark splits where a text has very many copies
    hits = stages.put(covered(found).join(items, TEXT), "hits")
    out = index.documents.join(_small(hits), TEXT, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    digest = F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), digest, (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
