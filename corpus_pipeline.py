"""The corpus pipeline: quality, near-duplicates, secrets, mixing, packing, each stage over all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined cases: nulls in any column, empty texts, repeated rows and empty tables pass through each stage as its operator
defines; columns beyond those of documents are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linecrf, minhash, mixing, packing, secrets
from tessera.llm.common import SPACE, Stages, free_name, table


#: Of the near-duplicates stage: the least similarity, as a fraction, and half keys in a collection (over 0.999 of such pairs meet).
SIMILARITY, HALVES = (80, 100), 12


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    score = free_name(docs, "score")
    scored = linecrf.with_score(docs, table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) >= linecrf.KEEP).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; those without an id come last. Documents are linked where they share
    80 % or more of their five-word shingles. Rows are told apart by id and text, so
    different texts under one id are documents of their own; rows without an id and without words are no copies of each other."""
    stages, node, check = Stages(spark, "dedup"), free_name(docs, "node"), free_name(docs, "check")
    lone = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(f"[^{SPACE}]")
    # a row's node is a hash of its id and text; where hashes clash both rows stay, and the second hash tells equal rows apart from them
    keyed = docs.where(~lone).withColumns({node: F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1), check: F.xxhash64(F.lit(1), "text")})
    found = minhash.near_duplicates(keyed.select(F.col(node).alias("doc_id"), "text", F.col("doc_id").alias("own")), SIMILARITY, HALVES, tag="own")
    order = F.struct(F.col("tag").isNull(), F.col("tag"), F.col("doc_id"))
    first = found.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("node"))
    # one join with a row for each that stays, sorted on both sides at every size: so texts move once
    ids = stages.put(first, "kept").select(F.struct("node").alias(kept := free_name(keyed, "kept"))).hint("merge")
    left = keyed.join(ids, F.col(node) == F.col(kept)["node"])
    return left.dropDuplicates([node, "doc_id", check]).select(*docs.columns).unionByName(docs.where(lone))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, with the parts linked to them, are replaced by marks; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's budget is taken in part, its first words."""
    mixed, name = mixing.with_mix(docs)
    size, taken, words = F.col(name)["size"], F.col(name)["taken"], free_name(mixed, "words")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    part = F.when(size > 0, taken % size).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn(words, F.explode(copies))
    first = F.array_join(F.slice(F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""), F.lit(1), F.col(words)), " ")
    rows = rows.withColumn("text", F.when(F.col(words) < 0, F.col("text")).otherwise(first))
    rows = rows.withColumn("n_chars", F.when(F.col(words) < 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, before = Stages(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, sf_dir), name)
        if before:
            stages.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the similarity classes and the packing can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
