"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the key ``u ** (1 / w)``: u in (0, 1) is a hash of its id and the seed, w its quality weight. Within
a source, larger keys come first. A source's target may be several times its size: the whole epochs are taken first,
and the fraction that is left takes the documents with the largest keys until their sizes reach the budget; the document
that crosses it is taken in part, so that each source meets its target to the word.

The prefix sums need no sort of a whole source: the keys are 24-bit numbers, and three rounds over 256 digits each sum
the sizes by digit (pre-aggregated before the shuffle) and keep only the digit that holds the budget's end. The rows that
share all three digits with it, a 16-millionth of the key range, are sorted exactly. So no task holds a source.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1 and so on in turn. All targets together are
the total of all sizes; a target stops at ``max_epochs`` times its source's size and the excess goes to the others by
weight until none is above. This fixed point is found in closed form: sources are sorted by cap over weight, and a prefix
of them is capped. The one table that meets in one task has a row for each source.

Defined cases: null text: size 0; null source: a source of its own, last; a null doc_id gets the same key as other nulls;
repeated rows are documents of their own, and where the budget ends among rows of one id, each is taken in the same
proportion; a size of 0 is taken 0 times its words; an empty table gives no rows; extra columns are kept by ``mix``, whatever
their names, and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stages, free_name

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20_011
#: What the operator adds to a row.
RESULT = ("size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.25 for texts without words to 2.25: more letters per character weigh more."""
    n = F.char_length(text)
    letters = n - F.char_length(F.translate(text, "#$%&*|!<>{}[]=_~^0123456789", ""))
    return F.when(n > 0, 2.25 - 2 * letters / n).otherwise(F.lit(0.25))


def mix_size_and_key(weight: Column, seed: int) -> tuple[Column, Column]:
    """The size, and a number below 2 ** 24; larger ones come first."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))
    key = F.least(F.floor(F.pow(u, F.lit(1.0) / weight) * (1 << 24)), F.lit((1 << 24) - 1)).cast("long")
    return size_of(F.col("text")), key


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target)."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_ratio", F.col("source").asc_nulls_last())
    upto, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w.cast("double")).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    t = t.withColumn("cap_ratio", F.col("cap") / F.col("w")).withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(after)
    t = t.withColumn("level", level)
    # the first source whose cap isn't reached sets the level for all after it
    t = t.withColumn("at", F.row_number().over(by_cap))
    t = t.withColumn("level", F.min(F.when(F.col("cap_ratio") >= F.col("level"), F.struct("at", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def plan(rows: DataFrame, stages: Stages, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row per source: source, source_size, target, epochs, and where its fraction ends: end_key, end_id, end_size, end_left.
    rows: doc_id, source, mix_size, mix_key."""
    null_safe = lambda t: F.col("r.source").eqNullSafe(F.col(f"{t}.source"))
    t = targets(rows.groupBy("source").agg(F.sum("mix_size").alias("source_size")), weights, max_epochs)
    wanted = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("long")
    t = t.withColumn("epochs", epochs).withColumn("left", F.greatest(F.lit(0), wanted - F.col("epochs") * F.col("source_size")))
    t = stages.put(t.withColumn("prefix", F.lit(0).cast("long")), "targets")
    for shift in (16, 8, 0):  # from the highest digit on
        digit = F.shiftright("mix_key", shift)
        inside = rows.alias("r").join(t.alias("t"), null_safe("t")).where(F.shiftright("mix_key", shift + 8) == F.col("prefix"))
        sums = inside.groupBy("r.source", digit.alias("digit")).agg(F.sum("mix_size").alias("n"))
        before = Window.partitionBy("source").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        found = sums.alias("r").join(t.alias("t"), null_safe("t")).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        found = found.select("r.source", F.col("digit").alias("new_prefix"), (F.col("left") - F.col("before")).alias("new_left"))
        t = t.alias("r").join(found.alias("f"), null_safe("f"), "left")
        # no digit holds the end: the fraction is the whole source (rounding), or the source has no words
        t = t.select("r.source", "source_size", "target", "epochs", F.coalesce("new_left", "left").alias("left"), F.coalesce("new_prefix", F.lit(-1)).cast("long").alias("prefix"))
        t = stages.put(t, f"digit{shift}")
    ends = rows.alias("r").join(t.alias("t"), null_safe("t")).where(F.col("mix_key") == F.col("prefix"))
    ends = ends.groupBy("r.source", "doc_id", "left").agg(F.sum("mix_size").alias("n"))
    before = Window.partitionBy("source").orderBy(F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
    ends = ends.select("source", F.col("doc_id").alias("end_id"), F.col("n").alias("end_size"), (F.col("left") - F.col("before")).alias("end_left"))
    t = t.alias("r").join(ends.alias("e"), null_safe("e"), "left")
    return stages.put(t.select("r.source", "source_size", "target", "epochs", F.col("prefix").alias("end_key"), "end_id", "end_size", "end_left"), "plan")


def with_mix(df: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, str]:
    """df with one more column, a struct of size, source_size, target and taken, and that column's name, which df doesn't have."""
    stages, name = Stages(df.sparkSession, "mixing"), free_name(df, "mix")
    size, key = mix_size_and_key(quality_weight(F.col("text")) if weight is None else weight, seed)
    keyed = df.withColumn(name, F.struct(size.alias("size"), key.alias("key")))
    rows = stages.put(keyed.select("doc_id", "source", F.col(name)["size"].alias("mix_size"), F.col(name)["key"].alias("mix_key")), "keys")
    return taken(keyed, name, plan(rows, stages, weights, max_epochs)), name


def mix(df: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """df with size, source_size, target and taken; a column of df that has one of these names is kept with an underscore added.
    df has doc_id, text and source."""
    out, name = with_mix(df, weight, weights, max_epochs, seed)
    held = out.select(*[F.col(c).alias(free_name(out, c + "_") if c.lower() in RESULT else c) for c in df.columns], name)
    return held.select(*[c for c in held.columns if c != name], *[F.col(name)[c].alias(c) for c in RESULT])


def mix_sizes(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: like mix, without carrying the texts."""
    stages = Stages(df.sparkSession, "mixing")
    size, key = mix_size_and_key(quality_weight(F.col("text")), seed)
    rows = stages.put(df.select("doc_id", "source", size.alias("mix_size"), key.alias("mix_key")), "keys")
    keyed = rows.select("doc_id", "source", F.struct(F.col("mix_size").alias("size"), F.col("mix_key").alias("key")).alias("mix"))
    return taken(keyed, "mix", plan(rows, stages, weights, max_epochs)).select("doc_id", "source", "mix.*")


def taken(keyed: DataFrame, name: str, ends: DataFrame) -> DataFrame:
    """Applies a plan, which has a row for each source, to rows with their size and key in the struct ``name``. They go no further than the
    join by source: a broadcast as long as Spark finds the plan small, and a join that it splits where a source is hot beyond that."""
    p = free_name(keyed, "plan")
    out = keyed.join(ends.select(F.struct(*ends.columns).alias(p)), F.col("source").eqNullSafe(F.col(p)["source"]))
    own, e = F.col(name), F.col(p)
    at_end = F.col("doc_id").eqNullSafe(e["end_id"])
    before_end = F.when(F.col("doc_id").isNull(), False).when(e["end_id"].isNull(), True).otherwise(F.col("doc_id") < e["end_id"])
    key, end, n = own["key"], e["end_key"], own["size"]
    part = F.when(end < 0, n).when(key > end, n).when(key < end, 0).when(e["end_left"].isNull(), 0)
    part = part.when(at_end, F.when(e["end_size"] > 0, F.floor(e["end_left"] * n / e["end_size"])).otherwise(0)).when(before_end, n).otherwise(0)
    return out.withColumn(name, F.struct(n.alias("size"), e["source_size"].alias("source_size"), e["target"].alias("target"), (e["epochs"] * n + part).cast("long").alias("taken"))).drop(p)
