"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash.  Tokens are summed by source and hash
bucket; in each source the budget falls inside one bucket at most, and only
the rows of that bucket are counted again over ten finer bits, until a single
hash value is left.  The result is one threshold for each source: documents
below it are taken once more than the rest.  What moves is each row's id,
source, size and hash once, and ``sources x 1024`` partial sums a level.

DataFrame functions only.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; a null id hashes as the empty string; rows with one id share
one hash and are taken together; an empty table gives an empty result; an
all-empty source has target 0.  Only named columns are read, so further ones,
whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 10


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_: Column, seed: str = "") -> Column:
    """60 bits of the MD5 of the id's text, the same in every run and engine."""
    key = F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) -> + weight, target: shares of all sizes by weight.

    A target stops at ``cap`` times its source; the excess goes to the others
    by weight until none is above.  That fixed point is a water level: with
    sources in order of ``cap * size / weight`` it is the largest
    ``(total - caps before) / (weights from here)`` that its own source can
    hold.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    rows = (
        sizes.withColumn("weight", F.element_at(wheel, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("limit", (F.col("source_size") * cap).cast("long"))
        .withColumn("fill", F.col("limit").cast("double") / F.col("weight"))
    )
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
    )
    water = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    target = F.least(F.col("limit").cast("double"), F.coalesce(water, F.lit(0.0)) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def mixing_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(sized rows, plan) of a mix.

    ``sized``: doc_id, source, size, hash, one row for each input row, kept in
    the shared folder so that the texts are read once.  ``plan``: one row for
    each source with its size, target, whole copies ``base`` and ``threshold``.
    """
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), seed).alias("hash"))
    # As many files as the small rows need, instead of one for each task that read the texts.
    sized = materialize(sized.hint("rebalance"), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    state = (
        source_targets(sizes, weights, cap)
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("extra", F.col("target") - (F.col("base") * F.col("source_size")).cast("double"))
        .withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "threshold": F.lit(None).cast("long")})
    )
    state = materialize(state, "mix-state")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        state = materialize(_refine(sized, state, shift), "mix-state")
        if state.filter("threshold is null").isEmpty():
            break
    return sized, state.select("source", "source_size", "weight", "target", "base", "threshold")


def _refine(sized: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """One level: histogram of the open buckets, then a new bucket or a threshold."""
    still = state.filter("threshold is null").select(F.col("source").alias("of"), "prefix", "below", "extra")
    hit = sized.join(still, sized["source"].eqNullSafe(still["of"]) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
    hist = hit.groupBy("of", F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").cast("long").alias("words"),
        F.min("hash").alias("least"),
        F.max("hash").alias("most"),
        F.first("below").alias("below"),
        F.first("extra").alias("extra"),
    )
    inside = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("from", F.col("below") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    upto = F.col("from") + F.col("words")
    crossing = (F.col("from") < F.col("extra")) & (upto > F.col("extra"))
    single = F.col("least") == F.col("most")
    half = 2 * F.col("from") + F.col("words") <= 2 * F.col("extra")
    taken = (upto <= F.col("extra")) | (crossing & single & half)
    found = hist.groupBy("of").agg(
        F.max(F.when(taken, F.col("most") + 1)).alias("last"),
        F.max(F.when(crossing & ~single, F.col("bucket"))).alias("open"),
        F.max(F.when(crossing & ~single, F.col("from"))).alias("open_from"),
    )
    floor = F.shiftleft(F.col("prefix"), shift + LEVEL_BITS)
    closed = F.coalesce(F.col("threshold"), F.when(F.col("open").isNull(), F.coalesce(F.col("last"), floor)))
    return state.join(found, state["source"].eqNullSafe(found["of"]), "left").select(
        "source", "source_size", "weight", "target", "base", "extra",
        F.coalesce("open", "prefix").alias("prefix"),
        F.coalesce("open_from", "below").cast("long").alias("below"),
        closed.alias("threshold"),
    )


def copies(base: Column, hash_: Column, threshold: Column) -> Column:
    """How often the mix holds a document."""
    return base + F.when(hash_ < threshold, F.lit(1)).otherwise(F.lit(0))


def mix(df: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies of each row."""
    sized, plan = mixing_plan(df, **options)
    plan = plan.withColumnRenamed("source", "of")
    times = copies(F.col("base"), F.col("hash"), F.col("threshold"))
    return sized.join(plan, sized["source"].eqNullSafe(plan["of"])).select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), "source", times.alias("copies"))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "", **options) -> DataFrame:
    """``df`` with each row as often as the mix holds it, all columns kept."""
    _, plan = mixing_plan(df, id_col, text_col, source_col, seed=seed, **options)
    names = df.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    rows = df.toDF(*own.values())
    source, id_ = F.col(own[source_col]), F.col(own[id_col])
    joined = rows.join(plan.toDF(*[f"plan_{c}" for c in plan.columns]), source.eqNullSafe(F.col("plan_source")))
    times = copies(F.col("plan_base"), row_hash(id_, seed), F.col("plan_threshold"))
    repeated = joined.withColumn("plan_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return repeated.select(*[F.col(own[c]).alias(c) for c in names])
