"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolith.llm.util import Stage, let

#: Above this mean, a Poisson draw is the sum of independent draws of smaller means,
#: because exp(-mean) underflows.
MAX_MEAN = 300.0
#: exp(-MAX_MEAN) is summed up to this many terms beyond the mean; the rest is below 1e-16.
TAIL = 200
#: Default target: a source's share is in proportion to its document count to this power.
FLATTEN = 0.5
SEED = "mix-1"
#: Sources up to which their rates are broadcast; beyond, documents meet them in a shuffle
#: in which each source is dealt over SALT tasks.
BROADCAST_SOURCES, SALT = 100_000, 64
#: Bytes of rows that one task of the global shuffle takes.
PART = 64_000_000


def uniform(seed: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of a string."""
    return F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until it no longer grows, for a mean of at most MAX_MEAN."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), F.least(last, F.lit(int(MAX_MEAN) + TAIL))),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    return F.when(mean > 0, step).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, rate, parts, cdf): mean repetitions of a document of each source.

    ``weights`` maps sources to relative targets; a source that it lacks gets 0. Without
    it, targets follow FLATTEN. The expected number of rows equals the input's. A null
    source is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(FLATTEN))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        known = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(0.0))
        target = F.coalesce(F.try_element_at(known, F.coalesce("source", F.lit(""))), F.lit(0.0))
    counts = counts.withColumn("target", target)
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("target").alias("all_t"))
    rate = F.when(F.col("all_t") > 0, F.col("target") / F.col("all_t") * F.col("all_n") / F.col("n")).otherwise(0.0)
    # One total row: a bounded broadcast, not a product of two tables that grow.
    return (
        counts.join(F.broadcast(total)).withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))
        .select("source", "rate", "parts", "cdf")
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """Every document, repeated by a Poisson count with its source's rate, in a global shuffle.

    Adds ``copy_no`` (0-based) and ``shuffle_key`` to the columns of ``docs`` (columns of
    those names are replaced) and returns the rows sorted by ``shuffle_key``. The count
    inverts the Poisson distribution at a number that is hashed from seed and doc_id, so a
    rerun gives the same rows; repeated rows of one doc_id get the same count. A null
    doc_id counts as the empty text. An empty input gives an empty result.

    Sources are counted before any shuffle of rows, and their rates (one row a source, a
    checked number) broadcast, so a source with a third of all rows is never gathered; the
    only shuffle of whole documents is the global one. Its keys are hashes: equal ranges of
    them make even tasks, as many as the bytes of the rows ask for, without a sample.
    """
    names = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    d = docs.select(*names)
    spark = d.sparkSession
    r = Stage(spark, "mix").cut(rates(d, weights)).withColumnRenamed("source", "__source")
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda acc, i: acc + let(
            uniform(F.concat(key, F.lit("|"), i.cast("string"))),
            lambda u: F.size(F.filter(F.col("__cdf"), lambda c: c <= u)),
        ),
    )
    r = r.select("__source", F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    same = F.col("source").eqNullSafe(F.col("__source"))
    if r.count() <= BROADCAST_SOURCES:
        out = d.join(F.broadcast(r), same)
    else:
        r = r.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = d.join(r, same & (F.pmod(F.xxhash64("doc_id"), F.lit(SALT)) == F.col("__salt")))
    out = out.withColumn("__n", draw).filter("__n > 0")
    out = out.select(*names, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("copy_no"))
    shuffle = F.md5(F.concat(key, F.lit("|s|"), F.col("copy_no").cast("string")))
    long = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in d.dtypes if t in ("string", "binary")]
    size = d.agg(F.sum(sum(long, F.lit(8 * len(names))).cast("bigint"))).first()[0] or 0
    n = int(max(-(-size // PART), spark.sparkContext.defaultParallelism))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * F.lit(n / 2.0**32)).cast("int")
    return out.withColumn("shuffle_key", shuffle).repartitionById(n, place).sortWithinPartitions("shuffle_key", "doc_id", "copy_no")
