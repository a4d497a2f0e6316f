"""What several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; documents can be long, so a batch stays small.
ARROW_ROWS = 512
ARROW_BYTES = "8m"

#: White space of every word definition, as a character class of both regex dialects.
SPACE = "[\\x20\\x09-\\x0D]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. A folder
    of this machine serves only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='foliolith-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


#: Spark's switch for removing the shuffle files of a query as soon as it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Tables written to the shared folder to cut lineage; ``drop`` frees those no longer read."""

    #: Folders of all stages of this session, for ``sweep``.
    roots: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        Stage.roots.append(self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again. Its shuffle files go at once, as nothing else reads
        them; those of other queries of the session stay as they are."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def bucketed(self, df: DataFrame, n: int, key: str) -> DataFrame:
        """``df`` written in n buckets of ``key``, each task's rows where they are: joins on the
        key then shuffle only their other side. The entry in the catalog goes at once; the
        files stay, as those of ``cut``."""
        self.n += 1
        name = f"{self.root.rsplit('/', 1)[1].replace('-', '_')}_{self.n}"
        path = f"{self.root}/{self.n}"
        df.write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        out._stage_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._stage_path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Removes the stage folders made after the first ``since``; for a caller whose results
    are written and need them no more."""
    for root in Stage.roots[since:]:
        remove(spark, root)
    del Stage.roots[since:]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block_names():
    """Names for the rows that a task writes, by its partition and a running number; for a
    table that is written before use, so that no second run gives them anew."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    return (first + i for i in range(1 << 32))


#: Text bytes that one task of a block operator reads, and most buckets of a table of blocks.
PART, MOST_PARTS = 16_000_000, 50_000


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts: one number."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0


def parts_for(spark: SparkSession, size: int) -> int:
    """Tasks for ``size`` bytes of text; by the data, not by the session's shuffle partitions."""
    return int(min(MOST_PARTS, max(-(-size // PART), 2 * spark.sparkContext.defaultParallelism)))


def grouped(df: DataFrame, n: int, keys: list[str], order: list[str], fn, schema: str, most: int | None = None, by: list | None = None) -> DataFrame:
    """``fn(rows)`` (rows as dicts, in ``order``; it yields record batches) for each group of
    equal keys. Sorted tasks stream their groups, so a task holds one group, or ``most`` rows
    of it where ``fn`` may see a group in pieces. Rows are dealt by their keys, or by ``by``
    where some groups need not meet."""

    def run(batches):
        key, held = None, []
        for b in batches:
            for row in b.to_pylist():
                now = tuple(row[c] for c in keys)
                if held and (now != key or most and len(held) >= most):
                    yield from fn(held)
                    held = []
                key = now
                held.append(row)
        if held:
            yield from fn(held)

    return df.repartition(n, *(by or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def batch_of(schema: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a schema of int, bigint and binary as a batch; columns that a row lacks are null."""
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names = [(n, types[t]) for n, t in (c.split() for c in schema.split(", "))]
    if rows:
        cols = zip(*((*r, *[None] * (len(names) - len(r))) for r in rows), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, names, strict=True)], names=[n for n, _ in names])


def rows_of(batches) -> Iterator[dict]:
    """Rows one at a time: a row may hold a whole block."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def with_answers(blocks: DataFrame, answers: DataFrame, cols: list[str], n: int) -> DataFrame:
    """Each block with ``answers``, an array of what was found for it (null: nothing). Blocks
    are in n buckets, so only answers are shuffled; those of a block are fewer than its bytes."""
    by = answers.repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct(*cols)).alias("answers"))
    return blocks.join(by.hint("shuffle_hash"), "block", "left")


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


#: A key with more than a HUBSth of all rows (and more than HUBS) is a hub; where there is one,
#: the rows of every key are dealt over SPREAD tasks.
HUBS, SPREAD = 1000, 16


def join_spread(left: DataFrame, right: DataFrame, key: str, by: str, total: int, top: int) -> DataFrame:
    """``left`` (``total`` rows, ``top`` at most of a key) joined with ``right``, a row a key."""
    if top <= max(HUBS, total / HUBS):
        return left.join(right, key)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


#: Edges that one task joins to trees before the steps between tasks; with no more in all, it is all.
TREE = 100_000


def _trees(batches):
    """(u, v) of every id in a task's edges, v being the smallest id that it reaches by them;
    ids are let go where they are many, so a long task holds a bounded number."""
    up = {}

    def root(x):
        top = x
        while up[top] != top:
            top = up[top]
        while x != top:
            up[x], x = top, up[x]
        return top

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(up), [root(x) for x in up])], names=["u", "v"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
        if len(up) > 2 * TREE + ARROW_ROWS:
            yield rows()
            up.clear()
    yield rows()


def components(stage: Stage, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) of every id in an edge, comp being the smallest id reachable.

    Tasks first join their own edges to trees, without a shuffle. What several tasks hold goes
    through alternating large-star and small-star steps until every id has one parent, a root;
    each step keeps the components and the number of rounds is logarithmic in the longest chain.
    Every step is a grouped minimum (combined before the shuffle) and an equi-join in which hubs
    aren't gathered. ``edges`` are read twice.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    tasks = -(-edges.count() // TREE)
    e = stage.cut(e.coalesce(max(1, tasks)).mapInArrow(_trees, "u bigint, v bigint"))
    if tasks <= 1:
        return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    trees, e = e, e.filter("u <> v")
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"))
    while True:
        ends = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.lit(None).cast("bigint").alias("v")))
        ends = ends.groupBy("u").agg(F.count("*").alias("n"), F.count("v").alias("up"), (F.min("v") < F.max("v")).alias("two"))
        # An id with two parents, or with one and children, is not settled.
        state = ends.agg(F.max("n"), F.sum("up"), F.max((F.col("up") > 0) & (F.col("two") | (F.col("n") > F.col("up"))))).first()
        top, total = state[0] or 0, state[1] or 0
        if not state[2]:
            break
        sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(sym).select("u", F.least("u", "m").alias("m"))
        large = (
            join_spread(sym, low, "u", "v", 2 * total, top).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        low = least(large)
        small = (
            join_spread(large, low, "u", "v", total, top).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        new = stage.cut(small)
        stage.drop(trees)
        trees = e = new
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots).distinct()
