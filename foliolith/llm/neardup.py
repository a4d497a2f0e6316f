"""Near-duplicates: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolith.llm.hashing import shingles
from foliolith.llm.util import MOST_PARTS, Stage, components, let, small_batches

#: Retained values of a sketch. A link has its 64 smallest union values in common with
#: chance 0.8 each, so fewer than half of them (see MIN_SHARE) is six sigma away.
SKETCH = 64
#: Inverted lists stand under pairs of neighbouring values among the first LISTED of a sketch;
#: that no two neighbours are shared by a link has a chance of 5e-10. A set of at most SMALL
#: values is also listed under each of them, a set of at least OVERLAP under pairs, so the
#: sets of a link have a kind of list in common.
LISTED, SMALL, OVERLAP = 32, 30, 24
#: Lists longer than this are hot: their members are compared in blocks, not by pairs of rows.
HOT = 64
#: Lists that a member must share with its leader to be compared in the first round.
AT_LEAST = 2
#: A document stays open for further comparison if OPEN_SHARE of its first OPEN sketch values
#: also stand in sketches of other components. Each value of a link's set is shared with
#: chance 0.8 at least, so that fewer are (7 of 24) has a chance of 1e-7.
#: They are looked for among the first REACH values of the others: the first dozen of a link's
#: shared values lie there with a chance of more than 1 - 1e-7.
OPEN, OPEN_SHARE, REACH = 24, 0.33, 28
#: Sets with more copies than a COPIESth of all documents (and than COPIES) are at most COPIES:
#: as many rows are broadcast, and no task gathers a larger group.
COPIES = 1000
#: Pairs whose sketches estimate less than this are not verified.
MIN_SHARE = 0.5
#: Members that one task compares with a leader's set.
BUCKET = 64
#: Members of a block of a hot family, all of whose sets a task compares two blocks at once.
FAMILY_BLOCK = 256


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): size, digest and smallest hashes of each shingle set."""

    def run(batches):
        for b in batches:
            n, d1, d2, sk = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, words)
                d = xxhash.xxh128_digest(s.tobytes())
                n.append(len(s))
                d1.append(int.from_bytes(d[:8], "big", signed=True))
                d2.append(int.from_bytes(d[8:], "big", signed=True))
                sk.append(_signed(s[:SKETCH]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sk])]).astype(np.int32)
            values = pa.array(np.concatenate(sk) if sk else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["doc_id", "n", "d1", "d2", "sketch"],
            )

    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>")


def _unsigned_order(c):
    """Sketches are sorted as unsigned numbers; flip the sign bit to compare as signed ones."""
    return F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63)).cast("bigint")))


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose union sketch doesn't rule it out."""
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    j = pairs.join(side("a"), "a").filter("n_a > 0").join(side("b"), "b")
    j = j.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, SKETCH)
    share = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union)) / F.size(union)
    return j.filter(share >= MIN_SHARE).select("a", "b")


def _verified(spark: SparkSession, stage: Stage, docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.

    Texts travel, not sets: they compress. A leader a is sent once for each BUCKET of its
    members and sorted before them, so a task holds one leader's set and one member's,
    and a leader with very many members is split over many tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BUCKET).alias("k"))
    p = stage.cut(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).alias("bucket")))
    need = p.select(F.col("a").alias("doc_id")).unionByName(p.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(need, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    leaders = p.select("a", "bucket").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "bucket", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    members = p.join(texts, F.col("b") == F.col("doc_id")).select("a", "bucket", F.lit(1).alias("role"), "b", "text")

    def run(batches):
        now, own = None, None
        for batch in batches:
            at, out = [batch.column(i).to_pylist() for i in range(5)], ([], [])
            for a, bucket, role, b, text in zip(*at, strict=True):
                s = shingles(text, words)
                if role == 0:
                    now, own = (a, bucket), s
                elif now == (a, bucket):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    rows = leaders.unionByName(members).repartition("a", "bucket").sortWithinPartitions("a", "bucket", "role")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _entries(stage: Stage, reps: DataFrame) -> DataFrame:
    """(value, id, lead, hot): the lists with at least two members that a document stands in, and
    each list's smallest member. Lists are counted before rows are kept, and most documents
    have few shared keys, so what follows is small."""
    none = F.array().cast("array<bigint>")
    paired, single = (F.col("n") >= OVERLAP) & (F.size("sketch") > 1), F.col("n") <= SMALL
    # Bound once: inside the function the slice would be cut anew for each pair.
    pairs = let(F.slice("sketch", 1, LISTED), lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1))))
    keys = F.concat(F.when(paired, pairs).otherwise(none), F.when(single, F.col("sketch")).otherwise(none))
    flat = reps.select(F.explode(keys).alias("value"), "id")
    stat = flat.groupBy("value").agg(F.count("*").alias("size"), F.min("id").alias("lead")).filter("size > 1")
    return flat.join(stat, "value").select("value", "id", "lead", (F.col("size") > HOT).alias("hot"))


def _open(stage: Stage, hot: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of ``hot`` whose document may be linked with one of another component: enough
    of its first sketch values stand among the first of other components', too (see OPEN).
    A batch of members exchanges each of its values once, whichever components it stands in, so
    there are REACH rows for a member at most and one where members of a batch are alike."""
    members = hot.select("id", "comp").distinct().join(reps.select("id", F.slice("sketch", 1, REACH).alias("sketch")), "id")
    lists = ("id", "comp", "size", "v")

    def pack(batches):
        """A batch of members as one row: their ids, components, sizes of sketches and values."""
        for batch in batches:
            if batch.num_rows:
                sketch, column = batch.column("sketch"), lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023
                cells = [column("id"), column("comp"), np.diff(sketch.offsets.to_numpy()), sketch.flatten().to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([pa.array([cells[0].min()]), *[pa.array([x], pa.list_(pa.int64())) for x in cells]], names=["part", *lists])

    def cells_of(batch, *names):
        for i, part in enumerate(batch.column("part").to_pylist()):
            yield part, *[batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in names]

    def values(batches):
        """(part, v, low, high): each value of a part once, with its least and greatest component."""
        for batch in batches:
            for part, comp, size, v in cells_of(batch, "comp", "size", "v"):
                order = np.argsort(v, kind="stable")
                v, owner = v[order], np.repeat(comp, size)[order]
                at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                cells = [np.full(len(at), part), v[at], np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["part", "v", "low", "high"])

    def still_open(batches):
        for batch in batches:
            for _, ids, size, v, found in cells_of(batch, "id", "size", "v", "found"):
                at = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
                row = np.repeat(np.arange(len(ids)), size)[np.isin(v, found) & (at < OPEN)]
                shared = np.bincount(row, minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[(shared > 0) & (shared >= OPEN_SHARE * np.minimum(size, OPEN))])], names=["id"])

    schema = "part bigint, " + ", ".join(f"{c} array<bigint>" for c in lists)
    parts = stage.cut(members.sortWithinPartitions("comp").mapInArrow(pack, schema))
    # Written, as it is read twice.
    every = stage.cut(parts.mapInArrow(values, "part bigint, v bigint, low bigint, high bigint"))
    both = every.groupBy("v").agg((F.min("low") < F.max("high")).alias("open")).filter("open").select("v")
    found = every.select("part", "v").join(both, "v", "left_semi").groupBy("part").agg(F.collect_set("v").alias("found"))
    return hot.join(parts.join(found, "part").mapInArrow(still_open, "id bigint"), "id", "left_semi")


def _prefixes(stage: Stage, sets: DataFrame, percent: int) -> DataFrame:
    """(value, id, comp, n): the shingles of a document under which it can meet all it is linked with.

    A link has ceil(percent * n / 100) values in common at least, for each of its sizes n, so it
    has one of any n + 1 less that of each set in common, if both are taken from the same end of
    one order of all values. Rare ones come first: values of one document are never written, and
    a document of which so much is its own has no list, whatever passages it shares.
    """
    flat = sets.select("id", "comp", "n", F.explode("shingles").alias("value"))
    often = stage.cut(flat.groupBy("value").agg(F.count("*").alias("size")).filter("size > 1"))
    many = F.greatest(F.lit(COPIES), F.lit(often.agg(F.sum("size")).first()[0] or 0) / COPIES)
    # At most COPIES rows, as in link.
    hot, rest = F.broadcast(often.filter(F.col("size") > many)), often.filter(F.col("size") <= many)
    shared = flat.join(hot, "value").unionByName(flat.join(hot, "value", "left_anti").join(rest, "value"))
    of = shared.groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("size", "value"))).alias("shared"))
    first = F.size("shared") + 1 - F.ceil(percent * F.col("n") / 100).cast("int")
    return of.filter(first > 0).select("id", "comp", "n", F.explode(F.slice("shared", 1, first)["value"]).alias("value"))


def _families(stage: Stage, docs: DataFrame, hot: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components among the members of hot lists.

    They are listed anew, under the rarest shingles of their full sets (see _prefixes). Short
    lists give pairs. Members of hot ones that overlap are one family, dealt by size into blocks;
    each task takes two blocks, holds their sets and gives the links between different
    components. Within a family every two members whose sizes allow a link meet once, inside
    tasks of bounded size; no pair is sent or written but links.
    """
    spark = stage.spark
    schema = "a bigint, b bigint"
    hot = stage.cut(_open(stage, hot, reps))
    if hot.isEmpty():
        return spark.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(hot.select("id", "comp").distinct(), "id").dropDuplicates(["id"]).select("id", "comp", "text")

    def full(batches):
        for batch in batches:
            sets = [shingles(text, words) for text in batch.column("text").to_pylist()]
            size = [len(x) for x in sets]
            values = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
            cells = [batch.column("id"), batch.column("comp"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]).astype(np.int32)), values)]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "comp", "n", "shingles"])

    sets = stage.cut(texts.mapInArrow(full, "id bigint, comp bigint, n bigint, shingles array<bigint>"))
    lists = stage.cut(_prefixes(stage, sets, percent))
    live = lists.groupBy("value").agg(F.count("*").alias("size"), F.min("id").alias("v"), (F.min("comp") < F.max("comp")).alias("open")).filter("open")
    lists = stage.cut(lists.join(live.drop("open"), "value"))
    cold, rest = lists.filter(F.col("size") <= HOT), lists.filter(F.col("size") > HOT)
    other = cold.select("value", F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"))
    pairs = cold.withColumnRenamed("id", "a").join(other, "value").filter("comp < comp_b").filter(100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
    found = _check(spark, stage, docs, pairs.select("a", "b").distinct(), reps, words, percent)
    if rest.isEmpty():
        return found
    return found.unionByName(stage.cut(_blocks(stage, sets, rest, percent)))


def _blocks(stage: Stage, sets: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members (id, v) of hot lists, v being each list's name,
    an id; families are compared in blocks. Sizes of a link differ by one class at most."""
    fam = components(stage, hot.select(F.col("id").alias("a"), F.col("v").alias("b")))
    wide = np.log(max(1.1, 100 / percent) * 1.000001)
    members = sets.select("id", "n").join(fam.select("id", F.col("comp").alias("family")), "id").select("id", "family", F.floor(F.log("n") / F.lit(float(wide))).cast("int").alias("class"))
    sizes = stage.cut(members.groupBy("family", "class").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks")))
    # A block is known by class and number; a block meets those of its class and the next ones.
    name = lambda c, i: F.shiftleft(F.col(c).cast("bigint"), 32) + i
    own = members.join(sizes, ["family", "class"]).withColumn("own", name("class", F.pmod(F.xxhash64("id"), F.col("blocks")))).drop("blocks")
    own = own.withColumn("at", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    met = own.join(sizes.withColumnRenamed("class", "at"), ["family", "at"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("j", name("at", F.col("j"))).select("id", "family", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own")
    tasks = sizes.agg(F.sum(F.col("blocks").cast("bigint") * F.col("blocks"))).first()[0] or 0
    tasks = int(min(MOST_PARTS, max(tasks, 2 * stage.spark.sparkContext.defaultParallelism)))

    def links(ids, comps, owns, sets, i, j):
        every, back = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        often = np.bincount(back, minlength=len(every)) > 1
        keep = often[back]
        row, col = row[keep], (np.cumsum(often) - 1)[back[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(often.sum()), 4096):
            m = np.zeros((len(sets), 4096), np.float32)
            part = slice(*np.searchsorted(col, [at, at + 4096]))
            m[row[part], col[part] - at] = 1
            both += m @ m.T
        near = (100 * both >= percent * (size[:, None] + size[None] - both)) & (comps[:, None] < comps[None])
        if i != j:
            near &= owns[:, None] != owns[None]
        x, y = np.nonzero(near)
        return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

    def run(batches):
        key, held = None, []

        def close():
            ids, comps, owns, sets = zip(*held, strict=True)
            return links(np.array(ids), np.array(comps), np.array(owns), list(sets), key[1], key[2])

        for batch in batches:
            of = [x.values.to_numpy() for x in batch.column("shingles")]
            for family, i, j, own, doc, comp, values in zip(*[batch.column(c).to_pylist() for c in ("family", "i", "j", "own", "id", "comp")], of, strict=True):
                if (family, i, j) != key:
                    if len(held) > 1:
                        yield close()
                    key, held = (family, i, j), []
                held.append((doc, comp, own, values))
        if len(held) > 1:
            yield close()

    rows = met.join(sets, "id").select("family", "i", "j", "own", "id", "comp", "shingles")
    return rows.repartition(tasks, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a bigint, b bigint")


def link(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Two documents are linked if their sets of word shingles (lower-cased A-Z, ``words``
    words; fewer are one shingle) have a Jaccard similarity of percent / 100 or more;
    component_id is the smallest doc_id reachable. Texts without words and null texts have
    an empty set and are linked with nothing. Rows with equal sets are one class, so copies
    are joined without pairs. Rows that share a doc_id count as one document, compared by one of its texts; rows with a
    null doc_id are linked with nothing and have a null component_id.

    In a list, every member is first compared with one leader, which takes one pair a row;
    components of what was confirmed shrink the lists to those that are still open. Then the
    pairs of a list in two different components are compared, and members of hot lists, which
    may have nothing but hot passages in common, in blocks. No list or pair is dropped for
    its size.
    """
    small_batches(spark)
    stage = Stage(spark, "neardup")
    sk = stage.cut(sketches(docs, words))
    classes = sk.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = classes.groupBy("id").agg(F.min_by("n", "d1").alias("n"), F.min_by("sketch", "d1").alias("sketch"))
    reps = stage.cut(reps.withColumn("sketch", _unsigned_order("sketch")))
    # Sketches make up most of what was written; from here on only those of reps are read.
    rows = stage.cut(sk.select("doc_id", "n", "d1", "d2"))
    stage.drop(sk)
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    entries = stage.cut(_entries(stage, reps))
    stars = entries.filter("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("lists"))
    edges = _check(spark, stage, docs, stars.filter(F.col("lists") >= AT_LEAST).select("a", "b"), reps, words, percent)
    comps = stage.cut(components(stage, edges))
    e = entries.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    live = e.groupBy("value").agg((F.min("comp") < F.max("comp")).alias("open")).filter("open").select("value")
    e = stage.cut(e.join(live, "value", "left_semi"))
    stage.drop(entries)
    cold = e.filter("not hot")
    other = cold.select("value", F.col("id").alias("b"), F.col("comp").alias("comp_b"))
    pairs = cold.select("value", F.col("id").alias("a"), "comp").join(other, "value").filter("comp < comp_b").select("a", "b").distinct()
    more = _check(spark, stage, docs, pairs, reps, words, percent)
    edges = edges.unionByName(more).unionByName(_families(stage, docs, e.filter("hot"), reps, words, percent))
    comps = stage.cut(components(stage, edges))
    found = stage.cut(classes.join(comps, "id", "left").select("d1", "d2", "copies", F.coalesce("comp", "id").alias("comp")))
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("comp"))
    rows = rows.filter("n > 0 and doc_id is not null")
    many = F.greatest(F.lit(COPIES), F.lit(rows.count()) / COPIES)
    # At most COPIES rows (see there), and what is left has no large group.
    hot = F.broadcast(found.filter(F.col("copies") > many).select("d1", "d2", "comp"))
    rest = found.filter(F.col("copies") <= many).select("d1", "d2", "comp")
    out = rows.join(hot, ["d1", "d2"]).unionByName(rows.join(hot, ["d1", "d2"], "left_anti").join(rest, ["d1", "d2"]))
    out = out.select("doc_id", "n", "comp").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def _check(spark, stage, docs, pairs, reps, words, percent) -> DataFrame:
    """The links among the pairs, written: shuffled texts of one call are gone before the next."""
    near = stage.cut(_estimated(pairs, reps, percent))
    return stage.cut(_verified(spark, stage, docs, near, words, percent))


def dedup(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (that with the smallest id), with the columns of ``docs``.

    Repeated rows of a doc_id leave one row; rows with a null doc_id all stay.
    """
    info = link(spark, docs, words, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.xxhash64("text").alias("__h"), F.struct(*docs.columns).alias("__row"))
    kept = rows.join(info, "__id", "left_semi")
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy("__h"))).filter("__n = 1")
    return kept.select("__row.*").unionByName(docs.filter("doc_id is null"))
