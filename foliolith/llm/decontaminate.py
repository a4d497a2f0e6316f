"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.llm.util import Stage, small_batches

WINDOW = 10
#: Pattern bytes of one broadcast table; a larger benchmark is searched in several passes.
BLOCK_BYTES = 8_000_000
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalise(text: str | None) -> bytes:
    """Words in lower case (A-Z only), each between single spaces; b' ' if there are none."""
    if not text:
        return b" "
    words = _GAP.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).strip(b" ")
    return b" " + words + b" " if words else b" "


def windows(text: str | None) -> list[bytes]:
    """The patterns of an item: every run of WINDOW words, or all words of a shorter one."""
    s = normalise(text)
    if len(s.strip()) == 0:
        return []
    words = s.split()
    if len(words) <= WINDOW:
        return [b" " + b" ".join(words) + b" "]
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(len(words) - WINDOW + 1)]


class WuManber:
    """Occurrences of many byte strings.

    Patterns are split into classes of like length, so a one-word item doesn't shorten the
    shifts of the others. In a class all are cut to the shortest length m for the tables:
    ``shift`` maps blocks of B bytes to the distance by which the window may move, and a
    block that ends some pattern's cut leads to the bucket of patterns with that cut, which
    are compared directly.
    """

    EDGES = (0, 8, 16, 32, 48)

    def __init__(self, patterns: dict[bytes, list[int]]):
        self.items = patterns
        by_class = defaultdict(list)
        for p in patterns:
            by_class[sum(len(p) >= e for e in self.EDGES)].append(p)
        self.tables = []
        for group in by_class.values():
            m = min(map(len, group))
            b = min(8, max(1, m // 2))
            shift: dict[bytes, int] = {}
            bucket: dict[bytes, list[bytes]] = defaultdict(list)
            for p in group:
                for j in range(b, m + 1):
                    block = p[j - b : j]
                    if shift.get(block, m) > m - j:
                        shift[block] = m - j
                bucket[p[:m]].append(p)
            self.tables.append((m, b, shift, dict(bucket)))

    def find(self, s: bytes) -> Iterator[tuple[int, bytes]]:
        n = len(s)
        for m, b, shift, bucket in self.tables:
            most, end, get = m - b + 1, m, shift.get
            while end <= n:
                step = get(s[end - b : end], most)
                if step:
                    end += step
                    continue
                start = end - m
                for p in bucket.get(s[start:end], ()):
                    if s.startswith(p, start):
                        yield start, p
                end += 1


def _id_kind(benchmark: DataFrame) -> str:
    """The type in which item ids are held: whole numbers or strings."""
    return "bigint" if benchmark.schema["item_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def _blocks(benchmark: DataFrame) -> Iterator[dict[bytes, list]]:
    """Patterns in tables of at most BLOCK_BYTES (one item more at most), read row by row."""
    block: dict[bytes, list[int]] = {}
    size = 0
    for row in benchmark.select(F.col("item_id").cast(_id_kind(benchmark)), F.col("text").cast("string")).toLocalIterator():
        if row[0] is None:
            continue
        for p in windows(row[1]):
            if p not in block:
                block[p] = []
                size += len(p)
            if row[0] not in block[p]:
                block[p].append(row[0])
        if size >= BLOCK_BYTES:
            yield block
            block, size = {}, 0
    if block:
        yield block


def _pass(bc, cols: list[str], kind: str):
    """Adds one block's occurrences to __from/__to (word intervals, merged) and __items."""

    def run(batches):
        search = WuManber(bc.value) if bc is not None else None
        for batch in batches:
            n_words, los, his, items = [], [], [], []
            old = [batch.column(c).to_pylist() for c in ("__from", "__to", "__items")]
            for text, lo, hi, it in zip(batch.column("text").to_pylist(), *old, strict=True):
                s = normalise(text)
                n_words.append(max(0, s.count(b" ") - 1))
                hits = list(search.find(s)) if search else []
                if hits:
                    gaps = np.flatnonzero(np.frombuffer(s, np.uint8) == 32)
                    first = np.searchsorted(gaps, [h[0] for h in hits])
                    spans = list(zip(lo, hi, strict=True))
                    spans += [(int(f), int(f) + p.count(b" ") - 1) for f, (_, p) in zip(first, hits, strict=True)]
                    spans.sort()
                    lo, hi = [], []
                    for a, b in spans:
                        if hi and a <= hi[-1]:
                            hi[-1] = max(hi[-1], b)
                        else:
                            lo.append(a)
                            hi.append(b)
                    found = set(it)
                    for p in {p for _, p in hits}:
                        found.update(search.items[p])
                    it = sorted(found)
                los.append(lo)
                his.append(hi)
                items.append(it)
            ints = pa.list_(pa.int64())
            out = {c: batch.column(c) for c in cols}
            out |= {"__n": pa.array(n_words, pa.int64()), "__from": pa.array(los, ints), "__to": pa.array(his, ints), "__items": pa.array(items, pa.list_(pa.int64() if kind == "bigint" else pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def find_items(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, text, n_words, hit_from, hit_to, items): word intervals of each document that
    lie inside an occurrence of a benchmark window, and the items that occur (ids as whole
    numbers where item_id is one, else as strings).

    ``row`` holds all columns of ``docs``. Each pass streams every whole document past one
    block of patterns; there is no shuffle, so a hot item or copies don't matter. Null and
    word-less texts have no words and no hits; null and word-less items and items with a
    null id have no windows; repeated items count once by their id. An empty benchmark hits
    nothing.
    """
    small_batches(spark)
    empty, kind = F.array().cast("array<bigint>"), _id_kind(benchmark)
    df = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text"), F.lit(0).cast("bigint").alias("__n"), empty.alias("__from"), empty.alias("__to"), F.array().cast(f"array<{kind}>").alias("__items"))
    schema, stage, cols = df.schema, None, ["row", "text"]
    block = None
    for block in _blocks(benchmark):
        if stage:  # one table of patterns a task: what was found is written before the next pass
            df = stage.cut(df)
        stage = stage or Stage(spark, "decontaminate")
        df = df.mapInArrow(_pass(spark.sparkContext.broadcast(block), cols, kind), schema)
    if block is None:
        df = df.mapInArrow(_pass(None, cols, kind), schema)
    return df.select("row", "text", F.col("__n").alias("n_words"), F.col("__from").alias("hit_from"), F.col("__to").alias("hit_to"), F.col("__items").alias("items"))


def n_hit():
    return F.aggregate(F.arrays_zip("hit_from", "hit_to"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["hit_to"] - x["hit_from"])


def remove_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose share of hit words is at most ``most``, with its columns."""
    found = find_items(spark, docs, benchmark)
    return found.filter(n_hit() <= F.lit(most) * F.col("n_words")).select("row.*")


def items_digest(items: list[int]) -> str:
    """The digest of the query, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
