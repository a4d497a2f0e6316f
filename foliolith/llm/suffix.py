"""Suffix-array deduplication: sorted suffix runs, front-coded, exchanged and merged by common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.llm.codec import bytes_text, pack, pack_sorted, slices, text_bytes, unpack, unpack_sorted
from foliolith.llm.hashing import _STEP, mix
from foliolith.llm.util import Stage, batch_of, block_names, grouped, parts_for, rows_of, small_batches, text_size, with_answers

#: Length in bytes of the strings whose later copies go.
WIDTH = 100
#: Bytes of the string at an anchor. Of the GRAMs in a window of WIDTH bytes, that with the
#: smallest hash (the first of equals) is the window's anchor, so equal windows have theirs
#: at the same place; only suffixes that start at anchors are sorted.
GRAM = 32
#: Text bytes of one block of documents, of a range of anchor hashes, and of a merge task.
BLOCK = 8_000_000
RANGE = 24_000_000
MERGE = 12_000_000
#: Window starts that one vectorised step handles.
STEP = 1 << 18
#: Occurrences from which a GRAM is hot: its suffixes are dealt over all merge tasks, and a
#: distributed minimum over their windows ends what the tasks begin.
HOT = 4096
#: Merged suffixes that a task resolves at once, and rows that it holds for one block.
CHUNK = 30_000
#: Bytes of the anchor's hash before each suffix: suffixes are ordered by it and then by
#: their bytes, so equal ranges of hashes make equal merge tasks without a sample.
HEAD = 8
_BLOCKS = "block bigint, text binary, lens binary, doc binary, null binary, keys binary, which binary, at binary, spans binary"
_ASKED = "block bigint, r int, keys binary, counts binary"
_FLAGS = "block bigint, r int, flags binary"
#: RUN: a sorted run for merge task r. MARKS: (row, first, last) of repeated windows of a
#: block. FIRSTS: (digest, doc, start, block, row) of windows that come first in a chunk.
_RUNS = "kind int, r int, block bigint, a binary, b binary, c binary, d binary, e binary, f binary"
RUN, MARKS, FIRSTS = 0, 1, 2
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first, last): for each anchor the window starts that it belongs to, as
    one or more stretches first..last; windows lie within one document (``ends``: their ends)."""
    n, width = len(text), WIDTH - GRAM + 1
    out: list[tuple] = []
    valid = np.ones(n, bool)
    begin = 0
    for end in ends.tolist():
        valid[max(begin, end - WIDTH + 1) : end] = False
        begin = end
    for at in range(0, n, STEP):
        seg = text[at : at + STEP + WIDTH - 1]
        if len(seg) < WIDTH:
            break
        g, size = _TABLE[seg], 1
        while size < GRAM:
            g = mix(g[: len(g) - size]) * _STEP + g[size:] if size == 16 else g[: len(g) - size] * _STEP + g[size:] ^ (g[size:] >> np.uint64(17))
            size *= 2
        g = mix(g)
        low = np.uint64((1 << 21) - 1)
        best = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            best = np.minimum(best[: len(best) - have], best[have:])
            have *= 2
        if have < width:
            rest = width - have
            best = np.minimum(best[: len(best) - rest], best[rest:])
        s = np.flatnonzero(valid[at : at + len(best)])
        if not len(s):
            continue
        a = (best[s] & low).astype(np.int64)
        cut = np.flatnonzero((np.diff(s) != 1) | (np.diff(a) != 0)) + 1
        i, j = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(s) - 1]])
        # Anchors have small hashes; mixed again, they spread evenly over ranges.
        out.append((mix(g[a[i]] * _STEP), a[i] + at, s[i] + at, s[j] + at))
    if not out:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents with their anchors; written before use, named by task and place.
    A document is never cut: its text is one value, which a task holds in any case."""

    def run(batches):
        ids, parts, size = [], [], 0
        names = block_names()

        def flush():
            raw = b"".join(parts)
            lens = np.array([len(p) for p in parts], np.int64)
            h, a, lo, hi = anchors(np.frombuffer(raw, np.uint8), np.cumsum(lens))
            keys, which = np.unique(h, return_inverse=True)
            doc = np.array([x if x is not None else np.iinfo(np.int64).min for x in ids], np.int64)
            null = np.array([x is None for x in ids], np.uint8)
            spots = pack(which.astype(np.uint32)), pack(np.diff(a, prepend=0).astype(np.int32)), pack(np.stack([a - lo, hi - lo]).astype(np.uint8).T.reshape(-1))
            return (next(names), text_bytes(raw), pack(lens), pack(doc), pack(null), pack_sorted(keys), *spots)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = (text or "").encode("utf-8", "surrogatepass")
                ids.append(doc_id)
                parts.append(x)
                size += len(x) + 64
                if size >= BLOCK:
                    yield from batch_of(_BLOCKS, [flush()])
                    ids, parts, size = [], [], 0
        if ids:
            yield from batch_of(_BLOCKS, [flush()])

    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, _BLOCKS)


class Block:
    def __init__(self, row: dict):
        self.name, self.text = row["block"], bytes_text(row["text"])
        self.lens, self.doc = unpack(row["lens"], np.int64), unpack(row["doc"], np.int64)
        self.null = unpack(row["null"], np.uint8).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64) if len(self.lens) else np.empty(0, np.int64)
        self.answers = row["answers"] or []

    def hits(self, row: dict) -> tuple[np.ndarray, ...]:
        """(hash, hot, anchor, bytes before it, further windows) of the anchors that occur twice."""
        if not self.answers:
            return (np.empty(0, np.uint64), np.empty(0, bool), *[np.empty(0, np.int64)] * 3)
        flags = np.concatenate([unpack(x["flags"], np.uint8) for x in sorted(self.answers, key=lambda x: x["r"])])
        which, at = unpack(row["which"], np.uint32), np.cumsum(unpack(row["at"], np.int32).astype(np.int64))
        left, span = unpack(row["spans"], np.uint8).reshape(-1, 2).T.astype(np.int64)
        hit = np.flatnonzero(flags[which])
        return unpack_sorted(row["keys"])[which[hit]], flags[which[hit]] > 1, at[hit], left[hit], span[hit]


def _ask(parts: int):
    """A block's anchor hashes and how often it has them, by range."""

    def run(batches):
        for row in rows_of(batches):
            keys = unpack_sorted(row["keys"])
            n = np.bincount(unpack(row["which"], np.uint32), minlength=len(keys)).astype(np.uint32)
            yield from batch_of(_ASKED, [(row["block"], r, pack_sorted(keys[i:j]), pack(n[i:j])) for r, i, j in slices(keys, parts)])

    return run


def _answer(rows: list[dict]):
    """Which of the hashes that blocks asked for occur more than once (1) or are hot (2)."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    uniq, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate([unpack(r["counts"], np.uint32) for r in rows]), minlength=len(uniq))
    flags = (n > 1).astype(np.uint8) + (n > HOT)
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        out.append((r["block"], r["r"], pack(flags[back[at : at + len(k)]].astype(np.uint8))))
        at += len(k)
    yield from batch_of(_FLAGS, out)


def common(a: bytes, b: bytes, i: int = 0) -> int:
    """The length of the common prefix, known to be at least i."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[i:n], "big") ^ int.from_bytes(b[i:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def front_code(items: list[tuple]) -> tuple[bytes, ...]:
    """A sorted run of (suffix, left, doc, position, row): of each suffix only what differs
    from the one before."""
    lcp, last = [], b""
    for s, *_ in items:
        lcp.append(common(last, s))
        last = s
    tails = [s[k:] for (s, *_), k in zip(items, lcp, strict=True)]
    col = lambda k, t: pack(np.array([x[k] for x in items], t))
    sizes = np.array([lcp, [len(t) for t in tails], [len(x[1]) for x in items]], np.uint8)
    return pack(sizes.reshape(-1)), text_bytes(b"".join(tails)), text_bytes(b"".join(x[1] for x in items)), col(2, np.int64), col(3, np.int64), col(4, np.uint32)


def decoded(row: dict) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the one before, suffix, (left, doc, position, block, row)) of a run."""
    lcp, size, left_size = unpack(row["a"], np.uint8).reshape(3, -1).tolist()
    tails, lefts = bytes_text(row["b"]), bytes_text(row["c"])
    doc, pos, at = unpack(row["d"], np.int64).tolist(), unpack(row["e"], np.int64).tolist(), unpack(row["f"], np.uint32).tolist()
    last, i, j = b"", 0, 0
    for k in range(len(lcp)):
        last = last[: lcp[k]] + tails[i : i + size[k]]
        i += size[k]
        yield lcp[k], last, (lefts[j : j + left_size[k]], doc[k], pos[k], row["block"], at[k])
        j += left_size[k]


def merged(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """The runs' items in order, each with its common prefix with the item before.

    A tree of losers in which each loser keeps its common prefix with what beat it. What
    comes up has such a prefix with the item last given, as has every loser on its way: the
    longer one comes first without looking at a byte, and equal ones are compared behind it.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    items: list[tuple | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    lcp = [0] * size

    def beats(i: int, j: int) -> bool:
        """Whether i comes before j; the one that doesn't gets its prefix with the other."""
        x, y = items[i], items[j]
        if x is None or y is None:
            return y is None
        if lcp[i] != lcp[j]:
            return lcp[i] > lcp[j]
        k = common(x[1], y[1], lcp[i])
        first = x[1][k : k + 1] <= y[1][k : k + 1]
        lcp[j if first else i] = k
        return first

    tree = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        tree[node] = lose
        return win

    win = build(1)
    while items[win] is not None:
        _, s, load = items[win]
        yield lcp[win], s, load
        items[win] = nxt = next(runs[win], None) if win < len(runs) else None
        lcp[win] = nxt[0] if nxt else 0
        node = (win + size) // 2
        while node:
            if not beats(win, tree[node]):
                win, tree[node] = tree[node], win
            node //= 2


class Marks:
    """Stretches of repeated window starts: (row, first, last) for each block."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, block, row, first, last) -> None:
        self.parts.append(tuple(np.asarray(x, np.int64).reshape(-1) for x in (block, row, first, last)))

    def rows(self) -> list[tuple]:
        if not self.parts:
            return []
        block, *rest = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        return [(MARKS, None, int(block[i[0]]), *(pack(x[i]) for x in rest)) for i in np.split(order, cuts) if len(i)]


def _dense(*cols: np.ndarray) -> np.ndarray:
    """The rank of each row among the distinct rows."""
    order = np.lexsort(cols[::-1])
    step = np.zeros(len(order), bool)
    for c in cols:
        step[1:] |= np.diff(c[order]) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def _late(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether another row with the same key has a smaller rank."""
    n = rank.max(initial=0) + 1
    order = np.argsort(key * n + rank)
    k, r = key[order], rank[order]
    begin = np.flatnonzero(np.diff(k, prepend=k[:1] - 1) != 0) if len(k) else np.empty(0, np.int64)
    least = np.repeat(r[begin], np.diff(np.append(begin, len(k))))
    out = np.empty(len(k), bool)
    out[order] = r > least
    return out


def _left_order(lefts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the reversed strings and each one's common prefix with the one before."""
    back = [x[::-1] for x in lefts]
    order = sorted(range(len(back)), key=back.__getitem__)
    lcp = np.array([0, *(common(back[i], back[j]) for i, j in zip(order, order[1:], strict=False))], np.int64)
    return np.array(order, np.int64), lcp


def resolve(chunk: list[tuple], hot: bool) -> Iterator[pa.RecordBatch]:
    """Marks of the repeats in a stretch of the merged order, whole groups of (lcp, suffix,
    left, doc, position, block, row), and, in a hot stretch, its first windows.

    The window that begins k bytes before an anchor is equal for two suffixes if their
    common prefix (the least of those between them) covers its right part and the common
    prefix of their reversed left contexts its k bytes. So classes for each k are runs of
    the two orders, and no window is compared byte by byte.
    """
    lcp, size, left_size, doc, pos, block, row = (np.array(x, np.int64) for x in zip(*((c[0], len(c[1]), len(c[2]), *c[3:]) for c in chunk), strict=True))
    lcp[0] = 0
    at, marks = pos + left_size, Marks()
    span = left_size + size - HEAD - WIDTH
    rank = _dense(doc, at)
    same = np.zeros(len(chunk), bool)
    same[1:] = (lcp[1:] == size[1:]) & (size[1:] == size[:-1])
    seen: dict[bytes, int] = {}
    left_id = np.array([seen.setdefault(c[2], len(seen)) for c in chunk], np.int64)
    late = _late(np.cumsum(~same) * len(chunk) + left_id, rank)
    marks.add(block[late], row[late], pos[late], (pos + span)[late])
    stay = np.flatnonzero(~late)
    lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
    if not hot:
        begin = np.flatnonzero(lcp < HEAD + GRAM)
        many = np.diff(np.append(begin, len(stay)))
        keep = np.repeat(many > 1, many)
        stay, lcp = stay[keep], lcp[keep]
    if not len(stay):
        yield from batch_of(_RUNS, marks.rows())
        return
    size, left_size, at, rank, block, row, doc = (x[stay] for x in (size, left_size, at, rank, block, row, doc))
    lefts = [chunk[i][2] for i in stay.tolist()]
    order, left_lcp = _left_order(lefts)
    most = WIDTH - GRAM
    again = np.zeros((len(stay), most + 3), bool)  # by k, with an empty column at both ends
    has = np.zeros((len(stay), most + 1), bool)
    left_class = np.empty(len(stay), np.int64)
    for k in range(most + 1):
        has[:, k] = (left_size >= k) & (size >= HEAD + WIDTH - k)
        i = np.flatnonzero(has[:, k])
        if len(i):
            left_class[order] = np.cumsum(left_lcp < k)
            again[i, k + 1] = _late(np.cumsum(lcp < HEAD + WIDTH - k)[i] * (len(stay) + 1) + left_class[i], rank[i])
    edge = np.diff(again.view(np.int8), axis=1)
    i, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    marks.add(block[i], row[i], at[i] - hi, at[i] - lo)
    yield from batch_of(_RUNS, marks.rows())
    if hot:
        i, k = np.nonzero(has & ~again[:, 1:-1])
        for c in range(0, len(i), CHUNK):
            j, kk = i[c : c + CHUNK], k[c : c + CHUNK]
            texts = ((lefts[x], chunk[stay[x]][1], y) for x, y in zip(j.tolist(), kk.tolist(), strict=True))
            dig = b"".join(xxhash.xxh128_digest(a[len(a) - y :] + s[HEAD : HEAD + WIDTH - y]) for a, s, y in texts)
            yield from batch_of(_RUNS, [(FIRSTS, None, None, dig, pack(doc[j]), pack(at[j] - kk), pack(block[j]), pack(row[j]))])


def _runs(tasks: int):
    """A block's sorted run for each merge task, hot suffixes apart; and repeats within the block."""

    def coded(block: int, items: list[tuple], first: int):
        items.sort()
        heads = np.array([int.from_bytes(x[0][:HEAD], "big") for x in items], np.uint64)
        if first:
            return [(RUN, first + xxhash.xxh32_intdigest(str(block)) % tasks, block, *front_code(items))] if items else []
        return [(RUN, part, block, *front_code(items[i:j])) for part, i, j in slices(heads, tasks)]

    def run(batches):
        for r in rows_of(batches):
            b, marks, best, items = Block(r), Marks(), {}, []
            h, hot, at, left, span = b.hits(r)
            row = np.searchsorted(b.starts, at, side="right") - 1
            pos, heads = at - left - b.starts[row], h.astype(">u8").tobytes()
            for q, (a, k, n, doc, p, i, w) in enumerate(zip(*(x.tolist() for x in (at, left, span, b.doc[row], pos, row, hot)), strict=True)):
                key = (heads[HEAD * q : HEAD * q + HEAD] + b.text[a : a - k + n + WIDTH], b.text[a - k : a])
                items.append((*key, doc, p, i, n, w))
                if key not in best or (doc, p) < best[key]:
                    best[key] = (doc, p)
            late = [(i, p, p + n) for s, x, doc, p, i, n, _ in items if (doc, p) > best[s, x]]
            if late:
                marks.add(np.full(len(late), b.name), *zip(*late, strict=True))
            first = [x for x in items if (x[2], x[3]) == best[x[0], x[1]]]
            out = marks.rows()
            for w in (False, True):
                out += coded(b.name, [x[:5] for x in first if x[6] == w], tasks * w)
            yield from batch_of(_RUNS, out)

    return run


def _merge(tasks: int):
    """Merges the runs of a task and resolves them chunk by chunk, each of whole groups but
    in a hot task, whose first windows are settled over all tasks. Marks pass."""

    def run(rows: list[dict]):
        if rows[0]["r"] is None:
            for at in range(0, len(rows), 64):
                yield from batch_of(_RUNS, [tuple(r.values()) for r in rows[at : at + 64]])
            return
        hot = rows[0]["r"] >= tasks
        chunk: list[tuple] = []
        for lcp, s, load in merged([decoded(r) for r in rows]):
            if len(chunk) >= CHUNK and (hot or lcp < HEAD + GRAM):
                yield from resolve(chunk, hot)
                chunk = []
            chunk.append((lcp, s, *load))
        if chunk:
            yield from resolve(chunk, hot)

    return run


def _windows(batches):
    for b in batches:
        for row in b.to_pylist():
            dig = np.frombuffer(row["a"], np.int64).reshape(-1, 2)
            cols = [dig[:, 0], dig[:, 1], *(unpack(row[c], np.int64) for c in "bcde")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d1", "d2", "doc", "pos", "block", "row"])


def _as_marks(rows: list[dict]):
    marks = Marks()
    marks.add(*(np.array([r[c] for r in rows]) for c in ("block", "row", "pos", "pos")))
    yield from batch_of(_RUNS, marks.rows())


_SPANS = "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"


def _cover(batches):
    """Each document of a block with the byte spans that go and the bytes that stay."""
    ints = pa.list_(pa.int64())
    for r in rows_of(batches):
        b = Block(r)
        step = np.zeros(len(b.text) + 1, np.int32)
        for x in b.answers:
            row, first, last = (unpack(x[c], np.int64) for c in "abc")
            np.add.at(step, b.starts[row] + first, 1)
            np.add.at(step, b.starts[row] + last + WIDTH, -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        los, his, kept = [], [], []
        text = np.frombuffer(b.text, np.uint8)
        for at, n in zip(b.starts.tolist(), b.lens.tolist(), strict=True):
            m = gone[at : at + n]
            if m.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
                los.append(edge[::2])
                his.append(edge[1::2])
                kept.append(text[at : at + n][~m].tobytes())
            else:
                los.append([])
                his.append([])
                kept.append(b.text[at : at + n])
        cols = [pa.array(b.doc, pa.int64(), mask=b.null), pa.array(b.lens), pa.array(los, ints), pa.array(his, ints), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "starts", "ends", "kept"])


def repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept), one row for each row of ``docs``: the maximal
    runs of UTF-8 bytes that lie in a string of WIDTH bytes which also starts earlier (in a
    document with a smaller doc_id, or earlier in the same one), and the bytes that stay.

    A null text is empty; a null doc_id counts as the smallest. Repeated rows of a document
    are one document: none is earlier than another, all have the same result.

    Blocks of documents find their anchors and learn from ranges of the hash space which
    occur elsewhere. Suffixes at those are sorted in each block (its own repeats are marked
    at once and go no further, so copies are combined before the exchange), front-coded,
    dealt by ranges of their anchors' hashes and merged; the merge's common prefixes tell
    which windows are equal. A suffix is sent with the bytes before it that its windows
    hold. Suffixes of a hot GRAM are dealt by their blocks instead, and the windows that are
    first in a chunk of them meet in a distributed minimum. Texts are never shuffled: blocks
    are bucketed where they are made and only answers come to them. Nothing is collected on
    the driver.
    """
    small_batches(spark)
    stage = Stage(spark, "suffix")
    size = text_size(docs)
    parts, ranges, tasks = parts_for(spark, size), int(max(1, -(-size // RANGE))), int(max(1, -(-size // MERGE)))
    blocks = stage.bucketed(_blocks(docs), parts, "block")
    flags = grouped(blocks.mapInArrow(_ask(ranges), _ASKED), ranges, ["r"], ["block"], _answer, _FLAGS)
    runs = with_answers(blocks, flags, ["r", "flags"], parts).mapInArrow(_runs(tasks), _RUNS)
    by = ["r", F.when(F.col("r").isNull(), F.col("block"))]
    found = stage.cut(grouped(runs, max(tasks, 2 * spark.sparkContext.defaultParallelism), ["r"], ["block"], _merge(tasks), _RUNS, by=by))
    marks = found.filter(F.col("kind") == MARKS)
    firsts = found.filter(F.col("kind") == FIRSTS)
    if not firsts.isEmpty():
        w = firsts.mapInArrow(_windows, "d1 bigint, d2 bigint, doc bigint, pos bigint, block bigint, row bigint")
        start = F.struct("doc", "pos")
        low = w.groupBy("d1", "d2").agg(F.min(start).alias("low"))
        late = w.join(low, ["d1", "d2"]).filter(F.col("low") < start).select("block", "row", "pos")
        marks = marks.unionByName(grouped(late, parts, ["block"], ["row", "pos"], _as_marks, _RUNS, most=CHUNK))
    return with_answers(blocks, marks, ["a", "b", "c"], parts).mapInArrow(_cover, _SPANS)
