"""Language-model scores by deleted interpolation of word n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.llm.codec import pack, pack_sorted, slices, unpack, unpack_sorted
from foliolith.llm.hashing import _STEP, WordHash, mix, words
from foliolith.llm.util import Stage, batch_of, block_names, crc_mod, grouped, parts_for, rows_of, small_batches, text_size, with_answers

#: Text bytes of one block of documents, which bounds what a task holds.
BLOCK = 8_000_000
#: Text bytes for each range of the key space that counts are summed in.
RANGE = 24_000_000
#: The token that ends a document; it's also the context of the first word.
END = np.uint64(0x5AD0E4B1C3F27A69)
#: Context-frequency buckets: by the power of two of the context's count, the last open.
BUCKETS = 12
#: EM sees counts up to EXACT as they are, and larger ones in SCALE steps for each power of
#: two; that bounds its histogram, whatever the size of the corpus.
EXACT, SCALE = 32, 8
#: One of DELETED training documents is held out of the counts on which EM learns.
DELETED = 10
EM_ROUNDS = 30
FLOOR = 1e-9
_BLOCKS = "block bigint, vocab binary, count binary, held binary, at binary, lens binary, doc binary, state binary"
#: Keys of a block in a range: their training counts, the part of them that is held out, and
#: for the keys with such a part the codes of their context's and word's counts.
_ASKED = "block bigint, r int, keys binary, counts binary, held binary, context binary, word binary"
#: TOTALS: counts and held-out counts in the order in which a block asked. SUMS: (cells, mass)
#: of a range's histogram, for no block.
_FOUND = "kind int, block bigint, r int, a binary, b binary"
UNI, BI, SUMS = 0, 1, 2


def _blocks(docs: DataFrame, train: Column, deleted: Column) -> DataFrame:
    """One row a block: its sorted vocabulary with training counts, and its documents as token
    numbers. A block is a stretch of one task's input; it is written before use, so its name
    (by its task and place) need not be found again."""

    def run(batches):
        seen, names = WordHash(), block_names()
        ids, flags, toks, size = [], [], [], 0

        def flush():
            lens = np.array([len(t) for t in toks], np.uint32)
            vocab, at = np.unique(np.concatenate(toks), return_inverse=True)
            state = np.array([f + 4 * (x is None) for f, x in zip(flags, ids, strict=True)], np.uint8)
            flag = np.repeat(state, lens)
            count, held = (np.bincount(at[flag & bit > 0], minlength=len(vocab)).astype(np.uint32) for bit in (1, 2))
            doc = np.array([x if x is not None else 0 for x in ids], np.int64)
            row = (next(names), pack_sorted(vocab), pack(count), pack(held), pack(at.astype(np.uint32)), pack(lens), pack(doc), pack(state))
            return batch_of(_BLOCKS, [row])

        for b in batches:
            for doc_id, text, learn, out in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                w = words(text)
                toks.append(np.append(seen.of(w), END))
                ids.append(doc_id)
                flags.append(bool(learn) + 2 * bool(learn and out))
                size += len(text or "") + 64
                if size >= BLOCK:
                    yield from flush()
                    ids, flags, toks, size = [], [], [], 0
        if ids:
            yield from flush()

    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("learn"), deleted.alias("out"))
    return cols.mapInArrow(run, _BLOCKS)


class Block:
    """One block's row, with the totals that were found for its keys."""

    def __init__(self, row: dict):
        self.name, self.vocab = row["block"], unpack_sorted(row["vocab"])
        self.at, self.lens = unpack(row["at"], np.uint32), unpack(row["lens"], np.uint32)
        self.doc, self.state = unpack(row["doc"], np.int64), unpack(row["state"], np.uint8)
        self.answers = row["answers"]

    def total(self, kind: int, col: str = "a") -> np.ndarray:
        found = sorted((x for x in self.answers if x["kind"] == kind), key=lambda x: x["r"])
        return np.concatenate([unpack(x[col], np.int64) for x in found])

    def bigrams(self):
        """Key, context and word number of every token, in order."""
        first = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        context = np.empty(len(self.at), np.uint32)
        context[1:] = self.at[:-1]
        context[first] = np.searchsorted(self.vocab, END)
        h = mix(self.vocab)
        return mix(self.vocab[context] * _STEP + h[self.at]), context, self.at

    def ids(self):
        return pa.array(self.doc, pa.int64(), mask=self.state >= 4)


def code(x: np.ndarray) -> np.ndarray:
    """A count as a number below 256: itself up to EXACT, then on a logarithmic scale."""
    high = EXACT + np.round(SCALE * np.log2(np.maximum(x, EXACT) / EXACT))
    return np.minimum(255, np.where(x <= EXACT, x, high)).astype(np.uint8)


def decode(q: np.ndarray) -> np.ndarray:
    return np.where(q <= EXACT, q, EXACT * 2.0 ** ((np.maximum(q, EXACT) - EXACT) / SCALE))


def _ask_words(parts: int):
    """A block's words and training counts by range of the key space."""

    def run(batches):
        for row in rows_of(batches):
            keys, count, held = unpack_sorted(row["vocab"]), unpack(row["count"], np.uint32), unpack(row["held"], np.uint32)
            yield from batch_of(_ASKED, [(row["block"], r, pack_sorted(keys[i:j]), pack(count[i:j]), pack(held[i:j])) for r, i, j in slices(keys, parts)])

    return run


def _ask_bigrams(parts: int):
    """A block's bigrams likewise, with the codes of what remains of their context's and word's
    counts without the held-out documents."""

    def run(batches):
        for row in rows_of(batches):
            b = Block(row)
            keys, context, word = b.bigrams()
            uniq, where, back = np.unique(keys, return_index=True, return_inverse=True)
            flag = np.repeat(b.state, b.lens)
            count, held = (np.bincount(back[flag & bit > 0], minlength=len(uniq)).astype(np.uint32) for bit in (1, 2))
            rest = code(b.total(UNI) - b.total(UNI, "b"))
            qc, qw = rest[context[where]], rest[word[where]]
            out = []
            for r, i, j in slices(uniq, parts):
                k = held[i:j] > 0
                out.append((b.name, r, pack_sorted(uniq[i:j]), pack(count[i:j]), pack(held[i:j]), pack(qc[i:j][k]), pack(qw[i:j][k])))
            yield from batch_of(_ASKED, out)

    return run


def _sum(kind: int):
    """Totals over all blocks, and a histogram of the range: for words, training tokens, distinct
    words and tokens that remain in cells 0 to 2; for bigrams, the held-out tokens by what
    remains of the counts of their context, word and bigram."""

    def run(rows: list[dict]):
        keys = [unpack_sorted(r["keys"]) for r in rows]
        uniq, back = np.unique(np.concatenate(keys), return_inverse=True)
        each = [np.concatenate([unpack(r[c], np.uint32) for r in rows]) for c in ("counts", "held")]
        total, held = (np.bincount(back, weights=x, minlength=len(uniq)).astype(np.int64) for x in each)
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            i = back[at : at + len(k)]
            out.append((kind, r["block"], r["r"], pack(total[i]), pack(held[i]) if kind == UNI else None))
            at += len(k)
        if kind == UNI:
            cells, mass = np.arange(3), np.array([total.sum(), (total > 0).sum(), (total - held).sum()])
        else:
            qc, qw = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
            own = back[each[1] > 0]
            qc[own] = np.concatenate([unpack(r["context"], np.uint8) for r in rows])
            qw[own] = np.concatenate([unpack(r["word"], np.uint8) for r in rows])
            has = held > 0
            cells, inv = np.unique((qc[has] * 256 + qw[has]) * 256 + code((total - held)[has]), return_inverse=True)
            mass = np.bincount(inv, weights=held[has], minlength=len(cells))
        out.append((SUMS, None, rows[0]["r"], cells.astype(np.int64).tobytes(), mass.astype(np.int64).tobytes()))
        yield from batch_of(_FOUND, out)

    return run


def _histogram(found: DataFrame) -> dict[int, int]:
    """The histograms of all ranges, summed; cells are bounded by the scale, not the data."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                cells, mass = (pa.array(np.frombuffer(row[c], np.int64)) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([cells, mass], names=["cell", "mass"])

    cells = found.filter(F.col("kind") == SUMS).select("a", "b").mapInArrow(run, "cell bigint, mass bigint")
    return {r[0]: r[1] for r in cells.groupBy("cell").agg(F.sum("mass")).collect()}


def bucket(context: np.ndarray) -> np.ndarray:
    """The context-frequency bucket of a count: 0 for none, then by powers of two."""
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1))).astype(np.int64)


def fit(cells: np.ndarray, mass: np.ndarray, n: int, v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation.

    ``cells`` code the counts of a held-out token's context, word and bigram in the other
    training documents (``n`` tokens); ``mass`` is how many held-out tokens have them.
    Buckets without tokens take the weights of the nearest lower bucket, the lowest ones
    (0, .5, .5).
    """
    cb, rest = decode(cells % 256), cells // 256
    cu, cv = decode(rest // 256), decode(rest % 256)
    p2 = np.where(cu > 0, np.minimum(1, cb / np.maximum(cu, 1)), 0)
    p = np.stack([p2, cv / max(n, 1), np.full(len(cv), 1 / (v + 1))])
    which = bucket(cu)
    w = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        post = p * w[which].T
        post *= mass / np.maximum(post.sum(0), 1e-300)
        new = np.stack([np.bincount(which, weights=x, minlength=BUCKETS) for x in post], 1)
        w = np.where(new.sum(1, keepdims=True) > 0, new / np.maximum(new.sum(1, keepdims=True), 1e-300), w)
    has = np.bincount(which, weights=mass, minlength=BUCKETS) > 0
    last = np.array([0, 0.5, 0.5])
    for i in range(BUCKETS):
        last = w[i] if has[i] else last
        w[i] = last
    w = np.maximum(w, FLOOR)
    w[0] = [0, *(w[0][1:] / w[0][1:].sum())]
    return w / w.sum(1, keepdims=True)


_SCORES = "doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(n: int, v: int, w: np.ndarray):
    def run(batches):
        for row in rows_of(batches):
            b = Block(row)
            keys, context, word = b.bigrams()
            back = np.unique(keys, return_inverse=True)[1]
            c2, total = b.total(BI)[back], b.total(UNI)
            c, cu = total[word], total[context]
            lam = w[bucket(total)]
            p = np.where(cu > 0, c2 / np.maximum(cu, 1), 0) * lam[context, 0]
            p += lam[context, 1] * (c / max(n, 1)) + lam[context, 2] / (v + 1)
            base = np.log10((total + 0.5) / (n + 0.5 * (v + 1)))[word]
            first = np.concatenate([[0], np.cumsum(b.lens)[:-1]]).astype(np.int64)
            sums = lambda x: np.add.reduceat(x, first)
            cols = [b.ids(), b.state % 2 == 1, b.lens.astype(np.int64), sums((c > 0).astype(np.int64)), np.full(len(first), n, np.int64), sums(base), sums(np.log10(p))]
            names = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return run


def score(spark: SparkSession, docs: DataFrame, train: Column, deleted: Column | None = None) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words with A-Z in lower case, then one end; a null text is empty. Counts come
    from the rows for which ``train`` is true. The model mixes the maximum-likelihood bigram
    and unigram estimates and a uniform one; weights depend on how often the context was
    seen. EM learns them on the ``deleted`` training documents (one of DELETED by a checksum
    of doc_id) with the counts of the others; the model then counts all training documents.
    Without training rows all mass is on the uniform estimate, without deleted ones weights
    are (0, .5, .5). base_score is the smoothed unigram score, score the model's, both log10
    of the whole text.

    Blocks of documents (bounded by BLOCK; a text is never cut) ask for the totals of their
    distinct keys, and ranges of the key space answer; a frequent word is one key of each
    block, so no key is hot. Blocks are bucketed where they are made, only keys and totals
    are shuffled. No table of the vocabulary is broadcast or collected; the driver sees
    three numbers and a histogram of bounded size.
    """
    small_batches(spark)
    stage = Stage(spark, "lm")
    size = text_size(docs)
    parts, ranges = parts_for(spark, size), int(max(1, -(-size // RANGE)))
    if deleted is None:
        deleted = crc_mod(F.concat(F.lit("deleted|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), DELETED) == 0
    blocks = stage.bucketed(_blocks(docs, train, deleted), parts, "block")
    asked = blocks.select("block", "vocab", "count", "held").mapInArrow(_ask_words(ranges), _ASKED)
    uni = stage.cut(grouped(asked, ranges, ["r"], ["block"], _sum(UNI), _FOUND))
    numbers = _histogram(uni)
    n, v, rest = (numbers.get(i, 0) for i in range(3))
    words_found = uni.filter(F.col("kind") == UNI)
    cols = ["kind", "r", "a", "b"]
    asked = with_answers(blocks, words_found, cols, parts).mapInArrow(_ask_bigrams(ranges), _ASKED)
    bi = stage.cut(grouped(asked, ranges, ["r"], ["block"], _sum(BI), _FOUND))
    hist = _histogram(bi)
    cells = np.array(sorted(hist), np.int64)
    w = fit(cells, np.array([hist[x] for x in cells.tolist()], np.float64), rest, v)
    return with_answers(blocks, words_found.unionByName(bi.filter(F.col("kind") == BI)), cols, parts).mapInArrow(_score(n, v, w), _SCORES)
