"""Language-model scores against a plain implementation of the same model."""

import math
from collections import Counter

import numpy as np
from foliolith.llm import lm
from foliolith.llm.util import crc_mod
from pyspark.sql import functions as F

from .fixtures import docs, empty, texts


def tokens(t):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (t or "").split(" ") for w in w.split()] + ["</s>"]


def test_scores_match_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 30_000)
    monkeypatch.setattr(lm, "RANGE", 20_000)
    seen = {}
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: seen.setdefault("w", real(*a)))
    rows = [(i, t) for i, t in enumerate(texts()) if t is None or "\x1f" not in t]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = {r[0]: r[1] for r in df.select("doc_id", crc_mod(F.col("doc_id"), 5) == 1).collect()}
    got = {r["doc_id"]: r for r in lm.score(spark, df, crc_mod(F.col("doc_id"), 5) != 1).collect()}
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            k = tokens(t)
            uni.update(k)
            bi.update(zip(["</s>", *k], k))
    n, v, w = sum(uni.values()), len(uni), seen["w"]
    for i, t in rows:
        k = tokens(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in k)
        model = 0
        for u, x in zip(["</s>", *k], k):
            a = w[int(lm.bucket(np.array([uni[u]]))[0])]
            model += math.log10(a[0] * (bi[u, x] / uni[u] if uni[u] else 0) + a[1] * uni[x] / n + a[2] / (v + 1))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["learned"]) == (len(k), sum(uni[x] > 0 for x in k), n, not held[i])
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9
        assert abs(r["score"] - model) < 1e-6 * abs(model) + 1e-9
    assert np.allclose(w.sum(1), 1) and w[5][0] > 0


def test_weights_match_plain_em_on_held_out_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 30_000)
    monkeypatch.setattr(lm, "RANGE", 20_000)
    seen = {}
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: seen.setdefault("w", real(*a)))
    rows = [(i, t) for i, t in enumerate(texts()) if t and "\x1f" not in t]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lm.score(spark, df, F.col("doc_id") % 7 != 0, F.col("doc_id") % 3 == 0).count()
    uni, bi, vocab = Counter(), Counter(), set()
    for i, t in rows:
        if i % 7:
            vocab.update(tokens(t))
        if i % 7 and i % 3:
            uni.update(tokens(t))
            bi.update(zip(["</s>", *tokens(t)], tokens(t)))
    n, w = sum(uni.values()), np.full((lm.BUCKETS, 3), 1 / 3)
    held = [p for i, t in rows if i % 7 and i % 3 == 0 for p in zip(["</s>", *tokens(t)], tokens(t))]
    ps = [(int(lm.bucket(np.array([uni[u]]))[0]), bi[u, x] / uni[u] if uni[u] else 0, uni[x] / n, 1 / (len(vocab) + 1)) for u, x in held]
    for _ in range(lm.EM_ROUNDS):
        new = np.zeros((lm.BUCKETS, 3))
        for b, *p in ps:
            post = w[b] * p
            new[b] += post / post.sum()
        w = np.where(new.sum(1, keepdims=True) > 0, new / np.maximum(new.sum(1, keepdims=True), 1e-300), w)
    used = sorted({b for b, *_ in ps})
    assert len(used) > 4 and np.allclose(seen["w"][used][1:], w[used][1:], atol=0.02)


def test_em_finds_the_better_estimate():
    # Contexts seen 65 times whose tokens are foreseen by the bigram, not by the unigram.
    s = lambda x: int(lm.code(np.array([x]))[0])
    cells = np.array([(s(64) * 256 + s(2)) * 256 + s(60)])
    w = lm.fit(cells, np.array([1000.0]), 100000, 5000)
    assert w[lm.bucket(np.array([64]))[0]][0] > 0.95


def test_awkward_rows(spark):
    d = docs(spark, extra=True)
    assert lm.score(spark, d, F.lit(True)).count() == d.count()
    none = lm.score(spark, d, F.lit(False))
    assert none.filter("n_known > 0 or score > 0 or isnan(score)").count() == 0
    assert lm.score(spark, empty(spark), F.lit(True)).count() == 0


def test_equal_blocks_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 100)
    rows = [(1, "a b a b c"), (2, "b c " * 30)]
    for part in (rows, rows, [(None, "only")], [(None, "other")]):
        df = spark.createDataFrame(part, "doc_id long, text string")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    d = spark.read.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file
    try:
        assert d.rdd.getNumPartitions() == 4
        got = lm.score(spark, d, F.lit(True)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = lm.score(spark, d.coalesce(1), F.lit(True)).collect()
    key = lambda r: (r["doc_id"] or 0, r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6))
    assert len(got) == 6 and sorted(map(key, got)) == sorted(map(key, whole))
