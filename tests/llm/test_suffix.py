"""Repeated strings against a plain dictionary of all windows."""

import hashlib
import random

from foliolith.llm import queries, suffix
from pyspark.sql import functions as F

from .fixtures import docs, empty, texts


def brute(rows, width=100):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            if w not in first or (i, p) < first[w]:
                first[w] = (i, p)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < (i, p):
                gone[p:p + width] = b"\1" * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in queries.op4_suffix(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert {i for i in want if got[i] != want[i]} == set()
    return want


def corpus():
    rng = random.Random(4)
    t = [x if x is None or len(x) < 9000 else x[:9000] for x in texts()]
    passage = "".join(rng.choice("abc def") for _ in range(350))
    t += ["".join(rng.choice("uvw xyz") for _ in range(rng.randrange(0, 300))) + passage[rng.randrange(0, 60):rng.randrange(200, 350)] + "é" * rng.randrange(0, 90) for _ in range(120)]
    t += [passage, passage + passage, "ab" * 400, "ab" * 300, "a" * 99, "a" * 100, "a" * 101, "a" * 700]
    order = list(range(len(t)))
    rng.shuffle(order)
    return [(k, x) for k, x in zip(order, t)]


def test_removed_bytes_match_all_windows(spark, tmp_path):
    want = check(spark, tmp_path, corpus())
    assert sum(w[1] > 0 for w in want.values()) > 100 and max(w[2] for w in want.values()) > 1


def test_small_blocks_groups_and_steps(spark, tmp_path, monkeypatch):
    for name, v in (("BLOCK", 9000), ("RANGE", 20000), ("MERGE", 15000), ("HOT", 5), ("CHUNK", 40), ("STEP", 1000)):
        monkeypatch.setattr(suffix, name, v)
    check(spark, tmp_path, corpus())


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(1)
    for n in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
        coded = [{"block": 1, **dict(zip("abcdef", suffix.front_code([(s, b"", 0, 0, 0) for s in r])))} for r in runs if r]
        last, out = b"", []
        for k, s, _ in suffix.merged([suffix.decoded(c) for c in coded]):
            assert k == suffix.common(last, s)
            last = s
            out.append(s)
        assert out == sorted(x for r in runs for x in r)


def test_awkward_rows(spark):
    d = docs(spark, extra=True)
    out = suffix.repeated(spark, d)
    rows = out.collect()
    assert len(rows) == d.count()
    same = [r for r in rows if r["doc_id"] == 5]
    assert len(same) == 3 and len({(r["n_bytes"], tuple(r["starts"])) for r in same}) == 1 and same[0]["starts"] == []
    assert suffix.repeated(spark, empty(spark)).count() == 0
    assert suffix.repeated(spark, d.filter("length(text) < 50")).filter(F.size("starts") > 0).count() == 0


def test_equal_blocks_stay_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc " * 60), (2, "x" * 150)], "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/t")
    df.write.mode("append").parquet(f"{tmp_path}/t")
    twice = spark.read.parquet(f"{tmp_path}/t")
    d = twice.filter("true").unionByName(twice)
    out = suffix.repeated(spark, d).collect()
    assert sorted(r["doc_id"] for r in out) == [1] * 4 + [2] * 4
    assert len({(r["doc_id"], tuple(r["starts"]), r["kept"]) for r in out}) == 2
