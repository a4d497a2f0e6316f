"""Near-duplicate components against all pairs on small tables."""

import random

from pyspark.sql import functions as F

from foliolith.llm import neardup, util

from .fixtures import docs, empty, texts


def brute(rows, words, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        n = min(words, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows, words=4, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in neardup.link(spark, df, words, percent).collect()}
    assert got == brute(rows, words, percent)


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_match_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(neardup, "HOT", 6)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, t if t is None or len(t) < 20000 else t[:100]) for i, t in enumerate(texts())]
    for g in range(6):
        w = [f"g{g}x{rng.randrange(500)}" for _ in range(rng.choice([5, 30, 120]))]
        rows += [(len(rows) + k, edited(rng, w, rng.randrange(0, 4))) for k in range(9)]
    for _ in range(25):  # documents that share a passage, and little else
        rows.append((len(rows), " ".join(passage) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 40])))))
    check(spark, rows)


def test_star_and_chain(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 6)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = [(5, " ".join(base))] + [(10 + i, edited(rng, base, 2)) for i in range(40)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        chain[i * 7] = f"z{i}"
        chain[i * 7 + 1] = f"y{i}"
        rows.append((100 - i, " ".join(chain)))
    check(spark, rows)


def test_short_copies_of_hot_families(spark):
    rng = random.Random(7)
    rows = []
    for g in range(8):  # 34 shared shingles and an own one; the copy has 29 and an own one
        w = [f"g{g}w{rng.randrange(10**6)}" for _ in range(37)]
        rows += [(len(rows) + k, " ".join([*w, f"o{g}x{k}"])) for k in range(100)]
        rows.append((len(rows), " ".join([*w[:32], f"c{g}"])))
    check(spark, rows)


def test_awkward_rows(spark):
    d = docs(spark, extra=True)
    out = neardup.link(spark, d)
    assert out.count() == d.count()
    kept = neardup.dedup(spark, d)
    assert kept.columns == d.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert {5, 6, 7} & set(ids) == {5} and {0, 1, 2, None} <= set(ids)
    assert neardup.dedup(spark, empty(spark)).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(5, 100 + i) for i in range(40)] + [(300 + i, 301 + i) for i in range(30)] + [(300, 120), (900, 100)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(25)]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    for hubs in (3, 1000):
        monkeypatch.setattr(util, "HUBS", hubs)
        got = {r[0]: r[1] for r in util.components(util.Stage(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
        alone = {a for a, b in edges if a == b} - set(got)
        assert got == {k: v for k, v in comp.items() if k not in alone}


def test_alike_members_exchange_their_values_once(spark):
    util.small_batches(spark)
    stage = util.Stage(spark, "open")
    hot = spark.createDataFrame([(7, i, 1, 1 if i < 250 else 2) for i in range(500)], "value long, id long, lead long, comp long").repartition(2)
    reps = spark.createDataFrame([(i, 60, [j if i % 2 else 1000 * (i // 250) + j for j in range(60)]) for i in range(500)], "id long, n long, sketch array<bigint>")
    df = neardup._open(stage, hot, reps)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    # Even members of the first component have the values of odd ones, those of the second don't.
    assert sorted(r["id"] for r in df.collect()) == [i for i in range(500) if i % 2 or i < 250]


def test_values_of_a_batch_are_made_once_for_all_components(spark):
    util.small_batches(spark)
    stage = util.Stage(spark, "open")
    hot = spark.createDataFrame([(7, i, 1, i) for i in range(300)], "value long, id long, lead long, comp long").coalesce(1)
    reps = spark.createDataFrame([(i, 40, list(range(40)) if i % 3 else [1000 * (i + 1) + j for j in range(40)]) for i in range(300)], "id long, n long, sketch array<bigint>")
    df = neardup._open(stage, hot, reps)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # what is read twice was written
    parts, every = (spark.read.parquet(f"{stage.root}/{n}") for n in (1, 2))
    # The alike members of all components have one row a value in each batch, 100 others their own.
    assert 28 * 100 < every.count() <= 28 * (100 + parts.count())
    assert sorted(r["id"] for r in df.collect()) == [i for i in range(300) if i % 3]


def test_hot_members_are_compared_by_rare_shingles_alone(spark, monkeypatch):
    """Documents that share a hot passage and have a fifth of their own meet nobody; blocks of
    families that can be linked give what all pairs give."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}x{k}" for k in range(20)])) for i in range(90)]
    for size in (40, 47, 60, 90):  # siblings, most of which are no link of another
        base = passage[:30] + [f"b{size}x{i}" for i in range(size)]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(1, 4))) for k in range(45)]
    monkeypatch.setattr(neardup, "HOT", 6)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 7)
    listed, real = [], neardup._prefixes

    def prefixes(*a):
        out = real(*a)
        listed.extend(r["id"] for r in out.select("id").distinct().collect())
        return out

    monkeypatch.setattr(neardup, "_prefixes", prefixes)
    check(spark, rows)
    assert listed and min(listed) >= 90


def test_word_hashes_tell_words_apart():
    from foliolith.llm.hashing import word_hashes, words

    texts = ["", " \t\x0b", "A b\x00 b \x0bc", "12345678 123456789 1234567890123456 " + "q" * 255, "y" * 256 + " " + "y" * 257 + " ü Ü z\x85z", "a\x00 a A"]
    for t in texts:
        w, h = words(t), word_hashes(t).tolist()
        assert len(w) == len(h) and len(set(zip(w, h, strict=True))) == len(set(w)) == len(set(h))
    assert len(word_hashes(None)) == 0


def test_components_of_few_edges_take_one_task_and_of_many_take_rounds(spark, monkeypatch):
    rng = random.Random(10)
    edges = [(300 - i, 301 - i) for i in range(200)] + [(5, 1000 + i) for i in range(60)] + [(rng.randrange(2000, 2090), rng.randrange(2000, 2090)) for _ in range(70)] + [(7, 7)]
    comp = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in comp:
        for a, b in edges[:-1]:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for tree, most in ((util.TREE, 1), (40, 9)):
        monkeypatch.setattr(util, "TREE", tree)
        stage = util.Stage(spark, "test")
        got = util.components(stage, df).collect()
        assert len(got) == len(comp) and {r[0]: r[1] for r in got} == comp
        assert (stage.n == 1) == (most == 1) and stage.n <= most
    assert util.components(util.Stage(spark, "test"), df.filter("a = b")).count() == 0
    many = [*range(1, 1000), *range(1, 1000)]  # more ids than a task keeps: trees come in parts
    monkeypatch.setattr(util, "TREE", 10)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([i + 1]), pa.array([i])], names=["u", "v"]) for i in many]
    assert len(list(util._trees(batches))) > 1


def test_written_stages_leave_no_shuffle_files(spark):
    import re
    import time

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return set(re.findall(r"shuffle_\w+\.\w+", found.toString()))

    before, conf = files(), spark.conf.get(util.CLEANUP, None)
    out = util.Stage(spark, "test").cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(util.CLEANUP, None) == conf and out.count() == 7


def test_sketches_of_all_rows_go_once_those_of_sets_are_written(spark):
    from pathlib import Path

    made = len(util.Stage.roots)
    neardup.link(spark, spark.createDataFrame([(i, f"a b c d e {i // 2}") for i in range(20)], "doc_id long, text string"))
    root = Path(util.Stage.roots[made].removeprefix("file://"))
    assert not (root / "1").exists() and (root / "2").exists()
