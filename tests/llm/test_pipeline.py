"""The pipeline against a plain version of every stage."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from foliolith.llm import mixing, quality

from .test_neardup import brute as brute_components
from .test_neardup import edited
from .test_simple_ops import brute_hits, brute_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    say = lambda n: [rng.choice(["the", "of", "and"]) if i % 4 == 0 else f"w{rng.randrange(3000)}" for i in range(n)]
    texts = [None, "", "too short", "# $ % & | < > * " * 20 + "the of", " ".join(say(10)) * 9]
    texts += [" ".join(say(rng.randrange(25, 90))) for _ in range(40)]
    for _ in range(4):
        w = say(80)
        texts += [" ".join(w), " ".join(w)] + [edited(rng, w, 1) for _ in range(3)]
    item = say(14)
    texts += [" ".join(say(30) + item + say(20)), " ".join(say(30) + item[:9] + say(20))]
    texts += [" ".join(say(25)) + f" write to me{i}@site.org or 10.0.0.{i} " + " ".join(say(10)) for i in range(5)]
    docs = [(i, t, "en", "hot" if i % 2 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return docs, [(1, " ".join(item)), (2, "never seen words here at all in any text of them")]


def plain_quality(t):
    n, chars, symbols, dup, repeat = brute_quality(t)
    if n < 20 or 100 * repeat > 30 * n:
        return False
    w = t.split()
    lines = [x for x in t.split("\n") if x.strip()]
    stop = sum(x.lower() in quality.STOP_WORDS for x in w)
    letters = sum(bool(re.search(r"[^\W\d_]", x)) for x in w)
    return 2 <= chars / n <= 20 and symbols / n <= 0.3 and stop / n >= 0.02 and dup / len(lines) <= 0.5 and letters / n >= 0.5


def plain_copies(docs):
    n = Counter(d[3] for d in docs)
    total = sum(math.sqrt(x) for x in n.values())
    out = {}
    for d in docs:
        mean = math.sqrt(n[d[3]]) / total * len(docs) / n[d[3]]
        u = int(hashlib.md5(f"{mixing.SEED}|{d[0]}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        cdf = p
        while cdf <= u:
            k += 1
            p *= mean / k
            cdf += p
        out[d[0]] = k
    return out


def test_run_matches_a_plain_version(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stay = [d for d in docs if plain_quality(d[1])]
    comp = brute_components([(d[0], d[1]) for d in stay], 5, 80)
    stay = [d for d in stay if comp[d[0]][1] == d[0]]
    clean = [d for d in stay if not brute_hits(d[1], bench)[1]]
    assert len(docs) - len(stay) > 15 and len(stay) - len(clean) == 1
    copies = plain_copies(clean)
    assert Counter(r["doc_id"] for r in got) == Counter({k: v for k, v in copies.items() if v})
    before = {d[0]: d[1] for d in clean}
    for r in got:
        want = re.sub(r"me\d@site\.org", "<EMAIL>", before[r["doc_id"]])
        assert r["text"] == re.sub(r"10\.0\.0\.\d", "<IP>", want)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "mixture"]


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(None, "the of and " * 3 + " ".join(f"w{i}" for i in range(30)), None, None, None)] * 2, SCHEMA)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns and out.count() == df.count()
        corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count()
