"""Operators 1, 2, 8, 9 and 10 against plain re-implementations."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

from foliolith.llm import chat, decontaminate, mixing, pii, quality, queries
from pyspark.sql import functions as F

from .fixtures import docs, empty, texts


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(t):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, r in rx.items():
        for m in re.finditer(r, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    got = {r[0]: r for r in docs(spark).select("doc_id", pii.base_spans(F.col("text")).alias("b")).dropDuplicates(["doc_id"]).collect()}
    some = 0
    for i, t in enumerate(texts()):
        if t is not None and len(t) >= 30000:
            continue
        want = brute_base(t or "")
        some += len(want)
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in got[i]["b"]] == want, i
    assert some >= 6
    assert len(got[19]["b"]) == 1  # a very long address


def test_pii_many_matches_in_one_text(spark):
    t = "".join(f"u{i}@ex.org text {i} " for i in range(1500))
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = df.select(pii.base_spans(F.col("text")).alias("b")).first()["b"]
    assert [(s["start"], s["end"]) for s in got if s["kind"] == 0] == [x[1:] for x in brute_base(t) if x[0] == "email"]


def test_pii_terms_and_sanitise(spark):
    rows = [(i, f"filler number{'abcdefghij'[i % 10]} words. Contact Zarquon at zarq@corp.net for the keys", None) for i in range(5)]
    rows += [(10 + i, "filler the keys for the words at contact", None) for i in range(20)] + [(99, None, None), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = {r["doc_id"]: r for r in pii.all_spans(spark, df).collect()}
    t = rows[0][1]
    assert [t[s["start"]:s["end"]] for s in got[0]["terms"]] == ["Zarquon"]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, df).collect()}
    assert out[0] == "filler numbera words. Contact  at <EMAIL> for the keys"
    assert out[10] == rows[5][1] and out[99] is None and out[None] == ""
    assert pii.sanitise(spark, df).columns == df.columns
    assert pii.sanitise(spark, empty(spark)).count() == 0


def brute_terms(rows, alpha, low, kind_low):
    """Start and end of all disclosing terms by counting everything."""
    base = {i: brute_base(t or "") for i, t in rows}
    ents, terms, df = {}, {}, Counter()
    for i, t in rows:
        t = t or ""
        df.update({m.lower() for m in re.findall(r"[^\W\d_]+", t)})
        if base[i]:
            blank = t
            for _, a, b in base[i]:
                blank = blank[:a] + " " * (b - a) + blank[b:]
            norm = lambda k, x: x.lower() if k == "email" else x if k == "ip" else re.sub("[^0-9]", "", x)
            ents[i] = {(k, norm(k, t[a:b])) for k, a, b in base[i]} | {k for k, _, _ in base[i]}
            terms[i] = {m.lower() for m in re.findall(r"[^\W\d_]+", blank)}
    ce, cet, n = Counter(e for v in ents.values() for e in v), Counter((e, w) for i in ents for e in ents[i] for w in terms[i]), len(rows)
    bad = {(e, w) for (e, w), c in cet.items() if c >= (kind_low if isinstance(e, str) else low) and n > ce[e]
           and math.log2(n * c / (ce[e] * df[w])) >= alpha * math.log2(n / ce[e]) - 1e-12}
    clear = lambda i, m: all(b <= m.start() or m.end() <= a for _, a, b in base[i])
    return {i: [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if i in ents and clear(i, m) and any((e, m[0].lower()) in bad for e in ents[i])] for i, t in rows if t}


def test_pii_terms_match_plain_counts(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "abcdefghijkl" for b in "mnopqrst"]
    rows = [(0, None), (1, "")]
    for i in range(2, 300):
        w = [rng.choice(vocab) for _ in range(rng.randrange(4, 60))]
        who = rng.randrange(60)
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), f"P{who % 7}@x.org")
            w.insert(rng.randrange(len(w)), "Name" + "abcdefg"[who % 7])
            w += ["reach"] * (rng.random() < 0.9)
        if i % 7 == 0:
            w.insert(rng.randrange(len(w)), "10.0.0.%d" % (who % 3))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_terms(rows, pii.DISCLOSURE, pii.MIN_DOCS, pii.KIND_DOCS)
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["terms"]] for r in pii.all_spans(spark, df).collect()}
    assert {i: v for i, v in got.items() if v} == {i: v for i, v in want.items() if v}
    assert sum(map(len, got.values())) > 60


def test_pii_handles_awkward_rows(spark):
    d = docs(spark, extra=True)
    assert pii.all_spans(spark, d).count() == d.count()
    clean = pii.sanitise(spark, d)
    assert clean.columns == d.columns and clean.count() == d.count()
    assert clean.filter("text like '%bob@site.org%'").count() == 0


def brute_quality(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    cover = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_counts(spark):
    d = docs(spark, extra=True)
    a = quality.assess(d)
    got = {r["doc_id"]: r for r in a.dropDuplicates(["doc_id"]).collect()}
    for i, t in enumerate(texts()):
        r, want = got[i], brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert any(brute_quality(t)[4] for t in texts())
    assert a.count() == d.count()
    assert quality.filter_quality(d).columns == d.columns
    assert quality.assess(empty(spark)).count() == 0


def brute_hits(t, items):
    def words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))

    w, hit, found = words(t), set(), set()
    for k, item in items:
        iw = words(item)
        n = min(10, len(iw))
        for j in range(len(iw) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i:i + n] == iw[j:j + n]:
                    hit.update(range(i, i + n))
                    found.add(k)
    return len(w), len(hit), found


def test_decontaminate_is_exact(spark, monkeypatch):
    t = texts()
    items = [(1, " ".join(t[11].split()[5:30])), (2, "One"), (3, "café 😀"), (4, None), (5, " , "), (6, t[20 + 5]), (12, "one TWO"), (None, "one"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, extra=True)
    for size in (8_000_000, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found = decontaminate.find_items(spark, d, bench).select("row.doc_id", "n_words", decontaminate.n_hit().alias("n"), "items")
        got = {r["doc_id"]: r for r in found.dropDuplicates(["doc_id"]).collect()}
        for i, x in enumerate(t):
            want = brute_hits(x, [k for k in items if k[0] is not None]) if len(x or "") < 20000 else None
            if want:
                assert (got[i]["n_words"], got[i]["n"], set(got[i]["items"])) == want, i
    kept = decontaminate.remove_hits(spark, d, bench)
    assert kept.columns == d.columns and kept.count() < d.count()
    named = bench.selectExpr("concat('q', item_id) as item_id", "text")
    assert {r[0] for r in decontaminate.find_items(spark, d, named).select(F.explode("items")).collect()} == {f"q{r[0]}" for r in decontaminate.find_items(spark, d, bench).select(F.explode("items")).collect()}
    assert decontaminate.remove_hits(spark, d, empty(spark, "item_id long, text string")).count() == d.count()
    assert decontaminate.find_items(spark, empty(spark), bench).count() == 0


def test_chat_round_trip(spark, tmp_path):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\s>", "[\\/INST] <<SYS>> \\", "", None, "日本 😀\n\n", "{\"a\": [1]} \\n \t \u0001", "x" * 20000]
    rows = [(1, i, ["user", "assistant", "tool\nx", None][i % 4], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "first"), (None, 1, "user", "q")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", nasty[0]), (-7, 1, "assistant", nasty[0])]
    by = defaultdict(list)
    for c, n, role, t in rows:
        by[c].append((n is not None, n or 0, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_layouts_share_a_canonical_form(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"},
        {"prompt": "q", "response": "a", "system": ""},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{bad",), (None,), ('{"z": 1}',)], "record string")
    out = chat.format_records(df).collect()
    assert {tuple((t["role"], t["text"]) for t in r["turns"]) for r in out[:7]} == {(("user", "q"), ("assistant", "a"))}
    assert [r["turns"] for r in out[7:]] == [None] * 3
    assert len({r["formatted"] for r in out[:7]}) == 1


def test_mixing_counts_and_order(spark):
    d = docs(spark, extra=True)
    out = mixing.mix(d)
    assert out.columns[: len(d.columns)] == d.columns
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    big = spark.range(20000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 40)) as source")
    n = Counter(r[0] for r in mixing.mix(big, {"hot": 1.0, "s1": 3.0}).select("source").collect())
    assert set(n) == {"hot", "s1"} and abs(n["hot"] - 5000) < 400 and abs(n["s1"] - 15000) < 600
    again = mixing.mix(big, {"hot": 1.0, "s1": 3.0}).select("doc_id", "copy_no", "shuffle_key")
    assert again.exceptAll(mixing.mix(big.repartition(7), {"hot": 1.0, "s1": 3.0}).select("doc_id", "copy_no", "shuffle_key")).count() == 0
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_large_mean(spark):
    d = spark.range(3).selectExpr("id as doc_id", "if(id = 0, 'rare', 'x') as source").unionByName(spark.range(3, 3000).selectExpr("id as doc_id", "'x' as source"))
    n = mixing.mix(d, {"rare": 1.0}).count()
    assert 2700 < n < 3300


def test_chat_rows_beyond_the_json_parser(spark):
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("human").alias("role"), F.expr("if(id = 0, repeat('x', 21000000), 'y')").alias("text"))
    got = chat.format_rows(rows).select(F.size("turns"), F.length(F.col("turns")[0]["text"]), "turns.role").first()
    assert tuple(got) == (2, 21_000_000, ["user", "user"])
    try:
        chat.format_records(chat.records_from_rows(rows)).select(F.size("turns")).collect()
    except Exception as e:
        assert "limits of the JSON parser" in str(e)
    else:
        raise AssertionError("a lost record")
