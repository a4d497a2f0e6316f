"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    vocab = [f"w{i}x" for i in range(size)]
    return [rng.choice(vocab) for _ in range(n)]


def texts(seed=1):
    rng = random.Random(seed)
    base = words(rng, 60)
    near = list(base)
    near[30] = "changed"
    passage = " ".join(words(rng, 40))
    out = [
        None, "", "   \n\t ", "one", "one two three", " ".join(base), " ".join(base), " ".join(near),
        "The of AND to. " * 30, " ".join(words(rng, 3000, 50)), "a\nb\n\nb\na \na\n" + passage,
        passage + " " + " ".join(words(rng, 50)), " ".join(words(rng, 30)) + "\n" + passage + "\n" + " ".join(words(rng, 30)),
        "naïve café 😀 été " * 12, "mail me: bob@site.org or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.1 " + " ".join(words(rng, 20)),
        "😀 x@y.z_a@b.co 1.2.3.4.5.6.7.8 999.1.1.1 4111-1111-1111-1112 +12 34 +1.2.3.4.5.6.7.8.9", "<b>$$ ## ** | <| & %</b> " * 10,
        "x" * 50000, "1" * 40000, "a.b-" * 8000 + "@" + "c.d" * 3000, "bullet\n* a\n- b\n• c...\n…\n" * 5,
    ]
    for i in range(40):
        out.append(" ".join(words(rng, rng.randint(5, 120))))
    return out


def docs(spark, seed=1, extra=False):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 5 else "hot", len(t or "")) for i, t in enumerate(texts(seed))]
    rows += [(None, "null id text here with some words in it", "en", None, None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as n_words", "2 as kept", "3 as row", "text as h", "doc_id as id", "4 as component_id") if extra else df


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], T._parse_datatype_string(schema))
