"""Language ID: accuracy on rows it hasn't learned from, and awkward rows."""

import random

import numpy as np
from foliolith.llm import langid
from foliolith.llm.util import crc_mod
from pyspark.sql import functions as F

from .fixtures import docs, empty

PARTS = {"en": "th the ing tion and er st", "de": "sch ung ein der keit ü ß", "fr": "eau que oi é aux ment ç"}


def corpus(spark, n=600):
    rng, rows = random.Random(3), []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        parts = PARTS[lang].split()
        rows.append((i, " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_calibration(spark):
    d = corpus(spark)
    held = crc_mod(F.col("doc_id"), 4) == 2
    out = langid.identify(spark, d, ~held).filter(held).collect()
    right = np.array([r["lang"] == r["lang_pred"] for r in out])
    score = np.array([r["score"] for r in out])
    assert len(out) > 80 and right.mean() > 0.97
    assert abs(score.mean() - right.mean()) < 0.1 and score.min() >= 0 and score.max() <= 1


def test_lang_is_no_input_and_results_repeat(spark):
    d = corpus(spark, 300)
    m = langid.train(d, F.col("doc_id") % 2 == 0)
    a = langid.predict(d, m).select("doc_id", "lang_pred", "score")
    b = langid.predict(d.withColumn("lang", F.lit("zz")), langid.train(d.repartition(5), F.col("doc_id") % 2 == 0)).select("doc_id", "lang_pred", "score")
    assert a.exceptAll(b).count() == 0


def test_weights_are_sparse(spark):
    m = langid.train(corpus(spark, 300), F.lit(True))
    assert (m.w == 0).mean() > 0.5


def test_awkward_rows(spark):
    d = docs(spark, extra=True)
    out = langid.identify(spark, d, F.lit(True))
    assert out.count() == d.count()
    assert {r[0] for r in out.filter("text is null or text rlike '^[^a-zA-Z]*$'").select("lang_pred").collect()} == {"und"}
    assert langid.identify(spark, d, F.lit(False)).filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert langid.identify(spark, empty(spark), F.lit(True)).count() == 0
