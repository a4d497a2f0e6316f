"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.llm.util import small_batches

#: Hashed features of runs of 1 to ORDER characters.
DIM = 1 << 14
ORDER = 3
#: Labelled rows that are drawn for each language, by a hash of their id; the fit sees
#: this bounded sample (as many as expected, give or take a few), document frequencies all
#: training rows.
SAMPLE = 600
#: Of the sample, the part that sets the temperature.
CALIBRATION = 0.2
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Letters in lower case, everything else one space."""
    return " " + _OTHER.sub(" ", (text or "").lower()).strip() + " "


def counts(clean: str) -> np.ndarray:
    """How often each feature occurs in a cleaned text."""
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = np.zeros(DIM, np.int64), np.zeros(len(c), np.uint64)
    for n in range(1, ORDER + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out += np.bincount((x >> np.uint64(50)).astype(np.int64), minlength=DIM)
    return out


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each feature and the number of documents, over all rows."""

    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                df += counts(letters(text)) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], df]))], names=["feature", "n"])

    out = np.zeros(DIM + 1, np.int64)
    for feature, n in rows.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n")).collect():
        out[feature + 1] = n
    return out[1:], int(out[0])


def _tfidf(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(c) * idf
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return (x / np.maximum(norm, 1e-12)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> np.ndarray:
    """Weights (features + bias, classes) by follow-the-regularised-leader, elastic net."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for index, value, label in samples:
            at, x = np.append(index, DIM), np.append(value, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(DIM + 1))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes held-back labels most likely."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 80))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, w: np.ndarray, t: float):
        self.languages, self.idf, self.w, self.t = languages, idf.astype(np.float32), w.astype(np.float32), t

    def logits(self, c: np.ndarray) -> np.ndarray:
        return _tfidf(c, self.idf) @ self.w[:-1] + self.w[-1]


def train(docs: DataFrame, learn: Column) -> Model | None:
    """A model of the rows for which ``learn`` is true and lang is set; None without any."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.coalesce(text, F.lit("")).rlike("\\p{L}"))
    rows = rows.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not known:
        return None
    languages = sorted(r[0] for r in known)
    df, total = _frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[F.lit(x) for r in known for x in (r[0], min(1.0, SAMPLE / r[1]))])
    drawn = rows.withColumn("u", u).withColumn("rate", F.try_element_at(rate, F.col("lang"))).filter("u < rate")
    # Rows that share an id are drawn together; one of them stays, so the draw is bounded.
    drawn = drawn.groupBy("doc_id", "lang", (F.col("u") / F.col("rate")).alias("u")).agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            at, value = [], []
            for t in b.column(0).to_pylist():
                x = _tfidf(counts(letters(t)), idf)
                i = np.flatnonzero(x)
                at.append(i.astype(np.int32).tobytes())
                value.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(value, pa.binary()), b.column(1), b.column(2)], names=["i", "x", "lang", "u"])

    features = drawn.select("text", "lang", "u").mapInArrow(run, "i binary, x binary, lang string, u double")
    data = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["x"], np.float32), languages.index(r["lang"]), r["u"]) for r in sorted(features.collect(), key=lambda r: (r["u"], r["lang"], r["i"]))]
    back = [d for k, d in enumerate(data) if k % round(1 / CALIBRATION) == 1]
    w = ftrl([d[:3] for k, d in enumerate(data) if k % round(1 / CALIBRATION) != 1], len(languages))
    logits = np.array([x @ w[i] + w[-1] for i, x, _, _ in back]).reshape(-1, len(languages))
    return Model(languages, idf, w, temperature(logits, np.array([d[2] for d in back], np.int64)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the calibrated chance of that language.

    Whole texts count; lang, source and doc_id don't. A text that is null or has no letters
    is ``und`` with score 0, as is everything without a model. A narrow projection; columns
    of the added names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bc = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        m = bc.value
        for b in batches:
            clean = [letters(t) for t in b.column("__text").to_pylist()]
            lang, score = ["und"] * len(clean), [0.0] * len(clean)
            some = [i for i, t in enumerate(clean) if t.strip()] if m else []
            if some:
                p = _softmax(m.logits(np.stack([counts(clean[i]) for i in some]).astype(np.float32)).astype(np.float64) / m.t)
                for i, row in zip(some, p, strict=True):
                    best = int(row.argmax())
                    lang[i], score[i] = m.languages[best], float(row[best])
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*names).alias("__row"), F.col("text").cast("string").alias("__text"))
    out = rows.mapInArrow(run, f"row {rows.schema['__row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in names], "lang_pred", "score")


def identify(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """Learns from the rows chosen by ``learn`` and predicts every row."""
    return predict(docs, train(docs, learn))
