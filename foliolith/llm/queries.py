"""The queries of this package and, where SQL expresses them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.llm import chat, decontaminate, html, langid, lm, mixing, neardup, oracles, pii, quality, suffix
from foliolith.llm.util import crc_mod, load


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data of ``documents``: base spans by kind and disclosing terms."""
    s = pii.all_spans(spark, load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    base, terms = pii.span_text(F.col("base")), pii.span_text(F.col("terms"), F.lit("term"))
    return s.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.array_remove(F.array(base, terms), ""), ",").alias("spans"),
        F.size("terms").cast("bigint").alias("n_terms"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdict of the quality rules for every row of ``documents``."""
    d = quality.assess(load(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on shingles of 4 words."""
    d = neardup.link(spark, load(spark, sf_dir, "documents"), words=4, percent=80)
    return d.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of ``documents``."""
    d = suffix.repeated(spark, load(spark, sf_dir, "documents"))
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["ends"] - x["starts"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts of ``documents`` by a model of those that aren't held out."""
    s = lm.score(spark, load(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 1)
    return s.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    d = html.extract(spark, load(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from those that aren't held out."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    d = langid.identify(spark, load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held)
    return d.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted and read back."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    f = chat.format_rows(rows.unionByName(extra))
    f = f.withColumn("back", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("back")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows that occur in each row of ``documents``."""
    found = decontaminate.find_items(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    n = decontaminate.n_hit()
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` repeated to the target weights, globally shuffled, whole rows."""
    return mixing.mix(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_quality": op2_quality,
        "op3_neardup": op3_neardup,
        "op4_suffix": op4_suffix,
        "op5_lm": op5_lm,
        "op6_html": op6_html,
        "op7_langid": op7_langid,
        "op8_chat": op8_chat,
        "op9_decontaminate": op9_decontaminate,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
