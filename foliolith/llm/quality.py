"""Quality rules: one projection of length, symbol, stop-word and line measures against a table of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolith.llm.util import SPACE, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il "
    "el y los del se las por con no una su para es al lo como más pero sus"
).split()

#: (measure, least, most); a document is kept if every measure lies within its bounds.
#: Measures with a zero denominator are null and pass.
THRESHOLDS = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.3),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("letter_word_ratio", 0.5, None),
    ("ellipsis_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by windows of WINDOW words that occur at least twice in the text.

    A hash of every window tells whether any can repeat; only then are the window texts
    sorted, so the count is exact. Linear but for that sort.
    """
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    any_twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def positions(s: Column) -> Column:
        text = lambda j: F.get(s, j)["w"]
        twice = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: (text(j).eqNullSafe(text(j - 1))) | (text(j).eqNullSafe(text(j + 1))),
        )
        return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1),
            F.lit(0).cast("bigint"),
            lambda acc, j: acc + F.coalesce(
                F.least(F.lit(WINDOW), F.get(p, j + 1) - F.get(p, j)), F.lit(WINDOW)
            ).cast("bigint"),
        )

    windows = F.transform(
        starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i"))
    )
    exact = let(
        let(F.sort_array(windows), positions),
        lambda p: F.when(F.size(p) > 0, covered(p)).otherwise(F.lit(0).cast("bigint")),
    )
    return F.when(n <= WINDOW, F.lit(0).cast("bigint")).when(any_twice, exact).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of the contract and one column for each measure of THRESHOLDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    many = lambda cond: F.size(F.filter(F.col("__lines"), cond)).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b)
    stop = F.size(F.filter(F.col("__words"), lambda w: F.lower(w).isin(*STOP_WORDS)))
    letters = F.size(F.filter(F.col("__words"), lambda w: w.rlike("\\p{L}")))
    n, n_lines = F.col("n_words"), F.size("__lines")
    return (
        docs.withColumn("__words", words_of(F.col("text")))
        .withColumn("__lines", lines)
        .withColumn("n_words", F.size("__words").cast("bigint"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_dup_lines", (n_lines - F.size(F.array_distinct("__lines"))).cast("bigint"))
        .withColumn("n_repeat_words", _repeat_words(F.col("__words"), F.size("__words")))
        .withColumn("mean_word_chars", ratio(F.col("word_chars"), n))
        .withColumn("symbol_ratio", ratio(F.col("n_symbols"), n))
        .withColumn("stop_ratio", ratio(stop, n))
        .withColumn("dup_line_ratio", ratio(F.col("n_dup_lines"), n_lines))
        .withColumn("letter_word_ratio", ratio(letters, n))
        .withColumn("ellipsis_line_ratio", ratio(many(lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$")), n_lines))
        .withColumn("bullet_line_ratio", ratio(many(lambda x: x.rlike("^[\\x20\\x09]*[•*-]")), n_lines))
    )


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table compiled into one condition."""
    ok = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            ok = ok & F.coalesce(F.col(name) >= least, F.lit(True))
        if most is not None:
            ok = ok & F.coalesce(F.col(name) <= most, F.lit(True))
    return ok


MEASURES = [t[0] for t in THRESHOLDS if t[0] != "n_words"]


def assess(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with counts, measures, ``base_failed`` and ``kept``.

    One narrow projection: no shuffle, so neither skew nor copies matter. A null text is
    an empty one: no words, base_failed. Repeated rows are judged alike; columns of docs
    that have an added column's name are replaced.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measures(docs).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(thresholds)).drop("__words", "__lines")


def filter_quality(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns only."""
    names = docs.columns
    judged = assess(docs.select(F.col("text"), F.struct(*names).alias("__row")), thresholds)
    # A plain filter would be pushed below the measures and repeat them in its condition.
    keep = judged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row"))
    return keep.select("__row.*")
