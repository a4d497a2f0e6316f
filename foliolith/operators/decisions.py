"""Aggregates of check results: scores, verdicts, batch tallies, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolith.functions import values as V
from foliolith.operators.rules import CATEGORIES

ISSUES = ("failed", "missing")
SCORED = ("passed", "failed", "missing")


def counters() -> list[Column]:
    """Aggregates: passed, failed, missing, not_applicable, blocking, warnings."""
    status, severity = F.col("status"), F.col("severity")
    issue = status.isin(*ISSUES)
    return [
        *[F.count_if(status == s).alias(s) for s in ("passed", "failed", "missing", "not_applicable")],
        F.count_if(issue & (severity == "blocking")).alias("blocking"), F.count_if(issue & (severity == "warning")).alias("warnings"),
    ]


def score(empty: int = 100) -> Column:
    """Share of passed among scored results, in percent, halves to even."""
    return V.percent(F.col("passed"), F.col("passed") + F.col("failed") + F.col("missing"), empty)


def verdict(reject_blocking: Column, reject_warning: Column, min_score: Column) -> Column:
    return (
        F.when(reject_blocking & (F.col("blocking") > 0), "rejected").when(reject_warning & (F.col("warnings") > 0), "rejected")
        .when(F.coalesce(F.col("score") < min_score, F.lit(False)), "rejected").when(F.col("warnings") > 0, "needs_review").otherwise("accepted")
    )


def assess(results: DataFrame, policies: DataFrame | dict, keys: list[str] = ("paper_id",)) -> DataFrame:
    """One row a paper: counters, score, verdict, the first blocking names, a summary line.
    ``policies``: paper_id, reject_blocking, reject_warning, min_score (a missing row or field takes
    the default), or one policy for all as a dict. ``keys``: paper_id and what goes with it."""
    reasons = F.filter(F.sort_array(F.collect_list(F.when(F.col("status").isin(*ISSUES) & (F.col("severity") == "blocking"), F.struct("ord", "name")))), lambda x: x.isNotNull())
    a = results.groupBy(*keys).agg(*counters(), F.transform(F.slice(reasons, 1, 3), lambda x: x["name"]).alias("reasons"))
    a = a.withColumn("score", score())
    if isinstance(policies, dict):
        kinds = {"reject_blocking": "boolean", "reject_warning": "boolean", "min_score": "int"}
        a = a.withColumns({k: F.lit(policies.get(k)).cast(t) for k, t in kinds.items()})
    else:
        a = a.join(policies, "paper_id", "left")
    v = verdict(F.coalesce("reject_blocking", F.lit(True)), F.coalesce("reject_warning", F.lit(False)), F.col("min_score"))
    a = a.withColumn("verdict", v).drop("reject_blocking", "reject_warning", "min_score")
    more = F.when(F.col("blocking") > 3, F.format_string(" (+%d more)", F.col("blocking") - 3)).otherwise("")
    line = (
        F.when(F.col("verdict") == "accepted", F.format_string("Accepted: all %d requirements satisfied.", F.col("passed") + F.col("failed") + F.col("missing")))
        .when(F.col("verdict") == "rejected", F.concat(F.format_string("Rejected: %d blocking issues: ", "blocking"), F.array_join("reasons", ", "), more))
        .otherwise(F.format_string("Accepted with %d warnings.", "warnings"))
    )
    return a.withColumn("summary", line)


def batch_tally(assessments: DataFrame, batch: str = "batch_id") -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return assessments.groupBy(batch).agg(F.count("*").alias("total"), n("accepted"), n("rejected"), n("needs_review"))


def batch_cap(df: DataFrame, batch: str, order: str, most: int = 200) -> DataFrame:
    """The first rows of each batch: the limit is the feature."""
    w = Window.partitionBy(batch).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def anonymity_score(facts: Column) -> Column:
    """100 less ten for each leak by weight."""
    i = facts["identity"]
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    names = F.exists(F.map_keys(i["leaks"]), lambda k: k.isin("author", "creator"))
    parts = [(i["author_block"], 3), (some(i["emails"]), 3), (some(i["affiliations"]), 2), (i["acknowledgement"], 2), (i["funding"], 1), (some(i["orcids"]), 1), (names, 1)]
    leaks = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for c, w in parts), F.lit(0))
    return F.greatest(F.lit(0), 100 - F.least(F.lit(100), leaks * 10))


def validation_status(verdict: Column, readable: Column, warnings: Column) -> Column:
    return (
        F.when(~readable, "unable_to_validate").when(verdict == "rejected", "failed")
        .when((verdict == "needs_review") | (warnings > 0), "passed_with_warnings").otherwise("passed")
    )


def by_category(results: DataFrame) -> DataFrame:
    """Results of each paper by category, in the order of the report."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    g = results.groupBy("paper_id", "category").agg(*counters())
    return g.withColumn("ord", F.when(order > 0, order).otherwise(len(CATEGORIES) + 1))


def next_number(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The next free number of each group."""
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))
