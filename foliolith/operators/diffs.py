"""Snapshot diffs and the labelled-corpus evaluator: full outer joins and set operations."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolith.operators.decisions import ISSUES

COMPARED = ("status", "severity", "expected", "actual", "confidence")
# Limits of a text comparison.
MAX_CHARS, MAX_LINES, MAX_LINE, MAX_HUNKS, CONTEXT = 100_000, 1500, 2000, 100, 3


# The facts that two checks of a paper are compared by.
PROPERTIES = (
    "layout.page_count", "layout.page_count_exact", "layout.page_count_confidence", "layout.page_size_label", "layout.columns", "layout.margins_pt", "layout.margins_confidence",
    "typography.body_font", "typography.body_font_size_pt", "structure.title_text", "structure.author_block_text", "structure.sections_present", "structure.headings",
    "structure.reference_entry_count", "structure.reference_count_confidence", "structure.total_word_count", "assets.figures", "assets.tables", "assets.confidence",
    "identity.acknowledgement_present", "latex.document_class",
)


def compare_findings(base: DataFrame, target: DataFrame, keys: list[str], rule: str = "id") -> DataFrame:
    """One row for each rule that is an issue on either side: resolved, remaining,
    newly_reported or not_evaluated, with the fields that changed.

    Groups whose ids repeat or are empty on a side are unavailable: one row without a rule.
    One full outer join on the group and rule.
    """
    from pyspark.sql import Window

    every = Window.partitionBy(*keys, rule)
    odd = (F.count("*").over(every) > 1) | F.col(rule).isNull() | (F.col(rule) == "")
    marked = lambda df: df.withColumn("__odd", odd)
    base, target = marked(base), marked(target)
    bad = base.filter("__odd").select(*keys).unionByName(target.filter("__odd").select(*keys)).distinct()
    side = lambda df, s: df.join(bad, keys, "left_anti").select(*keys, rule, F.lit(True).alias(f"{s}"), *[F.col(c).alias(f"{s}_{c}") for c in COMPARED])
    j = side(base, "old").join(side(target, "new"), [*keys, rule], "full_outer")
    was, now = F.coalesce(F.col("old_status").isin(*ISSUES), F.lit(False)), F.coalesce(F.col("new_status").isin(*ISSUES), F.lit(False))
    state = F.when(was & now, "remaining").when(now, "newly_reported").when(F.col("new_status") == "passed", "resolved").otherwise("not_evaluated")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    changed = F.array_compact(F.array(*[F.when(both & ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), c) for c in COMPARED]))
    out = j.filter(was | now).select(*keys, F.col(rule), state.alias("state"), "old_status", "new_status", F.array_join(changed, ",").alias("changed_fields"))
    return out.unionByName(bad.withColumn("state", F.lit("unavailable")), allowMissingColumns=True)


def comparison_warnings(rules: Column, engine: Column, fmt: Column) -> Column:
    """Warnings where rules, engine versions or formats of the two sides differ (conditions)."""
    return F.array_compact(F.array(F.when(rules, "rules differ"), F.when(engine, "engine versions differ"), F.when(fmt, "formats differ")))


def compare_properties(base: DataFrame, target: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a field: unchanged, changed, or unavailable where either side has no value."""
    def flat(df, s):
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
        return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.field", F.col("x.v").alias(s))

    j = flat(base, "before").join(flat(target, "after"), [*keys, "field"])
    state = F.when(F.col("before").isNull() | F.col("after").isNull(), "unavailable").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return j.withColumn("state", state)


def compare_facts(base: DataFrame, target: DataFrame, keys: list[str], facts_json: str = "facts") -> DataFrame:
    """One row for each of PROPERTIES of two stored checks, whose facts are JSON texts; checks
    without facts on either side are left out, as unavailable."""
    side = lambda df, s: df.filter(F.col(facts_json).isNotNull()).select(*keys, F.col(facts_json).alias(s))
    # Whole texts meet once, before there is a row a property; both sides are tables of stored
    # checks, so neither is sent to the driver.
    j = side(base, "__b").join(side(target, "__t").hint("merge"), keys)
    value = lambda s, p: F.get_json_object(s, f"$.{p}")
    cells = F.array(*[F.struct(F.lit(p).alias("field"), value("__b", p).alias("before"), value("__t", p).alias("after")) for p in PROPERTIES])
    j = j.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.field", "x.before", "x.after")
    state = F.when(F.col("before").isNull() | F.col("after").isNull(), "unavailable").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return j.withColumn("state", state)


def stripped(rules_json: Column) -> Column:
    """A group of rules as a map without what is empty or default: nulls, {} and []."""
    return F.map_filter(F.from_json(rules_json, "map<string,string>"), lambda k, v: v.isNotNull() & ~v.isin("null", "{}", "[]"))


def text_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, before, after) of stored files (before and after: content, sha256, size), each
    read only if it is what was stored; ``intact`` tells."""
    ok = lambda s: (F.sha2(f"{s}.content", 256) == F.col(f"{s}.sha256")) & (F.length(f"{s}.content") == F.col(f"{s}.size"))
    intact = F.coalesce(ok("before") & ok("after"), F.lit(False))
    text = lambda s: F.when(intact, F.regexp_replace(F.col(f"{s}.content").cast("string"), "\r\n?", "\n"))
    return pairs.select("pair_id", intact.alias("intact"), text("before").alias("before"), text("after").alias("after"))


def compare_rules(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, group, field, value) of two rule sets: added, removed, changed, unchanged."""
    b = base.select(*keys, "group", "field", F.col("value").alias("before"), F.lit(True).alias("b"))
    t = target.select(*keys, "group", "field", F.col("value").alias("after"), F.lit(True).alias("t"))
    state = F.when(F.col("b").isNull(), "added").when(F.col("t").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return b.join(t, [*keys, "group", "field"], "full_outer").select(*keys, "group", "field", "before", "after", state.alias("state"))


def rule_rows(df: DataFrame, keys: list[str], rules_json: str) -> DataFrame:
    """A JSON rule set as (keys, group, field, value) rows; nulls, as defaults, are left out."""
    groups = F.from_json(rules_json, "map<string,string>")
    g = df.select(*keys, F.explode(groups).alias("group", "body"))
    fields = F.coalesce(F.from_json("body", "map<string,string>"), F.create_map(F.lit("value"), F.col("body")))
    return g.select(*keys, "group", F.explode(F.map_filter(fields, lambda k, v: v.isNotNull())).alias("field", "value"))


def summarise_changes(diff: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """One line: the groups with most changes."""
    n = diff.filter("state <> 'unchanged'").groupBy(*keys, "group").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "group", "n")))
    line = F.array_join(F.transform(F.slice(order, 1, top), lambda x: F.concat(x["group"], F.lit(": "), x["n"].cast("string"))), ", ")
    return n.groupBy(*keys).agg(line.alias("summary"), F.sum("n").alias("changes"))


def text_diff(pairs: DataFrame) -> DataFrame:
    """(pair_id, hunk, header, lines) of (pair_id, before, after): grouped hunks with context.
    Texts beyond the limits give one row that says so. Line alignment is sequential, so it
    runs per pair in Arrow batches; no row leaves its partition."""

    def run(batches):
        for pdf in batches:
            out = []
            for pid, a, b in zip(pdf["pair_id"], pdf["before"], pdf["after"], strict=True):
                a, b = a or "", b or ""
                x, y = a.splitlines(), b.splitlines()
                if max(len(a), len(b)) > MAX_CHARS or max(len(x), len(y)) > MAX_LINES:
                    out.append((pid, -1, "too large", ""))
                    continue
                x, y = [s[:MAX_LINE] for s in x], [s[:MAX_LINE] for s in y]
                match = difflib.SequenceMatcher(None, x, y, autojunk=False)
                for k, ops in enumerate(match.get_grouped_opcodes(CONTEXT)):
                    if k == MAX_HUNKS:
                        out.append((pid, k, "more", ""))
                        break
                    lines = []
                    for tag, i, i2, j, j2 in ops:
                        if tag == "equal":
                            lines += [" " + s for s in x[i:i2]]
                        else:
                            lines += ["-" + s for s in x[i:i2]] + ["+" + s for s in y[j:j2]]
                    out.append((pid, k, f"{ops[0][1]},{ops[-1][2]} {ops[0][3]},{ops[-1][4]}", "\n".join(lines)))
            yield pd.DataFrame(out, columns=["pair_id", "hunk", "header", "lines"])

    return pairs.select("pair_id", "before", "after").mapInPandas(run, "pair_id bigint, hunk int, header string, lines string")


def evaluate_fixtures(expected: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, outcome): detected, missed or false_positive, by one full outer join."""
    e = expected.select(*keys, "rule").distinct().withColumn("e", F.lit(True))
    f = failed.select(*keys, "rule").distinct().withColumn("f", F.lit(True))
    outcome = F.when(F.col("e").isNull(), "false_positive").when(F.col("f").isNull(), "missed").otherwise("detected")
    return e.join(f, [*keys, "rule"], "full_outer").select(*keys, "rule", outcome.alias("outcome"))


def rule_report(outcomes: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("rule").agg((n("detected") + n("missed")).alias("planted"), n("detected").alias("detected"), n("missed").alias("missed"), n("false_positive").alias("false_positives"))


def corpus_report(verdicts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: verdict agreement and detection rate to four places; 1.0 where nothing counts."""
    a = verdicts.agg(F.coalesce(F.round(F.avg((F.col("expected") == F.col("actual")).cast("double")), 4), F.lit(1.0)).alias("agreement"), F.count("*").alias("fixtures"))
    d = outcomes.agg(F.count_if(F.col("outcome") == "detected").alias("d"), F.count_if(F.col("outcome") != "false_positive").alias("p"), F.count_if(F.col("outcome") == "false_positive").alias("false_positives"))
    d = d.select(F.when(F.col("p") > 0, F.round(F.col("d") / F.col("p"), 4)).otherwise(1.0).alias("detection"), "false_positives")
    return a.crossJoin(d)  # two rows of totals
