"""From files or text spans to verdicts: the whole path of a batch as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolith.functions import values as V
from foliolith.operators import decisions, facts, rules, structure


def doc_id(path):
    return F.xxhash64(path)


def sections_of(parsed: DataFrame) -> DataFrame:
    """The classified sections of parsed files (see sources.files.parse_files)."""
    blocks = parsed.filter("blocks is not null").select(doc_id("path").alias("doc_id"), F.inline("blocks"))
    return structure.classify_blocks(blocks)


def info_of(parsed: DataFrame, sections: DataFrame) -> DataFrame:
    """What facts.assemble asks of each file; pages of sources are estimated, but for
    documents in Google's form, which have none."""
    i = lambda c: F.col(f"info.{c}").alias(c)
    d = parsed.select(
        doc_id("path").alias("doc_id"), "filename", F.coalesce(V.extension(F.col("filename")), F.lit("")).alias("extension"), "format", "size", "sha256", "error",
        *[i(c) for c in ("width", "height", "orientation", "columns", "top", "bottom", "left", "right", "title", "anonymous_package")],
        V.page_label(F.col("info.width"), F.col("info.height")).alias("label"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    page = d.filter("width is not null").select("doc_id", "width", "height", "left", "right", "top", "bottom")
    pages = structure.estimate_pages(sections, page)
    return d.join(pages, "doc_id", "left").withColumn("page_count", F.when(F.col("format") != "gdoc", F.col("pages"))).withColumn("page_count_exact", F.lit(False)).drop("pages")


def span_info(spans: DataFrame, files: DataFrame) -> DataFrame:
    """The same for documents given as text spans; ``files``: doc_id, filename, size, sha256,
    metadata. One without spans has no readable text."""
    d = files.join(structure.document_info(spans), "doc_id", "left")
    return d.select(
        "doc_id", "filename", F.coalesce(V.extension(F.col("filename")), F.lit("")).alias("extension"), F.lit("pdf").alias("format"), "size", "sha256",
        F.when(F.col("page_count").isNull(), "no extractable text").alias("error"), "width", "height", "orientation", "columns", "top", "bottom", "left", "right",
        F.coalesce(F.try_element_at("metadata", F.lit("title")), F.lit("")).alias("title"), F.lit(False).alias("anonymous_package"), "label", "metadata",
        "page_count", F.lit(True).alias("page_count_exact"),
    )


def results(assembled: DataFrame, rule_sets: DataFrame, rules_id: str = "house") -> DataFrame:
    """The check results of assembled facts under one rule set; unreadable files have one row."""
    papers = assembled.select(F.col("doc_id").alias("paper_id"), F.lit(rules_id).alias("rules_id"), "facts", "error")
    return rules.check_results(rules.with_rules(papers, rule_sets))


def check_batch(sections: DataFrame, info: DataFrame, rule_sets: DataFrame, rules_id: str = "house") -> DataFrame:
    """One assessment a paper, with its file's name, error and validation status."""
    checked = results(facts.assemble(sections, info), rule_sets, rules_id)
    policy = rule_sets.filter(F.col("rules_id") == rules_id).select("rules.decision.*")
    names = info.select(F.col("doc_id").alias("paper_id"), "filename", "error")
    # The policy of one rule set is one row.
    out = decisions.assess(checked, names.select("paper_id").join(F.broadcast(policy))).join(names, "paper_id")
    status = decisions.validation_status(F.col("verdict"), F.col("error").isNull(), F.col("warnings"))
    score = F.when(F.col("error").isNotNull(), 0).otherwise(F.col("score"))
    return out.withColumn("validation", status).withColumn("score", score)


def check_files(parsed: DataFrame, rule_sets: DataFrame, rules_id: str = "house") -> DataFrame:
    sections = sections_of(parsed)
    return check_batch(sections, info_of(parsed, sections), rule_sets, rules_id)


def skipped(listing: DataFrame, usable: DataFrame, key: str = "path") -> DataFrame:
    """Files of a listing that aren't checked."""
    return listing.join(usable, key, "left_anti")


def failed_rules(checked: DataFrame) -> DataFrame:
    """(paper_id, rule): what the evaluator compares with the flaws that were planted."""
    return checked.filter(F.col("status").isin(*decisions.ISSUES)).select("paper_id", F.col("id").alias("rule")).distinct()
