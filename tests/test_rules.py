"""Every rule seen to pass and to fail; rules that speak only sometimes seen to be silent."""

import json

import pytest
from foliolith.operators import decisions, rules
from pyspark.sql import functions as F

GOOD = {
    "file": {"filename": "a.pdf", "extension": "pdf", "format": "pdf", "size_bytes": 1000},
    "layout": {"page_count": 8, "page_count_exact": True, "width": 595.0, "height": 842.0, "page_size_label": "A4", "orientation": "portrait", "columns": 2, "margins": {"top": 72, "bottom": 72, "left": 72, "right": 72}},
    "typography": {"dominant_font": "Times", "body_font": "Times", "body_font_size_pt": 10, "title_font_size_pt": 14, "heading_font_size_pt": 12, "line_spacing": 1.0, "first_line_indent_pt": 12, "space_above_pt": 0, "space_below_pt": 0, "sizes": [10.0, 9.0], "alignments": {"justified": 10}},
    "structure": {"title_text": "T", "sections": ["Introduction", "References"], "headings": ["1 Introduction"], "has_abstract": True, "abstract_words": 100, "has_keywords": True, "references": 12, "author_text": ""},
    "identity": {"author_block": False, "emails": [], "affiliations": [], "orcids": [], "acknowledgement": False, "funding": False, "self_citations": 0, "placeholder": True, "leaks": {}},
}
FMT = {"font_family": "Times", "font_size_pt": 10.0, "bold": False, "alignment": "justified"}
RULES = {
    "file_type": {"accepted": ["pdf"], "max_mb": 1.0, "allow_source": False, "require_source": True},
    "pages": {"max_pages": 8, "min_pages": 4, "page_size_label": "a4", "orientation": "portrait", "columns": 2, "margins": {"top": 72, "bottom": 72, "left": 72, "right": 72}},
    "sections": {"required": ["Introduction", "Abstract"], "forbidden": ["Appendix"], "abstract_max_words": 150, "keywords_required": True, "min_references": 10, "canonical_names": True},
    "anonymisation": {"required": True, "self_citation": True, "terms": ["acme"]},
    "typography": {"title": {**FMT, "font_size_pt": 14.0}, "headings": {**FMT, "font_size_pt": 12.0}, "abstract": FMT, "body": FMT, "min_size": 9.0, "max_size": 12.0},
    "paragraph": {"line_spacing": 1.0, "indent_first_line_pt": 12.0, "space_above_pt": 0.0, "space_below_pt": 0.0, "justified": True, "uniform": True, "max_mismatches": 0},
}
BREAKS = [
    ({"file": {"extension": None}}, "file.extension_present", "failed"), ({"file": {"extension": "doc"}}, "file.extension_accepted", "failed"), ({"file": {"size_bytes": 2 << 20}}, "file.size", "failed"),
    ({"file": {"format": "latex"}}, "file.source_allowed", "failed"), ({"layout": {"page_count": 9}}, "page.limit", "failed"), ({"layout": {"page_count": 3}}, "page.limit", "failed"), ({"layout": {"page_count": None}}, "page.limit", "not_applicable"),
    ({"layout": {"page_size_label": "Letter", "width": 612.0, "height": 792.0}}, "layout.page_size", "failed"), ({"layout": {"orientation": "landscape"}}, "layout.orientation", "failed"), ({"layout": {"columns": None}}, "layout.columns", "missing"), ({"layout": {"columns": 1}}, "layout.columns", "failed"),
    ({"layout": {"margins": {"top": 50, "bottom": 72, "left": 72, "right": 72}}}, "layout.margins", "failed"), ({"structure": {"title_text": ""}}, "structure.title", "missing"), ({"structure": {"sections": []}}, "structure.section.introduction", "missing"), ({"structure": {"sections": ["Introduction", "Appendix"]}}, "structure.forbid.appendix", "failed"),
    ({"structure": {"has_abstract": False}}, "structure.abstract", "missing"), ({"structure": {"abstract_words": 151}}, "structure.abstract_length", "failed"), ({"structure": {"has_keywords": False}}, "structure.keywords", "missing"), ({"structure": {"references": 3}}, "structure.references", "failed"), ({"structure": {"references": None}}, "structure.references", "not_applicable"),
    ({"structure": {"headings": ["Odd"]}}, "structure.heading_names", "failed"), ({"typography": {"body_font": "Arial"}}, "typography.body.font_family", "failed"), ({"typography": {"dominant_font": None}}, "typography.title.font_family", "missing"), ({"typography": {"body_font_size_pt": 11}}, "typography.abstract.font_size_pt", "failed"), ({"typography": {"alignments": {"left": 5}}}, "typography.body.alignment", "failed"),
    ({"typography": {"sizes": [8.0]}}, "typography.size_range", "failed"), ({"typography": {"line_spacing": 1.5}}, "paragraph.line_spacing", "failed"), ({"typography": {"first_line_indent_pt": None}}, "paragraph.first_line_indent", "missing"), ({"typography": {"space_above_pt": 9}}, "paragraph.space_above", "failed"), ({"typography": {"space_below_pt": 9}}, "paragraph.space_below", "failed"),
    ({"typography": {"alignments": {"justified": 5, "left": 5}}}, "paragraph.justified", "failed"), ({"typography": {"alignments": {"justified": 19, "left": 1}}}, "paragraph.uniform_alignment", "failed"), ({"identity": {"author_block": True}}, "anonymisation.author_block", "failed"), ({"identity": {"emails": ["a@b.c"]}}, "anonymisation.emails", "failed"),
    ({"identity": {"affiliations": ["X"]}}, "anonymisation.affiliations", "failed"), ({"identity": {"acknowledgement": True}}, "anonymisation.acknowledgements", "failed"), ({"identity": {"funding": True}}, "anonymisation.funding", "failed"), ({"identity": {"orcids": ["1"]}}, "anonymisation.orcid", "failed"), ({"identity": {"self_citations": 2}}, "anonymisation.self_citation", "failed"),
    ({"identity": {"leaks": {"author": "A"}}}, "anonymisation.metadata.author", "failed"), ({"structure": {"author_text": "of ACME"}}, "anonymisation.forbidden_terms", "failed"), ({"identity": {"placeholder": False}}, "anonymisation.placeholder", "passed"),
]


def changed(change):
    return {k: {**v, **change.get(k, {})} for k, v in GOOD.items()}


@pytest.fixture(scope="module")
def rows(spark):
    papers = [(0, json.dumps(GOOD), "full", None)] + [(i + 1, json.dumps(changed(c)), "full", None) for i, (c, _, _) in enumerate(BREAKS)] + [(900, json.dumps(GOOD), "none", None), (901, None, "full", "damaged")]
    df = spark.createDataFrame(papers, "paper_id bigint, j string, rules_id string, error string").withColumn("facts", F.from_json("j", rules.facts_schema()))
    out = rules.check_results(rules.with_rules(df, rules.rules_frame(spark, {"full": RULES, "none": {"sections": {"abstract_required": False}}})))
    return out.persist()


def test_a_good_paper_passes_everything(rows):
    got = {r["id"]: r["status"] for r in rows.filter("paper_id = 0").collect()}
    assert set(got.values()) == {"passed", "not_applicable"}
    assert not {"file.extension_accepted", "file.source_allowed", "anonymisation.placeholder", "anonymisation.enabled"} & set(got)
    assert got["file.source_required"] == "not_applicable" and sum(v == "passed" for v in got.values()) >= 35


def test_each_rule_fails_where_it_should(rows):
    got = {}
    for r in rows.collect():
        got.setdefault(r["paper_id"], {})[r["id"]] = r["status"]
    wrong = [(i, rule, got[i + 1].get(rule)) for i, (_, rule, status) in enumerate(BREAKS) if got[i + 1].get(rule) != status]
    assert wrong == []


def test_unset_rules_and_unreadable_files(rows):
    none = {r["id"]: r["status"] for r in rows.filter("paper_id = 900").collect()}
    assert none["anonymisation.enabled"] == "not_applicable" and none["typography.body.font_family"] == "not_applicable" and "structure.references" not in none and "typography.size_range" not in none
    bad = rows.filter("paper_id = 901").collect()
    assert [(r["id"], r["status"], r["severity"]) for r in bad] == [("file.ingest", "failed", "blocking")]


def test_verdicts(spark, rows):
    policy = rows.select("paper_id").distinct().withColumns({"reject_blocking": F.lit(True), "reject_warning": F.col("paper_id") % 2 == 0, "min_score": F.lit(10)})
    a = {r["paper_id"]: r for r in decisions.assess(rows, policy).collect()}
    assert a[0]["verdict"] == "accepted" and a[0]["score"] == 100
    assert a[901]["verdict"] == "rejected" and a[901]["score"] == 0 and a[901]["reasons"] == ["Readable file"]
    warned = next(i + 1 for i, b in enumerate(BREAKS) if b[1] == "typography.body.font_family")
    assert a[warned]["verdict"] == ("needs_review" if warned % 2 else "rejected")
    tally = decisions.batch_tally(spark.createDataFrame([(1, "accepted"), (1, "rejected"), (2, "needs_review")], "batch_id int, verdict string"))
    assert {tuple(r) for r in tally.collect()} == {(1, 2, 1, 1, 0), (2, 1, 0, 0, 1)}
