"""Facts on hand-made sections, and files checked from bytes to verdicts."""

from foliolith.operators import checking, diffs, facts, rules, structure
from foliolith.sources import files
from pyspark.sql import functions as F

from .test_sources import docx

FMT = {x.split()[0]: None for x in structure.FORMAT.split(", ")}
INFO = ("doc_id bigint, filename string, extension string, format string, size bigint, error string, width double, height double, label string, orientation string, columns int, top double, bottom double, "
        "left double, right double, page_count int, page_count_exact boolean, title string, anonymous_package boolean, metadata map<string,string>")


def sections(spark, rows):
    data = [(d, float(i), t, n, x, {**FMT, "font_family": f, "font_size_pt": s, "alignment": a}) for i, (d, t, n, x, f, s, a) in enumerate(rows)]
    kind = f"struct<{', '.join(x.replace(' ', ':') for x in structure.FORMAT.split(', '))}>"
    return spark.createDataFrame(data, f"doc_id bigint, ord double, type string, name string, text string, fmt {kind}")


def info(spark, ids, **own):
    row = dict(filename="a.pdf", extension="pdf", format="pdf", size=10, error=None, width=595.28, height=841.89, label="A4", orientation="portrait", columns=1, top=72.0, bottom=72.0, left=72.0, right=72.0,
               page_count=3, page_count_exact=True, title="", anonymous_package=False, metadata={"author": "Ann", "format": "x", "title": ""}) | own
    return spark.createDataFrame([(i, *row.values()) for i in ids], INFO)


def test_facts_of_a_paper(spark):
    s = sections(spark, [
        (1, "title", None, "Deep Things", "Arial", 16.0, "center"), (1, "authors", None, "Ada Lovelace, University of X, ada@x.org", "Times", 10.0, None), (1, "heading", "Abstract", "Abstract", "Times", 12.0, None),
        (1, "abstract", None, "Short words here.", "Times", 9.0, None), (1, "keywords", "Keywords", "a, b; c", "Times", 9.0, None), (1, "heading", "Introduction", "1 Introduction", "Times", 12.0, None),
        (1, "body", "Introduction", "In our previous work see Fig. 3 and Table 12.", "Times", 10.0, "justified"), (1, "body", "Introduction", "https://a.org/x. was funded by a grant", "Arial", 11.0, "left"),
        (1, "body", "Introduction", "more", "Times", 10.0, "justified"), (1, "heading", "Acknowledgements", "Acknowledgements", "Times", 12.0, None), (1, "body", "Acknowledgements", "Thanks all.", "Times", 10.0, None),
        (1, "heading", "References", "References", "Times", 12.0, None), (1, "body", "References", "[1] A one 2001 [2] B two 2002", "Times", 9.0, None),
        (2, "authors", None, "Anonymous authors", None, None, None), (2, "body", None, "plain", None, None, None)])
    got = {r["doc_id"]: r for r in facts.assemble(s, info(spark, [1, 2, 3])).collect()}
    f, n = got[1]["facts"], got[1]
    assert (f["structure"]["title_text"], f["structure"]["has_abstract"], f["structure"]["abstract_words"], f["structure"]["references"], f["structure"]["total_words"]) == ("Deep Things", True, 3, 2, 46)
    assert f["structure"]["sections"] == ["Abstract", "Introduction", "Acknowledgements", "References"] and n["structure_notes"]["numbered_headings"] == ["Introduction"] and n["structure_notes"]["keywords"] == ["a", "b", "c"]
    t = f["typography"]
    assert (t["body_font"], t["body_font_size_pt"], t["title_font_size_pt"], t["heading_font_size_pt"], t["sizes"], t["alignments"]) == ("Times", 10.0, 16.0, 12.0, [9.0, 10.0, 11.0], {"justified": 2, "left": 1})
    i = f["identity"]
    assert i["author_block"] and not i["placeholder_only"] and i["emails"] == ["ada@x.org"] and len(i["affiliations"]) == 1 and i["acknowledgement_text"] == "Thanks all." and i["self_citations"] == 1
    assert i["funding"] and "funded by a grant" in i["funding_text"] and i["leaks"] == {"author": "Ann"} and n["identity_notes"]["names"] == ["Ada Lovelace"] and n["identity_notes"]["urls"] == ["https://a.org/x"]
    assert (n["assets"]["figures"], n["assets"]["tables"], n["assets"]["confidence"]) == (3, 12, "medium") and n["identity_notes"]["reference_confidence"] == "high"
    order = facts.assemble(s, info(spark, [1])).select(F.transform(F.map_entries("typography_notes.fonts_used"), lambda e: e["key"])).first()[0]
    assert order == ["Times", "Arial"] and n["typography_notes"]["fonts_used"] == {"Times": 11, "Arial": 2} and n["warnings"] == ["Margins are estimated from content extents in PDFs; headers and footers can skew them."]
    two = got[2]["facts"]
    assert not two["identity"]["author_block"] and two["identity"]["placeholder_only"] and two["identity"]["placeholder"] and two["structure"]["references"] is None and two["typography"]["body_font"] is None
    assert got[3]["facts"]["structure"]["total_words"] == 0 and got[3]["facts"]["structure"]["title_text"] == ""
    assert facts.summary(facts.assemble(s, info(spark, [1]))).first().asDict() == {
        "doc_id": 1, "format": "pdf", "pages": 3, "pages_exact": True, "words": 46, "body_font": "Times", "body_size": 10.0, "sections": 4, "figures": 3, "tables": 12, "references": 2}
    d = facts.display(s, info(spark, [1], title="", metadata={"title": "From metadata"})).first()
    assert (d["title"], d["authors"], d["emails"]) == ("From metadata", ["Ada Lovelace"], ["ada@x.org"])


TEX = r"""\documentclass[10pt,a4paper,twocolumn]{article}\usepackage{times}
\title{On Things}\author{%s}
\begin{document}\maketitle
\begin{abstract}We study things.\end{abstract}
\section{Introduction}
Some text of the body%s.
\section{References}
[1] A one 2001 [2] B two 2002
\end{document}"""


def test_files_to_verdicts(spark, tmp_path):
    body = "<w:p><w:r><w:t>A Word title</w:t></w:r></w:p><w:p><w:r><w:t>Abstract</w:t></w:r></w:p><w:p><w:r><w:t>Short.</w:t></w:r></w:p>"
    for name, data in {"clean.tex": TEX % ("Anonymous Authors", ""), "named.tex": TEX % ("Ada Lovelace", ", mail ada at ada@x.org"), "a.docx": docx(body), "bad.docx": b"PK no", "x.pdf": b"%PDF-1.4"}.items():
        (tmp_path / name).write_bytes(data.encode() if isinstance(data, str) else data)
    parsed = files.parse_files(files.read_folder(spark, str(tmp_path)))
    house = rules.rules_frame(spark, {"house": {"file_type": {"accepted": ["tex", "docx", "pdf"]}, "pages": {"columns": 2, "page_size_label": "A4"}, "anonymisation": {"required": True}}})
    got = {r["filename"]: r for r in checking.check_files(parsed, house).collect()}
    assert {k: (v["verdict"], v["validation"]) for k, v in got.items()} == {
        "clean.tex": ("accepted", "passed"), "named.tex": ("rejected", "failed"), "a.docx": ("rejected", "failed"), "bad.docx": ("rejected", "unable_to_validate"), "x.pdf": ("rejected", "unable_to_validate")}
    assert got["bad.docx"]["score"] == 0 and got["bad.docx"]["failed"] == 1 and set(got["named.tex"]["reasons"]) == {"Author block", "No e-mail addresses"} or got["named.tex"]["reasons"]
    sections_ = checking.sections_of(parsed)
    checked = checking.results(facts.assemble(sections_, checking.info_of(parsed, sections_)), house)
    ids = parsed.select(checking.doc_id("path").alias("paper_id"), "filename")
    planted = ids.filter("filename = 'named.tex'").select("paper_id", F.explode(F.array(F.lit("anonymisation.emails"), F.lit("anonymisation.author_block"))).alias("rule"))
    out = diffs.evaluate_fixtures(planted, checking.failed_rules(checked).join(ids.filter("filename = 'named.tex'"), "paper_id", "left_semi"), ["paper_id"])
    assert {r["rule"]: r["outcome"] for r in out.collect()}["anonymisation.emails"] == "detected"
    assert checking.skipped(files.read_folder(spark, str(tmp_path)), parsed.filter("error is null")).count() == 2


def test_spans_to_verdicts(spark):
    words = "a line of the body that has at least twelve words in it now"
    rows = [(1, 0, 0, 0, 50.0, 20.0, 350.0, "A Title", 16.0, True)] + [(1, 0, 1, n, 50.0, 50.0 + 12 * n, 550.0, words, 10.0, False) for n in range(3)]
    cols = "doc_id bigint, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, baseline double, text string, size double, font string, bold boolean, italic boolean, page_width double, page_height double"
    spans = spark.createDataFrame([(d, p, b, n, x0, y, x1, y + 10, y + 9, t, s, "Times", bold, False, 595.28, 841.89) for d, p, b, n, x0, y, x1, t, s, bold in rows], cols)
    listing = spark.createDataFrame([(1, "a.pdf", 5, "x", {"author": "Ann"}), (2, "scan.pdf", 5, "y", None)], "doc_id bigint, filename string, size bigint, sha256 string, metadata map<string,string>")
    house = rules.rules_frame(spark, {"house": {"sections": {"abstract_required": False}}})
    got = {r["filename"]: r for r in checking.check_batch(structure.classify_blocks(structure.blocks_from_spans(spans)), checking.span_info(spans, listing), house).collect()}
    assert got["a.pdf"]["verdict"] == "accepted" and got["scan.pdf"]["validation"] == "unable_to_validate"


def test_comparison_computes_only_what_it_compares(spark):
    from foliolith.operators import inference
    from foliolith.plans import registry

    s = sections(spark, [(1, "title", None, "Deep", "Arial", 16.0, None), (1, "heading", "Results", "Results", "Times", 12.0, None), (1, "body", "Results", "we thank a@b.org", "Times", 10.0, None)])
    whole, part = (facts.assemble(s, info(spark, [1]), *only) for only in ((), (inference.COMPARED_FACTS,)))
    got = part.select("facts").first()["facts"]
    assert got["identity"]["emails"] is None and got["structure"]["sections"] == ["Results"]
    assert part.schema == whole.schema
    pick = lambda d: d.select(inference.compared_facts(F.col("facts"))).first()
    assert pick(part) == pick(whole)
    plan = registry.queries()["x2_file_comparison"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(facts" not in plan
