"""Section classification, dominant formats and page geometry on hand-made blocks."""

from foliolith.operators import structure
from pyspark.sql import functions as F

FMT = {x.split()[0]: None for x in structure.FORMAT.split(", ")}


def blocks(spark, docs):
    rows = [(d, i, t, {**FMT, "font_size_pt": float(s), "bold": b}, h) for d, items in docs.items() for i, (t, s, b, h) in enumerate(items)]
    return spark.createDataFrame(rows, structure.BLOCKS)


def plain(*texts):
    return [(t, 10, False, False) for t in texts]


def test_classify(spark):
    got = structure.classify_blocks(blocks(spark, {
        1: plain("A title", "Ann Author", "Some place", "Abstract", "First part.", "Second part.", "Keywords: a; b", "1 Introduction", "Text.", "OWN HEADING", "More.", "Smith, J.: One (2001)", "Doe, A.: Two (2002)"),
        2: plain("Abstract", "Only this."), 3: plain("Title", "x" * 401, "tail"), 4: [("T", 10, False, False), ("Styled", 12, True, True), ("body", 10, False, False)],
        5: plain("T", "References", "Smith, J.: One (2001)", "Doe, A.: Two (2002)", "Conclusion", "end"),
    })).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["ord"])):
        by.setdefault(r["doc_id"], []).append((r["type"], r["name"], r["text"]))
    assert by[1] == [
        ("title", None, "A title"), ("authors", None, "Ann Author Some place"), ("heading", "Abstract", "Abstract"), ("abstract", None, "First part. Second part."), ("keywords", "Keywords", "a; b"),
        ("heading", "Introduction", "1 Introduction"), ("body", "Introduction", "Text."), ("heading", "Own Heading", "OWN HEADING"), ("body", "Own Heading", "More."),
        ("references", None, "Smith, J.: One (2001)"), ("references", None, "Doe, A.: Two (2002)")]
    assert by[2] == [("heading", "Abstract", "Abstract"), ("abstract", None, "Only this.")]
    assert [x[0] for x in by[3]] == ["title", "body", "body"]
    assert by[4] == [("title", None, "T"), ("heading", "Styled", "Styled"), ("body", "Styled", "body")]
    assert [x[0] for x in by[5]] == ["title", "heading", "references", "references", "heading", "references"] or [x[:2] for x in by[5]][4] == ("heading", "Conclusion")


def test_formats_break_ties_by_first_seen_and_flags_by_true(spark):
    b = blocks(spark, {1: [("a", 9, True, False), ("b", 10, False, False), ("c", 10, False, False), ("d", 9, True, False)], 2: [("a", 12, False, False)]})
    got = {r["doc_id"]: r["fmt"] for r in structure.aggregate_formats(b, ["doc_id"], F.lit(1), F.col("pos")).collect()}
    assert got[1]["font_size_pt"] == 9.0 and got[1]["bold"] is True and got[2]["bold"] is False


def lines(spark, rows):
    cols = "doc_id bigint, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, baseline double, text string, size double, font string, bold boolean, italic boolean, page_width double, page_height double"
    return structure.text_lines(spark.createDataFrame([(d, p, b, n, x0, y, x1, y + 10, y + 9, t, s, "F", bold, False, 600.0, 800.0) for d, p, b, n, x0, x1, y, t, s, bold in rows], cols))


def test_columns_and_margins(spark):
    two = [(1, 1, 0, i, 50.0, 288.0, 50.0 + 12 * i, "left", 10.0, False) for i in range(15)] + [(1, 1, 1, i, 312.0, 550.0, 50.0 + 12 * i, "right", 10.0, False) for i in range(15)]
    one = [(2, 1, 0, i, 50.0, 550.0, 50.0 + 12 * i, "wide", 10.0, False) for i in range(30)]
    x = lines(spark, two + one)
    assert {r["doc_id"]: r["columns"] for r in structure.columns_of(x).collect()} == {1: 2, 2: 1}
    m = {r["doc_id"]: r for r in structure.margins_of(x).collect()}
    assert (m[2]["left"], m[2]["right"], m[2]["top"]) == (50.0, 50.0, 50.0)
    assert {r["line_spacing"] for r in structure.line_spacing_of(x).collect()} == {1.2}


def test_alignment_and_indent(spark):
    rows = [(1, 1, 0, 0, 70.0, 550.0, 50.0, "first", 10.0, False), (1, 1, 0, 1, 50.0, 550.0, 62.0, "second", 10.0, False), (1, 1, 0, 2, 50.0, 300.0, 74.0, "third", 10.0, False),
            (1, 1, 2, 0, 200.0, 400.0, 140.0, "mid", 10.0, False), (1, 1, 3, 0, 300.0, 549.0, 160.0, "right", 10.0, False), (1, 1, 4, 0, 70.0, 300.0, 180.0, "nothing", 10.0, False),
            (1, 1, 5, 0, 50.0, 550.0, 200.0, "ragged", 10.0, False), (1, 1, 5, 1, 48.0, 500.0, 212.0, "lines", 10.0, False)]
    x = lines(spark, rows).withColumn("rx0", F.lit(50.0)).withColumn("rx1", F.lit(550.0))
    a = structure.alignment_of(x)
    assert {r["block"]: r["alignment"] for r in a.collect()} == {0: "justified", 2: "center", 3: "right", 4: None, 5: "left"}
    assert {r["block"]: r["indent"] for r in structure.first_indent_of(x, a).collect()} == {0: 20.0, 2: None, 3: None, 4: None, 5: 0.0}


def test_blocks_from_spans(spark):
    words = "a line of the body that has at least twelve words in it now"
    rows = [(1, 0, 0, 0, 50.0, 350.0, 20.0, "A Title", 16.0, True), (1, 0, 1, 0, 50.0, 150.0, 50.0, "1 Introduction", 12.0, True)]
    rows += [(1, 0, 1, n, 50.0, 550.0, 50.0 + 12 * n, words, 10.0, False) for n in (1, 2, 3)] + [(1, 0, 2, n, 50.0, 550.0, 120.0 + 12 * n, words, 10.0, False) for n in (0, 1)] + [(1, 61, 0, 0, 50.0, 550.0, 20.0, "too far", 10.0, False)]
    cols = "doc_id bigint, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, baseline double, text string, size double, font string, bold boolean, italic boolean, page_width double, page_height double"
    spans = spark.createDataFrame([(d, p, b, n, x0, y, x1, y + 10, y + 9, t, s, "ABCDEF+Times-Bold" if bold else "Times", bold, False, 595.0, 842.0) for d, p, b, n, x0, x1, y, t, s, bold in rows], cols)
    got = structure.blocks_from_spans(spans).orderBy("pos").collect()
    assert [(r["text"][:14], r["heading_style"], r["fmt"]["font_size_pt"], r["fmt"]["font_family"]) for r in got] == [
        ("A Title", True, 16.0, "Times"), ("1 Introduction", False, 12.0, "Times"), ("a line of the ", False, 10.0, "Times"), ("a line of the ", False, 10.0, "Times")]
    assert got[2]["fmt"]["alignment"] == "justified" and got[1]["fmt"]["bold"] is True and got[2]["fmt"]["bold"] is None
    info = structure.document_info(spans).first()
    assert (info["page_count"], info["label"], info["orientation"], info["columns"], info["left"]) == (62, "A4", "portrait", 1, 50.0)
    kinds = [r["type"] for r in structure.classify_blocks(structure.blocks_from_spans(spans)).orderBy("ord").collect()]
    assert kinds == ["title", "heading", "body", "body"]


def test_page_estimate(spark):
    b = structure.classify_blocks(blocks(spark, {1: plain("T", "Introduction", *["word " * 200] * 60)}))
    page = spark.createDataFrame([(1, 595.0, 842.0, 72.0, 72.0, 72.0, 72.0)], "doc_id bigint, width double, height double, left double, right double, top double, bottom double")
    assert structure.estimate_pages(b, page).first()["pages"] in (12, 13)
