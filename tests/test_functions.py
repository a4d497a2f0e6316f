"""Text and value functions on hand-made inputs, each seen to hold and to fail."""

import pytest
from foliolith.functions import text as T
from foliolith.functions import values as V
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("1 Introduction", "Introduction"), ("II. METHODS", "Methodology"), ("Abstract:", "Abstract"), ("Abstract algebra", None), ("3.1 Results & Discussion", "Results"),
    ("Literature review", "Related Work"), ("Concluding remarks", "Conclusion"), ("Works cited", "References"), ("Something", None),
])
def test_canonical_section(spark, text, want):
    assert one(spark, T.canonical_section(F.col("t")), t=text) == want


def test_headings_and_references(spark):
    assert one(spark, T.is_caps_heading(F.col("t")), t="RESULTS AND MORE") and not one(spark, T.is_caps_heading(F.col("t")), t="123 456")
    assert one(spark, T.is_reference_entry(F.col("t")), t="Smith, J., Doe, A.: On things. Journal 3 (2019)")
    assert not one(spark, T.is_reference_entry(F.col("t")), t="Smith, J.: On things without a date")
    assert not one(spark, T.is_reference_entry(F.col("t")), t="Plain prose from 2019.")
    assert one(spark, T.keywords_text(F.col("t")), t="Keywords: a, b.") == "a, b"
    assert one(spark, T.title_case(F.col("t")), t="O'NEIL-SMITH AND 2ND") == "O'Neil-Smith And 2Nd"


def test_identity_facts(spark):
    assert one(spark, T.emails(F.col("t")), t="mémo@éx.fr a@b.com a@b.com") == ["a@b.com", "mémo@éx.fr"]
    assert one(spark, T.orcids(F.col("t")), t="0000-0002-1825-009X") == ["0000-0002-1825-009X"]
    assert one(spark, T.urls(F.col("t")), t="see https://x.org/a. and www.y.org,") == ["https://x.org/a", "www.y.org"]
    assert one(spark, F.size(T.affiliations(F.col("t"))), t="A. B., University of X; none") == 1
    assert one(spark, T.person_names(F.col("t"), F.lit("Deep Things")), t="Ada Lovelace, Alan M. Turing, Deep Things, Some University of X Bob Bee") == ["Ada Lovelace", "Alan M"]
    assert one(spark, T.has(F.col("t"), T.FUNDING), t="supported by a grant") and not one(spark, T.has(F.col("t"), T.FUNDING), t="nothing")
    assert one(spark, T.count_of(F.col("t"), T.SELF_CITATION), t="In our previous work we previously showed") == 2
    assert one(spark, T.largest_number(F.col("t"), T.FIGURE), t="Fig. 3 and figure 12") == 12 and one(spark, T.largest_number(F.col("t"), T.TABLE), t="") == 0
    assert one(spark, T.reference_parts(F.col("t")), t="[1] a one [2] b two") == 2
    assert one(spark, T.window_at(F.col("t"), "x+", 2, 3), t="abcxxdef") == "bcxxd"
    assert one(spark, T.word_count(F.col("t")), t="") == 0 and one(spark, T.word_count(F.col("t")), t=" a  b ") == 2


@pytest.mark.parametrize("name,want", [
    ("ABCDEF+TimesNewRomanPS-BoldMT", "Times New Roman"), ("Arial-BoldItalicMT", "Arial"), ("HELVETICA", "Helvetica"), ("BoldItalic", "Bold Italic"), ("BookBold", "Book"), ("", None), ("Garamond-Pro_Medium", "Garamond"),
])
def test_font_families(spark, name, want):
    assert one(spark, T.clean_font(F.col("n")), n=name) == want


def test_values(spark):
    assert one(spark, V.percent(F.lit(5), F.lit(8), 100)) == 62 and one(spark, V.percent(F.lit(0), F.lit(0), 100)) == 100
    assert one(spark, V.format_of(F.col("n")), n="a.b.TEX") == "latex" and one(spark, V.format_of(F.col("n")), n="none") is None
    assert one(spark, V.page_label(F.lit(842.0), F.lit(595.0))) == "A4" and one(spark, V.page_label(F.lit(523.0), F.lit(756.0))) == "Executive" and one(spark, V.page_label(F.lit(100.0), F.lit(100.0))) is None
    assert one(spark, V.to_points(F.col("x")), x="1in") == 72.0 and one(spark, V.to_points(F.col("x")), x="2.5cm") == 70.866 and one(spark, V.to_points(F.col("x")), x="3qq") == 3.0 and one(spark, V.to_points(F.col("x")), x="wide") is None
    assert one(spark, V.folder_id(F.col("u")), u="https://drive.example/drive/folders/abcDEF_123?x=1") == "abcDEF_123"
    assert one(spark, V.doc_id(F.col("u")), u="https://docs.example/document/d/1aB-c/edit") == "1aB-c" and one(spark, V.doc_id(F.col("u")), u="short") is None
    cursor = one(spark, V.encode_cursor(user=F.lit("u"), at=F.lit(3)))
    assert one(spark, V.decode_cursor(F.col("c"), "user string, at int")["at"], c=cursor) == 3
    assert one(spark, V.number(F.lit(595.280))) == "595.28" and one(spark, V.number(F.lit(20.0))) == "20"
    for data, name, want in [(b"%PDF-1.7", "x", "pdf"), (b"PK\x03\x04", "x.pdf", "docx"), (b"\\documentclass{a}", "x", "latex"), (b"text", "x.tex", "latex"), (b"text", "x.txt", "unknown"), (b"\xff\xfe", "y.pdf", "pdf")]:
        assert one(spark, V.sniff_format(F.col("d"), F.col("n")), d=data, n=name) == want


def test_affiliations_are_those_of_the_plain_pattern(spark):
    import random

    rng = random.Random(3)
    bits = ["University", "college", "colleges", "school of", "school \n of", "xlab", "lab", "labs", "research centre", "inc.", "Inc", "ltd", "ünlab", "lab́", "department", ". ", "; ", "\n", "_", "é", "word", "x" * 30, "the quick brown fox " * 3, "y" * 75]
    rows = [(None,), ("",), ("lab",)] + [("".join(rng.choice(bits) + rng.choice([" ", " ", "", ", "]) for _ in range(rng.randrange(1, 50))),) for _ in range(800)]
    found = F.transform(F.regexp_extract_all("t", F.lit(T._u(T.AFFILIATION, True)), F.lit(0)), lambda x: F.substring(F.trim(x), 1, T.SNIPPET))
    plain = F.slice(F.array_sort(F.array_distinct(found)), 1, 10)
    d = spark.createDataFrame(rows, "t string")
    assert d.filter(~plain.eqNullSafe(T.affiliations(F.col("t")))).count() == 0
    assert d.filter(F.size(plain) > 1).count() > 300


def test_text_far_from_hints_is_not_searched_for_affiliations(spark):
    far = "word " * 20_000
    near = T._near_hints(F.col("t"))
    assert one(spark, near, t=far) == ""
    assert one(spark, F.length(near), t=far + "University of X" + " and so on" * 20_000) < 300
