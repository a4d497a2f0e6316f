"""Rule sets inferred from template documents, and the older template-to-paper comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolith.functions import values as V
from foliolith.operators import facts
from foliolith.operators.structure import ATTRIBUTES, mode

# The proceedings family's signals with their weights, its text area and
# tolerances in millimetres, the score from which it is recognised, and its published policy.
FAMILY = {
    "a4": 0.30, "one_column": 0.15, "portrait": 0.10, "text_width": 0.20, "text_height": 0.15,
    "abstract": 0.15, "keywords": 0.10, "vocabulary": 0.10,
}
TEXT_WIDTH, TEXT_HEIGHT, WIDTH_TOLERANCE, HEIGHT_TOLERANCE = 122.0, 193.0, 4.0, 6.0
FAMILY_THRESHOLD = 0.75
VOCABULARY = ("abstract", "keywords", "references")
FAMILY_POLICY = {
    "sections": {"abstract_required": True, "abstract_max_words": 250, "keywords_required": True},
    "pages": {"max_pages": 9},
    "anonymisation": {"required": False, "allow_author_block": True},
}
# The starter presets.
PRESETS = {
    "IEEE two-column (anonymous)": {
        "file_type": {"accepted": ["pdf"], "allow_source": True},
        "pages": {"max_pages": 8, "page_size_label": "Letter", "orientation": "portrait", "columns": 2},
        "sections": {"required": ["Abstract", "Introduction", "Conclusion"], "keywords_required": True, "min_references": 5},
        "anonymisation": {"required": True, "self_citation": True},
        "typography": {"body": {"font_family": "Times New Roman", "font_size_pt": 10}, "title": {"font_size_pt": 24}, "headings": {"font_size_pt": 10, "bold": True}},
        "paragraph": {"line_spacing": 1.0},
    },
    "ACM single-column (anonymous)": {
        "file_type": {"accepted": ["pdf"]},
        "pages": {"max_pages": 9, "page_size_label": "Letter", "columns": 2},
        "sections": {"required": ["Abstract", "Introduction", "Conclusion"], "abstract_max_words": 150, "keywords_required": True},
        "anonymisation": {"required": True},
        "typography": {"body": {"font_family": "Libertine", "font_size_pt": 9}, "headings": {"font_size_pt": 9, "bold": True}},
        "paragraph": {"line_spacing": 1.0},
    },
    "Springer LNCS (visible authors)": {
        "file_type": {"accepted": ["pdf", "tex", "docx"], "allow_source": True},
        "pages": {"max_pages": 9, "page_size_label": "A4", "orientation": "portrait", "columns": 1, "margins": {"top": 147.4, "bottom": 147.4, "left": 124.7, "right": 124.7}},
        "sections": {"required": ["Abstract", "Introduction", "Conclusion", "References"], "abstract_required": True, "abstract_max_words": 250, "keywords_required": True},
        "anonymisation": {"required": False, "allow_author_block": True},
        "typography": {"body": {"font_family": "Times New Roman", "font_size_pt": 10}, "title": {"font_size_pt": 14, "bold": True}, "headings": {"font_size_pt": 10, "bold": True}},
        "paragraph": {"line_spacing": 1.0},
    },
}
# The order of sections, captions and back matter, and words that name an institution.
CANONICAL = ("Abstract", "Keywords", "Introduction", "Related Work", "Methodology", "Results", "Conclusion", "References")
CAPTION = r"(?i)^\s*(table|tab\.|fig\.|figure|algorithm|listing|scheme|chart)\s*\.?\s*\d+"
BACK_LEAD = r"(?i)^\s*(acknowledg(e)?ments?|disclosure of interests?|competing interests?|conflict of interests?|ethical standards?|author contributions?)\s*[.:]"
BACK_MATTER = (
    "References", "Acknowledgments", "Appendix", "Acknowledgment", "Acknowledgements", "Disclosure Of Interests", "Conflict Of Interest",
    "Competing Interests", "Ethical Standards", "Ethics Statement", "Author Contributions",
)
INSTITUTIONS = ("university", "institute", "department", "laborator")
POINTS_PER_MM = 72 / 25.4


def compare(want: Column, got: Column, tolerance: float | None = None) -> Column:
    """passed, failed or missing; null where nothing is wanted."""
    same = F.abs(want - got) <= tolerance if tolerance is not None else F.lower(want.cast("string")) == F.lower(got.cast("string"))
    return F.when(want.isNull(), F.lit(None)).when(got.isNull(), "missing").when(same, "passed").otherwise("failed")


#: What the older comparison looks at: (id, field, tolerance).
COMPARED = (
    ("document.width", "width", 2.0), ("document.height", "height", 2.0), ("document.orientation", "orientation", None), ("document.columns", "columns", None),
    ("document.margin_top", "margin_top", 2.0), ("document.margin_bottom", "margin_bottom", 2.0), ("document.margin_left", "margin_left", 2.0), ("document.margin_right", "margin_right", 2.0),
    ("typography.title_font", "title_font", None), ("typography.title_size", "title_size", 0.51), ("typography.abstract_font", "abstract_font", None), ("typography.abstract_size", "abstract_size", 0.51),
    ("typography.heading_font", "heading_font", None), ("typography.heading_size", "heading_size", 0.51), ("typography.body_font", "body_font", None), ("typography.body_size", "body_size", 0.51),
    ("paragraph.line_spacing", "line_spacing", 0.01), ("paragraph.indent", "indent", 2.0), ("paragraph.space_below", "space_below", 2.0),
)


#: The facts that it takes.
COMPARED_FACTS = ("layout", "typography", "structure.sections")


def compared_facts(f: Column) -> Column:
    """What the older comparison looks at, from the facts of a paper or template."""
    t, l, m = f["typography"], f["layout"], f["layout"]["margins"]
    known = {
        "width": l["width"], "height": l["height"], "orientation": l["orientation"], "columns": l["columns"], "title_size": t["title_font_size_pt"], "heading_size": t["heading_font_size_pt"],
        "body_font": t["body_font"], "body_size": t["body_font_size_pt"], "line_spacing": t["line_spacing"], "indent": t["first_line_indent_pt"], "space_below": t["space_below_pt"],
        **{f"margin_{x}": m[x] for x in ("top", "bottom", "left", "right")},
    }
    text = ("orientation", "title_font", "abstract_font", "heading_font", "body_font")
    cells = [known.get(c, F.lit(None)).cast("string" if c in text else "double").alias(c) for _, c, _ in COMPARED]
    return F.struct(*cells, f["structure"]["sections"].alias("sections"))


def run_comparison(pairs: DataFrame) -> DataFrame:
    """(paper_id, id, status) of ``pairs``: paper_id, structs template and paper with the
    fields of COMPARED and ``sections`` (names). Presence needs the exact name."""
    rows = [F.struct(F.lit(i).alias("id"), compare(F.col(f"template.{f}"), F.col(f"paper.{f}"), t).alias("status")) for i, f, t in COMPARED]
    need = F.transform("template.sections", lambda n: F.struct(F.concat(F.lit("structure."), n).alias("id"), F.when(F.array_contains("paper.sections", n), "passed").otherwise("missing").alias("status")))
    every = F.filter(F.concat(F.array(*rows), F.coalesce(need, F.array().cast("array<struct<id:string,status:string>>"))), lambda x: x["status"].isNotNull())
    return pairs.select("paper_id", F.inline(every))


def comparison_report(checks: DataFrame) -> DataFrame:
    """Counts and score of each paper; 0 where nothing was scored."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = checks.groupBy("paper_id").agg(n("passed"), n("failed"), n("missing"))
    return g.withColumn("score", V.percent(F.col("passed"), F.col("passed") + F.col("failed") + F.col("missing"), 0))


def is_body(name: Column, text: Column) -> Column:
    """Body text proper: no back matter, captions or run-in leads of back matter."""
    return ~F.coalesce(name.isin(*BACK_MATTER), F.lit(False)) & ~text.rlike(CAPTION) & ~text.rlike(BACK_LEAD)


def analyze_template(sections: DataFrame) -> DataFrame:
    """(doc_id, title, authors, abstract, headings, body, keywords_required, required): the
    formats of a template's elements and its canonical sections in order."""
    d = facts.collected(sections)
    form = lambda x: F.struct(*[facts.format_of(x, a).alias(a) for a in ATTRIBUTES])
    first = lambda kind: F.get(facts._of(kind), F.lit(0))["fmt"]
    body = F.filter("s", lambda x: (x["type"] == "body") & ~F.coalesce(x["name"].isin("References", "Acknowledgments", "Appendix"), F.lit(False)))
    names = F.transform(facts._of("heading"), lambda x: x["name"])
    wanted = F.filter(F.array(*map(F.lit, [c for c in CANONICAL if c != "Keywords"])), lambda c: F.array_contains(names, c))
    return d.select(
        "doc_id", first("title").alias("title"), first("authors").alias("authors"), first("abstract").alias("abstract"), form(facts._of("heading")).alias("headings"),
        form(body).alias("body"), (F.size(facts._of("keywords")) > 0).alias("keywords_required"), wanted.alias("required"),
    )


def infer_rules(sections: DataFrame) -> DataFrame:
    """(doc_id, body_font, body_size, min_size, max_size, title_font, title_size, sections): body
    formats weighted by text length, a size band of half a point, required sections but the
    references."""
    body = sections.filter(F.col("type") == "body").filter(is_body(F.col("name"), F.col("text")))
    weight = F.greatest(F.length(F.trim("text")), F.lit(1))
    body = body.withColumn("font", F.col("fmt.font_family")).withColumn("size", F.col("fmt.font_size_pt"))
    font = mode(body, ["doc_id"], "font", weight, F.col("ord")).withColumnRenamed("font", "body_font")
    size = mode(body, ["doc_id"], "size", weight, F.col("ord")).withColumnRenamed("size", "body_size")
    title = lambda c: F.min_by(F.when(F.col("type") == "title", F.col(f"fmt.{c}")), F.when(F.col("type") == "title", F.col("ord")))
    found = sections.groupBy("doc_id").agg(title("font_family").alias("title_font"), title("font_size_pt").alias("title_size"), F.collect_set(F.when(F.col("type") == "heading", F.col("name"))).alias("names"))
    order = F.array(*[F.lit(c) for c in CANONICAL if c not in ("Keywords", "References")])
    out = found.join(font, "doc_id", "left").join(size, "doc_id", "left")
    return out.select(
        "doc_id", "body_font", "body_size", (F.col("body_size") - 0.5).alias("min_size"), (F.col("body_size") + 0.5).alias("max_size"), "title_font", "title_size",
        F.filter(order, lambda n: F.array_contains("names", n)).alias("sections"),
    )


def leaks_identity(has_authors: Column, text: Column) -> Column:
    """Whether a template shows who wrote it: an author block, an address or an institution."""
    t = F.lower(F.coalesce(text, F.lit("")))
    named = F.lit(False)
    for word in INSTITUTIONS:
        named = named | F.contains(t, F.lit(word))
    return F.coalesce(has_authors, F.lit(False)) | F.contains(t, F.lit("@")) | named


def infer_blinding(has_authors: Column, text: Column) -> Column:
    """struct<required, allow_author_block, allow_placeholder, self_citation> of a template."""
    leaks = leaks_identity(has_authors, text)
    return F.struct((~leaks).alias("required"), leaks.alias("allow_author_block"), (~leaks).alias("allow_placeholder"), (~leaks).alias("self_citation"))


def family_signals(info: dict[str, Column], has_abstract: Column, has_keywords: Column, text: Column) -> dict[str, Column]:
    """The signals of the family; ``info``: width, height, left, right, top, bottom, label,
    columns, orientation."""
    wide = (info["width"] - info["left"] - info["right"]) / POINTS_PER_MM
    tall = (info["height"] - info["top"] - info["bottom"]) / POINTS_PER_MM
    words = F.lit(False)
    for w in VOCABULARY:
        words = words | F.contains(F.lower(text), F.lit(w))
    return {
        "a4": info["label"] == "A4", "one_column": info["columns"] == 1, "portrait": info["orientation"] == "portrait",
        "text_width": F.abs(wide - TEXT_WIDTH) < WIDTH_TOLERANCE, "text_height": F.abs(tall - TEXT_HEIGHT) < HEIGHT_TOLERANCE,
        "abstract": has_abstract, "keywords": has_keywords, "vocabulary": words,
    }


def family_score(signals: dict[str, Column]) -> Column:
    """The weight of the signals that hold, over the weight of all."""
    held = sum((F.when(F.coalesce(signals[k], F.lit(False)), w).otherwise(0.0) for k, w in FAMILY.items()), F.lit(0.0))
    return F.round(held / F.lit(sum(FAMILY.values())), 3)


def is_family(signals: dict[str, Column]) -> Column:
    held = sum((F.when(F.coalesce(signals[k], F.lit(False)), int(w * 100)).otherwise(0) for k, w in FAMILY.items()), F.lit(0))
    return held * 100 >= int(FAMILY_THRESHOLD * 100) * sum(int(w * 100) for w in FAMILY.values())


def apply_policy(rules: Column, known: Column) -> Column:
    """A rule set with the family's policy where ``known``: only what the file didn't set, and
    whether authors may be named."""
    s, p, a = rules["sections"], rules["pages"], rules["anonymisation"]
    on = lambda x: F.coalesce(x, F.lit(False))
    sections = s.withField("abstract_required", on(s["abstract_required"]) | FAMILY_POLICY["sections"]["abstract_required"])
    sections = sections.withField("abstract_max_words", F.coalesce(F.nullif(s["abstract_max_words"], F.lit(0)), F.lit(FAMILY_POLICY["sections"]["abstract_max_words"])))
    sections = sections.withField("keywords_required", on(s["keywords_required"]) | FAMILY_POLICY["sections"]["keywords_required"])
    pages = p.withField("max_pages", F.coalesce(F.nullif(p["max_pages"], F.lit(0)), F.lit(FAMILY_POLICY["pages"]["max_pages"])))
    blind = a.withField("required", on(a["required"]) | FAMILY_POLICY["anonymisation"]["required"]).withField("allow_author_block", F.lit(FAMILY_POLICY["anonymisation"]["allow_author_block"]))
    return F.when(known, rules.withField("sections", sections).withField("pages", pages).withField("anonymisation", blind)).otherwise(rules)


def presets_frame(spark) -> DataFrame:
    from foliolith.operators.rules import rules_frame

    return rules_frame(spark, PRESETS)


def rule_schema(spark) -> DataFrame:
    """(group, path, type): every field that a rule set can hold, from its own schema."""
    from foliolith.operators.rules import rules_frame
    from pyspark.sql.types import ArrayType, StructType

    rows = []

    def walk(prefix: str, kind: StructType):
        for f in kind.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            if isinstance(f.dataType, StructType):
                walk(path, f.dataType)
            else:
                what = "list" if isinstance(f.dataType, ArrayType) else {"string": "text", "boolean": "bool"}.get(f.dataType.simpleString(), "number")
                rows.append((path.split(".")[0], path, what))

    walk("", rules_frame(spark, {"x": {}}).schema["rules"].dataType)
    return spark.createDataFrame(rows, "group string, path string, type string")
