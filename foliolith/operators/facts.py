"""Facts of papers: one row a document, from its classified sections and what its file tells.

The sections of a document are one array; every fact is a column over it, so one exchange by
document serves all facts and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolith.functions import text as T
from foliolith.functions import values as V
from foliolith.operators import rules
from foliolith.operators.structure import ABSTRACT_CHARS, FLAGS

# Fields of a file's metadata that can name an author, and what LaTeX sources
# hold for floats, formulas and entries.
LEAKS = ("author", "creator", "producer", "title", "subject", "keywords")
LATEX_ASSETS = {
    "figures": r"\\begin\{figure\*?\}", "tables": r"\\begin\{table\*?\}", "equations": r"\\begin\{(?:equation|align|gather|eqnarray|multline)\*?\}",
    "algorithms": r"\\begin\{algorithm\*?\}", "listings": r"\\begin\{lstlisting\}", "bibliography_items": r"\\bibitem\b",
}
MARGINS = ("top", "bottom", "left", "right")


def _of(kind: str, s: Column | str = "s") -> Column:
    return F.filter(s, lambda x: x["type"] == kind)


def _first(kind: str, field: str = "text") -> Column:
    return F.get(_of(kind), F.lit(0))[field]


def mode_in(values: Column) -> Column:
    """The most frequent value of an array, the first seen among equals; nulls don't count."""
    known = F.filter(values, lambda v: v.isNotNull())
    seen = F.transform(F.array_distinct(known), lambda v, i: F.struct(F.size(F.filter(known, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(seen)["v"]


def mostly_in(flags: Column) -> Column:
    """Whether true is no rarer than false in an array; null without either."""
    yes, no = F.size(F.filter(flags, lambda v: v)), F.size(F.filter(flags, lambda v: ~v))
    return F.when(yes + no > 0, yes >= no)


def format_of(sections: Column, attribute: str) -> Column:
    each = F.transform(sections, lambda x: x["fmt"][attribute])
    return mostly_in(each) if attribute in FLAGS else mode_in(each)


def histogram(values: Column) -> Column:
    """map of an array's values to how often they occur, the most frequent first."""
    known = F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != ""))
    n = F.transform(F.array_distinct(known), lambda v, i: F.struct((-F.size(F.filter(known, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
    return F.map_from_entries(F.transform(F.array_sort(n), lambda x: F.struct(x["v"], (-x["n"]).cast("bigint"))))


def _texts(sections: Column, by: str) -> Column:
    return F.array_join(F.transform(sections, lambda x: F.coalesce(x["text"], F.lit(""))), by)


def snippet(text: Column, pattern: str, before: int = 0) -> Column:
    """SNIPPET characters from the first match on, and ``before`` ones ahead of it."""
    return F.coalesce(T.window_at(text, T._u(pattern, True), before, T.SNIPPET), F.lit(""))


def references_of(sections: Column) -> Column:
    """struct<n, confidence>: entries of the bibliography's body blocks; high if every other
    entry has a year; nothing is known without such blocks."""
    body = F.filter(sections, lambda x: (x["type"] == "body") & (x["name"] == "References"))
    n = F.aggregate(body, F.lit(0), lambda a, x: a + T.reference_parts(x["text"]))
    years = F.size(F.filter(body, lambda x: x["text"].rlike(T._u(T.REFERENCE_YEAR))))
    sure = F.when(years >= F.greatest(F.lit(1), F.floor(n / 2)), "high").otherwise("medium")
    return F.struct(
        F.when((F.size(body) > 0) & (n > 0), n).alias("n"),
        F.when(F.size(body) == 0, "unknown").when(n == 0, "low").otherwise(sure).alias("confidence"),
    )


def assets_of(full: Column, latex: Column) -> Column:
    """struct of counts: in LaTeX documents the commands that their text still holds, else the
    largest number that is referred to."""
    count = {k: T.count_of(full, p) for k, p in LATEX_ASSETS.items()}
    figures = F.when(count["figures"] > 0, count["figures"]).otherwise(T.count_of(full, r"\\includegraphics"))
    refer = {"figures": T.FIGURE, "tables": T.TABLE, "equations": T.EQUATION}
    cells = [F.when(latex, figures if k == "figures" else count[k]).otherwise(T.largest_number(full, refer[k]) if k in refer else F.lit(0)).alias(k) for k in LATEX_ASSETS]
    notes = F.when(latex, F.regexp_count(full, F.lit(r"\b(?:footnote|thanks)\b"))).otherwise(T.footnotes(full))
    return F.struct(*cells, notes.alias("footnotes"), F.when(latex, "high").otherwise("medium").alias("confidence"))


def collected(sections: DataFrame) -> DataFrame:
    """(doc_id, s): the sections of each document in order."""
    return sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "name", "text", "fmt"))).alias("s"))


def assemble(sections: DataFrame, info: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, error, facts, assets, identity_notes, typography_notes, structure_notes, warnings).

    ``sections`` as classify_blocks gives them; ``info``: doc_id, filename, extension, format,
    size, error, width, height, label, orientation, columns, top, bottom, left, right,
    page_count, page_count_exact, title, anonymous_package, metadata (map). ``facts`` is what
    rules look at; the rest is what reports show. A document without sections has its file
    facts and an error. ``only``: groups and facts (group.name) to compute, the others are null;
    a struct is made whole, whatever a reader asks of it.
    """
    d = info.join(collected(sections), "doc_id", "left").withColumn("s", F.coalesce("s", F.array().cast(collected(sections).schema["s"].dataType)))
    body = _of("body")
    d = d.withColumn("full", _texts(F.col("s"), "\n")).withColumn("body", body).withColumn("heads", _of("heading"))
    d = d.withColumn("title_text", F.coalesce(_first("title"), F.col("title"), F.lit(""))).withColumn("author_text", F.trim(F.coalesce(_first("authors"), F.lit(""))))
    d = d.withColumn("refs", references_of(F.col("s"))).withColumn("latex", F.coalesce(F.col("format") == "latex", F.lit(False)))
    d = d.withColumn("names", T.person_names(F.col("author_text"), F.coalesce("title", F.lit("")))).withColumn("assets", assets_of(F.col("full"), F.col("latex")))
    full, has_authors = F.col("full"), F.col("author_text") != ""
    placeholder = T.has(F.col("author_text"), T.PLACEHOLDER) & (F.size("names") == 0)
    ack = F.get(F.filter("heads", lambda x: T.has(x["name"], T.ACK_HEADING)), F.lit(0))["name"]
    ack_body = F.array_join(F.transform(F.filter("body", lambda x: x["name"] == ack), lambda x: x["text"]), " ")
    ack_phrase = T.has(full, T.ACK_PHRASE)
    keywords = F.when(_first("keywords").isNotNull(), T.keyword_list(_first("keywords")))
    # Bibliographies named in the source are exact.
    items = F.col("assets")["bibliography_items"]
    n_refs = F.when(F.col("latex") & (items > 0), items).otherwise(F.col("refs")["n"])
    leaks = F.transform_values(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*LEAKS) & (F.coalesce(v, F.lit("")) != "")), lambda k, v: F.substring(v, 1, T.SNIPPET))
    fmt = lambda a: format_of(F.col("body"), a)
    sizes = F.array_sort(F.array_distinct(F.filter(F.transform("body", lambda x: x["fmt"]["font_size_pt"]), lambda v: v.isNotNull() & (v != 0))))
    words = lambda t: F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + T.word_count(x["text"]))
    exact = F.coalesce("page_count_exact", F.lit(False))
    loose = ~F.col("format").isin("latex", "docx")
    facts = {
        "file": {"filename": F.col("filename"), "extension": F.col("extension"), "format": F.col("format"), "size_bytes": F.col("size").cast("bigint")},
        "layout": {
            "page_count": F.col("page_count").cast("int"), "page_count_exact": exact, "width": F.col("width"), "height": F.col("height"), "page_size_label": F.col("label"), "orientation": F.col("orientation"),
            "columns": F.col("columns").cast("int"), "margins": F.struct(*[F.col(m) for m in MARGINS]), "margins_confidence": F.when(loose, "low").otherwise("exact"),
        },
        "typography": {
            "dominant_font": fmt("font_family"), "body_font": fmt("font_family"), "body_font_size_pt": fmt("font_size_pt"), "title_font_size_pt": F.get(_of("title"), F.lit(0))["fmt"]["font_size_pt"],
            "heading_font_size_pt": format_of(F.col("heads"), "font_size_pt"), "line_spacing": fmt("line_spacing"), "first_line_indent_pt": fmt("indent_first_line_pt"), "space_above_pt": fmt("space_above_pt"),
            "space_below_pt": fmt("space_below_pt"), "sizes": sizes, "alignments": histogram(F.transform("body", lambda x: x["fmt"]["alignment"])),
        },
        "structure": {
            "title_text": F.col("title_text"), "sections": F.filter(F.transform("heads", lambda x: x["name"]), lambda n: n.isNotNull()), "headings": F.transform("heads", lambda x: x["text"]),
            "has_abstract": _first("abstract").isNotNull(), "abstract_words": F.when(_first("abstract").isNotNull(), T.word_count(_first("abstract"))), "has_keywords": _first("keywords").isNotNull(),
            "references": n_refs.cast("int"), "author_text": F.substring("author_text", 1, T.SNIPPET), "body_words": words(F.col("body")), "total_words": words(F.col("s")),
        },
        "identity": {
            "author_block": has_authors & ~placeholder, "placeholder_only": has_authors & placeholder, "emails": T.emails(full), "affiliations": T.affiliations(full), "orcids": T.orcids(full),
            "acknowledgement": ack.isNotNull() | ack_phrase, "acknowledgement_text": F.when(ack.isNotNull(), F.substring(ack_body, 1, T.SNIPPET)).otherwise(snippet(full, T.ACK_PHRASE)),
            "funding": T.has(full, T.FUNDING), "funding_text": snippet(full, T.FUNDING, 80), "self_citations": T.count_of(full, T.SELF_CITATION),
            "placeholder": T.has(full, T.PLACEHOLDER) | F.coalesce("anonymous_package", F.lit(False)), "leaks": F.when(F.col("format") == "pdf", leaks).otherwise(F.create_map().cast("map<string,string>")),
        },
    }
    if only:
        groups = rules.facts_of({name: {k: c for k, c in g.items() if name in only or f"{name}.{k}" in only} for name, g in facts.items()})
    else:
        groups = F.struct(*[F.struct(*[c.alias(k) for k, c in g.items()]).alias(name) for name, g in facts.items()])
    numbered = F.filter("heads", lambda x: x["text"].rlike(T._u(T.HEADING_NUMBER)))
    warnings = F.array_compact(F.array(
        F.when(F.col("page_count").isNotNull() & (F.col("page_count") > 0) & ~exact, F.format_string("Page count (%s) is an estimate: %s sources are not paginated until rendered.", F.col("page_count"), F.col("format"))),
        F.when(loose, "Margins are estimated from content extents in PDFs; headers and footers can skew them."),
    ))
    return d.select(
        "doc_id", "error", groups.cast(rules.facts_schema()).alias("facts"), "assets",
        F.struct(F.slice("names", 1, 10).alias("names"), T.urls(full).alias("urls"), F.when(F.col("latex") & (items > 0), "exact").otherwise(F.col("refs")["confidence"]).alias("reference_confidence")).alias("identity_notes"),
        F.struct(histogram(F.transform("s", lambda x: x["fmt"]["font_family"])).alias("fonts_used")).alias("typography_notes"),
        F.struct(
            F.transform(numbered, lambda x: x["name"]).alias("numbered_headings"), F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"),
            (F.length(_first("abstract")) >= ABSTRACT_CHARS).alias("abstract_truncated"),
        ).alias("structure_notes"),
        warnings.alias("warnings"),
    )


def summary(facts: DataFrame) -> DataFrame:
    """The ten facts that lists of papers show."""
    f = lambda path: F.col(f"facts.{path}")
    return facts.select(
        "doc_id", f("file.format").alias("format"), f("layout.page_count").alias("pages"), f("layout.page_count_exact").alias("pages_exact"), f("structure.total_words").alias("words"),
        f("typography.body_font").alias("body_font"), f("typography.body_font_size_pt").alias("body_size"), F.size(f("structure.sections")).alias("sections"),
        F.col("assets.figures").alias("figures"), F.col("assets.tables").alias("tables"), f("structure.references").alias("references"),
    )


def display(sections: DataFrame, info: DataFrame) -> DataFrame:
    """(doc_id, title, authors, author_block, emails, affiliations, orcids) for display."""
    d = info.join(collected(sections), "doc_id", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.when(F.col("format") == "pdf", F.nullif(F.try_element_at("metadata", F.lit("title")), F.lit(""))), F.lit(""))
    block, full = F.trim(F.coalesce(_first("authors"), F.lit(""))), _texts(F.col("s"), "\n")
    return d.select("doc_id", title.alias("title"), T.person_names(block, F.coalesce("title", F.lit(""))).alias("authors"), block.alias("author_block"), T.emails(full).alias("emails"), T.affiliations(full).alias("affiliations"), T.orcids(full).alias("orcids"))


def file_facts(files: DataFrame) -> DataFrame:
    """(filename, extension, format, size, sha256) of raw files."""
    return files.select("filename", F.coalesce(V.extension(F.col("filename")), F.lit("")).alias("extension"), V.sniff_format(F.col("content"), F.col("filename")).alias("format"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
