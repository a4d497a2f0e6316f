"""Sequence operators over ordered blocks: sections, dominant formats, pages, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolith.functions import text as T
from foliolith.functions import values as V

FORMAT = (
    "font_family string, font_size_pt double, bold boolean, italic boolean, alignment string, line_spacing double, "
    "space_above_pt double, space_below_pt double, indent_first_line_pt double, indent_start_pt double, indent_end_pt double"
)
ATTRIBUTES = [x.split()[0] for x in FORMAT.split(", ")]
FLAGS = ("bold", "italic")
BLOCKS = f"doc_id bigint, pos int, text string, fmt struct<{', '.join(x.replace(' ', ':') for x in FORMAT.split(', '))}>, heading_style boolean"
ABSTRACT_CHARS = 2000
AUTHORS_CHARS = 400


def mode(df: DataFrame, keys: list[str], value: str, weight: Column, order: Column) -> DataFrame:
    """The heaviest value of each group, the first seen among equals; nulls don't count."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__w"), F.min(order).alias("__o"))
    return per.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("__w"), -F.col("__o"))).alias(value))


def majority(df: DataFrame, keys: list[str], flag: Column, weight: Column, name: str) -> DataFrame:
    """Whether true weighs no less than false in each group; null without either."""
    yes, no = F.sum(F.when(flag, weight).otherwise(0)), F.sum(F.when(~flag, weight).otherwise(0))
    return df.groupBy(*keys).agg(F.when(yes + no > 0, yes >= no).alias(name))


def aggregate_formats(df: DataFrame, keys: list[str], weight: Column, order: Column, fmt: str = "fmt") -> DataFrame:
    """One format for each group: the weighted mode of each attribute (ties: first seen), for
    flags the weighted majority (ties: true). One exchange by the keys serves all steps."""
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"{fmt}.{a}").cast("string").alias("v")) for a in ATTRIBUTES])
    flat = df.select(*keys, weight.alias("w"), order.alias("o"), F.explode(names).alias("x")).filter("x.v is not null")
    per = flat.repartition(*keys).groupBy(*keys, "x.a", "x.v").agg(F.sum("w").alias("w"), F.min("o").alias("o"))
    flag = F.col("a").isin(*FLAGS)
    tie = F.when(flag, (F.col("v") == "true").cast("double")).otherwise(-F.col("o").cast("double"))
    best = per.groupBy(*keys, "a").agg(F.max_by("v", F.struct("w", tie)).alias("v"))
    kinds = dict(x.split() for x in FORMAT.split(", "))
    cells = [F.max(F.when(F.col("a") == a, F.col("v"))).cast(kinds[a]).alias(a) for a in ATTRIBUTES]
    return best.groupBy(*keys).agg(*cells).select(*keys, F.struct(*ATTRIBUTES).alias(fmt))


def reference_start(blocks: DataFrame) -> DataFrame:
    """(doc_id, ref_start): where the last run of two or more bibliography entries begins."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.select("doc_id", "pos", T.is_reference_entry(F.col("text")).alias("ref"))
    b = b.withColumn("island", F.sum(F.when(~F.col("ref"), 1).otherwise(0)).over(w)).filter("ref")
    runs = b.groupBy("doc_id", "island").agg(F.count("*").alias("n"), F.min("pos").alias("start")).filter("n >= 2")
    return runs.groupBy("doc_id").agg(F.max("start").alias("ref_start"))


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, type, name, text, fmt): the sections of each document, in order.

    Title, authors up to the first heading, keywords line, heading style or long block, then
    headings that carry forward as the section of what follows. Abstract blocks are joined
    up to the next heading and cut; a trailing bibliography is references. All steps are
    windows and groups by doc_id, so one exchange serves them.
    """
    by = Window.partitionBy("doc_id")
    upto = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.repartition("doc_id")
    b = b.join(reference_start(b), "doc_id", "left")
    canonical, keywords = T.canonical_section(F.col("text")), T.is_keywords_line(F.col("text"))
    style = F.coalesce("heading_style", F.lit(False))
    b = b.withColumn("canonical", canonical).withColumn("kw", keywords).withColumn("style", style)
    b = b.withColumn("is_title", (F.col("pos") == F.min("pos").over(by)) & ~F.coalesce(F.col("canonical") == "Abstract", F.lit(False)))
    stops = F.col("canonical").isNotNull() | F.col("kw") | (F.length("text") > AUTHORS_CHARS) | F.col("style")
    b = b.withColumn("stop", F.min(F.when(~F.col("is_title") & stops, F.col("pos"))).over(by))
    in_authors = ~F.col("is_title") & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    upper = (F.col("text") == F.upper("text")) & (F.col("text") != F.lower("text"))
    kind = (
        F.when(F.col("is_title"), "title").when(in_authors, "authors")
        .when(F.col("canonical").isNull() & (F.col("pos") >= F.col("ref_start")), "references")
        .when(F.col("canonical").isNotNull(), "heading").when(F.col("kw"), "keywords")
        .when(F.col("style") | T.is_caps_heading(F.col("text")), "heading")
    )
    b = b.withColumn("type", kind)
    own = F.when(F.col("type") == "keywords", "Keywords").when(F.col("type") == "heading", F.coalesce("canonical", F.when(upper, T.title_case(F.col("text"))).otherwise(F.col("text"))))
    b = b.withColumn("own", own)
    b = b.withColumn("section", F.last("own", ignorenulls=True).over(upto))
    b = b.withColumn("flush", F.sum(F.col("own").isNotNull().cast("int")).over(upto))
    b = b.withColumn("type", F.coalesce("type", F.when(F.col("section") == "Abstract", "abstract").otherwise("body")))
    single = b.filter(~F.col("type").isin("authors", "abstract")).select(
        "doc_id", F.col("pos").cast("double").alias("ord"), "type",
        F.when(F.col("type") == "body", F.col("section")).otherwise(F.col("own")).alias("name"),
        F.when(F.col("type") == "keywords", T.keywords_text(F.col("text"))).otherwise(F.col("text")).alias("text"), "fmt",
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    authors = b.filter("type = 'authors'").groupBy("doc_id").agg(F.min("pos").cast("double").alias("ord"), joined.alias("text"), F.min_by("fmt", "pos").alias("fmt"))
    authors = authors.select("doc_id", "ord", F.lit("authors").alias("type"), F.lit(None).cast("string").alias("name"), "text", "fmt")
    raw = b.filter("type = 'abstract'")
    abstract = raw.groupBy("doc_id", "flush").agg((F.max("pos") + 0.5).alias("ord"), F.substring(joined, 1, ABSTRACT_CHARS).alias("text"))
    formats = aggregate_formats(raw, ["doc_id", "flush"], F.lit(1), F.col("pos"))
    abstract = abstract.join(formats, ["doc_id", "flush"], "left").select("doc_id", "ord", F.lit("abstract").alias("type"), F.lit(None).cast("string").alias("name"), "text", "fmt")
    out = single.unionByName(authors).unionByName(abstract)
    # Opaque to the pruning of nested fields, which loses attributes across these branches.
    return out.withColumn("fmt", F.get(F.transform(F.array("fmt"), lambda x: x), F.lit(0)))


def first_of(sections: DataFrame, kind: str, value: str = "text") -> Column:
    """Aggregate: a field of the first section of a type."""
    return F.min_by(F.when(F.col("type") == kind, F.col(value)), F.when(F.col("type") == kind, F.col("ord")))


def full_text() -> Column:
    """Aggregate: the texts of all sections, by line."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")


def estimate_pages(sections: DataFrame, page: DataFrame, size: float = 10.0) -> DataFrame:
    """(doc_id, pages): lines that the texts need, over the lines that a page holds.

    ``page``: doc_id, width, height, left, right, top, bottom. Characters advance by half
    the size (monospace .6); lines stand 1.2 times size and spacing apart.
    """
    body = mode(sections.filter("type = 'body'").withColumn("size", F.col("fmt.font_size_pt")).filter("size > 0"), ["doc_id"], "size", F.lit(1), F.col("ord"))
    spacing = mode(sections.withColumn("spacing", F.col("fmt.line_spacing")).filter("spacing > 0"), ["doc_id"], "spacing", F.lit(1), F.col("ord"))
    s = sections.join(page, "doc_id").join(body, "doc_id", "left").join(spacing, "doc_id", "left")
    base = F.coalesce("size", F.lit(size))
    mono = F.lower(F.coalesce("fmt.font_family", F.lit(""))).rlike("courier|consolas|menlo|monaco|mono")
    own = F.greatest(F.coalesce(F.nullif(F.col("fmt.font_size_pt"), F.lit(0.0)), base), F.lit(1.0))
    per_line = F.greatest((F.col("width") - F.col("left") - F.col("right")) / (F.when(mono, 0.6).otherwise(0.5) * own), F.lit(8.0))
    lines = F.when(F.trim("text") == "", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.length("text") / per_line)))
    height = F.greatest(base, F.lit(1.0)) * 1.2 * F.coalesce("spacing", F.lit(1.0))
    per_page = F.greatest(F.lit(1.0), (F.col("height") - F.col("top") - F.col("bottom")) / height)
    room = (F.col("width") - F.col("left") - F.col("right") > 0) & (F.col("height") - F.col("top") - F.col("bottom") > 0)
    out = s.groupBy("doc_id").agg(F.sum(lines).alias("n"), F.first(per_page).alias("p"), F.first(room).alias("room"))
    return out.select("doc_id", F.when(F.col("room"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("p")))).otherwise(1).cast("int").alias("pages"))


# Layout of page geometry. ``spans``: doc_id, page, block, line, x0, y0, x1, y1, baseline,
# text, size, font, bold, italic, page_width, page_height. The most pages that
# are read, the free band beside the middle, and what makes a page and a document two-column.

MOST_PAGES = 60
GAP = 12.0
COLUMN_LINES, CROSSING, TWO_COLUMN_LINES, TWO_COLUMN_PART = 5, 0.25, 20, 0.6
BLOCK = ["doc_id", "page", "block"]


def text_lines(spans: DataFrame) -> DataFrame:
    """One row a line: its box, joined text, heaviest size (by characters) and flags."""
    keys = [*BLOCK, "line"]
    size = mode(spans, keys, "size", F.length("text"), F.col("x0"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), "")
    w = F.length("text")
    heavy = lambda c: F.sum(F.when(F.col(c), w).otherwise(0)) >= F.sum(F.when(F.col(c), 0).otherwise(w))
    lines = spans.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("baseline").alias("baseline"),
        F.trim(F.regexp_replace(parts, r"\s+", " ")).alias("text"), heavy("bold").alias("bold"), heavy("italic").alias("italic"),
        F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"),
        F.min_by("font", "x0").alias("font"), F.bool_or("bold").alias("any_bold"),
    )
    return lines.join(size, keys)


def page_layout(lines: DataFrame) -> DataFrame:
    """(doc_id, page, ...): the extents of each page's lines and of its two columns if it has them."""
    mid = F.col("page_width") / 2
    left, right, cross = F.col("x1") <= mid - GAP, F.col("x0") >= mid + GAP, (F.col("x0") < mid) & (F.col("x1") > mid)
    p = lines.groupBy("doc_id", "page").agg(
        F.max("page_width").alias("width"), F.max("page_height").alias("height"), F.count("*").alias("n"),
        F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.count_if(cross).alias("c"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))],
        F.min(F.when(left, F.col("x0"))).alias("lx0"), F.max(F.when(left, F.col("x1"))).alias("lx1"),
        F.min(F.when(right, F.col("x0"))).alias("rx0"), F.max(F.when(right, F.col("x1"))).alias("rx1"), F.min(F.when(left | right, F.col("y0"))).alias("band_top"),
    )
    few = F.col("c") <= CROSSING * (F.col("l") + F.col("r") + F.col("c"))
    return p.withColumn("two", (F.col("l") >= COLUMN_LINES) & (F.col("r") >= COLUMN_LINES) & few)


def columns_of(lines: DataFrame) -> DataFrame:
    """(doc_id, columns): 2 if enough lines stand in the columns of two-column pages."""
    doc = page_layout(lines).groupBy("doc_id").agg(F.sum(F.when(F.col("two"), F.col("l") + F.col("r")).otherwise(0)).alias("two"), F.sum("n").alias("n"))
    return doc.select("doc_id", F.when((F.col("two") >= TWO_COLUMN_LINES) & (F.col("two") / F.col("n") >= TWO_COLUMN_PART), 2).otherwise(1).alias("columns"))


def margins_of(lines: DataFrame) -> DataFrame:
    """(doc_id, left, right, top, bottom): medians over pages of the lines' extents, against
    the first page's size; 0 to 200."""
    p = page_layout(lines).groupBy("doc_id").agg(*[F.median(c).alias(c) for c in ("x0", "x1", "y0", "y1")], F.min_by("width", "page").alias("w"), F.min_by("height", "page").alias("h"))
    clamp = lambda c, name: F.round(F.least(F.lit(200.0), F.greatest(F.lit(0.0), c)), 1).alias(name)
    return p.select("doc_id", clamp(F.col("x0"), "left"), clamp(F.col("w") - F.col("x1"), "right"), clamp(F.col("y0"), "top"), clamp(F.col("h") - F.col("y1"), "bottom"))


def block_regions(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block, rx0, rx1): the column that holds a block's centre, else the nearer
    one; the whole band above the columns and on pages without two."""
    b = lines.groupBy(*BLOCK).agg(F.max("y1").alias("by1"), F.avg((F.col("x0") + F.col("x1")) / 2).alias("centre"))
    j = b.join(page_layout(lines).withColumnsRenamed({"rx0": "qx0", "rx1": "qx1"}), ["doc_id", "page"])
    within = lambda lo, hi: F.col("centre").between(F.col(lo), F.col(hi))
    away = lambda lo, hi: F.least(F.abs(F.col("centre") - F.col(lo)), F.abs(F.col("centre") - F.col(hi)))
    left = within("lx0", "lx1") | (~within("qx0", "qx1") & (away("lx0", "lx1") <= away("qx0", "qx1")))
    above = F.col("by1") <= F.col("band_top") - 2.0
    pick = lambda all_, l, r, both: F.when(~F.col("two"), F.col(all_)).when(above, both).when(left, F.col(l)).otherwise(F.col(r))
    return j.select(*BLOCK, pick("x0", "lx0", "qx0", F.least("lx0", "qx0")).alias("rx0"), pick("x1", "lx1", "qx1", F.greatest("lx1", "qx1")).alias("rx1"))


def alignment_of(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block, alignment) from the gaps to the block's column, rx0 to rx1; null
    where the column is narrow or the gaps tell nothing."""
    width, col = F.col("x1") - F.col("x0"), F.col("rx1") - F.col("rx0")
    g = lines.groupBy(*BLOCK).agg(
        F.max(col).alias("col"), F.median(F.col("x0") - F.col("rx0")).alias("l"), F.median(F.col("rx1") - F.col("x1")).alias("r"),
        F.bool_and(F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("rx0") + F.col("rx1")) / 2) <= 10.0).alias("even"),
        F.max(width).alias("widest"), F.median(width / col).alias("fill"), F.count("*").alias("n"),
    )
    how = (
        F.when(F.col("col") < 30, None).when(F.col("even") & (F.col("widest") <= F.col("col") * 0.92), "center")
        .when((F.col("l") <= 3) & (F.col("r") <= 3) & (F.col("n") >= 3) & (F.col("fill") > 0.85), "justified")
        .when(F.col("l") <= 3, "left").when((F.col("r") <= 3) & (F.col("l") > 10), "right")
    )
    return g.select(*BLOCK, how.alias("alignment"))


def line_spacing_of(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block, line_spacing): median step of baselines over the median size,
    within 0.5 and 4."""
    w = Window.partitionBy(*BLOCK).orderBy("baseline")
    step = lines.withColumn("step", F.col("baseline") - F.lag("baseline").over(w))
    g = step.groupBy(*BLOCK).agg(F.median(F.when(F.col("step") > 0, F.col("step"))).alias("step"), F.median(F.when(F.col("size") > 0, F.col("size"))).alias("size"))
    x = F.col("step") / F.col("size")
    return g.select(*BLOCK, F.when((x > 0.5) & (x < 4), F.round(x, 2)).alias("line_spacing"))


def first_indent_of(lines: DataFrame, alignment: DataFrame) -> DataFrame:
    """(doc_id, page, block, indent): how far the first line of a left or justified block of
    several lines stands in from the others, if by more than 3 points, else 0."""
    first = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("line", "x0")) == 1
    g = lines.withColumn("first", first).groupBy(*BLOCK).agg(F.max(F.when(F.col("first"), F.col("x0"))).alias("a"), F.min(F.when(~F.col("first"), F.col("x0"))).alias("b"))
    gap = F.col("a") - F.col("b")
    fits = F.col("alignment").isin("left", "justified") & F.col("b").isNotNull()
    return g.join(alignment, BLOCK).select(*BLOCK, F.when(fits, F.when(gap > 3, F.round(gap, 1)).otherwise(0.0)).alias("indent"))


def heading_like(text: Column, bold: Column, size: Column, body_size: Column) -> Column:
    """Short, few words, no end of a sentence, and bold or a fifth larger than the body."""
    big = F.coalesce(size >= body_size * 1.2, F.lit(False))
    return (F.length(text) <= 90) & (T.word_count(text) <= 12) & ~F.rtrim(text).rlike("[.,;]$") & (F.coalesce(bold, F.lit(False)) | big)


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, pos, text, fmt, heading_style): the blocks of the first MOST_PAGES pages, in
    order, with the format that their characters tell. A first line that names a section is
    a block of its own."""
    spans = spans.filter(F.col("page") < MOST_PAGES)
    lines = text_lines(spans)
    body = lines.filter(T.word_count(F.col("text")) >= 12).filter("size > 0").groupBy("doc_id").agg(F.median("size").alias("body_size"))
    weight = F.greatest(F.length("text"), F.lit(1))
    clean = spans.withColumn("font", F.nullif(T.clean_font(F.col("font")), F.lit(""))).withColumn("size", F.round("size", 2))
    at = F.struct("line", "x0")
    heavy = lambda c: F.sum(F.when(F.col(c), weight).otherwise(0)) >= F.sum(F.when(F.col(c), 0).otherwise(weight))
    flags = spans.groupBy(*BLOCK).agg(heavy("bold").alias("bold"), heavy("italic").alias("italic"))

    def heaviest(c):
        per = clean.filter(F.col(c).isNotNull()).groupBy(*BLOCK, c).agg(F.sum(weight).alias("w"), F.min(at).alias("o"))
        best = Window.partitionBy(*BLOCK).orderBy(F.desc("w"), "o")
        return per.withColumn("n", F.row_number().over(best)).filter("n = 1").select(*BLOCK, c)

    regions = block_regions(lines)
    lines = lines.join(regions, BLOCK).withColumn("first", F.row_number().over(Window.partitionBy(*BLOCK).orderBy("line")) == 1)
    align = alignment_of(lines)
    rest = alignment_of(lines.filter(~F.col("first"))).withColumnRenamed("alignment", "rest_alignment")
    joined = lambda c: F.trim(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("line", F.trim("text").alias("t"))))), lambda x: x["t"]), " "), r"\s+", " "))
    head = lambda c: F.max(F.when(F.col("first"), F.col(c)))
    b = lines.groupBy(*BLOCK).agg(
        joined(F.lit(True)).alias("text"), joined(~F.col("first")).alias("rest"), head("text").alias("first_text"), head("font").alias("first_font"),
        head("size").alias("first_size"), head("any_bold").alias("first_bold"), F.count("*").alias("n"),
    )
    for part in (flags, heaviest("font"), heaviest("size"), align, rest, line_spacing_of(lines), first_indent_of(lines, align)):
        b = b.join(part, BLOCK, "left")
    b = b.join(body, "doc_id", "left").filter("text <> ''")
    bare = T.strip_numbering(F.trim("first_text"))
    names = T.canonical_section(bare).isNotNull() | T.is_keywords_line(bare)
    split = (F.col("n") > 1) & names & ~F.col("text").rlike("(?i)" + T.KEYWORDS)
    style = heading_like(F.col("text"), F.col("bold"), F.col("size"), F.col("body_size"))
    kinds = dict(x.split() for x in FORMAT.split(", "))
    fmt = lambda **c: F.struct(*[c.get(x, F.lit(None)).cast(kinds[x]).alias(x) for x in ATTRIBUTES])
    row = lambda part, text, f, st: F.struct(F.lit(part).alias("part"), text.alias("text"), f.alias("fmt"), st.alias("heading_style"))
    col = F.col
    whole = row(0, col("text"), fmt(font_family=col("font"), font_size_pt=col("size"), bold=col("bold"), italic=col("italic"), alignment=col("alignment"), line_spacing=col("line_spacing"), indent_first_line_pt=col("indent")), style)
    top = row(0, F.trim("first_text"), fmt(font_family=T.clean_font(col("first_font")), font_size_pt=col("first_size"), bold=col("first_bold"), alignment=col("alignment")), style)
    tail = row(1, col("rest"), fmt(font_family=col("font"), font_size_pt=col("size"), italic=col("italic"), alignment=col("rest_alignment"), line_spacing=col("line_spacing")), F.lit(False))
    out = b.select(*BLOCK, F.explode(F.when(split, F.array(top, tail)).otherwise(F.array(whole))).alias("x")).select(*BLOCK, "x.*").filter("text <> ''")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block", "part")) - 1
    return out.select("doc_id", pos.alias("pos"), "text", "fmt", "heading_style")


def document_info(spans: DataFrame) -> DataFrame:
    """(doc_id, width, height, label, orientation, columns, left, right, top, bottom,
    page_count) of documents given as spans; the count is exact."""
    first = spans.groupBy("doc_id").agg(F.min_by("page_width", "page").alias("width"), F.min_by("page_height", "page").alias("height"), (F.max("page") + 1).alias("page_count"))
    lines = text_lines(spans.filter(F.col("page") < MOST_PAGES))
    info = first.join(columns_of(lines), "doc_id", "left").join(margins_of(lines), "doc_id", "left")
    return info.select(
        "doc_id", F.round("width", 2).alias("width"), F.round("height", 2).alias("height"), V.page_label(F.col("width"), F.col("height")).alias("label"),
        F.when(F.col("width") > F.col("height"), "landscape").otherwise("portrait").alias("orientation"), "columns", "left", "right", "top", "bottom", "page_count",
    )


def page_labels(pages: DataFrame) -> DataFrame:
    return pages.withColumn("label", V.page_label(F.col("width"), F.col("height")))
