"""Queries of the checking core over the driver's tables: documents are papers, lines are
blocks, sources are batches, lineitem rows are check results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.functions import text as T
from foliolith.functions import values as V
from foliolith.operators import decisions, diffs, inference, relational, rules, structure
from foliolith.session import table as t
from foliolith.sources import files

RULESET = {
    "name": "house rules", "file_type": {"accepted": ["en", ".DE"], "max_mb": 0.004}, "pages": {"max_pages": 8, "min_pages": 1},
    "sections": {"abstract_required": False},
    "anonymisation": {"required": True, "terms": ["that"]}, "decision": {"reject_warning": False, "min_score": 60},
}
ASCII_EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]{2,}"
ASCII_ID = r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{3}[0-9Xx]"


def paper_facts(docs: DataFrame) -> DataFrame:
    """(paper_id, batch_id, rules_id, facts, error) of documents: what their text tells."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, "[ \\t\\n\\r]+"), ""))
    facts = rules.facts_of({
        "file": {"filename": F.col("doc_id").cast("string"), "extension": F.col("lang"), "format": F.lit("pdf"), "size_bytes": F.col("n_chars")},
        "layout": {"page_count": F.greatest(F.lit(1), F.ceil(words / 300)), "page_count_exact": F.lit(False)},
        "structure": {"title_text": F.substring_index(text, "\n", 1), "has_abstract": F.lit(False), "total_words": words},
        "identity": {"emails": T.distinct_matches(text, ASCII_EMAIL), "orcids": T.distinct_matches(text, ASCII_ID)},
    })
    return docs.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("batch_id"), F.lit("house").alias("rules_id"), facts.alias("facts"), F.when(F.col("text").isNull(), "no text").alias("error"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    papers = paper_facts(t(spark, sf, "documents"))
    return rules.check_results(rules.with_rules(papers, rules.rules_frame(spark, {"house": RULESET})), carry=["batch_id"])


def verdicts(spark, sf):
    policy = {"reject_blocking": True, "reject_warning": False, "min_score": 60}
    a = decisions.assess(results(spark, sf), policy, ["paper_id", "batch_id"])
    return a.select("paper_id", "batch_id", "passed", "failed", "missing", "not_applicable", "blocking", "warnings", "score", "verdict")


_COUNTS = f"""
x AS (SELECT doc_id AS paper_id, source AS batch_id, lang, n_chars, split_part(text, chr(10), 1) AS title,
  len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS words, regexp_matches(text, '{ASCII_EMAIL}') AS em, regexp_matches(text, '{ASCII_ID}') AS oid FROM documents),
y AS (SELECT *, (lang IN ('en', 'de'))::INT AS ok_ext, (n_chars <= 0.004 * 1048576)::INT AS ok_size, (greatest(1, ceil(words / 300.0)) <= 9)::INT AS ok_page,
  (title <> '')::INT AS ok_title, (NOT contains(lower(title), 'that'))::INT AS ok_term, (NOT em)::INT AS ok_em, (NOT oid)::INT AS ok_id FROM x),
z AS (SELECT paper_id, batch_id, ok_ext + ok_size + ok_page + ok_title + ok_term + ok_em + ok_id + 5 AS passed,
  6 - ok_ext - ok_size - ok_page - ok_term - ok_em - ok_id AS failed, 1 - ok_title AS missing, 28 AS not_applicable,
  6 - ok_ext - ok_size - ok_page - ok_title - ok_term - ok_em AS blocking, 1 - ok_id AS warnings FROM y),
s AS (SELECT *, round_even(100.0 * passed / (passed + failed + missing), 0)::INT AS score FROM z),
v AS (SELECT *, CASE WHEN blocking > 0 THEN 'rejected' WHEN score < 60 THEN 'rejected' WHEN warnings > 0 THEN 'needs_review' ELSE 'accepted' END AS verdict FROM s)
"""


def result_counts(spark, sf):
    return results(spark, sf).groupBy("id", "category", "severity").pivot("status", ["passed", "failed", "missing", "not_applicable"]).count().na.fill(0)


def batch_tally(spark, sf):
    return decisions.batch_tally(verdicts(spark, sf))


def lines(spark, sf, docs=None):
    d = (docs or t(spark, sf, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.filter(F.trim("text") != "")


def sections(spark, sf, docs=None):
    """The classified sections of all documents, or of ``docs``."""
    b = lines(spark, sf, docs)
    fmt = F.struct(
        F.when(F.length("text") % 3 == 0, "Times").otherwise("Arial").alias("font_family"), (F.length("text") % 4 + 9).cast("double").alias("font_size_pt"), (F.col("pos") == 0).alias("bold"), F.lit(False).alias("italic"),
        *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in structure.FORMAT.split(", ")[4:]])
    return structure.classify_blocks(b.withColumn("fmt", fmt).withColumn("heading_style", F.lit(False)))


def section_counts(spark, sf):
    return sections(spark, sf).groupBy("doc_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("title", "authors", "heading", "body")], F.sum(F.length("text")).alias("chars"))


def caps_headings(spark, sf):
    return lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_caps_heading(F.col("text"))).alias("n_caps"))


def weighted_mode(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("flag", F.concat("l_returnflag", "l_linestatus"))
    return structure.mode(li, ["l_suppkey"], "flag", F.col("l_linenumber"), F.col("o"))


def majority(spark, sf):
    return structure.majority(t(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_linestatus") == "O", F.col("l_linenumber"), "open")


def page_labels(spark, sf):
    base = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("p_partkey") % 3).cast("int"))
    p = t(spark, sf, "part").select("p_partkey", (base(590.0, 500.0, 410.0) + F.col("p_size")).alias("w"), (base(780.0, 720.0, 580.0) + F.col("p_size") * 1.5).alias("h"))
    return p.select("p_partkey", V.page_label(F.col("w"), F.col("h")).alias("label"))


def page_estimate(spark, sf):
    s = lines(spark, sf).select("doc_id", F.col("pos").cast("double").alias("ord"), F.lit("body").alias("type"), "text", F.struct(F.lit(None).cast("string").alias("font_family"), F.lit(10.0).alias("font_size_pt"), F.lit(None).cast("double").alias("line_spacing")).alias("fmt"))
    page = s.select("doc_id").distinct().select("doc_id", *[F.lit(v).alias(k) for k, v in {"width": 595.0, "height": 842.0, "left": 72.0, "right": 73.0, "top": 72.0, "bottom": 72.0}.items()])
    return structure.estimate_pages(s, page)


def geometry(spark, sf):
    """Line items as text lines: an order is a document, its parts lie on a page."""
    return t(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_orderkey") % 5).cast("int").alias("page"), (F.col("l_suppkey") % 7).cast("int").alias("block"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        (F.col("l_quantity") * 5).alias("x0"), (F.col("l_quantity") * 5 + 200).alias("x1"), (F.col("l_partkey") % 700 + 30).cast("double").alias("y0"), (F.col("l_partkey") % 700 + 42).cast("double").alias("y1"),
        (F.col("l_partkey") % 700 + 40).cast("double").alias("baseline"), F.lit("x").alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


_GEO = """g AS (SELECT l_orderkey % 500 AS doc_id, (l_orderkey % 5)::INT AS page, (l_suppkey % 7)::INT AS block, l_orderkey * 10 + l_linenumber AS line, l_quantity * 5 AS x0, l_quantity * 5 + 200 AS x1,
  (l_partkey % 700 + 30)::DOUBLE AS y0, (l_partkey % 700 + 42)::DOUBLE AS y1, (l_partkey % 700 + 40)::DOUBLE AS baseline FROM lineitem),
p AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (x1 <= 294) AS l, count(*) FILTER (x0 >= 318) AS r, count(*) FILTER (x0 < 306 AND x1 > 306) AS c, min(x0) AS a0, max(x1) AS a1, min(y0) AS b0, max(y1) AS b1,
  min(x0) FILTER (x1 <= 294) AS l0, max(x1) FILTER (x1 <= 294) AS l1, min(x0) FILTER (x0 >= 318) AS r0, max(x1) FILTER (x0 >= 318) AS r1, min(y0) FILTER (x1 <= 294 OR x0 >= 318) AS top FROM g GROUP BY 1, 2),
q AS (SELECT *, l >= 5 AND r >= 5 AND c <= 0.25 * (l + r + c) AS two FROM p)"""


def alignments(spark, sf):
    return structure.alignment_of(geometry(spark, sf).withColumn("rx0", F.lit(5.0)).withColumn("rx1", F.lit(330.0)))


def indents(spark, sf):
    return structure.first_indent_of(geometry(spark, sf), alignments(spark, sf))


_ALIGN = f"""{_GEO}, s AS (SELECT doc_id, page, block, median(x0 - 5) AS l, median(330 - x1) AS r, bool_and(abs((x0 + x1) / 2 - 167.5) <= 10) AS even, median((x1 - x0) / 325) AS fill, max(x1 - x0) AS w, count(*) AS n FROM g GROUP BY 1, 2, 3),
al AS (SELECT doc_id, page, block, CASE WHEN even AND w <= 325 * 0.92 THEN 'center' WHEN l <= 3 AND r <= 3 AND n >= 3 AND fill > 0.85 THEN 'justified' WHEN l <= 3 THEN 'left' WHEN r <= 3 AND l > 10 THEN 'right' END AS alignment FROM s)"""


def font_names(spark, sf):
    names = F.array(*map(F.lit, ["ABCDEF+TimesNewRomanPS-BoldMT", "Arial-BoldItalicMT", "HELVETICA", "BookBold", "Minion-Pro_Medium", "Bold"]))
    return t(spark, sf, "part").select("p_partkey", T.clean_font(F.get(names, (F.col("p_partkey") % 6).cast("int"))).alias("family"))


def lengths(spark, sf):
    units = F.array(*map(F.lit, ["pt", "in", "MM", " cm ", "bp", "cc"]))
    return t(spark, sf, "part").select("p_partkey", V.to_points(F.concat(F.col("p_size").cast("string"), F.get(units, (F.col("p_partkey") % 6).cast("int")))).alias("points"))


_CHARS = r"\p{L}\p{M}\p{Nd}_"
_WORD = f"[{_CHARS}]"


def identity(spark, sf):
    d, x = t(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", F.array_join(T.emails(x), ",").alias("emails"), F.array_join(T.orcids(x), ",").alias("orcids"), T.word_count(x).alias("words"))


def figure_counts(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("see Fig. "), F.col("p_size"), F.lit(" and figure "), F.col("p_partkey") % 40, F.lit(", Table "), F.col("p_size") % 7, F.lit("; our previous work")).alias("x"))
    return d.select("p_partkey", T.largest_number(F.col("x"), T.FIGURE).alias("figures"), T.largest_number(F.col("x"), T.TABLE).alias("tables"), T.count_of(F.col("x"), T.SELF_CITATION).alias("self_citations"))


def heading_sections(spark, sf):
    """First words of the lines, as headings, by the section they name."""
    names = F.array(*map(F.lit, ["1 Introduction", "II. Methods and tools", "Abstract", "3.2 Results and discussion", "Conclusions", "references", "Something else", "Index Terms: a; b"]))
    p = t(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("heading"))
    return p.select("p_partkey", T.canonical_section(F.col("heading")).alias("section"), T.is_keywords_line(F.col("heading")).alias("keywords"))


def lineitem_results(spark, sf, until=None):
    li = t(spark, sf, "lineitem")
    if until:
        li = li.filter(F.col("l_shipdate") < F.lit(until).cast("timestamp"))
    status = F.when(F.col("l_returnflag") == "A", "passed").when(F.col("l_returnflag") == "N", "failed").otherwise("missing")
    return li.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("rule."), F.col("l_linenumber")).alias("id"), F.concat(F.lit("Rule "), F.col("l_linenumber")).alias("name"),
                     F.lit("rule").alias("category"), status.alias("status"), F.when(F.col("l_linestatus") == "O", "blocking").otherwise("warning").alias("severity"), F.lit("x").alias("expected"), F.col("l_quantity").cast("int").cast("string").alias("actual"), F.lit("high").alias("confidence"))


_LI = """li AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'failed' ELSE 'missing' END AS status,
  CASE l_linestatus WHEN 'O' THEN 'blocking' ELSE 'warning' END AS severity, l_quantity::INT AS actual FROM lineitem)"""


def scores(spark, sf):
    g = lineitem_results(spark, sf).groupBy("paper_id").agg(*decisions.counters())
    return g.withColumn("score", decisions.score()).withColumn("report_score", decisions.score(0)).select("paper_id", "passed", "failed", "missing", "blocking", "warnings", "score", "report_score")


def first_reasons(spark, sf):
    policy = spark.createDataFrame([], "paper_id bigint, reject_blocking boolean, reject_warning boolean, min_score int")
    a = decisions.assess(lineitem_results(spark, sf), policy)
    return a.select("paper_id", F.array_join("reasons", ",").alias("reasons"), "verdict", decisions.validation_status(F.col("verdict"), F.lit(True), F.col("warnings")).alias("validation"))


def snapshots(spark, sf):
    r = lineitem_results(spark, sf)
    base = r.filter("actual % 3 <> 0")
    moved = F.when(F.col("actual") % 5 == 0, "passed").when(F.col("actual") % 7 == 0, "missing").otherwise(F.col("status"))
    target = r.filter("actual % 4 <> 0").withColumn("status", moved)
    one = lambda df: relational.latest(df, ["paper_id", "id"], F.col("actual").cast("int"), F.col("severity"), F.col("status"))
    return one(base), one(target)


def findings_diff(spark, sf):
    return diffs.compare_findings(*snapshots(spark, sf), ["paper_id"]).groupBy("state", "changed_fields").agg(F.count("*").alias("n"))


_SNAP = f"""{_LI},
b0 AS (SELECT * FROM li WHERE actual % 3 <> 0),
t0 AS (SELECT paper_id, ord, CASE WHEN actual % 5 = 0 THEN 'passed' WHEN actual % 7 = 0 THEN 'missing' ELSE status END AS status, severity, actual FROM li WHERE actual % 4 <> 0),
b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY paper_id, ord ORDER BY actual, severity, status) = 1),
t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY paper_id, ord ORDER BY actual, severity, status) = 1)"""


def property_diff(spark, sf):
    fields = ["c_nationkey", "c_mktsegment", "c_acctbal"]
    c = t(spark, sf, "customer")
    new = c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("c_nationkey") + F.col("c_custkey") % 2)).withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return diffs.compare_properties(c, new, ["c_custkey"], fields).groupBy("field", "state").agg(F.count("*").alias("n"))


def rule_diff(spark, sf):
    p = t(spark, sf, "part")
    js = lambda shift: F.to_json(F.struct(F.struct((F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, shift).otherwise(0)).alias("max_pages"), F.when(F.col("p_partkey") % 5 != shift, F.col("p_brand")).alias("columns")).alias("pages"), F.struct(F.col("p_type").alias("body")).alias("typography")))
    a, b = (diffs.rule_rows(p.select("p_partkey", js(s).alias("j")), ["p_partkey"], "j") for s in (0, 1))
    return diffs.compare_rules(a, b, ["p_partkey"]).groupBy("group", "field", "state").agg(F.count("*").alias("n"))


def rule_diff_summary(spark, sf):
    o = t(spark, sf, "orders")
    d = o.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("group"), F.when(F.col("o_orderstatus") == "P", "unchanged").otherwise("changed").alias("state"))
    return diffs.summarise_changes(d, ["k"])


def text_hunks(spark, sf):
    d = t(spark, sf, "documents")
    pairs = d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("before"), F.regexp_replace("text", "\\n[A-M]", "\n*").alias("after"))
    return diffs.text_diff(pairs)


def evaluator(spark, sf):
    labels = t(spark, sf, "labels")
    expected = labels.filter("quality = 0").select("doc_id", F.lit("size").alias("rule")).unionByName(labels.filter("toxic = 1").select("doc_id", F.lit("words").alias("rule")))
    d = t(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    failed = d.filter("n_chars < 1000").select("doc_id", F.lit("size").alias("rule")).unionByName(d.filter("lower(text) like '%stupid%'").select("doc_id", F.lit("words").alias("rule")))
    return diffs.evaluate_fixtures(expected, failed, ["doc_id"])


def evaluator_rules(spark, sf):
    return diffs.rule_report(evaluator(spark, sf))


def evaluator_corpus(spark, sf):
    labels, d = t(spark, sf, "labels"), t(spark, sf, "documents")
    v = labels.join(d, "doc_id").select(F.when(F.col("quality") == 0, "rejected").otherwise("accepted").alias("expected"), F.when(F.col("n_chars") < 1000, "rejected").otherwise("accepted").alias("actual"))
    return diffs.corpus_report(v, evaluator(spark, sf))


_EVAL = """
e AS (SELECT doc_id, 'size' AS rule FROM labels WHERE quality = 0 UNION SELECT doc_id, 'words' FROM labels WHERE toxic = 1),
d AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
f AS (SELECT doc_id, 'size' AS rule FROM d WHERE n_chars < 1000 UNION SELECT doc_id, 'words' FROM d WHERE contains(lower(text), 'stupid')),
o AS (SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, coalesce(e.rule, f.rule) AS rule, CASE WHEN e.rule IS NULL THEN 'false_positive' WHEN f.rule IS NULL THEN 'missed' ELSE 'detected' END AS outcome
  FROM e FULL JOIN f ON e.doc_id = f.doc_id AND e.rule = f.rule)"""


def comparison(spark, sf):
    c = t(spark, sf, "customer")
    fields = [f for _, f, _ in inference.COMPARED]
    side = lambda v: F.struct(*[(v[f] if f in v else F.lit(None).cast("double")).alias(f) for f in fields], F.array(F.lit("Introduction"), F.col("c_mktsegment")).alias("sections"))
    template = side({"width": F.lit(10.0), "columns": F.lit(2.0), "body_size": F.lit(10.0)})
    paper = side({"width": F.col("c_nationkey").cast("double"), "columns": (F.col("c_custkey") % 3).cast("double"), "body_size": F.when(F.col("c_acctbal") > 0, F.lit(10.4))})
    paper = paper.withField("sections", F.array(F.lit("Introduction"), F.lit("BUILDING")))
    return inference.comparison_report(inference.run_comparison(c.select(F.col("c_custkey").alias("paper_id"), template.alias("template"), paper.alias("paper"))))


def family(spark, sf):
    s = t(spark, sf, "supplier")
    n = F.col("s_suppkey")
    info = {
        "width": F.lit(595.28), "height": F.lit(841.89), "left": F.lit(124.7) + n % 3 * 5, "right": F.lit(124.7), "top": F.lit(147.4), "bottom": F.lit(147.4) + n % 5 * 8,
        "label": F.when(n % 2 == 0, "A4"), "columns": n % 4, "orientation": F.lit("portrait"),
    }
    sig = inference.family_signals(info, n % 3 > 0, F.col("s_nationkey") > 5, F.when(n % 7 > 0, "See the Abstract").otherwise("nothing"))
    return s.select("s_suppkey", inference.family_score(sig).alias("score"), inference.is_family(sig).alias("family"))


def blinding(spark, sf):
    d = t(spark, sf, "documents")
    b = inference.infer_blinding(F.col("doc_id") % 3 == 0, F.col("text"))
    return d.select("doc_id", b.alias("b")).select("doc_id", "b.required", "b.allow_author_block")


def presets(spark, sf):
    p = inference.presets_frame(spark)
    f = inference.apply_policy(F.col("rules"), F.col("rules_id").startswith("IEEE"))
    return p.select("rules_id", f.alias("r")).select("rules_id", "r.pages.max_pages", "r.pages.columns", "r.sections.abstract_max_words", "r.sections.min_references", "r.anonymisation.required", "r.anonymisation.allow_author_block", F.col("r.typography.body.font_family").alias("font"))


def fact_diff(spark, sf):
    p = t(spark, sf, "part")
    js = lambda shift: F.to_json(F.struct(
        F.struct((F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, shift).otherwise(0)).alias("page_count"), F.when(F.col("p_partkey") % 5 > shift, "A4").alias("page_size_label")).alias("layout"),
        F.struct(F.col("p_name").alias("title_text")).alias("structure")))
    a, b = (p.select("p_partkey", F.when(F.col("p_partkey") % 9 > 0, js(s)).alias("facts")) for s in (0, 1))
    return diffs.compare_facts(a, b, ["p_partkey"]).groupBy("field", "state").agg(F.count("*").alias("n"))


def inferred(spark, sf):
    return inference.infer_rules(sections(spark, sf)).select("doc_id", "body_font", "body_size", "title_font", "title_size")


def formats(spark, sf):
    exts = F.array(*map(F.lit, ["pdf", "TEX", "docx", "doc", "tar.ltx"]))
    n = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "noext").otherwise(F.concat(F.lit("a b."), F.get(exts, (F.col("p_partkey") % 5).cast("int")))).alias("name"))
    return n.select("p_partkey", V.format_of(F.col("name")).alias("format"))


def upload_limits(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    return files.bounded(d, "source", "doc_id", 5000, 20000)


def forbidden_terms(spark, sf):
    """The rule's status of each paper: its term in what the paper says of its authors."""
    return results(spark, sf).filter("id = 'anonymisation.forbidden_terms'").select("paper_id", "status", "severity")


#: The sections of documents' lines, as in sections(): titles, authors up to the first heading,
#: keywords line or long line, headings that carry forward, trailing bibliographies.
_SECTIONS = r"""r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
l AS (SELECT *, trim(regexp_replace(x, '^(\d+(\.\d+)*[.)]?|[IVXLCDM]+[.)]?)\s+', '', 'i')) AS b FROM r WHERE trim(x) <> ''),
c AS (SELECT *, CASE WHEN regexp_matches(b, '(?i)^(abstract|summary)\b[:.\s]*$') THEN 'Abstract' WHEN regexp_matches(b, '(?i)^(introduction|background)\b') THEN 'Introduction'
  WHEN regexp_matches(b, '(?i)^(related\s+works?|literature\s+(review|survey))\b') THEN 'Related Work'
  WHEN regexp_matches(b, '(?i)^(methods?|methodology|materials?\s+and\s+methods?|experimental(s|\s+(setup|section|design))?|system\s+(design|architecture|model)|proposed\s+(method|approach|scheme)|approach)\b') THEN 'Methodology'
  WHEN regexp_matches(b, '(?i)^(results?(\s*(and|&)\s*discussion)?|discussion|evaluation|experiments?(al\s+results)?|analysis)\b') THEN 'Results'
  WHEN regexp_matches(b, '(?i)^(conclusions?|concluding\s+remarks?|final\s+remarks?)\b') THEN 'Conclusion' WHEN regexp_matches(b, '(?i)^(references|bibliography|works\s+cited)\b[:.\s]*$') THEN 'References' END AS cn,
  regexp_matches(b, '(?i)^(keywords?|index\s+terms)\s*[—–·:\-.]') AS k,
  length(trim(x)) <= 600 AND regexp_matches(trim(x), '^[A-Z][\w''’\-]+(?:\s+[A-Z][\w''’\-]+)?,(?:\s*[A-Z]\.(?:\s*[A-Z]\.)*|(?:\s+[A-Z][\w''’\-]+,\s*[A-Z]\.)+)[^:]{0,120}:') AND regexp_matches(trim(x), '(\(?(?:19|20)\d{2}[a-z]?\)?)') AS e FROM l),
w AS (SELECT *, pos = min(pos) OVER (PARTITION BY doc_id) AND cn IS DISTINCT FROM 'Abstract' AS ti FROM c),
i AS (SELECT doc_id, pos, e, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c),
rs AS (SELECT doc_id, max(start) AS ref_start FROM (SELECT doc_id, island, count(*) AS n, min(pos) AS start FROM i WHERE e GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1),
st AS (SELECT *, min(CASE WHEN NOT ti AND (cn IS NOT NULL OR k OR length(x) > 400) THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM w),
ty AS (SELECT st.*, CASE WHEN ti THEN 'title' WHEN stop IS NULL OR pos < stop THEN 'authors' WHEN cn IS NULL AND pos >= ref_start THEN 'references' WHEN cn IS NOT NULL THEN 'heading' WHEN k THEN 'keywords' WHEN length(x) <= 90 AND x = upper(x) AND x <> lower(x) THEN 'heading' END AS kind FROM st LEFT JOIN rs USING (doc_id)),
sec AS (SELECT *, last_value(CASE WHEN kind = 'keywords' THEN 'Keywords' WHEN kind = 'heading' THEN coalesce(cn, x) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sn FROM ty),
y AS (SELECT doc_id, pos, x, sn, coalesce(kind, CASE WHEN sn = 'Abstract' THEN 'abstract' ELSE 'body' END) AS kind FROM sec)"""


QUERIES = {
    "p1_verdicts": (verdicts, f"WITH {_COUNTS} SELECT paper_id, batch_id, passed::BIGINT AS passed, failed::BIGINT AS failed, missing::BIGINT AS missing, not_applicable::BIGINT AS not_applicable, blocking::BIGINT AS blocking, warnings::BIGINT AS warnings, score, verdict FROM v"),
    "a6_batch_tally": (batch_tally, f"WITH {_COUNTS} SELECT batch_id, count(*) AS total, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (verdict = 'needs_review') AS needs_review FROM v GROUP BY 1"),
    "r_result_counts": (result_counts, f"""WITH {_COUNTS},
na(id, severity) AS (VALUES ('layout.columns', 'blocking'), ('layout.margins', 'warning'), ('layout.orientation', 'blocking'), ('layout.page_size', 'blocking'), ('paragraph.first_line_indent', 'warning'), ('paragraph.justified', 'advisory'), ('paragraph.line_spacing',
  'warning'), ('paragraph.space_above', 'warning'), ('paragraph.space_below', 'warning'), ('paragraph.uniform_alignment', 'advisory'), ('structure.abstract', 'blocking'), ('structure.keywords', 'warning'), ('typography.abstract.alignment',
  'advisory'), ('typography.abstract.bold', 'advisory'), ('typography.abstract.font_family', 'warning'), ('typography.abstract.font_size_pt', 'warning'), ('typography.body.alignment', 'advisory'), ('typography.body.bold', 'advisory'),
  ('typography.body.font_family', 'warning'), ('typography.body.font_size_pt', 'warning'), ('typography.heading.alignment', 'advisory'), ('typography.heading.bold', 'advisory'), ('typography.heading.font_family', 'warning'),
  ('typography.heading.font_size_pt', 'warning'), ('typography.title.alignment', 'advisory'), ('typography.title.bold', 'advisory'), ('typography.title.font_family', 'warning'), ('typography.title.font_size_pt', 'warning')),
ok(id, severity) AS (VALUES ('anonymisation.acknowledgements', 'blocking'), ('anonymisation.affiliations', 'blocking'), ('anonymisation.author_block', 'blocking'), ('anonymisation.funding', 'blocking'), ('anonymisation.placeholder', 'advisory')),
tested AS (SELECT unnest([{{'id': 'anonymisation.emails', 'severity': 'blocking', 'ok': ok_em}}, {{'id': 'anonymisation.forbidden_terms', 'severity': 'blocking', 'ok': ok_term}}, {{'id': 'anonymisation.orcid', 'severity': 'warning', 'ok': ok_id}}, {{'id': 'file.size', 'severity': 'blocking', 'ok': ok_size}}, {{'id': 'page.limit', 'severity': 'blocking', 'ok': ok_page}}]) AS v FROM y),
rows AS (SELECT id, severity, 'not_applicable' AS status FROM na, y UNION ALL SELECT id, severity, 'passed' FROM ok, y UNION ALL SELECT v.id, v.severity, CASE WHEN v.ok = 1 THEN 'passed' ELSE 'failed' END FROM tested
  UNION ALL SELECT CASE WHEN ok_ext = 1 THEN 'file.extension_present' ELSE 'file.extension_accepted' END, 'blocking', CASE WHEN ok_ext = 1 THEN 'passed' ELSE 'failed' END FROM y UNION ALL SELECT 'structure.title', 'blocking', CASE WHEN ok_title = 1 THEN 'passed' ELSE 'missing' END FROM y)
SELECT id, split_part(id, '.', 1) AS category, severity, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'not_applicable') AS not_applicable FROM rows GROUP BY 1, 2, 3"""),
    "d6_sections": (section_counts, f"WITH {_SECTIONS} SELECT doc_id, count(*) FILTER (kind = 'title') AS title, least(1, count(*) FILTER (kind = 'authors')) AS authors, count(*) FILTER (kind = 'heading') AS heading, count(*) FILTER (kind = 'body') AS body, (sum(length(x)) + greatest(0, count(*) FILTER (kind = 'authors') - 1))::BIGINT AS chars FROM y GROUP BY 1"),
    "d3_caps_headings": (caps_headings, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(x) <= 90 AND x = upper(x) AND x <> lower(x)) AS n_caps FROM l WHERE trim(x) <> '' GROUP BY 1"),
    "d7_weighted_mode": (weighted_mode, "WITH g AS (SELECT l_suppkey, l_returnflag || l_linestatus AS flag, sum(l_linenumber) AS w, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_max(flag, (w, -o)) AS flag FROM g GROUP BY 1"),
    "d7_majority": (majority, "SELECT l_suppkey, sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE -l_linenumber END) >= 0 AS open FROM lineitem GROUP BY 1"),
    "d9_page_label": (page_labels, """WITH s(ord, name, w, h) AS (VALUES (1, 'A5', 419.53, 595.28), (2, 'A4', 595.28, 841.89), (3, 'Letter', 612.0, 792.0), (4, 'Legal', 612.0, 1008.0), (5, 'Tabloid', 792.0, 1224.0), (6, 'Executive', 522.0, 756.0)),
p AS (SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN 590.0 WHEN 1 THEN 500.0 ELSE 410.0 END)::DOUBLE + p_size AS w, (CASE p_partkey % 3 WHEN 0 THEN 780.0 WHEN 1 THEN 720.0 ELSE 580.0 END)::DOUBLE + p_size * 1.5 AS h FROM part)
SELECT p_partkey, arg_min(name, ord) AS label FROM p LEFT JOIN s ON (abs(p.w - s.w) <= 2 AND abs(p.h - s.h) <= 2) OR (abs(p.w - s.h) <= 2 AND abs(p.h - s.w) <= 2) GROUP BY 1"""),
    "d11_page_estimate": (page_estimate, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, greatest(1, ceil(sum(greatest(1, ceil(length(x) / 90.0))) / (698.0 / 12.0)))::INT AS pages FROM l WHERE trim(x) <> '' GROUP BY 1"),
    "d12_columns": (lambda s, sf: structure.columns_of(geometry(s, sf)), f"WITH {_GEO} SELECT doc_id, CASE WHEN sum(CASE WHEN two THEN l + r ELSE 0 END) >= 20 AND sum(CASE WHEN two THEN l + r ELSE 0 END) / sum(n) >= 0.6 THEN 2 ELSE 1 END AS columns FROM q GROUP BY 1"),
    "d13_margins": (lambda s, sf: structure.margins_of(geometry(s, sf)), f"WITH {_GEO} SELECT doc_id, round(least(200, greatest(0, median(a0))), 1) AS left, round(least(200, greatest(0, 612 - median(a1))), 1) AS right, round(least(200, greatest(0, median(b0))), 1) AS top, round(least(200, greatest(0, 792 - median(b1))), 1) AS bottom FROM p GROUP BY 1"),
    "d14_regions": (lambda s, sf: structure.block_regions(geometry(s, sf)), f"""WITH {_GEO}, b AS (SELECT doc_id, page, block, max(y1) AS by1, avg((x0 + x1) / 2) AS m FROM g GROUP BY 1, 2, 3),
x AS (SELECT *, CASE WHEN NOT two THEN 'all' WHEN by1 <= top - 2 THEN 'both' WHEN m BETWEEN l0 AND l1 THEN 'left' WHEN m BETWEEN r0 AND r1 THEN 'right' WHEN least(abs(m - l0), abs(m - l1)) <= least(abs(m - r0), abs(m - r1)) THEN 'left' ELSE 'right' END AS w FROM b JOIN q USING (doc_id, page))
SELECT doc_id, page, block, CASE w WHEN 'all' THEN a0 WHEN 'both' THEN least(l0, r0) WHEN 'left' THEN l0 ELSE r0 END AS rx0, CASE w WHEN 'all' THEN a1 WHEN 'both' THEN greatest(l1, r1) WHEN 'left' THEN l1 ELSE r1 END AS rx1 FROM x"""),
    "d15_alignment": (alignments, f"WITH {_ALIGN} SELECT * FROM al"),
    "d16_line_spacing": (lambda s, sf: structure.line_spacing_of(geometry(s, sf)), f"""WITH {_GEO}, d AS (SELECT *, baseline - lag(baseline) OVER (PARTITION BY doc_id, page, block ORDER BY baseline) AS st FROM g), r AS (SELECT doc_id, page, block, median(st) FILTER (st > 0) / 10 AS x FROM d GROUP BY 1, 2, 3)
SELECT doc_id, page, block, CASE WHEN x > 0.5 AND x < 4 THEN round(x, 2) END AS line_spacing FROM r"""),
    "d17_first_indent": (indents, f"""WITH {_ALIGN}, z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block ORDER BY line, x0) = 1 AS f FROM g), y AS (SELECT doc_id, page, block, max(x0) FILTER (f) - min(x0) FILTER (NOT f) AS d FROM z GROUP BY 1, 2, 3)
SELECT doc_id, page, block, CASE WHEN alignment IN ('left', 'justified') AND d IS NOT NULL THEN CASE WHEN d > 3 THEN round(d, 1) ELSE 0 END END AS indent FROM y JOIN al USING (doc_id, page, block)"""),
    "d19_font_names": (font_names, "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' WHEN 2 THEN 'Helvetica' WHEN 3 THEN 'Book' WHEN 4 THEN 'Minion' ELSE 'Bold' END AS family FROM part"),
    "d10_lengths": (lengths, "SELECT p_partkey, round(p_size * CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 72 WHEN 2 THEN 72 / 25.4 WHEN 3 THEN 72 / 2.54 WHEN 4 THEN 7200.0::DOUBLE / 7227 ELSE 12 * 1238.0::DOUBLE / 1157 END, 3)::DOUBLE AS points FROM part"),
    "f1_identity": (identity, f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_WORD}[{_CHARS}.+-]*@[{_CHARS}-]+\\.[{_CHARS}.-]+{_WORD}'))), ',') AS emails, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(?:\\(?[0-9]{{4}}\\)?[-\\s]?){{3}}[0-9]{{3}}[0-9Xx]\\b'))), ',') AS orcids,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> ''))::INT AS words FROM documents"""),
    "f13_figures": (figure_counts, "SELECT p_partkey, greatest(p_size, p_partkey % 40)::INT AS figures, (p_size % 7)::INT AS tables, 1 AS self_citations FROM part"),
    "d1_heading_sections": (heading_sections, "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Methodology' WHEN 2 THEN 'Abstract' WHEN 3 THEN 'Results' WHEN 4 THEN 'Conclusion' WHEN 5 THEN 'References' END AS section, p_partkey % 8 = 7 AS keywords FROM part"),
    "a2_scores": (scores, f"WITH {_LI} SELECT paper_id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status <> 'passed' AND severity = 'blocking') AS blocking, count(*) FILTER (status <> 'passed' AND severity = 'warning') AS warnings, round_even(100.0 * count(*) FILTER (status = 'passed') / count(*), 0)::INT AS score, round_even(100.0 * count(*) FILTER (status = 'passed') / count(*), 0)::INT AS report_score FROM li GROUP BY 1"),
    "a4_reasons": (first_reasons, f"""WITH {_LI}, q AS (SELECT paper_id, count(*) FILTER (status <> 'passed' AND severity = 'warning') AS w, count(*) FILTER (status <> 'passed' AND severity = 'blocking') AS b,
  coalesce(array_to_string(list_slice(list('Rule ' || ord ORDER BY ord) FILTER (status <> 'passed' AND severity = 'blocking'), 1, 3), ','), '') AS reasons FROM li GROUP BY 1)
SELECT paper_id, reasons, CASE WHEN b > 0 THEN 'rejected' WHEN w > 0 THEN 'needs_review' ELSE 'accepted' END AS verdict, CASE WHEN b > 0 THEN 'failed' WHEN w > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS validation FROM q"""),
    "v1_findings": (findings_diff, f"""WITH {_SNAP}, j AS (SELECT b.status AS os, t.status AS ns, b.severity AS ob, t.severity AS nb, b.actual AS oa, t.actual AS na, b.ord IS NOT NULL AND t.ord IS NOT NULL AS both_in FROM b FULL JOIN t ON b.paper_id = t.paper_id AND b.ord = t.ord)
SELECT CASE WHEN os <> 'passed' AND ns <> 'passed' THEN 'remaining' WHEN ns <> 'passed' THEN 'newly_reported' WHEN ns = 'passed' THEN 'resolved' ELSE 'not_evaluated' END AS state,
  CASE WHEN both_in THEN concat_ws(',', CASE WHEN os <> ns THEN 'status' END, CASE WHEN ob <> nb THEN 'severity' END, CASE WHEN oa <> na THEN 'actual' END) ELSE '' END AS changed_fields, count(*) AS n
FROM j WHERE coalesce(os, 'passed') <> 'passed' OR coalesce(ns, 'passed') <> 'passed' GROUP BY 1, 2"""),
    "v3_properties": (property_diff, """WITH n AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey + c_custkey % 2 END AS nk, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS ab FROM customer),
u AS (SELECT 'c_nationkey' AS field, CASE WHEN nk IS NULL THEN 'unavailable' WHEN nk = c_nationkey THEN 'unchanged' ELSE 'changed' END AS state FROM n
UNION ALL SELECT 'c_mktsegment', 'unchanged' FROM n UNION ALL SELECT 'c_acctbal', CASE WHEN ab = c_acctbal THEN 'unchanged' ELSE 'changed' END FROM n) SELECT field, state, count(*) AS n FROM u GROUP BY 1, 2"""),
    "v4_text_hunks": (text_hunks, None),
    "v5_rule_diff": (rule_diff, """WITH u AS (SELECT 'pages' AS "group", 'max_pages' AS field, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM part
UNION ALL SELECT 'pages', 'columns', CASE p_partkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'unchanged' END FROM part UNION ALL SELECT 'typography', 'body', 'unchanged' FROM part)
SELECT "group", field, state, count(*) AS n FROM u GROUP BY 1, 2, 3"""),
    "v6_rule_summary": (rule_diff_summary, """WITH g AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT k, array_to_string(list_slice(list(p || ': ' || n ORDER BY n DESC, p), 1, 3), ', ') AS summary, sum(n)::BIGINT AS changes FROM g GROUP BY 1"""),
    "e1_outcomes": (evaluator, f"WITH {_EVAL} SELECT * FROM o"),
    "e2_rules": (evaluator_rules, f"WITH {_EVAL} SELECT rule, count(*) FILTER (outcome <> 'false_positive') AS planted, count(*) FILTER (outcome = 'detected') AS detected, count(*) FILTER (outcome = 'missed') AS missed, count(*) FILTER (outcome = 'false_positive') AS false_positives FROM o GROUP BY 1"),
    "e3_corpus": (evaluator_corpus, f"""WITH {_EVAL}, v AS (SELECT avg(CASE WHEN (quality = 0) = (n_chars < 1000) THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM labels JOIN documents USING (doc_id))
SELECT round(v.a, 4) AS agreement, v.n AS fixtures, round(count(*) FILTER (outcome = 'detected') / count(*) FILTER (outcome <> 'false_positive'), 4) AS detection, count(*) FILTER (outcome = 'false_positive') AS false_positives FROM o, v GROUP BY v.a, v.n"""),
    "c1_comparison": (comparison, """WITH x AS (SELECT c_custkey AS paper_id, CASE WHEN abs(c_nationkey - 10) <= 2 THEN 'p' ELSE 'f' END AS a, CASE WHEN c_custkey % 3 = 2 THEN 'p' ELSE 'f' END AS b,
  CASE WHEN c_acctbal > 0 THEN 'p' ELSE 'm' END AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN 'p' ELSE 'm' END AS d FROM customer),
y AS (SELECT paper_id, 1 + (a = 'p')::INT + (b = 'p')::INT + (c = 'p')::INT + (d = 'p')::INT AS passed, (a = 'f')::INT + (b = 'f')::INT AS failed, (c = 'm')::INT + (d = 'm')::INT AS missing FROM x)
SELECT paper_id, passed::BIGINT AS passed, failed::BIGINT AS failed, missing::BIGINT AS missing, round_even(100.0 * passed / 5, 0)::INT AS score FROM y"""),
    "c10_family": (family, """WITH x AS (SELECT s_suppkey AS n, (s_suppkey % 2 = 0)::INT * 30 + (s_suppkey % 4 = 1)::INT * 15 + 10 + (abs((595.28 - 249.4 - s_suppkey % 3 * 5) * 25.4 / 72 - 122) < 4)::INT * 20 + (abs((841.89 - 294.8 - s_suppkey % 5 * 8) * 25.4 / 72 - 193) < 6)::INT * 15
  + (s_suppkey % 3 > 0)::INT * 15 + (s_nationkey > 5)::INT * 10 + (s_suppkey % 7 > 0)::INT * 10 AS w FROM supplier) SELECT n AS s_suppkey, round(w / 125.0::DOUBLE, 3) AS score, w >= 93.75 AS family FROM x"""),
    "c9_blinding": (blinding, "WITH x AS (SELECT doc_id, doc_id % 3 = 0 OR coalesce(contains(text, '@') OR regexp_matches(lower(text), 'university|institute|department|laborator'), false) AS l FROM documents) SELECT doc_id, NOT l AS required, l AS allow_author_block FROM x"),
    "c12_presets": (presets, """SELECT * FROM (VALUES ('IEEE two-column (anonymous)', 8, 2, 250, 5, true, true, 'Times New Roman'), ('ACM single-column (anonymous)', 9, 2, 150, NULL, true, false, 'Libertine'),
  ('Springer LNCS (visible authors)', 9, 1, 250, NULL, false, true, 'Times New Roman')) v(rules_id, max_pages, columns, abstract_max_words, min_references, required, allow_author_block, font)"""),
    "v3_facts": (fact_diff, """WITH p AS (SELECT * FROM part WHERE p_partkey % 9 > 0), f AS (SELECT unnest(['layout.page_count_exact', 'layout.page_count_confidence', 'layout.columns', 'layout.margins_pt', 'layout.margins_confidence', 'typography.body_font', 'typography.body_font_size_pt', 'structure.author_block_text', 'structure.sections_present', 'structure.headings',
  'structure.reference_entry_count', 'structure.reference_count_confidence', 'structure.total_word_count', 'assets.figures', 'assets.tables', 'assets.confidence', 'identity.acknowledgement_present', 'latex.document_class']) AS field),
u AS (SELECT 'layout.page_count' AS field, CASE WHEN p_partkey % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM p UNION ALL SELECT 'layout.page_size_label', CASE WHEN p_partkey % 5 > 1 THEN 'unchanged' ELSE 'unavailable' END FROM p UNION ALL SELECT 'structure.title_text', 'unchanged' FROM p
  UNION ALL SELECT field, 'unavailable' FROM p, f) SELECT field, state, count(*) AS n FROM u GROUP BY 1, 2"""),
    "c8_inferred": (inferred, f"""WITH {_SECTIONS}, q AS (SELECT doc_id, pos, greatest(length(trim(x)), 1) AS w, CASE WHEN length(x) % 3 = 0 THEN 'Times' ELSE 'Arial' END AS font, (length(x) % 4 + 9)::DOUBLE AS size, kind, kind = 'body' AND NOT regexp_matches(x, '(?i)^\\s*(table|tab\\.|fig\\.|figure|algorithm|listing|scheme|chart)\\s*\\.?\\s*\\d+')
  AND NOT regexp_matches(x, '(?i)^\\s*(acknowledg(e)?ments?|disclosure of interests?|competing interests?|conflict of interests?|ethical standards?|author contributions?)\\s*[.:]') AS body FROM y),
f AS (SELECT doc_id, arg_max(font, (w, -p)) AS body_font FROM (SELECT doc_id, font, sum(w) AS w, min(pos) AS p FROM q WHERE body GROUP BY 1, 2) GROUP BY 1), z AS (SELECT doc_id, arg_max(size, (w, -p)) AS body_size FROM (SELECT doc_id, size, sum(w) AS w, min(pos) AS p FROM q WHERE body GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id, body_font, body_size, (SELECT min(font) FROM q WHERE q.doc_id = d.doc_id AND kind = 'title') AS title_font, (SELECT min(size) FROM q WHERE q.doc_id = d.doc_id AND kind = 'title') AS title_size FROM (SELECT DISTINCT doc_id FROM y) d LEFT JOIN f USING (doc_id) LEFT JOIN z USING (doc_id)"""),
    "s1_formats": (formats, "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'latex' WHEN 2 THEN 'docx' WHEN 4 THEN 'latex' END END AS format FROM part"),
    "s11_upload_limits": (upload_limits, "SELECT doc_id, source, n_chars AS size FROM documents WHERE n_chars <= 5000 QUALIFY sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 20000"),
    "r51_forbidden_terms": (forbidden_terms, f"WITH {_COUNTS} SELECT paper_id, CASE WHEN ok_term = 1 THEN 'passed' ELSE 'failed' END AS status, 'blocking' AS severity FROM y"),
}
