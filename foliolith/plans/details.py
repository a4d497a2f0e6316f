"""Queries of single functions and operators over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from foliolith.functions import text as T
from foliolith.functions import values as V
from foliolith.operators import checking, decisions, diffs, facts, inference, portal, rules, structure
from foliolith.operators import relational as R
from foliolith.plans.papers import _COUNTS, _SECTIONS, lines, paper_facts, results, sections
from foliolith.session import table as t
from foliolith.sources import files


def info(spark, sf, docs=None):
    """Documents (all, or ``docs``) as papers whose files say little."""
    none = {"error": "string", "width": "double", "height": "double", "label": "string", "orientation": "string", "columns": "int", "top": "double", "bottom": "double", "left": "double", "right": "double", "metadata": "map<string,string>"}
    return (docs or t(spark, sf, "documents")).select(
        "doc_id", F.col("doc_id").cast("string").alias("filename"), F.lit("pdf").alias("extension"), F.lit("pdf").alias("format"), F.col("n_chars").alias("size"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()],
        F.lit(2).alias("page_count"), F.lit(True).alias("page_count_exact"), F.lit("").alias("title"), F.lit(False).alias("anonymous_package"))


def typography(spark, sf):
    f = facts.assemble(sections(spark, sf), info(spark, sf))
    g = lambda p: F.col(f"facts.{p}")
    return f.select(
        "doc_id", g("typography.body_font").alias("body_font"), g("typography.body_font_size_pt").alias("body_size"), g("typography.title_font_size_pt").alias("title_size"),
        F.array_join(F.transform(g("typography.sizes"), lambda x: x.cast("int").cast("string")), ",").alias("sizes"), F.size(g("structure.sections")).alias("headings"),
        F.coalesce(F.try_element_at("typography_notes.fonts_used", F.lit("Times")), F.lit(0)).cast("bigint").alias("times"), g("identity.funding").alias("funding"), g("identity.acknowledgement").alias("acknowledged"),
        g("identity.author_block").alias("author_block"),
    )


def files_to_verdicts(spark, sf):
    """Every document as a LaTeX file, read, classified, checked and judged."""
    d = t(spark, sf, "documents")
    tex = F.concat(F.lit("\\documentclass{article}\\title{Paper}\\begin{document}\\maketitle\n\\section{Introduction}\n"), F.coalesce("text", F.lit("")), F.lit("\n\\end{document}"))
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, ".pdf").otherwise(".tex"))
    content = F.when(F.col("doc_id") % 10 == 0, F.lit("%PDF-1.4 x")).otherwise(tex)
    # Texts are dealt over all tasks, as a file is far less than a task of the reader; files are
    # read and classified once, though several facts look at them.
    d = d.select(name.alias("filename"), name.alias("path"), F.encode(content, "UTF-8").alias("content")).repartition("path")
    parsed = files.parse_files(d).persist(StorageLevel.DISK_ONLY)
    sections = checking.sections_of(parsed).persist(StorageLevel.DISK_ONLY)
    house = rules.rules_frame(spark, {"house": {"file_type": {"accepted": ["tex"]}, "sections": {"abstract_required": False}}})
    return checking.check_batch(sections, checking.info_of(parsed, sections), house).groupBy(F.col("error").isNotNull().alias("unreadable"), "validation").agg(F.count("*").alias("n"))


def urls(spark, sf):
    u = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://drive.example/drive/folders/abcdefghij_"), "p_partkey", F.lit("?usp=x"))).when(
        F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://drive.example/open?id=ABCDEFGHIJ-"), "p_partkey")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("klmnopqrstuv"), "p_partkey")).otherwise("nothing here")
    return t(spark, sf, "part").select("p_partkey", V.folder_id(u).alias("folder"))


def sniffed(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x"))
    head = F.when(F.col("doc_id") % 5 == 0, "%PDF-1.7 ").when(F.col("doc_id") % 5 == 1, "PK\x03\x04").when(F.col("doc_id") % 5 == 2, "\\documentclass{a} ").otherwise("")
    name = F.when(F.col("doc_id") % 7 == 0, "a.TEX").when(F.col("doc_id") % 7 == 1, "b.docx").otherwise("c.txt")
    return d.select("doc_id", V.sniff_format(F.encode(F.concat(head, "x"), "UTF-8"), name).alias("format"))


def drive(spark, sf):
    kind = F.when(F.col("p_partkey") % 4 == 0, V.FOLDER).when(F.col("p_partkey") % 4 == 1, V.GOOGLE_DOC).when(F.col("p_partkey") % 4 == 2, "application/pdf").otherwise(V.SHORTCUT)
    p = t(spark, sf, "part").select("p_partkey", kind.alias("mime_type"), F.concat(F.lit("f."), F.when(F.col("p_partkey") % 3 == 0, "PDF").otherwise("odt")).alias("name"))
    return R.drive_candidates(p, ["pdf", ".docx"]).select("p_partkey")


def cursors(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", V.encode_cursor(user=F.col("o_custkey"), at=F.col("o_orderkey")).alias("c"))
    return o.select("o_orderkey", V.decode_cursor(F.col("c"), "user bigint, at bigint").alias("d")).select("o_orderkey", "d.user", "d.at")


def integrity(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    d = d.withColumn("sha256", F.when(F.col("doc_id") % 7 > 0, F.sha2("content", 256)).otherwise("x")).withColumn("size", F.length("content") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0))
    return R.check_integrity(d).groupBy("intact").agg(F.count("*").alias("n"))


def edits(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("body"), F.lit(1).alias("version"), F.lit(None).cast("int").alias("deleted_at"))
    c = R.edit_comment(c, F.col("turn") % 3 == 0, F.lit("new"), F.lit(5))
    c = R.edit_comment(c, F.col("turn") % 6 == 0, None, F.lit(5))
    return c.groupBy("version", F.col("deleted_at").isNotNull().alias("deleted"), (F.col("body") == "new").alias("new")).agg(F.count("*").alias("n"))


def thread_views(spark, sf):
    c = t(spark, sf, "conversations")
    m = c.groupBy(F.col("conv_id").alias("submission_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("at"), F.col("role").alias("author"), F.col("text").alias("body")))).alias("messages"))
    r = m.filter("submission_id % 2 = 0").select("submission_id", F.lit("assistant").alias("reviewer_id"))
    v = portal.thread_view(m, r, F.lit("user"), F.col("submission_id") % 5 == 0)
    return v.select("submission_id", F.size(F.filter("messages", lambda x: x["author"] == "Reviewer")).alias("hidden"))


def file_comparison(spark, sf):
    """Every document's facts against those of the first of its language."""
    d = t(spark, sf, "documents")
    # Only the compared facts leave assemble, and templates are found before theirs are made.
    first = d.filter("lang is not null").groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    of = lambda docs, name: facts.assemble(sections(spark, sf, docs), info(spark, sf, docs), inference.COMPARED_FACTS).select("doc_id", inference.compared_facts(F.col("facts")).alias(name))
    template = of(d.join(first.select("doc_id"), "doc_id", "left_semi"), "template").join(first, "doc_id").drop("doc_id")
    papers = of(d, "paper").join(d.select("doc_id", "lang"), "doc_id")
    pairs = papers.join(template, "lang").select(F.col("doc_id").alias("paper_id"), "template", "paper")
    return inference.run_comparison(pairs).filter("id in ('typography.body_font', 'typography.body_size')").groupBy("id", "status").agg(F.count("*").alias("n"))


_BODY = "b AS (SELECT doc_id, pos, CASE WHEN length(x) % 3 = 0 THEN 'Times' ELSE 'Arial' END AS font, length(x) % 4 + 9 AS size, kind, x, sn FROM y)"

QUERIES = {
    "f17_typography": (typography, f"""WITH {_SECTIONS}, {_BODY}, f AS (SELECT doc_id, arg_max(font, (n, -p)) AS body_font FROM (SELECT doc_id, font, count(*) AS n, min(pos) AS p FROM b WHERE kind = 'body' GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT doc_id, arg_max(size, (n, -p))::DOUBLE AS body_size, string_agg(size::VARCHAR, ',' ORDER BY size) AS sizes FROM (SELECT doc_id, size, count(*) AS n, min(pos) AS p FROM b WHERE kind = 'body' GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS au, arg_min(font, pos) AS afont FROM b WHERE kind = 'authors' GROUP BY 1),
g AS (SELECT doc_id, max(CASE WHEN kind = 'title' THEN size END)::DOUBLE AS title_size, count(*) FILTER (kind = 'heading')::INT AS headings, count(*) FILTER (font = 'Times' AND kind <> 'authors') AS times, string_agg(x, chr(10) ORDER BY pos) AS full_text FROM b GROUP BY 1)
SELECT d.doc_id, body_font, body_size, title_size, coalesce(sizes, '') AS sizes, coalesce(headings, 0)::INT AS headings, (coalesce(times, 0) + CASE WHEN afont = 'Times' THEN 1 ELSE 0 END)::BIGINT AS times,
  regexp_matches(coalesce(full_text, ''), '(?i)(\\b(funded|funded by|supported by|grant(?:s)?|award(?:s)?|grant no|award no|project no|r\\d{{2}}[A-Z]{{2}}\\d{{4,}}|nsf|erc|dst[ie]|nih|erc|eu horizon)\\b)') AS funding,
  regexp_matches(coalesce(full_text, ''), '(?i)\\b(we (thank|gratefully acknowledge|acknowledge)|this (work|research) (was|is) (supported|funded)|the authors (thank|acknowledge))\\b') AS acknowledged, coalesce(trim(au), '') <> '' AS author_block
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN a USING (doc_id)"""),
    "x3_files_to_verdicts": (files_to_verdicts, None),
    "x2_file_comparison": (file_comparison, f"""WITH {_SECTIONS}, {_BODY}, f AS (SELECT doc_id, arg_max(font, (n, -p)) AS font FROM (SELECT doc_id, font, count(*) AS n, min(pos) AS p FROM b WHERE kind = 'body' GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT doc_id, arg_max(size, (n, -p)) AS size FROM (SELECT doc_id, size, count(*) AS n, min(pos) AS p FROM b WHERE kind = 'body' GROUP BY 1, 2) GROUP BY 1), dd AS (SELECT doc_id, lang, font, size FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN z USING (doc_id)),
mm AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY 1), ww AS (SELECT mm.lang, dd.font AS wf, dd.size AS ws FROM mm JOIN dd USING (doc_id)),
u AS (SELECT 'typography.body_font' AS id, CASE WHEN font IS NULL THEN 'missing' WHEN font = wf THEN 'passed' ELSE 'failed' END AS status FROM dd JOIN ww USING (lang) WHERE wf IS NOT NULL UNION ALL SELECT 'typography.body_size', CASE WHEN size IS NULL THEN 'missing' WHEN abs(size - ws) <= 0.51 THEN 'passed' ELSE 'failed' END FROM dd JOIN ww USING (lang) WHERE ws IS NOT NULL)
SELECT id, status, count(*) AS n FROM u GROUP BY 1, 2"""),
    "d4_reference_entries": (lambda s, sf: lines(s, sf).groupBy("doc_id").agg(F.count_if(T.is_reference_entry(F.col("text"))).alias("n")), f"WITH {_SECTIONS} SELECT doc_id, count(*) FILTER (e) AS n FROM c GROUP BY 1"),
    "d23_first_headings": (lambda s, sf: sections(s, sf).groupBy("doc_id").agg(structure.first_of(sections(s, sf), "heading").alias("heading"), F.length(structure.full_text()).alias("chars")),
        f"WITH {_SECTIONS} SELECT doc_id, arg_min(x, pos) FILTER (kind = 'heading') AS heading, (sum(length(x)) + count(*) - 1)::INT AS chars FROM y GROUP BY 1"),
    "f20_keywords": (lambda s, sf: t(s, sf, "part").select("p_partkey", F.array_join(T.keyword_list(F.concat("p_name", F.lit(", "), "p_type", F.lit(";; x "))), "|").alias("keywords")), "SELECT p_partkey, p_name || '|' || p_type || '|x' AS keywords FROM part"),
    "a5_anonymity": (lambda s, sf: paper_facts(t(s, sf, "documents")).select("paper_id", decisions.anonymity_score(F.col("facts")).alias("score")), f"WITH {_COUNTS} SELECT paper_id, (100 - 30 * (1 - ok_em) - 10 * (1 - ok_id))::INT AS score FROM y"),
    "a7_batch_cap": (lambda s, sf: decisions.batch_cap(t(s, sf, "documents"), "source", "doc_id", 20).select("source", "doc_id"), "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20"),
    "a14_categories": (lambda s, sf: decisions.by_category(results(s, sf)).filter("category in ('structure', 'page')").select("paper_id", "category", "ord", "passed", "failed", "missing", "not_applicable"),
        f"WITH {_COUNTS} SELECT paper_id, 'structure' AS category, 4 AS ord, ok_title::BIGINT AS passed, 0::BIGINT AS failed, (1 - ok_title)::BIGINT AS missing, 2::BIGINT AS not_applicable FROM y UNION ALL SELECT paper_id, 'page', 2, ok_page, 1 - ok_page, 0, 0 FROM y"),
    "v2_warnings": (lambda s, sf: t(s, sf, "orders").select("o_orderkey", F.size(diffs.comparison_warnings(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 5 == 0)).alias("n")), "SELECT o_orderkey, ((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_custkey % 5 = 0)::INT)::INT AS n FROM orders"),
    "s2_sniffed": (sniffed, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 5 = 1 THEN 'docx' WHEN doc_id % 7 = 0 OR doc_id % 5 = 2 THEN 'latex' WHEN doc_id % 7 = 1 THEN 'docx' ELSE 'unknown' END AS format FROM documents"),
    "s9_candidates": (drive, "SELECT p_partkey FROM part WHERE p_partkey % 4 = 1 OR (p_partkey % 4 = 2 AND p_partkey % 3 = 0)"),
    "s10_folder_ids": (urls, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'abcdefghij_' || p_partkey WHEN 1 THEN 'ABCDEFGHIJ-' || p_partkey WHEN 2 THEN 'klmnopqrstuv' || p_partkey END AS folder FROM part"),
    "o8_cursors": (cursors, "SELECT o_orderkey, o_custkey AS user, o_orderkey AS at FROM orders"),
    "k9_integrity": (integrity, "SELECT doc_id % 7 > 0 AND doc_id % 11 > 0 AS intact, count(*) AS n FROM documents GROUP BY 1"),
    "k8_edits": (edits, "SELECT (1 + (turn % 3 = 0)::INT + (turn % 6 = 0)::INT)::INT AS version, turn % 6 = 0 AS deleted, turn % 3 = 0 OR text = 'new' AS new, count(*) AS n FROM conversations GROUP BY 1, 2, 3"),
    "x23_thread_views": (thread_views, "SELECT conv_id AS submission_id, (CASE WHEN conv_id % 2 = 0 AND conv_id % 5 > 0 THEN count(*) FILTER (role = 'assistant') ELSE 0 END)::INT AS hidden FROM conversations GROUP BY conv_id"),
    "q11_visible_answers": (lambda s, sf: t(s, sf, "part").select("p_partkey", R.visible_answers(F.create_map(F.lit("a"), "p_name", F.lit("b"), "p_type"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("c")))).alias("m")).select("p_partkey", F.array_join(F.map_values("m"), "|").alias("shown")),
        "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS shown FROM part"),
    "c12_schema": (lambda s, sf: inference.rule_schema(s).groupBy("group").agg(F.count("*").alias("n")),
        """SELECT * FROM (VALUES ('name', 1), ('file_type', 6), ('pages', 11), ('sections', 7), ('anonymisation', 11), ('typography', 40), ('paragraph', 10), ('decision', 3)) v("group", n)"""),
}
