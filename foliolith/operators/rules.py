"""The rule engine: every rule is one column over (facts, rules); all are inlined at once.

A result is a row; rules that only speak sometimes are null otherwise and never leave a
placeholder, because the set of rows decides the score.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.functions import text as T
from foliolith.functions import values as V

_FMT = (
    "struct<font_family:string,font_size_pt:double,bold:boolean,italic:boolean,alignment:string,line_spacing:double,"
    "space_above_pt:double,space_below_pt:double,indent_first_line_pt:double>"
)
_MARGINS = "struct<top:double,bottom:double,left:double,right:double>"
FACTS = f"""
file struct<filename:string,extension:string,format:string,size_bytes:bigint>,
layout struct<page_count:int,page_count_exact:boolean,width:double,height:double,page_size_label:string,orientation:string,columns:int,margins:{_MARGINS},margins_confidence:string>,
typography struct<dominant_font:string,body_font:string,body_font_size_pt:double,title_font_size_pt:double,heading_font_size_pt:double,line_spacing:double,
  first_line_indent_pt:double,space_above_pt:double,space_below_pt:double,sizes:array<double>,alignments:map<string,bigint>>,
structure struct<title_text:string,sections:array<string>,headings:array<string>,has_abstract:boolean,abstract_words:int,has_keywords:boolean,
  references:int,author_text:string,body_words:bigint,total_words:bigint>,
identity struct<author_block:boolean,placeholder_only:boolean,emails:array<string>,affiliations:array<string>,orcids:array<string>,acknowledgement:boolean,
  acknowledgement_text:string,funding:boolean,funding_text:string,self_citations:int,placeholder:boolean,leaks:map<string,string>>
"""
RULES = f"""
name string,
file_type struct<accepted:array<string>,max_mb:double,reject_not_accepted:boolean,reject_missing:boolean,allow_source:boolean,require_source:boolean>,
pages struct<max_pages:int,min_pages:int,page_size_label:string,orientation:string,columns:int,margins:{_MARGINS},margin_tolerance_pt:double,estimate_tolerance:int>,
sections struct<required:array<string>,forbidden:array<string>,abstract_required:boolean,abstract_max_words:int,keywords_required:boolean,min_references:int,canonical_names:boolean>,
anonymisation struct<required:boolean,allow_author_block:boolean,allow_placeholder:boolean,emails:boolean,affiliations:boolean,acknowledgements:boolean,
  self_citation:boolean,funding:boolean,orcid:boolean,terms:array<string>,metadata_fields:array<string>>,
typography struct<title:{_FMT},headings:{_FMT},abstract:{_FMT},body:{_FMT},size_tolerance:double,min_size:double,max_size:double,families:array<string>>,
paragraph struct<line_spacing:double,indent_first_line_pt:double,space_above_pt:double,space_below_pt:double,justified:boolean,uniform:boolean,max_mismatches:int,
  indent_tolerance:double,space_tolerance:double,line_tolerance:double>,
decision struct<reject_blocking:boolean,reject_warning:boolean,min_score:int>
"""
# What a rule set holds where it says nothing.
DEFAULTS = {
    "name": "Untitled template",
    "file_type": {"accepted": ["pdf"], "max_mb": 20.0, "reject_not_accepted": True, "reject_missing": True, "allow_source": True, "require_source": False},
    "pages": {"margin_tolerance_pt": 2.0, "estimate_tolerance": 1},
    "sections": {"required": [], "forbidden": [], "abstract_required": True, "keywords_required": False, "canonical_names": False},
    "anonymisation": {
        "required": False, "allow_author_block": False, "allow_placeholder": True, "emails": True, "affiliations": True, "acknowledgements": True,
        "self_citation": False, "funding": True, "orcid": True, "terms": [],
        "metadata_fields": ["author", "creator", "producer", "title", "subject", "keywords"],
    },
    "typography": {"size_tolerance": 0.51, "families": []},
    "paragraph": {"justified": False, "uniform": False, "max_mismatches": 0, "indent_tolerance": 2.0, "space_tolerance": 2.0, "line_tolerance": 0.01},
    "decision": {"reject_blocking": True, "reject_warning": False},
}
#: Order in which severities and categories are shown.
SEVERITIES = ("blocking", "warning", "advisory")
CATEGORIES = ("file", "page", "layout", "structure", "typography", "paragraph", "anonymisation", "policy")
RESULT = "struct<ord:int,id:string,name:string,category:string,status:string,severity:string,expected:string,actual:string,advice:string,evidence:string,confidence:string>"


def ruleset(given: dict) -> dict:
    """A rule set with its gaps filled by the defaults."""
    out = {k: (dict(v) if isinstance(v, dict) else v) for k, v in DEFAULTS.items()}
    for k, v in given.items():
        if isinstance(v, dict):
            out[k] = {**out.get(k, {}), **v}
        else:
            out[k] = v
    return out


def rules_frame(spark: SparkSession, rules: dict[str, dict]) -> DataFrame:
    """(rules_id, rules): rule sets as rows."""
    rows = [(k, json.dumps(ruleset(v))) for k, v in rules.items()]
    parsed = F.from_json("json", f"struct<{_compact(RULES)}>")
    return spark.createDataFrame(rows, "rules_id string, json string").select("rules_id", parsed.alias("rules"))


def _compact(ddl: str) -> str:
    """Top-level fields of a DDL list in struct form."""
    out, depth, field = [], 0, ""
    for ch in " ".join(ddl.split()) + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind.replace(' ', '')}")
            field = ""
        else:
            field += ch
    return ",".join(out)


def facts_schema() -> str:
    return f"struct<{_compact(FACTS)}>"


def facts_of(groups: dict[str, dict[str, Column]]) -> Column:
    """A struct of all facts from those given by group and name; the others are null."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(FACTS.replace("\n", " "))
    return F.struct(*[
        F.struct(*[groups.get(g.name, {}).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in g.dataType.fields]).alias(g.name) for g in kinds.fields
    ])


def _f(path: str) -> Column:
    return F.col(f"facts.{path}")


def _r(path: str) -> Column:
    return F.col(f"rules.{path}")


def _text(x: Column | str | None) -> Column:
    return (F.lit(x) if isinstance(x, str) or x is None else x).cast("string")


def _row(rule: str | Column, name: str | Column, status: Column | str, severity: Column | str, expected=None, actual=None, advice: str = "", evidence=None, confidence="high") -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    head = F.substring_index(rule, ".", 1)
    return F.struct(
        rule.alias("id"), _text(name).alias("name"), F.when(rule.contains("."), head).otherwise("policy").alias("category"), _text(status).alias("status"),
        _text(severity).alias("severity"), _text(expected).alias("expected"), _text(actual).alias("actual"), F.lit(advice).alias("advice"),
        _text(evidence).alias("evidence"), _text(confidence).alias("confidence"),
    )


def _ok(cond: Column) -> Column:
    return F.when(cond, "passed").otherwise("failed")


def evidence_list(items: Column) -> Column:
    """The first three, and how many more; null without any."""
    rest = F.size(items) - 3
    shown = F.array_join(F.slice(items, 1, 3), "; ")
    return F.when(F.size(items) > 0, F.when(rest > 0, F.concat(shown, F.lit(" (+"), rest.cast("string"), F.lit(" more)"))).otherwise(shown))


def _on(cond: Column, row: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), row)


B, W, A, NA = "blocking", "warning", "advisory", "not_applicable"


def file_rules() -> list[Column]:
    ext, accepted = F.lower(_f("file.extension")), F.transform(_r("file_type.accepted"), lambda e: F.regexp_replace(F.lower(e), r"^\.+", ""))
    missing = ext.isNull() | (ext == "")
    taken = F.coalesce(F.array_contains(accepted, ext), F.lit(False))
    mb, size = _r("file_type.max_mb"), _f("file.size_bytes")
    source = _f("file.format").isin("latex", "docx")
    wanted = F.array_join(F.array_sort(F.array_distinct(accepted)), ", ")
    return [
        _on(missing | taken, _row("file.extension_present", "File extension", F.when(missing & _r("file_type.reject_missing"), "failed").otherwise("passed"), B, wanted, ext, "Name the file with an accepted extension.")),
        _on(~missing & ~taken, _row("file.extension_accepted", "Accepted file type", "failed", F.when(_r("file_type.reject_not_accepted"), B).otherwise(W), wanted, ext, "Submit one of the accepted file types.")),
        _on(mb > 0, _row("file.size", "File size", _ok(size <= mb * 1048576), B, F.format_string("<= %s MB", V.number(mb)), size, "Reduce the size of the file.")),
        _on(~_r("file_type.allow_source") & source, _row("file.source_allowed", "Source upload", "failed", B, "pdf", _f("file.format"), "Submit the compiled document.")),
        _on(_r("file_type.require_source") & (_f("file.format") == "pdf"), _row("file.source_required", "Source files", NA, A, "source", "pdf")),
    ]


def layout_rules() -> list[Column]:
    n, most, least = _f("layout.page_count"), _r("pages.max_pages"), _r("pages.min_pages")
    slack = F.when(_f("layout.page_count_exact"), 0).otherwise(_r("pages.estimate_tolerance"))
    fits = F.coalesce(n <= most + slack, F.lit(True)) & F.coalesce(n >= F.greatest(F.lit(1), least - slack), F.lit(True))
    limit = F.when((most.isNull() & least.isNull()) | n.isNull(), NA).otherwise(_ok(fits))
    label, have = _r("pages.page_size_label"), _f("layout.page_size_label")
    near = F.lit(False)
    for name, w, h in V.PAGES:
        near = near | ((F.lower(label) == name.lower()) & (F.abs(_f("layout.width") - w) <= V.PAGE_TOLERANCE) & (F.abs(_f("layout.height") - h) <= V.PAGE_TOLERANCE))
    same = F.coalesce((F.lower(label) == F.lower(have)) | near, F.lit(False))

    def equal(rule, name, want, got, advice):
        status = F.when(want.isNull(), NA).when(got.isNull(), "missing").otherwise(_ok(want == got))
        return _row(rule, name, status, B, want, got, advice)

    sides = ("top", "bottom", "left", "right")
    gaps = [F.abs(F.coalesce(_f(f"layout.margins.{s}"), F.lit(0.0)) - F.coalesce(_r(f"pages.margins.{s}"), F.lit(0.0))) for s in sides]
    worst = F.greatest(*gaps)
    margins = F.when(_r("pages.margins").isNull(), NA).when(_f("layout.margins").isNull(), "missing").otherwise(_ok(worst <= _r("pages.margin_tolerance_pt")))
    return [
        _row("page.limit", "Page limit", limit, B, F.concat_ws("..", least.cast("string"), most.cast("string")), n, "Shorten or extend the paper.", confidence=F.when(_f("layout.page_count_exact"), "exact").otherwise("medium")),
        _row("layout.page_size", "Page size", F.when(label.isNull(), NA).when(have.isNull() & _f("layout.width").isNull(), "missing").otherwise(_ok(same)), B, label, have, "Set the required page size."),
        equal("layout.orientation", "Orientation", _r("pages.orientation"), _f("layout.orientation"), "Turn the page."),
        equal("layout.columns", "Columns", _r("pages.columns"), _f("layout.columns"), "Use the required columns."),
        _row("layout.margins", "Margins", margins, W, _r("pages.margin_tolerance_pt"), V.number(worst), "Set the required margins.", confidence=_f("layout.margins_confidence")),
    ]


def has_section(name: Column) -> Column:
    """Whether a section stands in the paper: by its facts, its exact name or its synonym."""
    canonical = T.canonical_section(name)
    by_name = F.exists(_f("structure.sections"), lambda s: (F.lower(s) == F.lower(name)) | F.coalesce(s == canonical, F.lit(False)))
    return (
        F.when(F.lower(name) == "abstract", _f("structure.has_abstract")).when(F.lower(name) == "keywords", _f("structure.has_keywords"))
        .when(F.lower(name) == "title", F.coalesce(_f("structure.title_text") != "", F.lit(False))).otherwise(F.coalesce(by_name, F.lit(False)))
    )


def structure_rules() -> list[Column]:
    """Columns of arrays of rows: sections give one row each."""
    slug = lambda n: F.regexp_replace(F.lower(n), r"\s+", "_")
    need = F.transform(_r("sections.required"), lambda n: _row(F.concat(F.lit("structure.section."), slug(n)), F.concat(F.lit("Section "), n), F.when(has_section(n), "passed").otherwise("missing"), B, n, None, "Add the section."))
    forbid = F.transform(_r("sections.forbidden"), lambda n: _row(F.concat(F.lit("structure.forbid."), slug(n)), F.concat(F.lit("No section "), n), _ok(~has_section(n)), W, None, n, "Remove the section."))
    abstract, words, most = F.coalesce(_f("structure.has_abstract"), F.lit(False)), _f("structure.abstract_words"), _r("sections.abstract_max_words")
    refs, least = _f("structure.references"), _r("sections.min_references")
    odd = F.filter(_f("structure.headings"), lambda h: T.canonical_section(h).isNull())
    title = F.coalesce(_f("structure.title_text") != "", F.lit(False))
    flat = [
        _row("structure.title", "Title", F.when(title, "passed").otherwise("missing"), B, "title", _f("structure.title_text"), "Begin with a title."),
        _row("structure.abstract", "Abstract", F.when(~_r("sections.abstract_required"), NA).when(abstract, "passed").otherwise("missing"), B, "abstract", abstract, "Add an abstract."),
        _on(most.isNotNull(), _row("structure.abstract_length", "Abstract length", F.when(~abstract | words.isNull(), NA).otherwise(_ok(words <= most)), W, most, words, "Shorten the abstract.")),
        _row("structure.keywords", "Keywords", F.when(~_r("sections.keywords_required"), NA).when(_f("structure.has_keywords"), "passed").otherwise("missing"), F.when(_r("sections.abstract_required"), B).otherwise(W), "keywords", _f("structure.has_keywords"), "Add keywords."),
        _on(least.isNotNull(), _row("structure.references", "References", F.when(refs.isNull(), NA).otherwise(_ok(refs >= least)), W, least, refs, "Add references.")),
        _on(_r("sections.canonical_names"), _row("structure.heading_names", "Heading names", _ok(F.size(odd) == 0), W, "canonical names", F.size(odd), "Use the usual names.", evidence_list(odd))),
    ]
    return [need, forbid, F.array(*flat)]


def typography_rules() -> list[Column]:
    out: list[Column] = []
    dist = _f("typography.alignments")
    entries = F.map_entries(dist)
    main = F.when(F.size(dist) > 0, F.array_max(F.transform(entries, lambda e: F.struct(e["value"], e["key"])))["key"])
    fonts = {"title": "dominant_font", "headings": "dominant_font", "abstract": "body_font", "body": "body_font"}
    sizes = {"title": "title_font_size_pt", "headings": "heading_font_size_pt", "abstract": "body_font_size_pt", "body": "body_font_size_pt"}
    for el in ("title", "headings", "abstract", "body"):
        rule, none = _r(f"typography.{el}"), _r(f"typography.{el}").isNull()
        key = "heading" if el == "headings" else el
        font, size = _f(f"typography.{fonts[el]}"), _f(f"typography.{sizes[el]}")
        allow = F.transform(_r("typography.families"), F.lower)
        in_list = F.array_contains(allow, F.lower(font))
        match = F.when(F.size(allow) > 0, in_list | (F.array_contains(allow, F.lower(rule["font_family"])) & (F.lower(font) == F.lower(rule["font_family"])))).otherwise(F.lower(font) == F.lower(rule["font_family"]))
        family = F.when(none | rule["font_family"].isNull(), NA).when(font.isNull(), "missing").otherwise(_ok(match))
        fit = F.when(none | rule["font_size_pt"].isNull(), NA).when(size.isNull(), "missing").otherwise(_ok(F.abs(rule["font_size_pt"] - size) <= _r("typography.size_tolerance")))
        align = F.when(none | rule["alignment"].isNull(), NA).when(main.isNull(), "missing").otherwise(_ok(main == rule["alignment"]))
        name = el.capitalize()
        out += [
            _row(f"typography.{key}.font_family", f"{name} font", family, W, rule["font_family"], font, "Use the required font."),
            _row(f"typography.{key}.font_size_pt", f"{name} size", fit, W, rule["font_size_pt"], size, "Use the required size."),
            _on(none | rule["bold"].isNotNull(), _row(f"typography.{key}.bold", f"{name} weight", NA, A, rule["bold"])),
            _on(none | rule["alignment"].isNotNull(), _row(f"typography.{key}.alignment", f"{name} alignment", align, A, rule["alignment"], main, "Align as required.")),
        ]
    lo, hi, seen = _r("typography.min_size"), _r("typography.max_size"), _f("typography.sizes")
    within = F.forall(seen, lambda s: F.coalesce(s >= lo, F.lit(True)) & F.coalesce(s <= hi, F.lit(True)))
    out.append(_on(lo.isNotNull() | hi.isNotNull(), _row("typography.size_range", "Size range", F.when(seen.isNull() | (F.size(seen) == 0), NA).otherwise(_ok(within)), W, F.concat_ws("..", lo.cast("string"), hi.cast("string")), F.array_join(seen.cast("array<string>"), ", "), "Keep sizes within the range.")))
    return out


def paragraph_rules() -> list[Column]:
    out: list[Column] = []
    for field, fact, tol in (("line_spacing", "line_spacing", "line_tolerance"), ("indent_first_line_pt", "first_line_indent_pt", "indent_tolerance"), ("space_above_pt", "space_above_pt", "space_tolerance"), ("space_below_pt", "space_below_pt", "space_tolerance")):
        want, got = _r(f"paragraph.{field}"), _f(f"typography.{fact}")
        rule = {"indent_first_line_pt": "first_line_indent", "space_above_pt": "space_above", "space_below_pt": "space_below"}.get(field, field)
        status = F.when(want.isNull(), NA).when(got.isNull(), "missing").otherwise(_ok(F.abs(want - got) <= _r(f"paragraph.{tol}")))
        out.append(_row(f"paragraph.{rule}", rule.replace("_", " ").capitalize(), status, W, want, got, "Set as required."))
    dist = _f("typography.alignments")
    counts = F.map_values(dist)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    just = F.coalesce(F.try_element_at(dist, F.lit("justified")), F.lit(0))
    none = F.coalesce(total, F.lit(0)) == 0
    # The count of the most frequent alignment is held against the allowance, not the others'.
    most = F.array_max(counts)
    return out + [
        _row("paragraph.justified", "Justified text", F.when(none | ~_r("paragraph.justified"), NA).otherwise(_ok(just / total >= 0.9)), A, "justified", just, "Justify the text."),
        _row("paragraph.uniform_alignment", "Uniform alignment", F.when(none | ~_r("paragraph.uniform"), NA).otherwise(_ok((F.size(dist) <= 1) | (most <= F.greatest(F.lit(1), _r("paragraph.max_mismatches"))))), A, "uniform", F.size(dist), "Align all text alike."),
    ]


def anonymisation_rules() -> list[Column]:
    on, a = _r("anonymisation.required"), "anonymisation"
    clean = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    no = lambda c: ~F.coalesce(c, F.lit(False))

    def rule(key, name, cond, severity, flag=None, evidence=None, actual=None):
        row = _row(f"{a}.{key}", name, _ok(cond), severity, "none", actual, "Remove what identifies the authors.", evidence)
        return _on(on & (_r(f"{a}.{flag}") if flag else F.lit(True)), row)

    hay = F.lower(F.concat_ws(" ", _f("structure.author_text"), _f("identity.acknowledgement_text"), _f("identity.funding_text"), _f("structure.title_text")))
    terms = F.filter(_r(f"{a}.terms"), lambda t: (t != "") & F.contains(hay, F.lower(t)))
    leaks = F.filter(F.map_entries(_f("identity.leaks")), lambda e: F.array_contains(_r(f"{a}.metadata_fields"), e["key"]) & (e["value"] != ""))
    leaked = F.transform(leaks, lambda e: _row(F.concat(F.lit(f"{a}.metadata."), e["key"]), F.concat(F.lit("Metadata "), e["key"]), "failed", F.when(e["key"] == "producer", A).otherwise(B), "empty", F.substring(e["value"], 1, 120), "Remove what identifies the authors."))
    flat = F.array(
        _on(~on, _row(f"{a}.enabled", "Anonymised submission", NA, B, "n/a", "n/a")),
        rule("author_block", "No author block", no(_f("identity.author_block")) | _r(f"{a}.allow_author_block"), B),
        rule("emails", "No e-mail addresses", clean(_f("identity.emails")), B, "emails", evidence_list(_f("identity.emails"))),
        rule("affiliations", "No affiliations", clean(_f("identity.affiliations")), B, "affiliations", evidence_list(_f("identity.affiliations"))),
        rule("acknowledgements", "No acknowledgements", no(_f("identity.acknowledgement")), B, "acknowledgements", _f("identity.acknowledgement_text")),
        rule("funding", "No funding statement", no(_f("identity.funding")), B, "funding", _f("identity.funding_text")),
        rule("orcid", "No researcher ids", clean(_f("identity.orcids")), W, "orcid", evidence_list(_f("identity.orcids"))),
        rule("self_citation", "No self-citation", F.coalesce(_f("identity.self_citations"), F.lit(0)) == 0, W, "self_citation", None, _f("identity.self_citations")),
    )
    tail = F.array(
        _on(on & (F.size(_r(f"{a}.terms")) > 0), _row(f"{a}.forbidden_terms", "No identifying terms", _ok(F.size(terms) == 0), B, "none", evidence_list(terms), "Remove the terms.")),
        _on(on & _r(f"{a}.allow_placeholder") & no(_f("identity.placeholder")), _row(f"{a}.placeholder", "Anonymous placeholder", "passed", A, "placeholder", "none", confidence="medium")),
    )
    return [flat, F.when(on, leaked), tail]


#: Groups in the order of the report; extra groups may be registered by applications.
GROUPS: dict[str, Callable[[], list[Column]]] = {
    "file": lambda: [F.array(*file_rules())],
    "layout": lambda: [F.array(*layout_rules())],
    "structure": structure_rules,
    "typography": lambda: [F.array(*typography_rules())],
    "paragraph": lambda: [F.array(*paragraph_rules())],
    "anonymisation": anonymisation_rules,
}
_EMPTY = RESULT.replace("ord:int,", "")


def check_results(papers: DataFrame, groups: dict | None = None, carry: list[str] = ()) -> DataFrame:
    """One row for each paper and rule that speaks, with the paper's ``carry`` columns.

    ``papers``: paper_id, facts, rules, and error (null, or why the file can't be read; such
    a paper has one failed row). One projection builds all rows of a paper as an array, which
    is inlined: the facts are scanned once, whatever the number of rules.
    """
    rows = [r.cast(f"array<{_EMPTY}>") for g in (groups or GROUPS).values() for r in g()]
    none = F.array().cast(f"array<{_EMPTY}>")
    every = F.filter(F.concat(*[F.coalesce(r, none) for r in rows]), lambda x: x.isNotNull())
    unread = F.array(_row("file.ingest", "Readable file", "failed", B, "readable", "unreadable", "Submit a readable file.", F.col("error"))).cast(f"array<{_EMPTY}>")
    out = papers.select("paper_id", *carry, F.posexplode(F.when(F.col("error").isNotNull(), unread).otherwise(every)).alias("ord", "x"))
    return out.select("paper_id", *carry, "ord", "x.*")


def with_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Papers (paper_id, facts, error, more) with the rule set they name (rules_id). Rule sets
    are configuration rows; the optimiser broadcasts them while they are small."""
    return facts.join(rules, "rules_id", "left")
