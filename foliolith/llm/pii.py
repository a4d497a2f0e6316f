"""PII: base patterns, and terms that disclose them by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.llm.util import Stage, let

_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Each pattern finds the same matches as the plain one of its kind, in linear time: runs
#: are possessive, and a search doesn't restart inside a run whose end decides the match.
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}+",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)

#: A term counts as a disclosure if its pointwise mutual information with an entity is at
#: least this part of the entity's own information content, seen in MIN_DOCS documents (once
#: is no estimate); for a kind of entity in KIND_DOCS, as its many documents hold rare words
#: by chance: of words in three documents dozens are only in such with addresses, of words
#: in eight practically none.
DISCLOSURE = 0.9
MIN_DOCS, KIND_DOCS = 2, 8
#: Rows up to which a table is broadcast, else joined by a shuffle.
BROADCAST_ROWS = 200_000
TERM = "\\p{L}+"
_SPAN = "array<struct<kind:int,start:bigint,end:bigint,entity:string>>"
_CHUNK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.expr("true") & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    value = F.lower(match) if kind == "email" else match if kind == "ip" else _digits(match)
    return F.concat(F.lit(f"{kind}:"), value)


def running(steps: Column) -> Column:
    """Sums of all steps before each element, in chunks so that long arrays stay linear."""
    longs = "array<bigint>"
    chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int"))
    inner = lambda acc, b: F.aggregate(
        F.slice(steps, b * _CHUNK + 1, _CHUNK),
        F.struct(acc["total"].alias("total"), F.array().cast(longs).alias("out")),
        lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["out"], F.array(a["total"])).alias("out")),
        lambda a: F.struct(a["total"].alias("total"), F.concat(acc["out"], F.array(a["out"])).alias("out")),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast(f"array<{longs}>").alias("out"))
    return F.when(F.size(steps) > 0, F.aggregate(chunks, start, inner, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(longs))


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind: the pieces between matches and the matches alternate, so running
    lengths give code-point positions."""
    regex = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, regex, F.lit(0))
    pieces = F.split(text, PATTERNS[kind], -1)

    def build(x: Column) -> Column:
        m, p = x["m"], x["p"]
        steps = F.transform(m, lambda v, i: (F.length(F.get(p, i)) + F.length(v)).cast("bigint"))
        rows = F.transform(
            F.arrays_zip(m.alias("m"), running(steps).alias("before"), F.slice(p, 1, F.size(m)).alias("l")),
            lambda z: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                (z["before"] + F.length(z["l"])).alias("start"),
                (z["before"] + F.length(z["l"]) + F.length(z["m"])).alias("end"),
                z["m"].alias("entity"),
            ),
        )
        good = F.filter(rows, lambda r: _valid(kind, r["entity"]))
        return F.transform(good, lambda r: r.withField("entity", _entity(kind, r["entity"])))

    return F.when(F.size(found) > 0, let(F.struct(found.alias("m"), pieces.alias("p")), build).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text by kind, then start; a null text is empty. Cheap tests for a
    character that a kind must have spare most texts the search."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(_SPAN)
    digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    return F.concat(*[F.when(gates[k], _spans(text, k)).otherwise(none) for k in KINDS])


def _lower_terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _places(text: Column, want: Column, base: Column) -> Column:
    """Where the terms of the map ``want`` (term to total) stand outside base spans:
    array<struct<start, end, total>>."""

    def build(x: Column) -> Column:
        m, p = x["m"], x["p"]
        steps = F.transform(m, lambda v, i: (F.length(F.get(p, i)) + F.length(v)).cast("bigint"))
        rows = F.transform(F.arrays_zip(m.alias("m"), running(steps).alias("before"), F.slice(p, 1, F.size(m)).alias("l")), lambda z: F.struct(
            (z["before"] + F.length(z["l"])).alias("start"),
            (z["before"] + F.length(z["l"]) + F.length(z["m"])).alias("end"),
            F.try_element_at(want, F.lower(z["m"])).alias("total"),
        ))
        rows = F.filter(rows, lambda t: t["total"].isNotNull())
        return F.filter(rows, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return let(F.struct(found.alias("m"), F.split(text, TERM, -1).alias("p")), build)


def _replaced(text: Column, marks: Column) -> Column:
    """A text with its marks (s, e, as), sorted, replaced; overlapping ones merge under the first."""
    out = F.aggregate(
        marks,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, m: F.when(m["s"] < acc["at"], F.struct(F.greatest(acc["at"], m["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(m["e"].alias("at"), F.concat(acc["out"], F.array(
                F.substring(text, acc["at"].cast("int") + 1, (m["s"] - acc["at"]).cast("int")), m["as"])).alias("out"))),
    )
    tail = lambda o: F.substring(text, o["at"].cast("int") + 1, F.length(text))
    return let(out, lambda o: F.concat(F.array_join(o["out"], ""), tail(o)))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base): one row for each of ``docs``; h is a hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("base"))


def _hits(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text, base, entities, kinds, terms) of the documents with personal data: what
    they protect, by value and by kind, and their terms outside of it."""
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base")).filter(F.size("base") > 0)
    blank = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.lit(" ").alias("as"))))
    return d.select(
        "doc_id", "h", "text", "base",
        F.array_distinct(F.transform("base", lambda s: s["entity"])).alias("entities"),
        F.array_distinct(F.transform("base", lambda s: s["kind"])).alias("kinds"),
        _lower_terms(_replaced(F.col("text"), blank)).alias("terms"),
    )


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most BROADCAST_ROWS rows, which is counted here."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def disclosures(docs: DataFrame, hits: DataFrame, stage: Stage, threshold: float = DISCLOSURE, min_docs: int = MIN_DOCS, kind_docs: int = KIND_DOCS) -> DataFrame:
    """(entity, term, total): the terms that disclose an entity, total if they do so entirely.
    A kind of entity is an entity, too, named kind:0 to kind:3.

    Document frequencies over the whole corpus: c(e) of entities, c(e, t) of terms in whole
    documents with e, and c(t) of terms anywhere. With information content
    IC(e) = log2(N / c(e)) and PMI(t; e) = log2(N c(e, t) / (c(e) c(t))), a term discloses e
    if PMI >= threshold * IC. An entity in every document holds no information and is
    disclosed by nothing. All counts are combined before their shuffles, so hot entities and
    terms are no skew; an entity in fewer than ``min_docs`` documents can have no term and is
    left out before its terms are.
    """
    n = docs.count()
    ces = hits.agg(*[F.coalesce(F.sum(F.array_contains("kinds", k).cast("bigint")), F.lit(0)).alias(str(k)) for k in range(len(KINDS))]).first()
    often = hits.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("ce")).filter(F.col("ce") >= min_docs)
    by_value = hits.select(F.explode("entities").alias("entity"), "terms").join(_small(stage.cut(often)), "entity").withColumn("need", F.lit(min_docs))
    by_kind = hits.select(F.explode("kinds").alias("k"), "terms").select(
        F.concat(F.lit("kind:"), F.col("k")).alias("entity"), "terms",
        F.get(F.array(*map(F.lit, ces)), F.col("k")).cast("bigint").alias("ce"), F.lit(kind_docs).alias("need"),
    )
    ic = F.log2(F.lit(float(max(n, 1))) / F.col("ce"))
    pairs = by_value.unionByName(by_kind).filter(ic > 0).select("entity", "ce", "need", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("cet"), F.first("ce").alias("ce"), F.first("need").alias("need")).filter(F.col("cet") >= F.col("need"))
    # c(t) is at least the number of documents that have t and any entity; terms that fail
    # with that bound fail with c(t), and common words need no count over the corpus.
    least = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("cx"))
    joint = joint.join(least, "term").filter(ic + F.log2(F.col("cet") / F.col("cx")) >= threshold * ic)
    joint = stage.cut(joint.drop("cx", "need"))
    terms = joint.select("term").distinct()
    few = _small(terms)
    seen = docs.select(F.explode(_lower_terms(F.col("text"))).alias("term"))
    # c(t) is counted for the terms in question only: before the shuffle if they are few.
    counts = seen.join(few, "term", "left_semi") if few is not terms else seen
    counts = counts.groupBy("term").agg(F.count("*").alias("ct"))
    pmi = ic + F.log2(F.col("cet") / F.col("ct"))
    return joint.join(counts, "term").filter(pmi >= threshold * ic).select("entity", "term", (F.col("cet") >= F.col("ct")).alias("total"))


def all_spans(spark: SparkSession, docs: DataFrame, threshold: float = DISCLOSURE, min_docs: int = MIN_DOCS, kind_docs: int = KIND_DOCS) -> DataFrame:
    """(doc_id, h, base, terms): base spans and term spans (start, end, total) of each row.

    A document's protected entities are those found in it and their kinds; a disclosing term
    is marked wherever it stands in the document, outside base spans. Null and empty texts
    have none. Repeated rows count each, but have equal results; rows that share a doc_id but
    not a text have their own.
    """
    stage = Stage(spark, "pii")
    hits = stage.cut(_hits(docs))
    marks = stage.cut(disclosures(docs, hits, stage, threshold, min_docs, kind_docs))
    own = hits.dropDuplicates(["doc_id", "h"])
    kinds = F.transform("kinds", lambda k: F.concat(F.lit("kind:"), k))
    # A document's terms are looked up once, whatever the number of its entities.
    pairs = own.select("doc_id", "h", F.concat("entities", kinds).alias("es"), F.explode("terms").alias("term"))
    told = pairs.join(_small(marks), "term").filter(F.array_contains("es", F.col("entity"))).groupBy("doc_id", "h", "term").agg(F.max("total").alias("total"))
    told = told.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.map_from_entries(F.collect_list(F.struct("term", "total"))).alias("want"))
    same = (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    found = own.join(told, same, "left").select(
        F.col("doc_id").alias("__i"), F.col("h").alias("__g"), F.col("base").alias("__base"),
        F.when(F.col("want").isNotNull(), F.sort_array(_places(F.col("text"), F.col("want"), F.col("base")))).alias("__terms"),
    )
    out = docs.select("doc_id", F.xxhash64("text").alias("h")).join(found, (F.col("h") == F.col("__g")) & F.col("doc_id").eqNullSafe(F.col("__i")), "left")
    none = "array<struct<start:bigint,end:bigint,total:boolean>>"
    return out.select("doc_id", "h", F.coalesce("__base", F.array().cast(_SPAN)).alias("base"), F.coalesce("__terms", F.array().cast(none)).alias("terms"))


def span_text(spans: Column, kind: Column | None = None) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind if kind is not None else F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitise(spark: SparkSession, docs: DataFrame, threshold: float = DISCLOSURE, min_docs: int = MIN_DOCS, kind_docs: int = KIND_DOCS) -> DataFrame:
    """``docs`` with personal data replaced in ``text``: base spans and disclosing terms by
    their kind in angle brackets (generalised), total disclosures by nothing (removed).
    Overlapping base spans merge under the first's kind. Other columns and rows stay."""
    spans = all_spans(spark, docs, threshold, min_docs, kind_docs).filter(F.size("base") > 0).distinct()
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    marks = F.sort_array(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.get(names, s["kind"]).alias("as"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("s"), t["end"].alias("e"), F.when(t["total"], "").otherwise("<TERM>").alias("as"))),
    ))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), marks.alias("__marks"))

    names_in = docs.columns
    d = docs.select(F.col("doc_id").alias("__d"), F.col("text").alias("__text"), F.xxhash64("text").alias("__t"), F.struct(*names_in).alias("__row"))
    j = d.join(spans, (F.col("__t") == F.col("__h")) & F.col("__d").eqNullSafe(F.col("__id")), "left")
    text = F.when(F.col("__marks").isNull(), F.col("__text")).otherwise(_replaced(F.col("__text"), F.col("__marks")))
    return j.select(*[text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names_in])
