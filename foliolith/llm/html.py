"""HTML extraction: pages of like URLs are differenced line by line; shared lines go."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.llm.util import Stage, small_batches

# Elements whose content is no text of a page, elements that are furniture
# wherever they stand, elements that begin a new block, elements without content, and words
# of class, id and role attributes that name furniture.
RAW = {"script", "style", "template", "iframe", "noframes", "textarea", "title"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NAMED = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies "
    "share sharing social related recommended newsletter subscribe signup popup modal overlay pagination pager skip toolbar widget"
).split()
_NAMED = frozenset(NAMED)
_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"})
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
MAIN, OTHER = 2, 1


def _furniture(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_main):
        return True
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and not _NAMED.isdisjoint(_SPLIT.split(value)):
            return True
    return False


def lines(page: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, with MAIN if they stand in an article or main
    element, OTHER if elsewhere. Blocks of furniture are left out.

    One linear pass with a stack of open elements; unclosed ones end with their parents,
    and a page that breaks off ends there. Character references are decoded, white space
    becomes one space, empty blocks are dropped.
    """
    if not page:
        return []
    out: list[tuple[str, int]] = []
    buf: list[str] = []
    stack: list[str] = []
    bad = main = 0  # depth at which furniture begins (0: none); open article and main elements
    at, n = 0, len(page)

    def flush():
        text = " ".join("".join(buf).split())
        buf.clear()
        if text:
            out.append((text, MAIN if main else OTHER))

    def text(x: str):
        if x and not bad:
            buf.append(entities.unescape(x))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS and not bad:
                flush()
            if tag in stack:
                while stack:
                    top = stack.pop()
                    main -= top in ("article", "main")
                    if bad > len(stack):
                        bad = 0
                    if top == tag:
                        break
            continue
        if tag in RAW and not (tag == "title" and "svg" in stack):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br" and not bad:
            buf.append(" ")
        if tag in BLOCKS and not bad:
            flush()
        if tag in VOID:
            continue
        if tag == "p" and stack and stack[-1] in ("p", "b", "i", "em", "strong", "a", "span", "u", "font") and "p" in stack:
            while stack and stack[-1] != "p" and stack[-1] not in BLOCKS:
                stack.pop()
            if stack and stack[-1] == "p":
                stack.pop()
            bad = 0 if bad > len(stack) else bad
        stack.append(tag)
        main += tag in ("article", "main")
        if not bad and _furniture(tag, m[3] or "", main > 0):
            flush()
            bad = len(stack)
    flush()
    return out


def _lcs_row(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequence of a and every prefix of b, by bit vectors."""
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    ones = (1 << len(b)) - 1
    v = ones
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & ones
    row, total = [0], 0
    for bit in reversed(bin(v | (1 << len(b)))[3:]) if b else "":
        total += bit == "0"
        row.append(total)
    return row


def shared(a: list[int], b: list[int], most: int = 2_000_000) -> list[int]:
    """Positions in a of one longest common subsequence of a and b.

    Equal ends are cut off. With few matching pairs, chains of matches are grown in order;
    with many, a is halved and b cut where the halves' lengths add up to most.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    ends = list(range(lo)), list(range(len(a) - hi, len(a)))
    where = defaultdict(list)
    for j, v in enumerate(y):
        where[v].append(j)
    if sum(len(where.get(v, ())) for v in x) > most and len(x) > 1:
        half = len(x) // 2
        left, right = _lcs_row(x[:half], y), _lcs_row(x[half:][::-1], y[::-1])
        cut = max(range(len(y) + 1), key=lambda j: left[j] + right[len(y) - j])
        middle = shared(x[:half], y[:cut], most) + [half + i for i in shared(x[half:], y[cut:], most)]
    else:
        tails, nodes = [], []
        for i, v in enumerate(x):
            for j in reversed(where.get(v, ())):
                k = bisect_left(tails, j)
                node = (i, nodes[k - 1] if k else None)
                if k == len(tails):
                    tails.append(j)
                    nodes.append(node)
                else:
                    tails[k], nodes[k] = j, node
        middle, node = [], nodes[-1] if nodes else None
        while node:
            middle.append(node[0])
            node = node[1]
        middle.reverse()
    return ends[0] + [lo + i for i in middle] + ends[1]


#: A neighbour that shares more of a page's lines may be a copy, whose shared lines are no
#: template; further neighbours tell which of them are.
COPY = 0.7


def counted(kinds: list[int]) -> list[int]:
    """The lines that can be main text: those in an article or main element, or all without one."""
    return [i for i, k in enumerate(kinds) if k == MAIN] or list(range(len(kinds)))


def template(keys: list[int], kinds: list[int], neighbours: list[list[int]]) -> list[int]:
    """Positions of the counted lines that are shared with the neighbours, nearest first.

    The first neighbour that shares at most COPY of the lines decides. Of those that share
    more, each may be a copy, so the next is asked; if all share more, the lines that all
    share go. Pages that agree in all lines tell nothing.
    """
    own = counted(kinds)
    mine, gone = [keys[i] for i in own], None
    for other in neighbours:
        found = set(shared(mine, other))
        if len(found) <= COPY * len(own):
            gone = found
            break
        if len(found) < len(own):
            gone = found if gone is None else gone & found
    return sorted(own[i] for i in gone or ())


def main_text(page: list[tuple[str, int]], gone: list[int] | None) -> str:
    """The text of a page's counted lines without those at the positions ``gone``."""
    drop = set(gone or ())
    return " ".join(page[i][0] for i in counted([k for _, k in page]) if i not in drop)


def line_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _parsed(pages: DataFrame) -> DataFrame:
    """The lines, kinds and line hashes of each page, and its place among the pages of its host."""

    def run(batches):
        for b in batches:
            found = [lines(t) for t in b.column("html").to_pylist()]
            cols = {c: b.column(c) for c in ("row", "host", "path")}
            cols["lines"] = pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string()))
            cols["kinds"] = pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32()))
            cols["keys"] = pa.array([[line_key(t) for t, _ in x] for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    names = [c for c in pages.columns if c != "html"]
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(
        F.struct(*names).alias("row"),
        F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col("html").cast("string").alias("html"),
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, host string, path string, lines array<string>, kinds array<int>, keys array<bigint>")


def _numbered(stage: Stage, df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``at``, its place in the given total order: rows are dealt by range, sorted
    and numbered within their task, and the tasks' row counts (one number each) added up."""
    cols = df.columns

    def run(batches):
        from pyspark import TaskContext

        part, i = TaskContext.get().partitionId(), 0
        for b in batches:
            place = pa.array(range(i, i + b.num_rows), pa.int64())
            i += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, place, pa.array([part] * b.num_rows, pa.int32())], names=[*cols, "at", "part"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    out = stage.cut(ranged.mapInArrow(run, f"{fields}, at bigint, part int"))
    before, total = {}, 0
    for part, n in sorted(out.groupBy("part").agg(F.count("*")).collect()):
        before[part], total = total, total + n
    spark = stage.spark
    start = spark.createDataFrame(list(before.items()), "part int, start bigint")
    # One row a task.
    return out.join(F.broadcast(start), "part").withColumn("at", F.col("at") + F.col("start")).drop("part", "start")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The rows of ``pages`` without html, with ``text``: the main text of each page.

    The pages of a host, equal ones as one, are sorted by path and page. Neighbours of a
    page are the two before and after it, by the longer common path and then by distance;
    first among the pages that mark their article (an article or main element) or don't,
    as the page itself, then among all of the host. Its lines are aligned with theirs by
    longest common subsequences and shared lines deleted (see ``template``). On a marked
    page only lines in the article count. Pages alone on their host keep all lines outside
    furniture. A null or empty html has an empty text. Repeated rows are extracted each.
    Sorting deals pages by range, so a host with very many pages spreads over many tasks;
    only line hashes of neighbours travel. Columns named text or like helpers are kept in
    ``row`` or replaced.
    """
    small_batches(spark)
    stage = Stage(spark, "html")
    # Pages are parsed twice, which takes less than to write their lines.
    parsed = _parsed(pages).withColumn("sig", F.xxhash64("keys", "kinds"))
    place = F.struct("path", F.coalesce(F.col("page_id").cast("bigint"), F.lit(-1)).alias("id"))
    slim = stage.cut(parsed.select("row.page_id", "host", "path", "sig", "keys", "kinds"))
    classes = slim.filter(F.size("keys") > 0).groupBy("host", "sig").agg(F.min(place).alias("p"), F.first("keys").alias("keys"), F.first("kinds").alias("kinds"))
    classes = stage.cut(classes.select("host", "sig", F.array_contains("kinds", MAIN).alias("marked"), "p.path", "p.id", "keys", "kinds"))
    common = lambda p, q: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(p), F.length(q)))), lambda i: F.substring(p, F.lit(1), i) == F.substring(q, F.lit(1), i)))

    def beside(order: int, within: list[str]) -> DataFrame:
        df = _numbered(stage, classes.drop("kinds"), [*within, "path", "id", "sig"])
        to = df.select(*within, "at", "path", "keys").withColumn("step", F.explode(F.array(*map(F.lit, (-1, 1, -2, 2)))))
        to = to.select(*within, (F.col("at") - F.col("step")).alias("at"), F.col("path").alias("to"), "step", F.col("keys").alias("other"))
        rank = F.struct(F.lit(order).alias("o"), (-common("path", "to")).alias("c"), F.abs("step").alias("d"), F.col("step").alias("s"), "other")
        return df.drop("keys").join(to, [*within, "at"]).select("host", "sig", rank.alias("n"))

    near = beside(0, ["host", "marked"]).unionByName(beside(1, ["host"]))
    near = near.groupBy("host", "sig").agg(F.transform(F.sort_array(F.collect_list("n")), lambda n: n["other"]).alias("others"))

    def align(batches):
        for b in batches:
            at = [b.column(c).to_pylist() for c in ("keys", "kinds", "others")]
            gone = pa.array([template(*x) for x in zip(*at, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("sig"), gone], names=["host", "sig", "gone"])

    aligned = classes.select("host", "sig", "keys", "kinds").join(near, ["host", "sig"])
    gone = stage.cut(aligned.mapInArrow(align, "host string, sig bigint, gone array<int>").filter(F.size("gone") > 0))
    joined = parsed.select("row", "lines", "kinds", "host", "sig").join(gone, ["host", "sig"], "left").select("row", "lines", "kinds", "gone")

    def run(batches):
        for b in batches:
            out = [main_text(list(zip(x, k, strict=True)), g) for x, k, g in zip(*[b.column(c).to_pylist() for c in ("lines", "kinds", "gone")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    out = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, text string")
    names = [c for c in pages.columns if c not in ("html", "text")]
    return out.select(*[F.col("row")[c].alias(c) for c in names], "text")
