"""HTML extraction: hand-made pages, and subsequences against a plain table."""

import random

from foliolith.llm import html

from .fixtures import empty

SCHEMA = "page_id long, url string, html string"


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        for most in (10**6, 3):
            got = html.shared(a, b, most)
            assert got == sorted(set(got)) and len(got) == plain_lcs(a, b)
            it = iter(b)
            assert all(a[i] in it for i in got)


def test_lines_of_awkward_markup():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>site</header><nav><ul><li><a href="/">home</a></li></ul></nav><!-- <p>no</p> --><div class="ad box">buy</div>
    <article><header><h1>Head &amp; tail</h1></header><p><b>Bold<br>line <p>A&nbsp;b\n\t c&#233;<i>x</i>y 1 < 2</p>
    <div id="comments"><p>troll</p></div><aside>side</aside><form><input name=q><p>search</p></form><p hidden>h</p>
    <p class="lead">shadow ads in text</p></article><footer>foot</footer><script>unclosed"""
    assert html.lines(page) == [(t, html.MAIN) for t in ("Head & tail", "Bold line", "A b céxy 1 < 2", "shadow ads in text")]
    assert html.lines(None) == html.lines("") == html.lines("<p></p><") == [] or html.lines("<p></p><") == [("<", 1)]
    assert html.lines("<p>cut off &lt;tag <b attr='") [0][0] == "cut off <tag"
    assert len(html.lines("<p>x" * 20000)) == 20000
    assert html.lines("<div>" * 5000 + "deep")[0][0] == "deep"


def page(body):
    return f"<html><body><div>Site title</div><p>Menu of things</p>{body}<p>All rights reserved</p></body></html>"


def test_template_lines_go_and_articles_stay(spark):
    rows = [
        (1, "http://h.org/a/1", page("<p>first text</p><p>more</p><p>and more</p>")), (2, "http://H.org/a/2?x=1", page("<p>second text</p><p>other</p>")),
        (3, "http://h.org/zz", page("<p>third</p><p>text</p>")), (4, "http://alone.org/", page("<p>single</p>")),
        (5, "http://h.org/b/1", "<article><p>same</p></article>"), (6, "http://h.org/b/2", "<article><p>same</p></article><p>x</p>"),
        (7, None, None), (None, "", ""), (8, "not a url", "plain &amp; text"), (1, "http://h.org/a/1", page("<p>first text</p><p>more</p><p>and more</p>")),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as lines", "3 as at")
    got = [(r["page_id"], r["text"]) for r in html.extract(spark, df).collect()]
    assert len(got) == len(rows)
    got = dict(got)
    assert got[2] == "second text other" and got[3] == "third text"
    assert got[4] == "Site title Menu of things single All rights reserved"
    assert got[5] == got[6] == "same" and got[7] == got[None] == "" and got[8] == "plain & text"
    assert html.extract(spark, df).columns == ["page_id", "url", "host", "lines", "at", "text"]
    assert html.extract(spark, empty(spark, SCHEMA)).count() == 0


def test_one_host_over_many_tasks(spark):
    rows = [(i, f"http://big.org/p/{i:05d}", page(f"<p>text {i}</p><p>more {i}</p><p>end {i}</p>")) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r["text"] for r in html.extract(spark, df).collect()}
    assert got == {i: f"text {i} more {i} end {i}" for i in range(800)}


def test_marked_pages_are_aligned(spark):
    art = lambda i: f"<p>Site title</p><article><p>Share this story</p><p>text {i}</p><p>more {i}</p></article>"
    rows = [(i, f"http://m.org/a/{i}", art(i)) for i in range(4)]
    rows.append((9, "http://m.org/a/9", "<p>Site title</p><p>no article</p>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: f"text {i} more {i}" for i in range(4)}, 9: "no article"}


def test_short_pages_and_copies(spark):
    rows = [(i, f"http://s.org/p/{i}", page(f"<p>text {i}</p>")) for i in range(4)]
    long = "".join(f"<p>line {k}</p>" for k in range(12))
    rows += [(10, "http://c.org/x/1", page(f"<p>one</p>{long}")), (11, "http://c.org/x/2", page(f"<p>two</p>{long}")), (13, "http://c.org/x/2?copy", page(f"<p>two</p>{long}"))]
    rows.append((12, "http://c.org/y", page("<p>other</p><p>words</p>")))
    got = {r["page_id"]: r["text"] for r in html.extract(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    text = " ".join(f"line {k}" for k in range(12))
    want = {**{i: f"text {i}" for i in range(4)}, 10: f"one {text}", 11: f"two {text}", 13: f"two {text}", 12: "other words"}
    assert got == want


def plain_extract(rows):
    """The whole extraction, page by page, with a table for each alignment. The pages' shared
    lines stand in one order, so their longest common subsequence is unique."""
    def positions(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        out, i, j = set(), 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j] and t[i][j] == t[i + 1][j + 1] + 1:
                out.add(i)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    pages = {}
    for pid, url, body in rows:
        host, _, path = url.split("//")[1].partition("/")
        pages[pid] = (host.lower(), "/" + path.split("?")[0], html.lines(body))
    out = {}
    for pid, (host, path, own) in pages.items():
        marked = any(k == html.MAIN for _, k in own)
        near = []
        for order, group in ((0, [p for p in pages if pages[p][0] == host and any(k == html.MAIN for _, k in pages[p][2]) == marked]), (1, [p for p in pages if pages[p][0] == host])):
            group.sort(key=lambda p: (pages[p][1], p))
            at = group.index(pid)
            for step in (-1, 1, -2, 2):
                if 0 <= at + step < len(group):
                    other = pages[group[at + step]]
                    same = 0
                    while same < min(len(path), len(other[1])) and path[same] == other[1][same]:
                        same += 1
                    near.append(((order, -same, abs(step), step), [t for t, _ in other[2]]))
        mine = [t for t, k in own if k == html.MAIN or not marked]
        gone = None
        for _, other in sorted(near):
            found = positions(mine, other)
            if len(found) <= html.COPY * len(mine):
                gone = found
                break
            if len(found) < len(mine):
                gone = found if gone is None else gone & found
        out[pid] = " ".join(t for i, t in enumerate(mine) if i not in (gone or set()))
    return out


def test_whole_query_matches_plain_differencing(spark):
    rng, rows = random.Random(8), []
    for host in range(3):
        top, low = [f"top {host} {i}" for i in range(4)], [f"low {host} {i}" for i in range(3)]
        for n in range(14):
            own = [f"own {host} {n} {i}" for i in range(rng.choice([1, 4, 9]))]
            if n % 5 == 4:
                own = [f"own {host} {n - 1} {i}" for i in range(6)] + own[:1]  # a near copy of the page before
            body = "".join(f"<p>{x}</p>" for x in [*sorted(rng.sample(top, rng.randrange(2, 5))), *own, *sorted(rng.sample(low, 2))])
            if n % 3 == 0:
                body = f"<div>outside {host}</div><article>{body}</article>"
            rows.append((100 * host + n, f"http://h{host}.org/{'ab'[n % 2]}/{n:02d}?x={n}", f"<html><body><nav>menu</nav>{body}</body></html>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = plain_extract(rows)
    assert got == want
    whole = {pid: " ".join(t for t, _ in html.lines(body)) for pid, _, body in rows}
    assert sum(len(got[p]) < len(whole[p]) for p in got) > 30
