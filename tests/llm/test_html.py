import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from pairsift.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First</b>
 paragraph,  &eacute;&#233; &lt;b&gt;.<br><p>Second<p>Third <a href="#">link</a> inside a long enough paragraph.<aside>Side</aside>
<form><input name="q"><button>Go</button></form><ul><li>one</li><li>two</li></ul><div class="comments"><p>Reader says</p></div></article>
<div id="sidebar">More</div><footer>&copy; x &middot; y</footer></body></html>"""


def text(page):
    return "\n".join(b for state, b in html.parse_blocks(page) if state != html.DROPPED_LINE)


def test_article_only():
    assert text(PAGE) == "Head & line\nFirst paragraph, éé <b>.\nSecond\nThird link inside a long enough paragraph.\none\ntwo"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a</p><p>b", "a\nb"),
        ("<article><p>cut off &amp", "cut off &"),
        ("<article><p>kept<div class='a", "kept"),
        ("<article><p>kept</", "kept"),
        ("<article><script>if (a</b) x", ""),
        ("<article>a &am", "a &am"),
        ("<article>5 < 6 and 7 > 2</article>", "5 < 6 and 7 > 2"),
        ("<main><div class=cookie-notice>x</div><table><tr><td>1</td><td>2</td></tr></table></main>", "1\n2"),
        ("<article>a<span hidden>b</span>c</article>", "ac"),
        ("<div role='navigation'>x</div><div class='Header'>y</div><div class='reader'>z</div>", "z"),
        ("<article><p>one\xa0two　three</article>", "one two three"),
        ("<p>a<nav>b</nav>c</p>", "a\nc"),
        ("</div></p>x", "x"),
        ("<article><article>in</article>out</article>", "in\nout"),
        ('<div style="overflow:hidden"><p>Main text here.</p></div>', "Main text here."),
        ('<p title="the hidden cost" data-id="nav">Body</p>', "Body"),
        ('<div class="ad-free-content"><p>Body</p></div><div class="related-work">Work</div>', "Body\nWork"),
        ('<div class="ad-slot-2">x</div><div class="site-header">y</div><div id=nav-list>z</div><p>Body</p>', "Body"),
        ("<p>before<span class=ad>Buy</span>after</p>", "beforeafter"),
        ("<p>a</p><svg-icon></svg-icon><template-x>q</template-x><style-guide/><p>b</p>", "a\nq\nb"),
        ("<p>a</p><svg width=1 /><p>b</p><svg><path d='M'/><text>no</text></svg >c<iframe src=x><p>d</p>", "a\nb\nc\nd"),
        ("<p title=don't>a</p><p class=\"x\"\">b</p><p id='>' data-x=\"5 > 3\">c</p><p alt=\"open>d</p>", "a\nb\nc\nd"),
        ("<main><h1>Title</h1></main><div><p>A body with more text.</p></div><nav>n</nav>", "Title\nA body with more text."),
        ("<article><p>A body with more text.</p></article><div>beside</div>", "A body with more text."),
        ("<section class='menu'><p>Tasting menu article</p></section>", "Tasting menu article"),
        ("<section class='menu'><p>Home</p></section><p>Body</p>", "Body"),
        ("<div class='sidebar ad'><p>Buy</p></div>", ""),
        ("<div class='sidebar'><p>About<span class=ad>Buy</span></p><nav>n</nav></div>", ""),
        ("<article><div class='menu'>x</div></article>", "x"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_common_lines_are_longest():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html.common_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_alignments_of_long_pages_are_halved(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(html, "_AREA", 40)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 60))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html.common_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_equal_lines_between_different_ends():
    a = [f"u{i}" for i in range(50)] + ["-"] * 30_000 + ["end a"]
    b = ["other"] + ["-"] * 29_000 + [f"u{i}" for i in range(50)] + ["end b"]
    began = time.perf_counter()
    assert len(html.shared_lines(a, b)) == 29_000
    assert time.perf_counter() - began < 5


class Plain(HTMLParser):
    """Article text by the standard library's parser: blocks outside of dropped parts, for pages that close what they open."""

    def __init__(self, page):
        super().__init__()
        self.lines, self.text, self.stack = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        block = " ".join("".join(self.text).split())
        if block:
            self.lines.append(block)
        self.text = []

    def handle_starttag(self, name, attrs):
        if name in html.BLOCK:
            self.end()
        words = {w.lower() for k, v in attrs if k in ("class", "id") for w in (v or "").split()}
        if name not in html.VOID:
            self.stack.append((name, name in html.DROPPED or name in html.RAW or bool(words & html.PARTS), name in ("article", "main")))

    def handle_endtag(self, name):
        if name in html.BLOCK:
            self.end()
        names = [s[0] for s in self.stack]
        if name in names:
            del self.stack[len(names) - 1 - names[::-1].index(name) :]

    def handle_data(self, data):
        if any(s[2] for s in self.stack) and not any(s[1] for s in self.stack):
            self.text.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_given_pages_equal_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html LIKE '%<article%'").collect()
    got = {r["page_id"]: r["text"] for r in html.op6_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) > 100
    for r in rows:
        assert got[r["page_id"]] == "\n".join(Plain(r["html"]).lines), r["url"]


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i // 7}/{i}", f"<div>Section {i // 7}</div><p>Body {i}</p>") for i in range(300)]
    monkeypatch.setattr(html, "RANGES_A_TASK", 400)
    found = [sorted(map(str, html.main_text(pages(spark, rows), group).collect())) for group in (1000, 2, 1)]
    assert found[0] == found[1] == found[2]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, host string")


def test_neighbours_lose_shared_lines(spark):
    rows = [(i, f"http://h.example/a/{i:02d}", f"<div>Menu one</div><p>Body {i}</p><div>All rights</div>") for i in range(9)]
    rows += [(20, "http://other.example/x", "<div>Menu one</div><p>Alone</p>"), (21, "http://h.example/b/1?q", "<article><p>Shared body</p></article>"), (22, "http://h.example/b/1#q", "<article><p>Shared body</p></article>"), (23, "http://copy.example/1", "<p>Same</p>"), (24, "http://copy.example/2", "<p>Same</p>")]
    for group in (400, 3, 1):
        got = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows), group).collect()}
        assert [got[i] for i in range(9)] == [f"Body {i}" for i in range(9)]
        assert got[20] == "Menu one\nAlone" and got[21] == got[22] == "Shared body" and got[23] == got[24] == "Same"
        assert all(f"Body {i}" in got[i] for i in range(9))


def test_pages_of_a_large_host_meet_their_nearest_url(spark):
    rows = [(i, f"http://big.example/s{i % 300:03d}/{i:04d}", f"<div>Section {i % 300}</div><p>Body {i}</p>") for i in range(900)]
    rows += [(1000 + i, f"http://h{i % 5}.example/{i % 7}?{i}", f"<div>Line {i % 3}</div><p>Page {i}</p>") for i in range(60)]
    rows += [(2000, "http://big.example/s001/0001", "<p>Same</p>")] * 3 + [(None, "http://big.example/s001/0001", "<p>None</p>")]
    first = None
    for group in (400, 3, 10_000):
        got = sorted(((r["page_id"], r["url"], r["text"]) for r in html.main_text(pages(spark, rows), group).collect()), key=str)
        assert len(got) == len(rows)
        texts = {i: t for i, _, t in got}
        assert all(texts[i] == f"Body {i}" for i in range(900) if i % 300 != 1)
        first = first or got
        assert got == first


def brute(rows):
    """Texts from a quadratic search of the nearest URL and set operations; the lines of these pages come in one order, none twice."""
    keyed = []
    for i, url, page in rows:
        rest = (url or "").split("://", 1)[-1]
        host = re.split("[/?#]", rest.lower())[0]
        keyed.append((host, re.split("[?#]", rest[len(host) :])[0], str(i), url or "", i, html.parse_blocks(page)))
    out = []
    for host, path, _, _, i, lines in (ordered := sorted(keyed, key=lambda x: x[:4])):
        at = next(k for k, x in enumerate(ordered) if x[5] is lines)
        near = []
        for k in (at - 1, at + 1):
            if 0 <= k < len(ordered) and ordered[k][0] == host:
                same = [a == b for a, b in zip(path, ordered[k][1], strict=False)]
                near.append((same.index(False) if False in same else len(same), k))
        other = {x for _, x in ordered[max(near, key=lambda x: (x[0], -x[1]))[1]][5]} if near else set()
        kept = [(s, x) for s, x in lines if s != html.DROPPED_LINE]
        left = [x for s, x in kept if s == html.ARTICLE or x not in other]
        out.append((i, "\n".join(left or [x for _, x in kept]), sum(x in other and s == html.OPEN for s, x in lines) if left else 0))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    parts = ["<nav>Menu {s}</nav>", "<div>Section {s}</div>", "<p>Host {h}</p>", "<article><p>Shared {s}</p><p>Own {i}</p></article>", "<p>Body {i}</p>", "<div class=ad>Ad {a}</div>", "<p>Tail</p>", "<footer>Foot {h}</footer>"]
    rows = []
    for i in range(700):
        h, s, a = rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 40), rng.randint(0, 5)
        page = "".join(p.format(s=s, h=h, i=i, a=a) for p in parts if rng.random() < 0.6)
        url = None if rng.random() < 0.1 else f"http://h{h}.example/s{s}" + rng.choice(["", f"/{i}", f"?t={i}"])
        rows.append((i, url, page))
    want = brute(rows)
    assert sum(n for _, _, n in want) > 100
    for group in (400, 50, 7):
        got = sorted(((r["page_id"], r["text"], r["n_shared"]) for r in html.main_text(pages(spark, rows), group).collect()), key=str)
        assert got == want


def test_long_pages_that_repeat_one_line(spark):
    rows = [(i, f"http://a/{i}", "<p>same line</p>" * 30_000 + f"<p>own {i}</p>") for i in range(2)]
    assert sorted(r["text"] for r in html.main_text(pages(spark, rows)).collect()) == ["own 0", "own 1"]


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "<p>x"), (2**60 + 1, "http://a/b", PAGE), (5, "http://a/c", "<article>" + "<p>long text here</p>" * 20_000)]
    got = [(r["page_id"], r["text"][:14]) for r in html.main_text(pages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (1, ""), (None, "x"), (2**60 + 1, "Head & line\nFi"), (5, "long text here")], key=str)
    assert html.main_text(pages(spark, [])).count() == 0


def test_query(spark, tmp_path):
    pages(spark, [(1, "http://a/b", PAGE), (2, None, None)]).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["url"], r["n_chars"]) for r in html.op6_html(spark, str(tmp_path)).collect()}
    assert got == {1: ("http://a/b", len(text(PAGE))), 2: (None, 0)}
