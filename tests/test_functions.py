"""Column functions on small literal inputs."""

import json
import random
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from auditlake.functions import html as H
from auditlake.functions import text as T
from auditlake.functions import urls as U
from auditlake.operators import discover
from auditlake.operators import windows as W


def column(spark, values, build, ddl="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, v {ddl}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_lengths_count_utf16_units_and_bytes(spark):
    assert column(spark, ["a😀", "é", ""], T.utf16_len) == [3, 1, 0]
    assert column(spark, ["a😀", "é", ""], T.byte_len) == [5, 2, 0]


def test_tokens(spark):
    assert column(spark, [-1, 0, 1, 2, 5, 6], T.tokens_est, "bigint") == [0, 0, 0, 1, 1, 2]


def test_white_space_is_unicode(spark):
    assert column(spark, ["  a \tb  c ", "a b", ""], T.collapse_ws) == ["a b c", "a b", ""]


def test_labels(spark):
    assert column(spark, [0, 999, 1250, 1450, 9999, 12400], T.format_chars, "bigint") == ["0", "999", "1.3k", "1.4k", "10.0k", "12k"]
    assert column(spark, [850, 1000, 2540, 59999, 119500], T.format_duration, "bigint") == ["850 ms", "1s", "2.5s", "1m 0s", "1m 60s"]


@pytest.mark.parametrize("exact", [False, True])
def test_json_is_one_value(spark, exact):
    texts = ['{"a": 1}', "1 2", "[1,]", " null ", "", "1] , [2", '1}, {"b":2', "{'a':1}", "NaN", '[{"a":[1,{"b":null}]}]']
    check = T.is_valid_json_exact if exact else T.is_valid_json
    want = [True, False, False, True, False, False, False, False, False, True]
    assert column(spark, texts, check) == want


def test_clamp_takes_nan_for_zero(spark):
    assert column(spark, [float("nan"), -0.5, 0.25, 7.0], T.clamp01, "double") == [0.0, 0.0, 0.25, 1.0]


def test_resolve_matches_the_standard_library(spark):
    base = "https://docs.example.com/guide/intro/page.html?x=1#top"
    hrefs = ["/a", "b", "../c/./d", "?q=1", "#f", "", "//cdn.example.com/x", "https://other.example.com/y/../z", "../../../up", "a/", "..", "."]
    got = column(spark, hrefs, lambda h: U.resolve_href(h, F.lit(base)))
    want = [urljoin(base, h) for h in hrefs]
    want[5] = base.split("#")[0]
    want[7] = "https://other.example.com/z"  # a browser also resolves the dots of absolute hrefs
    assert got == want


def test_resolve_encodes_and_refuses(spark):
    base = F.lit("http://EXAMPLE.com:80/x")
    got = column(spark, ["/é b", "http://", "mailto:a@b.c", "http://a b/c"], lambda h: U.resolve_href(h, base))
    assert got == ["http://example.com/%C3%A9%20b", None, "mailto:a@b.c", None]


def test_scope_rules_differ_at_the_segment_boundary(spark):
    urls = ["https://h/api", "https://h/api/x", "https://h/apiary", "https://other/api", "https://h/"]
    assert column(spark, urls, lambda u: U.under_prefix(u, F.lit("h"), F.lit("/api"))) == [True, True, False, False, False]
    assert column(spark, urls, lambda u: U.bfs_in_scope(u, F.lit("https://h/api/"))) == [True, True, True, False, False]


def test_normalise_and_variants(spark):
    assert column(spark, ["https://h/a//?q#f", "https://h", "nope"], U.normalize_url) == ["https://h/a?q", "https://h/", None]
    assert column(spark, ["https://h/", "https://h/a/?q=1"], U.md_variant) == ["https://h/index.md", "https://h/a.md?q=1"]


PAGE = """<!doctype html><html><head><title> A &amp; B </title><meta name="description" content=" About "><meta property="og:title" content="old">
<meta content="new" property='og:title'><meta property=og:type content=site><meta name="twitter:card" content="c">
<script type="application/ld+json">{"@type": "Article"}</script><script type="application/ld+json">{bad</script>
<style>p{}</style></head><body><!-- <a href="/hidden">x</a> --><nav><a href="/n">Nav</a></nav><h1>Top</h1><p>Text <b>bold</b> and <a href="/l">link</a></p>
<script>var s = "<a href='/script'>no</a>";</script><pre><code class="language-json">{"a": 1}
</code></pre><ul><li>one</li><li>two</li></ul><img src="/i.png" alt="pic"><img src="/j.png"><h3>Skip</h3></body></html>"""


def test_snippet(spark):
    s = column(spark, [PAGE], H.snippet)[0]
    assert (s.title, s.description, s.first_h1) == ("A & B", "About", "Top")
    assert s.og == {"og:title": "new", "og:type": "site"} and s.twitter == {"twitter:card": "c"}
    assert s.json_ld == ['{"@type": "Article"}']
    assert column(spark, [PAGE], lambda h: H.snippet(h, legacy=True))[0].json_ld == []


def test_markdown(spark):
    md = column(spark, [PAGE], H.html_to_markdown)[0]
    for part in ["# Top", "Text **bold** and [link](/l)", '```json\n{"a": 1}\n```', "-   one\n-   two", "![pic](/i.png)", "### Skip"]:
        assert part in md, md
    assert "var s" not in md and "hidden" not in md


def test_literal_marks_are_no_structure(spark):
    md = column(spark, ["<body><p># not a heading</p><p>```</p><h2>Real</h2></body>"], H.html_to_markdown)[0]
    assert md == "\\# not a heading\n\n\\`\\`\\`\n\n## Real"


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.text, self._skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self._skip += tag in ("script", "style")
        href = dict(attrs).get("href")
        if tag == "a" and href is not None:
            self.found.append(href)

    def handle_endtag(self, tag):
        self._skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self._skip:
            self.text.append(data)


def test_links_and_text_match_a_parser_on_random_pages(spark):
    rng = random.Random(7)
    pieces = ["<p>word &amp; more</p>", '<a class=x href="/a?b=1&amp;c=2">t</a>', "<A HREF='/up'>u</A>", "<!-- <a href='/no'> -->", "<script>'<a href=/s>'</script>",
              "<a name=x>none</a>", "<a href=bare>b</a>", "<style>a{}</style>", "plain <i>text</i> ", "<br>", '<a href="">e</a>']
    pages = ["<body>" + "".join(rng.choices(pieces, k=12)) + "</body>" for _ in range(60)]
    links, texts = column(spark, pages, H.hrefs), column(spark, pages, H.visible_text)
    for page, got, text in zip(pages, links, texts):
        parser = Anchors()
        parser.feed(page)
        assert [h for h in got if h] == [h for h in parser.found if h]
        assert text == " ".join("".join(parser.text).split())


def test_unclosed_and_huge_pages_finish(spark):
    pages = ["<body>" + "<a href='/x'>" * 50_000, "<script" * 100_000, "<body>" + "x " * 2_000_000 + "</body>", "<" * 300_000, "<!--" * 100_000]
    got = column(spark, pages, lambda h: F.length(H.html_to_markdown(h)))
    assert len(got) == len(pages)
    assert column(spark, pages, lambda h: F.size(H.hrefs(h)))[0] == 50_000


def test_budget_never_exceeds_the_total(spark):
    parts = column(spark, [PAGE, "<body></body>", "<nav><nav>a</nav></nav>"], H.content_budget)
    for page, segments in zip([PAGE, "<body></body>", "<nav><nav>a</nav></nav>"], parts):
        assert sum(s.bytes for s in segments) <= len(page.encode()) + 3
        assert all(s.bytes > 0 for s in segments)


def test_even_sample(spark):
    for n, got in zip([0, 3, 8, 9, 100], column(spark, [0, 3, 8, 9, 100], W.even_sample_index, "int")):
        want = list(range(n)) if n <= 8 else [int((i / 7) * (n - 1)) for i in range(8)]
        assert got == want


def test_ordinals_of_a_hot_group_are_numbered_in_blocks(spark):
    rows = [("hot", i * 3) for i in range(500)] + [("cold", 7), ("cold", 1)]
    df = W.ordinal_within(spark.createDataFrame(rows, "k STRING, o BIGINT"), ["k"], "o", "n", block_size=64)
    got = {(r.k, r.o): r.n for r in df.collect()}
    assert got == {**{("hot", i * 3): i for i in range(500)}, ("cold", 1): 0, ("cold", 7): 1}


def test_cap_sanitising(spark):
    got = column(spark, [None, -3.0, 0.4, 7.5, 1e9, float("inf"), float("nan")], W.sanitize_cap, "double")
    assert got == [10, 10, 1, 8, 50, 10, 10]


def test_json_fallback_accepts_repeated_keys(spark):
    assert column(spark, ['{"a":1,"a":2}'], T.is_valid_json_exact) == [True]
    assert json.loads('{"a":1,"a":2}') == {"a": 2}


def test_tag_names_end_where_they_end(spark):
    pages = ['<h1>T</h1><svg-icon name="x"></svg-icon><p>kept text</p>', "<nav-bar></nav-bar><p>kept</p>", "<svg>gone</svg><p>kept</p>"]
    assert column(spark, pages, H.html_to_markdown) == ["# T\n\nkept text", "kept", "kept"]
    assert column(spark, ["<header-menu></header-menu><h1>a</h1><header><h2>b</h2></header>"], H.html_heading_levels) == [[1]]
    assert column(spark, ["<body-like></body-like><p>x</p>"], H.visible_text) == ["x"]


def test_quoted_values_may_hold_angle_brackets(spark):
    pages = ['<a title="x > y" href="/q">L</a>', "<a href='/a>b'>L</a>", '<a title=it\'s href="/r">L</a>', '<a-b href="/no">L</a-b>', '<a href="/s">L']
    assert column(spark, pages, H.hrefs) == [["/q"], ["/a>b"], ["/r"], [], ["/s"]]
    assert column(spark, ['<p><a title="x > y" href="/q">L</a> and <a class="k" href="/z" id="1">M</a></p>'], H.html_to_markdown) == ["[L](/q) and [M](/z)"]
    counts = column(spark, ['<img alt="a > b" src="x"><img alt=" "><img src="y">'], H.image_counts)
    assert [tuple(c) for c in counts] == [(3, 1)]
    assert column(spark, ['<p title="1 > 0">5 < 6 isn\'t <b>bold</b> don\'t</p>'], H.visible_text) == ["5 < 6 isn't bold don't"]


def test_repeated_keys_are_valid_json(spark):
    assert column(spark, ['{"a":1,"a":2}', '{"a":1,"a":}'], T.is_valid_json) == [True, False]


def test_prefix_by_utf16_units(spark):
    texts = ["😀" * 300, "a" + "😀" * 300, "é" * 201, "short", ""]
    assert column(spark, texts, lambda s: T.utf16_prefix(s, 200)) == ["😀" * 100, "a" + "😀" * 99, "é" * 200, "short", ""]
    page = "<body>" + "😀" * 300 + "</body>"
    assert len(column(spark, [page], lambda s: H.snippet(s)["preview"])[0].encode("utf-16-be")) == 400


def test_trim_takes_all_white_space(spark):
    assert column(spark, [" ﻿\n a b 　\t", " ", ""], T.js_trim) == ["a b", "", ""]


BAD = {
    "blanks": ("x" + " " * 200_000 + "y", T.js_trim),
    "headings": ("<h1>" * 50_000, lambda s: H.first_text(s, "h1")),
    "meta": ("<meta " * 33_000, lambda s: H.redirect_markers(s)["meta_refresh"]),
    "titles": ("<title>" * 28_000, lambda s: H.login_markers(s)["signin_title"]),
    "json": ('<script type="application/ld+json">' * 5_700, lambda s: F.size(H.snippet(s)["json_ld"])),
    "quotes": ('<a title="' * 20_000, lambda s: F.size(H.hrefs(s))),
    "tags": ("<p class='" * 20_000, H.strip_tags),
}


@pytest.mark.parametrize("name", BAD)
def test_damaged_pages_take_linear_time(spark, name):
    text, build = BAD[name]
    column(spark, ["<h1>warm</h1>"], build)
    start = time.perf_counter()
    column(spark, [text], build)
    assert time.perf_counter() - start < 6


def test_damaged_sitemaps_take_linear_time(spark):
    body = "<urlset>" + "<url>" * 40_000 + "<url><loc>https://a.example.com/x</loc></url>" + "<url><loc>"
    df = spark.createDataFrame([("r", "s", "u", body)], "run_id string, site_id string, sitemap_url string, body string")
    start = time.perf_counter()
    assert [r["loc"] for r in discover.sitemap_locs(df).collect()] == ["https://a.example.com/x"]
    assert time.perf_counter() - start < 6


def test_content_is_the_whole_outer_element(spark):
    pages = [
        "<main><article>A</article><article>B</article>tail</main>x",
        '<div role="main"><div>A</div><p>B</p></div><div>x</div>',
        "<p>a</p><article>A<article-note>n</article-note><article/>B</article>c",
        "<body><section><main-nav></main-nav>only</section></body>",
        "<main>never closed <p>B</p>",
        '<article class="k">first</article><main>second</main>',
    ]
    want = ["<article>A</article><article>B</article>tail", "<div>A</div><p>B</p>", "A<article-note>n</article-note><article/>B", "<section><main-nav></main-nav>only</section>", "never closed <p>B</p>", "first"]
    assert column(spark, pages, H.content_body) == want
    parts = column(spark, ['<div role="main"><div>A</div>B</div><p>rest</p>'], H.content_budget)[0]
    assert {p["label"]: p["bytes"] for p in parts}["content"] == 13


def test_character_references(spark):
    """All names, numbers and missing semicolons, as the standard library reads them."""
    import html as std

    texts = ["&eacute; &#233; &#x2014; &amp;lt; &AMP &ampx; &unknown; &notit; &#0; &#x110000; &#55296; &#150; &#99999999999999999999; &#x1F600;",
             "& &; &#; &lt&gt; &CounterClockwiseContourIntegral; &NotEqualTilde; &#x;", "plain", "&Tab;x"]
    names = sorted(std.entities.html5)
    texts += [" ".join("&" + n for n in names[i : i + 300]) for i in range(0, len(names), 300)]
    assert column(spark, texts, H.decode_entities) == [std.unescape(t) for t in texts]
    assert column(spark, [None], H.decode_entities) == [None]


def test_nested_lists_and_quotes(spark):
    pages = {
        "<ol><li>a</li><li>b<ul><li>c</li></ul></li></ol>": "1.  a\n2.  b\n    -   c",
        '<ol start="7"><li>a<li>b</ol>': "7.  a\n8.  b",
        "<blockquote><p>q</p></blockquote>": "> q",
        "<blockquote><p>q</p><blockquote>r</blockquote></blockquote>": "> q\n>\n> > r",
        "<ul><li><p>a</p></li></ul>": "-   a",
        "<ul><li><ul><li>deep</li></ul></li></ul>": "-   -   deep",
        "<ul><li>a<pre><code>x\ny</code></pre></li></ul>z": "-   a\n\n    ```\n    x\n    y\n    ```\n\nz",
        "<li>loose</li></ul></li>text": "-   loose\n\ntext",
        "<h1></h1>x": "x",
        "<img alt='A' src='a.png'><img src=b.png><img alt=C src=\"c.png\">": "![A](a.png)![](b.png)![C](c.png)",
        "<pre>a <ul><li>b</pre>": "a b",
    }
    assert column(spark, list(pages), H.html_to_markdown) == list(pages.values())


def test_panels_with_nested_elements(spark):
    page = "<div role=tabpanel><div>one</div> <p>two</p></div><section class='x tab-panel' data-tab-panel>three &eacute;<div role='tabpanel'>in</div></section><tab-panel>open  end"
    assert [tuple(r) for r in column(spark, [page, "<p>none", "<div role=tabpanels>"], H.tab_panels)] == [(5, 7 + 2 * 9 + 2 + 8), (0, 0), (0, 0)]


def test_nested_markup_is_linear():
    import time

    from auditlake.functions import markup

    start = time.perf_counter()
    for part in ("<ul><li>", "<blockquote>a", "<pre>", "<li>x", "</ul>", "<div role=tabpanel>a b", '<a x="'):
        markup.laid_out(part * 3_000)
        markup.panel_sizes(part * 20_000)
    assert time.perf_counter() - start < 60


def test_page_walks_hold_few_pages_at_a_time(spark):
    pages = spark.createDataFrame([(i, "<ul><li>a</li></ul><div role=tabpanel>b c</div>" if i % 3 else None) for i in range(300)], "i INT, v string")
    out = pages.select("i", H.html_to_markdown(F.col("v")).alias("md"), H.tab_panels(F.col("v")).alias("tabs"))
    # Arrow batches hold 10,000 whole pages in a worker, whatever their size.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    got = {r.i: (r.md, tuple(r.tabs)) for r in out.collect()}
    assert all(got[i] == (("-   a\n\nb c", (1, 3)) if i % 3 else (got[0][0], (None, None))) for i in range(300)), got[1]
