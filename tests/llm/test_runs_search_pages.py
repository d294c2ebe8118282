"""Periodic runs, ranked lexical search and main text of pages."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import LONG, SF, extra, rows_of

from auditlake.llm import html_blocks, lexical_search, runs
from auditlake.llm.queries import QUERIES

# --- periodic runs -----------------------------------------------------------------------------------------------


def plain_runs(words):
    """Every lag, every place; of equal stretches the least period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("rounds", [12, 2, 0])
def test_runs_against_brute_force(rounds, monkeypatch):
    monkeypatch.setattr(runs, "ROUNDS", rounds)
    draw = random.Random(rounds)
    for _ in range(700):
        kinds, texts = draw.choice([1, 2, 3, 5, 8, 30]), []
        for length in draw.choices([0, 5, 20, 60, 150], k=3):
            words = []
            while len(words) < length:
                words += [b"%d" % draw.randrange(kinds) for _ in range(draw.choice([1, 2, 3, 5, 9]))] * draw.choice([1, 1, 2, 4, 5, 7])
                words = words[: len(words) - (draw.random() < 0.3)]
            texts.append(words)
        assert runs.runs_of(texts) == [plain_runs(t) for t in texts]


def test_runs_of_very_long_texts():
    draw = random.Random(5)
    start = time.perf_counter()
    assert runs.runs_of([[b"a"] * 400_000]) == [[(0, 400_000, 1)]]
    assert runs.runs_of([[b"%d" % (i % 1000) for i in range(400_000)] + [b"x"]]) == [[(0, 400_000, 1000)]]
    assert runs.runs_of([[b"%d" % abs(i) for i in range(-100_000, 100_000)] * 2]) == [[]]
    two = [draw.choice([b"a", b"b"]) for _ in range(2_000)]
    assert runs.runs_of([two]) == [plain_runs(two)]
    assert time.perf_counter() - start < 60


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    got = rows_of(runs.periodic_runs(odd_docs), "doc_id", "runs", "collapsed")
    assert len(got) == odd_docs.count() and runs.periodic_runs(no_docs).count() == 0
    texts = sorted(((r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for (name, found, collapsed), (doc, text) in zip(got, texts, strict=True):
        words = text.encode().split()
        assert name == doc and collapsed == b" ".join(runs.collapse(words, [tuple(r) for r in found])).decode()
        if len(words) < 100:
            assert [tuple(r) for r in found] == plain_runs(words)
    lorem = [tuple(r) for r in dict((r[0], r[1]) for r in got)[6]]
    assert lorem == [(0, 40_000, 5)] and LONG.startswith("lorem")


def test_runs_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op11_recursive_splitting"](spark, SF).collect()}
    assert len(got) == len(documents)
    marked = 0
    for name, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = zlib.crc32(str(name).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            marked += 1
        found = plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
        row, top = got[name], min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (row.n_runs, row.start, row.length, row.period) == ((len(found), *top) if top else (0, None, None, None))
        assert row.exponent_milli == (top and 1000 * top[1] // top[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert marked > 5


# --- ranked lexical search ---------------------------------------------------------------------------------------


def plain_ranking(docs, items, k):
    """Every document scored for every item."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(name, c, sum(c.values())) for name, c in ((n, Counter(words(t))) for n, t in docs) if c]
    n, total, df = len(held), sum(x[2] for x in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for name, c, length in held:
            m = 75 + 25 * length * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c), name))
        out += [(item, rank, name, -s) for rank, (s, name) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(2048, 1_000_000, 64, 256, 512), (7, 1_000_000, 3, 2, 2), (2048, 30, 1, 1, 1)])
def test_search_against_brute_force(spark, monkeypatch, shape):
    for name, value in zip(("SHARD_DOCS", "SHARD_WORDS", "WAVE", "BLOCK_QUERIES", "SHARDS_A_DEAL"), shape, strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    draw = random.Random(4)
    letters = ["a", "B", "b", "cé", "x1", "日本", "zz"] + [f"w{i}" for i in range(30)]
    docs = [(draw.randrange(10**6), draw.choice([" ", "-", "\x00", "\n"]).join(draw.choices(letters, k=draw.choice([0, 1, 5, 40])))) for _ in range(150)]
    docs += [(i, "zz b b a") for i in range(60)]
    items = [(i, " ".join(draw.choices(letters, k=draw.choice([0, 1, 4, 12])))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "zz zz a")]
    # Batches of a few rows make several batches a task.
    frames = extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), extra(spark.createDataFrame(items, "item_id long, text string"))
    got = lexical_search.ranked(*frames, 20)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == plain_ranking(docs, items, 20)


def test_search_leaves_documents_out_unscored():
    """Bounds do their work: few of many documents are scored."""
    draw = np.random.default_rng(1)
    n = 2000
    held = np.array([n, 40, 25])
    places = np.concatenate([np.arange(n), np.sort(draw.choice(n, 40, replace=False)), np.sort(draw.choice(n, 25, replace=False))])
    shard = lexical_search.Shard(np.arange(n), np.full(n, 100), np.array([5, 3000, 4000]), held, places, draw.integers(1, 4, len(places)))
    best = []
    assert shard.search(np.arange(3), np.ones(3, np.int64), best, 20) < 200 and len(best) == 20


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = extra(spark.createDataFrame([(1, "lorem two"), (1, "lorem two"), (1, "three"), (None, "MAIL"), (3, None), (4, "")], "item_id long, text string"))
    got = rows_of(lexical_search.ranked(odd_docs, items, 3), "item_id", "rank", "doc_id", "score")
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect() if r.doc_id is not None]
    # A repeated query is one query; two texts of one id are two; repeated documents have ranks of their own.
    assert got == [(None, *r[1:]) for r in plain_ranking(docs, [(0, "mail")], 3)] + sorted(plain_ranking(docs, [(1, "lorem two"), (1, "three")], 3))
    assert len(got) == 7
    assert lexical_search.ranked(no_docs, items, 3).count() == 0
    assert lexical_search.ranked(odd_docs, items.limit(0), 3).count() == 0


def test_search_query(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op12_range_maximum_search"](spark, SF)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == plain_ranking(documents, items, 20)


# --- main text of pages ------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def labeller():
    return html_blocks.trained()


def test_labeller_on_pages_that_it_has_not_seen(labeller):
    held_out = html_blocks.examples(4242, 300)
    got = labeller.probabilities([p for p, _ in held_out])
    right = np.concatenate([(p >= 0.5) == np.array(labels) for p, (_, labels) in zip(got, held_out, strict=True)])
    assert right.mean() > 0.99


def test_gradients_against_differences():
    model = html_blocks.Labeller(1)
    made = sorted(html_blocks.examples(3, 4), key=lambda e: -len(e[1]))
    paths = [[n for n in page.names[node] or [1]] for page, _ in made for node in page.nodes]
    words = [w for page, _ in made for w in html_blocks.word_lists(page)]
    extra_columns = np.concatenate([html_blocks.measures(page) for page, _ in made])
    labels = np.array([x for _, marks in made for x in marks], np.float32)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    ask = lambda: model.gradients(paths, words, extra_columns, np.array([len(m) for _, m in made]), labels)
    _, grads = ask()
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, losses = model.w[name][at], []
        for change in (1e-2, -1e-2):
            model.w[name][at] = kept + change
            losses.append(ask()[0])
        model.w[name][at] = kept
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(grad[at]), rel=0.05, abs=1e-4), name


PAGE = """<!DOCTYPE html><body class="home"><header class="site-header"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies to improve your experience.</div>
<main><article><h1>A  new&nbsp;bridge</h1><p>It&#39;s &lt;open&gt;<b> since</b> May.<br>Caf&eacute; owners are glad.<p>Short.</p><!-- <p>no</p> -->
<div class="ad">Buy shoes now</div><ul><li>First point.</li><li>Second point.</li></ul><script>"<p>never</p>"</script></article></main>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="x">Ten tips</a></ul></aside><section class="comments"><h3>2 comments</h3>
<div class="comment"><p>I disagree with all of this, it is far too expensive.</p></div></section><form>Subscribe <button>Go</button></form><footer>&copy; 2020</footer>"""


def test_main_text_of_a_page(labeller):
    text = html_blocks.main_text([html_blocks.read_page(PAGE)], labeller)
    assert text == ["A new bridge\nIt's <open> since May. Café owners are glad.\nShort.\nFirst point.\nSecond point."]


def test_pages_are_read_in_linear_time(labeller):
    start = time.perf_counter()
    parts = ("<div>", "<b>", '<a x="', "<a x='\"", "<", "&", "<ul><li>", "<a " + "=" * 50, "<svg ", "<script>", "<!--", "</p", "<p class='a", "<table><td>")
    for part in parts:
        html_blocks.read_page(part * 60_000)
    html_blocks.read_page("<div>" * 30_000 + "<li>x" * 3000)
    assert time.perf_counter() - start < 30
    long = html_blocks.read_page("<article>" + "<p>a b" * 20_000)
    assert len(long.texts) == 20_000 and len(labeller.probabilities([long])[0]) == 20_000


def test_odd_pages(spark, labeller):
    rows = [(None, None, PAGE), (1, "u", None), (1, "u", None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<!-- x"), (5, "u", " \n "), (6, "u", "<script>x")]
    frame = extra(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = rows_of(html_blocks.extract_main_text(frame, labeller), "page_id", "url", "text")
    assert got[0][2].startswith("A new bridge\n") and [r[2] for r in got[1:]] == [""] * 7
    assert html_blocks.extract_main_text(frame.limit(0), labeller).count() == 0


def test_pages_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op13_block_labeller"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    for name, source in pages.items():
        article = re.search(r"(?s)<article>(.*?)</article>", source)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[name].text == "\n".join(filter(None, blocks)) and got[name].n_chars == len(got[name].text)
