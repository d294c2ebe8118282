"""Private data, toxicity, URL rules and the pipeline."""

import hashlib
import random
import re
import time

import pytest
from helpers import CLASHES, LONG, SF, extra, rows_of

import corpus_pipeline
from auditlake.llm import private_data, toxicity, url_rules
from auditlake.llm.queries import QUERIES


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(t):
    """The base rules by plain regular expressions."""
    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_rules():
    draw = random.Random(3)
    for _ in range(20_000):
        letters = draw.choice(["a@b.-1", "0123456789.", "01 -+()59.", "+1 (2)", "@a.b c", "4111 -1", "٣1.2"])
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 45)))
        assert private_data.base_spans(text) == plain_spans(text), text
    assert private_data.base_spans("x 4111 1111 1111 1111") == [(2, 2, 21)]


def test_base_rules_are_linear():
    start = time.perf_counter()
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a.b@" * 50_000, "1 " * 100_000, "+(" * 100_000):
        private_data.base_spans(text)
    assert time.perf_counter() - start < 5


def test_occurrences_are_linear():
    start = time.perf_counter()
    n = 400_000
    for text in ("1 " + "a" * n, "1 " * n, "a1" * n, "a@b.cd," * (n // 7), "x " + "y" * n + " 1", "(1 " * (n // 3), "1 (((( " * (n // 7), "1 " + "(." * n, LONG + " 1"):
        private_data.occurrences(text, private_data.base_spans(text))
    assert time.perf_counter() - start < 20


def test_occurrences_take_whole_words_and_spaced_numbers():
    found = lambda text: [(text[s:e], p) for _, s, e, _, p in private_data.occurrences(text, private_data.base_spans(text))]
    assert found("call me at number 555 123 4567 now") == [("555 123 4567", "at number | 9 9 9")]
    assert found("card no 4111 1111 1111 1112, then 1 2 3") == [("4111 1111 1111 1112", "card no | 9 9 9 9")]
    far = "serial" + " " * 300 + "number" + " " * 300 + "ab12cd34"
    assert found(far) == [("ab12cd34", "serial number | a9a9")]
    long = ["k" * 300 + end + " id 12345678" for end in "xy"]
    assert found(long[0])[0][1] != found(long[1])[0][1]
    one, two = (private_data.occurrences("id " + "7" * 300 + end, [])[0][3] for end in "12")
    assert one != two


def test_discovery_of_a_spaced_number(spark):
    docs = [(i, f"card number 4111 1111 1111 1{i:03d} is") for i in range(1000)] + [(2000, "see room 4111 1111 1111 1112 here")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in private_data.find_private(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seeds = [i for i, t in docs[:1000] if plain_spans(t)]
    # One in ten passes the check of its digits; nine in ten of the pattern's instances are no seeds, which is not sure enough.
    assert 60 < len(seeds) < 140 and all(got[i] == plain_spans(t) for i, t in docs)
    some = [d for d in docs if d[0] in seeds] + [(3000, "card number 4111 1111 1111 1112 is"), docs[-1]]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in private_data.find_private(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got[3000] == [(2, 12, 31)] and got[2000] == []


def joined(spans):
    return ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_private_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op6_bootstrapped_private_data"](spark, SF).collect()}
    assert len(got) == len(documents)
    for name, text in documents:
        base = plain_spans(text)
        row = got[name]
        assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, *_ in base) for x in range(4)]
        assert set(filter(None, joined(base).split(","))) <= set(row.spans.split(","))


def test_patterns_discover_unseen_identifiers(spark):
    draw = random.Random(1)
    docs = [(i, f"please call me {draw.choice(['at', 'on'])} number +1 (555) 555-0{100 + i} today") for i in range(30)]
    docs += [(100, "call the number +1 (555) 555-019 x"), (101, "call me on number 555-0177 now"), (102, "the number 555-0178 of results is 123456")]
    docs += [(200 + i, f"my mail is u{i}@mail.example.com ok") for i in range(20)] + [(300, "my mail is u99@localhost ok"), (301, "room u99@localhost here")]
    df = extra(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in private_data.find_private(df).collect()}
    assert all(len(got[i]) == 1 for i in range(30))
    assert got[301] == [] and got[102] == []


def test_discovery_by_form_and_words(spark):
    docs = [(i, f"server address is 10.0.{i}.7 up") for i in range(40)] + [(100, "server address is 10.0.300.7 up"), (101, "version is 10.0.300.7 up")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in private_data.find_private(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100] == [(1, 18, 28)] and got[101] == []


def test_private_on_odd_rows(spark, odd_docs, no_docs):
    found = private_data.find_private(odd_docs)
    assert found.count() == odd_docs.count() and {len(r.spans) for r in found.filter("doc_id = 9").collect()} == {6}
    masked = private_data.mask_private(spark, odd_docs, SF)
    assert masked.columns == odd_docs.columns
    assert masked.filter("doc_id = 9").first().text == "mail me at <email> or <phone> " * 3
    assert rows_of(masked.filter("doc_id <> 9")) == rows_of(odd_docs.filter("doc_id <> 9"))
    assert private_data.find_private(no_docs).count() == 0 and private_data.mask_private(spark, no_docs, SF).count() == 0


def test_toxicity_query_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op7_compression_distance"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.toxic is not None and r.held_out]
    assert {r.held_out for r in rows} == {True, False} and sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)


def test_toxicity_learns_marked_words_and_ignores_the_rest():
    draw = random.Random(0)
    plain = [f"w{draw.randrange(3000)}" for _ in range(3000)]
    rows = []
    for i in range(1200):
        words = [draw.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for k in draw.sample(range(60), 3):
                words[k] = draw.choice(["blockheads", "nincompoop", "dunderhead"])
        rows.append((" ".join(words), int(i % 4 == 0)))
    scorer = toxicity.fit(rows)
    scores = [(scorer.score(t), y) for t, y in rows]
    assert sum((s >= 0.5) == bool(y) for s, y in scores) >= 0.98 * len(rows)
    assert 0 <= scorer.score("") == scorer.score(None) < 0.5 and 0 <= scorer.score("x" * 100_000) <= 1


def insulting(draw, insults, n):
    """Rows of random words, every third one toxic with three of the insults."""
    rows = []
    for i in range(n):
        words = [f"w{draw.randrange(3000)}" for _ in range(60)]
        if i % 3 == 0:
            for k in draw.sample(range(60), 3):
                words[k] = draw.choice(insults)
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_keeps_every_marking_word():
    """More marks than a dictionary holds, one of them longer than a dictionary."""
    draw = random.Random(1)
    insults = ["".join(draw.choice("bcdfghjklmnpqrstvxz") for _ in range(12)) for _ in range(99)] + ["q" * 30 + "".join(draw.choice("0123456789") for _ in range(900))]
    scorer = toxicity.fit(insulting(draw, insults, 6000))
    assert len(scorer.toxic) > 2 and len(scorer.toxic) == len(scorer.ordinary)
    assert all(scorer.distances(w)[0] >= 3 for w in insults)
    assert all(any(f" {w} ".encode() in book for book in scorer.toxic) for w in insults[:-1])
    fresh = [(scorer.score(t), y) for t, y in insulting(draw, insults, 600)]
    assert sum((s >= 0.5) == bool(y) for s, y in fresh) >= 0.97 * len(fresh)


def test_toxicity_works_words_out_together(monkeypatch):
    """The distances are those of one word after the other, in few calls, also when words are forgotten and met again."""
    draw = random.Random(4)
    marks = [["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(300)] for _ in range(2)]
    toxic, ordinary = ([b" the and of " + part for part in toxicity.dealt(words, 512)] for words in marks)
    assert len(toxic) > 2 and len(ordinary) > 2
    words = [draw.choice(marks[k % 2])[: draw.randint(1, 9)] + draw.choice(["", "é", "ing", draw.choice(marks[0])]) for k in range(900)] + ["x" * 70_000, "the", "a\x00b"]
    texts = [" ".join(draw.choice(words) for _ in range(80)) for _ in range(60)] + ["", None, " ".join(words)]
    calls = []
    make = toxicity._compressor

    def counting(book):
        class Counting:
            own = make(book)

            def __getattr__(self, name):
                calls.append(name)
                return getattr(self.own, name)

        return Counting()

    def distance(word):
        window = f" {word} ".encode() * 3

        def shortest(books):
            having = [k for k, book in enumerate(books) if k == 0 or any(window[i : i + 5] in book for i in range(len(window) // 3))]
            return min(len(make(books[k]).compress(window)) for k in having)

        return shortest(ordinary) - shortest(toxic)

    scorer = toxicity.Scorer(toxic, ordinary, [-1.0, 0.3, 0.2, 0.1, 0.1, 0.1, 0.1])
    by_one = [scorer.score(t) for t in texts]
    expected = {w: distance(w) for w in set(words)}
    assert len(set(expected.values())) > 3
    assert scorer.distances(texts[-1]).tolist() == [expected[w] for w in words]
    monkeypatch.setattr(toxicity, "_compressor", counting)
    together = toxicity.Scorer(toxic, ordinary, scorer.weights)
    assert together.scores(texts) == by_one and 0 < len(calls) < len(expected) / 4
    monkeypatch.setattr(toxicity, "KNOWN", 200)
    monkeypatch.setattr(toxicity, "TEXT_AT_ONCE", 2000)
    monkeypatch.setattr(toxicity, "AT_ONCE", 100)
    assert toxicity.Scorer(toxic, ordinary, scorer.weights).scores(texts) == by_one


def test_toxicity_counts_near_copies_once():
    """A third of the toxic rows are near copies of one text; its rare words push out no insult."""
    draw = random.Random(2)
    insults = ["blockheads", "nincompoop", "dunderhead", "numbskulls", "lamebrains", "halfwitted"]
    rows = insulting(draw, insults, 1500)
    base = [f"rare{draw.randrange(10**6)}" for _ in range(150)]
    for _ in range(250):
        words = list(base)
        for k in draw.sample(range(150), 5):
            words[k] = f"v{draw.randrange(10**6)}"
        rows.append((" ".join(words), 1))
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    assert sorted(toxicity.marking_words(toxic, ordinary)) == sorted(insults)
    scorer = toxicity.fit(rows)
    assert all(scorer.distances(w)[0] >= 3 for w in insults)
    fresh = [(scorer.score(t), y) for t, y in insulting(draw, insults, 600)]
    assert sum((s >= 0.5) == bool(y) for s, y in fresh) >= 0.98 * len(fresh)


def test_toxicity_on_odd_rows_and_without_labels(spark, odd_docs, no_docs):
    scorer = toxicity.fit([])
    assert scorer.score("anything") < 0.5
    scored = toxicity.score_documents(odd_docs, toxicity.fit([("a b c", 1), ("d e f", 0)] * 20))
    assert scored.count() == odd_docs.count() and scored.filter("score is null").isEmpty()
    assert toxicity.score_documents(no_docs, scorer).count() == 0
    kept = toxicity.reject_toxic(spark, odd_docs, SF)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def judged(url, rules, default="allow"):
    """Host, path, rule and verdict of one URL, rule by rule."""
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h), len(p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, default)


def test_url_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    want = sorted((p.page_id, *judged(p.url, url_rules.RULES)) for p in pages)
    assert sorted(map(tuple, QUERIES["op2_range_join_rules"](spark, SF).collect())) == want


@pytest.mark.parametrize("slices", [1, 7])
def test_urls_under_many_rules_and_odd_rows(spark, slices):
    draw = random.Random(slices)
    hosts = ["com", "a.com", "b.a.com", "A.COM", "ba.com", "net", "x.net", "", ".com", "com.", "é.com", "a..com", "a.com:80", "c\x01d.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y", "/e", "/é/", "/en/x?q=1", "/#en/", "?a://b/en/", "/en\n/x"]
    urls = [f"{draw.choice(['http', 'HTTPS', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "http:/x", "://"] + ["http://b.a.com/en/x"] * 300
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in {(draw.choice(hosts[:9]).lower(), draw.choice(paths[1:8])) for _ in range(40)} if h]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        pages = extra(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = sorted(map(tuple, url_rules.filter_urls(pages, table).collect()))
        assert got == [(i, *judged(u, rules)) for i, u in enumerate(urls)]
        assert {r.verdict for r in url_rules.filter_urls(pages, table.limit(0), "block").collect()} == {"block"}
        assert url_rules.filter_urls(pages.limit(0), table).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_stages_and_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    scores = {r.doc_id: r.score for r in toxicity.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.fitted(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)).collect()}
    assert {r.doc_id for r in kept["toxicity"]} == {i for i, s in scores.items() if s < 0.5}
    from test_dups import expected_groups, expected_repeats

    left = [(r.doc_id, r.text) for r in kept["toxicity"]]
    assert {r.doc_id for r in kept["near_duplicates"]} == {r[0] for r in expected_groups(left, 5) if r[3]}
    removed = {r[0]: r[1] - r[2] for r in expected_repeats([(r.doc_id, r.text) for r in kept["near_duplicates"]], 50)}
    assert all(len((r.text or "").encode()) in range(removed[r.doc_id] - 6, removed[r.doc_id] + 1) and r.n_chars == len(r.text) for r in kept["repeated_passages"])
    for r in kept["personal_data"]:
        assert not [s for s in plain_spans(r.text) if s[0] == 0], before[r.doc_id]
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["personal_data"]}


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, function in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stage(function(spark, docs, SF), name)
            assert set(CLASHES) < set(docs.columns)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert LONG
