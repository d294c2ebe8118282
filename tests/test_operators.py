"""Operators on small tables, several of them against plain Python."""

import json
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from auditlake.operators import discover as D
from auditlake.operators import findings as N
from auditlake.operators import page_checks as K
from auditlake.operators import profiles as P
from auditlake.operators import rollup as R
from auditlake.operators import row_checks as RC
from auditlake.operators import rundiff as X
from auditlake.operators import scoring as G
from auditlake.operators import site_checks as S
from auditlake.operators import strict_checks as L
from auditlake.operators import windows as W
from auditlake.plans import audit as A
from auditlake import schemas
from auditlake.sources import tables as IO
from auditlake.streaming import events as E
from auditlake.streaming import fold as Z
from auditlake.streaming import ledger
from auditlake.streaming import tail as TAIL

PAGE = "<html><head><title>T</title></head><body><h1>Top</h1><p>Some text.</p></body></html>"


def pages(spark, rows):
    """Rows of (index, status, raw, rendered, fetch_error, rendered_error)."""
    full = [("r", "h", i, f"https://h/{i}", *rest) for i, *rest in rows]
    return spark.createDataFrame(full, schemas.PAGES)


def severities(df):
    return {r.check_id: r.severity for r in df.collect()}


def test_profiles_fail_apart(spark):
    rows = [(0, 200, PAGE, PAGE, None, None), (1, 404, PAGE, PAGE, None, None), (2, None, None, None, "no route", "[0101/120000.1:ERROR:x] y\n boom \nz")]
    got = {(r.page_index, r.profile): r for r in P.page_profiles(P.with_profiles(pages(spark, rows))).collect()}
    assert len(got) == 9
    assert got[0, "rawHttp"].ok and got[0, "snippet"].ok and got[0, "rawHttp"].chars == got[0, "headless"].chars > 0
    assert got[1, "rawHttp"].reason == "HTTP 404" and got[1, "rawHttp"].chars > 0
    assert got[1, "snippet"].chars == 0 and got[1, "snippet"].reason == "HTTP 404"
    assert got[2, "rawHttp"].reason == "no route" and got[2, "headless"].reason == "boom"


@pytest.mark.parametrize(
    "raw, rendered, want", [(85, 100, "pass"), (84, 100, "warn"), (50, 100, "warn"), (49, 100, "fail"), (5, 0, "pass"), (0, 100, "fail")]
)
def test_rendering_thresholds(spark, raw, rendered, want):
    df = spark.createDataFrame([(True, True, raw, rendered)], "raw_ok BOOLEAN, headless_ok BOOLEAN, raw_chars BIGINT, headless_chars BIGINT")
    assert df.select(K.rendering_strategy()["severity"]).first()[0] == want


@pytest.mark.parametrize("value, live, strict", [(200_000, "pass", "pass"), (200_001, "pass", "warn"), (500_001, "pass", "fail"), (1_000_000, "pass", "fail"),
                                                (1_000_001, "warn", "fail"), (2_000_000, "warn", "fail"), (2_000_001, "fail", "fail")])
def test_size_thresholds(spark, value, live, strict):
    df = spark.createDataFrame([(True, value)], "raw_ok BOOLEAN, html_bytes BIGINT")
    assert df.select(K.page_size_html()["severity"], K.page_size_html("strict")["severity"]).first()[:] == (live, strict)


def test_structure_checks(spark):
    def check(body, head=""):
        html = f"<html><head>{head}</head><body>{body}</body></html>"
        return severities(K.page_checks(K.page_features(P.with_profiles(pages(spark, [(0, 200, html, html, None, None)])))))

    clean = check("<h1>A</h1><h2>B</h2><img src=a alt=x>", "<title>T</title><meta name=description content=d><meta property=og:a content=1><meta property=og:b content=2>")
    assert {clean[c] for c in clean} == {"pass"} and len(clean) == 11
    bad = check("<p>intro</p><h2>B</h2><h4>C</h4>" + '<img src=a alt=" ">' + "<pre><code>a</code></pre>" + '<pre><code class="language-json">{,}</code></pre>')
    assert bad["heading-hierarchy"] == "warn" and bad["image-alt-coverage"] == "fail" and bad["metadata-completeness"] == "fail"
    assert bad["markdown-code-fence-validity"] == "warn" and bad["json-code-block-validity"] == "warn" and bad["content-start-position"] == "warn"
    eighty = check("<h1>A</h1>" + "<img src=a alt=x>" * 4 + "<img src=a>")
    assert eighty["image-alt-coverage"] == "warn"


def test_links_of_a_page_against_statuses(spark):
    html = "<body>" + "".join(f'<a href="/p{i}">x</a>' for i in range(30)) + '<a href="/0">self</a><a href="https://else/x">o</a></body>'
    features = K.page_features(P.with_profiles(pages(spark, [(0, 200, html, html, None, None)])))
    assert features.select(F.size("links")).first()[0] == 30
    statuses = spark.createDataFrame([(f"https://h/p{i}", 404 if i < 2 else 200) for i in range(29)], "url STRING, status INT")
    sampled = K.link_integrity(features, statuses).first()
    # Positions 0 4 8 12 16 20 24 29: p0 is broken, p29 has no answer.
    assert (sampled.severity, sampled.conclusion) == ("warn", "2/8 looked-up links broken")
    every = K.link_integrity(features, statuses, sample=None).first()
    assert every.conclusion == "3/30 looked-up links broken"


def check_rows(spark, rows):
    full = [("r", site, i, f"u{i}", 0, check, "page-size", sev, "T", "m", "f", f"c{i}", {}) for site, i, check, sev in rows]
    return spark.createDataFrame(full, schemas.CHECK_RESULTS)


def test_rollup_keeps_three_pages_of_a_hot_site(spark):
    rows = [("hot", i, "a", "fail" if i % 2 else "pass") for i in range(400)] + [("s", 0, "a", "info"), ("s", 1, "a", "pass"), ("t", 5, "b", "info")]
    got = {(r.site_id, r.check_id): r for r in R.rollup_checks(check_rows(spark, rows)).collect()}
    hot = got["hot", "a"]
    assert (hot.severity, hot.n_fail, hot.n_pass, hot.affected) == ("fail", 200, 200, 200)
    assert hot.first_pages == ["u1", "u3", "u5"] and hot.message.endswith("u1, u3, u5 and 197 more")
    # A pass outweighs what could not be judged, but the example is the page that could not.
    assert got["s", "a"].severity == "pass" and got["s", "a"].rep_conclusion == "c0"
    assert got["t", "b"].severity == "info"


def test_findings_merge_rank_and_attribution(spark):
    def row(seq, fid, sev, src, occ):
        return ("r", "h", seq, fid, f"t{seq}", sev, src, "e", None, "", f"p{seq}", occ, "c")

    rows = [row(3, "check:sitemap", "warn", "check", 2), row(1, "check:sitemap", "fail", "check", 1), row(2, "x:zzz", "fail", "diff", 3), row(4, "check:robots-txt", "fail", "check", 3), row(5, "check:link-headers", "warn", "check", 9)]
    merged = N.merge_findings(spark.createDataFrame(rows, schemas.FINDINGS).drop("affected_profiles"))
    ranked = N.rank_findings(merged).orderBy("rank").collect()
    assert [(r.finding_id, r.occurrences) for r in ranked] == [("check:robots-txt", 3), ("check:sitemap", 3), ("x:zzz", 3), ("check:link-headers", 9)]
    assert ranked[1].title == "t1" and ranked[1].affected_profiles == ["snippet", "rawHttp"] and ranked[2].affected_profiles is None
    assert N.findings_per_profile(merged).first()[2:] == (3 - 1, 0, 2, 1)
    assert [r.rank for r in ranked] == [1, 2, 3, 4]


def test_grades_and_bands(spark):
    df = spark.createDataFrame([(100, 0, 0), (97, 0, 2), (96, 0, 3), (79, 2, 3), (69, 3, 0), (60, 1, 5)], "s INT, f INT, w INT")
    rows = df.select(G.grade(F.col("s")), G.band(F.col("f"), F.col("w"))["label"], G.band(F.col("f"), F.col("w"))["tone"]).collect()
    assert [r[0] for r in rows] == ["A+", "A", "B", "C", "D", "F"]
    assert [r[2] for r in rows] == ["ok", "warn", "warn", "warn", "alert", "alert"]


def plain_bfs(edges, seed, cap, max_depth):
    queue, seen, order = deque([(seed, 0)]), set(), []
    while queue and len(order) < cap:
        node, depth = queue.popleft()
        if node in seen:
            continue
        seen.add(node)
        order.append((node, depth))
        if depth < max_depth:
            queue.extend((t, depth + 1) for t in edges.get(node, []) if t not in seen)
    return order


@pytest.mark.parametrize("cap, depth", [(None, 6), (12, 6), (None, 2)])
def test_bfs_matches_a_queue_on_random_graphs(spark, cap, depth):
    rng = random.Random(cap or depth)
    links, want, seeds = [], {}, []
    for s in range(4):
        host, n = f"s{s}", 40
        seeds.append(("r", host, f"https://{host}/"))
        url = [f"https://{host}/"] + [f"https://{host}/p{i}" for i in range(1, n)]
        edges = {}
        for i in range(n):
            targets = [url[rng.randrange(n)] for _ in range(rng.randrange(5))]
            edges[url[i]] = targets
            links += [("r", host, url[i], k, t, t) for k, t in enumerate(targets)]
            links.append(("r", host, url[i], 9, "x", "https://elsewhere/x"))
        want[host] = plain_bfs(edges, url[0], cap or 10**9, depth)
    got = D.bfs(spark.createDataFrame(links, schemas.LINKS), spark.createDataFrame(seeds, "run_id STRING, site_id STRING, seed_url STRING"), cap, depth)
    rows = {}
    for r in got.orderBy("pos").collect():
        rows.setdefault(r.site_id, []).append((r.url, r.depth))
        assert r.pos == len(rows[r.site_id]) - 1
    assert rows == want


def test_sitemap_shapes(spark):
    flat = "<urlset><url><loc> https://h/a&amp;b </loc><image:image><image:loc>https://i/x</image:loc></image:image></url><url><loc></loc></url><url><loc><![CDATA[https://h/c]]></loc></url></urlset>"
    index = "<sitemapindex><sitemap><loc>https://h/s1.xml</loc></sitemap></sitemapindex>"
    bodies = spark.createDataFrame([("r", "h", "flat", flat), ("r", "h", "index", index), ("r", "h", "bad", "<<not xml")], "run_id STRING, site_id STRING, sitemap_url STRING, body STRING")
    got = [(r.sitemap_url, r.is_index, r.pos, r["loc"]) for r in D.sitemap_locs(bodies).orderBy("sitemap_url", "pos").collect()]
    assert got == [("flat", False, 0, "https://h/a&b"), ("flat", False, 1, "https://h/c"), ("index", True, 0, "https://h/s1.xml")]


def test_run_diff_of_a_run_with_itself_is_empty(spark):
    runs = spark.createDataFrame([("a", "h", 5, None, 1), ("b", "h", 1, 9, 2)], "run_id STRING, site_id STRING, started_at BIGINT, finished_at BIGINT, seq INT")
    pairs = X.consecutive_runs(runs)
    assert pairs.first()[:3] == ("h", "a", "b")
    found = spark.createDataFrame([(r, "h", f, "warn", 1) for r in "ab" for f in "xy"], "run_id STRING, site_id STRING, finding_id STRING, severity STRING, occurrences BIGINT")
    assert {r.change for r in X.diff_findings(found, pairs).collect()} == {"same"}
    more = found.unionByName(spark.createDataFrame([("b", "h", "z", "fail", 1)], found.schema)).where("NOT (run_id = 'b' AND finding_id = 'x')")
    assert {(r.finding_id, r.change) for r in X.diff_findings(more, pairs).collect()} == {("x", "resolved"), ("y", "same"), ("z", "new")}


def plain_open_fences(md):
    stack = []
    for i, line in enumerate(md.split("\n"), 1):
        body = line.lstrip()
        run = len(body) - len(body.lstrip(body[0])) if body[:3] in ("```", "~~~") else 0
        if len(line) - len(body) > 3 or run < 3:
            continue
        if stack and stack[-1][1] == body[0] and run >= stack[-1][2]:
            stack.pop()
        else:
            stack.append((i, body[0], run))
    return [s[0] for s in stack]


def test_fence_stack_matches_plain_python(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choices(["```", "````", "~~~", "text", "   ```js", "    ```", "~~~~"], k=rng.randrange(1, 12))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, md STRING")
    for r in df.select("md", L.open_fences(F.col("md")).alias("got")).collect():
        assert r.got == plain_open_fences(r.md), r.md


def test_site_without_responses_is_judged(spark):
    sites = spark.createDataFrame([("r", "h", "https://h/")], "run_id STRING, site_id STRING, seed_url STRING")
    got = severities(S.site_checks(sites, spark.createDataFrame([], schemas.RESPONSES)))
    assert got["llms-txt-exists"] == "fail" and got["sitemap"] == "fail" and got["robots-txt"] == "warn" and got["cache-headers"] == "info"
    assert "llms-txt-size" not in got and "content-signals" not in got and len(got) == 17


def test_trails_end_at_the_first_hit(spark):
    sites = spark.createDataFrame([("r", "h", "https://h/"), ("r", "md", "https://md/a.md")], "run_id STRING, site_id STRING, seed_url STRING")
    hop = {"from_url": "https://h/", "to_url": "https://h/b", "status": 302, "same_host": False}

    def answer(site, seq, url, status, body="", headers=None, chain=None, accept="text/html"):
        return ("r", site, seq, "GET", f"https://{site}{url}", accept, status, headers, body, len(body), f"https://{site}{url}", chain, None)

    given = [
        answer("h", 0, "/", 200, "<p>", {"content-type": ["text/html"], "etag": ["x"]}, [hop]),
        answer("h", 1, "/llms.txt", 200, "# A"), answer("h", 1, "/llms.txt", 200, "# A"),  # repeated row
        answer("h", 2, "/llms.txt", 404), answer("h", 3, "/docs/llms.txt", 200, "# B"),
        answer("h", 4, "/sitemap.xml", 200), answer("h", 5, "/sitemap_index.xml", 200, "", {"content-type": ["text/xml"]}),
        answer("h", 6, "/some/page", 200, "text"), answer("h", 7, "/robots.txt", None),
    ]
    responses = spark.createDataFrame(given, schemas.RESPONSES)
    results = S.probe_results(sites, responses).cache()
    checks = S.site_checks(sites, responses, results=results)
    trail = {}
    for r in S.check_trails(checks, results).orderBy("step").collect():
        trail.setdefault((r.site_id, r.check_id), []).append((r.step, r.method, r.url, r.status, r.note))
    assert trail["h", "llms-txt-exists"] == trail["h", "llms-txt-valid"] == [(0, "GET", "https://h/llms.txt", 200, "")]
    assert [t[3] for t in trail["h", "sitemap"]] == [200, 200]
    assert [t[3] for t in trail["md", "sitemap"]] == [0, 0, 0, 0] and trail["md", "sitemap"][0][4] == "no response"
    assert trail["h", "redirect-behavior"] == [
        (0, "GET", "https://h/", 200, "final URL: https://h/"), (1, "GET", "https://h/", 302, "to https://h/b (cross-host)")
    ]
    assert [t[1] for t in trail["md", "well-known-mcp-card"]] == ["HEAD"] * 3
    assert ("md", "markdown-url-support") not in trail and ("md", "llms-txt-size") not in trail and ("h", "content-signals") not in trail
    findings = N.finding_trails(N.site_findings(checks), S.check_trails(checks, results))
    assert {r.finding_id for r in findings.where("site_id = 'md'").collect()} >= {"check:llms-txt-exists", "check:sitemap", "check:robots-txt"}


def test_bodies_are_read_for_probes_only(spark, tmp_path):
    sites = spark.createDataFrame([("r", "h", "https://h/")], "run_id STRING, site_id STRING, seed_url STRING")
    spark.createDataFrame([], schemas.RESPONSES).write.parquet(str(tmp_path / "responses"))
    stored = spark.read.parquet(str(tmp_path / "responses"))
    plan = S.answered_probes(sites, stored)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "headers" not in plan
    some = S.site_checks(sites, stored, ["robots-txt", "content-signals"])
    assert severities(some) == {"robots-txt": "warn"}


def test_audit_end_to_end(spark):
    rows = [(i, 200 if i % 3 else 500, PAGE, PAGE, None, None) for i in range(6)]
    sites = spark.createDataFrame([("r", "h", "https://h/")], "run_id STRING, site_id STRING, seed_url STRING")
    statuses = spark.createDataFrame([], "url STRING, status INT")
    own = RC.RowCheck("first-page", "content-quality", "First page", ("page_index",), lambda page: ("warn", str(1 // page["page_index"])))
    out = A.audit(pages(spark, rows), sites, spark.createDataFrame([], schemas.RESPONSES), statuses, row_checks=(own,))
    assert out["check_errors"].first().page_index == 0 and out["rollup"].where("check_id = 'first-page'").first().n_warn == 5
    stats, score = out["site_stats"].first(), out["scores"].first()
    assert stats.pages_scanned == 6 and stats.fix_backlog == out["findings"].count()
    assert score.score == max(0, 100 - 7 * score.n_fail - 3 * score.n_warn)
    assert out["trails"].where("check_id = 'sitemap'").count() == 4
    assert "# Audit report: h" in out["reports"].first().report


EVENTS = "run_id STRING, seq BIGINT, type STRING, url STRING, page_index BIGINT, profile STRING, chars BIGINT, tokens_est BIGINT, js_gated DOUBLE, source STRING, capped BOOLEAN, message STRING, pages ARRAY<STRING>"


def raw_events(rows):
    """Rows of (run, seq, type, url, profile, chars, pages)."""
    return [(run, seq, kind, url, None, profile, chars, chars, 0.5 if kind == "page:done" else None, None, None, None, listed) for run, seq, kind, url, profile, chars, listed in rows]


LOG = [
    ("a", 0, "page:done", "u1", None, None, None),
    ("a", 1, "discover", None, None, None, ["u1", "u2"]),
    ("a", 2, "profile:done", "u1", "rawHttp", 10, None),
    ("a", 3, "profile:done", "u1", "rawHttp", 20, None),
    ("a", 4, "profile:done", "nowhere", "rawHttp", 5, None),
    ("a", 5, "page:done", "u1", None, None, None),
    ("a", 6, "run:done", None, None, None, None),
    ("a", 7, "profile:done", "u2", "snippet", 99, None),
    ("b", 0, "discover", None, None, None, ["u1"]),
    ("b", 1, "profile:done", "u1", "snippet", 7, None),
    ("b", 2, "discover", None, None, None, ["u2", "u3"]),
]


def test_fold(spark):
    log = E.normalize_log(spark.createDataFrame(raw_events(LOG), EVENTS))
    got = {(r.run_id, r.url): (r.page_index, r.chars_rawHttp, r.chars_snippet, r.done) for r in Z.fold_pages(log).collect()}
    assert got == {("a", "u1"): (0, 20, None, True), ("a", "u2"): (1, None, None, False), ("b", "u2"): (0, None, None, False), ("b", "u3"): (1, None, None, False)}
    state = {r.run_id: (r.status, r.total_pages, r.pages_done) for r in Z.run_state(Z.fold_pages(log), Z.run_status(log)).collect()}
    assert state == {"a": ("done", 2, 1), "b": ("running", 2, 0)}


def write_files(folder, parts, first=0):
    """One JSON file for each part of a log, read in this order."""
    folder.mkdir(exist_ok=True)
    names = [f.split()[0] for f in EVENTS.split(", ")]
    for n, part in enumerate(parts, first):
        text = "\n".join(json.dumps({k: v for k, v in zip(names, r) if v is not None}) for r in raw_events(part))
        (folder / f"{n}.json").write_text(text)
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def live_log(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.mark.parametrize("full_every", [32, 2])
def test_stream_over_several_batches_equals_the_batch_fold(spark, tmp_path, monkeypatch, full_every):
    """The log cut into files, one file delivered twice, a second discovery in a later trigger, a restart on the way."""
    monkeypatch.setattr(ledger, "FULL_EVERY", full_every)
    log = [*LOG, ("c", 0, "discover", None, None, None, ["u1", "u2"]), ("c", 1, "profile:done", "u1", "rawHttp", 3, None), ("c", 2, "page:done", "u1", None, None, None)]
    later = [("c", 3, "discover", None, None, None, ["u2", "u1"]), ("c", 4, "profile:done", "u2", "snippet", 4, None), ("c", 5, "page:done", "u2", None, None, None)]
    state = str(tmp_path / "state")
    write_files(tmp_path / "in", [log[:4], log[2:4], log[4:7], log[7:]])
    run = lambda: Z.fold_stream(E.normalize_log(live_log(spark, tmp_path / "in")), state).trigger(availableNow=True).start().awaitTermination()
    run()
    write_files(tmp_path / "in", [later[:1], later[1:]], first=4)
    run()
    live = Z.latest_pages(spark, state)
    batch = Z.fold_pages(E.normalize_log(spark.createDataFrame(raw_events([*log, *later]), EVENTS))).select(*live.columns)
    assert sorted(map(str, live.collect())) == sorted(map(str, batch.collect()))
    assert {(r.url, r.page_index, r.chars_rawHttp, r.done) for r in live.where("run_id = 'c'").collect()} == {("u2", 0, None, True), ("u1", 1, None, False)}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    log = E.normalize_log(spark.createDataFrame(raw_events(LOG), EVENTS))
    first, last = log.where("seq < 3"), log.where("seq >= 3")
    for n, part in [(0, first), (1, last), (1, last)]:
        Z.fold_batch(part, n, str(tmp_path / "state"))
        TAIL.deliver(part.where("type <> 'discover:page'"), n, str(tmp_path / "tail"))
    live = Z.latest_pages(spark, str(tmp_path / "state"))
    assert sorted(map(str, live.collect())) == sorted(map(str, Z.fold_pages(log).select(*live.columns).collect()))
    assert TAIL.delivered(spark, str(tmp_path / "tail"), log).count() == 10


def test_replay_then_tail(spark, tmp_path):
    """A late subscriber gets each event once and in order, over several triggers and a restart; an ended run is closed."""
    stored = spark.createDataFrame(raw_events([*LOG[:4], LOG[8]]), EVENTS)
    write_files(tmp_path / "in", [LOG[2:5], [*LOG[3:6], *LOG[8:10]]])
    run = lambda: TAIL.subscribe(stored, live_log(spark, tmp_path / "in"), str(tmp_path / "sub")).trigger(availableNow=True).start().awaitTermination()
    run()
    write_files(tmp_path / "in", [LOG[5:8], LOG[9:]], first=2)
    run()
    run()
    got = TAIL.delivered(spark, str(tmp_path / "sub"), stored).orderBy("run_id", "place").collect()
    assert [(r.run_id, r.seq, r.place) for r in got] == [("a", i, i) for i in range(7)] + [("b", i, i) for i in range(3)]
    # Later batches hold later events.
    assert [r.batch for r in got] == sorted(r.batch for r in got if r.run_id == "a") + sorted(r.batch for r in got if r.run_id == "b")
    assert len({r.batch for r in got}) == 5


def test_fold_of_a_synthesised_log_gives_the_stored_state(spark):
    rows = [("a", f"u{i}", i, 10 * i, 20, 5, i, 5, 1, 0.5) for i in range(40)]
    stored = spark.createDataFrame(rows, "run_id STRING, url STRING, page_index BIGINT, chars_rawHttp BIGINT, chars_headless BIGINT, chars_snippet BIGINT, tokens_rawHttp BIGINT, tokens_headless BIGINT, tokens_snippet BIGINT, js_gated DOUBLE")
    runs = spark.createDataFrame([("a", "stopped", None, None, 40, "why")], "run_id STRING, status STRING, source STRING, capped BOOLEAN, n_pages BIGINT, message STRING")
    log = E.synthesize(runs, stored)
    assert log.count() == 2 + 40 * 6
    folded = Z.fold_pages(log).select(*stored.columns, "done")
    assert sorted(map(str, folded.drop("done").collect())) == sorted(map(str, stored.collect()))
    assert Z.run_state(Z.fold_pages(log), Z.run_status(log)).first()[:] == ("a", "stopped", "why", 40, 40)


def test_run_documents_round_trip(spark, tmp_path):
    doc = {"id": "run_1", "status": "done", "result": {"startedAt": 1, "pages": [{"url": "u", "profiles": {"rawHttp": {"ok": True, "chars": 3, "markdown": "abc", "rawArtifact": "<p>"}}}, {"url": "v", "profiles": {"rawHttp": {"ok": False, "markdown": "d"}}}], "fixes": [{"id": "check:x", "severity": "warn"}]}}
    going = {"id": "run_2", "status": "running", "result": None}
    (tmp_path / "docs.json").write_text(json.dumps(doc) + "\n" + json.dumps(going) + "\nnot json\n")
    docs = IO.read_run_documents(spark, str(tmp_path / "docs.json"))
    assert IO.run_findings_of(docs).first().occurrences == 1
    pruned = {r.page_index: r.markdown for r in IO.prune(IO.run_profiles_of(docs)).collect()}
    assert pruned == {0: "abc", 1: None}
    IO.write_runs(IO.runs_of(docs), {"pages": IO.run_pages_of(docs)}, str(tmp_path / "store"))
    assert [r.run_id for r in IO.read_run_table(spark, str(tmp_path / "store"), "runs").collect()] == ["run_1"]
    assert IO.read_run_table(spark, str(tmp_path / "store"), "pages", run_id="run_1").count() == 2


def test_run_store_adds_and_replaces(spark, tmp_path):
    path = str(tmp_path / "store")

    def run(run_id, status, n):
        runs = spark.createDataFrame([(run_id, status)], "run_id string, status string")
        return runs, {"pages": spark.createDataFrame([(run_id, i) for i in range(n)], "run_id string, page_index int")}

    for run_id, status, n in (("a", "done", 2), ("b", "done", 3), ("c", "running", 4), ("a", "stopped", 1)):
        IO.write_runs(*run(run_id, status, n), path, buckets=2)
    assert sorted((r.run_id, r.status) for r in IO.read_run_table(spark, path, "runs").collect()) == [("a", "stopped"), ("b", "done")]
    pages = IO.read_run_table(spark, path, "pages").groupBy("run_id").count().collect()
    assert sorted((r.run_id, r["count"]) for r in pages) == [("a", 1), ("b", 3)]
    assert IO.read_run_table(spark, path, "pages", run_id="b", buckets=2).count() == 3


def test_places_of_any_size_keep_their_order(spark):
    """Link places beyond 2^22 and 2^31 belong to their own page."""
    site = [("r", "s", "https://a.example.com/")]
    sites = spark.createDataFrame(site, "run_id string, site_id string, seed_url string")
    home, base = "https://a.example.com/", "https://a.example.com/p"
    links = [("r", "s", home, (1 << 33) + i, f"{base}{i}") for i in range(3)] + [("r", "s", f"{base}0", (1 << 23), f"{base}x"), ("r", "s", f"{base}1", 0, f"{base}y")]
    table = spark.createDataFrame([(*row, row[-1]) for row in links], "run_id string, site_id string, src_url string, link_idx long, href string, abs_url string")
    got = [r.url.removeprefix("https://a.example.com/") for r in D.bfs(table, sites).orderBy("pos").collect()]
    assert got == ["", "p0", "p1", "p2", "px", "py"]
    many = D.bfs(table, sites, max_pages=5000).orderBy("pos").collect()
    assert [r.url.removeprefix("https://a.example.com/") for r in many] == got


def test_first_k_beyond_the_group_limit(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "id")
    got = W.first_k(df, ["k"], [F.col("id")], 1500)
    assert got.count() == 3000 and got.agg(F.max("id")).first()[0] == 2999 and got.columns == ["k", "id", "rank"]


def test_a_check_that_raises_costs_its_own_row(spark):
    def thirds(page):
        return ("pass", f"{12 // page['raw_chars']}") if page["raw_chars"] != 3 else "three"

    checks = [
        RC.RowCheck("thirds", "content-quality", "Thirds", ("raw_chars",), thirds),
        RC.RowCheck("always", "content-quality", "Always", ("url", "raw_chars"), lambda page: ("warn", page["url"]), "Mend."),
        RC.RowCheck("never", "content-quality", "Never", (), lambda page: None),
    ]
    schema = "run_id STRING, site_id STRING, page_index BIGINT, url STRING, raw_chars BIGINT, nth INT"
    df = spark.createDataFrame([("r", "h", i, f"u{i}", n, 7) for i, n in enumerate([4, 0, None, 3, 12])], schema)
    judged = RC.judged_rows(df, checks)
    results, errors = RC.split_outcomes(judged, checks, 5)
    got = {(r.check_id, r.page_index): r for r in results.collect()}
    assert {k for k in got if k[0] == "thirds"} == {("thirds", 0), ("thirds", 4)} and got["thirds", 0].conclusion == "3"
    assert len(got) == 7 and got["always", 1].fix == "Mend." and got["thirds", 0].fix is None
    assert got["always", 1].message == "Always: u1" and got["always", 2].source_ord == 6 and got["always", 2].page_url == "u2"
    wrong = {(r.check_id, r.page_index): r.error.split(":")[0] for r in errors.collect()}
    assert wrong == {("thirds", 1): "ZeroDivisionError", ("thirds", 2): "TypeError", ("thirds", 3): "ValueError"}
    assert RC.judged_rows(df.limit(0), checks).count() == 0 and RC.judged_rows(df, []).count() == 0
    with pytest.raises(ValueError):
        RC.judged_rows(df, [checks[0], checks[0]])


def test_checks_in_columns_that_cannot_be_planned(spark):
    df = spark.createDataFrame([(True, "x")], "raw_ok BOOLEAN, raw_reason STRING")

    def broken():
        raise KeyError("no title")

    usable, errors = RC.usable_checks(df, {"good": K.http_status, "no-column": K.page_size_html, "broken": broken})
    assert set(usable) == {"good"} and set(errors) == {"no-column", "broken"} and errors["broken"].startswith("KeyError")


def test_registry_replaces_and_refuses(spark):
    registry = P.built_in_profiles()
    registry.register("snippet", lambda df: df.select("url"))
    assert registry.names() == ["rawHttp", "headless", "snippet"]
    assert registry.run("snippet", pages(spark, [(0, 200, PAGE, PAGE, None, None)])).columns == ["url"]
    with pytest.raises(KeyError):
        registry.run("other", None)


def test_staged_folders_are_dropped(spark):
    from auditlake.session import drop_staged, stage

    path = stage(spark.range(3), "dropped").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert drop_staged(spark) > 0
    assert not os.path.exists(path) and drop_staged(spark) == 0
