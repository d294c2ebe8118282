"""Site-level checks: a site's probe responses joined with the probes, first match wins.

Bodies are read where they are stored: ``response_facts`` turns every response into narrow facts
before anything is shuffled, so the join and the grouping per site move no page text. A site has a
few dozen probes at most, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.dims import AI_CRAWLERS, AUDIT_HEADERS, PROBE_PATHS
from auditlake.functions import html as H
from auditlake.functions import urls as U
from auditlake.functions.text import WS, is_valid_json, js_trim, kb
from auditlake.operators.page_checks import check_row, explode_checks, graded, text

SITE = ["run_id", "site_id"]
HEAD_FAMILIES = ["api-catalog", "mcp-card", "agent-skills"]


def header_of(name: str) -> Column:
    """First value of a response header, NULL if missing or empty."""
    return F.nullif(F.get(F.col("headers")[name], F.lit(0)), F.lit(""))


def kept_headers(*names: str) -> Column:
    """First values of those response headers that an audit entry keeps."""
    return F.map_filter(
        F.transform_values("headers", lambda k, v: F.get(v, F.lit(0))),
        lambda k, v: k.isin(*names) & (F.coalesce(v, F.lit("")) != ""),
    )


def to_audit(responses: DataFrame) -> DataFrame:
    """Responses as audit entries: six headers, first value each, status 0 on error."""
    entry = F.struct(
        "method",
        "url",
        F.coalesce("status", F.lit(0)).alias("status"),
        kept_headers(*AUDIT_HEADERS).alias("headers"),
        F.coalesce(F.col("error"), F.lit("")).alias("note"),
    )
    return responses.select(*SITE, "seq", entry.alias("audit"))


def audit_trail(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered audit entries per key, as one list.

    Meant for a table that holds probes only, a few dozen per site; ``check_trails`` gives the
    requests behind each check as rows, from responses of any kind and number.
    """
    entries = F.array_sort(
        F.collect_list(F.struct("seq", "audit")),
        lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0),
    )
    return to_audit(responses).groupBy(*keys).agg(F.transform(entries, lambda e: e["audit"]).alias("audit"))


def probe_targets(sites: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Probes of every site, or those of some families: ``(family, ord, url, accept)``; ``sites`` has ``seed_url``.

    The candidates are an array literal that is exploded per site, so nothing is joined.
    """
    seed = F.col("seed_url")
    origin = U.origin_of(seed)
    probes = [("home", 0, seed, "text/html"), ("home-md", 0, seed, "text/markdown"), ("md-twin", 0, U.md_variant(seed), "text/html")]
    for family, paths in PROBE_PATHS.items():
        probes += [(family, i, F.concat(origin, F.lit(path)), "text/html") for i, path in enumerate(paths)]
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(i).alias("ord"), u.alias("url"), F.lit(a).alias("accept"))
            for f, i, u, a in probes
            if families is None or f in families
        ]
    )
    return sites.select(*SITE, "seed_url", F.explode(rows).alias("p")).select(*SITE, "seed_url", "p.*")


def robots_directives(bodies: DataFrame) -> DataFrame:
    """robots.txt bodies as rows ``(line_no, field, value)``; ``bodies`` has keys and ``body``."""
    lines = bodies.select(*SITE, F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    pattern = r"^\s*([A-Za-z][A-Za-z-]*)\s*:\s*([^#]*)"
    return lines.where(F.col("line").rlike(pattern)).select(
        *SITE,
        "line_no",
        F.lower(F.regexp_extract("line", pattern, 1)).alias("field"),
        js_trim(F.regexp_extract("line", pattern, 2)).alias("value"),
    )


LLMS_LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def llms_links(bodies: DataFrame) -> DataFrame:
    """Markdown links of llms.txt bodies in order, with flags of the file's shape."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(LLMS_LINK), F.lit(1)).alias("text"),
        F.regexp_extract_all("body", F.lit(LLMS_LINK), F.lit(2)).alias("href"),
    )
    shape = llms_shape(F.col("body"))
    return bodies.select(*SITE, "url", shape.alias("s"), F.posexplode(pairs).alias("pos", "l")).select(
        *SITE, "url", "pos", "l.text", "l.href", "s.has_h1", "s.has_quote"
    )


def llms_shape(body: Column) -> Column:
    marked = F.concat(F.lit("\n"), body)
    return F.struct(
        marked.rlike(rf"\n#{WS}").alias("has_h1"),
        marked.rlike(rf"\n>{WS}").alias("has_quote"),
        H.count_matches(body, LLMS_LINK).alias("links"),
    )


def named_crawlers(body: Column) -> Column:
    """AI crawlers that robots.txt has a User-agent line for, in their fixed order."""
    lines = F.concat(F.lit("\n"), body)
    hits = [
        F.when(lines.rlike(rf"(?i)\n{WS}*User-agent{WS}*:{WS}*{agent}\b"), F.lit(agent)) for agent in AI_CRAWLERS
    ]
    return F.array_compact(F.array(*hits))


def json_text(body: Column, field: str) -> Column:
    """Value of a top-level string field of a JSON document, else NULL."""
    value = F.when(is_valid_json(body), F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant"))
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def response_facts(responses: DataFrame, *keep: str) -> DataFrame:
    """What the site checks read of a response, after the columns ``keep``; its body stays behind.

    Reading a body only under its own kind of path keeps the work off other probes.
    """
    path = U.raw_path(F.col("url"))
    body = F.coalesce(F.col("body"), F.lit(""))
    trimmed = F.lower(js_trim(body))
    ok = F.col("status") == 200

    def on(paths: str, value: Column) -> Column:
        return F.when(ok & path.isin(*PROBE_PATHS[paths]), value)

    def has_array(field: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant"))
        return F.when(is_valid_json(body), kind.startswith("ARRAY"))

    return responses.select(
        *keep,
        F.coalesce("status", F.lit(0)).alias("status"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce(header_of("content-type"), F.lit("")).alias("ctype"),
        header_of("link").alias("link"),
        header_of("last-modified").alias("last_modified"),
        header_of("etag").alias("etag"),
        F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("hops"),
        F.exists(F.coalesce("redirect_chain", F.array().cast(responses.schema["redirect_chain"].dataType)), lambda h: ~h["same_host"]).alias("cross_host"),
        (body != "").alias("has_body"),
        trimmed.startswith("<").alias("starts_tag"),
        (trimmed.startswith("<!") | trimmed.startswith("<html")).alias("starts_html"),
        H.redirect_markers(body).alias("redirect"),
        body.rlike(r"""(?i)<link[^<>]+rel\s*=\s*["'][^"'<>]*llms[._-]?txt[^"'<>]*["'][^<>]*>""").alias("llms_tag"),
        on("llms", llms_shape(body)).alias("llms"),
        on("robots", body.rlike(r"(?i)Sitemap\s*:")).alias("robots_sitemap"),
        on("robots", body.rlike(r"(?i)Content-Signal\s*:")).alias("robots_signal"),
        on("robots", named_crawlers(body)).alias("crawlers"),
        on("oauth", json_text(body, "issuer")).alias("issuer"),
        on("oauth-resource", json_text(body, "resource").isNotNull() & F.coalesce(has_array("authorization_servers"), F.lit(False))).alias("resource_ok"),
        on("bot-auth", is_valid_json(body) & trimmed.rlike(r"^[\[{]")).alias("json_container"),
        on("agent-card", json_text(body, "name").isNotNull()).alias("has_name"),
        kept_headers(*AUDIT_HEADERS).alias("headers"),
        F.coalesce("error", F.lit("")).alias("note"),
        "final_url",
        "redirect_chain",
    )


PROBE = [*SITE, "seed_url", "family", "ord", "url", "accept"]


def answered_probes(sites: DataFrame, responses: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Every probe with number and status of the first response to it; status 0 where there is none.

    Only names, numbers and statuses of responses are read, so a scan of a large response table
    leaves headers and bodies alone.
    """
    target = [*SITE, "url", "accept"]
    answer = F.struct("seq", F.coalesce("status", F.lit(0)).alias("status"))
    first = responses.groupBy(*target).agg(F.min_by(answer, "seq").alias("a"))
    return probe_targets(sites, families).join(first, target, "left").select(*PROBE, F.col("a.seq").alias("seq"), F.coalesce("a.status", F.lit(0)).alias("status"))


def probe_responses(answered: DataFrame, responses: DataFrame) -> DataFrame:
    """Whole responses of the probes that were answered, once each, with ``seed_url, family, ord``.

    The numbers of these few responses select them before any body is looked at. As the smaller
    side they are broadcast if they fit, else Spark may sift the responses by a filter made of them.
    """
    hits = answered.where(F.col("seq").isNotNull()).drop("status")
    return hits.join(responses, [*SITE, "seq", "url", "accept"])


def probe_results(sites: DataFrame, responses: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Every probe with its response's facts in ``r``, NULL without a response; a repeated response counts once."""
    answered = answered_probes(sites, responses, families)
    facts = response_facts(probe_responses(answered, responses), *PROBE)
    read = facts.select(*PROBE, F.struct(*[c for c in facts.columns if c not in PROBE]).alias("r"))
    silent = answered.where(F.col("seq").isNull())
    both = read.dropDuplicates(PROBE).unionByName(silent.select(*PROBE), allowMissingColumns=True)
    return both.withColumn("status", F.coalesce("r.status", F.lit(0)))


# Facts that only audit trails read.
TRAIL_FACTS = ["headers", "note", "final_url", "redirect_chain"]


def site_probes(results: DataFrame) -> DataFrame:
    """One row per site with its ``probe_results`` by family, in candidate order."""
    facts = [f.name for f in results.schema["r"].dataType if f.name not in ("status", *TRAIL_FACTS)]
    entry = F.struct("ord", "url", "status", *[F.col(f"r.{name}").alias(name) for name in facts])

    def family(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("family") == name, entry))).alias(name)

    names = ["home", "home-md", "md-twin", *PROBE_PATHS]
    return results.groupBy(*SITE).agg(F.first("seed_url").alias("seed_url"), *[family(n) for n in names])


def _one(family: str) -> Column:
    return F.get(F.col(f"`{family}`"), F.lit(0))


# What ends the search of a family with several candidates; families with one candidate need no test.
HITS: dict[str, Callable[[Column], Column]] = {
    "llms": lambda p: (p["status"] == 200) & p["has_body"],
    "sitemap": lambda p: (p["status"] == 200) & (p["ctype"].contains("xml") | p["url"].endswith(".gz")),
    "oauth": lambda p: F.coalesce((p["status"] == 200) & (p["issuer"] != ""), F.lit(False)),
} | dict.fromkeys(HEAD_FAMILIES, lambda p: (p["status"] >= 200) & (p["status"] < 300))


def _first(family: str) -> Column:
    """First candidate of a family that is a hit."""
    return F.get(F.filter(F.col(f"`{family}`"), HITS[family]), F.lit(0))


def _last_status(family: str) -> Column:
    return F.element_at(F.col(f"`{family}`"), -1)["status"]


def _answered(probe: Column) -> Column:
    return F.coalesce(probe["status"] > 0, F.lit(False))


def _llms() -> list[Column]:
    found = _first("llms")
    size = found["bytes"]
    shape = found["llms"]
    missing = F.array_compact(
        F.array(
            F.when(~shape["has_h1"], F.lit("title")),
            F.when(~shape["has_quote"], F.lit("summary")),
            F.when(shape["links"] <= 3, F.lit("link list")),
        )
    )
    exists = F.when(found.isNull(), F.lit("fail")).otherwise(F.lit("pass"))
    return [
        check_row("llms-txt-exists", "discoverability", exists, F.when(found.isNull(), F.lit("not found")).otherwise(text("found at ", found["url"]))),
        check_row("llms-txt-size", "discoverability", F.when(found.isNotNull(), graded(size, size <= 50_000, size <= 100_000)), text(kb(size), " K bytes")),
        check_row(
            "llms-txt-valid", "discoverability",
            F.when(found.isNotNull(), F.when(F.size(missing) == 0, F.lit("pass")).otherwise(F.lit("warn"))),
            F.when(F.size(missing) == 0, F.lit("well formed")).otherwise(F.concat(F.lit("missing "), F.array_join(missing, ", "))),
        ),
    ]


def _llms_directive() -> Column:
    home = _one("home")
    in_header = F.coalesce(home["link"], F.lit("")).rlike(r"""(?i)rel\s*=\s*["']?llms[.-]txt["']?""")
    severity = F.when(~_answered(home), F.lit("info")).when(in_header | home["llms_tag"], F.lit("pass")).otherwise(F.lit("fail"))
    said = F.when(~_answered(home), F.lit("home page did not answer")).when(in_header, F.lit("announced by header")).when(
        home["llms_tag"], F.lit("announced by tag")
    ).otherwise(F.lit("not announced"))
    return check_row("llms-txt-directive", "discoverability", severity, said)


def _link_headers() -> Column:
    home = _one("home")
    link = home["link"]
    severity = F.when(_answered(home) & link.isNotNull(), F.lit("pass")).otherwise(F.lit("info"))
    rels = F.array_join(H.link_rels(link), ", ")
    said = F.when(~_answered(home), F.lit("home page did not answer")).when(link.isNotNull(), text("rels: ", rels)).otherwise(F.lit("no Link header"))
    return check_row("link-headers", "capability-discovery", severity, said)


def _sitemap() -> Column:
    found = _first("sitemap")
    severity = F.when(found.isNull(), F.lit("fail")).otherwise(F.lit("pass"))
    return check_row("sitemap", "discoverability", severity, F.when(found.isNull(), F.lit("not found")).otherwise(text("found at ", found["url"])))


def _robots() -> list[Column]:
    robots = _one("robots")
    there = robots["status"] == 200
    sitemap, signal, named = robots["robots_sitemap"], robots["robots_signal"], robots["crawlers"]
    n = F.size(named)
    return [
        check_row(
            "robots-txt", "discoverability",
            F.when(there & sitemap, F.lit("pass")).otherwise(F.lit("warn")),
            F.when(~there, text("missing, status ", robots["status"])).when(sitemap, F.lit("names a sitemap")).otherwise(F.lit("names no sitemap")),
        ),
        check_row(
            "content-signals", "capability-discovery",
            F.when(there, F.when(signal, F.lit("pass")).otherwise(F.lit("info"))),
            F.when(signal, F.lit("policy stated")).otherwise(F.lit("no policy")),
        ),
        check_row(
            "ai-bot-rules", "capability-discovery",
            F.when(~there, F.lit("info")).when(n >= 3, F.lit("pass")).when(n >= 1, F.lit("warn")).otherwise(F.lit("fail")),
            F.when(~there, F.lit("robots.txt missing")).otherwise(text(n, " crawlers named: ", F.array_join(named, ", "))),
        ),
    ]


def _well_known(check_id: str, family: str) -> Column:
    found = _first(family)
    silent = F.forall(F.col(f"`{family}`"), lambda p: p["status"] == 0)
    said = F.when(found.isNotNull(), text("found at ", found["url"])).when(silent, F.lit("no response")).otherwise(
        text("not found, status ", _last_status(family))
    )
    return check_row(check_id, "capability-discovery", F.when(found.isNotNull(), F.lit("pass")).otherwise(F.lit("info")), said)


def _markdown_url() -> Column:
    twin = _one("md-twin")
    already = U.is_md_url(F.col("seed_url"))
    ctype = twin["ctype"]
    good = (twin["status"] == 200) & (ctype.contains("text/markdown") | ctype.contains("text/plain")) & ~twin["starts_tag"]
    good = F.coalesce(good, F.lit(False))
    said = F.when(already, F.lit("URL is markdown")).when(good, F.lit("twin served")).otherwise(text("no twin, status ", twin["status"]))
    return check_row("markdown-url-support", "content-accessibility", F.when(already | good, F.lit("pass")).otherwise(F.lit("fail")), said)


def _negotiation() -> Column:
    page = _one("home-md")
    there = F.coalesce(page["status"] == 200, F.lit(False))
    typed = page["ctype"].contains("text/markdown")
    severity = F.when(there & typed, F.lit("pass")).when(there & ~page["starts_html"], F.lit("warn")).otherwise(F.lit("fail"))
    said = F.when(there & typed, F.lit("markdown served")).when(there & ~page["starts_html"], F.lit("markdown served, wrong type")).otherwise(
        text("no markdown, status ", page["status"])
    )
    return check_row("content-negotiation", "content-accessibility", severity, said)


def _oauth() -> list[Column]:
    found = _first("oauth")
    good = F.coalesce(_one("oauth-resource")["resource_ok"], F.lit(False))
    return [
        check_row(
            "oauth-discovery", "capability-discovery", F.when(found.isNotNull(), F.lit("pass")).otherwise(F.lit("info")),
            F.when(found.isNotNull(), text("issuer ", found["issuer"])).otherwise(F.lit("not found")),
        ),
        check_row(
            "oauth-protected-resource", "capability-discovery", F.when(good, F.lit("pass")).otherwise(F.lit("info")),
            F.when(good, F.lit("present")).otherwise(F.lit("not found")),
        ),
    ]


def _cache() -> Column:
    home = _one("home")
    names = F.array_compact(
        F.array(F.when(home["last_modified"].isNotNull(), F.lit("Last-Modified")), F.when(home["etag"].isNotNull(), F.lit("ETag")))
    )
    severity = F.when(~_answered(home), F.lit("info")).when(F.size(names) > 0, F.lit("pass")).otherwise(F.lit("warn"))
    said = F.when(~_answered(home), F.lit("home page did not answer")).when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("no validators"))
    return check_row("cache-headers", "observability", severity, said)


def _published(check_id: str, family: str, fact: str) -> Column:
    """Document that should have a certain shape once it is published."""
    probe = _one(family)
    there, good = probe["status"] == 200, F.coalesce(probe[fact], F.lit(False))
    severity = F.when(~there, F.lit("info")).when(good, F.lit("pass")).otherwise(F.lit("warn"))
    said = (
        F.when(probe["status"] == 0, F.lit("no response"))
        .when(~there, text("not published, status ", probe["status"]))
        .when(good, F.lit("present"))
        .otherwise(F.lit("present but malformed"))
    )
    return check_row(check_id, "capability-discovery", severity, said)


def _redirects() -> Column:
    home = _one("home")
    hops, meta, script = home["hops"], home["redirect"]["meta_refresh"], home["redirect"]["js_redirect"]
    severity = (
        F.when(~_answered(home), F.lit("info"))
        .when((hops == 0) & (meta | script), F.lit("fail"))
        .when(hops >= 4, F.lit("warn"))
        .when((hops >= 2) & meta, F.lit("warn"))
        .otherwise(F.lit("pass"))
    )
    said = (
        F.when(~_answered(home), F.lit("home page did not answer"))
        .when((hops == 0) & meta, F.lit("meta refresh only"))
        .when((hops == 0) & script, F.lit("script redirect only"))
        .otherwise(text(hops, " hops", F.when(meta & (hops >= 2), F.lit(" and a meta refresh")).otherwise(F.lit(""))))
    )
    return check_row("redirect-behavior", "url-stability", severity, said)


# Builders in the fixed order of the checks; each makes the rows of the ids it names.
SITE_CHECKS: list[tuple[list[str], Callable[[], list[Column]]]] = [
    (["llms-txt-exists", "llms-txt-size", "llms-txt-valid"], _llms),
    (["well-known-api-catalog"], lambda: [_well_known("well-known-api-catalog", "api-catalog")]),
    (["well-known-mcp-card"], lambda: [_well_known("well-known-mcp-card", "mcp-card")]),
    (["well-known-agent-skills"], lambda: [_well_known("well-known-agent-skills", "agent-skills")]),
    (["robots-txt", "content-signals"], lambda: _robots()[:2]),
    (["markdown-url-support"], lambda: [_markdown_url()]),
    (["content-negotiation"], lambda: [_negotiation()]),
    (["oauth-discovery", "oauth-protected-resource"], _oauth),
    (["sitemap"], lambda: [_sitemap()]),
    (["llms-txt-directive"], lambda: [_llms_directive()]),
    (["link-headers"], lambda: [_link_headers()]),
    (["ai-bot-rules"], lambda: _robots()[2:]),
    (["cache-headers"], lambda: [_cache()]),
    (["web-bot-auth"], lambda: [_published("web-bot-auth", "bot-auth", "json_container")]),
    (["a2a-agent-card"], lambda: [_published("a2a-agent-card", "agent-card", "has_name")]),
    (["redirect-behavior"], lambda: [_redirects()]),
]


# The checks that each family's requests are made for.
TRAILS = {
    "llms": ["llms-txt-exists", "llms-txt-size", "llms-txt-valid"],
    "sitemap": ["sitemap"],
    "robots": ["robots-txt", "content-signals", "ai-bot-rules"],
    "api-catalog": ["well-known-api-catalog"],
    "mcp-card": ["well-known-mcp-card"],
    "agent-skills": ["well-known-agent-skills"],
    "oauth": ["oauth-discovery"],
    "oauth-resource": ["oauth-protected-resource"],
    "bot-auth": ["web-bot-auth"],
    "agent-card": ["a2a-agent-card"],
    "md-twin": ["markdown-url-support"],
    "home-md": ["content-negotiation"],
    "home": ["llms-txt-directive", "link-headers", "cache-headers", "redirect-behavior"],
}


def site_checks(
    sites: DataFrame, responses: DataFrame, only: list[str] | None = None, results: DataFrame | None = None
) -> DataFrame:
    """Check rows of every site; pass ``results`` to reuse ``probe_results``."""
    families = [f for f, ids in TRAILS.items() if only is None or set(ids) & set(only)]
    probes = site_probes(probe_results(sites, responses, families) if results is None else results)
    rows = [row for ids, build in SITE_CHECKS if only is None or set(ids) & set(only) for row in build()]
    checks = explode_checks(probes, rows, [*SITE, "seed_url"]).withColumnRenamed("seed_url", "page_url")
    return checks if only is None else checks.where(F.col("check_id").isin(*only))


def check_trails(checks: DataFrame, results: DataFrame) -> DataFrame:
    """The requests that led to each site check's result, a row each, numbered by ``step``.

    ``checks`` are ``site_checks`` rows and ``results`` the ``probe_results`` they were made of. A
    check asks a family's candidates in order and stops at its first hit, so a request belongs to
    its trail if no earlier candidate is a hit. The redirect check's trail goes on with the hops.
    A probe without a response has status 0 and no headers; a check that asked nothing (markdown
    twins of a URL that is markdown already) has no rows.
    """
    probe = {name: F.col(f"r.{name}") for name in ("has_body", "ctype", "issuer")} | {"url": F.col("url"), "status": F.col("status")}
    hit = F.lit(False)
    for family, test in HITS.items():
        hit = F.when(F.col("family") == family, test(probe)).otherwise(hit)
    earlier = Window.partitionBy(*SITE, "family").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    asked = (
        results.where((F.col("family") != "md-twin") | ~U.is_md_url(F.col("seed_url")))
        .withColumn("_over", F.coalesce(F.max(F.coalesce(hit, F.lit(False))).over(earlier), F.lit(False)))
        .where(~F.col("_over"))
    )
    note, headers = F.coalesce("r.note", F.lit("no response")), F.col("r.headers")

    def entry(method: Column, url: Column, status: Column, kept: Column, said: Column) -> Column:
        return F.struct(method.alias("method"), url.alias("url"), status.alias("status"), kept.alias("headers"), said.alias("note"))

    request = entry(F.when(F.col("family").isin(*HEAD_FAMILIES), F.lit("HEAD")).otherwise(F.lit("GET")), F.col("url"), F.col("status"), headers, note)
    typed = F.map_filter(headers, lambda k, v: k == "content-type")
    landed = F.when(F.col("status") > 0, F.concat(F.lit("final URL: "), F.coalesce("r.final_url", "url"))).otherwise(note)
    hops = F.transform(
        F.coalesce("r.redirect_chain", F.array().cast(results.schema["r"].dataType["redirect_chain"].dataType)),
        lambda h: entry(
            F.lit("GET"), h["from_url"], h["status"], F.lit(None).cast("map<string,string>"),
            F.concat(F.lit("to "), h["to_url"], F.when(h["same_host"], F.lit("")).otherwise(F.lit(" (cross-host)"))),
        ),
    )
    followed = F.concat(F.array(entry(F.lit("GET"), F.col("url"), F.col("status"), typed, landed)), hops)
    made = [
        F.struct(F.lit(check_id).alias("check_id"), (followed if check_id == "redirect-behavior" else F.array(request)).alias("requests"), F.lit(family).alias("f"))
        for family, ids in TRAILS.items()
        for check_id in ids
    ]
    rows = asked.select(*SITE, "family", "ord", F.explode(F.filter(F.array(*made), lambda m: m["f"] == F.col("family"))).alias("m"))
    steps = rows.select(*SITE, "m.check_id", "ord", F.posexplode("m.requests").alias("hop", "q"))
    return steps.select(*SITE, "check_id", (F.col("ord") + F.col("hop")).alias("step"), "q.*").join(
        checks.select(*SITE, "check_id"), [*SITE, "check_id"], "left_semi"
    )


def soft_404(responses: DataFrame, probe_path: str) -> DataFrame:
    """Answer to a path that cannot exist: 404 is right, 200 is a disguised error page."""
    status = F.coalesce("status", F.lit(0))
    severity = F.when(status == 404, F.lit("pass")).when(status == 200, F.lit("fail")).when(status == 0, F.lit("info")).otherwise(F.lit("warn"))
    row = check_row("http-status-codes", "url-stability", severity, text("missing page answers ", status))
    return explode_checks(responses.where(F.col("url").endswith(probe_path)), [row], [*SITE, "url"])


# ---------------------------------------------------------------- links of the index file


def llms_link_checks(bodies: DataFrame, statuses: DataFrame, sitemap_locs: DataFrame) -> DataFrame:
    """Do the links of llms.txt resolve, lead to markdown, and match the sitemap?

    The rubric declares these three checks; each is a join of the link list. ``bodies`` has one
    index file per site, ``statuses(url, status, ctype)``, ``sitemap_locs(site_id, loc)``.
    """
    links = llms_links(bodies).select(*SITE, U.without_fragment(U.resolve_href(F.col("href"), F.col("url"))).alias("url")).distinct()
    known = links.join(statuses.select("url", "status", "ctype"), "url", "left")
    inside = known.join(
        sitemap_locs.select("site_id", F.col("loc").alias("url"), F.lit(True).alias("listed")).distinct(), ["site_id", "url"], "left"
    )
    status = F.coalesce("status", F.lit(0))
    counts = inside.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((status == 0) | (status >= 400)).alias("broken"),
        F.count_if(F.col("url").rlike(r"\.md(?:\?|\z)") | F.coalesce(F.col("ctype").contains("text/markdown"), F.lit(False))).alias("markdown"),
        F.count_if(F.col("listed").isNull()).alias("unlisted"),
    )
    n = F.col("n")

    def all_or(check_id: str, bad: Column, what: str) -> Column:
        severity = F.when(bad == 0, F.lit("pass")).when(bad * 4 <= n, F.lit("warn")).otherwise(F.lit("fail"))
        return check_row(check_id, "discoverability", severity, text(bad, "/", n, f" links {what}"))

    return explode_checks(
        counts,
        [
            all_or("llms-txt-links-resolve", F.col("broken"), "broken"),
            all_or("llms-txt-links-markdown", n - F.col("markdown"), "not markdown"),
            all_or("llms-txt-freshness", F.col("unlisted"), "not in the sitemap"),
        ],
        SITE,
    )
