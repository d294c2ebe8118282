"""Audit inputs derived from the given tables.

The given ``pages`` hold one HTML text each and no responses, statuses or runs. The expressions
below add those by rules on ``page_id``, in SQL that Spark and DuckDB read alike, so that every
branch of every check occurs while all rows of the table take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import html as H
from auditlake.functions import urls as U
from auditlake.operators.windows import ordinal_within

RUN_ID = "run-1"


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE '' END"


SITE_ID = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"

HEAD_EXTRA = " || ".join(
    [
        _when("page_id % 3 = 0", "'<meta name=\"description\" content=\"What this page is about\">'"),
        _when(
            "page_id % 2 = 0",
            "'<meta property=\"og:title\" content=\"Draft\"><meta content=\"Final &amp; done\" property=\"og:title\">'",
        ),
        _when("page_id % 4 < 3", "'<meta property=\"og:type\" content=\"article\">'"),
        _when("page_id % 7 = 0", "'<meta name=\"twitter:card\" content=\"summary\">'"),
        _when(
            "page_id % 4 = 2",
            "'<script type=\"application/ld+json\">{\"@type\":\"Article\",\"id\":' || CAST(page_id AS STRING) || '}</script>'",
        ),
        _when("page_id % 9 = 4", "'<script type=\"application/ld+json\">{broken</script>'"),
        _when("page_id % 3 = 1", "'<link rel=\"canonical\" href=\"' || url || '\">'"),
        _when("page_id % 31 = 3", "'<meta http-equiv=\"refresh\" content=\"0; url=/new\">'"),
        _when("page_id % 37 = 5", "'<script>window.location = \"https://other.example.com/\";</script>'"),
    ]
)

# Character references in several writings, and lists and quotes inside each other.
REFERENCES = "<p>Caf&eacute; na&#239;ve &#x2014; 5 &amp;lt; 6 &euro; &unknown; &#150;</p>"
NESTED = (
    '<ol start="3"><li>first</li><li>second<ul><li>inner</li><li><p>para</p></li></ul></li></ol>'
    "<blockquote><p>said</p><p>more</p><ul><li>point</li></ul></blockquote><h2></h2><ul><li><ol><li>deep</li></ol></li></ul>"
)

BODY_EXTRA = " || ".join(
    [
        _when("page_id % 5 = 0", "'<img src=\"/a.png\" alt=\"A diagram\"><img alt=\"Another\" src=\"/b.png\">'"),
        _when("page_id % 5 = 1", "'<img src=\"/c.png\"><img src=\"/d.png\" alt=\" \">'"),
        _when(
            "page_id % 5 = 2",
            "repeat('<img src=\"/e.png\" alt=\"Step\">', 4) || '<img src=\"/f.png\" alt=\"\">'",
        ),
        _when("page_id % 7 = 3", "'<h2>Setup</h2><p>First steps.</p><h3>Details</h3><p>More.</p>'"),
        _when("page_id % 7 = 5", "'<h2>Usage</h2><p>How to.</p><h4>Deep</h4><p>Skips a level.</p>'"),
        _when("page_id % 14 = 6", "'<h1>Second title</h1>'"),
        _when(
            "page_id % 6 = 0",
            "'<pre><code class=\"language-json\">{\"a\": [1, 2]}' || chr(10) || '</code></pre>'",
        ),
        _when(
            "page_id % 6 = 3",
            "'<pre><code class=\"language-json\">{\"a\": 1,} // note' || chr(10) || '</code></pre>'",
        ),
        _when("page_id % 6 = 4", "'<pre><code># build' || chr(10) || 'make all</code></pre>'"),
        _when("page_id % 19 = 1", "'<pre><code>' || chr(10) || '```' || chr(10) || 'inner</code></pre>'"),
        _when(
            "page_id % 8 = 2",
            "'<div role=\"tab\">npm</div><div role=\"tab\">pip</div><div role=\"tabpanel\">npm i it</div>'",
        ),
        _when("page_id % 16 = 2", "'<section role=tabpanel><div>one <b>two</b></div><div class=\"tab-panel x\"> three </div></section>'"),
        _when("page_id % 10 = 3", f"'{REFERENCES}'"),
        _when("page_id % 9 = 5", f"'{NESTED}'"),
        _when("page_id % 13 = 4", "'<img alt=''One mark'' src=''/g.png''><img src=/h.png alt=none>'"),
        _when("page_id % 41 = 7", "'<form><input type=\"password\" name=\"p\"></form>'"),
        _when(
            "page_id % 2 = 1",
            "'<a href=\"#top\">Top</a><a href=\"mailto:a@example.com\">Mail</a>"
            "<a href=\"../up/./x?q=1#frag\">Up</a><a href=\"//cdn.example.com/lib\">Lib</a>"
            "<a href=\"' || url || '\">Self</a><a href=\"sub/page/\">Sub</a>'",
        ),
        _when("page_id % 3 = 2", "repeat('<a href=\"/ref/1\">Ref</a>', 2) || '<a href=\"/ref/2\">Ref</a>'"),
    ]
)

HYDRATED = " || ".join(
    [
        _when("page_id % 6 = 1", "repeat('<p>Text that only a browser gets to see.</p>', 12)"),
        _when("page_id % 8 = 1", "'<div role=\"tab\">one</div><div role=\"tab\">two</div>'"),
    ]
)

BASE_HTML = f"""replace(replace(replace(html, '</head>', {HEAD_EXTRA} || '</head>'),
    '</article>', {BODY_EXTRA} || '</article>'),
    '<title>', CASE WHEN page_id % 41 = 7 THEN '<title>Sign in to ' ELSE '<title>' END)"""
RENDERED_HTML = f"replace(base_html, '</article>', {HYDRATED} || '</article>')"
RAW_HTML = """CASE WHEN page_id % 4 = 0
    THEN regexp_replace(base_html, '(?s)<article>.*</article>', '<div id="root"></div>')
    ELSE base_html END"""
RAW_STATUS = """CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 301
    WHEN page_id % 17 = 0 THEN 500 ELSE 200 END"""
FETCH_ERROR = "CASE WHEN page_id % 29 = 5 THEN 'connect ETIMEDOUT' END"
RENDERED_ERROR = """CASE WHEN page_id % 23 = 7
    THEN '[0101/120000.123:ERROR:gpu.cc(1)] lost' || chr(10) || '  Timeout 20000ms exceeded  ' || chr(10) || 'x'
    WHEN page_id % 59 = 9 THEN 'Skipped: no browser' END"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page source as stored, with site and variants; ``page_id`` orders the pages of a site."""
    return (
        read_table(spark, sf_dir, "pages")
        .withColumn("html", H.normalize_newlines(F.col("html")))
        .withColumn("base_html", F.expr(BASE_HTML))
        .select(
            F.lit(RUN_ID).alias("run_id"),
            F.expr(SITE_ID).alias("site_id"),
            F.col("page_id").alias("page_index"),
            "url",
            F.expr(RAW_STATUS).alias("raw_status"),
            F.expr(RAW_HTML).alias("raw_html"),
            F.expr(RENDERED_HTML).alias("rendered_html"),
            F.expr(FETCH_ERROR).alias("fetch_error"),
            F.expr(RENDERED_ERROR).alias("rendered_error"),
        )
    )


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each site numbered from 0: ``(site_id, url, page_id, page_index)``."""
    pages = read_table(spark, sf_dir, "pages").select(F.expr(SITE_ID).alias("site_id"), "url", "page_id")
    return ordinal_within(pages, ["site_id"], "page_id", "page_index")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site with its seed; ``h`` varies the derived responses."""
    return (
        read_table(spark, sf_dir, "pages")
        .groupBy(F.expr(SITE_ID).alias("site_id"))
        .agg(F.min("page_id").alias("h"))
        .select(
            F.lit(RUN_ID).alias("run_id"),
            "site_id",
            "h",
            F.concat(F.lit("https://"), "site_id", F.when(F.col("h") % 10 == 3, F.lit("/guide.md")).otherwise(F.lit("/"))).alias("seed_url"),
        )
    )


# Derived probe responses: kind, path, position. ``o`` is the position, ``h`` belongs to the site.
PROBES = [
    ("home", None), ("home-md", None), ("md-twin", None), ("not-found", "/no-such-page"),
    ("llms", "/llms.txt"), ("llms", "/docs/llms.txt"),
    ("sitemap", "/sitemap.xml"), ("sitemap", "/sitemap_index.xml"), ("sitemap", "/sitemap-index.xml"),
    ("sitemap", "/sitemap.xml.gz"), ("robots", "/robots.txt"),
    ("oauth", "/.well-known/openid-configuration"), ("oauth", "/.well-known/oauth-authorization-server"),
    ("oauth-resource", "/.well-known/oauth-protected-resource"),
    ("api-catalog", "/.well-known/api-catalog"),
    ("mcp-card", "/.well-known/mcp.json"), ("mcp-card", "/.well-known/mcp/server-card.json"),
    ("mcp-card", "/.well-known/mcp/server-cards.json"),
    ("agent-skills", "/.well-known/agent-skills/index.json"), ("agent-skills", "/.well-known/skills/index.json"),
    ("bot-auth", "/.well-known/http-message-signatures-directory"),
    ("agent-card", "/.well-known/agent-card.json"),
]

PROBE_STATUS = """CASE WHEN kind = 'home' THEN CASE WHEN h % 13 = 7 THEN 0 ELSE 200 END
    WHEN kind = 'not-found' THEN CASE h % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 0 END
    ELSE CASE (h * 3 + o * 5) % 7 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 200 WHEN 3 THEN 500
        WHEN 4 THEN 0 WHEN 5 THEN 200 ELSE 204 END END"""

CONTENT_TYPE = """CASE
    WHEN kind = 'home' THEN 'text/html'
    WHEN kind = 'home-md' THEN CASE h % 3 WHEN 0 THEN 'text/markdown; charset=utf-8' ELSE 'text/html' END
    WHEN kind = 'md-twin' THEN CASE h % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' ELSE 'text/html' END
    WHEN kind = 'sitemap' THEN CASE (h + o) % 3 WHEN 0 THEN 'text/html' ELSE 'application/xml' END
    ELSE CASE (h + o) % 2 WHEN 0 THEN 'application/json' ELSE 'text/plain' END END"""

LINK_HEADER = """CASE WHEN kind <> 'home' THEN NULL
    WHEN h % 5 = 0 THEN '</llms.txt>; rel="llms.txt", </.well-known/api-catalog>; rel="api-catalog"'
    WHEN h % 5 = 1 THEN '</style.css>; rel=preload' END"""
LAST_MODIFIED = "CASE WHEN kind = 'home' AND h % 3 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END"
ETAG = "CASE WHEN kind = 'home' AND h % 4 = 1 THEN 'abc' END"
HOPS = "CASE WHEN kind <> 'home' THEN 0 ELSE CASE h % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END END"

BODY = """CASE
    WHEN kind = 'home' THEN '<html><head><title>Home</title>'
        || CASE WHEN h % 7 = 1 THEN '<link rel="llms.txt" href="/llms.txt">' ELSE '' END
        || CASE WHEN h % 9 = 2 THEN '<meta http-equiv="refresh" content="0; url=/en">' ELSE '' END
        || CASE WHEN h % 9 = 4 THEN '<script>location.href = "https://www.example.com/"</script>' ELSE '' END
        || '</head><body><h1>Home</h1>' || page_html || '</body></html>'
    WHEN kind IN ('home-md', 'md-twin') THEN CASE h % 2 WHEN 0 THEN '# Home' ELSE '<!doctype html><p>Home</p>' END
    WHEN kind = 'llms' THEN CASE WHEN (h + o) % 8 = 1 THEN ''
        ELSE '# Site ' || site_id || chr(10) || CASE WHEN h % 3 = 0 THEN '' ELSE '> Summary' || chr(10) END
            || repeat('- [Page](/ref/1)' || chr(10) || '- [Twin](/ref/2.md): text' || chr(10), CAST(1 + h % 3 AS INT))
            || CASE WHEN h % 6 = 5 THEN repeat('filler text of a long index. ', CAST(1000 * (1 + h % 4) AS INT)) ELSE '' END || chr(10) || doc_text END
    WHEN kind = 'robots' THEN 'User-agent: *' || chr(10) || 'Disallow: /private' || chr(10)
        || CASE WHEN h % 3 > 0 THEN 'user-agent : GPTBot' || chr(10) || 'Allow: /' || chr(10) ELSE '' END
        || CASE WHEN h % 3 > 1 THEN '  User-agent: ClaudeBot' || chr(10) || 'User-agent: CCBot # all' || chr(10)
            || 'User-agent: PerplexityBotX' || chr(10) ELSE '' END
        || CASE WHEN h % 4 = 0 THEN 'Content-Signal: search=yes' || chr(10) ELSE '' END
        || CASE WHEN h % 2 = 0 THEN 'Sitemap: https://' || site_id || '/sitemap.xml' || chr(10) ELSE '' END
    WHEN kind = 'oauth' THEN CASE (h + o) % 3 WHEN 0 THEN '{"issuer": "https://' || site_id || '"}'
        WHEN 1 THEN '{"issuer": ""}' ELSE '{"issuer": 5}' END
    WHEN kind = 'oauth-resource' THEN CASE h % 3 WHEN 0 THEN '{"resource": "r", "authorization_servers": ["a"]}'
        WHEN 1 THEN '{"resource": "r"}' ELSE 'nothing' END
    WHEN kind = 'bot-auth' THEN CASE h % 3 WHEN 0 THEN '{"keys": []}' WHEN 1 THEN '"text"' ELSE 'not json' END
    WHEN kind = 'agent-card' THEN CASE h % 3 WHEN 0 THEN '{"name": "Agent"}' WHEN 1 THEN '{"name": 1}' ELSE '<html>' END
    ELSE '{}' END"""

PROBE_URL = """CASE WHEN kind IN ('home', 'home-md') THEN seed_url
    WHEN kind = 'md-twin' THEN CASE WHEN h % 10 = 3 THEN 'https://' || site_id || '/none' ELSE 'https://' || site_id || '/index.md' END
    ELSE 'https://' || site_id || path END"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe responses of every site, in the canonical response schema.

    A home page holds the HTML of the site's first page, an index the text of the document of that number.
    """
    probes = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(p).cast("string").alias("path"), F.lit(i).cast("bigint").alias("o"))
            for i, (k, p) in enumerate(PROBES)
        ]
    )
    first_page = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("h"), F.coalesce("html", F.lit("")).alias("page_html"))
    index_text = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("h"), "text")
    with_texts = sites(spark, sf_dir).join(first_page, "h").join(index_text, "h", "left").withColumn("doc_text", F.coalesce("text", F.lit(""))).drop("text")
    rows = with_texts.select("*", F.explode(probes).alias("p")).select("run_id", "site_id", "h", "seed_url", "page_html", "doc_text", "p.*")
    rows = rows.select(
        "*",
        F.expr(PROBE_URL).alias("url"),
        F.expr(PROBE_STATUS).cast("int").alias("status"),
        F.expr(BODY).alias("body"),
        F.expr(HOPS).alias("hops"),
    )
    kept = F.map_filter(
        F.create_map(
            F.lit("content-type"), F.expr(CONTENT_TYPE),
            F.lit("link"), F.expr(LINK_HEADER),
            F.lit("last-modified"), F.expr(LAST_MODIFIED),
            F.lit("etag"), F.expr(ETAG),
            F.lit("server"), F.lit("test"),
        ),
        lambda k, v: v.isNotNull(),
    )
    answered = F.col("status") > 0
    hop = F.transform(
        F.when(F.col("hops") > 0, F.sequence(F.lit(1), F.col("hops").cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat("url", F.lit("?hop="), (i - 1).cast("string")).alias("from_url"),
            F.concat("url", F.lit("?hop="), i.cast("string")).alias("to_url"),
            F.lit(301).alias("status"),
            (F.col("h") % 2 == 0).alias("same_host"),
        ),
    )
    return rows.select(
        "run_id",
        "site_id",
        F.col("o").alias("seq"),
        F.when(F.col("kind").isin("api-catalog", "mcp-card", "agent-skills"), F.lit("HEAD")).otherwise(F.lit("GET")).alias("method"),
        "url",
        F.when(F.col("kind") == "home-md", F.lit("text/markdown")).otherwise(F.lit("text/html")).alias("accept"),
        "status",
        F.when(answered, F.transform_values(kept, lambda k, v: F.array(v, F.lit("second")))).alias("headers"),
        F.when(answered, F.col("body")).alias("body"),
        F.when(answered, F.octet_length("body").cast("bigint")).alias("bytes"),
        F.when(answered, F.col("url")).alias("final_url"),
        F.when(answered, hop).alias("redirect_chain"),
        F.when(~answered, F.lit("fetch failed")).alias("error"),
    )


# Status of a linked URL: some links have no response at all.
LINK_STATUS = """CASE length(url) % 7 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 0 ELSE 200 END"""
LINK_ANSWERED = "length(url) % 9 <> 4"


def link_statuses(links: DataFrame) -> DataFrame:
    """HEAD answers for the distinct targets of ``links(abs_url)``."""
    targets = links.select(U.without_fragment(F.col("abs_url")).alias("url")).distinct()
    return targets.select("url", F.when(F.expr(LINK_ANSWERED), F.expr(LINK_STATUS)).cast("int").alias("status")).where(
        F.col("status").isNotNull()
    )


# ------------------------------------------------------------------ link graph, sitemaps, runs, logs

# Page i of a site links to 2i+1, 2i+2 and (7i+3) mod n, to itself with a fragment, and off the host.
NODE = "CASE WHEN {i} = 0 THEN 'https://' || site_id || '/' ELSE 'https://' || site_id || '/n/' || CAST({i} AS STRING) END"


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link table of a graph over each site's pages."""
    pages = site_pages(spark, sf_dir).select("site_id", F.col("page_index").alias("i"))
    sizes = pages.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    targets = F.expr("array(2 * i + 1, 2 * i + 2, (7 * i + 3) % n)")
    rows = pages.join(sizes, "site_id").select("site_id", "n", F.expr(NODE.format(i="i")).alias("src_url"), "i", F.posexplode(targets).alias("link_idx", "t"))
    inside = rows.where("t < n").select("site_id", "src_url", "link_idx", F.expr(NODE.format(i="t")).alias("abs_url"))
    outside = rows.where("link_idx = 0").select(
        "site_id", "src_url", F.lit(3).alias("link_idx"), F.concat(F.lit("https://other.example.com/"), F.col("i").cast("string")).alias("abs_url")
    )
    return inside.unionByName(outside).select(
        F.lit(RUN_ID).alias("run_id"), "site_id", "src_url", "link_idx", F.col("abs_url").alias("href"), "abs_url"
    )


def graph_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).withColumn("seed_url", F.concat(F.lit("https://"), "site_id", F.lit("/")))


# Sites with an odd h have an index of two children and a nested index; those with h % 4 = 0 a flat
# sitemap; the rest none. Entries are the site's pages plus one repeated, one foreign and one image.
SITEMAP_ENTRY = """'<url><loc> https://' || site_id || '/n/' || CAST(page_index AS STRING) || ' </loc><image:image><image:loc>https://cdn.example.com/i.png</image:loc></image:image></url>'"""


def sitemap_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap files of the sites: one with all pages, or an index over files of a few pages."""
    pages = site_pages(spark, sf_dir).join(sites(spark, sf_dir).select("site_id", "h"), "site_id")
    chunk = pages.withColumn("chunk", F.when(F.col("h") % 2 == 1, F.floor(F.col("page_index") / 20)).otherwise(0)).withColumn("entry", F.expr(SITEMAP_ENTRY))
    files = chunk.where("h % 2 = 1 OR h % 4 = 0").groupBy("site_id", "h", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "entry"))), lambda e: e["entry"]), "\n").alias("entries")
    )
    extra = F.expr("'<url><loc>https://' || site_id || '/n/0</loc></url><url><loc>https://elsewhere.example.com/x</loc></url><url><loc></loc></url>'")
    body = F.concat(F.lit('<?xml version="1.0"?><urlset><!-- <url><loc>https://no.example.com/</loc></url> -->'), "entries", extra, F.lit("</urlset>"))
    # An index names every file and one index too many.
    own = F.concat(F.lit("https://"), "site_id", F.when(F.col("h") % 2 == 1, F.concat(F.lit("/sitemap-"), F.col("chunk").cast("string"), F.lit(".xml"))).otherwise(F.lit("/sitemap.xml")))
    flat = files.select("site_id", own.alias("sitemap_url"), body.alias("body"))
    counts = files.where("h % 2 = 1").groupBy("site_id").agg(F.max("chunk").alias("last"))
    names = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("last")),
        lambda c: F.concat(F.lit("<sitemap><loc>https://"), F.col("site_id"), F.lit("/sitemap-"), c.cast("string"), F.lit(".xml</loc></sitemap>")),
    )
    index = counts.select(
        "site_id",
        F.concat(F.lit("https://"), "site_id", F.lit("/sitemap.xml")).alias("sitemap_url"),
        F.concat(F.lit("<sitemapindex>"), F.array_join(names, ""), F.lit("<sitemap><loc>https://"), "site_id", F.lit("/sitemap.xml</loc></sitemap></sitemapindex>")).alias("body"),
    )
    broken = sites(spark, sf_dir).where("h % 4 = 2").select("site_id", F.concat(F.lit("https://"), "site_id", F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit("<<not xml").alias("body"))
    return flat.unionByName(index).unionByName(broken).withColumn("run_id", F.lit(RUN_ID))


def run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two runs per site; in the later run some pages have moved."""
    pages = read_table(spark, sf_dir, "pages").select(F.expr(SITE_ID).alias("site_id"), "page_id", "url")
    moved = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("-moved"))).otherwise(F.col("url"))
    later = pages.select(F.lit("run-b").alias("run_id"), "site_id", moved.alias("url"))
    return pages.select(F.lit("run-a").alias("run_id"), "site_id", "url").unionByName(later)


# Finding ids of two runs per user: in the later run some events bear on another finding.
FINDING_A = "'check:' || event_type || '-' || get_json_object(props, '$.k')"
FINDING_B = "CASE WHEN event_id % 4 = 0 THEN 'check:moved-' || get_json_object(props, '$.k') ELSE 'check:' || event_type || '-' || get_json_object(props, '$.k') END"


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged findings of two runs per user."""
    e = read_table(spark, sf_dir, "events")
    cols = [F.concat(F.lit("user-"), "user_id").alias("site_id"), F.lit("warn").alias("severity")]
    a = e.select(F.lit("run-a").alias("run_id"), *cols, F.expr(FINDING_A).alias("finding_id"), F.lit(1).alias("n"))
    b = e.select(F.lit("run-b").alias("run_id"), *cols, F.expr(FINDING_B).alias("finding_id"), (1 + F.col("event_id") % 2).alias("n"))
    return a.unionByName(b).groupBy("run_id", "site_id", "finding_id", "severity").agg(F.sum("n").cast("bigint").alias("occurrences"))


def two_runs(site_ids: DataFrame) -> DataFrame:
    """Run table with two runs per site; the later one of some sites is listed first."""
    runs = F.array(
        F.struct(F.lit("run-a").alias("run_id"), F.lit(1000).cast("bigint").alias("started_at"), F.lit(None).cast("bigint").alias("finished_at"), F.lit(2).alias("seq")),
        F.struct(F.lit("run-b").alias("run_id"), F.lit(900).cast("bigint").alias("started_at"), F.lit(2000).cast("bigint").alias("finished_at"), F.lit(1).alias("seq")),
    )
    return site_ids.select("site_id", F.explode(runs).alias("r")).select("site_id", "r.*")


# Event types as run events; k is the number in props.
LOG_TYPE = """CASE event_type WHEN 'signup' THEN CASE WHEN k % 10 < 3 THEN 'discover' ELSE 'page:start' END
    WHEN 'view' THEN 'page:start' WHEN 'click' THEN 'profile:done' WHEN 'purchase' THEN 'page:done'
    ELSE CASE k WHEN 0 THEN 'run:done' WHEN 25 THEN 'run:stopped' WHEN 50 THEN 'run:error' ELSE 'page:start' END END"""


def raw_log(events: DataFrame) -> DataFrame:
    """Run events with page arrays, from a batch or a stream of the events table."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    typed = e.withColumn("type", F.expr(LOG_TYPE))
    on_page = F.col("type").isin("profile:done", "page:done", "page:start")
    profile = F.element_at(F.array(F.lit("rawHttp"), F.lit("headless"), F.lit("snippet")), (F.floor(F.col("k") / 10) % 3 + 1).cast("int"))
    is_profile = F.col("type") == "profile:done"
    chars = F.when(is_profile, F.floor(F.col("value") * 100).cast("bigint"))
    urls = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") % 10), lambda i: F.concat(F.lit("https://docs.example.com/p"), i.cast("string")))
    return typed.select(
        F.concat(F.lit("run-"), "user_id").alias("run_id"), F.col("event_id").alias("seq"), "type",
        F.when(on_page, F.concat(F.lit("https://docs.example.com/p"), (F.col("k") % 10).cast("string"))).alias("url"),
        F.lit(None).cast("bigint").alias("page_index"),
        F.when(is_profile, profile).alias("profile"), chars.alias("chars"), F.floor(chars / 4 + 0.5).cast("bigint").alias("tokens_est"),
        F.when(F.col("type") == "page:done", F.col("k") / 100).alias("js_gated"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("boolean").alias("capped"),
        F.when(F.col("type").startswith("run:"), F.concat(F.lit("at "), F.col("event_id").cast("string"))).alias("message"),
        F.when(F.col("type") == "discover", urls).alias("pages"), "ts",
    )


# Redirects and headers of a page fetch, for the strict ruleset.
PAGE_HOPS = "CASE page_id % 6 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END"
PAGE_HOP_TO = "CASE WHEN page_id % 12 = 3 THEN 'https://login.okta.com/x' ELSE url END"


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages with the redirects and the Link header of their fetch."""
    pages = crawled_pages(spark, sf_dir).withColumn("page_id", F.col("page_index"))
    hop = F.struct(
        F.col("url").alias("from_url"), F.expr(PAGE_HOP_TO).alias("to_url"), F.lit(301).alias("status"), (F.col("page_id") % 4 != 3).alias("same_host")
    )
    header = F.when(F.col("page_id") % 5 == 0, F.lit('</.well-known/api-catalog>; rel="api-catalog"'))
    return pages.select("*", F.array_repeat(hop, F.expr(PAGE_HOPS)).alias("redirect_chain"), header.alias("link_header"))
