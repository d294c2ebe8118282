"""The registered queries: each runs one operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import html as H
from auditlake.functions import text as T
from auditlake.functions import urls as U
from auditlake.operators import page_checks as K
from auditlake.operators import profiles as P
from auditlake.plans import corpus as C
from auditlake.session import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return keep


def sorted_text(m) -> F.Column:
    """Map as ``k=v`` lines in key order, for comparison."""
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(""))))),
        "; ",
    )


def joined(a) -> F.Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


# ------------------------------------------------------------------ URLs


def page_urls(spark, sf):
    return C.read_table(spark, sf, "pages").select("page_id", "url")


def url_query(name: str, **columns):
    """Register a query that applies URL functions to every page URL."""

    def run(spark, sf):
        return page_urls(spark, sf).select("page_id", *[build(F.col("url")).alias(k) for k, build in columns.items()])

    QUERIES[name] = run


url_query("u1_normalize_url", norm_url=U.normalize_url)
url_query("u3_origin_of", origin=U.origin_of)
url_query("u4_host_of", host=U.host_of)
url_query("u5_path_of", path=U.path_of)
url_query("u6_host_and_path", host_and_path=U.host_and_path)
url_query(
    "u7_under_prefix",
    under_en=lambda u: U.under_prefix(u, U.authority_of(u), F.lit("/en")),
    under_e=lambda u: U.under_prefix(u, U.authority_of(u), F.lit("/e")),
    under_root=lambda u: U.under_prefix(u, U.authority_of(u), F.lit("/")),
)
url_query(
    "u8_bfs_in_scope",
    scope_e=lambda u: U.bfs_in_scope(u, F.concat(U.origin_of(u), F.lit("/e"))),
    scope_other=lambda u: U.bfs_in_scope(u, F.lit("https://m.ththth.example.net/")),
)
url_query("u9_md_variant", md_url=U.md_variant, is_md=U.is_md_url)


def raw_links(spark, sf) -> DataFrame:
    """Every href of the raw pages in document order."""
    return C.crawled_pages(spark, sf).select(
        "run_id", "site_id", "page_index", F.col("url").alias("src_url"), F.posexplode(H.hrefs(F.col("raw_html"))).alias("link_idx", "href")
    )


@query("u2_resolve_href")
def u2(spark, sf):
    return raw_links(spark, sf).select(
        "page_index", F.col("link_idx").cast("bigint").alias("link_idx"), "href", U.resolve_href(F.col("href"), F.col("src_url")).alias("abs_url")
    )


@query("u10_href_is_navigable")
def u10(spark, sf):
    return raw_links(spark, sf).select(
        "page_index",
        F.col("link_idx").cast("bigint").alias("link_idx"),
        U.href_is_navigable(F.col("href"), "crawl").alias("crawl"),
        U.href_is_navigable(F.col("href"), "check").alias("checked"),
    )


# ------------------------------------------------------------------ text, numbers, JSON


def documents(spark, sf):
    return C.read_table(spark, sf, "documents")


def events(spark, sf):
    return C.read_table(spark, sf, "events")


@query("t1_lengths")
def t1(spark, sf):
    return documents(spark, sf).select("doc_id", T.utf16_len(F.col("text")).alias("utf16"), T.byte_len(F.col("text")).alias("bytes"))


@query("t2_tokens_est")
def t2(spark, sf):
    return documents(spark, sf).select("doc_id", T.tokens_est(T.utf16_len(F.col("text"))).alias("tokens"))


@query("t3_collapse_ws")
def t3(spark, sf):
    c = T.collapse_ws(F.col("text"))
    return documents(spark, sf).select("doc_id", F.md5(c).alias("collapsed_md5"), F.length(c).cast("bigint").alias("chars"))


@query("t4_clamp01")
def t4(spark, sf):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("value") - 20) / 100)
    return events(spark, sf).select("event_id", F.round(T.clamp01(x), 6).alias("share"))


@query("t5_kb_k")
def t5(spark, sf):
    return documents(spark, sf).select("doc_id", T.kb(F.octet_length("text")).alias("kb"), T.thousands(F.col("n_chars")).alias("k"))


@query("t6_format_chars")
def t6(spark, sf):
    return events(spark, sf).select("event_id", T.format_chars(F.col("event_id") * 7).alias("label"), T.format_chars(F.col("event_id")).alias("small_label"))


@query("t7_format_duration")
def t7(spark, sf):
    return events(spark, sf).select("event_id", T.format_duration(F.col("event_id") * 37).alias("label"))


@query("t8_content_start_pct")
def t8(spark, sf):
    docs = documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("md"))
    pages = C.crawled_pages(spark, sf).select(
        F.lit("page").alias("kind"), F.col("page_index").alias("id"), H.html_to_markdown(F.col("raw_html")).alias("md")
    )
    return docs.unionAll(pages).select("kind", "id", T.content_start_pct(F.col("md")).alias("start_pct"))


@query("t9_text_to_markup_ratio")
def t9(spark, sf):
    return C.crawled_pages(spark, sf).select(
        "page_index",
        F.round(H.text_to_markup_ratio(F.col("raw_html")), 6).alias("raw_ratio"),
        F.round(H.text_to_markup_ratio(F.col("rendered_html")), 6).alias("rendered_ratio"),
    )


JSON_VARIANTS = """CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN props || ' 2' WHEN 2 THEN '[' || props || ',]'
    WHEN 3 THEN ' ' || props || ' ' WHEN 4 THEN props || ', ' || props WHEN 5 THEN '[' || props || ', null, true, 1e3]'
    WHEN 6 THEN replace(props, '"', '') ELSE props || '] , [' || props END"""


@query("t10_is_valid_json")
def t10(spark, sf):
    text = events(spark, sf).select("event_id", F.expr(JSON_VARIANTS).alias("s"))
    return text.select("event_id", T.is_valid_json(F.col("s")).alias("valid"), T.is_valid_json_exact(F.col("s")).alias("valid_exact"))


FINDING_IDS = "CASE event_id % 3 WHEN 0 THEN 'check:' || event_type WHEN 1 THEN event_type ELSE 'diff:' || event_type || ':x' END"


@query("t11_bare_id")
def t11(spark, sf):
    return events(spark, sf).select("event_id", T.bare_id(F.expr(FINDING_IDS)).alias("bare"))


@query("t12_summarize_error")
def t12(spark, sf):
    noisy = F.concat(F.lit("[0101/120000.123:ERROR:gpu.cc(1)] lost\n  \n"), F.col("text"))
    return documents(spark, sf).select("doc_id", F.md5(T.summarize_error(noisy)).alias("summary_md5"))


@query("t13_pct")
def t13(spark, sf):
    return documents(spark, sf).select("doc_id", T.pct(F.col("n_chars"), F.octet_length("text")).alias("pct"))


# ------------------------------------------------------------------ page extraction


def crawl(spark, sf):
    return C.crawled_pages(spark, sf)


def raw_query(name: str, build):
    """Register a query over every raw page; ``build(html)`` returns named columns."""

    def run(spark, sf):
        return crawl(spark, sf).select("page_index", *build(F.col("raw_html")))

    QUERIES[name] = run


raw_query("x1_strip_elements", lambda h: [F.md5(H.strip_elements(h, "script", "style", "nav", comments=True)).alias("stripped_md5")])
raw_query("x2_visible_text", lambda h: [F.md5(H.visible_text(h)).alias("text_md5"), T.utf16_len(H.visible_text(h)).alias("chars")])
raw_query("x4_content_body", lambda h: [F.md5(H.content_body(h)).alias("body_md5")])
raw_query("x9_html_headings", lambda h: [joined(H.html_heading_levels(h)).alias("levels")])
raw_query("x10_images", lambda h: [H.image_counts(h)["total"].alias("total"), H.image_counts(h)["with_alt"].alias("with_alt")])
raw_query("x15_redirect_markers", lambda h: [H.redirect_markers(h)["meta_refresh"].alias("meta_refresh"), H.redirect_markers(h)["js_redirect"].alias("js_redirect")])
raw_query("x16_login_markers", lambda h: [H.login_markers(h)["password_field"].alias("password_field"), H.login_markers(h)["signin_title"].alias("signin_title")])


@query("x3_html_to_markdown")
def x3(spark, sf):
    md = crawl(spark, sf).select("page_index", H.html_to_markdown(F.col("rendered_html")).alias("md"))
    return md.select("page_index", F.md5("md").alias("md_md5"), T.utf16_len(F.col("md")).alias("chars"))


def snippets(spark, sf):
    return crawl(spark, sf).select("page_index", H.snippet(F.col("raw_html")).alias("s"))


@query("x5_snippet")
def x5(spark, sf):
    return snippets(spark, sf).select(
        "page_index", "s.title", "s.description", "s.first_h1", "s.preview",
        sorted_text(F.col("s.og")).alias("og"), sorted_text(F.col("s.twitter")).alias("twitter"), F.array_join("s.json_ld", ",").alias("json_ld"),
    )


@query("x6_snippet_markdown")
def x6(spark, sf):
    return P.with_profiles(crawl(spark, sf)).select("page_index", F.col("snippet.markdown").alias("markdown"))


@query("x7_links")
def x7(spark, sf):
    links = raw_links(spark, sf).where(U.href_is_navigable(F.col("href"), "crawl"))
    return links.select(
        "site_id", "page_index", F.col("link_idx").cast("bigint").alias("link_idx"), "href",
        U.normalize_url(U.resolve_href(F.col("href"), F.col("src_url"))).alias("abs_url"),
    )


def raw_markdown(spark, sf):
    return crawl(spark, sf).select("page_index", H.html_to_markdown(F.col("raw_html")).alias("md"))


@query("x8_markdown_headings")
def x8(spark, sf):
    return raw_markdown(spark, sf).select("page_index", joined(H.markdown_heading_levels(F.col("md"))).alias("levels"))


@query("x11_fences")
def x11(spark, sf):
    return raw_markdown(spark, sf).select(
        "page_index", H.fence_counts(F.col("md")).alias("f"), F.array_join(H.json_blocks(F.col("md")), "|").alias("json_blocks")
    ).select("page_index", "f.fences", "f.tagged", "json_blocks")


@query("x12_tabs")
def x12(spark, sf):
    return crawl(spark, sf).select(
        "page_index", H.tab_markers(F.col("rendered_html")).alias("markers"), H.tab_panels(F.col("rendered_html")).alias("p")
    ).select("page_index", "markers", F.col("p.panels").alias("panels"), F.col("p.chars").alias("panel_chars"))


@query("x13_head_metadata")
def x13(spark, sf):
    return crawl(spark, sf).select("page_index", H.head_metadata(F.col("raw_html")).alias("m")).select("page_index", "m.*")


@query("x14_rendering_signals")
def x14(spark, sf):
    return crawl(spark, sf).select("page_index", H.rendering_signals(F.col("raw_html")).alias("r")).select("page_index", "r.*")


@query("x17_content_budget")
def x17(spark, sf):
    return crawl(spark, sf).select("page_index", F.explode(H.content_budget(F.col("raw_html"))).alias("b")).select(
        "page_index", "b.label", "b.bytes", F.round("b.pct", 6).alias("pct")
    )


@query("x18_link_rels")
def x18(spark, sf):
    header = F.get(F.col("headers")["link"], F.lit(0))
    return C.responses(spark, sf).where(header.isNotNull()).select("site_id", "seq", F.array_join(H.link_rels(header), ",").alias("rels"))


def wide(spark, sf):
    return P.with_profiles(crawl(spark, sf))


@query("x19_page_profiles")
def x19(spark, sf):
    return P.page_profiles(wide(spark, sf)).select(
        "site_id", "page_index", "profile", F.col("profile_ord").cast("bigint").alias("profile_ord"), "ok", "reason", "bytes", "chars", "tokens_est", F.md5("markdown").alias("md_md5"),
    )


# ------------------------------------------------------------------ page checks


def features(spark, sf, links: bool = False):
    return K.page_features(wide(spark, sf), links=links)


def check_columns(df: DataFrame) -> DataFrame:
    return df.select("site_id", "page_index", "check_id", "category", "severity", "conclusion", sorted_text(F.col("details")).alias("details"))


def check_query(name: str, check_id: str):
    def run(spark, sf):
        return check_columns(K.page_checks(features(spark, sf), [check_id]))

    QUERIES[name] = run


for _name, _id in [
    ("p1_rendering_strategy", "rendering-strategy"), ("p2_page_size_html", "page-size-html"),
    ("p3_page_size_markdown", "page-size-markdown"), ("p4_content_start", "content-start-position"),
    ("p5_heading_hierarchy", "heading-hierarchy"), ("p6_image_alt", "image-alt-coverage"),
    ("p7_code_fences", "markdown-code-fence-validity"), ("p8_json_blocks", "json-code-block-validity"),
    ("p9_metadata", "metadata-completeness"), ("p10_http_status", "http-status-codes"),
    ("p11_tabbed_content", "tabbed-content-serialization"),
]:
    check_query(_name, _id)


def link_features(spark, sf):
    """Features with links and the HEAD answers of their targets."""
    f = stage(features(spark, sf, links=True).select(*P.KEYS, "has_html", "links"), "page-links")
    return f, C.link_statuses(f.select(F.explode("links").alias("abs_url")))


@query("p12_link_integrity")
def p12(spark, sf):
    return check_columns(K.link_integrity(*link_features(spark, sf)))


@query("p12_link_integrity_all_links")
def p12_all(spark, sf):
    f, statuses = link_features(spark, sf)
    return check_columns(K.link_integrity(f, statuses, sample=None))
