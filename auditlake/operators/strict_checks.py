"""The strict ruleset: the older, harder page checks, over the same pages.

Input is ``with_profiles`` output plus ``redirect_chain`` and ``link_header`` per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.dims import SSO_HOSTS
from auditlake.functions import html as H
from auditlake.functions import urls as U
from auditlake.functions.text import content_start_pct, is_valid_json, js_trim, let, thousands, utf16_len
from auditlake.operators.page_checks import SIZE_LIMITS, check_row, explode_checks, graded, look_up, size_check, text
from auditlake.operators.profiles import KEYS

CONTENT_LINKS = 20


def open_fences(md: Column) -> Column:
    """Line numbers of code fences left open.

    Lines are folded with a stack: a fence closes the topmost one if it has the same character and
    is at least as long, else it opens another.
    """
    lines = F.transform(
        F.split(md, "\n"),
        lambda line, i: F.struct((i + 1).alias("line"), F.regexp_extract(line, r"^\s{0,3}(`{3,}|~{3,})", 1).alias("mark")),
    )
    empty = F.array().cast("array<struct<line: int, mark: string>>")

    def step(stack: Column, fence: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        closes = (F.left(top["mark"], F.lit(1)) == F.left(fence["mark"], F.lit(1))) & (
            F.length(fence["mark"]) >= F.length(top["mark"])
        )
        return F.when(F.coalesce(closes, F.lit(False)), F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(
            F.concat(stack, F.array(fence))
        )

    fences = F.filter(lines, lambda x: x["mark"] != "")
    return F.transform(F.aggregate(fences, empty, step), lambda x: x["line"])


def content_links(html: Column, url: Column) -> Column:
    """Same-host link targets outside navigation, in order of first appearance."""
    quiet = H.strip_elements(html, "nav", "header", "footer")

    def of_base(base: Column) -> Column:
        targets = F.transform(
            F.array_distinct(F.filter(H.hrefs(quiet), lambda h: (h != "") & ~h.startswith("#") & ~h.rlike("^(?:mailto|tel):"))),
            lambda h: U.without_fragment(U.resolve_against(h, base)),
        )
        host = F.regexp_extract(base["origin"], r"://(.*)", 1)
        return F.array_distinct(F.filter(targets, lambda t: F.coalesce(U.authority_of(t) == host, F.lit(False))))

    return let(U.base_parts(url), of_base)


def strict_features(wide: DataFrame) -> DataFrame:
    """What the strict checks read; page texts are left behind. Only pages that were served."""
    md, html = F.col("rawHttp.markdown"), F.col("rawHttp.artifact")
    quiet = H.strip_elements(html, "script", "style", "noscript", "nav", "header", "footer", comments=True)
    alts = F.transform(H.tags_of(quiet, "img"), lambda t: js_trim(H.attr(t, "alt")))
    blocks = F.arrays_zip(
        F.regexp_extract_all(md, F.lit(r"(?s)```(json|yaml)\n(.*?)```"), F.lit(1)).alias("lang"),
        F.regexp_extract_all(md, F.lit(r"(?s)```(json|yaml)\n(.*?)```"), F.lit(2)).alias("body"),
    )
    rows = wide.where(F.col("rawHttp.ok")).select(
        *KEYS,
        F.lit(True).alias("raw_ok"),
        F.col("rawHttp.bytes").alias("html_bytes"),
        F.col("rawHttp.chars").alias("raw_chars"),
        content_start_pct(md).alias("start_pct"),
        H.html_heading_levels(html).alias("levels"),
        alts.alias("alts"),
        H.head_metadata(html).alias("head"),
        F.transform(blocks, lambda b: (b["lang"] == "yaml") | is_valid_json(b["body"])).alias("blocks_ok"),
        H.rendering_signals(html).alias("signals"),
        H.tab_panels(html).alias("panels"),
        open_fences(md).alias("open_fences"),
        H.redirect_markers(html)["meta_refresh"].alias("meta_refresh"),
        html.rlike(r"window\.location\s*=").alias("script_redirect"),
        H.login_markers(html).alias("login"),
        content_links(html, F.col("url")).alias("links"),
        "redirect_chain",
        "link_header",
    )
    return rows


def _size_html() -> Column:
    return size_check("page-size-html", F.col("html_bytes"), SIZE_LIMITS["strict"]["html_bytes"], "bytes")


def _size_markdown() -> Column:
    return size_check("page-size-markdown", F.col("raw_chars"), SIZE_LIMITS["strict"]["markdown_chars"], "characters")


def _content_start() -> Column:
    at = F.col("start_pct")
    return check_row("content-start-position", "page-size", graded(at, at <= 10, at <= 50), text("content starts at ", at, "%"))


def _headings() -> Column:
    levels = F.col("levels")
    tops, jumps = F.size(F.filter(levels, lambda x: x == 1)), F.size(H.level_jumps(levels))
    severity = F.when(tops == 0, "fail").when((tops == 1) & (jumps == 0), "pass").otherwise("warn")
    return check_row("heading-hierarchy", "content-structure", severity, text(tops, " top headings, ", jumps, " level skips"))


def _images() -> Column:
    total = F.size("alts")
    missing = F.size(F.filter("alts", lambda a: utf16_len(a) < 2))
    severity = (
        F.when(total == 0, "info").when(missing == 0, "pass").when(missing / total > 0.5, "fail").otherwise("warn")
    )
    said = F.when(total == 0, F.lit("no images in the content")).otherwise(text(missing, "/", total, " images without description"))
    return check_row("image-alt-coverage", "content-structure", severity, said)


def _metadata() -> Column:
    head = F.col("head")
    missing = F.array_compact(
        F.array(
            F.when(utf16_len(head["title"]) < 4, F.lit("title")),
            F.when(head["description"] == "", F.lit("description")),
            F.when(head["canonical"] == "", F.lit("canonical link")),
            F.when(head["og_title"] == "", F.lit("og:title")),
        )
    )
    n = F.size(missing)
    severity = F.when(n == 0, "pass").when(n >= 3, "fail").otherwise("warn")
    said = F.when(n == 0, F.lit("complete")).otherwise(F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return check_row("metadata-completeness", "discoverability", severity, said)


def _blocks() -> Column:
    total, bad = F.size("blocks_ok"), F.size(F.filter("blocks_ok", lambda ok: ~ok))
    severity = F.when(total == 0, "info").when(bad == 0, "pass").otherwise("warn")
    said = F.when(total == 0, F.lit("no JSON or YAML blocks")).otherwise(text(bad, "/", total, " blocks do not parse"))
    return check_row("json-code-block-validity", "content-structure", severity, said)


def _rendering() -> Column:
    s = F.col("signals")
    n = s["headings"] + s["paragraphs"] + s["code_blocks"]
    severity = (
        F.when((n >= 5) & (s["text_chars"] > 2000), "pass")
        .when(s["framework"].isNotNull() & (n < 3) & (s["text_chars"] < 500), "fail")
        .otherwise("warn")
    )
    shell = F.when(s["framework"].isNotNull(), F.concat(F.lit(", "), s["framework"], F.lit(" shell"))).otherwise(F.lit(""))
    return check_row("rendering-strategy", "page-size", severity, text(n, " elements, ", s["text_chars"], " characters", shell))


def _panels() -> Column:
    n, chars = F.col("panels.panels"), F.col("panels.chars")
    severity = F.when(n == 0, F.lit("pass")).otherwise(graded(chars, chars <= 50_000, chars <= 100_000))
    said = F.when(n == 0, F.lit("no tab panels")).otherwise(text(n, " tab panels, ", thousands(chars), " K characters"))
    return check_row("tabbed-content-serialization", "content-structure", severity, said)


def _fences() -> Column:
    n = F.size("open_fences")
    said = F.when(n == 0, F.lit("every fence is closed")).otherwise(
        text(n, " fences left open at line ", F.array_join(F.transform("open_fences", lambda x: x.cast("string")), ", "))
    )
    return check_row("markdown-code-fence-validity", "content-structure", F.when(n == 0, "pass").otherwise("fail"), said)


def _redirects() -> Column:
    hops = F.size("redirect_chain")
    crosses = F.exists("redirect_chain", lambda h: ~h["same_host"])
    client_side = (hops == 0) & (F.col("meta_refresh") | F.col("script_redirect"))
    severity = F.when(client_side, "fail").when(crosses, "warn").otherwise("pass")
    said = F.when(client_side, F.lit("redirect in the page")).otherwise(text(hops, " hops", F.when(crosses, F.lit(" across hosts")).otherwise(F.lit(""))))
    return check_row("redirect-behavior", "url-stability", severity, said)


def _auth() -> Column:
    to_sso = F.exists("redirect_chain", lambda h: _any_contains(h["to_url"]))
    wall = F.col("login.password_field") & F.col("login.signin_title")
    said = F.when(to_sso, F.lit("single sign-on")).when(wall, F.lit("login form")).otherwise(F.lit("open"))
    return check_row("auth-gate-detection", "authentication", F.when(to_sso | wall, "fail").otherwise("pass"), said)


def _any_contains(url: Column) -> Column:
    hit = F.lit(False)
    for host in SSO_HOSTS:
        hit = hit | url.contains(host)
    return hit


def _api_catalog() -> Column:
    found = F.coalesce(F.col("link_header").rlike(r"""rel=["']?api-catalog["']?"""), F.lit(False))
    said = F.when(found, F.lit("announced")).otherwise(F.lit("not announced"))
    return check_row("link-header-api-catalog", "capability-discovery", F.when(found, "pass").otherwise("info"), said)


STRICT_CHECKS = {
    "page-size-html": _size_html,
    "page-size-markdown": _size_markdown,
    "content-start-position": _content_start,
    "heading-hierarchy": _headings,
    "image-alt-coverage": _images,
    "metadata-completeness": _metadata,
    "json-code-block-validity": _blocks,
    "rendering-strategy": _rendering,
    "tabbed-content-serialization": _panels,
    "markdown-code-fence-validity": _fences,
    "redirect-behavior": _redirects,
    "auth-gate-detection": _auth,
    "link-header-api-catalog": _api_catalog,
}


def strict_checks(features: DataFrame, only: list[str] | None = None) -> DataFrame:
    chosen = only or list(STRICT_CHECKS)
    return explode_checks(features, [STRICT_CHECKS[c]() for c in chosen]).withColumnRenamed("url", "page_url")


def strict_link_integrity(features: DataFrame, statuses: DataFrame) -> DataFrame:
    """First links of the content against their statuses; more than a fifth broken fails."""
    first = features.select(*KEYS, F.explode(F.slice("links", 1, CONTENT_LINKS)).alias("link_url"))
    counts = look_up(first, statuses).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("sampled"), F.count_if("broken").alias("broken"))
    joined = features.select(*KEYS).join(counts, KEYS, "left")
    broken, sampled = F.col("broken"), F.col("sampled")
    severity = (
        F.when(sampled.isNull(), "info").when(broken == 0, "pass").when(broken / sampled > 0.2, "fail").otherwise("warn")
    )
    said = F.when(sampled.isNull(), F.lit("no links in the content")).otherwise(text(broken, "/", sampled, " links broken"))
    row = check_row("internal-link-integrity", "url-stability", severity, said)
    return explode_checks(joined, [row]).withColumnRenamed("url", "page_url")
