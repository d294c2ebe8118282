"""Page-level checks: every page row becomes its check rows in one projection, without a shuffle.

``page_features`` reads each page text once and keeps what the checks need; the checks themselves
are CASE expressions over those features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.dims import RUBRIC
from auditlake.functions import html as H
from auditlake.functions import urls as U
from auditlake.functions.text import WS, is_valid_json, js_round, kb, let, pct, utf16_len
from auditlake.operators.profiles import KEYS
from auditlake.operators.windows import even_sample_index

TITLES = {cid: title for cid, title, _, _ in RUBRIC}
FIXES = {cid: fix for cid, _, _, fix in RUBRIC}

# Size limits (pass up to the first, warn up to the second).
SIZE_LIMITS = {
    "live": {"html_bytes": (1_000_000, 2_000_000), "markdown_chars": (100_000, 200_000)},
    "strict": {"html_bytes": (200_000, 500_000), "markdown_chars": (50_000, 100_000)},
}
# Keys that the links of one target are dealt over.
LINK_SALTS = 8
LINK_SAMPLE = 8


def heading_offset_pct(md: Column) -> Column:
    """Position of the first top heading as % of the markdown; NULL without one."""
    return let(
        F.regexp_instr(F.concat(F.lit("\n"), md), F.lit(rf"\n#{WS}+")),
        lambda at: F.when(
            at > 0, js_round(utf16_len(F.substring(md, F.lit(1), (at - 1).cast("int"))) / utf16_len(md) * 100)
        ),
    )


def distinct_page_links(html: Column, url: Column) -> Column:
    """Same-origin link targets of a page, fragment dropped, first appearance first, itself left out."""
    own = F.array(url, F.regexp_replace(url, r"/\z", ""))

    def of_base(base: Column) -> Column:
        targets = F.transform(
            F.array_distinct(F.filter(H.hrefs(html), lambda h: U.href_is_navigable(h, "check"))),
            lambda h: U.without_fragment(U.resolve_against(h, base)),
        )
        inside = F.filter(
            targets,
            lambda t: F.coalesce(
                t.startswith(base["origin"])
                & F.substring(t, F.length(base["origin"]) + 1, F.lit(1)).isin("/", "?", "")
                & ~F.array_contains(own, t),
                F.lit(False),
            ),
        )
        return F.array_distinct(inside)

    return let(U.base_parts(url), of_base)


def page_features(wide: DataFrame, links: bool = True, extra: list[Column] | None = None) -> DataFrame:
    """What the page checks read, one row per page; page texts are left behind."""
    md, raw = F.col("rawHttp.markdown"), F.col("rawHttp.artifact")
    checked = F.col("rawHttp.ok") & (md != "")
    with_html = F.col("rawHttp.ok") & (raw != "")
    both = F.col("rawHttp.ok") & F.col("headless.ok")
    columns = [
        F.col("rawHttp.ok").alias("raw_ok"),
        F.col("rawHttp.reason").alias("raw_reason"),
        F.col("headless.ok").alias("headless_ok"),
        F.col("rawHttp.bytes").alias("html_bytes"),
        F.col("rawHttp.chars").alias("raw_chars"),
        F.col("headless.chars").alias("headless_chars"),
        (md != "").alias("has_markdown"),
        with_html.alias("has_html"),
        F.when(checked, heading_offset_pct(md)).alias("h1_pct"),
        F.when(checked, H.markdown_heading_levels(md)).alias("levels"),
        F.when(with_html, H.image_counts(raw)).alias("images"),
        F.when(checked, H.fence_counts(md)).alias("fences"),
        F.when(checked, F.transform(H.json_blocks(md), is_valid_json)).alias("json_ok"),
        F.when(both, H.tab_markers(raw)).alias("tabs_raw"),
        F.when(both, H.tab_markers(F.col("headless.artifact"))).alias("tabs_headless"),
        F.col("snippet.ok").alias("snippet_ok"),
        F.col("snippet_data.title").isNotNull().alias("has_title"),
        F.coalesce(F.col("snippet_data.description") != "", F.lit(False)).alias("has_description"),
        F.size("snippet_data.og").cast("bigint").alias("og_count"),
    ]
    if links:
        columns.append(F.when(with_html, distinct_page_links(raw, F.col("url"))).alias("links"))
    return wide.select(*KEYS, *columns, *(extra or []))


# ---------------------------------------------------------------- check rows

FIELDS = "check_id STRING, category STRING, severity STRING, title STRING, message STRING, fix STRING, conclusion STRING, details MAP<STRING, STRING>"


def check_row(
    check_id: str, category: str, severity: Column, conclusion: Column, details: dict[str, Column] | None = None
) -> Column:
    """One check result; a NULL severity means that the check emits no row."""
    said = F.concat(F.lit(f"{TITLES[check_id]}: "), conclusion)
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map()
    return F.struct(
        F.lit(check_id).alias("check_id"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        F.lit(TITLES[check_id]).alias("title"),
        said.alias("message"),
        F.when(severity.isin("warn", "fail"), F.lit(FIXES[check_id])).alias("fix"),
        conclusion.alias("conclusion"),
        made.cast("map<string,string>").alias("details"),
    )


def text(*parts) -> Column:
    """Concatenation of literals and columns."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def graded(value: Column, passes: Column, warns: Column) -> Column:
    return F.when(value.isNull(), F.lit("info")).when(passes, F.lit("pass")).when(warns, F.lit("warn")).otherwise(F.lit("fail"))


def rendering_strategy() -> Column:
    raw, rendered = F.col("raw_chars"), F.col("headless_chars")
    ratio = F.when(F.col("raw_ok") & F.col("headless_ok"), F.when(rendered > 0, raw / rendered).otherwise(F.lit(1.0)))
    share = js_round(ratio * 100)
    return check_row(
        "rendering-strategy",
        "content-accessibility",
        graded(ratio, ratio >= 0.85, ratio >= 0.5),
        F.when(ratio.isNull(), F.lit("skipped, a profile failed")).otherwise(text("raw HTML holds ", share, "% of the rendered text")),
        {"raw_chars": raw, "headless_chars": rendered},
    )


def size_check(check_id: str, value: Column, limits: tuple[int, int], unit: str) -> Column:
    sized = F.when(F.col("raw_ok"), value)
    severity = F.when(sized.isNotNull(), graded(sized, sized <= limits[0], sized <= limits[1]))
    return check_row(check_id, "page-size", severity, text(kb(value), f" K {unit}"), {"count": value})


def page_size_html(ruleset: str = "live") -> Column:
    return size_check("page-size-html", F.col("html_bytes"), SIZE_LIMITS[ruleset]["html_bytes"], "bytes")


def page_size_markdown(ruleset: str = "live") -> Column:
    return size_check("page-size-markdown", F.col("raw_chars"), SIZE_LIMITS[ruleset]["markdown_chars"], "characters")


def content_start_position() -> Column:
    usable, at = F.col("raw_ok") & F.col("has_markdown"), F.col("h1_pct")
    severity = (
        F.when(~usable, F.lit("info"))
        .when(at.isNull(), F.lit("warn"))
        .otherwise(graded(at, at <= 30, at <= 50))
    )
    said = F.when(~usable, F.lit("skipped, no markdown")).when(at.isNull(), F.lit("no top heading")).otherwise(
        text("top heading at ", at, "%")
    )
    return check_row("content-start-position", "page-size", severity, said, {"start_pct": at})


def heading_hierarchy() -> Column:
    levels = F.col("levels")
    tops = F.size(F.filter(levels, lambda x: x == 1))
    jumps = H.level_jumps(levels)
    named = F.transform(jumps, lambda p: F.concat(F.lit("h"), p["a"].cast("string"), F.lit(">h"), p["b"].cast("string")))
    shown = F.concat(F.array_join(F.slice(named, 1, 3), ", "), F.when(F.size(jumps) > 3, F.lit("...")).otherwise(F.lit("")))
    severity = (
        F.when(levels.isNull(), F.lit("info"))
        .when((tops == 1) & (F.size(jumps) == 0), F.lit("pass"))
        .otherwise(F.lit("warn"))
    )
    said = F.when(levels.isNull(), F.lit("skipped, no markdown")).otherwise(
        text(tops, " top headings, ", F.size(jumps), " level skips", F.when(F.size(jumps) > 0, F.concat(F.lit(": "), shown)).otherwise(F.lit("")))
    )
    return check_row("heading-hierarchy", "content-structure", severity, said, {"h1_count": F.when(levels.isNotNull(), tops)})


def image_alt_coverage() -> Column:
    total, with_alt = F.col("images.total"), F.col("images.with_alt")
    covered = pct(with_alt, total)
    severity = (
        F.when(total.isNull(), F.lit("info"))
        .when(total == 0, F.lit("pass"))
        .otherwise(graded(covered, covered == 100, covered >= 80))
    )
    said = F.when(total.isNull(), F.lit("skipped, no HTML")).when(total == 0, F.lit("no images")).otherwise(
        text(with_alt, "/", total, " images described")
    )
    return check_row("image-alt-coverage", "content-structure", severity, said, {"total": total, "with_alt": with_alt})


def code_fences() -> Column:
    fences, tagged = F.col("fences.fences"), F.col("fences.tagged")
    opens = F.ceil(fences / 2)
    covered = pct(tagged, opens)
    severity = (
        F.when(fences.isNull(), F.lit("info"))
        .when(fences % 2 == 1, F.lit("fail"))
        .when(fences == 0, F.lit("pass"))
        .when(covered >= 90, F.lit("pass"))
        .otherwise(F.lit("warn"))
    )
    said = (
        F.when(fences.isNull(), F.lit("skipped, no markdown"))
        .when(fences % 2 == 1, text(fences, " fences, one left open"))
        .when(fences == 0, F.lit("no code blocks"))
        .otherwise(text(tagged, "/", opens, " code blocks name a language"))
    )
    return check_row("markdown-code-fence-validity", "content-structure", severity, said, {"fences": fences})


def json_code_blocks() -> Column:
    ok = F.col("json_ok")
    bad = F.size(F.filter(ok, lambda x: ~x))
    severity = F.when(ok.isNull(), F.lit("info")).when(bad == 0, F.lit("pass")).otherwise(F.lit("warn"))
    said = (
        F.when(ok.isNull(), F.lit("skipped, no markdown"))
        .when(F.size(ok) == 0, F.lit("no JSON blocks"))
        .otherwise(text(bad, "/", F.size(ok), " JSON blocks do not parse"))
    )
    return check_row("json-code-block-validity", "content-structure", severity, said, {"total": F.when(ok.isNotNull(), F.size(ok))})


def metadata_completeness() -> Column:
    have = F.col("has_title"), F.col("has_description"), F.col("og_count") >= 2
    score = sum((F.when(h, 1).otherwise(0) for h in have), F.lit(0))
    severity = (
        F.when(~F.col("snippet_ok"), F.lit("info"))
        .when(score == 3, F.lit("pass"))
        .when(score == 0, F.lit("fail"))
        .otherwise(F.lit("warn"))
    )
    missing = F.array_compact(
        F.array(*[F.when(~h, F.lit(name)) for h, name in zip(have, ["title", "description", "Open Graph tags"])])
    )
    said = F.when(~F.col("snippet_ok"), F.lit("skipped, no snippet")).when(score == 3, F.lit("complete")).otherwise(
        F.concat(F.lit("missing "), F.array_join(missing, ", "))
    )
    return check_row("metadata-completeness", "content-quality", severity, said, {"og_count": F.when(F.col("snippet_ok"), F.col("og_count"))})


def http_status() -> Column:
    ok = F.col("raw_ok")
    severity = F.when(ok.isNull(), F.lit("info")).when(ok, F.lit("pass")).otherwise(F.lit("fail"))
    said = (
        F.when(ok.isNull(), F.lit("skipped, no raw profile"))
        .when(ok, F.lit("good status"))
        .otherwise(F.concat(F.lit("bad status: "), F.coalesce("raw_reason", F.lit("unknown"))))
    )
    return check_row("http-status-codes", "url-stability", severity, said, {"reason": F.col("raw_reason")})


def tabbed_content() -> Column:
    raw, rendered = F.col("tabs_raw"), F.col("tabs_headless")
    severity = (
        F.when(rendered.isNull(), F.lit("info"))
        .when((rendered == 0) | (raw >= rendered * 0.8), F.lit("pass"))
        .otherwise(F.lit("warn"))
    )
    said = (
        F.when(rendered.isNull(), F.lit("skipped, a profile failed"))
        .when(rendered == 0, F.lit("no tabs"))
        .otherwise(text(raw, "/", rendered, " tab markers in raw HTML"))
    )
    return check_row("tabbed-content-serialization", "content-structure", severity, said, {"raw": raw, "headless": rendered})


LIVE_CHECKS: dict[str, Callable[[], Column]] = {
    "rendering-strategy": rendering_strategy,
    "page-size-html": page_size_html,
    "page-size-markdown": page_size_markdown,
    "content-start-position": content_start_position,
    "heading-hierarchy": heading_hierarchy,
    "image-alt-coverage": image_alt_coverage,
    "markdown-code-fence-validity": code_fences,
    "json-code-block-validity": json_code_blocks,
    "metadata-completeness": metadata_completeness,
    "http-status-codes": http_status,
    "tabbed-content-serialization": tabbed_content,
}


def register_check(check_id: str, build: Callable[[], Column]) -> None:
    """Add or replace a page check; ``build`` returns a ``check_row`` over the feature columns."""
    LIVE_CHECKS[check_id] = build


def explode_checks(features: DataFrame, checks: list[Column], keys: list[str] = KEYS) -> DataFrame:
    numbered = [F.struct(F.lit(i).alias("source_ord"), c.alias("c")) for i, c in enumerate(checks)]
    rows = features.select(*keys, F.explode(F.array(*numbered)).alias("r")).select(*keys, "r.source_ord", "r.c.*")
    return rows.where(F.col("severity").isNotNull())


def page_checks(features: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Rows of the registered checks for every page (the link check joins, see ``link_integrity``)."""
    chosen = only or list(LIVE_CHECKS)
    return explode_checks(features, [LIVE_CHECKS[c]() for c in chosen]).withColumnRenamed("url", "page_url")


# ---------------------------------------------------------------- links against statuses


def sampled_links(features: DataFrame, sample: int | None = LINK_SAMPLE) -> DataFrame:
    """Links to look up: an even sample per page taken inside the row, or all of them.

    Sampling before the join sends at most ``sample`` rows per page through the shuffle.
    """
    links = F.col("links")
    n = F.size(links)
    chosen = links if sample is None else F.transform(even_sample_index(n, sample), lambda i: F.get(links, i))
    return features.where(n > 0).select(*KEYS, n.alias("total"), F.posexplode(chosen).alias("link_pos", "link_url"))


def look_up(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Links with ``link_status`` and ``broken``; a target without a response counts as broken.

    A home page is linked from everywhere. Its links are dealt over ``LINK_SALTS`` keys by page, and
    each target's one status row is repeated for all of them, so no task holds all links of a target.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(LINK_SALTS - 1))).alias("_salt")
    known = statuses.select(F.col("url").alias("link_url"), F.col("status").alias("link_status"), salts)
    dealt = links.withColumn("_salt", F.pmod(F.xxhash64(*KEYS), F.lit(LINK_SALTS)).cast("int"))
    looked_up = dealt.join(known, ["link_url", "_salt"], "left").drop("_salt")
    return looked_up.withColumn("broken", F.coalesce(F.col("link_status"), F.lit(0)).isin(0) | (F.col("link_status") >= 400))


def _broken_counts(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per page: links looked up, how many are broken and the first three of those."""
    ranked = look_up(links, statuses).withColumn("_nth", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("broken"), "link_pos")))
    # Broken links come first, so only rows of the first three places can be examples.
    example = F.when(F.col("broken") & (F.col("_nth") <= 3), F.struct("link_pos", "link_url"))
    return ranked.groupBy(*KEYS).agg(
        F.first("total").alias("total"),
        F.count(F.lit(1)).alias("sampled"),
        F.count_if("broken").alias("broken"),
        F.array_sort(F.collect_list(example)).alias("examples"),
    )


def link_integrity(features: DataFrame, statuses: DataFrame, sample: int | None = LINK_SAMPLE) -> DataFrame:
    """Check rows of the internal-link check for every page."""
    counts = _broken_counts(sampled_links(features, sample), statuses)
    page = features.select(*KEYS, "has_html", U.origin_of(F.col("url")).isNotNull().alias("parses"), F.size(F.coalesce("links", F.array().cast("array<string>"))).alias("n_links"))
    joined = page.join(counts, KEYS, "left")
    broken, sampled = F.coalesce("broken", F.lit(0)), F.col("sampled")
    share = pct(broken, sampled)
    severity = (
        F.when(~F.col("has_html") | ~F.col("parses"), F.lit("info"))
        .when(broken == 0, F.lit("pass"))
        .when(share <= 25, F.lit("warn"))
        .otherwise(F.lit("fail"))
    )
    said = (
        F.when(~F.col("has_html"), F.lit("skipped, no HTML"))
        .when(~F.col("parses"), F.lit("skipped, the page's URL does not parse"))
        .when(F.col("n_links") == 0, F.lit("no internal links"))
        .otherwise(text(broken, "/", sampled, " looked-up links broken"))
    )
    examples = F.array_join(F.transform("examples", lambda e: e["link_url"]), ", ")
    row = check_row(
        "internal-link-integrity", "content-structure", severity, said,
        {"total": F.col("total"), "sampled": sampled, "examples": F.when(broken > 0, examples)},
    )
    return explode_checks(joined, [row]).withColumn("source_ord", F.lit(len(LIVE_CHECKS))).withColumnRenamed("url", "page_url")
