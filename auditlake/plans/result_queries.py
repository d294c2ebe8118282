"""Registered queries of rollups, findings, scores, classifications and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.dims import PROFILES, dim_category, dim_check, with_axis
from auditlake.functions import urls as U
from auditlake.operators import findings as N
from auditlake.operators import page_checks as K
from auditlake.operators import profiles as P
from auditlake.operators import rollup as R
from auditlake.operators import scoring as G
from auditlake.operators import windows as W
from auditlake.plans import audit as A
from auditlake.plans import corpus as C
from auditlake.plans.flagship import rendering_by_site
from auditlake.plans.queries import QUERIES, crawl, documents, events, features, joined, link_features, query, raw_links, wide
from auditlake.plans.site_queries import all_site_checks
from auditlake.session import stage

SITE = ["run_id", "site_id"]


def big(name: str, alias: str | None = None):
    return F.col(name).cast("bigint").alias(alias or name)


QUERIES["flagship_rendering_by_site"] = rendering_by_site

# ------------------------------------------------------------------ profiles compared


@query("g1_page_diff")
def g1(spark, sf):
    return P.page_diff(wide(spark, sf)).select(
        "page_index", "largest_profile", *[F.round(F.col("chars_fraction")[p], 6).alias(f"share_{p}") for p in PROFILES],
        F.round("js_gated_fraction", 6).alias("js_gated"),
    )


@query("g1_page_diff_stored")
def g1_stored(spark, sf):
    return P.page_diff_long(P.page_profiles(wide(spark, sf))).select(
        "page_index", "largest_profile", *[F.round(F.col("chars_fraction")[p], 6).alias(f"share_{p}") for p in PROFILES],
        F.round("js_gated_fraction", 6).alias("js_gated"),
    )


@query("j1_profile_pivot")
def j1(spark, sf):
    return P.pivot_profiles(P.page_profiles(wide(spark, sf))).select("page_index", *[F.col(p) for p in PROFILES])


@query("g2_site_stats")
def g2(spark, sf):
    return P.site_stats(wide(spark, sf)).select(
        "site_id", "pages_scanned", F.round("avg_js_gated_fraction", 6).alias("avg_js_gated"), *[f"avg_tokens_{p}" for p in PROFILES]
    )


@query("d3_profile_status")
def d3(spark, sf):
    return P.profile_statuses(P.site_stats(wide(spark, sf))).select("site_id", "profile", "tokens", "status")


@query("d4_skipped_profiles")
def d4(spark, sf):
    # The wide rows are read for the statistics and for the first page of each site.
    narrow = stage(wide(spark, sf).select(*P.KEYS, *[F.col(p).dropFields("markdown", "artifact").alias(p) for p in PROFILES]), "narrow")
    return P.with_skips(P.profile_statuses(P.site_stats(narrow)), P.skipped_profiles(narrow)).select("site_id", "profile", "status", "skip_reason")


@query("d6_divergence")
def d6(spark, sf):
    return P.page_divergence(wide(spark, sf)).select("page_index", "divergence_pct", "show_divergence")


@query("d7_spread_tone")
def d7(spark, sf):
    raw = F.when(F.col("rawHttp.ok"), F.col("rawHttp.chars"))
    return wide(spark, sf).select("page_index", P.spread_tone(raw, F.col("headless.chars")).alias("tone"))


@query("d9_page_matrix")
def d9(spark, sf):
    m = P.page_matrix(wide(spark, sf))
    return m.select(
        "page_index", *[f"chars_{p}" for p in PROFILES], *[f"tokens_{p}" for p in PROFILES],
        *[F.round(f"share_{p}", 6).alias(f"share_{p}") for p in PROFILES],
    )


# ------------------------------------------------------------------ rollups and findings


def page_rows(spark, sf):
    """All page checks of all pages, over features that are staged once."""
    f = stage(features(spark, sf, links=True), "features")
    return stage(A.page_check_rows(f, C.link_statuses(f.select(F.explode("links").alias("abs_url")))), "page-checks")


def rollup(spark, sf):
    return R.rollup_checks(page_rows(spark, sf))


def site_rows(spark, sf):
    return all_site_checks(spark, sf)


def all_findings(spark, sf):
    return N.site_findings(site_rows(spark, sf)).unionByName(N.page_findings(rollup(spark, sf)))


def merged(spark, sf):
    return N.merge_findings(all_findings(spark, sf))


def all_checks(spark, sf):
    return A.union_checks(site_rows(spark, sf), rollup(spark, sf))


@query("g3_check_rollup")
def g3(spark, sf):
    return rollup(spark, sf).select(
        "site_id", "check_id", "severity", "total", "n_fail", "n_warn", "n_pass", "n_info", "message", "conclusion",
        "rep_conclusion", big("source_ord"),
    )


@query("g3_affected_pages")
def g3_affected(spark, sf):
    rows = stage(page_rows(spark, sf), "page-checks")
    return R.affected_pages(rows, R.rollup_checks(rows)).select("site_id", "check_id", "severity", "page_index", "page_url")


@query("g4_page_findings")
def g4(spark, sf):
    return N.page_findings(rollup(spark, sf)).select("site_id", "seq", "finding_id", "severity", "evidence", "fix_hint", "page_url", "occurrences")


@query("g5_site_findings")
def g5(spark, sf):
    return N.site_findings(site_rows(spark, sf)).select("site_id", "seq", "finding_id", "severity", "evidence", "fix_hint", "page_url", "occurrences")


@query("o4_check_union")
def o4(spark, sf):
    return all_checks(spark, sf).select("site_id", "seq", "check_id", "category", "severity", "conclusion", "page_url")


def run_findings(spark, sf):
    """Findings of stored event logs: every event is one occurrence of a finding of its run."""
    seq = F.col("event_id")
    return events(spark, sf).select(
        F.lit(C.RUN_ID).alias("run_id"), F.concat(F.lit("user-"), "user_id").alias("site_id"), seq.alias("seq"),
        F.concat(F.lit("check:"), F.element_at(F.array(*[F.lit(c) for c, *_ in FINDING_RUBRIC]), (F.get_json_object("props", "$.k").cast("int") % 9 + 1))).alias("finding_id"),
        F.concat(F.lit("t"), seq).alias("title"),
        F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "info").otherwise("warn").alias("severity"),
        F.when(F.col("event_type") == "view", "diff").otherwise("check").alias("source"),
        F.concat(F.lit("e"), seq).alias("evidence"), F.lit("").alias("fix_hint"), F.lit("").alias("page_url"),
        (F.floor("value").cast("bigint") % 3 + 1).alias("occurrences"), F.lit("").alias("conclusion"),
    )


FINDING_RUBRIC = [
    ("llms-txt-exists",), ("sitemap",), ("robots-txt",), ("page-size-html",), ("metadata-completeness",), ("link-headers",),
    ("cache-headers",), ("unknown-check",), ("heading-hierarchy",),
]


@query("g6_merged_findings")
def g6(spark, sf):
    return N.merge_findings(run_findings(spark, sf)).select(
        "site_id", "finding_id", "seq", "occurrences", "title", "severity", "source", "evidence", F.array_join("affected_profiles", ",").alias("profiles")
    )


@query("w1_ranked_findings")
def w1(spark, sf):
    return N.rank_findings(N.merge_findings(run_findings(spark, sf))).select("site_id", "finding_id", "severity", "source", "occurrences", big("rank"))


@query("w1_ranked_audit_findings")
def w1_audit(spark, sf):
    return N.rank_findings(merged(spark, sf)).select("site_id", "finding_id", "severity", "occurrences", big("rank"))


@query("j5_attribution")
def j5(spark, sf):
    found = run_findings(spark, sf).select("seq", "finding_id")
    loose = N.attribute(found).select("seq", "finding_id", F.array_join("affected_profiles", ",").alias("profiles"))
    return N.attribute(loose, exact_ids=True).select("seq", "profiles", F.array_join("affected_profiles", ",").alias("profiles_exact"))


@query("j6_fix_copy")
def j6(spark, sf):
    found = run_findings(spark, sf).select("seq", N.bare_id(F.col("finding_id")).alias("check_id"))
    return found.join(F.broadcast(dim_check(spark)), "check_id").select("seq", "check_id", "label", "fix_short")


@query("g7_category_scores")
def g7(spark, sf):
    return G.category_scores(all_checks(spark, sf)).select("site_id", "category", big("weight"), "score")


@query("g7_weighted_score")
def g7w(spark, sf):
    return G.weighted_score(G.category_scores(all_checks(spark, sf))).select("site_id", "overall", "grade")


@query("j7_category_weights")
def j7(spark, sf):
    counted = site_rows(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("checks"))
    return dim_category(spark).join(counted, "category", "left").select("category", big("weight"), F.coalesce("checks", F.lit(0)).alias("checks"))


@query("g8_live_score")
def g8(spark, sf):
    return A.live_scores(C.sites(spark, sf), merged(spark, sf)).select("site_id", "n_fail", "n_warn", "score", "grade")


@query("d1_grade")
def d1(spark, sf):
    return documents(spark, sf).select("doc_id", G.grade(F.col("n_chars") % 101).alias("grade"))


@query("d2_band")
def d2(spark, sf):
    b = G.band(F.floor("value").cast("bigint") % 4, F.col("event_id") % 7)
    return events(spark, sf).select("event_id", b["label"].alias("label"), b["tone"].alias("tone"))


@query("d5_reader_shares")
def d5(spark, sf):
    m = stage(merged(spark, sf), "merged")
    clean = G.clean_share(N.findings_per_profile(m), all_site_checks(spark, sf)).select("site_id", "profile", "clean_pct")
    shares = P.profile_statuses(P.site_stats(wide(spark, sf))).select("site_id", "profile", "retrieval_pct")
    return clean.join(shares, ["site_id", "profile"])


@query("d8_verdict")
def d8(spark, sf):
    scores = A.live_scores(C.sites(spark, sf), merged(spark, sf))
    said = G.profile_sentence(P.profile_statuses(P.site_stats(wide(spark, sf))))
    return scores.join(said, SITE).select("site_id", G.verdict(F.col("n_fail") + F.col("n_warn")).alias("verdict"), "sentence")


@query("d10_sanitize_cap")
def d10(spark, sf):
    cap = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, -F.col("value")).otherwise(F.col("value"))
    return events(spark, sf).select("event_id", W.sanitize_cap(cap).alias("cap"))


@query("g9_common_issues")
def g9(spark, sf):
    rows = stage(page_rows(spark, sf), "page-checks")
    return R.common_issues(rows).select("site_id", "check_id", "count", "message", F.array_join("example_urls", " ").alias("example_urls"))


@query("g10_findings_per_profile")
def g10(spark, sf):
    return N.findings_per_profile(merged(spark, sf)).select("site_id", *PROFILES, "general")


@query("j4_check_axis")
def j4(spark, sf):
    return with_axis(site_rows(spark, sf)).select("site_id", "check_id", "axis")


@query("g11_counts_by_axis")
def g11(spark, sf):
    return G.counts_by_axis(all_checks(spark, sf)).select("site_id", "axis", "fail", "warn", "total")


@query("g11_counts_by_severity")
def g11s(spark, sf):
    return G.counts_by_severity(all_checks(spark, sf)).select("site_id", "total", "n_fail", "n_warn", "n_pass", "n_info")


@query("g12_applicability")
def g12(spark, sf):
    sites, pages = stage(site_rows(spark, sf), "site-checks"), stage(rollup(spark, sf), "rollup")
    found = N.merge_findings(N.site_findings(sites).unionByName(N.page_findings(pages)))
    return G.applicability(A.union_checks(sites, pages), found).select("site_id", "applicable", "inapplicable", "passing", "passing_pct")


@query("g14_fix_backlog")
def g14(spark, sf):
    return N.fix_backlog(N.merge_findings(run_findings(spark, sf))).select("site_id", "fix_backlog")


@query("g15_report")
def g15(spark, sf):
    m = stage(merged(spark, sf), "merged")
    return N.report(m, A.live_scores(C.sites(spark, sf), m), C.sites(spark, sf)).select("site_id", "report")


# ------------------------------------------------------------------ orderings and sets


@query("w2_first_seen")
def w2(spark, sf):
    links = raw_links(spark, sf).select("site_id", "href", big("page_index"), big("link_idx"))
    return W.first_seen(links, ["site_id", "href"], "page_index", "link_idx")


@query("w3_cap_per_site")
def w3(spark, sf):
    return W.cap_per_site(C.site_pages(spark, sf), 5, ["site_id"], "page_index").select("site_id", "url", big("page_index"), "capped")


@query("w4_even_sample")
def w4(spark, sf):
    n = F.col("n_chars") % 200
    return documents(spark, sf).select("doc_id", joined(W.even_sample_index(n)).alias("sample"))


@query("w5_history")
def w5(spark, sf):
    runs = events(spark, sf).select(
        F.concat(F.lit("https://site-"), "user_id", F.lit(".example.com")).alias("url"), F.floor("value").cast("bigint").alias("overall"),
        F.col("event_type").alias("grade"), F.col("ts").alias("scanned_at"), F.col("event_id").alias("seq"),
    )
    return W.newest_per_url(runs).select("url", "grade", "overall", "seq")


@query("w6_feed_order")
def w6(spark, sf):
    progress = C.site_pages(spark, sf).select(
        "site_id", "url", "page_index", (F.col("page_id") % 3 == 0).alias("done"), (F.col("page_id") % 3 == 1).alias("started")
    )
    return W.feed_order(progress, ["site_id"]).select("site_id", "url", "feed_status", big("feed_pos"))


@query("w7_check_list")
def w7(spark, sf):
    rows = site_rows(spark, sf).withColumn("seq", F.col("source_ord"))
    return G.check_list(rows, axis="agent").select("site_id", "check_id", "severity", big("severity_ord"), big("seq"))


@query("w8_heading_jumps")
def w8(spark, sf):
    from auditlake.functions import html as H

    levels = H.html_heading_levels(F.col("rendered_html"))
    return crawl(spark, sf).select("page_index", F.posexplode(H.level_jumps(levels)).alias("pos", "p")).select(
        "page_index", big("pos"), big("p.a", "from_level"), big("p.b", "to_level")
    )


@query("w9_rubric_usage")
def w9(spark, sf):
    return G.rubric_usage(site_rows(spark, sf)).select("axis", "rubric_title", "check_id", "n", "n_fail")


@query("w10_result_pages")
def w10(spark, sf):
    pages = C.site_pages(spark, sf).withColumn("done", F.col("page_id") % 3 != 2)
    return pages.where("done").orderBy("site_id", "page_index").select("site_id", big("page_index"), "url")


@query("o1_distinct_links")
def o1(spark, sf):
    links = raw_links(spark, sf).select("site_id", U.without_fragment(U.resolve_href(F.col("href"), F.col("src_url"))).alias("url"))
    return links.dropDuplicates(["site_id", "url"])


@query("o5_self_exclusion")
def o5(spark, sf):
    f = features(spark, sf, links=True)
    return f.select("page_index", F.posexplode("links").alias("pos", "link_url")).select("page_index", big("pos"), "link_url")


@query("j8_links_with_status")
def j8(spark, sf):
    f, statuses = link_features(spark, sf)
    sampled = K.sampled_links(f)
    return K.look_up(sampled, statuses).select("page_index", big("link_pos"), "link_url", big("link_status").alias("status"), "broken")
