"""Registered queries of sources and site checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.operators import findings as N
from auditlake.operators import site_checks as S
from auditlake.plans import corpus as C
from auditlake.plans.queries import QUERIES, query, sorted_text
from auditlake.session import stage



def site_check_columns(df):
    return df.select("site_id", "check_id", "category", "severity", "conclusion")


def all_site_checks(spark, sf, only=None):
    return S.site_checks(C.sites(spark, sf), C.responses(spark, sf), only)


def site_check_query(name: str, *check_ids: str):
    def run(spark, sf):
        return site_check_columns(all_site_checks(spark, sf, list(check_ids)))

    QUERIES[name] = run


for _name, _ids in [
    ("c1_llms_txt_exists", ["llms-txt-exists"]), ("c2_llms_txt_size", ["llms-txt-size"]), ("c3_llms_txt_valid", ["llms-txt-valid"]),
    ("c4_llms_txt_directive", ["llms-txt-directive"]), ("c5_link_headers", ["link-headers"]), ("c6_sitemap", ["sitemap"]),
    ("c7_robots_txt", ["robots-txt"]), ("c8_content_signals", ["content-signals"]), ("c9_ai_bot_rules", ["ai-bot-rules"]),
    ("c10_well_known", ["well-known-api-catalog", "well-known-mcp-card", "well-known-agent-skills"]),
    ("c11_markdown_url", ["markdown-url-support"]), ("c12_content_negotiation", ["content-negotiation"]),
    ("c13_oauth_discovery", ["oauth-discovery"]), ("c14_oauth_resource", ["oauth-protected-resource"]),
    ("c15_cache_headers", ["cache-headers"]), ("c16_web_bot_auth", ["web-bot-auth"]),
    ("c17_a2a_agent_card", ["a2a-agent-card"]), ("c18_redirects", ["redirect-behavior"]),
]:
    site_check_query(_name, *_ids)


@query("c19_soft_404")
def c19(spark, sf):
    return site_check_columns(S.soft_404(C.responses(spark, sf), "/no-such-page"))


def llms_bodies(spark, sf):
    """The first index file of each site that has one."""
    r = C.responses(spark, sf).where(
        F.col("url").endswith("/llms.txt") & (F.col("status") == 200) & (F.col("body") != "")
    )
    return r.groupBy("run_id", "site_id").agg(F.min_by(F.struct("url", "body"), "seq").alias("r")).select("run_id", "site_id", "r.*")


@query("c20_llms_txt_links")
def c20(spark, sf):
    bodies = llms_bodies(spark, sf)
    targets = S.llms_links(bodies).select(U.resolve_href(F.col("href"), F.col("url")).alias("abs_url"))
    statuses = C.link_statuses(targets).withColumn("ctype", F.lit(""))
    locs = C.site_pages(spark, sf).select("site_id", F.col("url").alias("loc"))
    listed = locs.unionByName(C.sites(spark, sf).select("site_id", F.concat(F.lit("https://"), "site_id", F.lit("/ref/1")).alias("loc")))
    return site_check_columns(S.llms_link_checks(bodies, statuses, listed))


@query("u11_known_paths")
def u11(spark, sf):
    return S.probe_targets(C.sites(spark, sf)).select("site_id", "family", F.col("ord").cast("bigint").alias("ord"), "url", "accept")


@query("j9_probe_join")
def j9(spark, sf):
    return S.answered_probes(C.sites(spark, sf), C.responses(spark, sf)).select(
        "site_id", "family", F.col("ord").cast("bigint").alias("ord"), F.col("status").cast("bigint").alias("status")
    )


@query("s2_audit_projection")
def s2(spark, sf):
    return S.to_audit(C.responses(spark, sf)).select(
        "site_id", "seq", "audit.method", "audit.url", F.col("audit.status").cast("bigint").alias("status"), sorted_text(F.col("audit.headers")).alias("headers"), "audit.note",
    )


@query("g13_audit_trail")
def g13(spark, sf):
    trail = S.audit_trail(C.responses(spark, sf), ["run_id", "site_id"])
    line = F.transform("audit", lambda a: F.concat(a["method"], F.lit(" "), a["url"], F.lit(" "), a["status"].cast("string")))
    return trail.select("site_id", F.array_join(line, "\n").alias("trail"))


@query("g13_check_trails")
def g13_checks(spark, sf):
    """The requests behind each check of each site."""
    results = stage(S.probe_results(C.sites(spark, sf), C.responses(spark, sf)), "probes")
    trails = S.check_trails(S.site_checks(None, None, results=results), results)
    return trails.select(
        "site_id", "check_id", F.col("step").cast("bigint").alias("step"), "method", "url", F.col("status").cast("bigint").alias("status"),
        sorted_text(F.col("headers")).alias("headers"), "note",
    )


@query("g13_finding_trails")
def g13_findings(spark, sf):
    """Findings of site checks with the number and the last of the requests that led to them."""
    results = stage(S.probe_results(C.sites(spark, sf), C.responses(spark, sf)), "probes")
    checks = S.site_checks(None, None, results=results)
    rows = N.finding_trails(N.site_findings(checks), S.check_trails(checks, results))
    return rows.groupBy("site_id", "finding_id", "severity").agg(
        F.count(F.lit(1)).alias("requests"), F.max_by(F.concat_ws(" ", "method", "url", "status"), "step").alias("last_request")
    )


@query("s4_robots_directives")
def s4(spark, sf):
    bodies = C.responses(spark, sf).where(F.col("url").endswith("/robots.txt") & (F.col("status") == 200))
    return S.robots_directives(bodies).select("site_id", F.col("line_no").cast("bigint").alias("line_no"), "field", "value")


@query("s5_llms_links")
def s5(spark, sf):
    return S.llms_links(llms_bodies(spark, sf)).select(
        "site_id", F.col("pos").cast("bigint").alias("pos"), "text", "href", "has_h1", "has_quote"
    )
