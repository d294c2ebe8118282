"""The whole audit: pages and responses in, result tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import findings as N
from auditlake.operators import page_checks as K
from auditlake.operators import profiles as P
from auditlake.operators import row_checks as RC
from auditlake.operators import rollup as R
from auditlake.operators import scoring as G
from auditlake.operators import site_checks as S
from auditlake.session import stage

COMMON = ["run_id", "site_id", "page_url", "check_id", "category", "severity", "title", "message", "fix", "conclusion"]


def union_checks(site_rows: DataFrame, page_rollup: DataFrame) -> DataFrame:
    """Site checks, then rolled-up page checks, with ``seq`` as their fixed order."""
    first = site_rows.select(*COMMON, F.col("source_ord").cast("bigint").alias("seq"))
    rolled = page_rollup.withColumn("page_url", F.get("first_pages", F.lit(0)))
    second = rolled.select(*COMMON, (F.col("source_ord") + N.PAGE_SEQ).cast("bigint").alias("seq"))
    return first.unionByName(second)


def page_check_rows(
    features: DataFrame, statuses: DataFrame | None = None, sample: int | None = K.LINK_SAMPLE
) -> DataFrame:
    """All page checks; without ``statuses`` the link check is left out."""
    rows = K.page_checks(features)
    if statuses is not None:
        rows = rows.unionByName(K.link_integrity(features, statuses, sample))
    return rows


def audit(
    pages: DataFrame,
    sites: DataFrame,
    responses: DataFrame,
    statuses: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    discovery: DataFrame | None = None,
    row_checks: tuple[RC.RowCheck, ...] = (),
) -> dict[str, DataFrame]:
    """Audit all sites at once.

    The page texts are read once: their features (numbers and short lists) are staged, and every
    later step works on those. ``statuses`` answers linked URLs, given as a table or made from the
    features; ``discovery(run_id, site_id, source, capped)`` completes the site statistics.
    ``row_checks`` are further page checks as functions; what they raise is in ``check_errors``.
    """
    wide = P.with_profiles(pages)
    tokens = [F.col(f"{p}.tokens_est").alias(f"tokens_{p}") for p in ("rawHttp", "headless", "snippet")]
    features = stage(K.page_features(wide, links=True, extra=tokens), "features")
    known = statuses(features) if callable(statuses) else statuses
    checked = page_check_rows(features, known)
    errors = None
    if row_checks:
        judged = stage(RC.judged_rows(features, row_checks), "judged")
        more, errors = RC.split_outcomes(judged, row_checks, first_ord=len(K.LIVE_CHECKS) + 1)
        checked = checked.unionByName(more)
    page_rows = stage(checked, "page-checks")
    rollup = stage(R.rollup_checks(page_rows), "rollup")
    probes = stage(S.probe_results(sites, responses), "probes")
    site_rows = stage(S.site_checks(sites, responses, results=probes), "site-checks")
    merged = N.merge_findings(N.site_findings(site_rows).unionByName(N.page_findings(rollup)))
    checks = union_checks(site_rows, rollup)
    scores = live_scores(sites, merged)
    stats = P.site_stats(P.wide_from_features(features)).join(N.fix_backlog(merged), ["run_id", "site_id"], "left").fillna(0, ["fix_backlog"])
    if discovery is not None:
        stats = stats.join(discovery.select("run_id", "site_id", "source", "capped"), ["run_id", "site_id"], "left")
    return {
        "features": features,
        "page_checks": page_rows,
        "rollup": rollup,
        "checks": checks,
        "findings": N.rank_findings(merged),
        "trails": S.check_trails(site_rows, probes),
        "site_stats": stats,
        "category_scores": G.category_scores(checks),
        "scores": scores,
        "reports": N.report(merged, scores, sites),
    } | ({} if errors is None else {"check_errors": errors})


def live_scores(sites: DataFrame, merged: DataFrame) -> DataFrame:
    """Live score of every site, also of those without findings."""
    scored = sites.select("run_id", "site_id").join(G.live_score(merged), ["run_id", "site_id"], "left")
    return scored.select(
        "run_id", "site_id", F.coalesce("n_fail", F.lit(0)).alias("n_fail"), F.coalesce("n_warn", F.lit(0)).alias("n_warn"),
        F.coalesce("score", F.lit(100)).cast("bigint").alias("score"),
    ).withColumn("grade", G.grade(F.col("score")))
