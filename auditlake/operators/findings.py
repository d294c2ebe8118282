"""Findings: what checks left to fix, merged, attributed, ranked and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.dims import PROFILES, RANK_FIX, dim_check, rank
from auditlake.functions.text import bare_id
from auditlake.operators.page_checks import text

SITE = ["run_id", "site_id"]
PAGE_SEQ = 1000  # page findings follow all site findings
FIELDS = [
    "title", "severity", "source", "evidence", "fix_hint", "page_url", "conclusion",
]


def page_findings(rollup: DataFrame) -> DataFrame:
    """Findings of rolled-up page checks; the check's own fix text comes first."""
    hurt = F.col("n_fail") + F.col("n_warn")
    return rollup.where(F.col("severity").isin("fail", "warn")).select(
        *SITE,
        (F.col("source_ord") + PAGE_SEQ).cast("bigint").alias("seq"),
        F.concat(F.lit("check:"), "check_id").alias("finding_id"),
        "title",
        "severity",
        F.lit("check").alias("source"),
        F.col("message").alias("evidence"),
        F.coalesce("fix", text("See rubric entry ", F.col("check_id"))).alias("fix_hint"),
        F.coalesce(F.get("first_pages", F.lit(0)), F.lit("")).alias("page_url"),
        F.coalesce(F.nullif(hurt, F.lit(0)), F.nullif(F.col("affected"), F.lit(0)), F.lit(1)).cast("bigint").alias("occurrences"),
        "conclusion",
    )


def site_findings(checks: DataFrame) -> DataFrame:
    """Findings of site checks; their hint points at the rubric, not at the check's fix text."""
    return checks.where(F.col("severity").isin("fail", "warn")).select(
        *SITE,
        F.col("source_ord").cast("bigint").alias("seq"),
        F.concat(F.lit("check:"), "check_id").alias("finding_id"),
        "title",
        "severity",
        F.lit("check").alias("source"),
        F.col("message").alias("evidence"),
        text("See rubric entry ", F.col("check_id")).alias("fix_hint"),
        "page_url",
        F.lit(1).cast("bigint").alias("occurrences"),
        "conclusion",
    )


def finding_trails(findings: DataFrame, trails: DataFrame) -> DataFrame:
    """Findings with the requests of their check's trail, a row per request; findings without one have none."""
    named = trails.select(*SITE, F.concat(F.lit("check:"), "check_id").alias("finding_id"), "step", "method", "url", "status", "headers", "note")
    return findings.select(*SITE, "finding_id", "severity").join(named, [*SITE, "finding_id"])


def attribute(findings: DataFrame, exact_ids: bool = False) -> DataFrame:
    """Add ``affected_profiles``; NULL means general. The dimension has one row per rubric entry.

    Ids carry a source prefix that the attribution table does not know, so it is stripped;
    ``exact_ids`` looks the id up as it is.
    """
    dim = F.broadcast(
        dim_check(findings.sparkSession).select(F.col("check_id").alias("_id"), F.col("profiles").alias("affected_profiles"))
    )
    key = F.col("finding_id") if exact_ids else bare_id(F.col("finding_id"))
    return findings.withColumn("_id", key).join(dim, "_id", "left").drop("_id")


def merge_findings(findings: DataFrame, exact_ids: bool = False) -> DataFrame:
    """One row per finding id: occurrences summed, everything else from the first one seen."""
    merged = findings.groupBy(*SITE, "finding_id").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min("seq").alias("seq"),
        F.min_by(F.struct(*FIELDS), "seq").alias("first"),
    )
    return attribute(merged.select(*SITE, "finding_id", "seq", "occurrences", "first.*"), exact_ids)


def rank_findings(merged: DataFrame) -> DataFrame:
    """Rank by severity, occurrences, source and id. A site has at most one row per finding id."""
    by = Window.partitionBy(*SITE).orderBy(
        rank(F.col("severity"), RANK_FIX),
        F.desc("occurrences"),
        F.when(F.col("source") == "check", 0).otherwise(1),
        "finding_id",
    )
    return merged.withColumn("rank", F.row_number().over(by))


def findings_per_profile(merged: DataFrame) -> DataFrame:
    """Findings per reader profile of each site, and those that are general."""
    counts = merged.groupBy(*SITE).agg(
        *[F.count_if(F.array_contains("affected_profiles", p)).alias(p) for p in PROFILES],
        F.count_if(F.col("affected_profiles").isNull()).alias("general"),
    )
    return counts


def fix_backlog(merged: DataFrame) -> DataFrame:
    return merged.groupBy(*SITE).agg(F.count_if(F.col("severity") != "info").alias("fix_backlog"))


def _bullet(f: Column) -> Column:
    tail = F.when(f["evidence"] != "", F.concat(F.lit(": "), f["evidence"])).otherwise(F.lit(""))
    return F.concat(F.lit("- ["), bare_id(f["finding_id"]), F.lit("] "), f["title"], tail)


def report(merged: DataFrame, scores: DataFrame, sites: DataFrame) -> DataFrame:
    """A site's report as markdown: verdict, failures, warnings, and the fixes known for them.

    A list per site is bounded: merged findings have distinct ids and the rubric a few dozen.
    """
    dim = F.broadcast(dim_check(merged.sparkSession).select(F.col("check_id").alias("_id"), "label", "fix_short"))
    ranked = rank_findings(merged).withColumn("_id", bare_id(F.col("finding_id"))).join(dim, "_id", "left")
    entry = F.struct("rank", "finding_id", "severity", "title", "evidence", "label", "fix_short")
    per_site = ranked.groupBy(*SITE).agg(F.array_sort(F.collect_list(entry)).alias("fs"))
    rows = sites.join(scores, SITE).join(per_site, SITE, "left")
    fs = F.coalesce("fs", F.array().cast(per_site.schema["fs"].dataType))
    rows = rows.withColumn("fs", fs)
    fails = F.filter("fs", lambda f: f["severity"] == "fail")
    warns = F.filter("fs", lambda f: f["severity"] == "warn")
    known = F.filter("fs", lambda f: f["label"].isNotNull())
    fixes = F.transform(known, lambda f: F.concat(F.lit("- **"), f["label"], F.lit("**: "), f["fix_short"]))

    def section(name: str, items: Column) -> Column:
        return F.concat(F.array(text(f"## {name} (", F.size(items), ")")), F.transform(items, _bullet), F.array(F.lit("")))

    lines = F.concat(
        F.array(
            text("# Audit report: ", F.col("site_id")),
            text("URL: ", F.col("seed_url")),
            text("Score: ", F.col("score"), "/100 (grade ", F.col("grade"), ")"),
            F.lit(""),
            text(F.size(fails), " failing checks and ", F.size(warns), " warnings."),
            F.lit(""),
        ),
        section("Failing checks", fails),
        section("Warnings", warns),
        F.when(F.size("fs") > 0, F.concat(F.array(F.lit("### Common fixes")), fixes, F.array(F.lit("")))).otherwise(
            F.array().cast("array<string>")
        ),
        F.array(text("Run the audit of ", F.col("seed_url"), " again once these are fixed.")),
    )
    return rows.select(*SITE, F.array_join(lines, "\n").alias("report"))
