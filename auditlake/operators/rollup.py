"""Roll page checks up to one row per site and check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.dims import RANK_REPRESENTATIVE, rank
from auditlake.operators.page_checks import text
from auditlake.operators.windows import first_k

KEYS = ["run_id", "site_id", "check_id"]
SHOWN = 3


def severity_counts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per severity; plain counters, so most of a hot site is summed before the shuffle."""
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("fail", "warn", "pass", "info")],
    )


def rolled_severity():
    """Worst first, where an inconclusive page weighs less than one that passed."""
    return (
        F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").when(F.col("n_pass") > 0, "pass").otherwise("info")
    )


def rollup_checks(checks: DataFrame) -> DataFrame:
    """One row per site and check: counts, rolled severity, first affected pages, representative.

    The URL lists stay at three plus a count, since a site may have millions of affected pages;
    ``affected_pages`` gives them all as rows. Stage ``checks`` first if it is costly: it is read
    once for the counters and once for the first pages.
    """
    counts = severity_counts(checks, KEYS).withColumn("severity", rolled_severity())
    narrow = checks.select(
        *KEYS, "severity", "page_index", "page_url", "source_ord", "category", "title", "fix", "conclusion", "details"
    )
    firsts = first_k(narrow, [*KEYS, "severity"], [F.col("page_index")], SHOWN, "_rank")
    found = firsts.groupBy(*KEYS).agg(
        F.min_by(
            F.struct("source_ord", "category", "title", "fix", F.col("conclusion").alias("rep_conclusion"), "details"),
            F.struct(rank(F.col("severity"), RANK_REPRESENTATIVE), "page_index"),
        ).alias("rep"),
        F.array_sort(F.collect_list(F.struct("_rank", "severity", "page_url"))).alias("pages"),
    )
    joined = counts.join(found, KEYS)
    severity = F.col("severity")
    affected = (
        F.when(severity == "fail", F.col("n_fail"))
        .when(severity == "warn", F.col("n_warn"))
        .when(severity == "pass", F.col("n_pass"))
        .otherwise(F.col("n_info"))
    )
    urls = F.transform(F.filter("pages", lambda p: p["severity"] == severity), lambda p: p["page_url"])
    out = joined.withColumn("affected", affected).withColumn("first_pages", urls)
    more = F.col("affected") - F.size("first_pages")
    listed = F.concat(
        F.array_join("first_pages", ", "), F.when(more > 0, text(" and ", more, " more")).otherwise(F.lit(""))
    )
    message = F.when(severity == "pass", text("all ", F.col("total"), " pages pass")).otherwise(
        text(F.col("affected"), " of ", F.col("total"), " pages ", severity, ": ", listed)
    )
    conclusion = F.when(severity == "pass", text(F.col("total"), "/", F.col("total"), " pages clean")).otherwise(
        text(F.col("affected"), "/", F.col("total"), " pages ", severity)
    )
    return out.select(
        *KEYS, "rep.*", "severity", "total", "n_fail", "n_warn", "n_pass", "n_info", "affected", "first_pages",
        message.alias("message"), conclusion.alias("conclusion"),
    )


def affected_pages(checks: DataFrame, rollup: DataFrame) -> DataFrame:
    """Every page that has its site's rolled severity, as rows."""
    rolled = rollup.select(*KEYS, "severity")
    return checks.join(rolled, [*KEYS, "severity"], "left_semi").select(*KEYS, "severity", "page_index", "page_url")


def common_issues(checks: DataFrame, examples: int = 3) -> DataFrame:
    """Warnings and failures per check: count, first message, a few example URLs."""
    issues = checks.where(F.col("severity").isin("warn", "fail"))
    keys = ["run_id", "site_id", "check_id"]
    counts = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    shown = first_k(
        issues.select(*keys, "page_index", "page_url", "message"), keys, [F.col("page_index")], examples, "_rank"
    )
    first = shown.groupBy(*keys).agg(
        F.min_by("message", "_rank").alias("message"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "page_url"))), lambda p: p["page_url"]).alias("example_urls"),
    )
    return counts.join(first, keys)
