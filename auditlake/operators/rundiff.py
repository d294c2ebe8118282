"""What changed between two runs of a site, for all sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consecutive_runs(runs: DataFrame) -> DataFrame:
    """Pairs ``(site_id, before_run, after_run)`` of a site's runs next to each other in time.

    ``runs(run_id, site_id, started_at, finished_at, seq)``; a run without an end counts by its
    start, and runs of the same time keep the order of ``seq``. One narrow row per run, so even a
    site with very many runs sorts quickly.
    """
    at = F.coalesce("finished_at", "started_at")
    by_time = Window.partitionBy("site_id").orderBy(at, "seq")
    paired = runs.select(
        "site_id", F.lag("run_id").over(by_time).alias("before_run"), F.col("run_id").alias("after_run"),
        F.lag(at).over(by_time).alias("before_at"), at.alias("after_at"),
    )
    return paired.where(F.col("before_run").isNotNull())


def of_pairs(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of the runs on one side of the pairs, keyed by pair."""
    key = pairs.select("site_id", F.col(f"{side}_run").alias("run_id"), "before_run", "after_run")
    return rows.join(key, ["site_id", "run_id"]).drop("run_id")


PAIR = ["site_id", "before_run", "after_run"]


def diff_findings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings that are new, resolved, changed in number, or unchanged, by finding id."""
    cols = [*PAIR, "finding_id", "severity", "occurrences"]
    before = of_pairs(findings, pairs, "before").select(*cols).withColumnsRenamed({"severity": "before_severity", "occurrences": "before_occurrences"})
    after = of_pairs(findings, pairs, "after").select(*cols).withColumnsRenamed({"severity": "after_severity", "occurrences": "after_occurrences"})
    both = before.join(after, [*PAIR, "finding_id"], "full_outer")
    b, a = F.col("before_occurrences"), F.col("after_occurrences")
    change = F.when(b.isNull(), "new").when(a.isNull(), "resolved").when(a != b, "changed").otherwise("same")
    return both.withColumn("change", change).withColumn("delta", a - b)


def diff_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Page URLs that are new, removed or common."""
    before = of_pairs(pages.select("run_id", "site_id", "url").distinct(), pairs, "before").withColumn("in_before", F.lit(True))
    after = of_pairs(pages.select("run_id", "site_id", "url").distinct(), pairs, "after").withColumn("in_after", F.lit(True))
    both = before.join(after, [*PAIR, "url"], "full_outer")
    change = F.when(F.col("in_before").isNull(), "new").when(F.col("in_after").isNull(), "removed").otherwise("common")
    return both.select(*PAIR, "url", change.alias("change"))


def page_change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*PAIR).agg(*[F.count_if(F.col("change") == c).alias(f"{c}_pages") for c in ("new", "removed", "common")])


STATS = ["pages_scanned", "avg_js_gated_fraction", "fix_backlog"]


def diff_stats(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Before, after and delta of the site statistics; all NULL where a side has none."""
    cols = [*PAIR, *STATS]
    before = of_pairs(stats, pairs, "before").select(*cols).withColumnsRenamed({c: f"before_{c}" for c in STATS})
    after = of_pairs(stats, pairs, "after").select(*cols).withColumnsRenamed({c: f"after_{c}" for c in STATS})
    joined = pairs.select(*PAIR).join(before, PAIR, "left").join(after, PAIR, "left")
    known = F.col("before_pages_scanned").isNotNull() & F.col("after_pages_scanned").isNotNull()
    columns = []
    for c in STATS:
        columns += [
            F.when(known, F.col(f"before_{c}")).alias(f"before_{c}"),
            F.when(known, F.col(f"after_{c}")).alias(f"after_{c}"),
            F.when(known, F.col(f"after_{c}") - F.col(f"before_{c}")).alias(f"delta_{c}"),
        ]
    return joined.select(*PAIR, *columns)
