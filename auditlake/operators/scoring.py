"""Scores, grades and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.dims import AXES, CATEGORY_WEIGHTS, PROFILES, SEVERITY_SCORE, dim_check, literal_map, with_axis
from auditlake.functions.text import js_round
from auditlake.operators.page_checks import text
from auditlake.operators.rollup import severity_counts

SITE = ["run_id", "site_id"]


def grade(score: Column) -> Column:
    return (
        F.when(score == 100, "A+").when(score >= 97, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 61, "D").otherwise("F")
    )


def category_scores(checks: DataFrame) -> DataFrame:
    """Mean score per category of each site; a category without checks scores 100."""
    points = literal_map(SEVERITY_SCORE)[F.col("severity")]
    sums = checks.groupBy(*SITE).agg(
        *[
            x
            for c in CATEGORY_WEIGHTS
            for x in (
                F.sum(F.when(F.col("category") == c, points)).alias(f"sum {c}"),
                F.count_if(F.col("category") == c).alias(f"n {c}"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                F.lit(w).alias("weight"),
                F.when(F.col(f"n {c}") == 0, F.lit(100)).otherwise(js_round(F.col(f"sum {c}") / F.col(f"n {c}"))).cast("bigint").alias("score"),
            )
            for c, w in CATEGORY_WEIGHTS.items()
        ]
    )
    return sums.select(*SITE, F.explode(rows).alias("r")).select(*SITE, "r.*")


def weighted_score(categories: DataFrame) -> DataFrame:
    """Weighted mean of the category scores and its grade."""
    scored = categories.groupBy(*SITE).agg(js_round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("overall"))
    return scored.withColumn("grade", grade(F.col("overall")))


def live_score(merged: DataFrame) -> DataFrame:
    """100 less 7 per failing and 3 per warning finding, at least 0."""
    counts = merged.groupBy(*SITE).agg(
        F.count_if(F.col("severity") == "fail").alias("n_fail"), F.count_if(F.col("severity") == "warn").alias("n_warn")
    )
    scored = counts.withColumn("score", F.greatest(F.lit(0), 100 - F.col("n_fail") * 7 - F.col("n_warn") * 3).cast("bigint"))
    return scored.withColumn("grade", grade(F.col("score")))


def band(fails: Column, warns: Column) -> Column:
    issues = fails + warns
    label = (
        F.when(issues == 0, "Agent-ready")
        .when((fails == 0) & (issues <= 2), "Mostly readable")
        .when((fails <= 2) & (issues <= 5), "Needs work")
        .otherwise("Broken for agents")
    )
    tone = F.when(issues == 0, "ok").when((fails <= 2) & (issues <= 5), "warn").otherwise("alert")
    return F.struct(label.alias("label"), tone.alias("tone"))


def verdict(issues: Column) -> Column:
    return (
        F.when(issues == 0, F.lit("reads well for agents, nothing stands in the way"))
        .when(issues <= 2, F.lit("reads well for agents, with a few gaps to close"))
        .when(issues <= 5, text("has ", issues, " areas to fix before agents read it cleanly"))
        .otherwise(text("has ", issues, " areas that keep agents from its content; fix the severe ones first"))
    )


def profile_sentence(statuses: DataFrame) -> DataFrame:
    """One sentence per profile of each site, in profile order."""
    names = literal_map({"rawHttp": "Plain fetchers", "headless": "Browsers", "snippet": "Search snippets"})
    said = F.concat(
        names[F.col("profile")],
        F.when(F.col("status") == "good", " get all of it.").when(F.col("status") == "partial", " miss part of it.").otherwise(" cannot read it."),
    )
    return statuses.groupBy(*SITE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("profile_ord", said.alias("s")))), lambda x: x["s"]), " ").alias("sentence")
    )


def applicability(checks: DataFrame, merged: DataFrame) -> DataFrame:
    """How many checks apply to a site, how many pass, and the share of those."""
    applies = checks.groupBy(*SITE).agg(
        F.count_if(F.col("severity") != "info").alias("applicable"), F.count_if(F.col("severity") == "info").alias("inapplicable")
    )
    issues = live_score(merged).select(*SITE, "n_fail", "n_warn")
    rows = applies.join(issues, SITE, "left").fillna(0, ["n_fail", "n_warn"])
    passing = F.greatest(F.lit(0), F.col("applicable") - F.col("n_fail") - F.col("n_warn"))
    rows = rows.withColumn("passing", passing.cast("bigint"))
    share = F.when(F.col("applicable") > 0, js_round(F.col("passing") / F.col("applicable") * 100)).otherwise(F.lit(100))
    return rows.withColumn("passing_pct", share.cast("bigint"))


def counts_by_axis(checks: DataFrame) -> DataFrame:
    """Failures, warnings and totals per axis of each site, zero rows kept."""
    counted = with_axis(checks).groupBy(*SITE).agg(
        *[
            x
            for a in AXES
            for x in (
                F.count_if((F.col("axis") == a) & (F.col("severity") == "fail")).alias(f"fail {a}"),
                F.count_if((F.col("axis") == a) & (F.col("severity") == "warn")).alias(f"warn {a}"),
                F.count_if(F.col("axis") == a).alias(f"total {a}"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("axis"), F.col(f"fail {a}").alias("fail"), F.col(f"warn {a}").alias("warn"), F.col(f"total {a}").alias("total"))
            for a in AXES
        ]
    )
    return counted.select(*SITE, F.explode(rows).alias("r")).select(*SITE, "r.*")


def counts_by_severity(checks: DataFrame) -> DataFrame:
    return severity_counts(checks, SITE)


def clean_share(per_profile: DataFrame, checks: DataFrame) -> DataFrame:
    """Share of checks without a finding, per profile."""
    totals = checks.groupBy(*SITE).agg(F.count(F.lit(1)).alias("checks"))
    rows = F.array(*[F.struct(F.lit(p).alias("profile"), F.col(p).alias("findings")) for p in PROFILES])
    long = totals.join(per_profile, SITE, "left").select(*SITE, "checks", F.explode(rows).alias("r")).select(*SITE, "checks", "r.*")
    share = 1 - F.coalesce("findings", F.lit(0)) / F.col("checks")
    return long.withColumn("clean_pct", js_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100))


def rubric_usage(checks: DataFrame) -> DataFrame:
    """The rubric by axis and title, with how often each entry was checked and failed."""
    used = checks.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "fail").alias("n_fail"))
    rubric = dim_check(checks.sparkSession).join(used, "check_id", "left").fillna(0, ["n", "n_fail"])
    axis_ord = literal_map({a: i for i, a in enumerate(AXES)})[F.col("axis")]
    return rubric.withColumn("axis_ord", axis_ord).orderBy("axis_ord", "rubric_title")


def check_list(checks: DataFrame, axis: str | None = None, severity: str | None = None) -> DataFrame:
    """Checks of an axis and severity in listing order: failures first, then by position."""
    rows = with_axis(checks)
    if axis:
        rows = rows.where(F.col("axis") == axis)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    order = literal_map({"fail": 0, "warn": 1, "pass": 2, "info": 3})[F.col("severity")]
    return rows.withColumn("severity_ord", order).orderBy(*SITE, "severity_ord", "seq")
