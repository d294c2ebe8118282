"""The flagship query: where content depends on scripts, per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import page_checks as K
from auditlake.operators import profiles as P
from auditlake.plans import corpus as C


def rendering_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, mean script-gated share and rendering verdicts of every site; one shuffle by site."""
    wide = P.with_profiles(C.crawled_pages(spark, sf_dir))
    rows = wide.select(
        "site_id",
        F.col("rawHttp.ok").alias("raw_ok"),
        F.col("headless.ok").alias("headless_ok"),
        F.col("rawHttp.chars").alias("raw_chars"),
        F.col("headless.chars").alias("headless_chars"),
    )
    judged = rows.select(
        "site_id",
        P.js_gated(F.col("raw_chars"), F.col("headless_chars")).alias("gated"),
        K.rendering_strategy()["severity"].alias("severity"),
    )
    return judged.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.round(F.sum("gated") / F.count(F.lit(1)), 6).alias("avg_js_gated"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("fail", "warn", "pass", "info")],
    )
