"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The pages come as one file with one row group, which is one split whatever the session says; before
the timing starts they are written again as several files, as a crawl would be stored.

``page_checks_x10`` replicates every page ten times inside the query to measure a scan of
some size; its throughput is reported as pages per second.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_rendering_by_site", "x3_html_to_markdown", "x5_snippet", "x7_links", "x17_content_budget", "x19_page_profiles", "t3_collapse_ws",
    "g1_page_diff", "p5_heading_hierarchy", "p12_link_integrity", "g3_check_rollup", "c9_ai_bot_rules", "w1_ranked_audit_findings", "g15_report",
    "b1_bfs", "b2_discover", "j10_run_diff_findings", "j11_run_diff_pages", "p19_strict_rendering", "r1_page_state", "r2_replay",
    "d5_reader_shares", "d8_verdict", "e1_profile_registry", "o6_site_stats_delta", "s7_run_sink", "r1_page_state_stream",
]
COPIES = 10


def in_several_files(spark, sf_dir, parts):
    """Folder with the same tables, the pages cut into ``parts`` files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name != "pages.parquet":
            os.symlink(os.path.join(sf_dir, name), os.path.join(folder, name))
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(parts).write.parquet(f"{folder}/pages.parquet")
    return folder


def replicated_checks(spark, sf_dir):
    """All page checks of every page, ten copies of each page."""
    from pyspark.sql import functions as F

    from auditlake.operators import page_checks as K
    from auditlake.operators import profiles as P
    from auditlake.plans import corpus as C

    pages = C.crawled_pages(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    # Spread the copies before the work: the test file is a single split.
    pages = pages.repartition(64).drop("copy")
    checks = K.page_checks(K.page_features(P.with_profiles(pages), links=True))
    return checks.groupBy("check_id", "severity").count()


def main() -> None:
    from auditlake.plans.catalog import QUERIES
    from auditlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    sf = os.path.basename(sf_dir.rstrip("/"))
    sf_dir = in_several_files(spark, os.path.abspath(sf_dir), 2 * spark.sparkContext.defaultParallelism)
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    replicated_checks(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["page_checks_x10"] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total wall time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "pages_per_sec": round(n_pages * COPIES / times["page_checks_x10"], 1),
    }
    spark.stop()
    shutil.rmtree(sf_dir, ignore_errors=True)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
