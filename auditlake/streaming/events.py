"""Run-event logs: one row per event, ordered by ``seq`` within a run.

A discovery is a ``discover`` row followed by ``discover:page`` rows of the same ``seq``, so that no
row ever holds the page list of a large site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.dims import PROFILES
from auditlake.functions.text import js_round
from auditlake.operators.windows import ordinal_within

TERMINAL = {"run:done": "done", "run:stopped": "stopped", "run:error": "error"}

LOG = """
    run_id STRING, seq BIGINT, type STRING, url STRING, page_index BIGINT, profile STRING, chars BIGINT,
    tokens_est BIGINT, js_gated DOUBLE, source STRING, capped BOOLEAN, message STRING
"""
COLUMNS = [f.split()[0] for f in LOG.replace("\n", " ").split(",")]


def event(**values: Column) -> Column:
    """One log row as a struct; fields that are not named are NULL."""
    types = {f.split()[0]: f.split()[1] for f in LOG.replace("\n", " ").split(",")}
    return F.struct(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS if c != "run_id"])


def normalize_log(raw: DataFrame) -> DataFrame:
    """Logs whose ``discover`` events carry a page array, as log rows."""
    per_page = F.transform(
        F.coalesce("pages", F.array().cast("array<string>")),
        lambda url, i: event(seq=F.col("seq"), type=F.lit("discover:page"), url=url, page_index=i),
    )
    own = {c: F.col(c) for c in COLUMNS if c != "run_id"}
    rows = F.when(F.col("type") == "discover", F.concat(F.array(event(**own)), per_page)).otherwise(F.array(event(**own)))
    return raw.select("run_id", F.explode(rows).alias("e")).select("run_id", "e.*")


def synthesize(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Event log of stored runs.

    ``runs(run_id, status, source, capped, n_pages, message)``; ``pages`` has one row per page with
    ``page_index`` from 0, ``js_gated`` and the profile columns ``chars_*`` and ``tokens_*``. Each
    page owns five places in the log, so rows are numbered without looking at each other.
    """
    base = F.col("page_index") * 5 + 1
    page_events = [event(seq=F.lit(0), type=F.lit("discover:page"), url=F.col("url"), page_index=F.col("page_index"))]
    page_events.append(event(seq=base, type=F.lit("page:start"), url=F.col("url"), page_index=F.col("page_index")))
    for i, p in enumerate(PROFILES):
        page_events.append(
            event(seq=base + 1 + i, type=F.lit("profile:done"), url=F.col("url"), profile=F.lit(p),
                  chars=F.coalesce(F.col(f"chars_{p}"), F.lit(0)), tokens_est=F.coalesce(F.col(f"tokens_{p}"), F.lit(0)))
        )
    page_events.append(
        event(seq=base + 4, type=F.lit("page:done"), url=F.col("url"), page_index=F.col("page_index"), js_gated=F.coalesce("js_gated", F.lit(0.0)))
    )
    of_pages = pages.select("run_id", F.explode(F.array(*page_events)).alias("e"))
    kind = F.when(F.col("status") == "stopped", "run:stopped").when(F.col("status") == "error", "run:error").otherwise("run:done")
    found = event(seq=F.lit(0), type=F.lit("discover"), source=F.coalesce("source", F.lit("bfs")), capped=F.coalesce("capped", F.lit(False)))
    ended = event(seq=F.col("n_pages") * 5 + 1, type=kind, message=F.col("message"))
    # A run that failed before it had pages found none; one still going on has not ended.
    without_result = (F.col("status") == "error") & (F.coalesce("n_pages", F.lit(0)) == 0)
    of_run = F.when(without_result, F.array(ended)).when(F.col("status") == "running", F.array(found)).otherwise(F.array(found, ended))
    of_runs = runs.select("run_id", F.explode(of_run).alias("e"))
    return of_runs.unionByName(of_pages).select("run_id", "e.*")


def replay(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Every event of a run with its place in the log, for a subscriber that comes late.

    ``seq`` must be unique within a run; large runs are numbered in blocks.
    """
    return ordinal_within(log, ["run_id"], seq, "place")


def eta_label(status: Column, elapsed_ms: Column, done: Column, total: Column) -> Column:
    """Remaining time of a running audit; NULL where it cannot be told."""
    left = F.try_divide(elapsed_ms, done) * (total - done)
    known = (status == "running") & (done >= 1) & (total >= 2) & (total > done) & (elapsed_ms > 0)
    return F.when(
        known,
        F.when(left < 5_000, F.lit("<5s"))
        .when(left < 60_000, F.concat(F.lit("~"), (js_round(left / 1000 / 5) * 5).cast("string"), F.lit("s")))
        .when(left < 1_800_000, F.concat(F.lit("~"), js_round(left / 60_000).cast("string"), F.lit(" min")))
        .otherwise(F.lit(">30 min")),
    )
