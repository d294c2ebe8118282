"""Live state of runs, folded from their event logs: as a batch job and as a stream.

Both give the same rows. A page's state is the last value seen per profile since the last
discovery; what comes after a run's first terminal event is ignored; done pages are counted once
however often a log is replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from auditlake.dims import PROFILES, literal_map
from auditlake.streaming.events import TERMINAL
from auditlake.streaming.ledger import Ledger


def _bounded(log: DataFrame) -> DataFrame:
    """Log up to each run's first terminal event, with the place of the last discovery.

    Both bounds come from the few discovery and terminal rows; the log itself is joined once, to one
    row per run. A run without a discovery has no pages and falls out.
    """
    steering = log.where(F.col("type").isin("discover", *TERMINAL)).select("run_id", "type", "seq")
    ends = steering.groupBy("run_id").agg(F.min(F.when(F.col("type") != "discover", F.col("seq"))).alias("end_seq"))
    in_time = F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq"))
    starts = steering.where(F.col("type") == "discover").join(ends, "run_id").where(in_time)
    bounds = starts.groupBy("run_id").agg(F.max("seq").alias("start_seq"), F.first("end_seq").alias("end_seq"))
    return log.join(bounds, "run_id").where(in_time)


def fold_pages(log: DataFrame) -> DataFrame:
    """State of every page of every run; grouped by run and URL, so a hot run is spread."""
    seq, kind = F.col("seq"), F.col("type")
    live = _bounded(log).where(seq >= F.col("start_seq"))

    def last(value: str, condition) -> F.Column:
        return F.max_by(value, F.when(condition, seq))

    found = (kind == "discover:page") & (seq == F.col("start_seq"))
    grouped = live.where(F.col("url").isNotNull()).groupBy("run_id", "url").agg(
        F.min(F.when(found, F.col("page_index"))).alias("page_index"),
        *[last("chars", (kind == "profile:done") & (F.col("profile") == p)).alias(f"chars_{p}") for p in PROFILES],
        *[last("tokens_est", (kind == "profile:done") & (F.col("profile") == p)).alias(f"tokens_{p}") for p in PROFILES],
        last("js_gated", kind == "page:done").alias("js_gated"),
        (F.count_if(kind == "page:done") > 0).alias("done"),
    )
    return grouped.where(F.col("page_index").isNotNull())


def run_status(log: DataFrame) -> DataFrame:
    """Status of every run: loading before a discovery, running, or how it ended."""
    kind = F.col("type")
    ended = literal_map(TERMINAL)[kind]
    rows = log.groupBy("run_id").agg(
        F.min_by(F.struct(ended.alias("status"), "message"), F.when(kind.isin(*TERMINAL), F.col("seq"))).alias("end"),
        F.min(F.when(kind == "discover", F.col("seq"))).alias("first_discover"),
        F.min(F.when(kind.isin(*TERMINAL), F.col("seq"))).alias("end_seq"),
    )
    begun = F.col("first_discover").isNotNull()
    return rows.select(
        "run_id",
        F.when(F.col("end").isNotNull(), F.col("end.status")).when(begun, F.lit("running")).otherwise(F.lit("loading")).alias("status"),
        F.col("end.message").alias("message"),
    )


def run_state(pages: DataFrame, status: DataFrame) -> DataFrame:
    """Run totals next to their status."""
    totals = pages.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("done").alias("pages_done"))
    return status.join(totals, "run_id", "left").fillna(0, ["total_pages", "pages_done"])


# ---------------------------------------------------------------- the same as a stream

SLOTS = [*PROFILES, "finished"]
MARKS = "run_id STRING, start_seq BIGINT, end_seq BIGINT"
PARTS = ", ".join(
    ["run_id STRING, url STRING, found STRUCT<seq: BIGINT, earlier: BIGINT>"]
    + [f"{p} STRUCT<seq: BIGINT, chars: BIGINT, tokens: BIGINT>" for p in PROFILES]
    + ["finished STRUCT<seq: BIGINT, js_gated: DOUBLE>"]
)


def _marks(rows: DataFrame) -> DataFrame:
    """Bounds of each run from rows with some of them: its first end, and the last discovery before that."""
    ends = rows.groupBy("run_id").agg(F.min("end_seq").alias("end_seq"), F.collect_set("start_seq").alias("starts"))
    in_time = F.filter("starts", lambda s: F.col("end_seq").isNull() | (s <= F.col("end_seq")))
    return ends.select("run_id", F.array_max(in_time).alias("start_seq"), "end_seq")


def _last_values(rows: DataFrame) -> DataFrame:
    """Latest values of each page out of parts, which are told apart by the number of the event that set them."""
    return rows.groupBy("run_id", "url").agg(F.max("found").alias("found"), *[F.max(s).alias(s) for s in SLOTS])


def mark_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, f"{path}/marks", MARKS, _marks)


def page_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, f"{path}/pages", PARTS, _last_values)


def fold_batch(events: DataFrame, batch: int, path: str) -> None:
    """Reduce a batch of log rows to one row for each page that it touches, and note where runs begin and end.

    Values keep the number of their event, so a later discovery makes older ones void without touching them.
    """
    spark = events.sparkSession
    events = events.persist()
    kind, seq = F.col("type"), F.col("seq")
    steering = events.where(kind.isin("discover", *TERMINAL)).groupBy("run_id").agg(
        F.collect_set(F.when(kind == "discover", seq)).alias("starts"), F.min(F.when(kind != "discover", seq)).alias("end_seq")
    )
    now = steering.select("run_id", F.explode_outer("starts").alias("start_seq"), "end_seq")
    ledger = mark_ledger(spark, path)
    marks = _marks(ledger.rows(batch).unionByName(now))
    ledger.write(batch, marks.join(steering.select("run_id"), "run_id", "left_semi"))
    live = events.join(ledger.rows(batch + 1), "run_id").where((seq >= F.col("start_seq")) & (F.col("end_seq").isNull() | (seq <= F.col("end_seq"))))

    def last(condition: F.Column, *values: F.Column) -> F.Column:
        return F.max(F.when(condition, F.struct(seq.alias("seq"), *values)))

    values = [F.col("chars"), F.col("tokens_est").alias("tokens")]
    parts = live.where(F.col("url").isNotNull()).groupBy("run_id", "url").agg(
        last(kind == "discover:page", (-F.col("page_index")).alias("earlier")).alias("found"),
        *[last((kind == "profile:done") & (F.col("profile") == p), *values).alias(p) for p in PROFILES],
        last(kind == "page:done", F.col("js_gated")).alias("finished"),
    )
    page_ledger(spark, path).write(batch, parts)
    events.unpersist()


def fold_stream(log: DataFrame, path: str) -> DataStreamWriter:
    """Fold a streaming log into ``path``; ``latest_pages`` reads the state.

    All work is grouping and joining of a batch, whose size the source's trigger bounds; a hot run is spread over
    its pages. A run's end must not come in a later trigger than events that are numbered after it.
    """
    return log.writeStream.foreachBatch(lambda events, batch: fold_batch(events, batch, path)).option("checkpointLocation", f"{path}/checkpoint")


def latest_pages(spark: SparkSession, path: str) -> DataFrame:
    """Current page states: pages of each run's last discovery, with what came after it."""
    rows = page_ledger(spark, path).rows().join(mark_ledger(spark, path).rows(), "run_id").where(F.col("found.seq") == F.col("start_seq"))
    live = {s: F.when(F.col(f"{s}.seq") >= F.col("start_seq"), F.col(s)) for s in SLOTS}
    return rows.select(
        "run_id", "url", (-F.col("found.earlier")).alias("page_index"),
        *[live[p].getField("chars").alias(f"chars_{p}") for p in PROFILES],
        *[live[p].getField("tokens").alias(f"tokens_{p}") for p in PROFILES],
        live["finished"].getField("js_gated").alias("js_gated"), live["finished"].isNotNull().alias("done"),
    )
