"""Replay, then tail: a subscriber that comes late gets every past event of a run in order, then the live ones.

The stored log is delivered as one batch, then the live stream takes over. The two overlap, and a live log may repeat
events; a ledger of the last place and number delivered for each run tells what is new, so each event is delivered
once. A run's events must be written to the live log in the order of ``seq``; different runs may be mixed in any
way. The first terminal event closes a run: nothing after it is delivered.

Each batch writes a folder of its own under ``path``/events and reads the ledger of earlier batches only, so a
subscriber that is started again from its checkpoint neither loses nor repeats an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from auditlake.operators.windows import ordinal_within
from auditlake.streaming.events import TERMINAL
from auditlake.streaming.ledger import Ledger

DELIVERED = "run_id STRING, last_seq BIGINT, events BIGINT, ended BOOLEAN"


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.max("last_seq").alias("last_seq"), F.max("events").alias("events"), F.max("ended").alias("ended"))


def deliveries(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, f"{path}/delivered", DELIVERED, _merged)


def deliver(events: DataFrame, batch: int, path: str) -> None:
    """Append what is new of a batch to the subscriber's events, with its place in the run's log from 0."""
    spark = events.sparkSession
    ledger = deliveries(spark, path)
    events = events.persist()
    seen = events.join(ledger.rows(batch), "run_id", "left").where(~F.coalesce("ended", F.lit(False)) & (F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))))
    ends = seen.where(F.col("type").isin(*TERMINAL)).groupBy("run_id").agg(F.min("seq").alias("end_seq"))
    new = seen.dropDuplicates(["run_id", "seq"]).join(ends, "run_id", "left").where(F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    placed = ordinal_within(new, ["run_id"], "seq", "in_batch").withColumn("place", F.coalesce("events", F.lit(0)) + F.col("in_batch"))
    target = f"{path}/events/batch={batch}"
    placed.drop("last_seq", "events", "ended", "end_seq", "in_batch").sortWithinPartitions("run_id", "place").write.mode("overwrite").parquet(target)
    # Read back, so the ledger says what was written and the window is not computed twice.
    written = spark.read.schema(placed.select("run_id", "seq", "type", "place").schema).parquet(target)
    ledger.write(batch, written.groupBy("run_id").agg(F.max("seq").alias("last_seq"), (F.max("place") + 1).alias("events"), F.max(F.col("type").isin(*TERMINAL)).alias("ended")))
    events.unpersist()


def subscribe(stored: DataFrame, live: DataFrame, path: str) -> DataStreamWriter:
    """Deliver the stored log, unless that was done before, and go on with the live stream of the same columns."""
    if deliveries(stored.sparkSession, path).empty():
        deliver(stored, 0, path)
    return live.writeStream.foreachBatch(lambda events, batch: deliver(events, batch + 1, path)).option("checkpointLocation", f"{path}/checkpoint")


def delivered(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame:
    """All delivered events; ``columns`` is any frame with the log's schema."""
    schema = T.StructType([*columns.schema.fields, T.StructField("place", T.LongType()), T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/events")
