"""Session settings and the one helper that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every auditlake job relies on. Cluster sizing stays with spark-submit.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(cores: str = "8", app: str = "auditlake", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="auditlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


# Staged folders of this driver that are still there.
_STAGED: list[str] = []


def stage(df: DataFrame, label: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``drop_staged`` deletes what was staged.

    Cuts lineage, survives the loss of executors, and unlike an RDD checkpoint keeps columns
    prunable for the several readers the staged table usually has.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for ``drop_staged``: how many staged folders there are."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the folders that ``stage`` has written, once their readers are done.

    ``since``: only those after the mark; ``keep``: not the last so many.
    """
    gone = _STAGED[since : len(_STAGED) - keep]
    del _STAGED[since : len(_STAGED) - keep]
    dropped = 0
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        dropped += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return dropped
