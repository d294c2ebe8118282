"""A table that every batch of a stream adds to, so that a batch can be done again after a failure.

Batch ``n`` writes its own folder and reads only those of earlier batches: repeating it, as a stream does after a
lost driver, gives the same folder. Rows of one key are merged when they are read. Every ``FULL_EVERY`` batches the
merged table is written whole, so a reader never opens more than that many folders, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FULL_EVERY = 32


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge

    def _folders(self) -> dict[tuple[str, int], str]:
        """Written folders by kind and batch; unfinished ones have no success mark yet."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return {}
        out = {}
        for status in files.listStatus(root):
            kind, _, batch = status.getPath().getName().partition("-")
            if batch.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out[kind, int(batch)] = status.getPath().toString()
        return out

    def rows(self, before: int | None = None) -> DataFrame:
        """The merged table as it was before a batch, or as it is."""
        folders = {k: p for k, p in self._folders().items() if before is None or k[1] < before}
        full = max((n for kind, n in folders if kind == "full"), default=-1)
        paths = [p for (kind, n), p in folders.items() if (kind == "full" and n == full) or (kind == "batch" and n > full)]
        read = self.spark.read.schema(self.schema)
        return self.merge(read.parquet(*paths)) if paths else self.spark.createDataFrame([], self.schema)

    def empty(self) -> bool:
        return not self._folders()

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        if batch % FULL_EVERY == FULL_EVERY - 1:
            self.rows(batch + 1).write.mode("overwrite").parquet(f"{self.path}/full-{batch}")
