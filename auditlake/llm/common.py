"""What several of these operators share: batches of bounded size, staged tables, byte hashes."""

from __future__ import annotations

import ctypes
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.session import drop_staged, stage, staged_so_far

__all__ = ["BATCH_ROWS", "byte_table", "give_back", "gram_hashes", "mix", "result", "shuffle_parts", "small_batches", "stage", "staged_so_far", "table"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Rows of one Arrow batch: texts can be long, and a batch is held in a worker's memory.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold at most ``rows`` rows, so that long texts fit a worker.

    Workers on this machine also learn where the package lies; a cluster ships it with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), ROOT]))


def give_back() -> None:
    """Hand memory that earlier work of this worker left unused in its allocators back to the system.

    Workers serve many stages, and each would else hold the most that any of them took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def result(df: DataFrame, label: str, since: int, compression: str = "snappy") -> DataFrame:
    """An operator's result, staged; what it staged on the way, after the mark ``since``, is deleted."""
    out = stage(df, label, compression)
    drop_staged(df.sparkSession, since, keep=1)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession, rows: int = 0, per_part: int = 20_000) -> int:
    """Parts for a keyed repartition: the session's setting, more when the rows call for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part), 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 random 64-bit numbers, one for each byte value."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


def gram_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive symbols (already 64-bit random values).

    Spans are doubled: the hash of 2n symbols is made from those of its two halves, so a
    gram of any length costs a few passes over the array.
    """
    m = np.uint64(0x9E3779B97F4A7C15)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        out = a[:n] ^ (a[:n] >> np.uint64(29))
        out *= m
        out += b[:n]
        return out

    if len(symbols) < length:
        return np.empty(0, np.uint64)
    power, span, have, acc = symbols, 1, 0, None
    rest = length
    while rest:
        if rest & 1:
            acc = power[have:] if acc is None else join(acc, power[have:])
            have += span
        rest >>= 1
        if rest:
            power = join(power, power[span:])
            span *= 2
    return mix(acc[: len(symbols) - length + 1])
