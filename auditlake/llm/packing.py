"""Packing documents into sequences of fixed size by repeated length patterns.

Only the histogram of piece lengths goes to the driver (one count for each length up to the
sequence size, however many documents there are). Patterns of few lengths that fill a sequence
are enumerated from it, their repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and what is left is packed best-fit, again as patterns with repeats.
Pieces get their place by their rank among pieces of the same length, which is counted in
salted groups, so a length that a third of all documents share does not meet in one task.

Null texts count as empty: such a document is its end id alone. Repeated rows are packed as
often as they come; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, stage
from auditlake.llm.vocab import encoder

SALTS = 64
# Documents in an enumerated pattern at most, and second lengths tried for each first one.
PATTERN_DOCS, SECONDS = 8, 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """Each document's ids with its end id, cut into pieces of ``size`` if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced=False)
        for batch in batches:
            rows = []
            for name, ids in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(name, k, at, len(some), zlib.crc32(some.tobytes())) for k, at in enumerate(range(0, len(ids), size)) for some in (ids[at : at + size],)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], active: list[int], room: int, most: int) -> list[int]:
    """Lengths for ``room``: each time the largest that still fits, as often as there are such."""
    used: Counter[int] = Counter()
    out: list[int] = []
    top = len(active)
    while room > 0 and len(out) < most:
        top = bisect_right(active, room, 0, top)
        while top and counts[active[top - 1]] <= used[active[top - 1]]:
            top -= 1
        if not top:
            break
        pick = active[top - 1]
        used[pick] += 1
        out.append(pick)
        room -= pick
    return out


def enumerate_patterns(counts: dict[int, int], size: int) -> list[tuple[int, ...]]:
    """Few-document patterns that fill a sequence (nearly) whole, for every first length."""
    active = sorted(counts)
    total = sum(counts.values())
    cuts, run = [], 0
    for length in active:
        before, run = run, run + counts[length]
        cuts += [length] * (run * SECONDS // total - before * SECONDS // total)
    found = set()
    for first in active:
        for second in {0, size - first, *cuts}:
            room = size - first - second
            if room < 0 or second and second not in counts or second == first and counts[first] < 2:
                continue
            rest = best_fill(counts, active, room, PATTERN_DOCS - 1 - bool(second))
            pattern = (first, second, *rest) if second else (first, *rest)
            if sum(pattern) >= size - size // 512:
                found.add(tuple(sorted(pattern, reverse=True)))
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], counts: dict[int, int], rounds: int = 25) -> list[int]:
    """Non-negative least squares of the patterns' repeats to the histogram, by coordinates, rounded down.

    Rounded counts are kept within the histogram, so that they can all be packed.
    """
    left = {k: float(v) for k, v in counts.items()}
    shapes = [list(Counter(p).items()) for p in patterns]
    norms = [sum(m * m for _, m in s) for s in shapes]
    x = [0.0] * len(patterns)
    for _ in range(rounds):
        moved = 0.0
        for j, shape in enumerate(shapes):
            new = max(0.0, x[j] + sum(m * left[k] for k, m in shape) / norms[j])
            step = new - x[j]
            if step:
                x[j] = new
                moved = max(moved, abs(step))
                for k, m in shape:
                    left[k] -= m * step
        if moved < 0.25:
            break
    free = dict(counts)
    out = []
    for j, shape in enumerate(shapes):
        n = min(int(x[j] + 1e-6), *(free[k] // m for k, m in shape))
        out.append(n)
        for k, m in shape:
            free[k] -= m * n
    return out


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that use up the histogram exactly."""
    left = {k: v for k, v in histogram.items() if v > 0}
    plan: list[tuple[tuple[int, ...], int]] = [((size,), left.pop(size))] if size in left else []
    if not left:
        return plan
    patterns = enumerate_patterns(left, size)
    if patterns:
        for pattern, n in zip(patterns, fit_repeats(patterns, left), strict=True):
            if n:
                plan.append((pattern, n))
                for k in pattern:
                    left[k] -= n
    left = {k: v for k, v in left.items() if v}
    active = sorted(left)
    while active:
        first = active[-1]
        left[first] -= 1
        pattern = (first, *best_fill(left, active, size - first, size))
        left[first] += 1
        shape = Counter(pattern)
        n = min(left[k] // m for k, m in shape.items())
        plan.append((pattern, n))
        for k, m in shape.items():
            left[k] -= m * n
            if not left[k]:
                del left[k]
        active = [k for k in active if k in left]
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Where the ranks of each length go: rows (length, first rank, first sequence, offset), sorted.

    From its first rank on, a slot takes as many pieces as its pattern repeats, one a sequence.
    """
    rows, taken, sequence = [], Counter(), 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to staged pieces of at most ``size``."""
    counted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    groups = counted.groupBy("length", "salt").count()
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(pack_histogram(histogram, size))
    # One sorted number for each slot: ranks stay below 2^48 for any length below 2^15.
    keys = (table[:, 0] << 48) | table[:, 1]
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    base = groups.select("length", "salt", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = counted.withColumn("rank", rank).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table[at, 3])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """Pieces of all documents with their place: encoded once and staged as numbers, then packed."""
    return pack(stage(token_pieces(docs, path, end_id, size), "token-pieces"), size)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in sequences of 4096 with the word vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096)
