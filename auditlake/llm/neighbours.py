"""Approximate nearest neighbours by collision counting over query-centred windows.

Largest inner product becomes nearest point: vectors are scaled by the largest norm and given one
more coordinate that brings them to the unit sphere, queries are scaled to length one. Every
block of vectors keeps, for each of m random directions, its projections as one sorted array.
A query opens a window around its own projection in every array; each round of virtual rehashing
takes a larger radius and widens the windows with it, and only what they gain is counted. A vector that has collided in enough
arrays is verified by the inner product itself, in double precision. A query is done with a block
when the k best it has lie within the round's radius.

Blocks of vectors and blocks of queries meet by a list of block pairs, so memory is bounded by
two blocks, and each pair sends on at most k rows a query. Null vectors, zero ones, and vectors
with null or non-finite components take no part; vectors of different dimension never meet.
Repeated vectors are ranked by vec_id; a row repeated whole counts once; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, stage

DIRECTIONS = 32
# Rows of a block of vectors, and of queries.
BLOCK, QUERIES_AT_ONCE = 16_384, 1024
# The radii of the rounds on the unit sphere, where distances are at most 2; a window is WIDTH times as
# wide to either side, so that a point just inside a radius collides with the same chance in each round.
RADII = (0.4, 0.8, 1.0, 1.1, 1.2, 1.3, 1.42, 2.0)
WIDTH = 1.2
# Collisions asked for lie so many standard deviations below those expected at the radius.
SLACK = 1.3


def is_sound(v: F.Column) -> F.Column:
    """Whether a vector is there, has finite components only, and is not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id and v, in doubles, of rows with a sound vector; of several with one id the smallest."""
    v = F.col("embedding").cast("array<double>")
    return table.filter(F.col("vec_id").isNotNull() & is_sound(v)).groupBy("vec_id").agg(F.min(v).alias("v"))


def directions(dim: int, m: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(1).standard_normal((m, dim + 1))


def threshold(m: int = DIRECTIONS) -> int:
    """Collisions in m arrays from which a vector is verified."""
    p = math.erf(WIDTH / math.sqrt(2))
    return math.ceil(m * p - SLACK * math.sqrt(m * p * (1 - p)))


class Index:
    """One block: vectors, and for each direction the projections in rising order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        lines = (np.column_stack([scaled, rest]) @ directions(vectors.shape[1]).T).T
        order = np.argsort(lines, axis=1, kind="stable")
        self.order, self.sorted = order.astype(np.int32), np.take_along_axis(lines, order, axis=1)

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """Up to k (query id, vec_id, score) rows of every query, nearest first."""
        norms = np.linalg.norm(queries, axis=1)
        at = np.column_stack([queries / norms[:, None], np.zeros(len(queries))]) @ directions(queries.shape[1]).T
        m, n = self.sorted.shape
        enough = threshold(m)
        lows = np.stack([[np.searchsorted(self.sorted[j], at[:, j] - WIDTH * r, "left") for j in range(m)] for r in RADII])
        highs = np.stack([[np.searchsorted(self.sorted[j], at[:, j] + WIDTH * r, "right") for j in range(m)] for r in RADII])
        out = []
        for i, name in enumerate(q_ids):
            hits = np.zeros(n, np.int64)
            todo = self.ids != name
            places, scores = np.empty(0, np.int64), np.empty(0)
            low = high = highs[0, :, i]
            for r, radius in enumerate(RADII):
                new_low, new_high = lows[r, :, i], highs[r, :, i]
                if r == 0:
                    gained = [self.order[j, new_low[j] : new_high[j]] for j in range(m)]
                else:
                    gained = [self.order[j, a:b] for j in range(m) for a, b in ((new_low[j], low[j]), (high[j], new_high[j]))]
                low, high = new_low, new_high
                hits += np.bincount(np.concatenate(gained), minlength=n)
                # The last radius is the sphere's diameter: whatever is left is near enough by then.
                verify = np.flatnonzero(todo & (hits >= enough)) if r + 1 < len(RADII) else np.flatnonzero(todo)
                if len(verify):
                    todo[verify] = False
                    places, scores = np.concatenate([places, verify]), np.concatenate([scores, self.vectors[verify] @ queries[i]])
                    best = np.lexsort((self.ids[places], -scores))[:k]
                    places, scores = places[best], scores[best]
                if len(places) == k and 2 - 2 * scores[-1] / (norms[i] * self.longest) <= radius**2:
                    break
            out += zip([int(name)] * len(places), self.ids[places].tolist(), scores.tolist(), strict=True)
        return out


_LAST: dict[tuple, Index] = {}


def blocks_of(vectors: DataFrame, rows: int, per_block: int, label: str) -> DataFrame:
    """(dim, block, ids, data, n) with at most about ``per_block`` vectors of one dimension each."""

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group["vec_id"].to_numpy(), kind="stable")
        data = group["v"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        return pa.table({"dim": group["dim"][:1], "block": group["block"][:1], "ids": pa.array([group["vec_id"].to_numpy()[order].tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    blocks = max(1, math.ceil(rows / per_block))
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    packed = dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, ids binary, data binary")
    return stage(packed, label)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all vectors but itself.

    Both inputs: vec_id, v, as ``usable_vectors`` gives them.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = vectors.agg(F.count("*"), F.max(norm)).first()
    index = blocks_of(vectors, n, BLOCK, "vector-blocks")
    asked = blocks_of(queries, queries.count(), QUERIES_AT_ONCE, "query-blocks").select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # The list of block pairs is small; each pair is one row with both blocks.
    pairs = asked.join(index, "dim").select("dim", "block", "q_block", "q_ids", "q_data", "ids", "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, _, q_ids, q_data, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dim, block, ids) not in _LAST:
                    _LAST.clear()
                    _LAST[dim, block, ids] = Index(np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim), longest)
                rows = _LAST[dim, block, ids].search(np.frombuffer(q_ids, np.int64), np.frombuffer(q_data).reshape(-1, dim), k)
                columns = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    small_batches(spark, 1)
    parts = spark.sparkContext.defaultParallelism
    found = pairs.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block", "q_block").sortWithinPartitions("dim", "block").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 20 nearest of every vector whose id is divisible by 20."""
    vectors = usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)
