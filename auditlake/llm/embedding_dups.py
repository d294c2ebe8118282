"""Near-duplicate embeddings of one label, found through an inverted multi-index.

Each half of the (unit) vectors has its own codebook, fitted on a bounded sample; the pairs of
codewords are the cells of a grid, and every vector lies in one cell of its label. A vector visits
cells in the order of the multi-sequence traversal, nearest sum of squared distances first, until
the sum exceeds the nearest one by a radius at which the target share of partners at the threshold
has been met; that radius is measured on sample vectors and partners made for them. Whatever
shares a visited cell is verified by its cosine in double precision.

Equal vectors of a label are one node with a count. Cells are cut into blocks of visitors and of
residents, so no task holds a whole large cell; a block gives counts per node and the edges of a
spanning forest, never all its pairs. Of two nodes only the one with the smaller id visits for the
pair, so each link is counted once.

Vectors that are null, zero, or have null or non-finite components, and rows without a label or
vec_id, have no links and are kept. Rows with one vec_id count as one vector (the smallest label
and vector, if they differ); an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import result, small_batches, stage, staged_so_far
from auditlake.llm.near_dups import components
from auditlake.llm.neighbours import is_sound

# Vectors that codebooks and radius are fitted on at most, and those of a dimension needed to fit.
SAMPLE = 8000
# Vectors of a cell to aim at, and codewords of a half at most.
PER_CELL, MOST_WORDS = 128, 64
TARGET = 0.999
BLOCK = 1024


class Grid:
    """Codebooks of both halves and the radius of the traversal."""

    def __init__(self, sample: np.ndarray, cells: float, least: float):
        self.half = max(1, sample.shape[1] // 2)
        words = int(min(MOST_WORDS, max(1, round(math.sqrt(cells))), len(sample)))
        self.books = [self._fit(sample[:, : self.half], words), self._fit(sample[:, self.half :], words)]
        self.radius = self._radius(sample[:2000], least)

    @staticmethod
    def _fit(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
        """k-means from evenly spaced sample rows."""
        centres = x[np.linspace(0, len(x) - 1, words).astype(int)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            for k in range(words):
                if (near == k).any():
                    centres[k] = x[near == k].mean(0)
        return centres

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their codewords."""
        parts = x[:, : self.half], x[:, self.half :]
        return tuple(np.maximum(0, (p**2).sum(1)[:, None] + (b**2).sum(1) - 2 * p @ b.T) for p, b in zip(parts, self.books, strict=True))

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.costs(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def _radius(self, x: np.ndarray, least: float) -> float:
        """Excess of the cell cost under which the target share of partners at the threshold lies."""
        noise = np.random.default_rng(5).standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        partner = least * x + math.sqrt(1 - least**2) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 0)
        (a, b), cell = self.costs(x), self.home(partner)
        i, j = np.divmod(cell, len(self.books[1]))
        rows = np.arange(len(x))
        excess = a[rows, i] - a.min(1) + b[rows, j] - b.min(1)
        return float(np.quantile(excess, TARGET)) if len(excess) else 0.0

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells of one vector by the multi-sequence traversal: rows and columns in rising cost, the
        cheapest open cell of the grid next, until its excess is beyond the radius."""
        from heapq import heappop, heappush

        i_order, j_order = np.argsort(a), np.argsort(b)
        a, b = (a[i_order] - a[i_order[0]]).tolist(), (b[j_order] - b[j_order[0]]).tolist()
        out, heap, seen = [], [(0.0, 0, 0)], {(0, 0)}
        while heap:
            cost, i, j = heappop(heap)
            if cost > self.radius and out:
                break
            out.append(int(i_order[i]) * len(b) + int(j_order[j]))
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heappush(heap, (a[x] + b[y], x, y))
        return out


def compare_block(group: pa.Table, least: float) -> pa.Table:
    """Links of a block's visitors with its residents: per node how many vectors it linked with, and
    the root of its part of the block's links."""
    node, n = group["node"].to_numpy(), group["n"].to_numpy()
    x = group["u"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    visits = group["visits"].to_numpy(zero_copy_only=False)
    v, r = np.flatnonzero(visits), np.flatnonzero(~visits)
    linked = (x[v] @ x[r].T >= least) & (node[v][:, None] < node[r])
    found = np.zeros(len(node), np.int64)
    found[v], found[r] = linked @ n[r], n[v] @ linked
    root = node.copy()
    while True:
        before = root.copy()
        big = np.iinfo(np.int64).max
        if len(v) and len(r):
            root[v] = np.minimum(root[v], np.where(linked, root[r], big).min(1))
            root[r] = np.minimum(root[r], np.where(linked, root[v][:, None], big).min(0))
        if (before == root).all():
            break
    some = np.flatnonzero(found)
    return pa.table({"node": node[some], "found": found[some], "root": root[some]})


def near_duplicates(table: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``table`` (vec_id, embedding, label)."""
    spark = table.sparkSession
    since = staged_so_far()
    small_batches(spark, 4096)
    v = F.col("embedding").cast("array<double>")
    sound = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_sound(v))
    one = sound.groupBy("vec_id").agg(F.min(F.struct("label", v.alias("v"))).alias("x")).select("vec_id", "x.label", "x.v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform("v", F.abs))
    one = one.withColumn("v", F.transform("v", lambda x: x / top)).withColumn("norm", norm).select("vec_id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
    one = stage(one, "unit-vectors")
    nodes = stage(one.groupBy("label", "u").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).withColumn("dim", F.size("u")), "vector-nodes")
    sizes = nodes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most")).collect()
    grids = {}
    for dim, most in sizes:
        drawn = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("u").collect()
        grids[dim] = Grid(np.array([r["u"] for r in drawn]), most / PER_CELL, least)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                x = some.column(3).flatten().to_numpy().reshape(-1, dim)
                a, b = grids[dim].costs(x)
                cells = [grids[dim].visits(p, q) for p, q in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(grids[dim].home(x), pa.int64()), pa.array(cells, pa.list_(pa.int64()))], ["label", "node", "dim", "u", "n", "home", "cells"])

    schema = "label int, node long, dim int, u array<double>, n long, home long, cells array<long>"
    placed = stage(nodes.select("label", "node", "dim", "u", "n").mapInArrow(place, schema), "placed-vectors")
    lying = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("r_blocks"))
    coming = placed.select("label", "dim", F.explode("cells").alias("cell")).groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("v_blocks"))
    cut = lying.join(coming, ["label", "dim", "cell"])
    own = F.xxhash64("node")
    shape = ["label", "dim", "cell", "r", "v", "visits", "node", "u", "n"]
    residents = placed.withColumn("cell", F.col("home")).join(cut, ["label", "dim", "cell"]).withColumn("r", F.pmod(own, F.col("r_blocks"))).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_blocks").cast("long") - 1))).withColumn("visits", F.lit(False))
    visitors = placed.withColumn("cell", F.explode("cells")).join(cut, ["label", "dim", "cell"]).withColumn("v", F.pmod(own, F.col("v_blocks"))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r_blocks").cast("long") - 1))).withColumn("visits", F.lit(True))
    met = residents.select(*shape).union(visitors.select(*shape)).groupBy("label", "dim", "cell", "r", "v").applyInArrow(lambda g: compare_block(g, least), "node long, found long, root long")
    met = stage(met, "block-links")
    links = met.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    label = components(links)
    found = met.groupBy("node").agg(F.sum("found").alias("found"))
    by_node = nodes.select(F.col("label").alias("l"), F.col("u").alias("w"), "node", "n").join(found, "node", "left").join(label, "node", "left")
    known = one.join(by_node, (F.col("label") == F.col("l")) & (F.col("u") == F.col("w")))
    known = known.select("vec_id", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = table.select("vec_id").join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "embedding-duplicates", since)


def op5_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: links at cosine 0.93 within labels, over all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), 0.93)
