"""MinHash near-duplicates by min-max hashing: both ends of every permutation go into the signature.

Documents are sets of word shingles. One pass over the texts hashes them and keeps, for every
permutation, the smallest and the largest value, so a signature of 2k values costs k permutations.
Documents with one and the same set are one node from then on. Bands of the signature put nodes
into buckets; links are confirmed on full sets only, and found in rounds:

1. in every bucket, each node is paired with the bucket's centre, the node that shares buckets
   with the most others (so a bucket of n gives n - 1 pairs, not n squared); distinct pairs whose
   fine signatures agree are confirmed, and links joined to components;
2. buckets whose nodes are all in one component are done. In the others every pair of nodes of
   different components is still open. A bucket is cut into blocks of ``BLOCK`` nodes (fewer, if
   their sets are large: ``BLOCK_SHINGLES``), and the nodes outside its main component, which
   visit every block, are cut in the same way; each block of visitors is a group of its own with
   each block of nodes, so no group holds more than two blocks. There they are compared by fine signatures
   alone. Nodes that agree with others across components, bucket by bucket, fall into clusters; these are cut into
   blocks in the same way, now with the nodes' sets, each of which is so sent once and not for every bucket. A visitor
   sends on one link for each component that it reaches, found on full sets.

Fine signatures are compared with a margin under which a true link falls with a chance of 3e-7. So no link
between components is lost to the pairing, and a group of thousands of copies is never expanded into pairs.
Texts are shuffled once, to make the fine signatures and sets of the nodes that share a bucket with another.

Null and empty texts have no shingles, stay alone and are kept; a text with fewer words than a
shingle is one shingle, its whole sequence. Repeated rows fall together; ties go to the smaller
doc_id; rows with a null doc_id take no part and come out alone. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import mix, result, small_batches, stage, staged_so_far

PERMUTATIONS, ROWS = 48, 4
BLOCK = 1500
# Shingles of the nodes of a block, on average: 64 MB of sets.
BLOCK_SHINGLES = 8_000_000
# Shingles that go through all permutations at once: small arrays stay in a processor's cache.
AT_ONCE = 1024
# Permutations of the fine signature, one byte for each of its 2 * FINE values, and how many standard
# deviations below the threshold an agreement may lie: a true link falls with a chance of 3e-7.
FINE, DEVIATIONS = 256, 5.0


class _Words(dict):
    """Word to its hash; bounded by being dropped when large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_KNOWN = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    global _KNOWN
    if len(_KNOWN) > _Words.LIMIT:
        _KNOWN = _Words()
    # bytes.lower changes A-Z only, and bytes.split cuts at the six ASCII white-space characters.
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out + h[k : k + n])
    return np.unique(out)


_TURN = np.random.default_rng(8).integers(0, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def both_ends(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest and largest value of a set under each permutation: first the minima, then the maxima."""
    turns = _TURN[:permutations, None]
    lows, highs = np.full(permutations, 2**64 - 1, np.uint64), np.zeros(permutations, np.uint64)
    for s in range(0, len(shingles), AT_ONCE):
        moved = shingles[s : s + AT_ONCE] * turns
        moved ^= moved >> np.uint64(32)
        moved *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(lows, moved.min(axis=1), out=lows)
        np.maximum(highs, moved.max(axis=1), out=highs)
    return np.concatenate([lows, highs])


def signature(shingles: np.ndarray) -> np.ndarray:
    """32 bits of each end of ``PERMUTATIONS`` permutations, for the bands."""
    return (both_ends(shingles, PERMUTATIONS) >> np.uint64(32)).astype("<u4")


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    """A byte of each end of ``FINE`` permutations; equal bytes of unequal ends only raise an agreement."""
    return (mix(both_ends(shingles, FINE)) >> np.uint64(56)).astype(np.uint8)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` values; a band takes both ends of its permutations."""
    both = sig.reshape(2, PERMUTATIONS).T.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(len(both), dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + both[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set) and signature; one pass, no shuffle."""
    schema = "doc_id long, n_shingles long, set_key binary, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, fine, shingles): fine signature and sorted shingle hashes of the wanted documents, from their texts."""
    # The list of wanted ids grows with the input: it is merged at every size, never sent around whole.
    texts = docs.select("doc_id", "text").filter("doc_id is not null").join(wanted.hint("merge"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            fine = [fine_signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "fine", "shingles"])

    return texts.mapInArrow(run, "node long, fine binary, shingles binary").filter("fine is not null").dropDuplicates(["node"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def pairs_where(pairs: DataFrame, sets: DataFrame, column: str, holds) -> DataFrame:
    """The (a, b) pairs for which ``holds`` of the two nodes' binary column."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col(column).alias("of_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col(column).alias("of_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(holds(x, y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Of (a, b) pairs those whose full sets have ``percent`` of their union in common; most others fall by their signatures."""
    agree = pairs_where(pairs, sets, "fine", lambda x, y: (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() >= least)
    return pairs_where(agree, sets, "shingles", lambda x, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in some link: the smallest node reachable from it.

    Each round points every node to the smallest component among its neighbours and then to that
    one's own (path halving); rounds end when nothing changes.
    """
    edges = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "component")
    while True:
        seen = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = label.join(seen, "node").select("node", F.least("component", "near").alias("near"), "component")
        jump = label.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = stage(near.join(jump, "near").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved")), "component")
        label = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return label


def _candidates(members: pd.DataFrame, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each visitor of a block with the nodes of other components that agree with it, best first; by row numbers."""
    comp, visits = members["component"].to_numpy(), members["visits"].to_numpy(bool)
    fine = np.frombuffer(b"".join(members["fine"]), np.uint8).reshape(len(members), -1)
    here = np.flatnonzero(~visits)
    for i in np.flatnonzero(visits):
        others = here[comp[here] != comp[i]]
        agree = (fine[others] == fine[i]).mean(axis=1)
        order = np.argsort(-agree, kind="stable")[: int((agree >= least).sum())]
        if len(order):
            yield int(i), others[order]


def agreeing(members: pd.DataFrame, least: float) -> pd.DataFrame:
    """Edges (a, b) from the smallest of the nodes that agree across components, directly or by others, to each of them.

    There are fewer than nodes, and buckets that hold the same nodes give the same edges.
    """
    node, root = members["node"].to_numpy(), np.arange(len(members))
    for i, others in _candidates(members, least):
        # Members of the trees that meet here get the root whose node is smallest.
        meet = np.unique(root[np.append(others, i)])
        root[np.isin(root, meet)] = meet[node[meet].argmin()]
    far = node != node[root]
    return pd.DataFrame({"a": node[root][far], "b": node[far]}, dtype="int64").drop_duplicates()


def links_across(members: pd.DataFrame, least: float, percent: int) -> pd.DataFrame:
    """Links of a group's visitors to nodes of other components, found on full sets: one for each visitor and component."""
    node, comp = members["node"].to_numpy(), members["component"].to_numpy()
    sets = [np.frombuffer(m, np.uint64) for m in members["shingles"]]
    out = []
    for i, others in _candidates(members, least):
        reached = set()
        for j in others:
            if comp[j] not in reached and linked(sets[i], sets[j], percent):
                reached.add(comp[j])
                out.append((min(node[i], node[j]), max(node[i], node[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def dealt(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups of blocks from (key, node, component): keys with several components, nodes and visitors cut into blocks.

    Every node lies in one block of its key, for all blocks of visitors; a visitor, a node outside the key's main
    component, is in one of those, for all blocks of nodes.
    """
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    left = named.select("key", "node", "component").join(split.select("key", "main"), "key").join(nodes.select("node", "shingles"), "node")
    left = stage(left.withColumn("visits", F.col("component") != F.col("main")), "open-keys")

    def blocks(which: str) -> F.Column:
        n, shingles = F.count_if(F.expr(which)), F.sum(F.when(F.expr(which), F.col("shingles")))
        return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")

    cut = left.groupBy("key").agg(blocks("true").alias("r_blocks"), blocks("visits").alias("v_blocks"))
    left = left.select("key", "node", "component", "visits").join(cut, "key")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    one_of = lambda blocks, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(blocks)).cast("int")
    lying = left.withColumn("r_block", one_of("r_blocks", 1)).withColumn("v_block", every("v_blocks")).withColumn("visits", F.lit(False))
    visiting = left.filter("visits").withColumn("r_block", every("r_blocks")).withColumn("v_block", one_of("v_blocks", 2))
    columns = ["key", "r_block", "v_block", "visits", "node", "component"]
    return lying.select(columns).union(visiting.select(columns))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    since = staged_so_far()
    known = stage(signatures(docs, size), "signatures")
    sets = known.filter("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min_by("signature", "doc_id").alias("signature"), F.max("n_shingles").alias("shingles"))
    nodes = stage(sets, "nodes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(s, "<u4")) for s in batch.column(1).to_pylist()]
            n = len(keys[0]) if keys else 0
            node = np.repeat(batch.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(keys) if keys else [], pa.int64())], ["node", "key"])

    banded = nodes.select("node", "signature").mapInArrow(bands, "node long, key long")
    # Bands with one node only are most of all and go first; what is left is small and staged.
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage(banded.join(shared, "key"), "bucket-members")
    # A bucket's centre is the node that meets the most others anywhere: what copies were made from.
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    centre = members.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre"))
    stars = members.join(centre, "key").filter("node <> centre")
    pairs = stage(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "star-pairs")
    fine_and_sets = stage(sets_of(docs, members.select(F.col("node").alias("doc_id")).distinct(), size), "shingle-sets")
    least = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / (2 * FINE)) ** 0.5
    links = stage(confirmed(pairs, fine_and_sets, least, percent), "star-links")
    label = components(links)

    def with_component(rows: DataFrame) -> DataFrame:
        return rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))

    groups = dealt(with_component(members), nodes).join(fine_and_sets.select("node", "fine"), "node").groupBy("key", "r_block", "v_block")
    near = stage(groups.applyInPandas(lambda m: agreeing(m, least), "a long, b long").distinct(), "agreeing")
    if not near.isEmpty():
        clusters = with_component(components(near).withColumnRenamed("component", "key"))
        groups = dealt(clusters, nodes).join(fine_and_sets, "node").groupBy("key", "r_block", "v_block")
        links = links.union(stage(groups.applyInPandas(lambda m: links_across(m, least, percent), "a long, b long").distinct(), "links-across"))
        label = components(links)

    by_set = nodes.select("set_key", "node").join(label, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = known.drop("signature").join(by_set, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return result(out, "near-duplicates", since)


def op8_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: near-duplicates of all documents on two-word shingles at 80 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays, five-word shingles at 0.8."""
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").union(docs.filter("doc_id is null"))
