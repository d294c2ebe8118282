"""Removal of passages that start in an earlier document, by sorting suffix buckets one at a time.

A suffix matters here by its first ``length`` bytes only. All suffixes of all documents would be
far too many to shuffle, so they are thinned by a cover sample first. The sample is defined by
content: of the grams inside a suffix' first ``length`` bytes the one with the smallest hash is its
cover gram, so equal suffixes have equal cover grams (a cover by residues, as in a single text,
would give equal strings at different places different sample points and needs a comparison of
pairs, which no shuffle key can make). Then:

1. texts are written once as compressed blocks, bucketed by block, so that later joins by block
   move only small masks and never a text;
2. the distinct cover grams of every block are sorted bucket by bucket; a gram in one block only
   cannot start a repeat across blocks, and a mask sends that back to the block;
3. suffixes whose cover gram is shared get a rank name, made by doubling from the ranks of their
   halves; the distinct ones of each block, with their smallest document, are sorted bucket by
   bucket, and a mask says whose repeat starts in an earlier document;
4. each block applies its mask to its texts.

A block sends each gram and each name once, however often it has it, so very common passages put
one row per block into a bucket. Sorted names and ids are sent by their steps. Exact copies of a whole text are found before by their digest and
take part in nothing else. Names have 64 bits besides the bucket's: two different strings are taken
for one with a chance of about n^2 / 2^70 for n shared suffixes.

Null texts are empty; rows with a null doc_id are kept whole and are no source; rows with one
doc_id are no source for one another; texts below ``length`` bytes are kept whole. An empty table
gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import byte_table, give_back, gram_hashes, mix, result, shuffle_parts, small_batches, stage, staged_so_far

GRAM = 24
BLOCK_BYTES = 2_000_000
# Positions hashed at once: what a worker holds besides the block.
CHUNK = 1 << 16
# Names of a bucket compared at once.
NAMES_AT_ONCE = 1 << 19
# Of a packed row of names: how many, how many ids, the bytes of a step of each, the first id.
HEAD = struct.Struct("<IIBBQ")
_SYMBOLS = byte_table(10)
_NO_ID = np.iinfo(np.int64).min
BLOCKS = "block long, ids binary, sizes binary, digests binary, texts binary, rest binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows of about ``BLOCK_BYTES`` of text: ids, sizes, digests, compressed texts, and the other columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            first, held = 0, 0
            for i in range(len(texts) + 1):
                if i < len(texts) and (held == 0 or held + len(texts[i]) <= BLOCK_BYTES):
                    held += len(texts[i])
                    continue
                some = texts[first:i]
                if some:
                    part = batch.slice(first, i - first)
                    ids = part.column("doc_id").fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, (rest := part.drop_columns(["text"])).schema) as out:
                        out.write_batch(rest)
                    row = (block, ids.astype(np.int64).tobytes(), np.array([len(t) for t in some], np.int64).tobytes(), b"".join(xxhash.xxh3_128_digest(t) for t in some), press(b"".join(some)), sink.getvalue().to_pybytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(row)], ["block", "ids", "sizes", "digests", "texts", "rest"])
                    block += 1
                first, held = i, len(texts[i]) if i < len(texts) else 0

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, BLOCKS)


class Block:
    """One block's suffixes: cover grams and names of those that lie whole inside a document."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes, copies: list[int] | None, length: int):
        import zstandard

        self.ids = np.frombuffer(ids, np.int64)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts, max_output_size=int(self.sizes.sum()) + 1), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[copies or []] = True
        self.length = length
        # Places of documents in the order of their ids: smaller rank, earlier document.
        self.rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int32)
        taking = (self.sizes >= length) & ~self.copy & (self.ids != _NO_ID)
        starts = (self.ends - self.sizes)[taking]
        counts = self.sizes[taking] - length + 1
        begin = np.cumsum(counts) - counts
        # One number for each suffix: 32 bits, since a text has less than 2 GB.
        self.at = np.repeat((starts - begin).astype(np.int32), counts)
        self.at += np.arange(len(self.at), dtype=np.int32)
        self.doc = np.repeat(np.flatnonzero(taking).astype(np.int32), counts)
        self._find_covers()

    def _find_covers(self) -> None:
        """Cover grams as runs, since suffixes in a row mostly share theirs: each run's gram, document and length.

        The smallest of some hashes is mostly small, and the first bucket would get its ``length - GRAM + 1``-fold share:
        grams are mixed once more, which keeps different ones different and spreads them over the buckets.
        """
        grams, firsts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for a, b, hashed in self._hashed(self.at, lambda s: self._least(gram_hashes(s, GRAM))):
            new = np.ones(b - a, bool)
            new[1:] = (hashed[1:] != hashed[:-1]) | (self.doc[a + 1 : b] != self.doc[a : b - 1])
            grams.append(hashed[new])
            firsts.append(np.flatnonzero(new) + a)
        self.covers, first = mix(np.concatenate(grams)), np.concatenate(firsts)
        self.cover_doc = self.doc[first]
        self.cover_runs = np.diff(first, append=len(self.at))

    def _least(self, h: np.ndarray) -> np.ndarray:
        """The smallest gram hash of each suffix' first ``length`` bytes, by doubling."""
        width, span = self.length - GRAM + 1, 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        rest = width - span
        return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h

    def _hashed(self, at: np.ndarray, make) -> Iterator[tuple[int, int, np.ndarray]]:
        """``make`` over the symbols in chunks, at rising places: from which to which place, and the hashes there."""
        for first in range(0, max(0, len(self.data) - self.length + 1), CHUNK):
            a, b = np.searchsorted(at, np.array([first, min(first + CHUNK, np.iinfo(np.int32).max)], np.int32))
            if a < b:
                hashed = make(_SYMBOLS[self.data[first : first + CHUNK + self.length - 1]])
                yield int(a), int(b), hashed[at[a:b] - first]

    def grams(self) -> np.ndarray:
        """Distinct cover grams."""
        return np.unique(self.covers)

    def shared(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of suffixes with a cover gram in the mask or in several documents here: distinct names, the
        smallest document of each, and for every such suffix its number among the names and its own place."""
        grams, group = np.unique(self.covers, return_inverse=True)
        rank = self.rank[self.cover_doc]
        low, high = np.full(len(grams), len(self.ids)), np.full(len(grams), -1)
        np.minimum.at(low, group, rank)
        np.maximum.at(high, group, rank)
        take = np.flatnonzero(np.repeat((mask | (low < high))[group], self.cover_runs)).astype(np.int32)
        if not len(take):
            return np.empty(0, np.uint64), np.empty(0, np.int32), take, take
        names = self._names(take)
        order = np.argsort(names).astype(np.int32)
        names = names[order]
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        names = names[new]
        least = np.minimum.reduceat(self.rank[self.doc[take[order]]], np.flatnonzero(new))
        number = np.empty(len(take), np.int32)
        number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return names, least, number, take

    def _names(self, take: np.ndarray) -> np.ndarray:
        out = np.empty(len(take), np.uint64)
        for a, b, hashed in self._hashed(self.at[take], lambda s: gram_hashes(s, self.length)):
            out[a:b] = hashed
        return out

    def covered(self, suffixes: np.ndarray) -> np.ndarray:
        """The bytes that removed suffixes and whole copies cover."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, self.at[suffixes], 1)
        np.add.at(edge, self.at[suffixes] + self.length, -1)
        whole = np.flatnonzero(self.copy & (self.sizes >= self.length))
        np.add.at(edge, (self.ends - self.sizes)[whole], 1)
        np.add.at(edge, self.ends[whole], -1)
        return np.cumsum(edge[:-1], dtype=np.int32) > 0


def cut_by_bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted values; buckets are equal ranges of the hash."""
    bounds = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(values, bounds), len(values))


def masks(sent: DataFrame, verdict) -> DataFrame:
    """One mask per block and bucket: ``verdict`` sorts a bucket's values of all blocks at once."""

    def run(groups: pa.Table) -> pa.Table:
        give_back()
        out = verdict(groups)
        return pa.table({"block": groups["block"], "bucket": groups["bucket"], "mask": pa.array([np.packbits(m).tobytes() for m in out], pa.binary()), "n": pa.array(list(map(len, out)), pa.int64())})

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket int, mask binary, n long")


def whole_mask(parts) -> np.ndarray:
    """A block's mask over its sorted values, put together from its buckets."""
    out = [np.unpackbits(np.frombuffer(p["mask"], np.uint8), count=p["n"]).astype(bool) for p in sorted(parts or [], key=lambda p: p["bucket"])]
    return np.concatenate(out) if out else np.empty(0, bool)


def name_rows(block: int, ids: np.ndarray, names: np.ndarray, least: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A block's names and their smallest documents by bucket.

    A bucket gets only the ids that its names need: the buckets grow with the texts, and all ids in each would outgrow them.
    """
    cuts = cut_by_bucket(names, buckets)
    full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    used = [np.unique(least[cuts[k] : cuts[k + 1]], return_inverse=True) for k in full]
    return pa.RecordBatch.from_pydict({"block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "ids": pa.array([ids[u].tobytes() for u, _ in used], pa.binary()), "names": pa.array([names[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()), "places": pa.array([p.astype(np.uint16).tobytes() for _, p in used], pa.binary())})


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row of a binary column has, and the numbers of all rows."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.array([len(p) for p in parts], np.int64), np.concatenate([*parts, np.empty(0, kind)])


def _low_bytes(numbers: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit numbers, a row each, lowest first; only as many as the largest needs."""
    return numbers.view(np.uint8).reshape(-1, 8)[:, : -(-int(numbers.max(initial=0)).bit_length() // 8)]


def pack_names(rows: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """A block's ``name_rows`` as they are shuffled: of sorted names and ids the steps from one to the next, which need fewer
    bytes than they do, and of all numbers of a row the lowest bytes first, so that high ones, mostly 0, compress."""
    (n, names), (m, ids), (_, places) = (_joined(rows.column(c), kind) for c, kind in (("names", np.uint64), ("ids", np.uint64), ("places", np.uint16)))
    at, to = np.cumsum(n) - n, np.cumsum(m) - m
    steps, id_steps = np.diff(names, prepend=names[:1]), np.diff(ids, prepend=ids[:1])
    steps[at] = names[at] - np.array([(k << 64) // buckets for k in rows.column("bucket").to_pylist()], np.uint64)
    id_steps[to] = 0
    steps, id_steps, low, high = _low_bytes(steps), _low_bytes(id_steps), places.astype(np.uint8), (places >> np.uint16(8)).astype(np.uint8)
    out = []
    for i, count, j, used in zip(at.tolist(), n.tolist(), to.tolist(), m.tolist(), strict=True):
        head = HEAD.pack(count, used, steps.shape[1], id_steps.shape[1], int(ids[j]))
        out.append(b"".join((head, steps[i : i + count].T.tobytes(), id_steps[j : j + used].T.tobytes(), low[i : i + count].tobytes(), high[i : i + count].tobytes() if used > 256 else b"")))
    return pa.RecordBatch.from_pydict({"block": rows.column("block"), "bucket": rows.column("bucket"), "names": pa.array(out, pa.binary())})


def unpack_names(groups: pa.Table, buckets: int) -> pa.Table:
    """A bucket's rows as ``name_rows`` made them."""
    out: dict[str, list[bytes]] = {"ids": [], "names": [], "places": []}
    for bucket, row in zip(groups["bucket"].to_pylist(), groups["names"], strict=True):
        data = row.as_buffer()
        count, used, wide, id_wide, first = HEAD.unpack_from(data)
        data = np.frombuffer(data, np.uint8, offset=HEAD.size)
        places = data[wide * count + id_wide * used :].reshape(-1, count)
        for name, n, w, base, part in (("names", count, wide, (bucket << 64) // buckets, data[: wide * count]), ("ids", used, id_wide, first, data[wide * count : wide * count + id_wide * used])):
            steps = np.zeros((n, 8), np.uint8)
            steps[:, :w] = part.reshape(w, n).T
            steps = steps.view(np.uint64).ravel()
            steps[0] += np.uint64(base)
            out[name].append(np.cumsum(steps, out=steps).tobytes())
        two = np.zeros((count, 2), np.uint8)
        two[:, : len(places)] = places.T
        out["places"].append(two.tobytes())
    return pa.table({c: pa.array(x, pa.binary()) for c, x in out.items()})


def in_several_blocks(groups: pa.Table) -> list[np.ndarray]:
    parts = [np.frombuffer(p.as_py(), np.uint8).reshape(-1, 5) for p in groups["grams"]]
    every = np.zeros((sum(map(len, parts)), 8), np.uint8)
    every[:, :5] = np.concatenate(parts)
    every = every.view(np.uint64).ravel()
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.split(twice, np.cumsum([len(p) for p in parts])[:-1])


def in_earlier_documents(groups: pa.Table) -> list[np.ndarray]:
    """Which names an earlier document has; a bucket's names, sorted in every row, are gone through range by range."""
    parts = [np.frombuffer(p.as_buffer(), np.uint64) for p in groups["names"]]
    places = [np.frombuffer(p.as_buffer(), np.uint16) for p in groups["places"]]
    ids = [np.frombuffer(i.as_buffer(), np.int64) for i in groups["ids"]]
    rank = np.unique(np.concatenate(ids))
    ranks = [np.searchsorted(rank, i).astype(np.int32) for i in ids]
    low, high = min(int(p[0]) for p in parts), max(int(p[-1]) for p in parts) + 1
    ranges = -(-sum(map(len, parts)) // NAMES_AT_ONCE)
    bounds = np.array([low + (high - low) * k // ranges for k in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(p, bounds).tolist(), len(p)] for p in parts]
    out = [np.empty(len(p), bool) for p in parts]
    for k in range(ranges):
        every = np.concatenate([p[c[k] : c[k + 1]] for p, c in zip(parts, cuts, strict=True)])
        if not len(every):
            continue
        doc = np.concatenate([r[at[c[k] : c[k + 1]]] for r, at, c in zip(ranks, places, cuts, strict=True)])
        order = np.argsort(every)
        every, sorted_doc = every[order], doc[order]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        first = np.minimum.reduceat(sorted_doc, np.flatnonzero(new))
        earlier = np.empty(len(every), bool)
        earlier[order] = first[np.cumsum(new) - 1] < sorted_doc
        at = 0
        for o, c in zip(out, cuts, strict=True):
            n = c[k + 1] - c[k]
            o[c[k] : c[k + 1]] = earlier[at : at + n]
            at += n
    return out


def remove_repeats(docs: DataFrame, length: int = 50, report: bool = False) -> DataFrame:
    """``docs`` with each text's remaining bytes (a character cut by a removal is dropped), staged.

    ``report``: instead one row per document with doc_id, n_bytes, n_removed, n_spans and kept_sha256.
    """
    spark = docs.sparkSession
    since = staged_so_far()
    buckets = shuffle_parts(spark)
    name = f"text_blocks_{uuid.uuid4().hex}"
    names = docs.columns
    source = docs.select("doc_id", "text") if report else docs
    blocks_of(source).write.option("compression", "none").bucketBy(buckets, "block").saveAsTable(name)
    try:
        blocks = spark.table(name)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    at = np.flatnonzero(ids != _NO_ID)
                    yield pa.RecordBatch.from_pydict({"digest": pa.array([digests[16 * i : 16 * i + 16] for i in at], pa.binary()), "doc_id": pa.array(ids[at]), "block": pa.array(np.full(len(at), block)), "place": pa.array(at.astype(np.int32))})

        small_batches(spark, 8)
        rows = blocks.select("block", "ids", "digests").mapInArrow(each, "digest binary, doc_id long, block long, place int")
        rows = stage(rows, "text-digests")
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        copies = rows.join(first, "digest").filter("doc_id > first").groupBy("block").agg(F.collect_list("place").alias("copies"))
        copies = stage(copies, "text-copies")
        columns = ["block", "ids", "sizes", "texts", "copies"]

        def send_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                for block, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    grams = Block(*parts, length).grams()
                    cuts = cut_by_bucket(grams, buckets)
                    low = grams.view(np.uint8).reshape(-1, 8)[:, :5]
                    full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "grams": pa.array([low[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())})

        sent = blocks.join(copies, "block", "left").select(*columns).mapInArrow(send_grams, "block long, bucket int, grams binary")
        packed = F.collect_list(F.struct("bucket", "mask", "n"))
        gram_masks = stage(masks(sent, in_several_blocks).groupBy("block").agg(packed.alias("gram_masks")), "gram-masks")

        def send_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                for block, *parts, gram_parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = Block(*parts, length)
                    names, least, _, _ = own.shared(whole_mask(gram_parts))
                    yield pack_names(name_rows(block, np.unique(own.ids), names, least, buckets), buckets)

        known = blocks.join(copies, "block", "left").join(gram_masks, "block", "left")
        sent = known.select(*columns, "gram_masks").mapInArrow(send_names, "block long, bucket int, names binary")
        name_masks = stage(masks(sent, lambda groups: in_earlier_documents(unpack_names(groups, buckets))).groupBy("block").agg(packed.alias("name_masks")), "name-masks")
        known = known.join(name_masks, "block", "left").select(*columns, "gram_masks", "name_masks", "rest")
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if report else docs.schema
        return result(known.mapInArrow(lambda batches: apply_masks(batches, length, report, names), schema), "without-repeats", since, "zstd")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def apply_masks(batches: Iterator[pa.RecordBatch], length: int, report: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    import hashlib

    give_back()
    for batch in batches:
        for _, *parts, gram_parts, name_parts, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Block(*parts, length)
            _, least, number, take = own.shared(whole_mask(gram_parts))
            earlier = whole_mask(name_parts)
            gone = earlier[number] | (own.rank[own.doc[take]] > least[number]) if len(take) else np.empty(0, bool)
            covered = own.covered(take[gone])
            starts = own.ends - own.sizes
            kept = [own.data[s:e][~covered[s:e]].tobytes() for s, e in zip(starts, own.ends, strict=True)]
            others = pa.ipc.open_stream(rest).read_all().combine_chunks().to_batches()[0]
            if report:
                spans = [int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if len(c) else 0 for c in (covered[s:e] for s, e in zip(starts, own.ends, strict=True))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": others.column("doc_id"), "n_bytes": pa.array(own.sizes), "n_removed": pa.array([int(n) - len(k) for n, k in zip(own.sizes, kept, strict=True)], pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                })
            else:
                texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == "text" else others.column(c) for c in names], names)


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: 50-byte repeats of earlier documents, over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50, report=True)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the passages of 50 bytes and more that an earlier document has."""
    return remove_repeats(docs, 50)
