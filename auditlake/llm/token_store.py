"""Token ids of documents in binary shards with Elias-Fano document boundaries.

A shard is one self-contained byte string: a header, the documents' ends and ids as two
Elias-Fano sequences with select samples, then all ids of the shard in one array. Shards
are values of a Parquet column, so Spark's commit protocol makes them whole or absent
and a lost executor costs a retry only; ``Shard`` reads one back without any 64-bit table.
Nulls in ``text`` count as empty texts; rows with a null ``doc_id`` come first and keep it.
Repeated rows are stored as often as they come. An empty table gives an empty store. Other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import give_back, shuffle_parts, small_batches, stage
from auditlake.llm.vocab import encoder

MAGIC = b"EFIDS\x00\x00\x01"
HEADER = struct.Struct("<8sBQQQqQQ")  # magic, id width, documents, null ids, tokens, first id, bytes of ends, bytes of ids
SELECT_EVERY = 256
# A shard is closed when it holds this many ids: what a reader or writer keeps in memory at once.
SHARD_TOKENS = 2_000_000


class EliasFano:
    """A rising sequence in about 2 + log2(universe / n) bits a value, with select."""

    HEAD = struct.Struct("<QBQQ")  # values, low bits, bytes of lows, bytes of highs

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        highs = np.packbits(high, bitorder="little").tobytes()
        samples = ones[::SELECT_EVERY].astype("<u4").tobytes()
        return cls.HEAD.pack(n, low, len(lows), len(highs)) + lows + highs + samples

    def __init__(self, data: memoryview):
        self.n, self.low, lows, highs = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        self.lows = np.frombuffer(data, np.uint8, lows, at)
        self.highs = np.frombuffer(data, np.uint8, highs, at + lows)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SELECT_EVERY), at + lows + highs)

    def _low(self, i: int) -> int:
        first, last = i * self.low, (i + 1) * self.low
        value = int.from_bytes(self.lows[first // 8 : -(-last // 8)].tobytes(), "little")
        return (value >> (first % 8)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, the set bits are counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SELECT_EVERY])
        left = i % SELECT_EVERY
        byte, word = at // 8, int(self.highs[at // 8]) >> (at % 8) << (at % 8)
        while (here := word.bit_count()) <= left:
            left -= here
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return ((place - i) << self.low) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low and self.n:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def shard_bytes(doc_ids: list[int | None], documents: list[np.ndarray], width: int) -> bytes:
    """One shard of documents in rising order of id, those without an id first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64)
    head = EliasFano.encode(ends)
    names = EliasFano.encode((known - first).astype(np.uint64))
    ids = np.concatenate(documents).astype(f"<u{width}") if documents else np.empty(0, f"<u{width}")
    return HEADER.pack(MAGIC, width, len(documents), nulls, len(ids), first, len(head), len(names)) + head + names + ids.tobytes()


class Shard:
    """Reads a shard: ``bounds(i)`` and ``ids(i)`` by select, ``doc_ids()`` and ``ends()`` as arrays."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, self.n, self.nulls, self.tokens, self.first, head, names = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        self._ends = EliasFano(view[at : at + head])
        self._names = EliasFano(view[at + head : at + head + names])
        self.array = np.frombuffer(view, f"<u{self.width}", self.tokens, at + head + names)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self._ends.select(i - 1) if i else 0), self._ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.array[start:end]

    def ends(self) -> np.ndarray:
        return self._ends.all()

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self._names.all().astype(np.int64) + self.first).tolist()


def encode_documents(docs: DataFrame, path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(slice, doc_id, ids) of each document; ``bounds`` cut the id range into slices."""
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc = encoder(path, spaced=True)
        width = 2 if enc.tok.get_vocab_size() <= 1 << 16 else 4
        for batch in batches:
            names = batch.column(0)
            got = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            data = [np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes() for ids in got]
            known = names.fill_null(0).to_numpy(zero_copy_only=False)
            place = np.where(names.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(cuts, known, side="left"), 0)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), names, pa.array(data, pa.binary()), pa.array([width] * len(data), pa.int32())], ["slice", "doc_id", "ids", "width"])

    return docs.select("doc_id", "text").mapInArrow(run, "slice int, doc_id long, ids binary, width int")


def slice_bounds(docs: DataFrame, slices: int) -> list[int]:
    """Upper bounds of slices with about as many documents each; only the ids are read."""
    if slices < 2:
        return []
    at = [i / slices for i in range(1, slices)]
    row = docs.agg(F.percentile_approx("doc_id", at, 100 * slices).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def write_store(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the shards to a staged table and returns it: slice, seq, n_docs, n_tokens, payload.

    Ids are encoded once where the text is read; only packed ids are shuffled, by slices of
    the id range, and every task sorts its slices and closes shards of bounded size.
    """
    spark = docs.sparkSession
    small_batches(spark, 128)
    slices = shuffle_parts(spark, docs.select("doc_id").count())
    encoded = encode_documents(docs, path, end_id, slice_bounds(docs, slices))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, seq, names, parts, held, width = None, 0, [], [], 0, 4

        def close() -> pa.RecordBatch:
            data = shard_bytes(names, parts, width)
            return pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([data], pa.binary())})

        for batch in batches:
            for at, name, ids, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and (at != now or held >= SHARD_TOKENS):
                    yield close()
                    seq, names, parts, held = (seq + 1 if at == now else 0), [], [], 0
                now, width = at, wide
                names.append(name)
                parts.append(np.frombuffer(ids, f"<u{wide}"))
                held += len(parts[-1])
        if names:
            yield close()

    shards = encoded.repartition(slices, "slice").sortWithinPartitions("slice", F.asc_nulls_first("doc_id"))
    return stage(shards.mapInArrow(pack, "slice int, seq int, n_docs long, n_tokens long, payload binary"), "token-shards")


def read_store(shards: DataFrame) -> DataFrame:
    """One row per document, from the shards: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; offsets inside a shard come from its
    Elias-Fano ends, and shards are added up from their counts (one row per shard).
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at, seq, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(data)
                ends = shard.ends().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                whole = shard.array.astype("<u4")
                sums = [zlib.crc32(whole[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids(), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())],
                    ["slice", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    small_batches(shards.sparkSession, 4)
    rows = shards.select("slice", "seq", "payload").mapInArrow(unpack, "slice int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    before = F.sum("n_tokens").over(Window.orderBy("slice", "seq")) - F.col("n_tokens")
    base = shards.select("slice", "seq", before.alias("base"))
    return rows.join(base, ["slice", "seq"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents through the store with the byte-level vocabulary, read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_store(write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), 0))
