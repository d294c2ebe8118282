"""Ranked lexical search: the best documents for each query by an integer form of a term-weighting score.

**Index.** Documents are cut into shards of at most ``SHARD_DOCS`` documents or ``SHARD_WORDS`` terms (one longer text is
a shard of its own), each built by one map task without a shuffle. A row of the index is one term of one shard with
its posting list: places of the documents that hold it, in the order of their ids, and how often. The row of the empty
term lists the shard's document ids and lengths. The index holds every term of every document, whatever is asked.

**Search.** Every posting list gets a sparse table of range maxima over its impacts, so the largest impact between two
documents is two look-ups. For a query, an interval of documents is bounded by the sum of its terms' range maxima.
Intervals are taken best first, some ``WAVE`` at a time; each is split at the document of its largest single impact, which
is scored exactly, and both parts are bounded anew. Intervals whose bound cannot enter the k best so far are left
out, which drops no result; a task carries a query's k best from shard to shard. At the end the tasks' lists meet in one
ranking that Spark limits before its shuffle. Queries are searched in blocks of about ``BLOCK_QUERIES``.

All sums are 64-bit integers. Documents without terms, null texts among them, are not counted. Rows without a doc_id
take no part. Repeated rows are documents of their own and are ranked next to each other. A repeated query row is one
query; an id with several texts has a ranking for each of them. Queries without terms, and those that no document
shares a term with, give no rows; so do empty tables. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import result, shuffle_parts, small_batches, stage, staged_so_far, table

SHARD_DOCS, SHARD_WORDS = 2048, 1_000_000
BLOCK_QUERIES = 256
# Intervals that are split together.
WAVE = 64
# Shards whose lists meet in one value of the join's salt.
SHARDS_A_DEAL = 512
# A document's place within its shard, in the low bits of an impact.
_BITS = 24
_MASK = (1 << _BITS) - 1
# Terms are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of an array of numbers as binary values."""
    offsets = np.append(0, np.cumsum(sizes * values.itemsize)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _shard_rows(number: int, ids: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
    """Posting lists of one shard, and the list of its documents under the empty term."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for i in order for w in texts[i]), np.int64)
    lengths = np.array([len(texts[i]) for i in order], "<i8")
    found, times = np.unique(words * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    held = np.bincount(found // len(ids), minlength=len(known))
    total = np.bincount(words, minlength=len(known))
    names = pa.array(list(known), pa.binary()).cast(pa.string())
    rows = [
        pa.array(np.full(len(known) + 1, number)),
        pa.concat_arrays([pa.array([""]), names]),
        pa.array(np.append(len(ids), held)),
        pa.array(np.append(len(words), total)),
        pa.concat_arrays([pa.array([np.array([ids[i] for i in order], "<i8").tobytes()], pa.binary()), _binaries((found % len(ids)).astype("<i4"), held)]),
        pa.concat_arrays([pa.array([lengths.tobytes()], pa.binary()), _binaries(times.astype("<i4"), held)]),
    ]
    return pa.RecordBatch.from_arrays(rows, ["shard", "term", "held", "total", "places", "times"])


def build_index(docs: DataFrame) -> DataFrame:
    """Index rows of all documents: shard, term, held (documents), total (occurrences), places, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, words = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                if ids and (len(ids) == SHARD_DOCS or words + len(terms) > SHARD_WORDS):
                    yield _shard_rows(number, ids, texts)
                    number, ids, texts, words = number + 1, [], [], 0
                ids.append(name)
                texts.append(terms)
                words += len(terms)
        if ids:
            yield _shard_rows(number, ids, texts)

    small_batches(docs.sparkSession)
    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return known.mapInArrow(run, "shard long, term string, held long, total long, places binary, times binary")


class Shard:
    """The posting lists of one shard that a block of queries asks for, with their sparse tables."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, weights: np.ndarray, held: np.ndarray, places: np.ndarray, times: np.ndarray):
        self.ids = ids
        n, terms = len(ids), np.repeat(np.arange(len(held)), held)
        impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * norms[places]))
        # Of equal impacts the earliest document is the largest value.
        level = np.append(impact << _BITS | (_MASK - places), 0)
        tables = [level]
        for j in range(int(held.max(initial=1)).bit_length() - 1):
            level = level.copy()
            level[: -(1 << j)] = np.maximum(level[: -(1 << j)], level[1 << j :])
            tables.append(level)
        self.width, self.maxima = len(level), np.concatenate(tables)
        self.start = np.append(0, np.cumsum(held)[:-1])
        # How many documents of a list lie before each place of the shard.
        self.before = np.zeros((len(held), n + 1), np.uint16 if n < 65_536 else np.int32)
        self.before[terms, places + 1] = 1
        np.cumsum(self.before, axis=1, out=self.before)
        self.log = np.array([max(i.bit_length() - 1, 0) for i in range(n + 2)])

    def bounds(self, before: np.ndarray, start: np.ndarray, times: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bound of the scores in each interval, and the document of its largest single impact."""
        a, b = before[:, lo].astype(np.int64), before[:, hi].astype(np.int64)
        level = self.log[b - a]
        at = level * self.width + start
        top = np.where(b > a, np.maximum(self.maxima[at + a], self.maxima[at + b - (1 << level)]), 0)
        impact = (top >> _BITS) * times
        return impact.sum(0), _MASK - (top[impact.argmax(0), np.arange(len(lo))] & _MASK)

    def scores(self, before: np.ndarray, start: np.ndarray, times: np.ndarray, places: np.ndarray) -> np.ndarray:
        a = before[:, places].astype(np.int64)
        return (np.where(before[:, places + 1] > a, self.maxima[start + a] >> _BITS, 0) * times).sum(0)

    def search(self, lists: np.ndarray, times: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Enter the shard's documents into ``best``, a heap of the k best (score, -id); returns how many were scored."""
        before, start, times = self.before[lists], self.start[lists][:, None], times[:, None]
        lo, hi = np.array([0]), np.array([len(self.ids)])
        bound, split = self.bounds(before, start, times, lo, hi)
        scored = 0
        while True:
            if len(best) == k:
                least, name = best[0]
                alive = (bound > least) | ((bound == least) & (self.ids[lo] < -name))
            else:
                alive = bound > 0
            lo, hi, bound, split = lo[alive], hi[alive], bound[alive], split[alive]
            if not len(lo):
                return scored
            later = np.zeros(len(lo), bool)
            if len(lo) > WAVE:
                later[np.argpartition(-bound, WAVE)[WAVE:]] = True
            now = ~later
            at = split[now]
            scored += len(at)
            for found in zip(self.scores(before, start, times, at).tolist(), (-self.ids[at]).tolist(), strict=True):
                if found[0] > 0:
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
            new_lo, new_hi = np.concatenate([lo[now], at + 1]), np.concatenate([at, hi[now]])
            some = new_hi > new_lo
            new_lo, new_hi = new_lo[some], new_hi[some]
            new_bound, new_split = self.bounds(before, start, times, new_lo, new_hi)
            lo, hi = np.concatenate([lo[later], new_lo]), np.concatenate([hi[later], new_hi])
            bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])


def _searched(batches: Iterator[pa.RecordBatch], docs_in_all: int, terms_in_all: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of (block, shard), the empty term first: the k best documents of each query over all shards of the task."""
    best: dict[int, list[tuple[int, int]]] = {}

    def shard(rows: pa.Table) -> None:
        places, times = rows["places"].to_pylist(), rows["times"].to_pylist()
        ids, lengths = np.frombuffer(places[0], "<i8"), np.frombuffer(times[0], "<i8")
        if len(places) == 1:
            return
        norms = 75 + (25 * lengths * docs_in_all) // terms_in_all
        joined = [np.frombuffer(b"".join(x[1:]), "<i4").astype(np.int64) for x in (places, times)]
        held = np.array([len(x) // 4 for x in places[1:]])
        made = Shard(ids, norms, rows["weight"].to_numpy()[1:], held, *joined)
        asked: dict[int, list[tuple[int, int]]] = {}
        for i, asks in enumerate(rows["asks"].to_pylist()[1:]):
            for ask in asks:
                asked.setdefault(ask["query"], []).append((i, ask["times"]))
        for query, lists in asked.items():
            numbers = np.array(lists)
            made.search(numbers[:, 0], numbers[:, 1], best.setdefault(query, []), k)

    def found() -> pa.RecordBatch:
        rows = [(query, score, -name) for query, heap in best.items() for score, name in heap]
        best.clear()
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "score", "doc_id"])

    held: list[pa.Table] = []
    at: tuple[int, int] | None = None
    for batch in batches:
        keys = np.stack([batch.column("block").to_numpy(), batch.column("shard").to_numpy()], 1)
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if s == e:
                continue
            here = (int(keys[s, 0]), int(keys[s, 1]))
            if at is not None and here != at:
                shard(pa.concat_tables(held))
                held = []
                if here[0] != at[0]:
                    yield found()
            at = here
            held.append(pa.Table.from_batches([batch.slice(s, e - s)]))
    if held:
        shard(pa.concat_tables(held))
    yield found()


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query (query, text): query, rank, doc_id, score."""
    spark = index.sparkSession
    size = index.filter("term = ''").agg(F.count("*").alias("shards"), F.sum("held").alias("docs"), F.sum("total").alias("terms")).first()
    docs_in_all, terms_in_all, deals = size["docs"] or 0, size["terms"] or 0, 1 + size["shards"] // SHARDS_A_DEAL

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, t.decode()) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in terms_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["query", "term"])

    small_batches(spark)
    blocks = 1 + queries.count() // BLOCK_QUERIES
    terms = queries.select("query", "text").mapInArrow(asked, "query long, term string").groupBy("query", "term").agg(F.count("*").alias("times"))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    wanted = stage(terms.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("query", "times")).alias("asks")), "search-terms")
    lists = index.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(docs_in_all) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = wanted.join(lists.select("term", weight.alias("weight")), "term")
    # Every block of queries also reads the list of a shard's documents.
    heads = wanted.select("block").distinct().withColumn("term", F.lit("")).withColumn("asks", F.expr("cast(array() as array<struct<query: bigint, times: bigint>>)")).withColumn("weight", F.lit(0).cast("long"))
    sides = weighted.unionByName(heads).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = index.select("shard", "term", "places", "times", F.pmod(F.xxhash64("shard"), F.lit(deals)).cast("int").alias("deal"))
    met = sides.join(dealt, ["term", "deal"]).select("block", "shard", "term", "weight", "asks", "places", "times")
    parts = shuffle_parts(spark, size["shards"] * blocks, 64)
    grouped = met.repartition(parts, "block", "shard").sortWithinPartitions("block", "shard", "term")
    found = grouped.mapInArrow(lambda batches: _searched(batches, docs_in_all, terms_in_all, k), "query long, score long, doc_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item (item_id, text): item_id, rank, doc_id, score."""
    since = staged_so_far()
    index = stage(build_index(docs), "search-index", "zstd")
    queries = stage(items.select("item_id", F.col("text").cast("string")).distinct().withColumn("query", F.monotonically_increasing_id()), "search-queries")
    found = search(index, queries, k).join(queries.select("query", "item_id"), "query")
    return result(found.select("item_id", "rank", "doc_id", "score"), "search-found", since)


def op12_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the twenty best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


OP12_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
sizes AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, sizes GROUP BY term, docs),
norms AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, sizes),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
