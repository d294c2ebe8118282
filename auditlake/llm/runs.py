"""Periodic runs of words: stretches that repeat one phrase four times or more, and texts without the repeats.

A run is a stretch with smallest period q and a length of at least ``max(6, 4 * q)`` that no neighbouring
word extends. Each of its words stands in it four times or more, so a word that occurs less often within a
segment of the text is in no run of that segment and splits it. The pieces are split in the same way until
none changes (``surviving_segments``); ordinary prose falls apart within a few rounds. What survives is
scanned lag by lag (``scan_segment``): at lag q only every q-th word is compared, since a run holds four of
those in a row, and only stretches of four equal ones are widened to their full extent. A stretch inside a run
that was found at a divisor of its lag is that run again and is left out.

Texts are rows of a map without any shuffle. Splitting costs a few sorts of a batch, then m log m for a segment
of m words that still changes after ``ROUNDS`` rounds; a scan compares m log m words. Nothing is cut or sampled.

Null and blank texts have no words and no runs; repeated rows give repeated results; a row without a doc_id is
handled like any other; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, table

# Occurrences that every word of a run has in it, and the least length of a run.
REPEATS, SHORTEST = 4, 6
# Rounds over all segments at once; what still changes then is split piece by piece.
ROUNDS = 12
# Words of texts that are split together.
TOGETHER = 2_000_000
_WORD = r"[^\x20\x09-\x0D]+"


def _pieces(keep: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal stretches of kept positions with one owner."""
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def _settle(words: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """Split one segment to stability; of two parts only the smaller one is counted anew."""
    out, todo = [], [(start, end, Counter(words[start:end].tolist()))]
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words[start:end].tolist(), start):
        places.setdefault(w, []).append(i)
    while todo:
        lo, hi, counts = todo.pop()
        rare = [w for w, n in counts.items() if 0 < n < REPEATS]
        while rare and hi - lo >= SHORTEST:
            w = rare[-1]
            cut = next((i for i in places[w] if lo <= i < hi), None) if 0 < counts[w] < REPEATS else None
            if cut is None:
                rare.pop()
                continue
            # The word has few places in the segment, but may have many in the text: forget those that were used.
            places[w] = [i for i in places[w] if i != cut] if len(places[w]) < 64 else _without(places[w], cut)
            left, right = (lo, cut), (cut + 1, hi)
            small, large = (left, right) if cut - lo < hi - cut - 1 else (right, left)
            part = Counter(words[small[0] : small[1]].tolist())
            counts[w] -= 1
            counts.subtract(part)
            rare += [x for x in part if 0 < counts[x] < REPEATS]
            if small[1] - small[0] >= SHORTEST:
                todo.append((*small, part))
            lo, hi = large
        if hi - lo >= SHORTEST:
            out.append((lo, hi))
    return sorted(out)


def _without(places: list[int], cut: int) -> list[int]:
    places.remove(cut)
    return places


def surviving_segments(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Segments of one owner in which every word occurs ``REPEATS`` times or more, as (start, end).

    All segments are split together: a sort by segment and word counts each word within its segment.
    """
    starts, ends = _pieces(np.ones(len(words), bool), owner)
    done: list[tuple[int, int]] = []
    for turn in range(ROUNDS + 1):
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        if turn == ROUNDS:
            done += [piece for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for piece in _settle(words, s, e)]
            break
        sizes = ends - starts
        segment = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        key = segment * (int(words.max()) + 1) + words[at]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        often = np.empty(len(at), bool)
        often[order] = np.repeat(np.diff(np.append(first, len(at))) >= REPEATS, np.diff(np.append(first, len(at))))
        whole = np.logical_and.reduceat(often, np.append(0, np.cumsum(sizes)[:-1]))
        done += list(zip(starts[whole].tolist(), ends[whole].tolist(), strict=True))
        keep = np.zeros(len(words), bool)
        label = np.zeros(len(words), np.int64)
        moving = ~whole[segment]
        keep[at[moving & often]] = True
        label[at] = segment
        starts, ends = _pieces(keep, label)
    return sorted(done)


def _reach(words: np.ndarray, at: np.ndarray, lag: int, step: int, most: int) -> np.ndarray:
    """How many words in a row, from each place on in a direction, equal the word ``lag`` further on; ``most`` is enough."""
    last = len(words) - lag
    length = np.zeros(len(at), np.int64)
    alive, span = np.arange(len(at)), 8
    while len(alive):
        i = at[alive, None] + length[alive, None] * step + np.arange(span) * step
        inside = (i >= 0) & (i < last)
        i = np.clip(i, 0, last - 1)
        stop = ~(inside & (words[i] == words[i + lag]))
        run = np.where(stop.any(1), stop.argmax(1), span)
        length[alive] += run
        alive = alive[(run == span) & (length[alive] < most)]
        # Long stretches are followed in wide steps, but never more than a few million words at once.
        span = max(8, min(span * 4, 2_000_000 // max(len(alive), 1)))
    return length


def _known(active: list[tuple[int, int, int]], lag: int, at: np.ndarray) -> np.ndarray:
    """Which windows of three lags lie in a run that was found at a divisor of the lag."""
    runs = sorted((s, s + length) for s, length, q in active if lag % q == 0)
    if not runs:
        return np.zeros(len(at), bool)
    starts, ends = np.array(runs).T
    place = np.searchsorted(starts, at, "right") - 1
    return (place >= 0) & (np.maximum.accumulate(ends)[place] > at + 3 * lag)


def scan_segment(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a segment as (start, length, period), by start and period."""
    n = len(words)
    found: list[tuple[int, int, int]] = []
    active: list[tuple[int, int, int]] = []
    for lag in range(1, n // REPEATS + 1):
        picked = words[::lag]
        same = picked[1:] == picked[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * lag
        if not len(at):
            continue
        active = [r for r in active if r[1] > 3 * lag]
        at = at[~_known(active, lag, at)]
        at = at[_reach(words, at, lag, 1, 2 * lag + 1) > 2 * lag]
        if not len(at):
            continue
        # Windows one lag apart overlap, so they are one stretch: its first window stands for it.
        at = at[np.append(True, np.diff(at) > lag)]
        ahead, behind = _reach(words, at, lag, 1, n), _reach(words, at - 1, lag, -1, n)
        lengths = ahead + behind + lag
        good = lengths >= max(SHORTEST, REPEATS * lag)
        new = [(s, length, lag) for s, length in sorted(set(zip((at - behind)[good].tolist(), lengths[good].tolist(), strict=True)))]
        found += new
        active += new
        if (0, n, lag) in new:
            # A longer run inside this one would share so much with it that it had a divisor of both periods.
            break
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts, given as their words: (start, length, period) by start and period."""
    known: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sum(sizes))
    owner = np.repeat(np.arange(len(texts)), sizes)
    begins = np.append(0, np.cumsum(sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in surviving_segments(words, owner) if len(words) else []:
        text = int(owner[start])
        shift = start - int(begins[text])
        out[text] += [(s + shift, length, q) for s, length, q in scan_segment(words[start:end])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, kept in zip(words, keep.tolist(), strict=True) if kept]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, runs (start, length, period; by start, then period) and collapsed, the text without repeats."""
    shape = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Arrow strings are UTF-8, and bytes are split at the six white-space characters of ASCII.
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            runs: list[list[tuple[int, int, int]]] = []
            part: list[list[bytes]] = []
            for text in texts:
                part.append(text)
                if sum(map(len, part)) >= TOGETHER:
                    runs += runs_of(part)
                    part = []
            runs += runs_of(part)
            lists = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            kept = [b" ".join(collapse(t, r)).decode() for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten, told by a checksum of its id, repeats a phrase of its own from some word on.

    With h the crc32 of the decimal id and g = h div 10: of n words, each word i >= a = g % n becomes word
    a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8). Others keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    marked = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    # Nested selects: a projection of one level would compute the list of words for every use of it.
    changed = F.expr(
        """aggregate(array(words), cast(null as string), (none, w) -> aggregate(array(size(w)), cast(null as string), (no, n) ->
           aggregate(array(g % n), cast(null as string), (nil, a) -> aggregate(array(1 + (n - a) div (3 + g % 8)), cast(null as string), (nought, p) ->
           array_join(transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')))))"""
    )
    split = marked.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    return split.select("doc_id", F.when(F.size("words") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_recursive_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: runs of all documents, some of which repeat a phrase of their own."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as earlier, -r.period as shorter)))")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    best = found.withColumn("top", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.earlier")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.shorter")).alias("period"),
        F.expr("top.length * 1000 div -top.shorter").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# One step of the checksum over half a byte: its table follows from the polynomial.
_NIBBLES = [0] * 16
for _i in range(16):
    _value = _i
    for _ in range(4):
        _value = (_value >> 1) ^ (0xEDB88320 if _value & 1 else 0)
    _NIBBLES[_i] = _value
_HALF = "xor({0} >> 4, [" + ", ".join(map(str, _NIBBLES)) + "][({0} & 15) + 1])"

# Equal words of one text at every distance; islands of consecutive places at one distance are stretches with that
# period, and of equal stretches the least period counts.
OP11_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: {_HALF.format("(" + _HALF.format("xor(x, b)") + ")")})) AS h
  FROM documents),
split AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM hashed),
lengths AS (SELECT *, len(w) AS n FROM split),
starts AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM lengths),
phrases AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM starts),
made AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM phrases),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM made),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM
  (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS top,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s::BIGINT AS start, -top.l::BIGINT AS length, top.p::BIGINT AS period,
  (-top.l * 1000 // top.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
