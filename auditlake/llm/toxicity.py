"""Toxicity by compression distance: zstandard dictionaries for each of two kinds of text.

Each window of text is compressed with dictionaries made from toxic and from ordinary training
text; how much shorter the best of the first comes out is the window's distance. A window is one
word, written three times: zstandard stores very short inputs as they are, and repeating a word
brings its first occurrence, the one that the dictionary can shorten, into a compressed block
(words of marked kinds then differ by 4 to 9 bytes, others mostly by none). All
dictionaries share their first part, the commonest words of all training text, so what differs
is the part drawn from texts of one label only: the words that mark it, by likelihood ratio,
the strongest last, where zstandard reaches them most cheaply. Every word that marks toxic text
is in some dictionary: there are as many pairs as the list needs, and the ordinary dictionary of
a pair has the same length, filled with the strongest words of its own label that fit. A word
counts once for a group of near copies, so a text sent out many times marks no more words than
one sent once; in the calibration a group weighs as much as one text. Stock dictionary training takes
what is common in its samples, which is nearly the same for both labels here (area under the
curve 0.5 to 0.66 on held-out rows, against about 0.86), hence the choice of samples by contrast.
A document's distances are summarised and turned into a probability by a logistic calibration
fitted on other training rows than the dictionaries'.

Null and empty texts get the score of a text without any window. Repeated rows are scored as
often as they come; without labels of both kinds every score is 0.5 below the threshold, i.e. 0.
Other columns are not read for a score. A text of one huge word is one window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches
from auditlake.llm.near_dups import band_keys, shingle_set, signature

REPEATS = 3
# Distances kept for words met before, by each worker.
KNOWN = 300_000
# Characters of texts whose words are met together, and of unknown words worked out together.
TEXT_AT_ONCE, AT_ONCE = 1 << 20, 1 << 16
# Bytes of the shared and of the labels' own parts of a dictionary.
SHARED, OWN = 1024, 512
# The shortest match that a compressor looks for.
MATCH = 5
# Training texts with this share of the union of their two-word shingles in common are one group of near copies.
COPIES = 0.5
# Training rows of each label at most: what the driver fits on, however many labels there are.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
# A word marks a label from this ratio of document shares on, if at least so many documents have it
# and its likelihood ratio is above what chance gives the luckiest of so many words, by a margin.
ODDS, DOCS, MARGIN = 4.0, 3, 8.0


class _Side:
    """The dictionaries of one label."""

    def __init__(self, books: list[bytes]):
        self.compressors = [_compressor(book) for book in books]
        # Only a dictionary that has MATCH bytes in a row of a window can shorten it; the first one is always tried.
        having = [np.unique(_runs_of_bytes(np.frombuffer(book, np.uint8))) for book in books[1:]]
        runs, owner = np.concatenate([*having, np.empty(0, np.uint64)]), np.repeat(np.arange(1, len(having) + 1), [len(h) for h in having])
        self.runs, self.count = np.unique(runs, return_counts=True)
        self.owner, self.first = owner[np.argsort(runs, kind="stable")], np.cumsum(self.count) - self.count

    def shortest(self, windows: list[bytes], runs: np.ndarray, window_of: np.ndarray) -> np.ndarray:
        """Per window, its length under the best dictionary; ``runs``: the windows' bytes, MATCH in a row, and whose they are."""
        out = _lengths(self.compressors[0], windows)
        if len(self.runs):
            at = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
            hit = np.flatnonzero(self.runs[at] == runs)
            at, n = at[hit], self.count[at[hit]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(self.owner[np.repeat(self.first[at], n) + nth] * len(windows) + np.repeat(window_of[hit], n))
            for k in np.unique(pairs // len(windows)).tolist():
                some = pairs[pairs // len(windows) == k] % len(windows)
                out[some] = np.minimum(out[some], _lengths(self.compressors[k], [windows[i] for i in some.tolist()]))
        return out


def _runs_of_bytes(data: np.ndarray) -> np.ndarray:
    """Every MATCH bytes in a row as one number."""
    n = max(0, len(data) - MATCH + 1)
    out = np.zeros(n, np.uint64)
    for i in range(MATCH):
        out <<= np.uint64(8)
        out |= data[i : i + n]
    return out


def _lengths(compressor, windows: list[bytes]) -> np.ndarray:
    """The windows' compressed lengths: many short ones in one call, which costs less than calls of their own."""
    if len(windows) < 2:
        return np.array([len(compressor.compress(w)) for w in windows], np.int64)
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(windows)), np.int64, len(windows))


class _Distances(dict):
    """Word to its distance, worked out when first met; a word not met for long is forgotten."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.toxic, self.ordinary = _Side(toxic), _Side(ordinary)
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self.meet({word})
        return self[word]

    def meet(self, words: set[str]) -> None:
        """Have the distances of these words, the unknown ones worked out together."""
        if len(self) > KNOWN // 2:
            self.older = dict(self)
            self.clear()
        unknown = []
        for word in words.difference(self):
            if (had := self.older.get(word)) is None:
                unknown.append(word)
            else:
                self[word] = had
        some, held = [], 0
        for word in unknown:
            some.append(word)
            held += len(word)
            if held > AT_ONCE:
                self._work_out(some)
                some, held = [], 0
        if some:
            self._work_out(some)

    def _work_out(self, words: list[str]) -> None:
        once = [f" {word} ".encode() for word in words]
        windows = [w * REPEATS for w in once]
        data = np.frombuffer(b"".join(windows), np.uint8)
        sizes = np.array([len(w) for w in once])
        # The bytes in a row that start in a window's first word; those of the repeated ones are the same.
        window_of = np.repeat(np.arange(len(words)), sizes)
        starts = np.arange(len(window_of)) + ((REPEATS - 1) * (np.cumsum(sizes) - sizes))[window_of]
        runs = _runs_of_bytes(data)[starts]
        found = self.ordinary.shortest(windows, runs, window_of) - self.toxic.shortest(windows, runs, window_of)
        self.update(zip(words, found.tolist(), strict=True))


def _compressor(content: bytes):
    import zstandard as z

    setting = z.ZstdCompressionParameters(
        format=z.FORMAT_ZSTD1_MAGICLESS, strategy=z.STRATEGY_GREEDY, min_match=MATCH, window_log=12, hash_log=10, chain_log=10, search_log=4, target_length=32,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    book = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=setting)
    return z.ZstdCompressor(dict_data=book, compression_params=setting)


class Scorer:
    """Dictionaries in pairs and a calibration; made from plain bytes and numbers, so that it travels to tasks."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], weights: list[float]):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._known = None

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.weights)

    def __setstate__(self, state):
        self.__init__(*state)

    def distances(self, text: str) -> np.ndarray:
        """Per window, the bytes that the best toxic dictionary saves against the best ordinary one."""
        if self._known is None:
            self._known = _Distances(self.toxic, self.ordinary)
        return np.array([*map(self._known.__getitem__, text.lower().split())] or [0])

    def met(self, texts: list[str]) -> Iterator[str]:
        """The texts again; the words of some at a time are met before those are handed on."""
        if self._known is None:
            self._known = _Distances(self.toxic, self.ordinary)
        some, held = [], 0
        for i, text in enumerate(texts):
            some.append(text)
            held += len(text)
            if held > TEXT_AT_ONCE or i == len(texts) - 1:
                self._known.meet({w for t in some for w in t.lower().split()})
                yield from some
                some, held = [], 0

    def features(self, text: str) -> list[float]:
        d = self.distances(text)
        top = np.sort(d)[-3:]
        return [1.0, float(d.max()), float(top.mean()), math.log1p(float((d >= 3).sum())), math.log1p(float((d >= 4).sum())), float(d.mean()), math.log1p(len(d))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, self.features(text or "")))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def scores(self, texts: list[str | None]) -> list[float]:
        return [*map(self.score, self.met([t or "" for t in texts]))]


def copy_groups(texts: list[str]) -> list[int]:
    """For every text a number that near copies share: texts that meet in a band and agree are joined.

    In a band each text is held against the first one and the one before it, so the work is linear;
    a group of many copies meets in many bands.
    """
    sets = [shingle_set(t, 2) for t in texts]
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[int, int] = {}
    before: dict[int, int] = {}
    for i, own in enumerate(sets):
        for key in band_keys(signature(own)).tolist() if len(own) else ():
            for j in {first.setdefault(key, i), before.get(key, i)}:
                if find(i) != find(j):
                    common = len(np.intersect1d(own, sets[j], assume_unique=True))
                    if common >= COPIES * (len(own) + len(sets[j]) - common):
                        root[find(i)] = find(j)
            before[key] = i
    return [find(i) for i in range(len(texts))]


def words_of_groups(texts: list[str]) -> list[set[str]]:
    """The words of each text, those of near copies taken together."""
    words: dict[int, set[str]] = {}
    for group, text in zip(copy_groups(texts), texts, strict=True):
        words.setdefault(group, set()).update(text.lower().split())
    return list(words.values())


def marking_words(own: list[str], other: list[str], odds: float = ODDS, margin: float = MARGIN) -> list[str]:
    """Words far commoner in documents of one label, the strongest last; near copies count as one document."""
    return _marking(words_of_groups(own), words_of_groups(other), odds, margin)


def _marking(own: list[set[str]], other: list[set[str]], odds: float = ODDS, margin: float = MARGIN) -> list[str]:
    here = Counter(w for words in own for w in words)
    there = Counter(w for words in other for w in words)
    p, n = max(1, len(own)), max(1, len(other))
    marks = 2 * math.log(max(2, len(here))) + margin
    found = []
    for word, a in here.items():
        b = there[word]
        if a >= DOCS and a / p >= odds * (b + 0.5) / n:
            ratio = 2 * (a * math.log(a * (p + n) / p / (a + b)) + (b and b * math.log(b * (p + n) / n / (a + b))))
            if ratio > marks:
                found.append((ratio, word))
    return [w for _, w in sorted(found)]


def fill(words: list[str], sizes: list[int]) -> list[bytes]:
    """Parts of at most these sizes: each word, the last one first, in the first part that has room, between spaces."""
    left, out = list(sizes), [[] for _ in sizes]
    for word in reversed(words):
        piece = f" {word} ".encode()
        for k, size in enumerate(left):
            if len(piece) <= size:
                left[k] -= len(piece)
                out[k].append(piece)
                break
    return [b"".join(reversed(part)) for part in out]


def content(words: list[str], size: int) -> bytes:
    """The last words that fit, each between spaces."""
    return fill(words, [size])[0]


def dealt(words: list[str], size: int) -> list[bytes]:
    """All words over as many parts of ``size`` bytes as they need; a word longer than a part is there by its beginning."""
    words = [w if len(w.encode()) <= size - 2 else w.encode()[: size - 2].decode(errors="ignore") for w in words]
    # Parts filled in this way are half full at least, but for one.
    most = 1 + 2 * sum(len(w.encode()) + 2 for w in words) // size
    return [part for part in fill(words, [size] * most) if part] or [b""]


def fit(rows: list[tuple[str, int]]) -> Scorer:
    """``rows``: text and label in a fixed order; of each label every second one makes the dictionaries, the others the calibration."""
    rows = sorted(dict.fromkeys(rows), key=lambda r: r[1])
    made, held = rows[::2], rows[1::2]
    toxic, ordinary = words_of_groups([t for t, y in made if y]), words_of_groups([t for t, y in made if not y])
    own = dealt(_marking(toxic, ordinary), OWN)
    often = [w for w, _ in sorted(Counter(w for t, _ in made for w in set(t.lower().split())).items(), key=lambda x: (x[1], x[0]))][-400:]
    other = fill(_marking(ordinary, toxic, 1.2, -math.inf), [len(o) for o in own])
    shared = content([w for w in often if not any(f" {w} ".encode() in o for o in own)], SHARED)
    padding = [content(often[:200], len(o) - len(p)) for o, p in zip(own, other, strict=True)]
    scorer = Scorer([shared + o for o in own], [q + shared + p for q, p in zip(padding, other, strict=True)], [0.0] * 7)
    y = np.array([label for _, label in held], float)
    if not len(y) or y.min() == y.max():
        scorer.weights = [-30.0] + [0.0] * 6
        return scorer
    x = np.array([*map(scorer.features, scorer.met([t for t, _ in held]))])
    groups = [(label, g) for label in (0, 1) for g in copy_groups([t for t, have in held if have == label])]
    sizes = Counter(groups)
    share = np.array([1 / sizes[g] for g in groups])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (share * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    scorer.weights = w.tolist()
    return scorer


def training_rows(docs: DataFrame, labels: DataFrame, learn: F.Column, toxic: int = TOXIC_ROWS, ordinary: int = ORDINARY_ROWS) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts, in a fixed order: ids are drawn by hash, then looked up."""
    usable = labels.filter(learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic), (0, ordinary))]
    # At most toxic + ordinary ids, so the broadcast is bounded by the parameters.
    ids = F.broadcast(drawn[0].union(drawn[1]))
    got = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic").collect()
    return [(r["text"], int(r["toxic"])) for r in sorted(got, key=lambda r: (r["toxic"], r["doc_id"], r["text"]))]


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(name: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(5)) == 0


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Scorer:
    """Scorer learnt from the labels of rows that are not held out."""
    return fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out()))


def op7_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a score for every document, learnt without the held-out fifth of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below 0.5, all columns as they were."""
    scorer = fitted(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    small_batches(spark)

    @F.pandas_udf("double")
    def score(texts):
        return pd.Series(scorer.scores(texts.tolist()), texts.index, float)

    return docs.filter(score(F.coalesce("text", F.lit(""))) < 0.5)
