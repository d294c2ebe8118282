"""Personal data by patterns bootstrapped from seeds.

Four base rules find seed entities (e-mail and IP addresses, card and phone numbers). Every seed,
and every other piece of text that might be an identifier, is an instance that stands in some lexical
pattern: the two words before it and its form. Such pieces are tokens of ``SHORTEST`` characters or more
with a digit in them, and numbers written in several tokens (``555 123 4567``); a token without any digit
is never one. Spark keeps the graph of
patterns and instances as edges and scores it in rounds: a pattern is as good for a kind as the
share of its instances that are of that kind, an instance as good as its patterns together make
it. Tokens that no base rule finds, in patterns of high confidence with several different seeds,
become spans of the pattern's kind. Base spans always stay.

One pass over the texts makes a narrow table of spans and occurrences; edges are counted before
they are shuffled, so a pattern or instance that a third of all documents share is one row per
task. Null texts are empty and have no spans; repeated rows come out as often as they come in; an
empty table gives an empty result; other columns are not read. The rules are linear in a text of
any length; words, forms and instances of more than ``LONGEST`` characters go by their digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
# What a pattern needs to find new identifiers: its confidence, and how many different seeds it has.
CONFIDENCE, SEEDS = 0.8, 3
# A token below this length is not taken for an identifier.
SHORTEST = 6
# A longer word, form or instance is named by its digest: equal ones stay equal, others differ.
LONGEST = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its beginning only and never given back: no start inside it could do better.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Entered at the beginning of a token only, so a token without a digit is passed over once.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
# Tokens of digits and the marks of numbers, one space apart.
_SPACED = re.compile(r"(?<!\S)[+(]?[0-9][0-9().-]*+(?: [0-9().-]*[0-9][0-9().-]*+)+")
_TRIM = ".,;:!?\"'()[]{}<>"
_CLASSES = str.maketrans({**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})
_RUNS = re.compile(r"(.)\1+", re.S)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start; matches that fail a check are passed over."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _named(piece: str) -> str:
    return piece if len(piece) <= LONGEST else hashlib.md5(piece.encode("utf-8", "replace")).hexdigest()


def form_of(token: str) -> str:
    """Classes of characters with runs joined: ``555-0199`` and ``71-2`` have one form."""
    return _RUNS.sub(r"\1", token.translate(_CLASSES))


def words_before(text: str, start: int, wall: int) -> list[str]:
    """The two words before a place, in order, none of them from before ``wall``."""
    words: list[str] = []
    at = start
    while len(words) < 2:
        while at > wall and text[at - 1].isspace():
            at -= 1
        end = at
        while at > wall and not text[at - 1].isspace():
            at -= 1
        if at == end:
            break
        words.insert(0, text[at:end])
    return words


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(kind or -1, start, end, instance, pattern) of every seed and every other piece like an identifier.

    The words before a piece reach back to the end of the third piece before it at most: no word is read often.
    """
    pieces = [(s, e, k) for k, s, e in base]
    if _DIGIT.search(text):
        taken = sorted((s, e) for _, s, e in base)

        def free(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
            """Those that meet none of the taken ones; both in order."""
            out, at = [], 0
            for start, end in spans:
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if not (at < len(taken) and taken[at][0] < end):
                    out.append((start, end))
            return out

        spaced = []
        for m in _SPACED.finditer(text):
            end = m.end() - len(m[0]) + len(m[0].rstrip(_TRIM))
            if sum(map(str.isdigit, m[0])) >= SHORTEST:
                spaced.append((m.start(), end))
        spaced = free(spaced)
        taken = sorted(taken + spaced)
        tokens = []
        for m in _TOKEN.finditer(text):
            token = m[0].lstrip(_TRIM)
            start = m.end() - len(token)
            end = start + len(token.rstrip(_TRIM))
            if end - start >= SHORTEST:
                tokens.append((start, end))
        pieces += [(s, e, -1) for s, e in spaced + free(tokens)]
    out, ends = [], [0, 0, 0]
    for s, e, k in sorted(pieces):
        before = " ".join(_named(w.lower().strip(_TRIM)) for w in words_before(text, s, min(ends[0], s)))
        out.append((k, s, e, _named(text[s:e]), before + " | " + _named(form_of(text[s:e]))))
        ends = [*ends[1:], e]
    return out


FOUND = "row long, doc_id long, digest long, kinds array<int>, starts array<int>, ends array<int>, instances array<string>, patterns array<string>"


def extract(docs: DataFrame) -> DataFrame:
    """One staged row per document: its occurrences, base ones with their kind, others with -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            found = [occurrences(t, base_spans(t)) for t in (t or "" for t in batch.column(2).to_pylist())]
            columns = [[[o[k] for o in f] for f in found] for k in range(5)]
            kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.string())] * 2
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", "doc_id", "digest", "kinds", "starts", "ends", "instances", "patterns"])

    small_batches(docs.sparkSession)
    return stage(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, FOUND), "occurrences")


def good_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind) of the patterns whose confidence and number of different seeds suffice."""
    each = found.select(F.explode(F.arrays_zip("kinds", "instances", "patterns")).alias("o")).select("o.*")
    edges = stage(each.groupBy(F.col("patterns").alias("pattern"), F.col("instances").alias("instance")).agg(F.max("kinds").alias("seed")), "pattern-edges")
    # Only patterns that some seed stands in can gain confidence in the first round.
    scores = edges.filter("seed >= 0").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    seeds = edges.filter("seed >= 0").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    trust = None
    for _ in range(ROUNDS):
        trust = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("good")).join(total, "pattern")
        trust = stage(trust.select("pattern", "kind", (F.col("good") / (F.col("total") + 1)).alias("trust")), "pattern-trust")
        # An instance is wrong for a kind only if all its patterns are.
        near = edges.join(trust.filter("trust >= 0.5"), "pattern").groupBy("instance", "kind", "seed")
        found_now = near.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("score")).filter("seed < 0").drop("seed")
        scores = edges.filter("seed >= 0").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score")).union(found_now.select("instance", "kind", "score"))
        scores = stage(scores.groupBy("instance", "kind").agg(F.max("score").alias("score")), "instance-scores")
    good = trust.filter(F.col("trust") >= CONFIDENCE).join(seeds.filter(F.col("seeds") >= SEEDS), ["pattern", "kind"])
    return good.groupBy("pattern").agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind"))


def find_private(docs: DataFrame) -> DataFrame:
    """Per document: row, doc_id, digest (of the text), base and spans, arrays of (kind, start, end) in order."""
    found = extract(docs)
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda o: F.struct(o["kinds"].alias("kind"), o["starts"].alias("start"), o["ends"].alias("end")))
    base = found.select("row", "doc_id", "digest", F.array_sort(F.filter(spans, lambda s: s["kind"] >= 0)).alias("base"))
    other = found.filter(F.array_contains("kinds", -1)).select("row", F.explode(F.arrays_zip("kinds", "starts", "ends", "patterns")).alias("o")).filter("o.kinds < 0")
    other = other.select("row", F.col("o.starts").alias("start"), F.col("o.ends").alias("end"), F.col("o.patterns").alias("pattern"))
    new = other.join(good_patterns(found), "pattern").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    both = base.join(new, "row", "left")
    return both.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))).drop("new")


def span_text(spans: str) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_bootstrapped_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: base and discovered spans of all documents."""
    found = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span gives way to its kind in angle brackets; documents without spans stay as they are."""
    found = find_private(docs).filter("size(spans) > 0").select("doc_id", "digest", "spans").dropDuplicates(["doc_id", "digest"])
    # The given columns travel in one struct, so none of their names can meet one of these.
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"))
    keyed = given.select("given", F.col("given.doc_id").alias("of"), F.xxhash64("given.text").alias("text_digest"))

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, spans, strict=True):
            if some is not None and text is not None:
                parts, at = [], 0
                for s in sorted(some, key=lambda s: (s["start"], -s["end"])):
                    if s["end"] > at:
                        parts += [text[at : max(at, s["start"])], f"<{KINDS[s['kind']]}>" if s["start"] >= at else ""]
                        at = s["end"]
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    # Ids and text digests together name a row's content, so rows that share an id keep their own spans.
    both = keyed.join(found, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("text_digest") == F.col("digest")), "left")
    return both.select(*[masked("given.text", "spans").alias("text") if c == "text" else F.col("given").getField(c).alias(c) for c in docs.columns])
