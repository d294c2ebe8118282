"""BPE encoding and decoding by a deterministic automaton compiled from the merges.

The automaton starts as one state with a loop for every base symbol. Merge by merge (rank r,
``u v`` to ``w``) a gadget is added: the state that ``u`` leads to is split, and its copy loses
the arc ``v``, so that ``u v`` can no longer be read apart; wherever ``u`` could be read, ``w``
can, and leads where ``v`` leads. In what results, each string has exactly one path, and its arc
labels are the string's tokens. A state is known from the label that led to it, so arcs are a
relation between labels: ``y`` may follow ``x`` unless some gadget (u, v) took it away, with
``u`` the piece at the end of ``x`` and ``v`` the piece at the start of ``y`` at the time of its
merge. The gadgets are kept as one table, and an arc is looked up in it once per worker.

Null texts count as empty; rows are kept as they come, repeated ones included; an empty table
gives an empty result; other columns are not read. A word without spaces of any length takes
time in proportion to its length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches

_LATER = 1 << 60
# Letters, then marks that are neither letters, digits, white space nor the sign of a contraction.
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Automaton:
    """``ids(word)`` follows the arcs of one pre-split word; ``labels(ids)`` gives the arcs' labels."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.label = {i: t for t, i in vocab.items()}
        self.gadgets: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.heads: dict[int, list[tuple[int, int]]] = {}
        self.tails: dict[int, list[tuple[int, int]]] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        inner, final = {}, {}

        def reachable(token: str, i: int) -> None:
            if token.endswith(suffix):
                final[token[: -len(suffix)]] = i
            else:
                inner[token] = i

        for letter in byte_letters():
            for token in (letter, letter + suffix):
                if token in vocab:
                    reachable(token, i := vocab[token])
                    self.heads[i] = self.tails[i] = [(i, _LATER)]
        for rank, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            # A pair that earlier gadgets keep apart never meets: its label stays without arcs.
            if u in self.heads and v in self.heads and w not in self.heads and self._follows(u, v, rank):
                self.gadgets[u, v] = rank
                self.heads[w] = [(w, _LATER), (u, rank), *self.heads[u][1:]]
                self.tails[w] = [(w, _LATER), (v, rank), *self.tails[v][1:]]
                reachable(left + right, w)
        self.inner, self.final = inner, final
        self.longest = max(map(len, [*inner, *final]))

    def _follows(self, x: int, y: int, before: int = _LATER) -> bool:
        """Whether no gadget of a rank below ``before`` took the arc ``y`` from the state after ``x``."""
        for u, gone_u in self.tails[x]:
            for v, gone_v in self.heads[y]:
                rank = self.gadgets.get((u, v), _LATER)
                if rank < before and rank < gone_u and rank <= gone_v:
                    return False
        return True

    def ids(self, word: str) -> list[int]:
        """``word``: byte letters. Arcs are tried longest label first; the one path to the end is the answer.

        A prefix has one path only as well, so a place from which the end was not reached is
        never entered again, and the time stays in proportion to the word's length.
        """
        n = len(word)
        if not n:
            return []
        inner, final, arcs, longest = self.inner, self.final, self.arcs, self.longest
        # The first state has every arc, so a label that spells the whole word is its path.
        if (whole := final.get(word)) is not None:
            return [whole]
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, x, end = 0, -1, min(n, longest)
        while True:
            while end > at:
                if end not in dead:
                    y = (inner if end < n else final).get(word[at:end])
                    if y is not None:
                        if not at:
                            break
                        ok = arcs.get((x, y))
                        if ok is None:
                            ok = arcs[x, y] = self._follows(x, y)
                        if ok:
                            break
                end -= 1
            if end > at:
                out.append(y)
                if end == n:
                    return out
                starts.append(at)
                x, at, end = y, end, min(n, end + longest)
            else:
                dead.add(at)
                end, at = at - 1, starts.pop()
                out.pop()
                x = out[-1] if out else -1

    def labels(self, ids: list[int]) -> list[str]:
        return [self.label[i] for i in ids]


class WordCoder:
    """Texts by way of the automaton: normalised and split as the vocabulary's file says, each distinct piece once."""

    # Pieces and words kept at most by a worker.
    LIMIT = 400_000

    def __init__(self, path: str):
        with open(path) as file:
            made = json.load(file)
        model = made["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.automaton.label |= {i: t for t, i in self.special.items()}
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = byte_letters()
        self.known: dict[str, tuple[int, str, str] | None] = {}
        self.coded: dict[str, tuple[int, str, str]] = {}

    def _word(self, word: str) -> list[int]:
        spelt = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return self.automaton.ids(spelt)

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [i for word in self.words.findall(text.lower()) for i in self._word(word)]

    def ids(self, text: str) -> list[int]:
        """Ids of a text; names of special tokens are cut out first."""
        if "<|" not in text:
            return self._plain(text)
        return [i for part in self.cut.split(text) for i in ([self.special[part]] if part in self.special else self._plain(part))]

    def _coded(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join(self.automaton.labels(ids))

    def _parts(self, piece: str) -> list[tuple[int, str, str]]:
        """Plain words with marks behind them are met in many pieces: each is coded once."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        out = []
        for line in piece.lower().split("\n"):
            plain = _PLAIN.fullmatch(line)
            if not plain or not plain[1].isalpha():
                return []
            for word in (plain[1], plain[2]):
                if word:
                    got = self.coded.get(word)
                    if got is None:
                        got = self.coded[word] = self._coded(self._word(word))
                    out.append(got)
        return out

    def piece(self, piece: str) -> tuple[int, str, str] | None:
        parts = self._parts(piece)
        if len(parts) == 1:
            got = parts[0]
        elif parts:
            got = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        else:
            got = self._coded(ids) if (ids := self.ids(piece)) else None
        self.known[piece] = got
        return got

    def code(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals, and the decoded text, all joined by one space.

        The vocabulary has no rule across spaces, so a text is coded piece by piece.
        """
        if len(self.known) > self.LIMIT:
            self.known = {}
        if len(self.coded) > self.LIMIT:
            self.coded = {}
            self.automaton.arcs = {}
        known, piece = self.known, self.piece
        got = [x for p in text.split(" ") if (x := known[p] if p in known else piece(p))]
        return sum([x[0] for x in got]), " ".join([x[1] for x in got]), " ".join([x[2] for x in got])


_MADE: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _MADE:
        _MADE[path] = WordCoder(path)
    return _MADE[path]


def code_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (decimals joined by a space) and decoded (labels joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = coder(path)
        for batch in batches:
            got = [make.code(t or "") for t in batch.column(1).to_pylist()]
            n, ids, decoded = map(list, zip(*got, strict=True)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def op9_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents encoded and decoded with the word vocabulary."""
    import public_tokenizers

    coded = code_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
