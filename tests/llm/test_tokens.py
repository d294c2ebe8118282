"""Token store, packing and automaton against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, rows_of
from tokenizers import Tokenizer

from auditlake.llm import automaton, packing, token_store
from auditlake.llm.queries import QUERIES
from auditlake.llm.vocab import Encoder, encoder

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def strange():
    draw = random.Random(7)
    letters = "aabcdeeth inor'sll dé0 9ß\n\t\x1c\xa0<|endoftext|>ΣİǺ-.,!中文日😀\x00\x85²½_ ́"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(1500)] + ["", " ", "  a", "a \nb", "a\n b", "a" * 3000, "it's we'll don't", "<|endoftext|>x"]


def test_encoder_gives_the_library_s_ids(strange):
    for path, spaced in ((BYTES, True), (WORDS, False)):
        tok = Tokenizer.from_file(path)
        got = encoder(path, spaced).encode(strange)
        assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in strange]


def test_words_stay_known_when_pieces_start_anew():
    names = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(250_000)]
    coder = Encoder(WORDS, False)
    coder.encode([" ".join(names)])
    (ids,) = coder.encode([names[7] + "!"])
    assert names[200_000] in coder.words and len(coder.pieces) == 1
    assert ids.tolist() == coder.tok.encode(names[7] + "!", add_special_tokens=False).ids


def test_pieces_that_come_again_stay_known_in_a_bounded_table(monkeypatch):
    monkeypatch.setattr(Encoder, "PIECES", 3000)
    monkeypatch.setattr(Encoder, "WORDS", 4000)
    draw = np.random.default_rng(5)
    often = ["".join(map(chr, draw.integers(97, 123, 6))) for _ in range(500)]
    for path, spaced in ((BYTES, True), (WORDS, False)):
        coder, tok = Encoder(path, spaced), Tokenizer.from_file(path)
        for k in range(12):
            rare = [f"{''.join(map(chr, draw.integers(97, 123, 8)))}{'!' * (n % 3)}" for n in range(1000)]
            text = " ".join(often + rare) + "\n" + "\n".join(rare[::-7]) + "\n\n é\n" + rare[5].upper()
            (got,) = coder.encode([text])
            assert got.tolist() == tok.encode(text, add_special_tokens=False).ids
            if k:  # not in the text's first place, where byte pieces have no space before them
                assert all(w in coder.pieces for w in often[1:])
            assert len(coder.pieces) < 3000 + 2500 and len(coder.words) < 4000 + 3000
            fresh = sum(w not in coder.pieces for w in often[1:])
            coder.thin()
            assert fresh == 0 and all(w in coder.pieces for w in often[1:])


def test_automaton_encodes_and_decodes_like_the_library(strange):
    tok, coder = Tokenizer.from_file(WORDS), automaton.WordCoder(WORDS)
    for text in strange:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert coder.code(text) == (len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)), text


def test_automaton_is_deterministic_for_every_merge():
    made = automaton.WordCoder(WORDS).automaton
    for token, i in list(made.final.items())[::97]:
        assert made.ids(token) == [i]


def test_elias_fano_round_trip():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (1, 10, 10**6, 2**40):
            values = np.sort(draw.integers(0, top, n, dtype=np.uint64))
            data = token_store.EliasFano.encode(values)
            read = token_store.EliasFano(memoryview(data))
            assert (read.all() == values).all()
            assert [read.select(i) for i in range(0, n, 7)] == values[::7].tolist()
            if n == 3000 and top >= 10**6:
                assert len(data) < n * (2.5 + np.log2(top / n)) / 8 + 100
    with pytest.raises(IndexError):
        read.select(n)


def test_shard_holds_documents_without_ids_first():
    docs = [np.array([5, 0]), np.array([7]), np.array([1, 2, 3])]
    shard = token_store.Shard(token_store.shard_bytes([None, -4, 9], docs, 2))
    assert shard.doc_ids() == [None, -4, 9] and [shard.ids(i).tolist() for i in range(3)] == [d.tolist() for d in docs]


def expected_store(docs, tok):
    start = 0
    for name, text in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        yield name, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_store_query(spark, documents):
    assert rows_of(QUERIES["op3_token_store"](spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == list(expected_store(documents, Tokenizer.from_file(BYTES)))


def test_store_on_odd_rows(odd_docs, no_docs):
    tok = Tokenizer.from_file(BYTES)
    docs = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    store = token_store.write_store(odd_docs, BYTES, 0)
    assert rows_of(token_store.read_store(store), "start", "doc_id", "n_tokens", "ids_crc32") == [(s, d, n, c) for d, s, n, c in expected_store(docs, tok)]
    assert token_store.read_store(token_store.write_store(no_docs, BYTES, 0)).count() == 0


def test_shards_are_cut_by_size(odd_docs, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 10)
    store = token_store.write_store(odd_docs, BYTES, 0)
    assert store.count() > 3
    assert token_store.read_store(store).count() == odd_docs.count()


def expected_pieces(docs, tok, size):
    for name, text in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            some = ids[at : at + size]
            yield name, k, at, len(some), zlib.crc32(some.tobytes())


def check_packing(rows, size):
    by = defaultdict(list)
    for *_, length, _, sequence, offset in rows:
        by[sequence].append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_query(spark, documents):
    rows = rows_of(QUERIES["op4_pattern_packing"](spark, SF))
    assert [r[:5] for r in rows] == sorted(expected_pieces(documents, Tokenizer.from_file(WORDS), 4096))
    assert check_packing(rows, 4096) <= -(-sum(r[3] for r in rows) // 4096) + 1


def test_packing_on_odd_rows(odd_docs, no_docs):
    rows = rows_of(packing.pack_documents(odd_docs, WORDS, 1, 100))
    docs = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert Counter(r[:5] for r in rows) == Counter(expected_pieces(docs, Tokenizer.from_file(WORDS), 100))
    check_packing(rows, 100)
    assert packing.pack_documents(no_docs, WORDS, 1, 100).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_exactly_and_packs_tightly(seed):
    draw = np.random.default_rng(seed)
    lengths = np.clip(draw.lognormal(6.3, 0.5 + 0.3 * seed, 20_000).astype(int), 1, 4096)
    lengths[: 20_000 // 3] = lengths[0]  # a hot length
    histogram = Counter(lengths.tolist())
    plan = packing.pack_histogram(dict(histogram), 4096)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 4096
        for k in pattern:
            used[k] += n
    assert used == histogram
    first_fit = sum(1 for _ in first_fit_decreasing(sorted(lengths.tolist(), reverse=True)[:4000]))
    few = packing.pack_histogram(dict(Counter(sorted(lengths.tolist(), reverse=True)[:4000])), 4096)
    assert sum(n for _, n in few) <= first_fit * 1.01 + 1


def first_fit_decreasing(lengths):
    rooms = []
    for length in lengths:
        for i, room in enumerate(rooms):
            if room >= length:
                rooms[i] -= length
                break
        else:
            rooms.append(4096 - length)
    return rooms


def test_automaton_query_and_odd_rows(spark, documents, odd_docs, no_docs):
    tok = Tokenizer.from_file(WORDS)

    def expected(docs):
        for name, text in docs:
            ids = tok.encode(text, add_special_tokens=False).ids
            yield name, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert rows_of(QUERIES["op9_merge_automaton"](spark, SF)) == list(expected(documents))
    got = automaton.code_documents(odd_docs, WORDS).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((a, b) for a, b, *_ in expected([(r.doc_id, r.text or "") for r in odd_docs.collect()]))
    assert automaton.code_documents(no_docs, WORDS).count() == 0
