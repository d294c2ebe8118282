"""Near copies, repeated passages and embeddings against brute force."""

import hashlib
import random
import tracemalloc
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from helpers import SF, extra, rows_of
from pyspark.sql import functions as F

from auditlake.llm import embedding_dups, near_dups, neighbours, repeats
from auditlake.llm.queries import QUERIES


class Groups(dict):
    """Union-find that keeps the smallest member as the root."""

    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text, size):
    words = text.encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def expected_groups(docs, size, percent=80):
    sets = [(name, shingles(text or "", size)) for name, text in docs]
    groups = Groups()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    groups.join(a, b)
    return sorted(((a, len(x), a if a is None else groups.find(a), a is None or groups.find(a) == a) for a, x in sets), key=lambda r: tuple((v is not None, v) for v in r))


def test_near_copies_query(spark, documents):
    assert rows_of(QUERIES["op8_min_max_hashing"](spark, SF)) == expected_groups(documents, 2)


def test_near_copies_on_odd_rows(odd_docs, no_docs):
    got = rows_of(near_dups.near_duplicates(odd_docs, 2))
    assert got == expected_groups([(r.doc_id, r.text) for r in odd_docs.collect()], 2)
    assert near_dups.near_duplicates(no_docs).count() == 0


def test_hot_group_of_near_copies(spark, monkeypatch):
    """Copies of one base that are near it but mostly not near one another, among strays; several blocks."""
    monkeypatch.setattr(near_dups, "BLOCK", 20)
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    docs = []
    for i in range(120):
        words = list(base)
        for k in draw.sample(range(200), 10 if i else 0):
            words[k] = f"v{draw.randrange(10**6)}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(2000 + i, " ".join(base[: 100 + i] + [f"z{i}x{k}" for k in range(100 - i)])) for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(near_dups.near_duplicates(df, 2)) == expected_groups(docs, 2)


@pytest.mark.parametrize("shingles", [16_000_000, 3000])
def test_groups_of_unlinked_texts_are_bounded(spark, monkeypatch, tmp_path, shingles):
    """Templated texts that share bands but are not linked: no group holds more than two blocks, and no link is lost."""
    monkeypatch.setattr(near_dups, "BLOCK", 30)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", shingles)
    inner = near_dups.agreeing

    def watched(members, least):
        visits = members["visits"].sum()
        (tmp_path / uuid.uuid4().hex).write_text(f"{visits} {len(members) - visits}")
        return inner(members, least)

    monkeypatch.setattr(near_dups, "agreeing", watched)
    draw = random.Random(6)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(300):
        words = [*base, *(f"v{i}x{k}" for k in range(40))]
        docs.append((i, " ".join(words)))
        if i % 10 == 0:
            docs.append((1000 + i, " ".join(words[:-4] + [f"u{i}x{k}" for k in range(4)])))
    got = rows_of(near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2))
    assert got == expected_groups(docs, 2)
    seen = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    # Blocks are dealt by hash: some are fuller than others.
    most = 2 * min(30, shingles // 160)
    assert seen and max(max(v, r) for v, r in seen) <= most


def test_min_max_signature_estimates_overlap():
    draw = np.random.default_rng(0)
    every = draw.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.unique(every[:2000]), np.unique(every[1000:])
    agree = (near_dups.fine_signature(a) == near_dups.fine_signature(b)).mean()
    assert abs(agree - 1 / 3) < 0.06
    assert (near_dups.signature(a)[:48] < near_dups.signature(a)[48:]).all()


def expected_repeats(docs, length):
    """Per document: bytes, removed, spans and the digest of the rest, by comparing all strings."""
    first = {}
    for name, text in docs:
        data = (text or "").encode()
        if name is not None:
            for p in range(len(data) - length + 1):
                w = data[p : p + length]
                first[w] = min(first.get(w, name), name)
    out = []
    for name, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if name is not None and first[data[p : p + length]] < name:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((name, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_repeats_query(spark, documents):
    assert Counter(map(tuple, QUERIES["op10_suffix_repeats"](spark, SF).collect())) == expected_repeats(documents, 50)


def test_repeats_on_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text[:40_000] if r.text else r.text) for r in odd_docs.collect()]
    short = odd_docs.withColumn("text", F.substring("text", 1, 40_000))
    assert Counter(map(tuple, repeats.remove_repeats(short, 50, report=True).collect())) == expected_repeats(docs, 50)
    kept = repeats.remove_repeats(odd_docs, 50)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert kept.filter("slice <> 'mine'").isEmpty()
    assert repeats.remove_repeats(no_docs, 50, report=True).count() == 0


def test_a_block_takes_little_memory():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 200_000, dtype=np.uint8).tobytes() * 5
    own = (np.arange(20).tobytes(), np.full(20, 50_000).tobytes(), zstandard.compress(text), None)
    tracemalloc.start()
    try:
        block = repeats.Block(*own, 50)
        grams = block.grams()
        names = block.shared(np.ones(len(grams), bool))[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(names) == 4 * (50_000 - 49)
    assert peak < 64 * len(text)


def test_cover_grams_are_spread_over_the_buckets():
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    block = repeats.Block(np.arange(4).tobytes(), np.full(4, 50_000).tobytes(), zstandard.compress(text), None, 50)
    grams = block.grams()
    held = np.diff(repeats.cut_by_bucket(grams, 20))
    assert held.sum() == len(grams) > 10_000
    assert held.max() < 2 * held.mean()


def test_a_bucket_of_names_takes_little_memory(monkeypatch):
    monkeypatch.setattr(repeats, "NAMES_AT_ONCE", 1 << 12)
    rng = np.random.default_rng(4)
    names = [np.unique(rng.integers(0, 100_000, 40_000, dtype=np.uint64) << np.uint64(40)) for _ in range(6)]
    ids = [np.sort(rng.permutation(100)[:7]) for _ in names]
    places = [rng.integers(0, 7, len(n)).astype(np.uint16) for n in names]
    least = {}
    for n, i, p in zip(names, ids, places, strict=True):
        for name, doc in zip(n.tolist(), i[p].tolist(), strict=True):
            least[name] = min(doc, least.get(name, doc))
    rows = pa.table({"names": [n.tobytes() for n in names], "ids": [i.tobytes() for i in ids], "places": [p.tobytes() for p in places]})
    tracemalloc.start()
    try:
        out = repeats.in_earlier_documents(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [o.tolist() for o in out] == [[least[name] < doc for name, doc in zip(n.tolist(), i[p].tolist(), strict=True)] for n, i, p in zip(names, ids, places, strict=True)]
    assert peak < 8 * sum(map(len, names))


def test_a_bucket_gets_only_the_ids_that_its_names_need():
    names = np.arange(400, dtype=np.uint64) << np.uint64(55)
    least = (np.arange(400) % 300).astype(np.int32)
    ids = np.arange(1000, 1500)
    rows = repeats.name_rows(7, ids, names, least, 100).to_pylist()
    back = [(i, n) for r in rows for n, i in zip(np.frombuffer(r["names"], np.uint64).tolist(), np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["places"], np.uint16)].tolist(), strict=True)]
    assert back == list(zip(ids[least].tolist(), names.tolist(), strict=True))
    assert sum(len(r["ids"]) for r in rows) <= 8 * len(names)


def test_names_are_sent_in_fewer_bytes():
    rng = np.random.default_rng(5)
    for n, buckets, spread in ((40_000, 12, 600), (40_000, 1000, 600), (3, 5, 3), (1, 1, 1), (0, 4, 2)):
        names = np.unique(np.append(rng.integers(0, 2**64, max(0, n - 1), dtype=np.uint64), np.full(min(n, 1), 2**64 - 1, np.uint64)))
        ids = np.unique(np.append(rng.integers(-900, 900, spread), np.iinfo(np.int64).min + 1))
        rows = repeats.name_rows(7, ids, names, rng.integers(0, len(ids), len(names)).astype(np.int32), buckets)
        sent = repeats.pack_names(rows, buckets)
        for k in range(rows.num_rows):
            back = repeats.unpack_names(pa.Table.from_batches([sent.slice(k, 1)]), buckets).to_pylist()[0]
            assert back == {c: x for c, x in rows.slice(k, 1).to_pylist()[0].items() if c in back}
        if n > 3:
            size = [sum(len(x) for c in t.schema.names if c not in ("block", "bucket") for x in t.column(c).to_pylist()) for t in (rows, sent)]
            assert size[1] < 0.95 * size[0]


def test_repeats_inside_over_and_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "CHUNK", 512)
    draw = random.Random(9)
    letters = "abcdefgh é"
    passage = "".join(draw.choice(letters) for _ in range(90))
    docs = []
    for i in range(150):
        body = "".join(draw.choice(letters) for _ in range(draw.randint(0, 400)))
        if i % 3 == 0:
            body += passage[: draw.randint(40, 90)]
        if i % 7 == 0:
            body = passage + body + passage
        if i % 11 == 0:
            body += "ha " * 60
        docs.append((draw.randrange(120), body))
    docs += [(500 + i, docs[5][1]) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, repeats.remove_repeats(df, 50, report=True).collect()))
    assert got == expected_repeats(docs, 50)


def vectors(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((12, 16))
    rows = []
    for i in range(400):
        x = centres[i % 12] + 0.2 * draw.standard_normal(16) if i % 2 else draw.standard_normal(16)
        rows.append((i, (x * draw.uniform(0.2, 3)).tolist(), int(i % 3)))
    rows += [(1000 + i, rows[1][1], 1) for i in range(40)]  # exact copies
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [None] + [1.0] * 15, 1), (5004, [float("inf")] + [1.0] * 15, 1), (5005, [], 1), (5006, rows[1][1], None), (None, rows[1][1], 1), (3, rows[3][1], 0)]
    return rows, extra(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def usable(rows):
    return {i: (np.array(v), label) for i, v, label in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}


def test_embedding_links(spark):
    rows, df = vectors(spark)
    known = {i: (v / np.linalg.norm(v), label) for i, (v, label) in usable(rows).items() if label is not None}
    links, groups = Counter(), Groups()
    for a, (x, k) in known.items():
        for b, (y, m) in known.items():
            if a < b and k == m and x @ y >= 0.93:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    want = sorted((i is not None, i or 0, links[i] if i in known else 0, groups.find(i)) for i, *_ in rows if i is not None)
    got = sorted((r.vec_id is not None, r.vec_id, r.n_links, r.component_id) for r in embedding_dups.near_duplicates(df).collect() if r.vec_id is not None)
    missed = sum(w[2] for w in want) - sum(g[2] for g in got)
    assert 0 <= missed <= 0.02 * sum(w[2] for w in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))
    assert sum(g[3] != w[3] for g, w in zip(got, want, strict=True)) <= 4
    assert embedding_dups.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)
    monkeypatch.setattr(embedding_dups, "PER_CELL", 10_000)  # one cell: nothing can be missed
    rows, df = vectors(spark)
    known = {i: (v / np.linalg.norm(v), label) for i, (v, label) in usable(rows).items() if label is not None}
    total = sum(k == m and a != b and x @ y >= 0.93 for a, (x, k) in known.items() for b, (y, m) in known.items())
    got = embedding_dups.near_duplicates(df).filter("vec_id is not null").dropDuplicates(["vec_id"]).agg(F.sum("n_links")).first()[0]
    assert got == total


def test_traversal_visits_cells_in_rising_cost():
    grid = embedding_dups.Grid(np.random.default_rng(0).standard_normal((200, 8)), 64, 0.9)
    grid.radius = 1e9
    a, b = (c[0] for c in grid.costs(np.ones((1, 8))))
    cells = grid.visits(a, b)
    cost = [a[c // len(b)] + b[c % len(b)] for c in cells]
    assert len(cells) == len(a) * len(b) == len(set(cells)) and cost == sorted(cost)


def test_neighbours_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 10)
    rows, df = vectors(spark)
    known = {i: v for i, (v, _) in usable(rows).items()}
    every = neighbours.usable_vectors(df)
    got = {}
    for r in neighbours.nearest(every, every.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in known if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(s - known[v] @ known[q]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        best = sorted(((-(v @ known[q]), i) for i, v in known.items() if i != q))[:20]
        hit += len({i for _, i in best} & {v for _, v, _ in found})
    assert hit >= 0.9 * 20 * len(got)
    few = every.filter("vec_id < 4")
    assert neighbours.nearest(few, few, 20).count() == 12
    assert neighbours.nearest(few.limit(0), few.limit(0), 20).count() == 0


def test_neighbours_query(spark):
    out = QUERIES["op1_collision_counting"](spark, SF)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    known = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hit = total = 0
    for q in [i for i in known if i % 20 == 0]:
        best = sorted((-(v @ known[q]), i) for i, v in known.items() if i != q)[:20]
        hit += len({i for _, i in best} & {r.vec_id for r in out.filter(F.col("query_id") == q).collect()}) if total < 100 else 0
        total += 20 if total < 100 else 0
    assert hit >= 0.9 * total


def test_embedding_query(spark):
    out = rows_of(QUERIES["op5_inverted_multi_index"](spark, SF))
    assert len(out) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert all((i == c) == k for i, _, c, k in out)
