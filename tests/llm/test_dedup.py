"""Exact, SimHash, embedding and passage dedup against brute force, on given and awkward rows."""

import collections

import duckdb
import numpy as np
import pytest
import xxhash

from modspark.llm import embedding_dedup, exact_dedup, golomb, graph, queries, simhash, suffix_dedup

FOLDER = "/root/testdata/sf0.001"
ODD = [(None, "a b"), (None, "a  b"), (5, "a\tb"), (5, "a b"), (7, None), (8, ""), (9, "x " * 20000), (9, "x " * 20000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, rows repeated whole, and columns that clash with ours."""
    rows = [(i, t, 1, "a", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, digest string, kept int").repartition(3)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for top in (2, 1000, 2**60):
            values = np.unique(rng.integers(0, top, n).astype(np.uint64))
            for shift in (0, golomb.best_shift(values)):
                if shift or top <= 1000:
                    assert (golomb.decode(*golomb.encode(values, shift), len(values), shift) == values).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(900, 960)] + [(3, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union()
    for a, b in edges:
        u.join(a, b)
    sizes = collections.Counter(u.find(x) for x in list(u.up))
    assert got == {x: u.find(x) for x in list(u.up) if sizes[u.find(x)] > 1}


def test_exact_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{FOLDER}/documents.parquet'")
    got = sorted(map(tuple, queries.QUERIES["op10_exact_dedup"](spark, FOLDER).collect()))
    assert got == sorted(con.sql(queries.SQL["op10_exact_dedup"]).fetchall())


def test_exact_odd_rows(odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.keep_id, r.group_size) for r in rows if r.kept) == [(5, 4), (7, 2), (9, 2)]
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 9]


def fingerprint(text, words):
    w = (text or "").encode().lower().split()
    runs = [] if not w else [b" ".join(w)] if len(w) < words else [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_equals_brute_force(docs):
    rows = {r.doc_id: fingerprint(r.text, 3) for r in docs.collect()}
    u, ids = Union(), sorted(rows)
    for i in ids:
        for j in ids:
            if (rows[i] ^ rows[j]).bit_count() <= 2:
                u.join(i, j)
    for tile in (7, 10_000):  # many tiles of a class, and one
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(docs, tile=tile).collect()}
        assert got == {i: (f"{rows[i]:016x}", u.find(i)) for i in ids}


def test_simhash_majority_of_long_runs():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 254, 255, 256, 1000, 0, 3])
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    at, want = 0, []
    for n in counts:
        h = [int(x) for x in hashes[at:at + n]]
        want.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > n))
        at += n
    assert simhash.majority(hashes, counts).tolist() == want


def test_tile_pairs_skipped_hold_no_link():
    rng = np.random.default_rng(4)
    for radius, span in ((2, 1), (18, 18)):
        steps = set(simhash._steps(radius, span))
        for _ in range(300):
            a = int(rng.integers(0, 2**63))
            b = a
            for bit in rng.choice(64, radius, replace=False):
                b ^= 1 << int(bit)
            kinds = [[(x >> 16 * i & 0xFFFF).bit_count() // span for i in range(4)] for x in (a, b)]
            d = tuple(p - q for p, q in zip(*kinds, strict=True))
            assert d in steps or tuple(-x for x in d) in steps


def test_simhash_odd_rows(odd):
    rows = simhash.near_dedup(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows} == {5, 7, 9}
    assert {r.fingerprint for r in rows if r.doc_id in (7, 8)} == {"0" * 16}
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 9]


def test_wide_fingerprints_find_near_copies_and_spare_others(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words, 300).tolist() for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):  # three words of 300 changed: Jaccard 0.9
        copy = list(b)
        for spot in rng.choice(300, 3, replace=False):
            copy[spot] = "changed"
        rows.append((100 + i, " ".join(copy)))
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=5, radius=18, width=4, wide_radius=44)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 100 for i, _ in rows}


def brute_links(vectors, threshold):
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    u, n = Union(), collections.Counter()
    for i in unit:
        for j in unit:
            if i == j or unit[i] @ unit[j] >= threshold:
                u.join(i, j)
                n[i] += i != j
    return {i: (n[i], u.find(i)) for i in unit}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=24) for i in range(150)}
    for i in range(100):  # copies at different distances of ten vectors, and equal ones
        vectors[200 + i] = vectors[i % 10] + rng.normal(size=24) * 0.3 * rng.random()
        vectors[400 + i] = vectors[20]
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    got = embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), block=16)
    got = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    want = brute_links(vectors, 0.9)
    assert sum(got[i][0] for i in want) >= 0.999 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 2


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (None, [1.0, 0.1, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]),
            (8, [None, 1.0, 2.0]), (9, [1.0, 0.0]), (10, []), (11, [inf, 0.0, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, node int")
        got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.near_dedup(df).collect())
        assert got == [(0, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1)] + [(i, 0, i) for i in range(5, 12)]


def passages(rows, size=50):
    seen, starts, late, out = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(set), set()
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - size + 1):
            seen[b" ".join(w[k:k + size])].append((-1 if i is None else i, k))
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                starts[i].add(k)
                if (i, k) != min(places):
                    late[i].update(range(k, k + size))
    for i, found in starts.items():
        begin = end = None
        for k in [*sorted(found), None]:
            if begin is not None and (k is None or k > end):
                out.add((i, begin, end, end - begin, sum(begin <= x < end for x in late[i])))
                begin = None
            if k is not None:
                begin, end = k if begin is None else begin, k + size
    return out


def test_passages_equal_brute_force(docs):
    got = {tuple(r) for r in suffix_dedup.repeats(docs).collect()}
    assert got and got == passages([(r.doc_id, r.text) for r in docs.collect()])


def test_passage_of_all_documents_over_many_partitions(spark):
    common = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'a{i}_{k}' for k in range(i % 40))} {common} {' '.join(f'b{i}_{k}' for k in range(30))}") for i in range(300)]
    rows += [(None, "x " + common.replace(" ", "\n")), (1000, common.rsplit(" ", 11)[0]), (1001, None), (1002, ""), (1003, "y " * 500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, at int").repartition(7)
    got = {tuple(-1 if x is None else x for x in r) for r in suffix_dedup.repeats(df).collect()}
    assert got == passages(rows)


def test_neighbours_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        rows = sorted({(int(s), int(d), int(a)) for s, d, a in zip(rng.integers(0, 6, n), rng.integers(0, 3, n), rng.integers(0, 9, n), strict=True)})
        batch = pa.table({"suffix": [r[0] for r in rows], "doc": [r[1] for r in rows], "at": pa.array([r[2] for r in rows], pa.int32())})
        parts = np.array_split(np.arange(len(rows)), 3)
        sure, unsure, edges = set(), set(), collections.defaultdict(set)
        for part in parts:
            if not len(part):
                continue
            for b in suffix_dedup._neighbours(batch.slice(part[0], len(part)).to_batches(max_chunksize=int(rng.integers(1, 5)))):
                for kind, s, d, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind == suffix_dedup.EDGE:
                        edges[s].add(d)
                    else:
                        (sure if kind == suffix_dedup.SHARED else unsure).add((s, d, a))
        got = sure | {r for r in unsure if len(edges[r[0]]) > 1}
        many = {s for s in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == s}) > 1}
        assert got == {r for r in rows if r[0] in many}


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, exact_dedup.drop_exact, simhash.near_dedup, simhash.drop_near, suffix_dedup.repeats])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_empty_vectors(spark):
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
