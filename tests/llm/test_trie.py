"""Prefix trie against brute force, on given, awkward and very uneven conversations."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from modspark.llm import ordered, prefix_trie

KIND = "conv_id long, turn long, role string, text string, depth int, l0 string, n long"


def brute(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in said.values():
        turns.sort(key=lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    built = {}
    for conv, turns in said.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rest = abs(conv) % 5 * (1 if conv >= 0 else -1)
        built[conv] = [t[2:] for t in said.get(conv - rest, [])[:h]] + [t[2:] for t in turns[h:]]
    members = defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[c] for c in children[p])
    for p, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(p))))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND).repartition(parts)
    assert sorted(map(tuple, prefix_trie.trie(df).collect())) == brute(rows)


def test_given(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefix_trie.trie(df).collect())) == brute(rows)


def test_odd_rows(spark):
    """Nulls everywhere, negative ids, ties, repeated turns, empty and very long texts, names that clash with ours."""
    long = "lorem ipsum " * 50_000
    rows = [(None, 0, "user", "lost"), (None, None, None, None), (0, None, None, None), (0, 0, "user", ""), (0, 0, "user", ""), (0, 0, "user", "b"),
            (1, 3, "user", long), (1, 3, "bot", long), (-3, 1, "user", "x"), (-3, 2, None, "y"), (-5, 1, "é", "ü"), (-6, 1, "é", "ü"),
            (12, 1, "a", "b"), (13, 1, "ab", ""), (14, 1, "a", "b"), (14, 2, "a", "b"), (17, 1, "user", None)]
    check(spark, rows)


def test_empty(spark):
    empty = spark.createDataFrame([], KIND)
    assert prefix_trie.trie(empty).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2)], KIND)).count() == 0


def test_uneven(spark, monkeypatch):
    """One conversation with half of all turns, one parent with very many children, one prefix with
    very many members: over more partitions, paths and pieces than one."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 64)
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(10, t, "user", f"t{t % 7}") for t in range(900)]
    rows += [(5 * c, t, "user", "hello" if t == 0 else f"w{c}") for c in range(3, 120) for t in range(2)]
    rows += [(1000 + 5 * c, t, "bot", "same") for c in range(80) for t in range(10)]
    check(spark, rows, 8)


@pytest.mark.parametrize("bits", [None, 10])
def test_running_sums(spark, bits):
    """A key over many partitions, carried from one to the next."""
    rows = [(k, i, (37 * i) % 1000) for k, n in ((1, 3), (2, 500), (3, 1), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    got = ordered.running(ordered.ordered(df, "k", "i"), {"s": "v"}, "k", bits).collect()
    sums, want = defaultdict(int), {}
    for k, i, v in rows:
        sums[k] += v
        want[k, i] = sums[k] % (1 << bits) if bits else sums[k]
    assert {(r.k, r.i): r.s for r in got} == want
    whole = ordered.running(ordered.ordered(df, "k", "i"), {"s": "v"}).collect()
    assert max(r.s for r in whole) == sum(v for *_, v in rows)
