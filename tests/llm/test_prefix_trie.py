"""Prefix tries of conversations against a trie of tuples, over many shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import differences, duck
from trackflow.llm import prefix_trie, queries

KINDS = "conv_id long, turn long, role string, text string, shard int, KEY string, path string, n long"


def test_parentheses(monkeypatch):
    r = random.Random(4)
    for block in (2, 8, 64):
        monkeypatch.setattr(prefix_trie.Parentheses, "BLOCK", block)
        for shape in (0.5, 0.9, 0.1):
            bits, depth = [1], 1
            while len(bits) < 700:
                up = depth == 1 or r.random() < shape
                bits.append(int(up))
                depth += 1 if up else -1
            bits += [0] * depth
            made, stack, want = prefix_trie.Parentheses(np.array(bits, np.uint8)), [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            assert {int(i): made.close(int(i)) for i in made.opens()} == want
            assert int(made.leaves[-1]) == sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))


def told(rows):
    """conv_id -> [(role, text), ...] in the operator's order."""
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    found = {}
    for row in sorted((r for r in rows if r[0] is not None), key=key):
        found.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return found


def trie_brute(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    rows = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        childless = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        rows.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below), len(childless),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def rebuilt_brute(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - int(np.fmod(c, 100)))
        out[c] = paths.get(base, [])[:h] + own[h:]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(r, n, first=0):
    texts = ["", "a", "bb", "é漢", None, "ccc" * 50]
    rows = []
    for c in range(first, first + n):
        for turn in range(r.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, turn, r.choice(["user", "assistant"]) if r.random() < 0.3 else "user", r.choice(texts[: r.choice([2, 3, 6])]), 7, "k", "p", 1))
    return rows


@pytest.mark.parametrize("nodes", [1, 3, 25, 50_000])
def test_trie_over_shards(spark, monkeypatch, nodes):
    """Shards of a few nodes, so that spines run through several of them."""
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    r = random.Random(nodes)
    rows = some_rows(r, 90) + [(900 + i, t, "user", "same", 0, "", "", 0) for i in range(40) for t in range(5)]
    rows += [(990, t, "user", "deep", 0, "", "", 0) for t in range(60)] + [(991, t, "user", "deep", 0, "", "", 0) for t in range(30)]
    table = spark.createDataFrame(rows, KINDS)
    assert rows_of(prefix_trie.trie(prefix_trie.paths(table))) == trie_brute(told(rows))


def test_trie_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 3)
    rows = [(5, None, None, None, 1, "", "", 1), (5, 0, "user", "x", 1, "", "", 1), (-7, 3, "user", "x" * 100_000, 1, "", "", 1), (-7, 3, "user", "x", 1, "", "", 1)]
    rows += [(8, 1, "user", "x", 1, "", "", 1)] * 3 + [(None, 0, "user", "x", 1, "", "", 1)] + [(c, 0, "us", "erx", 1, "", "", 1) for c in range(20, 45)]
    got = prefix_trie.trie(prefix_trie.paths(spark.createDataFrame(rows, KINDS)))
    assert rows_of(got) == trie_brute(told(rows))
    turnless = spark.createDataFrame([(3,), (1,)], "conv_id long").withColumn("path", F.expr("cast(array() as array<struct<digest: binary, size: bigint>>)"))
    assert rows_of(prefix_trie.trie(turnless)) == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]
    assert prefix_trie.trie(prefix_trie.paths(spark.createDataFrame([], KINDS))).collect() == []


def test_query(spark, tmp_path):
    r = random.Random(6)
    rows = some_rows(r, 130, first=-60) + [(None, 1, "user", "x", 1, "", "", 1), (64, None, None, None, 1, "", "", 1), (64, None, None, None, 1, "", "", 1)]
    spark.createDataFrame(rows, KINDS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert rows_of(got) == trie_brute(rebuilt_brute(told(rows)))
    con = duck("/root/testdata/sf0.001")
    con.sql(f"create or replace temp view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert differences(got, con, queries.SQL["op13_prefix_trie"]) == ""
