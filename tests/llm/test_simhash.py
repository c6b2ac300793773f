"""SimHash fingerprints and their components against all pairs."""

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, docs, edited
from trackflow.llm import queries, simhash


def fingerprint_brute(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(fps):
    """The smallest place that links of at most three bits reach, for each of ``fps``."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def near_values(r, n):
    """Fingerprints in clusters of different density, chains three bits apart, and far ones."""
    values = [r.getrandbits(64) for _ in range(n // 4)]
    for spread in (4, 12, 30):
        centre, places = r.getrandbits(64), r.sample(range(64), spread)
        values += [centre ^ sum(1 << p for p in r.sample(places, r.randrange(min(spread, 9)))) for _ in range(n // 6)]
    chain = r.getrandbits(64)
    for _ in range(n // 4):
        chain ^= sum(1 << p for p in r.sample(range(64), r.choice([3, 3, 3, 4])))
        values.append(chain)
    return values


@pytest.mark.parametrize("limit", [2, 8, 64])
def test_links(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST", limit)
    for seed in (1, 2):
        fps = sorted(set(near_values(random.Random(seed), 400)))
        table = spark.createDataFrame([(simhash._signed(v),) for v in fps], "fp long")
        got = {r["node"] % (1 << 64): r["component"] for r in simhash.links(table).collect()}
        groups = {}
        for value, root in zip(fps, components_brute(fps)):
            groups.setdefault(root, set()).add(value)
        want = {frozenset(g) for g in groups.values() if len(g) > 1}
        found = {}
        for value, label in got.items():
            found.setdefault(label, set()).add(value)
        assert {frozenset(g) for g in found.values()} == want


def test_dense_list_makes_few_links(spark):
    """Of 41 fingerprints all linked with each other, a list makes a link each, not all 820 pairs."""
    fps = sorted(simhash._signed((1 << 63) + sum(1 << b for b in range(20, 40)) ^ (1 << i)) for i in range(16, 56)) + [simhash._signed((1 << 63) + 5)]
    lists = spark.createDataFrame([(b, sorted(fps)) for b in range(len(simhash.BLOCKS))], "block int, fps array<long>")
    got = [tuple(r) for r in simhash.pairs(lists).collect()]
    linked = [v for v in fps if v != fps[-1]]
    assert len(got) == len(set(got)) < 2 * len(fps)
    assert {r["component"] for r in simhash.components(spark.createDataFrame(got, "a long, b long")).collect()} == {min(linked)}


def test_blocks():
    assert len(simhash.BLOCKS) == 14
    for gone in combinations(range(8), 3):
        assert any(not set(gone) & set(b) for b in simhash.BLOCKS)


def texts_of(r):
    base, other = ([f"w{r.randrange(500)}" for _ in range(n)] for n in (400, 90))
    texts = [None, "", " \n\x0b", "one", "ONE two", "one two", "One Two three", "É two three four", "z " * 60_000, "a\u00a0b c\td", "x" * 100_000]
    texts += [edited(base, r.randrange(1, 6), r) for _ in range(80)] + [edited(other, r.randrange(1, 3), r) for _ in range(40)]
    return texts + [texts[12].upper(), texts[12], " ".join(base)]


def test_classes(spark):
    texts = texts_of(random.Random(11))
    got = simhash.classes(docs(spark, texts).withColumn("FP", F.lit(1))).orderBy("doc_id").collect()
    fps = [fingerprint_brute(t) for t in texts]
    assert [r["fp"] % (1 << 64) for r in got] == fps
    assert [r["component_id"] for r in got] == components_brute(fps)
    assert len(set(components_brute(fps))) < len(set(fps))


def test_odd_rows(spark):
    rows = [(None, "a b c"), (7, "A b c"), (7, "a b c"), (9, "d e f"), (9, "d e f"), (None, "g h i"), (3, None), (2, "")]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got.collect()) == [(0, 0), (0, 7), (2, 2), (3, 2), (7, 7), (7, 7), (9, 9), (9, 9)]
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_ids_are_one_node(spark):
    """Rows of one doc_id with different texts tie what their texts are linked with, over several such ids, too."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(5, 0), (7, 0), (7, 1), (8, 1), (8, 2), (3, 2), (None, 3), (None, 4), (20, 4), (9, 5), (9, 5), (30, 3)]
    fps = [fingerprint_brute(t) for t in texts]
    assert len(set(components_brute(fps))) == 6
    got = simhash.classes(spark.createDataFrame([(i, texts[k]) for i, k in rows], "doc_id long, text string"))
    want = sorted((fps[k], i or 0, {0: 3, 1: 3, 2: 3, 3: 30, 4: 20, 5: 9}[k]) for i, k in rows)
    assert sorted((r["fp"] % (1 << 64), r["doc_id"] or 0, r["component_id"]) for r in got.collect()) == want


def test_query(spark, tmp_path):
    texts = texts_of(random.Random(12))
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_simhash"](spark, str(tmp_path)).orderBy("doc_id").collect()
    fps = [fingerprint_brute(t) for t in texts]
    assert [tuple(r) for r in got] == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, components_brute(fps)))]
