"""Periodic runs against a search over all periods."""

import hashlib
import random
import time
import zlib

import pytest

from trackflow.llm import queries, runs
from tests.llm.test_operators import WORD, docs


def runs_brute(words):
    found, n = [], len(words)
    for q in range(1, n // runs.POWER + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            part = words[start : start + length]
            smallest = not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q))
            if i > start and length >= max(runs.LEAST, runs.POWER * q) and smallest:
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_brute(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(r):
    kinds = r.choice([1, 2, 3, 5])
    words = [f"w{r.randrange(kinds)}" for _ in range(r.randrange(60))]
    if words and r.random() < 0.6:
        block = words[: r.randrange(1, 6)]
        words = words[: len(words) // 3] + block * r.randrange(2, 9) + words[len(words) // 3 :]
    return words + words[-7:] * r.choice([0, 0, 4])


def test_runs_of_random_words():
    r = random.Random(8)
    for _ in range(3000):
        words = some_words(r)
        want = runs_brute(words)
        assert runs.runs_in([int(w[1:]) for w in words]) == want
        assert runs.text_runs([b"x x", " ".join(words).encode(), b"", b"w0"])[1] == want


@pytest.mark.parametrize("words", [[0] * 50_000, list(range(12_500)) * 4, [0, 1] * 20_000 + [2] * 9_999])
def test_long_runs_take_little_time(words):
    began = time.perf_counter()
    assert runs.runs_in(words)[0] == ((0, 40_000, 2) if 2 in words and words[40_000] == 2 else (0, 50_000, 1 if not any(words) else 12_500))
    assert time.perf_counter() - began < 20


def test_find_runs(spark):
    r = random.Random(9)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "É é É é\u00a0x", "ab " * 70_000 + "c", "a\x0bb\x0ca\rb a\nb a b x"]
    texts += [" ".join(some_words(r)) for _ in range(150)]
    table = docs(spark, texts).unionByName(docs(spark, texts[4:7]))  # repeated rows
    got = sorted(runs.find_runs(table.withColumnRenamed("lang", "Runs")).collect(), key=lambda x: x["doc_id"])
    assert len(got) == len(texts) + 3
    for row in got[:200]:
        words = WORD.findall(table_text(row["doc_id"], texts))
        want = [(0, 70_000, 1)] if len(words) > 10_000 else runs_brute(words)
        assert [tuple(x) for x in row["runs"]] in (want, runs_brute(WORD.findall(texts[4 + row["doc_id"]] or "")) if row["doc_id"] < 3 else want)
    long = [x for x in got if x["doc_id"] == 7][0]
    assert long["collapsed"] == "ab c"
    assert runs.find_runs(table.limit(0)).collect() == []
    assert runs.find_runs(spark.createDataFrame([(None, "a " * 6)], "doc_id long, text string")).head()["runs"][0]["length"] == 6


def table_text(doc_id, texts):
    return texts[doc_id] or ""


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def test_query(spark, tmp_path):
    r = random.Random(10)
    texts = [None, "", "one"] + [" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(150))) for _ in range(300)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {row["doc_id"]: row for row in queries.QUERIES["op12_runs"](spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    with_runs = 0
    for i, text in enumerate(texts):
        words = planted(i, text)
        found = runs_brute(words)
        with_runs += bool(found)
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (i, len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert tuple(got[i]) == (*want, digest(lines), digest(collapsed_brute(words, found)))
    assert with_runs > 10
