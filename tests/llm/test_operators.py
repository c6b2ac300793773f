"""Each text operator on small tables with nulls, empty and very long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackflow.llm import frames, language, line_dedup, mixing, near_dedup, page_text, passages, personal_data, pieces, quality, queries, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 0, 7, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lines_brute(texts, least):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    seen = {}
    for lines in split:
        for k in {key(x) for x in lines} - {""}:
            seen[k] = seen.get(k, 0) + 1
    return [[x for x in lines if seen.get(key(x), 0) < least] for lines in split]


def test_lines(spark):
    texts = [None, "", "a\nB \n\nlong " + "x" * 200_000, "b\n A", "\tb\r\nc", "C", "b", "É\né"]
    got = line_dedup.drop_common_lines(docs(spark, texts), 3).orderBy("doc_id").collect()
    want = lines_brute(texts, 3)
    assert [r["text"] for r in got] == ["\n".join(x) for x in want]
    assert [(r["n_lines"], r["n_dropped"]) for r in got] == [(len((t or "").split("\n")), len((t or "").split("\n")) - len(w)) for t, w in zip(texts, want)]
    assert "shard" in got[0].asDict() and got[0]["shard"] == 7


def test_lines_deletion_undoes_insertion(spark):
    one = line_dedup.line_keys(docs(spark, [f"common\nown {i}" for i in range(6)]))
    two = line_dedup.line_keys(docs(spark, [f"common\nnew\nmore {i}" for i in range(5)]))
    base = line_dedup.materialise(line_dedup.reference_counts(one))
    more = line_dedup.materialise(line_dedup.insert(base, two))
    back = line_dedup.delete(more, two)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(back) == rows(base) and rows(more) != rows(base)
    common = line_dedup.materialise(base.filter("n >= 5"))
    held = line_dedup.build_filters(common, 1)
    grown = line_dedup.update_filters(held, base, more, 1, 5)
    again = line_dedup.update_filters(grown, more, base, 1, 5).collect()[0]
    keys = more.filter("n >= 5").collect()
    wide, narrow = (line_dedup.CuckooFilter(r["buckets"], r["cells"]) for r in (grown.collect()[0], again))
    assert all(wide.may_hold(np.array([k["h2"] for k in keys])))
    assert narrow.may_hold(np.array([k["h2"] for k in keys])).sum() == common.count()


@pytest.mark.parametrize("rows_per_probe", [400_000, 5])
def test_lines_of_repeated_ids(spark, monkeypatch, rows_per_probe):
    """Rows of one doc_id are one document; rows without one are documents of their own."""
    monkeypatch.setattr(line_dedup, "ROWS_PER_PROBE", rows_per_probe)
    rows = [(i % 6, f"shared by rows\neverywhere\nown {i}") for i in range(12)] + [(None, "everywhere\nnone")] * 4 + [(50 + i, "everywhere") for i in range(3)]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    want = [(d, "\n".join(x for x in t.split("\n") if x != "everywhere")) for d, t in rows]
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=repr) == sorted(want, key=repr)


def test_lines_filters_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 50)
    lines = [f"line {i}" for i in range(400)]
    small = line_dedup.materialise(line_dedup.reference_counts(line_dedup.line_keys(docs(spark, ["\n".join(lines[:40])] * 2))))
    more = line_dedup.line_keys(docs(spark, ["\n".join(lines)] * 2))
    grown = line_dedup.materialise(line_dedup.insert(small, more))
    filters, shards = line_dedup.follow(line_dedup.build_filters(line_dedup.materialise(small), 1), small, grown, 1, 2)
    assert shards == 8 and filters.count() == 8
    keys = line_dedup.materialise(more)
    assert line_dedup.common_lines(keys, line_dedup.materialise(grown.filter("n >= 2")), filters, shards).count() == 800


def test_cuckoo_filter():
    random.seed(3)
    keys = [(random.getrandbits(63), random.getrandbits(63)) for _ in range(5000)]
    made = line_dedup.CuckooFilter.for_keys(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))
    h2 = np.array([k[1] for k in keys])
    assert made.may_hold(h2).all()
    assert made.may_hold(np.array([random.getrandbits(63) for _ in range(20000)])).mean() < 0.002
    for a, b in keys[:2500]:
        made.delete(a, b)
    assert made.may_hold(h2[2500:]).all() and made.may_hold(h2[:2500]).mean() < 0.01


def near_brute(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(i, len(s), x, x == i) for i, (s, x) in enumerate(zip(sets, label))]


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def test_near(spark):
    r = random.Random(5)
    base, other = ([f"w{r.randrange(400)}" for _ in range(n)] for n in (150, 60))
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", " ".join(base), " ".join(other), "z " * 40_000]
    texts += [edited(base, r.randrange(1, 9), r) for _ in range(60)] + [edited(other, r.randrange(1, 4), r) for _ in range(25)]
    texts += [texts[12], texts[12].upper(), " ".join(base[:100]), " ".join(base + other)]
    got = near_dedup.classes(docs(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == near_brute(texts)
    kept = {x["doc_id"] for x in near_dedup.keep_one(docs(spark, texts)).collect()}
    assert kept == {x[0] for x in near_brute(texts) if x[3]}


def test_near_nulls_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "a b c d e f")]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got.collect()) == [
        (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False),
    ]


def test_near_ids_with_several_texts(spark):
    """Each text of a doc_id is a set of its own: rows that share a doc_id or are similar make the components."""
    r = random.Random(31)
    rows = []
    for group in range(12):
        base = [f"g{group}w{r.randrange(40)}" for _ in range(60)]
        for copy in range(5):
            words = list(base[: r.choice((30, 45, 60))])
            words[r.randrange(len(words))] = f"x{group}{copy}"
            rows.append((r.randrange(30), " ".join(words)))
    rows += [(31, "one two three four five six")] * 4 + [(32, "one two three four five six"), (29, None), (33, "short")]
    whole = [set() if not t else {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for t in [x or "" for _, x in rows] for w in [t.split()]]
    label = {d: d for d, _ in rows}
    for _ in rows:
        for i, (d, _) in enumerate(rows):
            for j, (e, _) in enumerate(rows):
                if whole[i] and 100 * len(whole[i] & whole[j]) >= 75 * len(whole[i] | whole[j]):
                    label[d] = label[e] = min(label[d], label[e])
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, len(s), label[d], label[d] == d) for (d, _), s in zip(rows, whole)]
    assert sorted(tuple(x) for x in got) == sorted(want)


def passages_brute(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + 35))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone)]


def test_passages(spark, monkeypatch):
    r = random.Random(9)
    shared = [f"p{i}" for i in range(80)]
    texts = [None, "", "few words", " ".join(["same"] * 36), " ".join(["other"] * 35)]
    for i in range(60):
        own = [f"o{i}.{j}" for j in range(r.randrange(5, 60))]
        a = r.randrange(0, 45)
        cut = shared[a : a + r.randrange(30, 60)]
        at = r.randrange(len(own))
        texts.append(" ".join(own[:at] + cut + own[at:]))
    texts += [texts[9], texts[9].replace(" ", "\n")]
    monkeypatch.setattr(passages, "BLOCK_BYTES", 2000)
    got = passages.remove_repeats(docs(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in got] == passages_brute(texts)
    cover = set(passages.COVER)
    assert all(any((a + s) % 21 in cover and (b + s) % 21 in cover for s in range(21)) for a in range(21) for b in range(21))


def test_personal_data(spark):
    text = "É mail a.b@c.example.com, ip 1.2.3.4 and 1.2.3.256 card 4111 1111 1111 1111 phone +1 (203) 555-8282 x@y +12"
    parts = {"email": "a.b@c.example.com", "ip": "1.2.3.4", "card": "4111 1111 1111 1111", "phone": "+1 (203) 555-8282"}
    base = [(k, text.index(p), text.index(p) + len(p)) for k, p in parts.items()]
    assert [s[:3] for s in personal_data.find(text)] == base
    assert [s[0] for s in personal_data.find("IBAN DE89 3704 0044 0532 0130 00 NEXT call 203-555-0188 SSN 536-90-4399")] == ["iban", "ssn", "local_phone"]
    assert personal_data.find("order 536-90-4399 and 203-555-0188, 4111111111111112") == []
    naive = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("a@.b-+ 1") for _ in range(30))
        assert [s[1:3] for s in personal_data.find(t) if s[0] == "email"] == [m.span() for m in naive.finditer(t)]
    found = personal_data.spans(docs(spark, [None, "", text, "a" * 300_000 + "@" * 1000])).orderBy("row.doc_id").collect()
    assert [len(x["spans"]) for x in found] == [0, 0, 4, 0] and found[0]["row"]["shard"] == 7


def test_page_text(spark):
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
    <div class="cookie notice">We use cookies.</div><article><h2>Title &amp; more</h2><p>First,  long <b>text</b> with<br>points. And so on, really.
    <p>Second &eacute;&nbsp;paragraph, shorter.<div class=ad>Buy!</div><form><button>Go</button></form><p>End</article>
    <section id="comments"><p>A reader's very long comment, with points, and words; many of them, indeed!</p></section>
    <script>var a = "<p>no</p>";</script><aside>Side</aside><footer>&copy; x</footer></body></html>"""
    assert page_text.main_text(page) == "Title & more\n\nFirst, long text with points. And so on, really.\n\nSecond é paragraph, shorter.\n\nEnd"
    plain = "<div id=top><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=story><p>A tale, told at length. It goes on.</p><p>And on, to its end.</p></div>"
    assert page_text.main_text(plain) == "A tale, told at length. It goes on.\n\nAnd on, to its end."
    for odd in ("", "<", "<a href='", "<p" * 5000, "</p>" * 500, "&", "<script>x"):
        page_text.main_text(odd)
    rows = spark.createDataFrame([(1, "u", None, "old"), (2, "u", "", "old"), (3, "u", page, "old")], "page_id long, url string, html string, text string")
    got = page_text.extract(rows).orderBy("page_id").collect()
    assert [r["text"][:5] for r in got] == ["", "", "Title"]


@pytest.mark.parametrize("name", ["class='layout has-sidebar'", "class=content-with-sidebar", "class=page-with-banner", "id=social-history", "class=with-header"])
def test_page_text_named_wrapper(name):
    long = "A tale, told at length. It goes on, and on, to its end."
    around = f"<body><div class=ad>Buy!</div><div {name}>%s<div class=sidebar>Side, and more.</div><div class=related><article>A teaser.</article></div></div>"
    around += "<div id=comments><ol><li class=comment><article>A reader's very long comment, with points; longer, really, than the tale itself is.</article></ol></div>"
    article = f"<article><h1>Title</h1><p>{long}<p>End</article>"
    assert page_text.main_text(around % article) == f"Title\n\n{long}\n\nEnd"
    assert page_text.main_text(around % f"<main><div class='x-menu'>{article}</div></main>") == f"Title\n\n{long}\n\nEnd"
    only = f"<body><div class=ad>Buy!</div><div {name}><p>{long}<p>{long}</div><div class='cookie notice'>We use cookies.</div>"
    assert page_text.main_text(only) == f"{long}\n\n{long}"
    assert page_text.main_text("<body><article><p>Short.</article><div class=ad>An advert, longer than the article; much longer.</div>") == "Short."
    assert page_text.main_text("<body><article></article><div class=ad>An advert, all there is.</div>") == ""


def test_page_text_no_article():
    some, more = "A lead, of some length. It tells what comes.", "A tale, told at length. It goes on, and on, to its end. " * 2
    parts = f"<h1>Title</h1><div class=lead>{some}</div><div class=body>{more}</div>"
    want = f"Title\n\n{some}\n\n{more.strip()}"
    menu = "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>"
    assert page_text.main_text(f"<body><div>{menu}</div><div id=story>{parts}</div><div>{menu}</div>") == want
    assert page_text.main_text(f"<body><div>{menu}</div>{parts}<div>{menu}</div>") == want
    quoted = f"<div id=story><h1>Title</h1><p>So.<blockquote><p>{more}</blockquote><ul><li>{some}</ul><p>End</div>"
    assert page_text.main_text(f"<body>{menu}{quoted}") == f"Title\n\nSo.\n\n{more.strip()}\n\n{some}\n\nEnd"
    sections = "".join(f"<section><h2>Part {i}</h2><p>{more}</section>" for i in range(3))
    assert page_text.main_text(f"<body>{menu}<div>{sections}</div>") == "\n\n".join(f"Part {i}\n\n{more.strip()}" for i in range(3))


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<b>x" * 100_000 + "<p>y", "</div>" * 50_000 + "<span>" * 50_000 + "x</i>" * 50_000])
def test_page_text_deep(page):
    began = time.perf_counter()
    assert "x" in page_text.main_text(page)
    assert time.perf_counter() - began < 40


def test_page_text_links_only(spark):
    link = "<p><a href=x>A long linked sentence, with words.</a></p>"
    menu = "<nav><a>Home</a></nav><div class=ad><a>Buy this, now.</a></div>"
    pages = [f"<body>{menu}<article>{link}</article></body>", f"<body>{menu}{link}</body>", f"<main>{menu}{link}{link}</main>"]
    long = "A long linked sentence, with words."
    assert [page_text.main_text(p) for p in pages] == [long, "", f"{long}\n\n{long}"]
    table = spark.createDataFrame([(1, None, "u"), (1, "", "u")], "page_id long, html string, text string")
    assert [r["text"] for r in page_text.extract(table).collect()] == ["", ""] and page_text.extract(table.limit(0)).collect() == []


def parses_brute(sample, text):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_language(spark):
    samples = {"aa": "the cat sat on the mat and the rat", "bb": "el gato se sienta sobre la alfombra"}
    parser = language.CrossParser(samples)
    for text in ("the mat and a cat", "la alfombra el gato", "zzz the", "t"):
        counts = parser.phrases([text, "x" * 5])[0]
        assert counts.tolist() == [parses_brute(samples[k], text) for k in parser.languages]
    rows = docs(spark, [None, "", "12 !?", "the cat sat", "the rat and the cat " * 20_000]).withColumn("lang_pred", F.lit("old"))
    got = language.predictions(rows, samples).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "aa", "aa"] and all(0 <= r["score"] <= 1 for r in got)
    kept = language.keep_known(docs(spark, [None, "12", "some words", "other words"]))
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_language_copies(spark):
    # Texts with the highest draws, copied often: none lies under a share that counts rows.
    words = spark.range(4000).select(F.concat(F.lit("copied words "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    high = words.orderBy(F.desc(F.xxhash64("text"))).limit(20)
    rows = high.crossJoin(spark.range(100)).select("text", F.lit("many").alias("lang"))
    low = words.orderBy(F.xxhash64("text")).limit(20)
    rows = rows.unionByName(low.crossJoin(spark.range(100)).select("text", F.lit("low").alias("lang")))
    samples = language.learn(rows)
    assert set(samples) == {"many", "low"}
    for name, texts in (("many", high), ("low", low)):
        assert samples[name] == " ".join(r["text"] for r in texts.orderBy(F.xxhash64("text")).collect())


def test_language_many_letters(monkeypatch):
    r = random.Random(6)
    wide = lambda first, n: "".join(chr(first + r.randrange(n)) if r.random() < 0.9 else " " for _ in range(4000))
    samples = {"han": wide(0x4E00, 1200), "hangul": wide(0xAC00, 900), "small": "ᚠᚢᚦ ᚨᚱᚲ", "latin": "the cat sat on the mat"}
    samples = {k: " ".join(v.split()) for k, v in samples.items()}
    texts = [samples["han"][500:900], samples["hangul"][90:300], "ᚨᚱᚲ ᚠᚢᚦ", "the mat", samples["han"][7:60] + " cat ᚦ" + samples["hangul"][:30]]
    texts = [language.plain(t) for t in texts]
    for entries in (language.DENSE_ENTRIES, 300, 0):
        monkeypatch.setattr(language, "DENSE_ENTRIES", entries)
        parser = language.CrossParser(samples)
        for text in (t[:250] for t in texts):
            assert parser.phrases([text])[0].tolist() == [parses_brute(samples[k], text) for k in parser.languages]
        assert parser.judge(texts)[0][:4] == ["han", "hangul", "small", "latin"]


def test_language_every_label(spark):
    names = [f"l{i}" for i in range(language.TOTAL_CHARS // 2000 + 5)]
    rows = spark.createDataFrame([(n, f"text of {n}".translate({48 + i: 97 + i for i in range(10)})) for n in names], "lang string, text string")
    samples = language.learn(rows)
    assert sorted(samples) == sorted(names) and samples["l12"] == "text of lbc"


@pytest.mark.parametrize("label", [None, "und"])
def test_language_stage_without_labels(spark, label):
    import corpus_pipeline

    table = docs(spark, [None, "", "12 !?", "some words", "more words", "漢"]).withColumn("lang", F.lit(label).cast("string"))
    kept = dict(corpus_pipeline.STAGES)["language"](spark, table, "")
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_language_stage_labels(spark):
    """Documents without a label get the judged one; other columns keep their values, whatever their names."""
    a, b = "the cat and the dog sat there with them ", "der Hund und die Katze waren nicht dort mit "
    rows = [(i, (a if i % 2 else b) * 5, None if i % 5 == 0 else "en" if i % 2 else "de", 1.5, "x", True) for i in range(1, 60)]
    table = spark.createDataFrame(rows + [(60, "12", None, 0.0, "", False)], "doc_id long, text string, lang string, score double, lang_pred string, LETTERED boolean")
    got = {r["doc_id"]: r for r in language.keep_known(table).collect()}
    assert sorted(got) == list(range(1, 60)) and all(r["lang"] == ("en" if i % 2 else "de") for i, r in got.items())
    assert all((r["score"], r["lang_pred"], r["LETTERED"], r["text"]) == (1.5, "x", True, rows[i - 1][1]) for i, r in got.items())
    assert language.keep_known(table.limit(0)).collect() == []


@pytest.mark.parametrize("step", ["language", "pieces"])
def test_batches_bounded(spark, monkeypatch, tmp_path, step):
    """Python workers get a few MB of texts at once, not 10,000 texts of any length; a lower limit of the session stays."""
    module, note = {"language": language, "pieces": pieces}[step], tmp_path / "batches"

    def noted(sizes, *limit):
        with open(note, "a") as f:
            f.write(f"{sum(sizes)}\n")
        return frames.chunks(sizes, *limit)

    def largest():
        note.write_text("")
        if step == "language":
            rows = language.predictions(table, {"en": "the cat sat"})
        else:
            rows = pieces.encoded(table, pieces.read_model(queries.PIECES), keep=["doc_id"])
        assert rows.count() == 600
        batches = list(map(int, note.read_text().split()))
        assert sum(batches) == 600 * 20_000
        return max(batches)

    monkeypatch.setattr(module, "chunks", noted)
    table = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat sa "), 2000).substr(1, 20_000).alias("text"))
    before = spark.conf.get(frames.BATCH_LIMIT, None)
    try:
        assert largest() <= frames.BATCH_BYTES + 40_000
        spark.conf.set(frames.BATCH_LIMIT, "1m")
        assert largest() <= (1 << 20) + 40_000 and spark.conf.get(frames.BATCH_LIMIT) == "1m"
    finally:
        spark.conf.unset(frames.BATCH_LIMIT) if before is None else spark.conf.set(frames.BATCH_LIMIT, before)


def test_language_held_out(spark):
    found = queries.op5(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    share = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert share >= 0.95


@pytest.mark.parametrize("text", ["the ab", "a  b\n", "ñandú 漢", "x▁y z", " ", "▁", "<s> </s>", "\x00 é"])
def test_pieces_exact(text):
    model = pieces.PieceModel(pieces.read_model(queries.PIECES))
    whole = model.n_best_ids(text)
    assert len({p for _, p in whole}) == len(whole) and all(model.decode(list(ids)) == text for _, ids in whole)
    assert [s for s, _ in whole] == sorted((s for s, _ in whole), reverse=True)
    ids, scores = model.encode(text)
    assert tuple(ids) == whole[0][1] and scores == [s for s, _ in whole]
    if "▁" not in text:
        into, best = model.lattice("▁" + text.replace(" ", "▁")), [[0.0]]
        for edges in into[1:]:
            best.append([b + s for a, s, _ in edges for b in best[a]])
        assert scores == sorted(best[-1], reverse=True)[: model.n_best]


def test_pieces_table(spark):
    raw = pieces.read_model(queries.PIECES)
    texts = [None, "", "some text, ä", "word " * 30_000]
    got = pieces.encoded(docs(spark, texts), raw).withColumn("back", pieces.decoded(raw, F.col("pieces"))).orderBy("row.doc_id").collect()
    assert [r["back"] for r in got] == [t or "" for t in texts]


def test_pieces_n_best_table(spark):
    raw = pieces.read_model(queries.PIECES)
    texts = [None, "", "some text, ä", "x▁y z and a cat", "a", "word " * 3000]
    table = pieces.encoded(docs(spark, texts), raw)
    whole = pieces.written_out(F.col("pieces"), F.col("n_best")).alias("whole")
    read = pieces.digests(raw, F.col("pieces"), F.col("n_best")).alias("read")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    model = pieces.PieceModel(raw)
    for row, text in zip(table.select("row.doc_id", whole, read, "scores").orderBy("doc_id").collect(), texts):
        want = model.n_best_ids(text or "")
        assert [(o["score"], tuple(o["pieces"])) for o in row["whole"]] == want and len({ids for _, ids in want}) == len(want)
        assert [o["score"] for o in row["whole"]] == row["scores"] and (not text or len(want) == 4 or text == "a")
        assert all(model.decode(list(ids)) == (text or "") for _, ids in want)
        assert [tuple(r) for r in row["read"]] == [(sha(",".join(map(str, ids))), sha(text or "")) for _, ids in want]
    op7 = queries.op7(spark, "/root/testdata/sf0.001")
    assert op7.filter("not exact or n_best_sha256 is null").isEmpty() and not op7.filter("n_best = 4").isEmpty()


@pytest.mark.parametrize("c", list(" a-=_.#*") + ["ab", "漢"])
def test_pieces_long_runs(c):
    """Many equally good paths are not all grown: the N best of a long run come at once, distinct and exact."""
    model = pieces.PieceModel(pieces.read_model(queries.PIECES))
    text = c * (5_000 // len(c))
    began = time.perf_counter()
    found = model.n_best_ids(text)
    assert time.perf_counter() - began < 3
    assert len({ids for _, ids in found}) == len(found) == (1 if c == "漢" else 4)
    assert found[0][1] == tuple(model.encode(text)[0]) and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert all(model.decode(list(ids)) == text for _, ids in found)


def test_pieces_kept_columns(spark):
    raw = pieces.read_model(queries.PIECES)
    whole, part = (pieces.encoded(docs(spark, [None, "a text", "more"]), raw, keep=k) for k in (None, ["doc_id", "shard"]))
    assert part.select("row.*").columns == ["doc_id", "shard"] and "text" in whole.select("row.*").columns
    rows = lambda df: sorted(map(tuple, df.select("row.doc_id", "pieces", "scores").collect()))
    assert rows(part) == rows(whole)


def quality_brute(text):
    w = WORD.findall(text or "")
    lines, again = (text or "").split("\n"), 0
    for i, x in enumerate(lines):
        again += bool(WORD.search(x)) and x in lines[:i]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit))


def test_quality(spark):
    good = [f"plain words number {i} " + " ".join(f"w{(i * j) % 50}" for j in range(40)) for i in range(60)]
    bad = [" ".join(f"JUNK{(i + j) % 9}!!" for j in range(40)) for i in range(30)]
    odd = [None, "", "é # x\nq\nq\n\n \n q", "a b c d e f g h " * 6]
    texts = good + bad + odd
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 90)] + [(None, 1)], "doc_id long, quality int")
    got = quality.judge(docs(spark, texts), labels).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality.FORM) for r in got] == [quality_brute(t) for t in texts]
    assert all(r["kept"] != r["base_failed"] for r in got[:60]) and not any(r["kept"] for r in got[60:94])
    none = quality.judge(docs(spark, texts), labels.limit(0))
    assert none.filter("kept = base_failed").isEmpty()


def test_quality_scores(spark, monkeypatch):
    """Scores, the cut and the verdicts worked out again from the counts of all documents and a bounded draw of trusted ones."""
    from collections import Counter

    from trackflow.llm.words import Words

    monkeypatch.setattr(quality, "TRUSTED_ROWS", 40)
    r = random.Random(21)
    texts = [" ".join(r.choice(["fine", "plain", "word", "text", "more"] if i % 3 else ["spam", "buy", "word", "now"]) + str(r.randrange(9)) for _ in range(r.randrange(5, 60))) for i in range(240)]
    table = docs(spark, texts)
    marks = spark.createDataFrame([(i, int(i % 3 > 0 and i % 7 > 0)) for i in range(240)], "doc_id long, quality int")
    keyed = marks.select("doc_id", "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"), F.xxhash64("doc_id", F.lit("trusted")).alias("draw")).collect()
    trusted = {k["doc_id"] for k in sorted((k for k in keyed if not k["held"] and k["quality"] == 1), key=lambda k: (k["draw"], k["doc_id"]))[:40]}
    grams = [quality.ngrams(Words([t.encode()]))[0].tolist() for t in texts]
    every, good = Counter(), Counter()
    for i, g in enumerate(grams):
        every.update(g)
        if i in trusted:
            good.update(g)
    size = 1 << quality.BITS
    n_all, n_good = size + sum(every.values()), size + sum(good.values())
    score = [sum(math.log((1 + good[b]) / n_good) - math.log((1 + every[b]) / n_all) for b in g) / max(1, len(g)) for g in grams]
    held = [(score[k["doc_id"]], k["quality"]) for k in keyed if k["held"]]
    bins = sorted({math.floor(x / quality.STEP) for x, _ in held})
    cuts = [bins[0], *[b + 1 for b in bins]]
    lost = lambda c: sum(quality.LOSS if q else 0 for x, q in held if math.floor(x / quality.STEP) < c) + sum(1 for x, q in held if not q and math.floor(x / quality.STEP) >= c)
    limit = min(cuts, key=lambda c: (lost(c), c)) * quality.STEP
    got = quality.judge(table, marks).orderBy("doc_id").collect()
    assert [g["score"] for g in got] == pytest.approx(score, abs=1e-9) and len(trusted) == 40
    assert [g["kept"] for g in got] == [not g["base_failed"] and score[g["doc_id"]] >= limit for g in got]
    assert 0 < sum(g["kept"] for g in got) < sum(not g["base_failed"] for g in got)


def test_topk(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(12)], 0) for i in range(400)]
    rows += [(400 + i, rows[50][1], 0) for i in range(30)] + [(431, None, 0), (432, [float("nan")] * 12, 0), (433, [None] + [0.1] * 11, 0), (434, [0.5] * 3, 0), (None, [0.1] * 12, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = topk.search(topk.build_index(table), table.filter("vec_id % 50 = 0"), 5).collect()
    whole = {i: np.floor(np.array(v) * 256).astype(int) for i, v, _ in rows[:430]}
    for q in range(0, 430, 50):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    empty = table.limit(0)
    assert topk.search(topk.build_index(empty), empty, 5).count() == 0


def test_topk_blocks_bounded(spark, monkeypatch, tmp_path):
    """A worker gets a block of rows once, however many blocks of queries it meets, and a few blocks at once; many blocks give the rows that one gives."""
    r = np.random.default_rng(6)
    whole = {i: r.integers(-300, 300, 12 if i % 7 else 3) for i in range(0, 6000, 2)}
    table = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in whole.items()], "vec_id long, embedding array<double>").repartition(3)
    note, plain = str(tmp_path / "batches"), type(table).mapInArrow

    def noted(self, f, schema):
        def seen(batches):
            for batch in batches:
                with open(note, "a") as out:
                    out.write("".join(f"{batch.column(c).nbytes}\n" for c in range(batch.num_columns) if str(batch.column(c).type) == "binary"))
                yield batch

        return plain(self, lambda batches: f(seen(batches)), schema)

    monkeypatch.setattr(type(table), "mapInArrow", noted)
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 300)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 2)
    monkeypatch.setattr(topk, "HELD_NUMBERS", 600, raising=False)
    monkeypatch.setattr(frames, "BATCH_BYTES", 10_000)
    before = spark.conf.get(frames.BATCH_LIMIT, None)
    try:
        spark.conf.unset(frames.BATCH_LIMIT)
        index = topk.build_index(table)
        largest = index.agg(F.max(F.length("data")), F.sum(F.length("data")), F.count("data")).head()
        got = topk.search(index, table.filter("vec_id % 16 = 0"), 5).collect()
    finally:
        spark.conf.unset(frames.BATCH_LIMIT) if before is None else spark.conf.set(frames.BATCH_LIMIT, before)
    sizes = [int(x) for x in open(note)]
    assert largest[2] >= 10 and max(sizes) <= 12_000 + largest[0]
    # 375 queries in 188 blocks or more: each of 32 parts gets the index at most once, each of 16 slots the queries.
    assert sum(sizes) <= 32 * (largest[1] + 4 * largest[2]) + 16 * 375 * 8 * 14
    for q in range(0, 6000, 16):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_topk_large_components(spark):
    r = random.Random(5)
    rows = [(i, [0.0] + [r.choice([1, 1e3, 1e5, 3e6]) * r.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    rows += [(300, [3.0e16, 0, 0, 0, 0, 1e-2]), (301, [-3.0e16, 0, 0, 0, 0, 0]), (302, [0.0, 1, 0, 0, 0, 0])]
    whole = {i: [math.floor(x * 256) for x in v] for i, v in rows}
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = topk.search(topk.build_index(table), table.filter("vec_id in (0, 50, 100, 302)"), 5).collect()
    for q in (0, 50, 100, 302):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    for far in ([1e300, 0.0], [3e16, 0.0]):
        two = spark.createDataFrame([(1, far), (2, far)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64-bit integers"):
            topk.search(topk.build_index(two), two, 5).collect()


def test_mixing(spark):
    r = random.Random(4)
    sources = [r.choice(["a", "b", "b", "b", "c", "d"]) for _ in range(1500)] + [None, "z", "tiny"]
    texts = [" ".join(["w"] * r.randrange(1, 60)) for _ in range(1500)] + ["n n n", None, "one"]
    table = docs(spark, texts, sources)
    once, again = (sorted(map(tuple, mixing.mix(table).select("row.doc_id", "size", "source_size", "target", "copies").collect())) for _ in "ab")
    assert once == again and all(0 <= x[4] <= 3 for x in once)
    size = {}
    for s, t in zip(sources, texts):
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        level = (total - 3 * sum(size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in order:
        target = 3 * size[s] if s in full else weight[s] * level
        mine = [x for x in once if sources[x[0]] == s]
        assert all(x[2] == size[s] and abs(x[3] - target) < 1e-6 for x in mine)
        assert abs(sum(x[1] * x[4] for x in mine) - target) <= 60
    assert mixing.repeated(table).columns == table.columns
    assert mixing.mix(table.limit(0)).count() == 0


@pytest.mark.parametrize("step", ["lines", "near", "passages", "language", "quality", "spans"])
def test_empty_tables(spark, step):
    none = docs(spark, [])
    made = {
        "lines": lambda: line_dedup.drop_common_lines(none),
        "near": lambda: near_dedup.classes(none),
        "passages": lambda: passages.remove_repeats(none),
        "language": lambda: language.identify(none),
        "quality": lambda: quality.judge(none, spark.createDataFrame([], "doc_id long, quality int")),
        "spans": lambda: personal_data.spans(none),
    }[step]()
    assert made.count() == 0


def test_digest(spark):
    got = queries.op3(spark, "/root/testdata/sf0.001").filter("spans <> ''").head()
    base = ",".join(s for s in got["spans"].split(",") if s.split(":")[0] in personal_data.BASE)
    assert hashlib.sha256(base.encode()).hexdigest() == got["base_sha256"]
