"""Language identification by cross-parsing against suffix automata.

For each language a bounded sample of labelled text is indexed by a suffix automaton, which knows
every substring of the sample. A text is parsed from left to right into phrases, each the longest match with
the sample; a language whose sample resembles the text needs few phrases. Phrases times
log2(sample length) over the text's length is the cross entropy in bits per character; the language
with the fewest bits wins, ties go to the smaller name by code point.

Texts are lower-cased, and everything but letters becomes one space. Long texts are parsed in pieces of
PIECE characters side by side; a phrase ends where its piece ends.

Parameters of the sample: at most SAMPLE_ROWS different texts per language, at most SAMPLE_CHARS characters per
language, TOTAL_CHARS over all languages or LEAST_CHARS for each, if that is more. Every label is learned, and
every character of its sample counts. Defined results: a null text or one without a letter is "und" with score
0, as is every text if there is nothing to learn from; a label of null is not learned.
The score is 1 less the best language's bits over the second best's (1 if there is one language only).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.llm.frames import bound_batches, chunks, free_name, give_back
from trackflow.operators.tables import attach, materialise, row_count

SAMPLE_ROWS = 200
SAMPLE_CHARS = 30_000
TOTAL_CHARS = 600_000
ROW_CHARS = 6_000
PIECE = 256
LEAST_CHARS = 2_000
DENSE_ENTRIES = 1 << 25
CHUNK_CHARS = 1 << 19
UNKNOWN = "und"


def plain(text: str) -> str:
    """Lower-cased letters, words parted by one space; empty if there is no letter."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for symbol in text:
        here = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in follow[at]:
            follow[at][symbol] = here
            at = link[at]
        if at >= 0:
            to = follow[at][symbol]
            if length[to] == length[at] + 1:
                link[here] = to
            else:
                copy = len(follow)
                follow.append(dict(follow[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[here] = copy
                while at >= 0 and follow[at].get(symbol) == to:
                    follow[at][symbol] = copy
                    at = link[at]
        last = here
    return follow


class DenseTable:
    """An automaton as a table: row = state, column = symbol, entry = the next state's row, with the lowest bit
    set where a new phrase begins."""

    def __init__(self, follow: list[dict[int, int]], symbols: int):
        self.width = dense_width(symbols)
        start = np.full(self.width, 1, np.int32)
        for symbol, to in follow[0].items():
            start[symbol] = (to * self.width) | 1
        table = np.tile(start, (len(follow), 1))
        for at, state in enumerate(follow):
            if state and at:  # every step from the start begins a phrase
                table[at, list(state)] = [to * self.width for to in state.values()]
        self.table = table.ravel()
        self.keep = np.int32(~(self.width - 1))

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.table.take((state & self.keep) | symbols)


class SparseTable:
    """An automaton as its sorted steps (state, symbol); entries are twice the next state, the lowest bit as above."""

    def __init__(self, follow: list[dict[int, int]], symbols: int):
        self.symbols = symbols
        self.start = np.full(symbols, 1, np.int32)
        for symbol, to in follow[0].items():
            self.start[symbol] = (to << 1) | 1
        steps = [(at * symbols + symbol, to << 1) for at, state in enumerate(follow) if at for symbol, to in state.items()]
        keys = np.array([k for k, _ in steps] + [np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array([to for _, to in steps] + [0], np.int32)[order]

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        entry = self.start.take(symbols)
        live = np.flatnonzero((state > 1) & (symbols > 0))
        wanted = (state[live] >> 1).astype(np.int64) * self.symbols + symbols[live]
        at = self.keys.searchsorted(wanted)
        hit = self.keys.take(at) == wanted
        entry[live[hit]] = self.next.take(at[hit])
        return entry


def dense_width(symbols: int) -> int:
    return 1 << max(1, math.ceil(math.log2(symbols)))


class CrossParser:
    """Counts the phrases of many texts for all languages.

    Each language has symbols of its own for the characters of its sample. Tables are dense as far as all of them
    have at most DENSE_ENTRIES entries, those with the fewest first, and sparse beyond; both count the same.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        # 0: a letter that no sample has; 1: the space.
        common = [" ", *sorted(set().union(*samples.values()) - {" "})]
        self.symbol_of = np.zeros(0x110000, np.int32)
        self.symbol_of[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        letters = {name: [" ", *sorted(set(text) - {" "})] for name, text in samples.items()}
        entries = {name: 2 * (len(text) + 1) * dense_width(len(letters[name]) + 1) for name, text in samples.items()}
        dense, total = set(), 0
        for name in sorted(samples, key=lambda n: (entries[n], n)):
            total += entries[name]
            if total <= DENSE_ENTRIES:
                dense.add(name)
        self.tables: list[DenseTable | SparseTable] = []
        # Per language: its symbol of each symbol of all.
        self.own: list[np.ndarray] = []
        for name in self.languages:
            symbols = {c: i + 1 for i, c in enumerate(letters[name])}
            own = np.zeros(len(common) + 1, np.min_scalar_type(len(symbols)))
            own[self.symbol_of[[ord(c) for c in symbols]]] = list(symbols.values())
            self.own.append(own)
            # No name holds the dicts of one automaton while those of the next are made.
            kind = DenseTable if name in dense else SparseTable
            self.tables.append(kind(suffix_automaton([symbols[c] for c in samples[name]]), len(symbols) + 1))
        self.costs = np.array([math.log2(max(2, len(samples[n]))) for n in self.languages])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrase counts: a row per text, a column per language. ``texts`` are plain."""
        sizes = np.array([len(t) for t in texts], np.int64)
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        common = self.symbol_of[letters]
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[owner] + part * PIECE
        long = np.minimum(sizes[owner] - part * PIECE, PIECE)
        order = np.argsort(-long, kind="stable")
        owner, begin, long = owner[order], begin[order], long[order]
        active = np.searchsorted(-long, -np.arange(PIECE), side="left")
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        for column, (table, own) in enumerate(zip(self.tables, self.own)):
            symbols = own[common].astype(np.int32)
            state = np.zeros(len(owner), np.int32)
            found = np.zeros(len(owner), np.int32)
            for step in range(PIECE):
                m = int(active[step])
                if not m:
                    break
                entry = table.step(state[:m], symbols[begin[:m] + step])
                found[:m] += entry & 1
                state[:m] = entry
            total[:, column] = np.bincount(owner, found, len(texts)).astype(np.int64)
        return total

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        counts = self.phrases(texts) * self.costs
        for text, bits in zip(texts, counts):
            if not text:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(bits.argmin())
            names.append(self.languages[best])
            rest = np.delete(bits, best)
            scores.append(float(1 - bits[best] / rest.min()) if len(rest) else 1.0)
        return names, scores


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", draw: Column | None = None) -> dict[str, str]:
    """A bounded sample of plain text per language; ``draw`` is the number that orders the rows, copies count once."""
    key = F.xxhash64(F.col(text))
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), key.alias("key"), (key if draw is None else draw).alias("draw"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialise(rows.select("lang", "key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if not row_count(sizes):
        return {}
    # Hashes of different texts are even, so their lowest four-fold share holds enough of them; few are ranked.
    share = F.least(F.lit(1.0), 4 * SAMPLE_ROWS / F.col("n"))
    low = (F.col("draw") / float(1 << 63) + 1) / 2 <= share
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - ROW_CHARS) / 2)).cast("int")
    few = attach(rows, sizes, ["lang"], "inner").filter(low)
    few = few.select("lang", "key", "draw", F.col("text").substr(middle, F.lit(ROW_CHARS)).alias("text"))
    few = few.groupBy("lang", "key", "text").agg(F.min("draw").alias("draw"))
    chars = min(SAMPLE_CHARS, max(LEAST_CHARS, TOTAL_CHARS // row_count(sizes)))

    def sample(group: pa.Table) -> pa.Table:
        ranked = sorted(zip(group["draw"].to_pylist(), group["text"].to_pylist()))[:SAMPLE_ROWS]
        parts: list[str] = []
        for _, text in ranked:
            if sum(map(len, parts)) >= chars:
                break
            parts.append(plain(text))
        return pa.table({"lang": group["lang"][:1].cast(pa.string()), "sample": pa.array([" ".join(parts)[:chars].strip()], pa.string())})

    joined = few.groupBy("lang").applyInArrow(sample, "lang string, sample string")
    return {r["lang"]: r["sample"] for r in joined.filter("sample <> ''").collect()}


def predictions(
    docs: DataFrame, samples: dict[str, str], text: str = "text", names: tuple[str, ...] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with a language and a score under ``names``, a third name: whether the text has a letter; columns of these names are replaced.

    A text that is a column of its own type goes to the Python workers once.
    """
    taken = {n.lower() for n in names}
    kept = [c for c in docs.columns if c.lower() not in taken]
    inner = [f"c{i}" for i in range(len(kept))]
    plain_rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)])
    place = next((i for i, c in enumerate(kept) if c.lower() == text.lower() and plain_rows.schema[i].dataType.simpleString() == "string"), None)
    if place is None:
        place, plain_rows = len(inner), docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = [f"{i} {plain_rows.schema[i].dataType.simpleString()}" for i in inner]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = CrossParser(samples) if samples else None
        for batch in batches:
            column = batch.column(place)
            for a, b in chunks([n or 0 for n in pc.binary_length(column).to_pylist()], CHUNK_CHARS):
                texts = [plain(t or "") for t in column.slice(a, b - a).to_pylist()]
                judged, scores = parser.judge(texts) if parser else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                own = [c.slice(a, b - a) for c in batch.columns[: len(inner)]]
                found = [pa.array(judged), pa.array(scores), pa.array([bool(t) for t in texts])]
                yield pa.RecordBatch.from_arrays([*own, *found], [*inner, "lang_pred", "score", "lettered"])
                del own, found, texts
            del batch, column
            give_back()
        del parser
        give_back()

    bound_batches(docs.sparkSession)
    judged = plain_rows.mapInArrow(judge, ", ".join([*kinds, "lang_pred string", "score double", "lettered boolean"]))
    found = [F.col(i).alias(n) for i, n in zip(("lang_pred", "score", "lettered"), names)]
    return judged.select(*[F.col(i).alias(c) for c, i in zip(kept, inner)], *found)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: a fifth by CRC-32 of its id as text; never one without id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score, learned from labelled documents not held out."""
    samples = learn(docs.filter(~held_out(doc_id)), text, lang)
    out = predictions(docs, samples, text)
    others = [c for c in out.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    return out.select(*[F.col(f"`{c}`") for c in others], held_out(doc_id).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without those that have no language: null texts and texts without a letter. A document without a label gets the judged one.

    Texts with letters stay whatever they are judged to be, also unjudged (and then unlabelled) where there is nothing to learn from.
    """
    samples = learn(docs.filter(~held_out(doc_id)), text, lang)
    names = tuple(free_name(docs, n) for n in ("_judged", "_score", "_lettered"))
    judged = predictions(docs, samples, text, names).filter(F.col(names[2]))
    known = F.coalesce(F.col(f"`{lang}`"), F.when(F.col(names[0]) != UNKNOWN, F.col(names[0])))
    return judged.select(*[known.alias(c) if c.lower() == lang.lower() else F.col(f"`{c}`") for c in docs.columns])
