"""SentencePiece encoding and decoding with the N best segmentations.

A text is a path through the lattice of vocabulary pieces; its score is the sum of its pieces' scores. A
forward Viterbi pass gives every position the best score from the start. These are exact heuristics for a search
backward from the end (A*): the first path to reach the start is the best, the next the second, and so on.

Spaces are written as U+2581, and one is put before the text. Where no piece covers a character, its bytes
are used at the least piece score less 10. U+2581 in a text itself is always given as bytes, so decoding
gives back every text exactly. No piece spans the border between a word and the space before the next, so the
lattice falls into words: new distinct words of a batch go through the passes together, position by position,
and stay in a bounded table of the task. The N best texts are the N best sums over their words. A vocabulary
that has pieces across such borders is searched text by text.

The best ids are those of the Viterbi pass. A* runs over the words in which the next best texts differ from the best,
at most N - 1 of a text; these are given as changes to the best ids, and ``changed`` writes them out.

The vocabulary is read from a file whose path is a parameter. Null and empty texts have no pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.llm.frames import bound_batches, chunks, give_back

SPACE = "▁"
UNKNOWN_COST = 10.0
HELD_WORDS = 250_000
HELD_IDS = 8 * HELD_WORDS
LONG_WORD = 64  # longer words are searched one by one
WORDS_AT_ONCE = 10_000
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

Path = tuple[float, tuple[int, ...]]
Word = tuple[tuple[int, ...], float, float]
Change = tuple[int, int, tuple[int, ...]]  # start and number of the best ids that go, ids in their place
Option = tuple[float, tuple[tuple[int, int], ...]]  # score; (word, rank of its path) where not the best


class PieceTree:
    """Pieces as a tree of characters, kept as a hash table of (node, character) and walked for many words at once."""

    def __init__(self, ids: dict[str, int], scores: list[float], unknown: float):
        child: dict[int, int] = {}
        piece = [-1]
        for text, i in ids.items():
            node = 0
            for c in text:
                node = child.setdefault(node << 21 | ord(c), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        self.piece = np.array([*piece, -1], np.int32)  # the last stands for node -1: no such text
        self.scores = np.array([*scores, unknown])  # the last for id -1: bytes
        self.bits = (4 * len(piece)).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.nodes = np.full(1 << self.bits, -1, np.int32)
        keys, nodes = np.fromiter(child.keys(), np.int64), np.fromiter(child.values(), np.int32)
        slots = self._slots(keys)
        while len(keys):
            self.keys[slots] = np.where(self.keys[slots] < 0, keys, self.keys[slots])
            placed = self.keys[slots] == keys
            self.nodes[slots[placed]] = nodes[placed]
            keys, nodes, slots = keys[~placed], nodes[~placed], self._next(slots[~placed])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & ((1 << self.bits) - 1)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes under ``node`` along the characters ``code``; -1 where there is none."""
        key = node.astype(np.int64) << 21 | code
        slots = self._slots(key)
        there, found = self.keys[slots], self.nodes[slots]
        at = np.flatnonzero((there != key) & (there >= 0))
        found[(there != key)] = -1
        while len(at):
            slots = self._next(slots if len(slots) == len(at) else slots[at])
            there = self.keys[slots]
            hit = there == key[at]
            found[at[hit]] = self.nodes[slots[hit]]
            more = ~hit & (there >= 0)
            at, slots = at[more], slots[more]
        return found

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words by falling length: the best paths' ids in a row (a character c without a piece: -1 - c), how many each has, its score, the second best's."""
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        every, longest = np.arange(len(words)), int(sizes[0])
        left = np.searchsorted(-sizes, -np.arange(longest + 1)).tolist()  # words longer than each position
        best = np.full((longest + 1, len(words)), -np.inf)
        best[0] = 0.0
        length_of = np.zeros(best.shape, np.int16)
        id_of = np.full(best.shape, -1, np.int32)
        edges = []
        for a in range(longest):
            at, node = every[: left[a]], np.zeros(left[a], np.int32)
            for b in range(a + 1, longest + 1):
                n = int(np.searchsorted(at, left[b - 1]))
                at = at[:n]
                node = self.step(node[:n], codes[first[at] + (b - 1)])
                piece = self.piece[node]
                used = piece >= 0 if b > a + 1 else slice(None)
                ends, piece = at[used], piece[used]
                score = self.scores[piece]
                value = best[a, ends] + score
                better = value > best[b, ends]
                won = ends[better]
                best[b, won], length_of[b, won], id_of[b, won] = value[better], b - a, piece[better]
                edges.append((a, b, ends, score))
                alive = node >= 0
                at, node = at[alive], node[alive]
                if not len(at):
                    break
        on_path = np.zeros(best.shape, np.int16)
        at, end, walked = every, sizes, []
        while len(at):
            length = length_of[end, at]
            on_path[end, at] = length
            walked.append((at, end - length, id_of[end, at]))
            end = end - length
            at, end = at[end > 0], end[end > 0]
        # The second best path has an edge that is not on the best one: the best path through each such edge.
        rest = np.full(best.shape, -np.inf)
        rest[sizes, every] = 0.0
        second = np.full(len(words), -np.inf)
        for a, b, at, score in reversed(edges):
            after = score + rest[b, at]
            rest[a, at] = np.maximum(rest[a, at], after)
            through = best[a, at] + after
            through[on_path[b, at] == b - a] = -np.inf
            second[at] = np.maximum(second[at], through)
        word, start, piece = (np.concatenate(x) for x in zip(*walked))
        order = np.lexsort((start, word))
        word, start, piece = word[order], start[order], piece[order]
        lost = np.flatnonzero(piece < 0)
        piece[lost] = -1 - codes[first[word[lost]] + start[lost]]
        return piece, np.bincount(word, minlength=len(words)), best[sizes, every], second


class PieceModel:
    """Pieces with scores, from a SentencePiece model file's bytes."""

    def __init__(self, raw: bytes, n_best: int = 4):
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.n_best = n_best
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.scores: list[float] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            self.bytes_of.append(piece.replace(SPACE, " ").encode())
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[-1] = bytes([int(piece[1:-1], 16)])
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of[-1] = b""
            else:
                self.ids[piece] = i
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no piece for every byte")
        self.unknown = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_COST
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        # Held words by row: ids between two ends, best score, loss of the second best, the last batch that had it.
        self.held: dict[str, int] = {}
        self.held_ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.best, self.loss, self.batch_of = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.batch = 0
        self.found: dict[str, list[Path]] = {}
        self.many: PieceTree | None = None

    @cached_property
    def tree(self) -> dict:
        """Pieces as a tree of characters; a piece's end has its id under the empty string. Decoding needs none."""
        tree: dict = {}
        for piece, i in self.ids.items():
            node = tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        return tree

    def lattice(self, word: str) -> list[list[tuple[int, float, int]]]:
        """For each end position the edges (start, score, id); id -1: the character's bytes."""
        n, tree, scores = len(word), self.tree, self.scores
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for a in range(n):
            node = tree.get(word[a])
            if node is None or "" not in node:
                into[a + 1].append((a, self.unknown, -1))
            b = a + 1
            while node is not None:
                i = node.get("")
                if i is not None:
                    into[b].append((a, scores[i], i))
                if b == n:
                    break
                node = node.get(word[b])
                b += 1
        return into

    def _ids(self, word: str, edges: list[tuple[int, int]]) -> tuple[int, ...]:
        ids: list[int] = []
        for a, i in edges:
            if i < 0:
                ids.extend(self.byte_id[x] for x in word[a].encode())
            else:
                ids.append(i)
        return tuple(ids)

    def viterbi(self, into: list) -> tuple[list[float], list]:
        """The best score from the start to every position, and the last edge of a path that has it."""
        best, last = [0.0], [None]
        for edges in into[1:]:
            top, chosen = None, None
            for edge in edges:
                score = best[edge[0]] + edge[1]
                if top is None or score > top:
                    top, chosen = score, edge
            best.append(top)
            last.append(chosen)
        return best, last

    def search(self, word: str) -> list[Path]:
        """The N best paths (score, ids), best first."""
        into = self.lattice(word)
        best, _ = self.viterbi(into)
        found: list[Path] = []
        # By what a path loses against the best, which is exactly 0 along best edges. Of equal losses the one nearest to the start goes on,
        # then the newest, so that many equally good paths are not all grown side by side.
        agenda = [(0.0, len(word), 0, None)]
        serial = 0
        while agenda and len(found) < self.n_best:
            loss, at, _, path = heapq.heappop(agenda)
            if not at:
                edges: list[tuple[int, int]] = []
                while path is not None:
                    edge, path = path
                    edges.append(edge)
                found.append((best[-1] - loss, self._ids(word, edges)))
                continue
            for a, s, i in into[at]:
                serial -= 1
                heapq.heappush(agenda, (loss + (best[at] - (best[a] + s)), a, serial, ((a, i), path)))
        return found

    def of_word(self, word: str) -> Word:
        """The best path's ids and score, and what the second best loses (infinite if there is none)."""
        if not word:  # stands for a U+2581 of the text
            return tuple(self.byte_id[x] for x in SPACE.encode()), self.unknown, math.inf
        into = self.lattice(word)
        best, last = self.viterbi(into)
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at = last[at][0]
        # The second best path has an edge that is not on the best one: the best path through each such edge.
        rest = [-math.inf] * len(word) + [0.0]
        second = -math.inf
        for b in range(len(word), 0, -1):
            for edge in into[b]:
                after = edge[1] + rest[b]
                if after > rest[edge[0]]:
                    rest[edge[0]] = after
                if edge is not last[b] and best[edge[0]] + after > second:
                    second = best[edge[0]] + after
        on_path = {id(e) for e in path}
        for b in range(1, len(word) + 1):
            edge = last[b]
            if id(edge) not in on_path and best[edge[0]] + edge[1] + rest[b] > second:
                second = best[edge[0]] + edge[1] + rest[b]
        return self._ids(word, [(e[0], e[2]) for e in reversed(path)]), best[-1], best[-1] - second

    def hold(self, texts: list[list[str]]) -> None:
        """Finds all words of ``texts`` that are not held yet, many at once."""
        if len(self.held) > HELD_WORDS or len(self.held_ids) > HELD_IDS:
            self._let_go()
        self.batch += 1
        words = set(chain.from_iterable(texts))
        fresh = sorted(words.difference(self.held), key=len, reverse=True)
        self.batch_of[[self.held[w] for w in words.intersection(self.held)]] = self.batch
        alone = [w for w in fresh if not 0 < len(w) <= LONG_WORD]
        fresh = [w for w in fresh if 0 < len(w) <= LONG_WORD]
        ids, counts, best, loss = [self.held_ids], [np.diff(self.ends)], [self.best], [self.loss]
        for word in alone:
            own, score, less = self.of_word(word)
            for column, value in zip((ids, counts, best, loss), (own, [len(own)], [score], [less])):
                column.append(np.array(value))
        self.many = self.many or PieceTree(self.ids, self.scores, self.unknown)
        for x in range(0, len(fresh), WORDS_AT_ONCE):
            part = fresh[x : x + WORDS_AT_ONCE]
            flat, count, score, second = self.many.paths(part)
            for column, value in zip((ids, counts, best, loss), (*self._with_bytes(flat, count), score, score - second)):
                column.append(value)
        self.held.update(zip(alone + fresh, range(len(self.held), len(self.held) + len(alone) + len(fresh))))
        self.held_ids = np.concatenate(ids).astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
        self.best, self.loss = np.concatenate(best), np.concatenate(loss)
        self.batch_of = np.append(self.batch_of, np.full(len(self.held) - len(self.batch_of), self.batch))

    def _let_go(self) -> None:
        """Keeps the words that came in the later batches: about half of them, at most the bounds."""
        keep = self.batch_of > np.median(self.batch_of)
        counts = np.diff(self.ends)
        if counts[keep].sum() > HELD_IDS:
            keep[:] = False
        self.held = {w: row for row, w in enumerate(w for w, k in zip(self.held, keep.tolist()) if k)}
        self.held_ids = self.held_ids[np.repeat(keep, counts)]
        self.ends = np.concatenate([[0], np.cumsum(counts[keep])]).astype(np.int64)
        self.best, self.loss, self.batch_of = self.best[keep], self.loss[keep], self.batch_of[keep]
        self.found.clear()

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` and their counts with bytes for the characters without a piece."""
        lost = ids < 0
        if not lost.any():
            return ids, counts
        spelt = [[self.byte_id[x] for x in chr(-1 - c).encode()] for c in ids[lost].tolist()]
        width = np.ones(len(ids), np.int64)
        width[lost] = [len(b) for b in spelt]
        made = np.repeat(ids, width)
        made[made < 0] = list(chain.from_iterable(spelt))
        return made, np.bincount(np.repeat(np.arange(len(counts)), counts), width, len(counts)).astype(np.int64)

    def _search_held(self, word: str) -> list[Path]:
        if len(word) > LONG_WORD:
            return self.search(word)
        if word not in self.found:
            self.found[word] = self.search(word)
        return self.found[word]

    def _words(self, text: str) -> list[str]:
        """The words of the lattice; an empty string stands for U+2581 in the text itself."""
        words: list[str] = []
        for k, part in enumerate(text.split(SPACE)):
            part = part.replace(" ", SPACE)
            if k:
                words.append("")
            else:
                part = SPACE + part
            if self.by_word:
                words += WORD.findall(part)
            elif part:
                words.append(part)
        return words

    def _encode(self, words: list[str]) -> tuple[np.ndarray, list[tuple[float, list[Change]]]]:
        """The best ids, and the N best scores with their changes to them, in order. ``words`` are held."""
        if not words:
            return np.zeros(0, np.int32), [(0.0, [])]
        rows = np.fromiter(map(self.held.__getitem__, words), np.int64, len(words))
        begin, count = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        end = np.cumsum(count)
        ids = self.held_ids[np.arange(end[-1]) + np.repeat(begin - end + count, count)]
        total = float(self.best[rows].sum())
        # The N best texts change no words but those with the N - 1 smallest losses.
        losses, n = self.loss[rows], min(self.n_best - 1, len(words))
        low = np.flatnonzero(losses <= np.partition(losses, n - 1)[n - 1]) if n else np.zeros(0, np.int64)
        few = [w for w in low[np.argsort(losses[low], kind="stable")][:n].tolist() if losses[w] < math.inf]
        paths = {w: self._search_held(words[w]) for w in few}
        options: list[Option] = [(0.0, ())]
        for w, found in paths.items():
            grown = [(loss + found[0][0] - p[0], changes + ((w, r),) if r else changes) for loss, changes in options for r, p in enumerate(found)]
            options = heapq.nsmallest(self.n_best, grown)
        made = []
        for loss, changes in options:
            made.append((total - loss, [(int(end[w] - count[w]), int(count[w]), paths[w][r][1]) for w, r in sorted(changes)]))
        return ids, made

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[float, list[Change]]]]]:
        """For each text the best ids, and the scores of the N best segmentations in order with their changes."""
        words = [self._words(t) if t else [] for t in texts]
        self.hold(words)
        for w in words:
            yield self._encode(w)

    def encode(self, text: str) -> tuple[list[int], list[float]]:
        ids, options = next(self.encode_all([text]))
        return ids.tolist(), [score for score, _ in options]

    def n_best_ids(self, text: str) -> list[Path]:
        """The N best segmentations in full."""
        ids, options = next(self.encode_all([text]))
        return [(score, tuple(changed(ids.tolist(), changes))) for score, changes in options]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:] if ids else ""


def changed(best: list[int], changes: list[Change]) -> list[int]:
    """The best ids after the changes."""
    out, at = [], 0
    for start, n, ids in changes:
        out += best[at:start]
        out += ids
        at = start + n
    return out + best[at:]


CHANGES = "array<struct<start int, n int, pieces array<int>>>"


def encoded(docs: DataFrame, model: bytes, n_best: int = 4, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, pieces, scores, n_best): each row of ``docs`` as a struct, its best ids, its N best scores in order, and
    the N best segmentations, each with its score and its changes to the best ids.

    ``row`` holds the columns ``keep`` (default: all). Without the text among them it goes to the Python workers once and does not come back.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    row = docs.select(held.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = row.schema["row"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(model, n_best)
        change = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("pieces", pa.list_(pa.int32()))])
        option = pa.struct([("score", pa.float64()), ("changes", pa.list_(change))])
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in chunks(sizes):
                part = batch.slice(a, b - a)
                ids, ends, options = [], [0], []
                for best, found in pieces.encode_all(part.column(1).to_pylist()):
                    ids.append(best)
                    ends.append(ends[-1] + len(best))
                    options.append(found)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                scores = pa.array([[score for score, _ in found] for found in options], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, scores, pa.array(options, pa.list_(option))], ["row", "pieces", "scores", "n_best"])
                del part, ids, options, lists, scores
            del batch
            give_back()
        del pieces
        give_back()

    bound_batches(docs.sparkSession)
    return row.mapInArrow(encode, f"row {kind}, pieces array<int>, scores array<double>, n_best array<struct<score double, changes {CHANGES}>>")


def written_out(pieces: Column, n_best: Column) -> Column:
    """array<struct<score, pieces>>: the N best segmentations in full, of columns of ``encoded``."""
    after = lambda ids, c: F.concat(F.slice(ids, 1, c["start"]), c["pieces"], F.slice(ids, c["start"] + c["n"] + 1, F.size(ids)))
    whole = lambda o: F.aggregate(F.reverse(o["changes"]), pieces, after)
    return F.transform(n_best, lambda o: F.struct(o["score"].alias("score"), whole(o).alias("pieces")))


def digests(model: bytes, pieces: Column, n_best: Column) -> Column:
    """array<struct<pieces_sha256, decoded_sha256>>: the ids, joined by commas, and the text of each of the N best."""

    @F.pandas_udf("array<struct<pieces_sha256 string, decoded_sha256 string>>")
    def digest(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = PieceModel(model)
        names = [str(i) for i in range(len(made.bytes_of))]

        def both(ids: list[int], options: np.ndarray) -> list[dict[str, str]]:
            # What lies between the places of changes is joined once for all options.
            own, raw = list(map(names.__getitem__, ids)), list(map(made.bytes_of.__getitem__, ids))
            swaps = [{c["start"]: c["pieces"] for c in option["changes"]} for option in options]
            cuts = sorted({0, len(own)}.union(x for o in options for c in o["changes"] for x in (c["start"], c["start"] + c["n"])))
            spans = [(a, ",".join(own[a:b]), b"".join(raw[a:b])) for a, b in zip(cuts, cuts[1:])]
            found, known = [], {}
            for swap in swaps:
                listed = ",".join([",".join(names[i] for i in swap[a]) if a in swap else part for a, part, _ in spans])
                whole = b"".join([b"".join(made.bytes_of[i] for i in swap[a]) if a in swap else part for a, _, part in spans])
                if whole not in known:
                    known[whole] = hashlib.sha256(whole.decode("utf-8", "replace")[1:].encode()).hexdigest()
                found.append({"pieces_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": known[whole]})
            return found

        for first, second in columns:
            yield pd.Series([both(ids.tolist(), options) for ids, options in zip(first, second)], index=first.index)

    return digest(pieces, n_best)


def decoded(model: bytes, pieces: Column) -> Column:
    """The text of a column of ids."""

    @F.pandas_udf("string")
    def decode(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = PieceModel(model)
        for column in columns:
            yield column.map(lambda ids: made.decode([] if ids is None else ids.tolist()))

    return decode(pieces)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
