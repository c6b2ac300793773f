"""Periodic runs of words: where a text repeats a passage over and over, found with a suffix automaton.

Words are longest runs without space and \\t to \\r. A run is a stretch of consecutive words with smallest
period q (words q apart are equal) and a length of at least LEAST and POWER * q that no neighbouring word
extends keeping the period.

Words are appended one by one to a suffix automaton. Its suffix links form a tree; the nodes above
a new prefix's node are its suffixes, and each node holds the end of its last occurrence. The tree is kept
as a link-cut tree: a path of nodes with one last end is one splay tree. Accessing the new node walks up path by
path and recolours all of them with the new end. For each path met, the deepest node on the way is the longest
suffix, of L words, that last ended at some earlier j. With d = new end - j, words d apart are equal over
the last L + d words: squares of period d if L >= d. Where the next word ends that equality,
the L + d words are a run; they cannot be extended to the left, as L is the longest. The period is
the smallest, since a smaller one would have given the suffix a later last end.

Only stretches that can hold a run enter an automaton. Every GRAM consecutive words of a run occur in it a second
time, so texts are cut to stretches whose GRAM-word sequences all repeat inside the stretch, until nothing more
can be cut. Equal sequences have equal hashes, so no run is lost; a chance collision only keeps a stretch too
many. In the automaton words are compared themselves.

Defined results: a null text, an empty one or one without words has no runs and collapses to the empty text. Every row is a
document of its own, so repeated rows and doc_ids give a row each; a null doc_id stays null. Runs of different periods may
overlap; they are listed by start, then period. An empty table gives no rows.
A text is handled in one task, with memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflow.llm.frames import chunks, utf8
from trackflow.llm.words import Sequences, Words, mixed, window_starts

LEAST = 6  # words
POWER = 4  # periods; the proof above needs 3 at least
GRAM = 5  # every run has at least 2 * q + GRAM - 1 words
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

Run = tuple[int, int, int]


class SuffixPaths:
    """A suffix automaton over appended words; its link tree is held as link-cut paths. Node 0 is none, 1 the empty suffix."""

    def __init__(self):
        self.length, self.link = [0, 0], [0, 0]
        # Most states have one way on; further ones are in a dictionary.
        self.word, self.next, self.more = [-1, -1], [0, 0], {}
        # Splay trees over paths, shallow nodes left. The root of a tree holds the path's last end; its parent is
        # the node that the path hangs from.
        self.left, self.right, self.up, self.end = [0, 0], [0, 0], [0, 0], [0, 0]
        self.last = 1

    def _node(self, length: int) -> int:
        for column, value in ((self.length, length), (self.link, 0), (self.word, -1), (self.next, 0)):
            column.append(value)
        for column in (self.left, self.right, self.up, self.end):
            column.append(0)
        return len(self.length) - 1

    def _way(self, node: int, word: int) -> int:
        if self.word[node] == word:
            return self.next[node]
        more = self.more.get(node)
        return more.get(word, 0) if more else 0

    def _lead(self, node: int, word: int, to: int) -> None:
        if self.word[node] in (-1, word):
            self.word[node], self.next[node] = word, to
        else:
            self.more.setdefault(node, {})[word] = to

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            left[y] = b = right[x]
            right[x] = y
        else:
            right[y] = b = left[x]
            left[x] = y
        if b:
            up[b] = y
        if z and left[z] == y:
            left[z] = x
        elif z and right[z] == y:
            right[z] = x
        else:
            self.end[x] = self.end[y]
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)

    def _split(self, node: int, above: int, word: int) -> int:
        """A new node for the suffix through ``above`` and ``word``, between ``node`` and the node that it is linked to."""
        made = self._node(self.length[above] + 1)
        self.word[made], self.next[made] = self.word[node], self.next[node]
        if node in self.more:
            self.more[made] = dict(self.more[node])
        self._splay(node)
        shallow = self.left[node]
        if shallow:  # the path is cut above ``node``
            self.left[node] = 0
            self.up[shallow], self.end[shallow] = self.up[node], self.end[node]
        self.end[made] = self.end[node]
        self.link[made] = self.up[made] = self.link[node]
        self.link[node] = self.up[node] = made
        while above and self._way(above, word) == node:
            self._lead(above, word, made)
            above = self.link[above]
        return made

    def append(self, word: int) -> list[tuple[int, int]]:
        """Appends a word: (d, L) of each earlier last end met, d words back, and the longest suffix that ended there."""
        new = self._node(self.length[self.last] + 1)
        at = self.last
        while at and not self._way(at, word):
            self._lead(at, word, new)
            at = self.link[at]
        under = 1
        if at:
            under = self._way(at, word)
            if self.length[under] != self.length[at] + 1:
                under = self._split(under, at, word)
        self.link[new] = self.up[new] = under
        self.last = new
        return self._access(new)

    def _access(self, node: int) -> list[tuple[int, int]]:
        left, right, up, end, length = self.left, self.right, self.up, self.end, self.length
        now, before, below, met = length[node], 0, 0, []
        while node:
            self._splay(node)
            was = end[node]
            if was and was != before:
                met.append((now - was, length[node]))
                before = was
            if right[node]:
                end[right[node]] = was
            right[node] = below
            below, node = node, up[node]
        end[below] = now
        return met


def runs_in(words: list[int]) -> list[Run]:
    """The runs (start, length, period) of a sequence of word numbers, by start, then period."""
    paths, found, n = SuffixPaths(), [], len(words)
    for i, word in enumerate(words, 1):
        for d, same in paths.append(word):
            if same + d >= max(LEAST, POWER * d) and (i == n or words[i] != words[i - d]):
                found.append((i - same - d, same + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: Words) -> Iterator[tuple[int, int]]:
    """Ranges of word numbers, in order, that hold all runs: every GRAM-word sequence in a range repeats there."""
    starts = window_starts(words.first, GRAM)
    grams = Sequences(words.hashes[0]).of(starts, GRAM)
    group = words.text_of_word()[starts]
    while len(starts):
        _, which, times = np.unique(mixed(grams + mixed(group.astype(np.uint64))), return_inverse=True, return_counts=True)
        repeated = times[which] > 1
        if repeated.all():
            break
        starts, grams, group = starts[repeated], grams[repeated], group[repeated]
        cut = np.diff(starts, prepend=starts[:1]) != 1
        cut[1:] |= group[1:] != group[:-1]
        group = np.cumsum(cut)
    edges = np.flatnonzero((np.diff(starts, prepend=-2) != 1) | (np.diff(group, prepend=-1) != 0))
    for a, b in zip(edges, [*edges[1:], len(starts)]):
        yield int(starts[a]), int(starts[b - 1]) + GRAM


def text_runs(texts: list[bytes]) -> list[list[Run]]:
    """The runs of each text."""
    words = Words(texts)
    found: list[list[Run]] = [[] for _ in texts]
    if words.n:
        text_of, buffer = words.text_of_word(), words.buffer.tobytes()
        for begin, end in stretches(words):
            numbers: dict[bytes, int] = {}
            ends = words.ends[begin:end].tolist()
            ids = [numbers.setdefault(buffer[a:b], len(numbers)) for a, b in zip(words.starts[begin:end].tolist(), ends)]
            text = int(text_of[begin])
            offset = begin - int(words.first[text])
            found[text] += [(offset + s, n, q) for s, n, q in runs_in(ids)]
    return found


def collapsed(text: bytes, runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    words = text.split()
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        words = [w for w, inside in zip(words, np.cumsum(step).tolist()) if not inside]
    return b" ".join(words)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["start", "length", "period"]
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in chunks([len(t) for t in texts]):
            runs = text_runs(texts[a:b])
            flat = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names))
            left = pa.array([collapsed(t, r).decode() for t, r in zip(texts[a:b], runs)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed, left], ["doc_id", "runs", "collapsed"])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) of each row: runs as (start, length, period), and the text without the repetitions."""
    one = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return one.mapInArrow(_batches, f"doc_id long, runs {RUNS}, collapsed string")
