"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers, floor(256 * x). The index holds blocks of rows; in a block, each
attribute is stored as bit slices: slice b is a bitmap of bit b of (value - lowest) over the rows.
For a query, the score's slices are sums of attribute slices: each non-zero digit of a query
component (signed digits -1, 0, 1, so few are non-zero) adds the attribute's slices, shifted, by
carry-save additions of whole bitmaps; a negative digit adds complements. The best rows are chosen from
the most significant slice of the score downward; rows that tie on the boundary are resolved by exact
scores, read back from the slices, and by id.

Blocks of rows and blocks of queries are dealt to cells, so that every block of rows meets every block of queries
in one cell. A cell's worker holds its queries with the k best rows of each so far, and gets the cell's blocks of
rows one after another; then k best per query over the cells. Blocks and cells are bounded by the numbers they
hold, not by rows. No index, query set or candidate list passes through the driver.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite component, and rows with a
null id take no part. Quantised components are 64-bit integers; a component, or a score of a block's best,
beyond them is an error. Vectors meet only vectors of
their length. Rows that share the query's id are its own and no candidates; an id queried with
several vectors is answered for the least of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflow.llm.frames import bound_batches, give_back
from trackflow.operators.tables import materialise

ROWS_PER_BLOCK = 1 << 16
QUERIES_PER_BLOCK = 64
BLOCK_NUMBERS = 1 << 22  # of a block at most, unless one row has more
HELD_NUMBERS = 1 << 22  # of the queries that a cell should hold
MET_NUMBERS = 1 << 25  # of the rows that should come to a cell
LIMIT = 1 << 63


def quantised(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, dim, v): valid vectors as whole numbers."""
    fits = lambda y: (y >= F.lit(-1.0 * LIMIT)) & (y < F.lit(1.0 * LIMIT))
    beyond = F.raise_error(F.lit("a component times 256 is beyond 64-bit integers")).cast("long")
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(fits(x * 256), F.floor(x * 256)).otherwise(beyond))
    good = ~F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & good)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), whole.alias("v"))


class Slices:
    """The bit slices of a block: ``planes`` [attribute, bit, word]; value = lowest + sum of bits."""

    def __init__(self, ids: np.ndarray, planes: np.ndarray, lowest: np.ndarray):
        self.ids, self.planes, self.lowest = ids, planes, lowest
        n = len(ids)
        everything = np.zeros(planes.shape[2] * 64, np.uint8)
        everything[:n] = 1
        self.rows = np.packbits(everything, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Slices:
        order = np.argsort(ids, kind="stable")
        lowest, highest = values.min(axis=0), values.max(axis=0)
        spread = highest.view(np.uint64) - lowest.view(np.uint64)  # modulo 2**64, as the difference may have 64 bits
        bits = max(1, int(spread.max()).bit_length())
        words, used = -(-len(ids) // 64), -(-bits // 8)
        planes = np.zeros((values.shape[1], bits, words * 8), np.uint8)
        raised = np.zeros(words * 64, "<u8")
        for d in range(values.shape[1]):  # one attribute at a time, as the bits take more room than the numbers
            raised[: len(ids)] = values[order, d].view(np.uint64) - lowest.view(np.uint64)[d]
            each = np.unpackbits(raised.view(np.uint8).reshape(-1, 8)[:, :used], axis=1, count=bits, bitorder="little")
            planes[d] = np.packbits(each.T, axis=1, bitorder="little")
        return cls(ids[order], planes.view(np.uint64), lowest)

    def to_bytes(self) -> bytes:
        shape = np.array([len(self.ids), *self.planes.shape], np.int64)
        return b"".join(a.tobytes() for a in (shape, self.ids, self.lowest, self.planes))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Slices:
        n, dim, bits, words = np.frombuffer(raw, np.int64, 4).tolist()
        ids = np.frombuffer(raw, np.int64, n, 32)
        lowest = np.frombuffer(raw, np.int64, dim, 32 + 8 * n)
        planes = np.frombuffer(raw, np.uint64, dim * bits * words, 32 + 8 * (n + dim))
        return cls(ids, planes.reshape(dim, bits, words), lowest)

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The vectors of some rows, read back from the slices."""
        bit = (self.planes[:, :, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
        weights = (np.uint64(1) << np.arange(self.planes.shape[1], dtype=np.uint64))[None, :, None]
        return ((bit * weights).sum(axis=1, dtype=np.uint64) + self.lowest.view(np.uint64)[:, None]).view(np.int64).T

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The slices, least first, of the inner product less a constant that all rows share."""
        dims, bits, words = self.planes.shape
        minus, shift, d = signed_digits(query)
        if not len(d):
            return np.zeros((0, words), np.uint64)
        last = int(shift.max()) + bits - 1
        own = []  # by weight: the attributes' slices, and how many of them are added as they are
        sizes = []  # by weight: how many slices of its own and how many carries it has
        while len(own) <= last or sum(sizes[-1]) > 1:
            on = (shift <= len(own)) & (len(own) < shift + bits)
            own.append((d[on] * bits + len(own) - shift[on], int(np.count_nonzero(~minus[on]))))
            sizes.append((len(own[-1][0]), sum(sizes[-1]) // 2 if sizes else 0))
        flat, out = self.planes.reshape(dims * bits, words), np.zeros((len(own), words), np.uint64)
        # Sums stay where their summands were, carries go behind the next weight's own slices.
        most = max(map(sum, sizes))
        have, after, half = (np.empty((n, words), np.uint64) for n in (most, most, most // 3 + 1))
        for weight, ((chosen, plus), (fresh, carried)) in enumerate(zip(own, sizes)):
            np.take(flat, chosen, axis=0, out=have[:fresh], mode="clip")
            np.invert(have[plus:fresh], out=have[plus:fresh])
            n, to = fresh + carried, sizes[weight + 1][0] if weight + 1 < len(sizes) else 0
            while n > 2:
                k = n // 3
                a, b, c, h = have[:k], have[k : 2 * k], have[2 * k : 3 * k], half[:k]
                np.bitwise_xor(a, b, out=h)
                np.bitwise_and(a, b, out=a)
                np.bitwise_and(h, c, out=b)
                np.bitwise_or(a, b, out=after[to : to + k])
                np.bitwise_xor(h, c, out=a)
                have[k : n - 2 * k] = have[3 * k : n]
                n, to = n - 2 * k, to + k
            if n == 2:
                np.bitwise_and(have[0], have[1], out=after[to])
                np.bitwise_xor(have[0], have[1], out=have[0])
            if n:
                out[weight] = have[0]
            have, after = after, have
        return out

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k rows with the highest scores, ties to smaller ids."""
        open_ = self.rows.copy()
        lo, hi = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for r in range(lo, hi):
            open_[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        sure = np.zeros_like(open_)
        if count(open_) > k:
            for plane in reversed(self.scores(query)):
                high = open_ & plane
                n = count(sure | high)
                if n > k:
                    open_ = high
                elif n < k:
                    sure |= high
                    open_ = open_ & ~plane
                else:
                    sure |= high
                    open_ = np.zeros_like(open_)
                    break
        # What is open now ties on the boundary score; rows are in order of their ids.
        rows = np.concatenate([positions(sure), positions(open_)[: k - count(sure)]])
        scores = exact_products(self.values(rows), query)
        order = np.lexsort((self.ids[rows], -scores))
        return self.ids[rows][order], scores[order]


def exact_products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products with ``query``, by wider sums where 64 bits might not do; an error if one is beyond 64 bits."""
    largest = np.abs(values.astype(np.float64)).max(axis=0, initial=0.0)
    if float(largest @ np.abs(query.astype(np.float64))) < 2.0**62:
        return values @ query.astype(np.int64)
    wide = [sum(v * q for v, q in zip(row, query.tolist())) for row in values.tolist()]
    if any(not -LIMIT <= score < LIMIT for score in wide):
        raise OverflowError("an inner product is beyond 64-bit integers")
    return np.array(wide, np.int64)


def signed_digits(query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-adjacent form: (is minus, shift, attribute) of each digit, with value = sum of +-2**shift; the minus ones last."""
    value = query if -(1 << 62) <= int(query.min()) and int(query.max()) < 1 << 62 else query.astype(object)  # whole numbers of any size
    half = value >> 1
    more = value + half
    shifts = np.arange(max(int(x).bit_length() for x in (more.min(), more.max())) + 1)[:, None]
    plus, minus = (np.nonzero(((bits >> shifts) & 1).astype(bool)) for bits in (more & ~half, half & ~more))
    return np.arange(len(plus[0]) + len(minus[0])) >= len(plus[0]), *(np.concatenate(x) for x in zip(plus, minus))


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def block_rows(limit: int, dim: int) -> int:
    """How many rows of ``dim`` numbers a block holds."""
    return max(1, min(limit, BLOCK_NUMBERS // dim))


def _packed(limit: int, sliced: bool):
    """Packs a partition's rows, as they come, to blocks of at most ``limit`` rows of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows: dict[int, int] = {}

        def made(dim: int) -> pa.RecordBatch:
            nonlocal number
            parts = waiting.pop(dim)
            ids = np.concatenate([p[0] for p in parts])
            values = np.concatenate([p[1] for p in parts])
            parts.clear()
            data = Slices.of(ids, values).to_bytes() if sliced else ids.tobytes() + values.tobytes()
            columns = [pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([rows.pop(dim)], pa.int64()), pa.array([data], pa.binary())]
            number += 1
            return pa.RecordBatch.from_arrays(columns, ["block", "dim", "n", "data"])

        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(dims, dtype=np.int64)
            for dim in np.unique(dims).tolist():
                mine, most = np.flatnonzero(dims == dim), block_rows(limit, dim)
                for lo in range(0, len(mine), most):
                    part = mine[lo : lo + most]
                    if rows.get(dim, 0) + len(part) > most:
                        yield made(dim)
                    values = flat[(ends[part] - dim)[:, None] + np.arange(dim)].astype(np.int64, copy=False)
                    waiting.setdefault(dim, []).append((ids[part], values))
                    rows[dim] = rows.get(dim, 0) + len(part)
            while sum(dim * n for dim, n in rows.items()) > 2 * BLOCK_NUMBERS:  # many dimensions
                yield made(max(rows, key=lambda dim: dim * rows[dim]))
        for dim in list(waiting):
            yield made(dim)
        give_back()

    return pack


BLOCK = "block long, dim int, n long, data binary"


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The bit-sliced index (block, dim, n, data), written; rows stay in the partition that read them."""
    bound_batches(vectors.sparkSession)
    return materialise(quantised(vectors, vec_id, vector).mapInArrow(_packed(ROWS_PER_BLOCK, True), BLOCK))


def dealt(blocks: DataFrame) -> tuple[int, int, Column]:
    """How many blocks there are, how many numbers they hold, and an expression that numbers them so that a remainder deals them out evenly."""
    top = F.shiftright("block", 32)
    n, numbers, makers = blocks.agg(F.count("block"), F.sum(F.col("n") * F.col("dim")), F.max(top)).head()
    return n, numbers or 0, top + F.col("block").bitwiseAND((1 << 32) - 1) * F.lit((makers or 0) + 1)


def search(index: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``index`` (written)."""
    bound_batches(queries.sparkSession)
    asked = quantised(queries, vec_id, vector).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q"))
    asked = materialise(asked.select("vec_id", "q.dim", "q.v").mapInArrow(_packed(QUERIES_PER_BLOCK, False), BLOCK))
    # Rows are dealt to slots and queries to parts. A cell is a slot and a part, so rows are repeated per part and queries per slot.
    n_rows, row_numbers, row_at = dealt(index)
    n_asked, asked_numbers, asked_at = dealt(asked)
    wanted = 4 * index.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n_asked, math.ceil(asked_numbers / HELD_NUMBERS)))
    slots = max(1, min(n_rows, max(4 * parts, math.ceil(wanted / parts), math.ceil(row_numbers / MET_NUMBERS))))
    parts = max(parts, min(n_asked, math.ceil(wanted / slots)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.select(every(parts).alias("part"), F.pmod(row_at, F.lit(slots)).alias("slot"), F.lit(1).alias("kind"), "dim", "n", "data")
    asked = asked.select(F.pmod(asked_at, F.lit(parts)).alias("part"), every(slots).alias("slot"), F.lit(0).alias("kind"), "dim", "n", "data")
    cell = (F.col("slot") * parts + F.col("part")).cast("int").alias("cell")
    met = asked.unionByName(rows).select(cell, "kind", "dim", "n", "data").repartitionById(slots * parts, "cell")
    near = met.sortWithinPartitions("cell", "kind").mapInArrow(_answered(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _answered(k: int):
    """The k best rows of each query of a cell; a cell's blocks of queries (kind 0) come before its blocks of rows."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        asked: dict[int, list[tuple[int, np.ndarray]]] = {}
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for dim, found in best.items():
                ids, sizes = [i for i, _ in asked[dim]], [len(f[0]) for f in found]
                columns = [np.repeat(ids, sizes), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                cell, kind, dim, n = (batch.column(c)[r].as_py() for c in range(4))
                if cell != last:
                    yield from told()
                    last, asked, best = cell, {}, {}
                data = batch.column(4)[r].as_buffer()
                if not kind:
                    vectors = np.frombuffer(data, np.int64, n * dim, 8 * n).reshape(n, dim).copy()
                    asked.setdefault(dim, []).extend(zip(np.frombuffer(data, np.int64, n).tolist(), vectors))
                elif dim in asked:
                    held = Slices.from_bytes(data)
                    found = [held.best(i, v, k) for i, v in asked[dim]]
                    best[dim] = [merged(*f, k) for f in zip(best[dim], found)] if dim in best else found
        yield from told()
        give_back()

    return answer


def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of ids and scores, ties to smaller ids."""
    ids, scores = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]
