"""The rows with the most similar vectors, exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block that are multiplied at once, and candidates that they are multiplied with.
ROWS_AT_ONCE, OTHERS_AT_ONCE = 512, 1_024
#: Numbers of the pairs whose exact scores are taken at once; equal vectors may make all pairs such.
EXACT_AT_ONCE = 1 << 20
#: Far above the rounding of a cosine.
NEAR = 1e-9


def _directed(vector: Column) -> Column:
    """True for vectors that have a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _in_order(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, axis=1)[:, -1].copy()  # a view would hold all sums


class _Cell:
    """A block of asking rows; candidates stream by, and each row keeps its k best."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, vectors.astype(float), k
        self.norms = np.sqrt(_in_order(self.x * self.x))
        self.units = self.x / self.norms[:, None]
        self.limit = np.full(len(ids), -np.inf)  # the k-th score so far
        self.who, self.other, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for j in range(0, len(ids), OTHERS_AT_ONCE):
            self._offer(ids[j : j + OTHERS_AT_ONCE], vectors[j : j + OTHERS_AT_ONCE].astype(float))

    def _offer(self, ids: np.ndarray, y: np.ndarray) -> None:
        norms = np.sqrt(_in_order(y * y))
        units = np.ascontiguousarray((y / norms[:, None]).T)
        for i in range(0, len(self.ids), ROWS_AT_ONCE):
            part = slice(i, i + ROWS_AT_ONCE)
            s = self.units[part] @ units
            s[self.ids[part][:, None] == ids[None, :]] = -np.inf
            least = self.limit[part]
            if s.shape[1] >= self.k and np.isinf(least).any():
                least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
            p, q = np.nonzero(s >= np.maximum(least - NEAR, -2.0)[:, None])
            step = max(1, EXACT_AT_ONCE // y.shape[1])
            exact = [_in_order(self.x[i + p[a : a + step]] * y[q[a : a + step]]) for a in range(0, len(p), step)]
            if exact:
                self._keep(i + p, ids[q], np.concatenate(exact) / (self.norms[i + p] * norms[q]))

    def _keep(self, who: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        """Of the rows ``who`` the k best of those before and these."""
        low, high = np.searchsorted(self.who, [who[0], who[-1] + 1])  # rows are in order on both sides
        who, other, score = (np.concatenate(x) for x in ((self.who[low:high], who), (self.other[low:high], other), (self.score[low:high], score)))
        order = np.lexsort((other, -score, who))
        who, other, score = who[order], other[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        self.limit[who[rank == self.k - 1]] = score[rank == self.k - 1]
        put = lambda old, new: np.concatenate((old[:low], new[keep], old[high:]))
        self.who, self.other, self.score = put(self.who, who), put(self.other, other), put(self.score, score)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.who]), pa.array(self.other), pa.array(self.score)], names=["id", "other", "score"])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None  # of a cell the asking rows come first
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_size", "_i", "_j", "_asked")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if b == a:
                    continue
                here = tuple(keys[a, :3].tolist())
                if here != key:
                    if cell is not None:
                        yield cell.batch()
                    key, held, cell = here, [], None
                part = batch.slice(a, b - a)
                ids, vectors = part.column("_id").to_numpy(), part.column("_v").flatten().to_numpy().reshape(b - a, here[0])
                if not keys[a, 3]:
                    held.append((ids, vectors))
                    continue
                if cell is None:
                    if not held:
                        continue
                    cell = _Cell(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                    held = []
                cell.offer(ids, vectors)
        if cell is not None:
            yield cell.batch()

    return search


def cosine_top(vectors: DataFrame, k: int = 3, *, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4_096, lanes: int = 8) -> DataFrame:
    """``id, rank, other, score``: of every row the ``k`` others with the largest cosine, ties to the smaller id.

    Asking rows are dealt to blocks of about ``block_rows``, candidates to ``lanes``; a cell holds one block and lets one lane's candidates stream by, keeping
    k of each row. A candidate is shuffled once per block, an asking row once per lane, and lanes x k rows of each are merged. Exact search compares all with
    all: for vectors beyond some millions use an index. Vectors that are null, empty, zero or hold null or non-finite numbers take no part; vectors of another length
    are not compared, nor are rows with the same id. Rows that share an id share its k places.
    """
    good = vectors.where(F.col(id_col).isNotNull() & _directed(F.col(vector_col)))
    good = good.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.monotonically_increasing_id().alias("_at")).checkpoint()
    blocks = max(1, -(-good.count() // block_rows))
    block = F.pmod(F.xxhash64("_at"), F.lit(blocks)).cast("int")
    lane = F.pmod(F.xxhash64("_at", F.lit(1)), F.lit(lanes)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("_v").alias("_size")
    asks = good.select(size, block.alias("_i"), every(lanes).alias("_j"), F.lit(0).alias("_asked"), "_id", "_v")
    others = good.select(size, every(blocks).alias("_i"), lane.alias("_j"), F.lit(1).alias("_asked"), "_id", "_v")
    cells = asks.unionByName(others).repartition(max(lanes, min(4 * blocks * lanes, 8_192)), "_size", "_i", "_j")
    found = cells.sortWithinPartitions("_size", "_i", "_j", "_asked").mapInArrow(_search(k), "id long, other long, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "other", "score")
