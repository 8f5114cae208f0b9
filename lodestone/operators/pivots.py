"""Exact nearest neighbours without all distances: rows lie by their nearest pivot, and the triangle inequality rules tiles out.

Each vector is written with its nearest pivot and its distance to it, ordered by both, so that a run of rows lies in a ring around a pivot. No
row of a ring from `low` to `high` is nearer to a query at distance x from the pivot than x - high or low - x. A first pass scores each
query against its nearest pivots' rows alone, as many as hold k; the k-th distance there is a bound. The second pass reads what rings
the bounds leave (also as a filter on pivot and distance that the scan can use), and scores a query against a tile only if the tile may hold
something nearer than the k-th so far. Pivots are rows themselves, their distances are known from the start, and no pair is scored twice: never
more than all distances are taken. Ranks, ties and rounding are those of `knn.exact_topk`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.knn import DIGITS, FOUND, TILE_ROWS, best_of, matrix, query_blocks, ranked
from lodestone.operators.pq import sample
from lodestone.sources.tables import written

PIVOTS = 64
#: Squared distances are compared after rounding, so a bound has to lie above by more than that.
SLACK = 2e-6
ROWS = "pivot int, far double, vec_id long, embedding array<float>"
#: The row of a task's count of distances has this id and no query.
COUNT = -1


class PivotIndex:
    """rows (pivot, far, vec_id, embedding), without the pivots; the pivots' ids and vectors, of a number that is a parameter."""

    def __init__(self, rows: DataFrame, ids: np.ndarray, pivots: np.ndarray):
        self.rows, self.ids, self.pivots = rows, ids, pivots

    @classmethod
    def fit(cls, spark: SparkSession, base: DataFrame, pivots: int = PIVOTS, seed: int = 0) -> PivotIndex:
        """base (vec_id, embedding), ids each once."""
        base = base.select("vec_id", "embedding")
        drawn = sorted((r[0], r[1]) for r in sample(base, pivots, seed).collect())  # pivots rows
        ids = np.array([r[0] for r in drawn], np.int64)
        x = np.array([r[1] for r in drawn], float) if drawn else np.zeros((0, 0))
        placed = base.mapInArrow(_placing(ids, x), ROWS)
        return cls(written(spark, placed.repartitionByRange("pivot", "far").sortWithinPartitions("pivot", "far"), "pivots"), ids, x)

    def search(self, spark: SparkSession, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """queries (qid, qvec) -> (qid, rank, vec_id, d2), and one row with the distances that were taken."""
        found = None
        for ids, x in query_blocks(queries) if len(self.ids) else ():
            to_pivots = _squares(x, self.pivots)
            near = np.round(to_pivots, DIGITS)
            best = best_of((np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)), near, self.ids, k)
            sizes = np.zeros(len(self.ids), np.int64)
            for r in self.rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
                sizes[r[0]] = r[1]
            # The nearest pivots of each query that together have k rows.
            order = np.argsort(to_pivots, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            opening = np.zeros(to_pivots.shape, bool)
            np.put_along_axis(opening, order, before < k, 1)
            first = written(spark, self._pass(spark, ids, x, to_pivots, opening, best, k, None), "opening")
            bound = np.full(len(ids), np.inf)
            place = {q: n for n, q in enumerate(ids.tolist())}
            kth = ranked(first.where(f"vec_id <> {COUNT}").unionByName(_frame(spark, ids, best)), k).where(F.col("rank") == k).select("qid", "d2")
            for q, d in kth.collect():  # one row a query of the block
                bound[place[q]] = d
            second = self._pass(spark, ids, x, to_pivots, ~opening, best, k, bound)
            start = first.union(second).union(_frame(spark, ids, best)).union(spark.createDataFrame([(COUNT, COUNT, float(to_pivots.size))], FOUND))
            found = start if found is None else found.union(start)
        found = written(spark, found if found is not None else spark.createDataFrame([], FOUND), "found")
        counted = found.where(f"vec_id = {COUNT}").agg(F.coalesce(F.sum("d2"), F.lit(0.0)).cast("long").alias("distances"))
        return ranked(found.where(f"vec_id <> {COUNT}"), k).select("qid", "rank", "vec_id", "d2"), counted

    def _pass(self, spark: SparkSession, ids: np.ndarray, x: np.ndarray, to_pivots: np.ndarray, asked: np.ndarray, best, k: int, bound: np.ndarray | None) -> DataFrame:
        rows, far = self.rows, np.sqrt(to_pivots)
        bound = np.full(len(ids), np.inf) if bound is None else bound
        # Square roots of differences of squares are off by some 1e-8 of the vectors' lengths, where a row lies at its pivot.
        off = 1e-7 * (1 + max(np.sqrt((x * x).sum(axis=1)).max(initial=0), np.sqrt((self.pivots * self.pivots).sum(axis=1)).max(initial=0)))
        wide = np.sqrt(bound + SLACK)[:, None] + off
        low, high = np.where(asked, far - wide, np.inf).min(axis=0), np.where(asked, far + wide, -np.inf).max(axis=0)
        wanted = F.lit(False)
        for p in np.flatnonzero(asked.any(axis=0)).tolist():
            wanted = wanted | ((F.col("pivot") == p) & F.col("far").between(float(max(low[p], 0.0)), float(min(high[p], 1e300))))
        return rows.where(wanted).mapInArrow(_scoring(spark.sparkContext.broadcast((ids, x, far, asked, bound, off)), k), FOUND)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)


def _frame(spark: SparkSession, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    rows = [(int(q), int(v), float(d)) for q, ds, vs in zip(ids, *best, strict=True) for d, v in zip(ds, vs, strict=True)]
    return spark.createDataFrame(rows, FOUND)


def _placing(ids: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), ids)))
            if batch.num_rows:
                d = _squares(matrix(batch.column(1)), pivots)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(at)), at])), *batch.columns], names=["pivot", "far", "vec_id", "embedding"])

    return run


def _scoring(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, far, asked, bound, off = shared.value
        best = np.full((len(ids), k), np.inf), np.full((len(ids), k), COUNT, np.int64)
        taken = 0
        for batch in batches:
            pivots = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(pivots)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pivots)], strict=True):
                for at in range(start, end, TILE_ROWS):
                    part = batch.slice(at, min(TILE_ROWS, end - at))
                    if not part.num_rows:
                        continue
                    p, ring = int(pivots[at]), part.column(1).to_numpy()
                    least = np.maximum(np.maximum(far[:, p] - ring.max(), ring.min() - far[:, p]) - off, 0)
                    # The k-th of this task so far, or the bound of the first pass.
                    active = np.flatnonzero(asked[:, p] & (least * least * (1 - 1e-12) <= np.minimum(bound, best[0][:, -1]) + SLACK))
                    if len(active):
                        d = np.round(_squares(q[active], matrix(part.column(3))), DIGITS)
                        taken += d.size
                        best[0][active], best[1][active] = best_of((best[0][active], best[1][active]), d, part.column(2).to_numpy(), k)
        row, place = np.nonzero(np.isfinite(best[0]))
        columns = [np.append(ids[row], COUNT), np.append(best[1][row, place], COUNT), np.append(best[0][row, place], float(taken))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "vec_id", "d2"])

    return run
