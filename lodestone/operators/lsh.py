"""Approximate neighbours by buckets of random projections.

A row's key in a table is the signs of its projections on that table's planes; its candidates for a query are the rows that share a key
in some table. Blocks of queries go to the rows, as in exact search: keys are compared within a task and k rows a query leave it,
so a full bucket costs no shuffle. A query with fewer than k candidates is searched exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.knn import DIGITS, FOUND, exact_topk, matrix, query_blocks, ranked
from lodestone.sources.tables import written

#: At 64 dimensions without clusters, true neighbours are hardly nearer than other rows, and fewer tables or longer keys miss them.
TABLES, BITS = 40, 5
#: Rows compared with a block of queries at once.
ROWS = 1024


def keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(tables, rows): the signs of the projections on each table's planes, as a number."""
    bits = np.einsum("nd,tbd->tnb", x, planes, optimize=True) > 0
    return (bits * (1 << np.arange(planes.shape[1]))).sum(axis=2)


def _nearest(shared, k: int, tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        planes = np.random.default_rng(seed).normal(size=(tables, bits, q.shape[1]))
        asked = keys(q, planes)
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own, x = part.column(0).to_numpy(), matrix(part.column(1))
                held = keys(x, planes)
                for i in range(len(ids)):
                    near = np.flatnonzero((held == asked[:, i, None]).any(axis=0))
                    d = np.round(((x[near] - q[i]) ** 2).sum(axis=1), DIGITS)
                    order = np.lexsort((own[near], d))[:k]
                    best[i] = sorted(best[i] + list(zip(d[order].tolist(), own[near[order]].tolist(), strict=True)))[:k]
        found = [(int(ids[i]), v, d) for i in range(len(ids)) for d, v in best[i]]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["qid", "vec_id", "d2"])

    return run


def topk(spark: SparkSession, base: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, bits: int = BITS, seed: int = 7) -> DataFrame:
    """base (vec_id, embedding), queries (qid, qvec) -> qid, rank, vec_id, d2."""
    out = None
    for block in query_blocks(queries):
        part = base.select("vec_id", "embedding").mapInArrow(_nearest(spark.sparkContext.broadcast(block), k, tables, bits, seed), FOUND)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "qid long, rank long, vec_id long, d2 double")
    found = written(spark, ranked(out, k).select("qid", "rank", "vec_id", "d2"), "lsh")
    short = queries.join(found.where(f"rank = {k}").select("qid"), "qid", "left_anti")
    return found.join(short.select("qid"), "qid", "left_anti").select("qid", "rank", "vec_id", "d2").union(exact_topk(spark, base, short, k))
