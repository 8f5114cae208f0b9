"""Exact nearest neighbours: query blocks of bounded size against every base row, partial top-k in each task, then one merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import l2sq
from lodestone.sources.tables import BROADCAST_BYTES

DIGITS = 6
FOUND = "qid long, vec_id long, d2 double"
#: Rows and queries of the distances that a task holds at once, 16 MB of doubles.
TILE_ROWS, TILE_QUERIES = 2048, 1024


def query_blocks(queries: DataFrame, most_bytes: int = BROADCAST_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of (qid, qvec) rows in blocks of bounded size."""
    ids, rows, held = [], [], 0
    for row in queries.select("qid", "qvec").toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        held += 8 * len(row[1])
        if held >= most_bytes:
            yield np.array(ids, np.int64), np.array(rows, float)
            ids, rows, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(rows, float)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def best_of(best: tuple[np.ndarray, np.ndarray], d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest by (distance, id) of each row's best so far and of new columns d (queries, rows) with their ids. What is
    beyond the k-th distance goes before anything is sorted; ties at it stay until the ids settle them."""
    n = len(d)
    if d.shape[1] > k:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        keep = d <= edge
        width = int(keep.sum(axis=1).max())
        if width < d.shape[1]:
            # Kept columns to the left, in their order; rows with fewer get columns beyond the edge, which lose below.
            order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            d, ids = np.take_along_axis(d, order, 1), ids[order]
    all_d = np.hstack([best[0], d])
    all_ids = np.hstack([best[1], ids if ids.ndim == 2 else np.broadcast_to(ids, (n, len(ids)))])
    order = np.lexsort((all_ids, all_d), axis=1)[:, :k]
    return np.take_along_axis(all_d, order, 1), np.take_along_axis(all_ids, order, 1)


def _nearest(shared, k: int, dims: int | None, cosine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        q = q[:, :dims]
        squares = (q * q).sum(axis=1)
        best = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(start, TILE_ROWS)
                own, x = part.column(0).to_numpy(), matrix(part.column(1))[:, :dims]
                norms = (x * x).sum(axis=1)
                tiles = []
                for at in range(0, len(ids), TILE_QUERIES):
                    rows = slice(at, at + TILE_QUERIES)
                    products = q[rows] @ x.T
                    d = np.round(1 - products if cosine else np.maximum(squares[rows, None] - 2 * products + norms[None, :], 0), DIGITS)
                    tiles.append(best_of((best[0][rows], best[1][rows]), d, own, k))
                best = np.vstack([t[0] for t in tiles]), np.vstack([t[1] for t in tiles])
        if best[0].shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best[0].shape[1])), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["qid", "vec_id", "d2"])

    return run


def ranked(found: DataFrame, k: int, key: str = "qid", id_: str = "vec_id", distance: str = "d2") -> DataFrame:
    """The k nearest of each query, ranked from 1 by (distance, id)."""
    order = Window.partitionBy(key).orderBy(distance, id_)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def exact_topk(spark: SparkSession, base: DataFrame, queries: DataFrame, k: int = 10, dims: int | None = None, cosine: bool = False) -> DataFrame:
    """base (vec_id, embedding), queries (qid, qvec) -> qid, rank, vec_id, d2. Rows between the stages are k for each query and task.

    With cosine, d2 is one minus the product of the vectors. A task holds a block of queries with their k best, and distances
    in tiles of bounded size."""
    out = None
    for block in query_blocks(queries):
        part = base.select("vec_id", "embedding").mapInArrow(_nearest(spark.sparkContext.broadcast(block), k, dims, cosine), FOUND)
        out = part if out is None else out.union(part)
    out = out if out is not None else spark.createDataFrame([], FOUND)
    return ranked(out, k).select("qid", "rank", "vec_id", "d2")


def exact_topk_expr(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same rows by column expressions alone; for small query sets and as a cross-check."""
    pairs = base.select("vec_id", "embedding").crossJoin(queries).select("qid", "vec_id", F.round(l2sq("embedding", "qvec"), DIGITS).alias("d2"))
    return ranked(pairs, k).select("qid", "rank", "vec_id", "d2")


def medoid(vectors: DataFrame) -> DataFrame:
    """The vector nearest the mean of all: vec_id, d2; ties go to the lowest id."""
    mean = vectors.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"].cast("float")).alias("centre"))  # one row
    scored = vectors.crossJoin(F.broadcast(centre)).select("vec_id", F.round(l2sq("embedding", "centre"), DIGITS).alias("d2"))
    return scored.agg(F.min(F.struct("d2", "vec_id")).alias("m")).select("m.vec_id", "m.d2").where("vec_id is not null")


def recall(found: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """k-recall@k for each query: shared ids in the first k of both lists over k, whatever the lists hold."""
    hits = found.where(F.col("rank") <= k).select("qid", "vec_id").join(truth.where(F.col("rank") <= k).select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    every = truth.select("qid").distinct() if queries is None else queries.select("qid").distinct()
    return every.join(hits, "qid", "left").select("qid", F.round(F.coalesce("hits", F.lit(0)) / F.lit(k), DIGITS).alias("recall"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of queries whose first neighbour is the same in both lists."""
    first = a.where("rank = 1").select("qid", F.col("vec_id").alias("x")).join(b.where("rank = 1").select("qid", F.col("vec_id").alias("y")), "qid")
    return first.agg(F.round(F.avg((F.col("x") == F.col("y")).cast("double")), DIGITS).alias("agreement"))
