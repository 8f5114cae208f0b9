"""Hard negatives of anchor vectors: rows of another label whose score lies just below a positive's.

Vectors are of whole numbers and a score is an inner product, so everything is exact: products of blocks are taken in float64 while
their bound lies below 2^53, in 64-bit integers beyond, and a bound beyond 2^63 is an error. The rows are read twice. In the first pass
each task keeps its best positives of every anchor, and the tasks' lists are merged. In the second the anchors come with a window of scores for each of
their positives, and each task keeps its best rows of another label in each window. Anchors go to the tasks in blocks of
bounded bytes, fetched partition by partition; a task holds scores in tiles, and k rows for each anchor or window of a block.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part, nor as anchors. Ties go to the
smaller id. Of rows with one id the one with the smallest label, then vector, takes part. Vectors of unequal length are compared as
if the shorter ended in zeros. An anchor without a positive, and a positive with no row in its window, has no rows;
a negative positive score leaves its window empty, as 80 hundredths of it are more than itself. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.base import materialize, spread, table

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least and at most so many hundredths of the positive's.
LEAST, MOST = 80, 100
#: Components are taken in steps of one over this.
STEPS = 256
#: Bytes of anchors that are broadcast at once, and rows and anchors of the scores that a task holds at once, 16 MB.
BLOCK_BYTES = 16 << 20
TILE_ROWS, TILE_ANCHORS = 2048, 1024
#: In place of a score turned round where there is none, and of an id.
FAR, NONE = np.iinfo(np.int64).max, -1

FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding -> vec_id, label, vector of whole numbers, of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * STEPS)).alias("vector"))


def one_each(rows: DataFrame) -> DataFrame:
    """One row for each id; only ids are shuffled where none repeats."""
    if rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def matrix(lists: list | pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, the shorter filled with zeros."""
    lists = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.int64()))
    flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    width = int(lengths.max()) if len(lengths) else 0
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(width) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if bound < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2.0**63:
        return a @ b.T
    raise ArithmeticError("a score may be beyond a long")


class Best:
    """The k best scores and their ids of each of n lists, by score, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.turned, self.ids = k, np.full((n, k), FAR), np.full((n, k), NONE, np.int64)

    def add(self, lists: slice, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """scores (lists, rows) and whether they count, with the rows' ids."""
        held, held_ids = self.turned[lists], self.ids[lists]
        turned = np.where(valid, -scores, FAR)
        edge = held[:, -1:]
        if turned.shape[1] > self.k:
            edge = np.minimum(edge, np.partition(turned, self.k - 1, axis=1)[:, self.k - 1 : self.k])
        row, col = np.nonzero(valid & (turned <= edge))
        if not len(row):
            return
        rows = np.concatenate([np.repeat(np.arange(len(held)), self.k), row])
        all_turned, all_ids = np.concatenate([held.ravel(), turned[row, col]]), np.concatenate([held_ids.ravel(), ids[col]])
        order = np.lexsort((all_ids, all_turned, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        held[rows[kept], place[kept]], held_ids[rows[kept], place[kept]] = all_turned[order][kept], all_ids[order][kept]


def _tiles(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, scores, ids, labels) of every tile of a task's rows against a block of anchors."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(start, TILE_ROWS)
            ids, labels, x = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2))
            for at in range(0, len(vectors), TILE_ANCHORS):
                rows = slice(at, at + TILE_ANCHORS)
                yield rows, products(vectors[rows], x), ids, labels


def _positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, of, vectors = shared.value[:3]
        best = Best(len(anchors), k)
        for rows, scores, ids, labels in _tiles(batches, vectors):
            best.add(rows, scores, (labels == of[rows, None]) & (ids != anchors[rows, None]), ids)
        row, place = np.nonzero(best.turned != FAR)
        yield pa.RecordBatch.from_arrays([pa.array(anchors[row]), pa.array(best.ids[row, place]), pa.array(-best.turned[row, place])], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(shared, k: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, of, vectors, positives, scores_of, there = shared.value
        # In hundredths of the positive's score, rounded into the window.
        low, high = -(-least * scores_of // 100), most * scores_of // 100
        bests = [Best(len(anchors), k) for _ in range(positives.shape[1])]
        for rows, scores, ids, labels in _tiles(batches, vectors):
            other = labels != of[rows, None]
            for j, best in enumerate(bests):
                best.add(rows, scores, other & there[rows, j, None] & (scores >= low[rows, j, None]) & (scores <= high[rows, j, None]), ids)
        for j, best in enumerate(bests):
            row, place = np.nonzero(best.turned != FAR)
            columns = [anchors[row], positives[row, j], scores_of[row, j], best.ids[row, place], -best.turned[row, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def blocks(anchors: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors (vec_id, label, vector, positives) in blocks of bounded size: ids, labels, vectors, positives' ids, their scores, and
    which of them there are."""
    rows, held = [], 0

    def block() -> tuple[np.ndarray, ...]:
        width = max((len(r[3]) for r in rows), default=0)
        positives, scores, there = np.full((len(rows), width), NONE, np.int64), np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), bool)
        for k, r in enumerate(rows):
            for j, p in enumerate(r[3]):
                positives[k, j], scores[k, j], there[k, j] = p[0], p[1], True
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), matrix([r[2] for r in rows]), positives, scores, there

    for row in anchors.toLocalIterator():
        rows.append(row)
        held += 8 * len(row[2])
        if held >= most_bytes:
            yield block()
            rows, held = [], 0
    if rows:
        yield block()


def _passes(spark: SparkSession, rows: DataFrame, anchors: DataFrame, work, schema: str, most_bytes: int) -> DataFrame:
    out = None
    for block in blocks(anchors, most_bytes):
        part = rows.select("vec_id", "label", "vector").mapInArrow(work(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def mine(spark: SparkSession, rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows (vec_id, label, vector of whole numbers), anchor: whether a row is an anchor -> anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score: for each of an anchor's best positives, its best negatives within the window."""
    rows = one_each(rows)
    none = F.array().cast("array<struct<positive_id:bigint,positive_score:bigint>>")
    asked = rows.where(anchor).select("vec_id", "label", "vector", none.alias("positives"))
    found = _passes(spark, rows, asked, lambda shared: _positives(shared, positives), "anchor_id long, positive_id long, positive_score long", most_bytes)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = first.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # at most `positives` each
    windows = materialize(spark, rows.where(anchor).join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "vector", "positives"), "anchors")
    found = _passes(spark, rows, windows, lambda shared: _negatives(shared, negatives, least, most), FOUND, most_bytes)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spread(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))
    turned = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(spark, turned, F.col("vec_id") % 100 == 0)


OP12_SQL = """WITH q AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS k FROM q) WHERE k = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
