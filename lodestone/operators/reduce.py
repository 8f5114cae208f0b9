"""Principal components: the covariance is summed on the cluster, its decomposition is as small as the dimensions are few."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.knn import matrix
from lodestone.operators.pq import sample


class Components(NamedTuple):
    mean: np.ndarray
    components: np.ndarray  # one row for each
    ratios: np.ndarray  # shares of the variance
    total: float = 0.0  # the variance of all dimensions together


def fit(vectors: DataFrame, n: int, sample_rows: int | None = 200_000, seed: int = 0) -> Components:
    """The n leading components of a uniform sample (of all rows where sample_rows is None)."""
    rows = vectors if sample_rows is None else sample(vectors, sample_rows, seed)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
                count += len(x)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    got = rows.select("embedding").mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()  # (dims + 1)^2 rows
    size = int(got.column("i").to_numpy().max()) + 1
    total = np.zeros((size, size))
    total[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("s").to_numpy()
    count, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    values, found = np.linalg.eigh((total[:-1, :-1] - count * np.outer(mean, mean)) / max(1, count - 1))
    order = np.argsort(-values)
    return Components(mean, found[:, order[:n]].T, values[order[:n]] / max(values.sum(), 1e-300), float(values.sum()))


def projected(embedding: Column | str, mean: np.ndarray, components: np.ndarray) -> Column:
    """(x - mean) times each component, as one expression over an array column."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    centred = F.zip_with(column, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)

    def along(row: np.ndarray) -> Column:
        return F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)

    return F.array(*[along(row) for row in components])


def project(vectors: DataFrame, model: Components, normalize: bool = True, key: str = "vec_id") -> DataFrame:
    """Vectors in the components' space, as floats, of unit norm where asked for; the matrices are a few kilobytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (matrix(batch.column(1)) - model.mean) @ model.components.T if batch.num_rows else np.zeros((0, 0))
            if normalize and len(y):
                y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y.astype(np.float32)), pa.list_(pa.float32()))], names=["key", "embedding"])

    return vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(run, "key long, embedding array<float>").withColumnRenamed("key", key)
