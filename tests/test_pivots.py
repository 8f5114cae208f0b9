"""Exact search by pivots: the same rows as scoring everything, with fewer distances."""

import numpy as np
import pytest

from lodestone.operators import knn, pivots


def frame(spark, x):
    return spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>").repartition(4)


def rows(df):
    return [tuple(r) for r in df.orderBy("qid", "rank").collect()]


def clustered(n=3000, scale=1.0):
    rng = np.random.default_rng(1)
    centres, turn = rng.normal(size=(40, 8)) * 12, rng.normal(size=(8, 24))
    return ((centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 8))) @ turn + 0.1 * rng.normal(size=(n, 24))) * scale


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_less_than_half_on_clusters(spark, scale):
    base = frame(spark, clustered(scale=scale))
    queries = base.where("vec_id % 90 = 0").selectExpr("vec_id AS qid", "embedding AS qvec")
    found, counted = pivots.PivotIndex.fit(spark, base, 64).search(spark, queries, 10)
    # Long vectors: the last digits of a distance go with the order of its sum.
    found, want = rows(found), rows(knn.exact_topk(spark, base, queries, 10).select("qid", "rank", "vec_id", "d2"))
    assert [r[:3] for r in found] == [r[:3] for r in want] and np.allclose([r[3] for r in found], [r[3] for r in want], rtol=1e-9, atol=1e-6)
    assert 0 < counted.first().distances < 100 * 3000 / 2


@pytest.mark.parametrize("k", [1, 7, 400])
def test_never_more_than_all(spark, k):
    """Vectors without clusters, repeated vectors that tie, and lists as long as the table."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[7]
    base = frame(spark, x)
    queries = base.where("vec_id % 60 = 0 OR vec_id = 21").selectExpr("vec_id AS qid", "embedding AS qvec")
    found, counted = pivots.PivotIndex.fit(spark, base, 20).search(spark, queries, k)
    assert rows(found) == rows(knn.exact_topk(spark, base, queries, k).select("qid", "rank", "vec_id", "d2"))
    assert counted.first().distances <= 300 * queries.count()


def test_few_rows(spark):
    """Fewer rows than pivots, no rows, no queries."""
    base = frame(spark, np.eye(4))
    queries = base.selectExpr("vec_id AS qid", "embedding AS qvec")
    assert rows(pivots.PivotIndex.fit(spark, base, 64).search(spark, queries, 3)[0]) == rows(knn.exact_topk(spark, base, queries, 3).select("qid", "rank", "vec_id", "d2"))
    assert pivots.PivotIndex.fit(spark, base.where("false")).search(spark, queries, 3)[0].count() == 0
    assert pivots.PivotIndex.fit(spark, base).search(spark, queries.where("false"), 3)[0].count() == 0
