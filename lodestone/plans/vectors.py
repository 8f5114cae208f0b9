"""Queries over vectors: scans, distances, exact search and its scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.vectors import l2sq, normalized
from lodestone.operators import knn, pivots
from lodestone.registry import query
from lodestone.sources.tables import SQL_VECTORS, base_vectors, query_vectors, sql_dot, sql_l2, vectors
from lodestone.sources.vecs import decode_column, encode_rows

K = 10
HALF = 32  # leading dimensions of the deliberately degraded list


@query("scan_vectors", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def scan_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("vector_count", "SELECT count(*) AS n FROM embeddings")
def vector_count(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("prefix_subset", "SELECT vec_id FROM embeddings WHERE vec_id < 100")
def prefix_subset(spark, sf_dir, n: int = 100):
    """The first n vectors: the prefix itself is the operator."""
    return vectors(spark, sf_dir).where(F.col("vec_id") < n).select("vec_id")


@query(
    "dataset_meta",
    """SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dim, CAST(count(*) * max(len(embedding)) * 4 AS BIGINT) AS raw_bytes,
round(count(*) * max(len(embedding)) * 4 / 1048576.0, 6) AS raw_mib FROM embeddings""",
)
def dataset_meta(spark, sf_dir):
    size = F.max(F.size("embedding")).cast("long")
    raw = F.count(F.lit(1)) * size * 4
    return vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), size.alias("dim"), raw.alias("raw_bytes"), F.round(raw / 1048576.0, 6).alias("raw_mib"))


@query(
    "fvecs_roundtrip",
    "SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS val FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding)",
)
def fvecs_roundtrip(spark, sf_dir):
    """Every vector through the bytes of an fvecs row and back."""
    found = decode_column(encode_rows(vectors(spark, sf_dir), "vec_id", "embedding"), "key", "raw")
    return found.select(F.col("path").cast("long").alias("vec_id"), F.posexplode("value").alias("pos", "val")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("val").cast("double"), 6).alias("val"))


@query("l2_distance_pairs", f"SELECT a.vec_id, b.vec_id AS other_id, round({sql_l2('a.embedding', 'b.embedding')}, 6) AS d2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l2_distance_pairs(spark, sf_dir):
    """Distance of each vector to the next by id: a pair for every row."""
    a = vectors(spark, sf_dir).select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", "other_id", F.round(l2sq("embedding", "other"), 6).alias("d2"))


@query(
    "l2_normalize",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 3)) AS e FROM embeddings
  UNION ALL SELECT -1, list_transform(range(64), lambda x: CAST(0 AS DOUBLE))),
s AS (SELECT vec_id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) AS n FROM v)
SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(e[i] / n, 6) + 0.0 AS val FROM s, range(1, 65) r(i) WHERE i <= len(e)""",
)
def l2_normalize(spark, sf_dir):
    """Unit vectors of scaled embeddings and of a zero vector, which the floor keeps at zero."""
    scaled = vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("e"))
    zero = spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), F.array_repeat(F.lit(0.0), 64).alias("e"))
    unit = scaled.union(zero).select("vec_id", F.posexplode(normalized("e")).alias("pos", "val"))
    return unit.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("val", 6) + 0.0).alias("val"))


SQL_TOPK = f"""d AS (SELECT qid, vec_id, round({sql_l2("embedding", "qvec")}, 6) AS d2 FROM base_v CROSS JOIN query_v),
exact AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank, vec_id, d2 FROM d) WHERE rank <= {K})"""


@query("knn_exact_topk", f"WITH {SQL_VECTORS}, {SQL_TOPK} SELECT qid, rank, vec_id, d2 FROM exact")
def knn_exact_topk(spark, sf_dir):
    return knn.exact_topk(spark, base_vectors(spark, sf_dir), query_vectors(spark, sf_dir), K)


@query("knn_pivot_topk", f"WITH {SQL_VECTORS}, {SQL_TOPK} SELECT qid, rank, vec_id, d2 FROM exact")
def knn_pivot_topk(spark, sf_dir):
    """The same rows with the distances that the triangle inequality leaves."""
    return pivots.PivotIndex.fit(spark, base_vectors(spark, sf_dir)).search(spark, query_vectors(spark, sf_dir), K)[0]


@query(
    "cosine_equiv_topk",
    f"""WITH {SQL_VECTORS}, c AS (SELECT qid, vec_id, round(1 - {sql_dot("embedding", "qvec")}, 6) AS far FROM base_v CROSS JOIN query_v)
SELECT qid, rank, vec_id, round(1 - far, 6) AS cosine FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY far, vec_id) AS rank, vec_id, far FROM c) WHERE rank <= {K}""",
)
def cosine_equiv_topk(spark, sf_dir):
    """On unit vectors the squared distance is twice one minus the cosine. All rows are ranked by the rounded cosine itself."""
    near = knn.exact_topk(spark, base_vectors(spark, sf_dir), query_vectors(spark, sf_dir), K, cosine=True)
    return near.select("qid", "rank", "vec_id", F.round(1 - F.col("d2"), 6).alias("cosine"))


def _lists(spark, sf_dir):
    base, queries = base_vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    return knn.exact_topk(spark, base, queries, K), knn.exact_topk(spark, base, queries, K, dims=HALF), queries


SQL_DEGRADED = f"""h AS (SELECT qid, vec_id, round({sql_l2(f"embedding[1:{HALF}]", f"qvec[1:{HALF}]")}, 6) AS d2 FROM base_v CROSS JOIN query_v),
rough AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank, vec_id, d2 FROM h) WHERE rank <= {K})"""
SQL_LISTS = f"WITH {SQL_VECTORS}, {SQL_TOPK}, {SQL_DEGRADED}"


@query(
    "recall_at_k",
    f"""{SQL_LISTS} SELECT q.qid, round(coalesce(c.hits, 0) / {K}.0, 6) AS recall FROM query_v q LEFT JOIN
(SELECT r.qid, count(*) AS hits FROM rough r JOIN exact e ON r.qid = e.qid AND r.vec_id = e.vec_id GROUP BY r.qid) c ON c.qid = q.qid""",
)
def recall_at_k(spark, sf_dir):
    truth, found, queries = _lists(spark, sf_dir)
    return knn.recall(found, truth, K, queries)


@query(
    "recall_pair",
    f"""{SQL_LISTS} SELECT round((SELECT count(*) FROM rough r JOIN exact e ON r.qid = e.qid AND r.vec_id = e.vec_id WHERE r.rank = 1 AND e.rank = 1) / CAST(count(*) AS DOUBLE), 6) AS r1,
round((SELECT count(*) FROM rough r JOIN exact e ON r.qid = e.qid AND r.vec_id = e.vec_id) / (count(*) * {K}.0), 6) AS r10 FROM query_v""",
)
def recall_pair(spark, sf_dir):
    truth, found, queries = _lists(spark, sf_dir)
    means = [knn.recall(found, truth, k, queries).agg(F.round(F.avg("recall"), 6).alias(name)) for k, name in ((1, "r1"), (K, "r10"))]
    return means[0].crossJoin(means[1])  # a row each


@query("gt_agreement", f"{SQL_LISTS} SELECT round(avg(CASE WHEN r.vec_id = e.vec_id THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM rough r JOIN exact e ON r.qid = e.qid WHERE r.rank = 1 AND e.rank = 1")
def gt_agreement(spark, sf_dir):
    truth, found, _ = _lists(spark, sf_dir)
    return knn.agreement(found, truth)


@query(
    "medoid",
    f"""WITH {SQL_VECTORS}, m AS (SELECT i, CAST(avg(CAST(embedding[i] AS DOUBLE)) AS FLOAT) AS m FROM base_v, range(1, 65) r(i) GROUP BY i),
c AS (SELECT list(m ORDER BY i) AS centre FROM m)
SELECT vec_id, round({sql_l2("embedding", "centre")}, 6) AS d2 FROM base_v CROSS JOIN c ORDER BY d2, vec_id LIMIT 1""",
)
def medoid(spark, sf_dir):
    return knn.medoid(base_vectors(spark, sf_dir))
