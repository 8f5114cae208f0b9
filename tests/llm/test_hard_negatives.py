import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows):
    """The contract row by row, in Python's whole numbers."""
    kept = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v])
        kept[vec_id] = min(kept.get(vec_id, r), r)
    out = set()
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, (other, w) in kept.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [(n, b) for n, b, other in scored if other != label and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out |= {(a, p, k, b, -s, -n) for k, (n, b) in enumerate(near, 1)}
    return out


def result(df):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want = brute_force(rows)
        assert len(want) > 50 and result(h.op12_query(spark, sf)) == want


def odd_vectors():
    """Many ties, repeated ids, vectors of unequal length and such as take no part."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)], rng.randrange(3)) for k in range(400)]
    rows += [(k, [0.5, 0.5, 0.5, 0.5], 1) for k in range(400, 700)]
    rows += [(100, [0.25, 0.5], 2), (100, [0.25, 0.5], 2), (7, [0.5] * 6, 0), (800, [], 1), (900, [0.5], None), (901, None, 1), (None, [0.5], 1)]
    rows += [(1000, [float("nan"), 0.5], 1), (1001, [float("inf")], 1), (1002, [None, 0.5], 1), (-100, [0.5, 0.25, -0.5, 0.5], 1), (-7, [0.5] * 4, 9)]
    return rows


def test_odd_rows(spark, folder):
    rows = odd_vectors()
    table = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(n).alias(n) for n in ("vector", "rank", "positives", "anchor_id", "n")]).repartition(5)
    sf = folder(embeddings=table)
    want = brute_force(rows)
    assert len(want) > 50 and result(h.op12_query(spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    found = con.execute(h.OP12_SQL)
    assert {tuple(r) for r in found.fetchall()} == want


def test_blocks_and_tiles(spark, folder, monkeypatch):
    """Anchors one to a block and tiles of a few rows give the same."""
    rows = odd_vectors()
    sf = folder(embeddings=spark.createDataFrame(rows, SCHEMA).repartition(3))
    whole = result(h.op12_query(spark, sf))
    monkeypatch.setattr(h, "TILE_ROWS", 7)
    monkeypatch.setattr(h, "TILE_ANCHORS", 2)
    vectors = h.quantised(spark.read.parquet(f"{sf}/embeddings.parquet"))
    turned = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert result(h.mine(spark, turned, F.col("vec_id") % 100 == 0, most_bytes=1)) == whole


def test_empty(spark, folder):
    assert h.op12_query(spark, folder(embeddings=spark.createDataFrame([], SCHEMA))).count() == 0


def test_products():
    rng = np.random.default_rng(4)
    for top in (100, 2**26, 2**29):
        a, b = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (7, 8))
        assert h.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    with pytest.raises(ArithmeticError):
        h.products(np.full((1, 4), 2**40), np.full((1, 4), 2**40))
