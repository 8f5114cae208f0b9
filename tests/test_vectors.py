"""Search structures: exactness, invariants and recall on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, knn, pq, reduce, stats
from lodestone.sources import sinks, vecs


@pytest.fixture(scope="module")
def clustered():
    """Clustered points of low intrinsic dimension with noise, and queries from the same distribution."""
    rng = np.random.default_rng(0)
    centres, turn = rng.normal(size=(40, 16)) * 3, rng.normal(size=(16, 32))
    points = (centres[rng.integers(0, 40, 1560)] + rng.normal(size=(1560, 16))) @ turn + rng.normal(size=(1560, 32))
    return points[:1500].astype(np.float32), points[1500:].astype(np.float32)


@pytest.fixture(scope="module")
def tables(spark, clustered):
    x, q = clustered
    base = spark.createDataFrame([(k * 3 + 1, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "qid long, qvec array<float>")
    return base.cache(), queries.cache()


@pytest.fixture(scope="module")
def truth(clustered):
    x, q = clustered
    d = ((q[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(axis=2).round(6)
    return {k: (np.lexsort((np.arange(len(x)), row))[:10] * 3 + 1).tolist() for k, row in enumerate(d)}


def lists(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.vec_id)
    return out


def recall(found, truth):
    return np.mean([len(set(found.get(k, [])) & set(v)) / len(v) for k, v in truth.items()])


def test_exact(spark, tables, truth):
    base, queries = tables
    assert lists(knn.exact_topk(spark, base, queries)) == truth
    assert lists(knn.exact_topk_expr(base, queries.where("qid < 5"))) == {k: truth[k] for k in range(5)}


def test_query_blocks(tables, monkeypatch, spark, truth):
    base, queries = tables
    assert len(list(knn.query_blocks(queries, 8 * 32 * 7))) == 9
    monkeypatch.setattr(knn, "query_blocks", lambda q, f=knn.query_blocks: f(q, 8 * 32 * 25))
    assert lists(knn.exact_topk(spark, base, queries)) == truth
    assert knn.exact_topk(spark, base, queries.where("false")).count() == 0
    assert knn.exact_topk(spark, base.where("false"), queries).count() == 0


def test_tiles(spark, tables, truth, monkeypatch):
    """Tiles of any size give the same rows; many equal distances are settled by id."""
    base, queries = tables
    rng = np.random.default_rng(3)
    for rows, k in ((5, 10), (10, 10), (200, 3)):
        d, ids = rng.integers(0, 4, (7, rows)).astype(float), rng.permutation(1000)[:rows]
        best = knn.best_of((np.zeros((7, 0)), np.zeros((7, 0), np.int64)), d, ids, k)
        for at in range(7):
            order = np.lexsort((ids, d[at]))[:k]
            assert best[0][at].tolist() == d[at][order].tolist() and best[1][at].tolist() == ids[order].tolist()


def test_many_queries_in_bounded_memory():
    """A block of 50,000 queries against a batch of 10,000 rows: what the task holds is the block, its best and one tile."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(4)
    queries, rows = rng.normal(size=(50_000, 8)), rng.normal(size=(4096, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    shared = SimpleNamespace(value=(np.arange(len(queries)), queries))
    tracemalloc.start()
    found = next(knn._nearest(shared, 3, None, False)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 150_000 and peak < 200 << 20  # all distances at once would be 1,600 MB
    first = ((rows.astype(float) - queries[0]) ** 2).sum(axis=1).round(6)
    assert found.column(1).to_pylist()[:3] == np.lexsort((np.arange(len(rows)), first))[:3].tolist()


@pytest.mark.parametrize("shard_rows", [100_000, 400])
def test_graph(spark, tables, truth, shard_rows):
    base, queries = tables
    index = graph.fit(base, 24, 48, 1.2, shard_rows=shard_rows).cache()
    rows = index.collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert len(rows) == 1500 and (len(shards) == 1) == (shard_rows == 100_000)
    for members in shards.values():
        ids = {r.vec_id for r in members}
        assert sum(r.entry for r in members) == 1
        for r in members:
            assert len(r.nbrs) <= 24 and len(set(r.nbrs)) == len(r.nbrs) and r.vec_id not in r.nbrs and set(r.nbrs) <= ids
        reached, todo, nbrs = set(), [next(r.vec_id for r in members if r.entry)], {r.vec_id: r.nbrs for r in members}
        while todo:
            at = todo.pop()
            if at not in reached:
                reached.add(at)
                todo += nbrs[at]
        assert reached == ids
    found = graph.search_index(spark, index, queries, 10, [20, 100]).cache()
    by_size = {s: recall(lists(graph.merged(found.where(F.col("size") == s))), truth) for s in (20, 100)}
    assert by_size[100] > 0.95 and by_size[20] <= by_size[100] + 0.01
    counts = {r["size"]: r for r in graph.counters(found).collect()}
    assert counts[20].mean_expanded < counts[100].mean_expanded and counts[100].mean_distances < 1500
    for size in (1500, 0):  # a list as long as the shard finds all, and 0 stands for that length
        assert lists(graph.merged(graph.search_index(spark, index, queries, 10, [size]))) == truth
    row = graph.build_counters(index).first()
    assert (row.nodes, row.shards, row.entries) == (1500, len(shards), len(shards)) and 1 <= row.mean_expanded < row.mean_distances < 1500


def test_layers(spark, tables, truth):
    base, queries = tables
    layers = graph.fit_layers(base, m=12, size=60).cache()
    assert {r.level for r in layers.select("level").distinct().collect()} >= {0, 1}
    assert recall(lists(graph.merged(graph.search_index(spark, layers, queries, 10, [100]))), truth) > 0.9


def test_prune_by_definition(clustered):
    x = clustered[0].astype(float)
    for p in range(20):
        pool = np.arange(0, 300)
        kept = graph.prune(x, p, pool, 1.2, 8)
        want, left = [], sorted((k for k in pool if k != p), key=lambda k: (((x[k] - x[p]) ** 2).sum(), k))
        while left and len(want) < 8:
            near = left.pop(0)
            want.append(near)
            left = [k for k in left if 1.2**2 * ((x[k] - x[near]) ** 2).sum() > ((x[k] - x[p]) ** 2).sum()]
        assert kept.tolist() == want
    points, pools = list(range(60)), [np.arange(p % 7, 40 + 3 * p) for p in range(60)]
    for entries in (1, 2_000_000):
        graph.PRUNE_ENTRIES, before = entries, graph.PRUNE_ENTRIES
        assert [k.tolist() for k in graph.prune_many(x, points, pools, 1.2, 8)] == [graph.prune(x, p, pool, 1.2, 8).tolist() for p, pool in zip(points, pools)]
        graph.PRUNE_ENTRIES = before
    assert [k.tolist() for k in graph.prune_many(x, [3, 4], [np.array([3]), np.array([4, 5])], 1.2, 8)] == [[], [5]]


def test_audit_of_planted_defects(spark):
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 9), (0, 2)], "src long, dst long")
    row = graph.audit(edges, spark.range(4).withColumnRenamed("id", "vec_id"), 2).first()
    assert (row.max_degree, row.min_degree, row.zero_degree, row.duplicates, row.self_loops, row.out_of_range, row.in_degree_zero, row.within_degree) == (3, 0, 1, 1, 1, 1, 2, False)


def test_quantisation(spark, tables, clustered, truth):
    base, queries = tables
    x = clustered[0].astype(float)
    book = pq.fit(spark, base, parts=8, codes=64, rounds=5)
    assert book.shape == (8, 64, 4)
    codes = {r.vec_id: r.codes for r in pq.encoded(base, book).collect()}
    rebuilt = np.stack([np.concatenate([book[m, c] for m, c in enumerate(codes[k * 3 + 1])]) for k in range(len(x))])
    assert ((x - rebuilt) ** 2).sum() < 0.35 * ((x - x.mean(axis=0)) ** 2).sum()
    near = pq.adc_topk(spark, pq.encoded(base, book), queries, book, 60)
    assert recall(lists(pq.rerank(near, base, queries)), truth) > recall(lists(near.where("rank <= 10")), truth)
    assert recall(lists(pq.rerank(near, base, queries)), truth) > 0.9
    index = graph.fit(base, 24, 48).cache()
    found = pq.beam_search_index(spark, index, queries, book, 10, 60, 4, 24).cache()
    assert recall(lists(knn.ranked(found, 10)), truth) > 0.85
    stats_row = pq.io_stats(found).first()
    assert 0 < stats_row.p50_ms <= stats_row.p95_ms and stats_row.mean_ms > 0 and stats_row.first_ms > 0
    assert abs(stats_row.bytes_read - stats_row.reads * 4096) < 1 and stats_row.full_dists == stats_row.expanded and stats_row.rounds <= stats_row.expanded
    with pytest.raises(ValueError):
        pq.split(np.zeros((1, 10)), 3)
    with pytest.raises(ValueError):
        pq.node_bytes(2000, 64)


def test_sample_in_parallel(spark, monkeypatch):
    """The sample is the first rows by digest, whatever the bound lets through, and lies on all cores."""
    import hashlib

    rows = spark.range(20_000).selectExpr("id AS vec_id")
    want = sorted(range(20_000), key=lambda k: (hashlib.md5(f"3-{k}".encode()).hexdigest(), k))
    for n in (50, 9_000, 20_000):
        found = pq.sample(rows, n, seed=3)
        assert sorted(r.vec_id for r in found.collect()) == sorted(want[:n]) and found.rdd.getNumPartitions() > 1
    same = spark.range(20_000).selectExpr("7L AS vec_id")
    assert pq.sample(same, 300).count() == 300


def test_spread_seeds(spark, tables):
    """Better than seeds at random, for three seeds, before and after training; the same from other partitions."""
    base, _ = tables
    base = base.select("vec_id", "embedding")
    for seed in range(3):
        spread, random = pq.seeds(spark, base, 4, 32, seed), pq.random_seeds(base, 4, 32, seed)
        assert spread.shape == random.shape == (4, 32, 8)
        costs = []
        for book in (spread, random):
            costs.append(pq.lloyd(spark, base, book)[2])
            for _ in range(3):
                book, counts, cost = pq.lloyd(spark, base, book)
            costs.append(cost)
        assert costs[0] < costs[2] and costs[1] < costs[3] and costs[1] < costs[0]
    assert np.array_equal(pq.seeds(spark, base.repartition(5), 4, 32, 2), spread)


def test_empty_centroids_move(spark):
    """Centroids far from all rows, equal ones, and more centroids than different rows."""
    rows = spark.createDataFrame([(k, [float(k // 10), 0.0]) for k in range(40)], "vec_id long, embedding array<float>")
    book, counts, cost = pq.lloyd(spark, rows, np.array([[[0.0, 0.0], [900.0, 0.0], [900.0, 0.0], [-900.0, 0.0]]]))
    assert counts.tolist() == [[40, 0, 0, 0]] and cost == 10 * (1 + 4 + 9) and sorted(book[0, :, 0].tolist()) == [-900.0, 1.5, 3.0, 900.0]
    trained = pq.fit(spark, rows, 1, 4, rounds=6)
    assert sorted(trained[0, :, 0].tolist()) == [0, 1, 2, 3] and pq.fit(spark, rows, 1, 9, rounds=2).shape == (1, 9, 2)


def test_layout(spark, tmp_path):
    base = spark.range(1000).withColumnRenamed("id", "vec_id")
    rows = pq.layout(base, 64, 32)
    assert rows.agg(F.max("sector")).first()[0] == pq.sectors(1000, 64, 32) == 100
    assert rows.where("offset + 388 > 4096").count() == 0
    sinks.write_layout(rows, f"{tmp_path}/layout", 4)
    assert spark.read.parquet(f"{tmp_path}/layout").where("sector = 7").count() == 10


def test_components(spark, tables, clustered):
    base, _ = tables
    x = clustered[0].astype(float)
    model = reduce.fit(base, 16, sample_rows=None)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(model.ratios, values[:16] / values.sum(), atol=1e-6) and np.allclose(model.mean, x.mean(axis=0))
    y = np.stack([r.embedding for r in reduce.project(base, model).orderBy("vec_id").collect()])
    assert y.shape == (1500, 16) and np.allclose(np.linalg.norm(y, axis=1), 1, atol=1e-5)


def test_fvecs_files(spark, clustered, tmp_path):
    x = clustered[0][:100]
    (tmp_path / "a.fvecs").write_bytes(vecs.encoded(x))
    (tmp_path / "b.fvecs").write_bytes(vecs.encoded(x[:3]))
    (tmp_path / "c.ivecs").write_bytes(vecs.encoded(np.arange(12).reshape(4, 3), "<i4"))
    rows = vecs.read_vecs(spark, f"{tmp_path}/*.fvecs").collect()
    assert len(rows) == 103 and np.array_equal(np.stack([r.value for r in sorted(rows, key=lambda r: (r.path, r.row))][:100]).astype(np.float32), x)
    assert [r.value for r in vecs.read_vecs(spark, f"{tmp_path}/c.ivecs", "<i4").orderBy("row").collect()] == np.arange(12).reshape(4, 3).tolist()


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    x = np.arange(20_000 * 15, dtype=np.float32).reshape(20_000, 15)
    (tmp_path / "a.fvecs").write_bytes(vecs.encoded(x))
    (tmp_path / "empty.fvecs").write_bytes(b"")
    found = vecs.read_vecs(spark, str(tmp_path), split_bytes=100_000)
    assert found.rdd.getNumPartitions() >= 12
    rows = found.orderBy("row").collect()
    assert [r.row for r in rows] == list(range(20_000)) and np.array_equal(np.array([r.value for r in rows], np.float32), x)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "b.fvecs").write_bytes(vecs.encoded(x[:3]) + b"1234")
    with pytest.raises(ValueError, match="no rows"):
        vecs.read_vecs(spark, f"{tmp_path}/odd")
    (tmp_path / "odd" / "b.fvecs").write_bytes(vecs.encoded(x[:2]) + vecs.encoded(x[:1, :7]) + vecs.encoded(x[:1, :7]))
    with pytest.raises(Exception, match="different dimensions|cannot reshape"):
        vecs.read_vecs(spark, f"{tmp_path}/odd").collect()


def test_latencies(spark):
    df = spark.createDataFrame([(r, float(v)) for r, shift in ((0, 5), (1, 0), (2, 1), (3, 9)) for v in range(shift, shift + 5)], "run int, lat_ms double")
    row = stats.latency_summary(df.where("run = 1")).first()
    assert (row.mean_ms, row.p50_ms, row.p95_ms, row.qps) == (2, 2, 3.8, 500)
    assert tuple(stats.median_run(df).first()) == (0, 7.0, 4)


def test_index_object(spark, tables, tmp_path):
    from lodestone.operators.index import GraphIndex, GraphParameters

    base, queries = tables
    made = GraphIndex.fit(base.where("vec_id < 900"), GraphParameters(degree=12, size=24)).save(f"{tmp_path}/index")
    again = GraphIndex.load(spark, f"{tmp_path}/index")
    assert again.parameters == made.parameters == GraphParameters(degree=12, size=24)
    assert lists(again.search(queries, 5, 50)) == lists(made.search(queries, 5, 50))
    row = again.audit().first()
    assert row.within_degree and row.self_loops == row.duplicates == row.out_of_range == 0
    assert GraphIndex.size_bytes(spark, f"{tmp_path}/index") > 0


def test_datasets_and_results(spark, tables, tmp_path):
    from lodestone.sources import datasets
    from lodestone.sources.hdf5 import read_hdf5

    base, _ = tables
    assert datasets.dataset("scifact").top_k == 100 and len(datasets.DATASETS) == 5
    with pytest.raises(KeyError, match="nfcorpus"):
        datasets.dataset("none")
    paths = datasets.Paths(str(tmp_path), "scifact")
    assert paths.graph.endswith("scifact/graph")
    with pytest.raises(AttributeError):
        paths.other
    spark.range(2).write.parquet(paths.truth)
    assert datasets.ground_truth(spark, paths).count() == 2
    spark.range(3).write.parquet(paths.supplied_truth)
    assert datasets.ground_truth(spark, paths).count() == 3
    assert datasets.prefix(base, 5).count() == 2 and datasets.prefix(base).count() == 1500
    sinks.save_results(spark, {"a": np.float32(1.5), "b": np.arange(3), "c": None}, f"{tmp_path}/r")
    assert sinks.load_results(spark, f"{tmp_path}/r") == {"a": 1.5, "b": [0, 1, 2], "c": None}
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            read_hdf5(spark, "x.h5", "train", 10)


def test_bucket_search(spark):
    from lodestone.operators import lsh
    from lodestone.plans import graphs, vectors

    sf = "/root/testdata/sf0.01"
    assert recall(lists(graphs.lsh_knn(spark, sf)), lists(vectors.knn_exact_topk(spark, sf))) >= 0.9
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(-6, 7)], "vec_id long, embedding array<float>")
    queries = rows.selectExpr("vec_id AS qid", "embedding AS qvec")
    # Hardly a row shares a key of 8 bits: the rest comes from the exact pass.
    found = lsh.topk(spark, rows, queries, 10, tables=1, bits=8).groupBy("qid").count().collect()
    assert len(found) == 13 and {r["count"] for r in found} == {10}


def test_registered_beam_search(spark):
    from lodestone.plans import compression, vectors

    sf = "/root/testdata/sf0.01"
    assert recall(lists(compression.beam_search_topk(spark, sf)), lists(vectors.knn_exact_topk(spark, sf))) >= 0.9


@pytest.mark.parametrize("shard_rows", [100_000, 400])
def test_checked_search_is_exact(spark, tables, truth, shard_rows):
    """A short list misses neighbours; the check of all rows brings them in, without a walk over every node."""
    base, queries = tables
    index = graph.fit(base, 6, 12, 1.2, shard_rows=shard_rows).cache()
    rough = graph.search_index(spark, index, queries, 10, [10]).cache()
    assert recall(lists(graph.merged(rough)), truth) < 1
    found = graph.search_index(spark, index, queries, 10, [10], confirm=True).cache()
    assert lists(graph.merged(found)) == truth
    assert graph.counters(found).first() == graph.counters(rough).first()
    # Copies, ties, and fewer rows than are asked for.
    x = np.array([[0.0, 0.0], [3.0, 0.0], [0.0, 0.0], [0.0, 3.0], [1.0, 1.0]])
    q, none = np.array([[0.0, 0.0], [1.0, 1.0]]), np.full((2, 7), graph.NONE)
    ids, d = graph.confirmed(x, q, none, np.full((2, 7), np.inf), 7)
    assert ids[:, :5].tolist() == [[0, 2, 4, 1, 3], [4, 0, 2, 1, 3]] and d[0].tolist()[:5] == [0, 0, 2, 9, 9]
    assert (ids[:, 5:] == graph.NONE).all()
    ids, d = graph.confirmed(x, q, np.array([[2, 1], [1, 3]]), np.array([[0.0, 9.0], [5.0, 5.0]]), 2)
    assert ids.tolist() == [[0, 2], [4, 0]] and d.tolist() == [[0, 0], [0, 2]]


def peak_of(run):
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_centroids_in_tiles():
    """A batch of rows against 256 centroids a part: what is held at once is a tile."""
    rng = np.random.default_rng(5)
    x, book = rng.normal(size=(4000, 64)), rng.normal(size=(16, 256, 4))
    served, peak = peak_of(lambda: pq._served(x, list(book)))
    assert peak < 64 << 20
    (at, least), peak = peak_of(lambda: pq.nearest(x, book))
    assert peak < 64 << 20  # all distances at once would be 131 MB, with all coordinates 524 MB
    want = ((x[:500].reshape(500, 16, 1, 4) - book[None]) ** 2).sum(axis=3)
    assert (at[:500] == want.argmin(axis=2)).all() and (least[:500] == want.min(axis=2)).all()
    for m, (place, d) in enumerate(served):
        assert (place == at[:, m]).all() and (d == least[:, m]).all()


def test_beams_hold_a_tile_of_a_shard():
    from types import SimpleNamespace

    import pandas as pd

    rng = np.random.default_rng(6)
    n, x, book = 4000, rng.normal(size=(4000, 64)).astype(np.float32), rng.normal(size=(16, 256, 4))
    rows = pd.DataFrame({"shard": 0, "vec_id": np.arange(n), "embedding": list(x), "nbrs": [np.array([(k + 1) % n, (7 * k + 3) % n, (k * 31 + 11) % n]) for k in range(n)], "entry": np.arange(n) == 0})
    asked = x[:300].astype(float)
    shared = SimpleNamespace(value=((np.arange(300), asked), book))
    found, peak = peak_of(lambda: pq._beams(shared, 3, 20, 4, 32)(rows))
    assert peak < 96 << 20  # the shard's distances to the centroids at once would be 131 MB, with all coordinates 524 MB
    assert set(found.qid) == set(range(300)) and found.groupby("qid").size().eq(3).all()
    codes, place = pq.nearest(x.astype(float), book)[0], np.arange(n)
    nbrs = np.stack(rows["nbrs"].to_list())
    for q in (0, 299):
        ids, _, counts = pq.beam_search(x.astype(float), nbrs, place, codes, 0, asked[q], pq.distances(asked[q : q + 1], book)[0], 3, 20, 4, 10)
        mine = found[found.qid == q]
        assert mine.vec_id.tolist() == ids and int(mine.pq_dists.iloc[0]) == counts[3]
