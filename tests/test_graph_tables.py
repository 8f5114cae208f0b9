"""Graphs by joins: search against a plain one, the repair and the build by their invariants, recall against exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, graph_tables, knn


def frame(spark, x, first=0, step=1):
    return spark.createDataFrame([(first + step * k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>")


def adjacency_of(edges):
    out = {}
    for r in edges.collect():
        out.setdefault(r.src, []).append(r.dst)
    return out


def reached(lists, entry):
    seen, todo = {entry}, [entry]
    while todo:
        for other in lists.get(todo.pop(), ()):
            if other not in seen:
                seen.add(other)
                todo.append(other)
    return seen


def plain_walk(x, lists, entry, q, size, width):
    """The search for one query, written out."""
    far = lambda k: float(((x[k].astype(float) - q.astype(float)) ** 2).sum())
    found, done, seen, expanded = [(far(entry), entry)], set(), {entry}, 0
    while heads := [k for _, k in found if k not in done][:width]:
        done.update(heads)
        expanded += len(heads)
        fresh = {n for h in heads for n in lists.get(h, ())} - seen
        seen |= fresh
        found = sorted(found + [(far(n), n) for n in fresh])[:size]
    return [k for _, k in found], expanded, len(seen)


def test_walk_against_a_plain_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    lists = {k: rng.choice(300, 6, replace=False).tolist() for k in range(0, 300) if k % 50}  # some lead nowhere
    base = frame(spark, x)
    adjacency = spark.createDataFrame([(k, [*map(int, v)]) for k, v in lists.items()], "vec_id long, nbrs array<long>")
    queries = base.where("vec_id % 10 = 0").selectExpr("vec_id AS qid", "embedding AS qvec")
    entry = spark.createDataFrame([(7,)], "vec_id long")
    for size, width in ((12, 1), (20, 4)):
        found = {}
        for r in graph_tables.walk(spark, base, adjacency, entry, queries, 10, size, width).orderBy("qid", "rank").collect():
            found.setdefault(r.qid, ([], r.expanded, r.distances))[0].append(r.vec_id)
        want = {q: plain_walk(x, lists, 7, x[q], size, width) for q in range(0, 300, 10)}
        assert found == {q: (ids[:10], e, d) for q, (ids, e, d) in want.items()}


def test_walk_without_queries(spark):
    base = frame(spark, np.eye(3))
    none = graph_tables.walk(spark, base, spark.createDataFrame([], "vec_id long, nbrs array<long>"), base.limit(1), base.selectExpr("vec_id AS qid", "embedding AS qvec").where("false"))
    assert none.count() == 0


@pytest.mark.parametrize("degree", [2, 3, 4])
def test_repair_reaches_all(spark, degree):
    """Full lists that point into few nodes: edges have to be exchanged, and none of what was reached gets lost."""
    rng = random.Random(degree)
    n = 40
    x = np.random.default_rng(degree).normal(size=(n, 4)).astype(np.float32)
    edges = [(k, (k // 20 * 20 + rng.randrange(4)) % n) for k in range(n) for _ in range(degree)]
    edges = sorted({(a, b) for a, b in edges if a != b})
    base = frame(spark, x)
    found = graph_tables.repaired(spark, spark.createDataFrame(edges, "src long, dst long"), base, base.where("vec_id = 0").select("vec_id"), degree)
    lists = adjacency_of(found)
    assert max(map(len, lists.values())) <= degree and all(len(v) == len(set(v)) and k not in v for k, v in lists.items())
    assert reached(lists, 0) == set(range(n)) and len(reached({a: [b for c, b in edges if c == a] for a, _ in edges}, 0)) < n


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
def test_shards_reach_all(degree):
    rng = np.random.default_rng(degree)
    for n in (200, 500):
        x = (rng.normal(size=(20, 8)) * 9)[rng.integers(0, 20, n)] + rng.normal(size=(n, 8))
        lists, entry, _ = graph.build(x, degree, 20, 1.2, seed=0)
        assert max(map(len, lists)) <= degree and all(k not in f for k, f in enumerate(lists))
        assert reached(dict(enumerate(f.tolist() for f in lists)), entry) == set(range(n))


def test_pools_in_chunks(spark):
    """Pruning in chunks gives what pruning at once gives, for a hub as well."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    pool = [(0, k) for k in range(200)] + [(k, int(j)) for k in range(1, 40) for j in rng.choice(200, rng.integers(1, 30))]
    base, pools = frame(spark, x), spark.createDataFrame(pool, "vec_id long, id long")
    want = {k: graph.prune(x.astype(float), k, np.array([j for i, j in pool if i == k]), 1.2, 12).tolist() for k in {i for i, j in pool if i != j}}
    for chunk in (7, 500):
        assert {r.vec_id: list(r.nbrs) for r in graph_tables.pruned_pools(spark, pools, base, 1.2, 12, chunk).collect()} == want


def test_build(spark):
    """Clustered vectors with gaps between the ids: degree, reachability, recall, and the same graph from other partitions."""
    rng = np.random.default_rng(0)
    x = ((rng.normal(size=(30, 12)) * 3)[rng.integers(0, 30, 1200)] + rng.normal(size=(1200, 12))) @ rng.normal(size=(12, 24))
    base = frame(spark, x.astype(np.float32), 5, 3).cache()
    entry = knn.medoid(base)
    made = graph_tables.build(spark, base, entry, degree=20, neighbours=24).cache()
    lists = {r.vec_id: r.nbrs for r in made.collect()}
    assert set(lists) == {5 + 3 * k for k in range(1200)} and max(map(len, lists.values())) <= 20
    assert reached(lists, entry.first().vec_id) == set(lists)
    queries = base.where("vec_id % 7 = 0").selectExpr("vec_id AS qid", "embedding AS qvec")
    found = graph_tables.walk(spark, base, made, entry, queries, 10, 60, 8)
    truth = knn.exact_topk(spark, base, queries, 10)
    assert knn.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.95
    again = graph_tables.build(spark, base.repartition(7), entry, degree=20, neighbours=24)
    assert {r.vec_id: r.nbrs for r in again.collect()} == lists


def test_registered_walk(spark):
    """Recall at sf0.1, with a list that is a twentieth of the rows, and a plan without grouped calls of Python."""
    from lodestone.plans import graphs, vectors

    sf = "/root/testdata/sf0.1"
    found = graphs.graph_walk_topk(spark, sf)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert knn.recall(found, vectors.knn_exact_topk(spark, sf), 10).agg(F.avg("recall")).first()[0] >= 0.95


def test_one_graph_of_several_parts(spark):
    """More rows than a part holds still give one graph with one entry, which leads to every node."""
    from lodestone.plans import graphs

    sf = "/root/testdata/sf0.1"
    index = graphs.one_graph(spark, sf, part_rows=600)
    row = graph.build_counters(index).first()
    assert (row.nodes, row.shards, row.entries) == (2000, 1, 1) and 1 <= row.mean_expanded < row.mean_distances
    rows = index.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(2000)) and {(r.shard, r.level) for r in rows} == {(0, 0)}
    assert [r.vec_id for r in rows if r.entry] == [r.vec_id for r in knn.medoid(graphs.base_vectors(spark, sf)).collect()]
    for r in rows:
        assert len(set(r.nbrs)) == len(r.nbrs) <= graphs.DEGREE and r.vec_id not in r.nbrs
    reached = [next(r.vec_id for r in rows if r.entry)]
    for at in reached:
        reached += set(rows[at].nbrs) - set(reached)
    assert sorted(reached) == list(range(2000))
    x = np.array([r.embedding for r in rows], float)
    found = graph.search(x, graph.padded([np.array(r.nbrs) for r in rows], graphs.DEGREE), np.full(100, reached[0]), x[::20], 100)[0]
    near = np.argsort(((x[::20, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found.tolist(), near.tolist())]) > 0.9
    assert graph.build_counters(graphs.one_graph(spark, "/root/testdata/sf0.001")).first().nodes == 500
