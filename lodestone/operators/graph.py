"""Proximity graphs for approximate search, sharded by rows.

The base is dealt into shards of bounded size by a hash of the id. A shard's graph is built in one task by bulk-synchronous insertion
(a batch searches the frozen graph, its lists are written, reverse edges follow), and every query visits every shard; the
shards' lists are merged. With one shard this is the plain algorithm; with many, memory stays that of a shard. Distances are squared; equal
distances go by id.

The relational forms of pruning, reverse edges and the degree audit work on edge tables of any size."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import l2sq
from lodestone.operators.knn import DIGITS, TILE_ROWS, best_of, query_blocks, ranked

#: A shard is built in one task, some milliseconds a row: more shards are more tasks, and a query visits each.
SHARD_ROWS = 25_000
NONE = -1
#: expanded and distances are the work of a node's own insertion in the last pass.
INDEX = "shard int, level int, vec_id long, embedding array<float>, nbrs array<long>, entry boolean, expanded long, distances long"
COLUMNS = [field.split()[0] for field in INDEX.split(", ")]
#: Values that the hash of an id may take when its layer is drawn.
DRAWS = 1 << 30
#: Entries of the lists that a task searches with at once.
LIST_ENTRIES = 4_000_000
#: Nodes that a search with a list as long as the shard expands at once.
WHOLE_WIDTH = 128
#: Distances within pools that a task holds at once.
PRUNE_ENTRIES = 2_000_000


# ---- inside a task ----------------------------------------------------------------------------------------------------


def padded(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(lists), width), NONE, np.int64)
    for row, found in zip(out, lists, strict=True):
        row[: len(found)] = found
    return out


def search(x: np.ndarray, nbrs: np.ndarray, entries: np.ndarray, queries: np.ndarray, size: int, visits: bool = False, width: int = 1):
    """Best-first search of all queries in step: each expands the nearest `width` nodes of its list that it has not expanded.

    Returns ids and distances (query, size; NONE and inf where short), expansions and distance evaluations of each query, and, with
    visits, the expanded nodes of each."""
    n_queries, size = len(queries), max(1, size)
    ids = np.full((n_queries, size), NONE, np.int64)
    dist = np.full((n_queries, size), np.inf)
    done = np.ones((n_queries, size), bool)
    ids[:, 0], done[:, 0] = entries, False
    dist[:, 0] = ((x[entries] - queries) ** 2).sum(axis=1)
    seen = np.zeros((n_queries, len(x)), bool)
    seen[np.arange(n_queries), entries] = True
    expanded, scored = np.zeros(n_queries, np.int64), np.ones(n_queries, np.int64)
    trail: list[list[int]] = [[] for _ in range(n_queries)]
    active = np.arange(n_queries)
    while len(active):
        open_ = ~done[active]
        row, col = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= width))
        heads = ids[active[row], col]
        done[active[row], col] = True
        expanded += np.bincount(active[row], minlength=n_queries)
        if visits:
            for q, node in zip(active[row].tolist(), heads.tolist(), strict=True):
                trail[q].append(node)
        # The unseen neighbours of each query's heads, once each, side by side.
        near = nbrs[heads]
        at, place = np.nonzero(near != NONE)
        pairs = np.unique(row[at] * len(x) + near[at, place])
        q, node = pairs // len(x), pairs % len(x)
        fresh = ~seen[active[q], node]
        q, node = q[fresh], node[fresh]
        seen[active[q], node] = True
        counts = np.bincount(q, minlength=len(active))
        scored[active] += counts
        new, new_d = np.full((len(active), int(counts.max(initial=0))), NONE, np.int64), np.full((len(active), int(counts.max(initial=0))), np.inf)
        place = np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
        new[q, place], new_d[q, place] = node, ((x[node] - queries[active[q]]) ** 2).sum(axis=1)
        all_ids = np.hstack([ids[active], new])
        all_d = np.hstack([dist[active], new_d])
        all_done = np.hstack([done[active], new == NONE])
        order = np.lexsort((all_ids, all_d), axis=1)[:, :size]
        ids[active], dist[active], done[active] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_d, all_done))
        active = active[(~done[active]).any(axis=1)]
    return ids, dist, expanded, scored, trail


def prune(x: np.ndarray, p: int, pool: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Neighbours of p: nearest first, each candidate unless one that is kept is nearer to it by a factor alpha than p is."""
    pool = np.unique(pool[pool != p])
    d = ((x[pool] - x[p]) ** 2).sum(axis=1)
    order = np.lexsort((pool, d))
    pool, d = pool[order], d[order]
    kept, alive = [], np.ones(len(pool), bool)
    while len(kept) < degree and alive.any():
        at = int(alive.argmax())
        kept.append(pool[at])
        alive[at] = False
        left = np.flatnonzero(alive)
        alive[left[alpha * alpha * ((x[pool[left]] - x[pool[at]]) ** 2).sum(axis=1) <= d[left]]] = False
    return np.array(kept, np.int64)


def prune_many(x: np.ndarray, points: list[int], pools: list[np.ndarray], alpha: float, degree: int) -> list[np.ndarray]:
    """prune() of many points in step: their pools side by side, all distances within a pool by one product."""
    pools = [np.unique(pool[pool != p]) for p, pool in zip(points, pools, strict=True)]
    out: list[np.ndarray] = []
    step = max(1, PRUNE_ENTRIES // max([1, *map(len, pools)]) ** 2)
    for start in range(0, len(points), step):
        ids = padded(pools[start : start + step], max([1, *map(len, pools[start : start + step])]))
        own = np.array(points[start : start + step])
        d = np.where(ids != NONE, ((x[np.maximum(ids, 0)] - x[own][:, None, :]) ** 2).sum(axis=2), np.inf)
        order = np.lexsort((ids, d), axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        v = x[np.maximum(ids, 0)]
        squares = (v * v).sum(axis=2)
        between = squares[:, :, None] + squares[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        gone = alpha * alpha * between <= d[:, None, :]  # of each pool: whether the second goes when the first is kept
        alive, kept = ids != NONE, np.full((len(own), degree), NONE, np.int64)
        for place in range(degree):
            rows = np.flatnonzero(alive.any(axis=1))
            if not len(rows):
                break
            at = alive[rows].argmax(axis=1)
            kept[rows, place] = ids[rows, at]
            alive[rows] &= ~gone[rows, at]
            alive[rows, at] = False
        out += [row[row != NONE] for row in kept]
    return out


def nearest_to_mean(x: np.ndarray) -> int:
    return int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())


def build(x: np.ndarray, degree: int, size: int, alpha: float, seed: int, batch_share: float = 0.02, passes: tuple[float, ...] | None = None) -> tuple[list[np.ndarray], int, np.ndarray]:
    """Lists of neighbours, the entry node, and for each node the expansions and distance evaluations of its insertion in the
    last pass. Two passes, the first with alpha 1."""
    n, rng, entry = len(x), np.random.default_rng(seed), nearest_to_mean(x)
    lists = [_others(rng, n, k, min(degree, n - 1)) for k in range(n)]
    largest, work = max(16, int(batch_share * n)), np.zeros((n, 2), np.int64)
    for turn, a in enumerate(passes or (1.0, alpha)):
        order, at, batch = rng.permutation(n), 0, largest if turn else 16
        while at < n:
            points = order[at : at + batch]
            at += len(points)
            _, _, expanded, scored, trail = search(x, padded(lists, degree), np.full(len(points), entry), x[points], size, visits=True)
            work[points, 0], work[points, 1] = expanded, scored
            new = prune_many(x, points.tolist(), [np.concatenate([np.array(t, np.int64), lists[p]]) for p, t in zip(points, trail, strict=True)], a, degree)
            back: dict[int, list[int]] = {}
            for p, found in zip(points.tolist(), new, strict=True):
                lists[p] = found
                for target in found.tolist():
                    back.setdefault(target, []).append(p)
            full: dict[int, np.ndarray] = {}
            for target, sources in back.items():
                held = set(lists[target].tolist())
                joined = np.concatenate([lists[target], [s for s in sources if s not in held]]).astype(np.int64)
                if len(joined) <= degree:
                    lists[target] = joined
                else:
                    full[target] = joined
            for target, kept in zip(full, prune_many(x, list(full), list(full.values()), a, degree), strict=True):
                lists[target] = kept
            batch = min(largest, 2 * batch)
    _reach_all(x, lists, entry, degree)
    return lists, entry, work


def _others(rng: np.random.Generator, n: int, k: int, count: int) -> np.ndarray:
    """count distinct numbers below n without k."""
    found = rng.choice(n - 1, count, replace=False) if n > 1 else np.zeros(0, np.int64)
    return np.where(found >= k, found + 1, found)


def _reach_all(x: np.ndarray, lists: list[np.ndarray], entry: int, degree: int) -> None:
    """Makes every node reachable, within the degree, so that a list as long as the shard finds everything.

    The edges by which nodes are first reached are a tree; others can go and everything stays reached. A node not yet reached is tied to
    the nearest reached one with fewer tree edges than the degree, in place of its longest other edge where there is no
    room. A tree of n nodes has n - 1 edges and so always a node with room, for any degree from 1."""
    reached, tree = np.zeros(len(x), bool), [set() for _ in lists]
    room = np.full(len(x), degree)

    def spread(start: int) -> None:
        reached[start], todo = True, [start]
        while todo:
            node = todo.pop()
            for other in lists[node].tolist():
                if not reached[other]:
                    reached[other] = True
                    tree[node].add(other)
                    room[node] -= 1
                    todo.append(other)

    spread(entry)
    for node in np.flatnonzero(~reached).tolist():
        if reached[node]:
            continue
        free = np.flatnonzero(reached & (room > 0))
        near = int(free[((x[free] - x[node]) ** 2).sum(axis=1).argmin()])
        if len(lists[near]) >= degree:
            spare = np.array([other for other in lists[near].tolist() if other not in tree[near]])
            out = int(spare[((x[spare] - x[near]) ** 2).sum(axis=1).argmax()])
            lists[near] = lists[near][lists[near] != out]
        lists[near] = np.append(lists[near], node)
        tree[near].add(node)
        room[near] -= 1
        spread(node)


def matrix_of(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


# ---- over shards ------------------------------------------------------------------------------------------------------


def sharded(base: DataFrame, shard_rows: int = SHARD_ROWS, deal: int = 0) -> DataFrame:
    """base (vec_id, embedding) with a shard of at most about shard_rows rows each; another deal is another hash."""
    shards = max(1, math.ceil(base.count() / shard_rows))
    return base.select(F.pmod(F.xxhash64("vec_id", *[F.lit(deal)] * bool(deal)), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")


def by_shard(rows: DataFrame) -> GroupedData:
    """rows by shard, a task for each: shards are of few bytes and much work, so they are drawn together neither for their size nor by a hash."""
    return rows.repartitionById((rows.agg(F.max("shard")).first()[0] or 0) + 1, F.col("shard")).groupBy("shard")


def fit(base: DataFrame, degree: int = 64, size: int = 100, alpha: float = 1.2, seed: int = 0, batch_share: float = 0.02, shard_rows: int = SHARD_ROWS, deal: int = 0) -> DataFrame:
    """The index: a row for each vector with its neighbours; entry marks the node nearest its shard's mean."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        ids = rows["vec_id"].to_numpy()
        lists, entry, work = build(matrix_of(rows["embedding"]), degree, size, alpha, seed, batch_share)
        return rows.assign(level=0, nbrs=[ids[found].tolist() for found in lists], entry=np.arange(len(rows)) == entry, expanded=work[:, 0], distances=work[:, 1])[COLUMNS]

    return by_shard(sharded(base, shard_rows, deal)).applyInPandas(run, INDEX)


def fit_layers(base: DataFrame, m: int = 32, size: int = 200, seed: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Layered index: each node's top layer is drawn from a geometric distribution by the hash of its id; layer 0 has twice the degree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        ids, x = rows["vec_id"].to_numpy(), matrix_of(rows["embedding"])
        draw = (rows["draw"].to_numpy() + 0.5) / DRAWS
        top = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(max(2, m))).astype(int)
        parts = []
        for level in range(int(top.max()) + 1):
            here = np.flatnonzero(top >= level)
            lists, entry, work = build(x[here], 2 * m if level == 0 else m, size, 1.0, seed + level, passes=(1.0,))
            part = rows.iloc[here].assign(level=level, nbrs=[ids[here[f]].tolist() for f in lists], entry=np.arange(len(here)) == entry, expanded=work[:, 0], distances=work[:, 1])
            parts.append(part[COLUMNS])
        return pd.concat(parts)

    drawn = sharded(base, shard_rows).withColumn("draw", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(DRAWS)))
    return by_shard(drawn).applyInPandas(run, INDEX)


def loaded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """ids, vectors, padded neighbours as places, entry place of one layer."""
    rows = rows.sort_values("vec_id", ignore_index=True)
    ids = rows["vec_id"].to_numpy()
    lists = [np.searchsorted(ids, np.asarray(f, np.int64)) for f in rows["nbrs"]]
    return ids, matrix_of(rows["embedding"]), padded(lists, max(1, max(map(len, lists)))), int(rows["entry"].to_numpy().argmax())


def confirmed(x: np.ndarray, queries: np.ndarray, found: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What a search found (query, at least k; NONE and inf where short), made exact: every row is checked against the k-th distance found, and what
    the search has missed enters. Equal rounded distances go by place. Distances come in tiles; few rows are left of each."""
    edge = np.round(dist[:, k - 1 : k], DIGITS) + 1.5 * 10.0**-DIGITS  # both sides are rounded, by two ways of computing a distance
    squares = (queries * queries).sum(axis=1)[:, None]
    best = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64)
    for start in range(0, len(x), TILE_ROWS):
        rows = x[start : start + TILE_ROWS]
        d = np.round(np.maximum(squares - 2 * queries @ rows.T + (rows * rows).sum(axis=1), 0), DIGITS)
        near = d <= edge
        at = np.flatnonzero(near.any(axis=0))
        if len(at):
            best = best_of(best, np.where(near[:, at], d[:, at], np.inf), start + at, k)
    d, found = best
    exact = np.round(((x[found] - queries[:, None, :]) ** 2).sum(axis=2), DIGITS)
    exact, found = np.where(np.isfinite(d), exact, np.inf), np.where(np.isfinite(d), found, NONE)
    order = np.lexsort((found, exact), axis=1)
    return np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)


def _searching(shared, k: int, sizes: list[int], confirm: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        qids, queries = shared.value
        layers = [loaded(part) for _, part in sorted(rows.groupby("level"), reverse=True)]
        at = np.full(len(qids), layers[0][0][layers[0][3]])
        for ids, x, nbrs, _ in layers[:-1]:
            at = ids[search(x, nbrs, np.searchsorted(ids, at), queries, 1)[0][:, 0]]
        ids, x, nbrs, _ = layers[-1]
        out = []
        for size in sizes:
            length = max(size, k) if size else max(len(ids), k)
            step = max(1, min(256, LIST_ENTRIES // length))
            for start in range(0, len(qids), step):
                part = slice(start, start + step)
                # Whatever is expanded first, a list that rejects nothing expands all.
                began = time.perf_counter()
                found, d, expanded, scored, _ = search(x, nbrs, np.searchsorted(ids, at[part]), queries[part], length, width=1 if size else WHOLE_WIDTH)
                took = 1000 * (time.perf_counter() - began) / len(found)
                found, d = confirmed(x, queries[part], found, d, k) if confirm else (found[:, :k], d[:, :k])
                keep = found != NONE
                row = np.nonzero(keep)[0]
                out.append(pd.DataFrame({"size": size, "qid": qids[part][row], "vec_id": ids[found[keep]], "d2": np.round(d[keep], DIGITS), "expanded": expanded[row], "distances": scored[row], "shard": int(rows["shard"].iloc[0]), "lat_ms": took}))
        return pd.concat(out) if out else pd.DataFrame(columns=["size", "qid", "vec_id", "d2", "expanded", "distances", "shard", "lat_ms"])

    return run


def search_index(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = 10, sizes: list[int] | None = None, confirm: bool = False) -> DataFrame:
    """Nearest k of each query and list size in every shard, with the shard's counters; query blocks of bounded size are broadcast.
    A size of 0 is a list as long as the shard, with which the search is exact, as the build makes every node reachable.
    With confirm, what a list of any size found is made exact by a check of all rows; the counters stay the search's own."""
    schema = "size int, qid long, vec_id long, d2 double, expanded long, distances long, shard int, lat_ms double"
    out = None
    shards = by_shard(index)
    for block in query_blocks(queries):
        part = shards.applyInPandas(_searching(spark.sparkContext.broadcast(block), k, sizes or [100], confirm), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def merged(found: DataFrame, k: int = 10) -> DataFrame:
    """size, qid, rank, vec_id, d2: the shards' lists as one."""
    keyed = found.withColumn("key", F.struct("size", "qid"))
    return ranked(keyed, k, key="key").select("size", "qid", "rank", "vec_id", "d2")


def counters(found: DataFrame) -> DataFrame:
    """size, mean expansions and distance evaluations of a query, its shards summed."""
    each = found.groupBy("size", "qid", "shard").agg(F.max("expanded").alias("e"), F.max("distances").alias("d")).groupBy("size", "qid").agg(F.sum("e").alias("e"), F.sum("d").alias("d"))
    return each.groupBy("size").agg(F.round(F.avg("e"), DIGITS).alias("mean_expanded"), F.round(F.avg("d"), DIGITS).alias("mean_distances"))


def latencies(found: DataFrame) -> DataFrame:
    """size, mean_ms: the milliseconds that a query took in its shards, which were searched for many queries in step."""
    each = found.groupBy("size", "qid", "shard").agg(F.max("lat_ms").alias("t")).groupBy("size", "qid").agg(F.sum("t").alias("t"))
    return each.groupBy("size").agg(F.round(F.avg("t"), DIGITS).alias("mean_ms"))


def build_counters(index: DataFrame) -> DataFrame:
    """One row: nodes, shards, and the mean expansions and distance evaluations of a node's insertion in the last pass."""
    return index.where("level = 0").agg(
        F.count(F.lit(1)).alias("nodes"), F.countDistinct("shard").alias("shards"), F.count_if("entry").alias("entries"), F.round(F.avg("expanded"), DIGITS).alias("mean_expanded"), F.round(F.avg("distances"), DIGITS).alias("mean_distances")
    )


# ---- on tables --------------------------------------------------------------------------------------------------------


def pruned(pool: Column, alpha: float, degree: int) -> Column:
    """Robust pruning as a fold over an array of structs (d, id, v) sorted by (d, id): the kept ones, at most degree."""
    kind = "array<struct<d:double,id:bigint,v:array<float>>>"

    def step(kept: Column, c: Column) -> Column:
        ok = (F.size(kept) < degree) & F.forall(kept, lambda k: F.lit(alpha * alpha) * l2sq(k["v"], c["v"]) > c["d"])
        return F.when(ok, F.array_append(kept, c)).otherwise(kept)

    return F.aggregate(pool.cast(kind), F.array().cast(kind), step)


def reverse_edges(edges: DataFrame) -> DataFrame:
    """dst, src: the edges to add at each target so that its source is among its neighbours; those it has already are left out."""
    own = edges.select("src", "dst").distinct()
    return own.where("src <> dst").join(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").select("dst", "src")


def in_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """vec_id, in_degree for every node."""
    counts = edges.groupBy(F.col("dst").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(counts, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def audit(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """One row: degrees and defects of an edge table over the given nodes."""
    out = edges.groupBy(F.col("src").alias("vec_id")).agg(F.count(F.lit(1)).alias("deg"), F.countDistinct("dst").alias("different"))
    per = nodes.join(out, "vec_id", "left").select(F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("different", F.lit(0)).alias("different"))
    degrees = per.agg(
        F.round(F.avg("deg"), DIGITS).alias("avg_degree"),
        F.max("deg").alias("max_degree"),
        F.min("deg").alias("min_degree"),
        F.count_if(F.col("deg") == 0).alias("zero_degree"),
        F.sum(F.col("deg") - F.col("different")).alias("duplicates"),
        (F.max("deg") <= degree).alias("within_degree"),
    )
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    outside = edges.join(nodes.select(F.col("vec_id").alias("dst")), "dst", "left_anti").agg(F.count(F.lit(1)).alias("out_of_range"))
    unreached = in_degrees(edges, nodes).agg(F.count_if(F.col("in_degree") == 0).alias("in_degree_zero"))
    return degrees.crossJoin(loops).crossJoin(outside).crossJoin(unreached)  # a row each
