import random
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import minhash as m
from lodestone.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(words, rng, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """Exact copies, near copies about the threshold, a chain whose ends are far apart, a shared passage, and strangers."""
    rng, rows = random.Random(4), []
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(150)]
    rows += [" ".join(base)] * 20
    rows += [" ".join(edited(base, rng, share)) for share in (0.005, 0.01, 0.015, 0.02, 0.03) for _ in range(25)]
    chain = [word() for _ in range(120)]
    for k in range(30):
        chain = chain[:]
        chain[(k * 4) % 120] = f"step{k}"
        rows.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(rng.randrange(5, 60))] + passage) for _ in range(60)]
    rows += [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rng.shuffle(rows)
    return [(3 * i + 7, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, corpus, percent, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)  # so that buckets and clusters span many block pairs
    monkeypatch.setattr(m, "HOT", 10)  # and texts have many partners
    found = m.near_duplicates(spark, spark.createDataFrame(corpus, "doc_id long, text string"), percent).collect()
    want = brute_force(corpus, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len(set(c for _, c in want.values())) < len(corpus) - 20


@pytest.mark.parametrize("stragglers", [1, 3000])
def test_rows_of_a_large_bucket(spark, stragglers):
    """A bucket of 10,000 with two components: rows are linear in it, and every pair of members of different components meets."""
    n, block = 10_000, 1000
    members = spark.range(n).selectExpr("7L AS key", "id", f"if(id < {stragglers}, -1L, -2L) AS component", "1 AS weight").union(spark.range(50).selectExpr("8L AS key", "id", "5L AS component", "1 AS weight"))
    rows = m.in_block_pairs(members, block).toPandas()
    assert set(rows["key"]) == {7}  # a bucket of one component has nothing to compare
    own, others = -(-(n - stragglers) // block), -(-stragglers // block)
    assert len(rows) == (n - stragglers) * others + stragglers * (own + others)
    cells = rows.groupby("id")[["i", "j"]].apply(lambda g: set(map(tuple, g.to_numpy().tolist())))
    for a in range(0, stragglers, 97):
        for b in range(stragglers, n, 1013):
            assert cells[a] & cells[b]
    place = rows.drop_duplicates("id").set_index("id")["block"]
    assert place.value_counts().max() < 1.3 * block


def test_estimate():
    rng = np.random.default_rng(0)
    family = m.hash_family()
    for shared in (0.3, 0.7, 0.9):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 1000).astype(np.uint64)
            y = x.copy()
            n = int(1000 * (1 - shared) / (1 + shared))
            y[:n] = rng.integers(0, 2**63, n).astype(np.uint64)
            a, b = (np.frombuffer(m.packed(m.minima(v, family)), np.uint64) for v in (x, y))
            errors.append(float(m.estimated(a, b)) - (1000 - n) / (1000 + n))
        assert abs(np.mean(errors)) < 0.025
    same = np.frombuffer(m.packed(m.minima(x, family)), np.uint64)
    assert m.estimated(same, same) == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 103), (101, 103), (101, 102), (100, 102)]
    found = components(spark, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100, 103: 100}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, crowded, empty, odd_rows):
    found = m.near_duplicates(spark, odd).collect()
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[1].kept
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 for i in (3, 4, 5))
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    kept = m.dedup_stage(spark, crowded)
    assert kept.columns == crowded.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in [r[0] for r in odd_rows] if i not in (None, 2))
    assert m.near_duplicates(spark, empty).count() == 0
