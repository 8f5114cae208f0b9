import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality_rules as q


def naive(text):
    text = text or ""
    words = [w for w in "".join(" " if c in q.BLANKS else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(q.BLANKS)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in q.SYMBOLS for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_counts_against_naive():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c ", "é#", "\n", "\t", "x$", "a b c a b c ", " "]) for _ in range(rng.randrange(60)))
        assert q.measure_text(text)[:5] == naive(text)
    assert q.measure_text(None)[:5] == (0, 0, 0, 0, 0)


def test_em_finds_rare_kinds_of_junk():
    """Kinds of junk that never meet are all bad, and rare false alarms alone don't make a document bad twice over."""
    rng = np.random.default_rng(3)
    rows = np.ones((5000, 4), int)
    for kind in range(4):
        rows[kind * 100 : kind * 100 + 100, kind] = -1
    rows[rng.random(rows.shape) < 0.1] *= 0
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    share, chance = q.fit_accuracies(patterns, counts)
    good = q.posterior(patterns, share, chance)
    assert 0.88 < share < 0.96
    assert (good[(patterns < 0).any(axis=1)] < 0.5).all() and (good[(patterns >= 0).all(axis=1)] > 0.5).all()
    assert q.fit_accuracies(np.zeros((0, 4), int), np.zeros(0))[0] == 0.5


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = q.op9_query(spark, sf).collect()
    assert {r.doc_id for r in found} == set(texts)
    votes, measures = {}, {}
    for r in found:
        want = naive(texts[r.doc_id])
        assert tuple(r[c] for c in q.COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    # The whole model again, without Spark.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = q.measured(docs).select("doc_id", *[v.alias(k) for k, v in q.rule_votes().items()]).collect()
    patterns = np.array([r[1:] for r in rows])
    unique, at, counts = np.unique(patterns, axis=0, return_inverse=True, return_counts=True)
    good = q.posterior(unique, *q.fit_accuracies(unique, counts))[at.ravel()]
    want = {r.doc_id: p for r, p in zip(rows, good, strict=True)}
    assert all(abs(r.quality_probability - want[r.doc_id]) < 1e-6 and r.kept == (not r.base_failed and want[r.doc_id] >= 0.5) for r in found)


def test_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = q.op9_query(spark, sf).where(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()
    shares = {r.quality: r.share for r in kept}
    assert shares[1] > 0.98 and shares[0] < 0.1


def test_odd_rows(spark, odd, crowded, empty, odd_rows, folder):
    kept = q.filter_stage(crowded)
    assert kept.columns == crowded.columns
    assert {r.doc_id for r in kept.collect()} <= {1, 2, 6, None}
    assert {r["kept"] for r in kept.collect()} <= {"kept"}
    assert q.filter_stage(empty).count() == 0
    sf = folder(documents=crowded)
    found = q.op9_query(spark, sf).collect()
    assert len(found) == len(odd_rows)
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in found if r.doc_id in (3, 4, 5))
