import random

import numpy as np

from lodestone.llm import decontaminate as d


def naive_tiles(text, pattern, least):
    """Greedy string tiling by its definition: the longest unmarked match again and again."""
    t, p, covered = [x if x else None for x in text], list(pattern), 0
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(p)):
            for i in range(len(t)):
                n = 0
                while i + n < len(t) and j + n < len(p) and t[i + n] is not None and t[i + n] == p[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        t[i : i + n], p[j : j + n], covered = [None] * n, [-1] * n, covered + n


def test_tiles_against_naive():
    rng = random.Random(2)
    for _ in range(400):
        pattern = np.array([rng.randrange(1, 8) for _ in range(rng.randrange(1, 25))])
        text = np.array([rng.randrange(0, 8) for _ in range(rng.randrange(0, 40))] + pattern[rng.randrange(len(pattern)) :].tolist())
        tiles = d.greedy_tiles(text, pattern, 3)
        assert all((text[i : i + n] == pattern[j : j + n]).all() and n >= 3 for i, j, n in tiles)
        marked = [k for _, j, n in tiles for k in range(j, j + n)]
        assert len(marked) == len(set(marked))
        # Equally long matches may be taken in another order, which can change what is left over by a little.
        assert abs(len(marked) - naive_tiles(text, pattern, 3)) <= 4


def test_reordered_and_clean(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    item = [word() for _ in range(40)]
    parts = [item[k : k + 8] for k in range(0, 40, 8)]
    rng.shuffle(parts)
    filler = lambda n: [word() for _ in range(n)]
    docs = [
        (1, " ".join(filler(200) + item + filler(200))),
        (2, " ".join(w.upper() + "," for p in parts for w in p + filler(3))),
        (3, " ".join(filler(500))),
        (4, " ".join(filler(50) + item[:10] + filler(50))),
        (5, None),
        (6, ""),
    ]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(item)), (12, "w1"), (13, None)], "item_id long, text string")
    found = d.leaks(spark, docs_df, items).collect()
    # Item 12 is one word: it is reported where that word stands, and nowhere else.
    short = [(k, 12) for k, text in docs if text and "w1" in text.lower().replace(",", "").split()]
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted([(1, 10), (1, 11), (2, 10), (2, 11), *short])
    long_items = items.where("item_id <> 12")
    assert sorted(r.doc_id for r in d.filter_stage(spark, docs_df, long_items).collect()) == [3, 4, 5, 6]
    assert sorted(r.doc_id for r in d.filter_stage(spark, docs_df, items).collect()) == sorted({3, 4, 5, 6} - {k for k, _ in short})


def test_long_verbatim_part(spark):
    """35 of 100 words in one piece leak, in five pieces they don't."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    item = [word() for _ in range(100)]
    whole = [word() for _ in range(30)] + item[20:55] + [word() for _ in range(30)]
    parts = [w for k in range(0, 35, 7) for w in item[20 + k : 27 + k] + [word(), word()]]
    docs = spark.createDataFrame([(1, " ".join(whole)), (2, " ".join(parts))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.covered, r.tiles) for r in d.leaks(spark, docs, items).collect()] == [(1, 5, 35, 1)]


def test_short_items_are_matched_whole(spark):
    """Items of one to four words leak where they stand verbatim, in short documents as well, and not in parts or another order."""
    items = spark.createDataFrame([(1, "Zorv quen tal"), (2, "quen"), (3, "tal, zorv"), (None, "a b c d"), (5, "?!"), (6, "zorv quen tal")], "item_id long, text string")
    docs = [(1, "zorv QUEN tal"), (2, "it says: zorv, quen; tal! and " + "more " * 30), (3, "zorv tal quen"), (4, "tal zorv"), (5, "a b c"), (6, "x a b c d"), (7, "other words alone"), (8, "zorv quen"), (9, None)]
    for grams in (1, 1000):
        found = d.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), items, grams=grams).collect()
        want = {(1, 1, 3), (1, 2, 1), (1, 6, 3), (2, 1, 3), (2, 2, 1), (2, 6, 3), (3, 2, 1), (4, 3, 2), (6, None, 4), (8, 2, 1)}
        assert {(r.doc_id, r.item_id, r.covered) for r in found} == want and len(found) == len(want) and all(r.tiles == 1 for r in found)
    assert sorted(r.doc_id for r in d.filter_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), items).collect()) == [5, 7, 9]


def test_blocks_of_items(spark):
    items = spark.createDataFrame([(k, " ".join(f"t{k}x{j}" for j in range(12))) for k in range(10)], "item_id long, text string")
    docs = items.selectExpr("item_id + 100 AS doc_id", "text")
    assert len(list(d.blocks(items, 1))) == 10
    found = d.leaks(spark, docs, items, grams=1)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(k + 100, k) for k in range(10)]
    # Ten blocks are one Python stage, and none is evaluated twice.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    kept = d.filter_stage(spark, docs, items, grams=1)
    assert kept.count() == 0
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_query_on_odd_rows(spark, crowded, empty, folder):
    """Null, empty and repeated documents in the query itself: a row for each document and item."""
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (None, "the cat sat on the mat and looked at the dog"), (3, None)], "item_id long, text string")
    found = d.op4_query(spark, folder(documents=crowded.drop("a.b"), benchmark=items)).collect()
    rows = lambda i: [(r.doc_id, r.item_id) for r in found if r.item_id == i]
    assert sorted(rows(1), key=str) == sorted([(1, 1), (1, 1), (2, 1), (None, 1)], key=str) and len(rows(None)) == 4 and len(found) == 8
    assert all(r.coverage == 1.0 for r in found)
    assert d.leaks(spark, empty, items).count() == 0


def test_query_finds_verbatim_items(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    whole = {(r.doc_id, b.item_id) for r in docs for b in items if b.text in r.text}
    found = {(r.doc_id, r.item_id) for r in d.op4_query(spark, sf).collect()}
    assert whole <= found and len(found) <= len(whole) + 3


def test_odd_rows(spark, odd, crowded, empty):
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked")], "item_id long, text string")
    kept = d.filter_stage(spark, crowded, items)
    assert kept.columns == crowded.columns
    assert kept.count() == 14 - 4
    assert d.filter_stage(spark, empty, items).count() == 0
    assert d.filter_stage(spark, odd, items.where("false")).count() == 14
