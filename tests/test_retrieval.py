"""Ranking measures on hand-made runs, and BM25 by its formula."""

import math
import random
from collections import Counter

import pytest

from lodestone.operators import bm25, ireval
from lodestone.plans import retrieval
from lodestone.sources import reuse, sinks

RUN = "query_id long, rank long, doc_id long, score double"
QRELS = "query_id long, doc_id long, relevance long"


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame([(1, 1, 10, 3.0), (1, 2, 11, 2.0), (1, 3, 12, 1.0), (2, 1, 20, 1.0), (3, 1, 30, 1.0), (4, 1, 40, 1.0)], RUN)


@pytest.fixture(scope="module")
def qrels(spark):
    """Query 1: grades, a relevant document missing from the run; 2: zero grades alone; 3: unjudged; 5: judged but without hits; a negative grade."""
    return spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 99, 1), (2, 20, 0), (4, 40, -1), (4, 41, 1), (5, 50, 1)], QRELS)


def test_per_query(run, qrels):
    found = {r.query_id: r for r in ireval.per_query(run, qrels).collect()}
    assert set(found) == {1, 2, 4}
    ideal = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert found[1].ndcg_1 == 0 and found[1].ndcg_10 == round((2 / math.log2(3) + 1 / math.log2(4)) / ideal, 6)
    assert found[1].recall == round(2 / 3, 6) and found[1].average_precision == round((1 / 2 + 2 / 3) / 3, 6)
    assert (found[2].ndcg_10, found[2].recall, found[2].average_precision) == (0, 0, 0)
    assert (found[4].ndcg_10, found[4].recall) == (0, 0)


def test_reciprocal_ranks_go_over_every_query_of_the_run(run, qrels):
    assert {r.query_id: r.value for r in ireval.reciprocal_ranks(run, qrels).collect()} == {1: 0.5, 2: 0, 3: 0, 4: 0}
    row = ireval.summary(run, qrels).first()
    assert row.queries == 3 and row.mrr_at_10 == 0.125


def test_stage1_recall_is_null_without_gold(spark, run, qrels):
    queries = spark.createDataFrame([(k, f"q{k}") for k in range(1, 7)], "query_id long, query_text string")
    found = {r.query_id: tuple(r)[1:] for r in ireval.stage1_stats(queries, run, qrels).collect()}
    assert found == {1: (3, 3, 2, round(2 / 3, 6)), 2: (1, 0, 0, None), 3: (1, 0, 0, None), 4: (1, 1, 0, 0.0), 5: (0, 1, 0, 0.0), 6: (0, 0, 0, None)}


def test_rerank_dataset(spark, run, qrels, tmp_path):
    corpus = spark.createDataFrame([(k, "t", f"text {k}") for k in (10, 11, 12, 20, 30, 40, 41, 50)], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(k, f"q{k}") for k in range(1, 7)], "query_id long, query_text string")
    rows = {r.query_id: r for r in ireval.rerank_dataset(queries, run, qrels, corpus).collect()}
    assert len(rows) == 6 and [d.doc_id for d in rows[1].retrieved_docs] == [10, 11, 12] and rows[6].retrieved_docs == []
    assert [(d.doc_id, d.corpus_available, d.text) for d in rows[1].relevant_docs] == [(11, True, "text 11"), (12, True, "text 12"), (99, False, None)]
    assert rows[1].stage1_stats.gold_bm25_ranks == {11: 2, 12: 3} and rows[2].stage1_stats.gold_bm25_ranks == {}
    assert ireval.missing_gold(corpus, qrels).first().n == 1
    sinks.write_jsonl(ireval.rerank_dataset(queries, run, qrels, corpus), f"{tmp_path}/out")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert '"text":null' in text and '"recall_at_100":null' in text
    with pytest.raises(Exception, match="not in the corpus"):
        ireval.retrieved_docs(run, corpus.where("doc_id <> 10"), qrels).collect()


def test_merge_keeps_the_last(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], QRELS)
    b = spark.createDataFrame([(1, 2, 0), (2, 1, 2)], QRELS)
    assert {(r.query_id, r.doc_id): r.relevance for r in ireval.merge_qrels(a, b).collect()} == {(1, 1): 1, (1, 2): 0, (2, 1): 2}


def test_bm25_formula(spark):
    corpus = spark.createDataFrame([(1, "Red fox", "the fox"), (2, None, "a dog"), (3, "", None)], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(7, "fox, FOX dog?"), (8, "none"), (9, None)], "query_id long, query_text string")
    found = {(r.query_id, r.doc_id): r.score for r in bm25.scores(corpus, queries).collect()}
    idf, avgdl = math.log(1 + (3 - 1 + 0.5) / 1.5), 6 / 3
    assert found == {(7, 1): round(2 * idf * 2 / (2 + 0.9 * (0.6 + 0.4 * 4 / avgdl)), 6), (7, 2): round(idf / (1 + 0.9 * (0.6 + 0.4 * 2 / avgdl)), 6)}
    assert [(r["rank"], r.doc_id) for r in bm25.topk(bm25.scores(corpus, queries), 1).collect()] == [(1, 1)]


def rows_of(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_index_is_kept(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame([(k, f"title {k % 3}", "the running dogs " * (k % 4) + f"of word{k}") for k in range(40)], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(1, "the runs of dogs"), (2, "word7 title"), (3, None)], "query_id long, query_text string")
    plain = bm25.InvertedIndex.build(corpus).save(f"{tmp_path}/plain")
    found = rows_of(plain.search(queries, 5))
    assert found == rows_of(bm25.InvertedIndex.load(spark, f"{tmp_path}/plain").search(queries, 5)) == rows_of(bm25.topk(bm25.scores(corpus, queries), 5))
    # Weights beyond the limit are joined and not sent: the same rows.
    monkeypatch.setattr(bm25, "WEIGHTS", 0)
    assert found == rows_of(bm25.topk(bm25.scores(corpus, queries), 5))
    english = bm25.InvertedIndex.build(corpus, bm25.Analyzer(stop_words=True, stems=True)).save(f"{tmp_path}/english")
    assert bm25.InvertedIndex.load(spark, f"{tmp_path}/english").analyzer == bm25.Analyzer(True, True)
    terms = {r.term for r in english.postings.collect()}
    assert {"run", "dog", "titl"} <= terms and not {"the", "of", "running", "dogs"} & terms
    found = english.search(queries).collect()
    assert {r.query_id for r in found} == {1, 2} and sum(r.query_id == 1 for r in found) == 30  # the 30 documents with dogs


def test_odd_terms(spark):
    """Quotes and backslashes in queries, documents without terms, queries without known terms."""
    corpus = spark.createDataFrame([(1, None, "it's a\\b 'c'"), (2, "", ""), (3, None, None)], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(1, "it's a\\b"), (2, "'"), (3, "none")], "query_id long, query_text string")
    index = bm25.InvertedIndex.build(corpus)
    assert [(r.query_id, r.doc_id) for r in index.search(queries).collect()] == [(1, 1)]
    nothing = bm25.InvertedIndex.build(corpus.where("false"))
    assert nothing.search(queries).count() == 0 and index.search(queries.where("false")).count() == 0


def wordy(spark, docs=600, queries=12, seed=1):
    """Documents of many lengths over words of a long tail, with copies that tie."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 200))) for _ in range(docs)]
    texts += texts[:40] * 3
    corpus = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "doc_id long, title string, text string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(queries)], "query_id long, query_text string")
    return corpus, asked


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_bounds_lose_no_hit(spark, k):
    """The same hits as scoring everything: with ties at the last place, and where a query has fewer than k."""
    corpus, queries = wordy(spark)
    index = bm25.InvertedIndex.build(corpus)
    assert rows_of(index.search(queries, k)) == rows_of(bm25.topk(bm25.scores_of(index, queries), k))


def test_bounds_skip_most_pairs(spark):
    """Of the pairs of query and document with a common term, less than a third are scored, opening and survivors together."""
    sf = "/root/testdata/sf0.1"
    index = retrieval.index_of(spark, sf)
    topics = retrieval.topics(spark, sf)
    found = index.bounded().candidates(topics, bm25.TOP_K)
    scored = found.opening.count() + found.survivors.count()
    every = bm25.scores_of(index, topics)
    assert 0 < scored < every.count() / 3
    assert rows_of(bm25.topk(found.scores())) == rows_of(bm25.topk(every))


def test_reused_by_content(spark, tmp_path):
    """A second call builds nothing; a changed table, other parameters or another name do."""
    path, built = f"{tmp_path}/t", []

    def make():
        built.append(1)
        return spark.read.parquet(path).selectExpr("sum(id) AS s")

    spark.range(3).write.parquet(path)
    ask = lambda name="sum", parameters=1: reuse.reused(spark, name, [path], parameters, make).first().s
    assert (ask(), ask(), len(built)) == (3, 3, 1)
    assert ask(parameters=2) == 3 and ask(name="other") == 3 and len(built) == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert (ask(), ask(), len(built)) == (10, 10, 4)


def test_queries_see_changed_tables(spark, tmp_path):
    """A folder whose documents or topics change gives other hits to the queries that keep an index and a run."""
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    ask = lambda: [(r.query_id, r.doc_id) for r in retrieval.bm25_topk(spark, str(tmp_path)).collect()]
    docs, items = "doc_id long, source string, text string", "item_id long, text string"
    write("documents", [(1, "a", "red fox")], docs)
    write("benchmark", [(7, "fox")], items)
    assert ask() == [(7, 1)]
    write("documents", [(1, "a", "red dog"), (2, "a", "blue fox")], docs)
    assert ask() == [(7, 2)]
    write("benchmark", [(8, "dog")], items)
    assert ask() == [(8, 1)]


def test_stems():
    from lodestone.functions.stemming import stem

    pairs = (
        "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl "
        "hopping hop falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration "
        "digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form formalize formal "
        "electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt "
        "communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
    ).split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem(word) == want, word
    assert [stem(w) for w in ("is", "é", "naïve", "1990s", "")] == ["is", "é", "naïve", "1990s", ""]


def test_english_run_by_definition(spark):
    """The registered run with stop words and stems against scores written out."""
    import regex

    from lodestone.functions.stemming import stem
    from lodestone.functions.text import STOP_WORDS

    sf = "/root/testdata/sf0.001"
    terms = lambda text: [stem(t) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t and t not in STOP_WORDS]
    docs = {r.doc_id: Counter(terms(f"{r.source or ''} {r.text or ''}")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lengths = {d: sum(c.values()) for d, c in docs.items()}
    df, avgdl = Counter(t for c in docs.values() for t in c), sum(lengths.values()) / len(docs)
    found = {}
    for r in retrieval.bm25_english_topk(spark, sf).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert set(found) == {r.item_id for r in asked}
    for r in asked:
        scores = Counter()
        for t, qtf in Counter(terms(r.text)).items():
            for d, c in docs.items():
                if c[t]:
                    scores[d] += qtf * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] / (c[t] + 0.9 * (0.6 + 0.4 * lengths[d] / avgdl))
        got = [found[r.item_id][k + 1] for k in range(len(found[r.item_id]))]
        assert len(got) == min(100, len(scores)) and all(abs(scores[d] - s) < 1e-5 for d, s in got)
        assert got[-1][1] >= sorted(scores.values(), reverse=True)[len(got) - 1] - 1e-5


def test_queries_with_their_split(spark, tmp_path):
    import json

    queries = spark.createDataFrame([(1, "é?"), (2, None)], "query_id long, query_text string")
    sinks.write_queries(queries, f"{tmp_path}/q", "test")
    sinks.write_queries(queries, f"{tmp_path}/plain")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/q").collect())
    assert [json.loads(x) for x in lines] == [{"query_id": "1", "query_text": "é?", "split": "test"}, {"query_id": "2", "query_text": None, "split": "test"}]
    assert "split" not in spark.read.json(f"{tmp_path}/plain").columns


def test_sinks(spark, qrels, tmp_path):
    sinks.write_trec_qrels(qrels, f"{tmp_path}/qrels")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/qrels").collect()]
    assert sorted(lines)[0] == "1\t0\t11\t2" and len(lines) == 7
    assert not sinks.exists(spark, f"{tmp_path}/table")
    assert sinks.once(spark, qrels, f"{tmp_path}/table").count() == 7
    assert sinks.exists(spark, f"{tmp_path}/table") and sinks.once(spark, qrels.where("false"), f"{tmp_path}/table").count() == 7
    assert sinks.size_bytes(spark, f"{tmp_path}/table") > 0
    sinks.write_metrics_csv(qrels.limit(1), f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").columns == ["query_id", "doc_id", "relevance"]
