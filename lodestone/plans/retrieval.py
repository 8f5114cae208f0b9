"""Queries of lexical retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, contents
from lodestone.operators import bm25, ireval
from lodestone.registry import query
from lodestone.sources.reuse import reused
from lodestone.sources.sinks import trec_lines
from lodestone.sources.tables import SQL_QRELS, corpus, qrels, topics

SQL_TOKENS = """corpus_v AS (SELECT doc_id, source AS title, text FROM documents),
body AS (SELECT doc_id, trim(coalesce(title, '') || ' ' || coalesce(text, '')) AS contents FROM corpus_v),
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(contents), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM body)"""

SQL_BM25 = f"""{SQL_TOKENS},
dl AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM benchmark) GROUP BY query_id, term),
vt AS (SELECT DISTINCT term FROM qt),
tf AS (SELECT e.term, e.doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) e JOIN vt ON vt.term = e.term GROUP BY e.term, e.doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT q.query_id, t.doc_id, round(sum(q.qtf * ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * t.tf / (t.tf + 0.9 * (1 - 0.4 + 0.4 * d.dl / s.avgdl))), 6) AS score
  FROM qt q JOIN tf t ON t.term = q.term JOIN df f ON f.term = q.term JOIN dl d ON d.doc_id = t.doc_id CROSS JOIN st s GROUP BY q.query_id, t.doc_id),
run_v AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc) WHERE rank <= 100)"""

SQL_EVAL = f"""{SQL_BM25}, {SQL_QRELS},
jr AS (SELECT r.query_id, r.rank, r.doc_id, r.score, greatest(coalesce(q.relevance, 0), 0) AS gain FROM run_v r LEFT JOIN qrels_v q ON q.query_id = r.query_id AND q.doc_id = r.doc_id),
pl AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM qrels_v),
ideal AS (SELECT query_id, CAST(sum(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_relevant,
  sum(CASE WHEN place <= 1 THEN greatest(relevance, 0) / log2(place + 1.0) ELSE 0.0 END) AS ideal_1,
  sum(CASE WHEN place <= 10 THEN greatest(relevance, 0) / log2(place + 1.0) ELSE 0.0 END) AS ideal_10 FROM pl GROUP BY query_id),
pr AS (SELECT *, sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) / CAST(rank AS DOUBLE) AS prec FROM jr),
su AS (SELECT query_id, sum(CASE WHEN rank <= 1 THEN gain / log2(rank + 1.0) ELSE 0.0 END) AS dcg_1, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1.0) ELSE 0.0 END) AS dcg_10,
  sum(CASE WHEN gain > 0 AND rank <= 100 THEN 1 ELSE 0 END) AS found, sum(CASE WHEN gain > 0 THEN prec ELSE 0.0 END) AS precs FROM pr GROUP BY query_id),
ev AS (SELECT s.query_id, CASE WHEN ideal_1 > 0 THEN round(dcg_1 / ideal_1, 6) ELSE 0.0 END AS ndcg_1, CASE WHEN ideal_10 > 0 THEN round(dcg_10 / ideal_10, 6) ELSE 0.0 END AS ndcg_10,
  CASE WHEN n_relevant > 0 THEN round(CAST(found AS DOUBLE) / n_relevant, 6) ELSE 0.0 END AS recall, CASE WHEN n_relevant > 0 THEN round(precs / n_relevant, 6) ELSE 0.0 END AS average_precision
  FROM su s JOIN ideal i ON i.query_id = s.query_id),
rr AS (SELECT query_id, coalesce(round(1.0 / min(CASE WHEN gain > 0 AND rank <= 10 THEN rank END), 6), 0.0) AS value FROM jr GROUP BY query_id)"""


def _keep(spark, sf_dir, *parameters) -> bm25.Keep:
    """Tables made of the corpus, kept by what its file holds."""
    return lambda name, make: reused(spark, name, [f"{sf_dir}/documents.parquet"], parameters, make)


def index_of(spark, sf_dir, analyzer: bm25.Analyzer = bm25.Analyzer()) -> bm25.InvertedIndex:
    """The inverted index of a folder's corpus, written once for what the corpus holds; it serves every query."""
    return bm25.InvertedIndex.build(corpus(spark, sf_dir), analyzer, _keep(spark, sf_dir, analyzer))


def run_of(spark, sf_dir, analyzer: bm25.Analyzer = bm25.Analyzer()) -> DataFrame:
    """The first hits of all topics, written once for what corpus and topics hold."""

    def make() -> DataFrame:
        bounded = index_of(spark, sf_dir, analyzer).bounded(keep=_keep(spark, sf_dir, analyzer))
        return bounded.search(topics(spark, sf_dir))

    return reused(spark, "run", [f"{sf_dir}/{name}.parquet" for name in ("documents", "benchmark")], (analyzer, bm25.K1, bm25.B, bm25.TOP_K), make)


@query("corpus_export", f"WITH {SQL_TOKENS} SELECT doc_id, contents FROM body")
def corpus_export(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", contents("title", "text").alias("contents"))


@query(
    "qrels_merge",
    f"""WITH {SQL_QRELS}, two AS (SELECT query_id, doc_id, relevance, 0 AS src FROM qrels_v UNION ALL SELECT query_id, doc_id, relevance + 1, 1 FROM qrels_v WHERE doc_id % 2 = 0)
SELECT query_id, doc_id, arg_max(relevance, src) AS relevance FROM two GROUP BY query_id, doc_id""",
)
def qrels_merge(spark, sf_dir):
    """Two sources that share pairs: the second repeats those of even documents, one grade higher."""
    first = qrels(spark, sf_dir)
    return ireval.merge_qrels(first, first.where("doc_id % 2 = 0").withColumn("relevance", F.col("relevance") + 1))


@query("qrels_trec_format", f"WITH {SQL_QRELS} SELECT CAST(query_id AS VARCHAR) || chr(9) || '0' || chr(9) || CAST(doc_id AS VARCHAR) || chr(9) || CAST(relevance AS VARCHAR) AS line FROM qrels_v ORDER BY CAST(query_id AS VARCHAR), CAST(doc_id AS VARCHAR)")
def qrels_trec_format(spark, sf_dir):
    return trec_lines(qrels(spark, sf_dir)).orderBy("q", "d").select("line")


@query("bm25_postings", f"WITH {SQL_TOKENS} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY term, doc_id")
def bm25_postings(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("term", "doc_id", "tf")


@query("bm25_doc_stats", f"WITH {SQL_TOKENS} SELECT count(*) AS n, round(avg(len(terms)), 6) AS avgdl FROM tok")
def bm25_doc_stats(spark, sf_dir):
    return bm25.statistics(index_of(spark, sf_dir).lengths).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_scores", f"WITH {SQL_BM25} SELECT query_id, doc_id, score FROM sc")
def bm25_scores(spark, sf_dir):
    return bm25.scores_of(index_of(spark, sf_dir), topics(spark, sf_dir))


SQL_STOPPED = SQL_BM25.replace("lambda t: t <> '')", "lambda t: t NOT IN ('', " + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))")


@query("bm25_stopped_topk", f"WITH {SQL_STOPPED} SELECT query_id, rank, doc_id, score FROM run_v")
def bm25_stopped_topk(spark, sf_dir):
    """The run of an analyzer without English stop words."""
    return run_of(spark, sf_dir, bm25.Analyzer(stop_words=True))


@query("bm25_topk", f"WITH {SQL_BM25} SELECT query_id, rank, doc_id, score FROM run_v")
def bm25_topk(spark, sf_dir):
    return run_of(spark, sf_dir)


@query("run_nested", f"WITH {SQL_BM25} SELECT query_id, string_agg(CAST(doc_id AS VARCHAR) || ':' || printf('%.6f', score), ' ' ORDER BY rank) AS results FROM run_v GROUP BY query_id")
def run_nested(spark, sf_dir):
    """The run as a row for each query; the nested hits are written out as doc_id:score, by rank, so that engines can be compared."""
    nested = run_of(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits"))
    return nested.select("query_id", F.array_join(F.transform("hits", lambda h: F.format_string("%d:%.6f", h["doc_id"], h["score"])), " ").alias("results"))


@query("bm25_english_topk")
def bm25_english_topk(spark, sf_dir):
    """The run of an analyzer that leaves English stop words out and takes stems, as lexical engines do by default."""
    return run_of(spark, sf_dir, bm25.Analyzer(stop_words=True, stems=True))


def _measure(name: str, column: str):
    @query(name, f"WITH {SQL_EVAL} SELECT query_id, {column} AS value FROM ev")
    def run(spark, sf_dir):
        return ireval.per_query(run_of(spark, sf_dir), qrels(spark, sf_dir)).select("query_id", F.col(column).alias("value"))


for _name, _column in (("ndcg_at_1", "ndcg_1"), ("ndcg_at_10", "ndcg_10"), ("recall_at_100", "recall"), ("map_at_100", "average_precision")):
    _measure(_name, _column)


@query("mrr_at_10", f"WITH {SQL_EVAL} SELECT query_id, value FROM rr")
def mrr_at_10(spark, sf_dir):
    return ireval.reciprocal_ranks(run_of(spark, sf_dir), qrels(spark, sf_dir))


SQL_SUMMARY = """SELECT count(*) AS queries, round(avg(ndcg_1), 6) AS ndcg_at_1, round(avg(ndcg_10), 6) AS ndcg_at_10, round(avg(recall), 6) AS recall_at_100, round(avg(average_precision), 6) AS map,
(SELECT round(avg(value), 6) FROM rr) AS mrr_at_10 FROM ev"""


@query("ir_metrics", f"WITH {SQL_EVAL} {SQL_SUMMARY}")
def ir_metrics(spark, sf_dir):
    return ireval.summary(run_of(spark, sf_dir), qrels(spark, sf_dir))


@query("gold_docs", f"WITH {SQL_QRELS} SELECT query_id, doc_id, relevance FROM qrels_v WHERE relevance > 0")
def gold_docs(spark, sf_dir):
    return ireval.gold(qrels(spark, sf_dir))


SQL_GOLD = "gr AS (SELECT r.query_id, r.doc_id, r.rank FROM run_v r JOIN qrels_v q ON q.query_id = r.query_id AND q.doc_id = r.doc_id WHERE q.relevance > 0)"


@query("gold_retrieved", f"WITH {SQL_BM25}, {SQL_QRELS}, {SQL_GOLD} SELECT query_id, doc_id FROM gr")
def gold_retrieved(spark, sf_dir):
    return ireval.gold_retrieved(run_of(spark, sf_dir), qrels(spark, sf_dir)).select("query_id", "doc_id")


@query("gold_bm25_ranks", f"WITH {SQL_BM25}, {SQL_QRELS}, {SQL_GOLD} SELECT query_id, doc_id, rank FROM gr")
def gold_bm25_ranks(spark, sf_dir):
    return ireval.gold_retrieved(run_of(spark, sf_dir), qrels(spark, sf_dir))


@query("missing_gold", f"WITH {SQL_QRELS} SELECT count(*) AS n FROM qrels_v q WHERE relevance > 0 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = q.doc_id)")
def missing_gold(spark, sf_dir):
    return ireval.missing_gold(corpus(spark, sf_dir), qrels(spark, sf_dir))


SQL_STAGE1 = f"""{SQL_BM25}, {SQL_QRELS}, {SQL_GOLD},
s1 AS (SELECT b.item_id AS query_id, b.text AS query_text, coalesce(r.c, 0) AS num_retrieved, coalesce(g.c, 0) AS num_gold, coalesce(x.c, 0) AS num_gold_retrieved,
  CASE WHEN g.c > 0 THEN round(coalesce(x.c, 0) / CAST(g.c AS DOUBLE), 6) END AS recall_at_100 FROM benchmark b
  LEFT JOIN (SELECT query_id, count(*) AS c FROM run_v GROUP BY query_id) r ON r.query_id = b.item_id
  LEFT JOIN (SELECT query_id, count(*) AS c FROM qrels_v WHERE relevance > 0 GROUP BY query_id) g ON g.query_id = b.item_id
  LEFT JOIN (SELECT query_id, count(*) AS c FROM gr GROUP BY query_id) x ON x.query_id = b.item_id)"""


@query("stage1_stats", f"WITH {SQL_STAGE1} SELECT query_id, num_retrieved, num_gold, num_gold_retrieved, recall_at_100 FROM s1")
def stage1_stats(spark, sf_dir):
    return ireval.stage1_stats(topics(spark, sf_dir), run_of(spark, sf_dir), qrels(spark, sf_dir))


@query(
    "rerank_retrieved_docs",
    f"""WITH {SQL_BM25}, {SQL_QRELS} SELECT r.query_id, r.rank, r.doc_id, r.score, c.title, md5(c.text) AS text_md5, coalesce(q.relevance, 0) AS relevance
FROM run_v r JOIN corpus_v c ON c.doc_id = r.doc_id LEFT JOIN qrels_v q ON q.query_id = r.query_id AND q.doc_id = r.doc_id""",
)
def rerank_retrieved_docs(spark, sf_dir):
    found = ireval.retrieved_docs(run_of(spark, sf_dir), corpus(spark, sf_dir), qrels(spark, sf_dir))
    return found.select("query_id", "rank", "doc_id", "score", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), "relevance")


@query(
    "rerank_relevant_docs",
    f"""WITH {SQL_QRELS} SELECT q.query_id, q.doc_id, q.relevance, d.doc_id IS NOT NULL AS corpus_available, d.source AS title, CAST(length(d.text) AS BIGINT) AS text_chars
FROM qrels_v q LEFT JOIN documents d ON d.doc_id = q.doc_id WHERE q.relevance > 0""",
)
def rerank_relevant_docs(spark, sf_dir):
    found = ireval.relevant_docs(corpus(spark, sf_dir), qrels(spark, sf_dir))
    return found.select("query_id", "doc_id", "relevance", "corpus_available", "title", F.length("text").cast("long").alias("text_chars"))


@query(
    "rerank_dataset",
    f"""WITH {SQL_STAGE1} SELECT s.query_id, s.query_text, s.num_retrieved, s.num_gold, s.num_gold_retrieved, s.recall_at_100,
(SELECT string_agg(CAST(r.doc_id AS VARCHAR), ' ' ORDER BY r.rank) FROM run_v r WHERE r.query_id = s.query_id) AS retrieved,
(SELECT string_agg(CAST(q.doc_id AS VARCHAR), ' ' ORDER BY q.doc_id) FROM qrels_v q WHERE q.query_id = s.query_id AND q.relevance > 0) AS relevant,
(SELECT string_agg(CAST(g.doc_id AS VARCHAR) || ':' || CAST(g.rank AS VARCHAR), ' ' ORDER BY g.doc_id) FROM gr g WHERE g.query_id = s.query_id) AS gold_ranks FROM s1 s""",
)
def rerank_dataset(spark, sf_dir):
    """The nested record of every query; lists are shown as their ids, none as null."""
    rows = ireval.rerank_dataset(topics(spark, sf_dir), run_of(spark, sf_dir), qrels(spark, sf_dir), corpus(spark, sf_dir))
    ids = lambda c: F.nullif(F.array_join(F.transform(c, lambda d: d["doc_id"].cast("string")), " "), F.lit(""))
    ranks = F.transform(F.map_entries("stage1_stats.gold_bm25_ranks"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return rows.select(
        "query_id",
        "query_text",
        *[f"stage1_stats.{c}" for c in ("num_retrieved", "num_gold", "num_gold_retrieved", "recall_at_100")],
        ids("retrieved_docs").alias("retrieved"),
        ids("relevant_docs").alias("relevant"),
        F.nullif(F.array_join(ranks, " "), F.lit("")).alias("gold_ranks"),
    )


@query(
    "dataset_summary",
    f"""WITH {SQL_STAGE1} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS queries, (SELECT count(DISTINCT query_id) FROM qrels_v) AS judged_queries, (SELECT count(*) FROM qrels_v) AS pairs,
min(num_retrieved) AS min_candidates, max(num_retrieved) AS max_candidates, CAST(sum(num_retrieved) AS BIGINT) AS candidates, round(avg(num_retrieved), 6) AS mean_candidates, CAST(sum(CASE WHEN num_retrieved < 100 THEN 1 ELSE 0 END) AS BIGINT) AS below_k FROM s1""",
)
def dataset_summary(spark, sf_dir):
    return ireval.dataset_summary(corpus(spark, sf_dir), topics(spark, sf_dir), qrels(spark, sf_dir), run_of(spark, sf_dir))


def pipeline(spark, sf_dir, name: str = "corpus") -> dict[str, DataFrame]:
    """The whole evaluation of a dataset: export, judgements, run, re-ranking records and metrics, as one lazy plan each."""
    docs, queries, judged, run = corpus(spark, sf_dir), topics(spark, sf_dir), qrels(spark, sf_dir), run_of(spark, sf_dir)
    metrics = ireval.summary(run, judged).select(F.lit(name).alias("dataset"), "*")
    return {"corpus": docs.select("doc_id", contents("title", "text").alias("contents")), "queries": queries, "qrels": judged, "run": run, "rerank": ireval.rerank_dataset(queries, run, judged, docs), "metrics": metrics}


@query("ir_pipeline", f"WITH {SQL_EVAL} SELECT 'corpus' AS dataset, m.* FROM ({SQL_SUMMARY}) m")
def ir_pipeline(spark, sf_dir):
    return pipeline(spark, sf_dir)["metrics"]
