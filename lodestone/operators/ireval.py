"""Ranking quality and the re-ranking dataset: run (query_id, rank, doc_id, score) against qrels (query_id, doc_id, relevance).

Means of nDCG, recall and precision go over queries that are in both run and qrels; the reciprocal rank goes over every query
of the run. Gains are linear, negative grades count as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with gain: the grade of the document, 0 where it is unjudged or below."""
    return run.join(qrels, ["query_id", "doc_id"], "left").withColumn("gain", F.greatest(F.coalesce("relevance", F.lit(0)), F.lit(0)).cast("long"))


def ideal(qrels: DataFrame, depths: tuple[int, ...] = (1, 10)) -> DataFrame:
    """query_id, n_relevant, and ideal_<depth> for each depth: discounted gain of the best order of all judged documents."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    placed = qrels.withColumn("place", F.row_number().over(order))
    best = F.greatest("relevance", F.lit(0)) / F.log2(F.col("place") + 1.0)
    return placed.groupBy("query_id").agg(
        F.count_if(F.col("relevance") > 0).alias("n_relevant"),
        *[F.sum(F.when(F.col("place") <= d, best).otherwise(0.0)).alias(f"ideal_{d}") for d in depths],
    )


def over(value: Column, by: Column) -> Column:
    return F.when(by > 0, F.round(value / by, DIGITS)).otherwise(F.lit(0.0))


def per_query(run: DataFrame, qrels: DataFrame, recall_depth: int = 100) -> DataFrame:
    """query_id, ndcg_1, ndcg_10, recall, average_precision of the queries in both; one shuffle of the judged run by query."""
    hits = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (F.col("gain") > 0).cast("long")
    scored = judged_run(run, qrels).withColumn("precision", F.sum(hit).over(hits) / F.col("rank"))
    discounted = F.col("gain") / F.log2(F.col("rank") + 1.0)
    sums = scored.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 1, discounted).otherwise(0.0)).alias("dcg_1"),
        F.sum(F.when(F.col("rank") <= 10, discounted).otherwise(0.0)).alias("dcg_10"),
        F.count_if((F.col("gain") > 0) & (F.col("rank") <= recall_depth)).alias("found"),
        F.sum(F.when(F.col("gain") > 0, F.col("precision")).otherwise(0.0)).alias("precisions"),
    )
    both = sums.join(ideal(qrels), "query_id")
    return both.select(
        "query_id",
        over(F.col("dcg_1"), F.col("ideal_1")).alias("ndcg_1"),
        over(F.col("dcg_10"), F.col("ideal_10")).alias("ndcg_10"),
        over(F.col("found"), F.col("n_relevant")).alias("recall"),
        over(F.col("precisions"), F.col("n_relevant")).alias("average_precision"),
    )


def reciprocal_ranks(run: DataFrame, qrels: DataFrame, depth: int = 10) -> DataFrame:
    """query_id, value for every query of the run: one over the rank of its first relevant hit, 0 without one."""
    first = F.min(F.when((F.col("gain") > 0) & (F.col("rank") <= depth), F.col("rank")))
    return judged_run(run, qrels).groupBy("query_id").agg(F.coalesce(F.round(1 / first, DIGITS), F.lit(0.0)).alias("value"))


def summary(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: scored queries and the five means."""
    scored = per_query(run, qrels).agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), DIGITS).alias(n) for c, n in (("ndcg_1", "ndcg_at_1"), ("ndcg_10", "ndcg_at_10"), ("recall", "recall_at_100"), ("average_precision", "map"))]
    )
    return scored.crossJoin(reciprocal_ranks(run, qrels).agg(F.round(F.avg("value"), DIGITS).alias("mrr_at_10")))  # a row each


def gold(qrels: DataFrame) -> DataFrame:
    return qrels.where("relevance > 0")


def gold_retrieved(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, doc_id, rank of relevant documents in the run."""
    return run.join(gold(qrels).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "rank")


def stage1_stats(queries: DataFrame, run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Counts for every query; recall is null, not 0, where nothing is relevant."""
    retrieved = run.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_retrieved"))
    relevant = gold(qrels).groupBy("query_id").agg(F.count(F.lit(1)).alias("num_gold"))
    both = gold_retrieved(run, qrels).groupBy("query_id").agg(F.count(F.lit(1)).alias("num_gold_retrieved"))
    rows = queries.select("query_id").join(retrieved, "query_id", "left").join(relevant, "query_id", "left").join(both, "query_id", "left")
    rows = rows.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num_retrieved", "num_gold", "num_gold_retrieved")])
    return rows.withColumn("recall_at_100", F.when(F.col("num_gold") > 0, F.round(F.col("num_gold_retrieved") / F.col("num_gold"), DIGITS)))


def retrieved_docs(run: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with title, text and relevance (0 where unjudged). A hit that the corpus lacks is an error."""
    joined = run.join(corpus.withColumn("__here", F.lit(True)), "doc_id", "left").withColumn("__here", F.coalesce("__here", F.raise_error(F.concat(F.lit("not in the corpus: "), F.col("doc_id").cast("string"))).cast("boolean")))
    return joined.join(qrels, ["query_id", "doc_id"], "left").where("__here").select("query_id", "rank", "doc_id", "score", "title", "text", F.coalesce("relevance", F.lit(0)).cast("long").alias("relevance"))


def relevant_docs(corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevant pairs with title and text, null where the corpus lacks the document."""
    return gold(qrels).join(corpus.withColumn("__here", F.lit(True)), "doc_id", "left").select("query_id", "doc_id", "relevance", F.coalesce("__here", F.lit(False)).alias("corpus_available"), "title", "text")


def missing_gold(corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    return gold(qrels).join(corpus.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def rerank_dataset(queries: DataFrame, run: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """A row for every query: nested hits in rank order, nested relevant documents, counts, and ranks of relevant hits."""
    hits = retrieved_docs(run, corpus, qrels).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "title", "text", "relevance"))).alias("retrieved_docs"))
    wanted = relevant_docs(corpus, qrels).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "relevance", "corpus_available", "title", "text"))).alias("relevant_docs"))
    ranks = gold_retrieved(run, qrels).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "rank")))).alias("gold_bm25_ranks"))
    rows = queries.join(hits, "query_id", "left").join(wanted, "query_id", "left").join(stage1_stats(queries, run, qrels), "query_id").join(ranks, "query_id", "left")
    kinds = dict(rows.dtypes)
    return rows.select(
        "query_id",
        "query_text",
        *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("retrieved_docs", "relevant_docs")],
        F.struct("num_retrieved", "num_gold", "num_gold_retrieved", "recall_at_100", F.coalesce("gold_bm25_ranks", F.create_map().cast(kinds["gold_bm25_ranks"])).alias("gold_bm25_ranks")).alias("stage1_stats"),
    )


def merge_qrels(*sources: DataFrame) -> DataFrame:
    """Judgements of several datasets; of a pair that more than one has, the last source's grade stays."""
    tagged = [s.select("query_id", "doc_id", "relevance", F.lit(n).alias("__source")) for n, s in enumerate(sources)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    return merged.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "__source").alias("relevance"))


def dataset_summary(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, run: DataFrame, k: int = 100) -> DataFrame:
    """One row of sizes; candidate counts go over every query, also those without hits."""
    counts = queries.select("query_id").join(run.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")), "query_id", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    parts = [
        corpus.agg(F.count(F.lit(1)).alias("documents")),
        queries.agg(F.count(F.lit(1)).alias("queries")),
        qrels.agg(F.countDistinct("query_id").alias("judged_queries"), F.count(F.lit(1)).alias("pairs")),
        counts.agg(F.min("c").alias("min_candidates"), F.max("c").alias("max_candidates"), F.sum("c").alias("candidates"), F.round(F.avg("c"), DIGITS).alias("mean_candidates"), F.count_if(F.col("c") < k).alias("below_k")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # a row each
    return out
