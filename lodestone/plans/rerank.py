"""Queries of the re-ranking text layer: passages, prompts, and permutations read from generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.permutations import applied, parsed, scraped
from lodestone.functions.prompts import FINAL, INTRO, INTRO_COMPACT, READY, SYSTEM, compact_messages, paper_messages
from lodestone.functions.text import passage, truncated
from lodestone.plans.retrieval import SQL_BM25, run_of
from lodestone.registry import query
from lodestone.sources.tables import corpus, topics

#: Hits that are ranked anew, a window of the usual size.
DEPTH = 20
WORDS = 300

#: Generated texts with the number of passages they rank (fixed values: the cases a parser has to get right).
CASES: list[tuple[str | None, int]] = [
    ("[3] > [1] > [2]", 3),
    ("[1] > [2] > [3]", 3),
    (" > ".join(f"[{k}]" for k in range(20, 0, -1)), 20),
    ("[1] > [1] > [2] > [3]", 3),
    ("[5] > [1] > [2] > [3]", 3),
    ("[0] > [2] > [1] > [3]", 3),
    ("[2]", 3),
    ("By relevance I would order them [2] > [1] > [3], as asked.", 3),
    ("Of the 10 candidates, these come first: [3] > [1] > [2]", 3),
    ("2 > 1 > 3", 3),
    ("[3]\n[1]\n[2]", 3),
    ("[ 3 ] > [ 1 ] > [ 2 ]", 3),
    ("", 5),
    ("   ", 5),
    ("No order can be given.", 5),
    (None, 5),
    ("[1] > [1] > [99] > banana", 20),
    ("[99]", 3),
    ("[01] > [1] > [2]", 2),
    ("[7] > [7] > [1]", 2),
    ("[99999999999999999999] > [2] > [1]", 2),
]


def _literal(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_CASES = "cases AS (" + " UNION ALL ".join(f"SELECT {k} AS case_id, {_literal(t)} AS raw_text, {n} AS num" for k, (t, n) in enumerate(CASES)) + ")"
SQL_RESPONSES = f"""{SQL_BM25}, {SQL_CASES},
resp AS (SELECT b.item_id AS case_id, c.raw_text, x.num FROM benchmark b JOIN cases c ON c.case_id = b.item_id % {len(CASES)}
  JOIN (SELECT query_id, count(*) AS num FROM run_v WHERE rank <= {DEPTH} GROUP BY query_id) x ON x.query_id = b.item_id)"""


def _sql_parse(source: str) -> str:
    return f"""br AS (SELECT case_id, num, regexp_extract_all(coalesce(raw_text, ''), '\\[\\s*(\\d+)\\s*\\]', 1) AS b, regexp_extract_all(coalesce(raw_text, ''), '\\d+') AS i FROM {source}),
ids AS (SELECT case_id, num, CASE WHEN len(b) > 0 THEN b ELSE i END AS ids, CASE WHEN len(b) > 0 THEN 'bracket' WHEN len(i) > 0 THEN 'bare_int' ELSE 'none' END AS strategy FROM br),
ex AS (SELECT case_id, num, k AS pos, CAST(ids[k] AS HUGEINT) AS id FROM ids, range(1, 100) r(k) WHERE k <= len(ids)),
fi AS (SELECT case_id, num, id, min(pos) AS pos FROM ex GROUP BY case_id, num, id),
od AS (SELECT s.case_id, s.num, k AS id, f.pos, row_number() OVER (PARTITION BY s.case_id ORDER BY CASE WHEN f.pos IS NULL THEN 1000 + k ELSE f.pos END) AS llm_rank
  FROM {source} s JOIN range(1, 100) r(k) ON k <= s.num LEFT JOIN fi f ON f.case_id = s.case_id AND f.id = k),
pc AS (SELECT i.case_id, i.num, i.strategy, len(i.ids) AS n_ids,
  len(i.ids) - (SELECT count(*) FROM fi WHERE fi.case_id = i.case_id) AS n_duplicates,
  (SELECT count(*) FROM fi WHERE fi.case_id = i.case_id AND (fi.id < 1 OR fi.id > i.num)) AS n_out_of_range,
  (SELECT count(*) FROM od WHERE od.case_id = i.case_id AND od.pos IS NULL) AS n_missing FROM ids i)"""


SQL_PARSED = """SELECT case_id, CAST(num AS BIGINT) AS num, strategy, CAST(n_ids AS BIGINT) AS n_identifiers_parsed, CAST(n_duplicates AS BIGINT) AS n_duplicates, CAST(n_out_of_range AS BIGINT) AS n_out_of_range,
CAST(n_missing AS BIGINT) AS n_missing, n_duplicates = 0 AND n_out_of_range = 0 AND n_missing = 0 AND strategy = 'bracket' AS is_clean, n_ids = 0 AS is_total_failure FROM pc"""
COUNTERS = ("num", "n_identifiers_parsed", "n_duplicates", "n_out_of_range", "n_missing")


def cases(spark):
    return spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(CASES)], "case_id int, raw_text string, num int")


def responses(spark, sf_dir):
    """A generated text for every query with hits: query_id, query_text, docs (nested first hits), raw_text, num."""
    hits = run_of(spark, sf_dir).where(F.col("rank") <= DEPTH).join(corpus(spark, sf_dir), "doc_id")
    nested = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "title", "text"))).alias("docs"))
    texts = F.broadcast(cases(spark).select("case_id", "raw_text"))  # a fixed list
    rows = topics(spark, sf_dir).join(nested, "query_id").withColumn("case_id", (F.col("query_id") % len(CASES)).cast("int"))
    return rows.join(texts, "case_id").select("query_id", "query_text", "docs", "raw_text", F.size("docs").alias("num"))


@query(
    "truncate_words",
    "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{A0}]+'), lambda w: w <> '')[1:20], ' ') AS words FROM documents",
)
def truncate_words(spark, sf_dir, n: int = 20):
    return corpus(spark, sf_dir).select("doc_id", truncated("text", n).alias("words"))


@query(
    "format_passage",
    f"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(coalesce(source, '')) || ' ' || trim(coalesce(text, '')), '[\\s\\x{{A0}}]+'), lambda w: w <> '')[1:{WORDS}], ' ')) AS passage_md5 FROM documents",
)
def format_passage(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.md5(passage(F.col("title"), F.col("text"), WORDS).cast("binary")).alias("passage_md5"))


def _sql_fill(template: str) -> str:
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, column in (("n", "CAST(n.num AS VARCHAR)"), ("q", "b.text"), ("i", "CAST(rank AS VARCHAR)")):
        text = text.replace("{" + name + "}", f"' || {column} || '")
    return text


SQL_PASSAGES = f"""pa AS (SELECT r.query_id, r.rank, '[' || CAST(r.rank AS VARCHAR) || '] ' || array_to_string(list_filter(regexp_split_to_array(trim(coalesce(c.title, '')) || ' ' || trim(coalesce(c.text, '')), '[\\s\\x{{A0}}]+'), lambda w: w <> '')[1:{WORDS}], ' ') AS p
  FROM run_v r JOIN corpus_v c ON c.doc_id = r.doc_id WHERE r.rank <= {DEPTH}),
n AS (SELECT query_id, count(*) AS num FROM pa GROUP BY query_id)"""


@query(
    "prompt_paper",
    f"""WITH {SQL_BM25}, {SQL_PASSAGES}, m AS (
SELECT n.query_id, 0 AS turn, 'system' AS role, {_sql_fill(SYSTEM)} AS content FROM n JOIN benchmark b ON b.item_id = n.query_id
UNION ALL SELECT n.query_id, 1, 'user', {_sql_fill(INTRO)} FROM n JOIN benchmark b ON b.item_id = n.query_id
UNION ALL SELECT n.query_id, 2, 'assistant', {_sql_fill(READY)} FROM n JOIN benchmark b ON b.item_id = n.query_id
UNION ALL SELECT query_id, 1 + 2 * rank, 'user', p FROM pa
UNION ALL SELECT query_id, 2 + 2 * rank, 'assistant', 'Received passage [' || CAST(rank AS VARCHAR) || '].' FROM pa
UNION ALL SELECT n.query_id, 3 + 2 * n.num, 'user', {_sql_fill(FINAL)} FROM n JOIN benchmark b ON b.item_id = n.query_id)
SELECT query_id, CAST(turn AS BIGINT) AS turn, role, md5(content) AS content_md5 FROM m""",
)
def prompt_paper(spark, sf_dir):
    rows = responses(spark, sf_dir).select("query_id", F.posexplode(paper_messages(F.col("query_text"), F.col("docs"), WORDS)).alias("turn", "m"))
    return rows.select("query_id", F.col("turn").cast("long").alias("turn"), "m.role", F.md5(F.col("m.content").cast("binary")).alias("content_md5"))


@query(
    "prompt_compact",
    f"""WITH {SQL_BM25}, {SQL_PASSAGES}, j AS (SELECT query_id, string_agg(p, chr(10) || chr(10) ORDER BY rank) AS body FROM pa GROUP BY query_id), m AS (
SELECT n.query_id, 0 AS turn, 'system' AS role, {_sql_fill(SYSTEM)} AS content FROM n JOIN benchmark b ON b.item_id = n.query_id
UNION ALL SELECT n.query_id, 1, 'user', {_sql_fill(INTRO_COMPACT)} || j.body || chr(10) || chr(10) || {_sql_fill(FINAL)} FROM n JOIN benchmark b ON b.item_id = n.query_id JOIN j ON j.query_id = n.query_id)
SELECT query_id, CAST(turn AS BIGINT) AS turn, role, md5(content) AS content_md5 FROM m""",
)
def prompt_compact(spark, sf_dir):
    rows = responses(spark, sf_dir).select("query_id", F.posexplode(compact_messages(F.col("query_text"), F.col("docs"), WORDS)).alias("turn", "m"))
    return rows.select("query_id", F.col("turn").cast("long").alias("turn"), "m.role", F.md5(F.col("m.content").cast("binary")).alias("content_md5"))


@query("perm_scrape", f"WITH {SQL_RESPONSES}, {_sql_parse('resp')} SELECT case_id AS query_id, CAST(pos AS BIGINT) AS pos, CAST(id AS VARCHAR) AS id FROM ex")
def perm_scrape(spark, sf_dir):
    ids, _ = scraped(F.col("raw_text"))
    rows = responses(spark, sf_dir).select("query_id", F.posexplode(ids).alias("pos", "id"))
    return rows.select("query_id", (F.col("pos") + 1).cast("long").alias("pos"), "id")


@query("perm_order", f"WITH {SQL_RESPONSES}, {_sql_parse('resp')} SELECT case_id AS query_id, string_agg(CAST(id - 1 AS VARCHAR), ',' ORDER BY llm_rank) AS \"order\" FROM od GROUP BY case_id")
def perm_order(spark, sf_dir):
    rows = parsed(responses(spark, sf_dir), "raw_text", "num")
    return rows.select("query_id", F.array_join(F.transform("result.order", lambda v: v.cast("string")), ",").alias("order"))


@query("perm_parse", f"WITH {SQL_RESPONSES}, {_sql_parse('resp')}, p AS ({SQL_PARSED}) SELECT case_id AS query_id, p.* EXCLUDE (case_id) FROM p")
def perm_parse(spark, sf_dir):
    rows = parsed(responses(spark, sf_dir), "raw_text", "num").select("query_id", "result.*")
    return rows.select("query_id", "strategy", *[F.col(c).cast("long").alias(c) for c in COUNTERS], "is_clean", "is_total_failure")


@query(
    "perm_stats_summary",
    f"""WITH {SQL_RESPONSES}, {_sql_parse("resp")}, p AS ({SQL_PARSED}) SELECT strategy, is_clean, is_total_failure, count(*) AS n, CAST(sum(n_duplicates) AS BIGINT) AS duplicates,
CAST(sum(n_out_of_range) AS BIGINT) AS out_of_range, CAST(sum(n_missing) AS BIGINT) AS missing FROM p GROUP BY strategy, is_clean, is_total_failure""",
)
def perm_stats_summary(spark, sf_dir):
    rows = parsed(responses(spark, sf_dir).select("raw_text", "num"), "raw_text", "num").select("result.*")
    return rows.groupBy("strategy", "is_clean", "is_total_failure").agg(F.count(F.lit(1)).alias("n"), F.sum("n_duplicates").alias("duplicates"), F.sum("n_out_of_range").alias("out_of_range"), F.sum("n_missing").alias("missing"))


def reranked(spark, sf_dir):
    rows = parsed(responses(spark, sf_dir), "raw_text", "num")
    return rows.select("query_id", F.explode(applied(F.col("docs"), F.col("result.order"))).alias("r")).select("query_id", F.col("r.llm_rank").cast("long").alias("llm_rank"), "r.doc.doc_id", "r.doc.rank", "r.doc.score")


SQL_APPLIED = f"WITH {SQL_RESPONSES}, {_sql_parse('resp')}, ap AS (SELECT o.case_id AS query_id, o.llm_rank, r.doc_id, r.rank, r.score FROM od o JOIN run_v r ON r.query_id = o.case_id AND r.rank = o.id)"


@query("perm_apply", f"{SQL_APPLIED} SELECT query_id, llm_rank, doc_id, rank, score FROM ap")
def perm_apply(spark, sf_dir):
    return reranked(spark, sf_dir)


@query("rank_movement", f"{SQL_APPLIED} SELECT query_id, doc_id, rank - llm_rank AS delta FROM ap")
def rank_movement(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", "doc_id", (F.col("rank") - F.col("llm_rank")).alias("delta"))


@query("rerank_end_to_end", f"{SQL_APPLIED} SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY llm_rank) AS final_run FROM ap GROUP BY query_id")
def rerank_end_to_end(spark, sf_dir):
    """Generated text to final run, row by row: the candidates stay nested and nothing is shuffled after retrieval."""
    rows = parsed(responses(spark, sf_dir), "raw_text", "num")
    ids = F.transform(applied(F.col("docs"), F.col("result.order")), lambda r: r["doc"]["doc_id"].cast("string"))
    return rows.select("query_id", F.array_join(ids, " ").alias("final_run"))
