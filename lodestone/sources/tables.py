"""Tables of a scale-factor folder and the views that queries share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of query rows, items or index arrays that may be broadcast at once; larger sets are worked off in blocks of this size.
BROADCAST_BYTES = 32 << 20

_own: list[str] = []
_paths: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables; a local one only where none is set and one machine does all the work."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _own[0]


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here."""
    path = os.path.join(scratch(spark), f"{name}-{uuid.uuid4().hex}")
    _paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder, and returns how many; results that are read
    lazily from them have to be written elsewhere before."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _paths:
        path = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


def base_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is indexed and can be found, the queries' own rows included."""
    return vectors(spark, sf_dir)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    return vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("title"), "text")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query_text"))


def item_blocks(items: DataFrame, key: str, text: str, most_bytes: int = BROADCAST_BYTES) -> Iterator[list[tuple[int, str]]]:
    """(key, text) rows in blocks of bounded size, fetched partition by partition."""
    block, held = [], 0
    for row in items.select(key, text).toLocalIterator():
        if row[1]:
            block.append((row[0], row[1]))
            held += 4 * len(row[1])
        if held >= most_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def containing(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id) where a document holds an item's text verbatim: one automaton over all items, one pass of the texts."""
    import ahocorasick

    found = None
    for block in item_blocks(items, "query_id", "query_text"):
        by_text: dict[str, list[int]] = {}
        for key, text in block:
            by_text.setdefault(text, []).append(key)
        automaton = ahocorasick.Automaton()
        for text, keys in by_text.items():
            automaton.add_word(text, keys)
        automaton.make_automaton()
        shared = spark.sparkContext.broadcast(automaton)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(k, d) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for k in sorted({k for _, keys in shared.value.iter(t) for k in keys})]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["query_id", "doc_id"])

        part = docs.select("doc_id", "text").mapInArrow(search, "query_id long, doc_id long")
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, doc_id long")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded judgements: 2 for a passage held verbatim, 1 or 0 from the labels, and judged documents that the corpus lacks."""
    items = topics(spark, sf_dir)
    n = items.agg(F.count(F.lit(1)).alias("n"))
    verbatim = containing(spark, corpus(spark, sf_dir), items).select("query_id", "doc_id", F.lit(2).alias("relevance"))
    labels = load(spark, sf_dir, "labels").crossJoin(F.broadcast(n)).where("n > 0")  # n is one row
    graded = labels.select((F.col("doc_id") % F.col("n")).alias("query_id"), "doc_id", F.when(F.col("quality") == 1, 1).otherwise(0).alias("relevance")).where("query_id % 5 <> 0").join(items.select("query_id"), "query_id")
    missing = items.where("query_id % 7 = 0").select("query_id", (-1 - F.col("query_id")).alias("doc_id"), F.lit(1).alias("relevance"))
    return verbatim.union(graded.select("query_id", "doc_id", "relevance")).union(missing).groupBy("query_id", "doc_id").agg(F.max("relevance").cast("long").alias("relevance"))


#: The same views in SQL, for the counterparts of queries.
SQL_VECTORS = """base_v AS (SELECT vec_id, embedding, label FROM embeddings),
query_v AS (SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0)"""

SQL_QRELS = """qn AS (SELECT count(*) AS c FROM benchmark),
qrels_v AS (SELECT query_id, doc_id, CAST(max(relevance) AS BIGINT) AS relevance FROM (
  SELECT b.item_id AS query_id, d.doc_id AS doc_id, 2 AS relevance FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  UNION ALL
  SELECT b.item_id, l.doc_id, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END FROM labels l CROSS JOIN qn JOIN benchmark b ON b.item_id = l.doc_id % qn.c WHERE b.item_id % 5 <> 0
  UNION ALL
  SELECT item_id, -1 - item_id, 1 FROM benchmark WHERE item_id % 7 = 0) u GROUP BY query_id, doc_id)"""


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: z[1] * z[2]))"
