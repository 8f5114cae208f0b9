"""Writers: JSON lines, TREC judgements, metric tables, index layouts. All are plain Spark writes, so a lost task is just run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished artefact is there; Spark's writers leave _SUCCESS behind."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, asked of the file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def once(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Reuses a table that was written before, else writes it."""
    if not exists(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_queries(queries: DataFrame, path: str, split: str | None = None, mode: str = "errorifexists") -> None:
    """query_id and query_text as JSON lines, the id as a string, and the name of the split where one is given."""
    named = [F.lit(split).alias("split")] if split is not None else []
    write_jsonl(queries.select(F.col("query_id").cast("string").alias("query_id"), "query_text", *named), path, mode)


def trec_lines(qrels: DataFrame) -> DataFrame:
    """query_id 0 doc_id relevance, tab-separated; sorted by the ids as strings where the order is kept (a write after orderBy)."""
    line = F.concat_ws("\t", F.col("query_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("relevance").cast("string"))
    return qrels.select(F.col("query_id").cast("string").alias("q"), F.col("doc_id").cast("string").alias("d"), line.alias("line"))


def write_trec_qrels(qrels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    trec_lines(qrels).orderBy("q", "d").select("line").write.mode(mode).text(path)


def write_metrics_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_layout(layout: DataFrame, path: str, partitions: int = 200, mode: str = "errorifexists") -> None:
    """Node records clustered by sector, so a range of sectors is a range of row groups."""
    layout.repartitionByRange(partitions, "sector").sortWithinPartitions("sector", "slot").write.mode(mode).parquet(path)


def save_results(spark: SparkSession, results: dict, path: str, mode: str = "overwrite") -> None:
    """One result document as JSON; NumPy scalars and arrays become plain values."""
    import json

    def plain(value):
        return value.tolist() if hasattr(value, "tolist") else str(value)

    spark.createDataFrame([(json.dumps(results, default=plain),)], "value string").coalesce(1).write.mode(mode).text(path)


def load_results(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first().value)
