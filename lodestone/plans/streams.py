"""Extension: the streaming search as a query."""

from __future__ import annotations

import uuid

from lodestone.plans.vectors import K, SQL_TOPK
from lodestone.registry import query
from lodestone.sources.tables import SQL_VECTORS, base_vectors, query_vectors, scratch
from lodestone.streaming.search import answer_stream


@query("stream_query_topk", f"WITH {SQL_VECTORS}, {SQL_TOPK} SELECT qid, rank, vec_id, d2 FROM exact")
def stream_query_topk(spark, sf_dir):
    """All query vectors as a stream of files; the answers are those of the batch search."""
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    queries = query_vectors(spark, sf_dir)
    queries.write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    answer_stream(spark, base_vectors(spark, sf_dir), arriving, f"{folder}/out", f"{folder}/checkpoint", K).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("qid", "rank", "vec_id", "d2")
