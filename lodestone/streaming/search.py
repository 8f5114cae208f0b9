"""Extension: query vectors that arrive as a stream, answered against a standing base table.

Each micro-batch is a stated query set of bounded size, searched exactly like any other; results are written idempotently
by batch id, so a batch that is run again after a failure replaces its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.knn import exact_topk


def answer_stream(spark: SparkSession, base: DataFrame, arriving: DataFrame, out: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """arriving: a streaming DataFrame (qid, qvec) -> Parquet folders out/batch=<id>; stops when what is there has been answered."""

    def one(batch: DataFrame, batch_id: int) -> None:
        exact_topk(spark, base, batch, k).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
