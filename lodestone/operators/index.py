"""A graph index as an object: parameters, fit, save, load, search, audit."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.sources import sinks


@dataclass(frozen=True)
class GraphParameters:
    degree: int = 64
    size: int = 100
    alpha: float = 1.2
    seed: int = 0
    batch_share: float = 0.02
    shard_rows: int = graph.SHARD_ROWS


class GraphIndex:
    def __init__(self, rows: DataFrame, parameters: GraphParameters):
        self.rows, self.parameters = rows, parameters

    @classmethod
    def fit(cls, base: DataFrame, parameters: GraphParameters = GraphParameters()) -> GraphIndex:
        """base (vec_id, embedding); lazy until searched or saved."""
        return cls(graph.fit(base, **asdict(parameters)), parameters)

    def save(self, path: str, mode: str = "errorifexists") -> GraphIndex:
        """Writes rows and parameters; the index returned reads what was written, and is built no second time."""
        self.rows.write.mode(mode).parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([tuple(asdict(self.parameters).values())], list(asdict(self.parameters))).coalesce(1).write.mode(mode).json(f"{path}/parameters")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        found = spark.read.json(f"{path}/parameters").first().asDict()
        return cls(spark.read.schema(graph.INDEX).parquet(f"{path}/rows"), GraphParameters(**found))

    @staticmethod
    def size_bytes(spark: SparkSession, path: str) -> int:
        return sinks.size_bytes(spark, path)

    def search(self, queries: DataFrame, k: int = 10, size: int = 100) -> DataFrame:
        """queries (qid, qvec) -> qid, rank, vec_id, d2; a list shorter than k is lengthened to k."""
        found = graph.search_index(self.rows.sparkSession, self.rows, queries, k, [size])
        return graph.merged(found, k).drop("size")

    def counters(self, queries: DataFrame, k: int = 10, sizes: list[int] | None = None) -> DataFrame:
        return graph.counters(graph.search_index(self.rows.sparkSession, self.rows, queries, k, sizes or [self.parameters.size]))

    def edges(self) -> DataFrame:
        return self.rows.select(F.col("vec_id").alias("src"), F.explode("nbrs").alias("dst"))

    def audit(self) -> DataFrame:
        return graph.audit(self.edges(), self.rows.select("vec_id"), self.parameters.degree)
