"""Named retrieval datasets and where their artefacts lie. Fetching them needs a network and is left to the user."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.bm25 import TOP_K
from lodestone.sources import sinks


class Dataset(NamedTuple):
    """Ids of the collections that a dataset's corpus, queries and judgements come from."""

    name: str
    corpus: str
    queries: str
    qrels: tuple[str, ...]
    top_k: int = TOP_K


# Public collections by their catalogue ids (fixed values).
_CATALOGUE = {
    "nfcorpus": "beir/nfcorpus/test",
    "touche": "beir/webis-touche2020",
    "trec-covid": "beir/trec-covid",
    "dbpedia": "beir/dbpedia-entity/test",
    "scifact": "beir/scifact/test",
}
DATASETS = {name: Dataset(name, source, source, (source,)) for name, source in _CATALOGUE.items()}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name]


class Paths:
    """Places of a dataset's artefacts under a root that any Spark reader can open."""

    def __init__(self, root: str, name: str):
        self.root = f"{root.rstrip('/')}/{name}"

    def __getattr__(self, artefact: str) -> str:
        known = ("base", "queries", "truth", "supplied_truth", "meta", "corpus", "qrels", "run", "reranking", "metrics", "graph", "codes", "layout")
        if artefact not in known:
            raise AttributeError(artefact)
        return f"{self.root}/{artefact}"


def ground_truth(spark: SparkSession, paths: Paths) -> DataFrame:
    """Supplied neighbours where there are any, computed ones else."""
    return spark.read.parquet(paths.supplied_truth if sinks.exists(spark, paths.supplied_truth) else paths.truth)


def prefix(vectors: DataFrame, n: int | None = None) -> DataFrame:
    """All vectors, or the first n by id."""
    return vectors if n is None else vectors.where(f"vec_id < {int(n)}")
