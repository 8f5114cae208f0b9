"""Quality scores from random-indexing word vectors and a small network (operator 8).

Random indexing: every word has a sparse random vector; a word's context vector is the sum of the vectors of the words within two
places of it, over all documents. Words share 8,192 hash buckets, so the table that partitions add up and the driver
holds has one size whatever the corpus. A document is the mean of its words' context vectors and of their own random
vectors, how much the latter cluster, how often a word follows itself, and its length; a network of two layers in numpy maps that to a logit. A
temperature fitted on rows kept from training calibrates the probability.

The context vectors cover all documents; the network learns from at most max_rows labelled ones (of the smallest hash of doc_id).

Words are runs of letters and digits, or of other marks, as they are written. Defined results: a null or empty text has the vector of
no words and gets a score as any other. Rows without a label teach nothing; nothing learned gives every text 0.5; equal
doc_ids in the labels are each a training row. Texts are pooled whole, however long; of labelled rows that tie for the last place of the sample, as
those of one doc_id do, any may be taken. The query reads doc_id and text (and quality of the labels) alone; with_scores adds
one column and keeps the others, one of the same name excepted. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import MIX_A, Memo, bounded_sample, claim, mixed, spread, table
from lodestone.llm.language import remainder

BUCKETS, CONTEXT, OWN, REACH = 8192, 32, 64, 2
WIDTH = CONTEXT + OWN + 4
HIDDEN = 24
MAX_ROWS = 20_000
THRESHOLD = 0.3
words_of = re.compile(r"\w+|[^\w\s]+").findall


def _bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS


_buckets = Memo(_bucket)


def buckets_of(text: str | None) -> np.ndarray:
    words = words_of(text or "")
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))


@functools.cache
def index_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary vectors of the buckets: two places each, and their signs."""
    h = mixed(np.arange(1, 2 * BUCKETS + 1, dtype=np.uint64) * MIX_A + np.uint64(dimensions)).reshape(BUCKETS, 2)
    return (h % np.uint64(dimensions)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def context_sums(rows: list[np.ndarray]) -> np.ndarray:
    """Sums of neighbours' index vectors, (BUCKETS, CONTEXT), over documents given as buckets."""
    places, signs = index_vectors(CONTEXT)
    out = np.zeros(BUCKETS * CONTEXT)
    gap = np.full(REACH, -1, np.int64)
    flat = np.concatenate([x for r in rows for x in (r, gap)]) if rows else gap
    for distance in range(1, REACH + 1):
        left, right = flat[:-distance], flat[distance:]
        both = (left >= 0) & (right >= 0)
        for word, near in ((left[both], right[both]), (right[both], left[both])):
            for k in range(2):
                out += np.bincount(word * CONTEXT + places[near, k], weights=signs[near, k], minlength=len(out))
    return out.reshape(BUCKETS, CONTEXT)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(_buckets)
    total, held, size = np.zeros((BUCKETS, CONTEXT)), [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(buckets_of(text))
            size += len(held[-1])
            if size > 500_000:
                total += context_sums(held)
                held, size = [], 0
    total += context_sums(held)
    used = np.flatnonzero(np.any(total != 0, axis=1))
    # The sums are whole numbers, so adding them up in any order gives the same.
    columns = [pa.array(used)] + [pa.array(total[used, k].astype(np.int64)) for k in range(CONTEXT)]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"c{k}" for k in range(CONTEXT))])


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from every text."""
    schema = ", ".join(["bucket long", *(f"c{k} long" for k in range(CONTEXT))])
    sums = docs.select("text").mapInArrow(_accumulate, schema).groupBy("bucket").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(CONTEXT)])
    rows = sums.toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, CONTEXT))
    out[rows.column("bucket").to_numpy()] = np.stack([rows.column(f"c{k}").to_numpy() for k in range(CONTEXT)], axis=1) if rows.num_rows else np.zeros((0, CONTEXT))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def features(text: str | None, vectors: np.ndarray) -> np.ndarray:
    at = buckets_of(text)
    if not len(at):
        return np.zeros(WIDTH)
    used, times = np.unique(at, return_counts=True)
    share = times / len(at)
    places, signs = index_vectors(OWN)
    own = np.bincount(places[used].ravel(), weights=(signs[used] * share[:, None]).ravel(), minlength=OWN)
    same = np.log(np.mean(at[1:] == at[:-1]) + 1e-3) if len(at) > 1 else np.log(1e-3)
    return np.concatenate([share @ vectors[used], own, [np.log(np.linalg.norm(own) + 1e-3), np.log((share**2).sum()), np.log1p(len(at)), same]])


def loss(z: np.ndarray, y: np.ndarray, parts: list[np.ndarray], decay: float) -> float:
    """Mean log loss of rows z, and half the decay times the squares of the weights."""
    logits = np.tanh(z @ parts[0] + parts[1]) @ parts[2] + parts[3]
    return float(np.logaddexp(0, np.where(y > 0, -logits, logits)).mean() + decay / 2 * ((parts[0] ** 2).sum() + (parts[2] ** 2).sum()))


def gradients(z: np.ndarray, y: np.ndarray, parts: list[np.ndarray], decay: float) -> tuple[np.ndarray, ...]:
    """Of loss(), by each of the four parts."""
    hidden = np.tanh(z @ parts[0] + parts[1])
    error = (1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3], -60, 60))) - y) / len(y)
    back = np.outer(error, parts[2]) * (1 - hidden**2)
    return z.T @ back + decay * parts[0], back.sum(axis=0), hidden.T @ error + decay * parts[2], error.sum(keepdims=True)


class Network:
    """Two layers: tanh, then a logit; inputs are standardised."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.temperature = vectors, 1.0
        self.mean = self.scale = self.w1 = self.b1 = self.w2 = None
        self.b2 = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.zeros(len(x))
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([features(t, self.vectors) for t in texts]) if texts else np.zeros((0, WIDTH))
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> None:
        if not len(y):
            return
        rng = np.random.default_rng(seed)
        held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
        tx, ty = x[~held], y[~held]
        self.mean, self.scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
        parts = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, z, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], (tx - self.mean) / self.scale, 0
        for _ in range(epochs):
            order = rng.permutation(len(ty))
            for k in range(0, len(order), 64):
                rows = order[k : k + 64]
                step += 1
                for n, g in enumerate(gradients(z[rows], ty[rows], parts, decay)):
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    parts[n] = parts[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
        if held.any():
            logits, truth, losses = self.logits(x[held]), y[held], {}
            for t in np.geomspace(0.2, 10, 60):
                losses[float(t)] = np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean()
            self.temperature = min(losses, key=losses.get)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """docs (doc_id, text): the corpus; labels (doc_id, label 0 or 1): what the network learns from.

    The sample is drawn from the labels alone, so it is max_rows small numbers to broadcast, and no text is shuffled."""
    found = Network(context_vectors(docs))
    shared = spark.sparkContext.broadcast(found.vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, shared.value).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    known = labels.where("label is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    sample = bounded_sample(known, "doc_id", max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").mapInArrow(pooled, "doc_id long, label int, x array<double>").toArrow()
    if rows.num_rows:
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        found.fit(np.array(rows.column("x").to_pylist()), rows.column("label").to_numpy().astype(float))
    return found


def with_scores(spark: SparkSession, docs: DataFrame, network: Network, into: str = "score") -> DataFrame:
    shared = spark.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim(_buckets)
        for texts in batches:
            yield pa.array(shared.value.scores(texts.to_pylist()))

    return docs.withColumn(into, F.arrow_udf(score, "double")("text"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(remainder("doc_id", 5) != 0)
    scored = with_scores(spark, docs, fit(spark, docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
