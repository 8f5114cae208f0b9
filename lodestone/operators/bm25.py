"""Lexical retrieval: a written inverted index and BM25, by scoring every match or by upper bounds.

The index has the documents' lengths and the postings: a row for each term and document, in blocks of documents of like length. `bounded`
adds a table of the largest share that a term reaches in a block. A search then needs few scores (the same hits as scoring
everything):

1. Each query's rarest terms give some documents, of which the best are scored in full: their k-th score is a threshold, which no
   hit lies below.
2. In each block a query's terms are put in order of their bounds. As long as the bounds together stay below a part of the threshold, the
   terms are left out: documents with no other term are no hits. Blocks whose bounds together stay below it are not read at all.
3. The other terms' postings are joined and summed; documents that can't reach the threshold with the bounds of what was left
   out go, and the rest get the missing parts.

Joins and windows by query and block carry all of it; the largest group is a block's share of a query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, contents, tokens
from lodestone.sources.tables import written

K1, B, TOP_K, DIGITS = 0.9, 0.4, 100, 6
#: Rows of term weights (one for each query and term) that are broadcast, some 40 MB; more are shuffled by term.
WEIGHTS = 500_000
#: Documents of a block, about; classes of length for each doubling of it.
BLOCK_DOCS, CLASSES = 32, 16
#: The first pass reads a query's rarest terms up to so many times k postings, and scores so many times k documents in full.
OPENING, SCORED = 20, 2
#: Terms of a block are left out while their bounds stay below this part of the threshold: the more is left out, the fewer
#: postings are read, and the more documents are left that might still reach it.
LEAVE = 0.5
#: Scores are rounded, and added up in any order: what lies so little below the threshold may still be a hit.
MARGIN = 1e-5


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms; queries and documents share it."""

    stop_words: bool = False
    stems: bool = False

    def terms(self, text):
        return tokens(text, STOP_WORDS if self.stop_words else None, self.stems)


#: Keeps a table: by default it is written to the shared folder for this application.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


class InvertedIndex:
    """lengths (doc_id, dl) and postings (term, doc_id, dl, block, tf) of a corpus, with its analyzer. It is written once and
    serves any number of query sets."""

    def __init__(self, lengths: DataFrame, postings: DataFrame, analyzer: Analyzer):
        self.lengths, self.postings, self.analyzer = lengths, postings, analyzer

    @classmethod
    def build(cls, corpus: DataFrame, analyzer: Analyzer = Analyzer(), keep: Keep | None = None) -> InvertedIndex:
        """corpus (doc_id, title, text), tokenized and written."""
        keep = keep or (lambda name, make: written(corpus.sparkSession, make(), name))
        docs = keep("terms", lambda: tokenized(corpus, analyzer))
        return cls(docs.select("doc_id", "dl"), keep("postings", lambda: postings(docs)), analyzer)

    def save(self, path: str, mode: str = "errorifexists") -> InvertedIndex:
        spark = self.lengths.sparkSession
        self.lengths.write.mode(mode).parquet(f"{path}/lengths")
        self.postings.write.mode(mode).parquet(f"{path}/postings")
        spark.createDataFrame([tuple(asdict(self.analyzer).values())], list(asdict(self.analyzer))).coalesce(1).write.mode(mode).json(f"{path}/analyzer")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        return cls(spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/postings"), Analyzer(**spark.read.json(f"{path}/analyzer").first().asDict()))

    def bounded(self, k1: float = K1, b: float = B, keep: Keep | None = None) -> BoundedIndex:
        return BoundedIndex.build(self, k1, b, keep)

    def search(self, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
        """queries (query_id, query_text) -> query_id, rank, doc_id, score."""
        return self.bounded(k1, b).search(queries, k)


def tokenized(corpus: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """doc_id, dl, terms of title and text."""
    docs = corpus.select("doc_id", analyzer.terms(contents("title", "text")).alias("terms"))
    return docs.select("doc_id", F.size("terms").cast("long").alias("dl"), "terms")


def blocked(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with a block of about block_docs documents of like length: a class of lengths is cut by a hash of the ids, so nothing
    is sorted; there are some hundred classes, whose sizes are sent."""
    classed = docs.withColumn("class", F.floor(F.log2(F.col("dl") + 1.0) * CLASSES).cast("long"))
    sizes = classed.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("long").alias("parts"))
    place = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    return classed.join(F.broadcast(sizes), "class").select(*docs.columns, (F.shiftleft("class", 40) + place).alias("block"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, dl, terms -> term, doc_id, dl, block, tf. A document's terms are counted where it is before they are shuffled."""
    exploded = blocked(docs).select("doc_id", "dl", "block", F.explode("terms").alias("term"))
    return exploded.groupBy("doc_id", "dl", "block", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "dl", "block", "tf")


def statistics(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """query_id, term, qtf of queries (query_id, query_text)."""
    return queries.select("query_id", F.explode(analyzer.terms(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def share_of(k1: float, b: float):
    """The part of a term's weight that a document gets."""
    return F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def idf():
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def scores_of(index: InvertedIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of every match of queries (query_id, query_text)."""
    terms = written(index.lengths.sparkSession, query_terms(queries, index.analyzer), "query-terms")
    found = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(statistics(index.lengths))  # one row
    weights = terms.join(frequency, "term").crossJoin(stats).select("query_id", "term", (F.col("qtf") * idf()).alias("weight"), "avgdl")
    weights = F.broadcast(weights) if terms.count() <= WEIGHTS else weights
    parts = found.join(weights, "term").select("query_id", "doc_id", (F.col("weight") * share_of(k1, b)).alias("part"))
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def scores(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """corpus (doc_id, title, text), queries (query_id, query_text) -> query_id, doc_id, score of every match."""
    return scores_of(InvertedIndex.build(corpus, analyzer), queries, k1, b)


def topk(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, rank, doc_id, score: at most k hits a query, by score, then the lower id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


class BoundedIndex:
    """Postings with their shares (term, doc_id, block, share) and bounds (term, block, most, docs), for one pair of k1 and b."""

    def __init__(self, shares: DataFrame, bounds: DataFrame, stats: DataFrame, analyzer: Analyzer):
        self.shares, self.bounds, self.stats, self.analyzer = shares, bounds, stats, analyzer

    @classmethod
    def build(cls, index: InvertedIndex, k1: float = K1, b: float = B, keep: Keep | None = None) -> BoundedIndex:
        keep = keep or (lambda name, make: written(index.lengths.sparkSession, make(), name))
        stats = F.broadcast(statistics(index.lengths))  # one row
        shares = index.postings.crossJoin(stats).select("term", "doc_id", "block", share_of(k1, b).alias("share"))
        bounds = keep(f"bounds-{k1}-{b}", lambda: shares.groupBy("term", "block").agg(F.max("share").alias("most"), F.count(F.lit(1)).alias("docs")))
        return cls(shares, bounds, stats, index.analyzer)

    def candidates(self, queries: DataFrame, k: int = TOP_K) -> Candidates:
        return Candidates(self, queries, k)

    def search(self, queries: DataFrame, k: int = TOP_K) -> DataFrame:
        """queries (query_id, query_text) -> query_id, rank, doc_id, score: the k best, as if every match was scored."""
        return topk(self.candidates(queries, k).scores(), k)


class Candidates:
    """The steps of a search, each a written table: terms, shares (of the queries' terms), opening (documents scored for the
    thresholds), parts (a row for each query, block and term that is not skipped) and survivors."""

    def __init__(self, index: BoundedIndex, queries: DataFrame, k: int):
        spark, self.k = index.bounds.sparkSession, k
        asked = query_terms(queries, index.analyzer)
        known = index.bounds.groupBy("term").agg(F.sum("docs").alias("df")).join(asked, "term").crossJoin(index.stats)
        self.terms = written(spark, known.select("query_id", "term", "df", (F.col("qtf") * idf()).alias("weight")), "query-weights")
        self.shares = written(spark, index.shares.join(self.terms.select("term").distinct(), "term", "left_semi"), "query-shares")
        self.opening = written(spark, self._opening(), "opening")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        thresholds = self.opening.withColumn("place", place).where(F.col("place") == k).select("query_id", (F.col("score") - MARGIN).alias("least"))
        # Queries with fewer documents in the first pass have no threshold: all their terms are read.
        self.weights = self.terms.join(thresholds, "query_id", "left").select("query_id", "term", "weight", F.coalesce("least", F.lit(0.0)).alias("least"))
        self.parts = written(spark, self._parts(index.bounds), "parts")
        self.survivors = written(spark, self._survivors(), "survivors")

    def _opening(self) -> DataFrame:
        """query_id, doc_id, score: the full scores of the best documents by the query's rarest terms."""
        rarest = Window.partitionBy("query_id").orderBy("df", "term")
        read = self.terms.withColumn("before", F.sum("df").over(rarest) - F.col("df")).where(F.col("before") < OPENING * self.k)
        some = read.join(self.shares, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("share")).alias("part"))
        best = Window.partitionBy("query_id").orderBy(F.desc("part"), "doc_id")
        chosen = some.withColumn("place", F.row_number().over(best)).where(F.col("place") <= SCORED * self.k).select("query_id", "doc_id")
        full = chosen.join(self.terms.select("query_id", "term", "weight"), "query_id").join(self.shares, ["term", "doc_id"])
        return full.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))

    def _parts(self, bounds: DataFrame) -> DataFrame:
        """query_id, block, term, weight, needed (its postings are read), rest (the bounds of those that are not), least."""
        each = self.weights.join(bounds.select("term", "block", "most"), "term").withColumn("bound", F.col("weight") * F.col("most"))
        group = Window.partitionBy("query_id", "block")
        order = group.orderBy("bound", "term")
        summed = each.withColumn("total", F.sum("bound").over(order))
        needed = F.col("total") >= LEAVE * F.col("least")
        live = F.max("total").over(group) >= F.col("least")
        rest = F.coalesce(F.max(F.when(~needed, F.col("total"))).over(group), F.lit(0.0))
        return summed.select("query_id", "block", "term", "weight", "least", needed.alias("needed"), rest.alias("rest"), live.alias("live")).where("live").drop("live")

    def _survivors(self) -> DataFrame:
        """query_id, doc_id, block, part: documents that may reach the threshold, and what is summed so far."""
        read = self.parts.where("needed").join(self.shares, ["term", "block"])
        summed = read.groupBy("query_id", "doc_id", "block", "rest", "least").agg(F.sum(F.col("weight") * F.col("share")).alias("part"))
        return summed.where(F.col("part") + F.col("rest") >= F.col("least")).select("query_id", "doc_id", "block", "part")

    def scores(self) -> DataFrame:
        """query_id, doc_id, score of the survivors, in full."""
        skipped = self.parts.where("not needed").select("query_id", "block", "term", "weight")
        missing = self.survivors.join(skipped, ["query_id", "block"]).join(self.shares.select("term", "doc_id", "share"), ["term", "doc_id"])
        every = self.survivors.select("query_id", "doc_id", "part").union(missing.select("query_id", "doc_id", F.col("weight") * F.col("share")))
        return every.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
