"""Language identification by Kneser-Ney character models (operator 7).

A model for each language gives the chance of each letter of a word after the three before it, by interpolated Kneser-Ney
smoothing: the counts of 4-grams come from all training texts, the lower orders count distinct continuations. The n-grams of an order
are sorted arrays of 64-bit keys (four 16-bit units) beside arrays of values, searched by bisection. A text's cross-entropy
under a language is the mean over its letters and word ends; the lowest wins. The score is the winner's share of a softmax
whose temperature is fitted to training texts, and a text is marked as rejected when its cross-entropy is further from what its
language's training texts have than those texts would nearly ever be.

Counting covers every training text: partitions count words, turn them into 4-grams and Spark adds up. All distinct 4-grams
stay in the models. The driver fetches and builds the models of a few languages at a time, a block of at most max_ngrams
4-grams or one language with more. Where there are several blocks, each is broadcast on its own and a worker holds one at a time,
so the block size changes memory and time and no prediction. A single language's model has to fit into memory.
Temperature and rejection are fitted on at most calibration_rows texts (of the smallest hash of doc_id).

Defined results: a null text and one without letters is "und" with score 0; so is every text where nothing was learned. Rows
with a null doc_id or lang teach nothing but are classified. Ties go to the first language by name. Texts are scored whole, however long. The query reads doc_id, text
and lang alone; with_language adds one column and keeps the others, one of the same name excepted. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.base import bounded_sample, claim, spread, table

ORDER = 4
PAD = " " * (ORDER - 1)
MAX_NGRAMS = 4_000_000
CALIBRATION_ROWS = 4_000
FLUSH_WORDS = 200_000
#: Words of the texts that are scored together where models come in several blocks.
GROUP_WORDS = 2_000_000
#: Bytes that the remembered scores of words may take, the words themselves at about 200 each included.
ROW_BYTES = 64 << 20
UNKNOWN = "und"
SPACE = np.uint64(32)
UNIT = np.uint64(16)
words_of = re.compile(r"[^\W\d_]+").findall

RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def lettered(words: Iterable[str]) -> list[str]:
    """The words without what counts as a word character but is no letter, such as fractions and superscripts; may be empty."""
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of padded words, one for each letter and word end, and the word each belongs to. A letter beyond 16 bits is
    two units."""
    raw = np.frombuffer((PAD + PAD.join(words) + PAD).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    n = len(raw) - ORDER + 1
    keys = np.zeros(n, np.uint64)
    for k in range(ORDER):
        keys = keys << UNIT | raw[k : k + n]
    last, before = raw[ORDER - 1 :], raw[ORDER - 2 : ORDER - 2 + n]
    inside = (last != SPACE) | (before != SPACE)
    # A word ends where a space follows a letter.
    owner = np.cumsum(np.concatenate([[0], (last[:-1] == SPACE) & (before[:-1] != SPACE)]))
    return keys[inside], owner[inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            if not counts:
                continue
            known = [(w, n) for w, n in zip(lettered(counts), counts.values(), strict=True) if w]
            if not known:
                continue
            keys, owner = units([w for w, _ in known])
            times = np.array([n for _, n in known], np.int64)
            grams, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, weights=times[owner]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(total)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words_of((text or "").lower()))
        if sum(map(len, held.values())) > FLUSH_WORDS:
            yield from flush()
    yield from flush()


def ngram_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, text) -> lang, gram, n over all rows."""
    return docs.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney model of one language: for each order, sorted n-grams with their discounted shares, and
    sorted contexts with the weight that goes to the order below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order].astype(float)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(ORDER, 0, -1):
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            contexts, at, types = np.unique(grams >> UNIT, return_inverse=True, return_counts=True)
            totals = np.bincount(at, weights=counts)
            self.orders.append((grams, np.maximum(counts - discount, 0) / totals[at], contexts, discount * types / totals))
            if k > 1:
                # Below: how many different units stand before each shorter gram.
                grams, counts = np.unique(grams & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
                counts = counts.astype(float)
        self.orders.reverse()
        self.alphabet = len(self.orders[0][0]) + 1

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """Log chance of each 4-gram's last unit after the units before it."""
        chance = np.full(len(keys), 1 / self.alphabet)
        for k, (grams, shares, contexts, weights) in enumerate(self.orders, 1):
            own = keys & np.uint64((1 << 16 * k) - 1)
            chance = _looked_up(grams, shares, own, 0.0) + _looked_up(contexts, weights, own >> UNIT, 1.0) * chance
        return np.log2(chance)


def _looked_up(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], missing)


class Identifier:
    """The models of all languages, a temperature, and for each language the highest cross-entropy it accepts.

    blocks hold the models, in the order of the languages' names: one in memory, or several broadcasts that are opened in turn."""

    def __init__(self, langs: list[str], blocks: list[dict[str, KneserNey] | Broadcast]):
        self.langs, self.blocks = langs, blocks
        self.temperature = 0.1
        self.limits = np.full(len(self.langs), np.inf)
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.langs)))
        self.sizes = np.zeros(1024)

    def _full(self) -> bool:
        return len(self.rows) * (200 + 8 * len(self.langs)) > ROW_BYTES

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "sums", "sizes")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _models(self) -> Iterator[KneserNey]:
        for block in self.blocks:
            held = block.value if isinstance(block, Broadcast) else block
            yield from (held[k] for k in sorted(held))
            if isinstance(block, Broadcast):
                # The value is read from the local copy again when it is next asked for.
                del held, block._value

    def learn_words(self, new: list[str]) -> None:
        """Scores of words not met yet; remembered for the process."""
        if not new:
            return
        cleaned, first = lettered(new), len(self.rows)
        real = np.array([k for k, w in enumerate(cleaned) if w], np.int64)
        while first + len(new) > len(self.sizes):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sums[first : first + len(new)] = 0
        self.sizes[first : first + len(new)] = 0
        if len(real):
            keys, owner = units([cleaned[k] for k in real])
            kinds, at = np.unique(keys, return_inverse=True)
            for k, model in enumerate(self._models()):
                self.sums[first + real, k] = np.bincount(owner, weights=model.log2(kinds)[at], minlength=len(real))
            self.sizes[first + real] = np.bincount(owner, minlength=len(real))
        self.rows.update(zip(new, range(first, first + len(new)), strict=True))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy in bits a unit, a row for each text and a column for each language; NaN without letters."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        if self._full():
            self._reset()
        for i, split in self._groups(texts):
            self.learn_words([w for w in set().union(*split) if w not in self.rows])
            for k, words in enumerate(split):
                if words:
                    at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
                    letters = self.sizes[at].sum()
                    if letters:
                        out[i + k] = -self.sums[at].sum(axis=0) / letters
        return out

    def _groups(self, texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
        """Places of first texts and the words of each text from there: 64 texts, or with several blocks as many as have about GROUP_WORDS."""
        first, split, held = 0, [], 0
        same: dict[str, str] = {}
        for i in range(0, len(texts), 64):
            more = [words_of((t or "").lower()) for t in texts[i : i + 64]]
            if len(self.blocks) > 1:
                more = [[same.setdefault(w, w) for w in words] for words in more]
            split, held = split + more, held + sum(map(len, more))
            if len(self.blocks) <= 1 or held >= GROUP_WORDS:
                yield first, split
                first, split, held = i + 64, [], 0
                same.clear()
                if len(self.blocks) > 1 and self._full():
                    self._reset()
        if split:
            yield first, split

    def shares(self, entropies: np.ndarray) -> np.ndarray:
        low = np.exp(-(entropies - entropies.min(axis=1, keepdims=True)) / self.temperature)
        return low / low.sum(axis=1, keepdims=True)

    def calibrate(self, texts: list[str], langs: list[str], spread: float = 6.0) -> None:
        """Temperature of the least log loss; limits at spread standard deviations above each language's mean."""
        found = self.entropies(texts)
        right = np.array([self.langs.index(x) for x in langs], int)
        known = ~np.isnan(found[:, 0]) if len(self.langs) and len(found) else np.zeros(len(found), bool)
        if not known.any():
            return
        found, right = found[known], right[known]
        losses = {}
        for t in np.geomspace(0.01, 3, 40):
            self.temperature = float(t)
            losses[self.temperature] = -np.log(np.maximum(self.shares(found)[np.arange(len(right)), right], 1e-12)).mean()
        self.temperature = min(losses, key=losses.get)
        own = found[np.arange(len(right)), right]
        for k in range(len(self.langs)):
            if (right == k).any():
                self.limits[k] = own[right == k].mean() + spread * max(own[right == k].std(), 0.05)

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        if not self.langs:
            return [(UNKNOWN, 0.0, None, True)] * len(texts)
        found = self.entropies(texts)
        known = ~np.isnan(found[:, 0])
        best = np.where(known, np.nan_to_num(found, nan=np.inf).argmin(axis=1), 0)
        shares = self.shares(np.where(known[:, None], found, 0.0))
        return [
            (self.langs[b], float(shares[i, b]), float(found[i, b]), bool(found[i, b] > self.limits[b])) if known[i] else (UNKNOWN, 0.0, None, True)
            for i, b in enumerate(best.tolist())
        ]


def _models_of(counts: DataFrame, langs: list[str], sizes: dict[str, int], max_ngrams: int) -> dict[str, KneserNey]:
    """Models of some languages from all their counts; a language of more than max_ngrams rows is fetched in slices of about as many."""
    counts = counts.where(F.col("lang").isin(langs))
    slices = -(-sum(sizes[x] for x in langs) // max_ngrams)
    parts = [counts.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == k).toArrow() for k in range(slices)] if slices > 1 else [counts.toArrow()]
    rows = pa.concat_tables(parts)
    grams, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    own = {lang: pc.equal(rows.column("lang"), lang).to_numpy() for lang in langs}
    return {lang: KneserNey(grams[own[lang]], n[own[lang]]) for lang in langs}


def fit(docs: DataFrame, max_ngrams: int = MAX_NGRAMS, calibration_rows: int = CALIBRATION_ROWS) -> Identifier:
    """docs (doc_id, lang, text), lang not null -> models of every language in it."""
    counts = ngram_counts(docs).persist()
    sizes = {r["lang"]: r["rows"] for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}  # a row for each language
    groups: list[list[str]] = []
    for lang in sorted(sizes):
        if groups and sum(sizes[x] for x in groups[-1]) + sizes[lang] <= max_ngrams:
            groups[-1].append(lang)
        else:
            groups.append([lang])
    share = docs.sparkSession.sparkContext.broadcast if len(groups) > 1 else dict
    blocks = [share(_models_of(counts, group, sizes, max_ngrams)) for group in groups]
    counts.unpersist()
    found = Identifier(sorted(sizes), blocks)
    sample = bounded_sample(docs, "doc_id", calibration_rows).select("lang", "text").toArrow().to_pylist()
    sample = [r for r in sample if r["lang"] in found.langs]
    found.calibrate([r["text"] for r in sample], [r["lang"] for r in sample])
    return found


def with_language(spark: SparkSession, docs: DataFrame, identifier: Identifier, into: str = "__language") -> DataFrame:
    """docs with a struct of language, score, cross-entropy and rejection for each whole text."""
    # Broadcasts don't nest: an identifier of several blocks is small and goes with the function.
    shared = spark.sparkContext.broadcast(identifier) if len(identifier.blocks) <= 1 else None
    own = identifier if shared is None else None

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim()
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for texts in batches:
            rows = (shared.value if shared is not None else own).classify(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=RESULT.names)

    return docs.withColumn(into, F.arrow_udf(classify, RESULT)("text"))


def remainder(doc_id: str, divisor: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = remainder("doc_id", 3) == 1
    taught = docs.where(~held_out & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    found = with_language(spark, docs.select("doc_id", "text"), fit(taught))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("__language.lang").alias("lang_pred"), F.col("__language.score").alias("score"), F.col("__language.entropy").alias("entropy"), F.col("__language.rejected").alias("rejected"))
