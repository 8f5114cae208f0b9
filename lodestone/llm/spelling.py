"""Spelling variants: words one inserted, deleted or replaced letter apart, and for each word the far commoner one it is a form of.

The words, in order, are cut into shards of bounded bytes, and a task builds a shard's trie in arrays: the letters that follow a node as
bits, its first child, the word that ends there. Shards are broadcast, a few at a time. A task walks each with the distance-one automata
of many words in step, depth first: a state is a word, a node and a place in the word, and whether the edit is made. Without it, a
state goes on by the word's letter, or makes the edit there; with it, it goes on by the word's letter alone, and so along one
path. A state at the end of its word and of a trie's word, its edit made, accepts. As shards are ranges, most words leave
most shards at the first letters. What a word finds in a shard is reduced in the task to a number and its best form, so
no pairs leave a task; sums and the best of all shards follow by aggregation. Roots follow forms by doubling: as a form is several
times commoner, chains are as short as a logarithm.

Defined results: null texts have no words, a null id is written as nothing. Equal counts go to the smaller word in code-point
order. Repeated rows count again. Words may be of any length; one longer than a shard is a shard of its own. Words are of a-z and U+00C0 to U+00FF.
A word without near words has none, and is its own root. Empty tables give an empty result; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import doc_text, materialize, spread, table

LEAST_CHARS, LEAST_COUNT, TIMES, NOISE = 7, 2, 10, 31
RUN = "[A-Za-zÀ-ÿ]"
#: Letters of a shard's words; a trie has no more nodes than letters and its root, of NODE_BYTES each.
SHARD_CHARS = 2_000_000
#: Shards that are broadcast at once, 400 MB on an executor at most.
ROUND = 8
#: Words that a task walks with in step, and of a file of words.
STEP, FILE_WORDS = 4096, 50_000
NONE = -1

#: Letters are numbered in code-point order: a to z are 0 to 25, U+00C0 to U+00FF 26 to 89.
LETTERS = 90
CODE = np.full(256, 255, np.uint8)
CODE[np.r_[97:123, 192:256]] = np.arange(LETTERS)
#: Of each letter, its bit among those that follow a node, in two words of bits, and the bits of the letters before it.
LOW, HIGH = np.zeros(LETTERS, np.uint32), np.zeros(LETTERS, np.uint64)
LOW[:26], HIGH[26:] = np.uint32(1) << np.arange(26, dtype=np.uint32), np.uint64(1) << np.arange(64, dtype=np.uint64)
LOW_BEFORE = np.where(np.arange(LETTERS) < 26, LOW - np.uint32(1), np.uint32(0xFFFFFFFF)).astype(np.uint32)
HIGH_BEFORE = np.where(np.arange(LETTERS) < 26, np.uint64(0), HIGH - np.uint64(1))

KINDS = {"low": np.uint32, "high": np.uint64, "first": np.int32, "word": np.int32, "letter": np.uint8, "text": np.uint8, "starts": np.int64, "counts": np.int64}
NODE_BYTES = sum(np.dtype(KINDS[name]).itemsize for name in ("low", "high", "first", "word", "letter"))


def runs(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, run: the maximal runs of letters of at least so many letters, A-Z alone lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length("run") == F.length("run")
    return found.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", upper, upper.lower())).alias("run"))


def noisy(found: DataFrame) -> DataFrame:
    """word: the runs, of which some, by a checksum of document and run, have lost a letter."""
    sum_ = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    return found.select("run", sum_.alias("h")).select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and common enough."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# ---- inside a task ----------------------------------------------------------------------------------------------------


def packed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words by number, one after another, and where each starts and the last ends."""
    text = CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    return text, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).astype(np.int64)


class Trie:
    """The arrays of KINDS: for each node the bits of the letters that follow it, its first child (children lie side by side, in the
    order of their letters), the word that ends there, and its own letter; the words and their counts."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        """words: different ones in code-point order. Level by level, from the words' letters at that depth."""
        text, starts = packed(words)
        lengths, n = np.diff(starts), 1
        own, nodes, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
        levels: list[tuple[np.ndarray, ...]] = []
        ends = np.full(len(words), NONE, np.int64)
        letters = [np.zeros(1, np.uint8)]
        while len(own):
            over = lengths[own] == depth
            ends[own[over]] = nodes[over]
            own, nodes = own[~over], nodes[~over]
            if not len(own):
                break
            letter = text[starts[own] + depth]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (nodes[1:] != nodes[:-1]) | (letter[1:] != letter[:-1])
            parents, label = nodes[fresh], letter[fresh]
            at = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            levels.append((parents[at], n + at, np.bitwise_or.reduceat(LOW[label], at), np.bitwise_or.reduceat(HIGH[label], at)))
            letters.append(label)
            nodes = n + np.cumsum(fresh) - 1
            n, depth = n + len(label), depth + 1
        arrays = {"low": np.zeros(n, np.uint32), "high": np.zeros(n, np.uint64), "first": np.zeros(n, np.int32), "word": np.full(n, NONE, np.int32)}
        for parents, first, low, high in levels:
            arrays["first"][parents], arrays["low"][parents], arrays["high"][parents] = first, low, high
        arrays["word"][ends] = np.arange(len(words))
        return cls(arrays | {"letter": np.concatenate(letters), "text": text, "starts": starts, "counts": np.array(counts, np.int64)})

    def child(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child of that letter, and the child."""
        low, high = self.low[node], self.high[node]
        there = np.flatnonzero((low & LOW[letter]).astype(bool) | (high & HIGH[letter]).astype(bool))
        low, high, letter = low[there], high[there], letter[there]
        return there, self.first[node[there]] + np.bitwise_count(low & LOW_BEFORE[letter]) + np.bitwise_count(high & HIGH_BEFORE[letter])

    def near(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the given word, number of the trie's word), each pair once, of all words one edit apart."""
        lengths, n = np.diff(starts), len(starts) - 1
        accepted: list[np.ndarray] = []
        stack = [(False, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64))]
        while stack:
            edited, q, node, at = stack.pop()
            rest = np.flatnonzero(at < lengths[q])
            letter = text[starts[q[rest]] + at[rest]]
            there, child = self.child(node[rest], letter)
            on = rest[there]
            if edited:
                over = np.flatnonzero((at == lengths[q]) & (self.word[node] != NONE))
                accepted.append(q[over] << 32 | self.word[node[over]])
                follow = [(True, q[on], child, at[on] + 1)]
            else:
                # Of edits that come to the same, one: of equal letters side by side the last is left out, and a letter is not put in before its equal.
                follow = [(False, q[on], child, at[on] + 1)]
                after = at[rest] + 1
                out = (after == lengths[q[rest]]) | (text[np.minimum(starts[q[rest]] + after, len(text) - 1)] != letter)
                children = (np.bitwise_count(self.low[node]) + np.bitwise_count(self.high[node])).astype(np.int64)
                of = np.repeat(np.arange(len(q)), children)
                every = self.first[node][of] + np.arange(len(of)) - np.repeat(np.cumsum(children) - children, children)
                wanted = np.full(len(q), 255, np.uint8)
                wanted[rest] = letter
                other = self.letter[every] != wanted[of]
                of, every = of[other], every[other]
                put = wanted[of] != 255
                states = (np.concatenate([q[rest][out], q[of], q[of][put]]), np.concatenate([node[rest][out], every, every[put]]), np.concatenate([after[out], at[of], at[of][put] + 1]))
                follow.append((True, *states))
            stack += [f for f in follow if len(f[1])]
        pairs = np.sort(np.concatenate(accepted)) if accepted else np.zeros(0, np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF

    def spelled(self, at: np.ndarray) -> list[str]:
        letters = np.flatnonzero(CODE != 255).astype(np.uint8)[self.text].tobytes().decode("latin-1")
        return [letters[a:b] for a, b in zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), strict=True)]

    def best(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given words that have near words here: their numbers, how many, and the number of the commonest, then first, of these."""
        q, word = self.near(text, starts)
        order = np.lexsort((word, -self.counts[word], q))
        own, at, n = np.unique(q[order], return_index=True, return_counts=True)
        return own, n, word[order][at]


def _shards(most: int):
    """Words of a task in tries of at most so many letters, as a row of arrays each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def shard() -> pa.RecordBatch:
            trie = Trie.build(*map(list, zip(*sorted(rows), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([getattr(trie, name).astype(kind).tobytes()], pa.binary()) for name, kind in KINDS.items()], names=list(KINDS))

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows and held + len(word) > most:
                    yield shard()
                    rows, held = [], 0
                rows.append((word, n))
                held += len(word)
        if rows:
            yield shard()

    return run


FOUND = "word string, n_near long, form_n long, form string"


def _walk(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie({name: np.frombuffer(raw, KINDS[name]) for name, raw in shared.value.items()})
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                words = batch.column(0).slice(start, STEP)
                own, n, form = trie.best(*packed(words.to_pylist()))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(own)), pa.array(n.astype(np.int64)), pa.array(trie.counts[form]), pa.array(trie.spelled(form), pa.string())], names=["word", "n_near", "form_n", "form"])

    return run


# ---- over the words ---------------------------------------------------------------------------------------------------


def near(spark: SparkSession, words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """words (word, n, each word once; written) -> word, n_near, form_n, form of those with near words: their number and the commonest."""
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(1, -(-letters // shard_chars))
    schema = ", ".join(f"{name} binary" for name in KINDS)
    # Ranges are drawn together where there are more of them than shards' worth of letters.
    shards = materialize(spark, words.repartitionByRange(parts, "word").coalesce(parts).mapInArrow(_shards(shard_chars), schema), "tries")
    found, open_, branches = [], [], None

    def close() -> None:
        nonlocal branches
        if open_:
            found.append(materialize(spark, branches, "near"))
        for shared in open_:
            shared.destroy()
        open_.clear()
        branches = None

    for row in shards.toLocalIterator():
        open_.append(spark.sparkContext.broadcast({name: bytes(row[name]) for name in KINDS}))
        part = words.select("word").mapInArrow(_walk(open_[-1]), FOUND)
        branches = part if branches is None else branches.union(part)
        if len(open_) == ROUND:
            close()
    close()
    if not found:
        return spark.createDataFrame([], FOUND)
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    best = F.min(F.struct((-F.col("form_n")).alias("turned"), "form"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.turned")).alias("form_n"), "b.form")


def roots(spark: SparkSession, forms: DataFrame, files: int) -> DataFrame:
    """forms (word, form), without cycles -> word, root: the last form that is reached."""
    at = materialize(spark, forms.select("word", F.col("form").alias("root")).coalesce(files), "roots")
    moved = True
    while moved:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(spark, step.coalesce(files), "roots")
        at, moved = step.select("word", "root"), not step.where("moved").isEmpty()
    return at


def variants(spark: SparkSession, words: DataFrame, times: int = TIMES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """words (word, n, each word once) -> word, n, n_near, form, form_n, root. A word's form is its commonest near word, if that is at
    least `times` (2 or more) as common."""
    words = materialize(spark, words.select("word", "n"), "words")
    # As many tasks and files as the words are worth, where there are more shuffle partitions.
    files = 1 + words.count() // FILE_WORDS
    found = words.join(near(spark, words, shard_chars), "word", "left")
    is_form = F.col("form_n") >= times * F.col("n")
    rows = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    rows = materialize(spark, rows.coalesce(files), "variants")
    last = roots(spark, rows.where("form is not null").select("word", "form"), files)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n").coalesce(files)


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(doc_text(table(spark, sf_dir, "documents")))
    return variants(spark, counted(noisy(runs(docs))))
