"""Benchmark decontamination by greedy string tiling (operator 4).

Benchmark items are tokenized and their 5-token grams go into sorted indexes, each of a block of items of bounded size. All blocks
are broadcast, but a worker opens one at a time and holds it against a batch of documents, so memory is that of a block, and
one pass over the texts serves all. Grams that a
document shares with an item are seeds. Where the seeds of an item could cover enough of it, greedy string tiling runs on
the seeded parts of the document: running Karp-Rabin finds the longest matches of unmarked tokens, they are marked as
tiles, and the search length falls, so passages whose sentences were reordered are still covered. An item leaks into a document
when its tiles cover at least min_coverage of its tokens, or when one tile alone has LONG_TILE tokens: so long a verbatim part of a
long item is no accident.

Tokens are runs of letters, digits and underscores, lower-cased. Defined results: null and empty texts match nothing, and items without tokens too; an
item of fewer than 5 tokens leaks where it stands in a text as a whole, as one tile; equal items are each reported; repeated documents
are each reported; of tiles of one length the first in the item, then in the text, is marked first; texts are worked on whole, however long; a null doc_id is reported as null and judged in the filter like all others. The query reads doc_id and text
alone; the filter keeps all columns whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import MIX_A, claim, columns_of, free_name, mixed, rolled, spread, table

LEAST = 5
MIN_COVERAGE = 0.6
LONG_TILE = 30
#: Grams of the items in one broadcast block: about 40 MB with their tokens.
BLOCK_GRAMS = 500_000
#: Characters of text that are held against a block together.
BATCH_CHARS = 4 << 20
HITS = ("item_id", "item_tokens", "covered", "tiles")
words_of = re.compile(r"\w+").findall


class Index:
    """Grams of a block of items: sorted distinct hashes, and for each the (item, position) pairs that have it."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.tokens, self.least = [], [], least
        #: Items with fewer tokens than a gram, by their tokens.
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        grams, owners, positions = [], [], []
        for item_id, text in items:
            tokens = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").lower())], np.uint64)
            if len(tokens) < least:
                if len(tokens):
                    self.short[tuple(tokens.tolist())].append(item_id)
                continue
            grams.append(rolled(mixed(tokens), least))
            owners.append(np.full(len(grams[-1]), len(self.ids), np.int64))
            positions.append(np.arange(len(grams[-1])))
            self.ids.append(item_id)
            self.tokens.append(tokens)
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owners = np.concatenate(owners)[order] if grams else np.empty(0, np.int64)
        self.positions = np.concatenate(positions)[order] if grams else np.empty(0, np.int64)
        self.grams, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        self.short_firsts = np.array(sorted({key[0] for key in self.short}), np.uint64)
        self.short_sizes = sorted({len(key) for key in self.short})

    def short_hits(self, tokens: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The short items that stand in a document as a whole."""
        found = set()
        for at in np.flatnonzero(np.isin(tokens, self.short_firsts)).tolist():
            found |= {key for n in self.short_sizes if (key := tuple(tokens[at : at + n].tolist())) in self.short}
        return [(item, len(key), len(key), 1) for key in sorted(found) for item in self.short[key]]

    def hits(self, words: list[str], min_coverage: float, long_tile: int = LONG_TILE) -> list[tuple[int, int, int, int]]:
        """(item, its tokens, tokens covered, tiles) for the items that leak into a document of these words."""
        tokens = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        out = self.short_hits(tokens) if self.short else []
        if len(words) < self.least or not len(self.grams):
            return out
        known = np.cumsum(tokens > 0)
        whole = np.flatnonzero(known[self.least - 1 :] - np.concatenate([[0], known[: -self.least]]) == self.least)
        if not len(whole):
            return out
        windows = mixed(tokens)
        gram = np.zeros(len(whole), np.uint64)
        for j in range(self.least):
            gram = gram * MIX_A + windows[whole + j]
        gram = mixed(gram)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        found = self.grams[at] == gram
        seeds: dict[int, list[np.ndarray]] = defaultdict(list)
        by_gram: dict[int, list[int]] = defaultdict(list)
        for g, place in zip(at[found].tolist(), whole[found].tolist(), strict=True):
            by_gram[g].append(place)
        covers: dict[int, set[int]] = defaultdict(set)
        for g, places in by_gram.items():
            for k in range(self.starts[g], self.ends[g]):
                item = int(self.owners[k])
                covers[item].add(int(self.positions[k]))
                seeds[item].append(places)
        for item in sorted(covers):
            pattern = self.tokens[item]
            bound = np.zeros(len(pattern), bool)
            for p in covers[item]:
                bound[p : p + self.least] = True
            if bound.sum() < min(min_coverage * len(pattern), long_tile):
                continue
            tiles = greedy_tiles(seeded(tokens, seeds[item], self.least), pattern, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= min_coverage * len(pattern) or max((n for _, _, n in tiles), default=0) >= long_tile:
                out.append((self.ids[item], len(pattern), covered, len(tiles)))
        return out


def seeded(tokens: np.ndarray, places: list[list[int]], least: int) -> np.ndarray:
    """The parts of a document that lie in a seed, 0 (which matches nothing) between them."""
    marked = np.zeros(len(tokens) + 1, bool)
    for p in {p for group in places for p in group}:
        marked[p : p + least] = True
    keep = marked[:-1] | np.concatenate([[False], marked[:-2]])
    return np.where(marked[:-1], tokens, 0)[keep]


def greedy_tiles(text: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: tiles (start in text, start in pattern, length), none overlapping."""
    t, p = text.tolist(), pattern.tolist()
    free_t, free_p = [x != 0 for x in t], [True] * len(p)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(p))
    while True:
        matches = sorted(_matches(t, p, free_t, free_p, size), key=lambda m: (-m[2], m[1], m[0]))
        for i, j, n in matches:
            # A tile marked before may have taken part of this match; what is left of it is looked for again below.
            if all(free_t[i : i + n]) and all(free_p[j : j + n]):
                free_t[i : i + n] = [False] * n
                free_p[j : j + n] = [False] * n
                tiles.append((i, j, n))
        if _matches(t, p, free_t, free_p, size):
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


def _matches(t: list[int], p: list[int], free_t: list[bool], free_p: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Maximal matches of unmarked tokens, at least size long; windows meet by their Karp-Rabin hash and are then compared."""
    table: dict[int, list[int]] = defaultdict(list)
    for j, h in _windows(p, free_p, size):
        table[h].append(j)
    found = []
    for i, h in _windows(t, free_t, size) if table else ():
        for j in table.get(h, ()):
            if i and j and free_t[i - 1] and free_p[j - 1] and t[i - 1] == p[j - 1]:
                continue  # part of the match one to the left
            n = 0
            while i + n < len(t) and j + n < len(p) and t[i + n] == p[j + n] and free_t[i + n] and free_p[j + n]:
                n += 1
            if n >= size:
                found.append((i, j, n))
    return found


def _windows(tokens: list[int], free: list[bool], size: int, base: int = 1_000_003, modulus: int = (1 << 61) - 1) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of every window of unmarked tokens."""
    drop, h, run = pow(base, size - 1, modulus), 0, 0
    for i, token in enumerate(tokens):
        if not free[i]:
            h = run = 0
            continue
        if run >= size:
            h = (h - tokens[i - size] * drop) % modulus
        h = (h * base + token) % modulus
        run += 1
        if run >= size:
            yield i - size + 1, h


def blocks(items: DataFrame, grams: int = BLOCK_GRAMS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read partition by partition."""
    block, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "") // 4 + 1
        if held >= grams:
            yield block
            block, held = [], 0
    if block:
        yield block


def indexes(spark: SparkSession, items: DataFrame, grams: int = BLOCK_GRAMS) -> list[Broadcast]:
    return [spark.sparkContext.broadcast(Index(block)) for block in blocks(items, grams)]


def found_in(texts: list[str | None], shared: list[Broadcast], min_coverage: float) -> list[list[tuple[int, int, int, int]]]:
    """The items that leak into each text. With several blocks, each is opened in turn and let go before the next."""
    words, out = [words_of((t or "").lower()) for t in texts], [[] for _ in texts]
    for block in shared:
        index = block.value
        for own, hits in zip(words, out, strict=True):
            hits += index.hits(own, min_coverage)
        if len(shared) > 1:
            # The value is read from the local copy again when it is next asked for.
            del index, block._value
    return out


def slices(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, at most about BATCH_CHARS characters at a time."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, grams: int = BLOCK_GRAMS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, item_tokens, covered, tiles: a row for each leak."""
    shared = indexes(spark, items, grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            found = [h for texts in slices(batch.column(1)) for h in found_in(texts, shared, min_coverage)]
            rows = [(d, *h) for d, hits in zip(batch.column(0).to_pylist(), found, strict=True) for h in hits]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["doc_id", *HITS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in HITS))


def with_leaked(spark: SparkSession, docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, into: str = "__leaked", grams: int = BLOCK_GRAMS) -> DataFrame:
    """docs with the number of items that leak into each whole text."""
    shared = indexes(spark, items, grams)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim()
        for column in batches:
            yield pa.array([len(hits) for texts in slices(column) for hits in found_in(texts, shared, min_coverage)], pa.int64())

    return docs.withColumn(into, F.arrow_udf(count, "long")("text"))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that leaks into it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks(spark, docs, table(spark, sf_dir, "benchmark")).withColumn("coverage", F.round(F.col("covered") / F.col("item_tokens"), 6))


def filter_stage(spark: SparkSession, docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, grams: int = BLOCK_GRAMS) -> DataFrame:
    """docs into which no item leaks, columns unchanged."""
    leaked = free_name(docs, "__leaked")
    return with_leaked(spark, docs, items, min_coverage, leaked, grams).where(F.col(leaked) == 0).select(*columns_of(docs))
