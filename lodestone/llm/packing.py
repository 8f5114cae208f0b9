"""Packing by minimum bin slack (operator 6).

A document of more than one window fills windows of its own; what remains of it, shorter than a window, is packed. Only the
lengths of the remainders decide, and there are fewer of them than the window has tokens, so packing works on a histogram:
the longest remaining length opens a window, a subset-sum over bitsets (one bit for each reachable fill, one stage for each
power-of-two share of a length's count) finds the multiset of remaining lengths that comes closest to the capacity, and the
stages are walked back for the counts. The pattern is used as often as the counts allow.

Every task packs what it has read by itself, at most GROUP_TOKENS tokens at a time, but only into windows that become full to the
last token. The pieces that fill none are handed on, and tasks of up to GROUP_TOKENS tokens of them pack those with what slack it takes.
So there is no histogram of the whole table, and a small table's remainders all meet in one task. Windows are numbered within their
task; a table of a row for each task has the windows before it, and is the only thing that is broadcast.

Defined results: a null or empty text is its end token alone; every id lies in exactly one piece; rows with equal or null
doc_id are packed each by itself. Texts are tokenized whole, however long; of fillings that come equally close any may be taken. Columns besides doc_id and text are not read, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.base import materialize, spread, table
from lodestone.llm.encoding import default_vocabulary, encode, words

CAPACITY = 2048
END = 1
#: Tokens that a task holds and packs together.
GROUP_TOKENS = 16_000_000
#: Rows of an Arrow batch that a task hands out.
BATCH = 2_000
#: window and offset are null where a piece is handed on.
PLACED = "doc_id long, start long, length long, doc_tokens long, ids binary, level int, part int, window long, offset long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the least slack that holds the longest length: length -> times.

    Bit f of a stage is set if its lengths can fill f tokens; each length enters in shares of 1, 2, 4, ... copies."""
    longest = max(counts)
    shares, stages = [(longest, 1)], [1 << longest]
    left = {**counts, longest: counts[longest] - 1}
    limit, full = (1 << (capacity + 1)) - 1, 1 << capacity
    for length in sorted(left, reverse=True):
        copies, share = min(left[length], (capacity - longest) // length), 1
        while copies > 0 and not stages[-1] & full:
            share = min(share, copies)
            stages.append((stages[-1] | stages[-1] << (share * length)) & limit)
            shares.append((length, share))
            copies -= share
            share *= 2
        if stages[-1] & full:
            break
    used, at = Counter(), stages[-1].bit_length() - 1
    for k in range(len(stages) - 1, 0, -1):
        length, share = shares[k]
        if not stages[k - 1] >> at & 1:
            used[length] += share
            at -= share * length
    used[longest] += 1
    return dict(used)


def plan(counts: dict[int, int], capacity: int = CAPACITY, only_full: bool = False) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, end rank, first window, times in a window, offset in the window) for a histogram of lengths, and the
    number of windows. With only_full, a length that can't open a window to be filled to the last token is passed over; what
    is left only gets less, so it never could later."""
    left, taken, window, rows = {k: n for k, n in counts.items() if n}, Counter(), 0, []
    while left:
        used = fill(left, capacity)
        if only_full and sum(length * times for length, times in used.items()) < capacity:
            del left[max(left)]
            continue
        windows = min(left[length] // times for length, times in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            times = used[length]
            rows.append((length, taken[length], taken[length] + times * windows, window, times, offset))
            taken[length] += times * windows
            left[length] -= times * windows
            offset += times * length
            if not left[length]:
                del left[length]
        window += windows
    return np.array(sorted(rows), np.int64).reshape(len(rows), 6), window


def places(lengths: np.ndarray, capacity: int, only_full: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Window (-1 where a piece gets none) and offset of each piece, and the number of windows. Pieces of one length are alike
    and take their places in the order in which they come."""
    window, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    whole = lengths == capacity
    window[whole], first = np.arange(whole.sum()), int(whole.sum())
    short = np.flatnonzero(~whole)
    kinds, counts = np.unique(lengths[short], return_counts=True)
    rows, windows = plan(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), capacity, only_full)
    if len(rows):
        order = short[np.argsort(lengths[short], kind="stable")]
        own = lengths[order]
        rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        # One sorted key for (length, rank): the plan's ranges of a length are gapless from 0.
        row = rows[np.maximum(np.searchsorted(rows[:, 0] << 40 | rows[:, 1], own << 40 | rank, side="right") - 1, 0)]
        found = (row[:, 0] == own) & (rank < row[:, 2])
        inside = rank - row[:, 1]
        window[order[found]] = (first + row[:, 3] + inside // row[:, 4])[found]
        offset[order[found]] = (row[:, 5] + inside % row[:, 4] * own)[found]
    return window, offset, first + windows


class _Group:
    """Pieces that a task holds until it packs them; windows are numbered on from group to group."""

    def __init__(self, level: int, capacity: int, only_full: bool):
        self.level, self.capacity, self.only_full = level, capacity, only_full
        self.part, self.windows = TaskContext.get().partitionId(), 0
        self.held: list[list] = [[] for _ in range(5)]
        self.tokens = 0

    def add(self, doc_id: int | None, start: int, length: int, total: int, ids: bytes) -> None:
        for column, value in zip(self.held, (doc_id, start, length, total, ids), strict=True):
            column.append(value)
        self.tokens += length

    def packed(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.tokens = self.held, [[] for _ in range(5)], 0
        if not held[0]:
            return
        window, offset, windows = places(np.array(held[2], np.int64), self.capacity, self.only_full)
        none = window < 0
        table = pa.table(
            {
                **{name: pa.array(column, kind) for name, column, kind in zip(("doc_id", "start", "length", "doc_tokens", "ids"), held, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)},
                "level": pa.array(np.full(len(window), self.level, np.int32)),
                "part": pa.array(np.full(len(window), self.part, np.int32)),
                "window": pa.array(self.windows + window, mask=none),
                "offset": pa.array(offset, mask=none),
            }
        )
        self.windows += windows
        yield from table.to_batches(BATCH)


def _pieces(path: str, capacity: int, end: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group = words(path), _Group(1, capacity, only_full=True)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py(), known) + last
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    group.add(doc_id, start, length, total, ids[4 * start : 4 * (start + length)])
                if group.tokens >= group_tokens:
                    yield from group.packed()
        yield from group.packed()

    return run


def _rest(capacity: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(2, capacity, only_full=False)
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                group.add(*row)
                if group.tokens >= 2 * group_tokens:
                    yield from group.packed()
        yield from group.packed()

    return run


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> pieces with their ids (little-endian unsigned 32-bit), sequence_id (gapless from 0) and offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(spark, texts.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, end, group_tokens), PLACED), "pieces")
    rest = pieces.where("window is null").select("doc_id", "start", "length", "doc_tokens", "ids")
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if tokens:
        rest = materialize(spark, rest.repartition(-(-tokens // group_tokens)).mapInArrow(_rest(capacity, group_tokens), PLACED), "rest")
        pieces = pieces.where("window is not null").union(rest)
    counts = materialize(spark, pieces.groupBy("level", "part").agg((F.max("window") + 1).alias("n")), "windows")
    before = Window.orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("level", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # A row of a few bytes for each task that packed anything.
    placed = pieces.join(F.broadcast(firsts), ["level", "part"])
    return placed.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("first") + F.col("window")).alias("sequence_id"), "offset")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark, spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
