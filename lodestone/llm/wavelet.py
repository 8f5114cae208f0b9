"""Token ids in wavelet-matrix files (operator 3).

Documents are range-partitioned by doc_id, the bounds drawn from a sample of the ids alone; an id that is many rows is dealt over
all partitions it makes up. Each partition encodes its texts in order and writes a file whenever it holds
enough ids, so memory is bounded by a file and not by a partition. A file is one wavelet matrix: a bit-plane for each bit of an
id, highest first, each plane's order being that of the plane before with zeros moved ahead of ones; the planes are
compressed one by one. Rank samples over the planes give access to any position, counts of an id in any range and the
places of its occurrences, all from the one file.

Files go to the shared folder under the name of the task attempt that wrote them; a table of the files of the attempts that
counted is written by Spark itself, so a lost executor or a second attempt leaves at most unused files behind.

Defined results: a null or empty text is its end token alone; equal doc_ids are told apart by text (by a hash of it first, where they
fill partitions), and rows equal in both are each written; a null doc_id comes first.
Texts are encoded whole, however long. Columns besides doc_id and text are not
read, whatever their names. An empty table writes no files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.base import fresh_path, materialize, table
from lodestone.llm.encoding import default_vocabulary, encode, words

END = 2
FILE_IDS = 2_000_000
#: Sampled ids for each partition that bounds are drawn from.
SAMPLED = 100
MAGIC = b"LWM1"
SAMPLE = 8  # 64-bit words between rank samples
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


class WaveletMatrix:
    """Planes of packed bits with rank samples; positions count from 0 and ranges are half open."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        self.samples = [np.concatenate([[0], np.cumsum(np.bitwise_count(p).reshape(-1, SAMPLE).sum(axis=1, dtype=np.int64))]) for p in planes]
        self.zeros = [n - int(s[-1]) for s in self.samples]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        values = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, after = [], np.empty_like(values)
        for k in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = values & values.dtype.type(1 << k) != 0
            planes.append(_packed(ones))
            if k:
                zeros = len(ids) - int(np.count_nonzero(ones))
                np.compress(~ones, values, out=after[:zeros])
                np.compress(ones, values, out=after[zeros:])
                values, after = after, values
        return cls(len(ids), planes)

    def rank1(self, level: int, at: int) -> int:
        """Ones before a position."""
        word, bit = divmod(at, 64)
        first = word // SAMPLE * SAMPLE
        plane = self.planes[level]
        count = int(self.samples[level][word // SAMPLE]) + int(np.bitwise_count(plane[first:word]).sum())
        return count + ((int(plane[word]) & ((1 << bit) - 1)).bit_count() if bit else 0)

    def select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th one (or zero), from 0."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, at: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[at // 64]) >> (at % 64) & 1
            ones = self.rank1(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self.rank1(level, start), self.rank1(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def occurrences(self, value: int, start: int = 0, end: int | None = None) -> list[int]:
        """Positions of a value: each place in the last order is followed up through the planes by select."""
        a, b = self._range(value, start, self.n if end is None else end)
        out = []
        for at in range(a, b):
            for level in range(len(self.planes) - 1, -1, -1):
                bit = value >> (len(self.planes) - 1 - level) & 1
                at = self.select(level, bit, at - self.zeros[level] if bit else at)
            out.append(at)
        return sorted(out)

    def decode(self) -> np.ndarray:
        """All ids: from the last plane to the first, zeros and ones go back to where they came from."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        before = np.empty_like(values)
        for level in range(len(self.planes) - 1, -1, -1):
            ones, zeros = _unpacked(self.planes[level], self.n), self.zeros[level]
            values[zeros:] |= values.dtype.type(1 << (len(self.planes) - 1 - level))
            before[np.flatnonzero(~ones)] = values[:zeros]
            before[np.flatnonzero(ones)] = values[zeros:]
            values, before = before, values
        return values.astype("<u4")


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits in little-endian 64-bit words, at least one word more than the bits need and whole samples."""
    n_words = (len(bits) // 64 + SAMPLE) // SAMPLE * SAMPLE
    raw = np.zeros(n_words * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    raw[: len(packed)] = packed
    return raw.view("<u8")


def _unpacked(plane: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(plane.view(np.uint8), count=n, bitorder="little").view(bool)


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], level: int = 1) -> bytes:
    """A file: magic, length of the head, head as JSON, then the compressed table of documents and planes."""
    matrix, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=level).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u4").tobytes())
    planes = [pack(p.tobytes()) for p in matrix.planes]
    head = json.dumps({"n": len(ids), "n_docs": len(doc_ids), "docs": len(docs), "planes": [len(p) for p in planes]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, docs, *planes])


def from_bytes(raw: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    if raw[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    (size,) = struct.unpack("<I", raw[4:8])
    head, at = json.loads(raw[8 : 8 + size]), 8 + size
    unpack = zstandard.ZstdDecompressor().decompress
    docs, at, n = unpack(raw[at : at + head["docs"]]), at + head["docs"], head["n_docs"]
    ids, known, lengths = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, np.uint8, n, 8 * n), np.frombuffer(docs, "<u4", n, 9 * n)
    planes = []
    for length in head["planes"]:
        planes.append(np.frombuffer(unpack(raw[at : at + length]), "<u8"))
        at += length
    return WaveletMatrix(head["n"], planes), [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], lengths


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _writer(folder: str, vocabulary: str, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = words(vocabulary), np.array([end], "<u4").tobytes()
        fs, root = file_system(folder)
        task, seq = TaskContext.get(), 0
        held, doc_ids, lengths = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, doc_ids, lengths
            raw = to_bytes(np.frombuffer(b"".join(held), "<u4"), doc_ids, lengths)
            name = f"part-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.lwm"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(raw)
            row = [task.partitionId(), seq, f"{folder}/{name}", len(doc_ids), sum(lengths)]
            seq, held, doc_ids, lengths = seq + 1, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_ids"])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, known) + last
                held.append(ids)
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                size += lengths[-1]
                if size >= file_ids:
                    yield flush()
                    size = 0
        if doc_ids:
            yield flush()

    return run


def range_bounds(ids: DataFrame, partitions: int) -> list[int]:
    """partitions - 1 ids at most that cut the rows of ids (doc_id) into parts of about one size. At most about SAMPLED ids for each
    partition reach the driver, and no other column is read."""
    known = ids.where("doc_id is not null")
    n = known.count()
    if not n or partitions < 2:
        return []
    share = min(1.0, SAMPLED * partitions / n)
    drawn = np.sort((known if share == 1.0 else known.sample(share, 17)).toArrow().column(0).to_numpy())
    return [int(drawn[len(drawn) * k // partitions]) for k in range(1, partitions)] if len(drawn) else []


def range_of(doc_id: Column, text: Column, bounds: list[int]) -> Column:
    """The partition of a row by bisection of the bounds. An id that is itself one bound or several may lie in any partition that
    touches them, and its rows are dealt over these by a hash of their texts."""
    if not bounds:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def bisected(with_equal: bool) -> Column:
        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            at = F.get(cuts, mid)
            below = (s["lo"] < s["hi"]) & ((at <= doc_id) if with_equal else (at < doc_id))
            return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), state, step, lambda s: s["lo"])

    first, last = bisected(False), bisected(True)
    dealt = first + F.pmod(F.xxhash64(text), last - first + 1).cast("int")
    return F.when(doc_id.isNull(), 0).when(first < last, dealt).otherwise(first)


def write(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes docs (doc_id, text) as files in ascending order -> the table of files with the ids before each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(texts.select("doc_id"), partitions)
    ordered = texts.repartitionById(len(bounds) + 1, range_of(F.col("doc_id"), F.col("text"), bounds)).sortWithinPartitions("doc_id", "text")
    files = materialize(spark, ordered.mapInArrow(_writer(folder, vocabulary or default_vocabulary(), end, file_ids), MANIFEST), "files")
    # Running sums over a row for each partition, and within a partition over a row for each file.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    counted = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    return counted.select(*files.columns, (F.col("first") + F.col("inside")).alias("ids_before"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("ids_before").to_pylist(), strict=True):
            fs, name = file_system(path)
            with fs.open_input_stream(name) as f:
                matrix, doc_ids, lengths = from_bytes(f.read())
            raw, ends = matrix.decode().tobytes(), np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            pieces = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(p) for p in pieces], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(files: DataFrame) -> DataFrame:
    """A row for each document, from the files: its place among all ids, its length and the crc32 of its ids."""
    n = max(1, files.count())
    # The manifest is a few kilobytes; dealt by number, it is not drawn together into one task that reads every file.
    return files.repartition(n).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write(spark, table(spark, sf_dir, "documents"), fresh_path(spark, "wavelet")))
