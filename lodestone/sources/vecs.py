"""fvecs and ivecs files: every row is its dimension as a 32-bit integer, then that many 32-bit values, little-endian."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task reads.
SPLIT_BYTES = 32 << 20


def encoded(rows: np.ndarray, kind: str = "<f4") -> bytes:
    rows = np.asarray(rows, kind)
    head = np.full((len(rows), 1), rows.shape[1], "<i4").view(kind)
    return np.hstack([head, rows]).tobytes()


def decoded(raw: bytes, kind: str = "<f4") -> np.ndarray:
    if not raw:
        return np.zeros((0, 0), kind)
    (d,) = np.frombuffer(raw, "<i4", 1)
    return np.frombuffer(raw, kind).reshape(-1, int(d) + 1)[:, 1:]


def _rows(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = decoded(raw, kind)
                for k in range(0, len(found), 4096):
                    part = found[k : k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(list(part), pa.list_(pa.float32() if kind == "<f4" else pa.int32()))],
                        names=["path", "row", "value"],
                    )

    return run


def read_vecs(spark: SparkSession, path: str, kind: str = "<f4", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Files (or folders of them) -> path, row (place in its file) and value.

    A file's records are of one length, given by the number it starts with, so it is read in parts of about split_bytes, cut between
    records, by any number of tasks. What a record says of its length is checked."""
    context, parts = spark.sparkContext, []
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    for file, length in listed.collect():  # a row for each file; contents aren't read
        dims = int(np.frombuffer(context.binaryRecords(file, 4).first(), "<i4")[0])
        record = 4 * (dims + 1)
        if dims < 0 or length % record:
            raise ValueError(f"{file}: {length} bytes are no rows of {dims} values")
        conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record), "mapreduce.input.fileinputformat.split.maxsize": str(max(record, split_bytes))}
        records = context.newAPIHadoopFile(file, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        parts.append(spark.createDataFrame(records.map(lambda r, file=file: (file, int(r[0]), bytes(r[1]))), "path string, row long, raw binary", verifySchema=False))
    value = f"array<{'float' if kind == '<f4' else 'int'}>"
    found = spark.createDataFrame([], "path string, row long, raw binary")
    for part in parts:
        found = found.union(part)
    return found.mapInArrow(_records(kind), f"path string, row long, value {value}")


def _records(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [row for raw in batch.column(2).to_pylist() for row in decoded(raw, kind)]
            if len(values) != batch.num_rows:
                raise ValueError("rows of different dimensions in one file")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.float32() if kind == "<f4" else pa.int32()))], names=["path", "row", "value"])

    return run


def decode_column(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Rows of encoded vectors -> key, row, value."""
    return df.select(F.col(key).cast("string").alias("path"), raw).mapInArrow(_rows("<f4"), "path string, row long, value array<float>")


def encode_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, raw: one encoded row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [encoded(np.asarray([v], "<f4")) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["key", "raw"])

    return df.select(F.col(key).cast("long").alias("key"), value).mapInArrow(run, "key long, raw binary")
