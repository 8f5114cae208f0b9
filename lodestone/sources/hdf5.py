"""HDF5 files of vectors; needs h5py, which is optional."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 4096


def read_hdf5(spark: SparkSession, path: str, dataset: str, rows: int, partitions: int = 64) -> DataFrame:
    """A two-dimensional dataset of the given number of rows -> row, value. Tasks read ranges of rows; path has to be one they all see."""
    try:
        import h5py  # noqa: F401
    except ImportError as error:
        raise ImportError("reading HDF5 needs h5py, which is not installed") from error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(path, "r") as f:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    part = np.asarray(f[dataset][start : start + ROWS], np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), pa.array(list(part), pa.list_(pa.float32()))], names=["row", "value"])

    return spark.range(0, rows, ROWS, partitions).mapInArrow(run, "row long, value array<float>")
