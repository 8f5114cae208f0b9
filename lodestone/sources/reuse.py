"""Results that are written once and found again: by what their inputs hold, not by when or where they were made.

A result's fingerprint is a digest of its name, its parameters, the library's code, and the path, length and time of change of every file it
is made of. The shared folder keeps a small file named by the fingerprint, which holds the path of the written result. Other applications
find it as well; a table that changes gives another fingerprint and so a new result. Of two applications that make the
same result at once, the first to write the small file wins, and the other reads what the first has written."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import scratch


def _files(spark: SparkSession, path: str) -> tuple:
    """Number, length and a digest of the files of a table; Spark lists them, and none is opened. A row, however many files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    row = listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.sum(F.pmod(F.xxhash64("modificationTime", "path"), F.lit(1 << 40)))).first()
    return path, *row


@functools.cache
def _code() -> str:
    """A digest of the library's own files, so that what other code has written is not taken for a result of this."""
    root, found = Path(__file__).parent.parent, hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for file in sorted((root / part).glob("*.py")):
            found.update(file.name.encode() + b"\0" + file.read_bytes())
    return found.hexdigest()


def fingerprint(spark: SparkSession, name: str, paths: Sequence[str], parameters: object = None) -> str:
    return hashlib.sha256(repr((name, _code(), [_files(spark, p) for p in paths], parameters)).encode()).hexdigest()[:32]


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/reused"


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def reused(spark: SparkSession, name: str, paths: Sequence[str], parameters: object, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), or what it gave before for the same name, parameters (by their repr) and content of the paths."""
    digest = fingerprint(spark, name, paths, parameters)
    entry = f"{_folder(spark)}/manifest/{digest}"
    fs, place = _at(spark, entry)
    if not fs.exists(place):
        path = f"{_folder(spark)}/{name}-{digest}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        try:
            out = fs.create(place, False)
        except Exception:
            if not fs.exists(place):
                raise
            fs.delete(_at(spark, path)[1], True)  # another application was first
        else:
            out.write(path.encode())
            out.close()
    return spark.read.parquet(spark.read.text(entry).first()[0])


def forget(spark: SparkSession) -> bool:
    """Deletes all results kept in the shared folder; whatever still reads them can't any more."""
    fs, place = _at(spark, _folder(spark))
    return bool(fs.delete(place, True))
