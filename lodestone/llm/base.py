"""Shared plumbing of the training-data operators: inputs, scratch tables, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd 64-bit multipliers of the mixing steps (fixed values).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)

#: Bytes, as estimated, that a process's word table may hold before it is emptied, and the longest word it remembers; both change
#: speed and memory only.
MEMO_BYTES = 32 << 20
LONGEST = 64
#: What an entry takes besides the characters of its key: the objects and their share of the table.
ENTRY_BYTES = 200

_own_dir: list[str] = []
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and one machine does all
    the work (tests). On a cluster an unset one is an error: each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _own_dir[0]


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where it has fewer: a table in one small file would keep one core busy.
    Tables with a partition for each core, and so all large ones, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Deletes every table and folder that this process has written to the shared folder, and returns how many. Results that
    are read lazily from them can't be read any more, so it is called once they are written elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a written table in the shared folder, so a lost executor costs one task and not the chain."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_text(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty); whatever else docs holds is pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """df's columns as they are named, dots included."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most limit rows, those of the smallest hash of key. A count sets a bound on the hash first, so about one and a half
    times limit rows are sorted in all, and not limit rows from every partition."""
    space, n = 1 << 30, df.count()
    bound = space if n <= limit else min(space, int(space * (1.5 * limit + 1000) / n))
    place = F.pmod(F.xxhash64(key), F.lit(space))
    return df.where(place < bound).orderBy(place, key).limit(limit)


class Memo(dict):
    """key -> make(key), remembered within a number of bytes; long keys are made anew each time."""

    known: list[Memo] = []

    def __init__(self, make: Callable, most_bytes: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.held = make, most_bytes, 0
        Memo.known.append(self)

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            self.held += ENTRY_BYTES + len(key)
            if self.held > self.most:
                self.empty()
            self[key] = value
        return value

    def empty(self) -> None:
        self.clear()
        self.held = 0


def claim(*own: Memo) -> None:
    """Empties the tables of all other operators. A Python worker is used again from stage to stage, and what one stage
    remembers is of no use to the next."""
    for memo in Memo.known:
        if memo and not any(memo is o for o in own):
            memo.empty()


word_hash = Memo(xxhash.xxh64_intdigest)


def hashed_words(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; bytes.split() and bytes.lower() are exactly that."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= MIX_A
        out += hashes[j : j + n]
    return mixed(out)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; the whole sequence is one where there are fewer words."""
    hashes = hashed_words(text)
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(rolled(hashes, min(width, len(hashes))))
