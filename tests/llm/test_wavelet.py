import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import encoding
from lodestone.llm import wavelet as w


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 2500])
def test_file(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype("<u4")
    matrix, docs, lengths = w.from_bytes(w.to_bytes(ids, [5, None], [n, 0]))
    assert (matrix.decode() == ids).all() and docs == [5, None] and lengths.tolist() == [n, 0]
    assert [matrix.access(i) for i in range(0, n, 11)] == ids[::11].tolist()
    for value in {*ids[:20].tolist(), 299, 300, 70_000}:
        assert matrix.count(value) == (ids == value).sum()
        assert matrix.count(value, n // 3, n) == (ids[n // 3 :] == value).sum()
        assert matrix.occurrences(value) == np.flatnonzero(ids == value).tolist()


def test_large_ids():
    ids = np.array([0, 2**31, 5, 2**31, 70_000], "<u4")
    matrix, _, _ = w.from_bytes(w.to_bytes(ids, [1], [5]))
    assert (matrix.decode() == ids).all() and matrix.occurrences(2**31) == [1, 3]
    with pytest.raises(ValueError):
        w.from_bytes(b"none")


def expected(rows, end):
    tokenizer = Tokenizer.from_file(encoding.default_vocabulary())
    at, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_against_tokenizer(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in w.op3_query(spark, sf).collect()) == expected(rows, 2)


def test_odd_rows(spark, odd, empty, odd_rows, tmp_path):
    files = w.write(spark, odd, f"file://{tmp_path}/files", file_ids=50)
    assert files.count() > 3
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got = sorted((tuple(r) for r in w.read_digests(files).collect()), key=lambda r: r[1])
    assert got == expected([r[:2] for r in order], 2)
    assert w.read_digests(w.write(spark, empty, f"file://{tmp_path}/none")).count() == 0


def test_ranges(spark):
    """Partitions ascend with the ids, are of about one size, and one id with a third of the rows is dealt over several."""
    from pyspark.sql import functions as F

    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 777L, id) AS doc_id", "concat('text ', id) AS text").repartition(4)
    bounds = w.range_bounds(rows.select("doc_id"), 12)
    assert bounds == sorted(bounds) and len(bounds) == 11 and bounds.count(777) > 2
    placed = rows.select("doc_id", w.range_of(F.col("doc_id"), F.col("text"), bounds).alias("part")).toPandas()
    assert placed.groupby("part").size().max() < 1000 and placed["part"].nunique() == 12
    ends = placed.groupby("part")["doc_id"].agg(["min", "max"]).sort_index()
    assert (ends["min"].to_numpy()[1:] >= ends["max"].to_numpy()[:-1]).all()
    assert w.range_bounds(rows.select("doc_id").where("false"), 12) == []
    order = rows.select(w.range_of(F.lit(None).cast("long"), F.col("text"), bounds).alias("part")).distinct().collect()
    assert [r.part for r in order] == [0]


def test_one_reading_task_a_file(spark, odd, crowded, tmp_path):
    files = w.write(spark, crowded, f"file://{tmp_path}/files", file_ids=50)
    assert w.read_digests(files).rdd.getNumPartitions() == files.count() > 1


def test_encoding_of_odd_texts():
    tokenizer, known = Tokenizer.from_file(encoding.default_vocabulary()), encoding.words(encoding.default_vocabulary())
    texts = ["", " ", "It's WE'LL don't 'S x'tY", "a\x1cb c d e\x85f", "ΣΊΣΥΦΟΣ Σ", "İI", "é é Å", "<|endoftext|>x<|ENDOFTEXT|>", "<|x|>", "½²³ ١٢٣ 12 1a2", "日本語\U0001f600!?", "%%%###a$$$", "ß ẞ µ ª º", "a\x00b", "﻿z"]
    for text in texts:
        assert encoding.encode(text, known) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
