import base64
import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe as b


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=b.default_pattern(), mergeable_ranks=b.read_ranks(b.default_ranks()), special_tokens={})


def ids_of(known, text):
    return memoryview(known.encode(text)).cast("i").tolist()


def want(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_against_the_library(spark, library):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in b.op11_query(spark, sf).collect()}
        assert found == {doc_id: want(library, text) for doc_id, text in texts.items()}


def test_odd_rows(spark, crowded, folder, odd_rows, library):
    found = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in b.op11_query(spark, folder(documents=crowded.repartition(5))).collect() if r.doc_id is not None)
    assert found == sorted((False, d, *want(library, text)) for d, text, *_ in odd_rows if d is not None)
    both = b.decoded(b.encoded(crowded, into="own", back="straight"), ids="own", into="bytes")
    assert both.columns == [*crowded.columns, "own", "straight", "bytes"]
    rows = both.collect()
    assert all(r.bytes == r.straight and bytes(r.bytes).decode() == (r.text or "") for r in rows)
    assert sorted(map(str, (tuple(r)[: len(crowded.columns)] for r in rows))) == sorted(map(str, map(tuple, crowded.collect())))


def test_empty(spark, empty, folder):
    assert b.op11_query(spark, folder(documents=empty)).count() == 0


def test_no_ids(spark):
    rows = b.decoded(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()
    assert [bytes(r.decoded) for r in rows] == [b"", b""]


def test_every_character(library):
    known = b.encoder(b.default_ranks(), b.default_pattern())
    for c in range(0, 0x110000, 1):
        if c < 0x3100 or c % 97 == 0 and not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b 1 {chr(c)}2{chr(c)}"
            assert ids_of(known, text) == library.encode_ordinary(text), hex(c)


def test_random_texts(library):
    known, rng = b.encoder(b.default_ranks(), b.default_pattern()), random.Random(5)
    for _ in range(10_000):
        text = "".join(rng.choice("aabetsin  \n'é日0=-\t\x1c") for _ in range(rng.randrange(1, 60)))
        assert ids_of(known, text) == library.encode_ordinary(text)
    for text in ("x" * 100_000, "ab" * 50_000, " " * 50_000, "=" * 70_000 + "1", "日本" * 20_000):
        assert ids_of(known, text) == library.encode_ordinary(text)


def test_pairs_by_definition():
    known, rng = b.encoder(b.default_ranks(), b.default_pattern()), random.Random(6)
    ids = sorted(known.length)
    for _ in range(20_000):
        x, y = (rng.choice(ids), rng.choice(ids)) if rng.random() < 0.5 else (rng.randrange(3000), rng.randrange(3000))
        entries = [known.entries[x], known.entries[y]]
        assert known.pairs.apart(x, y) == (b.merges(b"".join(entries), known.ranks)[0] == entries)


def test_small_vocabularies(tmp_path):
    """Vocabularies of few letters are where longest matches have to be taken back, and where an entry is out of the merges' reach."""
    rng, taken_back = random.Random(7), 0
    for n in range(60):
        entries = [bytes([k]) for k in range(256)]
        for _ in range(25):
            made = rng.choice(entries[97:100] + entries[256:]) + rng.choice(entries[97:100] + entries[256:])
            if made not in entries and len(made) < 9:
                entries.append(made)
        if n % 3 == 0:
            entries += [e for e in [b"abcabcab"] if e not in entries]
        path = tmp_path / f"{n}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(e) + b" %d\n" % k for k, e in enumerate(entries)))
        try:
            known = b.Encoder(str(path), b.default_pattern())
        except ValueError:
            continue
        library = tiktoken.Encoding("small", pat_str=b.default_pattern(), mergeable_ranks=known.ranks, special_tokens={})
        for _ in range(200):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
            assert ids_of(known, text) == library.encode_ordinary(text), (n, text)
            taken_back += known.laid(text)[0] != known.first(text, 0)
    assert taken_back > 100


def test_pieces_forgotten(spark, library, monkeypatch):
    """Tables that are emptied again and again change nothing."""
    known = b.Encoder(b.default_ranks(), b.default_pattern())
    known.pieces.most, known.pairs.most = 2_000, 5
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text")).limit(40).collect()]
    assert all(ids_of(known, t) == library.encode_ordinary(t) for t in texts)
