import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import spelling as s

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(word):
    """What is left of a word without a letter, and with a hole in place of one."""
    return {(word[:k] + word[k + 1 :], "cut") for k in range(len(word))} | {(word[:k] + "*" + word[k + 1 :], "hole") for k in range(len(word))}


def near_words(words):
    """Pairs one edit apart, by the words' cuts and holes."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for left, kind in edits(w):
            if kind == "hole":
                holes[left].add(w)
            elif left in words:
                near[w].add(left)
                near[left].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def apart(a, b):
    """The edit distance by its definition."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def expected(counts):
    near, forms = near_words(set(counts)), {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(near[w]), counts[forms[w]] if w in forms else None))
    return out


def brute_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return expected({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def result(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        want = brute_force(rows)
        found = result(s.op13_query(spark, sf))
        assert found == want and sum(w[4] > 0 for w in want) > 100


def made_up(n=600, seed=2):
    """Words of few letters, so that most have near words, with counts over five powers of ten."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abÀÿé") for _ in range(rng.randrange(1, 8))) for _ in range(n)}
    return {w: int(10 ** rng.uniform(0, 5)) for w in words}


def test_near_by_definition():
    words = sorted(made_up(120))
    near = near_words(set(words))
    assert all((b in near[a]) == (apart(a, b) == 1) for a in words for b in words)
    trie = s.Trie.build(words, [1] * len(words))
    q, found = trie.near(*s.packed(words))
    assert set(zip(q.tolist(), found.tolist())) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if apart(a, b) == 1}
    assert trie.spelled(np.arange(len(words))) == words


@pytest.mark.parametrize("shard_chars", [1, 60, 10_000])
def test_shards(spark, monkeypatch, shard_chars):
    """Shards of a word, of some, and one shard: all the same, also where several rounds are needed."""
    counts = made_up(14 if shard_chars == 1 else 600, seed=4)
    monkeypatch.setattr(s, "ROUND", 5)
    want = expected(counts)
    assert shard_chars == 1 or any(w[1] and w[1] != w[2] for w in want)
    assert result(s.variants(spark, spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), shard_chars=shard_chars)) == want


def test_odd_rows(spark, crowded, folder, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert result(s.op13_query(spark, folder(documents=crowded.repartition(5)))) == brute_force(rows)


def test_noise_letters_and_hot_words(spark, folder):
    rng = random.Random(9)
    words = ["Élégance", "ÉLÉGANCES", "elegance", "straßen×÷", "abcdefg", "abcdefgh", "ABCDEFG", "abcdef", "x" * 3000, "x" * 2999]
    rows = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(300)] + [(None, "abcdefg " * 5000), (7, None), (8, "")]
    want = brute_force(rows)
    assert len(want) > len(words)
    assert result(s.op13_query(spark, folder(documents=spark.createDataFrame(rows, "doc_id long, text string")))) == want


def test_empty(spark, empty, folder):
    assert s.op13_query(spark, folder(documents=empty)).count() == 0
