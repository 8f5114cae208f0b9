import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm import encoding
from lodestone.llm import packing as p


def test_fill_against_enumeration():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.randrange(5, 40)
        counts = {length: rng.randrange(1, 4) for length in rng.sample(range(1, capacity), min(4, capacity - 1))}
        longest = max(counts)
        used = p.fill(counts, capacity)
        assert used[longest] >= 1 and all(used[k] <= counts[k] for k in used)
        total = sum(k * n for k, n in used.items())
        lengths = sorted(counts)
        best = max(t for times in product(*[range(counts[k] + 1) for k in lengths]) if times[lengths.index(longest)] and (t := sum(k * n for k, n in zip(lengths, times))) <= capacity)
        assert total == best


def test_plan_places_everything():
    rng = random.Random(7)
    counts = Counter(rng.randrange(1, 200) for _ in range(3000))
    windows = defaultdict(list)
    for length, first, end, window, times, offset in p.plan(counts, 200)[0].tolist():
        for rank in range(first, end):
            inside = rank - first
            windows[window + inside // times].append((offset + inside % times * length, length))
    assert Counter(n for w in windows.values() for _, n in w) == counts
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 200
    assert len(windows) <= 1.01 * sum(k * n for k, n in counts.items()) / 200 + 2
    assert len(p.plan({}, 200)[0]) == 0


def test_only_full_windows():
    """What is handed on could fill no window: the placed windows are full, and every piece is in one or handed on."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        lengths = rng.integers(1, 60, rng.integers(0, 300))
        window, offset, windows = p.places(lengths, 60, only_full=True)
        assert sorted(set(window[window >= 0].tolist())) == list(range(windows))
        for w in range(windows):
            at = 0
            for n in np.flatnonzero(window == w)[np.argsort(offset[window == w])]:
                assert offset[n] == at
                at += lengths[n]
            assert at == 60
        window, _, windows = p.places(lengths, 60, only_full=False)
        assert (window >= 0).all() and (len(lengths) == 0 or window.max() + 1 == windows)


def check(found, rows, capacity=2048):
    """Every id in one piece, sequences gapless from 0 and within capacity."""
    tokenizer = Tokenizer.from_file(encoding.default_vocabulary())
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in found:
        pieces[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for doc_id, all_ids in texts.items():
        for ids in all_ids:
            for start in range(0, len(ids), capacity):
                part = ids[start : start + capacity]
                want[doc_id][start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert pieces == want
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in found)


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        sequences, tokens = check(p.op6_query(spark, sf).collect(), rows)
        assert sequences * 2048 <= tokens * 1.02 + 2048


def test_odd_rows(spark, odd, crowded, empty, odd_rows):
    check(p.digest(p.pack(spark, crowded.repartition(5))).collect(), [r[:2] for r in odd_rows])
    assert p.pack(spark, empty).count() == 0


def test_groups(spark, odd, odd_rows):
    """Groups of a few tokens, in one task and in many: nothing is lost between the levels."""
    for parts in (1, 7):
        check(p.digest(p.pack(spark, odd.repartition(parts), group_tokens=3000)).collect(), [r[:2] for r in odd_rows])
