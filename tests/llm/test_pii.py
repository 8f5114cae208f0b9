import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii

# The patterns as they are stated, without any care for speed.
NAIVE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(pii.only_digits(s)) <= 19 and pii.luhn(pii.only_digits(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(pii.only_digits(s)) <= 15),
}


def naive(text):
    return [(k, *m.span()) for k, (p, ok) in NAIVE.items() for m in re.finditer(p, text) if ok(m.group())]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "B7", "@", ".", "-", "+1", "5", "42", " ", "(", ")", "255", "256", "é", "%", "_", "4111111111111111", "a@b.co", "1.2.3.4", "+1 (555) 010-9999", "\n"]), max_size=25).map("".join))
def test_base_spans_against_patterns(text):
    assert pii.base_spans(text) == naive(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")


def test_base_spans_on_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert pii.base_spans(r.text) == naive(r.text)


def test_viterbi_against_enumeration():
    """The dynamic program finds the best of all segmentations."""
    import numpy as np

    weights = np.random.default_rng(1).normal(0, 1, (len(pii.KINDS), len(pii.FEATURES)))
    text = "token = 12ab mail a at b dot c"
    tokens = [m.span() for m in pii.TOKEN.finditer(text)][:7]
    segments = pii.lattice(text, tokens, [False] * len(tokens))
    score = {(i, j): float(weights[:, f].sum(axis=1).max()) for i, j, f in segments}

    def best(at):
        if at >= len(tokens):
            return 0.0
        return max([best(at + 1), *(score[at, j] + best(j) for j in range(at + 1, len(tokens) + 1) if (at, j) in score)])

    found = pii.decode(len(tokens), segments, weights)
    assert abs(sum(score[i, j] for i, j, _ in found) - best(0)) < 1e-9
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_gradient():
    import numpy as np

    sentence = pii.training_set(1, seed=3)[0]
    weights = np.random.default_rng(2).normal(0, 0.3, (len(pii.KINDS), len(pii.FEATURES)))
    value, gradient = pii.log_likelihood(*sentence, weights)
    assert value < 0
    for k, f in ((0, 0), (4, pii.PLACE["hex_run"]), (3, pii.PLACE["digit_groups"])):
        moved = weights.copy()
        moved[k, f] += 1e-5
        assert abs((pii.log_likelihood(*sentence, moved)[0] - value) / 1e-5 - gradient[k, f]) < 1e-3


def test_held_out_accuracy():
    rng, weights, right, missed, wrong = random.Random(77), pii.trained(), 0, 0, 0
    for _ in range(300):
        text, spans = pii._generated(rng)
        found = set(pii.field_spans(text, [], weights))
        right, missed, wrong = right + len(found & set(spans)), missed + len(set(spans) - found), wrong + len(found - set(spans))
    assert right / (right + missed) > 0.95 and right / (right + wrong) > 0.95


def test_added_spans_keep_off_base_spans(spark):
    weights = pii.trained()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        base, spans = pii.all_spans(r.text, weights)
        assert set(base) <= set(spans)
        added = [s for s in spans if s not in base]
        assert all(b <= x or y <= a for _, a, b in added for _, x, y in base)
        assert {k for k, _, _ in added} <= {"secret"}


def whole_lattice(text, base, weights):
    """One lattice over the whole text, with every segment there is."""
    taken = [(a, b) for _, a, b in base]
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    blocked = [any(x < b and a < y for x, y in taken) for a, b in tokens]
    return [(pii.KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k in pii.decode(len(tokens), pii.lattice(text, tokens, blocked), weights)]


def test_windows_lose_nothing(spark):
    """What the windows about anchors find is what one lattice over the whole text finds."""
    weights, rng = pii.trained(), random.Random(31)
    assert pii.prunable(weights) and not pii.prunable(weights + 1)
    texts = [" ".join(pii._generated(rng)[0] + " plain words " * rng.randrange(20) for _ in range(3)) for _ in range(25)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 1200]
    for text in texts:
        base = pii.base_spans(text)
        assert pii.field_spans(text, base, weights) == whole_lattice(text, base, weights)
        # Weights for which the bound does not hold: the whole text is one window.
        assert pii.field_spans(text[:400], [], weights + 1) == whole_lattice(text[:400], [], weights + 1)


def test_time_is_linear():
    """Texts that make a careless pattern or window quadratic."""
    import time

    weights = pii.trained()
    for part in ("x", "at", "dot", "a-", "1,", "a@", "+1", "atdot", "- ", "1.", "_"):
        text, began = part * 50_000 + " end", time.process_time()
        pii.all_spans(text[: 40_000 if part in ("1,", "1.", "+1", "a@") else None], weights)
        assert time.process_time() - began < 20, part


def test_secrets_without_digits_and_hyphened():
    weights = pii.trained()
    for text, secret in (
        ('password = "abcdefGHIJklmnopqrstu"', "abcdefGHIJklmnopqrstu"),
        ('secret="abcdefghijklmnopqrstuvwxyzabcdef"', "abcdefghijklmnopqrstuvwxyzabcdef"),
        ("token: QWERTYUIOPASDFGHJKLZXCV", "QWERTYUIOPASDFGHJKLZXCV"),
        ("password: correcthorsebatterystaple", "correcthorsebatterystaple"),
        ("key = 550e8400-e29b-41d4-a716-446655440000 and", "550e8400-e29b-41d4-a716-446655440000"),
    ):
        assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, weights)[1]] == [("secret", secret)]
    for text in ("state-of-the-art-technology", "password: hello", "on 2021-03-04 the key = VALUE"):
        assert pii.all_spans(text, weights)[1] == []


def test_masked():
    text = "mail a@b.co or +1 (555) 010-9999 now"
    assert pii.masked(text, pii.base_spans(text)) == "mail [EMAIL] or [PHONE] now"
    assert pii.masked("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"


def test_odd_rows(spark, odd, crowded, empty, odd_rows, folder):
    found = pii.op1_query(spark, folder(documents=crowded)).collect()
    assert len(found) == len(odd_rows)
    one = next(r for r in found if r.doc_id == -5)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.n_spans) == (1, 1, 1, 1, 4)
    assert all(r.n_spans == len([s for s in r.spans.split(",") if s]) for r in found)
    out = pii.mask_stage(crowded)
    assert out.columns == crowded.columns
    rows = out.collect()
    assert next(r.text for r in rows if r.doc_id == -5) == "[EMAIL], [PHONE], [IP], [CARD]"
    assert next(r for r in rows if r.doc_id == 3).text is None
    assert pii.mask_stage(empty).count() == 0
