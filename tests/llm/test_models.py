"""Language models, the quality network and token counts."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language, quality_net, token_counts


def test_kneser_ney_sums_to_one():
    words = ["abab", "abba", "baa", "b", "aab", "cab"] * 3 + ["bac"]
    keys, _ = language.units(words)
    grams, counts = np.unique(keys, return_counts=True)
    model = language.KneserNey(grams, counts)
    letters = sorted({ord(c) for w in words for c in w} | {32})
    for context in ("   ", "  a", " ab", "aba", "zzz", "  c"):
        packed = [int("".join(f"{ord(c):04x}" for c in context) + f"{u:04x}", 16) for u in letters]
        total = (2.0 ** model.log2(np.array(packed, np.uint64))).sum()
        unseen = 1 / model.alphabet
        assert total <= 1 + 1e-9 and total > 1 - unseen - 0.25
    assert model.log2(keys).max() <= 0


def test_units():
    keys, owner = language.units(["ab", "c"])
    as_text = ["".join(chr(int(k) >> s & 0xFFFF) for s in (48, 32, 16, 0)) for k in keys]
    assert as_text == ["   a", "  ab", " ab ", "   c", "  c "] and owner.tolist() == [0, 0, 0, 1, 1]


def test_language_counts_cover_all_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "FLUSH_WORDS", 2)
    rows = [("en", "the cat the dog"), ("en", "the hat"), ("de", "der die"), ("de", None)]
    found = {(r.lang, r.gram): r.n for r in language.ngram_counts(spark.createDataFrame(rows, "lang string, text string")).collect()}
    keys, _ = language.units("the cat the dog the hat".split())
    grams, counts = np.unique(keys, return_counts=True)
    assert {g: n for (lang, g), n in found.items() if lang == "en"} == dict(zip(grams.view(np.int64).tolist(), counts.tolist()))


def naive_kneser_ney(words):
    """Chances by the definition, from dictionaries: a word's letters and its end, each after the three characters before it."""
    from collections import Counter, defaultdict

    padded = lambda w: [("   " + w + " ")[i - 3 : i + 1] for i in range(3, len(w) + 4)]
    levels, counts = {}, Counter(g for w in words for g in padded(w))
    for k in (4, 3, 2, 1):
        once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
        discount = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        totals, types = Counter(), Counter()
        for g, c in counts.items():
            totals[g[:-1]] += c
            types[g[:-1]] += 1
        levels[k] = (counts, totals, types, discount)
        before = defaultdict(set)
        for g in counts:
            before[g[1:]].add(g[0])
        counts = {g: len(s) for g, s in before.items()}
    alphabet = len(levels[1][0]) + 1

    def chance(g):
        if not g:
            return 1 / alphabet
        counts, totals, types, discount = levels[len(g)]
        lower = chance(g[1:])
        if g[:-1] not in totals:
            return lower
        return max(counts.get(g, 0) - discount, 0) / totals[g[:-1]] + discount * types[g[:-1]] / totals[g[:-1]] * lower

    return lambda asked: -sum(math.log2(chance(g)) for w in asked for g in padded(w)) / sum(len(w) + 1 for w in asked)


def test_language_query_against_naive(spark):
    """The query's predictions are those of Kneser-Ney models written out by their definition and fitted to the same rows."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 3 == 1
    taught = {}
    for r in rows:
        if r.lang is not None and not held(r):
            taught.setdefault(r.lang, []).extend(words(r.text))
    models = {lang: naive_kneser_ney(w) for lang, w in sorted(taught.items())}
    found = {r.doc_id: r for r in language.op7_query(spark, sf).collect()}
    assert len(found) == len(rows)
    for r in [r for r in rows if len(r.text or "") < 4000][:60]:
        asked, got = words(r.text), found[r.doc_id]
        assert got.held_out == held(r)
        if not asked:
            assert got.lang_pred == "und"
            continue
        entropies = {lang: model(asked) for lang, model in models.items()}
        best = min(entropies, key=entropies.get)
        assert got.lang_pred == best and abs(got.entropy - entropies[best]) < 1e-9


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = language.op7_query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert held.right > 0.97 and 0 <= held.lo <= held.hi <= 1
    assert found.where("held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)").count() == 0


def test_language_odd_rows(spark, crowded, empty, odd_rows, folder):
    found = language.op7_query(spark, folder(documents=crowded)).collect()
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].lang_pred == "und" for k in (3, 4, 5, 8))
    assert all(r.lang_pred in ("en", "de", "el", "fr", "und") and 0 <= r.score <= 1 for r in found)


def test_no_letters(spark):
    docs = spark.createDataFrame([(1, "en", "aaa aab ²½ ②"), (2, "de", "ccc ccd")], "doc_id long, lang string, text string")
    known = language.fit(docs)
    found = known.classify(["² ½ 12 ②", "a²", None, "", "aab"])
    assert [f[0] for f in found] == ["und", "en", "und", "und", "en"] and found[1][2] == known.classify(["a"])[0][2]


def test_language_empty(spark, empty, folder):
    assert language.op7_query(spark, folder(documents=empty)).count() == 0


def test_language_keeps_every_gram(spark):
    docs = spark.createDataFrame([(1, "en", "aaa aaa aaa bbb"), (2, "de", "ccc ccc ddd")], "doc_id long, lang string, text string")
    small = language.fit(docs, max_ngrams=4)
    assert small.langs and small.classify(["aaa"])[0][0] == "en"


def test_language_block_size_changes_nothing(spark):
    docs = spark.createDataFrame([(1, "en", "the cat the dog the hat that then"), (2, "de", "der die das und der"), (3, "fr", "une"), (4, "fr", None)], "doc_id long, lang string, text string")
    asked = docs.unionByName(spark.createDataFrame([(5, None, "une der the"), (6, None, "zzz"), (7, None, "12"), (8, None, None)], docs.schema)).repartition(3)
    read = lambda n: {r.doc_id: tuple(r["__language"]) for r in language.with_language(spark, asked, language.fit(docs, max_ngrams=n)).collect()}
    whole = language.fit(docs)
    small = language.fit(docs, max_ngrams=4)
    assert len(whole.blocks) == 1 and len(small.blocks) == 3 and small.langs == whole.langs == ["de", "en", "fr"]
    assert read(4) == read(20) == read(language.MAX_NGRAMS)
    assert {k: v[0] for k, v in read(4).items()} == {k: v[0] for k, v in read(language.MAX_NGRAMS).items()} and read(4)[3][0] == "fr"


def test_context_sums_against_naive():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, n) for n in (0, 1, 2, 7, 30)]
    places, signs = quality_net.index_vectors(quality_net.CONTEXT)
    want = np.zeros((quality_net.BUCKETS, quality_net.CONTEXT))
    for d in docs:
        for i in range(len(d)):
            for j in range(max(0, i - 2), min(len(d), i + 3)):
                if i != j:
                    for k in range(2):
                        want[d[i], places[d[j], k]] += signs[d[j], k]
    assert np.allclose(quality_net.context_sums(docs), want)


def test_pooling_against_naive():
    """A document is the mean of its words' context vectors and of their own vectors, and four numbers."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(quality_net.BUCKETS, quality_net.CONTEXT))
    places, signs = quality_net.index_vectors(quality_net.OWN)
    for text in ("one", "one two two three", "a b a b, a! a! a!", "Öl öl 12 12 12"):
        words = quality_net.buckets_of(text)
        own = np.zeros(quality_net.OWN)
        for w in words:
            for k in range(2):
                own[places[w, k]] += signs[w, k] / len(words)
        shares = [sum(w == v for w in words) / len(words) for v in set(words.tolist())]
        same = np.mean([a == b for a, b in zip(words, words[1:])]) if len(words) > 1 else 0
        last = [np.log(np.linalg.norm(own) + 1e-3), np.log(sum(x * x for x in shares)), np.log1p(len(words)), np.log(same + 1e-3)]
        assert np.allclose(quality_net.features(text, vectors), np.concatenate([vectors[words].mean(axis=0), own, last]))
    assert not quality_net.features(None, vectors).any()


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    z, y = rng.normal(size=(12, 5)), rng.integers(0, 2, 12).astype(float)
    parts = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    for n, gradient in enumerate(quality_net.gradients(z, y, parts, 0.01)):
        for place in np.ndindex(parts[n].shape):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [p.copy() for p in parts]
                moved[n][place] += step
                ends.append(quality_net.loss(z, y, moved, 0.01))
            assert abs((ends[0] - ends[1]) / 2e-6 - gradient[place]) < 1e-6


def test_quality_query_against_one_process(spark):
    """The query's scores are those of vectors, features and network made in one process from the whole tables."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = sorted((r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5)
    sums = quality_net.context_sums([quality_net.buckets_of(t) for t in docs.values()])
    network = quality_net.Network(sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9))
    network.fit(np.stack([quality_net.features(docs[d], network.vectors) for d, _ in labels]), np.array([q for _, q in labels], float))
    want = dict(zip(docs, network.scores(list(docs.values())), strict=True))
    found = quality_net.op8_query(spark, sf).collect()
    assert len(found) == len(docs) and max(abs(r.score - want[r.doc_id]) for r in found) < 1e-6
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = quality_net.op8_query(spark, sf)
    assert found.count() == 10_000
    held = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = held.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")).alias("right"), F.avg(F.pow(F.col("score") - F.col("quality"), 2)).alias("brier")).first()
    assert right.right > 0.97 and right.brier < 0.03
    assert found.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_quality_odd_rows(spark, crowded, empty, odd_rows, folder):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, None), (None, 1, 0), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_net.op8_query(spark, folder(documents=crowded, labels=labels)).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)


def test_quality_without_labels(spark, odd, folder):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_net.op8_query(spark, folder(documents=odd, labels=labels)).collect()} == {0.5}


def greedy(word, pieces, mark):
    at = n = 0
    while at < len(word):
        ends = [j for j in range(len(word), at, -1) if (mark if at else "") + word[at:j] in pieces]
        if not ends:
            return -1
        at, n = ends[0], n + 1
    return n


def test_automaton_against_greedy():
    rng = random.Random(0)
    for mark in ("", "##"):
        for _ in range(800):
            pieces = {(mark if rng.random() < 0.6 else "") + "".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 10))}
            automaton = token_counts.Automaton(sorted(pieces), mark)
            for _ in range(15):
                word = "".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.randint(1, 12)))
                assert automaton.count(word) == greedy(word, pieces, mark)


def test_counts_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    known = token_counts.known_words(token_counts.default_vocabulary())
    import json

    with open(token_counts.default_vocabulary()) as f:
        pieces = {p.removesuffix("</w>") for p in json.load(f)["model"]["vocab"]}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = token_counts.op10_query(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found[:60]:
        words = [w for w, _ in known.tokenizer.pre_tokenizer.pre_tokenize_str(known.tokenizer.normalizer.normalize_str(texts[r.doc_id]))]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(greedy(w, pieces, "") for w in words), 0)


def test_count_odd_rows(spark, crowded, empty, odd_rows, folder):
    found = token_counts.op10_query(spark, folder(documents=crowded)).collect()
    assert len(found) == len(odd_rows)
    assert all(r.n_words == r.n_tokens == 0 for r in found if r.doc_id in (3, 4, 5))
    assert next(r.n_words for r in found if r.doc_id == 8) == 20_000
    assert token_counts.with_counts(empty).count() == 0
