"""Permutation repair and prompts, case by case."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import permutations, prompts, text
from lodestone.plans.rerank import CASES

#: order, strategy, duplicates, out of range, missing, clean, total failure of the cases, in their order.
EXPECTED = [
    ([2, 0, 1], "bracket", 0, 0, 0, True, False),
    ([0, 1, 2], "bracket", 0, 0, 0, True, False),
    (list(range(19, -1, -1)), "bracket", 0, 0, 0, True, False),
    ([0, 1, 2], "bracket", 1, 0, 0, False, False),
    ([0, 1, 2], "bracket", 0, 1, 0, False, False),
    ([1, 0, 2], "bracket", 0, 1, 0, False, False),
    ([1, 0, 2], "bracket", 0, 0, 2, False, False),
    ([1, 0, 2], "bracket", 0, 0, 0, True, False),
    ([2, 0, 1], "bracket", 0, 0, 0, True, False),
    ([1, 0, 2], "bare_int", 0, 0, 0, False, False),
    ([2, 0, 1], "bracket", 0, 0, 0, True, False),
    ([2, 0, 1], "bracket", 0, 0, 0, True, False),
    *[(list(range(5)), "none", 0, 0, 5, False, True)] * 4,
    (list(range(20)), "bracket", 1, 1, 19, False, False),
    ([0, 1, 2], "bracket", 0, 1, 3, False, False),
    ([0, 1], "bracket", 1, 0, 0, False, False),
    ([0, 1], "bracket", 1, 1, 1, False, False),
    ([1, 0], "bracket", 0, 1, 0, False, False),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(CASES)], "case_id int, raw string, num int")
    return {r.case_id: r.result for r in permutations.parsed(df, "raw", "num").collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_case(results, case):
    r = results[case]
    assert (list(r.order), r.strategy, r.n_duplicates, r.n_out_of_range, r.n_missing, r.is_clean, r.is_total_failure) == EXPECTED[case]
    assert sorted(r.order) == list(range(CASES[case][1]))
    assert bool(r.notes) == (not r.is_clean)


@pytest.mark.parametrize("num", [0, -1, None])
def test_num_has_to_be_positive(spark, num):
    with pytest.raises(Exception, match="num must be positive"):
        permutations.parsed(spark.createDataFrame([("[1]", num)], "raw string, num int"), "raw", "num").collect()


def docs(spark, n):
    rows = [(k + 1, f"d{k}", 10.0 - k, f"title {k}", f"text  of\ndoc {k}") for k in range(n)]
    return spark.createDataFrame([("q", rows)], "query string, docs array<struct<rank:int,doc_id:string,score:double,title:string,text:string>>")


def test_applied(spark):
    out = docs(spark, 3).select(permutations.applied(F.col("docs"), F.array(F.lit(2), F.lit(0), F.lit(1))).alias("r")).first().r
    assert [(x.llm_rank, x.doc.doc_id, x.doc.rank) for x in out] == [(1, "d2", 3), (2, "d0", 1), (3, "d1", 2)]


@pytest.mark.parametrize("order", [[0, 1], [0, 0, 1], [0, 1, 3], [0, 1, 2, 2]])
def test_not_a_permutation(spark, order):
    with pytest.raises(Exception, match="not a permutation"):
        docs(spark, 3).select(permutations.applied(F.col("docs"), F.array(*[F.lit(o) for o in order]))).collect()


def test_paper_prompt(spark):
    m = docs(spark, 3).select(prompts.paper_messages(F.lit("why {n}?"), F.col("docs")).alias("m")).first().m
    assert len(m) == 4 + 2 * 3
    assert [x.role for x in m] == ["system", "user", "assistant"] + ["user", "assistant"] * 3 + ["user"]
    assert m[3].content == "[1] title 0 text of doc 0" and m[4].content == "Received passage [1]."
    assert m[1].content.startswith("I will provide you with 3 passages, each indicated by number identifier []. \n") and m[1].content.endswith("query: why {n}?.")
    assert m[-1].content.startswith("Search Query: why {n}?. \nRank the 3 passages above")


def test_compact_prompt(spark):
    m = docs(spark, 2).select(prompts.compact_messages(F.lit("q"), F.col("docs")).alias("m")).first().m
    assert [x.role for x in m] == ["system", "user"]
    assert "\n\n[1] title 0 text of doc 0\n\n[2] title 1 text of doc 1\n\nSearch Query: q. \n" in m[1].content


def test_builders():
    assert prompts.builder("paper") is prompts.paper_messages
    with pytest.raises(KeyError, match="compact, paper"):
        prompts.builder("other")


def test_text(spark):
    df = spark.createDataFrame([(" a b \n c ", " x "), (None, None), ("", "y"), ("t", None)], "title string, text string")
    out = df.select(text.truncated("title", 2).alias("t"), text.passage(F.col("title"), F.col("text"), 3).alias("p"), text.contents("title", "text").alias("c")).collect()
    assert [r.t for r in out] == ["a b", "", "", "t"]
    assert [r.p for r in out] == ["a b c", "", "y", "t"]
    assert [r.c for r in out] == ["a b \n c   x", "", "y", "t"]
