"""Quality rules as weak supervision (operator 9).

Every rule looks at a document and votes good (+1), bad (-1) or abstains (0). Nobody says how far a rule can be
trusted: expectation-maximisation over the counts of vote patterns estimates, for a hidden good/bad class, how often each
rule casts each vote in each class. The posterior probability of "good" then decides, instead of all rules having to pass.

Only the table of vote patterns (at most 3^10 rows whatever the input) reaches the driver.

Defined results: a null or empty text has no words, fails the base rule and is dropped. Rows are judged one by one, so
repeated rows, equal ids and null ids get the same verdict as the text alone would. Texts are read whole, however long. The stage keeps all columns whatever their
names; op9_query reads doc_id and text alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.base import columns_of, free_name, materialize, rolled, spread, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_shouts", "n_pipes", "n_stutters", "n_distinct")
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + EXTRA])


def repeat_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of width words found twice or more."""
    windows = rolled(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int32)
    found = np.flatnonzero(np.isin(windows, twice))
    np.add.at(edges, found, 1)
    np.add.at(edges, found + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1]) > 0))


def measure_text(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    letters = len(raw) - len(raw.translate(None, LETTERS))
    order = np.sort(hashes)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(hashes),
        len(lines),
        len(raw) - len(raw.translate(None, CAPITALS)),
        letters,
        text.count("!"),
        text.count("|"),
        int(np.count_nonzero(hashes[1:] == hashes[:-1])),
        len(words) and 1 + int(np.count_nonzero(order[1:] != order[:-1])),
    )


def _measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [measure_text(t) for t in texts.to_pylist()]
        columns = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
        yield pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(len(MEASURES))], names=MEASURES.names)


def measured(docs: DataFrame, into: str = "__measures") -> DataFrame:
    """docs with a struct of counts for each whole text."""
    return docs.withColumn(into, measure_udf()("text"))


def measure_udf():
    return F.arrow_udf(_measure, MEASURES)


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rule_votes(m: str = "__measures") -> dict[str, Column]:
    """One column of votes for each rule."""
    c = {n: F.col(f"{m}.{n}") for n in MEASURES.names}
    n, least = c["n_words"], F.greatest(c["n_words"], F.lit(1))
    return {
        "length": vote(n < 20, n >= 40),
        "symbols": vote(c["n_symbols"] * 10 > n, c["n_symbols"] * 50 <= n),
        "dup_lines": vote(c["n_dup_lines"] * 3 > c["n_lines"], c["n_dup_lines"] * 20 <= c["n_lines"]),
        "repeats": vote(c["n_repeat_words"] * 10 > n * 3, c["n_repeat_words"] * 20 <= n),
        "case": vote(c["n_upper"] * 2 > c["n_letters"], c["n_upper"] * 5 <= c["n_letters"]),
        "word_length": vote((c["word_chars"] > least * 15) | (c["word_chars"] < least * 2), (c["word_chars"] <= least * 10) & (c["word_chars"] >= least * 3)),
        "shouts": vote(c["n_shouts"] * 5 > n, c["n_shouts"] * 50 <= n),
        "pipes": vote(c["n_pipes"] * 10 > n, c["n_pipes"] * 50 <= n),
        "stutters": vote(c["n_stutters"] * 10 > n, c["n_stutters"] * 50 <= n),
        "variety": vote(c["n_distinct"] * 10 < n, c["n_distinct"] * 10 >= n * 2),
    }


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, false_alarms: float = 0.002, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) with their counts: the share of good documents, and
    chance[class, rule, vote + 1] of each vote. Class 0 is bad, class 1 good. It starts from "bad if any rule says so",
    which also settles which of the two classes is which, and documents that no rule objects to stay good while it learns.
    false_alarms bounds how often a rule says "bad" of a good
    document. Each rule looks for one kind of junk, and kinds seldom meet in one document: without these two holds the likelihood
    is highest where only the kind that most rules see is "bad", or where "bad" is a large class that few rules see."""
    rules = patterns.shape[1]
    chance = np.tile(np.array([[0.3, 0.2, 0.5], [0.02, 0.08, 0.9]])[:, None, :], (1, rules, 1))
    if not len(counts) or counts.sum() == 0:
        return 0.5, chance
    counts = counts.astype(float)
    quiet = ~(patterns < 0).any(axis=1)
    good = np.where(quiet, 0.999, 0.001)
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    share = last = 0.5
    silent = (np.einsum("p,pr->r", counts, one_hot[:, :, 1]) + 0.5) / (counts.sum() + 1)
    for _ in range(rounds):
        for k, weight in enumerate((1 - good, good)):
            mass = np.einsum("p,prv->rv", weight * counts, one_hot) + 0.5
            # A rule abstains as often in either class, so silence is no evidence.
            spoken = mass[:, [0, 2]] / mass[:, [0, 2]].sum(axis=1, keepdims=True) * (1 - silent)[:, None]
            chance[k] = np.stack([spoken[:, 0], silent, spoken[:, 1]], axis=1)
        chance[1, :, 0] = np.minimum(chance[1, :, 0], false_alarms)
        # A bad vote never speaks for "good", nor a good vote for "bad": rules are no worse than chance.
        for v, (more, less) in ((0, (0, 1)), (2, (1, 0))):
            chance[more, :, v] = np.maximum(chance[more, :, v], chance[less, :, v])
        share = float((good * counts).sum() + 1) / (counts.sum() + 2)
        good = np.where(quiet, 0.999, posterior(patterns, share, chance))
        if abs(share - last) < tolerance:
            break
        last = share
    return share, chance


def posterior(patterns: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    """Probability of the good class for each vote pattern."""
    picked = np.log(np.stack([[chance[k, r, patterns[:, r] + 1] for r in range(patterns.shape[1])] for k in (0, 1)])).sum(axis=1)
    odds = picked[1] - picked[0] + np.log(share) - np.log1p(-share)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_rules(measures: DataFrame, m: str = "__measures") -> tuple[float, dict[str, np.ndarray]]:
    """Estimates rule accuracies from all rows: vote patterns are counted on the cluster, EM runs on the pattern table."""
    votes = rule_votes(m)
    rows = measures.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).agg(F.count(F.lit(1)).alias("__n")).collect()
    patterns = np.array([r[:-1] for r in rows], int).reshape(len(rows), len(votes))
    order = np.lexsort(patterns.T)
    share, chance = fit_accuracies(patterns[order], np.array([r[-1] for r in rows])[order] if rows else np.empty(0))
    return share, dict(zip(votes, np.moveaxis(chance, 1, 0), strict=True))


def quality_probability(model: tuple[float, dict[str, np.ndarray]], m: str = "__measures") -> Column:
    """The posterior as an expression: log odds are a sum over rules, so no join or UDF is needed to apply it."""
    share, chance = model
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for name, v in rule_votes(m).items():
        bad, none, good = (float(x) for x in np.log(chance[name][1]) - np.log(chance[name][0]))
        odds = odds + F.when(v < 0, bad).when(v > 0, good).otherwise(none)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def base_failed(m: str = "__measures") -> Column:
    n = F.col(f"{m}.n_words")
    return (n < 20) | (F.col(f"{m}.n_repeat_words") * 100 > n * 30)


def judge(measures: DataFrame, threshold: float = 0.5, m: str = "__measures") -> DataFrame:
    """Adds quality_probability, base_failed and kept (a column of such a name makes way) to a table with measures in a struct m;
    the model is fitted to the same table."""
    model = fit_rules(measures, m)
    rows = measures.drop("quality_probability", "base_failed", "kept")
    return (
        rows.withColumn("quality_probability", quality_probability(model, m))
        .withColumn("base_failed", base_failed(m))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
    )


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    measures = materialize(spark, measured(docs).drop("text"), "rules")
    return judge(measures).select("doc_id", *[F.col(f"__measures.{c}").alias(c) for c in COUNTS], "base_failed", "kept", "quality_probability")


def filter_stage(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rejected rows, columns unchanged. The texts are measured once and written with their measures; the model
    is fitted to the measures and the rows are judged by expressions."""
    m = free_name(docs, "__measures")
    measures = materialize(docs.sparkSession, measured(docs, m), "rules")
    model = fit_rules(measures.select(m), m)
    return measures.where(~base_failed(m) & (quality_probability(model, m) >= threshold)).select(*columns_of(docs))
