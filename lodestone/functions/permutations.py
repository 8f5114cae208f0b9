"""Reading and repairing generated permutations with array expressions.

Identifiers are compared as numbers of any size (digits without leading zeros). Only ASCII digits count as digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRACKETED = r"\[\s*(\d+)\s*\]"
BARE = r"\d+"
# What the repair reports, for logs that are read by others (fixed values; a number stands before those that begin with a space).
NO_IDENTIFIERS = "no identifiers found; falling back to BM25 order"
NO_BRACKETS = "no bracketed identifiers; scraped bare integers"
REPEATED = " duplicate identifier(s) dropped"
OUTSIDE = " out-of-range identifier(s) dropped"
UNMENTIONED = " identifier(s) never mentioned; appended in BM25 order"


def scraped(raw: Column) -> tuple[Column, Column]:
    """Identifiers as digit strings in order of appearance, and where they came from: bracket, bare_int or none."""
    raw = F.coalesce(raw, F.lit(""))
    bracketed, bare = F.regexp_extract_all(raw, F.lit(BRACKETED), F.lit(1)), F.regexp_extract_all(raw, F.lit(BARE), F.lit(0))
    ids = F.when(F.size(bracketed) > 0, bracketed).otherwise(bare)
    plain = F.transform(ids, lambda s: F.regexp_replace(s, r"^0+(?=\d)", ""))
    strategy = F.when(F.size(bracketed) > 0, "bracket").when(F.size(bare) > 0, "bare_int").otherwise("none")
    return plain, strategy


def parsed(df: DataFrame, raw: str, num: str, into: str = "result") -> DataFrame:
    """Adds a struct: order (0-based, always a permutation of 0..num-1), counters, flags and notes. num below 1 is an error.

    Repeats go first and what is out of range after them, so a repeated identifier out of range counts once in each; the
    identifiers never mentioned follow in their old order."""
    ids, strategy = scraped(F.col(raw))
    count = F.col(num)
    n = F.when(count > 0, count).otherwise(F.raise_error(F.concat(F.lit("num must be positive, got "), F.coalesce(count.cast("string"), F.lit("null")))).cast("int")).cast("int")
    steps = df.withColumns({"__ids": ids, "__strategy": strategy, "__n": n})
    steps = steps.withColumn("__once", F.array_distinct("__ids"))
    # A number of ten digits or more is out of any range; try_cast leaves it null.
    inside = F.filter(F.transform("__once", lambda s: F.when(F.length(s) < 10, s.try_cast("int")).otherwise(F.lit(0))), lambda v: (v >= 1) & (v <= F.col("__n")))
    steps = steps.withColumn("__inside", inside).withColumn("__missing", F.array_except(F.sequence(F.lit(1), F.col("__n")), F.col("__inside")))
    repeats = F.size("__ids") - F.size("__once")
    outside = F.size("__once") - F.size("__inside")
    missing = F.size("__missing")
    failed = F.size("__ids") == 0
    note = lambda c, text: F.when(c > 0, F.concat(c.cast("string"), F.lit(text)))
    notes = F.filter(
        F.array(
            F.when(failed, F.lit(NO_IDENTIFIERS)),
            F.when(F.col("__strategy") == "bare_int", F.lit(NO_BRACKETS)),
            note(repeats, REPEATED),
            note(outside, OUTSIDE),
            F.when(~failed, note(missing, UNMENTIONED)),
        ),
        lambda x: x.isNotNull(),
    )
    result = F.struct(
        F.transform(F.concat("__inside", "__missing"), lambda v: v - 1).alias("order"),
        F.col("__n").alias("num"),
        F.col("__strategy").alias("strategy"),
        F.size("__ids").alias("n_identifiers_parsed"),
        repeats.alias("n_duplicates"),
        outside.alias("n_out_of_range"),
        missing.alias("n_missing"),
        ((repeats == 0) & (outside == 0) & (missing == 0) & (F.col("__strategy") == "bracket")).alias("is_clean"),
        failed.alias("is_total_failure"),
        notes.alias("notes"),
    )
    return steps.withColumn(into, result).drop("__ids", "__strategy", "__n", "__once", "__inside", "__missing")


def applied(docs: Column, order: Column) -> Column:
    """The candidates in a new order, each with llm_rank from 1 beside its old rank; anything but a permutation of them is an error."""
    whole = F.array_sort(order) == F.transform(F.sequence(F.lit(0), F.size(docs) - 1), lambda v: v.cast("int"))
    checked = F.when((F.size(docs) == 0) & (F.size(order) == 0), order).when((F.size(docs) > 0) & whole, order).otherwise(F.raise_error(F.lit("order is not a permutation of the candidates")).cast("array<int>"))
    return F.transform(checked, lambda o, i: F.struct((i + 1).alias("llm_rank"), F.get(docs, o).alias("doc")))
