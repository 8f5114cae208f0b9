"""Latency statistics, scaling fits and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.selection import percentiles

DIGITS = 6


def latency_summary(samples: DataFrame, value: str = "lat_ms") -> DataFrame:
    """One row: mean, median, 95th percentile (both interpolated), and queries a second of one caller, 1 / mean. The percentiles are found
    by counting, in passes over the samples."""
    v = F.col(value)
    p50, p95 = (F.round(F.lit(p).cast("double"), DIGITS) for p in percentiles(samples, value, [0.5, 0.95]))
    return samples.agg(F.round(F.avg(v), DIGITS).alias("mean_ms"), F.round(1000 / F.avg(v), DIGITS).alias("qps")).select("mean_ms", p50.alias("p50_ms"), p95.alias("p95_ms"), "qps")


def median_run(samples: DataFrame, run: str = "run", value: str = "lat_ms") -> DataFrame:
    """The run in the middle by mean (the upper of two), and the number of runs; a row for each run is sorted, not the samples."""
    means = samples.groupBy(run).agg(F.avg(value).alias("mean"))
    placed = means.withColumn("place", F.row_number().over(Window.orderBy("mean", run))).withColumn("runs", F.count(F.lit(1)).over(Window.partitionBy()))
    return placed.where(F.col("place") == F.floor(F.col("runs") / 2) + 1).select(run, F.round("mean", DIGITS).alias("mean_ms"), "runs")


def scaling_fit(points: DataFrame, at: float) -> DataFrame:
    """Least squares on logarithms: dataset, slope, intercept, and the value it gives at a size."""
    x, y = F.log("n"), F.log("seconds")
    fit = points.groupBy("dataset").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return fit.select("dataset", F.round("slope", DIGITS).alias("slope"), F.round("intercept", DIGITS).alias("intercept"), F.round(F.exp(F.col("intercept") + F.col("slope") * F.log(F.lit(float(at)))), 3).alias("extrapolated"))


def fastest_at(points: DataFrame, targets: list[float]) -> DataFrame:
    """For each recall target and method, the operating point of least latency that reaches it; repeated points count once."""
    asked = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    known = points.dropDuplicates(["method", "param", "recall", "latency_ms"]).select("*", asked).where(F.col("recall") >= F.col("target"))
    best = known.groupBy("target", "method").agg(F.min(F.struct("latency_ms", "param", "recall")).alias("b"))
    return best.select("target", "method", "b.param", "b.recall", "b.latency_ms")


def compare(left: DataFrame, right: DataFrame, key: str = "param") -> DataFrame:
    """Two methods side by side; a point that only one has keeps its row."""
    a = left.select(key, F.col("recall").alias("left_recall"), F.col("latency_ms").alias("left_ms"))
    b = right.select(key, F.col("recall").alias("right_recall"), F.col("latency_ms").alias("right_ms"))
    return a.join(b, key, "full").withColumn("speedup", F.round(F.try_divide("left_ms", "right_ms"), DIGITS))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a table, null as a dash: line_no 0 is the head, 1 the rule."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    body = rows.select(F.row_number().over(Window.orderBy(*columns)).cast("long").alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).select((F.col("n") + 1).alias("line_no"), "line")
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line_no long, line string")
    return head.union(body)
