"""Queries of statistics and reports, over the events as measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import stats
from lodestone.operators.pq import sample
from lodestone.registry import query
from lodestone.sources.tables import load

TIMING = 100
TARGETS = [0.9, 0.95, 0.99]

SIZES, SCALED_TO = 4, 2681468.0

#: Sizes and seconds of growing parts of each event type, and operating points: a method that waits for 3 * param ms has the answers that
#: come by then, at the time it waited.
SQL_SCALING = f"sc AS (SELECT event_type AS dataset, count(*) AS n, sum(value) / 1000 AS seconds FROM events JOIN range({SIZES}) r(j) ON event_id % {SIZES} <= j GROUP BY event_type, j)"
SQL_POINTS = """ev AS (SELECT value, CASE WHEN event_type IN ('view', 'click') THEN 'layered' ELSE 'flat_graph' END AS method,
  CASE WHEN event_type IN ('view', 'click') THEN 10 + 10 * (event_id % 8) ELSE 20 + 10 * (event_id % 9) END AS param FROM events),
op AS (SELECT method, param, round(avg(CASE WHEN value <= 3 * param THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(least(value, 3.0 * param)), 6) AS latency_ms FROM ev GROUP BY method, param)"""
SQL_LATENCY = "lat_v AS (SELECT user_id % 3 AS run, event_id, value AS lat_ms FROM events)"
SQL_FASTEST = f"""{SQL_POINTS}, t AS ({" UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS target" for t in TARGETS)}),
best AS (SELECT * FROM (SELECT t.target, o.method, o.param, o.recall, o.latency_ms, row_number() OVER (PARTITION BY t.target, o.method ORDER BY o.latency_ms, o.param) AS k FROM (SELECT DISTINCT * FROM op) o JOIN t ON o.recall >= t.target) WHERE k = 1)"""


def latencies(spark, sf_dir):
    return load(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("run"), "event_id", F.col("value").alias("lat_ms"))


def points(spark, sf_dir):
    early = F.col("event_type").isin("view", "click")
    events = load(spark, sf_dir, "events").select("value", F.when(early, "layered").otherwise("flat_graph").alias("method"), F.when(early, 10 + 10 * (F.col("event_id") % 8)).otherwise(20 + 10 * (F.col("event_id") % 9)).alias("param"))
    limit = 3 * F.col("param")
    return events.groupBy("method", "param").agg(F.round(F.avg((F.col("value") <= limit).cast("double")), 6).alias("recall"), F.round(F.avg(F.least("value", limit.cast("double"))), 6).alias("latency_ms"))


@query("timing_subset", f"SELECT event_id FROM (SELECT event_id FROM events ORDER BY md5('0-' || CAST(event_id AS VARCHAR)), event_id LIMIT {TIMING}) ORDER BY event_id")
def timing_subset(spark, sf_dir):
    """A fixed random sample without replacement, sorted: sampling is the operator."""
    return sample(latencies(spark, sf_dir).select("event_id"), TIMING, key="event_id").orderBy("event_id")


@query("latency_summary", f"WITH {SQL_LATENCY} SELECT round(avg(lat_ms), 6) AS mean_ms, round(quantile_cont(lat_ms, 0.5), 6) AS p50_ms, round(quantile_cont(lat_ms, 0.95), 6) AS p95_ms, round(1000 / avg(lat_ms), 6) AS qps FROM lat_v")
def latency_summary(spark, sf_dir):
    return stats.latency_summary(latencies(spark, sf_dir))


@query("median_run", f"WITH {SQL_LATENCY}, m AS (SELECT run, avg(lat_ms) AS mean FROM lat_v GROUP BY run), p AS (SELECT *, row_number() OVER (ORDER BY mean, run) AS k, count(*) OVER () AS runs FROM m) SELECT run, round(mean, 6) AS mean_ms, runs FROM p WHERE k = runs // 2 + 1")
def median_run(spark, sf_dir):
    return stats.median_run(latencies(spark, sf_dir))


@query("scaling_fit", f"WITH {SQL_SCALING}, f AS (SELECT dataset, regr_slope(ln(seconds), ln(n)) AS s, regr_intercept(ln(seconds), ln(n)) AS i FROM sc GROUP BY dataset) SELECT dataset, round(s, 6) AS slope, round(i, 6) AS intercept, round(exp(i + s * ln({SCALED_TO})), 3) AS extrapolated FROM f")
def scaling_fit(spark, sf_dir):
    parts = load(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), "value", F.explode(F.sequence(F.col("event_id") % SIZES, F.lit(SIZES - 1).cast("long"))).alias("j"))
    sizes = parts.groupBy("dataset", "j").agg(F.count(F.lit(1)).alias("n"), (F.sum("value") / 1000).alias("seconds"))
    return stats.scaling_fit(sizes, SCALED_TO)


@query("fastest_at_recall", f"WITH {SQL_FASTEST} SELECT target, method, param, recall, latency_ms FROM best")
def fastest_at_recall(spark, sf_dir):
    return stats.fastest_at(points(spark, sf_dir), TARGETS)


@query(
    "compare_methods",
    f"""WITH {SQL_POINTS}, d AS (SELECT DISTINCT * FROM op), a AS (SELECT * FROM d WHERE method = 'layered'), b AS (SELECT * FROM d WHERE method = 'flat_graph')
SELECT coalesce(a.param, b.param) AS param, a.recall AS left_recall, a.latency_ms AS left_ms, b.recall AS right_recall, b.latency_ms AS right_ms, round(a.latency_ms / b.latency_ms, 6) AS speedup FROM a FULL JOIN b ON a.param = b.param""",
)
def compare_methods(spark, sf_dir):
    known = points(spark, sf_dir).distinct()
    return stats.compare(known.where("method = 'layered'"), known.where("method = 'flat_graph'"))


@query(
    "report_markdown",
    f"""WITH {SQL_FASTEST} SELECT CAST(0 AS BIGINT) AS line_no, '| target | method | param |' AS line UNION ALL SELECT 1, '|---|---|---|'
UNION ALL SELECT 1 + row_number() OVER (ORDER BY target, method, param), '| ' || CAST(target AS VARCHAR) || ' | ' || method || ' | ' || CAST(param AS VARCHAR) || ' |' FROM best""",
)
def report_markdown(spark, sf_dir):
    return stats.markdown(stats.fastest_at(points(spark, sf_dir), TARGETS), ["target", "method", "param"])
