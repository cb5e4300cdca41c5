"""Site health and event windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventura.operators.joins import as_of_backward
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.streaming import health as H

#: 31 January 2024, after the last event.
AS_OF = 1_706_659_200_000_000


#: The state of a site after one more run, as SQL over the state ``s`` and the run ``r``; what an exclusion that is over leaves is ``f``.
_F = f"(CASE WHEN s.runs > 0 AND r.at - s.last_at >= {H.KEEP} OR s.status = 'excluded' AND s.exclude_until <= r.at THEN 0 ELSE s.failures END)"
_KEPT = lambda c: f"(CASE WHEN s.runs > 0 AND r.at - s.last_at >= {H.KEEP} THEN 0 ELSE s.{c} END)"
_STEP = f"""{{'at': r.at, 'result': r.result,
  'status': CASE WHEN r.result = 'success' THEN 'healthy' WHEN {_F} + 1 >= 3 THEN 'excluded' WHEN r.result = 'zero_result' THEN 'degraded' ELSE 'broken' END,
  'failures': CASE WHEN r.result = 'success' THEN 0 ELSE {_F} + 1 END, 'runs': {_KEPT('runs')} + 1, 'successes': {_KEPT('successes')} + CASE WHEN r.result = 'success' THEN 1 ELSE 0 END,
  'next_at': r.at + {H.DAY} * CASE WHEN r.result = 'success' THEN 7 WHEN {_F} + 1 >= 3 THEN 90 WHEN r.result = 'zero_result' THEN 2 ELSE 1 END,
  'exclude_until': CASE WHEN r.result <> 'success' AND {_F} + 1 >= 3 THEN r.at + 90 * {H.DAY} ELSE {_KEPT('exclude_until')} END,
  'diagnoses': {_KEPT('diagnoses')} + CASE WHEN r.result <> 'success' AND {_F} = 1 THEN 1 ELSE 0 END, 'last_at': r.at}}"""
_FRESH = lambda at, result: f"{{'at': {at}, 'result': {result}, 'status': 'pending', 'failures': CAST(0 AS BIGINT), 'runs': CAST(0 AS BIGINT), 'successes': CAST(0 AS BIGINT), 'next_at': CAST(0 AS BIGINT), 'exclude_until': CAST(0 AS BIGINT), 'diagnoses': CAST(0 AS BIGINT), 'last_at': CAST(0 AS BIGINT)}}"
_HEALTH = f"""SELECT site, h.status AS status, h.failures AS failures, h.runs AS runs, h.successes AS successes, h.next_at AS next_at, h.exclude_until AS exclude_until, h.diagnoses AS diagnoses, h.last_at AS last_at FROM (
  SELECT site, list_reduce(list({_FRESH('epoch_us(finished_at)', 'status')} ORDER BY finished_at, event_id), lambda s, r: {_STEP}, {_FRESH('CAST(0 AS BIGINT)', "''")}) AS h FROM runs GROUP BY site)"""


@plan("R01_site_health", _HEALTH, "runs")
def r01(t: Tables) -> DataFrame:
    return H.batch_health(t.runs)


@plan("R02_reactivation", f"SELECT CASE WHEN status = 'excluded' AND exclude_until <= {AS_OF + 88 * H.DAY} THEN 'pending' ELSE status END AS status, count(*) AS n, count(*) FILTER (WHERE failures >= 3 AND NOT (status = 'excluded' AND exclude_until <= {AS_OF + 88 * H.DAY})) AS failing FROM ({_HEALTH}) GROUP BY 1", "runs")
def r02(t: Tables) -> DataFrame:
    """States some 88 days later, when some exclusions are over and others are not."""
    later = H.reactivate(H.batch_health(t.runs), AS_OF + 88 * H.DAY)
    return later.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("failures") >= 3).alias("failing"))


@plan("R03_due_sites", f"SELECT site, status FROM ({_HEALTH}) WHERE status <> 'excluded' AND (next_at IS NULL OR next_at <= {AS_OF})", "runs")
def r03(t: Tables) -> DataFrame:
    return H.due(H.batch_health(t.runs), AS_OF).select("site", "status")


@plan("R04_cooldown", "SELECT site FROM runs GROUP BY 1 HAVING coalesce(max(finished_at) FILTER (WHERE status = 'success'), TIMESTAMP '1970-01-01') + INTERVAL 7 DAY <= TIMESTAMP '2024-01-31'", "runs")
def r04(t: Tables) -> DataFrame:
    """Sites whose last success is a week ago or more, or that never had one."""
    last = F.max(F.when(F.col("status") == "success", F.col("finished_at").cast("timestamp")))
    return t.runs.groupBy("site").agg(last.alias("last")).filter(F.coalesce("last", F.lit("1970-01-01").cast("timestamp")) + F.expr("INTERVAL 7 DAYS") <= F.lit("2024-01-31").cast("timestamp")).select("site")


@plan("R05_retry_window", "SELECT site FROM runs QUALIFY row_number() OVER (PARTITION BY site ORDER BY finished_at DESC, event_id DESC) = 1 AND status = 'zero_result' AND finished_at >= TIMESTAMP '2024-01-29'", "runs")
def r05(t: Tables) -> DataFrame:
    latest = t.runs.groupBy("site").agg(F.max_by(F.struct("status", F.col("finished_at").cast("timestamp").alias("at")), F.struct("finished_at", "event_id")).alias("l"))
    return latest.filter((F.col("l.status") == "zero_result") & (F.col("l.at") >= F.lit("2024-01-29").cast("timestamp"))).select("site")


@plan("R06_escalation", "SELECT event_id, CASE WHEN difficulty = 'easy' AND status <> 'success' THEN 'hard' ELSE difficulty END AS next_difficulty FROM runs", "runs")
def r06(t: Tables) -> DataFrame:
    return t.runs.select("event_id", F.when((F.col("difficulty") == "easy") & (F.col("status") != "success"), "hard").otherwise(F.col("difficulty")).alias("next_difficulty"))


#: Weights of the changes of stars, forks and issues in a week, and of freshness: whole for a week after a push, none after 30 days.
WEIGHTS, FRESH_DAYS, STALE_DAYS = (0.45, 0.2, 0.15, 0.2), 7, 30
_REPOS = "SELECT event_id, repo, collected_at, stars, floor(stars / 3) AS forks, CAST(event_id % 17 AS DOUBLE) AS issues, CASE WHEN event_id % 6 > 0 THEN collected_at - INTERVAL 1 DAY * (event_id % 5) END AS pushed_at FROM snapshots"
_SCALED = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN CASE WHEN {c} > 0 THEN 0.5 ELSE 0 END ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


@plan("R07_trend_score", f"""
, r AS ({_REPOS}), d AS (SELECT r.event_id, r.pushed_at, max(r.collected_at) OVER () AS now, coalesce(r.stars - p.stars, 0) AS a, coalesce(r.forks - p.forks, 0) AS b, coalesce(r.issues - p.issues, 0) AS c
  FROM r LEFT JOIN LATERAL (SELECT * FROM r b WHERE b.repo = r.repo AND b.collected_at <= r.collected_at - INTERVAL 7 DAY ORDER BY b.collected_at DESC, b.stars DESC, b.forks DESC, b.issues DESC LIMIT 1) p ON true)
SELECT event_id, round(0.45 * x + 0.2 * y + 0.15 * z + 0.2 * CASE WHEN days <= 7 THEN 1 WHEN days <= 30 THEN 1 - (days - 7) / 23 ELSE 0 END, 4) AS trend FROM (
  SELECT event_id, {_SCALED('a')} AS x, {_SCALED('b')} AS y, {_SCALED('c')} AS z, greatest((epoch_us(now) - epoch_us(pushed_at)) / 86400000000, 0) AS days FROM d)""", "snapshots")  # fmt: skip
def r07(t: Tables) -> DataFrame:
    """Trend of each snapshot against the repository's last one a week older or more, scaled over the batch; now is its latest time."""
    rows = t.spark.sql(_REPOS.replace("FROM snapshots", "FROM {snapshots}"), snapshots=t.snapshots).withColumn("m", F.struct("stars", "forks", "issues"))
    rows = as_of_backward(rows, "repo", "collected_at", "m", timedelta(days=7))
    metrics = ("stars", "forks", "issues")
    rows = rows.select("event_id", "collected_at", "pushed_at", *(F.coalesce(F.col(c) - F.col(f"prior.{c}"), F.lit(0.0)).alias(c) for c in metrics))
    # the extremes are one row, so they join every snapshot instead of a window over all of them
    ends = rows.agg(F.max("collected_at").alias("now"), *(f(c).alias(f"{n}_{c}") for c in metrics for n, f in (("hi", F.max), ("lo", F.min)))).withColumn("one", F.lit(1))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one")

    def scaled(c: str) -> Column:
        value, hi, lo = F.col(c), F.col(f"hi_{c}"), F.col(f"lo_{c}")
        return F.when(hi == lo, F.when(value > 0, 0.5).otherwise(0.0)).otherwise((value - lo) / (hi - lo))

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    days = F.greatest((micros("now") - micros("pushed_at")) / F.lit(H.DAY), F.lit(0.0))
    fresh = F.when(days <= FRESH_DAYS, 1.0).when(days <= STALE_DAYS, 1 - (days - FRESH_DAYS) / (STALE_DAYS - FRESH_DAYS)).otherwise(0.0)
    parts = (*map(scaled, metrics), fresh)
    return rows.select("event_id", F.round(sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:])), WEIGHTS[0] * parts[0]), 4).alias("trend"))


@plan("R08_transitions", "SELECT event_id, before, status FROM (SELECT event_id, status, lag(status) OVER (PARTITION BY site ORDER BY finished_at, event_id) AS before FROM runs) WHERE before <> status", "runs")
def r08(t: Tables) -> DataFrame:
    before = F.lag("status").over(Window.partitionBy("site").orderBy("finished_at", "event_id"))
    return t.runs.select("event_id", before.alias("before"), "status").filter(F.col("before") != F.col("status"))


@plan("R09_tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r09(t: Tables) -> DataFrame:
    return H.windowed_counts(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@plan("R11_session_windows")
def r11(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sessions"))
