"""Telemetry queries: A21-A24, W4, W5, P13, P14, O6, C7."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_spark.fixed_values import JOB_WALKS
from corpus_spark.operators import telemetry as t
from corpus_spark.operators.browse import newest
from corpus_spark.testbed.oracle import cte
from corpus_spark.testbed.registry import Bed, query

START, NOW = "2024-01-10 00:00:00", "2024-01-31 00:00:00"


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1000000.0)"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 3) for c in columns})


cte("stage_rows", f"SELECT stage, count(*) AS completed, round(avg({secs('started_at', 'finished_at')}), 3) AS avg_seconds, round(max({secs('started_at', 'finished_at')}), 3) AS max_seconds "
    f"FROM job_runs WHERE outcome = 'succeeded' AND started_at >= TIMESTAMP '{START}' GROUP BY stage")
cte("worker_rows", f"SELECT worker_id, count(*) FILTER (WHERE state = 'succeeded') AS jobs_succeeded, count(*) FILTER (WHERE state = 'failed') AS jobs_failed, "
    f"round(sum({secs('started_at', f'''coalesce(finished_at, TIMESTAMP '{NOW}')''')}), 3) AS busy_seconds FROM job_runs WHERE worker_id IS NOT NULL AND started_at >= TIMESTAMP '{START}' GROUP BY worker_id")
cte("lease_inside", f"SELECT * FROM lease_events WHERE happened_at >= TIMESTAMP '{START}' AND job_id IS NOT NULL")
cte("lease_streams", "SELECT 'wait' AS measure, 'requested' AS opens, * FROM lease_inside WHERE event IN ('requested', 'acquired') "
    "UNION ALL SELECT 'occupied', 'acquired', * FROM lease_inside WHERE event IN ('acquired', 'released', 'reclaimed')")
cte("lease_lagged", "SELECT *, lag(event) OVER w AS pe, lag(happened_at) OVER w AS pa, lead(event) OVER w AS ne FROM lease_streams WINDOW w AS (PARTITION BY measure, job_id ORDER BY happened_at, id)")
cte("intervals", f"SELECT job_id, measure, pa AS start_at, {secs('pa', 'happened_at')} AS seconds, true AS closed FROM lease_lagged WHERE event <> opens AND pe = opens "
    f"UNION ALL SELECT job_id, measure, happened_at, {secs('happened_at', f'''TIMESTAMP '{NOW}' ''')}, false FROM lease_lagged WHERE event = opens AND ne IS NULL")
cte("intervals_held", f"SELECT * FROM intervals UNION ALL SELECT 'job-held', 'occupied', TIMESTAMP '{START}', {secs(f'''TIMESTAMP '{START}' ''', f'''TIMESTAMP '{NOW}' ''')}, false")
cte("lease_row", "SELECT (SELECT count(*) FROM lease_inside WHERE event = 'acquired') AS total_acquisitions, round(sum(seconds) FILTER (WHERE measure = 'occupied'), 3) AS occupied_seconds, "
    f"round(avg(seconds) FILTER (WHERE measure = 'wait'), 3) AS avg_wait_seconds, round(max(seconds) FILTER (WHERE measure = 'wait'), 3) AS max_wait_seconds, "
    f"round(sum(seconds) FILTER (WHERE measure = 'occupied') / {secs(f'''TIMESTAMP '{START}' ''', f'''TIMESTAMP '{NOW}' ''')} * 100, 3) AS occupancy_pct FROM intervals_held")


@query("a21_stage_durations", "SELECT * FROM stage_rows")
def _(b: Bed):
    return rounded(t.stage_durations(b.table("job_runs"), START), "avg_seconds", "max_seconds")


@query("a22_worker_utilization", "SELECT * FROM worker_rows")
def _(b: Bed):
    return rounded(t.worker_utilization(b.table("job_runs"), START, NOW), "busy_seconds")


@query("w5_lease_intervals", "SELECT job_id, measure, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at, round(seconds, 3) AS seconds, closed FROM intervals")
def _(b: Bed):
    rows = t.lease_intervals(b.table("lease_events"), START, NOW)
    return rows.select("job_id", "measure", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), F.round("seconds", 3).alias("seconds"), "closed")


def holder(b: Bed):
    """The current lease: a job that took it before the window opened."""
    return b.table("lease_events").agg(F.lit("job-held").alias("job_id"), F.min("happened_at").alias("acquired_at"))


@query("a23_lease_stats", "SELECT * FROM lease_row")
def _(b: Bed):
    stats = t.lease_stats(b.table("lease_events"), START, NOW, holder(b))
    return rounded(stats, "occupied_seconds", "avg_wait_seconds", "max_wait_seconds", "occupancy_pct")


@query("a24_queue_depth", "SELECT count(*) FILTER (WHERE state = 'queued') AS queue_depth FROM job_runs")
def _(b: Bed):
    return t.queue_depth(b.table("job_runs"))


@query(
    "w4_eviction_plan",
    "WITH c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY mtime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before, sum(size) OVER () AS total FROM scratch_dirs "
    "WHERE NOT coalesce(job_state IN ('queued', 'running') AND job_attempt = dir_attempt, false)) SELECT id, CAST(freed_before AS BIGINT) AS freed_before FROM c WHERE total - freed_before > 100000000000",
)
def _(b: Bed):
    return t.eviction_plan(b.table("scratch_dirs"), 100_000_000_000).select("id", F.col("freed_before").cast("long").alias("freed_before"))


@query(
    "p13_stale_heartbeats",
    "SELECT job_id, state, CASE WHEN attempt >= 3 THEN 'failed' ELSE 'queued' END AS next_state FROM job_runs WHERE state IN ('claimed', 'running') AND heartbeat_at < TIMESTAMP '2024-01-20 00:00:00'",
)
def _(b: Bed):
    return t.stale_jobs(b.table("job_runs"), "2024-01-20 00:00:00", 3).select("job_id", "state", "next_state")


_walk = "CASE kind " + " ".join(f"WHEN '{k}' THEN ['" + "','".join(w) + "']" for k, w in JOB_WALKS.items()) + " END"


@query(
    "p14_stage_progress",
    f"SELECT job_id, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, CAST(round_even(100.0 * done / total, 0) AS BIGINT) AS pct FROM (SELECT job_id, coalesce(list_position({_walk}, stage), 0) AS done, len({_walk}) AS total FROM job_runs)",
)
def _(b: Bed):
    rows = t.stage_progress(b.table("job_runs"))
    return rows.select("job_id", F.col("stages_done").cast("long").alias("done"), F.col("stages_total").cast("long").alias("total"), F.col("progress_pct").cast("long").alias("pct"))


@query(
    "o6_filtered_job_list",
    "SELECT job_id, state, (SELECT count(*) FROM job_runs) AS total FROM job_runs WHERE state = 'failed' AND kind = 'classification' ORDER BY created_at DESC, job_id DESC LIMIT 100",
)
def _(b: Bed):
    jobs = b.table("job_runs")
    total = jobs.agg(F.count(F.lit(1))).scalar()
    rows = newest(jobs.filter("state = 'failed' AND kind = 'classification'"), "created_at", "job_id", 100).drop("total")
    return rows.select("job_id", "state", total.alias("total"))


@query(
    "c7_telemetry",
    "SELECT 'stage' AS section, stage AS name, CAST(completed AS DOUBLE) AS a, avg_seconds AS b, max_seconds AS c FROM stage_rows "
    "UNION ALL SELECT 'worker', worker_id, jobs_succeeded, jobs_failed, busy_seconds FROM worker_rows "
    "UNION ALL SELECT 'lease', 'all', total_acquisitions, occupied_seconds, occupancy_pct FROM lease_row "
    "UNION ALL SELECT 'queue', 'now', count(*) FILTER (WHERE state = 'queued'), NULL, NULL FROM job_runs",
)
def _(b: Bed):
    from corpus_spark.plans.reports import telemetry

    rows = telemetry(b.table("job_runs"), b.table("lease_events"), holder(b), START, NOW)
    return rounded(rows, "b", "c")
