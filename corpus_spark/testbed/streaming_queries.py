"""Streaming queries T1-T4: each runs its stream over everything given, then reads the result."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators.merge import ORDER_COLUMNS
from corpus_spark.session import fresh_path
from corpus_spark.streaming import jobs
from corpus_spark.testbed.merge_queries import FACT_SQL, fact_text
from corpus_spark.testbed.oracle import cte
from corpus_spark.testbed.registry import Bed, query


def replay(b: Bed, df: DataFrame, name: str, arrival: Column, batches: int) -> Iterator[DataFrame]:
    """`df` in `batches` arrivals of as many files as its partitions: after each is written, the stream
    over all of them comes back, to be run from its checkpoint over what is new."""
    path = fresh_path(b.spark, name)
    for n in range(batches):
        df.filter(arrival % batches == n).write.mode("append").option("compression", "zstd").parquet(path)
        yield b.spark.readStream.schema(df.schema).parquet(path)


@query("t1_incremental_merge_stream", FACT_SQL)
def _(b: Bed):
    obs = b.stored_observations
    logs = jobs.observation_logs(b.spark, fresh_path(b.spark, "merge-stream"), obs)
    checkpoint = fresh_path(b.spark, "merge-checkpoint")
    # Every tenth key arrives first under a package that it leaves with the last arrival.
    key, arrival = F.abs(F.hash(*ORDER_COLUMNS)), F.abs(F.hash("device_path")) % 3
    strayed = obs.filter(key % 10 == 0).withColumns({"package": F.concat("package", F.lit(".old")), "arrival": F.lit(0)})
    arriving = strayed.unionByName(obs.withColumn("arrival", F.when(key % 10 == 0, 2).otherwise(arrival)))
    for stream in replay(b, arriving, "observations", F.col("arrival"), 3):
        last = jobs.merge_stream(stream.drop("arrival"), *logs, checkpoint)
    return fact_text(logs[2].current(last).drop("deleted"))


@query("t2_latest_decision_stream", "SELECT package, id, action FROM latest_decision")
def _(b: Bed):
    log = b.table("decisions").select("package", "id", "action", "decided_at")
    # Newest first: later batches bring older decisions, which must not win.
    arrivals = replay(b, log, "decisions", 2 - F.year("decided_at") % 3, 3)
    state = jobs.latest_log(b.spark, fresh_path(b.spark, "latest"), log.schema, "package", ("decided_at", "id"))
    checkpoint = fresh_path(b.spark, "latest-checkpoint")
    last = max(jobs.latest_stream(stream, state, checkpoint) for stream in arrivals)
    return state.current(last).select("package", "id", "action")


cte("beats", "SELECT 'job-' || user_id AS job_id, ts AS beat_at, CAST(event_id % 4 AS INT) AS attempt FROM events")


@query(
    "t3_heartbeat_timeout_stream",
    "SELECT job_id, strftime(beat_at, '%Y-%m-%d %H:%M:%S') AS last_beat, attempt, CASE WHEN attempt >= 3 THEN 'exhausted' ELSE 'stale' END AS outcome FROM (SELECT job_id, beat_at, max(attempt) AS attempt, lead(beat_at) OVER (PARTITION BY job_id ORDER BY beat_at) AS after FROM beats GROUP BY job_id, beat_at) WHERE after IS NULL OR epoch_us(after) - epoch_us(beat_at) > 86400000000",
)
def _(b: Bed):
    beats = b.raw("events").select(F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("beat_at"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    # The last two arrivals are beats of no job, far behind all others, so that the watermark passes these.
    last, arrival = beats.agg(F.max("beat_at").alias("at")), F.least(F.floor((F.dayofmonth("beat_at") - 1) / 10), F.lit(2))
    for n in (3, 4):
        beats = beats.unionByName(last.select(F.lit("end").alias("job_id"), (F.col("at") + F.expr(f"INTERVAL {n + 7} DAYS")).alias("beat_at"), F.lit(n).alias("attempt")))
    path, checkpoint = fresh_path(b.spark, "heartbeats"), fresh_path(b.spark, "heartbeats-checkpoint")
    for stream in replay(b, beats, "beats", F.when(F.col("job_id") == "end", F.col("attempt")).otherwise(arrival), 5):
        found = jobs.collect_stream(jobs.heartbeat_timeouts(stream, 86_400, 3, "1 hour"), "heartbeats", path, checkpoint)
    return found.select("job_id", F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss").alias("last_beat"), "attempt", "outcome")


cte("all_streams", "SELECT 'wait' AS measure, 'requested' AS opens, * FROM lease_events WHERE job_id IS NOT NULL AND event IN ('requested', 'acquired') UNION ALL SELECT 'occupied', 'acquired', * FROM lease_events WHERE job_id IS NOT NULL AND event IN ('acquired', 'released', 'reclaimed')")


@query(
    "t4_lease_interval_stream",
    "SELECT job_id, measure, epoch_us(pa) AS start_us, epoch_us(happened_at) - epoch_us(pa) AS length_us FROM (SELECT *, lag(event) OVER w AS pe, lag(happened_at) OVER w AS pa FROM all_streams WINDOW w AS (PARTITION BY measure, job_id ORDER BY happened_at, id)) WHERE event <> opens AND pe = opens",
)
def _(b: Bed):
    events = b.table("lease_events").withColumn("happened_at", F.col("happened_at").cast("timestamp"))
    # Events come in no order of time at all. The last two arrivals, of no job's lease, lie far behind and let the watermark pass.
    last = events.agg(F.max("happened_at").alias("at"))
    for n in (3, 4):
        end = last.select(F.lit(-n).cast("bigint").alias("id"), F.lit("end").alias("job_id"), F.lit("acquired").alias("event"), (F.col("at") + F.expr(f"INTERVAL {n * 60} DAYS")).alias("happened_at"))
        events = events.unionByName(end)
    arrival = F.when(F.col("job_id") == "end", -F.col("id")).otherwise(F.abs(F.hash("id")) % 3)
    path, checkpoint = fresh_path(b.spark, "lease-intervals"), fresh_path(b.spark, "lease-checkpoint")
    for stream in replay(b, events, "lease-events", F.coalesce(arrival, F.lit(0)), 5):
        paired = jobs.collect_stream(jobs.lease_pairing(stream, "60 days"), "leases", path, checkpoint)
    closed, _ = jobs.lease_intervals_of(paired)
    return closed.select("job_id", "measure", "start_us", (F.col("end_us") - F.col("start_us")).alias("length_us"))
