"""Operational telemetry over one trailing window that ends at `now`, plus the retention plan."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import JOB_WALKS
from corpus_spark.operators.ordered import running_total, sliced, with_last_seen


def seconds_between(start: Column, end: Column) -> Column:
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(end) - micros(start)) / 1_000_000


def moment(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def stage_durations(runs: DataFrame, window_start: str) -> DataFrame:
    """Count, mean and longest duration per stage; succeeded runs only, so that a fast failure does
    not read as a fast stage."""
    took = seconds_between(F.col("started_at"), F.col("finished_at"))
    return (
        runs.filter((F.col("outcome") == "succeeded") & (F.col("started_at") >= moment(window_start)))
        .groupBy("stage")
        .agg(F.count(F.lit(1)).alias("completed"), F.avg(took).alias("avg_seconds"), F.max(took).alias("max_seconds"))
    )


def worker_utilization(jobs: DataFrame, window_start: str, now: str) -> DataFrame:
    """Outcomes and busy time per worker; a job still running is busy until now."""
    busy = seconds_between(F.col("started_at"), F.coalesce("finished_at", moment(now)))
    return (
        jobs.filter(F.col("worker_id").isNotNull() & (F.col("started_at") >= moment(window_start)))
        .groupBy("worker_id")
        .agg(
            F.count_if(F.col("state") == "succeeded").alias("jobs_succeeded"),
            F.count_if(F.col("state") == "failed").alias("jobs_failed"),
            F.sum(busy).alias("busy_seconds"),
        )
    )


def job_numbers(jobs: DataFrame, window_start: str, now: str) -> DataFrame:
    """(section, name, a, b, c): the rows of `stage_durations`, `worker_utilization` and `queue_depth` from one
    pass over the jobs. Only partial sums per stage, per worker and over all are shuffled."""
    # A blank row counts for nothing, but an empty table has a queue, too: of depth 0.
    blank = jobs.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.schema])
    inside = F.col("started_at") >= moment(window_start)
    finished = inside & (F.col("outcome") == "succeeded")
    took = F.when(finished, seconds_between(F.col("started_at"), F.col("finished_at")))
    busy = F.when(inside, seconds_between(F.col("started_at"), F.coalesce("finished_at", moment(now))))
    numbers = (
        jobs.unionByName(blank)
        .groupingSets([["stage"], ["worker_id"], []], "stage", "worker_id")
        .agg(
            F.grouping_id().alias("level"),  # a bit per column that is not grouped by
            F.count_if(finished).alias("completed"),
            F.avg(took).alias("avg_seconds"),
            F.max(took).alias("max_seconds"),
            F.count_if(inside).alias("started"),
            F.count_if(inside & (F.col("state") == "succeeded")).alias("succeeded"),
            F.count_if(inside & (F.col("state") == "failed")).alias("failed"),
            F.sum(busy).alias("busy_seconds"),
            F.count_if(F.col("state") == "queued").alias("queued"),
        )
    )
    stage, worker = F.col("level") == 1, F.col("level") == 2

    def number(of_stage: str, of_worker: str, of_queue: str | None) -> Column:
        rest = F.col(of_queue) if of_queue else F.lit(None)
        return F.when(stage, F.col(of_stage)).when(worker, F.col(of_worker)).otherwise(rest).cast("double")

    return numbers.filter(
        F.when(stage, F.col("completed") > 0).when(worker, F.col("worker_id").isNotNull() & (F.col("started") > 0)).otherwise(True)
    ).select(
        F.when(stage, "stage").when(worker, "worker").otherwise("queue").alias("section"),
        F.when(stage, F.col("stage")).when(worker, F.col("worker_id")).otherwise("now").alias("name"),
        number("completed", "succeeded", "queued").alias("a"),
        number("avg_seconds", "failed", None).alias("b"),
        number("max_seconds", "busy_seconds", None).alias("c"),
    )


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("state") == "queued").alias("queue_depth"))


def _waits() -> Column:
    return F.col("event").isin("requested", "acquired")


def _occupies() -> Column:
    return F.col("event").isin("acquired", "released", "reclaimed")


def lease_rows(events: DataFrame, window_start: str) -> DataFrame:
    """The window's lease events in order of (job, time, id), written once in even slices for all that reads
    them. Events of no job, and those that are no lease's, count for nothing."""
    inside = events.filter(
        (F.col("happened_at") >= moment(window_start)) & F.col("job_id").isNotNull() & (_waits() | _occupies())
    )
    return sliced(inside.select("id", "job_id", "happened_at", "event"), ("job_id", "happened_at", "id"), "lease-rows")


def pair_leases(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed, open) of `lease_rows`: an acquire closes the request just before it, a release or reclaim the
    acquire just before it, and a repeat replaces the earlier one. One sorted pass carries both measures, so a
    job with a third of all events is spread like any other; what is open comes from a grouped pass."""
    took = F.col("event") == "acquired"
    since = F.unix_micros(F.col("happened_at").cast("timestamp"))
    # A moment where the measure opens, a negative one where it doesn't.
    marks = {
        "wait": F.when(F.col("event") == "requested", since).when(took, F.lit(-1)),
        "occupied": F.when(took, since).when(_occupies(), F.lit(-1)),
    }
    met = with_last_seen(rows, "job_id", ("happened_at", "id"), marks)
    opened = F.when(took, F.col("wait")).when(_occupies(), F.col("occupied"))
    closed = met.filter(opened >= 0).select(
        "job_id", F.when(took, "wait").otherwise("occupied").alias("measure"), _at(opened).alias("start_at"), F.col("happened_at").alias("end_at")
    )
    newest = F.struct("happened_at", "id")
    ends = rows.groupBy("job_id").agg(*[F.max_by(v, F.when(v.isNotNull(), newest)).alias(m) for m, v in marks.items()])
    still = F.array_compact(
        F.array(*[F.when(F.col(m) >= 0, F.struct(F.lit(m).alias("measure"), _at(F.col(m)).alias("happened_at"))) for m in marks])
    )
    return closed, ends.select("job_id", F.inline(still))


def _at(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def lease_intervals(events: DataFrame, window_start: str, now: str) -> DataFrame:
    """(job_id, measure, start_at, seconds, closed) with measure `wait` or `occupied`; what is open
    at the end closes at `now`."""
    return _intervals(lease_rows(events, window_start), now)


def _intervals(rows: DataFrame, now: str) -> DataFrame:
    closed, pending = pair_leases(rows)
    return closed.select(
        "job_id", "measure", "start_at", seconds_between(F.col("start_at"), F.col("end_at")).alias("seconds"), F.lit(True).alias("closed")
    ).unionByName(
        pending.select(
            "job_id", "measure", F.col("happened_at").alias("start_at"),
            seconds_between(F.col("happened_at"), moment(now)).alias("seconds"), F.lit(False).alias("closed"),
        )
    )


def lease_stats(
    events: DataFrame, window_start: str, now: str, holder: DataFrame | None = None
) -> DataFrame:
    """One row of lease numbers. `holder` is the current lease row (job_id, acquired_at), at most
    one; a holder from before the window counts from the window's start."""
    rows = lease_rows(events, window_start)
    intervals = _intervals(rows, now)
    if holder is not None:
        open_now = intervals.filter("measure = 'occupied' AND NOT closed").select("job_id")
        start = F.greatest(F.coalesce("acquired_at", moment(window_start)), moment(window_start))
        seeded = holder.filter("job_id IS NOT NULL").join(open_now, "job_id", "left_anti").select(
            "job_id", F.lit("occupied").alias("measure"), start.alias("start_at"),
            seconds_between(start, moment(now)).alias("seconds"), F.lit(False).alias("closed"),
        )
        intervals = intervals.unionByName(seeded)
    acquired = rows.filter("event = 'acquired'").agg(F.count(F.lit(1)))
    occupied = F.when(F.col("measure") == "occupied", F.col("seconds"))
    waited = F.when(F.col("measure") == "wait", F.col("seconds"))
    window = seconds_between(moment(window_start), moment(now))
    totals = intervals.agg(
        F.coalesce(F.sum(occupied), F.lit(0.0)).alias("occupied_seconds"),
        F.avg(waited).alias("avg_wait_seconds"),
        F.max(waited).alias("max_wait_seconds"),
    )
    return totals.select(
        acquired.scalar().alias("total_acquisitions"),
        "*",
        F.when(window > 0, F.col("occupied_seconds") / window * 100).otherwise(0.0).alias("occupancy_pct"),
    )


def eviction_plan(dirs: DataFrame, ceiling: int) -> DataFrame:
    """Directories to evict, oldest first, until what remains fits under the ceiling. The current
    attempt of a job that is not finished is never a candidate."""
    live = (
        F.col("job_state").isin("queued", "claimed", "running")
        & (F.col("job_attempt") == F.col("dir_attempt"))
    )
    candidates = dirs.filter(~F.coalesce(live, F.lit(False)))
    total = candidates.agg(F.sum("size")).scalar()
    planned = running_total(candidates, "size", ("mtime", "id"), "freed_before")
    return planned.filter(total - F.col("freed_before") > ceiling)


def stale_jobs(jobs: DataFrame, cutoff: str, max_attempts: int) -> DataFrame:
    """Claimed or running jobs whose heartbeat is older than the cutoff, and what becomes of them."""
    return jobs.filter(
        F.col("state").isin("claimed", "running") & (F.col("heartbeat_at") < moment(cutoff))
    ).withColumn("next_state", F.when(F.col("attempt") >= max_attempts, "failed").otherwise("queued"))


def stage_progress(jobs: DataFrame) -> DataFrame:
    """Stages done and total of each job's own walk, and the rounded percentage."""
    walks = F.create_map(
        *chain.from_iterable((F.lit(kind), F.array(*[F.lit(s) for s in walk])) for kind, walk in JOB_WALKS.items())
    )
    walk = walks[F.col("kind")]
    done = F.coalesce(F.array_position(walk, F.col("stage")), F.lit(0)).cast("int")
    total = F.size(walk)
    # Halves round to even, as the original percentage does.
    return jobs.withColumns(
        {"stages_done": done, "stages_total": total, "progress_pct": F.bround(done * 100 / total).cast("int")}
    )
