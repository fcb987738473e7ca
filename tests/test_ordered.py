import random

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import ordered, telemetry
from datetime import datetime, timedelta

# One key holds most of the rows, and times repeat.
RNG = random.Random(3)
ROWS = [("hot" if RNG.random() < 0.7 else RNG.choice("abc"), RNG.randint(0, 40), i, RNG.randint(1, 9)) for i in range(500)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "k string, t int, id int, size int").repartition(5)


def test_running_total_matches_brute_force(frame):
    got = {r.id: r.before for r in ordered.running_total(frame, "size", ("t", "id"), "before", slices=7).collect()}
    total, want = 0, {}
    for _, t, i, size in sorted(ROWS, key=lambda r: (r[1], r[2])):
        want[i] = total
        total += size
    assert got == want


def test_numbering_continues_over_slices(frame):
    got = {r.id: r.n for r in ordered.numbered(frame, ["k"], ["t", "id"], "n", slices=7).collect()}
    want = {}
    for key in {r[0] for r in ROWS}:
        for n, row in enumerate(sorted((r for r in ROWS if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[row[2]] = n
    assert got == want


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_previous_row_crosses_slices(frame, slices):
    got = {r.id: (r.previous_id, r.last) for r in ordered.with_neighbour_rows(frame, "k", ("t", "id"), ("id",), slices=slices).collect()}
    want = {}
    for key in {r[0] for r in ROWS}:
        mine = sorted((r for r in ROWS if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, row in enumerate(mine):
            want[row[2]] = (mine[n - 1][2] if n else None, n == len(mine) - 1)
    assert got == want


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_last_marked_row_crosses_slices(frame, slices):
    rows = ordered.sliced(frame, ("k", "t", "id"), "marks", slices)
    marks = {"rare": F.when(F.col("id") % 23 == 0, F.col("id")), "usual": F.when(F.col("id") % 2 == 0, F.col("id")), "none": F.lit(None).cast("int")}
    got = {r.id: (r.rare, r.usual, r.none) for r in ordered.with_last_seen(rows, "k", ("t", "id"), marks).collect()}
    want = {}
    for key in {r[0] for r in ROWS}:
        rare = usual = None
        for row in sorted((r for r in ROWS if r[0] == key), key=lambda r: (r[1], r[2])):
            want[row[2]] = (rare, usual, None)
            rare = row[2] if row[2] % 23 == 0 else rare
            usual = row[2] if row[2] % 2 == 0 else usual
    assert got == want


def test_job_numbers_equal_their_parts(spark):
    base = datetime(2024, 1, 1)
    kinds = [("filter", "w1", "succeeded", "succeeded"), ("filter", "w2", "failed", "failed"), (None, "w1", "succeeded", "succeeded"), ("llm", None, "queued", None), ("branch", "w3", "running", None)]
    rows = [(*kinds[i % 5], base + timedelta(minutes=i - 3), base + timedelta(minutes=2 * i) if i % 5 < 3 else None) for i in range(40)]
    jobs = spark.createDataFrame(rows, "stage string, worker_id string, state string, outcome string, started_at timestamp_ntz, finished_at timestamp_ntz")
    for table in (jobs, jobs.limit(0)):
        want = [("stage", r.stage, r.completed, r.avg_seconds, r.max_seconds) for r in telemetry.stage_durations(table, START).collect()]
        want += [("worker", r.worker_id, r.jobs_succeeded, r.jobs_failed, r.busy_seconds) for r in telemetry.worker_utilization(table, START, NOW).collect()]
        want += [("queue", "now", telemetry.queue_depth(table).first().queue_depth, None, None)]
        assert sorted(map(tuple, telemetry.job_numbers(table, START, NOW).collect()), key=str) == sorted(((a, b, float(x), y if y is None else float(y), z) for a, b, x, y, z in want), key=str)


START, NOW = "2024-01-01 00:00:00", "2024-01-01 01:00:00"


def events(spark, *rows):
    base = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, j, e, base + timedelta(seconds=s)) for i, (j, e, s) in enumerate(rows)], "id bigint, job_id string, event string, happened_at timestamp_ntz")


def test_open_lease_counts_until_now(spark):
    got = telemetry.lease_stats(events(spark, ("j", "requested", 0), ("j", "acquired", 60)), START, NOW).first()
    assert (got.total_acquisitions, got.occupied_seconds, got.avg_wait_seconds) == (1, 3540.0, 60.0)


def test_holder_from_before_the_window_is_seeded(spark):
    holder = spark.createDataFrame([("old", datetime(2023, 12, 31))], "job_id string, acquired_at timestamp_ntz")
    got = telemetry.lease_stats(events(spark, ("old", "noise", 5)), START, NOW, holder).first()
    assert (got.total_acquisitions, got.occupancy_pct, got.avg_wait_seconds) == (0, 100.0, None)


def test_repeats_replace_and_strays_are_ignored(spark):
    rows = [("j", "released", 1), ("j", "requested", 2), ("j", "requested", 10), ("j", "acquired", 12), ("j", "acquired", 20), ("j", "reclaimed", 25), (None, "acquired", 30)]
    got = sorted((r.measure, r.seconds, r.closed) for r in telemetry.lease_intervals(events(spark, *rows), START, NOW).collect())
    assert got == [("occupied", 5.0, True), ("wait", 2.0, True)]


def test_eviction_spares_the_live_attempt(spark):
    base = datetime(2024, 1, 1)
    rows = [(1, "running", 2, 2, 50, base), (2, "running", 2, 1, 50, base + timedelta(1)), (3, None, None, 1, 50, base + timedelta(2)), (4, "failed", 1, 1, 50, base + timedelta(3))]
    dirs = spark.createDataFrame(rows, "id int, job_state string, job_attempt int, dir_attempt int, size bigint, mtime timestamp_ntz")
    assert [r.id for r in telemetry.eviction_plan(dirs, 60).orderBy("id").collect()] == [2, 3]
    assert telemetry.eviction_plan(dirs, 1000).count() == 0
    assert telemetry.eviction_plan(dirs, 60).agg(F.max("freed_before")).first()[0] == 50
