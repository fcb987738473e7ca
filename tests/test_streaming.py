import os
from datetime import datetime, timedelta, timezone

import pytest

from corpus_spark.operators import merge
from corpus_spark.operators.merge import merge_observations
from corpus_spark.session import fresh_path
from corpus_spark.streaming import jobs
from factories import observations


def arrivals(spark, *batches):
    path = fresh_path(spark, "arrivals")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_merge_stream_equals_one_merge(spark):
    first = observations(spark, {"package": "a", "cert_issuer": "1"}, {"package": "b", "device_path": "/b.apk"})
    second = observations(spark, {"package": "a", "cert_issuer": "2", "observed_at": datetime(2025, 1, 1)}, {"package": "a", "device_key": "z:9", "cert_issuer": "3"})
    moved = observations(spark, {"package": "c", "device_path": "/b.apk", "observed_at": datetime(2025, 1, 1)})
    again = observations(spark, {"package": "b", "device_path": "/other.apk"})
    logs = jobs.observation_logs(spark, fresh_path(spark, "s"), first, buckets=3)
    last = jobs.merge_stream(arrivals(spark, first, second, moved, again), *logs, fresh_path(spark, "c"))
    got = {r.package: r for r in logs[2].current(last).drop("deleted").collect()}
    assert got["a"].cert_issuer == "2" and got["a"].device_count == 2 and got["a"].first_seen_at == datetime(2024, 1, 1)
    # The moved key keeps the time it was first seen and no longer counts for its old package.
    assert got["c"].first_seen_at == datetime(2024, 1, 1)
    alone = merge_observations(again).first()
    assert str(got["b"]) == str(alone)


def test_packages_that_keys_leave_are_merged_again(spark):
    first = observations(spark, {"package": "a", "device_path": "/a.apk"}, {"package": "b", "device_path": "/b.apk"}, {"package": "b", "device_key": "z:9"})
    moved = observations(spark, {"package": "c", "device_path": "/a.apk"}, {"package": "c", "device_path": "/b.apk"})
    logs = jobs.observation_logs(spark, fresh_path(spark, "ms"), first, buckets=3)
    last = jobs.merge_stream(arrivals(spark, first, moved), *logs, fresh_path(spark, "mc"))
    got = {r.package: r.device_count for r in logs[2].current(last).collect()}
    assert got == {"b": 1, "c": 1}


@pytest.mark.parametrize("few", [200_000, 0])
def test_keys_that_come_again_or_under_several_packages(spark, monkeypatch, few):
    monkeypatch.setattr(merge, "FEW", few)

    def row(package, key, day, issuer):
        return {"package": package, "device_path": f"/{key}.apk", "observed_at": datetime(2024, 1, day), "cert_issuer": issuer}

    batches = [
        [row("a", 1, 1, "i1"), row("a", 2, 2, "i2"), row("b", 3, 3, "i3"), row("a", 4, 9, "late"), row("c", 4, 4, "i4"), row("d", 5, 5, "i5")],
        # 1 is refreshed, 2 comes twice and once under another package, 3 leaves b, which ends.
        [row("a", 1, 20, "j1"), row("a", 2, 22, "z"), row("a", 2, 22, "j2"), row("e", 2, 23, "x"), row("a", 3, 1, "j3")],
        [row("a", 4, 30, "k4"), row("d", 6, 6, "k6")],
    ]
    want = [row("a", 1, 1, "j1"), row("a", 2, 2, "j2"), row("a", 3, 3, "j3"), row("a", 4, 4, "k4"), row("d", 5, 5, "i5"), row("d", 6, 6, "k6")]
    frames = [observations(spark, *b) for b in batches]
    logs = jobs.observation_logs(spark, fresh_path(spark, "again"), frames[0], buckets=1)
    last = jobs.merge_stream(arrivals(spark, *frames), *logs, fresh_path(spark, "ac"))
    got = sorted(map(str, logs[2].current(last).drop("deleted").collect()))
    assert got == sorted(map(str, merge_observations(observations(spark, *want)).collect()))


def test_whole_rows_of_a_batch_are_shuffled_once(spark):
    size, rows = 10_000, 240
    came = [{"package": f"p{n % 3}", "device_path": f"/{n}.apk", "icon_bytes": bytearray(os.urandom(size))} for n in range(rows)]
    first, second = observations(spark, *came[: rows // 2]), observations(spark, *came[rows // 2 :])
    stream = arrivals(spark, first, second)
    logs = jobs.observation_logs(spark, fresh_path(spark, "once"), first, buckets=2)
    told = spark.sparkContext._jsc.sc().statusStore()
    before = told.executorSummary("driver").totalShuffleWrite()
    jobs.merge_stream(stream, *logs, fresh_path(spark, "oc"))
    assert told.executorSummary("driver").totalShuffleWrite() - before < 1.5 * size * rows


def test_older_decisions_do_not_win(spark):
    schema = "package string, id int, decided_at timestamp_ntz"
    newer = spark.createDataFrame([("p", 2, datetime(2024, 2, 1))], schema)
    older = spark.createDataFrame([("p", 1, datetime(2024, 1, 1)), ("q", 3, datetime(2024, 1, 1))], schema)
    state = jobs.latest_log(spark, fresh_path(spark, "l"), newer.schema, "package", ("decided_at", "id"), buckets=2)
    last = jobs.latest_stream(arrivals(spark, newer, older), state, fresh_path(spark, "lc"))
    assert {r.package: r.id for r in state.current(last).collect()} == {"p": 2, "q": 3}


@pytest.mark.parametrize("attempt", [1, 3])
def test_heartbeat_timeout(spark, attempt):
    def beats(*rows):
        return spark.createDataFrame([(j, datetime(2024, 1, 1, h), a) for j, h, a in rows], "job_id string, beat_at timestamp, attempt int")

    stream = arrivals(spark, beats(("dead", 1, attempt), ("alive", 1, 1)), beats(("alive", 2, 1)), beats(("other", 9, 1), ("alive", 9, 1)), beats(("other", 9, 1)))
    got = {(r.job_id, r.outcome) for r in jobs.collect_stream(jobs.heartbeat_timeouts(stream, 4 * 3600, 3, "1 minute"), "hb").collect()}
    assert ("dead", "exhausted" if attempt == 3 else "stale") in got
    assert not any(job == "other" for job, _ in got)


LEASES = "id bigint, job_id string, event string, happened_at timestamp"


def test_leases_pair_in_their_own_order_however_they_arrive(spark):
    def at(hour):
        return datetime(2024, 1, 1) + timedelta(hours=hour)

    # Job a's release comes before its acquire, its next pair crosses two spans; b repeats an acquire; c stays open.
    first = [(4, "a", "released", at(5)), (1, "a", "requested", at(1)), (6, "b", "acquired", at(2)), (9, None, "acquired", at(1))]
    second = [(3, "a", "acquired", at(3)), (7, "b", "acquired", at(4)), (5, "a", "acquired", at(20)), (10, "a", "noise", at(21))]
    third = [(8, "b", "reclaimed", at(9)), (11, "a", "released", at(70)), (12, "c", "acquired", at(71)), (13, "a", "acquired", None)]
    ends = [[(20 + n, "end", "acquired", at(1000 * (n + 1)))] for n in range(2)]
    frames = [spark.createDataFrame(rows, LEASES) for rows in (first, second, third, *ends)]
    paired = jobs.collect_stream(jobs.lease_pairing(arrivals(spark, *frames), "200 hours", span_s=24 * 3600), "leases")
    closed, pending = jobs.lease_intervals_of(paired)
    base, hour = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1e6), 3_600_000_000

    def told(frame):
        return {(r.job_id, r.measure, (r.start_us - base) // hour, r.end_us and (r.end_us - base) // hour) for r in frame.collect()}

    assert told(closed) == {("a", "wait", 1, 3), ("a", "occupied", 3, 5), ("a", "occupied", 20, 70), ("b", "occupied", 4, 9)}
    assert ("c", "occupied", 71, None) in told(pending) and not any(j in "ab" for j, *_ in told(pending))


def test_a_lease_span_ends_with_the_watermark(spark):
    def frame(*rows):
        return spark.createDataFrame([(i, "a", e, datetime(2024, 1, d)) for i, e, d in rows], LEASES)

    stream = arrivals(spark, frame((1, "acquired", 1), (2, "released", 2)), frame((3, "acquired", 9)), frame((4, "released", 30)), frame((5, "acquired", 31)))
    paired = jobs.collect_stream(jobs.lease_pairing(stream, "2 days"), "leases")
    closed, pending = jobs.lease_intervals_of(paired)
    # The span of the 9th is over; the one of the 30th still waits for late events.
    assert closed.count() == 1 and [r.start_us for r in pending.collect()] == [int(datetime(2024, 1, 9, tzinfo=timezone.utc).timestamp() * 1e6)]


def test_lease_events_are_gathered_and_paired_without_python(spark):
    schema = "id bigint, job_id string, event string, happened_at timestamp"
    plan = jobs.lease_pairing(arrivals(spark, spark.createDataFrame([(1, "a", "acquired", datetime(2024, 1, 1))], schema)), "2 days")
    text = plan._jdf.queryExecution().analyzed().toString()
    assert "collect_list" in text and "Python" not in text and "PySpark" not in text
