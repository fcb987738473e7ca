import os
import random

import pytest

from corpus_spark.session import fresh_path
from corpus_spark.sources.bucketed import KeyedLog, KeyedTable
from corpus_spark.sources.tables import replace_by_key, upsert_columns

ROW = "key string, part string, value bigint, gone boolean"


def told(frame):
    return sorted((r.key, r.part, r.value) for r in frame.collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_log_keeps_the_newest_row_and_few_runs(spark):
    r = random.Random(5)
    path = fresh_path(spark, "log")
    log = KeyedLog(spark, path, spark.createDataFrame([], ROW).schema, ["key", "part"], bucket_by=["key"], tombstone="gone", buckets=2, fan=3)
    want, read = {}, []
    for version in range(20):
        batch = {(f"k{r.randrange(6)}", "p"): (version, r.random() < 0.2) for _ in range(3)}
        batch[("k0", "p")] = (version, False)
        log.append(spark.createDataFrame([(*k, *v) for k, v in batch.items()], ROW).coalesce(1), version)
        want.update(batch)
        within = spark.createDataFrame([("k0",)], "key string")
        read.append(sum(run.rows for run in log.read_runs(version, within)))
        assert all(len(runs) <= 2 * 3 for runs in log.runs(version).values())  # fan - 1 a level, three levels
    assert told(log.current(19)) == sorted((*k, v) for k, (v, gone) in want.items() if not gone)
    # 60 rows were appended to two buckets of six keys; what a batch reads stays near the keys of one bucket.
    assert max(read) <= 24 and max(read[12:]) <= max(read[:12]) + 6
    assert len(files(path)) <= 2 * 2 * 6  # two versions at most


def test_runs_that_are_folded_at_once_leave_no_files(spark):
    path = fresh_path(spark, "log")
    log = KeyedLog(spark, path, spark.createDataFrame([], ROW).schema, ["key"], buckets=1, fan=2)
    for version in range(6):
        log.append(spark.createDataFrame([("k", "p", version, None)], ROW), version)
    named = {run.folder for v in log.versions() for found in log.runs(v).values() for run in found}
    assert {os.path.relpath(os.path.dirname(f), path) for f in files(path)} == named


def test_log_order_of_its_own(spark):
    log = KeyedLog(spark, fresh_path(spark, "log"), spark.createDataFrame([], ROW).schema, ["key"], order=("value",), buckets=2, fan=2)
    for version, value in enumerate([5, 9, 7, 1]):
        log.append(spark.createDataFrame([("k", "p", value, None)], ROW), version)
    assert told(log.current()) == [("k", "p", 9)]


def test_replayed_version_leaves_the_same(spark):
    log = KeyedLog(spark, fresh_path(spark, "log"), spark.createDataFrame([], ROW).schema, ["key"], buckets=2, fan=2)
    frames = [spark.createDataFrame([("a", "p", n, False), (f"b{n}", "p", n, False)], ROW) for n in range(4)]
    for version in (0, 1, 2, 2, 3, 3):
        log.append(frames[version], version)
    assert told(log.current()) == [("a", "p", 3), ("b0", "p", 0), ("b1", "p", 1), ("b2", "p", 2), ("b3", "p", 3)]
    assert told(log.current(2)) == [("a", "p", 2), ("b0", "p", 0), ("b1", "p", 1), ("b2", "p", 2)]


def test_empty_log_and_empty_append(spark):
    empty = spark.createDataFrame([], ROW)
    log = KeyedLog(spark, fresh_path(spark, "log"), empty.schema, ["key"], buckets=2)
    assert told(log.current()) == []
    log.append(empty, 0)
    assert told(log.current()) == [] and log.runs() == {}
    log.append(spark.createDataFrame([(None, "p", 1, None)], ROW), 1)
    assert [r.value for r in log.current().collect()] == [1]


@pytest.mark.parametrize("change", ["upsert", "replace"])
def test_a_change_rewrites_its_buckets_only(spark, change):
    schema = "key string, created bigint, value bigint"
    stored = spark.createDataFrame([(f"k{n}", n, n) for n in range(40)], schema)
    incoming = spark.createDataFrame([("k3", 100, 100), ("new", 7, 8)], schema)
    path = fresh_path(spark, "table")
    table = KeyedTable(spark, path, stored.schema, ["key"], buckets=8)
    table.upsert(stored)
    before, reader = files(path), table.read(0)
    if change == "upsert":
        version, want = table.upsert(incoming, insert_only=["created"]), upsert_columns(stored, incoming, ["key"], ["created"])
    else:
        version, want = table.replace(incoming), replace_by_key(stored, incoming, ["key"])
    assert sorted(table.read().collect()) == sorted(want.select("key", "created", "value").collect())
    touched = set(table.buckets_of(incoming))
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert len(kept) >= 5 and kept <= files(path)
    named = {run.folder for runs in table.runs(version).values() for run in runs}
    assert {n for n in named if n.startswith("run=1/")} == {f"run=1/_bucket={b}" for b in touched}
    assert reader.count() == 40  # who reads the version before goes on reading it
