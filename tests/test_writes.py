"""How much the merge moves: rows of a package lie together, and each pass combines them before it shuffles."""

import os

from pyspark.sql import functions as F

from corpus_spark.operators import merge
from corpus_spark.session import materialize, scratch
from corpus_spark.testbed.registry import Bed
from factories import observations

DATA = "/root/testdata/sf0.01"


def test_stored_observations_hold_a_package_in_few_files(spark):
    stored = Bed(spark, DATA).stored_observations.select("package", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    files = stored.groupBy("package").agg(F.count_distinct("file").alias("n")).agg(F.max("n")).first()[0]
    assert files == 1
    packages = [r[0] for r in stored.orderBy("at").select("package").collect()]
    runs = 1 + sum(a != b for a, b in zip(packages, packages[1:], strict=False))
    assert runs == len(set(packages))


def test_remerge_brings_the_touched_rows_together_once(spark):
    obs = Bed(spark, DATA).stored_observations
    late = F.substring("build", 2, 20).cast("long") % 10 == 0
    _, facts = merge.remerge_touched(merge.merge_observations(obs.filter(~late)), obs.filter(~late), obs.filter(late))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # the touched rows are read, not joined again for each pass


def test_remerge_moves_keys_and_not_rows(spark):
    size, rows = 10_000, 300
    came = [{"package": f"p{n % 3}", "device_path": f"/{n}.apk", "icon_bytes": bytearray(os.urandom(size))} for n in range(rows)]
    stored = materialize(observations(spark, *came).orderBy("package"), "stored")
    # A key moves to another package from one that it alone was in.
    incoming = observations(spark, {**came[0], "package": "p1", "device_path": "/moved.apk"}, {"package": "p2", "device_path": "/new.apk"})
    stored = stored.unionByName(observations(spark, {"package": "old", "device_path": "/moved.apk"}))
    told, threshold = spark.sparkContext._jsc.sc().statusStore(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        before = told.executorSummary("driver").totalShuffleWrite()
        _, facts = merge.remerge_touched(merge.merge_observations(stored), stored, incoming)
        assert {r.package for r in facts.collect()} == {"p0", "p1", "p2"}
        assert told.executorSummary("driver").totalShuffleWrite() - before < 0.5 * size * rows
    finally:
        spark.conf.unset(threshold)


def test_scratch_tables_go_with_their_block(spark):
    with scratch(spark) as write:
        df = write(spark.range(3), "scratch-test")
        assert df.count() == 3
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert fs.exists(fs_path)
    assert not fs.exists(fs_path)
