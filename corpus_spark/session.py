"""Session settings and the written-table workspace.

`materialize` cuts lineage by writing a parquet table in the shared folder the cluster names in
`spark.checkpoint.dir`. A written table outlives any executor, and readers get column pruning and
size statistics that an RDD checkpoint does not give.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Safe at any scale; none of them depends on the data size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytecodes; past that size split projections win.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_SHIPPED: set[str] = set()  # applications that have the package
_LOCAL_FOLDERS: dict[str, str] = {}  # by application, in local mode only
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("corpus_spark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.corpus_spark.spread", str(shuffle_partitions))  # the given tables are one row group each
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application: they know the driver's import
    path only where it is theirs, too."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-")  # the driver serves the file from here while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "corpus_spark"), "zip", root, "corpus_spark"))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediates: the cluster's own, or a temporary one in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is unset: name a folder every executor can reach before running "
            "a job that writes intermediates"
        )
    name = context.applicationId
    if name not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[name] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_FOLDERS[name]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back, so several readers share one computation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def finished_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For steps that end in written tables: their shuffles go with them instead of piling up."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """`materialize` for tables that nothing needs behind the block: they are removed there."""
    paths = []

    def write(df: DataFrame, name: str) -> DataFrame:
        paths.append(fresh_path(spark, name))
        df.write.option("compression", "zstd").parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
