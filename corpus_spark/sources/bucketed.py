"""Keyed tables in hash buckets, with a version pointer: read and rewritten where a change falls, not as a whole.

Rows lie in `buckets` folders by a hash of their bucket columns. A version is a small list of which folders make up each
bucket, written beside them and moved into place in one step, so a reader sees a version whole or not at all. Folders
are never changed: what a version no longer names stays until the version after it is there, and then goes.

`KeyedLog` appends and folds (few rows written per change, a few more read); `KeyedTable` rewrites the buckets that a
change falls into and keeps all others.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpus_spark.sources.tables import replace_by_key, upsert_columns

BUCKET, WRITTEN = "_bucket", "_written"


@dataclass(frozen=True)
class Run:
    """The rows of one bucket that one write left: `folder` under the table's path, its level and number of rows."""

    folder: str
    level: int
    rows: int


class _Bucketed:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket_by: Sequence[str], buckets: int) -> None:
        self.spark, self.path, self.bucket_by, self.buckets = spark, path, tuple(bucket_by), buckets
        self.schema = StructType(list(schema.fields))
        self.stored = StructType([*self.schema.fields, StructField(WRITTEN, LongType())])
        self._made: list[str] = []  # folders that the version at hand has written

    # Versions

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _version_path(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        fs, folder = self._fs(f"{self.path}/_versions")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def runs(self, version: int | None = None) -> dict[int, list[Run]]:
        """The runs of each bucket, oldest first, in the last version up to `version`."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {}
        fs, path = self._fs(self._version_path(known[-1]))
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): [Run(*r) for r in runs] for b, runs in json.loads(text).items()}

    def _commit(self, version: int, runs: dict[int, list[Run]]) -> None:
        """Writes the version beside its place and moves it in; a repeated write of one version replaces it."""
        text = json.dumps({b: [[r.folder, r.level, r.rows] for r in found] for b, found in runs.items() if found})
        fs, target = self._fs(self._version_path(version))
        _, beside = self._fs(f"{self._version_path(version)}.tmp")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.delete(target, False)
        if not fs.rename(beside, target):
            raise RuntimeError(f"version {version} of {self.path} could not be put in place")

    def _vacuum(self, version: int) -> None:
        """Drops versions before the last one but one, and folders that no version names any more."""
        known = self.versions()
        keep = [v for v in known if v >= version or v == max((k for k in known if k < version), default=version)]
        named = {run.folder for v in keep for found in self.runs(v).values() for run in found}
        # What was folded as soon as it was written stands in no version.
        before = {run.folder for v in known for found in self.runs(v).values() for run in found} | set(self._made)
        self._made.clear()
        for v in known:
            if v not in keep:
                fs, path = self._fs(self._version_path(v))
                fs.delete(path, False)
        for folder in before - named:
            fs, path = self._fs(f"{self.path}/{folder}")
            fs.delete(path, True)

    # Rows

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the bucket columns fall into; no more than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket_of().alias("b")).distinct().collect())

    def _write(self, df: DataFrame, name: str, version: int, level: int) -> dict[int, Run]:
        """One run a bucket; a bucket with very many rows is several files. Rows lie in the order of their bucket columns, so that neighbours
        compress and a reader that groups by these columns combines them before it shuffles."""
        rows = df.withColumn(BUCKET, self.bucket_of())
        if WRITTEN not in df.columns:
            rows = rows.withColumn(WRITTEN, F.lit(version).cast("bigint"))
        placed = rows.select(*self.stored.names, BUCKET).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.bucket_by)
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        schema = StructType([StructField(BUCKET, LongType())])
        counts = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").groupBy(BUCKET).count().collect()
        written = {r[0]: Run(f"{name}/{BUCKET}={r[0]}", level, r[1]) for r in counts}
        self._made += [run.folder for run in written.values()]
        return written

    def _read(self, runs: Iterable[Run]) -> DataFrame:
        paths = [f"{self.path}/{run.folder}" for run in runs]
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*paths)


class KeyedLog(_Bucketed):
    """A log of rows per key in which the newest counts, folded as it grows.

    Each append is a run of level 0 in the buckets it touches. Where a bucket has `fan` runs of one level, they are folded
    into one run of the next, which holds one row per key; so a bucket has fewer than `fan` runs a level, and levels
    grow with the logarithm of the appends. `order` says which row of a key is newest (default: the later version).
    Where a fold takes all of a bucket's runs, keys whose newest row has `tombstone` set go for good.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        keys: Sequence[str],
        bucket_by: Sequence[str] | None = None,
        order: Sequence[str] = (WRITTEN,),
        tombstone: str | None = None,
        buckets: int = 16,
        fan: int = 4,
    ) -> None:
        super().__init__(spark, path, schema, bucket_by or keys, buckets)
        self.keys, self.order, self.tombstone, self.fan = tuple(keys), tuple(order), tombstone, fan

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.stored.names if c not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct(*self.order))
        return rows.groupBy(*self.keys).agg(newest.alias("r")).select(*self.keys, "r.*").select(*self.stored.names)

    def current(self, version: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """The newest row of every key that no tombstone has ended; of the buckets only that rows of `within` fall into, if given."""
        rows = self._newest(self._read(self.read_runs(version, within))).drop(WRITTEN)
        return rows.filter(~F.coalesce(F.col(self.tombstone), F.lit(False))) if self.tombstone else rows

    def read(self, version: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """All rows that `current` reads, older ones and tombstones too, with the version that each was written in."""
        return self._read(self.read_runs(version, within))

    def read_runs(self, version: int | None = None, within: DataFrame | None = None) -> list[Run]:
        """What `current` opens: their `rows` are how many it reads."""
        runs = self.runs(version)
        buckets = runs.keys() if within is None else [b for b in self.buckets_of(within) if b in runs]
        return [run for b in sorted(buckets) for run in runs[b]]

    def append(self, df: DataFrame, version: int) -> None:
        """Version `version`: the last one before it and the rows of `df`. Once it stands, writing it again changes nothing
        but its own folders, so a batch that is replayed leaves what one run leaves."""
        runs = {b: list(found) for b, found in self.runs(version - 1).items()}
        for bucket, run in self._write(df.select(*self.schema.names), f"run={version}", version, 0).items():
            runs.setdefault(bucket, []).append(run)
        level = 0
        while full := [b for b, found in runs.items() if sum(r.level == level for r in found) >= self.fan]:
            # Folds of buckets that lose everything behind their tombstones must not be mixed with the others.
            for whole in (True, False):
                chosen = [b for b in full if (all(r.level <= level for r in runs[b])) == whole]
                if chosen:
                    self._fold(runs, chosen, level, version, whole)
            level += 1
        self._commit(version, runs)
        self._vacuum(version)

    def _fold(self, runs: dict[int, list[Run]], buckets: list[int], level: int, version: int, whole: bool) -> None:
        rows = self._newest(self._read(r for b in buckets for r in runs[b] if r.level == level))
        if whole and self.tombstone:
            rows = rows.filter(~F.coalesce(F.col(self.tombstone), F.lit(False)))
        folded = self._write(rows, f"run={version}-{level + 1}-{'all' if whole else 'some'}", version, level + 1)
        for b in buckets:
            older = [r for r in runs[b] if r.level > level]
            runs[b] = older + ([folded[b]] if b in folded else [])


class KeyedTable(_Bucketed):
    """A table with one set of folders per bucket; a change rewrites the buckets of its keys and no others."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 16) -> None:
        super().__init__(spark, path, schema, keys, buckets)
        self.keys = tuple(keys)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(r for found in self.runs(version).values() for r in found).drop(WRITTEN)

    def _change(self, incoming: DataFrame, change) -> int:
        known = self.versions()
        version = known[-1] + 1 if known else 0
        runs = self.runs()
        touched = self.buckets_of(incoming)
        stored = self._read(r for b in touched for r in runs.get(b, [])).drop(WRITTEN)
        written = self._write(change(stored).select(*self.schema.names), f"run={version}", version, 0) if touched else {}
        for b in touched:
            runs[b] = [written[b]] if b in written else []
        self._commit(version, runs)
        self._vacuum(version)
        return version

    def upsert(self, incoming: DataFrame, insert_only: Sequence[str] = ()) -> int:
        """`sources.tables.upsert_columns`, written; the new version's number. `incoming` has one row per key."""
        return self._change(incoming, lambda stored: upsert_columns(stored, incoming, self.keys, insert_only))

    def replace(self, incoming: DataFrame, keys: Sequence[str] | None = None) -> int:
        """`sources.tables.replace_by_key`, written: stored rows of the named keys go, then the rows of `incoming` come in."""
        return self._change(incoming, lambda stored: replace_by_key(stored, incoming, keys or self.keys))
