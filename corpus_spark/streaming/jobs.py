"""Structured Streaming jobs over the append-only logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from corpus_spark.operators.merge import KEY_ID, is_few, key_id, merge_observations
from corpus_spark.operators.ordered import with_neighbour_rows
from corpus_spark.operators.triage import latest
from corpus_spark.session import STATE_STORE, finished_shuffles_dropped, fresh_path, scratch
from corpus_spark.sources.bucketed import WRITTEN, KeyedLog


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> int:
    """Runs `each` over everything that has arrived; the number of the last batch, -1 for none."""
    seen = []

    def step(batch: DataFrame, batch_id: int) -> None:
        each(batch, batch_id)
        seen.append(batch_id)

    running = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return max(seen, default=-1)


class ObservationRows(KeyedLog):
    """The rows of each package as they arrived, and beside them marks that hold a key's `key_id` instead of its columns.

    A mark says that, from its version on, its package has the key no longer (`withdrawn` true), or has it with the mark's
    `observed_at` (`withdrawn` false). A key that is new and arrives once needs no mark. So rows are moved once, when they are written and come to
    lie together by package. Which of them count is found from keys and marks, and only packages with rows that do not need whole rows compared.
    """

    def __init__(self, spark: SparkSession, path: str, observations: StructType, buckets: int) -> None:
        self.columns = observations.names
        schema = StructType([*observations.fields, StructField(KEY_ID, BinaryType()), StructField("withdrawn", BooleanType())])
        super().__init__(spark, path, schema, ["package", KEY_ID], bucket_by=["package"], tombstone="withdrawn", buckets=buckets)

    def _by_key(self, rows: DataFrame, columns: Sequence[str], *states: Column) -> DataFrame:
        """Per package and key: whether it is `gone`, the `row` (with these columns) that counts, when the key was first `seen`, and other
        states. Of a key that came several times with one version the smallest row counts."""
        at, withdrawn = F.col(WRITTEN), F.col("withdrawn")
        return (
            rows.withColumn(KEY_ID, F.coalesce(KEY_ID, key_id()))
            .select("package", KEY_ID, WRITTEN, "withdrawn", "observed_at", *columns)
            .groupBy("package", KEY_ID)
            .agg(
                F.max(F.struct(at.alias("at"), F.coalesce(withdrawn, F.lit(False)).alias("gone"))).alias("last"),
                F.max(F.when(~withdrawn, F.struct(at.alias("at"), "observed_at"))).alias("mark"),
                F.min(F.when(withdrawn.isNull(), F.struct((-at).alias("age"), "observed_at", *columns))).alias("row"),
                *states,
            )
            .withColumn("gone", F.col("last.gone"))
            .withColumn("seen", F.when(F.col("mark.at") == F.col("last.at"), F.col("mark.observed_at")).otherwise(F.col("row.observed_at")))
        )

    def _newest(self, rows: DataFrame) -> DataFrame:
        gone, rest = F.col("gone"), [c for c in self.columns if c not in ("package", "observed_at")]
        values = {c: F.when(~gone, F.col(f"row.{c}")) for c in rest} | {
            "package": F.col("package"), "observed_at": F.when(~gone, F.col("seen")), KEY_ID: F.when(gone, F.col(KEY_ID)),
            "withdrawn": F.when(gone, True), WRITTEN: F.col("last.at"),
        }
        return self._by_key(rows, rest).select(*[values[c].alias(c) for c in self.stored.names])

    def live(self, rows: DataFrame) -> DataFrame:
        """Of rows that were read, those that count."""
        return self._newest(rows).filter("withdrawn IS NULL").select(*self.columns)

    def standing(self, rows: DataFrame) -> DataFrame:
        """(package, live, kept, first_seen_at, last_seen_at): how many keys a package has, how many rows lie there for it, whether they
        count or not, and when its keys were first seen. Where both numbers are equal, all rows count."""
        seen = F.when(~F.col("gone"), F.col("seen"))
        return (
            self._by_key(rows, [], F.count(F.when(F.col("withdrawn").isNull(), 1)).alias("kept"))
            .groupBy("package")
            .agg(
                F.count(F.when(~F.col("gone"), 1)).alias("live"), F.sum("kept").alias("kept"),
                F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"),
            )
        )


def observation_logs(spark: SparkSession, path: str, observations: DataFrame, buckets: int = 16) -> tuple[KeyedLog, ObservationRows, KeyedLog]:
    """The tables of `merge_stream` under `path`: which package each key was last seen in and when first, the rows of each package
    (see `ObservationRows`), and the merged facts (a package without a row is `deleted`)."""
    known = observations.select(key_id().alias(KEY_ID), "package", "observed_at").schema
    index = KeyedLog(spark, f"{path}/index", known, [KEY_ID], buckets=buckets)
    rows = ObservationRows(spark, f"{path}/rows", observations.schema, buckets)
    merged = merge_observations(observations.limit(0)).schema
    facts = KeyedLog(
        spark, f"{path}/facts", StructType([*merged.fields, StructField("deleted", BooleanType())]), ["package"],
        tombstone="deleted", buckets=buckets,
    )
    return index, rows, facts


def merge_stream(stream: DataFrame, index: KeyedLog, rows: ObservationRows, facts: KeyedLog, checkpoint: str) -> int:
    """Facts kept up with a stream of observations, replay-safe. See `observation_logs` for the tables.

    A key keeps the time it was first seen; when it turns up under another package, its row is withdrawn from the old one
    and both are merged again. A batch reads the buckets of its keys in `index` and the buckets of its packages in
    `rows`, where folding keeps the runs few, and nothing else, however many batches came before it. Of an arrival the whole row is shuffled
    once, into its bucket; keys are looked up by their `key_id`.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession) as write:
            step(batch, batch_id, write)

    def step(batch: DataFrame, batch_id: int, write: Callable[[DataFrame, str], DataFrame]) -> None:
        came = batch.select(key_id().alias(KEY_ID), "package", "observed_at")
        decided = write(decide(came, index.read(batch_id - 1, came)), "decided")
        index.append(decided.select(*index.schema.names), batch_id)
        marks = write(marks_of(came, decided), "marks")
        rows.append(batch.unionByName(marks, allowMissingColumns=True), batch_id)
        touched = write(decided.select("package").union(marks.select("package")).distinct(), "packages")
        facts.append(remerge(rows, rows.read(batch_id, touched), touched, write), batch_id)

    with finished_shuffles_dropped(index.spark):
        return run_available(stream, checkpoint, each)


def decide(came: DataFrame, known: DataFrame) -> DataFrame:
    """Per key that came: the package that has it now and had it before, when it was first seen, whether it was known or came several times
    (`again`), and whether it came under several packages. One key may arrive twice in a batch; the smallest row decides, whatever the order."""
    arrived = F.col(WRITTEN).isNull()
    name = F.when(arrived, F.col("package"))
    return (
        came.withColumn(WRITTEN, F.lit(None).cast("bigint"))
        .unionByName(known)
        .groupBy(KEY_ID)
        .agg(
            F.min(F.when(arrived, F.struct("observed_at", "package"))).alias("new"),
            F.max(F.when(~arrived, F.struct(WRITTEN, "package", "observed_at"))).alias("old"),
            F.count(F.when(arrived, 1)).alias("n"),
            (F.min(name) != F.max(name)).alias("scattered"),
        )
        .filter("new IS NOT NULL")
        .select(
            KEY_ID, "new.package", F.coalesce("old.observed_at", "new.observed_at").alias("observed_at"), F.col("old.package").alias("old_package"),
            (F.col("old").isNotNull() | (F.col("n") > 1)).alias("again"), "scattered",
        )
    )


def marks_of(came: DataFrame, decided: DataFrame) -> DataFrame:
    """The marks of `ObservationRows` that a batch makes."""
    stays = decided.filter("again").select("package", KEY_ID, "observed_at", F.lit(False).alias("withdrawn"))
    left = decided.filter("old_package <> package").select(F.col("old_package").alias("package"), KEY_ID)
    several = decided.filter("scattered")
    if not several.isEmpty():
        others = came.join(several.select(KEY_ID, F.col("package").alias("winner")), KEY_ID).filter("package <> winner")
        left = left.union(others.select("package", KEY_ID)).distinct()
    return stays.unionByName(left.withColumn("withdrawn", F.lit(True)), allowMissingColumns=True)


def remerge(rows: ObservationRows, read: DataFrame, touched: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The facts of the touched packages from rows that were read, with `deleted` for those without one.

    Few packages are picked before their rows are merged. Many are after it: rows lie together by package and come together
    in the merge, which moves less than a join of rows would.
    """
    few = is_few(touched)
    if few:
        read = read.join(F.broadcast(touched), "package", "left_semi")
    merged = merge_observations(read.filter("withdrawn IS NULL").select(*rows.columns))
    if not few:
        merged = merged.join(touched, "package", "left_semi")
    names = merged.columns
    if read.filter("withdrawn IS NOT NULL").isEmpty():
        return merged.withColumn("deleted", F.lit(False))
    standing = rows.standing(read)
    standing = write(standing if few else standing.join(touched, "package", "left_semi"), "standing")
    merged = merged.drop("first_seen_at", "last_seen_at").join(standing.filter("live > 0 AND live = kept").drop("live", "kept"), "package").select(*names)
    mixed = standing.filter("live > 0 AND live < kept").select("package")
    if not mixed.isEmpty():
        mixed = F.broadcast(mixed) if is_few(mixed) else mixed
        merged = merged.unionByName(merge_observations(write(rows.live(read.join(mixed, "package", "left_semi")), "mixed")))
    emptied = standing.filter("live = 0").select("package", F.lit(True).alias("deleted"))
    return merged.withColumn("deleted", F.lit(False)).unionByName(emptied, allowMissingColumns=True)


def latest_log(spark: SparkSession, path: str, schema: StructType, key: str, order: tuple[str, ...], buckets: int = 16) -> KeyedLog:
    """The table of `latest_stream`: the newest row per key by `order`, folded as it grows."""
    return KeyedLog(spark, path, schema, [key], order=order, buckets=buckets)


def latest_stream(stream: DataFrame, state: KeyedLog, checkpoint: str) -> int:
    """Each batch adds its own newest row per key to `state` (see `latest_log`). Rows are compared when they are folded or read,
    so batches may arrive in any order, and a reader opens a number of files that grows with the logarithm of the batches."""
    key = state.keys[0]

    def each(batch: DataFrame, batch_id: int) -> None:
        state.append(latest(batch, key, state.order, [c for c in batch.columns if c != key]), batch_id)

    return run_available(stream, checkpoint, each)


class HeartbeatTimeout(StatefulProcessor):
    """Per job: a beat without another within `stale_after_s` after it makes the job stale, or exhausted
    if it was the last attempt. A beat is judged once the watermark has passed that time, so the outcome does not
    depend on how beats were dealt to batches. Beats at one time count as one, with the highest attempt.

    State per job is the beats that no known beat follows in time: one, and more only where gaps
    longer than `stale_after_s` lie within one lateness."""

    def __init__(self, stale_after_s: int, max_attempts: int) -> None:
        self.wait_us, self.max_attempts = stale_after_s * 1_000_000, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_beats = handle.getMapState("open_beats", "at_us bigint", "attempt int")

    def _known(self) -> dict[int, int]:
        return {at[0]: attempt[0] for at, attempt in self.open_beats.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        beats = dict(known)
        for frame in rows:
            times = frame["beat_at"].astype("datetime64[us]").astype("int64")
            for at, attempt in zip(times, frame["attempt"], strict=True):
                attempt = 0 if pd.isna(attempt) else int(attempt)
                beats[int(at)] = max(attempt, beats.get(int(at), attempt))
        times = sorted(beats)
        unfollowed = {at for at, after in zip(times, [*times[1:], None], strict=True) if after is None or after - at > self.wait_us}
        for at in known.keys() - unfollowed:
            self.open_beats.removeKey((at,))
            self.handle.deleteTimer(self._due_ms(at))
        for at in unfollowed:
            if known.get(at) != beats[at]:
                self.open_beats.updateValue((at,), (beats[at],))
            if at not in known:
                self.handle.registerTimer(self._due_ms(at))
        yield from ()

    def _due_ms(self, at_us: int) -> int:
        return (at_us + self.wait_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [(at, attempt) for at, attempt in sorted(self._known().items()) if self._due_ms(at) <= now]
        for at, _ in due:
            self.open_beats.removeKey((at,))
        yield pd.DataFrame(
            {
                "job_id": [key[0]] * len(due),
                "last_beat": [datetime(1970, 1, 1) + timedelta(microseconds=at) for at, _ in due],
                "attempt": [attempt for _, attempt in due],
                "outcome": ["exhausted" if attempt >= self.max_attempts else "stale" for _, attempt in due],
            }
        )

    def close(self) -> None:
        pass


def heartbeat_timeouts(beats: DataFrame, stale_after_s: int, max_attempts: int, lateness: str) -> DataFrame:
    """`beats` is a stream of (job_id, beat_at timestamp, attempt); beats without a time are passed over."""
    return (
        beats.filter("beat_at IS NOT NULL")
        .withWatermark("beat_at", lateness)
        .groupBy("job_id")
        .transformWithStateInPandas(
            HeartbeatTimeout(stale_after_s, max_attempts),
            "job_id string, last_beat timestamp, attempt int, outcome string",
            "Append",
            "EventTime",
        )
    )


LEASE_MEASURES = {"wait": ("requested", {"requested", "acquired"}), "occupied": ("acquired", {"acquired", "released", "reclaimed"})}


def lease_pairing(events: DataFrame, lateness: str, span_s: int = 7 * 86_400) -> DataFrame:
    """`events` is a stream of (id bigint, job_id, event, happened_at timestamp), in any order within `lateness`; rows without a job or a time,
    and events that are no lease's, are passed over.

    The events of a job and span of time are gathered as they come and paired in their own order once the watermark has passed the
    span's end, when no more can come; then they are forgotten. What comes out are the intervals that begin and end in the span, and its border
    rows, the first and the last event of each measure, from which `lease_intervals_of` pairs what crosses spans. A job with a third of all
    events is as many keys as it has spans, and what is held of it is what lies within a span and the lateness.
    """
    wanted = sorted(set().union(*(takes for _, takes in LEASE_MEASURES.values())))
    event = F.struct(F.unix_micros("happened_at").alias("at_us"), F.col("id").cast("bigint").alias("id"), "event")
    spans = (
        events.filter(F.col("job_id").isNotNull() & F.col("happened_at").isNotNull() & F.col("event").isin(wanted))
        .withWatermark("happened_at", lateness)
        .groupBy("job_id", F.window("happened_at", f"{span_s} seconds").alias("span"))
        .agg(F.collect_list(event).alias("events"))
        .select("job_id", F.floor(F.unix_micros("span.start") / F.lit(span_s * 1_000_000)).cast("bigint").alias("span"), F.sort_array("events").alias("events"))
    )

    def rows_of(measure: str) -> tuple[Column, Column]:
        """The rows of a measure: its pairs within the span, and its border rows."""
        opens, takes = LEASE_MEASURES[measure]

        def row(border: bool, start: Column, end: Column, event_id: Column, kind: Column) -> Column:
            return F.struct(
                F.lit(measure).alias("measure"), F.lit(border).alias("border"), start.alias("start_us"), end.cast("bigint").alias("end_us"),
                event_id.cast("bigint").alias("id"), kind.cast("string").alias("event"),
            )

        mine, none = F.filter("events", lambda e: e["event"].isin(*takes)), F.lit(None)
        pairs = F.zip_with(
            mine, F.slice(mine, 2, F.greatest(F.size(mine) - 1, F.lit(0))),
            lambda e, after: F.when((e["event"] == opens) & (after["event"] != opens), row(False, e["at_us"], after["at_us"], none, none)),
        )
        ends = F.array_distinct(F.array(F.get(mine, F.lit(0)), F.get(mine, F.size(mine) - 1)))
        return F.array_compact(pairs), F.transform(F.array_compact(ends), lambda e: row(True, e["at_us"], none, e["id"], e["event"]))

    found = F.concat(*[rows for measure in LEASE_MEASURES for rows in rows_of(measure)])
    return spans.select("job_id", "span", F.inline(found))


def lease_intervals_of(paired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed, open) intervals (job_id, measure, start_us, end_us) from what `lease_pairing` has left so far.

    Border rows are at most two per job, measure and span; the last row of a span meets the first of the job's next one."""
    opens = F.when(F.col("measure") == "wait", LEASE_MEASURES["wait"][0]).otherwise(LEASE_MEASURES["occupied"][0])
    borders = paired.filter("border").select("job_id", "measure", "span", "start_us", "id", "event").withColumn(
        "stream", F.concat("measure", F.lit("/"), "job_id")
    )
    met = with_neighbour_rows(borders, "stream", ("start_us", "id"), ("event", "start_us", "span"))
    across = met.filter((F.col("previous_span") < F.col("span")) & (F.col("previous_event") == opens) & (F.col("event") != opens))
    closed = paired.filter("NOT border").select("job_id", "measure", "start_us", "end_us")
    closed = closed.unionByName(across.select("job_id", "measure", F.col("previous_start_us").alias("start_us"), F.col("start_us").alias("end_us")))
    pending = met.filter(F.col("last") & (F.col("event") == opens))
    return closed, pending.select("job_id", "measure", "start_us", F.lit(None).cast("bigint").alias("end_us"))


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store, and what a stream gathers should not have to fit in the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def collect_stream(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stateful stream over everything that has arrived, into a parquet table. With a path and a
    checkpoint of its own, a later call goes on where this one ended."""
    spark = stream.sparkSession
    use_state_store(spark)
    path = path or fresh_path(spark, name)
    running = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{name}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
