"""The same rules on live data, in Structured Streaming.

Event times are timestamps with the session's zone (a watermark needs them); every job's
sink is idempotent by batch id, so a batch that runs again after a failure gives the same
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.rounds import shared_folder

#: state in files beside the executor's heap, as typed state asks for
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under the checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_snapshots(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Snapshots as they arrive as Parquet files, at least once, with a fixed schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def _state_store(spark: SparkSession):
    name, value = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run(stream: DataFrame, folder: str, mode: str, save: Callable[[DataFrame, int], None]) -> None:
    """Process what has arrived since the folder's last run, and end."""
    with _state_store(stream.sparkSession):
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def run_now(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; each batch's rows go to a folder of its own.

    A batch that runs again overwrites its own folder. Returns all rows with ``batch_id``.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    _run(stream, folder, mode, save)
    return stream.sparkSession.read.schema(stream.schema.add("batch_id", "long")).parquet(f"{folder}/out")


def fold_latest(saved: DataFrame, key: list[str]) -> DataFrame:
    """Of updated rows the last batch's per key."""
    rest = [c for c in saved.columns if c not in (*key, "batch_id")]
    return saved.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("v")).select(*key, "v.*")


BUCKETS = 64


def read_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of an upserted table, each key once; no history is read."""
    return spark.read.schema(schema).parquet(f"{folder}/table").drop("bucket", "last_batch")


def upsert(batch: DataFrame, batch_id: int, folder: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge a batch into a table of one row per key, rewriting only the buckets that it touches.

    ``merge(old, new)`` gives the new rows of keys that are in both or in one; ``old`` and ``new``
    have the table's columns. The table is partitioned by a hash of the key; touched buckets
    are made in a folder beside it and then put in their place by a dynamic partition
    overwrite. Rows remember the last batch that changed them and a log names the batches that
    are done: a batch that runs again, wholly or after a break between table and log, changes
    nothing twice.
    """
    spark, table = batch.sparkSession, f"{folder}/table"
    schema = StructType(list(batch.schema.fields)).add("last_batch", "long").add("bucket", "integer")
    done = spark.read.schema("batch_id long").json(f"{folder}/log") if _exists(spark, f"{folder}/log") else None
    if done is not None and not done.filter(F.col("batch_id") == batch_id).isEmpty():
        return
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    touched = [r.bucket for r in batch.select(place.alias("bucket")).distinct().collect()]  # at most ``buckets``
    if touched:
        held = spark.read.schema(schema).parquet(table) if _exists(spark, table) else spark.createDataFrame([], schema)
        old = held.filter(F.col("bucket").isin(touched))
        behind = old.filter(F.col("last_batch") < batch_id).drop("last_batch", "bucket")
        ahead = old.filter(F.col("last_batch") >= batch_id)
        new = batch.join(ahead.select(*key), key, "left_anti")
        changed = new.select(*key).distinct()
        merged = merge(behind.join(changed, key, "left_semi"), new).select(*batch.columns).withColumn("last_batch", F.lit(batch_id).cast("long")).withColumn("bucket", place)
        kept = old.join(changed, key, "left_anti").select(*merged.columns)
        staged = f"{folder}/staged/batch_id={batch_id}"
        merged.unionByName(kept).write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(merged.schema).parquet(staged).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("append").json(f"{folder}/log")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def sink_findings(detections: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Problems as they are detected: each batch is appended to the detections and folded into one row per key.

    ``detections(db_id, rule, finding_key, detection_id, at_s, severity)``. The problem holds how
    often it was seen, first and last, and the last severity (ties by the greater detection).
    """
    key = ["db_id", "rule", "finding_key"]
    latest = F.struct("last_s", "last_id", "severity")

    def fold(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new).groupBy(*key).agg(F.sum("n").alias("n"), F.min("first_s").alias("first_s"), F.max(latest).alias("l"))
        return both.select(*key, "n", "first_s", "l.last_s", "l.last_id", "l.severity")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/detections/batch_id={batch_id}")
        one = F.lit(1).cast("long").alias("n")
        rows = batch.select(*key, one, F.col("at_s").alias("first_s"), F.col("at_s").alias("last_s"), F.col("detection_id").alias("last_id"), "severity")
        upsert(fold(rows.limit(0), rows), batch_id, folder, key, fold, buckets)

    _run(detections, folder, "append", save)


PROBLEM = "db_id string, rule string, finding_key string, n long, first_s long, last_s long, last_id long, severity string"


def dedup_stream(snapshots: DataFrame, key: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """A snapshot sent again within ``delay`` counts once."""
    return snapshots.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def late_policy(snapshots: DataFrame, at: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose window has closed, ``delay`` after its end, are left out; how many rows came is observed per batch.

    What was left out is ``late_rows`` of the arrivals and the windows' counts.
    """
    return snapshots.observe("arrivals", F.count("*").alias("rows"), F.max(at).alias("newest")).withWatermark(at, delay)


def late_rows(arrived: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """``(key, arrived, counted, late)`` of ``arrived(key, n)`` and ``counted(key, n)``: a side count of late rows."""
    total = lambda df, name: df.groupBy(key).agg(F.sum("n").alias(name))
    both = total(arrived, "arrived").join(total(counted, "counted"), key, "left").select(key, "arrived", F.coalesce("counted", F.lit(0).cast("long")).alias("counted"))
    return both.withColumn("late", F.col("arrived") - F.col("counted"))


def stream_evaluation(evaluations: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """Windows per ten minutes, rule and state (T07), for update mode."""
    counts = evaluations.withWatermark(at, delay).groupBy(F.window(at, "10 minutes").alias("w"), "db_id", "code", "state").agg(F.count("*").alias("n"))
    return counts.select("db_id", "code", "state", F.unix_seconds("w.start").alias("bucket_s"), "n")


def lookback(reports: DataFrame, at: str, width: str = "120 seconds", step: str = "60 seconds", delay: str = "1 hour") -> DataFrame:
    """What each cycle sees of the last ``width`` (T08), for update mode."""
    seen = reports.withWatermark(at, delay).groupBy(F.window(at, width, step).alias("w"), "db_id").agg(F.count("*").alias("n"))
    return seen.select("db_id", F.unix_seconds("w.end").alias("cycle_s"), "n")


def sessions(detections: DataFrame, at: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Stretches of activity per database, apart by more than ``gap`` (T09), for append or complete mode."""
    grouped = detections.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), "db_id").agg(F.count("*").alias("n"))
    return grouped.select("db_id", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("__at", F.timestamp_seconds("at_s")).withWatermark("__at", delay)


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


class _Expiring(StatefulProcessor):
    """Typed state of a key that goes when the watermark is ``keep_s`` past the key's last event."""

    states: tuple[str, ...] = ()

    def __init__(self, keep_s: int):
        self.keep_s = keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at_ms long")

    def expire_after(self, last_s: int, timer_values) -> None:
        before = int(self.timer.get()[0]) if self.timer.exists() else None
        at = max((last_s + self.keep_s) * 1000, timer_values.getCurrentWatermarkInMs() + 1)
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for name in (*self.states, "timer"):
            getattr(self, name).clear()
        yield from ()

    def close(self) -> None:
        pass


class _Baseline(_Expiring):
    states = ("last", "means")

    def __init__(self, min_calls: int, baseline: int, ratio: float, plus_ms: float, keep_s: int):
        super().__init__(keep_s)
        self.min_calls, self.baseline, self.ratio, self.plus_ms = min_calls, baseline, ratio, plus_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at_s long, calls long, time_ms double, epoch_s long")
        self.means = handle.getListState("means", "mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = list(self.last.get()) if self.last.exists() else None
        means = [float(m[0]) for m in self.means.get()] if last is not None else []
        batch = pd.concat(list(rows)).sort_values("at_s")
        out, before = [], list(means)
        for at, calls, time, epoch in zip(batch["at_s"], batch["calls"], batch["time_ms"], batch["epoch_s"]):
            at, calls, epoch, time = int(at), _whole(calls), _whole(epoch), None if pd.isna(time) else float(time)
            if calls is None or (last is not None and at <= last[0]):
                continue
            if last is not None and at - last[0] > self.keep_s:
                last, means = None, []
            same = last is not None and (epoch is None or last[3] is None or epoch == last[3])
            known = epoch if epoch is not None or last is None else last[3]
            if same and calls == last[1]:
                last[3] = known
                continue
            if same and time is not None and last[2] is not None:
                n, t = calls - last[1], time - last[2]
                if n >= max(1, self.min_calls) and t >= 0:
                    mean = t / n
                    if len(means) == self.baseline and (middle := float(np.median(means))) > 0 and mean >= self.ratio * middle and mean - middle >= self.plus_ms:
                        out.append((key[0], key[1], at, n, mean, middle))
                    means = [*means, mean][-self.baseline :]
            last = [at, calls, time, known]
        if last is not None:
            self.last.update(tuple(last))
            if means != before:
                if means:
                    self.means.put([(m,) for m in means])
                else:
                    self.means.clear()
            self.expire_after(last[0], timerValues)
        yield pd.DataFrame(out, columns=["db_id", "query_id", "at_s", "n", "mean_ms", "baseline_ms"])


def stream_baseline(statements: DataFrame, min_calls: int = 5, baseline: int = 60, ratio: float = 2.0, plus_ms: float = 10.0, keep_hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """AP-01 incrementally (T04): per fingerprint a value state with the last counters, a list state with the last ``baseline`` means.

    ``statements(db_id, query_id, at_s, calls, time_ms, epoch_s)`` with cumulative counters.
    Samples older than the last one kept are skipped, idle ones do not advance the state; a
    null epoch is unknown: it is no reset and the last known one stays. Samples without
    calls are skipped; a null time gives no window. A silence of more than ``keep_hours``
    starts anew; a timer frees the state when the watermark, ``delay`` behind, has passed it.
    """
    return _timed(statements, delay).groupBy("db_id", "query_id").transformWithStateInPandas(
        _Baseline(min_calls, baseline, ratio, plus_ms, keep_hours * 3600), "db_id string, query_id string, at_s long, n long, mean_ms double, baseline_ms double", "append", "eventTime"
    )


class _Cascade(_Expiring):
    states = ("last", "known", "told")

    def __init__(self, age_s: int, wait_s: int, blocked: int, gap_s: int, keep_s: int):
        super().__init__(keep_s)
        self.age_s, self.wait_s, self.blocked, self.gap_s = age_s, wait_s, blocked, gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at_s long")
        self.known = handle.getListState("known", "name string")
        self.told = handle.getMapState("told", "name string", "last_s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at0 = int(self.last.get()[0]) if self.last.exists() else None
        known = {k[0] for k in self.known.get()} if at0 is not None else set()
        told = {k[0]: int(v[0]) for k, v in self.told.iterator()} if at0 is not None else {}
        was, out = dict(told), []
        batch = pd.concat(list(rows)).dropna(subset=["at_s", "pid", "tx_start_s"])
        for at, sample in batch.sort_values(["at_s", "pid"]).groupby("at_s"):
            if at0 is not None and at <= at0:
                continue
            fit = sample[(at - sample.tx_start_s >= self.age_s) & (sample.n_blocked >= self.blocked) & (sample.min_wait_s >= self.wait_s)]
            now = {f"{int(p)}/{int(t)}": (p, t, w) for p, t, w in zip(fit.pid, fit.tx_start_s, fit.total_wait_s)}
            if at0 is not None and at - at0 <= self.gap_s:
                for name in sorted(now.keys() & known - told.keys()):
                    p, t, w = now[name]
                    out.append((key[0], int(p), int(t), int(at), _whole(w)))
                    told[name] = int(at)
            for p, t in zip(sample.pid, sample.tx_start_s):
                if (name := f"{int(p)}/{int(t)}") in told:
                    told[name] = int(at)
            at0, known = int(at), set(now)
            told = {name: seen for name, seen in told.items() if at0 - seen <= self.keep_s}
        if at0 is not None:
            self.last.update((at0,))
            if known:
                self.known.put([(name,) for name in sorted(known)])
            else:
                self.known.clear()
            # only what changed is written
            for name in was.keys() - told.keys():
                self.told.removeKey((name,))
            for name, seen in told.items():
                if was.get(name) != seen:
                    self.told.updateValue((name,), (seen,))
            self.expire_after(at0, timerValues)
        yield pd.DataFrame(out, columns=["db_id", "pid", "tx_start_s", "at_s", "impact_s"])


def stream_cascade(roots: DataFrame, age_s: int = 30, wait_s: int = 5, blocked: int = 2, gap_s: int = 60, keep_hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """CT-05 incrementally (T05): a database's last sample as value, its qualifying roots as list, what was reported as map state.

    A reported transaction is forgotten ``keep_hours`` after it was last a root, and a silent
    database after as long, by a timer. Rows with a null time, process or start are skipped.
    """
    return _timed(roots, delay).groupBy("db_id").transformWithStateInPandas(
        _Cascade(age_s, wait_s, blocked, gap_s, keep_hours * 3600), "db_id string, pid long, tx_start_s long, at_s long, impact_s long", "append", "eventTime"
    )


class _Deadlocks(_Expiring):
    states = ("count",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "last_s long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n = (int(v) for v in self.count.get()) if self.count.exists() else (None, 0)
        out = []
        for at_s, report in sorted((int(a), int(r)) for b in rows for a, r in zip(b["at_s"], b["report_id"])):
            n = 1 if last is None or at_s - last > self.keep_s else n + 1
            last = at_s if last is None else max(last, at_s)
            out.append((key[0], key[1], report, n))
        self.count.update((last, n))
        self.expire_after(last, timerValues)
        yield pd.DataFrame(out, columns=["db_id", "signature", "report_id", "occurrence"])


def stream_deadlocks(reports: DataFrame, at: str, delay: str = "10 minutes", days: int = 7) -> DataFrame:
    """Deadlocks seen once within ``delay``, counted per signature, restarting after ``days`` of silence, when a timer also frees the state."""
    once = dedup_stream(reports, ["db_id", "report_id"], at, delay)
    return once.groupBy("db_id", "signature").transformWithStateInPandas(
        _Deadlocks(days * 86400), "db_id string, signature string, report_id long, occurrence long", "append", "eventTime"
    )
