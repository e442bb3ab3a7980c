"""Streaming forms: arriving scores, progress, quota and re-tiering."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from keepsift import constants as K
from keepsift.functions.numbers import eta_seconds
from keepsift.operators.quota import TOLERANCE_US, UNLIMITED, quota_fold
from keepsift.operators.ranking import latest
from keepsift.operators.sets import upsert_scores
from keepsift.operators.tiers import assign_tiers
from keepsift.session import store

#: Before the number of any event.
RECORD_SEQ = -(2**62)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_scores(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream of score rows from arriving Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


class BatchLog:
    """A log to which a stream appends batches.

    A batch has a folder of its own below the stream's run, so a repeated batch replaces itself and streams
    with other checkpoints never touch it. The run is the id that Spark keeps in the checkpoint.
    """

    def __init__(self, path: str, checkpoint: str):
        self.path, self.checkpoint, self.started_us = path, checkpoint, time.time_ns() // 1000

    def folder(self, spark: SparkSession, batch_id: int) -> str:
        first = spark.read.text(f"{self.checkpoint}/metadata").first()[0]
        return f"{self.path}/run={json.loads(first)['id']}/batch={batch_id}"

    def other_runs(self, spark: SparkSession, batch_id: int) -> list[str]:
        """Folders of the streams with other checkpoints."""
        own = self.folder(spark, batch_id).rsplit("/", 1)[0]
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run=*")
        found = there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there) or []
        paths = [status.getPath().toString() for status in found]
        return [p for p in paths if p.rsplit("/", 1)[1] != own.rsplit("/", 1)[1]]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Rows with the start of their stream and their batch, by which later batches are newer."""
        rows = batch.withColumn("_started", F.lit(self.started_us)).withColumn("_batch", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(self.folder(batch.sparkSession, batch_id))


LOG_ORDER = ("_started", "_batch")


def score_stream(scores: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append arriving scores to a log at once; `stored_scores` reads the latest row per asset.
    Several streams may append to one log."""
    log = BatchLog(log_path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)

    return (
        scores.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_scores(spark: SparkSession, log_path: str, schema, key=("session_id", "image_id"), newest=(*LOG_ORDER, "seq")) -> DataFrame:
    full = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(log_path)
    return upsert_scores(full, key, newest)


def live_progress(scores: DataFrame) -> DataFrame:
    """Scored count and token sums per session; use output mode update."""
    return scores.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("scored_count"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"),
    )


def throttled_eta(progress: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Latest estimate per session and five-second window.

    progress(session_id, ts, elapsed_s, done, total). In output mode append a window is given out once, after it
    closed, and the last ones wait for later rows. In mode update it is given out whenever it changed, so the last
    windows of a session come out too; the newest row of a window counts.
    """
    w = F.window("ts", f"{K.PROGRESS_SECONDS} seconds")
    last = F.max_by(F.struct("elapsed_s", "done", "total"), F.col("ts"))
    rows = progress.withWatermark("ts", delay).groupBy(w, "session_id").agg(last.alias("p"))
    return rows.select(
        "session_id",
        F.col("window.end").alias("at"),
        F.col("p.done").alias("done"),
        eta_seconds(F.col("p.elapsed_s"), F.col("p.done"), F.col("p.total")).alias("eta_seconds"),
    )


def first_scores(scores: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append each asset once per session, however often and however late its score arrives again.

    What the stream itself has appended is in its state, so a batch looks up its own keys only (best in the RocksDB
    state store, `use_state_store`). Of the log it reads the keys that streams with other checkpoints appended. A
    repeated batch gives the same rows.
    """
    log, key = BatchLog(log_path, checkpoint), ["session_id", "image_id"]
    keys = T.StructType([scores.schema[c] for c in key])

    def write(batch: DataFrame, batch_id: int) -> None:
        others = log.other_runs(batch.sparkSession, batch_id)
        if others:
            seen = batch.sparkSession.read.schema(keys).option("recursiveFileLookup", True).parquet(*others)
            batch = store(batch.join(seen, key, "left_anti"), "first")
        log.write(batch, batch_id)

    once = scores.dropDuplicates(key)
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retier_per_batch(
    scores: DataFrame, log_path: str, schema, checkpoint: str, sink: Callable[[DataFrame, int], None], by=()
) -> StreamingQuery:
    """After every micro-batch, tier everything scored so far and hand it to `sink`."""
    spark, log = scores.sparkSession, BatchLog(log_path, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        sink(assign_tiers(stored_scores(spark, log_path, schema).drop(*LOG_ORDER, "seq"), by=by), batch_id)

    return (
        scores.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_events(progress: DataFrame, folders: DataFrame) -> DataFrame:
    """Start and completion per folder: (folder, batch_no, batches, total, scored, event).

    `folders(folder, batch_no, batches, total)` is the plan of the run, `progress(folder, scored)`
    what has been scored.
    """
    scored = F.coalesce("scored", F.lit(0))
    event = F.when(scored >= F.col("total"), "batch-complete").when(scored > 0, "batch-started").otherwise("batch-waiting")
    return folders.join(progress, "folder", "left").select(
        "folder", "batch_no", "batches", "total", scored.alias("scored"), event.alias("event")
    )


def quota_batches(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Quota by micro-batch with the exact, skew-proof fold of `operators.quota`.

    A user's record (month, count, time of the last accepted event) is where the fold of the batch starts: it stands
    before all events of the batch, whatever their number, so an event that arrives late finds the count that there
    is. Only users of the batch are folded. `table` receives outcomes below `outcomes/` and records below `records/`
    of the stream's run, one folder per batch, so a repeated batch replaces its own output.
    """
    spark = events.sparkSession
    cols = ["user_id", "seq", "ts_us", "month_key", "n", "quota"]
    outcomes, records = BatchLog(f"{table}/outcomes", checkpoint), BatchLog(f"{table}/records", checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        new = store(batch.select(*cols), "usage-batch")
        old = None
        work = new
        if batch_id > 0:
            old = spark.read.schema(new.schema).parquet(records.folder(spark, batch_id - 1))
            met = old.join(new.select("user_id").distinct(), "user_id", "left_semi")
            work = new.unionByName(met.withColumn("seq", F.lit(RECORD_SEQ)))
        done = store(quota_fold(work), "quota")
        outcomes.write(done.where(F.col("seq") != RECORD_SEQ), batch_id)
        accepted = done.where(F.col("success") & F.col("quota").isNotNull())
        kept = latest(
            accepted.select("user_id", "seq", "ts_us", "month_key", (F.col("quota") - F.col("remaining")).alias("n"), "quota"),
            ["user_id"],
            ["seq"],
        )
        if old is not None:
            kept = kept.unionByName(old.join(new.select("user_id").distinct(), "user_id", "left_anti"))
        records.write(kept, batch_id)

    return (
        events.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Quota(StatefulProcessor):
    """One record (month, count, last accepted time) per user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "month string, count bigint, last_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self.record.get() if self.record.exists() else None
        month, count, last = state if state else (None, 0, None)
        changed = False
        # All rows that a user has in one micro-batch, in order; the source's rate limit bounds them.
        held = list(rows)
        for pdf in [pd.concat(held).sort_values("seq")] if held else []:
            out = []
            for r in pdf.itertuples(index=False):
                quota = None if pd.isna(r.quota) else int(r.quota)
                if quota is None:
                    out.append((r.user_id, r.seq, True, UNLIMITED, None))
                    continue
                fresh = r.month_key != month
                used, seen = (0, None) if fresh else (count, last)
                if seen is not None and r.ts_us < seen - TOLERANCE_US:
                    out.append((r.user_id, r.seq, False, 0, "CLOCK_TAMPER"))
                elif used + r.n > quota:
                    out.append((r.user_id, r.seq, False, max(0, quota - used), "QUOTA_EXCEEDED"))
                else:
                    month, count, last, changed = r.month_key, used + int(r.n), int(r.ts_us), True
                    out.append((r.user_id, r.seq, True, quota - count, None))
            yield pd.DataFrame(out, columns=["user_id", "seq", "success", "remaining", "error"])
        if changed:
            self.record.update((month, count, last))

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame) -> DataFrame:
    """Outcome per usage event, the streaming form of `operators.quota.quota_fold`.

    events(user_id, seq, ts_us, month_key, n, quota). Needs the RocksDB state store
    (`use_state_store`). The rows of one micro-batch may come in any order; a user's rows of one
    micro-batch are held together. Where a user is hot or a backlog waits, use `quota_batches`.
    """
    return events.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Quota(),
        outputStructType="user_id bigint, seq bigint, success boolean, remaining bigint, error string",
        outputMode="Append",
        timeMode="None",
    )


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
