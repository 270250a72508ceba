"""Structured Streaming over the task log and over arriving observations."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.operators.composite import KEYS, medoid
from rasterloom.session import materialize
from rasterloom.sources.writers import path_exists

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# States that close a task.
FAILED_STATES = ["FAILED", "CANCELLED", "CANCEL_REQUESTED"]

READY_SCHEMA = "task_id long, ready_us long"
STATE_SCHEMA = "completed long, failed long, infos array<long>, emitted boolean"
NEVER = 1 << 62


def _ready(key, chunks, state: GroupState):
    """Merge a task's new rows into its bounded state and emit it the first time it is ready.

    Only minima are kept (first completion, first failure, three earliest info records), so rows may arrive in any order and
    a task with very many rows is read chunk by chunk.
    """
    completed, failed, infos, emitted = state.get if state.exists else (NEVER, NEVER, [], False)
    infos = list(infos)
    for pdf in chunks:
        us = pdf["us"]
        done, bad = us[pdf["state"] == "COMPLETED"], us[pdf["state"].isin(FAILED_STATES)]
        completed = min(completed, int(done.min())) if len(done) else completed
        failed = min(failed, int(bad.min())) if len(bad) else failed
        infos = sorted(infos + us[pdf["state"] == "INFO"].nsmallest(3).astype(int).tolist())[:3]
    third = infos[2] if len(infos) > 2 else NEVER
    ready = max(completed, infos[1]) if len(infos) > 1 else NEVER
    fire = not emitted and ready < NEVER and ready < third and ready < failed
    state.update((completed, failed, infos, emitted or fire))
    yield pd.DataFrame({"task_id": [key[0]], "ready_us": [ready]} if fire else {"task_id": [], "ready_us": []}).astype("int64")


def ready_tasks(events: DataFrame) -> DataFrame:
    """Tasks that completed with exactly two info records and no failure before; each is emitted once."""
    rows = events.select("task_id", "state", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("task_id").applyInPandasWithState(_ready, READY_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


ANSWER_SCHEMA = "task_id long, ready_us long"


def _answer(key, chunks, state: GroupState):
    """As ``_ready``, but gives the answer whenever it changes, NULL where later news withdrew it; a task that timed out is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    completed, failed, infos, told, last = state.get if state.exists else (NEVER, NEVER, [], NEVER, 0)
    infos = list(infos)
    for pdf in chunks:
        us = pdf["us"]
        done, bad = us[pdf["state"] == "COMPLETED"], us[pdf["state"].isin(FAILED_STATES)]
        completed = min(completed, int(done.min())) if len(done) else completed
        failed = min(failed, int(bad.min())) if len(bad) else failed
        infos = sorted(infos + us[pdf["state"] == "INFO"].nsmallest(3).astype(int).tolist())[:3]
        last, keep = max(last, int(us.max())), int(pdf["keep_ms"].iloc[0])
    ready = max(completed, infos[1]) if len(infos) > 1 else NEVER
    now = ready if ready < min(failed, infos[2] if len(infos) > 2 else NEVER) else NEVER
    state.update((completed, failed, infos, now, last))
    if keep:
        state.setTimeoutTimestamp(max(last // 1000 + keep, state.getCurrentWatermarkMs() + 1))
    if now != told:
        yield pd.DataFrame({"task_id": [key[0]], "ready_us": pd.array([None if now == NEVER else now], "Int64")})


def ready_answers(events: DataFrame, keep: str | None = None) -> DataFrame:
    """Current ready time per task, for an upserting sink: what a batch over the events so far would say, however they are dealt to micro-batches.

    Rows may come in any order; only minima are kept. Without ``keep`` no row is too late and a task's few numbers stay. With it (an interval such as
    ``7 days``) rows older than the newest event by more are dropped, and a task without news for that long is forgotten by an event-time timer.
    """
    ms = 0 if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows if keep is None else rows.withWatermark("ts", keep)
    rows = rows.select("task_id", "state", "ts", F.unix_micros("ts").alias("us"), F.lit(ms).cast("long").alias("keep_ms"))
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("task_id").applyInPandasWithState(
        _answer, ANSWER_SCHEMA, "completed long, failed long, infos array<long>, told long, last long", "update", timeout
    )


RUNS_SCHEMA = "task_id long, first_us array<long>, last_us array<long>, updates array<long>, newest_us long"


def merged_runs(runs: list[tuple[int, int, int]], wait: int) -> list[tuple[int, int, int]]:
    """(first, last, updates) of runs in any order, joined where less than ``wait`` lies between them."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(runs):
        if out and first < out[-1][1] + wait:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _runs(key, chunks, state: GroupState):
    first, last, n = state.get if state.exists else ([], [], [])
    runs, newest = list(zip(first, last, n)), 0
    for pdf in chunks:
        us = sorted(pdf["us"].tolist())
        newest, wait = max(newest, us[-1]), int(pdf["wait_us"].iloc[0])
        runs = merged_runs(runs + merged_runs([(u, u, 1) for u in us], wait), wait)
    cols = [list(c) for c in zip(*runs)]
    state.update(tuple(cols))
    yield pd.DataFrame({"task_id": [key[0]], "first_us": [cols[0]], "last_us": [cols[1]], "updates": [cols[2]], "newest_us": [newest]})


def run_answers(events: DataFrame, max_wait: str) -> DataFrame:
    """Each task's runs of updates so far, for an upserting sink. No row is dropped as late: one that falls between two runs joins them.

    The state holds three numbers per run of a task.
    """
    us = int(pd.Timedelta(max_wait).total_seconds() * 1_000_000)
    rows = events.select("task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(us).cast("long").alias("wait_us"))
    return rows.groupBy("task_id").applyInPandasWithState(
        _runs, RUNS_SCHEMA, "first array<long>, last array<long>, n array<long>", "update", GroupStateTimeout.NoTimeout
    )


def stalled_runs(upserts: DataFrame, max_wait: str) -> DataFrame:
    """Runs of the newest answers that were followed by nothing for ``max_wait`` before the newest event of all, to the millisecond."""
    us = int(pd.Timedelta(max_wait).total_seconds() * 1_000_000)
    now = upserts.groupBy("task_id").agg(F.max_by(F.struct("first_us", "last_us", "updates"), "batch").alias("r"))
    runs = now.select("task_id", F.explode(F.arrays_zip(F.col("r.first_us"), F.col("r.last_us"), F.col("r.updates"))).alias("r"))
    newest = upserts.agg(F.max("newest_us")).scalar()
    runs = runs.select("task_id", F.col("r.first_us").alias("first_us"), (F.col("r.last_us") + us).alias("stalled_us"), F.col("r.updates").alias("updates"))
    return runs.filter(F.floor(F.col("stalled_us") / 1000) <= F.floor(newest / 1000))


def stalls(events: DataFrame, max_wait: str, delay: str = "0 seconds") -> DataFrame:
    """Runs of updates of a task that were followed by nothing for ``max_wait``.

    A session window closes when the watermark passes its end, which is the event-time timeout; no user code runs.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    runs = rows.groupBy("task_id", F.session_window("ts", max_wait).alias("w")).agg(F.count(F.lit(1)).alias("updates"))
    return runs.select("task_id", F.unix_micros("w.start").alias("first_us"), F.unix_micros("w.end").alias("stalled_us"), "updates")


def progress(events: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Events per window and state; finished and failed totals are read off it.

    Without ``delay`` no event is ever too late, and the state holds one count per window and state seen. With it, windows older
    than the delay are closed and what comes later for them is not counted.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows if delay is None else rows.withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", width).alias("w"), "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_micros("w.start").alias("start_us"), "state", "n")


def run_append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what is available into a Parquet folder."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def run_upsert(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain an updating aggregate; every batch writes its changed rows under its own batch id.

    A batch that runs again overwrites its own folder, so results stay exact after a failure.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    q.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def latest(updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Current value per key of an upserted result."""
    return updates.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def incremental_composites(stream: DataFrame, base: str, checkpoint: str, bands: list[str], tile_rows: int = 256) -> None:
    """Keep annual medoid composites current as observations arrive.

    Each micro-batch is added to the observation history and the touched (tile, year) partitions, and only those, are recomputed
    and overwritten. The history is laid out by year, tile and batch, so a re-run batch replaces its own rows.
    """
    history, current = f"{base}/history", f"{base}/composites"

    def refresh(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        part = df.withColumns({"tile": F.floor(F.col("row") / tile_rows).cast("int"), "batch": F.lit(batch)})
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yr", "tile", "batch").parquet(history)
        seen = spark.read.parquet(history).filter(F.col("batch") <= batch)
        # One row per touched partition; partition pruning reads just those folders.
        touched = seen.filter(F.col("batch") == batch).select("yr", "tile").distinct()
        rows = seen.join(touched, ["yr", "tile"], "left_semi")
        fresh = medoid(rows, bands).withColumn("tile", F.floor(F.col("row") / tile_rows).cast("int"))
        fresh = materialize(fresh, "composites")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yr", "tile").parquet(current)

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh)
    q.trigger(availableNow=True).start().awaitTermination()
    if not path_exists(stream.sparkSession, current):
        raise ValueError("no observations arrived")


def composites(spark, base: str, bands: list[str]) -> DataFrame:
    return spark.read.parquet(f"{base}/composites").select(*KEYS, *bands)
