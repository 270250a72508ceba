"""Streaming queries, compared with their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.functions.spectral import BANDS
from rasterloom.plans.registry import query
from rasterloom.plans.timeseries import medoid_sql
from rasterloom.session import scratch_path
from rasterloom.streaming import tasks as st


def stream_of(spark, d, name: str):
    """The table's file as a file-source stream."""
    schema = fx.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _events(spark, d):
    return fx.as_task_events(stream_of(spark, d, "events"))


@query("task_ready_stream", "task_events", """
i AS (SELECT task_id, ts, row_number() OVER (PARTITION BY task_id ORDER BY ts) AS k FROM task_events WHERE state = 'INFO'),
p AS (SELECT task_id, max(ts) FILTER (k = 2) AS i2, max(ts) FILTER (k = 3) AS i3 FROM i GROUP BY task_id),
e AS (SELECT task_id, min(ts) FILTER (state = 'COMPLETED') AS done, min(ts) FILTER (state IN ('FAILED', 'CANCELLED', 'CANCEL_REQUESTED')) AS bad
  FROM task_events GROUP BY task_id),
r AS (SELECT e.task_id, greatest(done, i2) AS ready, i3, bad, done, i2 FROM e JOIN p ON p.task_id = e.task_id)
SELECT task_id, epoch_us(ready) AS ready_us FROM r WHERE done IS NOT NULL AND i2 IS NOT NULL AND (i3 IS NULL OR ready < i3) AND (bad IS NULL OR ready < bad)""")
def task_ready_stream(spark, d):
    out, check = scratch_path(spark, "ready"), scratch_path(spark, "ready-check")
    st.run_upsert(st.ready_answers(_events(spark, d)), out, check)
    rows = spark.read.schema(f"{st.ANSWER_SCHEMA}, batch int").parquet(f"{out}/*")
    return st.latest(rows, ["task_id"], "ready_us").filter("ready_us IS NOT NULL")


@query("stall_timeout", "task_events", """
g AS (SELECT task_id, ts, lag(ts) OVER (PARTITION BY task_id ORDER BY ts) AS p FROM task_events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 24 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts) AS run FROM g),
w AS (SELECT task_id, run, min(ts) AS a, max(ts) + INTERVAL 24 HOURS AS b, count(*) AS n FROM s GROUP BY task_id, run)
SELECT task_id, epoch_us(a) AS first_us, epoch_us(b) AS stalled_us, n AS updates FROM w
WHERE date_trunc('millisecond', b) <= (SELECT date_trunc('millisecond', max(ts)) FROM task_events)""")
def stall_timeout(spark, d):
    out, check = scratch_path(spark, "stalls"), scratch_path(spark, "stalls-check")
    st.run_upsert(st.run_answers(_events(spark, d), "24 hours"), out, check)
    return st.stalled_runs(spark.read.schema(f"{st.RUNS_SCHEMA}, batch int").parquet(f"{out}/*"), "24 hours")


@query("progress_counts", "task_events", """
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, state, count(*) AS n FROM task_events GROUP BY 1, 2""")
def progress_counts(spark, d):
    out, check = scratch_path(spark, "progress"), scratch_path(spark, "progress-check")
    st.run_upsert(st.progress(_events(spark, d)), out, check)
    rows = spark.read.schema("start_us long, state string, n long, batch int").parquet(f"{out}/*")
    return st.latest(rows, ["start_us", "state"], "n")


@query("composite_incremental", "obs", f"{medoid_sql('obs')} SELECT * FROM medoid")
def composite_incremental(spark, d):
    base, check = scratch_path(spark, "composites"), scratch_path(spark, "composites-check")
    items = stream_of(spark, d, "lineitem")
    st.incremental_composites(fx.as_obs(items).select("row", "col", "yr", "ts", *BANDS), base, check, BANDS)
    return st.composites(spark, base, BANDS)
