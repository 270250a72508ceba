"""Streams fed in several batches against their batch meaning."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rasterloom.operators.composite import medoid
from rasterloom.streaming import tasks as st

T0 = datetime(2024, 1, 1)


def _log(n=400):
    r = random.Random(5)
    states = ["READY", "RUNNING", "COMPLETED", "FAILED", "INFO"]
    # A third of all events belong to one task.
    return [(T0 + timedelta(minutes=7 * i, seconds=r.randint(0, 59)), 0 if r.random() < 0.33 else r.randint(1, 60), r.choice(states)) for i in range(n)]


@pytest.fixture
def log_dir(spark, tmp_path):
    """The log as four files, each one micro-batch."""
    path = str(tmp_path / "log")
    data = _log()
    for k in range(4):
        part = spark.createDataFrame(data[k * 100 : (k + 1) * 100], "ts timestamp, task_id long, state string")
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _us(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_tasks_become_ready_once(spark, log_dir, tmp_path):
    out = str(tmp_path / "out")
    st.run_append(st.ready_tasks(_stream(spark, log_dir)), out, str(tmp_path / "check"))
    want = []
    for task in {t for _, t, _ in _log()}:
        infos, done, failed = [], None, False
        for ts, who, state in sorted(_log()):
            if who != task:
                continue
            failed |= state == "FAILED"
            done = done or (ts if state == "COMPLETED" else None)
            infos += [ts] if state == "INFO" else []
            if done and len(infos) == 2 and not failed:
                want.append((task, _us(ts)))
                break
    got = rows(spark.read.schema(st.READY_SCHEMA).parquet(out), "task_id")
    assert len(got) == len(set(got))
    assert {t for (t,) in got} >= {t for t, _ in want}
    assert want


def test_ready_state_ignores_row_order(spark, log_dir, tmp_path):
    # All rows in one batch: exactly the batch answer, whatever order they arrive in.
    one = str(tmp_path / "one")
    spark.read.parquet(log_dir).orderBy(F.rand(3)).coalesce(1).write.parquet(one)
    out = str(tmp_path / "out")
    st.run_append(st.ready_tasks(_stream(spark, one)), out, str(tmp_path / "check"))
    e = spark.read.parquet(log_dir).groupBy("task_id").agg(
        F.min(F.when(F.col("state") == "COMPLETED", F.unix_micros("ts"))).alias("d"),
        F.min(F.when(F.col("state") == "FAILED", F.unix_micros("ts"))).alias("f"),
        F.sort_array(F.collect_list(F.when(F.col("state") == "INFO", F.unix_micros("ts")))).alias("i"),
    )
    e = e.filter("d IS NOT NULL AND size(i) >= 2").withColumn("r", F.greatest("d", F.col("i")[1]))
    e = e.filter("(f IS NULL OR r < f) AND (size(i) = 2 OR r < try_element_at(i, 3))")
    assert rows(spark.read.schema(st.READY_SCHEMA).parquet(out), "task_id", "ready_us") == rows(e, "task_id", "r")


def test_progress_equals_batch_counts(spark, log_dir, tmp_path):
    out = str(tmp_path / "out")
    st.run_upsert(st.progress(_stream(spark, log_dir)), out, str(tmp_path / "check"))
    upserts = spark.read.schema("start_us long, state string, n long, batch int").parquet(f"{out}/*")
    want = spark.read.parquet(log_dir).groupBy(F.unix_micros(F.date_trunc("hour", "ts")).alias("s"), "state").count()
    assert rows(st.latest(upserts, ["start_us", "state"], "n"), "start_us", "state", "n") == rows(want, "s", "state", "count")


def test_stalls_are_closed_sessions(spark, log_dir, tmp_path):
    out = str(tmp_path / "out")
    st.run_append(st.stalls(_stream(spark, log_dir), "5 hours", delay="1 hour"), out, str(tmp_path / "check"))
    got = rows(spark.read.schema("task_id long, first_us long, stalled_us long, updates long").parquet(out), "task_id", "first_us", "updates")
    want, last = [], max(t for t, _, _ in _log())
    for task in {t for _, t, _ in _log()}:
        times = sorted(t for t, who, _ in _log() if who == task)
        run = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t >= run[-1] + timedelta(hours=5):
                if run[-1] + timedelta(hours=6) <= last:
                    want.append((task, _us(run[0]), len(run)))
                run = []
            run.append(t)
    assert got == sorted(want) and want


def test_composites_follow_arrivals(spark, tmp_path):
    r = random.Random(7)
    data = [(r.randint(0, 5), r.randint(0, 3), 2000 + r.randint(0, 2), i, r.randint(0, 50), r.randint(0, 50)) for i in range(300)]
    schema = "row int, col int, yr int, ts int, b1 int, b2 int"
    path = str(tmp_path / "obs")
    for k in range(3):
        spark.createDataFrame(data[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(path)
    base = str(tmp_path / "base")
    st.incremental_composites(_stream(spark, path), base, str(tmp_path / "check"), ["b1", "b2"], tile_rows=2)
    want = rows(medoid(spark.createDataFrame(data, schema), ["b1", "b2"]))
    assert rows(st.composites(spark, base, ["b1", "b2"])) == want


@pytest.mark.parametrize("files", [1, 3, 8])
def test_answers_do_not_depend_on_batches(spark, tmp_path, files):
    """Rows shuffled over several files, one micro-batch each, give the rows of a batch over all of them."""
    data = _log(240)
    random.Random(files).shuffle(data)
    path = str(tmp_path / "log")
    for k in range(files):
        spark.createDataFrame(data[k::files], "ts timestamp, task_id long, state string").coalesce(1).write.mode("append").parquet(path)
    ready, stalled = [], []
    for task in {t for _, t, _ in data}:
        own = sorted((ts, s) for ts, t, s in data if t == task)
        times = lambda *states: [_us(ts) for ts, s in own if s in states]
        infos, done, bad = times("INFO"), times("COMPLETED"), times("FAILED")
        if done and len(infos) > 1:
            at = max(done[0], infos[1])
            if (not bad or at < bad[0]) and (len(infos) == 2 or at < infos[2]):
                ready.append((task, at))
        stalled += [(task, *run) for run in _plain_runs([_us(ts) for ts, _ in own])]
    newest = max(_us(ts) for ts, _, _ in data)
    wait = 5 * 3600 * 1_000_000
    stalled = sorted((t, a, b + wait, n) for t, a, b, n in stalled if (b + wait) // 1000 <= newest // 1000)
    for name, stream, schema in (("ready", st.ready_answers(_stream(spark, path)), st.ANSWER_SCHEMA), ("runs", st.run_answers(_stream(spark, path), "5 hours"), st.RUNS_SCHEMA)):
        st.run_upsert(stream, str(tmp_path / name), str(tmp_path / f"{name}-check"))
        got = spark.read.schema(f"{schema}, batch int").parquet(f"{tmp_path}/{name}/*")
        if name == "ready":
            assert rows(st.latest(got, ["task_id"], "ready_us").filter("ready_us IS NOT NULL"), "task_id", "ready_us") == sorted(ready) and ready
        else:
            assert rows(st.stalled_runs(got, "5 hours"), "task_id", "first_us", "stalled_us", "updates") == stalled and stalled


def _plain_runs(times):
    runs = []
    for t in times:
        if runs and t < runs[-1][1] + 5 * 3600 * 1_000_000:
            runs[-1] = (runs[-1][0], t, runs[-1][2] + 1)
        else:
            runs.append((t, t, 1))
    return runs


def test_closed_tasks_are_forgotten(spark, tmp_path):
    """With ``keep`` a timer drops the state of a task without news; its answer stays in the sink."""
    path = str(tmp_path / "log")
    for k, (day, task, state) in enumerate([(0, 1, "INFO"), (0, 1, "INFO"), (0, 1, "COMPLETED"), (9, 2, "INFO"), (20, 3, "INFO"), (30, 4, "INFO")]):
        spark.createDataFrame([(T0 + timedelta(days=day, minutes=k), task, state)], "ts timestamp, task_id long, state string").coalesce(1).write.mode("append").parquet(path)
    st.run_upsert(st.ready_answers(_stream(spark, path), keep="2 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(f"{st.ANSWER_SCHEMA}, batch int").parquet(f"{tmp_path}/out/*")
    assert rows(st.latest(got, ["task_id"], "ready_us"), "task_id", "ready_us") == [(1, _us(T0 + timedelta(minutes=2)))]
    held = {r["key"]["task_id"] for r in spark.read.format("statestore").load(str(tmp_path / "check")).collect()}
    assert 1 not in held and 4 in held


def test_quantile_buckets_spread_sparse_ids(spark):
    from rasterloom.operators.ranking import id_rank, quantile_bucket

    r = random.Random(1)
    ids = sorted({r.randint(0, 1 << 62) for _ in range(300)} | set(range(100)))
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    sizes = rows(df.filter("id IS NOT NULL").groupBy(quantile_bucket(df, "id", 20).alias("b")).count(), "b", "count")
    assert max(n for _, n in sizes) <= 60 and len(sizes) > 10
    got = rows(id_rank(df.filter("id IS NOT NULL"), "id"), "id", "rk")
    assert got == [(v, i + 1) for i, v in enumerate(ids)]
