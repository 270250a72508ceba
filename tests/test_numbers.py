"""Negative, fractional, zero and missing values in the statistics; late events in the counts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.functions.registry import exact_stdv
from rasterloom.operators import ensemble as en
from rasterloom.operators.accuracy import rmspe
from rasterloom.session import scratch_path
from rasterloom.streaming import tasks as st


def preds(spark, values, kind):
    return spark.createDataFrame([(0, 0, v) for v in values], f"row int, col int, pred {kind}")


def test_negative_classes_vote(spark):
    got = en.votes(preds(spark, [-3, -3, 5, None], "int")).first()
    assert (got["vote"], got["pct_vote"], got["count"]) == (-3, 67, 3)
    assert en.votes(preds(spark, [-3, -2, -2, -3], "int")).first()["vote"] == -3
    assert en.votes(preds(spark, [0.5, 0.5, 2.5], "double")).first()["vote"] == 0.5


def test_fractions_are_averaged_before_they_are_cut(spark):
    got = en.aggregate_stored(preds(spark, [6.9, 9.9, 17.9], "double"), "pred").first()
    assert (got["mean"], got["stdv"], got["count"]) == (11, 4, 3)
    assert en.aggregate_stored(preds(spark, [None, None], "double"), "pred").first()["mean"] == -9999


def test_stdv_of_fractions_and_large_sums(spark):
    stdv = lambda values, kind: preds(spark, values, kind).agg(exact_stdv(F.col("pred")).alias("s")).first()["s"]
    assert math.isclose(stdv([0.6, 0.9, 1.7], "double"), 0.46427960923947064)
    assert stdv([2, 4, None], "int") == 1.0
    assert stdv([None], "int") is None
    assert math.isclose(stdv([3_000_000_000, 1_000_000_000], "bigint"), 1e9)
    assert math.isclose(stdv([4_000_000_000_000, 2_000_000_000_000], "bigint"), 1e12)


def test_rmspe_without_truth(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "x double, y double")
    assert df.agg(rmspe(F.col("x"), F.col("y")).alias("e")).first()["e"] == 50.0


def test_progress_counts_late_events(spark):
    """Shuffled files, one a batch: the counts are those of the whole log."""
    log = spark.range(300).select(
        F.pmod(F.xxhash64("id"), F.lit(7)).alias("task_id"),
        F.when(F.col("id") % 3 == 0, "COMPLETED").otherwise("INFO").alias("state"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200_000))).alias("ts"),
    )
    src = scratch_path(spark, "log")
    log.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "late")
    st.run_upsert(st.progress(stream), out, scratch_path(spark, "late-check"))
    rows = spark.read.schema("start_us long, state string, n long, batch int").parquet(f"{out}/*")
    got = sorted(map(tuple, st.latest(rows, ["start_us", "state"], "n").collect()))
    want = log.groupBy(F.window("ts", "1 hour").alias("w"), "state").count().select(F.unix_micros("w.start"), "state", "count")
    assert got == sorted(map(tuple, want.collect()))


def test_stored_statistics_of_many_large_members(spark):
    """20,000 members near a million: the product of their count and squares passes a long."""
    df = spark.range(20_000).selectExpr("1 AS row", "2 AS col", "CAST(1000000 + id % 3 AS INT) AS pred")
    got = en.aggregate_stored(df, "pred").first()
    assert (got["mean"], got["stdv"], got["count"]) == (1_000_000, 0, 20_000)
    far = spark.range(20_000).selectExpr("1 AS row", "2 AS col", "CAST(id % 2 * 2000000000 AS INT) AS pred")
    got = en.aggregate_stored(far, "pred").first()
    assert (got["mean"], got["stdv"]) == (1_000_000_000, 1_000_000_000)


def test_named_statistics(spark):
    rows = [(1, 1, 5, 2, 80, 1, 3), (1, 1, 6, 2, 90, 1, 2), (1, 1, 7, 3, 70, 4, 0), (1, 2, 5, None, 80, 1, 3), (1, 2, 6, 4, 91, 1, 2)]
    df = spark.createDataFrame(rows, "row int, col int, set_id int, pred int, oob_rate int, importance_0 int, importance_1 int")
    got = en.aggregate(df, list(en.AGG_STATS), importances=["importance_0", "importance_1"]).orderBy("col")
    assert got.columns == ["row", "col", *en.AGG_STATS]
    assert [tuple(r) for r in got.collect()] == [(1, 1, 2, 2, 2, 0, 67, 0, 80, 3), (1, 2, 4, 4, 4, 0, 100, 1, 91, 1)]
    assert en.aggregate(df, ["pct_vote"]).columns == ["row", "col", "pct_vote"]
