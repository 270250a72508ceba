"""Bucketed ranks, samples and salted joins against plain definitions, on skewed groups."""

import hashlib
import random
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rasterloom.operators import ranking as rk, sampling as sa
from rasterloom.operators.skew import salted_join, split_hot


def _h(seed, *key):
    return hashlib.md5("|".join([seed, *map(str, key)]).encode()).hexdigest()


def _skewed(n=600):
    r = random.Random(1)
    return [(i, "hot" if r.random() < 0.6 else r.choice("abc")) for i in range(n)]


@pytest.mark.parametrize("per_bucket", [1_000_000, 100, 3])
def test_hash_rank(spark, per_bucket):
    data = _skewed()
    ranked = rk.hash_rank(spark.createDataFrame(data, "id long, g string"), "s", ["id"], ["g"], rows_per_bucket=per_bucket)
    got = dict(rows(ranked, "id", "rk"))
    want = {}
    for g in {g for _, g in data}:
        for k, i in enumerate(sorted((i for i, x in data if x == g), key=lambda i: (_h("s", i), i)), 1):
            want[i] = k
    assert got == want


def test_id_rank_small_buckets(spark):
    ids = random.Random(2).sample(range(100000), 500)
    got = rows(rk.id_rank(spark.createDataFrame([(i,) for i in ids], "id long"), "id", width=64), "id", "rk")
    assert got == [(i, k) for k, i in enumerate(sorted(ids), 1)]


def test_running_sums(spark):
    data = [(float(i), i % 7) for i in range(200)]
    df = rk.running_sums(spark.createDataFrame(data, "v double, n long"), F.col("v"), F.floor(F.col("v") / 9), ["n"])
    total, want = 0, []
    for v, n in data:
        total += n
        want.append((v, total))
    assert rows(df, "v", "cum_n") == want


def test_ntile(spark):
    for n in (1, 2, 3, 7, 10):
        df = spark.range(1, n + 1).select("id", rk.ntile_of(F.col("id"), F.lit(n), 3).alias("t"), F.expr("ntile(3) over (order by id)").alias("w"))
        assert df.filter("t <> w").count() == 0


def test_salted_join_keeps_every_row(spark):
    data = _skewed()
    big = spark.createDataFrame(data + data[:50], "id long, g string")
    small = big.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    want = sorted((r["id"], r["g"], r["lo"]) for r in big.join(small, "g").collect())
    assert rows(salted_join(big, small, ["g"], "n", rows_per_task=20), "id", "g", "lo") == want


def test_split_hot_partitions_rows(spark):
    big = spark.createDataFrame(_skewed(), "id long, g string")
    usual, hot = split_hot(big, ["g"], rows_per_task=200)
    assert {r[0] for r in hot.select("g").distinct().collect()} == {"hot"}
    assert usual.count() + hot.count() == 600 and usual.filter("g = 'hot'").isEmpty()


def test_bootstrap_partitions_each_set(spark):
    m = spark.createDataFrame([(s, i) for s in range(3) for i in range(40 + 60 * s)], "set_id long, obs_pt long")
    got = Counter((r["set_id"], r["in_bag"]) for r in sa.bootstrap(m, "b").collect())
    assert got == {(s, b): v for s in range(3) for b, v in ((1, int((40 + 60 * s) * 0.63)), (0, 40 + 60 * s - int((40 + 60 * s) * 0.63)))}


def test_split_keeps_locations_together(spark):
    df = spark.createDataFrame([(i, i % 10, i % 3) for i in range(300)], "id long, row int, col int")
    out = sa.split_locations(df, "s")
    assert out.groupBy("row", "col").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert out.filter("split = 'train'").select("row", "col").distinct().count() == 24


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(_skewed(), "id long, g string")
    one = rows(rk.hash_sample(df.coalesce(1), "s", ["id"], 30, ["g"]), "id")
    assert one == rows(rk.hash_sample(df.repartition(7), "s", ["id"], 30, ["g"]), "id") and len(one) == 120


def test_stratified_takes_all_of_a_small_bin(spark):
    df = spark.createDataFrame([(i, 0 if i < 5 else 10) for i in range(100)], "id long, v int")
    out = sa.stratified(df, "v", "id", [(-1, 0), (0, 10)], 40, "s", 0.5)
    assert Counter((r["bin"], r["split"]) for r in out.collect()) == {(0, "train"): 2, (0, "test"): 3, (1, "train"): 10, (1, "test"): 10}
