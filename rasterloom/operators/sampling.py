"""Reproducible sampling, splitting and folds, all in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators.accuracy import in_bin
from rasterloom.operators.ranking import hash_first, hash_rank, hash_sample, id_rank, ntile_of


def stratified(df: DataFrame, value: str, key: str, bins: list[tuple[int, int]], n: int, seed: str, pct_train: float | None = None) -> DataFrame:
    """``n / len(bins)`` rows per ``(lo, hi]`` bin (all of them where there are fewer), cut into train and test."""
    per = n // len(bins)
    binned = df.withColumn("bin", in_bin(F.col(value), bins)).filter(F.col("bin").isNotNull())
    ranked = hash_first(binned, seed, [key], per, ["bin"])
    cut = F.floor(F.least(F.col("_size"), F.lit(per)) * F.lit(1.0 if pct_train is None else pct_train))
    return ranked.withColumn("split", F.when(F.col("_rk") <= cut, "train").otherwise("test")).drop("_rk", "_size")


def proportional(df: DataFrame, tile: str, stratum: str, key: str, n: int, lo: float, hi: float, seed: str) -> DataFrame:
    """Per tile, strata sampled by their share of the tile, each share kept within [lo, hi]."""
    counts = df.groupBy(tile, stratum).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(tile).agg(F.sum("_n").alias("_t"))
    share = F.least(F.greatest(F.col("_n") / F.col("_t"), F.lit(lo)), F.lit(hi))
    want = counts.join(totals, tile).select(tile, stratum, F.floor(share * n).alias("_most"))
    return hash_first(df, seed, [key], want, [tile, stratum]).select(df.columns)


def from_zones(
    df: DataFrame, zone: str, key: str, n: int, false_val: int, pct_sample: float, pct_zone: float, seed: str, inflation: float | None = None
) -> DataFrame:
    """Half negatives, half positives; positives of the train and test split come from different zones."""
    per = n // 2
    zones = df.filter(F.col(zone) != false_val).select(zone).distinct()
    zones = hash_rank(zones, f"{seed}z", [zone], rank="_rk", total="_t").withColumn(
        "split", F.when(F.col("_rk") <= F.floor(F.col("_t") * F.lit(pct_zone)), "train").otherwise("test")
    )
    n_false = int(per * inflation) if inflation else per
    neg = hash_first(df.filter(F.col(zone) == false_val), f"{seed}n", [key], n_false, total="_t")
    cut = F.floor(F.least(F.col("_t"), F.lit(n_false)) * F.lit(pct_sample))
    neg = neg.withColumn("split", F.when(F.col("_rk") <= cut, "train").otherwise("test"))
    pos = df.join(zones.select(zone, "split"), zone)
    limit = F.when(F.col("split") == "train", int(per * pct_sample)).otherwise(int(per * (1 - pct_sample)))
    pos = hash_sample(pos, f"{seed}p", [key], limit, ["split"])
    cols = [*df.columns, "split"]
    return neg.select(cols).withColumn("value", F.lit(false_val)).unionByName(pos.select(cols).withColumn("value", F.lit(1)))


def top_random(df: DataFrame, key: list[str], n: int, seed: str) -> DataFrame:
    """``n`` rows in random order: a top-k, never a full sort."""
    from rasterloom.operators.ranking import hash_key

    return df.withColumn("_h", hash_key(seed, *key)).orderBy("_h", *key).limit(n).drop("_h")


def random_points(df: DataFrame, key: list[str], n: int, seed: str) -> DataFrame:
    """``n`` rows in hash order with a 1-based id."""
    return hash_first(df, seed, key, n, rank="id", total="_n").drop("_n")


def bootstrap(members: DataFrame, seed: str, share: float = 0.63) -> DataFrame:
    """Bag ``int(share * n)`` samples of every set without replacement; the rest are out of bag."""
    ranked = hash_rank(members, seed, ["set_id", "obs_pt"], ["set_id"], "_rk", "_n")
    bag = (F.col("_rk") <= F.floor(F.col("_n") * F.lit(share))).cast("int")
    return ranked.withColumn("in_bag", bag).drop("_rk", "_n")


def split_locations(df: DataFrame, seed: str, pct: float = 0.8) -> DataFrame:
    """Whole locations go to train or test together."""
    at = hash_rank(df.select("row", "col").distinct(), seed, ["row", "col"], rank="_rk", total="_n")
    split = F.when(F.col("_rk") <= F.floor(F.col("_n") * F.lit(pct)), "train").otherwise("test")
    return df.join(at.select("row", "col", split.alias("split")), ["row", "col"])


def holdout(df: DataFrame, key: str, seed: str, test: float = 0.2) -> DataFrame:
    """Test rows are the ceiling of the test share, the rest train."""
    ranked = hash_rank(df, seed, [key], rank="_rk", total="_n")
    split = F.when(F.col("_rk") <= F.ceil(F.col("_n") * F.lit(test)), "test").otherwise("train")
    return ranked.withColumn("split", split).drop("_rk", "_n")


def folds(df: DataFrame, key: str, k: int = 3, by: list[str] = ()) -> DataFrame:
    """Contiguous folds by id, or class-balanced ones when ``by`` names the class."""
    ranked = id_rank(df, key, by, "_rk", "_n")
    return ranked.withColumn("fold", ntile_of(F.col("_rk"), F.col("_n"), k)).drop("_rk", "_n")


def quota(n: Column, share: float) -> Column:
    return F.floor(n * F.lit(share))
