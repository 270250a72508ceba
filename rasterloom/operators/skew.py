"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.session import materialize

ROWS_PER_TASK = 1_000_000
MAX_HOT_KEYS = 1000


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], count_col: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Inner join of many rows per key with one row per key.

    ``small[count_col]`` is the number of ``big`` rows of each key. A key with more rows than both
    ``rows_per_task`` and one part in ``MAX_HOT_KEYS`` of the total is hot: its big-side rows spread over
    several salts and its small-side row is repeated once per salt. By that threshold there are at
    most ``MAX_HOT_KEYS`` hot keys, so sending their salt counts to every task is bounded by construction.

    ``small`` is read three times, so it is written once first; finding hot keys is then a pushed filter.
    """
    small = materialize(small, "per-key")
    total = small.agg(F.sum(count_col)).scalar()
    floor = F.greatest(F.lit(rows_per_task), F.ceil(total / F.lit(MAX_HOT_KEYS)))
    hot = small.filter(F.col(count_col) > floor).select(*keys, _salts(count_col, rows_per_task))
    hot = F.broadcast(hot)
    return _meet(big.join(hot, keys, "left"), small.join(hot, keys, "left"), keys)


def salted(big: DataFrame, small: DataFrame, keys: list[str], count_col: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``salted_join`` where every key is already known to be hot (see ``split_hot``), so the key list is bounded."""
    salts = F.broadcast(small.select(*keys, _salts(count_col, rows_per_task)))
    return _meet(big.join(salts, keys), small.withColumn("_salts", _salts(count_col, rows_per_task)), keys)


def _salts(count_col: str, rows_per_task: int) -> Column:
    return F.ceil(F.col(count_col) / F.lit(rows_per_task)).cast("int").alias("_salts")


def _meet(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    # Row content and input partition decide the salt: stable when a lost task runs again, and copies of
    # one row still spread.
    content = [F.col(c) for c in big.columns if c != "_salts"]
    draw = F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.col("_salts"))
    spread = big.withColumn("_salt", F.coalesce(draw, F.lit(0)).cast("int")).drop("_salts")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def split_hot(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys), by the same threshold as ``salted_join``.

    Ordinary groups then fit a task and may be handled as a whole; hot ones must be aggregated with map-side combine.
    Only the hot keys, at most ``MAX_HOT_KEYS`` of them, travel to every task. Without any, the second frame is
    empty at run time and its branch is dropped.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    floor = F.greatest(F.lit(rows_per_task), F.ceil(total / F.lit(MAX_HOT_KEYS)))
    hot = F.broadcast(counts.filter(F.col("_n") > floor).select(*keys))
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")
