"""Exact ranks, samples and running sums that never sort a whole group in one task.

A group is cut into ordered buckets, bucket totals are accumulated over the (few) buckets, and rows
are only ordered inside their bucket. Rank = rows in earlier buckets + position in the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


ROWS_PER_BUCKET = 1_000_000


#: Quantiles asked for at most, and the values a bucket's search reads at each of its two levels.
MOST_BUCKETS, FAN = 4096, 64


def quantile_bucket(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """Bucket of a numeric ``key`` that never decreases along it, near ``rows_per_bucket`` rows each whatever the spacing of the values.

    Bounds are approximate quantiles of the whole column from one aggregation, at most ``MOST_BUCKETS`` of them; only equal values can crowd a
    bucket. NULL goes to bucket 0.
    """
    marks = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    # a percentile sketch keeps doubles: the cast does not change the order of values, so bounds stay usable for long keys
    size, found = df.agg(F.count(key), F.percentile_approx(F.col(key).cast("double"), marks, 4 * MOST_BUCKETS)).first()
    parts = min(MOST_BUCKETS, -(-size // rows_per_bucket))
    if parts < 2:
        return F.lit(0)
    bounds = sorted({found[i * MOST_BUCKETS // parts - 1] for i in range(1, parts)})
    value, every = F.col(key).cast("double"), F.lit(bounds).cast("array<double>")
    below = lambda within: F.size(F.filter(within, lambda b: b < value))
    group = below(F.lit(bounds[FAN - 1 :: FAN]).cast("array<double>")) if len(bounds) >= FAN else F.lit(0)
    return F.when(F.col(key).isNull(), 0).otherwise(group * FAN + below(F.slice(every, group * FAN + 1, FAN)))


def hash_key(seed: str, *key: Column | str) -> Column:
    """md5 of ``seed|key|...``: the reproducible random order every sampler uses."""
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))


def ordered_rank(
    df: DataFrame, bucket: Column, order: list[Column], by: list[str] = (), rank: str = "rk", total: str | None = None
) -> DataFrame:
    """1-based rank inside ``by`` in the given total order; ``bucket`` must not decrease along it."""
    by = list(by)
    tagged = df.withColumn("_b", bucket)
    counts = tagged.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(*by).orderBy("_b")
    offsets = counts.select(
        *by,
        "_b",
        F.coalesce(F.sum("_n").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias("_total"),
    )
    inside = W.partitionBy(*by, "_b").orderBy(*order)
    out = tagged.join(offsets, [*by, "_b"]).withColumn(rank, F.col("_before") + F.row_number().over(inside))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_b", "_before", "_total")


def hash_rank(
    df: DataFrame, seed: str, key: list[str], by: list[str] = (), rank: str = "rk", total: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rank in hash order.

    Buckets are leading hex digits of the hash, even whatever the keys. Their number follows the table's size, so that
    a bucket stays near ``rows_per_bucket`` rows even if a single group holds the whole table.
    """
    h = F.col("_h")
    size = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(size / F.lit(rows_per_bucket), F.lit(1.0))))).cast("int")
    tagged = df.withColumn("_h", hash_key(seed, *key))
    ranked = ordered_rank(tagged, F.substring(h, F.lit(1), digits), [h, *[F.col(k) for k in key]], by, rank, total)
    return ranked.drop("_h")


def id_rank(
    df: DataFrame, key: str, by: list[str] = (), rank: str = "rk", total: str | None = None, width: int | None = None
) -> DataFrame:
    """Rank by an integer id that is unique in its group.

    Buckets are bounded by quantiles, so sparse and clustered ids spread evenly. With ``width`` a bucket spans that many ids instead, which saves
    the pass for the quantiles where groups are known to be small.
    """
    bucket = quantile_bucket(df, key) if width is None else F.floor(F.col(key) / F.lit(width))
    return ordered_rank(df, bucket, [F.col(key)], by, rank, total)


def hash_first(df: DataFrame, seed: str, key: list[str], n: int | Column | DataFrame, by: list[str] = (), rank: str = "_rk", total: str = "_size") -> DataFrame:
    """The first ``n`` rows per group in hash order, with their rank and their group's row count.

    ``n`` may use ``_size``, or be a table of ``by`` and ``_most``; a group that it lacks gives no rows.

    Group sizes are known after one map-side count, and hashes are even, so a row can only be among the first ``n`` if its hash is below a
    threshold near n / size. Rows above it are not shuffled. Should a group fall short of its ``n`` below the threshold, which a margin of eight
    standard deviations leaves to repeated keys, all rows are ranked instead.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    if isinstance(n, DataFrame):
        sizes, most = sizes.join(n, by), F.col("_most")
    else:
        most = n if isinstance(n, Column) else F.lit(n)
    want = F.least(F.greatest(most.cast("double"), F.lit(0.0)), F.col("_size"))
    sizes = sizes.select(*by, "_size", want.alias("_want"), F.try_divide(want + 8 * F.sqrt(want) + 32, F.col("_size")).alias("_below"))
    if by:
        met = df.join(sizes, by)
    else:
        met = df.withColumns({c: F.lit(v) for c, v in sizes.first().asDict().items()})
    lead = F.conv(F.substring(hash_key(seed, *key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    near = met.filter(lead < F.col("_below"))
    have = near.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.first("_want").alias("_want"))
    if by:
        have = sizes.select(*by, "_want").join(have.select(*by, "_n"), by, "left")
    if have.filter(F.coalesce("_n", F.lit(0)) < F.col("_want")).limit(1).count():
        near = met
    ranked = hash_rank(near, seed, key, by, rank).filter(F.col(rank) <= F.col("_want")).drop("_want", "_below")
    return ranked.withColumnRenamed("_size", total)


def hash_sample(df: DataFrame, seed: str, key: list[str], n: int | Column, by: list[str] = ()) -> DataFrame:
    """The first ``n`` rows per group in hash order; ``n`` may use ``_size``, the group's row count."""
    return hash_first(df, seed, key, n, by).select(df.columns)


def running_sums(df: DataFrame, order: Column, bucket: Column, values: list[str], by: list[str] = ()) -> DataFrame:
    """Adds ``cum_<v>``: the sum of ``v`` over rows up to and including this one."""
    by = list(by)
    tagged = df.withColumns({"_b": bucket, "_o": order})
    sums = tagged.groupBy(*by, "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_b", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    upto = W.partitionBy(*by, "_b").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    out = tagged.join(offsets, [*by, "_b"]).withColumns(
        {f"cum_{v}": F.col(f"_o_{v}") + F.sum(v).over(upto) for v in values}
    )
    return out.drop("_b", "_o", *[f"_o_{v}" for v in values])


def ntile_of(rank: Column, total: Column, k: int) -> Column:
    """Which of ``k`` near-equal consecutive parts a 1-based rank falls in; earlier parts are larger."""
    base, extra = F.floor(total / k), total % k
    head = extra * (base + 1)
    return (
        F.when(rank <= head, F.ceil(rank / (base + 1)))
        .otherwise(extra + F.ceil(F.try_divide(rank - head, base)))
        .cast("int")
    )
