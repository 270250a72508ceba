"""Per-pixel statistics over ensemble members and support sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.functions.registry import exact_stdv

PIXEL = ["row", "col"]


def simple_stats(preds: DataFrame, value: str = "pred") -> dict[str, Column]:
    """Aggregates of the prediction path, rounded half-even to integers."""
    v = F.col(value)
    return {
        "mean": F.bround(F.avg(v)).cast("int"),
        "median": F.bround(F.median(v)).cast("int"),
        "stdv": F.bround(exact_stdv(v)).cast("int"),
        "count": F.count(F.lit(1)),
    }


def class_counts(preds: DataFrame, value: str = "pred") -> DataFrame:
    """Members per pixel and value (NULL for members without data), at most one row per value."""
    return preds.groupBy(*PIXEL, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _is_int(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("tinyint", "smallint", "int")


def _top_class(small: bool) -> tuple[Column, Column]:
    """Most frequent class (smallest on ties, also below zero) and its count.

    For int classes (``small``) this is one maximum over a packed long: a maximum of structs would force a sort-based
    aggregation. Counts per pixel and class stay below 2^31. Wider or fractional classes take the struct.
    """
    if not small:
        top = F.max(F.when(F.col("v").isNotNull(), F.struct(F.col("n").alias("n"), (-F.col("v")).alias("v"))))
        return -top["v"], top["n"]
    low = F.lit((1 << 31) - 1).cast("long")
    packed = F.max(F.when(F.col("v").isNotNull(), F.shiftleft(F.col("n"), 32) + (low - F.col("v"))))
    return (low - packed.bitwiseAND((1 << 32) - 1)).cast("int"), F.shiftright(packed, 32)


def votes(preds: DataFrame, value: str = "pred") -> DataFrame:
    """Winning class (smallest on ties), its share in percent and the number of votes per pixel."""
    counts = class_counts(preds, value)
    vote, n = _top_class(_is_int(counts, "v"))
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    out = counts.groupBy(*PIXEL).agg(vote.alias("vote"), F.bround(100 * n / total).cast("int").alias("pct_vote"), total.alias("count"))
    return out.filter("vote IS NOT NULL")


#: Statistics of predictions that a caller may name.
AGG_STATS = ("mean", "vote", "median", "stdv", "pct_vote", "importance", "oob", "count")


def aggregate(preds: DataFrame, names: list[str], value: str = "pred", oob: str = "oob_rate", importances: list[str] = ()) -> DataFrame:
    """The named statistics (``AGG_STATS``) per pixel over the predictions of the sets that cover it.

    ``oob`` is the mean score of these sets, ``importance`` the number of the predictor that is most important on their average (first on ties).
    Members without a prediction do not count; a pixel without any is left out.
    """
    unknown = [n for n in names if n not in AGG_STATS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}; available: {', '.join(AGG_STATS)}")
    seen = preds.filter(F.col(value).isNotNull())
    build = simple_stats(seen, value)
    if "oob" in names:
        build["oob"] = F.bround(F.avg(oob)).cast("int")
    if "importance" in names:
        build["importance"] = argmax_index([F.avg(c) for c in importances])
    plain = [build[n].alias(n) for n in names if n in build]
    out = seen.groupBy(*PIXEL).agg(*plain) if plain else None
    if {"vote", "pct_vote"} & set(names):
        voted = votes(seen, value).select(*PIXEL, *[n for n in ("vote", "pct_vote") if n in names])
        out = voted if out is None else out.join(voted, PIXEL)
    return out.select(*PIXEL, *names)


def _moments(v: Column, n: Column, whole: bool) -> tuple[Column, Column]:
    """Mean and population deviation of values counted ``n`` times.

    Sums of whole numbers are exact longs whose products are taken as decimals; groups whose sums pass a long take doubles.
    """
    real, count = v.cast("double"), F.sum(n)
    s, q = F.sum(n * real), F.sum(n * real * real)
    gap, total = count * q - s * s, s
    if whole:
        s, q = F.try_sum(F.try_multiply(n, v)), F.try_sum(F.try_multiply(n, F.try_multiply(v, v)))
        wide = lambda c: c.cast("decimal(19,0)")
        # a sum that passed a long is NULL, and so is one that skipped an overflowing product
        safe = F.count_if(v.isNotNull() & F.try_multiply(n, F.try_multiply(v, v)).isNull()) == 0
        gap = F.coalesce(F.when(safe, F.try_subtract(wide(count) * wide(q), wide(s) * wide(s)).cast("double")), gap)
        total = F.coalesce(F.when(safe, s.cast("double")), total)
    count = count.cast("double")
    return F.try_divide(total, count), F.try_divide(F.sqrt(F.greatest(gap, F.lit(0.0))), count)


def aggregate_stored(preds: DataFrame, value: str, nodata: int = -9999) -> DataFrame:
    """Statistics of stored predictions: NULL-aware, truncated to integers at the end, nodata where no member has data.

    All of them follow from the counts per value, so one small intermediate table serves every statistic.
    """
    counts = class_counts(preds, value)
    small = _is_int(counts, "v")
    v, n = F.col("v").cast("long" if small else "double"), F.when(F.col("v").isNotNull(), F.col("n"))
    count = F.sum(n)
    mean, stdv = _moments(v, n, small)
    stats = {
        "mean": mean,
        "stdv": stdv,
        "count": count,
        "vote": _top_class(small)[0],
    }
    out = counts.groupBy(*PIXEL).agg(*[c.alias(k) for k, c in stats.items()])
    return out.select(*PIXEL, *[F.coalesce(F.col(k).cast("int"), F.lit(nodata)).alias(k) for k in stats])


def argmax_index(cols: list[str | Column]) -> Column:
    """0-based position of the largest value, first on ties."""
    a = F.array(*[F.col(c) if isinstance(c, str) else c for c in cols])
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def importance_summary(sets: DataFrame, cols: list[str]) -> DataFrame:
    """Mean importance per predictor over the sets and its share of the total."""
    means = sets.select(F.posexplode(F.array(*cols)).alias("var", "imp")).groupBy("var").agg(F.avg("imp").alias("mean_imp"))
    return means.withColumn("share", F.col("mean_imp") / means.agg(F.sum("mean_imp")).scalar())


def gaussian_mean(preds: DataFrame, value: str, centre: str, c: float = 5.0, a: float = 1.0) -> DataFrame:
    """Gaussian-weighted mean around a per-pixel centre, rounded half-even."""
    x, b = F.col(value), F.col(centre)
    weight = F.pow(F.lit(a * 2.718281828459045), -((x - b) * (x - b)) / F.lit(2 * c * c))
    mean = F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))
    return preds.groupBy(*PIXEL).agg(F.bround(mean).cast("int").alias("weighted"))


def class_feature(nodes: DataFrame, n: str = "n") -> DataFrame:
    """Per class, the feature whose split nodes hold most of its samples (lowest feature on ties)."""
    sums = nodes.groupBy("cls", "feature").agg(F.sum(n).alias("_s"))
    best = F.max(F.struct(F.col("_s").alias("s"), (-F.col("feature")).alias("f")))
    return sums.groupBy("cls").agg((-best["f"]).alias("feature"))
