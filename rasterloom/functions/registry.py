"""Statistics by name: each entry builds a Catalyst aggregate (or, for wide rows, an array expression)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def exact_stdv(v: Column) -> Column:
    """Population standard deviation; whole numbers use exact sums, so that ties round the same everywhere.

    Fractions, and groups whose sums pass a long, take the floating form.
    """
    x = v.try_cast("long")
    n, s, q = F.count(x), F.try_sum(x), F.try_sum(F.try_multiply(x, x))
    spread = F.try_subtract(F.try_multiply(n, q), F.try_multiply(s, s)).cast("double")
    whole = F.bool_and(x.isNotNull() & (v == x) | v.isNull()) & (F.count_if(x.isNotNull() & F.try_multiply(x, x).isNull()) == 0)
    return F.coalesce(F.when(whole, F.try_divide(F.sqrt(spread), n.cast("double"))), F.stddev_pop(v))


def _nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


STATS: dict[str, Callable[[Column], Column]] = {
    # NaN in the input makes these NaN, as NumPy's plain forms do; NULLs are skipped.
    "sum": F.sum,
    "mean": F.avg,
    "count": lambda v: F.count(F.lit(1)),
    # NaN-skipping forms.
    "nansum": lambda v: F.coalesce(F.sum(_nan_to_null(v)), F.lit(0.0)),
    "nanmean": lambda v: F.avg(_nan_to_null(v)),
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "stdv": exact_stdv,
    # Smallest value on ties; the buffer holds one counter per distinct class.
    "mode": lambda v: F.mode(v, True),
    "pct_nonzero": lambda v: F.coalesce(
        F.try_divide(100.0 * F.count_if(~F.isnan(v) & (v != 0)), F.count_if(~F.isnan(v))), F.lit(0.0)
    ),
    "lc_proportion": lambda v: F.try_divide(100.0 * F.count_if(v == 1), F.count(F.lit(1))),
}


def stat(name: str) -> Callable[[Column], Column]:
    """Aggregate builder by name; an unknown name fails listing the known ones."""
    key = name.strip().lower()
    if key not in STATS:
        raise ValueError(f"unknown statistic {name!r}; available: {', '.join(sorted(STATS))}")
    return STATS[key]


def pct_equal(v: Column, value) -> Column:
    """Share of values equal to ``value``; -1 for an empty group."""
    return F.coalesce(F.try_divide(100.0 * F.count_if(v == value), F.count(F.lit(1))), F.lit(-1.0))


def all_equal(v: Column, centre: Column) -> Column:
    """1 where every non-NaN value equals the group's centre value."""
    return F.coalesce(F.bool_and(F.when(~F.isnan(v), v == centre)), F.lit(True)).cast("int")


def row_stat(name: str, values: Column, option=None) -> Column:
    """One statistic over the columns of a row, given as an array."""
    key = name.strip().lower()
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    ordered = F.array_sort(values)
    table: dict[str, Callable[[], Column]] = {
        "mean": lambda: total / n,
        "max": lambda: F.array_max(values),
        "min": lambda: F.array_min(values),
        "median": lambda: (
            F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))
        ) / 2,
        "mode": lambda: -F.array_max(
            F.transform(values, lambda x: F.struct(F.size(F.filter(values, lambda y: y == x)).alias("n"), (-x).alias("v")))
        )["v"],
        "num_pix_with_data": lambda: F.size(F.filter(values, lambda x: x != option)),
        "num_pix_equal": lambda: F.size(F.filter(values, lambda x: x == option)),
        "num_pix_between": lambda: F.size(F.filter(values, lambda x: (x >= option[0]) & (x < option[1]))),
        "stdev": lambda: F.sqrt(
            (n * F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) - total * total).cast("double")
        ) / n,
        "mid_pix": lambda: F.element_at(values, (F.floor(n / 2) + 1).cast("int")),
    }
    if key not in table:
        raise ValueError(f"unknown statistic {name!r}; available: {', '.join(sorted(table))}")
    return table[key]()
