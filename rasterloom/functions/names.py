"""Identifiers, file names, label codes and table-shape helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Interpreter class code -> binary target.
LABEL_BINARY = {"s": 0, "w": 0, "n": 0, "g": 1, "d": 1, "ha": 1, "tw": 1, "sh": 1}

# First year of a composite series, by epoch length, from 1999 on.
EPOCH_FIRST_YEAR = {1: 2000, 2: 2001, 3: 2001, 4: 2003}
# Number of composites per series, by epoch length, before and from 1999.
EPOCH_COUNT_EARLY = {3: 6, 4: 5, 5: 4, 6: 3}
EPOCH_COUNT_LATE = {1: 20, 2: 10, 3: 7, 4: 5}


def pathrow6(text: Column) -> Column:
    """Six-digit scene id from ``PPRR``, ``0PPRR`` or ``PP0RR``; longer ids pass, others fail the query."""
    s = F.trim(text)
    n = F.length(s)
    return (
        F.when(n < 4, F.raise_error(F.concat(F.lit("scene id needs at least 4 digits: "), s)).cast("string"))
        .when(n == 4, F.concat(F.lit("0"), F.substring(s, 1, 2), F.lit("0"), F.substring(s, 3, 2)))
        .when((n == 5) & s.startswith("0"), F.concat(F.substring(s, 1, 3), F.lit("0"), F.substring(s, 4, 2)))
        .when((n == 5) & (F.substring(s, 3, 1) == "0"), F.concat(F.lit("0"), s))
        .when(n == 5, F.raise_error(F.concat(F.lit("scene id is not of form PPRR: "), s)).cast("string"))
        .otherwise(s)
    )


def pathrow4(text: Column) -> Column:
    six = pathrow6(text)
    return F.concat(F.substring(six, 2, 2), F.substring(six, 5, 2))


def expand_pathrows(df: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """``45-47/28-30`` to one row per scene id; ``pos`` counts rows outer, paths inner."""

    def span(part: Column) -> Column:
        ends = F.split(part, "-")
        return F.when(
            F.size(ends) > 1,
            F.transform(
                F.sequence(ends[0].cast("int"), F.get(ends, F.lit(1)).cast("int")), lambda v: v.cast("string")
            ),
        ).otherwise(F.array(part))

    halves = F.split(F.col(spec), "/")
    return (
        df.withColumns({"_p": span(halves[0]), "_r": span(halves[1])})
        .select(*keep, "_p", F.posexplode("_r").alias("_ri", "_row"))
        .select(*keep, "_ri", "_row", F.size("_p").alias("_np"), F.posexplode("_p").alias("_pi", "_path"))
        .select(
            *keep,
            (F.col("_ri") * F.col("_np") + F.col("_pi")).alias("pos"),
            pathrow6(F.concat("_path", "_row")).alias("scene"),
        )
    )


def parse_output_name(name: Column) -> dict[str, Column]:
    p = F.split(name, "-")
    return {
        "key": p[0],
        "value": p[1],
        "index_id": F.lower(p[2]),
        "n_vert": p[3].cast("int"),
        "start_year": F.substring(p[4], 1, 4).cast("int"),
        "end_year": F.substring(p[4], 5, 4).cast("int"),
        "date_range": p[5],
    }


def year_from_name(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d{4})", 1)


def region_from_name(name: Column) -> Column:
    """Text before the year found in the name."""
    return F.regexp_extract(name, r"^(.*?)\d{4}", 1)


def binary_label(cls: Column) -> Column:
    """Class code to 0/1; codes outside the list become 0, as missing values do."""
    out = F.lit(0)
    for code, v in LABEL_BINARY.items():
        out = F.when(cls == code, v).otherwise(out)
    return out


def keep_labels(df: DataFrame, remove_field: str = "discard", remove_value: str = "y") -> DataFrame:
    """Drop discarded and undecided points; matching is exact, so blanks around a code keep the row."""
    drop = F.col(remove_field).eqNullSafe(F.lit(remove_value)) | F.col("class").eqNullSafe(F.lit("u"))
    return df.filter(~drop).withColumn("binary", binary_label(F.col("class")))


def normalize_text(s: Column) -> Column:
    return F.lower(F.trim(s))


def certainty_from_name(name: Column, null_value: str = "combined") -> Column:
    """First of one, two, three contained in the name."""
    out = F.when(name.contains("one"), "one")
    return out.when(name.contains("two"), "two").when(name.contains("three"), "three").otherwise(F.lit(null_value))


def epoch_year(idx: Column, epoch: Column, start_year: Column) -> Column:
    """Calendar year of a composite; index values outside the series stay as they are."""
    early = F.when(F.lit(False), idx)
    for e, n in EPOCH_COUNT_EARLY.items():
        early = early.when((epoch == e) & idx.between(0, n - 1), 1983 + epoch + epoch * idx)
    late = F.when(F.lit(False), idx)
    for e, n in EPOCH_COUNT_LATE.items():
        late = late.when((epoch == e) & idx.between(0, n - 1), F.lit(EPOCH_FIRST_YEAR[e]) + epoch * idx)
    return F.when(start_year < 1999, F.coalesce(early, idx)).otherwise(F.coalesce(late, idx))


def training_columns(df: DataFrame, year: int) -> DataFrame:
    """Columns naming the year, plus the class; rows with gaps removed."""
    drop = ("system:index", ".geo")
    cols = [c for c in df.columns if (str(year) in c or "class" in c) and c not in drop]
    return df.select(*[F.col(f"`{c}`") for c in cols]).dropna()


def melt_years(df: DataFrame, ids: list[str], value: str = "area") -> DataFrame:
    """Integer-named columns to (year, value) rows."""
    years = [c for c in df.columns if re.fullmatch(r"\d+", c)]
    long = df.unpivot(ids, [F.col(f"`{y}`") for y in years], "year", value)
    return long.withColumn("year", F.col("year").cast("int"))


_OPS = {
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
}


def drop_predicate(expr: str, metrics: list[str], compat: bool = False) -> Column | None:
    """``<metric> <op> <integer>`` as a column; anything else is ignored (None).

    ``compat`` reads ``>=`` as ``>``.
    """
    found = re.findall(r"<=|>=|<|>", expr)
    if len(found) != 1:
        return None
    metric, _, value = (p.strip() for p in expr.partition(found[0]))
    if metric not in metrics or not re.fullmatch(r"-?\d+", value):
        return None
    op = ">" if compat and found[0] == ">=" else found[0]
    return _OPS[op](F.col(metric), F.lit(int(value)))


def glob_to_regex(pattern: str) -> str:
    """Shell wildcard as an anchored regular expression."""
    out = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return f"^{out}$"
