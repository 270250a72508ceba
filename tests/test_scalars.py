import math

import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom.functions import grid as g, names as nm, spectral as sp
from rasterloom.functions.registry import row_stat, stat

TX = g.Affine(0.0, 30.0, 0.0, -30.0)


def test_offsets_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-29.0, 29.0), (31.0, -31.0)], "x double, y double")
    assert rows(df.select(g.col_of(F.col("x"), TX), g.row_of(F.col("y"), TX))) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("coord,anchor,res", [(-7.5, 0, 30), (22.0, 7, 30), (22.0, 7, -30), (-100.0, 15, -30), (60.0, 0, 30)])
def test_snap_uses_divisor_sign(spark, coord, anchor, res):
    got = spark.range(1).select(g.snap(F.lit(coord), anchor, res)).first()[0]
    assert got == pytest.approx(coord + (anchor % res - coord % res))


def test_clamp_negative_handles_null_and_nan(spark):
    df = spark.createDataFrame([(2.0,), (-2.0,), (None,), (math.nan,)], "v double")
    assert sorted(r[0] for r in df.select(g.clamp_negative(F.col("v"))).collect()) == [0.0, 0.0, 0.0, 2.0]


def test_recode_is_sequential(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 9)], "v int")
    got = [r[0] for r in df.orderBy("v").select(g.recode(F.col("v"), {1: 2, 2: 3, 3: 1})).collect()]
    assert got == [1, 1, 1, 9]


def test_recode_reports_bad_text():
    with pytest.raises(ValueError, match="key:value"):
        g.parse_recode("1:2;3:4")
    with pytest.raises(ValueError, match="mode"):
        g.reclassify(F.lit(1), "nope")


@pytest.mark.parametrize("text,want", [("4529", "045029"), ("04529", "045029"), ("45029", "045029"), ("045029", "045029"), (" 4529 ", "045029")])
def test_pathrow6(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(nm.pathrow6(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("text", ["452", "45129"])
def test_pathrow6_rejects(spark, text):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(text,)], "s string").select(nm.pathrow6(F.col("s"))).collect()


def test_expand_pathrows_order(spark):
    df = spark.createDataFrame([(1, "45-46/28-29"), (2, "45/28")], "id int, spec string")
    got = rows(nm.expand_pathrows(df, "spec", ["id"]), "id", "pos", "scene")
    assert got == [(1, 0, "045028"), (1, 1, "046028"), (1, 2, "045029"), (1, 3, "046029"), (2, 0, "045028")]


def test_label_rules_match_exactly(spark):
    df = spark.createDataFrame([("n", None), ("g", "y"), ("g", "y "), ("u", None), ("u ", None), ("tw", "m")], "class string, discard string")
    assert rows(nm.keep_labels(df), "class", "binary") == [("g", 1), ("n", 0), ("tw", 1), ("u ", 0)]


@pytest.mark.parametrize(
    "epoch,start,idx,want",
    [(3, 1986, 5, 2001), (4, 1986, 0, 1987), (4, 1986, 5, 5), (5, 1986, 3, 2003), (1, 2000, 19, 2019), (2, 2000, 9, 2019), (4, 2000, 4, 2019), (6, 2000, 1, 1)],
)
def test_epoch_year(spark, epoch, start, idx, want):
    df = spark.createDataFrame([(idx, epoch, start)], "i int, e int, s int")
    assert df.select(nm.epoch_year(F.col("i"), F.col("e"), F.col("s"))).first()[0] == want


def test_drop_predicate(spark):
    df = spark.createDataFrame([(v,) for v in (9, 10, 11)], "oob_rate int")

    def kept(text, **kw):
        return sorted(r[0] for r in df.filter(nm.drop_predicate(text, ["oob_rate"], **kw)).collect())

    assert kept("oob_rate >= 10") == [10, 11]
    assert kept("oob_rate >= 10", compat=True) == [11]
    assert kept("oob_rate <= 10") == [9, 10]
    for bad in ("oob_rate 10", "oob_rate < > 10", "other < 10", "oob_rate < ten"):
        assert nm.drop_predicate(bad, ["oob_rate"]) is None


def test_unknown_names_list_the_known_ones():
    with pytest.raises(ValueError, match="median"):
        stat("nope")
    with pytest.raises(ValueError, match="mid_pix"):
        row_stat("nope", F.array(F.lit(1)))
    with pytest.raises(ValueError, match="NBR"):
        sp.spectral_index("EVI")


def test_normalized_difference_of_zero_sum_is_null(spark):
    df = spark.createDataFrame([(1, -1), (3, 1)], "b4 int, b7 int")
    assert sorted(str(r[0]) for r in df.select(sp.spectral_index("NBR")).collect()) == ["500.0", "None"]


def test_area_golden(spark):
    # Pixel counts and areas published with the reference results.
    df = spark.createDataFrame([(37993850,)], "n long")
    assert df.select(g.area_km2(F.col("n"))).first()[0] == pytest.approx(34194.465)
