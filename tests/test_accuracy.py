"""Published matrix and scores, and edge rules of the measures."""

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import accuracy as ac

MATRIX = [(0, 0, 188), (0, 1, 23), (1, 0, 12), (1, 1, 209)]


@pytest.fixture
def counts(spark):
    return spark.createDataFrame(MATRIX, "truth int, pred int, n long")


def test_report_golden(counts):
    got = {r["stat"]: r for r in ac.classification_report(counts).collect()}
    assert got["0"]["precision"] == pytest.approx(0.94) and got["1"]["precision"] == pytest.approx(0.9008620689655172)
    assert got["0"]["recall"] == pytest.approx(0.8909952606635071) and got["1"]["recall"] == pytest.approx(0.9457013574660633)
    assert got["0"]["f1_score"] == pytest.approx(0.9148418491484186) and got["1"]["f1_score"] == pytest.approx(0.9227373068432672)
    assert (got["0"]["support"], got["1"]["support"]) == (211, 221)
    assert got["accuracy"]["precision"] == pytest.approx(0.9189814814814815)
    assert got["macro avg"]["f1_score"] == pytest.approx(0.91879, abs=1e-5)
    assert got["weighted avg"]["f1_score"] == pytest.approx(0.91888, abs=1e-5)


def test_kappa_golden(counts):
    assert ac.kappa_report(counts).first()["kappa"] == pytest.approx(0.8376846444520784)


def test_confusion_matrix_fills_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "truth int, pred int")
    assert sorted(tuple(r) for r in ac.confusion_matrix(df, [0, 1]).collect()) == [(0, 2, 0), (1, 1, 0)]


def test_unpredicted_class_scores_zero(spark):
    c = spark.createDataFrame([(0, 0, 3), (1, 0, 2)], "truth int, pred int, n long")
    one = ac.classification_report(c).filter("stat = '1'").first()
    assert (one["precision"], one["recall"], one["f1_score"], one["support"]) == (0.0, 0.0, 0.0, 2)


def test_bins_are_open_below(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 10, 11, 31)], "v int").orderBy("v")
    bins = ac.parse_bins("0:10,10:30")
    assert [r[0] for r in df.select(ac.in_bin(F.col("v"), bins)).collect()] == [None, 0, 0, 1, None]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 5), (0, 5), (1, 9), (0, 1)], "t int, s int")
    assert ac.roc_auc(df, "t", "s").first()[0] == pytest.approx(0.875)


def test_agreement_of_identical_and_constant(spark):
    same = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "x double, y double")
    assert ac.agreement(same, "x", "y").first()["ac"] == pytest.approx(1.0)
    flat = spark.createDataFrame([(float(i), 2.0) for i in range(5)], "x double, y double")
    assert ac.agreement(flat, "x", "y").first()["ac_u"] is None


def test_rmse_split_compat_is_absolute(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0), (0, 1.0), (0, 0.0)], "t int, p double")
    got = df.agg(*[c.alias(k) for k, c in ac.rmse_split(F.col("t"), F.col("p"), compat=True).items()]).first()
    assert tuple(got) == (0.5, 1.0, 0.333)
