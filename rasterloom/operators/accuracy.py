"""Confusion matrices, reports, agreement and ranking measures.

Everything starts from counts per (truth, prediction) pair: rows are collapsed with map-side combine
once and every measure is arithmetic on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators.ranking import running_sums, quantile_bucket
from rasterloom.session import materialize


def pair_counts(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels: list, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row per truth label, one ``pred_<label>`` column per predicted label."""
    wide = pair_counts(df, truth, pred).groupBy("truth").pivot("pred", labels).agg(F.sum("n")).na.fill(0)
    return wide.withColumnsRenamed({str(v): f"pred_{v}" for v in labels})


def per_class(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """true positives, predicted and actual totals for every label seen on either side."""
    n = F.col("n")
    hit = F.when(F.col("truth") == F.col("pred"), n).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), hit.alias("tp"), n.alias("actual"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), n.alias("predicted")),
    )
    long = counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    return long.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])


def _scored(classes: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0))
    return classes.withColumns({"precision": p, "recall": r}).withColumn(
        "f1_score", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )


def classification_report(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages; 0/0 counts as 0."""
    by = list(by)
    scored = _scored(per_class(counts, by))
    cols = ("precision", "recall", "f1_score")
    means = scored.groupBy(*by).agg(
        F.sum("actual").alias("support"),
        F.try_divide(F.sum("tp"), F.sum("actual")).alias("accuracy"),
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.try_divide(F.sum(F.col(c) * F.col("actual")), F.sum("actual")).alias(f"w_{c}") for c in cols],
    )

    def line(name: str, values: list[str]) -> Column:
        return F.struct(F.lit(name).alias("stat"), *[F.col(v).alias(c) for v, c in zip(values, cols)], F.col("support").alias("support"))

    summary = F.array(
        line("accuracy", ["accuracy"] * 3), line("macro avg", [f"m_{c}" for c in cols]), line("weighted avg", [f"w_{c}" for c in cols])
    )
    tail = means.select(*by, F.explode(summary).alias("s"), F.col("accuracy").alias("model_accuracy")).select(*by, "s.*", "model_accuracy")
    head = scored.select(*by, F.col("label").cast("string").alias("stat"), *cols, F.col("actual").alias("support"))
    if by:
        head = head.join(means.select(*by, F.col("accuracy").alias("model_accuracy")), by)
    else:
        head = head.withColumn("model_accuracy", means.select("accuracy").scalar())
    return head.unionByName(tail)


def kappa_report(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Users and producers accuracy per label with the overall accuracy and kappa on every row."""
    by = list(by)
    c = per_class(counts, by)
    total = c.groupBy(*by).agg(
        F.sum("actual").alias("n"),
        F.sum("tp").alias("_tp"),
        F.sum((F.col("actual") * F.col("predicted")).cast("double")).alias("_e"),
    )
    po, pe = F.try_divide("_tp", "n"), F.try_divide(F.col("_e"), F.col("n").cast("double") * F.col("n").cast("double"))
    total = total.select(*by, po.alias("overall"), F.try_divide(po - pe, 1 - pe).alias("kappa"))
    c = c.withColumns({"users": F.try_divide("tp", "predicted"), "producers": F.try_divide("tp", "actual")})
    if by:
        return c.join(total, by)
    stats = total.select(F.struct("overall", "kappa")).scalar()
    return c.withColumn("_t", stats).select("*", "_t.overall", "_t.kappa").drop("_t")


def in_bin(v: Column, bins: list[tuple[int, int]]) -> Column:
    """Index of the ``(lo, hi]`` bin, NULL outside all of them."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bins))):
        out = F.when((v > lo) & (v <= hi), i).otherwise(out)
    return out


def parse_bins(text: str) -> list[tuple[int, int]]:
    return [(int(a), int(b)) for a, b in (p.split(":") for p in text.split(","))]


def threshold_sweep(df: DataFrame, truth: str, prob100: str, lo: int = 50, hi: int = 95, step: int = 5) -> DataFrame:
    """Report per threshold, ``pred = prob >= t``; thresholds multiply the collapsed counts, not the rows."""
    cells = df.groupBy(F.col(truth).alias("truth"), F.col(prob100).alias("prob")).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("threshold", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))))
    hit = F.when(F.col("prob") >= F.col("threshold"), 1).otherwise(0)
    counts = cells.groupBy("threshold", "truth", hit.alias("pred")).agg(F.sum("_n").alias("n"))
    return classification_report(counts, ["threshold"])


def agreement(df: DataFrame, x: str, y: str) -> DataFrame:
    """Agreement coefficient with its systematic and unsystematic parts.

    Two aggregation passes: means, deviations and correlation sign first, product differences second. All NULL
    where the correlation is zero or a variable is constant.
    """
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    base = df.select(xd.alias("x"), yd.alias("y"))
    first = base.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cv"))
    m = base.withColumn("_m", first.select(F.struct("*")).scalar())
    dif = F.abs(F.col("_m.mx") - F.col("_m.my"))
    slope = F.signum("_m.cv") * F.sqrt(F.try_divide(F.col("_m.vy"), F.col("_m.vx")))
    b = F.when(slope != 0, slope)
    a = F.col("_m.my") - b * F.col("_m.mx")
    gy, gx = a + b * F.col("x"), (F.col("y") - a) / b
    out = m.agg(
        F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("ssd"),
        F.sum((dif + F.abs(F.col("x") - F.col("_m.mx"))) * (dif + F.abs(F.col("y") - F.col("_m.my")))).alias("spod"),
        F.sum(F.abs(F.col("x") - gx) * F.abs(F.col("y") - gy)).alias("spd_u"),
    )
    share = {"ac": F.col("ssd"), "ac_s": F.col("ssd") - F.col("spd_u"), "ac_u": F.col("spd_u")}
    return out.select(*[(1 - F.try_divide(v, F.col("spod"))).alias(k) for k, v in share.items()], "ssd", "spod")


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.avg((x - y) * (x - y)))


def rmspe(x: Column, y: Column) -> Column:
    """Root mean square percentage error; a truth of 0 has no percentage and is left out."""
    e = F.try_divide(100 * (x - y), x)
    return F.sqrt(F.avg(e * e))


def rmse_split(truth: Column, pred: Column, compat: bool = False) -> dict[str, Column]:
    """Error overall, where truth is 1, and elsewhere, to three decimals; ``compat`` gives the mean absolute error."""
    e = F.abs(truth - pred) if compat else (truth - pred) * (truth - pred)

    def score(c: Column) -> Column:
        m = F.avg(c)
        return F.round(m if compat else F.sqrt(m), 3)

    return {"rmse": score(e), "rmse_true": score(F.when(truth == 1, e)), "rmse_false": score(F.when(truth != 1, e))}


def _score_counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, written once: totals and running sums both read them."""
    pos = F.count_if(F.col(truth) == 1)
    counts = df.groupBy(F.col(score).alias("score")).agg(pos.alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    return materialize(counts, "scores")


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the curve to three decimals (Mann-Whitney with ties at half weight)."""
    counts = _score_counts(df, truth, score)
    c = running_sums(counts, F.col("score"), quantile_bucket(counts, "score"), ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum((F.col("pos") * (2 * below + F.col("neg"))).cast("decimal(38,0)"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return c.agg(F.round(F.try_divide(wins.cast("double") / 2, pairs), 3).alias("auc"))


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One point per distinct score: share of negatives and positives scoring at least that much."""
    counts = _score_counts(df, truth, score)
    c = running_sums(counts, -F.col("score"), -quantile_bucket(counts, "score"), ["pos", "neg"])
    all_of = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    c = c.withColumn("_a", all_of)
    return c.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("_a.n")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("_a.p")).alias("tpr"),
    )


def oob_regression(df: DataFrame, by: list[str], truth: Column, pred: Column) -> DataFrame:
    """R-squared in percent and RMSE per set, both rounded to integers, from one pass of sums."""
    n, st, stt = F.count(F.lit(1)), F.sum(truth), F.sum(truth * truth)
    sse = F.sum((truth - pred) * (truth - pred))
    sst = stt - st * st / n
    return df.groupBy(*by).agg(
        F.bround(100 * (1 - F.try_divide(sse, sst))).cast("int").alias("oob_rate"),
        F.bround(F.sqrt(sse / n)).cast("int").alias("oob_rmse"),
    )
