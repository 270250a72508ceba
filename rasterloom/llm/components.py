"""Connected components of a link table, by smallest label with pointer jumping; each round is written, nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from rasterloom.session import materialize

#: Links per task, about: a small table is not spread over all partitions of a shuffle, round by round.
ROWS_PER_TASK = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): the smallest id that each linked id reaches. Ids without a link are not listed.

    A round takes the smallest label among neighbours and then the label of that label, so the number of rounds grows with
    the logarithm of a chain's length. A hub's links are spread by Spark's skew join: each join feeds no window or sort.
    """
    tasks = math.ceil((2 * links.count() + 1) / ROWS_PER_TASK)
    both = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct().coalesce(tasks), "links")
    label = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("label")).coalesce(tasks), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id"), "label", F.lit(None).cast("bigint").alias("old"))
        own = label.withColumn("old", F.col("label").cast("bigint"))
        least = near.union(own).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = label.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = materialize(least.join(up, "label").select("id", F.least("label", "next").alias("label"), "old").coalesce(tasks), "labels")
        label = jumped.drop("old")
        if not jumped.filter(F.col("label") != F.col("old")).limit(1).count():
            return label
