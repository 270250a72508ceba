"""Connected regions of equal value."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from rasterloom.session import materialize

WIDTH = 1 << 31

# Send this module's helpers to the workers by value, so that no package needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _block_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest cell id reachable inside one block, by sweeping minima until nothing changes."""
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    r0, c0 = r.min(), c.min()
    shape = (r.max() - r0 + 1, c.max() - c0 + 1)
    value = np.full(shape, np.nan)
    label = np.full(shape, np.iinfo(np.int64).max)
    value[r - r0, c - c0] = pdf["v"]
    label[r - r0, c - c0] = pdf["cell"]
    same_down, same_right = value[1:] == value[:-1], value[:, 1:] == value[:, :-1]
    while True:
        before = label.copy()
        for a, b, same in ((label[1:], label[:-1], same_down), (label[:, 1:], label[:, :-1], same_right)):
            # Both sides view the same array, so the second minimum must see the first one's result.
            a[same] = np.minimum(a, b)[same]
            b[same] = np.minimum(a, b)[same]
        if np.array_equal(before, label):
            break
    return pd.DataFrame({"row": r, "col": c, "v": pdf["v"], "label": label[r - r0, c - c0]})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node of the component, for undirected edges (u, v).

    Every round hooks each node to its smallest neighbour, shortens the chains by pointer jumping, and contracts the
    edges. Minima combine map-side, contracted edges are made distinct, so a node of huge degree is no bottleneck
    in the grouping; finished nodes leave the joins.
    """
    both = edges.filter("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "labels")
    while not both.isEmpty():
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        hook = materialize(hook, "hook")
        while True:
            up = hook.filter("u <> p").select(F.col("u").alias("p"), F.col("p").alias("q"))
            nxt = materialize(hook.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hook")
            hook = nxt.select("u", "p")
            if nxt.filter("moved").isEmpty():
                break
        moved = hook.filter("u <> p")
        to = moved.select(F.col("u").alias("root"), F.col("p").alias("_p"))
        labels = materialize(labels.join(to, "root", "left").select("node", F.coalesce("_p", "root").alias("root")), "labels")
        for end in ("u", "v"):
            both = both.join(moved.select(F.col("u").alias(end), F.col("p").alias("_p")), end, "left").withColumn(end, F.coalesce("_p", end)).drop("_p")
        both = materialize(both.filter("u <> v").distinct(), "edges")
    return labels


def regions(cells: DataFrame, value: str, block: int = 64) -> DataFrame:
    """Adds ``region`` (the smallest row-major cell id of the 4-connected region) to each cell.

    Blocks of bounded size are labelled on their own first; only contacts across block borders enter the
    distributed rounds.
    """
    b = F.lit(block)
    base = cells.select("row", "col", F.col(value).cast("double").alias("v"), (F.col("row").cast("long") * WIDTH + F.col("col")).alias("cell"))
    keyed = base.withColumns({"_br": F.floor(F.col("row") / b), "_bc": F.floor(F.col("col") / b)})
    local = keyed.groupBy("_br", "_bc").applyInPandas(
        lambda pdf: _block_labels(pdf), "row int, col int, v double, label long"
    )
    local = materialize(local, "blocks")
    contacts = None
    for axis, other in (("row", "col"), ("col", "row")):
        low = local.filter(F.col(axis) % b == b - 1).select(F.col(other).alias("o"), (F.col(axis) + 1).alias("a"), "v", F.col("label").alias("u"))
        high = local.filter(F.col(axis) % b == 0).select(F.col(other).alias("o"), F.col(axis).alias("a"), "v", F.col("label").alias("w"))
        part = low.join(high, ["o", "a", "v"]).select("u", F.col("w").alias("v")).distinct()
        contacts = part if contacts is None else contacts.unionByName(part)
    roots = connected_components(contacts).select(F.col("node").alias("label"), F.col("root"))
    return local.join(roots, "label", "left").select("row", "col", F.col("v").alias(value), F.coalesce("root", "label").alias("region"))


def region_table(labelled: DataFrame, value: str) -> DataFrame:
    """One row per region: value, cell count and bounding box."""
    return labelled.groupBy("region", value).agg(
        F.count(F.lit(1)).alias("cells"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1")
    )
