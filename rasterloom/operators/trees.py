"""Thousands of decision trees grown together on raw predictors, without a depth cap.

As published (PLANET, Panda et al. 2009) growth has two phases. Nodes of more than ``FINISH_ROWS`` rows are split level by level as DataFrame
aggregations: bins are quantiles of the node itself, so they get finer on the way down, one histogram goes over (set, node, feature, bin), and
prefix sums over at most ``BINS`` bins give the best split. A node that fits is handed to one task, which grows the whole subtree below
it exactly, on all values. Thresholds are real numbers halfway between the values on either side.

A node is named by its path: ``1`` is the root, and a left child appends 0, a right one 1. Ties go to the lowest feature, then to the lowest
threshold. With ``max_features`` each node looks at those features whose md5 of (seed, set, node, feature) is smallest, a draw that any other
program can repeat. Sets with a NULL or NaN predictor are left out, rows without a target are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rasterloom.operators.digests import md5
from rasterloom.session import materialize, share_package

SET = ["set_id"]
NODE = ["set_id", "node_id"]
#: Rows of a node that one task may finish, and bins of a larger one.
FINISH_ROWS, BINS = 200_000, 256
#: Rows of a set that one task predicts, and nodes of a tree that it may hold for that.
PREDICT_ROWS, PREDICT_NODES = 500_000, 2_000_000

NODES = (
    "set_id bigint, node_id string, feature int, threshold double, left string, right string, "
    "prediction double, n bigint, impurity double, gain double, shares array<double>"
)


#: A bag with many samples in a row: how many (with different predictors), whether one lacks a predictor, their weight, and by column the predictors
#: and the measures (weight, then those of ``_names``).
PACKED = "set_id bigint, cells bigint, bad boolean, weight bigint, x binary, m binary"


def _names(classes: list | None) -> list[str]:
    """Additive statistics besides the weight: weighted class counts, or sum and sum of squares."""
    return ["s", "q"] if classes is None else [f"c{i}" for i in range(len(classes))]


def _counted(classes: list | None) -> dict[str, Column]:
    """These statistics of one sample, as columns ``_<name>``."""
    if classes is None:
        return {"_s": F.col("w") * F.col("y"), "_q": F.col("w") * F.col("y") * F.col("y")}
    return {f"_c{i}": F.when(F.col("y") == c, F.col("w")).otherwise(0) for i, c in enumerate(classes)}


def _measures(classes: list | None) -> dict[str, Column]:
    """Weight and statistics of a group of samples."""
    return {"n": F.sum("w")} | {k: F.sum(f"_{k}") for k in _names(classes)}


def _score(get: Callable[[str], Column], classes: list | None) -> Column:
    """Sum of squared class counts (or squared sum) over the size: larger is purer, and it adds up over children."""
    n = get("n").cast("double")
    if classes is None:
        return F.try_divide(get("s") * get("s"), n)
    total = None
    for i in range(len(classes)):
        c = get(f"c{i}").cast("double")
        total = c * c if total is None else total + c * c
    return F.try_divide(total, n)


def _described(stats: DataFrame, classes: list | None) -> DataFrame:
    """Adds prediction, impurity and class shares from the measures."""
    n = F.col("n").cast("double")
    if classes is None:
        spread = F.greatest(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n), F.lit(0.0))
        return stats.select("*", (F.col("s") / n).alias("prediction"), spread.alias("impurity"), F.lit(None).cast("array<double>").alias("shares"))
    best = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("n"), F.lit(-i).alias("i"), F.lit(float(c)).alias("v")) for i, c in enumerate(classes)]))
    shares = F.array(*[F.col(f"c{i}") / n for i in range(len(classes))])
    return stats.select("*", best["v"].alias("prediction"), (1 - _score(F.col, classes) / n).alias("impurity"), shares.alias("shares"))


def drawn(seed: str, set_id: int, node_id: str, k: int, most: int | None) -> list[int]:
    """The features that a node looks at."""
    if most is None or most >= k:
        return list(range(k))
    return sorted(sorted(range(k), key=lambda f: hashlib.md5(f"{seed}|{set_id}|{node_id}|{f}".encode()).hexdigest())[:most])


def _level(rows: DataFrame, features: list[str], classes: list | None, seed: str, most: int | None) -> DataFrame:
    """Best split of each (large) node: feature, threshold, gain."""
    names = list(_measures(classes))
    marks = [i / BINS for i in range(1, BINS)]
    edges = rows.groupBy(*NODE).agg(F.array(*[F.array_distinct(F.percentile_approx(F.col(f), marks, 4 * BINS)) for f in features]).alias("_edges"))
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("v")) for i, f in enumerate(features)])
    if most is not None and most < len(features):
        hashed = lambda p: F.md5(F.concat_ws("|", F.lit(seed), F.col("set_id").cast("string"), F.col("node_id"), p["feature"].cast("string")))
        ranked = F.array_sort(F.transform(pairs, lambda p: F.struct(hashed(p).alias("h"), p["feature"].alias("feature"), p["v"].alias("v"))))
        pairs = F.transform(F.slice(ranked, 1, most), lambda p: F.struct(p["feature"].alias("feature"), p["v"].alias("v")))
    kept = [*NODE, "w", *[f"_{k}" for k in _names(classes)], "min_leaf"]
    long = rows.join(edges, NODE).select(*kept, "_edges", F.explode(pairs).alias("_p")).select(*kept, "_p.*", "_edges")
    cut = F.size(F.filter(F.element_at("_edges", F.col("feature") + 1), lambda e: e < F.col("v")))
    ends = {"low": F.min("v"), "high": F.max("v"), "min_leaf": F.max("min_leaf")}
    hist = long.withColumn("bin", cut).groupBy(*NODE, "feature", "bin").agg(*[c.alias(k) for k, c in (_measures(classes) | ends).items()])
    part = W.partitionBy(*NODE, "feature")  # at most BINS rows
    upto = part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumns({f"l_{m}": F.sum(m).over(upto) for m in names} | {f"t_{m}": F.sum(m).over(part) for m in names})
    middle = (F.col("high") + F.lead("low").over(part.orderBy("bin"))) / 2
    hist = hist.withColumn("threshold", middle)
    left = _score(lambda m: F.col(f"l_{m}"), classes)
    right = _score(lambda m: F.col(f"t_{m}") - F.col(f"l_{m}"), classes)
    whole = _score(lambda m: F.col(f"t_{m}"), classes)
    hist = hist.filter((F.col("l_n") >= F.col("min_leaf")) & (F.col("t_n") - F.col("l_n") >= F.col("min_leaf")) & F.col("threshold").isNotNull())
    hist = hist.select(*NODE, "feature", "threshold", (left + right).alias("score"), whole.alias("whole"))
    hist = hist.filter(F.col("score") - F.col("whole") > 1e-9 * F.greatest(F.abs("whole"), F.lit(1.0)))
    best = F.max(F.struct("score", (-F.col("feature")).alias("f"), (-F.col("threshold")).alias("t"), "whole"))
    return hist.groupBy(*NODE).agg(best.alias("_s")).select(
        *NODE, (-F.col("_s.f")).alias("feature"), (-F.col("_s.t")).alias("threshold"), (F.col("_s.score") - F.col("_s.whole")).alias("gain")
    )


def _sees(names: np.ndarray, k: int, set_id: int, seed: str, most: int) -> np.ndarray:
    """``drawn`` for the nodes of a level: which features each looks at."""
    words = [md5(f"{seed}|{set_id}|".encode(), names.T, f"|{f}".encode()).byteswap().astype(np.uint64) for f in range(k)]
    high, low = (np.stack([w[i] << np.uint64(32) | w[i + 1] for w in words], axis=1) for i in (0, 2))
    out = np.zeros((len(names), k), bool)
    np.put_along_axis(out, np.lexsort((low, high), axis=1)[:, :most], True, axis=1)
    return out


def _texts(names: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as strings."""
    n, width = names.shape
    ends = pa.py_buffer((np.arange(n + 1) * width).astype(np.int64))
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.LargeStringArray.from_buffers(n, ends, pa.py_buffer(np.ascontiguousarray(names)), mask).cast(pa.string())


_NODE_SCHEMA = pa.schema(
    [("set_id", pa.int64()), ("node_id", pa.string()), ("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.string()), ("right", pa.string()),
     ("prediction", pa.float64()), ("n", pa.int64()), ("impurity", pa.float64()), ("gain", pa.float64()), ("shares", pa.list_(pa.float64()))]
)


def subtree(
    x: list[np.ndarray], w: np.ndarray, m: list[np.ndarray], root: str, set_id: int, classes: list | None, leaf: float, depth: int | None, seed: str, most: int | None
) -> pa.Table:
    """Nodes of the exact tree below ``root``, from columns of predictors, weights and statistics.

    All nodes of a level are split in one pass over columns that are sorted once and then dealt to the children in order. Nodes of one row or of one class
    are leaves.
    """
    k = len(x)
    score = (lambda c, n: sum(v * v for v in c) / n) if classes is not None else (lambda c, n: c[0] * c[0] / n)
    names, node = np.frombuffer(root.encode(), np.uint8)[None, :], np.zeros(len(w), np.int64)
    rows = [np.argsort(v, kind="stable") for v in x]  # of the nodes still open: by node, then by value
    level, out = 0, []
    while True:
        count = len(names)
        at = node[rows[0]]
        size = np.bincount(at, w[rows[0]], count)
        total = [np.bincount(at, v[rows[0]], count) for v in m]
        whole = score(total, size)
        best, feature, threshold = np.full(count, -np.inf), np.full(count, -1), np.zeros(count)
        held = np.bincount(at, minlength=count)
        open_ = held > 1 if classes is None else (held > 1) & (np.max(total, axis=0) < size)
        if not open_.all():
            mask = open_[at]
            rows, at, held = [r[mask] for r in rows], at[mask], np.where(open_, held, 0)
        if (depth is None or level < depth) and len(at):
            sees = None
            if most is not None and most < k:
                sees = np.zeros((count, k), bool)
                sees[open_] = _sees(names[open_], k, set_id, seed, most)
            for f in range(k):
                here, own_at, own_held = rows[f], at, held
                if sees is not None:
                    mask = sees[at, f]
                    here, own_at, own_held = here[mask], at[mask], np.where(sees[:, f], held, 0)
                v = x[f][here]
                cut = np.flatnonzero((own_at[:-1] == own_at[1:]) & (v[:-1] < v[1:]))
                if not len(cut):
                    continue
                before = np.cumsum(own_held) - own_held  # rows of the nodes before each node
                own = own_at[cut]

                def left_of(values: np.ndarray) -> np.ndarray:
                    sums = np.cumsum(values[here])
                    return sums[cut] - np.where(before > 0, sums[before - 1], 0)[own]

                n_left = left_of(w)
                fits = (n_left >= leaf) & (size[own] - n_left >= leaf)
                if not fits.any():
                    continue
                c_left = [left_of(v)[fits] for v in m]
                cut, own, n_left = cut[fits], own[fits], n_left[fits]
                got = score(c_left, n_left) + score([t[own] - c for t, c in zip(total, c_left)], size[own] - n_left)
                start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                top = np.maximum.reduceat(got, start)
                # the first place of each node's best score, so the lowest threshold
                place = cut[start + _first_of(got == np.repeat(top, np.diff(np.append(start, len(cut)))), start)]
                own = own[start]
                better = (top > best[own]) & (top - whole[own] > 1e-9 * np.maximum(np.abs(whole[own]), 1))
                own, place = own[better], place[better]
                best[own], feature[own] = top[better], f
                middle = (v[place] + v[place + 1]) / 2
                threshold[own] = np.where(middle < v[place + 1], middle, v[place])
        inner = feature >= 0
        out.append(_level_table(names, inner, feature, threshold, size, total, whole, best, set_id, classes))
        if not inner.any():
            return pa.concat_tables(out)
        mask = inner[at]
        rows, at = [r[mask] for r in rows], at[mask]
        right = np.zeros(len(node), bool)
        for f in range(k):
            mine = feature[at] == f
            right[rows[0][mine]] = x[f][rows[0][mine]] > threshold[at[mine]]
        number = (np.cumsum(inner) - 1)[at]
        held = held[inner]
        before, place = np.cumsum(held) - held, np.arange(len(at))
        node[rows[0]] = 2 * number + right[rows[0]]
        for f in range(k):
            go = right[rows[f]]
            rights = np.cumsum(go)
            rights_before = np.where(before > 0, rights[before - 1], 0)
            lefts = held - (rights[before + held - 1] - rights_before)
            rights = rights - rights_before[number]
            dealt = np.empty_like(rows[f])
            dealt[np.where(go, (before + lefts - 1)[number] + rights, place - rights)] = rows[f]
            rows[f] = dealt
        names = np.repeat(names[inner], 2, axis=0)
        names = np.column_stack([names, np.tile(np.frombuffer(b"01", np.uint8), len(names) // 2)])
        level += 1


def _level_table(names, inner, feature, threshold, size, total, whole, best, set_id: int, classes: list | None) -> pa.Table:
    if classes is None:
        value, shares = total[0] / size, pa.nulls(len(names), pa.list_(pa.float64()))
        impurity = np.maximum(total[1] / size - value * value, 0.0)
    else:
        value, impurity = np.array(classes, np.float64)[np.argmax(total, axis=0)], 1 - whole / size
        ends = np.arange(len(names) + 1, dtype=np.int32) * len(classes)
        shares = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack([t / size for t in total], axis=1).ravel()))
    child = lambda side: _texts(np.column_stack([names, np.full(len(names), side, np.uint8)]), inner)
    columns = [
        pa.array(np.full(len(names), set_id), pa.int64()), _texts(names), pa.array(feature, pa.int32(), mask=~inner), pa.array(threshold, mask=~inner), child(ord("0")), child(ord("1")),
        pa.array(value), pa.array(size.astype(np.int64)), pa.array(impurity), pa.array(np.where(inner, best - whole, 0.0)), shares,
    ]
    return pa.Table.from_arrays(columns, schema=_NODE_SCHEMA)


def _first_of(hit: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Offset of the first hit in each run that begins at ``start``; every run has one."""
    at = np.flatnonzero(hit)
    return at[np.searchsorted(at, start)] - start


def _finish(features: list[str], classes: list | None, depth: int | None, seed: str, most: int | None):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        set_id, root = key[0].as_py(), key[1].as_py()
        x, (w, *m) = ([table.column(c).to_numpy().astype(np.float64) for c in cols] for cols in (features, ["w", *[f"_{k}" for k in _names(classes)]]))
        left = None if depth is None else depth - len(root) + 1
        return subtree(x, w, m, root, set_id, classes, float(table.column("min_leaf")[0].as_py()), left, seed, most)

    return run


def unpacked(column: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """The columns of numbers in packed rows, end to end."""
    parts = [np.frombuffer(v.as_buffer(), np.float64).reshape(width, -1) for v in column]
    return list(np.concatenate(parts, axis=1)) if parts else [np.empty(0)] * width


def _finish_packed(features: list[str], classes: list | None, depth: int | None, min_leaf: float, seed: str, most: int | None):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, (w, *m) = unpacked(table.column("x"), len(features)), unpacked(table.column("m"), 1 + len(_names(classes)))
        leaf = max(math.ceil(pc.sum(table.column("weight")).as_py() * float(min_leaf)), 1) if min_leaf < 1 else int(min_leaf)
        return subtree(x, w, m, "1", key[0].as_py(), classes, float(leaf), depth, seed, most)

    return run


def _unpack(features: list[str], classes: list | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = batch.slice(i, 1)
                x, (w, *m) = unpacked(part.column("x"), len(features)), unpacked(part.column("m"), 1 + len(_names(classes)))
                columns = [np.full(len(w), part.column("set_id")[0].as_py()), w, *m, *x]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def spread(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """Deals rows of much work and few bytes, which size rules would leave in few tasks, to about ``parts`` tasks or 64 to a task."""
    return df.repartition(max(1, min(parts, max(4 * df.sparkSession.sparkContext.defaultParallelism, parts // 64))), *by)


def grow(
    bag: DataFrame, features: list[str], classes: list | None, max_depth: int | None = None, min_leaf: float = 0.005, max_features: int | None = None,
    seed: str = "tree",
) -> DataFrame:
    """Node table (``NODES``) of one tree per set.

    ``bag`` holds (set_id, y, predictors) and may hold a whole weight ``w``, how often a row counts. ``classes`` lists the labels of a classifier, None
    grows regression trees. A row goes left if its value is at most the threshold. No leaf weighs less than ``min_leaf``: a share of its
    set's weight below 1, else a number.
    """
    share_package(bag.sparkSession)
    weight = F.col("w").cast("bigint") if "w" in bag.columns else F.lit(1).cast("bigint")
    values = [F.col(f).cast("double").alias(f) for f in features]
    rows = bag.filter("set_id IS NOT NULL AND y IS NOT NULL").select(F.col("set_id").cast("bigint").alias("set_id"), F.col("y").cast("double").alias("y"), weight.alias("w"), *values).filter("w > 0")
    rows = rows.select("set_id", "w", *[c.alias(k) for k, c in _counted(classes).items()], *features)
    return _grow(rows, features, classes, max_depth, min_leaf, max_features, seed)


def grow_packed(
    bag: DataFrame, features: list[str], classes: list | None, max_depth: int | None = None, min_leaf: float = 0.005, max_features: int | None = None,
    seed: str = "tree",
) -> DataFrame:
    """As ``grow`` for a bag of ``PACKED`` rows: a set of up to ``FINISH_ROWS`` samples goes to its task as it is, larger ones are unpacked."""
    spark = bag.sparkSession
    share_package(spark)
    sizes = bag.groupBy(*SET).agg(F.sum("cells").alias("cells"), F.max("bad").alias("bad")).collect()  # a row for each tree
    small, large = ([r["set_id"] for r in sizes if not r["bad"] and r["cells"] and (r["cells"] <= FINISH_ROWS) == fits] for fits in (True, False))
    bag = bag.filter("cells > 0")
    done = spread(bag.filter(F.col("set_id").isin(small)), len(small), *SET).groupBy(*SET)
    done = done.applyInArrow(_finish_packed(features, classes, max_depth, min_leaf, seed, max_features), NODES)
    if not large:
        return done
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = "double" if classes is None else "bigint"
    schema = bag.select("set_id", F.col("set_id").alias("w"), *[F.lit(0).cast(kind).alias(f"_{k}") for k in _names(classes)], *[F.lit(0.0).alias(f) for f in features]).schema
    rows = bag.filter(F.col("set_id").isin(large)).mapInArrow(_unpack(features, classes, to_arrow_schema(schema)), schema)
    return done.unionByName(_grow(rows, features, classes, max_depth, min_leaf, max_features, seed))


def _grow(rows: DataFrame, features: list[str], classes: list | None, max_depth: int | None, min_leaf: float, max_features: int | None, seed: str) -> DataFrame:
    bad = F.greatest(*[(F.col(f).isNull() | F.isnan(f)).cast("int") for f in features]) if len(features) > 1 else (F.col(features[0]).isNull() | F.isnan(features[0])).cast("int")
    least = F.greatest(F.ceil(F.sum("w") * F.lit(float(min_leaf))), F.lit(1)) if min_leaf < 1 else F.lit(int(min_leaf))
    rows = materialize(rows, "bag")
    sizes = rows.groupBy(*SET).agg(least.cast("bigint").alias("min_leaf"), F.max(bad).alias("_bad"), F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.filter("_bad = 0").drop("_bad")
    rows = rows.join(sizes, SET).withColumn("node_id", F.lit("1"))
    nodes = []
    depth = 0
    large = F.col("_rows") > FINISH_ROWS
    while (max_depth is None or depth < max_depth) and rows.filter(large).limit(1).count():
        rows = materialize(rows, "level")
        big = rows.filter(large)
        stats = big.groupBy(*NODE).agg(*[c.alias(k) for k, c in _measures(classes).items()])
        splits = materialize(_level(big, features, classes, seed, max_features), "splits")
        shown = _described(stats, classes).join(splits, NODE, "left")
        child = lambda side: F.when(F.col("feature").isNotNull(), F.concat("node_id", F.lit(side)))
        nodes.append(materialize(shown.select(
            *NODE, "feature", "threshold", child("0").alias("left"), child("1").alias("right"), "prediction", F.col("n").cast("bigint").alias("n"), "impurity",
            F.coalesce("gain", F.lit(0.0)).alias("gain"), "shares",
        ), "nodes"))
        value = F.element_at(F.array(*features), F.col("feature") + 1)
        side = F.when(value > F.col("threshold"), "1").otherwise("0")
        moved = big.join(splits.select(*NODE, "feature", "threshold"), NODE).withColumn("node_id", F.concat("node_id", side)).drop("feature", "threshold", "_rows")
        moved = materialize(moved, "moved")
        moved = moved.join(moved.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_rows")), NODE)
        rows = rows.filter(~large).unionByName(moved)
        depth += 1
    done = rows.groupBy(*NODE).applyInArrow(_finish(features, classes, max_depth, seed, max_features), NODES)
    for level in nodes:
        done = done.unionByName(level)
    return done


def importances(nodes: DataFrame, features: list[str]) -> DataFrame:
    """Share of each set's total gain owed to each feature, as ``importance_<feature>`` columns."""
    total = F.sum("gain")
    cols = [
        F.coalesce(F.try_divide(F.sum(F.when(F.col("feature") == i, F.col("gain"))), total), F.lit(0.0)).alias(f"importance_{f}")
        for i, f in enumerate(features)
    ]
    return nodes.groupBy(*SET).agg(*cols)


def walk(x: list[np.ndarray], names: pa.Array, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Place of each row's leaf in the node arrays, by pointer steps of all rows at once."""
    find = lambda n: pc.index_in(n, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
    children = np.stack([find(pc.binary_join_element_wise(names, side, "")) for side in "01"])
    at = np.full(len(x[0]), find(pa.array(["1"], names.type))[0])
    move = np.arange(len(at))
    while True:
        move = move[feature[at[move]] >= 0]
        if not len(move):
            return at
        here = at[move]
        looks, right = feature[here], np.zeros(len(move), bool)
        for f in range(len(x)):
            mine = np.flatnonzero(looks == f)
            right[mine] = x[f][move[mine]] > threshold[here[mine]]
        at[move] = children[right.astype(np.int8), here]


def _leaves(x: list[np.ndarray], nodes: pa.Table) -> np.ndarray:
    return walk(x, nodes.column("node_id").combine_chunks(), nodes.column("feature").fill_null(-1).to_numpy(), nodes.column("threshold").fill_null(0.0).to_numpy())


def _answer(features: list[str], kept: list[str], out):
    def run(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        rows = rows.drop(["_salt"])
        if not rows.num_rows or not nodes.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in out], schema=out)
        x = [rows.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features]
        leaf = _leaves(x, nodes)
        # a comparison with NaN is false, so a NULL predictor would go left unseen
        whole = pa.array(~np.isnan(x).any(axis=0))
        got = [nodes.column(c).take(pa.array(leaf)).combine_chunks() for c in ("prediction", "shares")]
        got = [pc.if_else(whole, g, pa.scalar(None, g.type)) for g in got]
        return pa.Table.from_arrays([*[rows.column(c) for c in kept], *got], schema=out)

    return run


def predict(rows: DataFrame, nodes: DataFrame, features: list[str], shares: bool = False) -> DataFrame:
    """Adds ``pred`` (and ``shares`` of the classes) to rows carrying ``set_id`` and raw predictors; rows of sets without a tree are left out.

    Rows of a set are dealt to tasks of about ``PREDICT_ROWS`` with a copy of its tree each. Trees beyond ``PREDICT_NODES`` are walked by joins, one
    step a round. A row with a NULL predictor has no prediction.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    share_package(rows.sparkSession)
    kept = [c for c in rows.columns if c not in ("pred", "shares")]
    nodes = materialize(nodes, "forest")
    most = nodes.groupBy(*SET).count().agg(F.max("count")).first()[0] or 0
    if most > PREDICT_NODES:
        out = _by_joins(rows.select(kept), nodes, features)
    else:
        counts = rows.groupBy(*SET).agg((F.floor(F.count(F.lit(1)) / PREDICT_ROWS) + 1).cast("int").alias("_salts"))
        salted = rows.select(kept).join(counts, SET)
        salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*kept), F.col("_salts")).cast("int")).drop("_salts")
        trees = nodes.select("set_id", "node_id", "feature", "threshold", "prediction", "shares").join(counts, SET)
        trees = trees.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
        schema = StructType([*rows.select(kept).schema.fields, *nodes.select(F.col("prediction").alias("pred"), "shares").schema.fields])
        both = salted.groupBy("set_id", "_salt").cogroup(trees.groupBy("set_id", "_salt"))
        out = both.applyInArrow(_answer(features, kept, to_arrow_schema(schema)), schema)
    return out if shares else out.drop("shares")


def _answer_packed(features: list[str], classes: list | None, out: pa.Schema):
    def run(key: tuple, blocks: pa.Table, nodes: pa.Table) -> pa.Table:
        if not blocks.num_rows or not nodes.num_rows:
            return out.empty_table()
        leaf = _leaves(unpacked(blocks.column("x"), len(features)), nodes)
        if classes is None:
            values = nodes.column("prediction").to_numpy()[None, leaf]
        else:
            values = nodes.column("shares").combine_chunks().flatten().to_numpy().reshape(-1, len(classes)).T[:, leaf]
        ends = np.cumsum(blocks.column("cells").to_numpy())[:-1]
        parts = [np.ascontiguousarray(v).tobytes() for v in np.split(values, ends, axis=1)]
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int64()), blocks.column("block"), pa.array(parts, pa.binary())], schema=out)

    return run


def _repack(classes: list | None, out: pa.Schema):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cell")
        if classes is None:
            values = rows.column("pred").to_numpy()
        else:
            values = rows.column("shares").combine_chunks().flatten().to_numpy().reshape(-1, len(classes)).T
        return pa.table([pa.array([k.as_py()], t) for k, t in zip(key, out.types)] + [pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())], schema=out)

    return run


def _cells_of(features: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = batch.slice(i, 1)
                x = unpacked(part.column("x"), len(features))
                n = len(x[0])
                columns = [*[pa.array([part.column(c)[0].as_py()] * n, pa.int64()) for c in ("set_id", "block")], pa.array(np.arange(n)), *[pa.array(v) for v in x]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def predict_packed(blocks: DataFrame, nodes: DataFrame, features: list[str], classes: list | None, trees: int) -> DataFrame:
    """What trees 0 .. ``trees`` - 1 answer to packed predictors (block, cells, x): (set_id, block, p), ``p`` the predictions or by class the shares.

    As in ``predict``, blocks are dealt to tasks of about ``PREDICT_ROWS`` with a copy of a tree each, and trees beyond ``PREDICT_NODES`` are walked by joins.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    share_package(blocks.sparkSession)
    out = StructType.fromDDL("set_id bigint, block bigint, p binary")
    nodes = nodes.select("set_id", "node_id", "feature", "threshold", "prediction", "shares")
    asked = blocks.filter("cells > 0").select("block", "cells", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trees - 1).cast("bigint"))).alias("set_id"))
    if (nodes.groupBy(*SET).count().agg(F.max("count")).first()[0] or 0) > PREDICT_NODES:
        schema = asked.select("set_id", "block", F.lit(0).cast("bigint").alias("cell"), *[F.lit(0.0).alias(f) for f in features]).schema
        rows = asked.mapInArrow(_cells_of(features, to_arrow_schema(schema)), schema)
        answers = predict(rows, nodes, features, shares=True).select("set_id", "block", "cell", "pred", "shares")
        return answers.groupBy("set_id", "block").applyInArrow(_repack(classes, to_arrow_schema(out)), out)
    salts = (blocks.agg(F.sum("cells")).first()[0] or 0) // PREDICT_ROWS + 1
    dealt = spread(asked.withColumn("_salt", F.col("block") % salts), trees * salts, "set_id", "_salt")
    if classes is None:
        nodes = nodes.drop("shares")  # a column of NULL lists goes to Python in square time
    copies = spread(nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))), trees * salts, "set_id", "_salt")
    both = dealt.groupBy("set_id", "_salt").cogroup(copies.groupBy("set_id", "_salt"))
    return both.applyInArrow(_answer_packed(features, classes, to_arrow_schema(out)), out)


def _by_joins(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Pointer steps as joins: rows at inner nodes move to a child, rows at leaves are done."""
    nodes = nodes.select("set_id", "node_id", "feature", "threshold", F.col("prediction").alias("pred"), "shares")
    open_ = rows.withColumn("node_id", F.lit("1"))
    done, value = None, F.element_at(F.array(*[F.col(f).cast("double") for f in features]), F.col("feature") + 1)
    whole = ~F.greatest(*[F.col(f).isNull() for f in features], F.lit(False))
    while True:
        at = materialize(open_.join(nodes, NODE), "step")
        here = at.filter("feature IS NULL").select(*rows.columns, F.when(whole, F.col("pred")).alias("pred"), F.when(whole, F.col("shares")).alias("shares"))
        done = here if done is None else done.unionByName(here)
        inner = at.filter("feature IS NOT NULL")
        if not inner.limit(1).count():
            return done
        side = F.when(value > F.col("threshold"), "1").otherwise("0")
        open_ = inner.withColumn("node_id", F.concat("node_id", side)).select(*rows.columns, "node_id")


def zero_inflated(bag: DataFrame, features: list[str], max_depth: int | None = None, min_leaf: float = 0.005, max_features: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Classifier of y <> 0 and regressor of y; their predictions are multiplied."""
    presence = bag.withColumn("y", (F.col("y") != 0).cast("int"))
    return grow(presence, features, [0, 1], max_depth, min_leaf, max_features), grow(bag, features, None, max_depth, min_leaf, max_features)


def predict_zero_inflated(rows: DataFrame, models: tuple[DataFrame, DataFrame], features: list[str]) -> DataFrame:
    some = predict(rows, models[0], features).withColumnRenamed("pred", "_some")
    return predict(some, models[1], features).withColumn("pred", F.col("_some") * F.col("pred")).drop("_some")


MODELS: dict[str, Callable] = {
    "classifier": lambda bag, features, classes, depth=None: grow(bag, features, classes, depth),
    "regressor": lambda bag, features, classes, depth=None: grow(bag, features, None, depth),
    "zero_inflated": lambda bag, features, classes, depth=None: zero_inflated(bag, features, depth),
}


def trainer(model_type: str) -> Callable:
    if model_type not in MODELS:
        raise ValueError(f"unknown model type {model_type!r}; available: {', '.join(sorted(MODELS))}")
    return MODELS[model_type]

