"""Random forests on the tree trainer: every tree is a set, so a forest grows in the same passes as one tree.

A row's weight in a tree is how often a bootstrap of the table's size would draw it, a Poisson number with mean 1 taken from the md5 of
(seed, tree, row key). So any program can repeat the bags, and a row is out of bag where its weight is 0.

Rows are dealt to blocks by their predictors, once, whatever the number of trees. Inside a block, rows with the same predictors are one cell: a tree gets
each cell once with the sums of its rows in the bag, and answers each cell once. Weights are computed where the rows are, for growing and again for the
out-of-bag votes, so no row travels for a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.operators.digests import by_length, md5
from rasterloom.operators.trees import PACKED, grow_packed, predict_packed, spread, unpacked
from rasterloom.session import materialize, share_package

#: P(Poisson(1) <= k): beyond the last one the chance is below that of the hash.
STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]
#: The same for the first 52 bits of a digest as a whole number.
LIMITS = [step * (1 << 52) for step in STEPS]
#: Rows of a block, and bytes of answers that all trees may give to one block or of a bag that goes on at once.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 64_000_000
#: Forests of a grid that grow at a time, as one of few trees leaves most of a cluster idle.
TOGETHER = 4


def _first_bits(seed: str, tree: int, keys: np.ndarray) -> np.ndarray:
    """The first 13 hexadecimal digits of md5(seed|tree|key), as numbers."""
    words = md5(f"{seed}|{tree}|".encode(), keys)
    return words[0].byteswap().astype(np.float64) * (1 << 20) + (words[1].byteswap() >> np.uint32(12))


def weights(seed: str, tree: int, keys: np.ndarray) -> np.ndarray:
    """How often each key (a column of bytes) is in the bag of a tree."""
    bits, out = _first_bits(seed, tree, keys), np.zeros(keys.shape[1], np.uint8)
    for limit in LIMITS:
        out += bits > limit
    return out


def _pack(features: list[str], out: pa.Schema):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.stack([rows.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features])
        good = np.flatnonzero(~np.isnan(x).any(axis=0))
        place, cells = np.full(rows.num_rows, -1, np.int32), x[:, :0]
        if len(good):
            order = good[np.lexsort(x[:, good])]
            held = x[:, order]
            new = np.append(True, (held[:, 1:] != held[:, :-1]).any(axis=0))
            place[order], cells = np.cumsum(new) - 1, held[:, new]
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks())
        packed = [np.ascontiguousarray(a).tobytes() for a in (cells, place, rows.column("_y").to_numpy(zero_copy_only=False).astype(np.float64))]
        columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([cells.shape[1]], pa.int64()), *[pa.array([b], pa.binary()) for b in packed], whole("_name"), whole("_key")]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return run


def pack(df: DataFrame, key: str, features: list[str], width: int, label: str | None = None) -> DataFrame:
    """Rows in blocks: (block, cells, x: their predictors by column, place: the cell of each row or -1 without all predictors, y, names, keys).

    ``width`` is how many numbers the trees answer to a row; rows without a key take no part. Blocks that equal predictors would overfill are dealt by key.
    """
    y = F.lit(None) if label is None else F.col(label)
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(key).cast("string").alias("_name"), y.cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    share_package(rows.sparkSession)
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    blocks = rows.count() // most + 1
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*features), F.lit(blocks)))
    full = rows.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts")).filter("_parts > 4")
    rows = rows.join(F.broadcast(full), "_block", "left")
    rows = rows.withColumn("block", F.col("_block") + F.coalesce(blocks * F.pmod(F.xxhash64("_name"), F.col("_parts")), F.lit(0))).drop("_block", "_parts")
    kind = rows.schema["_key"].dataType.simpleString()
    out = StructType.fromDDL(f"block bigint, cells bigint, x binary, place binary, y binary, names array<string>, keys array<{kind}>")
    return materialize(rows.groupBy("block").applyInArrow(_pack(features, to_arrow_schema(out)), out), "blocks")


def _bagged(features: list[str], classes: list | None, trees: int, seed: str, out: pa.Schema):
    def bags(block: pa.RecordBatch) -> Iterator[tuple]:
        place, y = (np.frombuffer(block.column(c)[0].as_buffer(), t) for c, t in (("place", np.int32), ("y", np.float64)))
        x, groups = np.stack(unpacked(block.column("x"), len(features))), by_length(block.column("names").flatten())
        bad, cell, w = place < 0, np.maximum(place, 0), np.empty(len(place))
        for tree in range(trees):
            for places, keys in groups:
                w[places] = weights(seed, tree, keys)
            lost = bool(w[bad].any())
            w[bad] = 0
            sums = [w] + ([np.where(w > 0, v, 0.0) for v in (w * y, w * y * y)] if classes is None else [w * (y == c) for c in classes])
            m = np.stack([np.bincount(cell, s, x.shape[1]) for s in sums]) if x.shape[1] else np.empty((len(sums), 0))
            seen = m[0] > 0
            if lost or seen.any():
                yield tree, int(seen.sum()), lost, int(m[0].sum()), x[:, seen].tobytes(), m[:, seen].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held, size = [], 0
                for bag in bags(batch.slice(i, 1)):
                    held.append(bag)
                    size += len(bag[4]) + len(bag[5])
                    if size > BLOCK_BYTES // 4:
                        yield _batch(held, out)
                        held, size = [], 0
                if held:
                    yield _batch(held, out)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def with_bags(blocks: DataFrame, features: list[str], classes: list | None, trees: int, seed: str = "forest") -> DataFrame:
    """The bag of each tree (``set_id`` 0 .. trees - 1) from packed rows with a label, in ``PACKED`` rows."""
    out = StructType.fromDDL(PACKED)
    return spread(blocks, blocks.count(), "block").mapInArrow(_bagged(features, classes, trees, seed, to_arrow_schema(out)), out)


def _bags_of(df: DataFrame, key: str, features: list[str], label: str, classes: list | None, trees: int, seed: str) -> DataFrame:
    known = df.filter(F.col(label).isNotNull())
    return materialize(with_bags(pack(known, key, features, 1, label), features, classes, trees, seed), "bag")


def fit(
    df: DataFrame, key: str, features: list[str], label: str, classes: list | None, trees: int = 50, max_features: int | None = None,
    max_depth: int | None = None, min_leaf: float = 1, seed: str = "forest",
) -> DataFrame:
    """Node table of a forest: a classifier with ``classes``, else a regressor; rows without a label are not used."""
    bag = _bags_of(df, key, features, label, classes, trees, seed)
    return materialize(grow_packed(bag, features, classes, max_depth, min_leaf, max_features, seed), "forest")


def _votes(key: str, width: int, models: int, seed: str, out_of_bag: bool, out: pa.Schema):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return out.empty_table()
        place = np.frombuffer(block.column("place")[0].as_buffer(), np.int32)
        rows = np.flatnonzero(place >= 0)
        place, names, keys = place[rows], *[block.column(c).combine_chunks().flatten().take(pa.array(rows)) for c in ("names", "keys")]
        by_tree: dict[int, list[np.ndarray]] = {}
        for tree, p in zip(answers.column("set_id").to_pylist(), answers.column("p")):
            by_tree.setdefault(tree, []).append(np.frombuffer(p.as_buffer(), np.float64).reshape(width, -1))
        answer = {t: math.prod(p) for t, p in sorted(by_tree.items()) if len(p) == models}
        sums, n = np.zeros((width, len(rows))), np.zeros(len(rows), np.int64)
        if out_of_bag:
            for places, bytes_ in by_length(names):
                cells, own, seen = place[places], np.zeros((width, len(places))), np.zeros(len(places), np.int64)
                for tree, p in answer.items():
                    outside = _first_bits(seed, tree, bytes_) <= LIMITS[0]
                    own += np.where(outside, p[:, cells], 0.0)
                    seen += outside
                sums[:, places], n[places] = own, seen
        elif answer:
            sums, n = sum(answer.values())[:, place], n + len(answer)
        return pa.Table.from_arrays([pa.array(keys).cast(out.types[0]), pa.array(n), *[pa.array(s) for s in sums]], schema=out)

    return run


def _vote(blocks: DataFrame, models: list[DataFrame], features: list[str], classes: list | None, trees: int, seed: str, out_of_bag: bool, key: str) -> DataFrame:
    """By key, the mean answer of the trees (``_p0`` and on) and their number ``n_trees``; answers of several models are multiplied tree by tree."""
    width = 1 if classes is None else len(classes)
    answers = None
    for nodes in models:
        own = predict_packed(blocks, nodes, features, classes, trees)
        answers = own if answers is None else answers.unionByName(own)
    n = blocks.count()
    kind = blocks.schema["keys"].dataType.elementType
    out = StructType([*StructType().add(key, kind).fields, *StructType.fromDDL(", ".join(["_n bigint", *[f"_s{i} double" for i in range(width)]])).fields])
    both = spread(blocks.filter("cells > 0").drop("x", "y"), n, "block").groupBy("block").cogroup(spread(answers, n, "block").groupBy("block"))
    votes = both.applyInArrow(_votes(key, width, len(models), seed, out_of_bag, to_arrow_schema(out)), out)
    means = [F.try_divide(F.sum(f"_s{i}"), F.sum("_n")).alias(f"_p{i}") for i in range(width)]
    return votes.groupBy(key).agg(*means, F.sum("_n").alias("n_trees"))


def _width(trees: int, classes: list | None) -> int:
    return trees * (1 if classes is None else len(classes))


def apply(
    nodes: DataFrame, rows: DataFrame, key: str, features: list[str], classes: list | None, trees: int, seed: str = "forest", out_of_bag: bool = False
) -> DataFrame:
    """Adds ``prediction`` and ``n_trees``: the class of the largest mean leaf share (first on ties), or the mean of the trees.

    ``out_of_bag`` asks only the trees that did not see a row; where there is none the prediction is NULL. ``key`` names rows apart.
    """
    return _apply(pack(rows, key, features, _width(trees, classes)), nodes, rows, key, features, classes, trees, seed, out_of_bag)


def _apply(blocks, nodes, rows, key, features, classes, trees, seed, out_of_bag=False) -> DataFrame:
    out = _vote(blocks, [nodes], features, classes, trees, seed, out_of_bag, key)
    if classes is None:
        out = out.select(key, F.col("_p0").alias("prediction"), "n_trees")
    else:
        best = F.array_max(F.array(*[F.struct(F.round(f"_p{i}", 12).alias("p"), F.lit(-i).alias("i"), F.lit(float(c)).alias("v")) for i, c in enumerate(classes)]))
        out = out.select(key, F.when(F.col("_p0").isNotNull(), best["v"]).alias("prediction"), "n_trees")
    return rows.join(out, key, "left").withColumn("n_trees", F.coalesce("n_trees", F.lit(0)))


def fit_zero_inflated(
    df: DataFrame, key: str, features: list[str], label: str, trees: int = 50, max_features: int | None = None, max_depth: int | None = None,
    min_leaf: float = 1, seed: str = "forest",
) -> tuple[DataFrame, DataFrame]:
    """A bag of zero-inflated trees: for each bag a classifier of label <> 0 and a regressor, on the same rows."""
    presence = df.withColumn(label, (F.col(label) != 0).cast("int"))
    options = dict(trees=trees, max_features=max_features, max_depth=max_depth, min_leaf=min_leaf, seed=seed)
    return fit(presence, key, features, label, [0, 1], **options), fit(df, key, features, label, None, **options)


def apply_zero_inflated(
    models: tuple[DataFrame, DataFrame], rows: DataFrame, key: str, features: list[str], trees: int, seed: str = "forest", out_of_bag: bool = False
) -> DataFrame:
    """Adds ``prediction``, the mean over the bags of class times value, and ``n_trees``."""
    blocks = pack(rows, key, features, 2 * trees)
    out = _vote(blocks, list(models), features, None, trees, seed, out_of_bag, key).withColumnRenamed("_p0", "prediction")
    return rows.join(out, key, "left").withColumn("n_trees", F.coalesce("n_trees", F.lit(0)))


def score(out: DataFrame, label: str, classes: list | None) -> DataFrame:
    """Out-of-bag score of predictions: n and accuracy, or n and R squared. Rows without a prediction take no part."""
    seen = out.filter(F.col("prediction").isNotNull() & F.col(label).isNotNull())
    y, p = F.col(label).cast("double"), F.col("prediction")
    if classes is not None:
        return seen.agg(F.count(F.lit(1)).alias("n"), F.avg((y == p).cast("double")).alias("oob_score"))
    rest: Column = F.sum((y - p) * (y - p))
    return seen.agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(rest, F.var_pop(y) * F.count(F.lit(1)))).alias("oob_score"))


def grid_search(
    df: DataFrame, key: str, features: list[str], label: str, classes: list, fold: str, max_features: list[int], min_leaf: list[int], trees: int = 1000,
    seed: str = "grid",
) -> DataFrame:
    """Mean and standard deviation of the accuracy over the folds, per parameter pair; ``rank`` 1 is best, ties go to the first pair.

    A forest per fold and pair, ``TOGETHER`` at a time; the bags and blocks of a fold are shared by its pairs. Only accuracies and the table of parameter
    pairs pass through the driver.
    """
    df = materialize(df, "folded")
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    pairs = [(m, leaf) for m in max_features for leaf in min_leaf]
    got: dict[tuple, list] = {pair: [] for pair in pairs}
    for k in folds:
        own = f"{seed}{k}"
        bag = _bags_of(df.filter(F.col(fold) != k), key, features, label, classes, trees, own)
        held_out = df.filter(F.col(fold) == k)
        blocks = pack(held_out, key, features, _width(trees, classes))

        def accuracy(pair: tuple) -> float:
            nodes = materialize(grow_packed(bag, features, classes, None, pair[1], pair[0], own), "forest")  # noqa: B023
            out = _apply(blocks, nodes, held_out, key, features, classes, trees, own)  # noqa: B023
            return score(out, label, classes).first()["oob_score"]

        with ThreadPoolExecutor(TOGETHER) as pool:
            for pair, found in zip(pairs, pool.map(accuracy, pairs)):
                got[pair].append(found)
    rows = []
    for pair in pairs:
        mean = sum(got[pair]) / len(got[pair])
        rows.append((*pair, mean, math.sqrt(sum((g - mean) ** 2 for g in got[pair]) / len(got[pair]))))
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], i))
    ranked = [(*rows[i], place + 1) for place, i in enumerate(order)]
    return df.sparkSession.createDataFrame(ranked, "max_features int, min_leaf int, mean_accuracy double, std_accuracy double, rank int")
