"""Nearest neighbours by cosine: learned rotated binary codes in several indexes of substrings, probed by the pigeonhole rule.

A code is the signs of a vector under ``ROTATIONS`` orthogonal maps. Each map is learned on a bounded sample: signs are taken, then the
rotation that brings the vectors closest to their signs, in turns. The code is cut into substrings of about ``SUB_BITS`` bits, and an index
lists the vectors by the value of one substring. If two codes differ in at most r bits, then with m substrings at least one of the
first r mod m + 1 differs in at most r div m bits, or one of the others in at most r div m - 1. So probing every index for the values
within these distances meets every code within r; the full codes are compared next, and what is within r is ranked by the cosine of the
original vectors in double precision.

The radius is measured: for at most ``ASKED`` queries the true neighbours in the whole table are found by comparison with all rows, and the
radius is the quantile ``SAFE`` of the bits in which these differ from their query, so that about that share of true neighbours is found.
A query with fewer than k rows within it is asked again without a radius.

Vectors are dealt to shards and queries to blocks, both by hash and of bounded size; each (shard, block) builds the indexes of its vectors
and answers its queries with k rows each. So no group of like vectors gathers in a task, and no table is broadcast. The shuffle holds the
vectors once per block and the queries once per shard.

Defined cases: a vector that is null, zero, or has a null or non-finite component takes no part, nor does one whose length is not the
commonest (of several, the longest). Equal rows are one. Rows of the query's own id are no candidates. A repeated id with different
vectors is asked with each and found by each; it is listed once, with its best score. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rasterloom.llm.common import find_package
from rasterloom.session import materialize

TOP = 5
ROTATIONS, SUB_BITS, TURNS = 2, 16, 30
#: Numbers in the sample that the rotations are learned from, and the queries that measure the radius.
SAMPLE_NUMBERS, ASKED, SAFE = 1_280_000, 256, 0.99
#: Vectors of a shard and queries of a block at most, on average; a shard has at least ``SHARD_LEAST`` if the table allows ``SPREAD`` of them.
SHARD, BLOCK, SHARD_LEAST, SPREAD = 131_072, 32_768, 1024, 48

_RESULT = "query_id bigint, vec_id bigint, score double"


class Codes(NamedTuple):
    """Rotations (dimension x bits) and the borders of the substrings."""

    rotation: np.ndarray
    borders: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """Signs (rows x bits) as 0 and 1."""
        return (x @ self.rotation >= 0).astype(np.uint8)


def learn(sample: np.ndarray, rotations: int = ROTATIONS, turns: int = TURNS) -> Codes:
    """Rotations from unit vectors; each starts at another random one."""
    dim = sample.shape[1]
    axes = np.linalg.svd(sample.T @ sample)[0] if len(sample) else np.eye(dim)
    z, found = sample @ axes, []
    for seed in range(rotations):
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
        for _ in range(turns if len(z) else 0):
            left, _, right = np.linalg.svd(z.T @ np.where(z @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        found.append(axes @ turn)
    bits = dim * rotations
    return Codes(np.concatenate(found, axis=1), np.linspace(0, bits, -(-bits // SUB_BITS) + 1).astype(int))


def allowance(radius: int, m: int) -> list[int]:
    """How many bits each of ``m`` substrings may differ in so that no code within ``radius`` is missed; -1 leaves an index out."""
    return [radius // m - (j > radius % m) for j in range(m)]


class Index:
    """One list per value of each substring, over the codes of a shard."""

    def __init__(self, codes: Codes, bits: np.ndarray):
        self.codes, self.n = codes, len(bits)
        self.packed = np.packbits(bits, axis=1)
        self.tables = []
        for value in self.substrings(bits):
            order = np.argsort(value, kind="stable")
            values, start = np.unique(value[order], return_index=True)
            self.tables.append((values, np.append(start, self.n), order))

    def substrings(self, bits: np.ndarray) -> list[np.ndarray]:
        cuts = zip(self.codes.borders[:-1], self.codes.borders[1:])
        return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.uint32)).astype(np.uint32) for a, b in cuts]

    def within(self, bits: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """For each query code: the places of all codes within ``radius``."""
        own, packed = self.substrings(bits), np.packbits(bits, axis=1)
        allowed = allowance(radius, len(self.tables))
        for q in range(len(bits)):
            met = np.zeros(self.n, bool)
            for (values, start, order), value, most in zip(self.tables, own, allowed):
                near = np.bitwise_count(values ^ value[q]) <= most if most >= 0 else np.zeros(len(values), bool)
                # the lists of the values within reach, marked as runs of the sorted order
                met[order[np.repeat(near, np.diff(start))]] = True
            place = np.flatnonzero(met)
            yield place[np.bitwise_count(self.packed[place] ^ packed[q]).sum(axis=1) <= radius]


def cosine(rows: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision; every row is summed in the same order, so equal vectors have equal scores."""
    return (rows * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


def first(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best different ids by score, then id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        if len(np.unique(ident[some])) < k:
            some = np.arange(len(score))
    else:
        some = np.arange(len(score))
    some = some[np.lexsort((ident[some], -score[some]))]
    return some[np.sort(np.unique(ident[some], return_index=True)[1])[:k]]


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray | pa.LargeListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def usable(df: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the different rows that take part, and their dimension (0: none)."""
    clean = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = df.select(F.col(f"`{ident}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & clean)
    found = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if found is None:
        return rows, 0
    return rows.filter(F.size("v") == found["dim"]).distinct(), found["dim"]


def _answer(shared, dim: int, k: int, radius: int | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            codes: Codes = shared.value
            ident, x = left.column("id").to_numpy(), _vectors(left.column("v"), dim)
            asked, y = right.column("id").to_numpy(), _vectors(right.column("v"), dim)
            norms = _norms(x)
            if radius is None:
                near = (np.arange(len(x)) for _ in asked)
            else:
                near = Index(codes, codes.of(x)).within(codes.of(y), radius)
            for place, q, v in zip(near, asked, y):
                place = place[ident[place] != q]
                score = cosine(x[place], norms[place], v)
                best = first(score, ident[place], k)
                out.append((np.full(len(best), q), ident[place[best]], score[best]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    return run


def _calibrate(shared, dim: int, k: int, codes: Codes):
    """The nearest of a task's rows to each of the asked vectors, with the bits in which they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, y = shared.value
        code, held = codes.of(y), [[] for _ in ident]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column(0).to_numpy(), _vectors(pa.chunked_array([batch.column(1)]), dim)
            score = x @ y.T / (_norms(x)[:, None] * _norms(y))
            for q in range(len(ident)):
                s = np.where(own == ident[q], -2.0, score[:, q])
                best = np.argpartition(-s, k)[:k] if len(s) > k else np.arange(len(s))
                bits = (codes.of(x[best]) != code[q]).sum(axis=1)
                held[q] = sorted([*held[q], *zip(-s[best], own[best].tolist(), bits.tolist())])[:k]
        rows = [(int(i), v, -s, b) for i, h in zip(ident, held) for s, v, b in h if s < 2]
        cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score", "bits"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each id once per query, ranked."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def fit(rows: DataFrame, dim: int) -> Codes:
    """Codes from the rows with the smallest hashes, ``SAMPLE_NUMBERS`` numbers at most."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(max(1, SAMPLE_NUMBERS // dim)).select("v").toPandas()["v"]
    x = np.array([np.asarray(v, np.float64) for v in sample]).reshape(-1, dim)
    return learn(x / _norms(x)[:, None])


def measure(rows: DataFrame, queries: DataFrame, dim: int, k: int, codes: Codes, safe: float = SAFE) -> int:
    """Radius that holds the share ``safe`` of the true neighbours of at most ``ASKED`` queries among all rows."""
    some = queries.orderBy(F.xxhash64("id", "v"), "id").limit(ASKED).toPandas()
    y = np.array([np.asarray(v, np.float64) for v in some["v"]]).reshape(-1, dim)
    shared = rows.sparkSession.sparkContext.broadcast((some["id"].to_numpy(np.int64), y))
    near = rows.mapInArrow(_calibrate(shared, dim, k, codes), f"{_RESULT}, bits int")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bits = near.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k).select("bits").toPandas()["bits"]
    return int(np.ceil(np.quantile(bits, safe))) if len(bits) else codes.rotation.shape[1]


def neighbours(df: DataFrame, queries: DataFrame, k: int = TOP, ident: str = "vec_id", vector: str = "embedding", safe: float = SAFE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` found nearest to each row of ``queries``, which has the same columns."""
    spark = df.sparkSession
    find_package(spark)
    rows, dim = usable(df, ident, vector)
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not dim:
        return none
    asked = queries.select(F.col(f"`{ident}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"))
    asked, own = usable(asked, "id", "v")
    if own != dim:
        return none
    rows, asked = materialize(rows, "vectors"), materialize(asked, "asked")
    codes = fit(rows, dim)
    radius = measure(rows, asked, dim, k, codes, safe)
    n, n_asked = rows.count(), asked.count()
    shards = max(-(-n // SHARD), min(SPREAD, -(-n // SHARD_LEAST)))
    shared = spark.sparkContext.broadcast(codes)

    def answer(asked: DataFrame, n_asked: int, radius: int | None) -> DataFrame:
        blocks = -(-n_asked // BLOCK)
        side = lambda own, other: F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(own)
        shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard")
        block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block")
        left = rows.select(shard, side("block", blocks), "id", "v").groupBy("shard", "block")
        right = asked.select(side("shard", shards), block, "id", "v").groupBy("shard", "block")
        return _top(left.cogroup(right).applyInArrow(_answer(shared, dim, k, radius), _RESULT), k)

    found = materialize(answer(asked, n_asked, radius), "neighbours")
    few = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    again = materialize(asked.join(few, "id", "left_anti"), "asked_again")
    n_again = again.count()
    if n_again:
        kept = found.join(again.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
        found = kept.unionByName(answer(again, n_again, None))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
