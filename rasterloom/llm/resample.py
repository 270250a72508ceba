"""Resampling of a corpus towards a target distribution, by importance weights of hashed features and Gumbel noise.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased; a feature is a run of 1 to ``GRAMS`` words
and falls into one of ``BUCKETS`` buckets by crc32. One pass sums a histogram of the corpus (one array per task, added up by Spark), another
one that of the target; the gain of a bucket is the logarithm of how much more common it is in the target. A second pass sums the gains of
each text from that array. A document's key is its weight plus noise from a hash of its id, so that the highest keys are a sample without
replacement with chances in proportion to the weights.

The cutoff key is found exactly and without sorting the corpus. Each task takes the median of its own keys that are still in question, and
the pivot is the median of these medians, each weighted by how many keys stand behind it. Half of the weight has medians on either side, and
half of the keys behind each of these lie beyond it, so at least a quarter of all keys in question is discarded in every round. One
pass over the written keys counts those above the pivot and takes the next medians of both sides. When few are left they are sorted
outright. Only the winners are put in order, in buckets bounded by quantiles of the key.

Defined cases: null and empty texts have no features and weight 0. Rows of a null id count among the long ones but have no score and are
never drawn. Repeated rows are documents of their own; where the cutoff falls among rows of equal score and id, only
as many of these are drawn as there is room for. An empty corpus gives no rows; an empty target leaves gains of the smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rasterloom.llm.common import chunks, find_package, map_text
from rasterloom.operators.ranking import ordered_rank, quantile_bucket
from rasterloom.session import materialize

GRAMS, BUCKETS, SEED = 1, 10_000, 2024
MIN_WORDS, PERCENT = 20, 10
#: Keys in question that are sorted outright instead of halved again.
FEW = 4096
#: Different words whose bucket a task remembers.
REMEMBERED = 200_000

_FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256))


class Buckets(dict):
    """Bucket of a feature; remembers a bounded number of them."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = at = zlib.crc32(feature) % BUCKETS
        return at


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def buckets_of(own: list[bytes], seen: Buckets, grams: int = GRAMS) -> np.ndarray:
    """Bucket of each feature, repeats included."""
    found = [seen[w] for w in own]
    for n in range(2, grams + 1):
        found += [seen[b" ".join(own[i : i + n])] for i in range(len(own) - n + 1)]
    return np.array(found, np.int64)


def histogram(df: DataFrame, column: str = "text", grams: int = GRAMS) -> np.ndarray:
    """Features of all texts by bucket: one array per task is added up, ``BUCKETS`` numbers reach the driver."""
    find_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Buckets(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for i in range(len(texts)):
                total += np.bincount(buckets_of(words(texts[i].as_py()), seen, grams), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    texts = df.select(F.col(column).cast("string").alias("text"))
    counts = texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS, np.int64)
    for r in counts:
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the corpus, by bucket."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((int(t) + 1) * s_all / ((int(s) + 1) * t_all))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """Adds ``n_words``, ``n_features``, ``weight`` and ``score``. No shuffle; the array has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def make(texts: list[str | None]) -> list:
        own, seen, out = shared.value, Buckets(), []
        for t in texts:
            w = words(t)
            b = buckets_of(w, seen, grams)
            out.append((len(w), len(b), int(own[b].sum())))
        return [[o[i] for o in out] for i in range(3)]

    weighed = map_text(docs, "text", [("n_words", "bigint"), ("n_features", "bigint"), ("weight", "bigint")], make)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def _sides(pivot: tuple[int, int] | None):
    """Per task: how many keys lie at or above the pivot and their median, and the same below it. Order: high score, then small id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        score, ident = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
        first = np.ones(len(score), bool) if pivot is None else (score > pivot[0]) | ((score == pivot[0]) & (ident <= pivot[1]))
        rows = []
        for side, own in ((0, first), (1, ~first)):
            s, d = score[own], ident[own]
            if len(s):
                mid = np.lexsort((d, -s))[(len(s) - 1) // 2]
                rows.append((side, len(s), int(s[mid]), int(d[mid])))
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(cols, names=["side", "n", "score", "doc_id"])

    return run


def weighted_median(medians: list[tuple[int, int, int]]) -> tuple[int, int]:
    """(score, id) among (n, score, id) with half of the weight on either side."""
    ranked = sorted(medians, key=lambda m: (-m[1], m[2]))
    half, upto = sum(m[0] for m in ranked) / 2, 0
    for n, score, ident in ranked:
        upto += n
        if upto >= half:
            return score, ident
    raise ValueError("no medians")


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> tuple[int, int, int] | None:
    """Key (score, doc_id) of place ``k`` in the order of high score and small id, and how many keys stand before it; None if ``k`` is 0.

    ``keys`` has the columns score and doc_id and is read once a round. The driver gets one median per task and side, and at the end at most
    ``few`` keys, or all copies of one key as a count.
    """
    if k < 1:
        return None
    before, left, high, low, pivot, sides = 0, None, None, None, None, None
    rows = keys.select("score", "doc_id")

    def within():
        """The keys after ``high`` and up to ``low``."""
        out = rows
        if high is not None:
            out = out.filter((F.col("score") < high[0]) | ((F.col("score") == high[0]) & (F.col("doc_id") > high[1])))
        if low is not None:
            out = out.filter((F.col("score") > low[0]) | ((F.col("score") == low[0]) & (F.col("doc_id") <= low[1])))
        return out

    while True:
        found = [tuple(r) for r in within().mapInArrow(_sides(pivot), "side bigint, n bigint, score bigint, doc_id bigint").collect()]
        sides = [[f[1:] for f in found if f[0] == s] for s in (0, 1)]
        sizes = [sum(f[0] for f in s) for s in sides]
        if pivot is None:
            here, left = sides[0], sizes[0]
            if k > left:
                raise ValueError(f"place {k} of {left} keys")
        elif k <= before + sizes[0]:
            low, here, left = pivot, sides[0], sizes[0]
        else:
            before, high, here, left = before + sizes[0], pivot, sides[1], sizes[1]
        if left <= few:
            last = sorted(((-s, d) for s, d in within().collect()))
            key = last[k - before - 1]
            return -key[0], key[1], before + last.index(key)
        new = weighted_median(here)
        if new == low and pivot == low and sizes[1] == 0:
            # nothing lies after the pivot: count the copies of the last key, which may be many
            edge = (F.col("score") == low[0]) & (F.col("doc_id") == low[1])
            ahead = within().filter(~edge).count()
            if k - before > ahead:
                return *low, before + ahead
            rows = rows.filter(~edge)
        pivot = new


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where it is not drawn.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred are drawn. The keys are written once, four numbers a row.
    """
    gain = gains(histogram(docs, "text", grams), histogram(target, "text", grams))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialize(weigh(base, gain, grams, seed).drop("text"), "weights")
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    long_enough, able_count = scored.agg(F.count_if(F.col("n_words") >= min_words), F.count_if(able)).first()
    k = min(percent * long_enough // 100, able_count)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    edge = cutoff(scored.filter(able), k)
    if edge is None:
        return scored.select(*out, none)
    score, ident, before = edge
    ahead = able & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("doc_id") < ident)))
    at = able & (F.col("score") == score) & (F.col("doc_id") == ident)
    ahead, at = F.coalesce(ahead, F.lit(False)), F.coalesce(at, F.lit(False))
    # rows of the very cutoff key: one, unless rows are repeated
    ties = scored.filter(at)
    room = k - before
    taken = ties.limit(room).select(*out).withColumn("rank", F.lit(before) + F.row_number().over(W.partitionBy("doc_id").orderBy("n_features", "weight")))
    spare = ties.count() - room
    winners = scored.filter(ahead).select(*out)
    bucket = -quantile_bucket(winners, "score")
    ranked = ordered_rank(winners, bucket, [F.desc("score"), F.col("doc_id")], rank="rank")
    rest = scored.filter(~ahead & ~at).select(*out, none)
    done = ranked.select(*out, F.col("rank").cast("bigint")).union(taken.select(*out, F.col("rank").cast("bigint"))).union(rest)
    if spare:
        done = done.union(ties.select(*out).exceptAll(taken.select(*out)).select(*out, none))
    return done


def sql() -> str:
    """DuckDB text of the draw; crc32 goes through a table of its 256 steps."""
    step = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    table = "i::UBIGINT AS c0" + "".join(f", {step.format(c=f'c{j}')} AS c{j + 1}" for j in range(8))
    split = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH crc AS (SELECT list(c8 ORDER BY i) AS t FROM (SELECT i, {table} FROM range(256) r(i))),
    d AS (SELECT doc_id, unnest({split.format("text")}) AS w FROM documents WHERE text IS NOT NULL),
    b AS (SELECT unnest({split.format("text")}) AS w FROM benchmark WHERE text IS NOT NULL),
    voc AS (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
    bytes AS (SELECT w, hex(encode(w)) AS h FROM voc),
    hashed AS (SELECT w, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2),
        lambda p: CAST('0x' || substr(h, CAST(2 * p + 1 AS BIGINT), 2) AS UBIGINT))),
        lambda x, y: xor(t[CAST(xor(x, y) & 255 AS BIGINT) + 1], x >> 8)), 4294967295::UBIGINT) % {BUCKETS} AS INT) AS bucket FROM bytes, crc),
    ds AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (w) GROUP BY bucket),
    bt AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
    tot AS (SELECT (SELECT count(*) FROM d) AS s_all, (SELECT count(*) FROM b) AS t_all),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * (t_all + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g
      FROM ds LEFT JOIN bt USING (bucket), tot),
    sums AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM d JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
    scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST(CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM documents LEFT JOIN sums USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n_all FROM scored WHERE n_features >= {MIN_WORDS})
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
      CAST(CASE WHEN rank <= {PERCENT} * n_all // 100 THEN rank END AS BIGINT) AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
