"""Language-model scores by online logistic context mixing, beside a unigram base score.

A document is its tokens (words, A-Z lowered) and one end. The model predicts the bytes of each word and a closing byte, bit by
bit. Bit predictors look up counts by a hash of a context: nothing, the last one to three bytes of the word, or all
of its bytes so far. Their stretched chances are mixed by weights that a gate chooses (bit and place in the word), learned online by
gradient steps; a last stage refines the mixed chance by what followed it before at the same order-1 context.

What is learned comes from all training documents: tokens are counted by a shuffle, the hashed counts are sums over that table,
weights and refinement are learned in one online pass over each part of it (each token without its own share of the counts)
and averaged. Contexts stay inside a word, so a word has one chance whatever its document and is scored once. Scores
return to documents by a broadcast of the ``HEAD`` most frequent tokens, whose number and length are bounded, and a join of the rest.

Null and empty texts consist of the end only. Repeated rows are counted as often as they occur.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom.llm.common import WORD, chunks, find_package
from rasterloom.session import materialize

ORDERS = 5
#: Size of each order's table, as a power of two.
SLOT_BITS = (12, 16, 19, 21, 22)
SLOTS = sum(1 << b for b in SLOT_BITS)
BLOCK = 1 << 13
CLOSE = 0
HEAD, HEAD_CHARS = 150_000, 40
#: Curvature assumed before anything is seen, per weight.
PRIOR = 20.0
#: Distinct tokens that one task counts; its hashed table is what it hands on.
TASK_TOKENS = 2_000_000
PLACES, REFINE = 6, 33
#: A word is scored in pieces of at most this many bytes; contexts do not reach over a cut.
PIECE = 64
#: Tokens handled at once, and those that are gathered to be counted or scored and sorted by length first, so that few rows outlive the rest of their batch.
BATCH, GATHER = 4096, 40_000
#: Words of a text and lower case in plain Python; ``split_words`` does the same for many texts.
words_of = re.compile(WORD).findall
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


@dataclass
class Mixer:
    counts: np.ndarray  # slots x 2
    weights: np.ndarray  # gate x ORDERS; a gate is the place in the word and the bit
    refine: np.ndarray  # 256 x REFINE x 3: ones met, ones expected, bits met
    shift: np.ndarray  # 256 x REFINE, what that adds to the log odds
    odds: np.ndarray  # slots, what the counts say
    curve: np.ndarray  # gate x ORDERS x ORDERS, for learning


def byte_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of pieces, one row each with its closing byte and then -1, and the word of each row."""
    raw, of = [], []
    for i, w in enumerate(words):
        b = w.encode("utf-8", "replace") + bytes([CLOSE])
        for a in range(0, len(b), PIECE):
            raw.append(b[a : a + PIECE])
            of.append(i)
    n = np.array([len(b) for b in raw])
    rows = np.full((len(raw), n.max(initial=0)), -1, np.int16)
    rows[np.arange(rows.shape[1]) < n[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return rows, np.array(of)


def contexts(rows: np.ndarray, t: int) -> np.ndarray:
    """Hashes (orders x rows) of what stands before byte ``t``: nothing, the last 1 to 3 bytes, all bytes of the piece."""
    n = len(rows)
    out = np.zeros((ORDERS, n), np.uint64)
    for order in range(1, ORDERS):
        h = np.full(n, order + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(max(0, t - order) if order < ORDERS - 1 else 0, t):
            h = (h + rows[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
            h ^= h >> np.uint64(29)
        out[order] = h + np.uint64(t == 0)
    return out


_FIRST = np.cumsum([0, *(1 << b for b in SLOT_BITS[:-1])])[:, None]
_SHIFT = np.array([64 - b for b in SLOT_BITS], np.uint64)[:, None]


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot of each context and bit node (the bits of the byte so far, with a leading one); each order has its own range."""
    h = (context + node.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0x2545F4914F6CDD1D)) >> _SHIFT).astype(np.int64) + _FIRST


def add_counts(counts: np.ndarray, words: list[str], times: np.ndarray) -> None:
    """Adds the bits of words that occur ``times`` often to ``counts`` (slots x 2)."""
    rows, of = byte_rows(words)
    times, flat = times[of].astype(np.float32), counts.reshape(-1)
    for t in range(rows.shape[1]):
        live = np.flatnonzero(rows[:, t] >= 0)
        byte, context = rows[live, t].astype(np.int64), contexts(rows[live, :t], t)
        for b in range(8):
            bit, node = (byte >> (7 - b)) & 1, (1 << b) | (byte >> (8 - b))
            at = slots(context, node) * 2 + bit
            np.add.at(flat, at.ravel(), np.tile(times[live], ORDERS))


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one, less sure where little was seen."""
    seen = zeros + ones
    return np.log((ones + np.float32(0.02)) / (zeros + np.float32(0.02))) * (seen / (seen + np.float32(0.2)))


def bits(model: Mixer, words: list[str], times: np.ndarray, learn: bool) -> np.ndarray:
    """-log2 of each word's chance. ``learn``: weights and refinement are updated bit by bit on the way.

    While learning, one occurrence of the word itself is taken off the counts, so that a word seen once looks unseen.
    """
    rows, of = byte_rows(words)
    cost, share = np.zeros(len(words)), (times[of] ** 0.8).astype(np.float32) if learn else None
    for t in range(rows.shape[1]):
        live = np.flatnonzero(rows[:, t] >= 0)
        byte, context = rows[live, t].astype(np.int64), contexts(rows[live, :t], t)
        last = rows[live, t - 1].astype(np.int64) if t else np.zeros(len(live), np.int64)
        for b in range(8):
            bit, node = (byte >> (7 - b)) & 1, (1 << b) | (byte >> (8 - b))
            at = slots(context, node)
            if learn:
                one = bit.astype(np.float32)
                x = stretched(np.maximum(model.counts[at, 0] - (1 - one), 0), np.maximum(model.counts[at, 1] - one, 0))
            else:
                x = model.odds[at]
            gate = min(t, PLACES - 1) * 8 + b
            mixed = np.clip(model.weights[gate] @ x, -12, 12)
            p = 1 / (1 + np.exp(-mixed))
            cell = np.rint((mixed + 12) / 24 * (REFINE - 1)).astype(np.int64)
            if learn:
                w = share[live]
                # a gradient step, scaled by the curvature met so far at this gate: large at first, then ever smaller
                model.curve[gate] += (x * (w * (p * (1 - p) + 1e-3))) @ x.T
                model.weights[gate] += np.linalg.solve(model.curve[gate], x @ (w * (one - p)))
                where = last * REFINE + cell
                for i, met in enumerate((w * one, w * p, w)):
                    model.refine[:, :, i] += np.bincount(where, met, 256 * REFINE).reshape(256, REFINE)
            else:
                final = np.clip(1 / (1 + np.exp(-mixed - model.shift[last, cell])), 1e-7, 1 - 1e-7)
                cost += np.bincount(of[live], -np.log2(np.where(bit == 1, final, 1 - final)), len(words))
    return cost


def fresh(counts: np.ndarray) -> Mixer:
    gates = PLACES * 8
    weights = np.full((gates, ORDERS), 1 / ORDERS, np.float32)
    curve = np.tile(PRIOR * np.eye(ORDERS, dtype=np.float32), (gates, 1, 1))
    return Mixer(counts, weights, np.zeros((256, REFINE, 3), np.float32), np.zeros((256, REFINE)), stretched(counts[:, 0], counts[:, 1]), curve)


def refined(refine: np.ndarray) -> np.ndarray:
    """Log odds of the ones met less those of the ones expected, near 0 where little was met."""
    met, expected, n = np.moveaxis(refine.astype(np.float64), -1, 0)
    odds = lambda k: np.log((k + 2) / (np.maximum(n - k, 0) + 2))
    return np.clip(odds(met) - odds(expected), -3, 3)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lowered, one after another, and the place of each one's text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    # white space at an end leaves an empty piece there
    flat = split.flatten()
    held = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(held), of[held.to_numpy(zero_copy_only=False)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each chunk of texts with their counts in training documents and in all."""
    for batch in batches:
        for a, b in chunks(batch.column(1).to_pylist(), 4_000_000):
            words, of = split_words(batch.column(1).slice(a, b - a))
            coded, train = words.dictionary_encode(), batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            at, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
            counts = [np.bincount(at[k], minlength=size).astype(np.int64) for k in (train[of].astype(bool), slice(None))]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, counts)], names=["token", "c", "n"])


def token_table(docs: DataFrame) -> DataFrame:
    """(token, c, n): each token's count in training documents and in all. ``docs`` has text and train."""
    tokens = docs.select("train", "text").mapInArrow(_counted, "token string, c bigint, n bigint")
    return tokens.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``GATHER`` or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_length(tokens: pa.Array) -> Iterator[np.ndarray]:
    """Rows of like length, ``BATCH`` at once."""
    order = np.argsort(pc.binary_length(tokens).to_numpy(zero_copy_only=False), kind="stable")
    for a in range(0, len(order), BATCH):
        yield order[a : a + BATCH]


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    for batch in batches:
        words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for at in _by_length(batch.column(0)):
            yield [words[i] for i in at], times[at]


def fit(spark: SparkSession, known: DataFrame) -> Mixer:
    """Mixer from (token, c) with c > 0. What reaches the driver has a fixed size: hashed counts, weights, refinement."""
    sc = spark.sparkContext
    tasks = max(1, math.ceil(known.count() / TASK_TOKENS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SLOTS, 2), np.float32)
        for words, times in _word_batches(_gathered(batches)):
            add_counts(counts, words, times)
        flat = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(flat.any(axis=1))
        for a in range(0, len(used), 64):
            part = used[a : a + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([flat[i].tobytes() for i in part], pa.binary())], names=["block", "counts"])

    def add(key, rows):
        import pandas as pd

        total = np.zeros(BLOCK, np.float64)
        for x in rows["counts"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"block": [key[0]], "counts": [total.astype(np.float32).tobytes()]})

    # tables are added in two steps, so that no task gets one row from every other task
    partial = known.select("token", "c").coalesce(tasks).mapInArrow(count, "block int, counts binary")
    partial = materialize(partial.withColumn("salt", F.spark_partition_id() % math.ceil(math.sqrt(tasks))), "context-counts")
    for keys in (("block", "salt"), ("block",))[tasks == 1 :]:
        if len(keys) == 2:
            step = partial.groupBy(*keys).applyInPandas(add, "block int, counts binary")
        else:
            step = (step if tasks > 1 else partial).groupBy(*keys).applyInPandas(add, "block int, counts binary")
    counts = np.zeros((SLOTS * 2 // BLOCK, BLOCK), np.float32)
    for r in step.collect():
        counts[r["block"]] = np.frombuffer(r["counts"], np.float32)
    counts = counts.reshape(SLOTS, 2)
    shared = sc.broadcast(counts)
    parts = 4 * tasks

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weight = fresh(shared.value), 0.0
        for words, times in _word_batches(batches):
            bits(model, words, times, learn=True)
            weight += len(words)
        if weight:
            learned = [pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.refine)]
            yield pa.RecordBatch.from_arrays([pa.array([weight]), *learned], names=["weight", "weights", "refine"])

    model, weight = fresh(counts), 0.0
    weights = np.zeros(model.weights.shape)
    for r in known.select("token", "c").coalesce(parts).mapInArrow(learn, "weight double, weights binary, refine binary").collect():
        weight += r["weight"]
        weights += r["weight"] * np.frombuffer(r["weights"], np.float32).reshape(weights.shape)
        model.refine += np.frombuffer(r["refine"], np.float32).reshape(model.refine.shape)
    if weight:
        model.weights = (weights / weight).astype(np.float32)
        model.shift = refined(model.refine)
    return model


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row; ``train`` marks training rows."""
    spark = docs.sparkSession
    find_package(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    table = materialize(token_table(rows), "tokens")
    total = table.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = rows.filter("train").count()  # each training document has one end
    n_all, distinct = int(total["n"] or 0) + ends, int(total["v"] or 0) + (1 if ends else 0)
    model = fit(spark, table.filter("c > 0"))
    # scoring needs no counts
    model.counts = model.curve = model.refine = None
    shared = spark.sparkContext.broadcast(model)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            words = batch.column(0).to_pylist()
            got = np.zeros(len(words))
            for at in _by_length(batch.column(0)):
                got[at] = bits(shared.value, [words[i] for i in at], np.zeros(len(at)), learn=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=["token", "c", "n", "bits"])

    scored = materialize(table.mapInArrow(cost, "token string, c bigint, n bigint, bits double"), "token-bits")
    # how often a document ends here rather than going on
    words_in = int(total["n"] or 0)
    p_end = (ends + 0.5) / (words_in + ends + 1.0)
    log_base = math.log10(n_all + 1 * (distinct + 1))
    known_end = {"c": ends, "base": math.log10(ends + 1) - log_base, "score": math.log10(p_end)}
    go_on = math.log10(1 - p_end)

    head = {r["token"]: (r["c"], r["bits"]) for r in _head(scored).collect()}
    head = spark.sparkContext.broadcast({t: (int(c > 0), math.log10(c + 1) - log_base, go_on - b * math.log10(2)) for t, (c, b) in head.items()})

    def known_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, none = head.value.get, (0, 0.0, 0.0)
        ends_with = int(known_end["c"] > 0), known_end["base"], known_end["score"]
        for batch in batches:
            for a, b in chunks(batch.column(1).to_pylist(), 4_000_000):
                part = batch.slice(a, b - a)
                words, of = split_words(part.column(1))
                coded, n = words.dictionary_encode(), len(part)
                at, got = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [get(w) for w in coded.dictionary.to_pylist()]
                value = np.array([g or none for g in got], np.float64).reshape(-1, 3)
                known, base, full = (np.bincount(of, value[at, i], n) + x for i, x in enumerate(ends_with))
                n_words = np.bincount(of, minlength=n)
                # a space between words and the end, a byte each
                size = np.bincount(of, pc.binary_length(words).to_numpy(zero_copy_only=False), n).astype(np.int64) + np.maximum(n_words, 1)
                tail = ~np.array([g is not None for g in got], bool)[at]
                pairs, times = np.unique(of[tail] * len(got) + at[tail], return_counts=True)
                starts = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(got)).astype(np.int32))
                rest = coded.dictionary.take(pa.array(pairs % max(1, len(got))))
                lists = [pa.ListArray.from_arrays(starts, x) for x in (rest, pa.array(times.astype(np.int64)))]
                columns = [n_words.astype(np.int64) + 1, size, known.astype(np.int64), base, full]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, columns), *lists], names=names)

    id_type = dict(rows.dtypes)["id"]
    names = ["id", "train", "n_tokens", "n_bytes", "known", "base", "full", "rest", "times"]
    schema = f"id {id_type}, train boolean, n_tokens bigint, n_bytes bigint, known bigint, base double, full double, rest array<string>, times array<bigint>"
    parts = rows.mapInArrow(known_part, schema).withColumn("row", F.monotonically_increasing_id())
    parts = materialize(parts, "document-parts")
    rest = parts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    of_token = scored.select(
        "token",
        (F.col("c") > 0).cast("bigint").alias("known"),
        (F.log10(F.col("c") + 1) - F.lit(log_base)).alias("base"),
        (F.lit(go_on) - F.col("bits") * F.lit(math.log10(2))).alias("full"),
    )
    tail = rest.join(of_token, "token").groupBy("row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"t_{c}") for c in ("known", "base", "full")])
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"t_{c}"), F.lit(0))).alias(c)
    out = parts.drop("rest", "times").join(tail, "row", "left").select("id", "train", "n_tokens", "n_bytes", add("known"), add("base"), add("full"))
    return out.select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("full").alias("score"),
        (F.col("full") / F.lit(-math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _head(scored: DataFrame) -> DataFrame:
    """At most ``HEAD`` of the most frequent short tokens: the largest counts' threshold is found from a histogram of counts."""
    short = scored.filter(F.length("token") <= HEAD_CHARS)
    steps = short.groupBy(F.floor(F.log2(F.col("n")) * 8).cast("int").alias("step")).count().collect()
    room, least = HEAD, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return short.filter(F.lit(False) if least is None else F.floor(F.log2(F.col("n")) * 8) >= least)
