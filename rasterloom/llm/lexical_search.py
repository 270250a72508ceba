"""Ranked lexical search: the terms of all items form one automaton, and each document is scanned with it; documents are never indexed.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. A text goes through the automaton
with every other character turned into a space, and a term stands in the automaton between two spaces, so it only matches as a whole.
Each output of the automaton is a term's number, which leads to the items that hold it and how often.

Two passes over the texts. The first one gives the number of documents with a term, the number of all terms, and in how many documents
each item term occurs: a few numbers per task are summed by Spark. Then a term's weight is known, and the second pass scans again, scores
every document for every item that shares a term with it, and each task hands on its best documents per item; ranked windows merge
them, first the tasks of a group and then the groups. Nothing is kept per document, so nothing grows with the corpus but the time of the scans.

Items are dealt to blocks of bounded size with an automaton each, so the broadcast does not grow with the items, only the number of scans.

Defined cases: a document without text has no terms. Repeated rows are documents of their own. Rows without an id count in the
statistics but are not listed. Rows of one item id are one item with the terms of all of them, and an item without terms has no result.
Empty tables give no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rasterloom.llm.common import find_package

TOP = 10
#: Characters of item texts in one automaton, and the cells of one table of documents by items.
BLOCK_CHARS, CELLS = 8_000_000, 1_000_000
#: Found documents a task holds before it keeps only the best of each item.
HELD = 200_000
#: Groups of tasks whose best documents are merged before those of all tasks.
GROUPS = 256

_KEEP = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z, everything that is no part of a term to a space.
_FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEEP else b if b in _KEEP else 0x20 for b in range(256))


def folded(text: bytes) -> bytes:
    """The UTF-8 text with spaces for all that is in no term; all characters that matter to the folding are ASCII."""
    return text.translate(_FOLD)


def terms(text: str | None) -> list[str]:
    return [t.decode() for t in folded((text or "").encode()).split()]


class Block:
    """Automaton of the items' terms, and for each term its items with their repeats (``start`` to ``start + 1`` of ``item`` and ``times``)."""

    def __init__(self, items: list[tuple[int, str]]):
        held: dict[int, Counter] = {}
        for item_id, text in items:
            held.setdefault(item_id, Counter()).update(terms(text))
        self.ids = np.array(sorted(held), np.int64)
        self.terms = sorted({t for c in held.values() for t in c})
        number = {t: i for i, t in enumerate(self.terms)}
        found = sorted((number[t], i, n) for i, item_id in enumerate(self.ids) for t, n in held[item_id].items())
        self.item = np.array([f[1] for f in found], np.int64)
        self.times = np.array([f[2] for f in found], np.int64)
        self.start = np.searchsorted([f[0] for f in found], np.arange(len(self.terms) + 1))
        self.machine = ahocorasick.Automaton()
        for t, i in number.items():
            self.machine.add_word(f" {t} ".encode().decode("latin-1"), i)
        if number:
            self.machine.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, dict[int, int]]:
        """Terms of a text with repeats, and how often each item term occurs."""
        flat = folded(text or b"")
        if not self.terms:
            return len(flat.split()), {}
        # one character per byte: the automaton takes strings, and bytes keep the borders
        return len(flat.split()), Counter(i for _, i in self.machine.iter(f" {flat.decode('latin-1')} "))


def _column(batch: pa.RecordBatch, at: int) -> pa.Array:
    return batch.column(at).cast(pa.large_binary())


def _count(shared):
    """(term, documents) of a task; term -1 counts documents with a term, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        df = np.zeros(len(block.terms), np.int64)
        some = total = 0
        for batch in batches:
            for text in _column(batch, 0):
                n, tf = block.scan(text.as_py())
                some, total = some + (n > 0), total + n
                df[list(tf)] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *used], pa.int32()), pa.array([some, total, *df[used]], pa.int64())], names=["term", "n"])

    return run


def _best(items: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each item by score, then id."""
    order = np.lexsort((docs, -scores, items))
    at = items[order]
    first = np.searchsorted(at, at)
    return order[np.arange(len(at)) - first < k]


def _search(shared, weights, documents: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        weight = np.array(weights.value, np.int64)
        n_items = len(block.ids)
        rows = max(1, CELLS // max(n_items, 1))
        held = [np.zeros(0, np.int64)] * 3
        bar = np.zeros(n_items, np.int64)  # a document must reach it to come among an item's best of this task

        def prune(held):
            keep = _best(*held, k)
            held = [h[keep] for h in held]
            size = np.bincount(held[0], minlength=n_items)
            low = np.full(n_items, np.iinfo(np.int64).max)
            np.minimum.at(low, held[0], held[2])
            bar[:] = np.where(size >= k, low, 0)
            return held

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = _column(batch, 1)
            for a in range(0, len(ids), rows):
                doc, term, tf, length = [], [], [], []
                for d, text in enumerate(texts[a : a + rows]):
                    n, found = block.scan(text.as_py())
                    length.append(n)
                    doc.extend([d] * len(found))
                    term.extend(found)
                    tf.extend(found.values())
                if not doc:
                    continue
                doc, term, tf = np.array(doc), np.array(term), np.array(tf, np.int64)
                m = np.array([100 - 75 + (75 * n * documents) // total for n in length], np.int64)
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                size = block.start[term + 1] - block.start[term]
                place = np.repeat(block.start[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                score = np.zeros((len(length), n_items), np.int64)
                np.add.at(score, (np.repeat(doc, size), block.item[place]), np.repeat(part, size) * block.times[place])
                d, i = np.nonzero((score > 0) & (score >= bar))
                held = [np.concatenate(p) for p in zip(held, (i, ids[a + d], score[d, i]))]
                if len(held[0]) > HELD:
                    held = prune(held)
        i, d, s = prune(held)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[i]), pa.array(d), pa.array(s)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, ties to the smaller id."""
    spark = docs.sparkSession
    find_package(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    asked = asked.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = asked.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) * 2 + 1
    parts = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = [tuple(r) for r in own.collect()]
        shared = spark.sparkContext.broadcast(rows)
        found = texts.select("text").mapInArrow(_count(shared), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r["term"]: r["n"] for r in found.collect()}
        documents, total = df.get(-1, 0), df.get(-2, 0)
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(Block(rows).terms))]
        run = _search(shared, spark.sparkContext.broadcast(weights), documents, total, k)
        parts.append(texts.filter("doc_id is not null").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint"))
    first = reduce(DataFrame.union, parts).withColumn("_group", F.spark_partition_id() % GROUPS)
    for by in (["item_id", "_group"], ["item_id"]):
        ranked = W.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
        first = first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return first.select("item_id", "rank", "doc_id", "score")


def sql() -> str:
    """DuckDB text of the search over ``documents`` and ``benchmark``."""
    split = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, unnest({split.format("text")}) AS term FROM documents WHERE text IS NOT NULL),
    len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM len),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
    q AS (SELECT item_id, term, count(*) AS times FROM
      (SELECT item_id, unnest({split.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
    s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // l)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), tot GROUP BY item_id, doc_id),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""
