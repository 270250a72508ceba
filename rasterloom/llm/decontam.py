"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits. A document and a benchmark item meet if they share a seed: ``SEED``
consecutive tokens. Then tiles are marked: by Karp-Rabin hashes of falling length, the longest matches of still unmarked
tokens on both sides are found and marked, down to ``SEED``. The share of the item's tokens in tiles is its coverage; it does
not depend on the order in which the document has the passages. Items shorter than a seed are matched as a whole.

The benchmark travels to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each met by all documents; a larger
benchmark takes more passes, so no broadcast grows. Documents are never shuffled. Null and empty documents and items give no row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm.common import find_package, free_name, map_text

SEED = 5
COVERAGE = 0.5
BLOCK_CHARS = 4_000_000
tokens_of = re.compile(r"[^\W_]+").findall

_RESULT = "doc_id bigint, item_id bigint, coverage double, n_tiles int, longest_tile int, tiles array<struct<doc_start:int,item_start:int,length:int>>"


def tile(doc: list[int], item: list[int], seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (document start, item start, length), longest first; equal lengths in order of the item, then the document.

    A round of search length s: hashes of all unmarked item windows of that length meet rolling hashes of the document's.
    A match is extended while both sides agree and are unmarked. Marked rounds repeat until the length is exhausted, then it is halved.
    """
    seed = min(seed, len(item))
    doc_used, item_used, tiles = [False] * len(doc), [False] * len(item), []
    s, base, prime = max(seed, min(len(doc), len(item))), 1_000_003, (1 << 61) - 1

    def windows(t: list[int], used: list[bool], s: int) -> Iterator[tuple[int, int]]:
        """(hash, start) of unmarked windows, by a rolling hash."""
        lead, h, run = pow(base, s, prime), 0, 0
        for i, x in enumerate(t):
            if used[i]:
                h = run = 0
                continue
            h = (h * base + x) % prime
            run += 1
            if run > s:
                h = (h - t[i - s] * lead) % prime
            if run >= s:
                yield h, i - s + 1

    while True:
        at = defaultdict(list)
        for h, i in windows(item, item_used, s):
            at[h].append(i)
        found = []
        for h, d in windows(doc, doc_used, s) if at else ():
            for i in at.get(h, ()):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not doc_used[d + n] and not item_used[i + n]:
                    n += 1
                if n >= s:
                    found.append((-n, i, d))
        for n, i, d in sorted(found):
            if not any(doc_used[d : d - n]) and not any(item_used[i : i - n]):
                doc_used[d : d - n] = item_used[i : i - n] = [True] * -n
                tiles.append((d, i, -n))
        if found:
            continue  # what was hidden by a longer match may still hold one of this length
        if s <= seed:
            return tiles
        s = max(seed, s // 2)


class Block:
    """A block of benchmark items: their tokens as numbers, and the seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.first: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            t = [self.number.setdefault(w, len(self.number) + 1) for w in tokens_of(text.lower())]
            if not t:
                continue
            for k in {tuple(t[i : i + SEED]) for i in range(max(1, len(t) - SEED + 1))}:
                self.first[k].append(len(self.items))
            self.items.append((item_id, t))
        self.seeds = {k for k in self.first if len(k) == SEED}
        self.whole = {k for k in self.first if len(k) < SEED}

    def leaks(self, text: str) -> list[tuple]:
        number = self.number
        doc = [number.get(w, 0) for w in tokens_of(text.lower())]
        met = set(zip(doc, doc[1:], doc[2:], doc[3:], doc[4:])) & self.seeds
        for n in {len(k) for k in self.whole}:
            met |= {k for k in zip(*(doc[i:] for i in range(n)))} & self.whole
        out = []
        for at in sorted({i for k in met for i in self.first[k]}):
            item_id, item = self.items[at]
            tiles = tile(doc, item)
            out.append((item_id, sum(n for _, _, n in tiles) / len(item), tiles))
        return out


def item_blocks(spark: SparkSession, benchmark: DataFrame) -> list:
    """Broadcasts of the different items, in blocks of bounded size."""
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) * 2 + 1
    own = [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items for b in range(blocks)]
    return [spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in i.collect()]) for i in own]


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item of which it holds ``coverage`` or more: doc_id, item_id, coverage, n_tiles, longest_tile, tiles.

    Repeated rows of one document give repeated results.
    """
    find_package(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.union, [rows.mapInArrow(_pass(shared, coverage), _RESULT) for shared in item_blocks(docs.sparkSession, benchmark)])


def _pass(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), kind]
        names = ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "tiles"]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for item_id, share, tiles in block.leaks(text.as_py()):
                    if share >= coverage:
                        spans = [{"doc_start": d, "item_start": i, "length": n} for d, i, n in sorted(tiles)]
                        out.append((doc_id.as_py(), item_id, share, len(tiles), max(n for *_, n in tiles), spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows whose text holds an item; rows without a text stay. Each row is judged by its own text, where it lies: no shuffle."""
    flag = free_name(docs, "holds_item")
    for shared in item_blocks(docs.sparkSession, benchmark):
        docs = map_text(docs, "text", [(flag, "boolean")], _holds(shared, coverage)).filter(~F.col(flag)).drop(flag)
    return docs


def _holds(shared, coverage: float):
    blocks: list[Block] = []

    def make(texts: list[str | None]) -> list:
        if not blocks:
            blocks.append(Block(shared.value))
        return [[t is not None and any(share >= coverage for _, share, _ in blocks[0].leaks(t)) for t in texts]]

    return make
