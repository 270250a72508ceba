"""Byte-pair encoding and decoding with a public word-end vocabulary, by a contiguous rank array per word.

A word is a list of parts and a list of the ranks of adjacent parts. The smallest rank is found by a scan, its boundary
deleted and the two neighbouring ranks refreshed. Parts of one long unbroken run would make that quadratic, so above
``SHORT`` symbols the same merges are taken from a heap.

Null and empty texts have no ids and decode to the empty string. Special tokens written in a text are taken as such, as the
tokenizers library does by default. Repeated rows and further columns pass through; a clashing column is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rasterloom.llm.common import map_text

SHORT = 64
#: Words remembered by a worker.
CACHE_WORDS = 300_000
NONE = 1 << 30

#: Pre-tokens of the vocabulary file (fixed by that file).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
#: Separators that str.split() takes for white space and the vocabulary does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for a, b in model["merges"]:
            self.rank[vocab[a], vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            parts = [self.inner[b] for b in data[:-1]]
            parts.append(self.last[data[-1]])
            ids = tuple(self.scan(parts) if len(parts) <= SHORT else self.heap(parts))
            if len(parts) <= SHORT:
                if len(self.pieces) >= CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def scan(self, parts: list[int]) -> list[int]:
        rank, made = self.rank, self.made
        ranks = [rank.get(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), NONE)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges (least rank, leftmost first) in n log n."""
        rank, made, n = self.rank, self.made, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (pair := (parts[x], parts[y])) in rank:
                    heapq.heappush(queue, (rank[pair], x, *pair))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a run without white space. Letters are lowered one by one, so a final sigma is an ordinary one."""
        if word.isascii() and word.isalpha():
            return self.piece(word.lower())
        plain = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return tuple(chain.from_iterable(map(self.piece, PRETOKEN.findall(plain))))

    def words(self, text: str) -> list[int]:
        words = SPACE.split(text) if NOT_SPACE.search(text) else text.split()
        cache = self.cache
        if new := set(words).difference(cache):
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = self.word(w)
        return list(chain.from_iterable([cache[w] for w in words]))

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or "<|" not in text:
            return self.words(text)
        parts = self.split_special.split(text)
        return list(chain.from_iterable([self.special[p]] if i % 2 else self.words(p) for i, p in enumerate(parts)))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        token = self.token
        return " ".join([token[i] for i in ids])


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoded(path: str, texts: list[str | None]) -> list:
    bpe = load(path)
    return [_lists([np.array(bpe.encode(t or ""), dtype=np.int32) for t in texts])]


def _both(path: str, texts: list[str | None]) -> list:
    bpe = load(path)
    ids, decoded = [], []
    for t in texts:
        own = bpe.encode(t or "")
        decoded.append(bpe.decode(own))
        ids.append(np.array(own, dtype=np.int32))
    return [_lists(ids), decoded]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.array([], np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Adds ``token_ids`` array<int> alone."""
    return map_text(df, column, [("token_ids", "array<int>")], partial(_encoded, path or default_path()), 1_000_000)


def encode_decode(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Adds ``token_ids`` array<int> and ``decoded`` string. No shuffle; one pass over whole texts in bounded chunks."""
    return map_text(df, column, [("token_ids", "array<int>"), ("decoded", "string")], partial(_both, path or default_path()), 1_000_000)

