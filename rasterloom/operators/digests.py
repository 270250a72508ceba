"""MD5 of many short messages at once, on columns of words: the digests of Spark's ``md5`` and of ``hashlib``.

Messages of one call have the same length: a common prefix, the bytes of ``body`` (a row per byte place, a column per message) and a common suffix.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages that go through the rounds together, so that their words stay in the cache; fewer than ``FEW`` are not worth the rounds.
CHUNK, FEW = 8192, 400


def md5(prefix: bytes, body: np.ndarray, suffix: bytes = b"") -> np.ndarray:
    """The four little-endian words of each digest, a row each."""
    width, n = body.shape
    if n < FEW:
        flat, done = np.ascontiguousarray(body.T).tobytes(), []
        for i in range(n):
            done.append(hashlib.md5(prefix + flat[i * width : (i + 1) * width] + suffix).digest())
        return np.frombuffer(b"".join(done), "<u4").reshape(n, 4).T
    length = len(prefix) + width + len(suffix)
    frame = bytearray((length + 9 + 63) // 64 * 64)
    frame[: len(prefix)] = prefix
    frame[len(prefix) + width : length] = suffix
    frame[length] = 0x80
    frame[-8:] = (8 * length).to_bytes(8, "little")
    plain = np.frombuffer(bytes(frame), "<u4").tolist()
    out = np.empty((4, n), np.uint32)
    for start in range(0, n, CHUNK):
        words = list(plain)
        for i, column in enumerate(body[:, start : start + CHUNK]):
            word, place = divmod(len(prefix) + i, 4)
            words[word] = column.astype(np.uint32) << np.uint32(8 * place) | words[word]
        state = [np.full(min(CHUNK, n - start), v, np.uint32) for v in _BEGIN]
        for block in range(0, len(words), 16):
            state = [x + y for x, y in zip(state, _rounds(*state, words[block : block + 16]))]
        out[:, start : start + CHUNK] = state
    return out


def _rounds(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, words: list) -> tuple:
    for i in range(64):
        if i < 16:
            f, at = c ^ d, i
            f &= b
            f ^= d
        elif i < 32:
            f, at = b ^ c, (5 * i + 1) % 16
            f &= d
            f ^= c
        elif i < 48:
            f, at = b ^ c, (3 * i + 5) % 16
            f ^= d
        else:
            f, at = ~d, 7 * i % 16
            f |= b
            f ^= c
        f += a
        if isinstance(words[at], int):
            f += np.uint32((_ADDED[i] + words[at]) & 0xFFFFFFFF)
        else:
            f += words[at]
            f += np.uint32(_ADDED[i])
        turn = _TURNS[i // 16][i % 4]
        high = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return a, b, c, d


def by_length(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The texts dealt by their number of bytes: their places, and their bytes as a ``body``."""
    texts = texts.cast(pa.large_string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = []
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        out.append((places, data[ends[places][None, :] + np.arange(size)[:, None]]))
    return out
