"""Secrets in text: named patterns, and random-looking tokens found by a battery of randomness tests.

A candidate token is a long unbroken run of letters, digits and ``+/_-``. For each encoding that its letters fit (hex, base32,
base64, letters and digits) three tests ask whether it could be random: chi-squared uniformity over the alphabet, runs above
and below the middle symbol, and serial correlation of neighbouring symbols. The three chances are joined by Bonferroni and the
best encoding counts. How surprising the same token would be as ordinary text is measured by its likelihood ratio against the
letter frequencies of all documents (an e-value, so 1/ratio bounds the chance). Both sides go through
Benjamini-Hochberg within strata of token length, over all candidates of the corpus: a token is a secret if text is
rejected for it and randomness is not. Cut-offs come from two small histograms, so no candidate is collected.

Null and empty texts have no spans. Spans are in code points, end exclusive. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import partial
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import find_package, map_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

# Alphabets of the encodings.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": LOWER.upper() + "234567",
    "lower36": DIGITS + LOWER,
    "upper36": DIGITS + LOWER.upper(),
    "alnum": DIGITS + LOWER + LOWER.upper(),
    "base64": LOWER.upper() + LOWER + DIGITS + "+/",
    "base64url": LOWER.upper() + LOWER + DIGITS + "-_",
}
PLACES = {k: {c: i for i, c in enumerate(sorted(v))} for k, v in ENCODINGS.items()}

#: Share of wrong decisions allowed on either side, and bins of -log10 of a chance.
FDR = 0.001
BINS, PER_UNIT = 400, 10
STRATA = 6


def stratum(n: int) -> int:
    """Length class: 20-31, 32-47, 48-63, 64-127, 128-255, longer."""
    return sum(n >= b for b in (32, 48, 64, 128, 256))


def chi2_tail(x: float, df: int) -> float:
    """Chance of a chi-squared value of x or more (Wilson and Hilferty's normal approximation)."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> float:
    """Chance that a random token of the best fitting encoding looks this uneven; 0 if no encoding fits."""
    body = token.rstrip("=")
    used, best = set(body), 0.0
    if len(used) < 2 or not any(c.isdigit() for c in used) or not any(c.isalpha() for c in used):
        return 0.0  # one class of letters only: a word or a number
    for place in PLACES.values():
        if not used <= place.keys():
            continue
        n, size = len(body), len(place)
        at = np.array([place[c] for c in body])
        count = np.bincount(at, minlength=size)
        p_even = chi2_tail(float(((count - n / size) ** 2).sum() * size / n), size - 1)
        high = at >= size / 2
        up, down = int(high.sum()), int((~high).sum())
        p_runs = 0.0
        if up and down:
            runs = 1 + int((high[1:] != high[:-1]).sum())
            mean = 1 + 2 * up * down / n
            var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
            p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
        spread = float(at.std())
        p_serial = 0.0
        if spread > 0:
            r = float(((at[1:] - at.mean()) * (at[:-1] - at.mean())).mean()) / spread**2
            p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
        best = max(best, min(1.0, 3 * min(p_even, p_runs, p_serial)))
    return best


def surprise(token: str, log_text: np.ndarray) -> float:
    """-log10 of a bound on the chance of this token as text: ratio of an even draw from its classes to text letters."""
    body = token.rstrip("=")
    size = sum(k for k, has in ((10, re.search("[0-9]", body)), (26, re.search("[a-z]", body)), (26, re.search("[A-Z]", body)), (2, re.search("[+/_-]", body))) if has)
    text = float(log_text[np.frombuffer(body.encode("ascii"), np.uint8)].sum())
    return max(0.0, (-len(body) * math.log(max(size, 2)) - text) / math.log(10))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the named patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _bin(x: float) -> int:
    return min(BINS - 1, int(x * PER_UNIT))


def _candidates(log_text: np.ndarray, texts: list[str | None]) -> list:
    out = []
    for t in texts:
        rows = []
        for m in CANDIDATE.finditer(t or ""):
            p = battery(m[0])
            if p > 0:
                rows.append({"stratum": stratum(len(m[0])), "text_bin": _bin(surprise(m[0], log_text)), "random_bin": _bin(-math.log10(max(p, 1e-300)))})
        out.append(rows)
    return [out]


class Taken:
    """Spans in order of their start, with the farthest end so far, so that one lookup tells whether any of them overlaps another span."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def _spans(log_text: np.ndarray, text_cut: list[int], random_cut: list[int], texts: list[str | None]) -> list:
    out = []
    for t in texts:
        t = t or ""
        spans = base_spans(t)
        taken = Taken([(a, b) for a, _, b in spans])
        for m in CANDIDATE.finditer(t):
            if taken.overlaps(m.start(), m.end()):
                continue
            p = battery(m[0])
            if p > 0:
                s = stratum(len(m[0]))
                if _bin(surprise(m[0], log_text)) >= text_cut[s] and _bin(-math.log10(max(p, 1e-300))) < random_cut[s]:
                    spans.append((m.start(), 3, m.end()))
        out.append([{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(spans)])
    return [out]


def step_up(counts: np.ndarray, q: float) -> int:
    """Benjamini-Hochberg on binned chances: the lowest bin of -log10(p) that is rejected (``BINS`` if none)."""
    total = counts.sum()
    at_least = np.cumsum(counts[::-1])[::-1]
    for b in range(BINS):
        if at_least[b] and 10 ** (-b / PER_UNIT) * total <= q * at_least[b]:
            return b
    return BINS


def letter_model(df: DataFrame, column: str) -> np.ndarray:
    """Log frequency of each ASCII character over all texts: one small row leaves each task."""
    find_package(df.sparkSession)

    def tally(batches):
        import pyarrow as pa

        got = np.zeros(128, np.int64)
        for batch in batches:
            for t in batch.column(0):
                got += np.bincount(np.frombuffer((t.as_py() or "").encode("ascii", "ignore"), np.uint8), minlength=128)
        yield pa.RecordBatch.from_pydict({"code": list(range(128)), "n": got.tolist()})

    rows = df.select(F.col(f"`{column}`").cast("string")).mapInArrow(tally, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(128)
    for r in rows:
        n[r["code"]] = r["n"]
    n[33:127] += 1  # printable characters that no text has
    return np.log(np.maximum(n, 1e-9) / n.sum()) if n.sum() else np.zeros(128)


def cutoffs(df: DataFrame, column: str, log_text: np.ndarray) -> tuple[list[int], list[int]]:
    found = map_text(df.select(F.col(f"`{column}`").alias("t")), "t", [("c", "array<struct<stratum:int,text_bin:int,random_bin:int>>")], partial(_candidates, log_text))
    rows = found.select(F.explode("c").alias("c")).groupBy("c.stratum", "c.text_bin", "c.random_bin").count().collect()
    text, rand = np.zeros((STRATA, BINS)), np.zeros((STRATA, BINS))
    for r in rows:
        text[r["stratum"], r["text_bin"]] += r["count"]
        rand[r["stratum"], r["random_bin"]] += r["count"]
    return [step_up(x, FDR) for x in text], [step_up(x, FDR) for x in rand]


def find_secrets(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``secrets`` array<struct<start, kind, end>>, in order of start.

    Three passes over the texts (letter counts, cut-offs, spans); only histograms are shuffled.
    """
    log_text = letter_model(df, column)
    text_cut, random_cut = cutoffs(df, column, log_text)
    return map_text(df, column, [("secrets", "array<struct<start:bigint,kind:string,end:bigint>>")], partial(_spans, log_text, text_cut, random_cut))


def redact(df: DataFrame, column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with each secret in ``column`` replaced by ``mask``; overlapping spans become one. Null stays null."""
    log_text = letter_model(df, column)
    masked = map_text(df, column, [(column, "string")], partial(_masked, mask, log_text, *cutoffs(df, column, log_text)))
    return masked.select(*[F.col(f"`{c}`") for c in df.columns])


def _masked(mask: str, log_text: np.ndarray, text_cut: list[int], random_cut: list[int], texts: list[str | None]) -> list:
    out = []
    for t, spans in zip(texts, _spans(log_text, text_cut, random_cut, texts)[0], strict=True):
        parts, at = [], 0
        for s in spans:
            if s["start"] >= at:
                parts += [t[at : s["start"]], mask]
            at = max(at, s["end"])
        out.append("".join([*parts, t[at:]]) if spans else t)
    return [out]
