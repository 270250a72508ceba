"""Quality score by Bradley-Terry pairwise ranking.

A preference pair is a good and a bad labelled text; the model learns weights so that the good one's score is higher, by logistic
loss on the difference of their features (Newton steps with a ridge). The score of a text is then weights times features. The
threshold is a quantile of the training scores: the share of bad labels. A logistic curve maps scores to 0..1 so that the
threshold falls on 0.3.

At most ``MAX_TRAIN`` labelled texts are used, taken by a hash of the whole row within each label, and ``PAIRS`` partners for each text of the rarer label; every text is
scored whole. Null and empty texts have the features of an empty text. Equal texts have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import bounded_sample, free_name, map_text, sampled

MAX_TRAIN = 40_000
PAIRS = 8
RIDGE = 1e-3
CUT = 0.3
SIGNS = "#*$%&|<>!?.,:;-_/\\@=+(){}[]\"'"


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; ``CUT`` at the threshold."""
        s = ((x - self.mean) / self.scale) @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut) + np.log(CUT / (1 - CUT)), -700, 700)))


def features(text: str | None) -> np.ndarray:
    """Ratios of signs, letters, words and lines of a text."""
    text = text or ""
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    m = max(1, len(lines))
    upper = byte[65:91].sum()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    many = max(map(words.count, words[:1]), default=0) if n < 2 else _top(words)
    ratios = [byte[ord(c)] / n for c in SIGNS]
    ratios += [upper / chars, byte[97:123].sum() / chars, byte[48:58].sum() / chars, byte[128:].sum() / chars, byte[10] / n]
    ratios += [1 - len(set(lines)) / m, distinct / n, many / n, (lengths == 1).mean(), (lengths > 20).mean(), (lengths > 40).mean()]
    logs = [np.log1p(len(words)), np.log1p(chars / n), np.log1p(lengths.max()), np.log1p(n / m), np.log(distinct + 1) / np.log(n + 1.0), float(not words)]
    return np.concatenate([np.sqrt(ratios), logs])


def _top(words: list[str]) -> int:
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    return max(count.values())


def _features(texts: list[str | None]) -> list:
    return [pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))]


def _score(ranker: Ranker, texts: list[str | None]) -> list:
    x = np.stack([features(t) for t in texts])
    score = ranker.score(x)
    return [score, (score >= CUT).astype(np.int32)]


def _good(ranker: Ranker, texts: list[str | None]) -> list:
    return [_score(ranker, texts)[1] == 1]


def fit(
    docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", column: str = "text", label: str = "quality", max_train: int = MAX_TRAIN
) -> Ranker:
    """Ranker from the texts of ``docs`` with a label 0 or 1 in ``labels`` (or, without that table, in ``docs``). The features of the bounded sample meet in the driver.

    Without a label of either kind every text scores alike.
    """
    # each label keeps its share: the threshold is a quantile at the share of bad labels
    known = (docs if labels is None else labels).filter(F.col(label).isin(0, 1))
    rows = bounded_sample(known, label, max_train, 0.0) if labels is None else sampled(docs.select(key, column), known, key, label, max_train, 0.0)
    rows = rows.select(F.col(label).cast("int").alias("label"), F.col(column).cast("string").alias("text"))
    got = map_text(rows, "text", [("x", "array<double>")], _features).select("label", "x").toPandas()
    width = len(features(None))
    x = np.array(got["x"].tolist(), float).reshape(-1, width)
    order = np.lexsort(x.T)  # results do not depend on the order in which rows arrive
    x, y = x[order], got["label"].to_numpy()[order]
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(width), 0.0, 0.0)
    pick = np.random.default_rng(1)
    pairs = PAIRS * min(len(good), len(bad))
    diff = good[partners(pick, len(good), pairs)] - bad[partners(pick, len(bad), pairs)]
    weight = np.zeros(width)
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(diff @ weight, -500, 500)))  # chance that the bad one wins
        slope = diff.T @ p / len(diff) - RIDGE * weight
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, slope)
        weight += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = z @ weight
    return Ranker(mean, scale, weight, _threshold(s, y), 1.0)


def partners(pick: np.random.Generator, n: int, count: int) -> np.ndarray:
    """``count`` places below ``n``, drawn from the whole range; each is taken once before any is taken again."""
    return np.concatenate([pick.permutation(n) for _ in range(-(-count // n))])[:count]


def _threshold(s: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the scores at the share of bad labels, halfway to the next score above."""
    ranked, k = np.sort(s), int((y == 0).sum())
    return float((ranked[k - 1] + ranked[min(k, len(ranked) - 1)]) / 2)


def score(df: DataFrame, ranker: Ranker, column: str = "text") -> DataFrame:
    """Adds ``score`` (0..1, higher is better) and ``predicted`` (1 from ``CUT``). No shuffle."""
    return map_text(df, column, [("score", "double"), ("predicted", "int")], partial(_score, ranker))


def keep_good(docs: DataFrame, ranker: Ranker, column: str = "text") -> DataFrame:
    """``docs`` without the rows predicted as bad. Each row is judged by its own text, where it lies: no shuffle."""
    flag = free_name(docs, "is_good")
    return map_text(docs, column, [(flag, "boolean")], partial(_good, ranker)).filter(F.col(flag)).drop(flag)
