"""Piecewise-linear segmentation of annual pixel series, after Kennedy et al. (2010).

One shuffle brings the years of a pixel together as a short array; pixels of a batch with equally many years are stacked to one matrix, and
every step is an array operation on all of them: spikes are dampened, the year farthest from the polyline becomes a vertex, vertices are culled by the
flattest angle into a nested family of models, and all models are fitted and scored.

A model is fitted twice: point to point through its vertices, and by anchored regression, a least-squares line in the first segment and then in each
segment the least-squares slope from the end of the one before. The fit with the smaller squared error counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PX = ["row", "col"]


class Params(NamedTuple):
    """Published control parameters; spikes, recovery and p-values as in the method's paper."""

    max_segments: int = 9
    spike_threshold: float = 0.9
    vertex_overshoot: int = 3
    prevent_one_year_recovery: bool = True
    recovery_threshold: float = 0.75
    pval_threshold: float = 0.05
    best_model_proportion: float = 0.75
    min_observations: int = 6


def _p_of_f(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Upper tail of the F distribution: incomplete beta by its continued fraction, all rows at once."""
    from math import lgamma

    if not len(f):
        return np.zeros(0)
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log_gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
    front = np.where(x <= 0, 0.0, front)
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / (1 + term * d), 1 + term / c
            h = h * d * c
    p = front * h
    return np.where(flip, 1 - p, p)


def despike(v: np.ndarray, threshold: float) -> np.ndarray:
    """Replace a year standing out from two similar neighbours by their mean."""
    out = v.copy()
    before, here, after = v[:, :-2], v[:, 1:-1], v[:, 2:]
    size = np.maximum(np.abs(here - before), np.abs(here - after))
    with np.errstate(all="ignore"):
        spike = 1 - np.abs(after - before) / size
    out[:, 1:-1] = np.where(spike > threshold, (before + after) / 2, here)
    return out


def _around(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the nearest marked place strictly before (-1: none) and strictly after (the length: none)."""
    n = mark.shape[1]
    at = np.arange(n)
    upto = np.maximum.accumulate(np.where(mark, at, -1), axis=1)
    onward = np.minimum.accumulate(np.where(mark, at, n)[:, ::-1], axis=1)[:, ::-1]
    none = np.full((len(mark), 1), -1)
    return np.hstack([none, upto[:, :-1]]), np.hstack([onward[:, 1:], none + n + 1])


def _take(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, np.clip(at, 0, x.shape[1] - 1), axis=1)


def _between(t: np.ndarray, v: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The polyline through the marked places, of which the first and last are."""
    a, b = _around(mark)
    ta, tb, va, vb = _take(t, a), _take(t, b), _take(v, a), _take(v, b)
    with np.errstate(all="ignore"):
        line = va + (vb - va) * (t - ta) / (tb - ta)
    return np.where(mark, v, line)


def candidate_vertices(t: np.ndarray, v: np.ndarray, p: Params) -> np.ndarray:
    """Insert the year farthest from the current polyline (the earliest on ties), one per round, starting from the two end years."""
    mark = np.zeros(v.shape, bool)
    mark[:, [0, -1]] = True
    for _ in range(p.max_segments - 1 + p.vertex_overshoot):
        off = np.where(mark, 0.0, np.abs(v - _between(t, v, mark)))
        best = off.argmax(axis=1)
        rows = np.flatnonzero(off.max(axis=1) > 0)
        if not len(rows):
            break
        mark[rows, best[rows]] = True
    return mark


def model_sizes(t: np.ndarray, v: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Of each vertex the smallest model, counted in segments, that still uses it (elsewhere a number beyond all models).

    The vertex with the flattest angle goes first, the earliest on ties.
    """
    tall = np.maximum(v.max(axis=1) - v.min(axis=1), 1e-9)[:, None]
    wide = (t[:, -1] - t[:, 0])[:, None]
    segments, live = np.where(mark, 1, 1 << 20), mark.copy()
    inner = np.ones(v.shape, bool)
    inner[:, [0, -1]] = False
    while True:
        rows = np.flatnonzero((live & inner).any(axis=1))
        if not len(rows):
            return segments
        a, b = _around(live)
        with np.errstate(all="ignore"):
            rise = np.arctan(((v - _take(v, a)) / tall) / ((t - _take(t, a)) / wide))
            on = np.arctan(((_take(v, b) - v) / tall) / ((_take(t, b) - t) / wide))
        bend = np.where(live & inner, np.abs(on - rise), np.inf)
        out = bend.argmin(axis=1)[rows]
        segments[rows, out] = live.sum(axis=1)[rows] - 1
        live[rows, out] = False


def anchored(t: np.ndarray, v: np.ndarray, vertex: np.ndarray) -> np.ndarray:
    """Least-squares line in the first segment, then the least-squares slope from the end before. ``vertex``: places (rows x segments + 1)."""
    at, fit = np.arange(v.shape[1]), np.zeros(v.shape)
    end = None
    for j in range(vertex.shape[1] - 1):
        a, b = vertex[:, [j]], vertex[:, [j + 1]]
        m = (at >= a) & (at <= b)
        if end is None:
            n = m.sum(axis=1, keepdims=True)
            mt, mv = (t * m).sum(axis=1, keepdims=True) / n, (v * m).sum(axis=1, keepdims=True) / n
            slope = (m * (t - mt) * (v - mv)).sum(axis=1, keepdims=True) / (m * (t - mt) ** 2).sum(axis=1, keepdims=True)
            line = mv + slope * (t - mt)
        else:
            t0 = np.take_along_axis(t, a, axis=1)
            slope = (m * (t - t0) * (v - end)).sum(axis=1, keepdims=True) / (m * (t - t0) ** 2).sum(axis=1, keepdims=True)
            line = end + slope * (t - t0)
            m &= at > a
        fit = np.where(m, line, fit)
        end = np.take_along_axis(line, b, axis=1)
    return fit


def fit_stack(t: np.ndarray, raw: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(fitted, is_vertex) of series with equally many years, two at least."""
    v = despike(raw, p.spike_threshold)
    sizes = model_sizes(t, v, candidate_vertices(t, v, p))
    rows, years = v.shape
    mean = v.mean(axis=1, keepdims=True)
    sst = ((v - mean) ** 2).sum(axis=1)
    found = []
    for k in range(1, p.max_segments + 1):
        mark = sizes <= k
        here = np.flatnonzero(mark.sum(axis=1) == k + 1)
        if not len(here) or years - k - 1 <= 0:
            continue
        tk, vk, mk = t[here], v[here], mark[here]
        vertex = np.nonzero(mk)[1].reshape(len(here), k + 1)
        fits = np.stack([_between(tk, vk, mk), anchored(tk, vk, vertex)])
        errors = ((vk - fits) ** 2).sum(axis=2)
        pick = errors.argmin(axis=0)
        fit, sse = fits[pick, np.arange(len(here))], errors.min(axis=0)
        at = np.take_along_axis(fit, vertex, axis=1)
        fall, gap = at[:, :-1] - at[:, 1:], np.diff(np.take_along_axis(tk, vertex, axis=1))
        fast = (np.maximum(fall, 0) / gap).max(axis=1) > p.recovery_threshold * (vk.max(axis=1) - vk.min(axis=1))
        one_year = ((fall > 0) & (gap == 1)).any(axis=1) & p.prevent_one_year_recovery
        whole, d1, d2 = sst[here], np.full(len(here), float(k)), np.full(len(here), float(years - k - 1))
        with np.errstate(all="ignore"):
            ratio = np.nan_to_num((whole - sse) / d1 / (sse / d2), nan=0.0, posinf=0.0, neginf=0.0)
        chance = np.where(sse <= 1e-9 * np.maximum(whole, 1.0), np.where(whole > 0, 0.0, 1.0), _p_of_f(ratio, d1, d2))
        ok = (~fast & ~one_year) | (k == 1)
        found.append((k, here[ok], chance[ok], fit[ok], mk[ok]))
    best = np.full(rows, np.inf)
    for _, here, chance, _, _ in found:
        best[here] = np.minimum(best[here], chance)
    fitted, vertex = np.repeat(mean, years, axis=1), np.zeros(v.shape, bool)
    vertex[:, [0, -1]] = True
    for _, here, chance, fit, mark in found:  # the largest good model is written last
        good = (chance <= (2 - p.best_model_proportion) * best[here]) & (chance <= p.pval_threshold)
        fitted[here[good]], vertex[here[good]] = fit[good], mark[good]
    return fitted, vertex


def segment(series: DataFrame, value: str, p: Params = Params()) -> DataFrame:
    """(row, col, yr, raw, fitted, is_vertex) for every pixel with enough years; values of one pixel and year are averaged.

    The model kept is the one with most segments whose p-value is within the allowed factor of the best. A pixel
    whose best p-value misses the threshold gets a flat line at its mean.
    """
    years = series.select(*PX, "yr", F.col(value).cast("double").alias("raw")).dropna().repartition(*PX)
    years = years.groupBy(*PX, "yr").agg(F.avg("raw").alias("raw"))
    stacked = years.groupBy(*PX).agg(F.array_sort(F.collect_list(F.struct("yr", "raw"))).alias("s"))
    stacked = stacked.filter(F.size("s") >= max(p.min_observations, 2)).select(*PX, F.col("s.yr").cast("array<double>").alias("yr"), F.col("s.raw").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            years, raw = batch.column(2), batch.column(3)
            size, ends = np.asarray(years.value_lengths()), np.asarray(years.offsets)
            t, v = np.asarray(years.values), np.asarray(raw.values)
            fitted, vertex = np.zeros(len(v)), np.zeros(len(v), bool)
            for n in np.unique(size):
                place = ends[:-1][size == n][:, None] + np.arange(n)
                fitted[place], vertex[place] = fit_stack(t[place], v[place], p)
            lists = [pa.ListArray.from_arrays(years.offsets, pa.array(x)) for x in (fitted, vertex)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "fitted", "is_vertex"])

    types = dict(stacked.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in stacked.columns] + ["fitted array<double>", "is_vertex array<boolean>"])
    fits = stacked.mapInArrow(run, schema)
    each = fits.select(*PX, F.explode(F.arrays_zip("yr", "raw", "fitted", "is_vertex")).alias("s"))
    return each.select(*PX, F.col("s.yr").cast(dict(series.dtypes)["yr"]).alias("yr"), "s.raw", "s.fitted", "s.is_vertex")
