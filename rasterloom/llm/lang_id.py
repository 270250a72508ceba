"""Language of a text: scripts narrow the candidates, word scores choose, and Viterbi labels spans of mixed text.

A model holds, for each language, the log chance of hashed letter 1- to 3-grams of words (word borders included) and the scripts
its training texts use. A word is scored for the languages that use its script; a path over the words pays
``SWITCH`` for each change of language. The language with most letters on the best path is the prediction.

The model is fitted on at most ``MAX_TRAIN`` labelled texts, taken by a hash of the whole row; half of the room is shared out evenly
among the languages, so a rare one is not lost; every text is scored whole.
Null texts and texts without letters are ``und`` with score 0. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import bounded_sample, find_package, map_text, sampled

MAX_TRAIN = 20_000
BUCKETS = 1 << 16
SWITCH = 12.0
#: A script counts as a language's own from this share of its letters.
OWN_SCRIPT = 0.01
UNDETERMINED = "und"

# First code points of script blocks (Unicode charts) up to the next entry's; "" is no script of its own.
SCRIPTS = [
    (0x0000, ""), (0x0041, "Latin"), (0x0250, "Latin"), (0x0300, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""),
    (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"),
    (0xA000, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, ""), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x32000, ""),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_PLACES = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # BUCKETS x languages, log chance
    scripts: np.ndarray  # scripts x languages, bool


@dataclass
class Words:
    """The words of some texts: distinct words, and for each text its words' places among them."""

    distinct: list[str]
    places: np.ndarray
    ends: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    lower = pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))
    split = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\pL\pM]+", " "), " "), " ")
    flat = split.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Words(flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all grams, the word of each, and script and word of each letter."""
    c = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = c == 1
    word = np.cumsum(edge) - 1
    own = ~edge
    parts = [(c, own, word)]
    two = c[:-1] * np.uint64(0x1F35A7BD3) + c[1:]
    # a border counts for the word after it, so a pair or triple belongs to the word of its first or middle letter
    parts.append((two ^ np.uint64(0x51), own[:-1] | own[1:], word[:-1]))
    three = two[:-1] * np.uint64(0x2545F4914F6CDD1D) + c[2:]
    parts.append((three ^ np.uint64(0xA3), own[1:-1], word[1:-1]))
    bucket = np.concatenate([((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))[m] for h, m, _ in parts]).astype(np.int64)
    of = np.concatenate([w[m] for _, m, w in parts])
    letters = c[own].astype(np.int64)
    script = _PLACES[np.searchsorted(_STARTS, letters, side="right") - 1]
    return bucket, of, script, word[own]


def fit(labelled: DataFrame, column: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN, key: str | None = None) -> Model:
    """Model from rows with a text and a language, drawn by their key, or without one by the whole row: one histogram per language leaves each task."""
    find_package(labelled.sparkSession)
    known = labelled.filter(F.col(lang).isNotNull() & F.col(column).isNotNull())
    if key is None:
        rows = bounded_sample(known, lang, max_train, 0.5)
    else:
        rows = sampled(known.select(key, column), known.select(key, lang).distinct(), key, lang, max_train, 0.5)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(column).cast("string").alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).to_pylist()
            for x in set(langs):
                w = words_of([texts[i] for i in np.flatnonzero(langs == x)])
                if not any(w.distinct):
                    continue
                bucket, of, script, at = grams_of(w.distinct)
                times = np.bincount(w.places, minlength=len(w.distinct))
                got = grams.setdefault(x, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                got[:BUCKETS] += np.bincount(bucket, times[of], BUCKETS).astype(np.int64)
                got[BUCKETS:] += np.bincount(script, times[at], len(SCRIPT_NAMES)).astype(np.int64)
        for x, got in grams.items():
            used = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(got[used])], names=["lang", "place", "n"])

    counts = rows.mapInArrow(tally, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    table[counts["place"], counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)] = counts["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    chance = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)) if len(langs) else grams
    return Model(langs, chance.astype(np.float32), scripts >= OWN_SCRIPT * np.maximum(scripts.sum(axis=0), 1))


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log chance of each word by language, relative to its best; languages that do not write its script are ruled out."""
    bucket, of, script, at = grams_of(words)
    score = np.stack([np.bincount(of, model.grams[bucket, k], len(words)) for k in range(len(model.langs))], axis=1)
    used = np.zeros((len(words), len(SCRIPT_NAMES)), bool)
    used[at, script] = True
    used[:, SCRIPT_NAMES.index("")] = False
    may = np.ones(score.shape, bool)
    for s in range(len(SCRIPT_NAMES)):
        may[used[:, s]] &= model.scripts[s]
    none = ~may.any(axis=1)
    may[none] = True
    score[none] = 0.0  # a script that no language has says nothing
    score[~may] = -1e4
    return score - score.max(axis=1, keepdims=True)


def paths(score: np.ndarray, start: np.ndarray, length: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word of many texts, whose words lie at ``start``; all texts move one word a step."""
    k = score.shape[1]
    label = np.zeros(len(score), np.int16)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    stay, top = np.ones((len(score), k), bool), np.zeros(len(score), np.int16)
    value = score[start]
    for t in range(1, int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, side="left"))
        v, at = value[:live], start[:live] + t
        best = v.argmax(axis=1)
        moved = v[np.arange(live), best] - switch
        stay[at] = v >= moved[:, None]
        top[at] = best
        value[:live] = np.maximum(v, moved[:, None]) + score[at]
    now = value.argmax(axis=1) if len(length) else np.zeros(0, int)
    for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
        live = int(np.searchsorted(-length, -t, side="left"))
        at = start[:live] + t
        label[at] = now[:live]
        if t:
            now[:live] = np.where(stay[at, now[:live]], now[:live], top[at])
    return label


def _predict(model: Model, texts: list[str | None]) -> list:
    w = words_of(texts)
    n, k = len(texts), len(model.langs)
    if not k or not any(w.distinct):
        return [[UNDETERMINED] * n, [0.0] * n, [[] for _ in texts]]
    size = np.array([len(x) for x in w.distinct])
    score = word_scores(model, w.distinct)[w.places]
    size = size[w.places]
    doc = np.repeat(np.arange(n), np.diff(w.ends))
    total = np.stack([np.bincount(doc, score[:, j], n) for j in range(k)], axis=1)
    label = total.argmax(axis=1)[doc].astype(np.int16)
    # Where no run of words gains more than half a switch by another language, no change of language pays: such a text
    # keeps its best language and needs no path.
    mixed = np.zeros(n, bool)
    for i in range(n):
        own = score[w.ends[i] : w.ends[i + 1]]
        rise = np.cumsum(own - own[:, total[i].argmax(), None], axis=0)
        if len(rise):
            mixed[i] = (np.vstack([np.zeros(k), rise]) - np.minimum.accumulate(np.vstack([np.zeros(k), rise]), axis=0)).max() > SWITCH / 2
    if mixed.any():
        which = np.flatnonzero(mixed)
        found = paths(score, w.ends[which], np.diff(w.ends)[which])
        inside = mixed[doc]
        label[inside] = found[inside]
    letters = np.stack([np.bincount(doc, size * (label == j), n) for j in range(k)], axis=1)
    best, have = letters.argmax(axis=1), letters.sum(axis=1)
    # marks count as parts of words, but a text of marks alone has no letter
    lettered = pc.match_substring_regex(pa.array([t or "" for t in texts], pa.string()), r"\pL").to_pylist()
    langs, shares, spans = [], [], []
    for i in range(n):
        if not have[i] or not lettered[i]:
            langs.append(UNDETERMINED)
            shares.append(0.0)
            spans.append([])
            continue
        own = label[w.ends[i] : w.ends[i + 1]]
        cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        langs.append(model.langs[best[i]])
        shares.append(float(letters[i, best[i]] / have[i]))
        spans.append([{"lang": model.langs[own[a]], "start": int(a), "end": int(b)} for a, b in zip(cut, cut[1:])])
    return [langs, shares, spans]


def predict(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (share of letters on the path that are of that language) and ``spans`` (lang, start, end in words)."""
    fields = [("lang_pred", "string"), ("score", "double"), ("spans", "array<struct<lang:string,start:int,end:int>>")]
    return map_text(df, column, fields, partial(_predict, model), 2_000_000)
