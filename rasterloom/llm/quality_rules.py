"""Quality rules: a table of thresholds on ratios, compiled into one Spark projection without user functions.

Counts of words, symbols, repeated lines and repeated three-word windows come from array expressions; the rules are rows of
``RULES``. A null or empty text has no words and fails. Repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WHITE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Common function words of the corpus's languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "der die das und ist nicht mit von zu ein eine den dem des sich auf für im als auch es an werden aus er hat dass sie nach wird "
    "le la les de des et en un une est que qui dans pour pas sur au par plus ne se ce il elle avec son sa ses "
    "el los las del y que en un una es por con para no se su al lo como más"
).split()

#: As they stand in running text.
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})

#: (measure, least, most): a document is kept if each measure lies between its bounds; None is no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 30.0),
    ("symbols_per_word", None, 0.5),
    ("dup_line_share", None, 0.5),
    ("stop_word_share", 0.01, None),
    ("bar_line_share", None, 0.5),
]
MEASURES = [m for m, _, _ in RULES]


def _places(windows: str, most: Column) -> Column:
    """Starts of windows that occur twice or more, in order, from (hash, start) in order of hash."""
    follow = F.slice(F.col(windows), F.lit(2), most)
    twins = F.zip_with(F.col(windows), follow, lambda a, b: F.when(a["_qr_hash"] == b["_qr_hash"], F.array(a["1"], b["1"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))


def measure(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures of ``RULES``.

    Each step is a projection on the one before, so that no array is built twice. Windows are compared by 64-bit hashes.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    text, words, lines, of_word, of_window, places = (F.col(f"_qr_{h}") for h in ("text", "words", "lines", "hashes", "hash", "places"))
    out = df.select(*kept, F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("_qr_text"))
    bare = F.btrim(text, F.lit(WHITE))
    out = out.select(
        "*",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT)).alias("_qr_words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("_qr_lines"),
    )
    n = F.size(words)
    some = F.greatest(n, F.lit(1))
    out = out.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias("_qr_hashes"))
    both = F.zip_with(F.slice(of_word, F.lit(2), some), F.slice(of_word, F.lit(3), some), lambda b, c: F.xxhash64(b, c))
    three = F.zip_with(of_word, both, lambda a, bc: F.xxhash64(a, bc))
    out = out.select("*", F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("_qr_hash"))
    # only a text in which a window repeats is sorted
    sorted_ = F.sort_array(F.arrays_zip(of_window, F.sequence(F.lit(1), F.size(of_window))))
    none = F.array().cast("array<struct<_qr_hash:bigint,`1`:int>>")
    out = out.select("*", F.when(F.size(F.array_distinct(of_window)) < F.size(of_window), sorted_).otherwise(none).alias("_qr_windows"))
    out = out.select("*", _places("_qr_windows", some).alias("_qr_places"))
    gaps = F.zip_with(places, F.slice(places, F.lit(2), some), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    symbols = F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0))
    out = out.select(
        "*",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda a, g: a + g).cast("bigint").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))).alias("_qr_stops"),
        F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))).alias("_qr_bars"),
        F.size(lines).alias("_qr_n_lines"),
    )
    per_word, per_line = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("_qr_n_lines"), F.lit(1)).cast("double")
    return out.select(
        *kept,
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / per_word).alias("mean_word_chars"),
        (F.col("n_symbols") / per_word).alias("symbols_per_word"),
        (F.col("n_dup_lines") / per_line).alias("dup_line_share"),
        (F.col("_qr_stops") / per_word).alias("stop_word_share"),
        (F.col("_qr_bars") / per_line).alias("bar_line_share"),
    )


def base_failed() -> Column:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def passes(rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    bounds = [F.col(m) >= low for m, low, _ in rules if low is not None] + [F.col(m) <= high for m, _, high in rules if high is not None]
    return reduce(Column.__and__, bounds, F.lit(True))


def judge(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the counts, the measures, ``base_failed`` and ``kept``."""
    df = measure(df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("base_failed", "kept")]), column)
    return df.select("*", base_failed().alias("base_failed"), (~base_failed() & passes()).alias("kept"))


def sql(source: str = "documents") -> str:
    """The digest of ``judge`` in DuckDB SQL, written from the definitions, not from the expressions above."""
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    bounds = " AND ".join([f"{m} >= {low}" for m, low, _ in RULES if low is not None] + [f"{m} <= {high}" for m, _, high in RULES if high is not None])
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM {source}
), win AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), seen AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM win
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM seen WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({stops}))) AS stops, len(list_filter(l, lambda x: contains(x, '|'))) AS bars
  FROM d LEFT JOIN rep USING (rid)
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_per_word,
         n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share, stops / greatest(n_words, 1)::DOUBLE AS stop_word_share,
         bars / greatest(n_lines, 1)::DOUBLE AS bar_line_share
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {bounds} AS kept
FROM r
"""
