"""The registered text queries: each operator over its whole table, reduced to the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import (
    bpe, context_mixing, decontam, hash_neighbours, html_text, lang_id, lexical_search, near_dup, quality_rank, quality_rules, resample,
    secret_scan, trie_tokens,
)
from rasterloom.llm.common import fold, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, with the item."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the decoded text."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class, its equal copies, and how many pairs with its text were verified (not all its links)."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages; texts of fold 2 of 4 take no part in the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold("doc_id", 4).alias("fold"))
    model = lang_id.fit(docs.filter("fold <> 2"), key="doc_id")
    return lang_id.predict(docs.select("doc_id", "text", (F.col("fold") == 2).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores; labels of fold 0 of 5 take no part in the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold("doc_id", 5).alias("fold"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    ranker = quality_rank.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    return quality_rank.score(docs.select("doc_id", "text", (F.col("fold") == 0).alias("held_out")), ranker).select("doc_id", "held_out", "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores; fold 2 of 7 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = context_mixing.score(docs, fold("doc_id", 7) != 2)
    held = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = trie_tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_tokens", "n_pretokens", "n_distinct_pretokens")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and the ranks of the tenth that is drawn."""
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return hash_neighbours.neighbours(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_bpe, op3_html_text, op4_near_dup, op5_secrets,
        op6_language, op7_quality, op8_quality_rules, op9_context_mixing, op10_token_counts,
        op11_lexical_search, op12_resample, op13_hash_neighbours,
    )
}

ORACLES: dict[str, str] = {"op8_quality_rules": quality_rules.sql(), "op11_lexical_search": lexical_search.sql(), "op12_resample": resample.sql()}
