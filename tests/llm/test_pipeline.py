"""The pipeline: each stage's decisions take effect on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from rasterloom.llm import bpe, near_dup, quality_rank

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert 0 < out.count() <= docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    assert {"token_ids", "n_tokens"} <= set(docs.columns)
    got = docs.collect()
    left = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert all(i == c for i, c in left.items())
    own = bpe.load(bpe.default_path())
    assert all(own.encode(r["text"]) == r["token_ids"] for r in got)


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF).join(labels, "doc_id")
    assert kept.filter("quality = 1").count() >= 0.95 * docs.join(labels.filter("quality = 1"), "doc_id").count()


def test_texts_travel_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sent = []
    plain = type(docs).mapInArrow

    def noted(self, func, schema, *more, **named):
        sent.append([t for _, t in self.dtypes if "string" in t])
        return plain(self, func, schema, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    own = [t for _, t in docs.dtypes if t == "string"]
    for name in ("decontamination", "bpe"):
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert sent == [own] * 2
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality_rank.keep_good(docs, quality_rank.fit(docs, labels))
    sent.pop(-2)  # the features of the labelled texts
    assert sent == [own] * 3
    assert good.columns == docs.columns


def test_stages_keep_rows_and_columns(spark):
    rows = [(1, "a b", "x"), (1, "c d e", "y"), (2, None, "z"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, is_good string")
    zero = quality_rank.Ranker(*[quality_rank.np.zeros(len(quality_rank.features(None)))] * 3, 0.0, 0.0)
    zero.scale = zero.scale + 1
    assert sorted(map(str, quality_rank.keep_good(docs, zero).collect())) == sorted(map(str, docs.collect()))
    zero.cut, zero.slope = 1.0, 1.0
    assert quality_rank.keep_good(docs, zero).count() == 0
    both = bpe.encode_decode(docs).drop("decoded").collect()
    assert sorted(map(str, bpe.encode(docs).collect())) == sorted(map(str, both)) and len(both) == 4
