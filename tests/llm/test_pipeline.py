"""The pipeline's stages, each on what the one before kept, and the whole."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tests.llm.test_texts import jaccard_classes, plain_secrets
from tests.llm.test_tokens import checked_pieces, plain


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    first = spark.read.parquet(f"{folder}/documents.parquet")
    assert kept["language"].count() >= 0.99 * first.count()
    classes = jaccard_classes(kept["language"].select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in kept["near copies"].collect()) == sorted({c for _, c, _ in classes})
    assert 0 < kept["near copies"].count() - kept["benchmark"].count() < 0.2 * kept["near copies"].count()
    before = {r.doc_id: r.text for r in kept["benchmark"].collect()}
    after = {r.doc_id: r.text for r in kept["secrets"].collect()}
    assert before.keys() == after.keys() and not any(plain_secrets(t) for t in after.values())
    assert sum(before[k] != after[k] for k in before) >= sum(bool(plain_secrets(t)) for t in before.values())
    ids = {k: [*x, 1] for k, x in zip(after, plain("word_bpe_49k.json", list(after.values())), strict=True)}
    checked_pieces(kept["packing"].collect(), ids)
    whole = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")
    total = Counter()
    for r in whole.collect():
        total[r.doc_id] += r.length
    assert total == {k: len(x) for k, x in ids.items()}


def test_stages_of_odd_rows(spark, odd_docs, no_docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd_docs, no_docs):
            found = stage(spark, table, folder)
            assert found.count() >= 0 and (name == "packing" or found.columns == table.columns)
    assert public_tokenizers.path("word_bpe_49k.json")
