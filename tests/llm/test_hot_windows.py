"""A passage that many documents hold in other contexts."""

from __future__ import annotations

from finality.llm import substring_dedup
from tests.llm.test_texts import plain_removal


def test_no_shard_gets_more_rows_than_distinct_windows(spark, monkeypatch):
    passage = [f"p{i}" for i in range(40)]
    texts = [(" ", "\n ")[i % 2].join([*(f"a{i}x{j}" for j in range(20)), *passage, *(f"b{i}x{j}" for j in range(20))]) for i in range(60)]
    rows = []

    def watched(texts, *rest, search=substring_dedup.search_shards):
        rows.extend(texts.select("shard", "words").collect())
        return search(texts, *rest)

    monkeypatch.setattr(substring_dedup, "search_shards", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring_dedup.without_repeats(docs, 35, hot=3).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == [(k, *x) for k, x in enumerate(plain_removal(texts, 35))]
    assert all(r.n_removed == 40 for r in found)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(tuple(bytes(r.words).split()))
    assert all(len(own) <= len(set(own)) for own in shards.values())
