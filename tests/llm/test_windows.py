"""Windows of documents that are close to an item without a run at its place."""

from __future__ import annotations

import random

from finality.llm import decontaminate

WORDS = [f"w{i}" for i in range(50)]


def test_swapped_halves_inside_a_longer_document(spark):
    around = [" ".join(f"{side}{i}" for i in range(100)) for side in "xy"]
    swapped = " ".join([around[0], *WORDS[25:], *WORDS[:25], around[1]])
    docs = spark.createDataFrame([(1, swapped), (2, " ".join([around[0], *WORDS[25:], around[1], *WORDS[:25]]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(WORDS))], "item_id long, text string")
    for broadcast_runs in (1_000_000, 0):
        found = decontaminate.find_leaks(docs, items, broadcast_runs=broadcast_runs).collect()
        assert [(r.doc_id, r.item_id, r.start, r.n_words, r.similarity) for r in found] == [(1, 7, 100, 50, 42 / 50)]


def test_windows_shorter_than_the_item_and_repeated_runs(spark):
    docs = [(1, " ".join(WORDS[:46])), (2, " ".join(["a b c d e"] * 9)), (3, " ".join(WORDS[:40]))]
    items = [(1, " ".join(WORDS)), (2, " ".join(["a b c d e"] * 2)), (3, " ".join(["e d c b a"] * 2))]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in found) == [(1, 1, 0, 42 / 46), (2, 2, 0, 1.0)]


def test_windows_are_not_written_in_a_file_for_each_part_of_the_texts(spark, monkeypatch):
    files = {}

    def watched(table, name, write=decontaminate.stored):
        found = write(table, name)
        files[name] = len(found.inputFiles())
        return found

    monkeypatch.setattr(decontaminate, "stored", watched)
    rng = random.Random(3)
    texts = [[f"x{rng.randrange(10**9)}" for _ in range(1_000)] for _ in range(200)]
    docs = [(i, " ".join([*t[:500], *(WORDS if i % 20 == 0 else []), *t[500:]])) for i, t in enumerate(texts)]
    items = spark.createDataFrame([(7, " ".join(WORDS))], "item_id long, text string")
    parts = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in parts}
    try:
        for k, v in parts.items():
            spark.conf.set(k, v)
        found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), items).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.start, r.similarity) for r in found) == [(i, 500, 1.0) for i in range(0, 200, 20)]
    assert files["windows"] <= 4
