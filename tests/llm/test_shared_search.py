"""Search for many items against scores worked out one by one."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from finality.llm import shared_search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = st.sampled_from("a b c d e f g h one two One TWO".split())


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counts = [Counter(terms(text)) for _, text in docs]
    n, total = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), own in zip(docs, counts, strict=True):
            m = 25 + 75 * own.total() * n // max(1, total)
            score = 0
            for term in terms(text):
                if own[term]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (10**9 * own[term] // (1000 * own[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=12).map(" ".join), min_size=1, max_size=9))
def test_graph_adds_up_to_every_item(texts):
    """Over the graph, each item sums every term as often as it has it."""
    plan = shared_search.mine(list(range(len(texts))), pa.array(texts, pa.string()))
    n = len(plan["vocabulary"])
    if not n:
        assert not len(plan["items"])
        return
    # a document for each term, with a value of its own
    scores = shared_search.partial_scores(plan, np.arange(n), np.arange(n), np.full(n, 1), n)
    found, first = shared_search.terms(pa.array(texts, pa.string()))
    for row, item in zip(scores, plan["items"], strict=True):
        own = Counter(found[first[item] : first[item + 1]].tolist())
        assert row.tolist() == [own[t] for t in plan["vocabulary"].tolist()]


def test_shared_terms_become_nodes():
    texts = ["the cat sat on a mat", "the cat sat on a hat", "a dog on the mat", "the dog sat", "the dog sat"]
    plan = shared_search.mine([5, 6, 7, 8, 9], pa.array(texts))
    assert len(plan["left"]) and len(plan["symbols"]) < sum(len(set(t.split())) for t in texts)
    starts = plan["starts"].tolist()
    assert plan["symbols"][starts[3] : starts[4]].tolist() == plan["symbols"][starts[4] :].tolist()
    again = shared_search.unpack(shared_search.pack(plan))
    assert all(np.array_equal(plan[c], again[c]) for c in plan)


def test_best_documents_by_brute_force(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = shared_search.best_documents(docs, items).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(tuple(r) for r in got) == sorted(plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))


def test_many_blocks_and_short_chunks(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(shared_search, "BLOCK_BYTES", 20)
    rows = [(1, "one TWO two"), (1, "one TWO two"), (2, None), (3, ""), (None, "id, no id; thing"), (4, "%% nothing-here 日本"), (5, "no such termss"), (6, "word7 word7 word8 the three")]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as block", "2 as rank")
    got = shared_search.best_documents(odd_docs, items, k=3).select("item_id", "rank", "doc_id", "score").collect()
    expected = plain([(r.doc_id, r.text) for r in odd_docs.collect()], rows, 3)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


def test_ties_go_to_the_least_id_and_best_documents_stay(spark):
    docs = spark.createDataFrame([(100 - k, "same text") for k in range(40)] + [(200, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same"), (2, "words")], "item_id long, text string")
    got = shared_search.best_documents(docs.repartition(7), items, k=10).orderBy("item_id", "rank").collect()
    assert [r.doc_id for r in got if r.item_id == 2] == [200]
    # a term of nearly all documents weighs nothing or little; equal scores come by ascending id
    same = [r.doc_id for r in got if r.item_id == 1]
    assert same == sorted(range(61, 101))[: len(same)]


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert shared_search.best_documents(odd_docs, none).collect() == []
    assert shared_search.best_documents(no_docs, some).collect() == []
