"""Sketches of paragraphs against sets of paragraphs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from finality.llm import paragraph_sketch as sketch
from finality.llm import queries

TEXTS = st.lists(st.sampled_from("the cat. sat on\n a mat! dog ran far away from home it is so".split(" ")), max_size=60).map(" ".join)


def keys_of(text: str | None) -> set[int]:
    keys, _ = sketch.pieces(pa.array([text], pa.string()))
    assert len(set(keys.tolist())) == len(keys)
    return set(keys.tolist())


def alike(left: str, right: str) -> float:
    a, b = keys_of(left), keys_of(right)
    weight = lambda keys: sum(k & 0xFFFF for k in keys)
    return weight(a & b) / weight(a | b) if a | b else 1.0


def neighbours(rows: list[tuple]) -> list[tuple]:
    texts = [t or "" for _, t in rows]
    after = texts[1:] + texts[:1]
    out = []
    for (doc_id, _), text, following in zip(rows, texts, after, strict=True):
        new = sketch.edited(text, following)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), alike(text, new), alike(text, following)))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=6))
def test_peeling_gives_the_difference(pairs):
    left, right = (sketch.pieces(pa.array([p[k] for p in pairs], pa.string())) for k in (0, 1))
    owner, keys = sketch.differing(left, right, sketch.sketched(*left), sketch.sketched(*right))
    for k, (a, b) in enumerate(pairs):
        assert sorted(keys[owner == k].tolist()) == sorted(keys_of(a) ^ keys_of(b))


def test_weights_are_words():
    text = "One two three.\nFour five\n\nsix " + "same " * 100
    assert sum(k & 0xFFFF for k in keys_of(text)) == 106


def test_small_sketches_are_tried_again_larger():
    """Nothing in common: far more pieces differ than the fingerprints have cells."""
    left, right = (sketch.pieces(pa.array([" ".join(f"{x}{k}" for k in range(3_000))])) for x in "ab")
    prints = sketch.sketched(*left), sketch.sketched(*right)
    assert prints[0].ends[-1] < len(left[0]) / 4
    _, keys = sketch.differing(left, right, *prints)
    assert sorted(keys.tolist()) == sorted([*left[0].tolist(), *right[0].tolist()])


def test_sketches_of_different_sizes_are_folded():
    long = " ".join(f"word{k}" for k in range(4_000))
    left, right = sketch.pieces(pa.array([long])), sketch.pieces(pa.array([long[:300]]))
    prints = sketch.sketched(*left), sketch.sketched(*right)
    assert prints[0].bits[0] > prints[1].bits[0]
    owner, keys = sketch.differing(left, right, *prints)
    assert sorted(keys.tolist()) == sorted(keys_of(long) ^ keys_of(long[:300]))


def test_empty_texts_are_alike():
    none = sketch.pieces(pa.array([None, "", " \n"], pa.string()))
    assert sketch.likeness(none, none, sketch.sketched(*none), sketch.sketched(*none)).tolist() == [1.0, 1.0, 1.0]
    assert sketch.edited("", "abc") == "" and sketch.edited("abcdefgh", "x") == "abcdefx"


def test_query_by_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op12_edited_texts(spark, folder).collect()
    plain = sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert plain == sorted((*r[:3], round(r[3], 9), round(r[4], 9)) for r in neighbours(rows))
    prints = {r.doc_id: r.fingerprint for r in got}
    texts = dict(rows)
    by_text = {}
    for doc_id, text in texts.items():
        assert by_text.setdefault(text or "", prints[doc_id]) == prints[doc_id]
    assert len(set(prints.values())) > 0.9 * len(set(texts.values()))


def test_neighbours_over_task_seams(spark):
    """Every split of the rows into tasks, empty tasks too, gives the same neighbours."""
    rows = [(k, f"text {k} has. some words\nand {k * k} more") for k in range(23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(neighbours(rows))
    for parts in ("1", "5", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = sketch.compared(docs).selectExpr("doc_id", "n_chars", "lower(hex(edited_sha256))", "near_edited", "near_next").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted(tuple(r) for r in got) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    assert sketch.compared(no_docs).count() == 0
    got = sketch.compared(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sorted(r.n_chars for r in got) == sorted(len(r.text or "") for r in odd_docs.collect())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    (one,) = sketch.compared(spark.createDataFrame([(1, "a single row. of text")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a single row. ofa sin").digest()


def test_places_restart_after_stops():
    assert sketch._places(np.array([False, True, True, False, False, True])).tolist() == [0, 1, 0, 0, 1, 2]
