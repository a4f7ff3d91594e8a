"""Operators 1, 9 and 10 against the tokenizers library itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from finality.llm import packing, queries, records, token_counts
from finality.llm.piece_tokens import PieceEncoder
from finality.llm.shared import shared_folder

NAMES = (queries.BYTE_BPE, queries.WORD_BPE)
ENCODERS = {n: PieceEncoder(public_tokenizers.path(n), keep=300) for n in NAMES}


def plain(name: str, texts: list[str | None], plain_specials: bool = False) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = plain_specials
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


PIECES = st.sampled_from(["a", "B", "the", "é", "É", "×", "ÿ", "'s", "'", " ", "  ", "\n", "\t", "\r\n", ".", ",", "1", "\xa0", "\x85", "\x1c", "\u3000", "e\u0301", "Σ", "İ", "日本", "<|endoftext|>", "_", "-"])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=25).map("".join) | st.text(max_size=30) | st.none(), min_size=1, max_size=8))
def test_pieces_encode_as_whole_texts(name, texts):
    ids, at = ENCODERS[name].encode(pa.array(texts, pa.string()), 9)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x + [9] for x in plain(name, texts)]


def test_records_round_trip(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    expected, start = [], 0
    for row, ids in zip(rows, plain(queries.BYTE_BPE, [r.text for r in rows]), strict=True):
        ids = [*ids, 0]
        expected.append((row.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op9_token_records(spark, folder).collect()) == sorted(expected)


def test_records_of_odd_rows(spark, odd_docs, no_docs):
    path = public_tokenizers.path(queries.BYTE_BPE)
    assert records.record_rows(spark, no_docs, path).count() == 0
    got = records.record_rows(spark, odd_docs, path).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    assert {(r.doc_id, r.ids_crc32) for r in got} == {(i, crc([*ids, 0])) for (i, _), ids in zip(texts, plain(queries.BYTE_BPE, [t for _, t in texts]), strict=True)}
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.concatenate([[0], np.cumsum([r.n_tokens for r in in_order])[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert ids == sorted(ids)


def test_shuffled_reads_and_damage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(50)
    parts = records.write_records(docs, shared_folder(spark, "t"), public_tokenizers.path(queries.BYTE_BPE))
    one, two = ([(r.doc_id, tuple(r.ids)) for r in records.read_shuffled(parts, seed).collect()] for seed in (1, 2))
    assert one != two and sorted(one) == sorted(two) and len(one) == 50
    record = bytearray(records.framed(records.payload_of(5, np.arange(4, dtype=np.uint16))))
    assert records.sequence_of(records.unframed(bytes(record)))[1].tolist() == [0, 1, 2, 3]
    for at in (0, 9, 15, len(record) - 1):
        damaged = bytearray(record)
        damaged[at] ^= 1
        with pytest.raises(records.BadRecord):
            records.unframed(bytes(damaged))


@pytest.mark.parametrize("block", (7, 64, 1 << 20))
def test_token_counts(spark, folder, block):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20 if block == 7 else 1000)
    got = token_counts.document_tokens(docs, shared_folder(spark, "t"), public_tokenizers.path(queries.BYTE_BPE), queries.END_OF_TEXT, block).collect()
    rows = docs.collect()
    assert {r.doc_id: r.n_tokens for r in got} == {r.doc_id: len(x) + 1 for r, x in zip(rows, plain(queries.BYTE_BPE, [r.text for r in rows], plain_specials=True), strict=True)}
    assert len(got) == len(rows)


def test_token_counts_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = public_tokenizers.path(queries.BYTE_BPE)
    assert token_counts.document_tokens(no_docs, shared_folder(spark, "t"), path, queries.END_OF_TEXT).count() == 0
    assert token_counts.document_tokens(odd_docs, shared_folder(spark, "t"), path, queries.END_OF_TEXT).count() == odd_docs.count()
    # a file without a separator at its end, one without any, an empty one
    files = {"a.u2": [5, 6, 0, 0, 7], "b.u2": [1, 2], "c.u2": [], "d.u4": [70_000, 0]}
    for name, ids in files.items():
        np.array(ids, dtype=f"<u{name[-1]}").tofile(tmp_path / name)
    table = spark.createDataFrame([(k, f"file://{tmp_path}/{n}") for k, n in enumerate(files)], "part int, path string")
    for block in (1, 2, 100):
        got = sorted(tuple(r) for r in token_counts.count_tokens(table, 0, block).collect())
        assert got == [(0, 0, 0, 3, True), (0, 1, 3, 1, True), (0, 2, 4, 1, False), (1, 0, 0, 2, False), (3, 0, 0, 2, True)]


def checked_pieces(pieces, documents: dict, window: int = 2048) -> int:
    """Every id lies in one piece, sequences have no gaps; returns the padding. ``documents``: (doc_id, tokens) to lists of ids."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    for doc_id, ids in documents.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert set(by_doc) == set(documents)
    return padding


def test_packing_holds_every_token_once(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    ids = {r.doc_id: [*x, 1] for r, x in zip(rows, plain(queries.WORD_BPE, [r.text for r in rows]), strict=True)}
    padding = checked_pieces(queries.op10_packed_sequences(spark, folder).collect(), ids)
    assert padding < 0.03 * sum(map(len, ids.values()))


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    path = public_tokenizers.path(queries.WORD_BPE)
    assert packing.pack(no_docs, path).count() == 0
    got = packing.pack(odd_docs, path).collect()
    rows = odd_docs.collect()
    assert sum(p.length for p in got) == sum(len(x) + 1 for x in plain(queries.WORD_BPE, [r.text for r in rows]))
    only = odd_docs.filter("doc_id > 4")
    checked_pieces(packing.pack(only, path).collect(), {r.doc_id: [*x, 1] for r, x in zip(only.collect(), plain(queries.WORD_BPE, [r.text for r in only.collect()]), strict=True)})


@settings(max_examples=60, deadline=None)
@given(gaps=st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 2.0, 9.0])), min_size=1, max_size=14))
def test_cuts_are_the_cheapest(gaps):
    at = np.concatenate([[0], np.cumsum([g for g, _ in gaps])])
    cost = np.array([0.0, *[c for _, c in gaps]])
    cost[-1] = 0.0
    window = 16

    def padding(n: int) -> int:
        return 0 if n & (n - 1) == 0 and n >= 4 else window - n

    place = dict(zip(at.tolist(), cost.tolist(), strict=True))
    best = {0: 0.0}
    for j in range(1, len(at)):
        best[j] = cost[j] + min(best[i] + padding(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= window)
    cuts = packing.best_cuts(at, cost, window, 4)
    price = sum(padding(b - a) + place[b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))
    assert price == pytest.approx(best[len(at) - 1])


@pytest.mark.parametrize("name", NAMES)
def test_strings_of_added_tokens_give_their_ids(name):
    texts = ["see <|endoftext|> here", "<|ENDOFTEXT|> x", None, "plain", "<|startoftext|><|endoftext|>  a", ""]
    ids, at = ENCODERS[name].encode(pa.array(texts, pa.string()), 9)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x + [9] for x in plain(name, texts)]
    assert len(plain(name, texts)[0]) < len(plain(name, texts, plain_specials=True)[0])
    as_text = PieceEncoder(public_tokenizers.path(name), plain_specials=True)
    ids, at = as_text.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain(name, texts, plain_specials=True)


def test_packing_does_not_depend_on_batches(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    key, results = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        for rows in ("5", "50", "2000"):
            spark.conf.set(key, rows)
            got = packing.pack(docs, public_tokenizers.path(queries.WORD_BPE), run_tokens=20_000).collect()
            results.append(sorted(tuple(r) for r in got))
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert results[0] == results[1] == results[2]
