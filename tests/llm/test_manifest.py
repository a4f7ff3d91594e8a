"""The Merkle manifest against trees that are built level by level."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from finality.llm import merkle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text) -> str:
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and for each node the siblings before and after it, level by level."""
    paths, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        parents, under = [], []
        for low in range(0, len(nodes), 8):
            run = nodes[low : low + 8]
            for k in range(len(run)):
                for own in below[low + k]:
                    paths[own].append((run[:k], run[k + 1 :]))
            parents.append(h(*run))
            under.append(sum(below[low : low + 8], []))
        nodes, below = parents, under
    return nodes[0], paths


def expected(rows) -> list[tuple]:
    groups = defaultdict(list)
    for row in rows:
        groups[row.lang].append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        own[lang] = climb([leaf(r, r.text) for r in groups[lang]])
    root, tops = climb([own[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for row, path in zip(groups[lang], own[lang][1], strict=True):
            changed = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0 and row.text is not None
            node = leaf(row, row.text.translate(str.maketrans(UPPER, LOWER)) if changed else row.text)
            for before, after in path + top:
                node = h(*before, node, *after)
            proof = h(*[s for before, after in path + top for s in before + after])
            out.append((row.doc_id, leaf(row, row.text), own[lang][0], root, proof, node, node == root))
    return out


def found(docs, levels: int = merkle.BLOCK_LEVELS) -> list[tuple]:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.verified(docs, tampered, F.translate("text", UPPER, LOWER), levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in rows.select(*names).collect()]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 200, 513])
def test_open_tree_grows_to_the_root(n):
    nodes = [str(k) for k in range(n)]
    tree = merkle.OpenTree()
    places = [tree.append(node) for node in nodes]
    root, paths = climb(nodes)
    assert tree.close() == root
    assert [merkle.witness(*place) for place in places] == [[("".join(b), "".join(a)) for b, a in path] for path in paths]


def test_partial_witness_is_extended_by_later_siblings():
    tree = merkle.OpenTree()
    run, place = tree.append("a")
    assert run.members[place + 1 :] == []
    tree.append("b")
    assert run.members[place + 1 :] == ["b"] and run.up is None
    for k in range(6):
        tree.append(str(k))
    above, at = run.up
    assert above.members[at] == h("a", "b", *"012345") and above.up is None


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_blocks_of_every_height_give_the_same_manifest(spark, levels):
    """Languages with one row, one block, several blocks and several levels of blocks."""
    sizes = {"one": 1, "eight": 8, "nine": 9, "more": 130, None: 66, "Ä": 3}
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k * 7 % 1009, f"Text {k}", lang, "s", k))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(found(docs.repartition(5), levels)) == sorted(expected(docs.collect()))


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    assert found(no_docs) == []
    order = lambda rows: sorted(rows, key=repr)
    assert order(found(odd_docs)) == order(expected(odd_docs.collect()))


def test_one_language_has_no_top_siblings(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = found(docs)
    assert row[1] == row[2] == row[3] and row[4] == h("") and row[6]
