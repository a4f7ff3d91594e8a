"""Links of weak parts against all pairs."""

from __future__ import annotations

import numpy as np

from finality.llm import secret_links

SCHEMA = f"row_a long, row_b long, sure {secret_links.SPAN}, weak {secret_links.SPAN}"


def all_pairs(parts, scope):
    role = lambda p: secret_links.ROLES[secret_links.KINDS[p[2]]]
    needs = lambda p: secret_links.NEEDS.get(secret_links.KINDS[p[2]], ())
    reached = lambda p, o: (o[0] >= p[1] or o[1] <= p[0]) and o[0] - p[1] <= scope and p[0] - o[1] <= scope
    return {p for p in parts if any(role(o) in needs(p) and reached(p, o) for o in parts)}


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for k in range(3_000):
        at, size, gap, other = int(rng.integers(0, 600)), int(rng.choice([16, 20, 64, 200, 450, 1_000])), int(rng.integers(0, 202)), int(rng.integers(9, 60))
        weak, sure = (at, at + size, int(rng.integers(3, 6))), (at + size + gap, at + size + gap + other, int(rng.integers(0, 3)))
        if k % 2:
            weak, sure = (at + other + gap, at + other + gap + size, weak[2]), (at, at + other, sure[2])
        rows.append((k, 0, [sure], [weak]))
        expected[k] = all_pairs([sure, weak], 200)
    got = {r.row_a: {tuple(s) for s in r.linked} for r in secret_links.linked(spark.createDataFrame(rows, SCHEMA), 200).collect()}
    assert {k: got.get(k, set()) for k in expected} == expected
    assert sum(map(bool, expected.values())) > 1_000


def test_long_url_before_a_password(spark):
    text = "https://x.example/" + "a" * 432 + " password=abcdefgh"
    found = secret_links.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.start, s.stop) for s in found[0].linked] == [(0, 450)]
