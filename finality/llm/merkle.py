"""Merkle manifest of a table of documents, with a witness for every row.

A row is hashed to a leaf inside Spark, so texts are never shuffled. Leaves of one language stand in order of their ids; their
places are found from a range partitioning and the counts of its parts. A *block* is an aligned run of ``8 ** 4`` places, and blocks are
worked through side by side: a language with a third of all rows is many blocks.

In a block, leaves are appended one by one to an :class:`OpenTree`. Every node that enters an open run gets a partial witness at once, which is the
run and its place there; each sibling that is completed later extends the run and with it the witnesses of all that stand
below its members. A full run becomes a node of the next level. The root of a block is then appended, as a node of higher level, to the next tree: block roots
of a language are a table with ``8 ** 4`` times fewer rows, to which the same step is applied until each language has one block, and then the
languages are appended to one last tree. A leaf's witness is the one in its block, continued by that of its block root.

Nulls: a null column counts as such in the leaf; a null language is a group of its own and stands first, null ids stand first in their language. Rows with equal ids stand in
order of their leaves; repeated rows are leaves of their own. An empty table has no rows and no root. Texts of any length
are hashed whole. Columns other than the five that are hashed don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from finality.llm.shared import stored

ARITY, BLOCK_LEVELS = 8, 4
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"
RUNS = f"tree string, block long, run int, items array<long>, members array<string>, others array<string>, closed boolean, path array<{STEP}>, block_root string"
ARROW_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Run:
    """Consecutive nodes of one level below one parent; ``up`` is the parent's own run and place there."""

    __slots__ = ("members", "up")

    def __init__(self):
        self.members: list[str] = []
        self.up: tuple[Run, int] | None = None


class OpenTree:
    """A hash tree that grows at its right edge. ``append`` gives the partial witness of a leaf: its run and its place in it."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.open, self.counts = arity, [Run()], [0]

    def append(self, node: str, level: int = 0) -> tuple[Run, int]:
        if level == len(self.open):
            self.open.append(Run())
            self.counts.append(0)
        run = self.open[level]
        at = run, len(run.members)
        run.members.append(node)
        self.counts[level] += 1
        if len(run.members) == self.arity:
            self._complete(level)
        return at

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run()
        run.up = self.append(digest(run.members), level + 1)

    def close(self, levels: int | None = None) -> str:
        """The root ``levels`` above the leaves; without a number, the node that remains when no level above has several."""
        level = 0
        while level != levels and not (levels is None and self.counts[level] == 1):
            if self.open[level].members:
                self._complete(level)
            level += 1
        return self.open[level].members[0]


def witness(run: Run, place: int) -> list[tuple[str, str]]:
    """For each level from this one up: the hashes of the siblings before and after."""
    steps = []
    while run.up is not None:
        steps.append(("".join(run.members[:place]), "".join(run.members[place + 1 :])))
        run, place = run.up
    return steps


def leaf_hash(changed_text: Column | None = None) -> Column:
    """The leaf of a row: each field with its length in bytes, a dash for null."""

    def field(name: str) -> Column:
        value = (changed_text if name == "text" and changed_text is not None else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in LEAF_COLUMNS]), 256)


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Nodes (``tree``, ``node``, ...) with their place ``at`` from 0 in the order of their tree."""
    row = F.monotonically_increasing_id()
    ordered = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = stored(ordered.withColumn("_row", row).withColumn("_part", F.shiftright("_row", 33)), "ordered-nodes")
    parts = placed.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, ["tree", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Appends the nodes (tree, at, node, item, other) of each block to its tree; one row per lowest run, with the witness of what stands above it."""
    size = ARITY**levels
    block = F.floor(F.col("at") / size)
    alone = nodes.groupBy("tree").agg((F.max("at") < size).alias("alone"))
    # a block is all of its tree, or it is closed at the height of its full neighbours
    dealt = nodes.join(alone, "tree").select("tree", block.alias("block"), "at", "node", "item", "other", "alone")
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, alone, tree, lowest, items, others = None, False, OpenTree(), [], [], []

        def finished() -> pa.RecordBatch:
            root = tree.close(None if alone else levels)
            rows = []
            for k, run in enumerate(lowest):
                own = slice(k * ARITY, k * ARITY + len(run.members))
                path = witness(*run.up) if run.up else []
                rows.append((*key, k, items[own], run.members, others[own], run.up is not None, [{"before": b, "after": a} for b, a in path], root))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), ARROW_STEPS, pa.string()]
            names = [part.split()[0] for part in RUNS.replace(f"<{STEP}>", "").split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for t, b, node, item, other, whole in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "node", "item", "other", "alone")), strict=True):
                if key != (t, b):
                    if key is not None:
                        yield finished()
                    key, alone, tree, lowest, items, others = (t, b), whole, OpenTree(), [], [], []
                run, _ = tree.append(node)
                if not lowest or lowest[-1] is not run:
                    lowest.append(run)
                items.append(item)
                others.append(other)
        if key is not None:
            yield finished()

    return stored(dealt.mapInArrow(build, RUNS), "tree-runs")


def _members(runs: DataFrame) -> DataFrame:
    """One row per node of the lowest runs, with the whole witness in its block as ``steps``."""
    each = runs.select("*", F.posexplode("members").alias("place", "node"))
    here = F.struct(
        F.array_join(F.slice("members", F.lit(1), F.col("place")), "").alias("before"),
        F.array_join(F.slice("members", F.col("place") + 2, F.lit(ARITY)), "").alias("after"),
    )
    steps = F.when(F.col("closed"), F.concat(F.array(here), F.col("path"))).otherwise(F.col("path"))
    return each.withColumns({"steps": steps, "item": F.get("items", F.col("place")), "other": F.get("others", F.col("place"))}).select("tree", "block", "node", "item", "other", "steps", "block_root")


def _above(runs: DataFrame, levels: int) -> DataFrame:
    """(tree, block, steps, subroot) for the blocks of ``runs``: the witness of each block root up to the root of its tree."""
    roots = runs.filter("run = 0").select("tree", "block", "block_root")
    if roots.filter("block > 0").isEmpty():
        return roots.select("tree", "block", F.array().cast(f"array<{STEP}>").alias("steps"), F.col("block_root").alias("subroot"))
    nodes = roots.select("tree", F.col("block").alias("at"), F.col("block_root").alias("node"), F.col("block").alias("item"), F.lit(None).cast("string").alias("other"))
    next_runs = _blocks(nodes, levels)
    own = _members(next_runs).select("tree", "block", F.col("item").alias("low"), F.col("steps").alias("own"))
    joined = own.join(_above(next_runs, levels), ["tree", "block"])
    return joined.select("tree", F.col("low").alias("block"), F.concat("own", "steps").alias("steps"), "subroot")


def _name(value: Column) -> Column:
    """A group's name that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def manifest(docs: DataFrame, tampered_text: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The leaf, the witness and the roots of every row of ``docs``.

    Columns: doc_id, leaf, other_leaf, steps (array of struct(before, after): the siblings' hashes from the leaf up), subroot, root. ``tampered_text`` makes
    ``other_leaf``, the leaf of a row with another text; without it, it equals ``leaf``. ``levels`` is the height of a block.
    """
    leaves = docs.select(_name(F.col("lang")).alias("tree"), F.col("doc_id").alias("item"), leaf_hash().alias("node"), leaf_hash(tampered_text).alias("other"))
    runs = _blocks(numbered(leaves, [F.col("item").asc_nulls_first(), F.col("node")]), levels)
    above = stored(_above(runs, levels), "block-witnesses")
    groups = above.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("subroot").alias("node"))
    groups = stored(numbered(groups, [F.col("group")]), "groups")
    top_runs = _blocks(groups.select("tree", "at", "node", F.col("at").alias("item"), F.lit(None).cast("string").alias("other")), levels)
    top = _members(top_runs).join(_above(top_runs, levels).withColumnRenamed("steps", "higher"), ["tree", "block"])
    top = top.select(F.col("item").alias("at"), F.concat("steps", "higher").alias("top_steps"), F.col("subroot").alias("root"))
    top = groups.join(top, "at").select(F.col("group").alias("tree"), "top_steps", "root")
    whole = above.join(top, "tree").select("tree", "block", F.concat("steps", "top_steps").alias("high"), "subroot", "root")
    found = _members(runs).join(whole, ["tree", "block"])
    return found.select(
        F.col("item").alias("doc_id"), F.col("node").alias("leaf"), F.col("other").alias("other_leaf"), F.concat("steps", "high").alias("steps"), "subroot", "root",
    )


def proof_hash(steps: Column) -> Column:
    """The hash of all siblings from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its witness lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def verified(docs: DataFrame, tampered: Column, tampered_text: Column, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest with ``folded_root``, worked out from the tampered leaf where ``tampered`` holds, and whether it is the root.

    A null in ``tampered`` counts as false.
    """
    text = F.when(F.coalesce(tampered, F.lit(False)), tampered_text).otherwise(F.col("text"))
    rows = manifest(docs, text, levels)
    rows = rows.withColumns({"proof_sha256": proof_hash(F.col("steps")), "folded_root": folded(F.col("other_leaf"), F.col("steps"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
