"""Similarity join of documents on the Jaccard similarity of their sets of ``k`` words in a row.

1. Signatures: ``bands * rows`` MinHash values per text. The number of rows in a band and of bands is chosen for the target recall at
   the threshold: the most rows per band (fewest chance meetings) for which 1 - (1 - t^r)^b reaches it with few enough values.
2. Texts with the same runs of words become one *set* with a number of documents, so copies cost nothing further.
3. Sets that meet in a band form groups: each bucket links its sets to the least one only, and groups are connected components of that.
4. Verification: a group is cut into blocks of about ``block`` sets, and each pair of blocks is a tile that one task works through with the whole
   sets of words, as a product of bit matrices. A tile returns, for each of its sets, the number of documents it is linked to, and one
   link for the component; no pair is ever emitted or left out.
5. Classes are the connected components of the verified links.

A group with very many sets is spread over many tiles; a tile holds two blocks, however large the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from finality.llm.arrow_text import TO_LOWER, grams, hashes, mixed, slices, starts_within, text_bytes, whole_groups, words
from finality.llm.graph import components
from finality.llm.shared import row_key, stored

MAX_VALUES = 128
SLICE_BYTES, TILE_BYTES = 3_000_000, 4_000_000


def banding(threshold: float, recall: float, most: int = MAX_VALUES) -> tuple[int, int]:
    """(bands, rows): the most rows for which at most ``most`` values find a pair at the threshold with probability ``recall``."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall; allow more values")


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words in lower case, row after row, and the runs before each row. Fewer words are one run of all of them."""
    data = TO_LOWER[data]
    begin, end, first_word = words(data, offsets)
    spelled = hashes(data, begin, end)
    at, rows = starts_within(first_word, k)
    runs = grams(spelled, k)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    counts = np.diff(first_word)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        one = np.array([mixed(np.bitwise_xor.reduce(mixed(spelled[first_word[r] : first_word[r + 1]] + np.arange(counts[r], dtype=np.uint64)))[None])[0] for r in short], dtype=np.uint64)
        rows, runs = np.concatenate([rows, short]), np.concatenate([runs, one])
        order = np.argsort(rows, kind="stable")
        rows, runs = rows[order], runs[order]
    return runs, np.searchsorted(rows, np.arange(len(offsets)))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row_a, row_b, set_id, n_runs, bands) of all rows; ``set_id`` is null where a text has no words."""
    # odd multipliers and masks of the hash functions, drawn from their number
    draws = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors, masks = draws[::2] | np.uint64(1), draws[1::2]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, limit=SLICE_BYTES):
                runs, before = shingles(*text_bytes(some.column("text")), k)
                full = np.flatnonzero(before[1:] > before[:-1])
                starts = before[:-1][full]
                band = np.zeros((len(full), bands), dtype=np.uint64)
                set_id = np.zeros(some.num_rows, dtype=np.int64)
                if len(full):
                    spare = np.empty_like(runs)
                    for j in range(bands):
                        value = np.full(len(full), j, dtype=np.uint64)
                        for i in range(j * rows, (j + 1) * rows):
                            np.bitwise_xor(runs, masks[i], out=spare)
                            np.multiply(spare, factors[i], out=spare)
                            value = mixed(value * np.uint64(31) + np.minimum.reduceat(spare, starts))
                        band[:, j] = value
                    total = np.add.reduceat(mixed(runs ^ masks[0]), starts)
                    set_id[full] = mixed(total ^ np.diff(before)[full].astype(np.uint64)).view(np.int64)
                counts = np.zeros(some.num_rows, dtype=np.int64)
                counts[full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").cast(pa.int64()), some.column("row_a"), some.column("row_b"), pa.array(set_id, mask=counts == 0), pa.array(np.diff(before).astype(np.int64)), lists],
                    ["doc_id", "row_a", "row_b", "set_id", "n_runs", "bands"],
                )

    keyed = docs.select("doc_id", *row_key("doc_id", "text"), "text")
    return keyed.mapInArrow(sign, "doc_id long, row_a long, row_b long, set_id long, n_runs long, bands array<long>")


def linked_in_tile(members: list[np.ndarray], side: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents each set is linked to, and the first set (by place) that its links lead to.

    ``members``: the distinct runs of each set; ``side``: 0 or 1, of a tile of two blocks, or 2 for one block with itself.
    """
    n = len(members)
    sizes = np.array([len(m) for m in members], dtype=np.float64)
    values, inverse, counts = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    common = np.zeros((n, n), dtype=np.float32)
    column = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, place = owner[keep], column[inverse[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = 16_384
    for first in range(0, int((counts > 1).sum()), width):
        a, b = np.searchsorted(place, (first, first + width))
        bits = np.zeros((n, int(place[b - 1]) - first + 1), dtype=np.float32)
        bits[owner[a:b], place[a:b] - first] = 1
        common += bits @ bits.T
    near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    links = near @ weights
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(near, root[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == root).all():
            return links, root
        root = least


def verify(tiles: DataFrame, k: int, threshold: float) -> DataFrame:
    """(set_id, root, links) of all sets in ``tiles`` (tile, side, set_id, n_docs, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile", TILE_BYTES):
            runs, before = shingles(*text_bytes(table.column("text")), k)
            tile, set_id = table.column("tile").to_numpy(), table.column("set_id").to_numpy()
            side, weight = table.column("side").to_numpy(), table.column("n_docs").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
            links, roots = np.zeros(len(tile), dtype=np.int64), np.arange(len(tile))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    members = [np.unique(runs[before[r] : before[r + 1]]) for r in range(a, b)]
                    links[a:b], found = linked_in_tile(members, side[a:b], weight[a:b], threshold)
                    roots[a:b] = a + found
            yield pa.RecordBatch.from_arrays([pa.array(set_id), pa.array(set_id[roots]), pa.array(links)], ["set_id", "root", "links"])

    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(work, "set_id long, root long, links long")


def similar_documents(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 256, block_runs: int = 300_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, row_a, row_b, root, class_id, and n_links, the number of other rows that are as similar as the threshold or more.

    ``class_id`` is the least doc_id of all rows that links lead to (nulls apart), and ``root`` tells classes apart where ids repeat. A text that is null or has no words is similar
    to nothing, its class is its own doc_id, and its root is null. Texts of fewer than ``k`` words are compared as one run. Repeated rows are
    linked as any equal texts are. Letters A-Z count as a-z. Other columns don't matter.
    """
    bands, rows = banding(threshold, recall)
    signed = stored(signatures(docs, k, bands, rows), "signatures")
    # per set: its documents, and one row to take the text from (the columns of ``first`` come from one row)
    sets = signed.filter("set_id is not null").groupBy("set_id").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("least_doc"), *[F.first(c).alias(c) for c in ("row_a", "row_b")], F.max("n_runs").alias("n_runs"), F.first("bands").alias("bands")
    )
    sets = stored(sets, "sets")
    met = sets.select("set_id", F.posexplode("bands").alias("band", "value")).select("set_id", F.xxhash64("band", "value").alias("bucket"))
    hubs = met.groupBy("bucket").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("other")).filter("hub < other")
    edges = met.join(hubs.select("bucket", "hub"), "bucket").filter("set_id <> hub").select(F.col("set_id").alias("u"), F.col("hub").alias("v"))
    groups = stored(components(edges), "groups")
    by_size = groups.join(sets.select(F.col("set_id").alias("node"), "n_runs"), "node").groupBy("root")
    sizes = by_size.agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_runs") / block_runs)).cast("int").alias("blocks"))
    placed = (
        groups.join(sizes, "root")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("node").alias("set_id"),
            F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
            F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
        )
    )
    # an own tile has one block; other tiles have the lesser block on side 0
    texts = docs.select("text", *row_key("doc_id", "text")).join(sets.join(groups.select(F.col("node").alias("set_id")), "set_id").select("row_a", "row_b", "set_id", "n_docs"), ["row_a", "row_b"])
    chosen = texts.dropDuplicates(["set_id"]).select("set_id", "n_docs", "text")
    found = stored(verify(placed.join(chosen, "set_id"), k, threshold), "links")
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("set_id <> root").select(F.col("set_id").alias("u"), F.col("root").alias("v")))
    classes = (
        sets.select("set_id", "n_docs", "least_doc").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").join(links, "set_id", "left")
        .select("set_id", F.coalesce("root", "set_id").alias("root"), "least_doc", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    )
    least = classes.groupBy("root").agg(F.min("least_doc").alias("class_id"))
    of_set = stored(classes.join(least, "root").select("set_id", "root", "class_id", "n_links"), "classes")
    return signed.select("doc_id", "row_a", "row_b", "set_id").join(of_set, "set_id", "left").select(
        "doc_id", "row_a", "row_b", "root", F.coalesce("class_id", F.when(F.col("set_id").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with one row of each class: the one with the least doc_id (rows without an id last, ties by a hash of the text).

    Texts without words stay, but for repeated rows, which become one row. All columns are kept.
    """
    found = similar_documents(docs, **settings).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_a", "row_b").alias("row"))
    first = found.filter("root is not null").groupBy("root").agg(F.min("row").alias("row")).select("row").unionByName(found.filter("root is null").select("row"))
    keep = stored(first.select("row.row_a", "row.row_b").distinct(), "kept-rows")
    a, b = "__finality_row_a", "__finality_row_b"
    keyed = docs.withColumns(dict(zip((a, b), row_key("doc_id", "text"), strict=True)))
    kept = keyed.join(keep, (F.col(a) == keep.row_a) & (F.col(b) == keep.row_b), "left_semi")
    return kept.dropDuplicates([a, b]).drop(a, b)
