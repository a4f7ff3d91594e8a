"""Ranked search for many items at once, with what they share worked out once.

*Plan.* Items are dealt into blocks of about ``BLOCK_BYTES`` of text, each mined in one task. Terms that occur in the same items of a block, equally often in each, form
an *atom*. A pair of atom and count is a symbol, and an item is a list of symbols, the most widely shared ones first. Neighbouring symbols that
stand side by side in several items become a node, which takes their place; this is repeated until no pair is shared. So nodes and symbols are term sets, linked to an acyclic graph in
which an item is the sum of few of them. Plans are files in the shared folder and hold no more than their block.

*Statistics.* One pass over the documents counts them, their terms, and the documents of each term that any item asks for.

*Search.* Each task goes through its documents in chunks. For a chunk it works out the partial scores of all atoms, once, as a table of atoms by documents, then those of the nodes,
each from its two parts, and then adds up those of each item. It keeps the best ``k`` documents of an item over all its chunks; the best of all tasks are merged.
Documents aren't shuffled, and all arithmetic is in whole numbers, so the order of summation doesn't matter.

Scores: a term's weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; a document's ``m`` is ``25 + 75 * n * N div L``; a score sums
``weight * (10**9 * tf div (1000 * tf + 8 * m))`` over the item's terms with repeats. Terms are compared by 64-bit hashes.

Nulls: a null text has no terms, and neither finds nor is found; a null item_id stays null and a null doc_id stands last among equal scores. Each row of items is searched
for itself, also where ids or rows repeat (``item`` numbers them), and each row of documents is a document. Without items or documents there are no rows. Texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from finality.llm.arrow_text import MIX_A, STEP, TO_LOWER, hashes, mixed, slices, text_bytes, words
from finality.llm.shared import shared_folder, stored
from finality.llm.shared_files import create, whole

#: Bytes that are no part of a term: all of ASCII but digits and letters.
PARTS_TERMS = np.ones(256, dtype=bool)
PARTS_TERMS[0x30:0x3A] = PARTS_TERMS[0x41:0x5B] = PARTS_TERMS[0x61:0x7B] = PARTS_TERMS[0x80:] = False
BLOCK_BYTES, CHUNK_CELLS, HELD_COUNTS = 1_000_000, 3_000_000, 4_000_000
NO_ID = np.iinfo(np.int64).max


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, and the n+1 offsets of the texts in them."""
    data, offsets = text_bytes(texts)
    data = TO_LOWER[data]
    starts, ends, first = words(data, offsets, PARTS_TERMS)
    return hashes(data, starts, ends), first


def counted(found: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term (its place in ``vocabulary``) and number of occurrences, for the terms of each text that the sorted vocabulary has."""
    if not len(vocabulary) or not len(found):
        return (np.zeros(0, dtype=np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    known = vocabulary[at] == found
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, times = np.unique(owner[known] * len(vocabulary) + at[known], return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), times


def atoms_of(item: np.ndarray, term: np.ndarray, times: np.ndarray, n_terms: int) -> np.ndarray:
    """The atom of each term: terms with equal items and equal counts in them share one."""
    marks = []
    for salt in (1, 2):
        mark = np.zeros(n_terms, dtype=np.uint64)
        np.add.at(mark, term, mixed(mixed(item.astype(np.uint64) * STEP + np.uint64(salt)) + times.astype(np.uint64) * MIX_A))
        marks.append(mark)
    return np.unique(np.stack(marks, axis=1), axis=0, return_inverse=True)[1].reshape(-1)


def share_pairs(items: np.ndarray, symbols: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Replaces pairs of neighbours that several items share by new symbols, until none is shared.

    ``items`` is sorted; ``symbols`` are in the order of each item. Returns both as they are in the end, and for each level of new symbols (numbered on from
    ``n_symbols``) the two parts of each. In a level, a pair is replaced where no pair that overlaps it is shared more widely, so no two overlap.
    """
    levels, total = [], n_symbols
    while len(symbols) > 1:
        beside = items[1:] == items[:-1]
        pairs = np.where(beside, symbols[:-1] * np.int64(total) + symbols[1:], -1)
        values, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        shared = (counts[which] > 1) & beside
        if not shared.any():
            break
        # order of pairs: by number of items, then by an arbitrary but fixed rank
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.lexsort((mixed(values.astype(np.uint64)), counts))] = np.arange(1, len(values) + 1)
        strength = np.where(shared, rank[which], 0)
        padded = np.concatenate([[0], strength, [0]])
        taken = shared & (strength > padded[:-2]) & (strength > padded[2:])
        fresh, number = np.unique(pairs[taken], return_inverse=True)
        levels.append((fresh // total, fresh % total))
        place = np.flatnonzero(taken)
        symbols = symbols.copy()
        symbols[place] = total + number
        stay = np.ones(len(symbols), dtype=bool)
        stay[place + 1] = False
        items, symbols = items[stay], symbols[stay]
        total += len(fresh)
    return items, symbols, levels


def mine(ids: list, texts: pa.Array) -> dict[str, np.ndarray]:
    """The plan of a block of items; ``ids`` number them."""
    found, first = terms(texts)
    vocabulary = np.unique(found)
    item, term, times = counted(found, first, vocabulary)
    atom = atoms_of(item, term, times, len(vocabulary))
    # an item's atoms with their counts, each once
    _, one = np.unique(np.stack([item, atom[term]], axis=1), axis=0, return_index=True) if len(item) else (None, np.zeros(0, dtype=np.int64))
    item, own, times = item[one], atom[term[one]], times[one]
    kinds, symbol = np.unique(np.stack([own, times], axis=1), axis=0, return_inverse=True) if len(own) else (np.zeros((0, 2), dtype=np.int64), own)
    symbol = symbol.reshape(-1)
    spread = np.bincount(symbol, minlength=len(kinds))
    order = np.lexsort((symbol, -spread[symbol], item))
    item, symbol, levels = share_pairs(item[order], symbol[order], len(kinds))
    lists, starts = np.unique(item, return_index=True)
    plan = {"vocabulary": vocabulary, "atom": atom, "symbol_atom": kinds[:, 0], "symbol_times": kinds[:, 1], "items": np.array(ids, dtype=np.int64)[lists], "starts": starts, "symbols": symbol}
    sizes = np.array([len(left) for left, _ in levels], dtype=np.int64)
    left, right = (np.concatenate([pair[k] for pair in levels]) if levels else np.zeros(0, dtype=np.int64) for k in (0, 1))
    return plan | {"level_sizes": sizes, "left": left, "right": right}


def pack(plan: dict[str, np.ndarray]) -> bytes:
    table = pa.table({"name": list(plan), "values": pa.array([v.astype("<u8").tobytes() for v in plan.values()], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    rows = pa.ipc.open_stream(data).read_all().to_pylist()
    return {r["name"]: np.frombuffer(r["values"], dtype="<u8" if r["name"] == "vocabulary" else "<i8") for r in rows}


@functools.lru_cache(maxsize=4)
def plan_of(folder: str, block: int) -> dict[str, np.ndarray]:
    return unpack(whole(f"{folder}/plan-{block}"))


@functools.lru_cache(maxsize=4)
def weights_of(folder: str, block: int) -> np.ndarray:
    return np.frombuffer(whole(f"{folder}/weights-{block}"), dtype="<i8")


def partial_scores(plan: dict[str, np.ndarray], doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of all items (rows) for all documents of a chunk: of atoms first, then of nodes, then of items."""
    n_symbols, sizes = len(plan["symbol_atom"]), plan["level_sizes"]
    atoms = np.zeros((int(plan["atom"].max(initial=-1)) + 1, n_docs), dtype=np.int64)
    np.add.at(atoms, (plan["atom"][term], doc), value)
    parts = np.empty((n_symbols + int(sizes.sum()), n_docs), dtype=np.int64)
    parts[:n_symbols] = atoms[plan["symbol_atom"]] * plan["symbol_times"][:, None]
    done = 0
    for size in sizes.tolist():
        left, right = plan["left"][done : done + size], plan["right"][done : done + size]
        parts[n_symbols + done : n_symbols + done + size] = parts[left] + parts[right]
        done += size
    return np.add.reduceat(parts[plan["symbols"]], plan["starts"], axis=0)


class Best:
    """The best ``k`` documents of each item of a block so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, score, doc = (np.concatenate(pair) for pair in ((self.item, item), (self.score, scores[item, doc]), (self.doc, ids[doc])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        starts = np.searchsorted(item, np.arange(len(self.least)))
        rank = np.arange(len(item)) - starts[item]
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[item[full]] = score[full]
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


class Searcher:
    """What a task needs of the plans: the blocks of the folder and the statistics of all documents."""

    def __init__(self, folder: str, blocks: list[int], k: int, n_docs: int, n_terms: int):
        self.folder, self.blocks, self.k, self.n_docs, self.n_terms = folder, blocks, k, n_docs, n_terms

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for some in slices(batch):
                found, first = terms(some.column("text"))
                lengths = np.diff(first)
                ids = some.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                m = 25 + 75 * lengths * self.n_docs // max(1, self.n_terms)
                for block in self.blocks:
                    plan, weights = plan_of(self.folder, block), weights_of(self.folder, block)
                    kept = best.setdefault(block, Best(len(plan["items"]), self.k))
                    doc, term, tf = counted(found, first, plan["vocabulary"])
                    value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                    width = max(len(plan["symbols"]), len(plan["symbol_atom"]) + len(plan["left"]), 1)
                    step = max(1, CHUNK_CELLS // width)
                    for low in range(0, len(ids), step):
                        high = min(low + step, len(ids))
                        a, b = np.searchsorted(doc, [low, high])
                        kept.add(partial_scores(plan, doc[a:b] - low, term[a:b], value[a:b], high - low), ids[low:high])
        for block, kept in best.items():
            items = plan_of(self.folder, block)["items"][kept.item]
            ids = pa.array(kept.doc, pa.int64(), mask=kept.doc == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), ids, pa.array(kept.score, pa.int64())], ["item", "doc_id", "score"])

    def statistics(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of block, term and number of documents; the null block has the number of documents and, as ``total``, of terms."""
        held: dict[int, np.ndarray] = {}
        docs = total = 0
        for batch in batches:
            for some in slices(batch):
                found, first = terms(some.column("text"))
                docs, total = docs + int((np.diff(first) > 0).sum()), total + len(found)
                for block in self.blocks:
                    vocabulary = plan_of(self.folder, block)["vocabulary"]
                    _, term, _ = counted(found, first, vocabulary)
                    counts = np.bincount(term, minlength=len(vocabulary))
                    held[block] = held[block] + counts if block in held else counts
                    if sum(map(len, held.values())) > HELD_COUNTS:
                        yield from self._counts(held)
                        held = {}
        yield from self._counts(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["block", "term", "n", "total"])

    def _counts(self, held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block, counts in held.items():
            some = np.flatnonzero(counts)
            vocabulary = plan_of(self.folder, block)["vocabulary"][some].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(vocabulary), pa.array(counts[some], pa.int64()), pa.nulls(len(some), pa.int64())], ["block", "term", "n", "total"])


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Rows (item, item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "item-plans")
    asked = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // BLOCK_BYTES
    blocks = asked.select(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block"), "item", "text")

    def write_plan(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("item")
        plan = mine(rows.column("item").to_pylist(), rows.column("text").combine_chunks())
        if len(plan["items"]):
            with create(f"{folder}/plan-{key[0].as_py()}") as file:
                file.write(pack(plan))
        vocabulary = plan["vocabulary"].view(np.int64)
        return pa.table({"block": pa.array([key[0].as_py()] * len(vocabulary), pa.int64()), "term": pa.array(vocabulary, pa.int64())})

    wanted = stored(blocks.groupBy("block").applyInArrow(write_plan, "block long, term long"), "item-terms")
    numbers = [r.block for r in wanted.select("block").distinct().orderBy("block").collect()]  # a number per BLOCK_BYTES of items
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tallies = texts.select("text").mapInArrow(Searcher(folder, numbers, k, 0, 0).statistics, "block long, term long, n long, total long")
    counts = stored(tallies.groupBy("block", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "term-counts")
    n_docs, n_terms = counts.filter("block IS NULL").select(F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))).first() or (0, 0)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.coalesce("n", F.lit(0)) + 1))).cast("long")
    weighted = wanted.join(counts.filter("block IS NOT NULL").drop("total"), ["block", "term"], "left").select("block", "term", weight.alias("weight"))

    def write_weights(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("term").to_numpy().view(np.uint64))
        with create(f"{folder}/weights-{key[0].as_py()}") as file:
            file.write(rows.column("weight").to_numpy()[order].astype("<i8").tobytes())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())})

    weighted.groupBy("block").applyInArrow(write_weights, "block long").count()
    searching = Searcher(folder, numbers, k, n_docs, n_terms)
    found = texts.mapInArrow(searching.search, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")
