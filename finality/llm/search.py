"""Exact top-k search by BM25: inverted index in shards, block-max WAND in each, results merged under global statistics.

A shard is about ``SHARD_BYTES`` of text. Its index is a few thousand rows, each holding the postings of all words whose hash falls into one
bucket, so a query reads only the buckets of its words. Postings are cut into blocks of ``BLOCK`` documents; a block keeps
its highest count and the shortest length of a document, from which an upper bound of any score in it follows once the global
numbers (documents, mean length, documents per word) are known. Document counts per word are summed over all shards first.

Search keeps one cursor per word. The pivot is the first document at which the bounds of the words before it can reach the k-th score so
far; if the bounds of the blocks there can't reach it, everything up to the nearest end of a block is skipped. Skips need a bound
strictly below the k-th score, so ties are kept; they go to the lesser document id. Results are the same as of scoring every
document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from finality.llm.arrow_text import TO_LOWER, hashes, slices, text_bytes, words
from finality.llm.shared import shared_folder, stored
from finality.llm.shared_files import create, whole

SHARD_BYTES, BLOCK, BUCKET_BITS = 12_000_000, 64, 10
#: Texts of queries whose weighted words a task holds at a time.
QUERY_BYTES = 1_000_000
INDEX = "shard long, bucket int, terms binary, ends binary, docs binary, counts binary, block_ends binary, block_counts binary, block_lengths binary, ids array<long>, lengths binary"


def buckets(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _blocks(ends: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all blocks, and the highest count and least length in each; a block holds postings of one word."""
    starts = np.concatenate([[0], ends[:-1]])
    per_term = -(-(ends - starts) // BLOCK)
    first = np.repeat(starts, per_term)
    k = np.arange(len(first)) - np.repeat(np.cumsum(per_term) - per_term, per_term)
    begin = first + k * BLOCK
    return np.append(begin[1:], ends[-1]), np.maximum.reduceat(counts, begin), np.minimum.reduceat(lengths, begin)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all rows of ``docs`` (doc_id, text), as stored; a row with bucket -1 has ids and lengths of a shard's documents.

    Words are runs of anything but white space, A-Z as a-z. Texts that are null or empty are documents without words.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size, base = TaskContext.get().partitionId() << 32, [], 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held, size, base
            if not held:
                return
            ids = [i for part in held for i in part[0]]
            lengths = np.concatenate([part[1] for part in held])
            term, doc, count = (np.concatenate([part[c] for part in held]) for c in (2, 3, 4))
            order = np.argsort(term, kind="stable")  # documents stay in order
            term, doc, count = term[order], doc[order], count[order]
            of_doc = lengths[doc]
            new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, dtype=np.int64)
            ends = np.append(new[1:], len(term)).astype(np.int64) if len(term) else new
            bucket = buckets(term[new])
            edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(new)]]) if len(new) else [0]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                low, high = (ends[a - 1] if a else 0), ends[b - 1]
                block_ends, block_counts, block_lengths = _blocks(ends[a:b] - low, count[low:high], of_doc[low:high])
                binary = (term[new[a:b]].astype("<u8"), (ends[a:b] - low).astype("<i8"), doc[low:high].astype("<i4"), count[low:high].astype("<i4"), block_ends.astype("<i8"), block_counts.astype("<i4"), block_lengths.astype("<i4"))
                out.append((shard, int(bucket[a]), *[x.tobytes() for x in binary], None, None))
            out.append((shard, -1, *[None] * 7, ids, lengths.astype("<i4").tobytes()))
            shard, held, size, base = shard + 1, [], 0, 0
            names = [part.split()[0] for part in INDEX.split(", ")]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7, pa.list_(pa.int64()), pa.binary()]
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 256], strict=True), kinds, strict=True)], names)

        for batch in batches:
            for some in slices(batch):
                data, offsets = text_bytes(some.column("text"))
                data = TO_LOWER[data]
                begin, end, first_word = words(data, offsets)
                spelled = hashes(data, begin, end)
                of = np.repeat(np.arange(some.num_rows), np.diff(first_word))
                order = np.lexsort((spelled, of))
                term, doc = spelled[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, dtype=np.int64)
                counts = np.diff(np.append(new, len(term)))
                held.append((some.column("doc_id").to_pylist(), np.diff(first_word), term[new], doc[new] + base, counts))
                base += some.num_rows
                size += len(data)
                if size >= SHARD_BYTES:
                    yield from rows()
        yield from rows()

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX), "index")


class Postings:
    """One word's cursor."""

    def __init__(self, docs, counts, block_ends, block_counts, block_lengths, weight: float, mean: float, k1: float, b: float):
        self.docs, self.counts, self.weight = docs, counts, weight
        self.last_docs = docs[block_ends - 1]
        norm = k1 * (1 - b + b * block_lengths / mean)
        self.bounds = weight * block_counts * (k1 + 1) / (block_counts + norm)
        self.bound = float(self.bounds.max())
        self.at, self.doc = 0, int(docs[0])

    def seek(self, target: int) -> None:
        """Move to the first posting from ``target`` on."""
        self.at += int(np.searchsorted(self.docs[self.at :], target))
        self.doc = int(self.docs[self.at]) if self.at < len(self.docs) else END

    def block(self, target: int) -> tuple[float, int]:
        """Bound of the block that holds ``target``, and the last document of it."""
        k = int(np.searchsorted(self.last_docs, target))
        return (float(self.bounds[k]), int(self.last_docs[k])) if k < len(self.bounds) else (0.0, END)


END = 1 << 60
#: Sums of bounds and scores in another order may differ by rounding.
SLACK = 1e-7


def best_documents(cursors: list[Postings], k: int, lengths: np.ndarray, ids: list, mean: float, k1: float, b: float) -> list[tuple[float, int]]:
    """The k best (score, -doc_id) of a shard by block-max WAND."""
    heap: list[tuple[float, int]] = []
    live = [c for c in cursors if c.doc < END]
    while live:
        live.sort(key=lambda c: c.doc)
        needed = heap[0][0] - SLACK if len(heap) == k else -1.0
        bound, pivot = 0.0, None
        for place, cursor in enumerate(live):
            bound += cursor.bound
            if bound >= needed:
                pivot = place
                break
        if pivot is None:
            break
        target = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == target:
            pivot += 1
        near = [c.block(target) for c in live[: pivot + 1]]
        if sum(x for x, _ in near) < needed:
            # nothing up to the nearest end of a block can reach the k-th score, nor before the next word begins
            beyond = min(min(last for _, last in near) + 1, live[pivot + 1].doc if pivot + 1 < len(live) else END)
            for cursor in live[: pivot + 1]:
                if cursor.doc < beyond:
                    cursor.seek(beyond)
        elif live[0].doc == target:
            norm = k1 * (1 - b + b * float(lengths[target]) / mean)
            score = 0.0
            for cursor in sorted(live[: pivot + 1], key=lambda c: c.weight):
                count = float(cursor.counts[cursor.at])
                score += cursor.weight * count * (k1 + 1) / (count + norm)
            entry = (round(score, 9), -ids[target] if ids[target] is not None else -END)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            for cursor in live[: pivot + 1]:
                cursor.seek(target + 1)
        else:
            for cursor in live[: pivot + 1]:
                if cursor.doc < target:
                    cursor.seek(target)
        live = [c for c in live if c.doc < END]
    return heap


def query_terms(queries: DataFrame) -> DataFrame:
    """Words and their counts of each row of ``queries`` (query_id, text), in blocks of about ``QUERY_BYTES`` of text.

    Rows are told apart by ``query``, as ids may repeat or be null. A block holds whole queries.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for some in slices(batch):
                data, offsets = text_bytes(some.column("text"))
                cuts = (size + offsets[:-1] - offsets[0]) // QUERY_BYTES
                begin, end, first_word = words(TO_LOWER[data], offsets)
                spelled, of = hashes(TO_LOWER[data], begin, end), np.repeat(np.arange(some.num_rows), np.diff(first_word))
                order = np.lexsort((spelled, of))
                term, row = spelled[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])) if len(term) else np.zeros(0, dtype=np.int64)
                own = pa.array(row[new])
                columns = [pa.array(block + cuts[row[new]]), some.column("query").take(own), some.column("query_id").take(own), pa.array(term[new].view(np.int64)), pa.array(np.diff(np.append(new, len(term))))]
                size += len(data)
                yield pa.RecordBatch.from_arrays(columns, ["block", "query", "query_id", "term", "times"])

    numbered = queries.select(F.col("query_id").cast("long"), "text").withColumn("query", F.monotonically_increasing_id())
    return stored(numbered.mapInArrow(count, "block long, query long, query_id long, term long, times long"), "query-terms")


@lru_cache(maxsize=2)
def plan_of(uri: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the queries of a block, the end of each in the words, words and their weights."""
    table = pa.ipc.open_stream(whole(uri)).read_all()
    query = table.column("query").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    keys = list(zip(query[first].tolist(), table.column("query_id").take(pa.array(first)).to_pylist(), strict=True))
    return keys, np.append(first[1:], len(query)), table.column("term").to_numpy().view(np.uint64), table.column("weight").to_numpy()


class Shard:
    """Postings of a shard's words, cut from the rows of its buckets as they are asked for."""

    def __init__(self, table: pa.Table):
        self.rows, self.ids, self.lengths = {}, [], np.zeros(0)
        for row in table.to_pylist():
            if row["bucket"] == -1:
                self.ids, self.lengths = row["ids"], np.frombuffer(row["lengths"], "<i4")
            else:
                kinds = (("terms", "<u8"), ("ends", "<i8"), ("docs", "<i4"), ("counts", "<i4"), ("block_ends", "<i8"), ("block_counts", "<i4"), ("block_lengths", "<i4"))
                self.rows[row["bucket"]] = [np.frombuffer(row[c], t) for c, t in kinds]

    def postings(self, term: np.uint64, bucket: int) -> tuple | None:
        if bucket not in self.rows:
            return None
        own, ends, docs, counts, block_ends, block_counts, block_lengths = self.rows[bucket]
        i = int(np.searchsorted(own, term))
        if i == len(own) or own[i] != term:
            return None
        low, high = (int(ends[i - 1]) if i else 0), int(ends[i])
        p, q = np.searchsorted(block_ends, low, side="right"), np.searchsorted(block_ends, high)
        return docs[low:high], counts[low:high], block_ends[p : q + 1] - low, block_counts[p : q + 1], block_lengths[p : q + 1]


def top_documents(index: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest BM25 score for each row of ``queries``, exactly.

    Documents that share no word with a query are no results, so there may be fewer than k. Words of a query count as often as they
    occur. Equal scores (to nine digits) are ranked by doc_id, rows without an id last. A query without words has no results.

    Words of queries meet the documents per word in a join. The weighted words are files in the shared folder, one per block of
    queries; a task that searches a shard goes through them and holds one or two at a time. The driver sees the numbers of the
    blocks and of the buckets, never a word.
    """
    spark = index.sparkSession
    asked, folder = query_terms(queries), shared_folder(spark, "query-plans")
    bucket = F.shiftrightunsigned("term", 64 - BUCKET_BITS).cast("int")
    wanted = [r[0] for r in asked.select(bucket).distinct().collect()]  # at most 2 ** BUCKET_BITS
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.concatenate([np.frombuffer(x, "<u8") for x in batch.column("terms").to_pylist()] or [np.zeros(0, "<u8")])
            sizes = [np.diff(np.frombuffer(x, "<i8"), prepend=0) for x in batch.column("ends").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.concatenate(sizes or [np.zeros(0, np.int64)]))], ["term", "n"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(x, "<i4") for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [len(x) for x in sizes], "total": [int(x.sum()) for x in sizes]})

    n_docs, total = index.filter("bucket = -1").select("lengths").mapInArrow(measure, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    mean = max(1e-9, (total or 0) / max(1, n_docs or 0))
    per_term = index.filter(F.col("bucket").isin(wanted)).select("terms", "ends").mapInArrow(tally, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weight = F.col("times") * F.log(1 + (F.lit(n_docs or 0) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighted = asked.join(per_term, "term").select("block", "query", "query_id", "term", weight.alias("weight"))

    def write_plan(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(["query", "query_id", "term", "weight"]).sort_by([("query", "ascending"), ("term", "ascending")]).combine_chunks()
        with create(f"{folder}/plan-{key[0].as_py()}") as file, pa.ipc.new_stream(file, rows.schema) as out:
            out.write_table(rows)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())})

    written = stored(weighted.groupBy("block").applyInArrow(write_plan, "block long"), "query-blocks")
    blocks = sorted(r.block for r in written.collect())  # a number per QUERY_BYTES of queries

    def search(key: tuple, table: pa.Table) -> pa.Table:
        shard, out = Shard(table), []
        for block in blocks:
            keys, ends, terms, weights = plan_of(f"{folder}/plan-{block}")
            of_term = dict.fromkeys(terms.tolist())
            for term, home in zip(np.unique(terms), buckets(np.unique(terms)).tolist(), strict=True):
                of_term[int(term)] = shard.postings(term, home)
            begin = 0
            for (query, query_id), end in zip(keys, ends.tolist(), strict=True):
                own = zip(terms[begin:end].tolist(), weights[begin:end].tolist(), strict=True)
                cursors = [Postings(*of_term[t], w, mean, k1, b) for t, w in own if of_term[t] is not None]
                out += [(query, query_id, None if d == -END else -d, s) for s, d in best_documents(cursors, k, shard.lengths, shard.ids, mean, k1, b)]
                begin = end
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = {"query": pa.int64(), "query_id": pa.int64(), "doc_id": pa.int64(), "score": pa.float64()}
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(kinds.items(), columns, strict=True)})

    needed = index.filter(F.col("bucket").isin([-1, *wanted]))
    found = needed.groupBy("shard").applyInArrow(search, "query long, query_id long, doc_id long, score double")
    # the window is cut to k rows of each query in every task before they are dealt out
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
