"""Packing of token streams into sequences, in order, with cuts where they cost least.

Documents are dealt out by ranges of doc_id and sorted; each task packs its stream of tokens. A cut may fall at the end of a
document (free), of a sentence (``sentence_cost`` tokens), or, only inside spans without either, every ``hard_step`` tokens
(``hard_cost``). A sequence of n tokens costs its padding: ``window - n``, or nothing where n is a power of two from
``least_power`` on. With f(j) the least cost up to cut j,

    f(j) = cost(j) + min( window - p(j) + min over p(i) >= p(j) - window of (f(i) + p(i)),  f(i) where p(j) - p(i) is such a power )

and the inner minimum slides over i, so a monotone queue gives each f(j) in constant time. A stream is worked through in
runs of documents with a fixed number of tokens: the best path to the end of a run is kept but for its last sequence, which goes on with the next run, so the size
of batches changes nothing. Memory holds one run and one slice of texts; only the tail of each task can end short of the window.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from finality.llm.arrow_text import slices
from finality.llm.piece_tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidate_cuts(ends: np.ndarray, is_sentence_end: np.ndarray, sentence_cost: float, hard_step: int, hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from 0) at which a stream may be cut, and their costs. ``ends``: document ends, the last one is the stream's."""
    sentence = np.flatnonzero(is_sentence_end) + 1
    at = np.unique(np.concatenate([[0], sentence, ends]))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > hard_step)
    if len(wide):
        counts = (gaps[wide] - 1) // hard_step
        k = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        hard = np.repeat(at[wide], counts) + (k + 1) * hard_step
        at = np.union1d(at, hard)
        cost = np.full(len(at), sentence_cost)
        cost[np.searchsorted(at, hard)] = hard_cost
    else:
        cost = np.full(len(at), sentence_cost)
    cost[np.searchsorted(at, ends)] = 0.0
    cost[0] = 0.0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int, least_power: int) -> list[int]:
    """Positions that end the sequences of a cheapest packing. Gaps between candidates must not exceed the window."""
    place = np.full(int(at[-1]) + 1, -1, dtype=np.int64)
    place[at] = np.arange(len(at))
    jumps = []
    power = least_power
    while power < window:
        back = at - power
        jumps.append(np.where(back >= 0, place[np.maximum(back, 0)], -1).tolist())
        power *= 2
    positions, costs = at.tolist(), cost.tolist()
    best, came = [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(positions)):
        p = positions[j]
        while positions[queue[0][1]] < p - window:
            queue.popleft()
        least, i = queue[0]
        value = window - p + least
        for jump in jumps:
            k = jump[j]
            if k >= 0 and best[k] < value:
                value, i = best[k], k
        value += costs[j]
        best.append(value)
        came.append(i)
        here = value + p
        while queue and queue[-1][0] >= here:
            queue.pop()
        queue.append((here, j))
    out, j = [], len(positions) - 1
    while j:
        out.append(positions[j])
        j = came[j]
    return out[::-1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, sentence_cost: float = 4.0, hard_cost: float = 16.0, hard_step: int = 128, least_power: int = 256, run_tokens: int = 400_000) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): which ids of which document lie where in which sequence.

    A null text is empty; every document ends with ``end_id``, so none is without tokens. Rows without an id come first,
    equal ids in the order of a hash of their texts. ``sequence_id`` holds the task in its upper bits. No documents: no rows.
    Cuts are chosen over runs of documents with ``run_tokens`` tokens or more, whose last sequence is left open for the next run.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        ends_sentence = np.zeros(pieces.tokenizer.get_vocab_size(), dtype=bool)
        for mark in (".", "!", "?"):
            for form in (mark, mark + "</w>"):
                if (found := pieces.tokenizer.token_to_id(form)) is not None:
                    ends_sentence[found] = True
        # documents that are not packed to their end: id, ids of them packed already, tokens in all; and those tokens
        ids, names, done, sizes = np.zeros(0, dtype=np.uint32), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = iter(some for batch in batches for some in slices(batch))
        more = True
        while more:
            some = next(rest, None)
            if more := some is not None:
                new, at = pieces.encode(some.column("text"), end_id)
                ids = np.concatenate([ids, new.astype(np.uint32)])
                names += some.column("doc_id").to_pylist()
                sizes = np.concatenate([sizes, np.diff(at)])
                done = np.concatenate([done, np.zeros(some.num_rows, np.int64)])
            while len(names):
                # a run ends with the document that fills it, wherever batches end
                ends = np.cumsum(sizes - done)
                filling = int(np.searchsorted(ends, max(run_tokens, 2 * window)))
                if filling == len(ends) and more:
                    break
                last_run = filling >= len(ends) - 1 and not more
                ends = ends[: filling + 1]
                cuts = best_cuts(*candidate_cuts(ends, ends_sentence[ids[: ends[-1]]], sentence_cost, hard_step, hard_cost), window, least_power)
                if not last_run:
                    cuts.pop()
                to = cuts[-1]
                starts = np.unique(np.concatenate([[0], ends[ends < to], cuts[:-1]])).astype(np.int64)
                lengths = np.diff(np.append(starts, to))
                of = np.searchsorted(ends, starts, side="right")
                number = np.searchsorted(cuts, starts, side="right")
                begin = np.concatenate([[0], cuts])[number]
                within = starts - (ends - sizes[: len(ends)])[of]
                data = memoryview(ids[:to].astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([names[k] for k in of.tolist()], pa.int64()), "start": within, "length": lengths,
                        "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": sizes[of], "sequence_id": sequence + number, "offset": starts - begin,
                    }
                )
                sequence += len(cuts)
                ends = np.cumsum(sizes - done)
                keep = int(np.searchsorted(ends, to, side="right"))
                first = (ends - (sizes - done))[keep:]  # where what is left of each document begins
                done = done[keep:] + np.maximum(to - first, 0)
                ids, names, sizes = ids[to:], names[keep:], sizes[keep:]

    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    )
    return ordered.mapInArrow(work, PIECES)
