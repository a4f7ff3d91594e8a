"""Fingerprints of texts as invertible Bloom lookup sketches of their paragraphs.

A text is cut into *pieces*: a piece ends with its line, with a sentence (a word that ends in ``.``, ``!`` or ``?``), after a word whose hash is
divisible by 4, or after 12 words, so a long paragraph has many and an edit touches few. A piece is known by a digest of its words and of how often the same piece came before in the text (48 bits) and by its weight,
the number of its words (16 bits, the highest value standing for more). A sketch has three tables of ``2 ** k`` cells; a piece is put into one cell of each, which counts pieces and
takes the XOR of their keys and of a check value. The fingerprint's ``2 ** k`` is the least one that is at least a 64th of the number of pieces, and 4 at least; a cell's place is the low bits of a hash,
so a table is folded to a smaller one by adding its halves.

Two versions are compared by subtracting one sketch from the other: what they share goes out, and cells left with a single piece are peeled until nothing remains, which gives the pieces
in which they differ. Where peeling stops early the tables were too small, and both texts are sketched again with tables four times as large (and other hashes) until it succeeds. The likeness is the
weight of the shared pieces divided by that of all pieces of either text (a Jaccard similarity); two texts without words have likeness 1.

Neighbours in order of ids: rows are range-partitioned by id, each task goes through its rows in order and keeps one row back until the next has come; the first and last rows of
tasks (two rows a task) are paired afterwards, so no text is shuffled more than once.

Nulls: a null text is empty; rows with a null id stand first, rows with equal ids in order of a hash of their texts. Repeated rows are neighbours of each other and equal. An empty table gives none; in a table of
one row that row is its own neighbour. Whole texts are read; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from finality.llm.arrow_text import STEP, hashes, mixed, text_bytes, words
from finality.llm.shared import stored

TABLES, LEAST_BITS, PIECES_PER_PLACE, CUT_EVERY, MOST_WORDS = 3, 2, 64, 4, 12
#: Bits by which tables grow from one try to the next.
GROWTH = 2
WEIGHT = np.uint64(0xFFFF)
#: Texts are worked through in runs of about so many bytes.
RUN_BYTES = 2_000_000
SEED = 0x2545F4914F6CDD1D

FOUND = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
ARROW_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
#: First and last text of a task's rows.
SEAM = "part int, place int, seam_text string"
ARROW_SEAM = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("seam_text", pa.string())])


def _places(stops: np.ndarray) -> np.ndarray:
    """Number of each word in its piece."""
    last = np.flatnonzero(stops)
    begin = np.concatenate([[0], last[:-1] + 1])
    return np.arange(len(stops)) - np.repeat(begin, last - begin + 1)


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pieces of all texts, text by text, and the n+1 offsets of the texts in them."""
    data, offsets = text_bytes(texts)
    starts, ends, first = words(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    own = hashes(data, starts, ends)
    last_byte = data[ends - 1]
    stops = (own % np.uint64(CUT_EVERY) == 0) | np.isin(last_byte, np.frombuffer(b".!?", dtype=np.uint8))
    lines = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(starts, lines) - 1
    stops[before[before >= 0]] = True
    ends_of_text = first[1:] - 1
    stops[ends_of_text[np.diff(first) > 0]] = True
    place = _places(stops)
    stops |= place % MOST_WORDS == MOST_WORDS - 1
    place %= MOST_WORDS
    last = np.flatnonzero(stops)
    begin = np.concatenate([[0], last[:-1] + 1])
    digests = mixed(np.add.reduceat(mixed(own + STEP * place.astype(np.uint64)), begin))
    owner = np.searchsorted(first, begin, side="right") - 1
    # equal pieces of one text are told apart by their number
    order = np.lexsort((digests, owner))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (digests[order][1:] == digests[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    run_start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    number = np.empty(len(order), dtype=np.uint64)
    number[order] = (np.arange(len(order)) - run_start).astype(np.uint64)
    weight = np.minimum(last - begin + 1, int(WEIGHT)).astype(np.uint64)
    keys = (mixed(digests + STEP * number) & ~WEIGHT) | weight
    return keys, np.searchsorted(owner, np.arange(len(offsets)))


def bits_for(counts: np.ndarray) -> np.ndarray:
    """Size of a table, as a power of two, for texts of so many pieces."""
    wanted = np.maximum(np.ceil(counts / PIECES_PER_PLACE), 1)
    return np.maximum(np.ceil(np.log2(wanted)).astype(np.int64), LEAST_BITS)


class Sketches:
    """The sketches of several texts, end to end: ``TABLES << bits`` cells each."""

    def __init__(self, bits: np.ndarray, salt: int = 0):
        self.bits, self.salt = bits, salt
        self.ends = np.cumsum(TABLES << bits)
        self.starts = self.ends - (TABLES << bits)
        total = int(self.ends[-1]) if len(bits) else 0
        self.count, self.keys, self.checks = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)

    def check_of(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys * STEP + np.uint64(SEED + self.salt)) >> np.uint64(32)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: int | np.ndarray = 1) -> np.ndarray:
        """Puts pieces into the sketches of their owners; returns the cells that changed."""
        checks, changed = self.check_of(keys), []
        for table in range(TABLES):
            hashed = mixed(keys + np.uint64(SEED * (1 + table + TABLES * self.salt) & (2**64 - 1)))
            size = np.int64(1) << self.bits[owner]
            cells = self.starts[owner] + table * size + (hashed & (size - 1).astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, cells, sign)
            np.bitwise_xor.at(self.keys, cells, keys)
            np.bitwise_xor.at(self.checks, cells, checks)
            changed.append(cells)
        return np.concatenate(changed)

    def to_bytes(self) -> list[bytes]:
        """For each text its counts (4 bytes a cell), keys (8) and checks (4)."""
        columns = self.count.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4")
        return [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out pieces that stand alone until none does. Returns owner and key of all, and for each text whether its cells are empty now."""
        owner_of = np.repeat(np.arange(len(self.bits)), self.ends - self.starts)
        owners, keys = [], []
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            live = live[self.check_of(self.keys[live]) == self.checks[live]]
            # one piece may stand alone in several cells
            owner, key, sign = owner_of[live], self.keys[live], self.count[live]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
            owner, key, sign = owner[fresh], key[fresh], sign[fresh]
            if not len(owner):
                break
            owners.append(owner)
            keys.append(key)
            changed = self.add(key, owner, -sign)
            live = changed[np.abs(self.count[changed]) == 1]
        rest = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        empty = ~np.logical_or.reduceat(rest, self.starts) if len(self.bits) else np.zeros(0, dtype=bool)
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return np.concatenate(owners) if owners else none[0], np.concatenate(keys) if keys else none[1], empty


def sketched(keys: np.ndarray, at: np.ndarray) -> Sketches:
    """The fingerprints of texts given by their pieces."""
    counts = np.diff(at)
    out = Sketches(bits_for(counts))
    out.add(keys, np.repeat(np.arange(len(counts)), counts))
    return out


def _part(prints: Sketches, low: int, high: int) -> Sketches:
    """The sketches of some texts in a row."""
    out = Sketches(prints.bits[low:high], prints.salt)
    if high > low:
        cells = slice(prints.starts[low], prints.ends[high - 1])
        out.count, out.keys, out.checks = prints.count[cells].copy(), prints.keys[cells].copy(), prints.checks[cells].copy()
    return out


def _rows(keys: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of some texts, and for each piece the number of its text in ``which``."""
    lengths = at[which + 1] - at[which]
    owner = np.repeat(np.arange(len(which)), lengths)
    return keys[np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(at[which], lengths)], owner


def differing(left: tuple, right: tuple, left_prints: Sketches, right_prints: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Owner and key of the pieces in which left and right texts differ, found by subtracting and peeling their sketches.

    ``left`` and ``right`` are (keys, offsets) of equally many texts. The first try takes the fingerprints as they are (the larger folded to the smaller), the next ones
    new sketches, each with tables four times as large as the last.
    """
    bits = np.minimum(left_prints.bits, right_prints.bits)
    which = np.arange(len(bits))
    tried = Sketches(bits)
    for prints, sign in ((left_prints, 1), (right_prints, -1)):
        # folding: the low bits of a place in its table are its place in the smaller one
        size = np.repeat(np.int64(1) << prints.bits, TABLES << prints.bits)
        own = np.arange(len(size)) - np.repeat(prints.starts, TABLES << prints.bits)
        small = np.repeat(np.int64(1) << bits, TABLES << prints.bits)
        cells = np.repeat(tried.starts, TABLES << prints.bits) + (own // size) * small + (own % size) % small
        np.add.at(tried.count, cells, sign * prints.count)
        np.bitwise_xor.at(tried.keys, cells, prints.keys)
        np.bitwise_xor.at(tried.checks, cells, prints.checks)
    owners, keys, salt = [], [], 0
    while True:
        owner, key, whole = tried.peeled()
        good = whole[owner]
        owners.append(which[owner[good]])
        keys.append(key[good])
        if whole.all():
            return np.concatenate(owners), np.concatenate(keys)
        which, bits, salt = which[~whole], bits[~whole] + GROWTH, salt + 1
        tried = Sketches(bits, salt)
        for (values, at), sign in ((left, 1), (right, -1)):
            tried.add(*_rows(values, at, which), sign)


def likeness(left: tuple, right: tuple, left_prints: Sketches, right_prints: Sketches) -> np.ndarray:
    n = len(left[1]) - 1
    weights = np.zeros(n, dtype=np.int64)
    for keys, at in (left, right):
        np.add.at(weights, np.repeat(np.arange(n), np.diff(at)), (keys & WEIGHT).astype(np.int64))
    owner, keys = differing(left, right, left_prints, right_prints)
    apart = np.zeros(n, dtype=np.int64)
    np.add.at(apart, owner, (keys & WEIGHT).astype(np.int64))
    return np.where(weights + apart > 0, (weights - apart) / np.maximum(weights + apart, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many from the start of the following text, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_neighbours(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of ``FOUND`` for all texts but the last, each compared with its edited form and with the text after it."""
    n = len(ids)
    changed = [edited(texts[k], texts[k + 1]) for k in range(n)]
    keys, at = pieces(pa.array(texts, pa.large_string()))
    new = pieces(pa.array(changed, pa.large_string()))
    every, new_prints = sketched(keys, at), sketched(*new)
    own, after = (keys[: at[n]], at[: n + 1]), (keys[at[1] :], at[1:] - at[1])
    prints = _part(every, 0, n)
    near_edited, near_next = likeness(own, new, prints, new_prints), likeness(own, after, prints, _part(every, 1, n + 1))
    hashed = [hashlib.sha256(t.encode()).digest() for t in changed]
    columns = [ids, [len(t) for t in texts[:n]], hashed, prints.to_bytes(), new_prints.to_bytes(), near_edited, near_next]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_FOUND, strict=True)], ARROW_FOUND.names)


def _runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= RUN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            yield doc_id.as_py(), text.as_py() or ""


def compared(docs: DataFrame) -> DataFrame:
    """Columns of ``FOUND`` for every row of ``docs`` (doc_id, text)."""
    names = [*ARROW_FOUND.names, *ARROW_SEAM.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, head = TaskContext.get().partitionId(), None, None
        for run in _runs(_texts(batches)):
            head = run[0][1] if head is None else head
            rows = run if kept is None else [kept, *run]
            kept = rows[-1]
            if len(rows) > 1:
                found = compare_neighbours([r[0] for r in rows[:-1]], [r[1] for r in rows])
                yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, f.type) for f in ARROW_SEAM]], names)
        if kept is not None:
            none = [pa.array([None, kept[0]], pa.int64()), *[pa.nulls(2, f.type) for f in list(ARROW_FOUND)[1:]]]
            ends = [pa.array([part, part], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([head, kept[1]], pa.string())]
            yield pa.RecordBatch.from_arrays([*none, *ends], names)

    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    order = [F.col("doc_id").asc_nulls_first(), tie]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ordered.mapInArrow(work, f"{FOUND}, {SEAM}"), "compared-texts")
    inside = rows.filter("part IS NULL").drop("part", "place", "seam_text")
    ends = rows.filter("part IS NOT NULL")
    # one number a task; the texts themselves are joined
    heads = ends.filter("place = 0")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(ahead)).alias("next_part"))
    following = heads.select(F.col("part").alias("next_part"), F.col("seam_text").alias("following"))
    pairs = ends.filter("place = 1").join(follows, "part").join(following, "next_part").select("doc_id", F.col("seam_text").alias("text"), "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
            for k in range(len(ids)):
                yield compare_neighbours(ids[k : k + 1], [texts[k], following[k]])

    return inside.unionByName(pairs.mapInArrow(close, FOUND))
