"""Words of a whole Arrow text column as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
#: Odd multipliers of 64-bit mixing.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rows are worked through in slices of about so many bytes of text.
SLICE_BYTES = 6_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n+1 row offsets. A null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of text (one row at least)."""
    _, offsets = text_bytes(batch.column(column))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every row the number of words before it (n+1).

    ``parts`` tells for each of the 256 bytes whether it parts words.
    """
    inside = ~parts[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    out = mixed(left.astype(np.uint64) * STEP + STEP)
    which, at = np.arange(len(starts)), starts
    while len(which):
        some = np.minimum(left, 8).astype(np.uint64)
        chunk = eight[at]
        part = some < 8
        chunk[part] &= (np.uint64(1) << (some[part] * np.uint64(8))) - np.uint64(1)
        out[which] = mixed(out[which] ^ chunk) + STEP
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return out


def grams(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words in a row, one for each start (across rows too; see ``starts_within``)."""
    n = max(0, len(word_hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * MIX_A + word_hashes[k : k + n]
    return mixed(out)


def starts_within(first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of runs of ``size`` words that stay in their row, and the row of each."""
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(rows)) - np.repeat(before, counts) + np.repeat(first_word[:-1], counts), rows


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of all ranges ``start .. start + length - 1``, range after range."""
    total = int(lengths.sum())
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return out + np.arange(total)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes that hold all rows of each of their keys, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
