"""Token counts of documents in flat token files, found by their end-of-document ids alone.

A file is token ids of a fixed width end to end, with no index. It is cut into blocks of equal size, every block is searched
for separators in one vectorised step, and a prefix scan over the blocks of a file (separators before it, last separator
before it) stitches documents that cross blocks. One document may fill many blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from finality.llm.arrow_text import slices
from finality.llm.piece_tokens import encoder
from finality.llm.shared import stored
from finality.llm.shared_files import create, random_access

BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) as flat files, one per task; returns (part, path, ordinal, doc_id) as stored.

    Ids take 2 bytes where the vocabulary allows, else 4. Null texts are empty documents: their separator alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path, file, ordinal, pieces = TaskContext.get().partitionId(), None, None, 0, encoder(tokenizer, plain_specials=True)
        for batch in batches:
            for some in slices(batch):
                ids, _ = pieces.encode(some.column("text"), end_id)
                if file is None:
                    path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.{'u2' if ids.dtype.itemsize == 2 else 'u4'}"
                    file = create(path)
                file.write(ids.astype(ids.dtype.newbyteorder("<")).tobytes())
                n = some.num_rows
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(np.full(n, part, dtype=np.int32)), "path": pa.array([path] * n, pa.string()), "ordinal": np.arange(ordinal, ordinal + n), "doc_id": some.column("doc_id").cast(pa.int64())}
                )
                ordinal += n
        if file is not None:
            file.close()

    return stored(docs.select("doc_id", "text").mapInArrow(write, "part int, path string, ordinal long, doc_id long"), "flat-parts")


def count_tokens(files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(part, ordinal, start, n_tokens, terminated) of every document in ``files`` (part, path).

    ``n_tokens`` counts the separator. What follows the last separator of a file is one more document that isn't
    terminated. An empty file has no documents. The ending of a path (``u2`` or ``u4``) gives the width.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with random_access(path) as file:
                    n = file.size() // int(path[-1])
                blocks = np.arange(-(-n // block_tokens))
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(np.full(len(blocks), part, dtype=np.int32)), "path": pa.array([path] * len(blocks), pa.string()), "block": blocks, "tokens": np.minimum(block_tokens, n - blocks * block_tokens)}
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width, first = int(row["path"][-1]), row["block"] * block_tokens
                with random_access(row["path"]) as file:
                    file.seek(first * width)
                    ids = np.frombuffer(file.read(row["tokens"] * width), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + first + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([first + len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    ["part", "block", "block_end", "ends"],
                )

    named = files.select("part", "path").distinct()
    blocks = named.mapInArrow(cut, "part int, path string, block long, tokens long").repartition("part", "block")
    found = blocks.mapInArrow(scan, "part int, block long, block_end long, ends array<long>")
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "part",
        "block_end",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.array_max("ends")).over(earlier), F.lit(0)).alias("last_before"),
        (F.lead("block").over(Window.partitionBy("part").orderBy("block")).isNull()).alias("final"),
    )
    last_end = F.greatest(F.coalesce(F.array_max("ends"), F.lit(0)), F.col("last_before"))
    # the rest of a file, if any, is one more end after its last block
    rest = F.when(F.col("final") & (F.col("block_end") > last_end), F.array("block_end")).otherwise(F.array().cast("array<bigint>"))
    each = stitched.select("part", "before", "last_before", "ends", F.size("ends").alias("n"), F.posexplode(F.concat("ends", rest)).alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("last_before")).otherwise(F.get("ends", F.col("k") - 1))
    return each.select(
        "part",
        (F.col("before") + F.col("k")).alias("ordinal"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        (F.col("k") < F.col("n")).alias("terminated"),
    )


def document_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` flat, count by scanning the files, and name each counted document by its place in its file."""
    written = write_flat(docs, folder, tokenizer, end_id)
    counted = count_tokens(written, end_id, block_tokens)
    # sizes on disk say little here: equal paths and rising ids take next to no room
    return written.hint("merge").join(counted, ["part", "ordinal"]).select("doc_id", "part", "ordinal", "start", "n_tokens")
