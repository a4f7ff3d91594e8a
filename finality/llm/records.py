"""Length-delimited binary records of token sequences, with masked checksums and a separate offset index.

A part is two files. ``<name>.rec`` holds records end to end:

    length u64 | masked crc of the length u32 | payload | masked crc of the payload u32

and ``<name>.idx`` holds the byte offset of every record, and the size of the file, as i64. A payload is one byte of
flags (1: the document has no id, 2: ids are 4 bytes wide), the document id as i64 and its token ids, 2 bytes each where the
vocabulary allows. All numbers are little-endian. The checksum is CRC-32, rotated by 15 bits and shifted by a constant, so
that a checksum of data which holds checksums stays sound.

Writing: documents are dealt out by ranges of the id and sorted, each task writes one part under a name of its own attempt,
and the table of parts names those that count. A lost executor only leaves files that no table names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from finality.llm.arrow_text import slices
from finality.llm.piece_tokens import encoder
from finality.llm.shared import parts_before, shared_folder, stored
from finality.llm.shared_files import create, random_access, whole

#: Added to a rotated checksum; a fixed value of the masked form.
MASK = 0xA282EAD8
PARTS = "part int, path string, first_doc long, n_docs long, n_tokens long"
ROWS = "doc_id long, part int, record long, start_in_part long, n_tokens long, ids_crc32 long"


class BadRecord(ValueError):
    """A record whose length or checksum doesn't hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17 & 0xFFFFFFFF)) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframed(data: bytes) -> bytes:
    """The payload of one whole record."""
    length, crc = struct.unpack_from("<QI", data)
    if masked(data[:8]) != crc or len(data) != length + 16:
        raise BadRecord("the length of a record doesn't hold")
    payload = data[12:-4]
    if masked(payload) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise BadRecord("the checksum of a record doesn't hold")
    return payload


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    flags = (doc_id is None) | 2 * (ids.dtype.itemsize == 4)
    return struct.pack("<Bq", flags, doc_id or 0) + ids.astype(ids.dtype.newbyteorder("<")).tobytes()


def sequence_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=9)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text; further columns are ignored) and write them in ascending order of doc_id.

    Returns the table of parts, as stored in ``folder``. Rows without an id come first, equal ids stand in the order of
    a hash of their texts, a text that is null counts as empty, and every document ends with ``end_id``. No documents:
    no parts.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), None
        pieces, first, docs_, tokens, offsets = encoder(tokenizer), None, 0, 0, [0]
        records = None
        for batch in batches:
            for some in slices(batch):
                ids, at = pieces.encode(some.column("text"), end_id)
                if records is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                    records, first = create(f"{name}.rec"), some.column("doc_id")[0].as_py()
                for k, doc_id in enumerate(some.column("doc_id").to_pylist()):
                    record = framed(payload_of(doc_id, ids[at[k] : at[k + 1]]))
                    records.write(record)
                    offsets.append(offsets[-1] + len(record))
                docs_, tokens = docs_ + some.num_rows, tokens + len(ids)
        if records is not None:
            records.close()
            with create(f"{name}.idx") as index:
                index.write(np.array(offsets, dtype="<i8").tobytes())
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [name], "first_doc": pa.array([first], pa.int64()), "n_docs": [docs_], "n_tokens": [tokens]}
            )

    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    )
    return stored(ordered.mapInArrow(write, PARTS), "record-parts")


def read_records(parts: DataFrame) -> DataFrame:
    """One row per record of the named parts, checked against its checksums, in the columns of ``ROWS``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                offsets = np.frombuffer(whole(f"{path}.idx"), dtype="<i8")
                rows, start = [], 0
                with random_access(f"{path}.rec") as file:
                    for k in range(len(offsets) - 1):
                        doc_id, ids = sequence_of(unframed(file.read(int(offsets[k + 1] - offsets[k]))))
                        rows.append((doc_id, part, k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if file.read(1):
                        raise BadRecord("the file goes on after its last record")
                if rows:
                    yield _rows(rows)

    spread = parts.select("part", "path").repartition(max(1, parts.count()), "path")
    return spread.mapInArrow(read, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "part", "record", "start_in_part", "n_tokens", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_shuffled(parts: DataFrame, seed: int, batch: int = 256) -> DataFrame:
    """(position, doc_id, ids) of all records in an order that ``seed`` draws, read record by record through the offset index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            files: dict[str, tuple] = {}
            out = []
            for path, k, position in zip(*(rows.column(c).to_pylist() for c in ("path", "record", "position")), strict=True):
                if path not in files:
                    files[path] = random_access(f"{path}.rec"), np.frombuffer(whole(f"{path}.idx"), dtype="<i8")
                file, offsets = files[path]
                file.seek(int(offsets[k]))
                doc_id, ids = sequence_of(unframed(file.read(int(offsets[k + 1] - offsets[k]))))
                out.append((position, doc_id, ids.astype(np.int64)))
                if len(out) == batch:
                    yield _sequences(out)
                    out = []
            if out:
                yield _sequences(out)
            for file, _ in files.values():
                file.close()

    each = parts.select("path", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1)).alias("record"))
    dealt = each.withColumn("position", F.xxhash64(F.lit(seed), "path", "record"))
    return dealt.repartitionByRange("position").sortWithinPartitions("position").mapInArrow(read, "position long, doc_id long, ids array<long>")


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    position, doc_id, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(position, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(list(ids), pa.list_(pa.int64()))], ["position", "doc_id", "ids"])


def record_rows(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs``, read the files back, and add ``start``: the ids of all documents before each one."""
    parts = write_records(docs, folder or shared_folder(spark, "records"), tokenizer, end_id)
    before = F.broadcast(parts_before(parts, "part", ["n_tokens"]))  # a row per task of the writing stage
    rows = read_records(parts).join(before, "part")
    return rows.select("doc_id", (F.col("n_tokens_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
