"""A bus without a server: topics as folders of segments, read as a stream with offsets.

A topic is a folder that all machines share. Each of its partitions is a folder ``partition=<n>``, and a segment holds
the messages ``first`` up to ``end`` of it, one per line, in a file named ``<first>-<end>.log`` (or ``.log.gz``).
A segment doesn't change once it has its name, so names alone tell the offsets: the driver lists files and never
opens one. A task reads one segment, so a batch of any size is many bounded tasks, and a lost task reads the same
messages again. Which messages belong to a batch is in the checkpoint of the query.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from finality.session import ship

FORMAT = "finality_segments"
SCHEMA = "partition int, offset bigint, value string"
_NAME = re.compile(r"partition=(\d+)/(\d+)-(\d+)\.log(?:\.gz)?$")
_BATCH = 10_000


@dataclass
class Segment(InputPartition):
    """Messages ``low`` up to ``high`` of a file that starts at ``first``."""

    path: str
    partition: int
    first: int
    low: int
    high: int


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    plain = re.sub("^file:/+", "/", folder)
    return fs.FileSystem.from_uri(plain if "://" in plain else os.path.abspath(plain))


def listed(folder: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first, end, path) of the segments of each partition, in order. Other files don't count.

    Segments that overlap are an error; after a gap, segments wait until it is filled.
    """
    system, root = _opened(folder)
    parts: dict[int, list[tuple[int, int, str]]] = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        match = _NAME.search(info.path)
        if match and info.is_file:
            parts.setdefault(int(match[1]), []).append((int(match[2]), int(match[3]), info.path))
    whole = {}
    for part, segments in parts.items():
        kept: list[tuple[int, int, str]] = []
        for segment in sorted(segments):
            if kept and segment[0] < kept[-1][1]:
                raise ValueError(f"segments overlap: {kept[-1][2]}, {segment[2]}")
            if kept and segment[0] > kept[-1][1]:
                break
            kept.append(segment)
        whole[part] = kept
    return whole


class SegmentStream(DataSourceStreamReader):
    """Offsets are the next message of each partition, ``{"0": 120, "1": 80}``."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {str(part): segments[0][0] for part, segments in sorted(listed(self.folder).items())}

    def latestOffset(self) -> dict:
        return {str(part): segments[-1][1] for part, segments in sorted(listed(self.folder).items())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = listed(self.folder)
        out = []
        for name, high in sorted(end.items()):
            segments = found.get(int(name), [])
            # a partition that is new since the start is read from its first message
            low = start.get(name, segments[0][0] if segments else high)
            out += [
                Segment(path, int(name), first, max(first, low), min(stop, high))
                for first, stop, path in segments
                if max(first, low) < min(stop, high)
            ]
            if sum(s.high - s.low for s in out if s.partition == int(name)) != max(high - low, 0):
                raise ValueError(f"messages {low} to {high} of partition {name} are no longer in {self.folder}")
        return out

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        offset, offsets, values = partition.first, [], []

        def batch() -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array([partition.partition] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(values, pa.string())]
            return pa.record_batch(columns, names=["partition", "offset", "value"])

        with system.open_input_stream(partition.path) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="\n") as lines:
            for text in lines:
                if offset >= partition.high:
                    break
                if offset >= partition.low:
                    offsets.append(offset)
                    values.append(text.rstrip("\n"))
                    if len(values) == _BATCH:
                        yield batch()
                        offsets, values = [], []
                offset += 1
        if offset < partition.high:
            raise ValueError(f"{partition.path} ends at {offset}, not at {partition.high}")
        if values:
            yield batch()


class SegmentSource(DataSource):
    """``spark.readStream.format("finality_segments").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SegmentStream:
        return SegmentStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(SegmentSource)


def publish(folder: str, partition: int, values: Sequence[str]) -> tuple[int, int]:
    """Append messages to a partition as one segment; gives its offsets. Each partition has one writer.

    The file gets its name when it is whole, so a reader never sees half a segment.
    """
    if not values:
        raise ValueError("a segment has at least one message")
    if any("\n" in value for value in values):
        raise ValueError("a message is one line")
    segments = listed(folder).get(partition, [])
    first = segments[-1][1] if segments else 0
    end = first + len(values)
    system, root = _opened(folder)
    place = f"{root.rstrip('/')}/partition={partition}"
    system.create_dir(place, recursive=True)
    hidden = f"{place}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden, compression=None) as out:
        out.write("".join(f"{value}\n" for value in values).encode("utf-8"))
    system.move(hidden, f"{place}/{first:020d}-{end:020d}.log")
    return first, end
