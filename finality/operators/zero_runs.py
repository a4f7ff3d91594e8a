"""Zero runs of windows of any fullness, without a window's points in one place.

Points of a series, in event order, are summed up in pieces: how many there are, how many zeros stand at
both ends, and whether a run of zeros lies inside. Two neighbouring pieces give such a summary again. Pieces
are built in three levels, each bounded whatever the data looks like: points of one event time and one block of
arrivals, then those of a stretch of ``2**SLOT_BITS`` milliseconds, then the window.

Where a window is answered once, the levels are window functions and aggregates (``closing_flags``). Where
late readings update it, a piece has a summary *from an arrival on*: ``flag_changes`` hands these versions up
the levels. A node above keeps its children in a segment tree over event order, replaces a leaf by each
version in order of arrival and passes the root on when it changes, so n updates cost n log n.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from finality.config import THREE, WindowSpec
from finality.functions.points import is_zero
from finality.functions.windowing import phase_index
from finality.session import ship

GROUP = ["phase_group", "meter_id", "window_start_ms"]
SLOT_BITS = 12
#: The version that holds when a window closes.
AT_CLOSE = -1


def series_points(taken: DataFrame, spec: WindowSpec) -> DataFrame:
    """The columns that runs are found from, with the piece each point belongs to.

    Readings come with their block of arrivals, ``_blk``, by which they are partitioned already.
    """
    return taken.select(
        *GROUP,
        phase_index(F.col("series_id")).alias("phase"),
        F.shiftright(F.col("event_ms") - F.col("window_start_ms"), SLOT_BITS).alias("slot"),
        "event_ms",
        F.col("_blk").alias("arrivals"),
        F.col("arrival_seq").alias("seq"),
        "late",
        is_zero(F.col("value"), spec).alias("zero"),
    )


def _merged(pieces: DataFrame, keys: list[str], order: list[str], run: int) -> DataFrame:
    """Pieces (``n, head, tail, fault``) in ``order`` within ``keys`` summed up to one for each key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mixed = F.col("tail") < F.col("n")
    placed = pieces.withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("_last", F.when(mixed, F.col("_at") + F.col("n") - F.col("tail")))
    # zeros in front of a piece: the points since the last other reading
    front = F.col("_at") - F.coalesce(F.max("_last").over(before), F.lit(0))
    placed = placed.withColumn("_joined", front + F.col("head") >= run)
    total = F.sum("n")
    return placed.groupBy(*keys).agg(
        total.alias("n"),
        F.coalesce(F.min(F.when(mixed, F.col("_at") + F.col("head"))), total).alias("head"),
        (total - F.coalesce(F.max("_last"), F.lit(0))).alias("tail"),
        F.bool_or(F.col("fault") | F.col("_joined")).alias("fault"),
    )


def closing_flags(taken: DataFrame, spec: WindowSpec) -> DataFrame:
    """Per window: the number of points as ``k``, and ``fault_indicator``."""
    one = F.col("zero").cast("bigint")
    points = series_points(taken, spec).withColumns(
        {"n": F.lit(1).cast("bigint"), "head": one, "tail": one, "fault": F.col("zero") & F.lit(spec.zero_run <= 1)}
    )
    series = [*GROUP, "phase"]
    pieces = _merged(points, [*series, "slot", "event_ms", "arrivals"], ["seq"], spec.zero_run)
    slots = _merged(pieces, [*series, "slot"], ["event_ms", "arrivals"], spec.zero_run)
    # a window has few slots: its series meet in one task, so one exchange serves both steps
    windows = _merged(slots.repartition(*GROUP), series, ["slot"], spec.zero_run)
    return windows.groupBy(*GROUP).agg(F.sum("n").alias("k"), all_phases(F.col("fault")).alias("fault_indicator"))


def all_phases(flag: Column) -> Column:
    """Aggregate over the series of a window: the flag on L1, or on every phase of three."""
    has = [F.coalesce(F.bool_or(F.when(F.col("phase") == p, flag)), F.lit(False)) for p in range(3)]
    return F.when(F.col("phase_group") == THREE, has[0] & has[1] & has[2]).otherwise(has[0])


# ------------------------------------------------------------ versions


class Summaries:
    """Summaries with ends counted up to ``run``, as small numbers; ``merge`` puts two side by side."""

    def __init__(self, run: int):
        self.run, self.base = run, run + 1
        self.empty = self.code(0, 0, True, False)
        self.merge = functools.lru_cache(maxsize=1 << 18)(self._merge)

    def code(self, head: int, tail: int, all_zero: bool, fault: bool) -> int:
        return head + self.base * (tail + self.base * (all_zero + 2 * fault))

    def parts(self, code: int) -> tuple[int, int, bool, bool]:
        rest, head = divmod(code, self.base)
        flags, tail = divmod(rest, self.base)
        return head, tail, bool(flags & 1), bool(flags & 2)

    def fault(self, code: int) -> bool:
        return code >= 2 * self.base * self.base

    def _merge(self, left: int, right: int) -> int:
        (h1, t1, z1, f1), (h2, t2, z2, f2) = self.parts(left), self.parts(right)
        head = min(self.run, h1 + h2) if z1 else h1
        tail = min(self.run, t1 + t2) if z2 else t2
        return self.code(head, tail, z1 and z2, f1 or f2 or t1 + h2 >= self.run)


class Tree:
    """A segment tree over the children of a node, in event order."""

    def __init__(self, leaves: list[int], kinds: Summaries):
        self.kinds, self.size = kinds, 1 << max(0, len(leaves) - 1).bit_length()
        self.nodes = [kinds.empty] * self.size + leaves + [kinds.empty] * (self.size - len(leaves))
        for at in range(self.size - 1, 0, -1):
            self.nodes[at] = kinds.merge(self.nodes[2 * at], self.nodes[2 * at + 1])

    def put(self, leaf: int, code: int) -> int:
        """Replaces a leaf; returns the root."""
        at, nodes, merge = leaf + self.size, self.nodes, self.kinds.merge
        nodes[at] = code
        while at > 1:
            at >>= 1
            code = merge(nodes[2 * at], nodes[2 * at + 1])
            if code == nodes[at]:
                break
            nodes[at] = code
        return nodes[1]


def versions(children: list[int], seqs: list[int], codes: list[int], kinds: Summaries) -> list[tuple[int, int]]:
    """Root of a node after each arrival that changes it.

    The rows are versions of children, by arrival; ``children`` numbers them in event order from 0.
    """
    tree = Tree([kinds.empty] * (max(children) + 1), kinds)
    out, last = [], kinds.empty
    for at, (child, seq, code) in enumerate(zip(children, seqs, codes, strict=True)):
        root = tree.put(child, code)
        if seq == AT_CLOSE and at + 1 < len(seqs) and seqs[at + 1] == AT_CLOSE:
            continue
        if root != last or seq == AT_CLOSE:
            out.append((seq, root))
            last = root
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        starts = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(starts):
            cut = int(starts[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1)


def _slot_versions(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Versions of slots from those of their pieces; a slot with one piece has its versions."""
    kinds = Summaries(run)
    for table in _groups(batches, "gid"):
        gid, piece, seq, code = (table.column(c).to_numpy() for c in ("gid", "piece", "seq", "code"))
        rows, seqs, codes = [], [], []
        for low, high in _bounds(gid):
            own = piece[low:high]
            if high - low == 1 or (own == own[0]).all():
                rows.append(np.arange(low, high))
                seqs.append(seq[low:high])
                codes.append(code[low:high])
                continue
            found = versions(_dense(own).tolist(), seq[low:high].tolist(), code[low:high].tolist(), kinds)
            rows.append(np.full(len(found), low))
            seqs.append(np.array([s for s, _ in found], dtype=np.int64))
            codes.append(np.array([c for _, c in found], dtype=np.int64))
        kept = table.select([*GROUP, "phase", "slot"]).take(pa.array(np.concatenate(rows)))
        kept = kept.append_column("seq", pa.array(np.concatenate(seqs))).append_column("code", pa.array(np.concatenate(codes)))
        yield from kept.to_batches()


def _window_flags(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """The flag of each window when it closes, and after each arrival that changes it."""
    kinds = Summaries(run)
    for table in _groups(batches, "gid"):
        gid, phase, slot, seq, code = (table.column(c).to_numpy() for c in ("gid", "phase", "slot", "seq", "code"))
        rows, seqs, flags = [], [], []
        three = table.column("phase_group").to_pylist()
        for low, high in _bounds(gid):
            changes = []
            needed = (0, 1, 2) if three[low] == THREE else (0,)
            for p in needed:
                own = np.flatnonzero(phase[low:high] == p) + low
                if len(own):
                    found = versions(_dense(slot[own]).tolist(), seq[own].tolist(), code[own].tolist(), kinds)
                    changes += [(s, p, kinds.fault(c)) for s, c in found]
            now, last = dict.fromkeys(needed, False), None
            changes.sort()
            for at, (s, p, fault) in enumerate(changes):
                now[p] = fault
                if at + 1 < len(changes) and changes[at + 1][0] == s:
                    continue
                flag = all(now.values())
                if flag != last:
                    rows.append(low)
                    seqs.append(s)
                    flags.append(flag)
                    last = flag
        kept = table.select(GROUP).take(pa.array(rows, pa.int64()))
        kept = kept.append_column("seq", pa.array(seqs, pa.int64())).append_column("flag", pa.array(flags, pa.bool_()))
        yield from kept.to_batches()


def flag_changes(taken: DataFrame, spec: WindowSpec) -> DataFrame:
    """``flag`` of each window from arrival ``seq`` on; ``AT_CLOSE`` for what holds when it closes.

    A row for each change. A window without a row up to some arrival has no fault until then.
    """
    ship(taken.sparkSession)
    run = spec.zero_run
    kind = {f.name: f.dataType.simpleString() for f in taken.select(*GROUP).schema}
    keys = ", ".join(f"{name} {kind[name]}" for name in GROUP)
    series = [*GROUP, "phase"]
    piece = [*series, "slot", "event_ms", "arrivals"]
    # within a piece event order is order of arrival
    upto = Window.partitionBy(*piece).orderBy("seq")
    row, zero = F.row_number().over(upto), F.col("zero")
    points = series_points(taken, spec).withColumn("_row", row)
    other = F.when(~zero, F.col("_row"))
    points = points.withColumns({"_first": F.min(other).over(upto), "_tail": F.col("_row") - F.coalesce(F.max(other).over(upto), F.lit(0))})
    points = points.withColumn("_fault", F.max(F.col("_tail")).over(upto) >= run)
    head = F.least(F.lit(run), F.coalesce(F.col("_first") - 1, F.col("_row")))
    flags = F.col("_first").isNull().cast("bigint") + 2 * F.col("_fault").cast("bigint")
    code = head + (run + 1) * (F.least(F.lit(run), F.col("_tail")) + (run + 1) * flags)
    points = points.withColumn("code", code.cast("bigint"))
    changed = F.when(F.col("late"), ~F.lag("code").over(upto).eqNullSafe(F.col("code"))).otherwise(
        F.coalesce(F.lead("late").over(upto), F.lit(True))
    )
    pieces = points.withColumn("_changed", changed).filter("_changed")
    pieces = pieces.select(*series, "slot", F.struct("event_ms", "arrivals").alias("piece"), F.when(F.col("late"), F.col("seq")).otherwise(F.lit(AT_CLOSE)).alias("seq"), "code")
    # pieces of a slot are numbered in event order
    number = F.dense_rank().over(Window.partitionBy(*series, "slot").orderBy("piece"))
    node = [*series, "slot"]
    slots = (
        pieces.withColumns({"piece": number.cast("bigint"), "gid": F.xxhash64(*node)})
        .sortWithinPartitions(*node, "seq", "piece")
        .mapInArrow(lambda batches: _slot_versions(batches, run), f"{keys}, phase int, slot bigint, seq bigint, code bigint")
    )
    return (
        slots.repartition(*GROUP)
        .withColumn("gid", F.xxhash64(*GROUP))
        .sortWithinPartitions(*GROUP, "seq")
        .mapInArrow(lambda batches: _window_flags(batches, run), f"{keys}, seq bigint, flag boolean")
    )
