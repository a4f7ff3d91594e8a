"""Arrival order and the watermark a record meets when it arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from finality.config import WindowSpec
from finality.functions.scan import TOP_BITS, blocks_of, running, total_prefix
from finality.functions.windowing import floor_to, window_start

NO_MORE_INPUT = 9_223_372_036_854_775_807


def replay_watermark(
    readings: DataFrame, spec: WindowSpec, per: str = "record", keep: Column | None = None
) -> DataFrame:
    """Add ``max_seen_ms``: the largest event time that arrived before.

    ``per="record"`` looks at every earlier record, ``per="epoch"`` at the
    records of earlier epochs, which is what a micro-batch sees. Null means
    nothing arrived before. All readings move the watermark; rows failing
    ``keep`` are dropped after that. The helper column ``_blk`` numbers blocks
    of arrivals.
    """
    if per == "record":
        return running(
            readings,
            blocks_of("arrival_seq", spec.block_bits),
            ["arrival_seq"],
            {"max_seen_ms": ("max", F.col("event_ms"))},
            keep=keep,
            block=["_blk"],
        )
    epochs = readings.groupBy("arrival_epoch").agg(F.max("event_ms").alias("top"))
    # few epochs may hold most rows; Spark broadcasts or splits by the sizes it meets at run time
    before = total_prefix(epochs, [["arrival_epoch"]], {"top": "max"})
    rows = readings if keep is None else readings.filter(keep)
    return rows.join(
        before.withColumnRenamed("_before_top", "max_seen_ms"), "arrival_epoch"
    ).withColumn("_blk", F.shiftright("arrival_seq", spec.block_bits))


def watermark_passes(
    readings: DataFrame, spec: WindowSpec, shift_ms: int, per: str = "record"
) -> DataFrame:
    """For every window end: the first arrival that reaches ``end + shift_ms``.

    Columns ``window_end_ms, pass_seq, pass_event_ms``; null when no arrival
    does. The instants ``end + shift_ms`` cut the event axis into cells, so the
    first arrival at or past an instant is the earliest one among the cells
    from there on: one partial aggregate and a suffix minimum over window ends.
    """
    unit = "arrival_seq" if per == "record" else "arrival_epoch"
    end = window_start(F.col("event_ms"), spec) + spec.size_ms
    cells = (
        readings.select(
            F.inline(
                F.array(
                    F.struct(
                        floor_to(F.col("event_ms") - shift_ms, spec.size_ms).alias("cell"),
                        F.col(unit).alias("unit"),
                        F.col("event_ms"),
                    ),
                    F.struct(
                        end.alias("cell"),
                        F.lit(None).cast("bigint").alias("unit"),
                        F.lit(None).cast("bigint").alias("event_ms"),
                    ),
                )
            )
        )
        .groupBy("cell")
        .agg(F.min("unit").alias("unit"), F.min_by("event_ms", "unit").alias("event_ms"))
        .withColumn("hit", F.when(F.col("unit").isNotNull(), F.struct("unit", "event_ms")))
        .withColumn("_top", F.expr(f"cell div {spec.size_ms << TOP_BITS}"))
    )
    after = total_prefix(
        cells.select("_top", "cell", "hit"), [["_top"], ["cell"]], {"hit": "min"}, descending=True
    )
    passes = cells.join(after, ["_top", "cell"]).select(
        F.col("cell").alias("window_end_ms"), F.least("hit", "_before_hit").alias("hit")
    )
    if per == "record":
        return passes.select(
            "window_end_ms",
            F.col("hit.unit").alias("pass_seq"),
            F.col("hit.event_ms").alias("pass_event_ms"),
        )
    epochs = readings.groupBy("arrival_epoch").agg(
        F.max("event_ms").alias("top"), F.max("arrival_seq").alias("pass_seq")
    )
    before = total_prefix(epochs.select("arrival_epoch", "top"), [["arrival_epoch"]], {"top": "max"})
    reached = epochs.join(before, "arrival_epoch").select(
        F.col("arrival_epoch").alias("unit"),
        "pass_seq",
        F.greatest("top", "_before_top").alias("pass_event_ms"),
    )
    passes = passes.select("window_end_ms", F.col("hit.unit").alias("unit"))
    return passes.join(reached, "unit", "left").drop("unit")
