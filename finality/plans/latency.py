"""Distribution of finalization latency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from finality.functions.frames import by_value, counted_values, quantile_row, quantiles
from finality.functions.scan import running

MINUTE = 60_000.0
QUANTILES = (0.0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)
_AXIS = 4096


def select_rows(
    rows: DataFrame, mode: str | None = None, result_type: str | None = None
) -> DataFrame:
    """Rows with a latency, of one mode and result type where those columns exist."""
    for column, wanted in (("mode", mode), ("result_type", result_type)):
        if wanted and column in rows.columns:
            rows = rows.filter(F.upper(column) == wanted.upper())
    return rows.filter("finalization_latency_ms IS NOT NULL")


def final_or_purge(rows: DataFrame) -> DataFrame:
    if "result_type" not in rows.columns:
        return rows
    return rows.filter(F.upper("result_type").rlike("FINAL|PURGE"))


def _percentile(value: Column, share: float, weight: str | None = None) -> Column:
    return F.percentile(value, F.lit(share), F.col(weight) if weight else F.lit(1))


def latency_summary(rows: DataFrame) -> DataFrame:
    """Latency, reduction and saving ratio per experiment."""
    clean = rows.dropna(
        subset=["finalization_latency_ms", "latency_reduction_ms", "allowed_lateness_ms"]
    )
    latency = F.col("finalization_latency_ms") / MINUTE
    saved = F.col("latency_reduction_ms") / MINUTE
    ratio = F.try_divide(F.col("latency_reduction_ms"), F.col("allowed_lateness_ms"))
    # equal rows are counted first: the exact percentiles then hold one entry per distinct value
    values = clean.groupBy(
        "experiment", latency.alias("latency"), saved.alias("saved"), ratio.alias("ratio")
    ).agg(F.count("*").alias("n"))
    return values.groupBy("experiment").agg(
        F.sum("n").alias("finalized_windows"),
        (F.sum(F.col("latency") * F.col("n")) / F.sum("n")).alias("finalization_latency_mean_min"),
        _percentile(F.col("latency"), 0.5, "n").alias("finalization_latency_median_min"),
        _percentile(F.col("latency"), 0.95, "n").alias("finalization_latency_p95_min"),
        (F.sum(F.col("saved") * F.col("n")) / F.sum("n")).alias("latency_reduction_mean_min"),
        _percentile(F.col("saved"), 0.5, "n").alias("latency_reduction_median_min"),
        _percentile(F.col("saved"), 0.95, "n").alias("latency_reduction_p95_min"),
        F.try_divide(
            F.sum(F.col("ratio") * F.col("n")), F.sum(F.when(F.col("ratio").isNotNull(), F.col("n")))
        ).alias("latency_reduction_mean_ratio"),
        _percentile(F.col("ratio"), 0.95, "n").alias("latency_reduction_p95_ratio"),
    )


def distribution_summary(
    rows: DataFrame, deadline_tolerance_ms: int = 0, immediate_tolerance_ms: int = 0
) -> DataFrame:
    """One row: moments, percentiles and shares of immediate and deadline windows.

    Rows are read once: all measures, those of yes and no included, are counted by value, and everything
    follows from the counts.
    """
    latency = F.col("finalization_latency_ms")
    measures = {"row": F.lit(1), "latency": latency, "immediate": latency <= immediate_tolerance_ms}
    shares = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    named = {f"latency_p{round(share * 100)}_min": ("latency", share) for share in shares}
    if "allowed_lateness_ms" in rows.columns:
        allowed = F.col("allowed_lateness_ms")
        measures["allowed"] = allowed
        if "finalization_reason" in rows.columns:
            reason = F.upper("finalization_reason")
            measures["completeness"] = reason == "COMPLETENESS"
            measures["deadline"] = reason == "DEADLINE"
        else:
            measures["deadline"] = latency >= allowed - deadline_tolerance_ms
        named["allowed_lateness_median_min"] = ("allowed", 0.5)
    if "latency_reduction_ms" in rows.columns:
        measures["saved"] = F.col("latency_reduction_ms")
        named |= {"latency_reduction_p50_min": ("saved", 0.5), "latency_reduction_p95_min": ("saved", 0.95)}
    counted = counted_values(rows, measures)

    def of(measure: str, column: Column) -> Column:
        return F.when(F.col("measure") == measure, column)

    value, n = F.col("v") / MINUTE, F.col("n")
    windows = F.coalesce(F.sum(of("row", n)), F.lit(0).cast("bigint"))

    def mean(measure: str) -> Column:
        return F.try_divide(F.sum(of(measure, value * n)), F.sum(of(measure, n)))

    out = [
        windows.alias("windows"),
        mean("latency").alias("latency_mean_min"),
        F.min(of("latency", value)).alias("latency_min_min"),
        F.max(of("latency", value)).alias("latency_max_min"),
    ]
    for name in ("immediate", "completeness", "deadline"):
        if name in measures:
            hits = F.coalesce(F.sum(of(name, F.col("v") * n)), F.lit(0).cast("bigint"))
            out += [
                hits.alias(f"{name}_windows"),
                F.when(windows > 0, F.try_divide(hits, windows)).alias(f"{name}_ratio"),
            ]
    if "allowed" in measures:
        out.append(F.max(of("allowed", value)).alias("allowed_lateness_max_min"))
    if "saved" in measures:
        out.append(mean("saved").alias("latency_reduction_mean_min"))
    out.append(_deviation(lambda column: F.sum(of("latency", column))).alias("latency_std_min"))
    # two sides of one row
    return counted.agg(*out).crossJoin(F.broadcast(quantile_row(counted, named, MINUTE)))


def _deviation(total: Callable[[Column], Column]) -> Column:
    """Sample deviation in minutes of counted values in ms: squares are summed up as whole numbers, so no digits are lost."""
    v, n = F.col("v").cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")

    def whole(column: Column) -> Column:
        return column.cast("decimal(38,0)")

    count, sums, squares = whole(total(n)), whole(total(whole(v * n))), whole(total(whole(whole(v * v) * n)))
    middle = whole(F.floor(F.try_divide(sums.cast("double"), count.cast("double"))))
    around = whole(squares - whole(whole(middle * sums) * 2)) + whole(whole(middle * middle) * count)
    rest = (sums - whole(middle * count)).cast("double")
    count = count.cast("double")
    return F.sqrt(F.try_divide(around.cast("double") - rest * rest / count, F.nullif(count - 1, F.lit(0.0)))) / MINUTE


def quantile_table(rows: DataFrame) -> DataFrame:
    """Eleven fixed quantiles of the latency in minutes."""
    counted = counted_values(rows, {"latency": F.col("finalization_latency_ms")})
    found = quantiles(counted, list(QUANTILES), MINUTE)
    return found.select(
        "quantile",
        (F.col("quantile") * 100).alias("window_share_percent"),
        F.col("value").alias("finalization_latency_min"),
    ).orderBy("quantile")


def latency_histogram(
    rows: DataFrame, bin_minutes: float, max_minutes: float | None = None
) -> DataFrame:
    """Fixed-width histogram with share and cumulative share.

    The axis ends at the largest latency (or ``max_minutes``), not before the
    allowed lateness or one bin; the last bin is closed on the right. A latency
    past the axis extends it by one last, odd bin.
    """
    if bin_minutes <= 0:
        raise ValueError("bin_minutes must be positive")
    minutes = F.col("finalization_latency_ms") / MINUTE
    width = F.lit(float(bin_minutes))
    has_allowed = "allowed_lateness_ms" in rows.columns
    allowed = F.col("allowed_lateness_ms") if has_allowed else F.lit(None).cast("bigint")
    # one pass over the rows: from here on there is one row per bin
    counted = rows.groupBy(F.floor(minutes / width).alias("b")).agg(
        F.count("*").alias("n"), F.max(minutes).alias("top"), F.max(allowed).alias("allowed")
    )
    whole = counted.agg(
        F.sum("n").alias("total"), F.max("top").alias("top"), F.max("allowed").alias("allowed")
    ).filter("total > 0")
    right = F.greatest(
        F.lit(max_minutes).cast("double") if max_minutes is not None else F.col("top"),
        F.col("allowed") / MINUTE,
        width,
    )
    edges = F.ceil((right + width) / width).cast("int")
    odd = (F.col("edges") - 1) * width < F.col("top")
    axis = whole.withColumn("edges", edges).withColumn(
        "last", F.col("edges") - F.when(odd, 1).otherwise(2)
    )
    # the axis is laid out block by block, and counts are summed up along the blocks
    first = F.col("part") * _AXIS
    bins = (
        axis.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / _AXIS).cast("int"))).alias("part"))
        .repartition("part")
        .select("*", F.explode(F.sequence(first, F.least(first + _AXIS - 1, "last"))).alias("bin"))
    )
    in_bin = (
        counted.crossJoin(F.broadcast(axis.select("last")))  # one row
        .groupBy(F.least("b", "last").alias("bin"))
        .agg(F.sum("n").alias("windows"))
    )
    filled = bins.join(in_bin, "bin", "left").withColumn("windows", F.coalesce("windows", F.lit(0).cast("bigint")))
    summed = running(
        filled, by_value("bin", _AXIS), ["bin"], {"cumulative": ("sum", F.col("windows"))}, inclusive=True, block=["_blk"]
    )
    return (
        summed.orderBy("bin")
        .select(
            (F.col("bin") * width).alias("bin_start_min"),
            F.when(F.col("bin") == F.col("edges") - 1, F.col("top"))
            .otherwise((F.col("bin") + 1) * width)
            .alias("bin_end_min"),
            "windows",
            (F.col("windows") / F.col("total")).alias("window_share"),
            (F.col("cumulative") / F.col("total")).alias("cumulative_window_share"),
        )
    )


def reference_latency_min(summary: DataFrame, given: float | None = None) -> float:
    """The given allowed lateness in minutes, or the largest one in the data."""
    if given is not None:
        return given
    if "allowed_lateness_max_min" not in summary.columns:
        raise ValueError("no allowed lateness in the data; give one")
    value = summary.select("allowed_lateness_max_min").first()[0]
    if value is None:
        raise ValueError("the allowed lateness has no valid values; give one")
    return float(value)
