"""Lateness profile: how late readings arrive, measured three ways.

``per_meter`` and ``per_meter_series`` compare a reading with the largest event
time of the same key before it, ``global`` with that of all readings, and
``post_window_delay`` measures how far the largest event time has passed the
end of the reading's window, which is what decides whether it is dropped.
Times are whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finality.config import WindowSpec
from finality.functions.scan import blocks_of, running
from finality.functions.timecols import local_text
from finality.functions.windowing import floor_to

MODES = ("per_meter", "per_meter_series", "post_window_delay")
BIN_MINUTES, BINS = 6, 500
PERCENTILES = (50, 90, 95, 99)
# a key is spread over blocks of this many arrivals
_KEY_BITS = 20
# stands before every arrival
_CARRIED = -(1 << 62)

KEYS = {
    "per_meter": ["meter_id"],
    "per_meter_series": ["meter_id", "series_id"],
    "global": [],
    "post_window_delay": [],
}


def lateness(
    readings: DataFrame, mode: str, spec: WindowSpec, earlier: DataFrame | None = None
) -> DataFrame:
    """Readings with ``late_s``, null when the reading is not late.

    Needs ``day`` and ``insert_ms`` besides the reading columns. ``earlier`` carries
    on from readings that are not in the table: the largest ``top_s`` per ``meter_id, series_id``
    of the mode. Its rows stand before all arrivals in the same blocked scan, so a key with
    very many readings is still dealt over blocks.
    """
    keys = KEYS[mode]
    rows = readings.select(
        "arrival_seq",
        "day",
        "meter_id",
        "series_id",
        F.expr("event_ms div 1000").alias("event_s"),
        F.expr("insert_ms div 1000").alias("insert_s"),
    )
    if earlier is not None:
        carried = earlier.select(
            F.lit(_CARRIED).alias("arrival_seq"), "meter_id", "series_id", F.col("top_s").alias("event_s")
        )
        rows = rows.unionByName(carried, allowMissingColumns=True)
    after_window = mode == "post_window_delay"
    seen = running(
        rows,
        blocks_of("arrival_seq", _KEY_BITS if keys else spec.block_bits),
        ["arrival_seq"],
        {"top_s": ("max", F.col("event_s"))},
        keys=keys,
        inclusive=after_window,
        keep=None if earlier is None else F.col("arrival_seq") != _CARRIED,
        block=["_blk"],
    )
    if after_window:
        size_s = spec.size_ms // 1000
        reference = floor_to(F.col("event_s"), size_s) + size_s
    else:
        reference = F.col("event_s")
    gap = F.col("top_s") - reference
    return seen.select(
        F.lit(mode).alias("mode"),
        "day",
        "meter_id",
        "series_id",
        "insert_s",
        F.when(gap > 0, gap).alias("late_s"),
    )


def bin_index(minutes: Column) -> Column:
    """Six-minute bin, values past the last edge in the last bin."""
    return F.least(
        F.greatest(F.floor(minutes / BIN_MINUTES), F.lit(0)), F.lit(BINS - 1)
    ).cast("int")


def late_minutes() -> Column:
    return F.col("late_s") / 60.0


def bin_counts(late: DataFrame, by: list[str]) -> DataFrame:
    """Readings counted per group and bin, those on time in a bin without number."""
    return late.groupBy(
        *by, F.when(F.col("late_s").isNotNull(), bin_index(late_minutes())).alias("bin")
    ).agg(
        F.count("*").alias("n"), F.sum("late_s").alias("sum_s"), F.max("late_s").alias("max_s")
    )


def profile(late: DataFrame, by: list[str]) -> DataFrame:
    """Per group its totals and one array of its at most 500 non-empty bins.

    One pass over the readings: they are counted per bin, and all else follows
    from that small table.
    """
    return profile_of(bin_counts(late, by), by)


def profile_of(counted: DataFrame, by: list[str]) -> DataFrame:
    """The same from readings that are counted already, one row per group and bin."""
    is_late = F.col("bin").isNotNull()
    upto = Window.partitionBy(*by).orderBy("bin")
    return (
        counted.withColumn("upto", F.sum(F.when(is_late, F.col("n"))).over(upto))
        .groupBy(*by)
        .agg(
            F.sum("n").alias("records"),
            F.coalesce(F.sum(F.when(is_late, F.col("n"))), F.lit(0)).alias("total"),
            F.sum("sum_s").alias("sum_s"),
            F.max("max_s").alias("max_s"),
            F.sort_array(
                F.collect_list(F.when(is_late, F.struct("bin", "n", "upto")))
            ).alias("bins"),
        )
    )


def histogram(late: DataFrame, by: list[str]) -> DataFrame:
    """All 500 bins of every group, empty ones with count zero."""
    return histogram_of(profile(late, by), by)


def histogram_of(profiles: DataFrame, by: list[str]) -> DataFrame:
    frame = profiles.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    hit = F.try_element_at(F.filter("bins", lambda b: b["bin"] == F.col("bin")), F.lit(1))
    return frame.select(
        *by,
        (F.col("bin") * BIN_MINUTES).alias("bin_left_min"),
        ((F.col("bin") + 1) * BIN_MINUTES).alias("bin_right_min"),
        F.coalesce(hit["n"], F.lit(0)).alias("count"),
    )


def bin_percentile(bins: Column, total: Column, q: Column) -> Column:
    """Percentile inside the first bin that reaches it, by linear interpolation."""
    wanted = q / 100.0 * total
    hit = F.try_element_at(F.filter(bins, lambda b: b["upto"] >= wanted), F.lit(1))
    share = (wanted - (hit["upto"] - hit["n"])) / hit["n"]
    value = F.round(hit["bin"] * BIN_MINUTES + share * BIN_MINUTES, 4)
    return F.when(total > 0, F.when(q <= 0, F.lit(0.0)).otherwise(value))


def cdf(late: DataFrame, by: list[str]) -> DataFrame:
    """1001 percentile points per group, zero where a group has no late reading."""
    return cdf_of(profile(late, by), by)


def cdf_of(profiles: DataFrame, by: list[str]) -> DataFrame:
    q = F.col("i") * F.lit(0.1)
    points = profiles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1000))))
    return points.select(
        *by,
        F.round(q, 1).alias("percentile"),
        F.coalesce(bin_percentile(F.col("bins"), F.col("total"), q), F.lit(0.0)).alias(
            "lateness_min"
        ),
    )


def _percentile_columns() -> list[Column]:
    return [
        bin_percentile(F.col("bins"), F.col("total"), F.lit(float(q))).alias(f"p{q}_min")
        for q in PERCENTILES
    ]


def _ratio() -> Column:
    return F.round(F.col("total") / F.col("records"), 6)


def _mean() -> Column:
    return F.round(F.try_divide(F.col("sum_s") / 60.0, F.col("total")), 4)


def _max() -> Column:
    return F.round(F.col("max_s") / 60.0, 4)


def keys_so_far(readings: DataFrame, mode: str) -> DataFrame:
    """Distinct keys of the mode up to each day."""
    keys = KEYS[mode]
    days = readings.select("day").distinct()
    if not keys:
        return days.withColumn("unique_keys", F.lit(1).cast("bigint"))
    new = (
        readings.groupBy(*keys)
        .agg(F.min("day").alias("day"))
        .groupBy("day")
        .agg(F.count("*").alias("new"))
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("day")
    return days.join(new, "day", "left").select(
        "day", F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("unique_keys")
    )


def day_summary(readings: DataFrame, mode: str, spec: WindowSpec) -> DataFrame:
    """Per day: late share, keys so far, mean, percentiles and maximum."""
    return day_rows(
        profile(lateness(readings, mode, spec), ["mode", "day"]).join(keys_so_far(readings, mode), "day")
    )


def day_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "mode",
        "day",
        F.col("records").alias("total_records"),
        F.col("total").alias("late_records"),
        _ratio().alias("late_ratio"),
        "unique_keys",
        _mean().alias("mean_lateness_min"),
        *_percentile_columns(),
        _max().alias("max_min"),
    )


def overall_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "mode",
        F.col("records").alias("total_records"),
        F.col("total").alias("late_records"),
        _ratio().alias("late_ratio"),
        "unique_keys",
        *_percentile_columns(),
    )


def overall_summary(
    readings: DataFrame, spec: WindowSpec, modes: tuple[str, ...] = MODES
) -> DataFrame:
    """One row per measure: late share, distinct keys and percentiles."""
    parts = []
    for mode in modes:
        late = lateness(readings, mode, spec)
        keys = KEYS[mode]
        unique = (
            readings.agg(F.count_distinct(*keys).alias("unique_keys"))
            if keys
            else readings.limit(1).select(F.lit(1).cast("bigint").alias("unique_keys"))
        )
        parts.append(overall_rows(profile(late, ["mode"]).crossJoin(F.broadcast(unique))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def hourly(readings: DataFrame, mode: str, spec: WindowSpec) -> DataFrame:
    """Late readings by the hour they were inserted."""
    late = lateness(readings, mode, spec).filter(
        F.col("late_s").isNotNull() & F.col("insert_s").isNotNull()
    )
    late = late.withColumn("hour_s", floor_to(F.col("insert_s"), 3600))
    return hour_rows(profile(late, ["mode", "hour_s"]), spec)


def hour_rows(profiles: DataFrame, spec: WindowSpec) -> DataFrame:
    hour = F.substring(local_text(F.col("hour_s") * 1000, spec.zone), 1, 13)
    return profiles.select(
        "mode",
        F.concat(hour, F.lit(":00")).alias("hour"),
        F.col("total").alias("count"),
        _mean().alias("mean_min"),
        *_percentile_columns(),
        _max().alias("max_min"),
    )


def recommended_lateness(readings: DataFrame, spec: WindowSpec) -> DataFrame:
    """Allowed lateness in minutes that keeps 99 % of the late readings."""
    return overall_summary(readings, spec, ("post_window_delay",)).select(
        F.col("p99_min").alias("allowed_lateness_min")
    )
