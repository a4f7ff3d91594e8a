"""The lateness profile carried on from batch to batch, such as day by day.

What later batches need of the readings so far is kept in a folder:

* ``tops/slot=0`` and ``slot=1``: per measure and key the largest event time and the first day.
  Batches write the two in turn, each from the other, so a batch that fails can be run again.
* ``counts/batch=<name>``: readings per measure, day, hour of insertion and bin of lateness. They
  add up, so totals, histograms and percentiles of any days come from them alone.
* ``done/batch=<name>``: one row in one file, written last. A batch without it never happened:
  its counts are not read, and running it again replaces them.

A batch reads its own readings and one row per key, never the readings before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from finality.config import WindowSpec
from finality.functions.windowing import floor_to
from finality.plans import lateness
from finality.plans.lateness import MODES

_DONE = "number bigint, records bigint, errors bigint, modes array<string>, batch string"
_COUNTS = (
    "mode string, day string, hour_s bigint, bin int, n bigint, sum_s bigint, max_s bigint, batch string"
)
_TOPS = "mode string, meter_id string, series_id string, top_s bigint, first_day string"


def batches(spark: SparkSession, state: str) -> DataFrame:
    """The batches that were added, a row each; empty for a new folder."""
    try:
        return spark.read.schema(_DONE).parquet(f"{state}/done")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], _DONE)


def last_batch(spark: SparkSession, state: str):
    """Row of the last batch, or None."""
    return batches(spark, state).orderBy(F.desc("number")).first()


def add_batch(
    state: str,
    name: str,
    readings: DataFrame,
    spec: WindowSpec,
    modes: tuple[str, ...] = MODES,
    errors: int = 0,
) -> None:
    """Add the next readings, whose arrivals all follow those of the batches before.

    Names must ascend as text, as dates do; a name that is not after the last one is
    an error, since what came later has been measured without it. ``readings`` are read once
    per measure and for the keys, so store them first. Besides the reading columns they need
    ``day`` and ``insert_ms``; ``errors`` is kept for the progress table.
    """
    spark = readings.sparkSession
    last = last_batch(spark, state)
    if last is not None and name <= last.batch:
        raise ValueError(f"batch {name} does not follow {last.batch}, the last one in {state}")
    if last is not None and set(last.modes) != set(modes):
        raise ValueError(f"{state} holds the measures {', '.join(sorted(last.modes))}")
    number = 0 if last is None else last.number + 1
    if last is None:
        tops = spark.createDataFrame([], _TOPS)
    else:
        tops = spark.read.schema(_TOPS).parquet(f"{state}/tops/slot={last.number % 2}")

    counts = None
    for mode in modes:
        late = lateness.lateness(readings, mode, spec, tops.filter(F.col("mode") == mode))
        late = late.withColumn("hour_s", floor_to(F.col("insert_s"), 3600))
        part = lateness.bin_counts(late, ["mode", "day", "hour_s"])
        counts = part if counts is None else counts.unionByName(part)
    counts.write.mode("overwrite").parquet(f"{state}/counts/batch={name}")
    _next_tops(readings, tops, modes).write.mode("overwrite").parquet(f"{state}/tops/slot={number % 2}")

    records = spark.read.schema(_COUNTS).parquet(f"{state}/counts").filter(
        (F.col("batch") == name) & (F.col("mode") == modes[0])
    )
    (
        records.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
        .select(
            F.lit(number).cast("bigint").alias("number"),
            "records",
            F.lit(errors).cast("bigint").alias("errors"),
            F.array(*[F.lit(m) for m in modes]).alias("modes"),
        )
        .coalesce(1)
        .write.mode("overwrite")
        .parquet(f"{state}/done/batch={name}")
    )


def _next_tops(readings: DataFrame, tops: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Largest event time and first day per measure and key, after the batch."""
    series = readings.groupBy("meter_id", "series_id").agg(
        F.max(F.expr("event_ms div 1000")).alias("top_s"), F.min("day").alias("first_day")
    )
    keys = F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"),
                *[
                    (F.col(c) if c in lateness.KEYS[mode] else F.lit(None).cast("string")).alias(c)
                    for c in ("meter_id", "series_id")
                ],
            )
            for mode in modes
        ]
    )
    new = series.select(F.explode(keys).alias("k"), "top_s", "first_day").select("k.*", "top_s", "first_day")
    return (
        tops.unionByName(new)
        .groupBy("mode", "meter_id", "series_id")
        .agg(F.max("top_s").alias("top_s"), F.min("first_day").alias("first_day"))
    )


# ------------------------------------------------------------------ results


def profiles(spark: SparkSession, state: str, by: list[str], late_only: bool = False) -> DataFrame:
    """Totals and bins per group over all batches, as ``lateness.profile`` gives them."""
    added = F.broadcast(batches(spark, state).select("batch"))  # a row per batch
    counts = spark.read.schema(_COUNTS).parquet(f"{state}/counts").join(added, "batch", "left_semi")
    if late_only:
        counts = counts.filter("bin IS NOT NULL AND hour_s IS NOT NULL")
    added_up = counts.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"), F.sum("sum_s").alias("sum_s"), F.max("max_s").alias("max_s")
    )
    return lateness.profile_of(added_up, by)


def first_days(spark: SparkSession, state: str) -> DataFrame:
    """Keys per measure and the day that first has them; a measure without keys counts as one."""
    slot = last_batch(spark, state).number % 2
    tops = spark.read.schema(_TOPS).parquet(f"{state}/tops/slot={slot}")
    return tops.groupBy("mode", F.col("first_day").alias("day")).agg(F.count("*").alias("new"))


def day_summary(spark: SparkSession, state: str) -> DataFrame:
    """Per measure and day: late share, keys so far, mean, percentiles and maximum."""
    days = profiles(spark, state, ["mode", "day"])
    upto = Window.partitionBy("mode").orderBy("day")  # a row per day
    keys = F.sum(F.coalesce("new", F.lit(0))).over(upto)
    return lateness.day_rows(
        days.join(first_days(spark, state), ["mode", "day"], "left").withColumn("unique_keys", keys)
    )


def overall_summary(spark: SparkSession, state: str) -> DataFrame:
    """One row per measure over all days."""
    keys = first_days(spark, state).groupBy("mode").agg(F.sum("new").alias("unique_keys"))
    return lateness.overall_rows(profiles(spark, state, ["mode"]).join(keys, "mode"))


def hourly(spark: SparkSession, state: str, spec: WindowSpec) -> DataFrame:
    """Late readings by the hour they were inserted, also where an hour lies in two batches."""
    return lateness.hour_rows(profiles(spark, state, ["mode", "hour_s"], late_only=True), spec)


def histogram(spark: SparkSession, state: str, by: list[str]) -> DataFrame:
    return lateness.histogram_of(profiles(spark, state, by), by)


def cdf(spark: SparkSession, state: str, by: list[str]) -> DataFrame:
    return lateness.cdf_of(profiles(spark, state, by), by)


def progress(spark: SparkSession, state: str) -> DataFrame:
    """Records and parse errors per batch and in total up to it."""
    upto = Window.partitionBy(F.lit(0)).orderBy("number")  # a row per batch
    return batches(spark, state).select(
        "batch",
        "records",
        "errors",
        F.sum("records").over(upto).alias("total_records"),
        F.sum("errors").over(upto).alias("total_errors"),
    )
