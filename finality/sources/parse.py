"""Raw ``Struct{name=value,...}`` lines to readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from finality.functions.timecols import epoch_ms

# The fields of a raw line.
FIELDS = (
    "series_id",
    "location_id",
    "meter_id",
    "time",
    "value",
    "value_status",
    "insert_time",
    "extract_time",
)
_BLANKS = "".join(chr(code) for code in range(33))


def _field(pairs: Column, name: str) -> Column:
    """Value of the last pair with that name."""
    return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(-1))["text"]


def parse_strict(lines: DataFrame, zone: str) -> DataFrame:
    """Readings with ``parse_error``: null, or what is wrong with the line.

    A comma separates fields only when a name and an equals sign follow, so
    values may hold commas. All eight fields must be there.
    """
    body = F.expr("substring(value, 8, length(value) - 8)")
    parts = F.filter(F.split(body, r",(?=[a-zA-Z_]+=)"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.btrim(F.substring_index(p, "=", 1), F.lit(_BLANKS)).alias("name"),
            F.btrim(F.substr(p, F.instr(p, "=") + 1), F.lit(_BLANKS)).alias("text"),
        ),
    )
    framed = F.col("value").startswith("Struct{") & F.col("value").endswith("}")
    rows = lines.withColumn("_pairs", F.when(framed, pairs))
    rows = rows.withColumn("_f", F.struct(*[_field(F.col("_pairs"), f).alias(f) for f in FIELDS]))
    stamps = {
        "event_ms": epoch_ms(F.col("_f.time"), zone),
        "insert_ms": epoch_ms(F.col("_f.insert_time"), zone),
        "extract_ms": epoch_ms(F.col("_f.extract_time"), zone),
    }
    number = F.col("_f.value").try_cast("double")
    missing = F.lit(False)
    for name in FIELDS:
        missing = missing | F.col(f"_f.{name}").isNull()
    error = (
        F.when(F.trim("value") == "", "empty line")
        .when(~framed, "not a Struct{...} line")
        .when(missing, "missing field")
        .when(
            F.col("event_ms").isNull() | F.col("insert_ms").isNull() | F.col("extract_ms").isNull(),
            "bad time",
        )
        .when(number.isNull(), "bad value")
    )
    others = [c for c in lines.columns if c != "value"]
    return rows.withColumns(stamps).select(
        *others,
        *[F.col(f"_f.{name}").alias(name) for name in ("series_id", "location_id", "meter_id")],
        "event_ms",
        number.alias("value"),
        F.col("_f.value_status").alias("value_status"),
        "insert_ms",
        "extract_ms",
        error.alias("parse_error"),
        F.when(error.isNotNull(), F.col("value")).alias("raw"),
    )


def parse_permissive(lines: DataFrame, zone: str) -> DataFrame:
    """Readings for profiling: only meter, series and time are needed.

    Any ``name=value`` pair counts, values end at a comma or brace.
    """
    pattern = r"(?U)(\w+)=([^,}]+)"
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    framed = text.startswith("Struct{") & text.endswith("}")
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("text"),
    )
    rows = lines.filter(text != "").withColumn("_pairs", F.when(framed, pairs))
    others = [c for c in lines.columns if c != "value"]

    def stamp(name: str) -> Column:
        return epoch_ms(F.btrim(_field(F.col("_pairs"), name), F.lit(_BLANKS)), zone)

    parsed = rows.select(
        *others,
        *[_field(F.col("_pairs"), n).alias(n) for n in ("series_id", "location_id", "meter_id")],
        stamp("time").alias("event_ms"),
        _field(F.col("_pairs"), "value").try_cast("double").alias("value"),
        _field(F.col("_pairs"), "value_status").alias("value_status"),
        stamp("insert_time").alias("insert_ms"),
        stamp("extract_time").alias("extract_ms"),
        F.col("_pairs").isNotNull().alias("_framed"),
        F.col("value").alias("raw"),
    )
    error = (
        F.when(~F.col("_framed"), "not a Struct{...} line")
        .when(F.col("meter_id").isNull() | F.col("series_id").isNull(), "missing field")
        .when(F.col("event_ms").isNull(), "bad time")
    )
    return (
        parsed.withColumn("parse_error", error)
        .withColumn("raw", F.when(F.col("parse_error").isNotNull(), F.col("raw")))
        .drop("_framed")
    )


def readings_of(parsed: DataFrame, fail: bool = False) -> DataFrame:
    """The good readings; with ``fail`` a bad line ends the job."""
    good = F.col("parse_error").isNull()
    if fail:
        message = F.concat(F.col("parse_error"), F.lit(": "), F.coalesce("raw", F.lit("")))
        good = F.when(good, True).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.filter(good).drop("parse_error", "raw")


def quarantine(parsed: DataFrame) -> DataFrame:
    """The bad lines and what is wrong with them."""
    keys = [c for c in ("file_name", "arrival_seq") if c in parsed.columns]
    return parsed.filter("parse_error IS NOT NULL").select(*keys, "parse_error", "raw")
