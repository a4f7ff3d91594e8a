"""Local time text and epoch values, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"


def epoch_ms(text: Column, zone: str) -> Column:
    """Local timestamp text with up to six fraction digits to epoch ms, or null."""
    local = F.when(text.rlike(_STAMP), text).try_cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return (
        F.unix_date(utc.cast("date")).cast("bigint") * 86_400_000
        + F.hour(utc) * 3_600_000
        + F.minute(utc) * 60_000
        + F.floor(F.extract(F.lit("SECOND"), utc) * 1000).cast("bigint")
    )


def local_text(ms: Column, zone: str) -> Column:
    """Epoch ms as ``yyyy-MM-dd HH:mm:ss`` in a zone."""
    seconds = F.floor(ms / 1000).cast("bigint")
    utc = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("string")


def local_day(ms: Column, zone: str) -> Column:
    """Epoch ms as ``yyyy-MM-dd`` in a zone."""
    return F.substring(local_text(ms, zone), 1, 10)


def instant_text(ms: Column) -> Column:
    """Epoch ms as ``yyyy-MM-ddTHH:mm:ssZ``."""
    return F.concat(F.replace(local_text(ms, "UTC"), F.lit(" "), F.lit("T")), F.lit("Z"))
