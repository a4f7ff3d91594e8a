"""Method labels, probe names and safe ratios as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from finality.config import MODES

# Display label and order of the methods and their older names.
METHODS = {
    "fast": ("SW", 0),
    "baseline1": ("SW", 0),
    "delayed": ("DWW", 1),
    "baseline2": ("DWW", 1),
    "baseline": ("ALW", 2),
    "baseline3": ("ALW", 2),
    "proposed": ("CBW", 3),
}
LAST = 4


def _case(key: Column, pairs: dict, default: Column) -> Column:
    case = None
    for name, value in pairs.items():
        case = F.when(key == name, value) if case is None else case.when(key == name, value)
    return case.otherwise(default)


def method_label(value: Column) -> Column:
    """Display label; an unknown method keeps its own name."""
    return _case(
        F.lower(F.trim(value)), {name: label for name, (label, _) in METHODS.items()}, F.trim(value)
    )


def method_order(value: Column) -> Column:
    """Position in the display order; unknown methods come last."""
    ranks = {name: rank for name, (_, rank) in METHODS.items()}
    ranks.update({label.lower(): rank for label, rank in METHODS.values()})
    return _case(F.lower(F.trim(value)), ranks, F.lit(LAST))


def probe_mode(probe: Column) -> Column:
    found = F.regexp_extract(probe, f"^({'|'.join(MODES)})_", 1)
    return F.when(found == "", "unknown").otherwise(found)


def probe_stage(probe: Column) -> Column:
    pattern = f"(?s)^({'|'.join(MODES)})_(.*)$"
    return F.when(probe.rlike(pattern), F.regexp_extract(probe, pattern, 2)).otherwise(probe)


def stage_label(probe: Column) -> Column:
    return (
        F.when(probe.endswith("_source_after_ingestion"), "Source")
        .when(probe.endswith("_post_filter"), "Post-filter")
        .otherwise(probe)
    )


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Ratio, zero when the denominator is zero or missing."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent; null when a value is missing or the old one is zero."""
    return F.try_divide(new - old, old) * 100.0


def percent_saving(reference: Column, proposed: Column) -> Column:
    return F.try_divide(reference - proposed, reference) * 100.0
