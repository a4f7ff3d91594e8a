"""Prefix aggregates over an order, in blocks.

A plain ``Window.orderBy(seq)`` puts a whole key (or, without keys, the whole
table) into one task. Here the order is cut into blocks by one or more levels
of columns, coarse to fine: for a unique integer order a block of ``2**bits``
values never holds more rows than that, whatever the data looks like. Block
totals come from a partial aggregate, are summed up along the much smaller
tables of blocks, and are joined back to the rows, which are scanned inside
their block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_FUNCTIONS = {"max": F.max, "min": F.min, "sum": F.sum}
TOP_BITS = 12

Levels = list[dict[str, Column]]


def blocks_of(order: str, bits: int) -> Levels:
    """Two levels over an integer order: blocks, and groups of 4096 blocks.

    Not nullable, so that joins add no null filters and all branches share one
    aggregate of the source.
    """
    block = F.coalesce(F.shiftright(F.col(order), bits), F.lit(0))
    return [{"_top": F.shiftright(block, TOP_BITS)}, {"_blk": block}]


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind == "max":
        return F.greatest(left, right)
    if kind == "min":
        return F.least(left, right)
    return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))


def _before(partition: list[str], order: list[str], descending: bool):
    by = [F.col(c).desc() if descending else F.col(c) for c in order]
    return Window.partitionBy(*partition).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def total_prefix(
    totals: DataFrame,
    levels: list[list[str]],
    kinds: dict[str, str],
    keys: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Exclusive prefix of block totals as columns ``_before_<name>``.

    ``totals`` has one row per finest block, ``kinds`` maps its value columns
    to ``max``, ``min`` or ``sum``. Each level is scanned within the next
    coarser one.
    """
    keys = keys or []
    result, outer = None, []
    for depth, level in enumerate(levels):
        columns = [*keys, *outer, *level]
        finest = depth == len(levels) - 1
        table = totals if finest else totals.groupBy(*columns).agg(
            *[_FUNCTIONS[kind](name).alias(name) for name, kind in kinds.items()]
        )
        before = _before([*keys, *outer], level, descending)
        table = table.select(
            *columns,
            *[_FUNCTIONS[kind](name).over(before).alias(f"_here_{name}") for name, kind in kinds.items()],
        )
        if result is None:
            result = table.withColumnsRenamed({f"_here_{n}": f"_before_{n}" for n in kinds})
        else:
            result = table.join(result, [*keys, *outer]).select(
                *columns,
                *[
                    _merge(kind, F.col(f"_before_{name}"), F.col(f"_here_{name}")).alias(
                        f"_before_{name}"
                    )
                    for name, kind in kinds.items()
                ],
            )
        outer += level
    return result


def running(
    df: DataFrame,
    levels: Levels,
    order: list[str],
    aggregates: dict[str, tuple[str, Column]],
    keys: list[str] | None = None,
    inclusive: bool = False,
    keep: Column | None = None,
    block: list[str] | None = None,
) -> DataFrame:
    """Add running aggregates along ``levels`` and ``order`` within ``keys``.

    ``aggregates`` maps an output name to ``(kind, column)`` with kind ``max``,
    ``min`` or ``sum``; ``inclusive`` counts the current row. Rows failing
    ``keep`` still take part in the scan, with their other columns emptied
    before the shuffle, and are dropped afterwards. ``block`` lists the level
    columns that identify a block, all of them by default; rows are partitioned
    by these alone. They stay in the result.
    """
    keys = keys or []
    names = [list(level) for level in levels]
    blocks = [name for level in names for name in level]
    block = block or blocks
    inputs = {name: f"_in_{name}" for name in aggregates}
    kinds = {name: kind for name, (kind, _) in aggregates.items()}
    rows = df.withColumns(
        {name: column for level in levels for name, column in level.items()}
        | {inputs[name]: column for name, (_, column) in aggregates.items()}
    )
    totals = rows.groupBy(*keys, *blocks).agg(
        *[_FUNCTIONS[kind](inputs[name]).alias(name) for name, kind in kinds.items()]
    )
    prior = total_prefix(totals, names, kinds, keys).drop(*[c for c in blocks if c not in block])

    if keep is not None:
        needed = {*order, *keys, *blocks, *inputs.values(), "_keep"}
        rows = rows.withColumn("_keep", F.coalesce(keep, F.lit(False)))
        rows = rows.select(
            *[
                F.col(c) if c in needed else F.when(F.col("_keep"), F.col(c)).alias(c)
                for c in rows.columns
            ]
        )
    within = (
        Window.partitionBy(*keys, *block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    scanned = rows.withColumns(
        {f"_here_{name}": _FUNCTIONS[kind](inputs[name]).over(within) for name, kind in kinds.items()}
    )
    if keep is not None:
        scanned = scanned.filter("_keep").drop("_keep")
    return scanned.join(prior, [*keys, *block]).select(
        *df.columns,
        *block,
        *[
            _merge(kind, F.col(f"_before_{name}"), F.col(f"_here_{name}")).alias(name)
            for name, kind in kinds.items()
        ],
    )
