"""Numbers, neighbours, extremes and quantiles of long groups, without a group in one task.

Rows of a group are cut into blocks of time or of position, see ``functions.scan``. Null keys make a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finality.functions.scan import Levels, TOP_BITS, running

_BLOCK_BITS = 22
_POSITIONS = 4096
_BIN_BLOCK = 65_536


def _keyed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with their keys as text that is never null."""
    names = [f"_key{i}" for i in range(len(keys))]
    texts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]
    return rows.withColumns(dict(zip(names, texts, strict=True))), names


def by_value(column: str, width: int) -> Levels:
    """Levels over the values of a number: blocks of a width, and groups of them."""
    block = F.coalesce(F.floor(F.col(column) / width), F.lit(0)).cast("bigint")
    return [{"_top": F.shiftright(block, TOP_BITS)}, {"_blk": block}]


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The position of each row in its group from 1; the first column of ``order`` is a time in ms."""
    keyed, names = _keyed(rows, keys)
    levels = by_value(order[0], 1 << _BLOCK_BITS)
    found = running(keyed, levels, order, {"_n": ("sum", F.lit(1))}, keys=names, inclusive=True, block=["_blk"])
    return found.select(*rows.columns, F.col("_n").cast("int").alias(name))


def previous(rows: DataFrame, keys: list[str], time: str, name: str) -> DataFrame:
    """The time of the row before in its group, null for the first."""
    keyed, names = _keyed(rows, keys)
    levels = by_value(time, 1 << _BLOCK_BITS)
    found = running(keyed, levels, [time], {name: ("max", F.col(time))}, keys=names, block=["_blk"])
    return found.select(*rows.columns, name)


def centred_mean(
    rows: DataFrame, keys: list[str], time: str, column: str, before: int, after: int, name: str
) -> DataFrame:
    """Mean of a column over the rows around each row, fewer at both ends of its group.

    Positions are cut into blocks. A row stands in its own block and, as part of the halo, in the blocks whose rows
    reach it, so a block is averaged by itself.
    """
    size = max(_POSITIONS, before + after)
    placed, names = _keyed(numbered(rows, keys, [time], "_at"), keys)
    reached = F.sequence(
        F.floor(F.greatest(F.col("_at") - after, F.lit(0)) / size), F.floor((F.col("_at") + before) / size)
    )
    spread = placed.withColumn("_block", F.explode(reached))
    around = Window.partitionBy(*names, "_block").orderBy("_at").rowsBetween(-before, after)
    return (
        spread.withColumn(name, F.avg(column).over(around))
        .filter(F.col("_block") == F.floor(F.col("_at") / size))
        .select(*[c for c in rows.columns if c != name], name)
    )


def with_extremes(rows: DataFrame, keys: list[str], extremes: dict[str, Column]) -> DataFrame:
    """Aggregates of a group beside each of its rows: a partial aggregate joined back."""
    keyed, names = _keyed(rows, keys)
    short = keyed.groupBy(*names).agg(*[column.alias(name) for name, column in extremes.items()])
    return keyed.join(short, names).drop(*names)


def counted_values(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """``measure, v, n``: how often each value of some whole numbers occurs, in one pass. Nulls don't count."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("measure"), column.cast("bigint").alias("v")) for name, column in measures.items()]
    )
    long = rows.select(F.inline(pairs)).filter("v IS NOT NULL")
    return long.groupBy("measure", "v").agg(F.count("*").alias("n"))


def quantiles(counted: DataFrame, shares: list[float], unit: float = 1.0) -> DataFrame:
    """``measure, quantile, value``: exact quantiles of counted values, linear between neighbours, in a unit.

    Counts are summed up along the values in blocks, and only the values at the wanted ranks go on. A measure
    without a value has no rows.
    """
    upto = running(
        counted,
        by_value("v", _BIN_BLOCK),
        ["v"],
        {"upto": ("sum", F.col("n"))},
        keys=["measure"],
        inclusive=True,
        block=["_blk"],
    )
    total = counted.groupBy("measure").agg(F.sum("n").alias("total"))
    wanted = F.transform(
        F.array(*[F.lit(float(s)) for s in shares]),
        lambda s: F.struct(s.alias("quantile"), ((F.col("total") - 1) * s).alias("rank")),
    )

    def here(rank: Column) -> Column:
        return (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))

    ranked = upto.join(total, "measure").withColumn("w", wanted)
    hits = F.filter("w", lambda w: here(F.floor(w["rank"])) | here(F.ceil(w["rank"])))
    met = ranked.select("measure", "v", "n", "upto", F.explode(hits).alias("w")).select("*", "w.*")
    value = F.col("v") / unit
    low = F.max(F.when(here(F.floor("rank")), value))
    high = F.max(F.when(here(F.ceil("rank")), value))
    part = F.max(F.col("rank") - F.floor("rank"))
    return met.groupBy("measure", "quantile").agg(
        F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias("value")
    )


def quantile_row(
    counted: DataFrame, named: dict[str, tuple[str, float]], unit: float = 1.0
) -> DataFrame:
    """One row with exact quantiles under their names, each of a measure at a share; null without a value."""
    found = quantiles(counted, sorted({share for _, share in named.values()}), unit)
    return found.agg(
        *[
            F.max(F.when((F.col("measure") == m) & (F.col("quantile") == share), F.col("value"))).alias(name)
            for name, (m, share) in named.items()
        ]
    )
