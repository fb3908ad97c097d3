"""Running values in an order, for groups of any size.

A window without keys, or with one hot key, is one task. Here rows are dealt by ranges of (key,
order) and written once with the number of their range; a range adds up its own rows, and what the
earlier ranges of its first key hold comes by a table of at most one row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stage

PART = "_part"


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], stage: Stage, name: str = "ranged", readers: int = 1) -> DataFrame:
    """df in ranges of (by, order), with the range's number: written, so that every reader sees the same ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage.keep(df.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()), name, readers)


def _aggregate(kind: str, value: Column, order: Sequence[str], backwards: bool = False) -> Column:
    if kind in ("last", "lag"):  # of those that are not null
        return (F.min_by if backwards else F.max_by)(value, F.when(value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "count": F.count}[kind](value)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], backwards: bool = False, few: bool = True) -> DataFrame:
    """Rows of ranged() with each named value over all rows of its key up to and with its own; backwards: from its own on.

    values: name to ("sum" | "count" | "max" | "last" | "lag", column); "last" passes over nulls, and "lag" is the value of
    the row before (none of its values is null). Rows that are equal in the order come in any order, so it should tell rows apart.
    few: keys that go on from range to range are as many as there are ranges at most, as ranged() makes them.
    """
    turned = [F.desc(c) if backwards else F.asc(c) for c in order]
    whole = Window.partitionBy(PART, *by).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0)
    alone = Window.partitionBy(PART, *by).orderBy(*turned)
    local = {n: F.last(c, True).over(whole) if kind == "last" else F.lag(c).over(alone) if kind == "lag" else _aggregate(kind, c, order).over(whole) for n, (kind, c) in values.items()}
    totals = rows.groupBy(PART, *by).agg(*[_aggregate(kind, c, order, backwards).alias(n) for n, (kind, c) in values.items()])
    w = Window.partitionBy(*by).orderBy(F.desc(PART) if backwards else F.asc(PART))  # ranges of a key: no more than there are partitions
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    over = {n: F.last(n, True).over(earlier) if kind in ("last", "lag") else {"sum": F.sum, "count": F.sum, "max": F.max}[kind](n).over(earlier) for n, (kind, _) in values.items()}
    before = totals.select(F.col(PART).alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], F.row_number().over(w).alias("_nth"), *[c.alias(f"_before_{n}") for n, c in over.items()]).where("_nth > 1").drop("_nth")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col(PART) == F.col("_p"))
    out = rows.withColumns(local).join(F.broadcast(before) if few else before, same, "left")
    both = {"sum": lambda n: F.when(F.col(n).isNull(), F.col(f"_before_{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))), "max": lambda n: F.greatest(n, f"_before_{n}"), "last": lambda n: F.coalesce(n, f"_before_{n}")}
    both["count"], both["lag"] = both["sum"], both["last"]
    out = out.withColumns({n: both[kind](n) for n, (kind, _) in values.items()})
    return out.drop("_p", *[f"_by_{c}" for c in by], *[f"_before_{n}" for n in values])


def in_chunks(df: DataFrame, by: Sequence[str], number: str, chunk: int, values: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """running() of rows that a column numbers: they are cut where it passes a multiple of chunk, and nothing is written.

    A key with most rows is as many tasks as it has chunks.
    """
    rows = df.withColumn(PART, F.floor(F.col(number) / chunk))
    return running(rows, by, [number], values, backwards, few=False).drop(PART)


def numbered(df: DataFrame, order: Sequence[str], name: str, stage: Stage) -> DataFrame:
    """df with its rows numbered from 1 in this order, which tells rows apart."""
    return running(ranged(df, [], order, stage, name, readers=2), [], order, {name: ("sum", F.lit(1).cast("long"))}).drop(PART)
