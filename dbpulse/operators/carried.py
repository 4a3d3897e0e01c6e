"""Running values over one key's whole history in many tasks: a two-level carried scan.

A window partitioned by database puts a database's history into one task. Here rows are put
in order by a range shuffle over (key, time), so a long history lies in several ranges; each
range computes its running values by itself, leaves one row with its totals, and what the
ranges before leave is carried into it. The carry holds one row per range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import written

RANGE = "__range"


def carried(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], own: bool = True, partitions: int | None = None) -> DataFrame:
    """``df`` with running values added: name -> (``max``, ``sum`` or ``last``, column).

    They run over the rows of equal ``by`` (none: over all rows; nulls are a key) in the
    ascending order of ``order``, nulls first, up to the row itself, or without it where
    ``own`` is false. ``last`` is the last value that is not null; to get a row's value even if
    null, wrap it in a struct. ``order`` should settle ties.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_values = df.select("*", *[c.alias(f"__{name}") for name, (_, c) in values.items()])
    placed = written(with_values.repartitionByRange(n, *by, *order).withColumn(RANGE, F.spark_partition_id()))
    inside = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)

    def run(kind: str, column: str, window: Window) -> Column:
        return {"max": F.max, "sum": F.sum}[kind](column).over(window) if kind != "last" else F.last(column, ignorenulls=True).over(window)

    def total(kind: str, column: str) -> Column:
        if kind == "last":
            return F.max_by(column, F.when(F.col(column).isNotNull(), place))
        return {"max": F.max, "sum": F.sum}[kind](column)

    ends = placed.groupBy(RANGE, *by).agg(*[total(kind, f"__{name}").alias(f"__{name}") for name, (kind, _) in values.items()])
    carry = ends.select(F.col(RANGE).alias("__r"), *[F.col(b).alias(f"__by_{b}") for b in by], *[run(kind, f"__{name}", before).alias(f"__c_{name}") for name, (kind, _) in values.items()])
    same = [F.col(RANGE) == F.col("__r"), *[F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]]
    joined = placed.select("*", *[run(kind, f"__{name}", inside).alias(f"__o_{name}") for name, (kind, _) in values.items()]).join(carry, same)

    def both(name: str, kind: str) -> Column:
        mine, theirs = F.col(f"__o_{name}"), F.col(f"__c_{name}")
        if kind == "sum":
            return F.coalesce(mine + theirs, mine, theirs)
        return F.greatest(mine, theirs) if kind == "max" else F.coalesce(mine, theirs)

    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[both(name, kind).alias(name) for name, (kind, _) in values.items()])


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with a struct ``previous`` of the named columns of the row before, null at a key's first."""
    return carried(df, by, order, {"previous": ("last", F.struct(*columns))}, own=False, partitions=partitions)
