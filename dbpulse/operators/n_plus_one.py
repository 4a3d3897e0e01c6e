"""AP-06: a query called about once for each row that another query returned, along a foreign key.

Calls and rows meet by a banded equality join: both are put on a logarithmic grid whose
cells are as wide as the band, a child asks its own and both neighbouring cells, and the exact
band is the residual condition. So a snapshot with many children and many parents of one
table meets those of like counts only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAP = ["db_id", "captured_at"]


def relations(fks: DataFrame) -> DataFrame:
    """Both directions of each foreign key: the table whose key a child filters by and the table its parent reads.

    ``fks(db_id, schema_name, table_name, constraint_name, column_name,
    referenced_schema, referenced_table, referenced_column)``, a row per column. Names in
    lower case; rows without a table or column are left out.
    """
    low = [F.lower(c).alias(c) for c in ("schema_name", "table_name", "column_name", "referenced_schema", "referenced_table", "referenced_column")]
    named = fks.select("db_id", "constraint_name", *low).filter("table_name is not null and column_name is not null and referenced_table is not null and referenced_column is not null")
    keys = named.groupBy("db_id", "schema_name", "table_name", "constraint_name").agg(
        F.collect_set("column_name").alias("own"), F.min("referenced_schema").alias("rs"), F.min("referenced_table").alias("rt"), F.collect_set("referenced_column").alias("theirs")
    )
    side = lambda direction, s, t, key, ps, pt: F.struct(F.lit(direction).alias("direction"), F.col(s).alias("child_schema"), F.col(t).alias("child_table"), F.col(key).alias("key"), F.col(ps).alias("parent_schema"), F.col(pt).alias("parent_table"))
    both = F.array(side("one_to_many", "schema_name", "table_name", "own", "rs", "rt"), side("many_to_one", "rs", "rt", "theirs", "schema_name", "table_name"))
    return keys.select("db_id", "constraint_name", F.inline(both))


def _same_schema(a: str, b: str):
    return F.col(a).isNull() | F.col(b).isNull() | (F.lower(a) == F.lower(b))


def n_plus_one(windows: DataFrame, reads: DataFrame, equal: DataFrame, fks: DataFrame, calls: int = 50, tolerance: float = 0.2, per_call: float = 2.0, high: int = 500) -> DataFrame:
    """One finding per child and window, with its closest parent.

    ``windows(db_id, query_id, captured_at, window_start, is_new, calls, rows, time_ms)``;
    ``reads(db_id, query_id, schema_name, table_name)``; ``equal`` the same with the columns
    that are compared with a parameter. Both windows must begin alike: at the same snapshot, or
    both are new. Schemas must agree where both are known. The impact is the child's time
    and the parent's; null without the child's.
    """
    if not 0 < tolerance < 1:
        raise ValueError("tolerance must lie between 0 and 1")
    # |calls - rows| <= tolerance * rows keeps their logarithms within this step
    step = -math.log(1 - tolerance)
    cell = lambda n: F.floor(F.log(F.col(n).cast("double")) / step)
    begins = F.when(F.col("is_new"), F.lit(-1)).otherwise(F.unix_micros(F.col("window_start").cast("timestamp"))).alias("begins")
    rel = relations(fks)
    filtered = equal.groupBy("db_id", "query_id", "schema_name", F.lower("table_name").alias("child_table")).agg(F.collect_set(F.lower("column_name")).alias("eq"))
    child = (
        windows.filter(F.col("calls") >= calls).join(filtered, ["db_id", "query_id"]).join(rel, ["db_id", "child_table"])
        .filter((F.size(F.array_except("key", "eq")) == 0) & _same_schema("schema_name", "child_schema"))
        .select(*SNAP, begins, F.col("query_id").alias("child_id"), F.col("calls").alias("child_calls"), F.col("time_ms").alias("child_ms"), "constraint_name", "direction", "child_table", "parent_schema", "parent_table", F.explode(F.array(*[cell("calls") + k for k in (-1, 0, 1)])).alias("cell"))
    )
    parent = (
        windows.filter((F.col("rows") > 0) & (F.col("rows") >= per_call * F.col("calls"))).join(reads, ["db_id", "query_id"])
        .select(*SNAP, begins, F.col("query_id").alias("parent_id"), F.col("rows").alias("parent_rows"), F.col("time_ms").alias("parent_ms"), F.col("schema_name").alias("read_schema"), F.lower("table_name").alias("parent_table"), cell("rows").alias("cell"))
    )
    off = F.abs(F.col("child_calls") - F.col("parent_rows")) / F.col("parent_rows")
    pairs = child.join(parent, [*SNAP, "begins", "parent_table", "cell"]).filter((F.col("child_id") != F.col("parent_id")) & _same_schema("parent_schema", "read_schema")).withColumn("off", off).filter(F.col("off") <= tolerance)
    fields = ["parent_id", "constraint_name", "direction", "child_table", "parent_table", "parent_rows", "parent_ms"]
    best = pairs.groupBy(*SNAP, "child_id", "child_calls", "child_ms").agg(F.min_by(F.struct(*fields), F.struct("off", "parent_id", "constraint_name", "direction", "child_table")).alias("b"))
    return best.select(
        *SNAP, "child_id", *[F.col(f"b.{f}").alias(f) for f in fields[:6]], "child_calls",
        F.round(F.col("child_ms") + F.coalesce("b.parent_ms", F.lit(0.0)), 3).alias("impact_ms"), F.when(F.col("child_calls") >= high, "high").otherwise("medium").alias("severity"),
    )
