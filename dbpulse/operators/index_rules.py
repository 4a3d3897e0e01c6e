"""AP-05: indexes that nothing uses, and indexes that another one covers.

An index is known by database, schema, table and name: names repeat over tables and schemas.
A query's schema may be unknown (null) or one that does not hold the table; where that
leaves one candidate it counts, and a plan that may mean several indexes counts for all of
them, so that a doubt never makes a finding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = ["db_id", "schema_name", "table_name"]
INDEX = [*TABLE, "index_name"]


def _on(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of which the schema may be null on both sides; the right one's are dropped."""
    other = right.toDF(*[f"__{c}" if c in columns else c for c in right.columns])
    same = [F.col(c) == F.col(f"__{c}") for c in columns if c != "schema_name"]
    if "schema_name" in columns:
        # the coalesced schema is a join key like the others, so this is a hash join
        same.append(F.coalesce("schema_name", F.lit("")) == F.coalesce("__schema_name", F.lit("")))
    return left.join(other, same, how).drop(*[f"__{c}" for c in columns])


def at_schema(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(db_id, schema_name, table_name, at)``: for each of left's tables the schema under which right knows it.

    The same schema, else the only candidate if one of both sides has no schema (``at`` may
    then be null itself); without one, or with several, there is no row.
    """
    known = right.select("db_id", "table_name", F.col("schema_name").alias("at")).distinct()
    same = F.col("at").eqNullSafe(F.col("schema_name"))
    met = left.select(*TABLE).distinct().join(known, ["db_id", "table_name"]).filter(same | F.col("at").isNull() | F.col("schema_name").isNull())
    found = met.groupBy(*TABLE).agg(F.bool_or(same).alias("exact"), F.count("*").alias("n"), F.max("at").alias("other"))
    return found.filter("exact or n = 1").select(*TABLE, F.when(F.col("exact"), F.col("schema_name")).otherwise(F.col("other")).alias("at"))


def used_indexes(ops: DataFrame, catalog: DataFrame) -> DataFrame:
    """Indexes that any plan of the database cites.

    A plan whose schema does not hold that index on that table, or that has none, does not
    say which one is meant: it counts for all of that table and name.
    """
    cited = ops.filter("index_name is not null").select("db_id", "table_name", "index_name", F.col("schema_name").alias("cited")).distinct()
    met = catalog.select(*INDEX).join(cited, ["db_id", "table_name", "index_name"]).withColumn("exact", F.col("cited").eqNullSafe(F.col("schema_name")))
    settled = met.filter("exact").select("db_id", "table_name", "index_name", F.coalesce("cited", F.lit("")).alias("c"), F.lit(True).alias("settled")).distinct()
    kept = met.withColumn("c", F.coalesce("cited", F.lit(""))).join(settled, ["db_id", "table_name", "index_name", "c"], "left")
    return kept.filter("exact or settled is null").select(*INDEX).distinct()


def with_reads(facts: DataFrame, used: DataFrame) -> DataFrame:
    """``facts`` with ``in_plans``, and ``has_reads``: scans counted, a last scan known, or cited in a plan."""
    seen = _on(facts, used.withColumn("__seen", F.lit(True)), INDEX, "left").withColumn("in_plans", F.coalesce("__seen", F.lit(False))).drop("__seen")
    return seen.withColumn("has_reads", (F.coalesce("index_scans", F.lit(0)) > 0) | F.col("last_index_scan").isNotNull() | F.col("in_plans"))


def query_traffic(activity: DataFrame, filters: DataFrame, ops: DataFrame) -> DataFrame:
    """Queries that ran and filter a table: its filter columns, whether its plan reads the whole table, time (per query and table)."""
    time = activity.groupBy("db_id", "query_id").agg(F.sum("time_ms").alias("time_ms"))
    scans = ops.filter("access_method in ('full_table_scan', 'full_index_scan')").select("db_id", "query_id", "schema_name", "table_name").distinct().withColumn("scan", F.lit(True))
    by_table = filters.groupBy("db_id", "query_id", "schema_name", "table_name").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))
    joined = _on(by_table.join(time, ["db_id", "query_id"]), scans, ["db_id", "query_id", "schema_name", "table_name"], "left")
    return joined.withColumn("scan", F.coalesce("scan", F.lit(False)))


def filter_traffic(traffic: DataFrame) -> DataFrame:
    """Per table: active queries, filter columns, columns of full scans."""
    each = traffic.select(*TABLE, "query_id", "scan", F.explode("columns").alias("c"))
    texts = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return each.groupBy(*TABLE).agg(F.countDistinct("query_id").alias("queries"), texts("c").alias("columns"), texts(F.when(F.col("scan"), F.col("c"))).alias("scan_columns"))


def redundant_indexes(facts: DataFrame, traffic: DataFrame, freshness: DataFrame) -> DataFrame:
    """Exact copies and strict prefixes of a wider index of the same method, on tables that queries filter.

    Of copies stays: unique before plain, read before unread, more scans, name. Unique indexes
    are never redundant; a partial one covers nothing, is no copy, but may be a prefix (with low
    confidence). The index that covers must have been read, unless the database's statistics
    are too fresh to tell (``freshness(db_id, fresh)``). A copy is named before a wider index.
    """
    known = at_schema(facts, traffic).select(*TABLE)
    usable = _on(facts, known, TABLE, "left_semi").filter((F.size("columns") > 0) & ~F.exists("columns", lambda c: c.isNull()))
    usable = usable.join(freshness, "db_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    worth = F.struct(F.col("is_unique").cast("int"), F.col("has_reads").cast("int"), F.coalesce("index_scans", F.lit(0)))
    usable = usable.select(*INDEX, "method", "columns", "is_unique", "is_partial", "has_reads", "in_plans", "fresh", worth.alias("worth"))
    other = usable.filter("not is_partial").select(*TABLE, "method", *[F.col(c).alias(f"o_{c}") for c in ("index_name", "columns", "worth", "has_reads")])
    pairs = _on(usable.filter("not is_unique"), other, [*TABLE, "method"]).filter("index_name != o_index_name and (fresh or o_has_reads)")
    stays = (F.col("o_worth") > F.col("worth")) | ((F.col("o_worth") == F.col("worth")) & (F.col("o_index_name") < F.col("index_name")))
    copy = (F.col("columns") == F.col("o_columns")) & ~F.col("is_partial") & stays
    prefix = (F.size("o_columns") > F.size("columns")) & (F.slice("o_columns", F.lit(1), F.size("columns")) == F.col("columns"))
    bad = pairs.withColumn("copy", copy).filter(copy | prefix)
    best = bad.groupBy(*INDEX, "in_plans", "is_partial").agg(F.min_by("o_index_name", F.struct(~F.col("copy"), "o_index_name")).alias("covered_by"), F.bool_or("copy").alias("is_copy"))
    return best.select(
        *INDEX, "covered_by", F.when(F.col("is_copy"), "copy").otherwise("prefix").alias("kind"), F.when(F.col("in_plans"), "medium").otherwise("low").alias("severity"),
        F.when(F.col("in_plans") | F.col("is_partial"), "low").otherwise("high").alias("confidence"),
    )


def fk_keepers(fks: DataFrame, facts: DataFrame, redundant: DataFrame) -> DataFrame:
    """For each foreign key the narrowest index whose first columns are the key's, in any order (D05e).

    Partial and redundant indexes do not count; none is kept if one of the others is unique or
    read. ``fks(db_id, schema_name, table_name, constraint_name, column_name)``; names are
    compared in lower case.
    """
    low = lambda df: df.withColumn("table_name", F.lower("table_name")).withColumn("schema_name", F.lower("schema_name"))
    keys = low(fks).groupBy(*TABLE, "constraint_name").agg(F.array_sort(F.collect_set(F.lower("column_name"))).alias("key"))
    fit = low(_on(facts.filter("not is_partial"), redundant.select(*INDEX), INDEX, "left_anti"))
    first = F.array_sort(F.array_distinct(F.transform(F.slice("columns", F.lit(1), F.size("key")), lambda c: F.lower(c))))
    fit = _on(fit, keys, TABLE).filter((F.size("columns") >= F.size("key")) & (first == F.col("key")))
    ranked = fit.groupBy(*TABLE, "constraint_name").agg(F.bool_or(F.col("is_unique") | F.col("has_reads")).alias("safe"), F.min_by("index_name", F.struct(F.size("columns"), "index_name")).alias("index_name"))
    return ranked.filter("not safe").select(*TABLE, "constraint_name", "index_name")


def unused_indexes(facts: DataFrame, redundant: DataFrame, keepers: DataFrame, traffic: DataFrame, freshness: DataFrame) -> DataFrame:
    """AP-05: never read, not redundant, not unique, no foreign key's keeper, on a table that queries filter (D05d).

    Databases with fresh statistics are left out: their counters have not run for long enough.
    Each finding names a query (``pick_query``); it is high where that one filters by the
    index's first column and could have used it.
    """
    idle = facts.filter("not has_reads and not is_unique").join(freshness.filter("fresh").select("db_id"), "db_id", "left_anti")
    for other in (redundant, keepers):
        idle = _on(idle, other.select(*INDEX), INDEX, "left_anti")
    shown = pick_query(idle.select(*INDEX, F.get("columns", F.lit(0)).alias("lead")), traffic)
    return shown.withColumn("severity", F.when(F.col("by_lead"), "high").otherwise("low"))


def pick_query(indexes: DataFrame, traffic: DataFrame) -> DataFrame:
    """The query to show with an index: one that filters its lead column, of these one whose plan reads the whole table, then the most time (D05f).

    ``by_lead``: there is such a filter, so the index could have served.
    """
    placed = _on(indexes, at_schema(indexes, traffic), TABLE)
    queries = traffic.select("db_id", F.col("schema_name").alias("at"), "table_name", "query_id", "columns", "scan", "time_ms").withColumn("at", F.coalesce("at", F.lit("")))
    joined = placed.withColumn("at", F.coalesce("at", F.lit(""))).join(queries, ["db_id", "table_name", "at"])
    leads = F.coalesce(F.array_contains("columns", F.col("lead")), F.lit(False))
    order = F.struct(leads, leads & F.col("scan"), F.coalesce("time_ms", F.lit(0.0)), "query_id")
    return joined.groupBy(*INDEX).agg(F.max_by("query_id", order).alias("query_id"), F.bool_or(leads).alias("by_lead"))
