"""Plan documents (JSON trees) as relational operations, for whole tables of stored plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rounds import written

# Node types by kind, and access methods.
SCANS = ["Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan", "Bitmap Index Scan"]
JOINS = ["Nested Loop", "Hash Join", "Merge Join"]
AGGREGATES = ["Aggregate", "HashAggregate", "GroupAggregate"]


SUBQUERIES = ["subquery", "attached_subqueries", "dependent_subquery"]


def _place(pos: str) -> str:
    """A position that sorts as text: its number of digits before it."""
    return f"concat(length(cast({pos} AS string)), ':', {pos})"


def _levels(plans: DataFrame, key: str, column: str, step: str) -> DataFrame:
    """``(key, path, name, node)``: the documents and all that ``step`` reaches from them, level by level until nothing is left.

    Each document is parsed once; a level is written before the next is taken from it, so
    no depth is too deep and nothing is parsed again.
    """
    level = written(plans.select(F.col(key).alias("k"), F.lit("0").alias("path"), F.lit(None).cast("string").alias("name"), F.parse_json(column).alias("node")).filter("node is not null"))
    found = level
    while not level.isEmpty():
        level = written(plans.sparkSession.sql(step, level=level))
        found = found.unionByName(level)
    return found.withColumnRenamed("k", key)


def walk(plans: DataFrame, key: str, column: str, children: str) -> DataFrame:
    """``(key, path, node)``: every node of each tree; ``path`` orders nodes as they are written.

    ``node`` is a VARIANT; its children are the array called ``children``.
    """
    step = f"SELECT k, concat(path, '.', {_place('c.pos')}) AS path, name, c.value AS node FROM {{level}}, LATERAL variant_explode(variant_get(node, '$.{children}', 'variant')) AS c"
    return _levels(plans, key, column, step).drop("name")


def field(name: str, kind: str = "string") -> Column:
    """A field of the VARIANT column ``node``; null where it is absent or of another kind."""
    return F.try_variant_get("node", f"$['{name}']", kind)


def access_method(node_type: Column, condition: Column) -> Column:
    """Sequential and ALL scans read the table; index scans without condition read the whole index."""
    index = node_type.isin("Index Scan", "Index Only Scan", "Bitmap Heap Scan", "Bitmap Index Scan")
    return (
        F.when(node_type.isin("Seq Scan", "ALL"), "full_table_scan").when((index & condition.isNull()) | (node_type == "index"), "full_index_scan")
        .when(index | node_type.isin("ref", "range", "eq_ref", "const"), "index_lookup")
    )


def and_conditions(a: Column, b: Column) -> Column:
    """The conditions that are there, each in parentheses if there are two."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("("), a, F.lit(") AND ("), b, F.lit(")"))).otherwise(F.coalesce(a, b))


def flatten_pg_plan(plans: DataFrame, key: str, column: str) -> DataFrame:
    """Operations of PostgreSQL plans (P01): scans, joins, aggregates, sorts in written order; a scan's alias as the plan names it."""
    nodes = walk(plans, key, column, "Plans")
    node_type, index_cond = field("Node Type"), F.coalesce(field("Index Cond"), field("Recheck Cond"))
    kind = (
        F.when(node_type.isin(*SCANS), "scan").when(node_type.isin(*JOINS), "join").when(node_type.isin(*AGGREGATES), "aggregate")
        .when(node_type == "Sort", "sort").when(node_type == "Unique", "distinct").when(node_type == "Subquery Scan", "subquery")
    )
    return nodes.select(
        key, "path", node_type.alias("node_type"), kind.alias("type"), field("Relation Name").alias("table_name"), field("Alias").alias("alias"), field("Index Name").alias("index_name"),
        and_conditions(index_cond, field("Filter")).alias("predicate"), field("Plan Rows", "double").alias("estimated_rows"), access_method(node_type, index_cond).alias("access_method"),
    ).filter("type is not null")


def bitmap_attrib(ops: DataFrame, key: str) -> DataFrame:
    """Bitmap index scans take the table of the heap scan above; the heap takes the index's name if there is one only."""
    heap = ops.filter("node_type = 'Bitmap Heap Scan'").select(F.col(key).alias("hk"), F.col("path").alias("hp"), F.col("table_name").alias("ht"))
    leaf = ops.filter("node_type = 'Bitmap Index Scan'").select(F.col(key).alias("lk"), F.col("path").alias("lp"), F.col("index_name").alias("li"))
    below = heap.join(leaf, (F.col("hk") == F.col("lk")) & F.col("lp").startswith(F.concat("hp", F.lit("."))))
    down = below.select(F.col("lk").alias(key), F.col("lp").alias("path"), F.col("ht").alias("from_heap"))
    up = below.groupBy(F.col("hk").alias(key), F.col("hp").alias("path")).agg(F.when(F.count("*") == 1, F.max("li")).alias("from_leaf"))
    joined = ops.join(down, [key, "path"], "left").join(up, [key, "path"], "left")
    return joined.withColumn("table_name", F.coalesce("table_name", "from_heap")).withColumn("index_name", F.coalesce("index_name", "from_leaf")).drop("from_heap", "from_leaf")


def flatten_my_plan(plans: DataFrame, key: str, column: str) -> DataFrame:
    """Operations of MySQL plans (P02) with the row estimates of their scans (P06): examined times filtered percent.

    Every key of the document is walked: tables are scans, ``nested_loop`` a join, grouping,
    ordering and removal of duplicates an aggregate, a sort and a distinct, at any depth and
    in any order, subqueries too. ``path`` names the keys and positions; ``in_subquery``
    tells scans of subqueries from those of the statement itself.
    """
    step = f"SELECT k, concat(path, '.', coalesce(c.key, {_place('c.pos')})) AS path, c.key AS name, c.value AS node FROM {{level}}, LATERAL variant_explode(node) AS c"
    nodes = _levels(plans, key, column, step)
    name = F.col("name")
    kind = (
        F.when((name == "table") & field("table_name").isNotNull(), "scan").when(name == "nested_loop", "join").when(name == "grouping_operation", "aggregate")
        .when(name == "ordering_operation", "sort").when(name == "duplicates_removal", "distinct").when(name.isin(*SUBQUERIES), "subquery")
    )
    scan = kind == "scan"
    examined = F.round(field("rows_examined_per_scan", "double") * field("filtered", "double") / 100, 2)
    flag = F.when(kind == "aggregate", field("using_temporary_table")).when(kind == "sort", field("using_filesort"))
    predicate = F.when(scan, and_conditions(field("index_condition"), field("attached_condition"))).otherwise(flag)
    return nodes.filter(kind.isNotNull()).select(
        key, "path", kind.alias("type"), field("table_name").alias("table_name"), field("key").alias("index_name"),
        F.when(scan, access_method(field("access_type"), F.lit(None).cast("string"))).alias("access_method"), predicate.alias("predicate"),
        F.when(scan, F.coalesce(examined, field("rows_produced_per_join", "double"))).alias("estimated_rows"), F.when(scan, field("rows_produced_per_join", "double")).alias("produced"),
        F.exists(F.split("path", r"\."), lambda p: p.isin(*SUBQUERIES)).alias("in_subquery"),
    )


def output_rows(ops: DataFrame, key: str) -> DataFrame:
    """Rows that come out of a plan: those of the last table of the statement's own loop (P06); and what all its scans return."""
    scans = ops.filter("type = 'scan'")
    return scans.groupBy(key).agg(F.max_by(F.when(~F.col("in_subquery"), F.col("produced")), F.when(~F.col("in_subquery"), F.col("path"))).alias("output_rows"), F.sum("estimated_rows").alias("scanned_rows"))


def logical_shape(ops: DataFrame, key: str) -> DataFrame:
    """Operations of each kind per plan."""
    return ops.groupBy(key).pivot("type", ["scan", "join", "aggregate", "sort", "distinct", "subquery"]).count().na.fill(0)


PRIORITY = ["auto_explain", "history", "generic", "sample"]


def best_plan(plans: DataFrame, key: list[str]) -> DataFrame:
    """The plan of the best source: logged, historical, generic, sample; the cheapest of equals."""
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("explain_source"))
    rest = [c for c in plans.columns if c not in key]
    return plans.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(place, "total_cost", "plan_id")).alias("p")).select(*key, "p.*")


def node_usability(nodes: DataFrame) -> DataFrame:
    """Every node of condition trees with ``now`` and ``fixed``: can an index serve it as it is, or with all fixes (P09)?

    ``nodes(tree, node_id, parent_id, level, kind, state)``: kind and, or, leaf; a leaf's
    state is OK, FIX (usable after a change) or OTHER. AND needs one usable child, OR all.
    ``has_or`` tells subtrees with an OR. Level by level from the deepest there is.
    """
    leaf = F.col("kind") == "leaf"
    base = nodes.select("tree", "node_id", "parent_id", "level", "kind", "state")
    deepest = base.agg(F.max("level")).first()[0]
    found = under = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = base.filter(F.col("level") == level)
        if under is None:
            joined = here.withColumns({f"{n}_{c}": F.lit(None).cast("boolean") for n in ("any", "all") for c in ("now", "fixed", "has_or")})
        else:
            below = under.groupBy("tree", F.col("parent_id").alias("node_id")).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("any", F.bool_or), ("all", F.bool_and)) for c in ("now", "fixed", "has_or")])
            joined = here.join(below, ["tree", "node_id"], "left")
        value = lambda c, own: F.coalesce(F.when(leaf, own).when(F.col("kind") == "and", F.col(f"any_{c}")).otherwise(F.col(f"all_{c}")), F.lit(False))
        under = written(joined.select(
            "tree", "node_id", "parent_id", "level", "kind", "state", value("now", F.col("state") == "OK").alias("now"), value("fixed", F.col("state").isin("OK", "FIX")).alias("fixed"),
            (~leaf & ((F.col("kind") == "or") | F.coalesce("any_has_or", F.lit(False)))).alias("has_or"),
        ))
        found = under if found is None else found.unionByName(under)
    return found if found is not None else base.withColumns({c: F.lit(None).cast("boolean") for c in ("now", "fixed", "has_or")})


def usable_tree(nodes: DataFrame) -> DataFrame:
    """``(tree, usable, fixable)`` of the roots (P09): fixable trees are not usable now but would be with all fixes."""
    return node_usability(nodes).filter("level = 0").select("tree", F.col("now").alias("usable"), (~F.col("now") & F.col("fixed")).alias("fixable"))


def fix_leaves(nodes: DataFrame) -> DataFrame:
    """``(tree, node_id, in_or)``: the leaves to change so that a fixable tree becomes usable.

    Of an OR every branch that is not usable now; of an AND its fixable parts, those without
    an OR if there are any, since one change is enough there.
    """
    known = node_usability(nodes)
    level = known.filter("level = 0 and not now and fixed").select("tree", "node_id", "kind", F.lit(False).alias("in_or"))
    found = level.filter("kind = 'leaf'")
    while True:
        level = written(level.filter("kind != 'leaf'"))
        if level.isEmpty():
            return found.select("tree", "node_id", "in_or")
        above = level.select("tree", F.col("node_id").alias("parent_id"), F.col("kind").alias("p_kind"), "in_or")
        children = known.join(above, ["tree", "parent_id"]).withColumn("plain", F.max((F.col("fixed") & ~F.col("has_or")).cast("int")).over(Window.partitionBy("tree", "parent_id")))
        chosen = F.when(F.col("p_kind") == "or", ~F.col("now")).otherwise(F.col("fixed") & ((F.col("plain") == 0) | ~F.col("has_or")))
        level = children.filter(chosen).select("tree", "node_id", "kind", (F.col("in_or") | (F.col("p_kind") == "or")).alias("in_or"))
        found = found.unionByName(level.filter("kind = 'leaf'"))
