"""Anti-pattern rules AP-02 to AP-04, AP-07 and AP-08 as joins of windows, plans and catalogs (AP-05: ``index_rules``, AP-06: ``n_plus_one``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.flatten import fix_leaves
from .rounds import written

SNAP = ["db_id", "captured_at"]


def avoidable_full_scan(windows: DataFrame, ops: DataFrame, tables: DataFrame, live_rows: int = 10_000, selectivity: float = 0.1, calls: int = 2) -> DataFrame:
    """AP-02: a simple select that reads a large table whole for few rows; one finding per query and window.

    ``ops(db_id, query_id, op_pos, access_method, table_name, simple)``.
    """
    scans = ops.filter("simple and access_method in ('full_table_scan', 'full_index_scan')")
    large = tables.filter(F.col("live_rows") >= live_rows).select("db_id", "table_name", "live_rows")
    per_call = F.col("rows") / F.col("calls") / F.col("live_rows")
    found = windows.filter(F.col("calls") >= calls).join(scans, ["db_id", "query_id"]).join(large, ["db_id", "table_name"]).withColumn("selectivity", per_call)
    first = F.row_number().over(Window.partitionBy(*SNAP, "query_id").orderBy("op_pos"))
    return found.filter(F.col("selectivity") <= selectivity).withColumn("r", first).filter("r = 1").select(*SNAP, "query_id", "table_name", "live_rows", "calls", "selectivity")


def leading_columns(facts: DataFrame) -> DataFrame:
    """``(db_id, table_name, column_name, partial_only)``: columns that lead an index; do only partial ones begin with it?"""
    leads = facts.select("db_id", "table_name", F.col("columns")[0].alias("column_name"), "is_partial").filter("column_name is not null")
    return leads.groupBy("db_id", "table_name", "column_name").agg(F.bool_and("is_partial").alias("partial_only"))


def _to_fix(base: DataFrame, conditions: DataFrame, leads: DataFrame, state) -> DataFrame:
    """The condition leaves to change for each scanned query, with whether they stand in an OR."""
    asked = base.select("db_id", "query_id", "table_name").distinct().join(conditions, ["query_id", "table_name"] + (["db_id"] if "db_id" in conditions.columns else []))
    known = asked.join(leads.withColumn("leads", F.lit(True)), ["db_id", "table_name", "column_name"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    nodes = known.withColumn("tree", F.struct("db_id", "query_id", "table_name")).withColumn("state", F.when(F.col("kind") == "leaf", state))
    nodes = written(nodes)
    return nodes.join(fix_leaves(nodes), ["tree", "node_id"])


def non_sargable(base: DataFrame, conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """AP-03: wrapped columns that lead an index and whose rewrite lets the scan use it; one per column.

    ``conditions(query_id, table_name, node_id, parent_id, level, kind, column_name, wrapper,
    comparator)`` are the scans' condition trees. ``partial_only``: only partial indexes
    begin with the column.
    """
    can = F.col("leads") & F.col("comparator").isin("eq", "in", "range", "is_null")
    state = F.when(can & (F.col("wrapper") == "none"), "OK").when(can, "FIX").otherwise("OTHER")
    found = _to_fix(base, conditions, leading_columns(facts), state)
    return found.groupBy("db_id", "query_id", "table_name", "column_name").agg(F.min("wrapper").alias("subtype"), F.bool_or("in_or").alias("in_or"), F.bool_and("partial_only").alias("partial_only"))


def missing_index(base: DataFrame, conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """AP-04: bare columns without a leading index that would let the scan use one.

    Equality before range; a column that has both counts as equality. In an OR each branch
    needs an index of its own (``per_branch``). ``unverified`` are columns of unknown type
    that are compared with a value: an implicit conversion could not be ruled out.
    """
    bare = (F.col("wrapper") == "none") & F.col("comparator").isin("eq", "in", "range", "is_null")
    state = F.when(bare & F.col("leads"), "OK").when(bare, "FIX").otherwise("OTHER")
    found = _to_fix(base, conditions, leading_columns(facts).filter("not partial_only"), state)
    each = found.groupBy("db_id", "query_id", "table_name", "column_name").agg(
        F.min(F.when(F.col("comparator") == "range", 1).otherwise(0)).alias("o"), F.bool_or("in_or").alias("in_or"), F.bool_or(F.col("data_type").isNull() & (F.col("comparator") != "is_null")).alias("unknown")
    )
    grouped = each.groupBy("db_id", "query_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("o", "column_name"))).alias("c"), F.bool_or("in_or").alias("per_branch"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("unknown"), F.col("column_name")))), ", ").alias("unverified")
    )
    names = F.transform("c", lambda x: x["column_name"])
    create = lambda columns: F.concat(F.lit("CREATE INDEX ON "), "table_name", F.lit(" ("), columns, F.lit(")"))
    suggested = F.when(F.col("per_branch"), F.array_join(F.transform(names, create), "; ")).otherwise(create(F.array_join(names, ", ")))
    return grouped.select("db_id", "query_id", "table_name", F.array_join(names, ", ").alias("columns"), suggested.alias("suggested_index"), "per_branch", "unverified")


def disk_spill(windows: DataFrame, high_ms: float = 10_000, medium_ms: float = 1_000) -> DataFrame:
    """AP-07: windows that wrote temporary data or merged sort runs, with kind and severity by time."""
    spill, merges = F.coalesce("spill", F.lit(0)) > 0, F.coalesce("merges", F.lit(0)) > 0
    kind = F.when(spill & merges, "temporary table and sort").when(spill, "temporary data").when(merges, "sort")
    level = F.when(F.col("time_ms") >= high_ms, "high").when(F.col("time_ms") >= medium_ms, "medium").otherwise("low")
    return windows.withColumn("kind", kind).filter("kind is not null").withColumn("severity", level)


def misestimate(windows: DataFrame, estimates: DataFrame, q_error: float = 10, rows: float = 100, high: float = 100) -> DataFrame:
    """AP-08: the plan's estimated rows against the rows of the execution that gave the plan, both taken as one at least.

    ``estimates(db_id, query_id, captured_at, estimated, actual, shape)``: the snapshot's plans.
    A plan without an execution's own rows says nothing of its estimate and is left out, as
    is a query whose output is not its scan's (``shape`` not null: aggregate, limit ...). The
    windows only tell that the query ran since the snapshot before, and its time.
    """
    told = estimates.filter("estimated is not null and actual is not null and shape is null").drop("shape")
    joined = windows.join(told, [*SNAP, "query_id"])
    e, a = F.greatest("estimated", F.lit(1.0)), F.greatest("actual", F.lit(1.0))
    judged = joined.withColumn("q_error", F.greatest(e / a, a / e)).filter((F.col("q_error") >= q_error) & (F.greatest("estimated", "actual") >= rows))
    return judged.select(*SNAP, "query_id", "estimated", "actual", "q_error", F.round("time_ms", 3).alias("impact_ms"), F.when(F.col("estimated") > F.col("actual"), "over").otherwise("under").alias("direction"), F.when(F.col("q_error") >= high, "high").otherwise("medium").alias("severity"))


# What each rule says of a finding with its query and its detail, what to do and what that risks, by variant; "" is for all others.
TEXTS = {
    "AP-01": {"": ("Query %s has become slower than its own history; severity %s.", "Compare its plan with an earlier one and refresh the statistics of its tables.", "New statistics may change other plans too.")},
    "AP-02": {"": ("Query %s reads all of %s for few rows.", "Let it filter by the first column of an index, or add one.", "An index slows every write to the table.")},
    "AP-03": {
        "": ("Query %s wraps column %s, so its index cannot serve.", "Compare the bare column.", "The rewritten condition must keep the same rows, nulls too."),
        "function": ("Query %s calls a function on column %s, so its index cannot serve.", "Move the function to the other side, or index the expression.", "An index on an expression slows every write and serves that expression only."),
        "arithmetic": ("Query %s calculates with column %s, so its index cannot serve.", "Move the calculation to the other side.", "Rounding may differ on the other side."),
        "cast": ("Query %s converts column %s, so its index cannot serve.", "Give the value the column's type.", "A value that is not of that type then fails."),
    },
    "AP-04": {
        "": ("Query %s scans the table for want of an index: %s.", "Create the index at a quiet time.", "Building it may hold up writes; each write costs more from then on."),
        "per_branch": ("Query %s has branches that need an index each: %s.", "Create all of them, since one alone does not help.", "Each of them costs space and slows writes."),
    },
    "AP-05": {
        "low": ("No query uses an index, least of all %s: %s.", "Make sure of rare jobs, then drop it.", "A job that has not run in the time observed would read the whole table."),
        "high": ("Query %s filters by the first column of %s and does not use it.", "Find out why: analyse the table or define the index anew.", "New statistics may change other plans too."),
    },
    "AP-06": {
        "one_to_many": ("Query %s is called once for each row of its parent along %s.", "Fetch the rows of all parents with one join or one list.", "One large result takes more memory than many small ones."),
        "many_to_one": ("Query %s fetches by its key, once for each row, what %s refers to.", "Join the referenced table in the first query, or keep what was read.", "What is kept may become stale."),
    },
    "AP-07": {
        "": ("Query %s wrote %s to disk.", "Raise the memory of its sorts and tables, or sort less.", "More memory a query is more memory for all that run at once."),
        "sort": ("Query %s merged runs of a %s on disk.", "Read in the order of an index, or raise the memory of sorts.", "More memory a sort is more memory for all that run at once."),
    },
    "AP-08": {
        "over": ("The row estimate of query %s is far %s what it returns.", "Analyse its tables; then raise the detail of their statistics.", "Plans made for many rows may change for the worse elsewhere."),
        "under": ("The row estimate of query %s is far %s what it returns.", "Analyse its tables; then tell the optimizer which columns go together.", "Extended statistics make analysing slower."),
    },
    "CT-01": {"": ("Sessions (%s) lock rows in opposite order: report %s.", "Let all transactions take their locks in one order.", "None for the data; code that relies on the old order must change with it.")},
    "CT-02": {"": ("Sessions (%s) turn shared locks into exclusive ones: report %s.", "Ask for the exclusive lock at once.", "Readers of those rows wait longer.")},
    "CT-03": {"": ("Sessions (%s) insert into gaps that others hold: report %s.", "Shorten the transactions, or lock without gaps where that is allowed.", "Without gap locks a range may have new rows when it is read again.")},
    "CT-04": {"": ("A statement (%s) locks far more rows than it changes: report %s.", "Add an index for its condition.", "An index slows every write to the table.")},
    "CT-05": {"": ("A long transaction (%s) holds up other sessions: process %s.", "End it, or cut it into shorter ones.", "What it has done so far is undone if it is ended.")},
}


def text_rows() -> list[tuple[str, str, str, str, str]]:
    """``TEXTS`` as rows (rule, variant, explanation, recommendation, risk)."""
    return [(rule, variant, *said) for rule, variants in TEXTS.items() for variant, said in variants.items()]


def render_texts(findings: DataFrame) -> DataFrame:
    """Explanation, recommendation and risk of each finding, by rule and variant.

    ``findings(rule, variant, query_id, detail)``; a variant without texts of its own takes the
    rule's general ones, a finding without a query says "-" for it.
    """
    cases = [(F.col("rule") == rule) & (F.coalesce("variant", F.lit("")) == variant if variant else F.lit(True)) for rule, variant, *_ in _by_variant()]
    pick = lambda made: F.coalesce(*[F.when(c, made(row)) for c, row in zip(cases, _by_variant())])
    said = pick(lambda r: F.format_string(r[2], F.coalesce("query_id", F.lit("-")), "detail"))
    return findings.withColumn("text", said).withColumn("recommendation", pick(lambda r: F.lit(r[3]))).withColumn("risk", pick(lambda r: F.lit(r[4])))


def _by_variant() -> list[tuple[str, str, str, str, str]]:
    return sorted(text_rows(), key=lambda r: r[1] == "")  # the general ones last


def detect_all(found: dict[str | tuple[str, ...], DataFrame], rule: str | None = None) -> DataFrame:
    """One table of all rules' findings, or of one rule's.

    Each frame has db_id, detail, and captured_at, query_id and variant where the rule knows them;
    one of several rules, under their tuple, says in ``rule`` whose each finding is.
    """
    out = None
    for name, df in found.items():
        several = isinstance(name, tuple)
        if rule is None or rule == name or several and rule in name:
            own = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)  # noqa: E731, B023
            part = df.select("db_id", own("captured_at", "timestamp_ntz"), own("query_id", "string"), F.col("detail").cast("string").alias("detail"), own("variant", "string"), (F.col("rule") if several else F.lit(name)).alias("rule"))
            part = part.filter(F.col("rule") == rule) if several and rule else part
            out = part if out is None else out.unionByName(part)
    return out


def findings_by_rule(findings: DataFrame) -> DataFrame:
    """How many findings each rule has, of each query."""
    return findings.groupBy("rule", "query_id").agg(F.count("*").alias("n"), F.countDistinct("db_id").alias("databases"))
