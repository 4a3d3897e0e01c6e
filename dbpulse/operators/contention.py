"""Lock waits and deadlocks: chains of waiting sessions, deadlock patterns, events and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried
from .rounds import written


def wait_edges(sessions: DataFrame) -> DataFrame:
    """``(db_id, waiter, blocker)`` from ``sessions(db_id, process_id, blocking_pids)``, without self edges."""
    edges = sessions.select("db_id", F.col("process_id").alias("waiter"), F.explode("blocking_pids").alias("blocker"))
    return edges.filter("waiter != blocker").distinct()


def wait_roots(edges: DataFrame) -> DataFrame:
    """Sessions that block and do not wait."""
    blockers = edges.select("db_id", F.col("blocker").alias("root")).distinct()
    return blockers.join(edges.select("db_id", F.col("waiter").alias("root")).distinct(), ["db_id", "root"], "left_anti")


def blocked_under(edges: DataFrame) -> DataFrame:
    """``(db_id, root, member, depth)``: all sessions under each root; depth is the least.

    Jumps of doubling length: after k rounds each session knows whom it reaches in 2**k
    waits, or its roots within them. Chains of any length take as many rounds as their
    length has binary digits; sessions in wait cycles have no root and end with the last round.
    """
    root = wait_roots(edges).select("db_id", F.col("root").alias("over"), F.lit(True).alias("is_root"))
    jumps = edges.select("db_id", F.col("waiter").alias("member"), F.col("blocker").alias("over")).distinct()
    jumps = written(jumps.join(root, ["db_id", "over"], "left").select("db_id", "member", "over", F.coalesce("is_root", F.lit(False)).alias("is_root"), F.lit(1).cast("long").alias("depth")))
    most = jumps.select("db_id", "member").distinct().groupBy("db_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = 1
    while steps < most and not jumps.filter("not is_root").isEmpty():
        far = jumps.select("db_id", F.col("member").alias("over"), F.col("over").alias("o"), F.col("is_root").alias("r"), F.col("depth").alias("d"))
        on = jumps.filter("not is_root").join(far, ["db_id", "over"]).select("db_id", "member", F.col("o").alias("over"), F.col("r").alias("is_root"), (F.col("depth") + F.col("d")).alias("depth"))
        jumps = written(jumps.filter("is_root").unionByName(on).groupBy("db_id", "member", "over", "is_root").agg(F.min("depth").alias("depth")))
        steps *= 2
    return jumps.filter("is_root").select("db_id", F.col("over").alias("root"), "member", "depth")


def long_tx_cascade(roots: DataFrame, age_s: int = 30, wait_s: int = 5, blocked: int = 2, gap_s: int = 60, high_s: int = 120) -> DataFrame:
    """CT-05 (G04). ``roots(db_id, at_s, pid, tx_start_s, n_blocked, min_wait_s, total_wait_s)`` per sample.

    A root qualifies when old enough with enough sessions waiting long enough; it is
    reported once per transaction, on its second consecutive qualifying sample.
    """
    samples = roots.select("db_id", "at_s").distinct()
    previous = samples.withColumn("before_s", F.lag("at_s").over(Window.partitionBy("db_id").orderBy("at_s")))
    fit = roots.filter((F.col("at_s") - F.col("tx_start_s") >= age_s) & (F.col("n_blocked") >= blocked) & (F.col("min_wait_s") >= wait_s)).join(previous, ["db_id", "at_s"])
    tx = Window.partitionBy("db_id", "pid", "tx_start_s").orderBy("at_s")
    again = (F.lag("at_s").over(tx) == F.col("before_s")) & (F.col("at_s") - F.col("before_s") <= gap_s)
    second = fit.withColumn("again", F.coalesce(again, F.lit(False))).filter("again")
    first = second.withColumn("nth", F.row_number().over(tx)).filter("nth = 1")
    return first.select("db_id", "pid", "tx_start_s", "at_s", "n_blocked", F.col("total_wait_s").alias("impact_s"), F.when(F.col("total_wait_s") >= high_s, "high").otherwise("medium").alias("severity"))


def cascade_tables(locks: DataFrame) -> DataFrame:
    """Tables that the blocked wait for, else those the root holds."""
    waits, holds = (F.sort_array(F.collect_set(F.when(c, F.col("table_name")))) for c in (~F.col("is_granted"), F.col("is_granted")))
    return locks.groupBy("db_id", "root").agg(waits.alias("w"), holds.alias("h")).select("db_id", "root", F.when(F.size("w") > 0, F.col("w")).otherwise(F.col("h")).alias("tables"))


# Lock scopes of the space between rows, and those that hold off an insert into it.
GAPS, GAP_HOLDS = ["gap", "insert_intention"], ["gap", "row+gap"]
PATTERNS = ["CT-01", "CT-02", "CT-03", "CT-04", "CT"]


def _ratio():
    """Rows locked for each row changed."""
    return F.col("rows_locked") / F.greatest(F.coalesce(F.col("undo_entries"), F.lit(0)), F.lit(1))


def _member(trx: DataFrame, *more):
    scan = F.col("scan") if "scan" in trx.columns else F.lit(None).cast("struct<columns:array<string>,led:boolean>")
    return F.struct("process_id", "complete", "blocked_by", "holds_known", _ratio().alias("ratio"), scan.alias("scan"), *more)


def reports_of(trx: DataFrame, locks: DataFrame) -> DataFrame:
    """One row per report: its transactions with their waits, and what is held, as arrays, in one shuffle.

    ``trx(report_id, process_id, complete, blocked_by, holds_known, rows_locked, undo_entries,
    scan)``, where ``blocked_by`` lists the processes that block it and ``scan`` is the statement of ``amplifying_statements`` or null; ``locks(
    report_id, process_id, role, target, mode, scope)``, a row per target held or awaited.
    A report is one text of bounded size, so its transactions fit a row.
    """
    lock = F.struct("process_id", "role", "target", "mode", "scope")
    both = trx.select("report_id", _member(trx).alias("t"), F.lit(None).alias("l")).unionByName(locks.select("report_id", F.lit(None).alias("t"), lock.alias("l")))
    reports = both.groupBy("report_id").agg(F.collect_list("t").alias("members"), F.collect_list("l").alias("locks"))
    waits = lambda m: F.filter("locks", lambda w: (w["role"] == "wait") & (w["process_id"] == m["process_id"]))
    return reports.select("report_id", F.transform("members", lambda m: m.withField("waits", waits(m))).alias("members"), F.filter("locks", lambda h: h["role"] == "hold").alias("holds"))


def reports_together(trx: DataFrame, facts: dict[str, Column] | None = None) -> DataFrame:
    """The same from transactions that carry their own locks: ``waits(target, mode, scope)`` and ``held(process_id, target, mode, scope)``, arrays or null.

    ``facts`` are further aggregates of a report. Where transactions come from a window over
    their report they lie together already, and are neither shuffled nor sorted again: reports
    are windows of which one row is kept.
    """
    report = Window.partitionBy("report_id")
    found = {"members": F.collect_list("__member"), "__holds": F.collect_list("held"), **(facts or {})}
    nth = F.count(F.lit(1)).over(report.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = trx.withColumn("__member", _member(trx, F.coalesce("waits", F.array()).alias("waits"))).select("report_id", *[c.over(report).alias(n) for n, c in found.items()], nth.alias("__nth"))
    return rows.filter("__nth = 1").withColumn("holds", F.flatten("__holds")).drop("__nth", "__holds")


def _waits(member):
    return member["waits"]


def _held(is_holder, target, kind):
    return F.exists("holds", lambda h: (h["target"] == target) & F.coalesce(kind(h), F.lit(False)) & is_holder(h["process_id"]))


def _blocker_holds(member, wait, kind):
    """Does any of the members that block this one keep, in that way, what it waits for?"""
    among = lambda ids, pid: F.coalesce(F.array_contains(ids, pid), F.lit(False))
    return _held(lambda pid: among(member["blocked_by"], pid) & among(F.col("members")["process_id"], pid), wait["target"], kind)


def _on_row(lock, mode):
    return (lock["mode"] == mode) & ~F.coalesce(lock["scope"].isin(*GAPS), F.lit(False))


def _asks_exclusive(wait):
    return (wait["mode"].isNull() | (wait["mode"] == "X")) & ~F.coalesce(wait["scope"].isin(*GAPS), F.lit(False))


def cycle_flags(reports: DataFrame) -> DataFrame:
    """Adds: is it a cycle (complete, two or more, all waiting for a member), are targets and holds known (G06, G07)?"""
    ids = F.col("members")["process_id"]
    waiting = F.forall("members", lambda m: (F.size(_waits(m)) > 0) & F.coalesce(F.arrays_overlap(ids, m["blocked_by"]), F.lit(False)))
    known = F.forall("members", lambda m: (F.size(_waits(m)) > 0) & F.forall(_waits(m), lambda w: w["target"].isNotNull()))
    return reports.withColumns({
        "is_cycle": F.forall("members", lambda m: F.coalesce(m["complete"], F.lit(False))) & (F.size("members") >= 2) & waiting,
        "targets_known": known, "holds_known": F.forall("members", lambda m: F.coalesce(m["holds_known"], F.lit(False))),
    })


def holder_match(locks: DataFrame, modes: list[str], scopes: list[str] | None = None) -> DataFrame:
    """``(report_id, process_id)`` of waits whose target another member holds in one of the modes and scopes."""
    kept = locks.filter((F.col("role") == "hold") & F.col("mode").isin(*modes))
    if scopes:
        kept = kept.filter(F.col("scope").isin(*scopes))
    held = kept.select("report_id", "target", F.col("process_id").alias("holder"))
    waits = locks.filter("role = 'wait'").select("report_id", "target", "process_id")
    return waits.join(held, ["report_id", "target"]).filter("holder != process_id").select("report_id", "process_id").distinct()


def amplification(reports: DataFrame, ratio: float = 10) -> DataFrame:
    """Adds: does a transaction lock ``ratio`` times the rows it changed (G12)? And the greatest ratio, null where none is known."""
    most = F.array_max(F.transform("members", lambda m: m["ratio"]))
    return reports.withColumn("ratio", most).withColumn("amplified", F.coalesce(most >= ratio, F.lit(False)))


def inconsistent_order(flags: DataFrame) -> DataFrame:
    """CT-01 (G09): all ask exclusively for different rows, and where holds are known the blocker holds the row exclusively."""
    targets = F.flatten(F.transform("members", lambda m: F.array_distinct(F.transform(_waits(m), lambda w: w["target"]))))
    disjoint = F.size(targets) == F.size(F.array_distinct(targets))
    asks = F.forall("members", lambda m: F.forall(_waits(m), _asks_exclusive))
    kept = F.forall("members", lambda m: F.exists(_waits(m), lambda w: _blocker_holds(m, w, lambda h: _on_row(h, "X"))))
    return flags.withColumn("ct01", F.col("is_cycle") & F.col("targets_known") & asks & disjoint & ~F.col("amplified") & (~F.col("holds_known") | kept))


def mode_conversion(flags: DataFrame) -> DataFrame:
    """CT-02 (G10): all ask exclusively for a row that they and their blocker hold shared; holds unknown: all ask for one row."""
    asks = F.forall("members", lambda m: F.forall(_waits(m), _asks_exclusive))
    own = lambda m: F.exists(_waits(m), lambda w: _held(lambda pid: pid == m["process_id"], w["target"], lambda h: _on_row(h, "S")))
    blocker = lambda m: F.exists(_waits(m), lambda w: _blocker_holds(m, w, lambda h: _on_row(h, "S")))
    first = F.transform(_waits(F.col("members")[0]), lambda w: w["target"])
    common = F.exists(first, lambda t: F.forall("members", lambda m: F.exists(_waits(m), lambda w: w["target"] == t)))
    converts = F.when(F.col("holds_known"), F.forall("members", lambda m: own(m) & blocker(m))).otherwise(common)
    return flags.withColumn("ct02", F.col("is_cycle") & F.col("targets_known") & asks & ~F.col("amplified") & converts)


def range_contention(flags: DataFrame) -> DataFrame:
    """CT-03 (G11): someone waits to insert where its blocker holds the gap; ``gaps`` lists the places.

    A gap is named by the record that closes it; heap number 1 is the end of the index.
    """
    gap = lambda h: h["scope"].isin(*GAP_HOLDS)
    blocked = F.flatten(F.transform("members", lambda m: F.filter(_waits(m), lambda w: (w["scope"] == "insert_intention") & _blocker_holds(m, w, gap))))
    place = lambda w: F.struct(w["target"].alias("record"), F.when(F.element_at(F.split(w["target"], ":"), -1) == "1", "end_of_index").otherwise("before_record").alias("position"))
    # the places are looked for only where all else holds
    may = F.col("is_cycle") & F.col("targets_known") & F.col("holds_known") & ~F.col("amplified")
    places = F.array_sort(F.array_distinct(F.transform(blocked, place)))
    found = flags.withColumn("gaps", F.coalesce(F.when(may, places), F.array().cast("array<struct<record:string,position:string>>")))
    return found.withColumn("ct03", may & (F.size("gaps") > 0))


#: leading columns of at most so many tables are broadcast to the transactions
BROADCAST_LEADS = 400_000


def amplifying_statements(trx: DataFrame, leads: DataFrame, ratio: float | None = None) -> DataFrame:
    """Adds ``scan(columns, led)`` to transactions with an UPDATE or DELETE of one table that filters by bare columns.

    ``trx`` has db_id, schema_name and canonic_query; ``leads(db_id, schema_name, table_name,
    column_name)`` are first columns of indexes. ``led``: an index of that table begins with
    one of the columns, or it is not known which table of that name is meant. With ``ratio``
    only transactions that lock so many times the rows they changed have a scan: CT-04 asks no others.
    """
    query = F.regexp_replace("canonic_query", r"\s+", " ")
    raw = F.col("canonic_query")
    one = raw.rlike(r"(?i)^(UPDATE|DELETE\s+FROM)\s+[\w.]+\s") & ~raw.rlike(r"(?i)\b(JOIN|USING|SELECT)\b") & ~raw.rlike(r"(?i)^UPDATE\s+[\w.]+\s+(AS\s+)?\w*\s*,")
    asked = one if ratio is None else F.coalesce(_ratio() >= ratio, F.lit(False)) & one
    clause = F.regexp_extract(query, r"(?i) WHERE (.*)$", 1)
    names = F.regexp_extract_all(clause, F.lit(r"(?i)(?:^|\bAND\b|\bOR\b|\()\s*\(*([a-z_]\w*)\s*(?:<=|>=|=|<(?!>)|>|\bIN\b|\bBETWEEN\b|\bIS NULL\b)"), F.lit(1))
    columns = F.array_sort(F.array_distinct(F.transform(names, F.lower)))
    table = F.lower(F.element_at(F.split(F.regexp_extract("canonic_query", r"(?i)^(?:UPDATE|DELETE\s+FROM)\s+([\w.]+)", 1), r"\."), -1))
    told = trx.withColumn("__told", F.when(asked, F.struct(columns.alias("columns"), table.alias("table"))))
    named = told.withColumns({"__columns": F.col("__told.columns"), "__table": F.col("__told.table")}).drop("__told")
    by_table = written(leads.groupBy("db_id", F.col("table_name").alias("__table")).agg(F.collect_set(F.struct("schema_name", "column_name")).alias("__leads")))
    joined = named.join(F.broadcast(by_table) if by_table.count() <= BROADCAST_LEADS else by_table, ["db_id", "__table"], "left")
    all_leads = F.coalesce("__leads", F.array().cast("array<struct<schema_name:string,column_name:string>>"))
    same = F.filter(all_leads, lambda x: x["schema_name"].eqNullSafe(F.col("schema_name")))
    loose = F.filter(all_leads, lambda x: x["schema_name"].isNull() | F.col("schema_name").isNull())
    ambiguous = (F.size(same) == 0) & (F.size(F.array_distinct(F.transform(loose, lambda x: x["schema_name"]))) > 1)
    meant = F.when(F.size(same) > 0, same).otherwise(loose)
    led = ambiguous | F.arrays_overlap("__columns", F.transform(meant, lambda x: x["column_name"]))
    scan = F.when(F.size("__columns") > 0, F.struct(F.col("__columns").alias("columns"), F.coalesce(led, F.lit(False)).alias("led")))
    return joined.withColumn("scan", scan).drop("__columns", "__table", "__leads")


def lock_amplification(flags: DataFrame, ratio: float = 10) -> DataFrame:
    """CT-04 (G13): of the amplified transactions with such a statement, the one of the greatest ratio filters by columns that lead no index.

    ``index_columns`` are the columns an index should have.
    """
    scanning = F.filter("members", lambda m: F.coalesce(m["ratio"] >= ratio, F.lit(False)) & m["scan"].isNotNull())
    most = F.array_max(F.transform(scanning, lambda m: F.struct(m["ratio"].alias("ratio"), (-m["process_id"]).alias("p"), m["scan"]["columns"].alias("columns"), m["scan"]["led"].alias("led"))))
    found = flags.withColumn("__most", most).withColumn("ct04", F.col("is_cycle") & F.col("amplified") & F.coalesce(~F.col("__most.led"), F.lit(False)))
    return found.withColumn("index_columns", F.when(F.col("ct04"), F.array_join("__most.columns", ", "))).drop("__most")


def unclassified(flags: DataFrame) -> DataFrame:
    """A cycle of which it is not known what was waited for."""
    return flags.withColumn("open", F.col("is_cycle") & ~F.col("targets_known"))


def pattern_flags(trx: DataFrame, locks: DataFrame, ratio: float = 10) -> DataFrame:
    """Per report the flags of CT-01 to CT-04 and of unclassified cycles."""
    flags = amplification(cycle_flags(reports_of(trx, locks)), ratio)
    return unclassified(lock_amplification(range_contention(mode_conversion(inconsistent_order(flags))), ratio))


def classify_deadlocks(flags: DataFrame) -> DataFrame:
    """The first pattern in the order CT-01 to CT-04, else unclassified for cycles without targets, else none."""
    rule = F.coalesce(*[F.when(F.col(flag), code) for flag, code in zip(("ct01", "ct02", "ct03", "ct04", "open"), PATTERNS)])
    return flags.withColumn("rule", rule)


def dedup_deadlocks(reports: DataFrame, within_s: int = 2) -> DataFrame:
    """Reports that come again are the same deadlock; the first stays.

    ``reports(db_id, report_id, victim_pid, at_us, complete, source)``, times in microseconds.
    Complete reports of one victim at one time are the same. InnoDB's time may come without
    its fraction, so its reports are also the same as one that stayed at most ``within_s``
    before if either time is in whole seconds. An incomplete report is the same as any other
    of its time. Reports of one victim are folded in stretches without a gap over ``within_s``.
    """
    second = 1_000_000
    rest = [c for c in reports.columns if c not in ("db_id", "at_us", "victim_pid")]
    first = lambda df, key: df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in reports.columns if c not in key]), "report_id").alias("r")).select(*key, "r.*")
    exact = first(reports.filter("complete"), ["db_id", "victim_pid", "at_us"])
    w = Window.partitionBy("db_id", "victim_pid").orderBy("at_us")
    apart = F.coalesce((F.col("at_us") - F.lag("at_us").over(w) > within_s * second).cast("int"), F.lit(0))
    runs = exact.withColumn("__apart", apart).withColumn("__run", F.sum("__apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = runs.groupBy("db_id", "victim_pid", "__run").agg(F.array_sort(F.collect_list(F.struct("at_us", *rest))).alias("all"))
    same = lambda kept, x: (
        (x["source"] == "innodb_status") & F.col("victim_pid").isNotNull()
        & F.exists(kept, lambda k: (x["at_us"] - k["at_us"] <= within_s * second) & ((k["at_us"] % second == 0) | (x["at_us"] % second == 0)))
    )
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(F.coalesce(same(kept, x), F.lit(False)), kept).otherwise(F.array_append(kept, x)))
    kept = stretch.select("db_id", "victim_pid", F.inline(fold))
    bare = first(reports.filter("not coalesce(complete, false)"), ["db_id", "at_us"]).join(exact.select("db_id", "at_us").distinct(), ["db_id", "at_us"], "left_anti")
    return kept.select(reports.columns).unionByName(bare.select(reports.columns))


def recurrence(events: DataFrame, days: int = 7, high: int = 3) -> DataFrame:
    """Running count per signature, restarting after ``days`` of silence."""
    w = Window.partitionBy("db_id", "signature").orderBy("at_s", "report_id")
    gap = F.coalesce((F.col("at_s") - F.lag("at_s").over(w) > days * 86400).cast("long"), F.lit(0))
    cut = events.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("db_id", "signature", "run").orderBy("at_s", "report_id")
    counted = cut.withColumn("occurrence", F.row_number().over(r)).withColumn("first_s", F.first("at_s").over(r))
    return counted.withColumn("severity", F.when(F.col("occurrence") >= high, "high").otherwise("medium")).drop("gap", "run")


def deadlock_evidence(trx: DataFrame, captures: DataFrame) -> DataFrame:
    """Per report: the victim, the tables waited for, how many members, and the detection delay.

    ``captures(report_id, captured_s)``: when the snapshot with the report was taken. The delay
    is null where that, or the deadlock's own time, is unknown.
    """
    facts = trx.groupBy("report_id", "db_id").agg(
        F.max(F.when(F.col("victim"), F.col("process_id"))).alias("victim_pid"), F.array_join(F.sort_array(F.collect_set("waits_for")), ",").alias("waits"), F.count("*").alias("members"), F.max("at_s").alias("at_s")
    )
    return facts.join(captures.select("report_id", "captured_s"), "report_id", "left").withColumn("delay_s", F.col("captured_s") - F.col("at_s")).drop("captured_s")


# The common mode of each PostgreSQL lock mode, by what is locked.
PG_RELATION = {"AccessShareLock": "IS", "RowShareLock": "IS", "RowExclusiveLock": "IX", "ShareLock": "S", "ExclusiveLock": "X", "AccessExclusiveLock": "X"}
PG_TUPLE = {"AccessShareLock": "S", "RowShareLock": "S", "ExclusiveLock": "X", "AccessExclusiveLock": "X"}
PG_OTHER = {"ShareLock": "S", "ExclusiveLock": "X"}


def parse_pg_deadlock(log: DataFrame) -> DataFrame:
    """Detail lines of a PostgreSQL deadlock, a row per wait.

    ``(report_id, pid, mode, target, blocker, statement, lock_type, common_mode, scope, row_target)``.
    Statements may go over several lines. What is locked gives type, scope (row, table,
    other) and the mode in the engines' common words; a wait for a transaction is one for a row
    of which the log tells neither which one nor how: the mode is what the statement asks for
    (X if it writes or locks for update, S if for share) and ``row_target`` is null. Keys of advisory
    locks are the application's and become tokens, equal for equal keys of a report.
    """
    pattern = r"Process (\d+) waits for (\w+) on (.+?); blocked by process (\d+)\."
    lines = F.regexp_extract_all("detail", F.lit(rf"({pattern})"), F.lit(1))
    rows = log.select("report_id", "detail", F.posexplode(lines).alias("pos", "line"))
    part = lambda i: F.regexp_extract("line", pattern, i)
    said = F.expr(r"nullif(regexp_extract(detail, concat('(?ms)^Process ', pid, ': (.*?)(?=\\nProcess [0-9]+(?:: | waits for )|\\z)'), 1), '')")
    one = rows.select("report_id", "detail", "pos", part(1).alias("pid"), part(2).alias("mode"), F.regexp_replace(part(3), r" of database \d+$", "").alias("target"), part(4).cast("long").alias("blocker")).withColumn("statement", said)
    kind = (
        F.when(F.col("target").rlike(r"^tuple \(\d+,\d+\) of relation \d+"), "tuple").when(F.col("target").rlike(r"^relation \d+"), "relation").when(F.col("target").rlike(r"^transaction \d+"), "transactionid")
        .when(F.col("target").startswith("virtual transaction"), "virtualxid").otherwise(F.substring_index("target", " ", 1))
    )
    word = lambda known: F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("mode"))
    asks = F.when(F.col("statement").rlike(r"(?i)^\s*(?:UPDATE|DELETE|INSERT|MERGE)\b|\bFOR\s+(?:NO\s+KEY\s+)?UPDATE\b"), "X").when(F.col("statement").rlike(r"(?i)\bFOR\s+(?:KEY\s+)?SHARE\b"), "S")
    of = lambda name: F.col("lock_type") == name
    mode = F.when(of("tuple"), word(PG_TUPLE)).when(of("relation"), word(PG_RELATION)).when(of("transactionid"), asks).when(~of("virtualxid"), word(PG_OTHER))
    scope = F.when(F.col("lock_type").isin("tuple", "transactionid"), "row").when(of("relation"), "table").otherwise("other")
    typed = one.withColumn("lock_type", kind).withColumn("common_mode", mode).withColumn("scope", scope)
    first = F.min("pos").over(Window.partitionBy("report_id", "target"))
    token = F.dense_rank().over(Window.partitionBy("report_id", "lock_type").orderBy("first"))
    named = typed.withColumn("first", first).withColumn("target", F.when(of("advisory"), F.concat(F.lit("advisory lock a"), token.cast("string"))).otherwise(F.col("target")))
    return named.select(
        "report_id", F.col("pid").cast("long").alias("pid"), "mode", "target", "blocker", "statement", "lock_type", "common_mode", "scope", F.when(~F.col("lock_type").isin("transactionid", "virtualxid"), F.col("target")).alias("row_target")
    )


INNODB = r"(?m)^\*\*\* \((\d+)\) (TRANSACTION|HOLDS THE LOCK\(S\)|WAITING FOR THIS LOCK TO BE GRANTED):"


def parse_innodb(texts: DataFrame) -> DataFrame:
    """InnoDB status text -> ``(report_id, trx, role, resource, mode, scope)``, a row per held or awaited lock."""
    cut = F.split("status", r"(?m)^\*\*\* (?=\(\d+\) (?:TRANSACTION|HOLDS|WAITING))")
    parts = texts.select("report_id", F.explode(cut).alias("part"))
    lock = r"RECORD LOCKS space id (\d+) page no (\d+) .*?lock_mode (\w+)((?: locks gap before rec| locks rec but not gap| insert intention)*)"
    got = lambda i: F.regexp_extract("part", lock, i)
    heap = F.regexp_extract("part", r"heap no (\d+)", 1)
    role = F.when(F.col("part").rlike(r"^\(\d+\) HOLDS"), "hold").when(F.col("part").rlike(r"^\(\d+\) WAITING"), "wait")
    scope = F.when(got(4).contains("insert intention"), "insert_intention").when(got(4).contains("locks gap"), "gap").when(got(4).contains("rec but not gap"), "row").otherwise("row+gap")
    rows = parts.select("report_id", F.regexp_extract("part", r"^\((\d+)\)", 1).cast("int").alias("trx"), role.alias("role"), F.concat_ws(":", got(1), got(2), heap).alias("resource"), got(3).alias("mode"), scope.alias("scope"))
    return rows.filter("role is not null and mode != ''")


def blocked_by(locks: DataFrame) -> DataFrame:
    """All who hold what each member waits for, in order; of two members, the other where nobody is seen holding it."""
    waits = locks.filter("role = 'wait'").select("report_id", "process_id", "target")
    holds = locks.filter("role = 'hold'").select("report_id", "target", F.col("process_id").alias("holder"))
    seen = waits.join(holds, ["report_id", "target"], "left").filter("holder is null or holder != process_id").groupBy("report_id", "process_id").agg(F.array_sort(F.collect_set("holder")).alias("holders"))
    n = waits.select("report_id", "process_id").distinct().groupBy("report_id").agg(F.count("*").alias("n"), F.sum("process_id").alias("all"))
    other = F.when(F.col("n") == 2, F.array(F.col("all") - F.col("process_id"))).otherwise(F.array().cast("array<long>"))
    every = waits.select("report_id", "process_id").distinct().join(seen, ["report_id", "process_id"], "left").join(n, "report_id")
    return every.select("report_id", "process_id", F.when(F.size("holders") > 0, F.col("holders")).otherwise(other).alias("blockers"))


def trim_resources(locks: DataFrame, most: int = 64) -> DataFrame:
    """At most ``most`` resources per member and role, but always those someone waits for."""
    wanted = locks.filter("role = 'wait'").select("report_id", "target").distinct().withColumn("wanted", F.lit(1))
    marked = locks.join(wanted, ["report_id", "target"], "left").na.fill(0, ["wanted"])
    place = F.row_number().over(Window.partitionBy("report_id", "process_id", "role").orderBy(F.col("wanted").desc(), "target"))
    return marked.withColumn("r", place).filter((F.col("r") <= most) | (F.col("wanted") == 1)).drop("r", "wanted")


def merge_headers(headers: DataFrame, reports: DataFrame, within_s: int = 2) -> DataFrame:
    """Each report takes the time of the newest header at most ``within_s`` before it; other headers stay without detail.

    As-of by a union in time order, with the last header carried on.
    """
    marks = headers.select("db_id", F.col("h_s").alias("at"), F.lit(0).alias("kind"), "h_s", F.lit(None).cast("long").alias("report_id"))
    asks = reports.select("db_id", F.col("r_s").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("h_s"), "report_id")
    joined = carried(marks.unionByName(asks), ["db_id"], ["at", "kind"], {"near": ("last", F.col("h_s"))}).filter("kind = 1")
    matched = joined.select("db_id", "report_id", F.when(F.col("at") - F.col("near") <= within_s, F.col("near")).alias("h_s"))
    used = matched.filter("h_s is not null").select("db_id", "h_s").distinct()
    alone = headers.select("db_id", "h_s").distinct().join(used, ["db_id", "h_s"], "left_anti").select("db_id", F.lit(None).cast("long").alias("report_id"), "h_s")
    return matched.unionByName(alone)


def label_rows(waits: DataFrame, unique_keys: DataFrame) -> DataFrame:
    """``waits`` with ``label`` and ``targets_source``: equal rows of a report have one label "row n", by first wait.

    ``waits(report_id, wait_id, db_id, table_id, row_key, ctid)``: the table if it could be told, the
    tokens of ``row_keys``, and the row's place. ``unique_keys(db_id, table_id, index_id, is_primary,
    columns)`` are the plain ones, whole tables only. A wait's row is known by the first unique
    key that its tokens cover, the primary first. A report is labelled by keys if that holds
    for all its waits and no table was reached by two keys (one row may have been named twice);
    else by places if all its waits have one; else not at all, and never by a mixture. Waits without a
    report have no label.
    """
    wait = ["report_id", "wait_id", "db_id", "table_id"]
    asked = waits.filter("size(row_key) > 0").select(*wait, "row_key").join(unique_keys.filter("size(columns) > 0"), ["db_id", "table_id"])
    covered = asked.filter(F.forall("columns", lambda c: F.map_contains_key("row_key", c)))
    values = F.transform(F.array_sort("columns"), lambda c: F.try_element_at("row_key", c))
    known = covered.groupBy(*wait).agg(F.min_by(F.struct("index_id", values.alias("values")), F.struct(~F.col("is_primary"), "index_id")).alias("known"))
    report = Window.partitionBy("report_id")
    tables, indexes = (F.size(F.collect_set(F.struct("db_id", "table_id", *more)).over(report)) for more in ([], ["known.index_id"]))
    every = lambda c: F.bool_and(c).over(report)
    by_key = every(F.col("known").isNotNull()) & (tables == indexes)
    by_place = every(F.col("ctid").isNotNull() & F.col("table_id").isNotNull())
    source = F.when(F.col("report_id").isNull(), None).when(by_key, "row_key").when(by_place, "ctid")
    judged = waits.join(known, wait, "left").withColumn("targets_source", source)
    row = F.when(F.col("targets_source") == "row_key", F.to_json(F.struct("db_id", "table_id", "known"))).when(F.col("targets_source") == "ctid", F.to_json(F.struct("db_id", "table_id", "ctid")))
    numbered = judged.withColumn("row", row).withColumn("at", F.min("wait_id").over(Window.partitionBy("report_id", "row")))
    n = F.dense_rank().over(Window.partitionBy("report_id").orderBy("at"))
    return numbered.withColumn("label", F.when(F.col("row").isNotNull(), F.concat(F.lit("row "), n.cast("string")))).drop("known", "row", "at")


def resolve_table(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """The named schema, else the only candidate, else the first of the search path; null if none of several is on it.

    ``candidates(table_name, candidate, priority)``: the place on the search path, null if not on it.
    """
    joined = names.join(candidates, "table_name", "left").filter("schema_name is null or schema_name = candidate")
    only = F.when(F.min("candidate") == F.max("candidate"), F.min("candidate"))
    return joined.groupBy("id").agg(F.coalesce(only, F.min_by("candidate", "priority")).alias("schema_name"))


def capture_time(snapshots: DataFrame) -> DataFrame:
    """The server's clock, else the time the snapshot was queued."""
    return snapshots.withColumn("captured_s", F.coalesce("server_s", "queued_s"))
