"""Readers: snapshots, vendor statistics views and logs become engine-neutral tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import to_utc
from ..operators.rounds import written
from ..operators.windows import COUNTERS, merge_counters

_TIMES = "total_time_ms:double,mean_time_ms:double,stddev_time_ms:double,min_time_ms:double,max_time_ms:double,coeff_of_variation:double"
STATEMENT = (
    f"query_id:string,query_text:string,database_name:string,schema_name:string,execution_count:bigint,rows_returned:bigint,avg_rows_per_call:double,{_TIMES},"
    "disk_spill_indicator:bigint,sort_merge_passes:bigint,counters_epoch:string,canonic_query:string,query_text_truncated:boolean"
)
CANDIDATE = f"{STATEMENT},selected_by:array<string>,ready_for_explain:boolean"
_LOCK = "struct<mode:string,scope:string,schema_name:string,table_name:string,index_name:string,targets:array<string>,targets_source:string>"
_MEMBER = f"struct<process_id:bigint,query_id:string,canonic_query:string,victim:boolean,blocked_by:array<bigint>,waits_for:{_LOCK},holds:array<{_LOCK}>,rows_locked:bigint,undo_log_entries:bigint>"
_OPERATION = "struct<type:string,access_method:string,relation:string,table_name:string,index_name:string,predicate:string,estimated_rows:double>"
_PLAN = f"struct<estimates:struct<output_rows:double,actual_rows:double>,physical_operations:array<{_OPERATION}>>"
#: the catalogue of a snapshot's sections and the fields of their rows; other fields and sections are ignored
SECTIONS = {
    "statements": f"array<struct<{STATEMENT}>>",
    "locks": "array<struct<process_id:bigint,database_name:string,table_name:string,lock_mode:string,is_granted:boolean>>",
    "active_queries": "array<struct<process_id:bigint,database_name:string,query_text:string,query_id:string,canonic_query:string,transaction_start_time:string,session_state:string,wait_start_time:string,blocking_pids:array<bigint>>>",
    "indexes": "array<struct<schema_name:string,table_name:string,index_name:string,index_ref:string,index_scans:bigint,last_index_scan:string,index_size_bytes:bigint>>",
    "tables": "array<struct<schema_name:string,table_name:string,seq_scans:bigint,live_rows:bigint>>",
    "columns": "array<struct<schema_name:string,table_name:string,column_name:string,data_type:string>>",
    "server_start_timestamp": "array<struct<server_start_time:string,stats_reset_time:string>>",
    "foreign_keys": "array<struct<schema_name:string,table_name:string,constraint_name:string,column_name:string,referenced_schema_name:string,referenced_table_name:string,referenced_column_name:string,position:int>>",
    "capture_timestamp": "array<struct<capture_timestamp:string>>",
    "deadlocks": f"array<struct<detected_at:string,source:string,complete:boolean,database_name:string,transactions:array<{_MEMBER}>>>",
    "canonic_explains": f"array<struct<query_id:string,explain_source:string,total_cost:double,canonical_plan:{_PLAN}>>",
    "top_impact_queries": f"array<struct<{CANDIDATE}>>",
    "non_explainable_candidates": f"array<struct<{CANDIDATE}>>",
    "collection_status": "struct<sections_failed:array<string>,issues:array<struct<code:string,section:string,severity:string>>>",
}
MANDATORY = ["statements", "locks", "active_queries", "indexes", "tables", "columns", "server_start_timestamp"]


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("p", F.try_parse_json("payload"))


def _section(name: str):
    """The section's rows; null where it is absent, was not read (null) or has another type."""
    return F.try_variant_get("p", f"$.{name}", SECTIONS[name])


def _is_typed(name: str):
    """Has the section its type? In a lambda, so that fourteen such checks are not one method too large to compile."""
    return F.get(F.transform(F.array("p"), lambda p: F.try_variant_get(p, f"$.{name}", SECTIONS[name]).isNotNull()), 0)


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads that keep the contract, and those that do not; the rest goes on.

    ``db_id`` and the ``MANDATORY`` sections must be there, though a section may be null if
    it could not be read; every section that is there must have its type. A field of a row
    that has another type is null.
    """
    ok = F.try_variant_get("p", "$.db_id", "string").isNotNull()
    for name in SECTIONS:
        there = F.try_variant_get("p", f"$.{name}", "variant")
        typed = F.is_variant_null(there) | _is_typed(name)
        ok = ok & (F.coalesce(typed, F.lit(False)) if name in MANDATORY else there.isNull() | F.coalesce(typed, F.lit(False)))
    marked = _parsed(raw).withColumn("__ok", F.coalesce(ok, F.lit(False)))
    return marked.filter("__ok").drop("__ok", "p"), marked.filter("not __ok").drop("__ok", "p")


def ingest_snapshots(raw: DataFrame) -> dict[str, DataFrame]:
    """One table per section, each row with its database, message and capture time (S01); of the status one row per message.

    Payloads are parsed and checked once, and written; every section is read from there.
    """
    head = ["db_id", "msg_id", "captured_at"]
    parsed = written(_parsed(split_valid(raw)[0]).select(*head, "p"))
    rows = lambda name: F.array(_section(name)) if SECTIONS[name].startswith("struct") else _section(name)
    return {name: parsed.select(*head, F.explode(rows(name)).alias("r")).filter("r is not null").select(*head, "r.*") for name in SECTIONS}


def section_issues(raw: DataFrame) -> DataFrame:
    """``(msg_id, db_id, captured_at, section, code)`` of sections that gave no rows to read.

    SECTION_UNREAD: there, but null, since the collector could not read it; SECTION_MISTYPED:
    there with another type; SECTION_MISSING: a mandatory one is absent; PAYLOAD_UNREADABLE (no
    section): no JSON.
    """
    parsed = _parsed(raw)

    def issue(name: str):
        there = F.try_variant_get("p", f"$.{name}", "variant")
        absent = F.when(F.lit(name in MANDATORY), "SECTION_MISSING")
        return F.struct(F.lit(name).alias("section"), F.when(there.isNull(), absent).when(F.is_variant_null(there), "SECTION_UNREAD").when(~_is_typed(name), "SECTION_MISTYPED").alias("code"))

    whole = F.array(F.struct(F.lit("").alias("section"), F.lit("PAYLOAD_UNREADABLE").alias("code")))
    found = F.when(F.col("p").isNull(), whole).otherwise(F.array(*[issue(n) for n in SECTIONS]))
    return parsed.select("msg_id", "db_id", "captured_at", F.inline(found)).filter("code is not null")


def statement_counters(statements: DataFrame) -> DataFrame:
    """The ``statements`` section as the counters that windows and rules read, a row per fingerprint and snapshot.

    A snapshot that came twice counts once (its greatest message); rows of one fingerprint
    (several users or databases) are added up. Rows without id or count are left out.
    """
    last = statements.groupBy("db_id", "captured_at").agg(F.max("msg_id").alias("msg_id"))
    rows = statements.filter("query_id is not null and execution_count is not null").join(last, ["db_id", "captured_at", "msg_id"])
    return merge_counters(rows.select("db_id", "query_id", "captured_at", *COUNTERS, to_utc(F.col("counters_epoch")).alias("counters_epoch")), order="counters_epoch")


def read_statements(pg: DataFrame, my: DataFrame, own_roles: list[str], noise: str) -> DataFrame:
    """Both vendors' statement views in one layout: milliseconds, rows per call, without the tool's own statements."""
    a = pg.select(F.lit("postgres").alias("engine"), "db_id", F.col("queryid").cast("string").alias("query_id"), "role", "query", "calls", F.col("total_exec_time").alias("total_time_ms"), "rows")
    b = my.select(
        F.lit("mysql").alias("engine"), "db_id", F.concat_ws("/", "schema_name", "digest").alias("query_id"), F.lit(None).cast("string").alias("role"), F.col("digest_text").alias("query"),
        F.col("count_star").alias("calls"), (F.col("sum_timer_wait") / 1e9).alias("total_time_ms"), F.col("sum_rows_sent").alias("rows"),
    )
    both = a.unionByName(b)
    own = F.coalesce(F.col("role").isin(*own_roles), F.lit(False)) | F.coalesce(F.col("query").rlike(noise), F.lit(False))
    return both.filter(~own).withColumn("rows_per_call", F.col("rows") / F.nullif(F.col("calls"), F.lit(0)))


def table_stats(stats: DataFrame, catalog: DataFrame, index_reads: DataFrame) -> DataFrame:
    """Live rows, from the catalog's estimate where statistics say 0, with reads added up over indexes."""
    reads = index_reads.groupBy("db_id", "table_name").agg(F.sum("index_scans").alias("idx_scans"))
    joined = stats.join(catalog, ["db_id", "table_name"], "left").join(reads, ["db_id", "table_name"], "left")
    live = F.when(F.coalesce("live_rows", F.lit(0)) > 0, F.col("live_rows")).otherwise(F.greatest("catalog_rows", F.lit(0)))
    return joined.select("db_id", "table_name", live.alias("live_rows"), "idx_scans")


def index_catalog(parts: DataFrame, io: DataFrame) -> DataFrame:
    """Index definitions from one row per column, with their reads."""
    columns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "column_name"))), lambda c: c["column_name"]), ", ")
    built = parts.groupBy("db_id", "table_name", "index_name").agg(columns.alias("columns"), F.max("is_unique").alias("is_unique"))
    text = F.concat(F.lit("CREATE "), F.when(F.col("is_unique"), "UNIQUE ").otherwise(""), F.lit("INDEX "), "index_name", F.lit(" ON "), "table_name", F.lit(" ("), "columns", F.lit(")"))
    return built.withColumn("index_ref", text).join(io, ["db_id", "index_name"], "left")


def merge_index_sizes(indexes: DataFrame, sizes: DataFrame, page_size: int = 16384) -> DataFrame:
    """Pages times page size, joined on database, table and index."""
    return indexes.join(sizes, ["db_id", "table_name", "index_name"], "left").withColumn("index_size_bytes", F.col("pages") * page_size).drop("pages")


def flatten_fks(fks: DataFrame) -> DataFrame:
    """Parallel column arrays -> one row per column with its position."""
    zipped = fks.select("constraint_name", "table_name", "referenced_table", F.posexplode(F.arrays_zip("columns", "referenced_columns")).alias("i", "z"))
    return zipped.select("constraint_name", "table_name", "referenced_table", F.col("z.columns").alias("column_name"), F.col("z.referenced_columns").alias("referenced_column"), (F.col("i") + 1).alias("position"))


def resolve_schema(roles: DataFrame, schemas: DataFrame) -> DataFrame:
    """The first schema of a role's search path that exists; ``$user`` is the role."""
    paths = roles.select("role", F.posexplode(F.split("search_path", r"\s*,\s*")).alias("pos", "s")).withColumn("schema_name", F.when(F.col("s").isin("$user", '"$user"'), F.col("role")).otherwise(F.col("s")))
    return paths.join(schemas, "schema_name", "left_semi").groupBy("role").agg(F.min_by("schema_name", "pos").alias("schema_name"))


def session_sample(sessions: DataFrame, locks: DataFrame, waits: DataFrame) -> DataFrame:
    """Per session: oldest ungranted wait, blockers, and a state that marks idle transactions."""
    oldest = locks.filter("not granted").groupBy("process_id").agg(F.min("wait_s").alias("wait_start_s"))
    blockers = waits.groupBy("process_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("blocker")), lambda x: x.cast("string")), ",").alias("blocking_pids"))
    state = F.when((F.col("command") == "Sleep") & F.col("in_tx"), "idle in transaction").when(F.col("command") == "Sleep", "idle").otherwise("active")
    return sessions.join(oldest, "process_id", "left").join(blockers, "process_id", "left").withColumn("state", state).drop("command", "in_tx")


def lock_sample(locks: DataFrame, relations: DataFrame, sessions: DataFrame, database: str, own_role: str) -> DataFrame:
    """Locks of one database with names, without the tool's own; a session without role is kept."""
    joined = locks.join(relations, "relation_id").join(sessions, "process_id", "left")
    return joined.filter((F.col("database") == database) & ~F.col("role").eqNullSafe(own_role))


def slowest_execution(history: DataFrame) -> DataFrame:
    """Of finished, error-free executions of a fingerprint, the longest."""
    done = history.filter("finished and errors = 0")
    return done.groupBy("db_id", "query_id").agg(F.max("time_ms").alias("time_ms"), F.max_by("event_id", F.struct("time_ms", "event_id")).alias("event_id"))


def latest_logged_plan(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """JSON log lines -> the newest plan of each candidate fingerprint.

    Lines without the message prefix are dropped before any JSON is parsed.
    """
    wanted = lines.filter(F.col("value").contains("duration: "))
    parsed = wanted.select(F.from_json("value", "ts bigint, query_id string, db_id string, message string").alias("j")).select("j.*").filter(F.col("message").startswith("duration: "))
    found = parsed.join(candidates.select("db_id", "query_id").distinct(), ["db_id", "query_id"], "left_semi")
    plan = F.regexp_extract("message", r"plan: (.*)$", 1)
    return found.groupBy("db_id", "query_id").agg(F.max("ts").alias("ts"), F.max_by(plan, F.struct("ts", "message")).alias("plan"))


def deadlock_log(lines: DataFrame) -> DataFrame:
    """Log lines with SQLSTATE 40P01, and the newest wait notice per process and transaction."""
    parsed = lines.filter(F.col("value").contains("40P01") | F.col("value").contains("still waiting")).select(F.from_json("value", "ts bigint, pid bigint, state_code string, message string").alias("j")).select("j.*")
    dead = parsed.filter("state_code = '40P01'").select(F.lit("deadlock").alias("kind"), "pid", "ts", "message")
    waits = parsed.filter(F.coalesce(F.col("message").contains("still waiting"), F.lit(False))).withColumn("tx", F.regexp_extract("message", r"transaction (\d+)", 1))
    newest = waits.groupBy("pid", "tx").agg(F.max("ts").alias("ts"), F.max_by("message", "ts").alias("message"))
    return dead.unionByName(newest.select(F.lit("wait").alias("kind"), "pid", "ts", "message"))


def log_window(files: DataFrame, budget: int, since_s: int) -> DataFrame:
    """The newest log files of each database up to a byte budget; the last one may be cut at its start.

    ``files(db_id, path, bytes, modified_s)``, e.g. from the ``_metadata`` columns of a read.
    """
    newest = Window.partitionBy("db_id").orderBy(F.col("modified_s").desc(), "path")
    total = F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    cut = files.filter(F.col("modified_s") >= since_s).withColumn("before", total - F.col("bytes")).filter(F.col("before") < budget)
    return cut.select("db_id", "path", F.least(F.col("bytes"), F.lit(budget) - F.col("before")).alias("take_bytes"))


def read_jdbc_stats(spark: SparkSession, url: str, query: str, databases: list[str], **options: str) -> DataFrame:
    """A statistics view of many databases, one partition each (S21); needs the vendor's driver on the class path."""
    predicates = ["db_id = '{}'".format(d.replace("'", "''")) for d in databases]
    return spark.read.jdbc(url, f"({query}) q", predicates=predicates, properties=options)


def pull_sections(spark: SparkSession, url: str, queries: dict[str, tuple[str, str]], databases: list[str], **options: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Sections read over JDBC, and an issue for each that could not be read.

    ``queries`` gives each section's SQL, with a ``db_id``, and its schema. A section whose
    query the server refuses is an empty table of that schema, and a row ``(section, code,
    message)`` of the issues with the code SECTION_UNREAD; the others are read all the same.
    """
    found, issues = {}, []
    for section, (query, schema) in queries.items():
        try:
            df = read_jdbc_stats(spark, url, query, databases, **options)
            kinds = StructType.fromDDL(schema)
            named = {c.lower(): c for c in df.columns}
            found[section] = df.select(*[F.col(named[f.name.lower()]).cast(f.dataType).alias(f.name) for f in kinds.fields])
        except Exception as e:  # noqa: BLE001 - whatever the driver throws is the section's issue
            found[section] = spark.createDataFrame([], schema)
            issues.append((section, "SECTION_UNREAD", str(e).splitlines()[0][:200]))
    return found, spark.createDataFrame(issues, "section string, code string, message string")
