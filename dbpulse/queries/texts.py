"""Queries of text expressions N01-N35."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statements as A
from ..functions import text as T
from ..sources import varied
from ..sources.fixtures import ctes, define, view
from . import query

S, Q, C, NUM = r"'[^']*(?:''[^']*)*'", r'"[^"]*(?:""[^"]*)*"', r"--[^\n]*|/\*(?:[^*]|\*[^/])*\*/", r"\b\d+(?:\.\d+)?\b"


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def pieces(col: str, pattern: str, made: str) -> str:
    """DuckDB: replace matches by ``made`` (of m and i)."""
    p = lit(f"({pattern})")
    return f"array_to_string(list_transform(string_split_regex({col}, {lit(pattern)}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {made.replace('@m', f'regexp_extract_all({col}, {p})[i - 1]').replace('@i', '(i - 1)')} || x END), '')"


MASK = pieces("q", f"{S}|{Q}|{C}", "(CASE WHEN starts_with(@m, '''') THEN '''''' WHEN starts_with(@m, '\"') THEN '\"\"' ELSE ' ' END)")
BARE = pieces("q", f"{S}|{C}", "(CASE WHEN starts_with(@m, '''') THEN @m ELSE ' ' END)")
TEXTS = f"tx AS (SELECT *, {MASK} AS m, {BARE} AS b FROM sql_text), cn AS (SELECT *, trim(regexp_replace({pieces('b', f'{S}|{NUM}', chr(39) + '$' + chr(39) + ' || @i')}, '\\s+', ' ', 'g')) AS canonical FROM tx)"


def texts(spark, sf_dir):
    return view(spark, sf_dir, "sql_text")


def both_engines(spark, sf_dir, made):
    """``made(statements, engine)`` over the varied statements of each engine; their ids are below zero."""
    rows = view(spark, sf_dir, "varied").withColumn("id", -F.col("id"))
    return made(rows.filter("engine = 'postgres'"), "postgres").unionByName(made(rows.filter("engine = 'mysql'"), "mysql"))


@query("n01_canonical_text", ctes("sql_text", "varied") + f", {TEXTS} SELECT id, canonical FROM cn UNION ALL SELECT -id, coalesce({varied.answers(2)}, 'Not available') FROM varied")
def n01(spark, sf_dir):
    more = both_engines(spark, sf_dir, lambda rows, engine: T.canonical_texts(rows, "q", engine=engine).select("id", "canonical"))
    return T.canonical_texts(texts(spark, sf_dir), "q").select("id", "canonical").unionByName(more)


@query("n02_collapse_lists", ctes("sql_text") + r""" SELECT id, regexp_replace(q, '(?i)\bIN\s*\([^()]*\)', 'IN (...)', 'g') AS t FROM sql_text""")
def n02(spark, sf_dir):
    return texts(spark, sf_dir).select("id", T.collapse_lists(F.col("q")).alias("t"))


@query("n03_split_params", ctes("sql_text") + r""" SELECT id, regexp_replace('a=$' || id || 'AND b=$2 or$3x', '(\$\d+)([A-Za-z_])', '\1 \2', 'g') AS t FROM sql_text""")
def n03(spark, sf_dir):
    return texts(spark, sf_dir).select("id", T.split_params(F.concat(F.lit("a=$"), F.col("id").cast("string"), F.lit("AND b=$2 or$3x"))).alias("t"))


@query("n04_redact_predicate", ctes("sql_text") + """ SELECT id, '((a = $' || id % 9 || ') AND (b = $' || (id % 9 + 1) || ') AND (c > $' || (id % 9 + 2) || ') AND (col1 = x))' AS t FROM sql_text""")
def n04(spark, sf_dir):
    p = F.concat(F.lit("((a = $"), (F.col("id") % 9).cast("string"), F.lit(") AND (b = 'it''s'::text) AND (c > "), F.col("o_custkey").cast("string"), F.lit(".25::numeric) AND (col1 = x))"))
    return texts(spark, sf_dir).select("id", T.redact_predicate(p).alias("t"))


@query("n05_mask_sql", ctes("sql_text", "varied") + f", {TEXTS} SELECT id, m AS masked FROM tx UNION ALL SELECT -id, {varied.answers(3)} FROM varied")
def n05(spark, sf_dir):
    more = both_engines(spark, sf_dir, lambda rows, engine: rows.select("id", T.mask_sql(F.col("q"), engine).alias("masked")))
    return texts(spark, sf_dir).select("id", T.mask_sql(F.col("q")).alias("masked")).unionByName(more)


@query("n06_is_single", ctes("sql_text") + ", x AS (SELECT id, id % 4 <> 1 AS single FROM sql_text) SELECT * FROM x")
def n06(spark, sf_dir):
    made = F.when(F.col("id") % 4 == 1, F.concat(F.lit("SELECT 1; "), F.col("q"))).when(F.col("id") % 4 == 2, F.concat(F.regexp_replace("q", r";|--.*$", ""), F.lit(" ; "))).otherwise(F.col("q"))
    return texts(spark, sf_dir).select("id", T.is_single(made).alias("single"))


@query("n07_is_explainable", ctes("sql_text") + " SELECT id, id_mod NOT IN (2, 5) AS explainable FROM (SELECT id, id % 6 AS id_mod FROM sql_text)")
def n07(spark, sf_dir):
    return texts(spark, sf_dir).select("id", T.is_explainable(F.col("q")).alias("explainable"))


@query("n08_cap_text", " SELECT doc_id, substr(text, 1, 1000) AS text, coalesce(length(text) > 1000, false) AS truncated FROM documents")
def n08(spark, sf_dir):
    return T.cap_text(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text", 1000)


@query("n09_to_utc", ctes("ev") + " SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts - INTERVAL 5 HOUR WHEN 1 THEN ts END AS at FROM ev")
def n09(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("+05:00"))).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("Z"))).otherwise("no time")
    return view(spark, sf_dir, "ev").select("event_id", T.to_utc(text).alias("at"))


@query("n10_to_granted", ctes("ev") + " SELECT event_id, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS granted FROM ev")
def n10(spark, sf_dir):
    word = F.when(F.col("k") % 3 == 0, " granted").when(F.col("k") % 3 == 1, "WAITING ").otherwise("PENDING")
    return view(spark, sf_dir, "ev").select("event_id", T.to_granted(word).alias("granted"))


@query("n11_to_pids", ctes("ev") + " SELECT event_id, k AS total, 2 AS n FROM ev")
def n11(spark, sf_dir):
    pids = T.to_pids(F.concat(F.lit("x, "), F.col("k").cast("string"), F.lit(",,0 ,7a")))
    return view(spark, sf_dir, "ev").select("event_id", F.aggregate(pids, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.size(pids).alias("n"))


@query("n12_redact_sessions", ctes("sql_text") + ", " + TEXTS + " SELECT id, CASE WHEN id % 5 = 0 THEN 'Not available' ELSE canonical END AS canonic_query FROM cn")
def n12(spark, sf_dir):
    s = texts(spark, sf_dir).select("id", "q", F.when(F.col("id") % 5 != 0, T.canonical_text(F.col("q"))).alias("canonic_query"))
    return T.redact_sessions(s, "q", "canonic_query")


AUDITED = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"], "pages": ["page_id", "url", "html"], "customer": ["c_name"], "orders": ["o_orderpriority"]}


@query("n13_leak_audit", "WITH m AS (SELECT DISTINCT text AS marker FROM benchmark WHERE text <> ''), r AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, concat_ws(chr(31), {', '.join(f'CAST({c} AS VARCHAR)' for c in cs)}) AS row FROM {t}" for t, cs in AUDITED.items()) + ") SELECT marker, count(*) AS n, table_name FROM r JOIN m ON contains(row, marker) GROUP BY ALL")
def n13(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return T.leak_audit({t: read(t).select(cs) for t, cs in AUDITED.items()}, read("benchmark").select(F.col("text").alias("marker")))


FACTS = r"""fa AS (SELECT *, regexp_extract(index_ref, '(?i)USING\s+(\w+)', 1) AS method, starts_with(index_ref, 'CREATE UNIQUE') AS is_unique, regexp_matches(index_ref, '\)\s+WHERE\b') AS is_partial,
  list_transform(string_split_regex(regexp_extract(index_ref, 'USING\s+\w+\s*\((.*?)\)(\s+WHERE\b.*)?$', 1), ',\s*'), lambda c: CASE WHEN regexp_matches(c, '^[a-z_][a-z0-9_]*$') THEN c END) AS columns FROM index_catalog)"""


@query("n14_index_facts", ctes("index_catalog") + f", {FACTS} SELECT db_id, index_name, method, is_unique, is_partial, columns[1] AS lead, len(columns) AS n FROM fa")
def n14(spark, sf_dir):
    facts = T.index_facts(view(spark, sf_dir, "index_catalog"))
    return facts.select("db_id", "index_name", "method", "is_unique", "is_partial", F.col("columns")[0].alias("lead"), F.size("columns").cast("long").alias("n"))


@query("n15_simple_table", ctes("sql_text", "varied") + f" SELECT id, CASE id % 6 WHEN 0 THEN 'orders' WHEN 5 THEN 'part' END AS t FROM sql_text UNION ALL SELECT -id, {varied.answers(5)} FROM varied")
def n15(spark, sf_dir):
    more = both_engines(spark, sf_dir, lambda rows, engine: A.shapes(rows, "id", "q", engine))
    return A.shapes(texts(spark, sf_dir), "id", "q").unionByName(more).select("id", F.col("simple_table").alias("t"))


@query("n16_shape_exclusion", ctes("sql_text", "varied") + f" SELECT id, CASE id % 6 WHEN 2 THEN 'no_select' WHEN 3 THEN 'group_by' WHEN 4 THEN 'no_select' END AS reason FROM sql_text UNION ALL SELECT -id, {varied.answers(4)} FROM varied")
def n16(spark, sf_dir):
    more = both_engines(spark, sf_dir, lambda rows, engine: A.shapes(rows, "id", "q", engine))
    return A.shapes(texts(spark, sf_dir), "id", "q").unionByName(more).select("id", F.col("exclusion").alias("reason"))


@query("n17_query_tables", ctes("sql_text", "varied") + f""" SELECT id, 'orders' AS table_name, CASE id % 6 WHEN 1 THEN 'o' ELSE 'orders' END AS alias FROM sql_text WHERE id % 6 IN (0, 1, 2) UNION ALL SELECT id, 'customer', 'c' FROM sql_text WHERE id % 6 = 1
UNION ALL SELECT id, 'lineitem', 'lineitem' FROM sql_text WHERE id % 6 = 3 UNION ALL SELECT id, 'x', 'x' FROM sql_text WHERE id % 6 = 4 UNION ALL SELECT id, 'part', 'part' FROM sql_text WHERE id % 6 = 5
UNION ALL SELECT -id, table_name, alias FROM varied JOIN {varied.listed(6, "table_name, alias")} USING (shape)""")
def n17(spark, sf_dir):
    more = both_engines(spark, sf_dir, lambda rows, engine: A.query_tables(rows, "id", "q", engine))
    return A.query_tables(texts(spark, sf_dir), "id", "q").unionByName(more)


CATALOG = [("orders", "o_custkey", "bigint"), ("orders", "o_orderkey", "bigint"), ("orders", "o_orderstatus", "varchar"), ("orders", "o_totalprice", "double"), ("customer", "c_custkey", "bigint"), ("lineitem", "l_orderkey", "bigint"), ("part", "p_name", "varchar"), ("part", "p_size", "bigint")]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "table_name string, column_name string, data_type string")


@query("n18_filter_columns", ctes("sql_text", "varied") + f""", f(m, table_name, column_name) AS (VALUES (0, 'orders', 'o_custkey'), (0, 'orders', 'o_orderstatus'), (1, 'orders', 'o_custkey'), (1, 'customer', 'c_custkey'), (1, 'orders', 'o_totalprice'),
  (2, 'orders', 'o_orderkey'), (3, 'lineitem', 'l_orderkey'), (5, 'part', 'p_name'), (5, 'part', 'p_size')) SELECT id, table_name, column_name FROM sql_text JOIN f ON id % 6 = m
UNION ALL SELECT -id, table_name, column_name FROM varied JOIN {varied.listed(7, "table_name, column_name")} USING (shape)""")
def n18(spark, sf_dir):
    known = catalog(spark)
    more = both_engines(spark, sf_dir, lambda rows, engine: A.filter_columns(rows, "id", "q", known, engine))
    return A.filter_columns(texts(spark, sf_dir), "id", "q", known).unionByName(more)


@query("n19_equality_columns", ctes("sql_text", "varied") + f""" SELECT id, 'orders' AS table_name, 'o_custkey' AS column_name FROM sql_text WHERE id % 6 = 0 UNION ALL SELECT id, 'orders', 'o_orderstatus' FROM sql_text WHERE id % 6 = 0
UNION ALL SELECT id, 'lineitem', 'l_orderkey' FROM sql_text WHERE id % 6 = 3 UNION ALL SELECT id, 'part', 'p_size' FROM sql_text WHERE id % 6 = 5
UNION ALL SELECT -id, table_name, column_name FROM varied JOIN {varied.listed(8, "table_name, column_name")} USING (shape)""")
def n19(spark, sf_dir):
    more = both_engines(spark, sf_dir, lambda rows, engine: A.equality_columns(rows, "id", "q", engine))
    canonical = T.canonical_texts(texts(spark, sf_dir), "q", "c").select("id", "c")
    return A.equality_columns(canonical, "id", "c").unionByName(more)


define("leaf", ["ev"], """SELECT event_id, CASE k % 3 WHEN 0 THEN 'o_custkey' WHEN 1 THEN 'o_orderstatus' ELSE 'missing' END AS column_name, 'orders' AS table_name, CASE WHEN k % 2 = 0 THEN 'number' ELSE 'text' END AS value_kind FROM ev""")


@query("n20_explicit_casts", ctes("leaf") + """ SELECT event_id, column_name = 'o_orderstatus' AND value_kind = 'number' AS cast FROM leaf""")
def n20(spark, sf_dir):
    return T.explicit_casts(view(spark, sf_dir, "leaf"), catalog(spark)).select("event_id", "cast")


# predicates of scans by engine; types known with and without schema
define("predicate", ["ev"], """SELECT event_id AS id, CASE WHEN k % 3 = 0 THEN 's' WHEN k % 3 = 1 THEN 'other' END AS schema_name, 'o' AS relation, 'orders' AS table_name, k % 2 = 0 AS pg,
  CASE WHEN k % 2 = 0 THEN concat('((o.a)::text = $', cast(k AS string), ') AND ((b)::text ~~ $1) AND ((c)::text[] = d) AND (("E")::text = ''z'')')
  ELSE concat('o.a = $', cast(k AS string), ' and x.d between $2 and $3 and (b) > 5 and 7 <= (d) and a in (''$4'', $5) and a like ''$6'' and lower(a) = 5') END AS predicate FROM ev""")
TYPES = [("s", "a", "varchar"), ("s", "b", "integer"), (None, "c", "varchar"), ("s", "d", "date"), ("t", "a", "integer")]
# a is a varchar in s, an integer in t: without a schema its type is not known, in another schema there is none
_A = "CASE schema_name WHEN 's' THEN 'CAST(@ AS DOUBLE PRECISION)' ELSE '@' END"
_D = "CASE WHEN schema_name = 'other' THEN '@' ELSE 'CAST(@ AS DOUBLE PRECISION)' END"
_cast_of = lambda rule, name: f"replace({rule}, '@', '{name}')"


@query("n20b_explicit_predicates", ctes("predicate") + f""" SELECT id, CASE WHEN pg THEN '(o.a = ' || regexp_extract(predicate, '[$][0-9]+') || ') AND (' || CASE WHEN schema_name = 'other' THEN 'b' ELSE '(b)::text' END || ' ~~ $1) AND ((c)::text[] = d) AND ("E" = ''z'')'
  ELSE {_cast_of(_A, "o.a")} || ' = ' || regexp_extract(predicate, '[$][0-9]+') || ' and ' || {_cast_of(_D, "x.d")} || ' between $2 and $3 and (b) > 5 and 7 <= (' || {_cast_of(_D, "d")} || ') and ' || {_cast_of(_A, "a")} || ' in (''$4'', $5) and a like ''$6'' and lower(a) = 5' END AS predicate FROM predicate""")
def n20b(spark, sf_dir):
    scans = view(spark, sf_dir, "predicate")
    types = spark.createDataFrame([(s, "orders", c, t) for s, c, t in TYPES], "schema_name string, table_name string, column_name string, data_type string")
    aliases = scans.select("id", F.lit("x").alias("alias"), F.lit("orders").alias("table_name"))
    return A.explicit_predicates(scans.filter("pg"), types, aliases).unionByName(A.explicit_predicates(scans.filter("not pg"), types, aliases, "mysql"))


define("named", ["ev"], "SELECT event_id AS id, CASE k % 4 WHEN 0 THEN cast(NULL AS string) ELSE concat('s', cast(k % 4 AS string)) END AS schema_name, concat('t', cast(k % 7 AS string)) AS table_name FROM ev")
define("named_ref", [], """SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN cast(NULL AS string) ELSE concat('s', cast(p_size % 3 AS string)) END AS schema_name, concat('t', cast(p_size % 5 AS string)) AS table_name,
  concat('r', cast(p_size % 4 AS string), cast(p_size % 3 AS string), cast(p_size % 5 AS string)) AS ref FROM @part WHERE p_size < 14""")


@query("n21_lookup_by_table", ctes("named", "named_ref") + """, j AS (SELECT a.id, a.schema_name IS NOT DISTINCT FROM b.schema_name AND b.ref IS NOT NULL AS ex, b.ref FROM named a LEFT JOIN named_ref b ON a.table_name = b.table_name
  AND (a.schema_name IS NOT DISTINCT FROM b.schema_name OR (a.schema_name IS NULL) <> (b.schema_name IS NULL)))
SELECT id, CASE WHEN count(*) FILTER (ex) > 0 THEN max(ref) FILTER (ex) WHEN count(ref) = 1 THEN max(ref) END AS ref, count(*) FILTER (ex) = 0 AND count(ref) > 1 AS ambiguous FROM j GROUP BY id""")
def n21(spark, sf_dir):
    return T.lookup_by_table(view(spark, sf_dir, "named"), view(spark, sf_dir, "named_ref"))


define("finding_row", ["ev"], """SELECT event_id AS detection_id, CASE k % 4 WHEN 0 THEN 'baseline_degradation' WHEN 1 THEN 'unused_index' WHEN 2 THEN 'range_contention_deadlock' ELSE 'missing_index' END AS rule,
  CASE WHEN user_id % 3 = 0 THEN 'Not available' ELSE concat('SELECT ', event_type) END AS canonic_query, event_type AS query_id, CASE WHEN user_id % 2 = 0 THEN 'public' END AS schema_name, concat('t', cast(k % 5 AS string)) AS table_name,
  CASE WHEN k % 2 = 1 THEN concat('ix', cast(k AS string)) END AS index_name, concat('sig', cast(k AS string)) AS signature, CASE WHEN k % 3 = 0 THEN 'c1' END AS column_name FROM ev""")


@query("n22_finding_key", ctes("finding_row") + """, q AS (SELECT *, CASE WHEN canonic_query <> 'Not available' THEN 't' || substr(sha1(canonic_query), 1, 16) ELSE query_id END AS qi, concat_ws('.', schema_name, table_name) AS tb FROM finding_row)
SELECT detection_id, CASE rule WHEN 'baseline_degradation' THEN qi WHEN 'unused_index' THEN tb || '|' || coalesce(index_name, '') WHEN 'range_contention_deadlock' THEN signature ELSE tb || '|' || qi END AS finding_key FROM q""")
def n22(spark, sf_dir):
    return T.finding_key(view(spark, sf_dir, "finding_row")).select("detection_id", "finding_key")


@query("n23_deadlock_signature", ctes("deadlock_trx") + """, p AS (SELECT report_id, 'ct' AS rule, list_sort(list(waits_for || '/' || holds || '/' || CASE WHEN process_id % 3 = 0 THEN '' ELSE 'ix' || process_id END || '/' || lock_mode || ',' || lock_scope)) AS ps FROM deadlock_trx GROUP BY 1)
SELECT report_id, substr(sha1(rule || '|' || array_to_string(ps, '|')), 1, 16) AS signature FROM p""")
def n23(spark, sf_dir):
    trx = view(spark, sf_dir, "deadlock_trx").select("report_id", F.lit("ct").alias("rule"), F.col("waits_for").alias("canonic_query"), F.col("holds").alias("table_name"), F.when(F.col("process_id") % 3 != 0, F.concat(F.lit("ix"), F.col("process_id").cast("string"))).alias("index_name"), "lock_mode", "lock_scope")
    return T.deadlock_signature(trx)


define("error_row", ["ev"], """SELECT event_id, CASE k % 4 WHEN 0 THEN '28P01' WHEN 1 THEN '53300' WHEN 2 THEN 'XX000' END AS state,
  CASE k % 5 WHEN 0 THEN 'FATAL: timeout expired' WHEN 1 THEN 'Connection refused; timed out' ELSE 'other' END AS message,
  CASE k % 3 WHEN 0 THEN 'connect' WHEN 1 THEN 'collect' END AS scope, CASE k % 7 WHEN 0 THEN 'locks' WHEN 1 THEN 'statements' END AS section FROM ev""")


@query("n24_classify_error", ctes("error_row") + """ SELECT event_id, CASE WHEN state = '28P01' THEN 'AUTH_FAILED' WHEN state = '53300' AND section = 'locks' THEN 'LOCKS_BUSY' WHEN state = '53300' AND scope = 'connect' THEN 'TOO_MANY_CONNECTIONS'
  WHEN message = 'FATAL: timeout expired' THEN CASE WHEN scope = 'collect' THEN 'QUERY_TIMEOUT' ELSE 'CONNECT_TIMEOUT' END WHEN message = 'Connection refused; timed out' THEN CASE WHEN section = 'statements' THEN 'HOST_UNREACHABLE' ELSE 'CONNECT_TIMEOUT' END ELSE 'UNKNOWN' END AS code FROM error_row""")
def n24(spark, sf_dir):
    states = spark.createDataFrame([("28P01", "AUTH_FAILED", None, None), ("3D000", "DATABASE_NOT_FOUND", None, None), ("53300", "TOO_MANY_CONNECTIONS", "connect", None), ("53300", "LOCKS_BUSY", None, "locks")], "state string, state_code string, scope string, section string")
    phrases = [(1, "timeout expired", "CONNECT_TIMEOUT", None, None), (2, "timed out", "CONNECT_TIMEOUT", None, None), (3, "connection refused", "HOST_UNREACHABLE", None, "statements"), (4, "timeout expired", "QUERY_TIMEOUT", "collect", None)]
    return T.classify_error(view(spark, sf_dir, "error_row"), states, spark.createDataFrame(phrases, "nth int, phrase string, phrase_code string, scope string, section string")).select("event_id", "code")


@query("n25_enrich_issue", ctes("issue_seen") + """ SELECT event_id, code, CASE code WHEN 'issue0' THEN 'run' WHEN 'issue1' THEN 'db' END AS scope, CASE code WHEN 'issue0' THEN 'cannot read' WHEN 'issue1' THEN 'cut off' ELSE 'unknown issue' END || ' in ' || section AS message FROM issue_seen""")
def n25(spark, sf_dir):
    known = spark.createDataFrame([("issue0", "run", "cannot read"), ("issue1", "db", "cut off")], "code string, scope string, text string")
    return T.enrich_issue(view(spark, sf_dir, "issue_seen").select("event_id", "code", "section"), known).drop("section")


@query("n26_code_of", ctes("finding_row") + """ SELECT detection_id, CASE rule WHEN 'baseline_degradation' THEN 'AP-01' WHEN 'unused_index' THEN 'AP-05' WHEN 'range_contention_deadlock' THEN 'CT-03' ELSE 'AP-04' END AS code FROM finding_row""")
def n26(spark, sf_dir):
    return view(spark, sf_dir, "finding_row").select("detection_id", T.code_of(F.col("rule")).alias("code"))


@query("n27_evidence_metrics", ctes("detection") + """ SELECT detection_id, 'rows=' || json_extract_string(evidence, '$.rows') || ',ratio=' || json_extract_string(evidence, '$.ratio') AS metrics FROM detection""")
def n27(spark, sf_dir):
    return T.evidence_metrics(view(spark, sf_dir, "detection"), [["live_rows", "rows"], ["q_error"], ["table"], ["ratio"]]).select("detection_id", "metrics")


@query("n28_finding_tables", ctes("detection") + """ SELECT detection_id, CASE WHEN table_name = 'table' || (detection_id % 3) THEN table_name || ',extra' ELSE table_name || ',table' || (detection_id % 3) || ',extra' END AS tables FROM detection""")
def n28(spark, sf_dir):
    with_list = view(spark, sf_dir, "detection").withColumn("evidence", F.concat(F.lit('{"tables":["table'), (F.col("detection_id") % 3).cast("string"), F.lit('","extra"]}')))
    return T.finding_tables(with_list).select("detection_id", F.array_join("tables", ",").alias("tables"))


@query("n29_evidence_facts", ctes("detection") + """ SELECT detection_id, 'rows' AS name, json_extract_string(evidence, '$.rows') AS value FROM detection UNION ALL SELECT detection_id, 'ratio', json_extract_string(evidence, '$.ratio') FROM detection""")
def n29(spark, sf_dir):
    return T.evidence_facts(view(spark, sf_dir, "detection"), "detection_id", ["table"])


@query("n30_format", ctes("ev") + """, m AS (SELECT event_id, v * 1000 * k AS ms, s % 200000 AS age FROM ev), d AS (SELECT *, CAST(CASE WHEN ms >= 3600000 THEN ms / 3600000 WHEN ms >= 60000 THEN ms / 60000 WHEN ms >= 1000 THEN ms / 1000 ELSE ms END AS DECIMAL(20,6)) AS x FROM m)
SELECT event_id, CAST(round(x, 1) AS DECIMAL(20,1)) || CASE WHEN ms >= 3600000 THEN ' h' WHEN ms >= 60000 THEN ' min' WHEN ms >= 1000 THEN ' s' ELSE ' ms' END AS duration,
  CASE WHEN age < 60 THEN age || ' s' WHEN age < 3600 THEN age // 60 || ' min' WHEN age < 86400 THEN age // 3600 || ' h' ELSE age // 86400 || ' d' END AS age FROM d""")
def n30(spark, sf_dir):
    ms = F.col("v") * 1000 * F.col("k")
    return view(spark, sf_dir, "ev").select("event_id", T.fmt_duration(ms).alias("duration"), T.fmt_age(F.col("s") % 200000).alias("age"))


@query("n31_evidence_edges", ctes("finding_row") + """ SELECT detection_id, query_id AS src, table_name AS dst, 'reads' AS kind FROM finding_row UNION ALL SELECT detection_id, table_name, column_name, 'has column' FROM finding_row WHERE column_name IS NOT NULL
UNION ALL SELECT detection_id, table_name, index_name, 'has index' FROM finding_row WHERE index_name IS NOT NULL""")
def n31(spark, sf_dir):
    return T.evidence_edges(view(spark, sf_dir, "finding_row"))


def contention_evidence(spark, sf_dir):
    """Evidence of deadlocks and of cascades as the rules write it."""
    trx = view(spark, sf_dir, "deadlock_trx")
    lock = lambda c: F.struct(F.col("lock_mode").alias("mode"), F.col("lock_scope").alias("scope"), F.array(c).alias("targets"))
    member = F.struct("process_id", F.col("victim"), "canonic_query", "blocked_by", lock("waits_for").alias("waits_for"), F.when(F.col("holds_known"), F.array(lock("holds"))).alias("holds"))
    cycles = trx.groupBy(F.col("report_id").alias("detection_id")).agg(F.to_json(F.struct(F.collect_list(member).alias("transactions"))).alias("evidence"))
    waiting = view(spark, sf_dir, "session").filter("blocker is not null")
    one = F.struct(F.struct(F.col("blocker").alias("process_id")).alias("root"), F.array(F.struct("process_id", F.array("blocker").alias("blocking_pids"))).alias("blocked_sessions"))
    return cycles.unionByName(waiting.select((-F.col("process_id")).alias("detection_id"), F.to_json(one).alias("evidence")))


@query("n31b_contention_edges", ctes("deadlock_trx", "session") + """ SELECT DISTINCT report_id AS detection_id, 'session ' || process_id AS src, 'session ' || unnest(blocked_by) AS dst, 'blocked by' AS kind FROM deadlock_trx
UNION ALL SELECT report_id, 'session ' || process_id, waits_for, 'waits for' FROM deadlock_trx UNION ALL SELECT report_id, holds, 'session ' || process_id, 'held by' FROM deadlock_trx WHERE holds_known
UNION ALL SELECT -process_id, 'session ' || process_id, 'session ' || blocker, 'blocked by' FROM session WHERE blocker IS NOT NULL""")
def n31b(spark, sf_dir):
    return T.contention_graph(contention_evidence(spark, sf_dir))[1]


@query("n31c_contention_nodes", ctes("deadlock_trx", "session") + """, n AS (SELECT report_id AS detection_id, 'session ' || process_id AS node, 'session' AS kind, CASE WHEN victim THEN 'victim' ELSE '' END AS tag FROM deadlock_trx
UNION ALL SELECT report_id, 'session ' || unnest(blocked_by), 'session', '' FROM deadlock_trx UNION ALL SELECT report_id, waits_for, 'lock', '' FROM deadlock_trx UNION ALL SELECT report_id, holds, 'lock', '' FROM deadlock_trx WHERE holds_known
UNION ALL SELECT -process_id, 'session ' || process_id, 'session', '' FROM session WHERE blocker IS NOT NULL UNION ALL SELECT -process_id, 'session ' || blocker, 'session', 'root' FROM session WHERE blocker IS NOT NULL)
SELECT detection_id, node, kind, max(tag) AS tag FROM n GROUP BY 1, 2, 3""")
def n31c(spark, sf_dir):
    return T.contention_graph(contention_evidence(spark, sf_dir))[0]


@query("n32_severity", ctes("ev") + " SELECT event_id, CASE WHEN value >= 200 THEN 'high' WHEN value >= 80 THEN 'medium' ELSE 'low' END AS severity FROM ev")
def n32(spark, sf_dir):
    return view(spark, sf_dir, "ev").select("event_id", T.severity(F.col("value"), 200, 80).alias("severity"))


@query("n33_clean_my_predicate", ctes("sql_text") + """ SELECT id, '((orders.o_custkey = $1) and NOT (orders.o_flag) and (date(orders.o_date) = ''$2'') and (o.x > $3))' AS t FROM sql_text""")
def n33(spark, sf_dir):
    p = F.concat(F.lit("((`shop`.`orders`.`o_custkey` = <cache>("), F.col("o_custkey").cast("string"), F.lit(")) and <not>(`orders`.`o_flag`) and (cast(`orders`.`o_date` as date) = '2024-01-01') and (`o`.`x` > -"), (F.col("id") % 7).cast("string"), F.lit("))"))
    return T.clean_my_predicates(texts(spark, sf_dir).select("id", p.alias("p")), "p", "t").select("id", "t")


@query("n34_strip_markers", ctes("sql_text") + " SELECT id, '(a = NULL) AND NULL AND (b = ' || o_custkey || ')' AS t FROM sql_text")
def n34(spark, sf_dir):
    p = F.concat(F.lit("(a = (SubPlan "), (F.col("id") % 9).cast("string"), F.lit(")) AND <exists>(<cache>(x)) AND (b = "), F.col("o_custkey").cast("string"), F.lit(")"))
    return texts(spark, sf_dir).select("id", T.strip_markers(p).alias("t"))


@query("n35_recommended_sql", ctes("sql_text") + """ SELECT id, 0 AS pos, 'CREATE INDEX i ON orders (o_custkey);' AS statement FROM sql_text UNION ALL SELECT id, 2, 'ANALYZE t' || id % 4 || ';' FROM sql_text""")
def n35(spark, sf_dir):
    told = F.concat(F.lit("Run CREATE INDEX i ON orders (o_custkey); or CREATE  INDEX i on orders(o_custkey); then ANALYZE t"), (F.col("id") % 4).cast("string"), F.lit("; later"))
    return T.recommended_sql(texts(spark, sf_dir).withColumn("r", told), "id", "r")
