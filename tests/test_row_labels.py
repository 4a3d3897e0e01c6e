"""Rows named by statements, their labels, and tables found on the search path."""

from pyspark.sql import functions as F

from dbpulse.functions import statements as A
from dbpulse.operators import contention

KEYS = "db_id string, table_id long, index_id int, is_primary boolean, columns array<string>"
WAITS = "report_id long, wait_id int, db_id string, table_id long, row_key map<string,string>, ctid string"


def keys_of(spark, *texts):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "report long, member int, q string")
    return {r.member: (r.schema_name, r.table_name, r.row_key) for r in A.row_keys(rows, "report", "member", "q").collect()}


def test_a_statement_names_its_row_without_its_values(spark):
    got = keys_of(
        spark, "UPDATE t SET a = 9 WHERE id = 1", "delete from S.T x where '1' = x.ID and x.b > 3", 'SELECT * FROM "T u" WHERE id = 1::int\nFOR NO KEY UPDATE', "UPDATE t SET a = 1 WHERE (id = 2 AND (n = 'it''s'))", "UPDATE t SET a = 1 WHERE id = 1 AND id = 2",
    )
    assert got == {0: (None, "t", {"id": "v1"}), 1: ("s", "t", {"id": "v1"}), 2: (None, "T u", {"id": "v1"}), 3: (None, "t", {"id": "v2", "n": "v3"}), 4: (None, "t", {"id": "v2"})}


def test_statements_that_do_not_name_a_row(spark):
    none = [
        "UPDATE t SET a = 1 WHERE id = $1", "UPDATE t SET a = 1 WHERE id = 1 OR b = 2", "UPDATE t SET a = 1 FROM u WHERE id = 1", "DELETE FROM t USING u WHERE t.id = 1", "SELECT * FROM t WHERE id = 1", "SELECT * FROM t JOIN u ON true WHERE t.id = 1 FOR UPDATE",
        "SELECT * FROM t, (SELECT 1) s WHERE t.id = 1 FOR UPDATE", "UPDATE t SET a = 1", "INSERT INTO t VALUES (1)", "WITH w AS (SELECT 1) UPDATE t SET a = 1 WHERE id = 1", "UPDATE t SET a = 1 WHERE other.id = 1", "UPDATE t SET a = 1 WHERE NOT (id = 1)", "UPDATE t SET a = 1 WHERE id = E'1'", "", None,
    ]
    assert keys_of(spark, *none) == {}
    assert keys_of(spark) == {}


def test_labels_are_by_key_or_by_place_and_never_mixed(spark):
    keys = spark.createDataFrame([("d", 7, 1, True, ["id"]), ("d", 7, 2, False, ["a", "b"]), ("d", 8, 3, True, ["id"]), ("e", 7, 1, True, ["zz"])], KEYS)
    rows = [
        (1, 1, "d", 7, {"id": "v2"}, "(0,1)"), (1, 2, "d", 7, {"id": "v1", "x": "v9"}, "(0,1)"), (1, 3, "d", 7, {"id": "v2"}, None), (1, 4, "d", 8, {"id": "v2"}, None),  # by key
        (2, 1, "d", 7, {"id": "v1"}, "(0,1)"), (2, 2, "d", 7, {"a": "v1"}, "(0,1)"),  # a key half covered: by place
        (3, 1, "d", 7, {"id": "v1"}, "(0,1)"), (3, 2, "d", 7, {"b": "v1", "a": "v2"}, None),  # one table by two keys, one place unknown
        (4, 1, "e", 7, {"id": "v1"}, "(0,1)"), (4, 2, "e", None, {"id": "v1"}, "(0,1)"),  # another database's key; a table unknown
        (None, 1, "d", 7, {"id": "v1"}, "(0,1)"), (5, 1, "d", 7, None, "(0,1)"), (5, 1, "d", 7, None, "(0,1)"), (6, 1, "d", 7, {"id": "v1", "a": "v1", "b": "v1"}, None),
    ]
    waits = spark.createDataFrame(rows, WAITS)
    got = sorted(((r.report_id or 0, r.wait_id, r.targets_source, r.label) for r in contention.label_rows(waits, keys).collect()), key=str)
    want = [
        (0, 1, None, None), (1, 1, "row_key", "row 1"), (1, 2, "row_key", "row 2"), (1, 3, "row_key", "row 1"), (1, 4, "row_key", "row 3"), (2, 1, "ctid", "row 1"), (2, 2, "ctid", "row 1"),
        (3, 1, None, None), (3, 2, None, None), (4, 1, None, None), (4, 2, None, None), (5, 1, "ctid", "row 1"), (5, 1, "ctid", "row 1"), (6, 1, "row_key", "row 1"),
    ]
    assert got == want
    assert contention.label_rows(waits.limit(0), keys).count() == 0
    assert {r.targets_source for r in contention.label_rows(waits.filter("report_id = 1"), keys.limit(0)).collect()} == {None}


def test_table_by_name_only_one_or_path(spark):
    names = spark.createDataFrame([(1, "t", None), (2, "t", "b"), (3, "t", "zz"), (4, "only", None), (5, "off", None), (6, "gone", None)], "id long, table_name string, schema_name string")
    seen = spark.createDataFrame([("t", "a", 2), ("t", "b", 1), ("only", "a", None), ("off", "a", None), ("off", "b", None)], "table_name string, candidate string, priority int")
    got = {r.id: r.schema_name for r in contention.resolve_table(names, seen).collect()}
    assert got == {1: "b", 2: "b", 4: "a", 5: None, 6: None}
