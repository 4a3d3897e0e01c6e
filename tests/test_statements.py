"""Facts of statements over line ends, nesting, quotes and engines; the leak audit's windows."""

from pyspark.sql import functions as F

from dbpulse.functions import statements as A
from dbpulse.functions import text as T


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, q string")


def test_nothing_that_may_be_a_literal_leaves(spark):
    hidden = ["SELECT 'a\\'b', 1", "SELECT 12ab", "SELECT 'open", "/* open 5", "SELECT 1 */ 2", "SELECT $x$ 5", 'SELECT "open 5', None]
    assert {r.c for r in rows(spark, *hidden).select(T.canonical_text(F.col("q")).alias("c")).collect()} == {T.NOT_AVAILABLE}
    one = lambda q, engine="postgres": spark.range(1).select(T.canonical_text(F.lit(q), engine).alias("c")).first().c
    assert one("SELECT -1.5e-3, 0b101, .5, x'ff', U&'d', t1.c2, $4, 7") == "SELECT -$5, $6, $7, $8, $9, t1.c2, $4, $10"
    assert one("SELECT `a 5`, \"x\\\"5\", 'it''s' # 5\n, _latin1'y'", "mysql") == "SELECT `a 5`, $1, $2 , $3"
    assert one('SELECT "it\'s 5", 6') == 'SELECT "it\'s 5", $1'
    assert one("SELECT 5 " + "+ 5 " * 3000).endswith("$3001")


def test_equal_texts_are_made_once_and_come_back_everywhere(spark):
    got = T.canonical_texts(rows(spark, "SELECT 1", None, "SELECT 1", "SELECT  1"), "q").collect()
    assert sorted((r.id, r.canonical) for r in got) == [(0, "SELECT $1"), (1, T.NOT_AVAILABLE), (2, "SELECT $1"), (3, "SELECT $1")]


def test_tables_in_brackets_commas_and_deletes(spark):
    got = A.query_tables(rows(
        spark, 'SELECT * FROM (a JOIN "B c" ON a.x = "B c".y), ONLY d', "SELECT * FROM f(1) AS g, h", "DELETE FROM a USING b c WHERE a.x = c.x", "INSERT INTO t (a) SELECT b FROM u FOR UPDATE",
        "SELECT trim(both FROM x) FROM s . t q", "SELECT 1", None,
    ), "id", "q")
    want = {(0, "a", "a"), (0, "B c", "B c"), (0, "d", "d"), (1, "h", "h"), (2, "a", "a"), (2, "b", "c"), (3, "t", "t"), (3, "u", "u"), (4, "s.t", "q")}
    assert {tuple(r) for r in got.collect()} == want


def test_shapes_tell_window_calls_and_subqueries_from_aggregates(spark):
    texts = [
        "SELECT sum(x) OVER (ORDER BY y) FROM t", "SELECT count(*) FILTER (WHERE a) OVER w FROM t WINDOW w AS (ORDER BY a)", "SELECT a FROM t WHERE b = (SELECT\nmax(c) FROM t LIMIT 1)",
        "SELECT coalesce(\nsum(a), 0) FROM t", "SELECT a FROM t UNION SELECT b FROM u", "SELECT DISTINCT a FROM t", "(SELECT a FROM t)", "SELECT a FROM t\nGROUP\nBY a", "SELECT a FROM t FETCH FIRST 1 ROW ONLY", "",
    ]
    got = {r.id: (r.exclusion, r.simple_table) for r in A.shapes(rows(spark, *texts), "id", "q").collect()}
    assert got == {0: (None, "t"), 1: (None, "t"), 2: (None, None), 3: ("aggregate", None), 4: (None, None), 5: ("distinct", None), 6: (None, None), 7: ("group_by", None), 8: (None, "t"), 9: ("no_select", None)}


def test_equalities_and_bars(spark):
    texts = [
        "SELECT * FROM t\nWHERE a = $1\nAND (b = $2 OR c = $3)\nAND (d = $4 AND (e = $5))", "SELECT * FROM t WHERE a = $1 OR b = $2", "SELECT * FROM t WHERE NOT (a = $1) AND $2 = b", "SELECT * FROM t WHERE a = $1 + b AND c = $2::int",
        "SELECT * FROM t WHERE a IN ($1) AND b = (SELECT c FROM u WHERE d = $2)", "SELECT * FROM t JOIN u ON t.x = $1 WHERE a = $2 AND u.y = $3", "SELECT * FROM t WHERE a = $1 GROUP BY a HAVING b = $2",
    ]
    got = {(r.id, r.table_name, r.column_name) for r in A.equality_columns(rows(spark, *texts), "id", "q").collect()}
    assert got == {(0, "t", "a"), (0, "t", "d"), (0, "t", "e"), (2, "t", "b"), (3, "t", "c"), (5, "u", "y"), (6, "t", "a")}


def test_predicates_of_unknown_types_and_empty_ones(spark):
    scans = spark.createDataFrame([(1, None, "t", "t", "((a)::text = $1)"), (2, None, "t", "t", None), (3, None, "t", "t", ""), (4, None, "t", "t", "it's open")], "id long, schema_name string, relation string, table_name string, predicate string")
    none = spark.createDataFrame([], "schema_name string, table_name string, column_name string, data_type string")
    aliases = spark.createDataFrame([], "id long, alias string, table_name string")
    got = {r.id: r.predicate for r in A.explicit_predicates(scans, none, aliases).collect()}
    assert got == {1: "(a = $1)", 2: None, 3: "", 4: "it's open"}
    assert {r.id: r.predicate for r in A.explicit_predicates(scans, none, aliases, "mysql").collect()}[1] == "((a)::text = $1)"


def test_leak_audit_over_chunks_and_short_markers(spark):
    made = spark.createDataFrame([(1, "x" * 5000 + " secret value of mine " + "y" * 4090), (2, "ab secret value of mine"), (3, None), (4, "short pw1 end"), (5, "pw"), (6, "q" * (T.CHUNK - 5) + " another marker here ok")], "id long, t string")
    markers = spark.createDataFrame([(m,) for m in ("secret value of mine", "a secret value of mine", "pw1", "", None, "another marker here", "y" * 40, "absent words in here")], "marker string")
    found = T.leak_audit({"made": made}, markers)
    assert {(r.marker, r.n) for r in found.collect()} == {("secret value of mine", 2), ("pw1", 1), ("another marker here", 1), ("y" * 40, 1)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_texts_that_differ_in_literals_are_one_shape_and_come_back_everywhere(spark, monkeypatch):
    texts = [f"SELECT * FROM t WHERE a = {i} AND b = 'v{i}' AND c = $t$x{i}$t$ AND d = ${i} AND e = E'\\'{i}' -- {i}" for i in range(40)] + [None, "", 'SELECT b.c FROM t AS "x1" JOIN u "x2" ON "x1".a = 5']
    assert A.tokens(rows(spark, *texts[:40]), "q").select(*A.TEXT).distinct().count() == 1
    want = {(i, "t", c) for i in range(40) for c in "abcde"}
    ask = lambda: {(r.id, r.table_name, r.column_name) for r in A.equality_columns(rows(spark, *texts), "id", "q").collect()}
    assert ask() == want
    monkeypatch.setattr(A, "BROADCAST_FACTS", 0)
    assert ask() == want
    assert {r.id: (r.exclusion, r.simple_table) for r in A.shapes(rows(spark, *texts), "id", "q").collect()} == {**{i: (None, "t") for i in range(40)}, 40: ("no_select", None), 41: ("no_select", None), 42: (None, None)}
    # a quoted text after a name or AS is an alias, not a literal, and stays apart
    both = rows(spark, *[f'SELECT 1 FROM t "s{i}" WHERE a = "v{i}" AND b IN ("{i}")' for i in range(3)])
    assert {(r.id, r.alias) for r in A.query_tables(both, "id", "q", "mysql").collect()} == {(i, f"s{i}") for i in range(3)}


def test_statements_of_one_shape_are_not_one_task(spark):
    many = spark.range(4000).selectExpr("id report", "1 member", "concat('UPDATE t SET a = 1 WHERE id = ', id % 3) q").repartition(4)
    few, A.BROADCAST_FACTS = A.BROADCAST_FACTS, 2
    try:
        assert A.row_keys(many, "report", "member", "q").filter("row_key['id'] = 'v1'").count() == 4000
    finally:
        A.BROADCAST_FACTS = few
    found = A.row_keys(many, "report", "member", "q")
    assert found.filter("row_key['id'] = 'v1'").count() == 4000
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_predicates_are_taken_apart_once_whatever_their_ids(spark, monkeypatch):
    scans = spark.range(300).selectExpr("id", "if(id % 3 = 0, 's', null) schema_name", "'o' relation", "if(id % 2 = 0, 'orders', null) table_name", "if(id = 7, null, '((x.a)::text = $1)') predicate")
    types = spark.createDataFrame([("s", "orders", "a", "varchar"), ("s", "other", "a", "integer")], "schema_name string, table_name string, column_name string, data_type string")
    aliases = scans.selectExpr("id", "'x' alias", "if(id % 5 = 0, 'other', 'orders') table_name").filter("id != 10")
    taken, explicit = [], A._explicit
    monkeypatch.setattr(A, "_explicit", lambda once, *more: (taken.append(once.count()), explicit(once, *more))[1])
    got = {r.id: r.predicate for r in A.explicit_predicates(scans, types, aliases).collect()}
    assert taken[0] <= 2 * 2 * 3 + 1
    assert got == {i: None if i == 7 else "((x.a)::text = $1)" if i % 5 == 0 and i != 10 else "(x.a = $1)" for i in range(300)}


def test_predicates_that_differ_in_numbers_are_cleaned_once(spark, monkeypatch):
    odd = [None, "", "(`a`5 = 1)", "(`a`<cache>(5) = 1)", "(<cache>(5)<cache>(6) = <if>(7))", "(x.y.z1 = 5.25 and 1.5.x > 0x1F)", "(a in ('5 (', $3, -7))", "<odd>(5)", "((((<not>(<cache>(((b < 12))))))))", "a 1 (b 2 (c 3) 4", "(c)5 = 'it''s 9'"]
    texts = [f"((`s`.`t`.`a` = <cache>({i})) and <not>(`t`.`b`) and (`t`.`c` > -{i}))" for i in range(200)] + odd
    alone = {r.id: r.c for r in rows(spark, *texts).select("id", T.clean_my_predicate(F.col("q")).alias("c")).collect()}
    assert alone[7] == "((t.a = $1) and NOT (t.b) and (t.c > $2))"
    cleaned, clean = [], T.clean_my_predicate
    monkeypatch.setattr(T, "clean_my_predicate", lambda col: (cleaned.append(str(col)), clean(col))[1])
    for kinds in (100, 0):
        assert {r.id: r.c for r in T.clean_my_predicates(rows(spark, *texts), "q", "c", kinds).collect()} == alone
    assert ["__like" in c for c in cleaned] == [True, False]


def test_texts_that_differ_in_numbers_have_one_canonical_text_without_a_shuffle_of_texts(spark, monkeypatch):
    odd = [None, "", "SELECT 1e-5.5", "SELECT 1e-5", "SELECT 7.5.x, 7.x, .5, 1..2, 12ab, 0x1F, a.5", 'SELECT "T 1", 5', 'SELECT "T 2", 5', "SELECT '\"' \"T 3\" '\"'", "SELECT $7, 5", "SELECT 'open 5", "/* 5", "SELECT E'\\55' , b'01', $t$5$t$, 5$x$", "SELECT `n 1`, \"b 2\", 'c 3' # 5", "SELECT `n 2` -- 5", "a --5\n#6\n, 7"]
    texts = [f"SELECT * FROM t WHERE a = {i} AND b > {i}.5 AND c = -{i} AND d = 'v {i}' /* {i} */ -- {i}" for i in range(200)] + odd
    for engine in ("postgres", "mysql"):
        alone = {r.id: r.c for r in rows(spark, *texts).select("id", T.canonical_text(F.col("q"), engine).alias("c")).collect()}
        for kinds in (100, 0):
            got = T.canonical_texts(rows(spark, *texts), "q", "c", engine, kinds)
            assert {r.id: r.c for r in got.collect()} == alone
            if kinds:
                assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    made, canonical = [], T.canonical_text
    monkeypatch.setattr(T, "canonical_text", lambda col, engine: (made.append(str(col)), canonical(col, engine))[1])
    assert T.canonical_texts(rows(spark, *texts[:200]), "q").select("canonical").distinct().count() == 1
    assert "__like" in made[0]


def test_leak_audit_by_phrases_equals_a_search(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["a", "the", "één", "\U0001f600x", "", "no\nline", "q.", "long" * 9, "'it''s'"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 90]))) for _ in range(60)]
    texts += texts[:7] + [None, "", " ", "x" * 300]
    cut = lambda n: (lambda t: t[(b := rng.randrange(max(len(t) - n, 1))) : b + n])(rng.choice([t for t in texts if t and len(t) > 60]))
    markers = sorted({cut(rng.choice([25, 50, 60])) for _ in range(80)} | {"a b c d e f", "the the  the", "x" * 40, "a the a the a the nowhere"})
    want = {(m, sum(m in t for t in texts if t)) for m in markers if any(m in t for t in texts if t)}
    made, asked = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(m,) for m in markers], "marker string")
    ask = lambda of: {(r.marker, r.n) for r in T.leak_audit({"made": made}, of).collect()}
    assert ask(asked) == want
    monkeypatch.setattr(T, "PHRASE_CHUNK", 70)
    monkeypatch.setattr(T, "BROADCAST_NEAR", 0)
    monkeypatch.setattr(T, "MARKERS_AT_ONCE", 30)
    assert ask(asked) == want
    # markers of five words and more need no window by characters
    monkeypatch.setattr(T, "AT_WORDS", "(never{n})")
    monkeypatch.setattr(T, "ANYWHERE", "(never{m})")
    long = [m for m in markers if m.count(" ") >= 4]
    assert ask(asked.filter(F.size(F.split("marker", " ")) >= 5)) == {(m, n) for m, n in want if m in long} != set()
    assert ask(asked.limit(0)) == set()
