"""Statements of many shapes, filled with values of ``orders``, and what is true of each, worked out by hand.

In the templates ``{n}`` is a customer number, ``^`` a backslash and ``~`` a line end.
"""

from __future__ import annotations

from .fixtures import define

#: engine, text, canonical (None: the marker), masked (None: not whole), exclusion, simple table, tables and aliases, filter columns, equalities
STATEMENTS = [
    ("postgres", "SELECT 1e5, 0x1F, E'a^'{n}', $$x {n}$$, $t$ 'y $$ $t$ FROM \"T 1\" -- c 'x'~WHERE a = {n}", 'SELECT $1, $2, $3, $4, $5 FROM "T 1" WHERE a = $6', "SELECT 1e5, 0x1F, '', '', '' FROM \"\"  ~WHERE a = {n}", None, "T 1", [("T 1", "T 1")], [("T 1", "a")], [("T 1", "a")]),
    ("postgres", "SELECT 'a^'{n}' FROM t1", None, None, None, "t1", [("t1", "t1")], [], []),
    ("postgres", "SELECT a,~(SELECT {n}~FROM z)~FROM t", "SELECT a, (SELECT $1 FROM z) FROM t", "SELECT a,~(SELECT {n}~FROM z)~FROM t", None, None, [("t", "t"), ("z", "z")], [], []),
    ("postgres", "SELECT sum(x) OVER (PARTITION BY f(y) ORDER BY z) FROM sales.t q~WHERE q.b = {n}~  AND (q.c = 'x'~OR q.d = 'y')", "SELECT sum(x) OVER (PARTITION BY f(y) ORDER BY z) FROM sales.t q WHERE q.b = $1 AND (q.c = $2 OR q.d = $3)",
     "SELECT sum(x) OVER (PARTITION BY f(y) ORDER BY z) FROM sales.t q~WHERE q.b = {n}~  AND (q.c = ''~OR q.d = '')", None, "sales.t", [("sales.t", "q")], [("sales.t", "b"), ("sales.t", "c"), ("sales.t", "d")], [("sales.t", "b")]),
    ("postgres", "SELECT round(sum(x) FILTER (WHERE x > {n})) FROM t", "SELECT round(sum(x) FILTER (WHERE x > $1)) FROM t", "SELECT round(sum(x) FILTER (WHERE x > {n})) FROM t", "aggregate", None, [("t", "t")], [], []),
    ("postgres", "SELECT * FROM a, b x, \"Orders\" AS \"O\"~JOIN e USING (k) JOIN f ON f.id = e.id, g~WHERE x.c = {n} AND 5 = \"O\".h AND NOT (a.z = 6) AND f.q = '7'::int", 'SELECT * FROM a, b x, "Orders" AS "O" JOIN e USING (k) JOIN f ON f.id = e.id, g WHERE x.c = $1 AND $2 = "O".h AND NOT (a.z = $3) AND f.q = $4::int',
     "SELECT * FROM a, b x, \"\" AS \"\"~JOIN e USING (k) JOIN f ON f.id = e.id, g~WHERE x.c = {n} AND 5 = \"\".h AND NOT (a.z = 6) AND f.q = ''::int", None, None, [("a", "a"), ("b", "x"), ("Orders", "O"), ("e", "e"), ("f", "f"), ("g", "g")],
     [("b", "c"), ("Orders", "h"), ("a", "z"), ("f", "q"), ("f", "id"), ("e", "id")], [("b", "c"), ("Orders", "h"), ("f", "q")]),
    ("postgres", "UPDATE shop.t1 SET a = 1~WHERE t1.b IN (SELECT u.c FROM u WHERE u.d = {n})", "UPDATE shop.t1 SET a = $1 WHERE t1.b IN (SELECT u.c FROM u WHERE u.d = $2)", "UPDATE shop.t1 SET a = 1~WHERE t1.b IN (SELECT u.c FROM u WHERE u.d = {n})", "no_select", None,
     [("shop.t1", "t1"), ("u", "u")], [("shop.t1", "b"), ("u", "d")], []),
    ("postgres", "DELETE FROM t USING v~WHERE t.a = v.a AND t.b = {n}", "DELETE FROM t USING v WHERE t.a = v.a AND t.b = $1", "DELETE FROM t USING v~WHERE t.a = v.a AND t.b = {n}", "no_select", None, [("t", "t"), ("v", "v")], [("t", "a"), ("v", "a"), ("t", "b")], [("t", "b")]),
    ("postgres", "select count(*) from generate_series(1, 3) g, x where extract(year from x.d) = {n} limit 5", "select count(*) from generate_series($1, $2) g, x where extract(year from x.d) = $3 limit $4", "select count(*) from generate_series(1, 3) g, x where extract(year from x.d) = {n} limit 5", "limit", None, [("x", "x")], [("x", "d")], []),
    ("postgres", "SELECT {n}ab FROM t", None, "SELECT {n}ab FROM t", None, "t", [("t", "t")], [], []),
    ("postgres", "SELECT $3, {n} FROM t9~WHERE a1 = .5 OR b=2", "SELECT $3, $4 FROM t9 WHERE a1 = $5 OR b=$6", "SELECT $3, {n} FROM t9~WHERE a1 = .5 OR b=2", None, "t9", [("t9", "t9")], [("t9", "a1"), ("t9", "b")], []),
    ("postgres", "WITH w AS (SELECT o_custkey FROM orders~WHERE o_orderkey = {n}) SELECT DISTINCT w.o_custkey FROM w", "WITH w AS (SELECT o_custkey FROM orders WHERE o_orderkey = $1) SELECT DISTINCT w.o_custkey FROM w", "WITH w AS (SELECT o_custkey FROM orders~WHERE o_orderkey = {n}) SELECT DISTINCT w.o_custkey FROM w",
     "no_select", None, [("orders", "orders"), ("w", "w")], [("orders", "o_orderkey")], []),
    ("mysql", "SELECT \"a 'x\", 'it^'s {n}', `na 5`, x'ff' # tail 'q~FROM `T` WHERE a={n}", "SELECT $1, $2, `na 5`, $3 FROM `T` WHERE a=$4", "SELECT '', '', \"\", ''  ~FROM \"\" WHERE a={n}", None, "T", [("T", "T")], [("T", "a")], [("T", "a")]),
    ("mysql", "SELECT a -- b {n}~FROM t WHERE b LIKE _utf8'x' AND c = \"{n}\" GROUP~BY a", "SELECT a FROM t WHERE b LIKE $1 AND c = $2 GROUP BY a", "SELECT a  ~FROM t WHERE b LIKE '' AND c = '' GROUP~BY a", "group_by", None, [("t", "t")], [("t", "b"), ("t", "c")], [("t", "c")]),
    ("mysql", "SELECT 'open {n} FROM t", None, None, None, "t", [("t", "t")], [], []),
]


def _made(template: str | None) -> str:
    """The template as an expression that both engines read alike, over a column ``n``."""
    if template is None:
        return "cast(NULL AS string)"
    said = "'" + template.replace("'", "''") + "'"
    return f"replace(replace(replace({said}, '^', chr(92)), '~', chr(10)), '{{n}}', cast(n AS string))"


_case = lambda at: "CASE shape " + " ".join(f"WHEN {i} THEN {_made(s[at])}" for i, s in enumerate(STATEMENTS)) + " END"
define("varied_key", [], f"SELECT o_orderkey AS id, o_orderkey % {len(STATEMENTS)} AS shape, o_custkey AS n FROM @orders")
define("varied", ["varied_key"], f"SELECT id, shape, CASE WHEN shape >= {[s[0] for s in STATEMENTS].index('mysql')} THEN 'mysql' ELSE 'postgres' END AS engine, {_case(1)} AS q, n FROM varied_key")


def answers(at: int) -> str:
    """DuckDB: the worked answer at that place of the list, one value per statement."""
    if at in (2, 3):
        return _case(at)
    return "CASE shape " + " ".join(f"WHEN {i} THEN '{s[at]}'" for i, s in enumerate(STATEMENTS) if s[at] is not None) + " END"


def listed(at: int, names: str) -> str:
    """DuckDB: the worked answers of several rows, as VALUES named ``names``."""
    rows = [f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, s in enumerate(STATEMENTS) for row in s[at]]
    return f"(VALUES {', '.join(rows)}) AS v(shape, {names})"
