"""Facts of SQL statements from their tokens as rows.

A statement's tokens (names, strings, numbers, signs) become rows with their positions. A
running sum of brackets gives depth, brackets that open with SELECT give scopes, and the last
keyword at a scope's own depth gives the clause that a token stands in. Tables, columns,
equalities and shape are then plain filters on those rows, whatever the line breaks, quotes
and nesting. Statements that differ only in their literals and comments have the same facts:
each row is cut into an array of tokens with its literals made alike, only distinct arrays
become rows, and the facts come back to all statements of that shape. All windows are
partitioned by shape, so one shuffle serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rounds import written
from .text import COMMENTS, NUMBER, STRINGS

# Words of SQL that are no names, and those that begin a clause.
WORDS = (
    "ALL AND ANY AS ASC BETWEEN BY CASE COLLATE CROSS CURRENT_DATE CURRENT_TIMESTAMP DELETE DESC DISTINCT ELSE END ESCAPE EXCEPT EXISTS FALSE FETCH FILTER FIRST FOR FROM FULL GROUP HAVING ILIKE IN INNER INSERT INTERSECT INTERVAL INTO IS JOIN "
    "LATERAL LEFT LIKE LIMIT LOCK NATURAL NOT NULL NULLS OFFSET ON ONLY OR ORDER OUTER OVER PARTITION RECURSIVE RETURNING RIGHT ROW ROWS SELECT SET SHARE SIMILAR SOME STRAIGHT_JOIN THEN TRUE UNION UPDATE USING VALUES WHEN WHERE WINDOW WITH XOR"
).split()
CLAUSES = "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET SET VALUES UNION EXCEPT INTERSECT UPDATE INTO FOR RETURNING WINDOW FETCH".split()
AGGREGATES = "COUNT SUM AVG MIN MAX ARRAY_AGG STRING_AGG GROUP_CONCAT JSON_AGG JSONB_AGG BOOL_AND BOOL_OR EVERY STDDEV VARIANCE".split()
COMPARES = ["=", "<", ">", "<=", ">=", "<>", "!=", "LIKE", "ILIKE"]

PART = r'(?:[A-Za-z_][\w$]*|"(?:[^"]|"")+"|`[^`]+`)'
TEXT = ["h1", "h2"]
#: facts of at most so many rows are broadcast to the statements; more meet them with salts, since one shape may hold most statements
BROADCAST_FACTS, SALTS = 200_000, 32


def _pattern(engine: str) -> str:
    part = PART if engine == "postgres" else r"(?:[A-Za-z_][\w$]*|`[^`]+`)"
    return rf"{STRINGS[engine]}|{COMMENTS[engine]}|\$\d+|{part}(?:\s*\.\s*(?:{part}|\*))*|{NUMBER}|::|<=|>=|<>|!=|\|\||\S"


def clean_name(token: Column) -> Column:
    """A name without quotes; what was not quoted in lower case."""
    bare = F.regexp_replace(token, r"\s*\.\s*", ".")
    return F.when(bare.rlike('["`]'), F.regexp_replace(bare, '["`]', "")).otherwise(F.lower(bare))


def _cut(df: DataFrame, keep: list[str], column: str, engine: str) -> DataFrame:
    """``keep``, the tokens ``said`` of the text but for comments, the same as ``shape`` with literals alike, and its hashes."""
    comment = lambda t: t.startswith("--") | t.startswith("/*") | (t.startswith("#") if engine == "mysql" else F.lit(False))
    cut = df.select(*keep, F.filter(F.regexp_extract_all(column, F.lit(f"({_pattern(engine)})"), F.lit(1)), lambda t: ~comment(t)).alias("said"))
    # after AS or a name a word or quoted text may be an alias: it stays as written
    named = lambda p: F.coalesce(p.rlike('^[A-Za-z_"`]') & ~F.upper(p).isin(*WORDS), F.lit(False))
    quoted = r"^\w+&?'" + ('|^"' if engine == "mysql" else "")

    def alike(t: Column, i: Column) -> Column:
        p = F.get("said", i - 1)
        plain = F.when(t.startswith("$"), "$").when(t.startswith("'"), "''").when(t.rlike(r"^\.?\d"), "0").when(t.rlike(quoted) & ~named(p), "x''").otherwise(t)
        return F.when(t.rlike(r"^[(),=*;<>]|^[A-Za-z_][\w.]*$"), t).when((i > 0) & (F.upper(p) == "AS"), t).otherwise(plain)

    made = cut.withColumn("shape", F.transform("said", alike))
    return made.withColumns({f"h{seed}": F.xxhash64(F.lit(seed), "shape") for seed in (1, 2)})


def _repeated(df: DataFrame, column: str) -> bool:
    """Whether the distinct texts are few enough to be broadcast: then each is cut once, else every row by itself."""
    return df.agg(F.approx_count_distinct(F.xxhash64(column))).first()[0] <= BROADCAST_FACTS


def tokens(df: DataFrame, column: str, engine: str = "postgres", repeated: bool = False) -> DataFrame:
    """``(h1, h2, pos, tok, up, ...)``: the tokens of each distinct shape with depth, group, scope and clause.

    ``h1`` and ``h2`` are 128 bits of hash of the shape, its tokens with literals made alike. ``grp`` is the
    position of the innermost open bracket, ``sdepth`` and ``scope`` count and name subqueries only,
    ``is_base`` tells tokens outside of any bracket of their scope. Null texts have no tokens.
    """
    texts = df.select(column).filter(F.col(column).isNotNull())
    once = written(_cut(texts.distinct() if repeated else texts, [], column, engine).select(*TEXT, "shape").distinct())
    found = once.select(*TEXT, F.posexplode("shape").alias("pos", "tok")).withColumn("up", F.upper("tok"))
    at = Window.partitionBy(*TEXT).orderBy("pos")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("tok") == "(", F.col("tok") == ")"
    side = F.when(opens, 1).when(closes, -1).otherwise(0)
    is_name = F.col("tok").rlike('^[A-Za-z_"`]' if engine == "postgres" else "^[A-Za-z_`]") & ~F.col("tok").rlike(r"^\w*&?'") & ~F.col("up").isin(*WORDS)
    one = found.select(
        "*", *[F.lag("up", n).over(at).alias(f"p{n}") for n in (1, 2)], *[F.lead("up", n).over(at).alias(f"n{n}") for n in (1, 2, 3, 4, 5)], *[F.lead("tok", n).over(at).alias(f"t{n}") for n in (1, 2)],
        is_name.alias("is_name"), (F.sum(side).over(upto) + closes.cast("int")).alias("depth"),
    )
    own = Window.partitionBy(*TEXT, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    two = one.withColumn("grp", F.coalesce(F.last(F.when(opens, F.col("pos")), ignorenulls=True).over(own), F.lit(-1))).withColumn(
        "sub", (F.col("depth") > 0) & F.coalesce(F.last(F.when(opens, F.col("n1").isin("SELECT", "WITH")), ignorenulls=True).over(own), F.lit(False))
    )
    inner = F.when(opens & F.col("sub"), 1).when(closes & F.col("sub"), -1).otherwise(0)
    three = two.withColumn("sdepth", F.sum(inner).over(upto) + (closes & F.col("sub")).cast("int"))
    scoped = Window.partitionBy(*TEXT, "sdepth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begins = opens & F.col("sub")
    four = three.withColumn("scope", F.coalesce(F.last(F.when(begins, F.col("pos")), ignorenulls=True).over(scoped), F.lit(-1))).withColumn(
        "is_base", F.col("depth") == F.coalesce(F.last(F.when(begins, F.col("depth")), ignorenulls=True).over(scoped), F.lit(0))
    )
    # FOR UPDATE and DO UPDATE begin no UPDATE clause; JOIN goes on with FROM at any depth
    hard = F.when(F.col("up") == "JOIN", "FROM").when(F.col("is_base") & F.col("up").isin(*CLAUSES) & ~F.coalesce(F.col("p1").isin("FOR", "DO", "KEY", "DISTINCT"), F.lit(False)), F.col("up"))
    here = Window.partitionBy(*TEXT, "sdepth", "scope").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    five = four.withColumn("hard", hard).withColumn("in_hard", F.last("hard", ignorenulls=True).over(here))
    soft = F.coalesce("hard", F.when(F.col("up").isin("ON", "USING"), F.col("up")), F.when((F.col("tok") == ",") & F.col("is_base") & (F.col("in_hard") == "FROM"), F.lit("FROM")))
    return five.withColumn("clause", F.last(soft, ignorenulls=True).over(here))


def _meet(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the ``facts`` of their shape, in as many tasks as ``rows`` have, however many are of one shape."""
    facts = written(facts)
    if facts.count() <= BROADCAST_FACTS:
        return rows.join(F.broadcast(facts), TEXT, how)
    each = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")).join(each, [*TEXT, "salt"], how).drop("salt")


def _back(df: DataFrame, keep: list[str], column: str, engine: str, facts: DataFrame, repeated: bool, how: str = "inner", made=lambda rows: rows) -> DataFrame:
    """``keep`` with the facts of the text's shape; ``made`` adds to them what is told by the text's own tokens ``said``."""
    if not repeated:
        return made(_meet(_cut(df, keep, column, engine), facts, how)).drop(*TEXT, "said", "shape")
    raw = [F.xxhash64(F.lit(seed), column).alias(f"__t{seed}") for seed in (1, 2)]
    names = ["__t1", "__t2"]
    told = made(_meet(_cut(df.select(*raw, column).distinct(), names, column, engine), facts, how)).drop(*TEXT, "said", "shape")
    return df.select(*keep, *raw).join(F.broadcast(told), names, how).drop(*names)


def _tables(found: DataFrame) -> DataFrame:
    """``(h1, h2, scope, table_name, alias)`` after FROM, JOIN, UPDATE, INTO and commas in FROM."""
    after = F.col("p1").isin("FROM", "JOIN", "STRAIGHT_JOIN", "UPDATE", "INTO", "ONLY", "LATERAL", "USING", ",") | ((F.col("p1") == "(") & F.col("p2").isin("FROM", "JOIN", ","))
    names = found.filter(F.col("is_name") & F.col("clause").isin("FROM", "UPDATE", "INTO", "USING") & after & ((F.col("n1") != "(") | F.col("n1").isNull() | (F.col("clause") == "INTO")))
    names = names.filter((F.col("clause") != "USING") | (F.col("p1") == "USING"))
    plain = lambda up, tok: F.when(F.col(tok).rlike('^[A-Za-z_"`]') & ~F.col(up).isin(*WORDS), F.col(tok))
    alias = F.when(F.col("n1") == "AS", F.col("t2")).otherwise(plain("n1", "t1"))
    table = clean_name(F.col("tok"))
    return names.select(*TEXT, "sdepth", table.alias("table_name"), F.coalesce(clean_name(alias), F.substring_index(table, ".", -1)).alias("alias")).distinct()


def query_tables(df: DataFrame, key: str, column: str, engine: str = "postgres") -> DataFrame:
    """``(key, table_name, alias)`` of every table of a statement, those of subqueries too.

    Tables after FROM, JOIN, UPDATE and INTO, after commas and in brackets of FROM; names in
    lower case unless quoted, with their schema if given. Without an alias the table's own
    name stands for it. Functions in FROM are no tables.
    """
    repeated = _repeated(df, column)
    return _back(df, [key], column, engine, _tables(tokens(df, column, engine, repeated)).select(*TEXT, "table_name", "alias").distinct(), repeated).distinct()


def _owned(names: DataFrame, tables: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """``names(h1, h2, tok)`` with the table each belongs to: by alias, else the only table, else by the catalog."""
    name = clean_name(F.col("tok"))
    split = names.select(*TEXT, F.when(name.contains("."), F.element_at(F.split(name, r"\."), -2)).alias("q"), F.substring_index(name, ".", -1).alias("column_name")).distinct()
    short = F.substring_index("table_name", ".", -1)
    joined = split.join(tables.select(*TEXT, "table_name", "alias").distinct(), TEXT)
    count = tables.groupBy(*TEXT).agg(F.count_distinct("table_name").alias("n"))
    joined = joined.join(count, TEXT).filter(F.col("q").isNull() | (F.col("q") == F.col("alias")) | (F.col("q") == short))
    if catalog is None:
        return joined.filter("q is not null or n = 1").select(*TEXT, "table_name", "column_name").distinct()
    has = catalog.select(F.lower("table_name").alias("__t"), F.lower("column_name").alias("__c"), F.lit(True).alias("has")).distinct()
    known = joined.join(has, (F.lower(short) == F.col("__t")) & (F.lower("column_name") == F.col("__c")), "left")
    anywhere = F.max(F.coalesce("has", F.lit(False))).over(Window.partitionBy(*TEXT, "column_name"))
    return known.withColumn("any", anywhere).filter("q is not null or n = 1 or has or not any").select(*TEXT, "table_name", "column_name").distinct()


def filter_columns(df: DataFrame, key: str, column: str, catalog: DataFrame, engine: str = "postgres") -> DataFrame:
    """``(key, table_name, column_name)`` of all columns in WHERE and ON, at any depth.

    A qualified column belongs to its alias's table; others to the only table, to the tables
    that have such a column by the catalog, or to all of them if none has.
    """
    repeated = _repeated(df, column)
    found = tokens(df, column, engine, repeated)
    call, typed = F.coalesce(F.col("n1") == "(", F.lit(False)), F.coalesce(F.col("t1").rlike(r"^'"), F.lit(False))
    field = F.coalesce(F.col("n1") == "FROM", F.lit(False))  # extract(year FROM ...)
    names = found.filter(F.col("is_name") & F.col("clause").isin("WHERE", "ON") & ~call & ~typed & ~field & ~F.coalesce(F.col("p1").isin("::", "AS", "OVER"), F.lit(False)))
    return _back(df, [key], column, engine, _owned(names, _tables(found), catalog), repeated).distinct()


def equality_columns(df: DataFrame, key: str, column: str, engine: str = "postgres") -> DataFrame:
    """``(key, table_name, column_name)`` compared with a parameter or literal in an AND-ed equality of the main WHERE.

    An OR, or a NOT before a bracket, takes out what stands in its own bracket only; an OR at
    the top takes out all. A column without a qualifier counts if the statement's main part
    has one table.
    """
    repeated = _repeated(df, column)
    found = tokens(df, column, engine, repeated)
    names = _equalities(found, engine)
    return _back(df, [key], column, engine, _owned(names, _tables(found.filter("sdepth = 0")), None), repeated).distinct()


def _equalities(found: DataFrame, engine: str) -> DataFrame:
    """The tokens that are columns of an AND-ed equality of the main WHERE, with the position of the value they are compared with."""
    group = Window.partitionBy(*TEXT, "depth", "grp", "sdepth", "clause")
    whole = Window.partitionBy(*TEXT, "depth", "grp")
    opens, closes = F.col("tok") == "(", F.col("tok") == ")"
    loose = F.max((F.col("up") == "OR").cast("int")).over(group)
    barred = F.greatest(F.max((F.col("up") == "OR").cast("int")).over(whole), F.max((opens & F.coalesce(F.col("p1") == "NOT", F.lit(False))).cast("int")).over(whole))
    marked = found.withColumn("loose", loose).withColumn("barred", F.when((F.col("depth") > 0) & ~F.col("sub"), barred).otherwise(0))
    upto = Window.partitionBy(*TEXT).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("bars", F.sum(F.when(opens, F.col("barred")).when(closes, -F.col("barred")).otherwise(0)).over(upto))
    cast = F.col("n3") == "::"
    ends = lambda c: F.coalesce(F.col(c).isin("AND", ")", ";", "GROUP", "ORDER", "LIMIT", "FOR", "OFFSET", "FETCH", "HAVING", "UNION", "RETURNING"), F.lit(True))
    starts = lambda c: F.col(c).isin("WHERE", "AND", "(")
    value = lambda c: F.coalesce(F.col(c).rlike(r"^(?:\$\d+$|\?$|\.?\d|\w*&?'|\$" + ('|")' if engine == "mysql" else ")")), F.lit(False))
    forward = starts("p1") & (F.col("n1") == "=") & value("n2") & F.when(F.coalesce(cast, F.lit(False)), ends("n5")).otherwise(ends("n3"))
    before = Window.partitionBy(*TEXT).orderBy("pos")
    marked = marked.withColumn("p3", F.lag("up", 3).over(before))
    backward = (F.col("p1") == "=") & value("p2") & F.coalesce(starts("p3"), F.lit(False)) & ends("n1")
    top = F.col("is_name") & (F.col("sdepth") == 0) & (F.col("clause") == "WHERE") & (F.col("bars") == 0) & ~((F.col("loose") == 1) & F.col("is_base"))
    forward = F.coalesce(forward, F.lit(False))
    named = marked.filter(top & (forward | F.coalesce(backward, F.lit(False))))
    return named.withColumn("value_at", F.when(forward, F.col("pos") + 2).otherwise(F.col("pos") - 2))


def row_keys(df: DataFrame, report: str, member: str, column: str) -> DataFrame:
    """``(report, member, schema_name, table_name, row_key)``: which row a statement locks, as far as its WHERE tells.

    ``row_key`` maps columns to tokens: of an UPDATE, DELETE or locking SELECT of one table, the
    columns that an AND-ed equality compares with a written string or number. No value leaves:
    equal values of a column have one token in a report, '1' and 1 are equal. Of a column named twice
    the last counts. Statements of several tables, those that begin with WITH and those without such an
    equality (parameters tell nothing) have no row.
    """
    repeated = _repeated(df, column)
    found = tokens(df, column, repeated=repeated)
    flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    several = (F.col("sdepth") == 0) & F.col("up").isin("JOIN", "UNION", "EXCEPT", "INTERSECT") | ((F.col("tok") == "(") & F.col("sub") & F.col("p1").isin("FROM", "JOIN", "USING", "LATERAL", ","))
    locks = F.col("is_base") & (F.col("sdepth") == 0) & (F.col("up") == "FOR") & F.col("n1").isin("UPDATE", "NO", "SHARE", "KEY")
    first = F.min_by("up", F.when(F.col("tok") != "(", F.col("pos")))
    kinds = found.groupBy(*TEXT).agg(first.alias("first"), flag(several).alias("several"), flag(locks).alias("locks"))
    fit = kinds.filter("not several and (first in ('UPDATE', 'DELETE') or first = 'SELECT' and locks)").select(*TEXT)
    one = _tables(found.filter("sdepth = 0")).groupBy(*TEXT).agg(F.count("*").alias("n"), F.min("table_name").alias("table_name"), F.min("alias").alias("alias")).filter("n = 1")
    value = F.get("said", F.col("value_at"))
    literal = F.when(F.col("value").rlike(r"^'"), F.regexp_replace(F.expr("substring(value, 2, length(value) - 2)"), "''", "'")).when(F.col("value").rlike(r"^[0-9.]"), F.col("value"))
    name = clean_name(F.col("tok"))
    owner = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -2))
    said = _equalities(found, "postgres").select(*TEXT, "pos", F.substring_index(name, ".", -1).alias("column_name"), owner.alias("owner"), "value_at")
    short = F.substring_index("table_name", ".", -1)
    facts = said.join(fit, TEXT).join(one, TEXT).filter(F.col("owner").isNull() | (F.col("owner") == F.col("alias")) | (F.col("owner") == short))
    made = lambda met: met.withColumn("value", value).withColumn("literal", literal).filter("literal is not null").drop("value", "value_at")
    rows = _back(df, [report, member], column, "postgres", facts.select(*TEXT, "pos", "table_name", "column_name", "value_at"), repeated, made=made)
    seen = F.min(F.struct(member, "pos")).over(Window.partitionBy(report, "column_name", "literal"))
    token = F.concat(F.lit("v"), F.dense_rank().over(Window.partitionBy(report).orderBy("seen")).cast("string"))
    named = rows.withColumn("seen", seen).withColumn("token", token).groupBy(report, member, "table_name", "column_name").agg(F.max_by("token", "pos").alias("token"))
    schema = F.when(F.col("table_name").contains("."), F.element_at(F.split("table_name", r"\."), -2))
    return named.groupBy(report, member, "table_name").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "token"))).alias("row_key")).select(report, member, schema.alias("schema_name"), short.alias("table_name"), "row_key")


def shapes(df: DataFrame, key: str, column: str, engine: str = "postgres") -> DataFrame:
    """``(key, exclusion, simple_table)``: why a query is no plain select (N16), and the table of a one-table select.

    ``exclusion`` is no_select, limit, group_by, distinct or aggregate, by the statement's main
    part; aggregates of subqueries and calls with OVER are none. ``simple_table`` is null with
    an exclusion, a join, a second table, a subquery or a set operation.
    """
    repeated = _repeated(df, column)
    found = tokens(df, column, engine, repeated)
    at, group = Window.partitionBy(*TEXT).orderBy("pos"), Window.partitionBy(*TEXT, "depth", "grp")
    closes = F.col("tok") == ")"
    one = found.withColumn("after", F.max(F.when(closes, F.col("n1"))).over(group)).withColumn("call_after", F.when(F.col("n1") == "(", F.lead("after").over(at)))
    two = one.withColumn("then", F.max(F.when(closes, F.lead("call_after").over(at))).over(group)).withColumn("call_then", F.lead("then").over(at))
    over = F.coalesce((F.col("call_after") == "OVER") | ((F.col("call_after") == "FILTER") & (F.col("call_then") == "OVER")), F.lit(False))
    main = F.col("sdepth") == 0
    base = main & F.col("is_base")
    aggregate = main & F.col("up").isin(*AGGREGATES) & (F.col("n1") == "(") & ~over
    flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    facts = two.groupBy(*TEXT).agg(
        F.min_by("up", F.when(F.col("tok") != "(", F.col("pos"))).alias("first"), flag(base & (F.col("up") == "LIMIT")).alias("limit"), flag(base & (F.col("up") == "GROUP") & (F.col("n1") == "BY")).alias("group_by"),
        flag(main & (F.col("up") == "DISTINCT") & (F.col("p1") == "SELECT")).alias("distinct"), flag(aggregate).alias("aggregate"),
        flag(F.col("up").isin("JOIN", "STRAIGHT_JOIN", "UNION", "EXCEPT", "INTERSECT") | F.col("sub")).alias("several"),
    )
    why = F.when(F.coalesce(F.col("first") != "SELECT", F.lit(True)), "no_select")
    for name in ("limit", "group_by", "distinct", "aggregate"):
        why = why.when(F.col(name), name)
    only = _tables(found).groupBy(*TEXT).agg(F.count("*").alias("n"), F.min("table_name").alias("t"))
    named = facts.withColumn("exclusion", why).join(only, TEXT, "left")
    simple = F.when(F.col("exclusion").isNull() & ~F.col("several") & (F.col("n") == 1), F.col("t"))
    every = _back(df, [key], column, engine, named.select(*TEXT, "exclusion", simple.alias("simple_table"), F.lit(True).alias("seen")), repeated, "left")
    return every.select(key, F.when(F.col("seen").isNull(), "no_select").otherwise(F.col("exclusion")).alias("exclusion"), "simple_table")


# Types whose columns the engine turns into numbers when it compares them with one, and those that cast to text anyway.
NOT_NUMERIC = ("char varchar character bpchar text tinytext mediumtext longtext enum set uuid date time datetime timestamp year").split() + ["character varying", "timestamp without time zone", "timestamp with time zone"]
VARCHARS = ["character varying", "varchar"]


def _typed(names: DataFrame, types: DataFrame) -> DataFrame:
    """``names(id, pos, schema_name, owner, column_name)`` with ``data_type``: by schema, else the only candidate if one side has none."""
    known = types.filter("data_type is not null").select(F.col("schema_name").alias("s"), F.col("table_name").alias("owner"), "column_name", F.lower(F.trim("data_type")).alias("data_type"))
    same = F.col("s").eqNullSafe(F.col("schema_name"))
    met = names.join(known, ["owner", "column_name"]).filter(same | F.col("s").isNull() | F.col("schema_name").isNull())
    found = met.groupBy("id", "pos").agg(F.max(F.when(same, F.col("data_type"))).alias("exact"), F.count("*").alias("n"), F.max("data_type").alias("any"))
    return names.join(found, ["id", "pos"], "left").withColumn("data_type", F.coalesce("exact", F.when(F.col("n") == 1, F.col("any")))).drop("exact", "n", "any")


def explicit_predicates(scans: DataFrame, types: DataFrame, aliases: DataFrame, engine: str = "postgres") -> DataFrame:
    """``(id, predicate)`` with conversions made explicit by the columns' types.

    ``scans(id, schema_name, relation, table_name, predicate)``, ``types(schema_name, table_name,
    column_name, data_type)``, ``aliases(id, alias, table_name)``. In postgres ``(column)::text`` of a
    varchar, or of a column of unknown type, is the column itself: the cast hides no index. In
    mysql a text or date column that is compared with a number is cast to a number by the
    engine, which hides its index: the cast is written out. Predicates are cut into tokens,
    those of columns are joined with their types, and all are put together again in order.
    Scans of equal predicate, table and aliases are taken apart once.
    """
    listed = aliases.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("alias", "table_name"))).alias("aliases"))
    told = ["schema_name", "relation", "table_name", "predicate", "aliases"]
    parts = [part for c in told for part in (F.col(c).isNull(), F.col(c))]
    keyed = scans.select("id", *told[:-1]).join(listed, "id", "left").withColumns({f"h{seed}": F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)})
    once = written(keyed.select(F.struct(*TEXT).alias("id"), *told).distinct())
    made = _explicit(once.drop("aliases"), types, once.select("id", F.inline("aliases")), engine)
    return _meet(keyed.select("id", *TEXT), made.select("id.h1", "id.h2", "predicate")).select("id", "predicate")


def _explicit(scans: DataFrame, types: DataFrame, aliases: DataFrame, engine: str) -> DataFrame:
    """``(id, predicate)`` of ``explicit_predicates``, each row of ``scans`` by itself."""
    name = rf"{PART}(?:\.{PART})?"
    cast = rf"\({name}\)::text(?![\w\[])"
    pieces = rf"{STRINGS[engine]}|{cast}|{PART}(?:\.{PART})*|\$\d+|{NUMBER}|<=|>=|<>|!=|\s+|[^\s]" if engine == "postgres" else rf"{STRINGS[engine]}|(?:[A-Za-z_][\w$]*|`[^`]+`)(?:\.(?:[A-Za-z_][\w$]*|`[^`]+`))*|\$\d+|{NUMBER}|<=|>=|<>|!=|\s+|[^\s]"
    cut = scans.select("id", "schema_name", "relation", "table_name", F.posexplode(F.regexp_extract_all("predicate", F.lit(f"({pieces})"), F.lit(1))).alias("pos", "tok"))
    if engine == "postgres":
        asked = cut.filter(F.col("tok").rlike(f"^{cast}$")).withColumn("column", F.regexp_extract("tok", rf"^\(({name})\)", 1))
    else:
        solid = cut.filter(~F.col("tok").rlike(r"^\s+$")).withColumn("up", F.upper("tok"))
        at = Window.partitionBy("id").orderBy("pos")
        side = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
        solid = solid.withColumn("depth", F.sum(side).over(at.rowsBetween(Window.unboundedPreceding, 0)) + (F.col("tok") == ")").cast("int"))
        own = Window.partitionBy("id", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        solid = solid.withColumn("grp", F.last(F.when(F.col("tok") == "(", F.col("pos")), ignorenulls=True).over(own))
        number = F.col("tok").rlike(r"^(?:\$\d+|\.?\d.*)$")
        solid = solid.withColumn("number", number).withColumn("listed", F.max(F.col("number").cast("int")).over(Window.partitionBy("id", "depth", "grp")) == 1)
        lead = lambda c, n: F.lead(c, n).over(at)
        lag = lambda c, n: F.lag(c, n).over(at)
        # a column may stand in brackets of its own
        called = F.coalesce(lag("tok", 2).rlike("^[A-Za-z_`]") & ~lag("up", 2).isin(*WORDS), F.lit(False))
        wrapped = F.coalesce((lag("tok", 1) == "(") & (lead("tok", 1) == ")") & ~called, F.lit(False))
        ahead = lambda c, n: F.when(wrapped, lead(c, n + 1)).otherwise(lead(c, n))
        behind = lambda c, n: F.when(wrapped, lag(c, n + 1)).otherwise(lag(c, n))
        met = (
            (ahead("up", 1).isin(*COMPARES) & ahead("number", 2)) | (behind("up", 1).isin(*COMPARES) & behind("number", 2)) | ((ahead("up", 1) == "IN") & ahead("listed", 2))
            | ((ahead("up", 1) == "BETWEEN") & (ahead("number", 2) | ahead("number", 4)))
        )
        is_column = F.col("tok").rlike("^[A-Za-z_`]") & ~F.col("tok").contains("'") & ~F.col("up").isin(*WORDS) & F.coalesce(lead("tok", 1) != "(", F.lit(True))
        asked = solid.withColumn("met", F.coalesce(met, F.lit(False)) & is_column).filter("met").withColumn("column", F.col("tok"))
    parts = F.split(F.regexp_replace("column", '["`]', ""), r"\.")
    asked = asked.select("id", "pos", "schema_name", "relation", "table_name", "column", F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("q"), F.element_at(parts, -1).alias("column_name"))
    named = asked.join(aliases.select("id", F.col("alias").alias("q"), F.col("table_name").alias("aliased")), ["id", "q"], "left")
    mine = F.col("q").isNull() | (F.col("q") == F.col("relation"))
    typed = _typed(named.withColumn("owner", F.when(mine, F.coalesce("table_name", "relation")).otherwise(F.coalesce("aliased", "q"))), types)
    if engine == "postgres":
        new = F.when(F.col("data_type").isNull() | F.col("data_type").isin(*VARCHARS), F.col("column"))
    else:
        new = F.when(F.col("data_type").isin(*NOT_NUMERIC), F.concat(F.lit("CAST("), F.col("column"), F.lit(" AS DOUBLE PRECISION)")))
    changed = typed.select("id", "pos", new.alias("new")).filter("new is not null")
    whole = cut.join(changed, ["id", "pos"], "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "tok").alias("tok")))).alias("t"))
    put = whole.select("id", F.array_join(F.transform("t", lambda x: x["tok"]), "").alias("__p"))
    return scans.select("id", "predicate").join(put, "id", "left").select("id", F.coalesce("__p", "predicate").alias("predicate"))
