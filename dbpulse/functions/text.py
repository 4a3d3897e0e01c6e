"""Column expressions over SQL texts, predicates and evidence.

There is no parser here: each rule is a pattern that is exact for the shapes it accepts
and gives null for others; what needs a statement's clauses is in ``statements``. A literal or quoted part is found by one scan (``_pieces``),
so a quote inside a comment, or a comment inside a string, is not taken for what it is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rounds import written

# patterns with possessive loops: long texts need no deep stack
STRING = r"'[^']*+(?:''[^']*+)*+'"
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
COMMENT = r"--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
#: decimal, exponent, hexadecimal and binary numbers that are not part of a name
NUMBER = r"(?<![\w$.])(?:0[xX][0-9a-fA-F]+|0[bB][01]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$])"
_ESCAPED = r"(?:[^'\\]++|\\[\s\S]|'')*+'"
#: strings by engine: with prefix, with backslashes where they escape, between dollar tags; in mysql also in double quotes
STRINGS = {
    "postgres": rf"(?<![\w$])[eE]'{_ESCAPED}|(?:(?<![\w$])(?:[bBxXnN]|[uU]&))?{STRING}|(?<![\w$])\$(?<tag>(?:[A-Za-z_]\w*)?)\$[\s\S]*?\$\k<tag>\$",
    "mysql": rf"(?:(?<![\w$])(?:[bBxXnN]|_[A-Za-z0-9]+))?'{_ESCAPED}|" + r'"(?:[^"\\]++|\\[\s\S]|"")*+"',
}
NAMES = {"postgres": QUOTED, "mysql": r"`[^`]*+`"}
COMMENTS = {"postgres": COMMENT, "mysql": r"--(?=\s|$)[^\n]*+|#[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"}

# Rule names and their codes.
CODES = {
    "baseline_degradation": "AP-01",
    "avoidable_full_scan": "AP-02",
    "non_sargable_predicate": "AP-03",
    "missing_index": "AP-04",
    "unused_index": "AP-05",
    "n_plus_one": "AP-06",
    "disk_spill": "AP-07",
    "cardinality_misestimate": "AP-08",
    "inconsistent_lock_order_deadlock": "CT-01",
    "lock_mode_conversion_deadlock": "CT-02",
    "range_contention_deadlock": "CT-03",
    "lock_amplification_deadlock": "CT-04",
    "long_transaction_cascade": "CT-05",
    "unclassified_deadlock": "CT",
}
NOT_AVAILABLE = "Not available"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _pieces(col: Column, pattern: str, made) -> Column:
    """Replace each match of ``pattern`` by ``made(match, number from 1)``."""

    def put(hits: Column) -> Column:
        def join(plain: Column) -> Column:
            rest = F.transform(F.slice(plain, 2, F.size(plain)), lambda x, i: F.concat(made(F.get(hits, i), i + 1), x))
            return F.concat(F.get(plain, 0), F.array_join(rest, ""))

        return _let(F.split(col, pattern, -1), join)

    return _let(F.regexp_extract_all(col, F.lit(f"({pattern})"), F.lit(1)), put)


def _numbered(col: Column, pattern: str, after: Column) -> Column:
    """Replace the matches of ``pattern`` by ``$n``, counted on from ``after``."""
    put = lambda plain: F.concat(F.get(plain, 0), F.array_join(F.transform(F.slice(plain, 2, F.size(plain)), lambda x, i: F.concat(F.lit("$"), (i + 1 + after).cast("string"), x)), ""))
    return _let(F.split(col, pattern, -1), put)


def _is_comment(m: Column, engine: str) -> Column:
    begins = m.startswith("--") | m.startswith("/*")
    return begins | m.startswith("#") if engine == "mysql" else begins


def mask_sql(col: Column, engine: str = "postgres") -> Column:
    """Strings become ``''``, quoted names ``""``, comments a space; null if one does not end.

    By the engine's rules: backslashes escape in mysql and in ``E'...'``, ``#`` begins a comment in
    mysql, where double quotes hold a string and back quotes a name; dollar quotes are strings.
    """
    name = '"' if engine == "postgres" else "`"
    kinds = lambda m, _: F.when(_is_comment(m, engine), " ").when(m.startswith(name), '""').otherwise("''")
    whole = lambda m: F.when(F.replace(F.replace(m, F.lit("''"), F.lit("")), F.lit('""'), F.lit("")).rlike(r"['\"`]|/\*|\*/|\$[A-Za-z_]*\$"), None).otherwise(m)
    return _let(_pieces(col, f"{COMMENTS[engine]}|{NAMES[engine]}|{STRINGS[engine]}", kinds), whole)


def canonical_text(col: Column, engine: str = "postgres") -> Column:
    """Comments go, every literal becomes ``$n`` in reading order.

    Numbers go on from the highest ``$n`` there is. Null texts, and texts in which anything is
    left that may be a literal (an open quote or comment, digits that belong to no name),
    give the marker: nothing leaves unless it is surely clean.
    """
    name = '"' if engine == "postgres" else "`"
    outer = f"{COMMENTS[engine]}|{NAMES[engine]}|{STRINGS[engine]}"
    highest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col, F.lit(r"(?<![\w$])\$(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))), F.lit(0))

    def put(hits: Column) -> Column:
        # quoted names are set aside, so that digits and quotes in them are not taken for literals
        aside = lambda m: F.when(_is_comment(m, engine), " ").when(m.startswith(name), "\u0003").otherwise(m)
        bare = _let(F.split(col, outer, -1), lambda plain: F.concat(F.get(plain, 0), F.array_join(F.transform(F.slice(plain, 2, F.size(plain)), lambda x, i: F.concat(aside(F.get(hits, i)), x)), "")))
        names = F.filter(hits, lambda m: m.startswith(name))
        return _let(highest, lambda top: _let(_numbered(bare, f"{STRINGS[engine]}|{NUMBER}", top), lambda made: _let(names, lambda n: checked(made, n))))

    def checked(made: Column, names: Column) -> Column:
        unclean = made.rlike(r"['\"`\\]|/\*|\*/|\$[A-Za-z_]*\$|(?<![\w$])\d|\d\.\d") | col.contains("\u0003")
        flat = F.split(F.trim(F.regexp_replace(made, r"\s+", " ")), "\u0003", -1)
        back = _let(flat, lambda parts: F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda x, i: F.concat(F.get(names, i), x)), "")))
        return F.when(~unclean, back)

    return F.coalesce(_let(F.regexp_extract_all(col, F.lit(f"({outer})"), F.lit(1)), put), F.lit(NOT_AVAILABLE))


def _alike(col: Column, engine: str) -> Column:
    """The text with each number that stands by itself made 0, which changes nothing in its canonical text.

    Such a number is a literal, or lies inside of one or of a comment. In a quoted name it would
    be part of the name, so texts with name quotes stay as they are; as do numbers that touch a name, a sign
    of a parameter, a further point or an exponent.
    """
    name = '"' if engine == "postgres" else "`"
    return F.when(col.contains(name), col).otherwise(F.regexp_replace(col, r"(?<![\w$.])(?<![eE][+-])\d++(?:\.\d++)?+(?![\w$.])", "0"))


#: texts made once (canonical texts, cleaned predicates) are broadcast to their rows if there are at most so many kinds
BROADCAST_KINDS = 200_000


def canonical_texts(df: DataFrame, column: str, out: str = "canonical", engine: str = "postgres", kinds: int = BROADCAST_KINDS) -> DataFrame:
    """``df`` with the canonical text of ``column``; texts that differ only in numbers, as those of every snapshot do, are made once.

    The texts themselves are not shuffled, but for one of each kind: up to ``kinds`` canonical texts are
    broadcast to the rows, more meet them by hashes.
    """
    once = written(df.select(_alike(F.col(column), engine).alias("__like")).distinct())
    hashes = {f"__h{k}": F.xxhash64(F.lit(k), "__like") for k in (1, 2)}
    made = once.withColumns(hashes).select(*hashes, canonical_text(F.col("__like"), engine).alias(out))
    keyed = df.withColumn("__like", _alike(F.col(column), engine)).withColumns(hashes).drop("__like")
    if once.count() > kinds:
        return keyed.join(made, [*hashes]).drop(*hashes)
    return keyed.join(F.broadcast(written(made)), [*hashes]).drop(*hashes)


def collapse_lists(col: Column) -> Column:
    """IN lists and repeated VALUES rows become one placeholder; DISTINCTROW is DISTINCT."""
    one = F.regexp_replace(col, r"(?i)\bIN\s*\([^()]*\)", "IN (...)")
    two = F.regexp_replace(one, r"(?i)\bVALUES\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*", "VALUES (...)")
    return F.regexp_replace(two, r"(?i)\bDISTINCTROW\b", "DISTINCT")


def split_params(col: Column) -> Column:
    """``$1AND`` -> ``$1 AND``."""
    return F.regexp_replace(col, r"(\$\d+)([A-Za-z_])", "$1 $2")


def redact_predicate(col: Column) -> Column:
    """Literals with their casts become ``$n``, numbered on from the highest ``$n`` there is."""
    top = F.array_max(F.transform(F.regexp_extract_all(col, F.lit(r"\$(\d+)"), F.lit(1)), lambda x: x.cast("int")))
    literal = rf"(?:{STRING}|{NUMBER})(?:::[a-z]+(?: [a-z]+)*)?"
    return _numbered(col, literal, F.coalesce(top, F.lit(0)))


def is_single(col: Column) -> Column:
    """No ``;`` but one at the end, outside strings and comments."""
    return ~F.regexp_replace(mask_sql(col), r";\s*$", "").contains(";")


def is_explainable(col: Column) -> Column:
    """Begins with SELECT or WITH and has no writing or locking word."""
    masked = mask_sql(col)
    writes = r"(?i)\b(?:INSERT|UPDATE|DELETE|MERGE|INTO|LOCK|TRUNCATE|FOR\s+(?:UPDATE|SHARE))\b"
    return F.coalesce(masked.rlike(r"(?i)^[\s(]*(?:SELECT|WITH)\b") & ~masked.rlike(writes) & is_single(col), F.lit(False))


def cap_text(df: DataFrame, column: str, most: int = 8192) -> DataFrame:
    """Texts cut at ``most`` characters, with a flag."""
    return df.withColumn("truncated", F.coalesce(F.length(column) > most, F.lit(False))).withColumn(column, F.substring(column, 1, most))


def to_utc(col: Column) -> Column:
    """ISO text with or without offset -> naive UTC time; null if it is not one."""
    aware = F.to_utc_timestamp(F.try_to_timestamp(col), F.current_timezone())
    return aware.cast("timestamp_ntz")


def to_granted(col: Column) -> Column:
    """GRANTED and WAITING as truth values."""
    word = F.upper(F.trim(col))
    return F.when(word == "GRANTED", True).when(word == "WAITING", False)


def to_pids(col: Column) -> Column:
    """Comma text -> numbers; what is not digits is dropped."""
    parts = F.transform(F.split(col, ","), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("long"))


def redact_sessions(df: DataFrame, raw: str, canonical: str) -> DataFrame:
    """The raw text goes; the canonical one or the marker stays."""
    return df.withColumn(canonical, F.coalesce(canonical, F.lit(NOT_AVAILABLE))).drop(raw)


WINDOW = 16
CHUNK, PHRASE_CHUNK = 4_096, 65_536
MARKERS_AT_ONCE = 200_000
#: windows that begin a word; any window at all (words of phrases are cut at spaces)
AT_WORDS, ANYWHERE = r"(?<=\W)(?=(\w[\s\S]{{{n}}}))", r"(?=([\s\S]{{{m}}}))"


#: so many pairs of row and marker that share a window are broadcast to the rows; more meet them by a shuffle
BROADCAST_NEAR = 500_000


def leak_audit(tables: dict[str, DataFrame], markers: DataFrame) -> DataFrame:
    """``(table_name, marker, n)``: how many rows of each table hold a marker in any column.

    A row that holds a marker has the words between its first and its last space whole. So a marker is
    found by equality of one window of three such words, the longest; rows give all such windows, each once, and
    only rows that share a marker's window are searched for the whole marker. Markers of fewer
    words go by ``WINDOW`` characters, the first that begin a word inside of them, those without such
    a window (short ones, single words) by windows as long as the shortest of them. Windows are
    hashed and joined in a hash join; ``markers(marker)`` is a stated query set, broadcast
    ``MARKERS_AT_ONCE`` at a time. A window carries the hash of its row, not its text: every table is
    read once for each of those and for each kind, and once more for the rows that are searched
    (rows of one hash are all searched, so equal rows count each and unequal ones do no harm).
    Null and empty markers are left out.
    """
    words = F.split("marker", " ", -1)
    inside = F.sequence(F.lit(2), F.size(words) - 3)
    said = lambda at: F.slice(words, at, 3)
    at = F.array_max(F.transform(inside, lambda i: F.struct(F.length(F.array_join(said(i), " ")).alias("n"), i.alias("i"))))
    phrase = F.when(F.size(words) >= 5, said(at["i"]))
    named = markers.filter("marker != ''").select("marker").distinct().withColumn("m", F.xxhash64("marker")).withColumn("phrase", phrase)
    known, wordy, others = named.select("m", "marker"), named.filter("phrase is not null"), named.filter("phrase is null")
    anchor = F.regexp_extract("marker", rf"\W(\w[\s\S]{{{WINDOW - 1}}})", 1)
    widest = wordy.agg(F.max(F.length(F.array_join("phrase", " ")))).first()[0]
    least = others.filter(anchor == "").agg(F.min(F.length("marker"))).first()[0]
    pieces = lambda pattern: lambda chunk: F.transform(F.regexp_extract_all(chunk, F.lit(pattern), F.lit(1)), lambda w: F.xxhash64(w))
    three = lambda chunk: _let(F.split(chunk, " ", -1), lambda all: F.transform(F.slice(all, 1, F.greatest(F.size(all) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(all, i + 1), F.get(all, i + 2))))
    kinds = []
    if widest is not None:
        kinds.append((three, PHRASE_CHUNK, widest + 2, wordy.select("m", F.xxhash64(*[F.get("phrase", F.lit(i)) for i in range(3)]).alias("h"))))
    kinds.append((pieces(AT_WORDS.format(n=WINDOW - 1)), CHUNK, WINDOW, others.filter(anchor != "").select("m", F.xxhash64(anchor).alias("h"))))
    if least is not None:
        kinds.append((pieces(ANYWHERE.format(m=least)), CHUNK, least, others.filter(anchor == "").select("m", F.xxhash64(F.substring("marker", 1, least)).alias("h"))))
    texts = {name: df.select(F.concat_ws("\u001f", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("row")).withColumn("id", F.xxhash64("row")) for name, df in tables.items()}
    pairs = [known.limit(0).select(F.lit("").alias("table_name"), F.col("m").alias("id"), "m")]
    for made, length, width, asked in kinds:
        blocks = -(-asked.count() // MARKERS_AT_ONCE)
        numbered = asked.withColumn("block", F.pmod("m", F.lit(max(blocks, 1))))
        # a chunk goes on for one window more, and begins with the character before it
        cut = F.regexp_extract_all("row", F.lit(rf"(?=([\s\S]{{1,{length + width + 1}}}))[\s\S]{{1,{length}}}"), F.lit(1))
        for name, rows in texts.items():
            chunks = rows.select("id", F.explode(F.when(F.length("row") > length, cut).otherwise(F.array("row"))).alias("chunk"))
            windows = chunks.select("id", F.explode(F.array_distinct(made(F.col("chunk")))).alias("h"))
            for block in range(blocks):
                some = F.broadcast(numbered.filter(F.col("block") == block).select("m", "h"))
                pairs.append(windows.join(some, "h").select(F.lit(name).alias("table_name"), "id", "m"))
    near = written(reduce(DataFrame.unionByName, pairs).distinct())
    few = near.count() <= BROADCAST_NEAR
    found = []
    for name, rows in texts.items():
        mine = near.filter(F.col("table_name") == name).select("id", "m").join(known, "m").select("id", "marker")
        hits = rows.join(F.broadcast(mine) if few else mine, "id").filter(F.col("row").contains(F.col("marker")))
        found.append(hits.groupBy("marker").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


def index_facts(df: DataFrame, column: str = "index_ref") -> DataFrame:
    """Method, uniqueness, partial, and columns in order (null for expressions) of an index definition."""
    inside = F.regexp_extract(column, r"(?i)USING\s+\w+\s*\((.*?)\)(?:\s+WHERE\b.*)?$", 1)
    parts = F.transform(F.split(inside, r",\s*"), lambda c: F.when(c.rlike(r"^[a-z_][a-z0-9_]*$"), c))
    return df.withColumn("method", F.regexp_extract(column, r"(?i)USING\s+(\w+)", 1)).withColumn("is_unique", F.col(column).rlike(r"(?i)^CREATE UNIQUE")).withColumn(
        "is_partial", F.col(column).rlike(r"(?i)\)\s+WHERE\b")
    ).withColumn("columns", parts)


def explicit_casts(leaves: DataFrame, catalog: DataFrame) -> DataFrame:
    """Marks leaves whose text or date column is compared with a number."""
    joined = leaves.join(catalog, ["table_name", "column_name"], "left")
    return joined.withColumn("cast", F.coalesce(F.col("data_type").isin("varchar", "char", "text", "date", "timestamp") & (F.col("value_kind") == "number"), F.lit(False)))


def lookup_by_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left row's right row by schema and table; else by table alone if one side has no schema and there is one candidate."""
    a, b = left.alias("a"), right.alias("b")
    same = F.col("a.table_name") == F.col("b.table_name")
    exact = F.col("a.schema_name").eqNullSafe(F.col("b.schema_name"))
    loose = F.col("a.schema_name").isNull() != F.col("b.schema_name").isNull()
    found = a.join(b, same & (exact | loose), "left")
    best = found.groupBy("a.id").agg(
        F.count_if(F.col("b.schema_name").eqNullSafe(F.col("a.schema_name")) & F.col("b.ref").isNotNull()).alias("n_exact"), F.count("b.ref").alias("n"),
        F.max(F.when(exact, F.col("b.ref"))).alias("by_exact"), F.max("b.ref").alias("any_ref"),
    )
    return best.select("id", F.when(F.col("n_exact") > 0, F.col("by_exact")).when(F.col("n") == 1, F.col("any_ref")).alias("ref"), ((F.col("n_exact") == 0) & (F.col("n") > 1)).alias("ambiguous"))


def query_identity(text: Column, query_id: Column) -> Column:
    usable = text.isNotNull() & (text != "") & (text != NOT_AVAILABLE)
    return F.when(usable, F.concat(F.lit("t"), F.substring(F.sha1(text.cast("binary")), 1, 16))).otherwise(F.coalesce(query_id, F.lit("")))


def finding_key(df: DataFrame) -> DataFrame:
    """Identity of a finding inside its rule (N22): query alone, table and index, signature, or query with table."""
    query = query_identity(F.col("canonic_query"), F.col("query_id"))
    table = F.concat_ws(".", "schema_name", "table_name")
    key = (
        F.when(F.col("rule").isin("baseline_degradation", "disk_spill", "cardinality_misestimate"), query).when(F.col("rule") == "unused_index", F.concat_ws("|", table, F.coalesce("index_name", F.lit(""))))
        .when(F.col("rule").endswith("_deadlock"), F.coalesce("signature", F.lit(""))).otherwise(F.concat_ws("|", table, query))
    )
    return df.withColumn("finding_key", key)


def deadlock_signature(trx: DataFrame) -> DataFrame:
    """``(report_id, signature)``: hash of the rule and the sorted (text, table, index, mode and scope) of its transactions.

    A part that is not known is empty, so it keeps its place.
    """
    known = [F.coalesce(F.col(c), F.lit("")) for c in ("canonic_query", "table_name", "index_name", "lock_mode", "lock_scope")]
    part = F.concat_ws("/", *known[:3], F.concat_ws(",", *known[3:]))
    return trx.groupBy("report_id", "rule").agg(F.array_join(F.array_sort(F.collect_list(part)), "|").alias("parts")).select(
        "report_id", F.substring(F.sha1(F.concat_ws("|", "rule", "parts").cast("binary")), 1, 16).alias("signature")
    )


def classify_error(errors: DataFrame, states: DataFrame, phrases: DataFrame) -> DataFrame:
    """``code`` by state, else by the first phrase of the message, else UNKNOWN, within the error's scope and section.

    ``errors(state, message, scope, section)``; ``states(state, state_code, scope, section)`` and
    ``phrases(nth, phrase, phrase_code, scope, section)`` are short fixed lists. An entry with a scope
    or a section holds for errors of that one only and goes before one without; one for a
    section goes before one for a scope.
    """
    entries = lambda df, *own: F.broadcast(df.select(F.collect_list(F.struct(*own, "scope", "section")).alias("list")))
    fits = lambda e: (e["scope"].isNull() | F.coalesce(e["scope"] == F.col("scope"), F.lit(False))) & (e["section"].isNull() | F.coalesce(e["section"] == F.col("section"), F.lit(False)))
    rank = lambda e: F.when(e["section"].isNotNull(), 0).when(e["scope"].isNotNull(), 1).otherwise(2)
    by_state = F.array_min(F.transform(F.filter("states", lambda e: F.coalesce(e["state"] == F.col("state"), F.lit(False)) & fits(e)), lambda e: F.struct(rank(e).alias("r"), e["state_code"].alias("code"))))["code"]
    said = F.filter("phrases", lambda e: F.coalesce(F.lower("message").contains(e["phrase"]), F.lit(False)) & fits(e))
    by_phrase = F.array_min(F.transform(said, lambda e: F.struct(rank(e).alias("r"), e["nth"].alias("nth"), e["phrase_code"].alias("code"))))["code"]
    both = errors.crossJoin(entries(states, "state", "state_code").withColumnRenamed("list", "states")).crossJoin(entries(phrases, "nth", "phrase", "phrase_code").withColumnRenamed("list", "phrases"))  # one row each
    return both.withColumn("code", F.coalesce(by_state, by_phrase, F.lit("UNKNOWN"))).drop("states", "phrases")


def enrich_issue(issues: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scope, severity and a message with the issue's section, from a catalog of codes."""
    joined = issues.join(F.broadcast(catalog), "code", "left")  # a fixed list of codes
    return joined.withColumn("message", F.concat(F.coalesce("text", F.lit("unknown issue")), F.lit(" in "), F.coalesce("section", F.lit("?")))).drop("text")


def code_of(col: Column) -> Column:
    """Rule name -> code; null for other names."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), col)


def evidence_metrics(df: DataFrame, groups: list[list[str]], most: int = 6) -> DataFrame:
    """The first key of each group that the evidence has a number for, in order, at most ``most``."""
    fields = F.from_json("evidence", "map<string,string>")
    pick = lambda g: F.coalesce(*[F.when(F.element_at("__m", k).try_cast("double").isNotNull(), F.concat(F.lit(f"{k}="), F.element_at("__m", k))) for k in g])
    metrics = F.slice(F.filter(F.array(*map(pick, groups)), lambda x: x.isNotNull()), 1, most)
    return df.withColumn("__m", fields).withColumn("metrics", F.array_join(metrics, ",")).drop("__m")


def finding_tables(df: DataFrame) -> DataFrame:
    """The finding's table and those its evidence lists, each once."""
    more = F.coalesce(F.from_json(F.get_json_object("evidence", "$.tables"), "array<string>"), F.array().cast("array<string>"))
    own = F.filter(F.array("table_name", F.get_json_object("evidence", "$.table")), lambda x: x.isNotNull())
    return df.withColumn("tables", F.array_distinct(F.concat(own, more)))


def evidence_facts(df: DataFrame, key: str, skip: list[str], most: int = 80) -> DataFrame:
    """``(key, name, value)`` of scalar evidence entries that are not listed or long."""
    facts = df.select(key, F.explode(F.from_json("evidence", "map<string,string>")).alias("name", "value"))
    return facts.filter(~F.col("name").isin(*skip) & (F.length("value") <= most) & ~F.col("value").rlike(r"^[\[{]"))


def fmt_duration(ms: Column) -> Column:
    """Milliseconds in the unit that reads best, one digit."""
    show = lambda x, unit: F.concat(F.round(x.cast("decimal(20,6)"), 1).cast("string"), F.lit(unit))
    return F.when(ms >= 3_600_000, show(ms / 3_600_000, " h")).when(ms >= 60_000, show(ms / 60_000, " min")).when(ms >= 1_000, show(ms / 1_000, " s")).otherwise(show(ms, " ms"))


def fmt_age(seconds: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u))
    return F.when(seconds < 60, unit(1, " s")).when(seconds < 3600, unit(60, " min")).when(seconds < 86400, unit(3600, " h")).otherwise(unit(86400, " d"))


def evidence_edges(df: DataFrame) -> DataFrame:
    """Edges of a finding's graph: query to table, table to column, table to index."""
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    q, t, c, i = (F.col(x) for x in ("query_id", "table_name", "column_name", "index_name"))
    edges = df.select("detection_id", F.inline(F.array(edge(q, t, "reads"), edge(t, c, "has column"), edge(t, i, "has index"))))
    return edges.filter("src is not null and dst is not null")


_LOCK = "struct<mode:string,scope:string,schema_name:string,table_name:string,targets:array<string>>"
_MEMBER = f"struct<process_id:bigint,victim:boolean,canonic_query:string,blocked_by:array<bigint>,waits_for:{_LOCK},holds:array<{_LOCK}>>"
_SESSION = "struct<process_id:bigint,session_state:string,canonic_query:string,blocking_pids:array<bigint>>"


def contention_graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of contention findings from their evidence.

    A deadlock's evidence lists ``transactions``, a cascade's has a ``root`` and
    ``blocked_sessions``; it is read as VARIANT by these paths, and what is missing or of another
    type gives nothing. Nodes: ``(detection_id, node, kind, tag)``, sessions (tag victim or root)
    and what they wait for or hold. Edges: ``(detection_id, src, dst, kind)`` with ``blocked by``,
    ``waits for`` and ``held by``; a lock is named by its targets, else by its table. Sessions
    without a process are left out.
    """
    parsed = df.select("detection_id", F.try_parse_json("evidence").alias("e"))
    got = lambda path, kind: F.try_variant_get("e", path, kind)
    none = F.lit(None).cast(f"array<{_LOCK}>")
    name = lambda pid: F.concat(F.lit("session "), pid.cast("string"))
    each = lambda array, kind, made: F.transform(F.coalesce(array, F.array().cast(f"array<{kind}>")), made)
    party = lambda pid, tag, by, waits, holds: F.struct(pid.alias("pid"), tag.alias("tag"), by.alias("by"), waits.alias("waits"), holds.alias("holds"))
    members = each(got("$.transactions", f"array<{_MEMBER}>"), _MEMBER, lambda t: party(t["process_id"], F.when(t["victim"], "victim"), t["blocked_by"], F.array(t["waits_for"]), t["holds"]))
    session = lambda s, tag: party(s["process_id"], tag.cast("string"), s["blocking_pids"], none, none)
    # one pass: the evidence is read once, and all of a party comes from its own row
    read = parsed.select("detection_id", members.alias("members"), got("$.root", _SESSION).alias("root"), got("$.blocked_sessions", f"array<{_SESSION}>").alias("sessions"))
    cascade = F.concat(F.array(session(F.col("root"), F.lit("root"))), each(F.col("sessions"), _SESSION, lambda s: session(s, F.lit(None))))
    every = F.when(F.col("root").isNull(), F.col("members")).otherwise(F.concat("members", cascade))
    parties = read.select("detection_id", F.inline(every)).filter("pid is not null").withColumn("p", name(F.col("pid")))
    named = lambda lock: F.when(F.size(lock["targets"]) > 0, lock["targets"]).when(lock["table_name"].isNotNull(), F.array(F.concat_ws(".", lock["schema_name"], lock["table_name"])))
    locks = lambda c: F.array_distinct(F.flatten(F.filter(F.transform(c, named), lambda x: x.isNotNull())))
    blockers = F.filter(F.array_distinct("by"), lambda b: b.isNotNull())
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    node = lambda n, kind, tag: F.struct(n.alias("node"), F.lit(kind).alias("kind"), tag.alias("tag"))
    p, untagged = F.col("p"), F.lit("")
    edges = F.concat(
        each(blockers, "bigint", lambda b: edge(p, name(b), "blocked by")), each(locks("waits"), "string", lambda x: edge(p, x, "waits for")), each(locks("holds"), "string", lambda x: edge(x, p, "held by"))
    )
    nodes = F.concat(
        F.array(node(p, "session", F.coalesce("tag", untagged))), each(blockers, "bigint", lambda b: node(name(b), "session", untagged)), each(locks("waits"), "string", lambda x: node(x, "lock", untagged)),
        each(locks("holds"), "string", lambda x: node(x, "lock", untagged)),
    )
    met = parties.select("detection_id", F.inline(nodes)).groupBy("detection_id", "node", "kind").agg(F.max("tag").alias("tag"))
    return met, parties.select("detection_id", F.inline(edges)).filter("dst is not null")


def severity(x: Column, high: float, medium: float | None = None) -> Column:
    """Bands of a number."""
    return F.when(x >= high, "high").when(x >= (medium if medium is not None else high), "medium").otherwise("low")


def _inside_out(col: Column, step) -> Column:
    """Apply ``step`` to the innermost parentheses, then to those around them, as often as there are any.

    Parentheses that are done are set aside as control characters and come back at the end,
    so nesting of any depth is met from the inside. Once none is left open the other rounds do nothing.
    """
    once = lambda text: F.regexp_replace(step(text), r"(?<!<[a-z_]{1,60}>)\(([^()]*)\)", "\u0001$1\u0002")
    inner = lambda text, _: F.when(text.contains("("), once(text)).otherwise(text)
    rounds = lambda text: F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(F.replace(text, F.lit("("), F.lit(""))), F.lit(1)))
    return _let(col, lambda text: F.translate(F.aggregate(rounds(text), text, inner), "\u0001\u0002", "()"))


def strip_markers(col: Column) -> Column:
    """Engine-internal ``<marker>(...)`` wrappers of any depth and sub-plan references become NULL."""
    out = F.regexp_replace(col, r"\((?:SubPlan|InitPlan) \d+\)|\b(?:SubPlan|InitPlan) \d+", "NULL")
    return _inside_out(out, lambda text: F.regexp_replace(text, r"<[a-z_]+>\([^()]*\)", "NULL"))


def clean_my_predicate(col: Column) -> Column:
    """Schema qualifiers, back quotes and optimizer markers go; literals become numbered (N33). Null where an unknown marker stays."""
    out = F.regexp_replace(col, "`", "")
    out = F.regexp_replace(out, r"\b\w+\.(\w+\.\w+)", "$1")
    bare = lambda text: F.regexp_replace(text, r"<(?:cache|if|is_not_null_test)>\(([^()]*)\)", "$1")
    out = _inside_out(out, lambda text: F.regexp_replace(bare(text), r"<not>\(([^()]*)\)", "NOT \u0001$1\u0002"))
    out = F.regexp_replace(out, r"(?i)\bcast\(([\w.]+) as date\)", "date($1)")
    numbered = _pieces(out, rf"{STRING}|(?<![\w$.])-?{NUMBER}", lambda m, n: F.when(m.startswith("'"), F.concat(F.lit("'$"), n.cast("string"), F.lit("'"))).otherwise(F.concat(F.lit("$"), n.cast("string"))))
    return _let(numbered, lambda text: F.when(text.rlike(r"<\w+>"), None).otherwise(text))


def clean_my_predicates(df: DataFrame, column: str, out: str = "predicate", kinds: int = BROADCAST_KINDS) -> DataFrame:
    """``df`` with the cleaned ``column`` (N33); predicates that differ only in whole numbers are cleaned once.

    Such a number stands by itself, so whatever it is it becomes the next ``$n``. Where a marker or
    bracket touches a word or another one, what is inside may become part of a name: that text stays as it is.
    """
    glued = F.col(column).rlike(r"[\w$.`)]<|\)[\w$.`<]")
    like = F.when(glued, F.col(column)).otherwise(F.regexp_replace(column, r"(?<![\w$.`])\d+(?![\w$.`])", "0"))
    once = written(df.select(like.alias("__like")).distinct())
    if once.count() > kinds:
        return df.withColumn(out, clean_my_predicate(F.col(column)))
    made = written(once.select(*[F.xxhash64(F.lit(k), "__like").alias(f"__h{k}") for k in (1, 2)], clean_my_predicate(F.col("__like")).alias(out)))
    keyed = df.withColumn("__like", like).withColumns({f"__h{k}": F.xxhash64(F.lit(k), "__like") for k in (1, 2)})
    return keyed.drop("__like", out).join(F.broadcast(made), ["__h1", "__h2"]).drop("__h1", "__h2")


def recommended_sql(df: DataFrame, key: str, column: str) -> DataFrame:
    """Statements named in a recommendation, in order, each once whatever its case and spaces."""
    pattern = r"((?:CREATE\s+(?:UNIQUE\s+)?INDEX|CREATE\s+STATISTICS|ALTER\s+TABLE|ANALYZE|DROP\s+INDEX)\b[^;]*;)"
    found = df.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("pos", "statement"))
    same = F.lower(F.regexp_replace("statement", r"\s+", ""))
    first = F.row_number().over(Window.partitionBy(key, same).orderBy("pos"))
    return found.withColumn("r", first).filter("r = 1").select(key, "pos", "statement")
