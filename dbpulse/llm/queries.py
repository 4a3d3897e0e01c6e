"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, decontaminate, embedding_dedup, line_dedup, mixing, quality, simhash, suffix_dedup, tokens, toxicity, url_filter, whitening
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d),
s AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM w),
f AS (SELECT s, min(doc_id) AS m FROM s GROUP BY s),
hit AS (SELECT doc_id, p FROM s JOIN f USING (s) WHERE m < doc_id),
cut AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM cut),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM span),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e,
    string_agg(substr(h, CAST(2 * e + 1 AS BIGINT), CAST(2 * (a - e) AS BIGINT)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(h, CAST(2 * coalesce(e, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op6_suffix_dedup", OP6_SQL)
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.repeated_passages(docs, length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k+4], ' '))) AS s
  FROM d WHERE len(w) > 0
), js AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k+4], ' '))) AS s
  FROM i WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n FROM js GROUP BY 1)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, count(*) AS n_found, count(*) / n AS containment
FROM ds JOIN js USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(round(0.8 * n, 6))
"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


PROBE = r"\### Assistant: </turn> ok"
OP10_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))
), n AS (
  SELECT *, 14 + length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM c
), p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


@query("op10_chat_format", OP10_SQL)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(PROBE))
    return chat.digests(chat.expand(given.unionByName(probe)))


def _scored(spark: SparkSession, sf_dir: str, method, label: str, folds: int, fold: int, limit: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).filter(~held_out("doc_id", folds, fold))
    scored = method.score(docs, method.fit(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted")
    )


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", folds=4, fold=2, limit=0.7)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", folds=5, fold=0, limit=0.5)


def _public_tokenizer(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    model = tokens.read_sentencepiece(model_file or _public_tokenizer("piece_bpe_32k.model"))
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "n_tokens")


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = vec_id
"""


@query("op9_embedding_dedup", OP9_SQL)
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_groups(table(spark, sf_dir, "embeddings"), cosine=0.98)


#: weights of a mixture for the query: four classes of sources, the rest together one part in 51
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}
BLOCK_CHARS = 20_000


def _op5_sql() -> str:
    weights = {**WEIGHTS, mixing.OTHER: 1}
    names = mixing.pattern(weights)
    steps = ", ".join(f"('{s}', {i}, {k}, {weights[s]})" for s in weights for i, k in enumerate(k for k, n in enumerate(names) if n == s))
    listed = ", ".join(f"'{s}'" for s in WEIGHTS)
    order = "PARTITION BY mix_source ORDER BY o, doc_id, chars ROWS UNBOUNDED PRECEDING"
    return f"""
WITH pattern(s, nth, slot, weight) AS (VALUES {steps}),
d AS (
  SELECT doc_id, text, CASE WHEN source IN ({listed}) THEN source ELSE '{mixing.OTHER}' END AS mix_source,
    coalesce(length(text), 0) AS chars, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents
), r AS (
  SELECT *, CAST(sum(chars) OVER ({order}) - chars AS BIGINT) AS run, row_number() OVER ({order}) AS mix_rank FROM d
), b AS (SELECT *, run // {BLOCK_CHARS} AS block FROM r)
SELECT doc_id, text, mix_source, block, (block // weight) * {len(names)} + slot AS slot, mix_rank
FROM b JOIN pattern ON s = mix_source AND nth = block % weight
"""


@query("op5_mixing", _op5_sql())
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.schedule(docs, WEIGHTS, 1, BLOCK_CHARS).select("doc_id", "text", "mix_source", "block", "slot", "mix_rank")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day drawn from their id, since the table has none."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages' own hosts, domains and first path parts."""
    seen = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path")).filter("host is not null").distinct()

    def number(text):
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")

    def entries(kind, pattern, modulus, changes):
        made = seen.select(F.lit(kind).alias("kind"), pattern.alias("pattern")).distinct().withColumn("h", number(F.col("pattern")))
        dated = [F.struct(F.lit(a).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod("h", F.lit(300)) + after).cast("int")).alias("changed_at")) for a, after in changes]
        return made.filter(F.pmod("h", F.lit(modulus)) == 0).select("kind", "pattern", F.inline(F.array(*dated)))

    host = F.col("host")
    return (
        entries("host", host, 2, [("block", 0), ("remove", 60)])
        .unionByName(entries("domain", F.substring_index(host, ".", -2), 1, [("block", 30), ("allow", 45), ("block", 90)]))
        .unionByName(entries("prefix", F.concat(host, F.lit("/"), F.substring_index(F.substring_index("path", "/", 2), "/", -1), F.lit("/")), 3, [("allow", 10), ("remove", 200)]))
    )


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS DATE) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
    coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages
), pats AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM p WHERE host IS NOT NULL
  UNION SELECT 'domain', array_to_string(string_split(host, '.')[-2:], '.') FROM p WHERE host IS NOT NULL
  UNION SELECT 'prefix', lower(host || '/' || split_part(path, '/', 2) || '/') FROM p WHERE host IS NOT NULL
), raw AS (
  SELECT DISTINCT 'prefix' AS kind, host || '/' || split_part(path, '/', 2) || '/' AS pattern FROM p WHERE host IS NOT NULL
  UNION SELECT kind, pattern FROM pats WHERE kind <> 'prefix'
), h AS (SELECT *, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS h FROM raw
), changes(kind, modulus, action, after) AS (VALUES ('host', 2, 'block', 0), ('host', 2, 'remove', 60),
  ('domain', 1, 'block', 30), ('domain', 1, 'allow', 45), ('domain', 1, 'block', 90), ('prefix', 3, 'allow', 10), ('prefix', 3, 'remove', 200)
), e AS (
  SELECT kind, lower(pattern) AS pattern, CAST(DATE '2024-01-01' + CAST(h % 300 + after AS INTEGER) AS DATE) AS changed_at, min(action) AS action
  FROM h JOIN changes USING (kind) WHERE h % modulus = 0 GROUP BY ALL
), v AS (
  SELECT kind, pattern, action, changed_at AS valid_from, lead(changed_at) OVER (PARTITION BY kind, pattern ORDER BY changed_at) AS valid_to FROM e
), held AS (
  SELECT page_id, p.host, v.*, CASE kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END AS k
  FROM p JOIN v ON action <> 'remove' AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
    AND ((kind = 'host' AND pattern = p.host) OR (kind = 'domain' AND ('.' || p.host) LIKE '%.' || pattern)
      OR (kind = 'prefix' AND starts_with(lower(p.host || path), pattern)))
), best AS (
  SELECT page_id, kind, pattern, action, valid_from FROM held
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k DESC, length(pattern) DESC, action) = 1
)
SELECT page_id, host, coalesce(action, 'keep') AS verdict, kind, pattern, valid_from FROM p LEFT JOIN best USING (page_id)
"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(captures_of(pages), list_of(pages))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation as a long; null where it needs more than 64 bits."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blanks),
s AS (SELECT r, doc_id, string_split(t, chr(10)) AS a FROM d),
l AS (SELECT r, doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM s),
k AS (SELECT l.*, translate(trim(line, blanks), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l, w),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND (doc_id IS NULL OR doc_id < last) AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query("op12_line_dedup", OP12_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def _op13_sql() -> str:
    # crc32 a bit at a time; the cheapest repair forwards, kept for each state as its cost in eight digits and its audit
    # (an insertion costs 5 and a deletion of the row beside it 2, so none is ever in a cheapest repair)
    crc = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''),
      lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""
    step = lambda v, cost, letter, when: f"CASE WHEN {v} IS NOT NULL AND {when} THEN printf('%08d', CAST(substr({v}, 1, 8) AS INTEGER) + {cost}) || substr({v}, 9) || '{letter}' END"
    stay = lambda v: step(v, "2", "D", "true")
    keep = lambda v, initial: step(v, "cut", "K", f"NOT gone AND initial = '{initial}'")
    give = lambda v: step(v, "1 + cut", "R", "NOT gone")
    to_user = ", ".join(f(v) for v in ("v0", "v1", "v3") for f in (lambda v: keep(v, "u"), give))
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), h AS (SELECT *, {crc} % 20 AS h FROM c),
d AS (
  SELECT conv, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0
), o AS (
  SELECT conv, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare
  FROM d WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM f),
r AS (
  SELECT DISTINCT conv, 0 AS i, '00000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM g
  UNION ALL
  SELECT g.conv, CAST(g.i AS INTEGER), {stay("v0")}, least({stay("v1")}, {keep("v0", "s")}), least({stay("v2")}, {to_user}), least({stay("v3")}, {keep("v2", "a")}, {give("v2")})
  FROM r JOIN g ON g.conv = r.conv AND g.i = r.i + 1
), best AS (SELECT conv, least(v0, v3) AS v FROM r QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1
), e AS (SELECT g.*, v, substr(v, CAST(8 + i AS BIGINT), 1) AS letter FROM g JOIN best USING (conv)
), k AS (
  SELECT *, row_number() OVER w AS place, first_value(initial || letter) OVER w AS head FROM e WHERE letter <> 'D' WINDOW w AS (PARTITION BY conv ORDER BY i)
), t AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place + CAST(head = 'sK' AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS said FROM k GROUP BY conv
), n AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, any_value(v) AS v FROM e GROUP BY conv
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(substr(v, 1, 8), '0') AS BIGINT) AS cost, coalesce(substr(v, 9), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM c) a LEFT JOIN n USING (conv) LEFT JOIN t USING (conv)
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by a hash of conversation and turn; nulls but in ids and turns become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how")).filter("how != 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("how") == 3, 1).otherwise(0))).alias("copy"),
    ).drop("copy")


@query("op13_conversation_repair", _op13_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation of which no row is left has zeros, no audit and the digest of an empty text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.digests(conversation_repair.repair(damaged(given)))
    every = given.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(found, "conv", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
