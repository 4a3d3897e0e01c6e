"""URL filters by a temporal list join.

A list is a dated log: on a day an entry (a host, a domain with its subdomains, or a URL
prefix) is put on or taken off. The entries of one pattern become validity intervals, from
each change to the next; a capture is then checked against the intervals that hold at its
own fetch time, so a page is judged by the list of its day, not of today.

A capture asks for its host, each parent domain and each path prefix up to a ``/``: a
handful of keys, looked up by equality; the interval is a residual condition of the same
join, so nothing is compared with the whole list. If several entries hold, the most
specific wins: prefix before host before domain, longer before shorter, "allow" before
"block".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

BROADCAST_ROWS = 100_000
HOT_SHARE = 10_000
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; null where the URL has no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment; ``/`` where there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def validity(entries: DataFrame) -> DataFrame:
    """``entries(kind, pattern, action, changed_at)`` -> intervals ``(kind, pattern, action, valid_from, valid_to)``.

    ``kind`` is host, domain or prefix; ``action`` is block, allow or remove. An interval
    runs from its change up to, not including, the next change of the same pattern; the
    last is open (null end). Of several changes at one time the least action in the order
    allow, block, remove counts. Entries with a null kind, pattern, action or time are
    left out.
    """
    known = entries.dropna(subset=["kind", "pattern", "action", "changed_at"]).withColumn("pattern", F.lower("pattern"))
    one = known.groupBy("kind", "pattern", "changed_at").agg(F.min("action").alias("action"))
    order = Window.partitionBy("kind", "pattern").orderBy("changed_at")
    spans = one.select("kind", "pattern", "action", F.col("changed_at").alias("valid_from"), F.lead("changed_at").over(order).alias("valid_to"))
    return spans.filter("action != 'remove'")


def _depth(pattern: Column) -> Column:
    """How many slashes a prefix has."""
    return F.length(pattern) - F.length(F.replace(pattern, F.lit("/"), F.lit("")))


def _keys(host: Column, path: Column, depths: list[int]) -> Column:
    """Structs (kind, pattern, rank): everything a list with prefixes of these depths could hold about this address."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i + 1, n), ".").alias("pattern"), (F.lit(100) - i).alias("rank")),
    )
    # of a long path only the prefixes that the list may have are made; the path is split once, as a lambda's variable
    deep = F.array(*[F.lit(d) for d in depths]).cast("array<int>")

    def of_parts(parts: Column) -> Column:
        whole = F.when(F.array_contains(deep, F.size(parts) - 1), F.array(F.size(parts))).otherwise(F.array().cast("array<int>"))
        wanted = F.concat(F.filter(deep, lambda d: (d > 0) & (d < F.size(parts))), whole)
        made = lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise(""))
        return F.transform(wanted, lambda i: F.struct(F.lit("prefix").alias("kind"), made(i).alias("pattern"), (i + 1000).alias("rank")))

    prefixes = F.flatten(F.transform(F.array(F.split(F.lower(path), "/")), of_parts))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"), F.lit(500).alias("rank")))
    return F.concat(domains, prefixes, own)


def _lookup(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """Join on kind and pattern by shuffling; patterns asked for by over one in ``HOT_SHARE`` of all keys, so no more than that many, are salted."""
    asked = cut_lineage(keyed.groupBy("kind", "pattern").agg(F.count("*").alias("n")).join(spans.select("kind", "pattern").distinct(), ["kind", "pattern"], "left_semi"))
    total = asked.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(asked.filter(F.col("n") > total / HOT_SHARE).select("kind", "pattern", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("host", "path", "fetched_at"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = keyed.join(hot, ["kind", "pattern"], "left").withColumn("salt", salt)
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = spans.join(hot, ["kind", "pattern"], "left").select(*spans.columns, F.explode(every).alias("salt"))
    return left.join(right, ["kind", "pattern", "salt"])


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(page_id, url, fetched_at)`` -> ``(page_id, host, verdict, kind, pattern, valid_from)``, a row per capture.

    ``verdict`` is block, allow, or keep where no entry holds at the fetch time. A null URL
    or one without host, and a null fetch time, give keep. Repeated captures come back as
    often. Extra columns, whatever their names, are ignored; an empty table gives an empty table.

    Each address and time is looked up once however often it was captured, by its host, its
    domains and those prefixes of its path that are as deep as one of the list. The intervals
    are sent to every executor only if they are at most ``BROADCAST_ROWS``; else both sides
    are shuffled, with salted keys for the patterns that many addresses ask for.
    """
    spans = validity(entries)
    small = spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("fetched_at"))
    asked = rows.filter("host is not null and fetched_at is not null").select("host", "path", "fetched_at").distinct()
    # numbers of slashes, as many as the deepest prefix has at most
    depths = sorted(r.d for r in spans.filter("kind = 'prefix'").select(_depth(F.col("pattern")).alias("d")).distinct().collect())
    keyed = asked.select("host", "path", "fetched_at", F.inline(_keys(F.col("host"), F.col("path"), depths)))
    met = keyed.join(F.broadcast(spans), ["kind", "pattern"]) if small else _lookup(keyed, spans)
    held = met.filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    strength = F.struct(F.col("rank"), (F.col("action") == "allow").cast("int"))
    best = held.groupBy("host", "path", "fetched_at").agg(F.max_by(F.struct("action", "kind", "pattern", "valid_from"), strength).alias("b"))
    return rows.join(best, ["host", "path", "fetched_at"], "left").select(
        "page_id", "host", F.coalesce("b.action", F.lit("keep")).alias("verdict"), F.col("b.kind").alias("kind"), F.col("b.pattern").alias("pattern"), F.col("b.valid_from").alias("valid_from")
    )
