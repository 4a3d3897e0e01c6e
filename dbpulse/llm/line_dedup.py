"""Line dedup in SQL functions only: lines that many documents share stay in one of them.

Lines are exploded with their position, normalised and hashed to 128 bits; documents are
counted once per hash, and the lines of hashes over the threshold are dropped by position.

* Counting: pairs of hash and document are made distinct before they are counted, so a line
  that a third of all documents hold is counted in many tasks and summed from partial counts.
* Finding the places of shared lines: hashes that hold at least ``1 / HOT_SHARE`` of all pairs
  are fewer than ``HOT_SHARE`` by that count alone and are broadcast; all others meet their
  lines in a shuffled join in which no key holds more than that share.
* Reassembling: a document's dropped positions (not its lines) come back to it, keyed by id and
  128 bits of its text, and the kept lines are joined in order. Texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, set_aside

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: at most so many hashes are broadcast
HOT_SHARE = 10_000
ADDED = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; other letters stay."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash128(name: str, *columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns).alias(f"{name}{seed}") for seed in (1, 2)]


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``(k1, k2, n_docs, last)``: hashes that at least ``min_docs`` documents hold, and the largest id of those."""
    held = lines.filter("doc is not null").select("k1", "k2", "doc").distinct()
    return held.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A text is split at line feeds; null and empty texts are one empty line. Lines whose key
    (see ``line_key``) has at least ``min_chars`` code points and is held by at least
    ``min_docs`` documents are dropped, all of them, except in the document of the largest id
    that holds it, which keeps all of its own. The other lines stay in order, joined by line
    feeds; nothing left is an empty text.

    Documents are told apart by id: rows that repeat an id count as one document, each is
    returned, and lines are dropped from each. Rows with a null id are returned too and lose
    shared lines, but count as no document. All columns stay, those named like an added one as
    ``<name>_given``. An empty table gives an empty table.
    """
    docs = set_aside(docs, *ADDED)
    # "__" names are this function's own and go at the end
    doc, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = [doc.alias("doc"), *_hash128("t", text)]
    lines = (
        docs.select(*row, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("doc", "t1", "t2", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .select("doc", "t1", "t2", "pos", *_hash128("k", line_key(F.col("line"))))
    )
    shared = cut_lineage(shared_lines(lines, min_docs))
    # distinct pairs of hash and document, all of them: hashes of n_docs >= pairs / HOT_SHARE are at most HOT_SHARE
    pairs = shared.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * HOT_SHARE >= max(pairs, 1)
    marked = lines.join(F.broadcast(shared.filter(hot).select("k1", "k2", F.col("last").alias("hot_last"))), ["k1", "k2"], "left")
    found = marked.filter("hot_last is not null").select("doc", "t1", "t2", "pos", F.col("hot_last").alias("last")).unionByName(
        marked.filter("hot_last is null").join(shared.filter(~hot).select("k1", "k2", "last"), ["k1", "k2"]).select("doc", "t1", "t2", "pos", "last")
    )
    gone = found.filter(F.col("doc").isNull() | (F.col("doc") < F.col("last")))
    dropped = gone.select(F.coalesce("doc", F.lit(0)).alias("__doc"), F.col("doc").isNull().alias("__none"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "pos")
    key = ["__doc", "__none", "__t1", "__t2"]
    dropped = dropped.groupBy(*key).agg(F.collect_set("pos").alias("__gone"))
    keyed = docs.select("*", F.coalesce(doc, F.lit(0)).alias("__doc"), doc.isNull().alias("__none"), *[c.alias(f"__t{k}") for k, c in enumerate(_hash128("t", text), 1)])
    whole = keyed.join(dropped, key, "left").withColumn("__lines", F.split(text, "\n"))
    n = F.size("__lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return whole.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__gone").isNull(), text).otherwise(left).alias("kept_text"),
    )
