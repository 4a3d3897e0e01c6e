"""Benchmark decontamination: size-partitioned MinHash containment search, in SQL functions.

A test item with n distinct word shingles is contained in a document at ``threshold`` if
the document has at least ``ceil(threshold * n)`` of them, so it misses at most m, the rest.

* Items are partitioned by size (powers of two). All items of a partition have a signature
  of the same length: the most that any of its sizes may miss, and ``AGREE`` more. A signature
  is the item's least values in MinHash order, shingles that fewer items share before those
  that many share, so that a stock phrase of many items is in few signatures.
* A document meets an item where its own values hit the signature. Of k signature values a
  document that contains the item has at least k - m; pairs that agree on fewer are dropped.
  Nothing contained is lost, so recall is 1 whatever the document's length.
* Each remaining pair is verified by the item's exact shingles in the document.

(Signatures of whole documents would miss here: twenty shingles in a document of twenty
thousand have a Jaccard similarity of 0.001, whatever the partition. So the document's side
of the comparison is all its values, and only the item's side is cut to a signature.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

WIDTH = 5
AGREE = 4
BROADCAST_KEYS = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 32


def words(text: Column) -> Column:
    """Lower-cased runs without white space; none for a null or blank text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_texts(words_col: str, width: int = WIDTH) -> Column:
    """All shingles as strings; the whole sequence if it is shorter; none without words."""
    last = F.greatest(F.size(words_col) - (width - 1), F.lit(1))
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words_col, i, width), " "))
    return F.when(F.size(words_col) > 0, every).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words_col: str, width: int = WIDTH) -> Column:
    """Like ``shingle_texts``, each as one hash of its words."""
    last = F.greatest(F.size(words_col) - (width - 1), F.lit(1))
    at = lambda i, k: F.try_element_at(F.col(words_col), i + k)
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[at(i, k) for k in range(width)]))
    return F.when(F.size(words_col) > 0, every).otherwise(F.array().cast("array<bigint>"))


def item_sets(items: DataFrame, threshold: float, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``(item_id, set_id)`` and the distinct sets ``(set_id, n_shingles, needed, shingles, hashes)``: equal items are searched once."""
    split = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter("item_id is not null and size(w) > 0")
    sets = split.select("item_id", F.array_sort(F.array_distinct(shingle_texts("w", width))).alias("shingles"), F.array_distinct(shingle_hashes("w", width)).alias("hashes"))
    named = sets.withColumn("set_id", F.md5(F.array_join("shingles", "\n").cast("binary")))
    needed = F.ceil(F.round(F.size("shingles") * F.lit(threshold), 6)).cast("int")
    distinct = named.dropDuplicates(["set_id"]).select("set_id", F.size("shingles").alias("n_shingles"), needed.alias("needed"), "shingles", "hashes")
    return named.select("item_id", "set_id").distinct(), distinct


def signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """``(set_id, size_part, key, agree)``: each set's signature values and how many of them a document must have.

    ``size_part`` is the size's power of two; the signature's length is the partition's.
    """
    part = F.floor(F.log2("n_shingles")).cast("int")
    largest = F.pow(F.lit(2.0), part + 1) - 1
    length = F.least(F.col("n_shingles"), (largest - F.ceil(F.round(largest * threshold, 6)) + AGREE).cast("int"))
    each = sets.select("set_id", "n_shingles", "needed", part.alias("size_part"), length.alias("k"), F.explode("hashes").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("sharing"))
    ordered = each.join(shared, "key").groupBy("set_id", "n_shingles", "needed", "size_part", "k").agg(F.array_sort(F.collect_list(F.struct("sharing", "key"))).alias("values"))
    agree = F.col("k") - (F.col("n_shingles") - F.col("needed"))
    return ordered.select("set_id", "size_part", agree.alias("agree"), F.explode(F.slice("values", F.lit(1), F.col("k"))).alias("v")).select("set_id", "size_part", F.col("v.key").alias("key"), "agree")


def _meet(left: DataFrame, right: DataFrame, on: str, fits: bool) -> DataFrame:
    """Equality join of many rows with few: the few broadcast if they fit, else repeated for every salt, so no value of ``on`` is one task."""
    if fits:
        return left.join(F.broadcast(right), on)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [on, "__salt"]).drop("__salt")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)``, a row per contained item.

    Shingles are ``width`` lower-cased words (all words of a shorter text) and count once.
    Texts that are null or blank contain nothing and are contained in nothing; rows with a
    null id take no part. Rows that repeat a doc_id count as one document, items that
    repeat an item_id are searched text by text and the best containment is kept. Extra
    columns, whatever their names, are ignored; an empty table on either side gives an
    empty table.

    Signatures, candidate pairs and item sets go to every executor only if they are at most
    ``BROADCAST_KEYS`` rows, and the sets ``BROADCAST_BYTES``; else both sides are shuffled
    with salted keys, so a phrase that a third of all documents have is no single task.
    """
    owners, sets = item_sets(items, threshold, width)
    sets = cut_lineage(sets)
    keys = cut_lineage(signatures(sets, threshold))
    n_keys = keys.count()
    sets_bytes, n_sets = sets.agg(F.sum(F.octet_length(F.array_join("shingles", " "))), F.count("*")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    met = rows.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes("w", width)).alias("key"))
    hits = _meet(met, keys, "key", n_keys <= BROADCAST_KEYS).select("doc_id", "set_id", "agree", "key").distinct()
    pairs = cut_lineage(hits.groupBy("doc_id", "set_id", "agree").agg(F.count("*").alias("n")).filter("n >= agree").select("doc_id", "set_id"))
    # exact: the shingles themselves, read again from the documents of the candidate pairs
    n_pairs = pairs.count()
    asked = rows.join(F.broadcast(pairs) if n_pairs <= BROADCAST_KEYS else pairs, "doc_id").select("doc_id", "set_id", words(F.col("text")).alias("w"))
    sized = sets.select("set_id", "n_shingles", "needed", "shingles")
    checked = _meet(asked, sized, "set_id", n_sets <= BROADCAST_KEYS and (sets_bytes or 0) <= BROADCAST_BYTES)
    parts = checked.select("doc_id", "set_id", "n_shingles", "needed", F.array_intersect("shingles", shingle_texts("w", width)).alias("has"))
    # rows that repeat an id are few; at most the item's own shingles come from each
    found = parts.select("doc_id", "set_id", "n_shingles", "needed", F.explode("has").alias("shingle")).distinct().groupBy("doc_id", "set_id", "n_shingles", "needed").agg(F.count("*").alias("n_found"))
    contained = _meet(found.filter("n_found >= needed"), owners, "set_id", owners.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS)
    best = contained.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_found"), F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_shingles"), F.col("b.n_found").cast("long").alias("n_found"), (F.col("b.n_found") / F.col("b.n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose document contains no item; rows with a null id stay."""
    bad = cut_lineage(contained_items(docs, items, threshold).select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad, docs["doc_id"] == bad["__id"], "left_anti")
