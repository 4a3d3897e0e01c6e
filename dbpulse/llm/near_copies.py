"""Near copies by SimHash and exact Jaccard similarity of word shingles, for the pipeline's stage.

Texts with equal shingle sets are one node. The nodes' SimHash fingerprints go through the
Gray-order index of ``simhash.near_links``; pairs within ``DISTANCE`` bits are verified by
their exact similarity. That finds close copies. At a similarity of 0.8 fingerprints lie about
ten bits apart, with a deviation of three, which no index of bit blocks reaches without
meeting everything, so what SimHash has not joined is completed: further candidates share
one of ``BANDS`` keys, each of ``ROWS`` least hash values. At 0.8 a pair is missed with
probability ``(1 - 0.8**5) ** 32``, 3e-6, and less above it. Links are only pairs whose
exact similarity suffices.

Buckets of the same nodes are met once, and buckets whose nodes are already in one group not
at all. The rest bring their nodes' shingle sets to a task, which emits a spanning forest of the
bucket's links and no pairs: a node is held against all others at once, its group grows, and
once all that are left to hold are in one group the bucket is done; so in a bucket of near
copies only those that are unlike the rest cost a look at all others. A bucket of more than
``BLOCK_ROWS`` nodes or ``BLOCK_HASHES`` shingles is cut into parts, and every two parts meet
in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import connected_components
from .simhash import SEED, majority, near_links, without

DISTANCE = 4
BANDS, ROWS = 32, 5
FACTORS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
HASHES_AT_ONCE = 512
SHINGLES_AT_ONCE = 200_000
BLOCK_ROWS, BLOCK_HASHES = 400, 1_000_000
SMALL_IDS = 500_000
#: buckets that hold at least so small a share of all places are fewer than that, and broadcast
HOT_SHARE = 10_000
BITMAP = 8


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, ascending; words and shingles as in ``simhash.fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    width, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    first, last, found = starts[: len(words) - width + 1], ends[width - 1 :] - 1, np.empty(0, np.uint64)
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        spans = zip(first[at : at + SHINGLES_AT_ONCE].tolist(), last[at : at + SHINGLES_AT_ONCE].tolist())
        found = np.union1d(found, np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64))
    return found


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key per band of least hash values; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        np.minimum(least, np.multiply.outer(FACTORS, hashes[at : at + HASHES_AT_ONCE]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """``BITMAP`` signed words in which each hash sets one bit."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[hashes % np.uint64(64 * BITMAP)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _bounded(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Without pairs that cannot have that similarity: each bit that one side alone has is a hash that it alone has."""
    side = lambda k: sets.select(F.col("node").alias(k), F.size("hashes").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    alone = lambda x, y: reduce(add, [F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITMAP)])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    most = joined.select("a", "b", "a_n", "b_n", F.least(F.col("a_n") - alone("a_bits", "b_bits"), F.col("b_n") - alone("b_bits", "a_bits")).alias("most"))
    return cut_lineage(most.filter(F.col("most") / (F.col("a_n") + F.col("b_n") - F.col("most")) >= similarity).select("a", "b"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, s1, s2, n, fp, bands)``: 128 bits of hash, size and SimHash of the shingle set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, fp, bands = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), shingle)
                names.append(set_name(hashes))
                n.append(len(hashes))
                fp.append(majority(hashes))
                bands.append(band_keys(hashes))
            two = np.array(names, np.int64).reshape(-1, 2)
            columns = [batch.column(0), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "n", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, s1 long, s2 long, n long, fp long, bands array<long>")


def set_name(hashes: np.ndarray) -> list[int]:
    """128 bits of hash of a shingle set as two signed longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes(), SEED), np.int64).tolist()


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(s1, s2, hashes, bits)`` of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                hashes = shingle_set(text.as_py(), shingle)
                (s1, s2), columns = set_name(hashes), [[h.view(np.int64)] for h in (hashes, bitmap(hashes))]
                yield pa.RecordBatch.from_arrays([pa.array([s1]), pa.array([s2]), *[pa.array(c, pa.list_(pa.int64())) for c in columns]], ["s1", "s2", "hashes", "bits"])

    return docs.select("text").mapInArrow(run, "s1 long, s2 long, hashes array<long>, bits array<long>")


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of at least that exact similarity, as ``(src, dst)``."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}_hashes"))
    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    near = both / (F.size("a_hashes") + F.size("b_hashes") - both) >= similarity
    return cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(node, fp)``: equal fingerprints, and a forest of those within ``DISTANCE`` bits."""
    reps = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.join(reps, "fp").filter("node != rep").select("node", F.col("rep").alias("other"))
    near = near_links(reps, DISTANCE).select(F.col("src").alias("node"), F.col("dst").alias("other"))
    return cut_lineage(same.unionByName(near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())


def forest_of(sets: list[np.ndarray], groups: list[int], similarity: float) -> list[tuple[int, int]]:
    """Positions of links that join what has that similarity and is not yet in one group; no pair is passed over."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    group = np.unique(np.array(groups), return_inverse=True)[1]
    mark, left, found = np.zeros(codes.max() + 1, bool), np.ones(len(sets), bool), []
    while True:
        counts = np.bincount(group[left])
        largest = counts.argmax()
        if counts[largest] == counts.sum():
            return found  # whatever has not been held against all is in one group
        i = int(np.flatnonzero(left & (group != largest))[0])
        left[i] = False
        mine = codes[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[mine] = False
        near = both / (sizes + sizes[i] - both) >= similarity
        met = np.unique(group[near & (group != group[i])], return_index=False)
        for other in met.tolist():
            found.append((i, int(np.flatnonzero(near & (group == other))[0])))
        group[np.isin(group, met)] = group[i]


def _bucket_links(nodes: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links ``(src, dst)`` that join nodes of a common bucket beyond ``found(node, component)``."""
    dealt = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    placed = dealt.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"m{seed}") for seed in (1, 2)]
    kinds = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("component").alias("low"), F.max("component").alias("high"), *same)
    mixed = kinds.filter("low != high").groupBy("m1", "m2", "size").agg(F.min("bucket").alias("bucket"), F.first("weight").alias("weight"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_HASHES)).cast("int")
    mixed = cut_lineage(mixed.select("bucket", "size", parts.alias("parts")))
    hot = F.col("size") * HOT_SHARE >= (mixed.agg(F.sum("size")).first()[0] or 1)
    marked = placed.join(F.broadcast(mixed.filter(hot).select("bucket", F.col("parts").alias("hot_parts"))), "bucket", "left")
    rest = marked.filter("hot_parts is null").join(mixed.filter(~hot).select("bucket", "parts"), "bucket").select("bucket", "parts", "node", "component")
    every = marked.filter("hot_parts is not null").select("bucket", F.col("hot_parts").alias("parts"), "node", "component").unionByName(rest)
    part = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")))
    met = every.withColumn("part", part).select("bucket", "node", "component", "part", F.explode(others).alias("other"))
    met = met.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "component")
    where = ["bucket", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])

        def done():
            ids, groups, hashes = held
            links = forest_of(hashes, groups, similarity) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in links], pa.int64()) for k in (0, 1)], ["src", "dst"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            ids, groups = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for at, here in enumerate(keys):
                if here != key:
                    if key is not None:
                        yield done()
                    key, held = here, ([], [], [])
                for column, value in zip(held, (ids[at], groups[at], batch.column(5)[at].values.to_numpy())):
                    column.append(value)
        if key is not None:
            yield done()

    whole = met.join(sets.select("node", "hashes"), "node").select(*where, "node", "component", "hashes")
    return cut_lineage(whole.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "src long, dst long"))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, group_id)`` for every row with an id: the smallest id reachable over links.

    A link is an exact Jaccard similarity of the shingle sets of at least ``similarity``.
    Texts without words are copies of each other and of nothing else. Rows that repeat an id
    with other texts belong to the group of their own text each.
    """
    texts = _rows(docs, id_col, text_col).filter("doc_id is not null")
    rows = cut_lineage(_described(texts, shingle))
    name = ["s1", "s2"]
    distinct = rows.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.min_by("bands", "doc_id").alias("bands"))
    # numbered by place, so that no two sets share a number however many there are
    nodes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    several = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    close = _simhash_pairs(nodes.select("node", "fp"))
    shared = dealt.join(several.select("bucket"), "bucket", "left_semi")
    met = shared.select("node").unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node"))).distinct()
    wanted = cut_lineage(nodes.join(met, "node", "left_semi").select("node", *name, F.col("rep").alias("doc_id")))
    ids = wanted.select("doc_id").distinct()
    few = F.broadcast(ids) if wanted.count() <= SMALL_IDS else ids
    sets = _sets(texts.join(few, "doc_id", "left_semi"), shingle).dropDuplicates(name)
    sets = cut_lineage(sets.join(wanted.select("node", *name), name).select("node", "hashes", "bits"))
    links = _links(_bounded(close, sets, similarity), sets, similarity)
    found = connected_components(links.unionByName(_bucket_links(nodes, sets, connected_components(links), similarity)))
    named = nodes.join(found, "node", "left").select(*name, "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("group_id"))
    return rows.join(named.join(least, "component").select(*name, "group_id"), name).select("doc_id", "group_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of near copies.

    All columns stay. Of repeated rows with one id each stays; rows with a null id stay.
    """
    groups = near_groups(docs, shingle, similarity, id_col, text_col)
    return without(docs, groups.filter("doc_id != group_id").select(F.col("doc_id").alias("__id")), id_col)
