"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are dealt to buckets by every choice of ``shared`` out of
``blocks`` bit blocks: two fingerprints that differ in at most ``blocks - shared`` bits
agree on at least one choice, so no link is lost. Inside a bucket the fingerprints are
sorted by Gray rank, neighbours are packed into nodes that keep the bits all their members
share (a mask and a pattern), and pairs of nodes are walked from the top down: bits on
which both nodes are settled and differ add up to a lower bound, and a pair above the
limit is dropped with all its members. Each bucket emits a spanning forest of its links,
never all pairs, and the forests are merged by ``connected_components``. A bucket of more
than ``BUCKET_ROWS`` fingerprints is cut into parts, and every two parts meet in a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import connected_components

SEED = 42
FAN_OUT = 8
PAIRS_AT_ONCE = 400_000
BUCKET_ROWS = 200_000
BROADCAST_ROWS = 500_000
SHINGLES_AT_ONCE = 200_000


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros(64, np.int64)
    for start in range(0, len(bits), 250):  # sums of 250 fit a byte, which adds fastest
        total += np.add.reduce(bits[start : start + 250], axis=0, dtype=np.uint8)
    return total


def majority(hashes: np.ndarray) -> int:
    """The signed fingerprint of some hashes: a bit is 1 if set in over half of them."""
    return int(np.packbits(_ones(hashes) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text; zero if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        spans = zip(first[at : at + SHINGLES_AT_ONCE], last[at : at + SHINGLES_AT_ONCE])
        total += _ones(np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64))
    bits = total * 2 > len(first)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the SimHash of every whole text as a signed long.

    Letters A-Z are lowered, words are runs without ASCII white space, a shingle is
    ``shingle`` words joined by single spaces (all words, if there are fewer), repeats
    count, and its hash is XXH64 with seed 42. A null or wordless text has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ---- the index of one partition ---------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence (prefix XOR from the top)."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def _pair_up(a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of ``a`` with a child of ``b``, each unordered pair once."""
    n, m = count[a], count[b]
    each = n * m
    of = np.repeat(np.arange(len(a)), each)
    k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    left, right = first[a][of] + k // m[of], first[b][of] + k % m[of]
    keep = left <= right
    return left[keep], right[keep]


class _Forest:
    """Union-find over array positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self._root(i), self._root(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(self.up, np.maximum(i, j), np.minimum(i, j))

    def _root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[i]
            if np.array_equal(up, i):
                return i
            i = up

    def roots(self) -> np.ndarray:
        return self._root(np.arange(len(self.up)))


def link_forest(keys: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the links inside each group of equal keys."""
    order = np.lexsort((gray_rank(codes), keys))
    keys, codes = keys[order], codes[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((edge, [len(keys)])))
    # levels[0] is the fingerprints; each further level packs FAN_OUT neighbours of a group
    levels = [(codes, np.full(len(codes), ~np.uint64(0)), None, None)]
    group_start, group_size = edge, sizes
    while len(group_size) and group_size.max() > 1:
        packed = -(-group_size // FAN_OUT)
        owner = np.repeat(np.arange(len(packed)), packed)
        nth = np.arange(int(packed.sum())) - np.repeat(np.cumsum(packed) - packed, packed)
        first = group_start[owner] + nth * FAN_OUT
        count = np.minimum(FAN_OUT, group_size[owner] - nth * FAN_OUT)
        pattern, mask = levels[-1][0], levels[-1][1]
        both = np.bitwise_and.reduceat(pattern, first)
        shared = np.bitwise_and.reduceat(mask, first) & ~(both ^ np.bitwise_or.reduceat(pattern, first))
        levels.append((both & shared, shared, first, count))
        group_start, group_size = np.cumsum(packed) - packed, packed
    forest = _Forest(len(codes))
    top = np.arange(len(levels[-1][0]))
    pending = [(len(levels) - 1, top, top)]
    while pending:
        level, a, b = pending.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            pending += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        if level == 0:
            apart = a != b
            a, b = a[apart], b[apart]
            near = np.bitwise_count(codes[a] ^ codes[b]) <= distance
            forest.join(a[near], b[near])
            continue
        pattern, mask, first, count = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
        a, b = a[near], b[near]
        step = max(1, PAIRS_AT_ONCE // (FAN_OUT * FAN_OUT))
        for at in range(0, len(a), step):
            left, right = _pair_up(a[at : at + step], b[at : at + step], first, count)
            if len(left):
                pending.append((level - 1, left, right))
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return order[moved], order[roots[moved]]


def blocks_for(nodes: int, distance: int) -> int:
    """The fewest bit blocks with which a bucket of evenly spread fingerprints holds a thousand or fewer."""
    blocks = distance + 2
    while nodes / 2 ** (64 * (blocks - distance) / blocks) > 1_000:
        blocks += 1
    return blocks


def _split_large(dealt: DataFrame) -> DataFrame:
    """``dealt(bucket, fp, rep)`` with large buckets cut into parts and a bucket for every two of them."""
    large = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
    large = cut_lineage(large.select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts")))
    n = large.count()
    if not n:
        return dealt
    marked = dealt.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "bucket", "left")
    part = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("parts")).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")))
    each = marked.withColumn("part", part).select("bucket", "fp", "rep", "part", F.explode(others).alias("other"))
    two = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    return each.select(F.when(F.col("other") < 0, F.col("bucket")).otherwise(two).alias("bucket"), "fp", "rep")


def near_links(nodes: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """``nodes(fp, rep)`` with distinct fingerprints -> links ``(src, dst)`` between reps.

    The links of each bucket are a spanning forest of all its pairs at ``distance`` or less.
    ``blocks`` is by default what the number of nodes asks for.
    """
    blocks = blocks or blocks_for(nodes.count(), distance)
    shared = blocks - distance
    if shared < 1:
        raise ValueError("blocks must exceed distance, or links would be lost")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in itertools.combinations(range(blocks), shared):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    bucket = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits")
    dealt = nodes.select("fp", "rep", bucket).select(F.xxhash64("choice", "bits").alias("bucket"), "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts):
            keys, codes, reps = (np.concatenate([p[i] for p in parts]) for i in range(3))
            i, j = link_forest(keys, codes.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(reps[i]), pa.array(reps[j])], ["src", "dst"])

        kept: list[tuple] = []
        for batch in batches:
            keys, codes, reps = (c.to_numpy() for c in batch.columns)
            if not len(keys):
                continue
            # rows come sorted by bucket; the last bucket may go on in the next batch
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (kept and kept[-1][0][-1] != keys[0]):
                kept.append((keys[:last], codes[:last], reps[:last]))
                yield links(kept)
                kept = []
            kept.append((keys[last:], codes[last:], reps[last:]))
        if kept:
            yield links(kept)

    return _split_large(dealt).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "src long, dst long")


def simhash_groups(
    docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id reachable
    over links of ``distance`` bits or fewer. Texts that are null, empty or without words
    have fingerprint zero and link like any other. Rows with a null id get a fingerprint,
    take part in no link and have a null component. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty table.
    """
    fps = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    nodes = cut_lineage(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(near_links(nodes, distance, blocks))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate group.

    All columns stay. Of repeated rows with one id each stays; rows with a null id stay.
    """
    groups = simhash_groups(docs, **options).select(F.col("doc_id").alias("__id"), "component_id")
    return without(docs, groups.filter("__id != component_id").select("__id"), options.get("id_col", "doc_id"))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids(__id)``; these are broadcast only if at most ``BROADCAST_ROWS``."""
    gone = cut_lineage(ids.distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, docs[id_col] == gone["__id"], "left_anti")
