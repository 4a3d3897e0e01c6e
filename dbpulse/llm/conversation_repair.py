"""Conversation structure repair: the cheapest edits, and of those the least audit.

A conversation's role initials must read ``(s?(ua)+)?``. Keeping a row costs 0, giving it
another role 1, deleting it 2, inserting an empty user or assistant row 5, and a truncated row
that stays 5 more; blank rows and repeats must go. The audit is the edits' initials in order
(D, I, K, R); among the cheapest repairs the one of the least audit in ASCII order is taken.

The repair is a path through nodes (rows read, state of the pattern). Two steps find it:

1. cost DP: the least cost from every node to the end, backwards. Arcs that keep to it are
   optimal arcs. A state allows one of user and assistant next, so a node's arcs carry
   different letters, and the audit settles the path.
2. prefix doubling over the optimal arcs: a node's least letter is its rank at length one and
   leads to its successor; the rank at length 2k is that of the pair (rank at length k, rank
   at length k of the node k letters on), and the pointer goes on from there. Once the length
   covers all audits, each node takes the arc whose letter and target rank least, and the
   doubled pointers mark the nodes on the path from a start.

Conversations may have any length. Rows are put in order once by a range shuffle, and cut into
blocks of ``BLOCK`` rows; the steps above work on pieces, a conversation's rows in one block.
A conversation of several pieces is joined by what each piece means as a whole: a matrix of
least costs from state to state (added from the last piece to the first, it gives every piece
the costs after it), then the state in which each start leaves (from the first to the last, it
gives every piece its start). Those two passes hold one piece at a time. So a conversation
that holds a third of all rows is repaired in as many tasks as any other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions

BLOCK = 1_024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: letters by code, in ASCII order; 0 ends an audit
LETTERS = " DIKR"
INITIALS = "?sua"
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
#: states: nothing yet, after s, after u, after a; the state that each initial of INITIALS leads to
STEP = [[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]]
ACCEPTING = (0, 3)
#: the one initial that may be inserted or given in each state
WANTED = [2, 2, 3, 2]
FAR = 1 << 60


def _arc_tables() -> tuple[np.ndarray, np.ndarray]:
    """``cost`` and ``to`` by letter (D, K, R), class of row and state; class = initial + 4 * must go + 8 * truncated."""
    cost, to = np.full((3, 16, 4), FAR, np.int64), np.full((3, 16, 4), -1)
    for kind in range(16):
        initial, gone, extra = kind % 4, kind // 4 % 2, TRUNCATED * (kind // 8)
        for q in range(4):
            cost[0, kind, q], to[0, kind, q] = DELETE, q
            if not gone:
                cost[2, kind, q], to[2, kind, q] = REROLE + extra, STEP[q][WANTED[q]]
                if STEP[q][initial] >= 0:
                    cost[1, kind, q], to[1, kind, q] = KEEP + extra, STEP[q][initial]
    return cost, to


COST, TO = _arc_tables()
ROW_LETTERS = (1, 3, 4)
INSERT_TO = [STEP[q][WANTED[q]] for q in range(4)]
#: the arcs of a row by class and state, as plain pairs of cost and state
ARCS = [[[(int(COST[x, k, q]), int(TO[x, k, q])) for x in range(3) if TO[x, k, q] >= 0] for q in range(4)] for k in range(16)]


def _with_inserts(cost: list[int]) -> list[int]:
    """Least costs of the four states where rows may be inserted first; three in a row reach every state."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[to], FAR) for c, to in zip(cost, INSERT_TO)]
    return cost


END = _with_inserts([0 if q in ACCEPTING else FAR for q in range(4)])


def costs(kinds: list[int], after: list[int]) -> list[list[int]]:
    """Least cost from each node (row, state) to the end, given the costs ``after`` the last row."""
    out = [after]
    for kind in reversed(kinds):
        out.append(_with_inserts([min([c + after[to] for c, to in arcs]) for arcs in ARCS[kind]]))
        after = out[-1]
    return out[::-1]


def piece_matrix(kinds: list[int]) -> list[list[int]]:
    """Least cost to each state after the piece, from each state before it."""
    return [costs(kinds, [0 if q == end else FAR for q in range(4)])[0] for end in range(4)]


def least_paths(kinds: list[int], cost: list[list[int]], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(letter, successor)`` of each node ``4 * row + state``: its arc on the least of the cheapest audits.

    Nodes after the last row end the audit (letter 0, their own successor), unless rows must
    still be inserted at the end of the conversation (``last``).
    """
    m, kinds, cost, insert_to = len(kinds), np.array(kinds, np.int64), np.minimum(np.array(cost, np.int64), FAR), np.array(INSERT_TO)
    nodes = np.arange(4 * (m + 1)).reshape(m + 1, 4)
    fits, target = np.zeros((5, m + 1, 4), bool), np.zeros((5, m + 1, 4), np.int64)
    for letter, code in enumerate(ROW_LETTERS):
        to = TO[letter, kinds]
        target[code, :m] = nodes[1:, :1] + np.maximum(to, 0)
        fits[code, :m] = (to >= 0) & (np.minimum(COST[letter, kinds] + np.take_along_axis(cost[1:], np.maximum(to, 0), 1), FAR) == cost[:m])
    target[2] = nodes[:, :1] + insert_to
    fits[2] = INSERT + cost[:, insert_to] == cost
    target[0, m], fits[0, m] = nodes[m], True
    # past the last row only an insertion that the end asks for goes on
    fits[2, m] &= last
    fits[0, m] &= ~fits[2, m]
    fits &= cost < FAR
    fits, target = fits.reshape(5, -1), target.reshape(5, -1)
    dead = ~fits.any(axis=0)
    fits[0, dead], target[0, dead] = True, np.flatnonzero(dead)

    letter = fits.argmax(axis=0)
    successor = target[letter, np.arange(len(letter))]
    rank, pointer, length = letter.copy(), successor.copy(), 1
    while length < 2 * (m + 1):
        rank = np.unique(rank * (len(rank) + 5) + rank[pointer], return_inverse=True)[1]
        pointer, length = pointer[pointer], 2 * length
    order = np.where(fits, np.arange(5)[:, None] * (len(rank) + 1) + rank[target], np.iinfo(np.int64).max)
    letter = order.argmin(axis=0)
    return letter, target[letter, np.arange(len(letter))]


def path(successor: np.ndarray, start: int) -> np.ndarray:
    """The nodes met from ``start``, ascending by row, by doubling the pointers."""
    met, pointer = np.array([start]), successor
    while True:
        more = np.union1d(met, pointer[met])
        if len(more) == len(met):
            break
        met, pointer = more, pointer[pointer]
    order, at = [start], start
    # within a row insertions come in the order of their pointers
    if len(met) > 1 and (np.diff(met // 4) == 0).any():
        while successor[at] != at:
            at = int(successor[at])
            order.append(at)
        return np.array(order)
    return met


def _by_piece(batches: Iterator[pa.RecordBatch], piece: Callable[[list[dict]], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Call ``piece`` with the rows of each piece (rows of equal ``conv`` and ``block`` in a row) and send what it returns."""
    held: list[dict] = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if held and (row["conv"], row["block"]) != (held[-1]["conv"], held[-1]["block"]):
                out += piece(held)
                held = []
            held.append(row)
        if out:
            yield _sent(out, schema)
    if held:
        yield _sent(piece(held), schema)


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def _kinds(rows: list[dict]) -> list[int]:
    return [r["kind"] for r in rows]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("matrix", pa.list_(pa.int64()))])
    return _by_piece(batches, lambda rows: [(rows[0]["conv"], rows[0]["block"], [c for to in piece_matrix(_kinds(rows)) for c in to])], schema)


def _after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last to the first of each conversation: the costs after each."""
    conv, cost = None, END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = row["conv"] != conv
            conv, cost = row["conv"], END if last else cost
            out.append((conv, row["block"], cost, last))
            cost = _with_inserts([min(row["matrix"][4 * end + q] + cost[end] for end in range(4)) for q in range(4)])
        yield _sent(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each start leaves a piece, and the initial of its last row."""

    def piece(rows: list[dict]) -> list[tuple]:
        kinds = _kinds(rows)
        _, successor = least_paths(kinds, costs(kinds, rows[0]["after"]), False)
        out = np.arange(4)
        pointer, length = successor, 1
        while length < 2 * (len(kinds) + 1):
            pointer, length = pointer[pointer], 2 * length
        return [(rows[0]["conv"], rows[0]["block"], (pointer[out] % 4).tolist(), rows[-1]["kind"] % 4)]

    return _by_piece(batches, piece, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("exits", pa.list_(pa.int64())), ("initial", pa.int64())]))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the first to the last of each conversation: the state each starts in, and the initial before it."""
    conv, state, before = None, 0, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv"] != conv:
                conv, state, before = row["conv"], 0, None
            out.append((conv, row["block"], state, before))
            state, before = row["exits"][state], row["initial"]
        yield _sent(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("before", pa.int64())]))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(at, audit, roles, kept, cost, illegal)`` of each row: its letters, the roles inserted before it and, at the end, behind it."""

    def piece(rows: list[dict]) -> list[tuple]:
        kinds, last = _kinds(rows), rows[0]["last"]
        letter, successor = least_paths(kinds, costs(kinds, rows[0]["after"]), last)
        out = [[r["at"], "", [], None, [], 0, 0] for r in rows]
        for node in path(successor, rows[0]["start"]).tolist():
            code, i, q = int(letter[node]), node // 4, node % 4
            given = {2: "user", 3: "assistant"}[WANTED[q]]
            row = out[min(i, len(rows) - 1)]
            if code:
                row[1] += LETTERS[code]
            if code == 2:
                row[2 if i < len(rows) else 4].append(given)
                row[5] += INSERT
            elif code:
                row[3] = rows[i]["role"] if code == 3 else given if code == 4 else None
                row[5] += int(COST[ROW_LETTERS.index(code), kinds[i], q])
        before = rows[0]["before"]
        for r, row in zip(rows, out):
            extra, initial = r["copies"] - 1, r["kind"] % 4
            # letters of copies stand behind the row's own, before what the end adds
            own = len(row[1]) - len(row[4])
            row[1] = row[1][:own] + "D" * extra + row[1][own:]
            row[5] += DELETE * extra
            row[6] = extra * (INITIALS[initial] * 2 not in LEGAL) + (before is not None and INITIALS[before] + INITIALS[initial] not in LEGAL)
            before = initial
        return [tuple(row) for row in out]

    return _by_piece(batches, piece, pa.schema([("at", pa.int64()), ("audit", pa.string()), ("inserted", pa.list_(pa.string())), ("kept", pa.string()), ("appended", pa.list_(pa.string())), ("cost", pa.int64()), ("illegal", pa.int64())]))


LEGAL = ("su", "ua", "au")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``conversations(conv_id, turn, role, text)`` in order, each with its fault and its edits.

    ``(conv, turn, role, text, copies, at, fault, audit, inserted, kept, appended, cost, illegal)``:
    ``conv`` is the id as text (one space for null), ``at`` ascends in the order of each
    conversation's turns. Rows are ordered by turn, nulls first, then role and text; equal rows
    are one row with ``copies``, of which all but the first are duplicates that must go, as
    all are where the role and text came before. ``fault`` is the first fault of the first copy
    (blank, duplicate, truncated) or null. ``audit`` holds the letters of what is inserted
    before the row, of the row and its copies, and of what is appended behind it at the
    conversation's end; ``kept`` is the role it stays with, null if it goes. ``illegal`` counts
    neighbours before the repair whose initials are not ``su``, ``ua`` or ``au``, the row and
    the one before it and the copies among themselves.

    Null roles and texts count as one space. A role's initial is its first character, so any
    role that begins with s, u or a fits there; others (an empty one too) must be given
    another. Further columns are ignored; an empty table gives an empty table.
    """
    spark = conversations.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = (
        conversations.select(space("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
        .groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    )
    # the range key is a prefix of the order, so that equal ones meet and no long text is sampled
    near = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32)]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *near).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    stamped = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()))
    bare = F.rtrim("text", F.lit(BLANKS))
    slim = stamped.select(
        "at", F.floor(F.col("at") / block).alias("block"), "conv", "turn", "role", "copies",
        *[F.xxhash64(F.lit(seed), "role", "text").alias(f"h{seed}") for seed in (1, 2)],
        (F.instr(F.lit(INITIALS[1:]), F.when(F.col("role") != "", F.substring("role", 1, 1)).otherwise(" "))).alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    first = slim.groupBy("conv", "h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    flagged = (
        slim.join(first, "at", "left").withColumn("fault", fault)
        .withColumn("kind", F.col("initial") + F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).cast("int") * 4 + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int") * 8)
        .select("conv", "block", "at", "turn", "role", "copies", "fault", F.col("kind").cast("int").alias("kind"))
    )
    flagged = cut_lineage(flagged)
    pieces = ["conv", "block"]
    spans = flagged.groupBy("conv").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("conv")
    # a conversation of several blocks is all of a block but for two ends, so joining by conversation and block is even
    several = flagged.select(*pieces).distinct().join(spans, "conv", "left_semi")
    split = flagged.join(several, pieces, "left_semi")

    def in_blocks(df: DataFrame) -> DataFrame:
        return df.repartition("block").sortWithinPartitions("block", "at")

    matrices = in_blocks(split.select(*pieces, "at", "kind")).mapInArrow(_matrices, "conv string, block long, matrix array<long>")
    after = cut_lineage(matrices.repartition("conv").sortWithinPartitions("conv", F.col("block").desc()).mapInArrow(_after, "conv string, block long, after array<long>, last boolean"))
    exits = in_blocks(split.select(*pieces, "at", "kind").join(after, pieces)).mapInArrow(_exits, "conv string, block long, exits array<long>, initial long")
    starts = exits.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_starts, "conv string, block long, start long, before long")
    end = F.array(*[F.lit(c).cast("long") for c in END])
    placed = (
        flagged.join(after.join(starts, pieces), pieces, "left")
        .select(*pieces, "at", "role", "copies", "kind", F.coalesce("after", end).alias("after"), F.coalesce("last", F.lit(True)).alias("last"), F.coalesce("start", F.lit(0)).cast("long").alias("start"), "before")
    )
    edits = in_blocks(placed).mapInArrow(_edits, "at long, audit string, inserted array<string>, kept string, appended array<string>, cost long, illegal long")
    return stamped.join(flagged.select("at", "fault"), "at").join(edits, "at")


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result: counts, cost, audit and SHA-256 of what is left.

    Sums are grouped as usual. An audit and a digest of a whole text have no partial form: a
    conversation's rows pass in order through one task, which holds the digest and the letters.
    """
    extra = F.col("copies") - 1
    is_fault = lambda f: F.coalesce(F.col("fault") == f, F.lit(False))
    # copies of a blank row are blank first, all others repeat the first
    blank = F.when(is_fault("blank"), F.col("copies")).otherwise(0)
    duplicate = F.when(is_fault("duplicate"), F.col("copies")).when(is_fault("blank"), 0).otherwise(extra)
    counts = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(blank).cast("long").alias("blank"), F.sum(duplicate).cast("long").alias("duplicate"), F.sum(is_fault("truncated").cast("long")).alias("truncated"),
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv, audit, digest, lines = None, [], hashlib.sha256(), 0

        def done() -> tuple:
            return conv, "".join(audit), digest.hexdigest()

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv"] != conv:
                    if conv is not None:
                        out.append(done())
                    conv, audit, digest, lines = row["conv"], [], hashlib.sha256(), 0
                audit.append(row["audit"])
                kept = [f"{row['kept']}:{row['text']}"] if row["kept"] is not None else []
                for line in [*[f"{r}:" for r in row["inserted"]], *kept, *[f"{r}:" for r in row["appended"]]]:
                    digest.update((("\n" if lines else "") + line).encode("utf-8", "surrogatepass"))
                    lines += 1
            yield _sent(out, schema)
        if conv is not None:
            yield _sent([done()], schema)

    schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    text = F.when(F.col("kept").isNotNull(), F.col("text"))
    whole = rows.select("conv", "at", "audit", "inserted", "kept", "appended", text.alias("text")).repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(run, "conv string, audit string, repaired_sha256 string")
    return counts.join(whole, "conv")
