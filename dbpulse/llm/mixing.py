"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of about ``block_chars`` characters. Block j
(from 1) of a source with weight w has release time floor((j - 1) / w) and deadline
ceil(j / w); in each slot the released block with the earliest deadline goes next, so
after any number of slots a source is less than one block from its share.

Weights are whole numbers with sum A, so the schedule repeats every A slots. It is worked
out once for A slots (``pattern``); block j of a source then has its slot by arithmetic,
without looking at other blocks, and the blocks of any amount of data are placed in
parallel. Where a source has run out, its slots stay empty and the others keep their order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside_names, cut_lineage, set_aside, shuffle_partitions

OTHER = "(other)"
RANGE_ROWS = 20_000
BROADCAST_ROWS = 100_000
ADDED = ("mix_source", "block", "slot", "mix_rank", "__chars", "__order", "__range", "__part", "__tie", "__run", "__rank", "__c", "__n", "__nth", "__cycle", "__slot")


def pattern(weights: dict[str, int]) -> list[str]:
    """Which source takes each of the ``sum(weights)`` slots of a period: earliest deadline first."""
    period = sum(weights.values())
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    due = lambda s, j: (-(-j * period // weights[s]), s)  # noqa: E731  ceil(j / w), ties by name
    waiting = [((j - 1) * period // weights[s], *due(s, j), j) for s in weights for j in [1]]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, deadline, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, source, j))
        deadline, source, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block has missed its deadline")
        out.append(source)
        heapq.heappush(waiting, (j * period // weights[source], *due(source, j + 1), j + 1))
    return out


def _own(source: Column, weights: dict[str, int]) -> Column:
    return F.when(source.isin([s for s in weights if s != OTHER]), source).otherwise(F.lit(OTHER))


def schedule(docs: DataFrame, weights: dict[str, int], other_weight: int = 1, block_chars: int = 20_000, hot_rows: int = 4 * RANGE_ROWS) -> DataFrame:
    """Every row of ``docs``, all columns, with its place in the mixture.

    Added: ``mix_source`` (the row's source, or "(other)" for null and unlisted ones, which
    share ``other_weight``), ``block`` (from 0, in its source), ``slot`` (of the block, over
    all sources; the mixture is the rows by slot, then ``mix_rank``) and ``mix_rank`` (order
    in the source). Inside a source, documents are ordered by the MD5 of their id. A block
    takes the documents that begin inside it, so a long document may leave the next blocks
    of its source empty. Null texts have no characters; repeated rows each take a place; an
    empty table gives an empty table.

    Running totals are taken in ranges of each source and then over the ranges' totals, so
    a source of any size is spread over tasks: ranges are the first hex digits of the MD5,
    as many digits as bring a range of the whole table to ``RANGE_ROWS`` rows. A range of
    more than ``hot_rows`` rows holds an id that repeats, or null ids; such ranges are written
    once and cut further, by length and then by row, so that equal rows are no single task
    either. A column named like an added one is called ``<name>_given`` in the result.
    """
    columns = [aside_names(docs.columns, ADDED)[c] for c in docs.columns]
    docs = set_aside(docs, *ADDED)
    digits = 2
    rows = docs.count()
    while rows > RANGE_ROWS * 16**digits:
        digits += 1
    weights = {**weights, OTHER: other_weight}
    names = pattern(weights)
    steps = [(s, i, k) for s in weights for i, k in enumerate(k for k, n in enumerate(names) if n == s)]
    chars = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = docs.withColumn("mix_source", _own(F.col("source"), weights)).withColumn("__chars", chars).withColumn("__order", order)
    placed = placed.withColumn("__range", F.conv(F.substring("__order", 1, digits), 16, 10).cast("long"))
    cell = ["mix_source", "__range"]
    sums = [F.sum("__chars").alias("c"), F.count("*").alias("n")]
    totals = cut_lineage(placed.groupBy(*cell).agg(*sums))
    hot = totals.filter(F.col("n") > hot_rows).select(*cell)
    n_hot = hot.count()
    placed, totals = placed.withColumn("__part", F.lit(0)).withColumn("__tie", F.lit(0).cast("long")), totals.withColumn("__part", F.lit(0))
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        # written before rows are numbered, so that a lost task numbers them alike
        again = cut_lineage(placed.join(few, cell, "left_semi")).withColumn("__tie", F.monotonically_increasing_id())
        again = cut_lineage(again.repartitionByRange(shuffle_partitions(docs.sparkSession), *cell, "__order", "doc_id", "__chars", "__tie").withColumn("__part", F.spark_partition_id()))
        placed = placed.join(few, cell, "left_anti").unionByName(again)
        totals = totals.join(few, cell, "left_anti").unionByName(again.groupBy(*cell, "__part").agg(*sums).select(*totals.columns))
    before = Window.partitionBy("mix_source").orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*cell, "__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"))
    inner = Window.partitionBy(*cell, "__part").orderBy("__order", "doc_id", "__chars", "__tie")
    ranked = (
        placed.withColumn("__run", F.sum("__chars").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__chars"))
        .withColumn("__rank", F.row_number().over(inner))
        # a row for each weight given and range at most; else both sides are partitioned alike already
        .join(F.broadcast(starts) if not n_hot and len(weights) * 16**digits <= BROADCAST_ROWS else starts, [*cell, "__part"])
        .withColumn("mix_rank", (F.col("__n") + F.col("__rank")).cast("long"))
        .withColumn("block", F.floor((F.col("__c") + F.col("__run")) / block_chars))
    )
    share = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, w)])
    table = docs.sparkSession.createDataFrame(steps, "mix_source string, __nth long, __slot long")
    nth = F.col("block") % share[F.col("mix_source")]
    cycle = F.floor(F.col("block") / share[F.col("mix_source")])
    joined = ranked.withColumn("__nth", nth.cast("long")).withColumn("__cycle", cycle).join(F.broadcast(table), ["mix_source", "__nth"])
    slot = (F.col("__cycle") * len(names) + F.col("__slot")).alias("slot")
    return joined.select(*[F.col(f"`{c}`") for c in columns], "mix_source", "block", slot, "mix_rank")
