"""Health of the collection itself: run status, issues with their lifetimes, missed deadlocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried

RANK = {"error": 2, "warning": 1, "info": 0}


def _rank(column="severity"):
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def run_status(issues: DataFrame) -> DataFrame:
    """Worst severity of a run: failed, degraded or ok."""
    worst = F.max(_rank())
    return issues.groupBy("db_id", "run_no").agg(F.when(worst == 2, "failed").when(worst == 1, "degraded").otherwise("ok").alias("status"))


def fold_issues(issues: DataFrame) -> DataFrame:
    """One row per run, code and section: how often, and the last parameters."""
    return issues.groupBy("db_id", "run_no", "code", "section").agg(F.count("*").alias("n"), F.max_by("severity", F.struct("s", "event_id")).alias("severity"), F.max("s").alias("last_s"))


def issue_intervals(issues: DataFrame, runs: DataFrame) -> DataFrame:
    """Lifetimes of issues: open until a run that checked the section no longer sees it; seeing it again opens a new one.

    ``issues(db_id, run_no, code, section, severity, s)``, ``runs(db_id, run_no, section, at_s)``
    are the runs that checked a section. Gaps and islands over the section's run sequence.
    """
    order = Window.partitionBy("db_id", "section").orderBy("run_no")
    numbered = runs.select("db_id", "section", "run_no", "at_s").withColumn("nth", F.row_number().over(order)).withColumn("next_at", F.lead("at_s").over(order))
    seen = issues.groupBy("db_id", "section", "code", "run_no").agg(F.count("*").alias("n"), F.max_by("severity", "s").alias("severity"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    placed = seen.join(numbered, ["db_id", "section", "run_no"])
    mine = Window.partitionBy("db_id", "section", "code").orderBy("nth")
    island = placed.withColumn("island", F.col("nth") - F.row_number().over(mine))
    return island.groupBy("db_id", "section", "code", "island").agg(
        F.min("s0").alias("opened_s"), F.max("s1").alias("last_s"), F.sum("n").alias("occurrences"), F.max_by("severity", "nth").alias("severity"), F.max_by("next_at", "nth").alias("closed_s")
    ).drop("island")


def symptoms(statements: DataFrame, limit: int, marker: str = "<insufficient privilege>") -> DataFrame:
    """Per database: hidden texts, and texts cut at the engine's byte limit."""
    return statements.groupBy("db_id").agg(F.count_if(F.col("text").contains(marker)).alias("hidden"), F.count_if(F.octet_length("text") >= limit - 3).alias("truncated"))


def lost_stats(tables: DataFrame, examples: int = 3) -> DataFrame:
    """Tables with no live rows in the statistics though the catalog has some and they were never analysed."""
    lost = tables.filter("live_rows = 0 and catalog_rows > 0 and last_analyzed is null")
    return lost.groupBy("db_id").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("table_name")), 1, examples), ",").alias("examples"))


def config_issues(settings: DataFrame, required: dict[str, str]) -> DataFrame:
    """Settings that are off or missing what a rule needs: one list per database."""
    need = F.create_map(*[F.lit(x) for kv in required.items() for x in kv])
    wrong = settings.filter(F.col("name").isin(*required) & (F.col("value") != need[F.col("name")]))
    return wrong.groupBy("db_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("wrong"), F.countDistinct("name").alias("n"))


# The oldest version that is read at all, and what a version has from which number on.
OLDEST = {"postgres": ("PG", 150_000)}
FEATURES = [("postgres", "pg_stat_statements.stats_since", 170_000, None), ("postgres", "EXPLAIN (GENERIC_PLAN)", 160_000, None), ("postgres", "pg_stat_user_indexes.last_idx_scan", 160_000, None)]


def version_issues(servers: DataFrame, features: list[tuple] = FEATURES, oldest: dict[str, tuple] = OLDEST) -> DataFrame:
    """``(db_id, version_num, code, missing)``: servers too old to be read, and those that lack features, with their list.

    ``servers(db_id, engine, version_num)``; a feature holds in versions from its number up to
    (without) its end, if it has one. Servers of unknown version or engine have no row.
    """
    spark = servers.sparkSession
    limits = spark.createDataFrame([(e, p, n) for e, (p, n) in oldest.items()], "engine string, prefix string, oldest long")
    known = spark.createDataFrame(features, "engine string, feature string, since long, until long")
    named = servers.filter("version_num is not null").join(F.broadcast(limits), "engine")  # both are short fixed lists
    lacks = (F.col("version_num") < F.col("since")) | (F.col("version_num") >= F.col("until"))
    each = named.join(F.broadcast(known), "engine", "left").groupBy("db_id", "version_num", "prefix", "oldest").agg(F.array_sort(F.collect_set(F.when(F.coalesce(lacks, F.lit(False)), F.col("feature")))).alias("lack"))
    old = F.col("version_num") < F.col("oldest")
    code = F.concat("prefix", F.when(old, "_VERSION_UNSUPPORTED").otherwise("_VERSION_LIMITED"))
    return each.filter(old | (F.size("lack") > 0)).select("db_id", "version_num", code.alias("code"), F.when(old, "").otherwise(F.array_join("lack", ", ")).alias("missing"))


def payload_flag(samples: DataFrame, high: float, low: float) -> DataFrame:
    """A flag that rises above ``high`` and falls only below ``low``."""
    crossing = F.when(F.col("bytes") > high, True).when(F.col("bytes") < low, False)
    return carried(samples, ["db_id"], ["at_s"], {"flag": ("last", crossing)}).withColumn("flag", F.coalesce("flag", F.lit(False)))


def missed_deadlocks(samples: DataFrame, events: DataFrame, back: int = 3600, lag: int = 120, slot: int = 3600) -> DataFrame:
    """Deadlocks counted and captured in the ``back`` seconds ending ``lag`` before each sample.

    Events are put into time slots, so the interval join is an equality join on a few slots.
    """
    asked = samples.select("db_id", "at_s", "delta", (F.col("at_s") - lag - back).alias("lo"), (F.col("at_s") - lag).alias("hi"))
    slots = asked.withColumn("slot", F.explode(F.expr(f"sequence(cast(floor(lo / {slot}) as bigint), cast(floor(hi / {slot}) as bigint))")))
    placed = events.select("db_id", F.col("s").alias("es"), F.floor(F.col("s") / slot).cast("long").alias("slot"))
    hits = slots.join(placed, ["db_id", "slot"]).filter("es > lo and es <= hi").groupBy("db_id", "at_s").agg(F.count("*").alias("captured"))
    joined = asked.join(hits, ["db_id", "at_s"], "left").withColumn("captured", F.coalesce("captured", F.lit(0)))
    return joined.select("db_id", "at_s", F.col("delta").alias("counted"), "captured", F.greatest(F.col("delta") - F.col("captured"), F.lit(0)).alias("missed"))


def last_runs(runs: DataFrame) -> DataFrame:
    """The latest run per database; its version is the last that was known."""
    return runs.groupBy("db_id").agg(F.max("at_s").alias("last_s"), F.max_by("status", "at_s").alias("status"), F.max_by("version", F.when(F.col("version").isNotNull(), F.col("at_s"))).alias("version"))
