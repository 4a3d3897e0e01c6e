"""Cost of observation: latency samples in treated and untreated blocks, compared pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried


def percentile(column: str, p: float) -> Column:
    """Linear interpolation between neighbours at (n - 1) p."""
    return F.expr(f"percentile({column}, {p})")


def latency_stats(samples: DataFrame, by: list[str], span_seconds: float) -> DataFrame:
    """Count, failures, median, p95, mean and rate of successful samples."""
    good = F.when(F.col("ok"), F.col("latency"))
    return samples.withColumn("__l", good).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures"), percentile("__l", 0.5).alias("p50"), percentile("__l", 0.95).alias("p95"),
        F.avg("__l").alias("mean"), (F.count("__l") / F.lit(span_seconds)).alias("qps"),
    )


def in_block(samples: DataFrame, blocks: DataFrame, settle_us: int = 0, by: list[str] | None = None) -> DataFrame:
    """Samples that begin after a block has settled and end inside it.

    Blocks of one experiment (``by``) follow each other, so a sample's block is the last that
    had settled when it began: both sides in time order, the block carried on. Samples do
    not meet blocks by pairs. Blocks that overlap are refused.
    """
    by = by or []
    order = carried(blocks.select(*by, "start_us", "end_us", "day_no"), by, ["start_us", "day_no"], {"until": ("max", F.col("end_us"))}, own=False)
    if order.filter("until > start_us").limit(1).count():
        raise ValueError("blocks of one experiment must not overlap")
    held = [c for c in blocks.columns if c not in by]
    block = F.struct(*[F.col(c).alias({"pair": "block_pair", "side": "block_side"}.get(c, c)) for c in held])
    begins = blocks.select(*by, (F.col("start_us") + settle_us).alias("__at"), F.lit(0).alias("__kind"), block.alias("__block"))
    asks = samples.select(*by, F.col("t0").alias("__at"), F.lit(1).alias("__kind"), F.struct(*samples.columns).alias("__sample"))
    swept = carried(begins.unionByName(asks, allowMissingColumns=True), by, ["__at", "__kind"], {"__b": ("last", F.col("__block"))}).filter("__kind = 1")
    inside = swept.filter("__sample.t1 <= __b.end_us")
    return inside.select("__sample.*", "__b.*")


def overlaps(samples: DataFrame, cycles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``samples`` with whether any cycle ``(c0, c1)`` of the same experiment (``by``) runs during them.

    Of the cycles that begin before a sample ends, the latest end decides: cycles at their
    begin and samples at their end in time order, with the greatest end carried on. Each
    sample and each cycle is one row, however many meet.
    """
    by = by or []
    marks = cycles.filter("c0 < c1").select(*by, F.col("c0").alias("__at"), F.lit(1).alias("__kind"), F.col("c1").alias("__c1"))
    asks = samples.select(*by, F.col("t1").alias("__at"), F.lit(0).alias("__kind"), F.struct(*samples.columns).alias("__sample"))
    swept = carried(asks.unionByName(marks, allowMissingColumns=True), by, ["__at", "__kind"], {"__until": ("max", F.col("__c1"))}).filter("__kind = 0")
    return swept.select("__sample.*", F.coalesce(F.col("__until") > F.col("__sample.t0"), F.lit(False)).alias("overlaps"))


def geomean_overhead(samples: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """exp(mean over templates of ln(treated / base)) - 1, of the templates' medians."""
    medians = samples.filter("ok").groupBy(*by, "template_id", "side").agg(percentile("latency", 0.5).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least)
    ratio = medians.groupBy(*by, "template_id").agg(F.max(F.when(F.col("side") == 1, F.col("m"))).alias("treated"), F.max(F.when(F.col("side") == 0, F.col("m"))).alias("base"))
    usable = ratio.filter("treated > 0 and base > 0")
    return usable.groupBy(*by).agg((F.exp(F.avg(F.ln(F.col("treated") / F.col("base")))) - 1).alias("overhead"), F.count("*").alias("templates"))


def throughput_overhead(pairs: DataFrame) -> DataFrame:
    """Percent of throughput lost, over all complete pairs."""
    return pairs.agg((100 * (F.sum("base_n") - F.sum("treated_n")) / F.sum("base_n")).alias("drop_percent"))


def pair_blocks(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per pair, in each experiment of ``by``: successful samples and summed latency of both sides; incomplete pairs go."""
    side = lambda s, v: F.sum(F.when(F.col("side") == s, v))
    sums = samples.filter("ok").groupBy(*(by or []), "pair").agg(
        side(0, F.lit(1)).alias("base_n"), side(1, F.lit(1)).alias("treated_n"), side(0, F.col("latency")).alias("base_t"), side(1, F.col("latency")).alias("treated_t")
    )
    return sums.dropna(subset=["base_n", "treated_n"])


ROUNDS = 2000


def bootstrap_ci(pairs: DataFrame, by: list[str], rounds: int = ROUNDS, low: float = 0.025, high: float = 0.975, least: float = 0.9) -> DataFrame:
    """Interval of each experiment's mean latency ratio over resampled whole pairs.

    Draw d of round r takes pair number md5(r/d) mod n, so the resampling is the same
    everywhere. Experiments (``by``) of fewer than two pairs have no rounds and no row; the
    interval is null if fewer than ``least`` of the rounds give a ratio.
    """
    spark = pairs.sparkSession
    order = Window.partitionBy(*by).orderBy("pair")
    numbered = pairs.select(*by, "base_t", "base_n", "treated_t", "treated_n", (F.row_number().over(order) - 1).alias("i"))
    sizes = pairs.groupBy(*by).agg(F.count("*").alias("n")).filter("n >= 2")
    draws = sizes.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("draw", F.explode(F.expr("sequence(0L, n - 1)")))
    picked = draws.withColumn("i", (F.conv(F.substring(F.md5(F.concat_ws("/", "round", "draw").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")).cast("int"))
    ratio = (F.sum("treated_t") / F.sum("treated_n")) / F.nullif(F.sum("base_t") / F.sum("base_n"), F.lit(0.0)) - 1
    each = picked.join(numbered, [*by, "i"]).groupBy(*by, "round").agg(ratio.cast("double").alias("x"))
    enough = F.count("x") >= least * rounds
    return each.groupBy(*by).agg(F.when(enough, percentile("x", low)).alias("low"), F.when(enough, percentile("x", high)).alias("high"), F.count("x").alias("rounds"))


def arm_points(pairs: DataFrame, by: list[str], least_n: int = 30) -> DataFrame:
    """Each experiment's ratio over all its pairs, and whether every side has ``least_n`` samples."""
    ratio = (F.sum("treated_t") / F.sum("treated_n")) / F.nullif(F.sum("base_t") / F.sum("base_n"), F.lit(0.0)) - 1
    return pairs.groupBy(*by).agg(ratio.cast("double").alias("point"), (F.least(F.min("base_n"), F.min("treated_n")) >= least_n).alias("enough"))


def arm_verdict(arms: DataFrame, limit: float = 0.05) -> DataFrame:
    """pass, fail, inconclusive or no data from an interval and a limit.

    ``noise_ok``: an interval of equal arms lies within the limit on both sides; ``detected``:
    a positive control would have failed. Both are null without an interval.
    """
    unknown = ~F.col("enough") | F.col("point").isNull() | F.col("low").isNull() | F.col("high").isNull()
    verdict = F.when(unknown, "no data").when(F.col("high") < limit, "pass").when(F.col("low") >= limit, "fail").otherwise("inconclusive")
    return arms.withColumn("verdict", verdict).withColumn("noise_ok", (F.col("low") > -limit) & (F.col("high") < limit)).withColumn("detected", F.col("low") >= limit)


def cycle_summary(cycles: DataFrame, by: list[str]) -> DataFrame:
    """Cycles, failures, mean and greatest wall time, duty."""
    wall = F.col("c1") - F.col("c0")
    span = F.max("c1") - F.min("c0")
    return cycles.groupBy(*by).agg(F.count("*").alias("cycles"), F.count_if(~F.col("ok")).alias("failed"), F.avg(wall).alias("mean_wall"), F.max(wall).alias("max_wall"), (F.sum(wall) / span).alias("duty"))


def server_rates(readings: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Growth per second of each counter between the first and last reading of a block."""
    long = readings.unpivot([*by, "at_s"], fields, "field", "value")
    ends = long.groupBy(*by, "field").agg(F.min_by("value", "at_s").alias("a"), F.max_by("value", "at_s").alias("b"), (F.max("at_s") - F.min("at_s")).alias("span"))
    return ends.filter("span > 0").groupBy("field").agg(F.avg((F.col("b") - F.col("a")) / F.col("span")).alias("rate"))


def round_summary(rounds: DataFrame) -> DataFrame:
    """Relative differences over rounds: least, greatest, mean, deviation, and the worst verdict."""
    x = (F.col("treated") - F.col("base")) / F.col("base")
    rank = F.max(F.when(x >= 0.5, 2).when(x >= 0.05, 1).otherwise(0))
    return rounds.filter("base > 0").agg(
        F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.element_at(F.array(F.lit("pass"), F.lit("inconclusive"), F.lit("fail")), rank + 1).alias("worst")
    )


def warnings(arms: DataFrame, least_n: int = 100, most_failures: float = 0.1) -> DataFrame:
    """The conditions an arm violates, as one text."""
    told = F.array(F.when(F.col("n") < least_n, "few samples"), F.when(F.col("failures") > most_failures * F.col("n"), "many failures"), F.when(F.col("p95") > 10 * F.col("p50"), "long tail"))
    return arms.withColumn("warnings", F.array_join(F.filter(told, lambda w: w.isNotNull()), "; "))


def read_samples(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of "t0,t1,template,ok" -> samples; malformed lines are dropped."""
    part = F.split("value", ",")
    t0, t1 = part[0].try_cast("long"), part[1].try_cast("long")
    rows = lines.filter(F.size(part) == 4).select(t0.alias("t0"), t1.alias("t1"), part[2].alias("template_id"), (part[3] == "1").alias("ok"))
    return rows.dropna(subset=["t0", "t1"])
