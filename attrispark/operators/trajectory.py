"""Convergence trajectories: the estimate after every checkpoint, from one pass over the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoints(samples: DataFrame, interval: int) -> DataFrame:
    """samples with ckpt: the checkpoint at whose end a sample k counts."""
    return samples.withColumn("ckpt", F.floor(F.col("k") / interval).cast("int"))


def cumulative(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Partial sums per (keys, ckpt) as running sums over checkpoints."""
    run = Window.partitionBy(*keys).orderBy("ckpt").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select(*keys, "ckpt", *[F.sum(c).over(run).alias(c) for c in sums])


def inclusion_trajectory(evaluated: DataFrame, n: int, interval: int, keys: list[str] = ()) -> DataFrame:
    """(keys, player, ckpt, value): running difference of mean worth with and without each player, of each run that the keys name.

    Partial sums are combined per checkpoint before anything is shuffled.
    """
    spread = checkpoints(evaluated, interval).select(*keys, "ckpt", "u", "mask", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("player"))
    inside = F.expr("getbit(mask, player) = 1")
    parts = spread.groupBy(*keys, "player", "ckpt").agg(*[F.sum(F.when(hit, what).otherwise(0.0)).alias(c) for c, hit, what in (("si", inside, F.col("u")), ("ci", inside, F.lit(1.0)), ("so", ~inside, F.col("u")), ("co", ~inside, F.lit(1.0)))])
    run = cumulative(parts, [*keys, "player"], ["si", "ci", "so", "co"])
    mean = lambda s, c: F.coalesce(F.try_divide(F.col(s), F.col(c)), F.lit(0.0))
    return run.select(*keys, "player", "ckpt", (mean("si", "ci") - mean("so", "co")).alias("value"))


def mean_trajectory(deltas: DataFrame, interval: int, value: Column | str = "delta") -> DataFrame:
    """(player, ckpt, value): running mean of a statistic per player and sample k."""
    column = F.col(value) if isinstance(value, str) else value
    parts = checkpoints(deltas, interval).groupBy("player", "ckpt").agg(F.sum(column).alias("s"), F.count(column).cast("double").alias("c"))
    return cumulative(parts, ["player"], ["s", "c"]).select("player", "ckpt", F.coalesce(F.try_divide("s", "c"), F.lit(0.0)).alias("value"))


def filled(trajectory: DataFrame, keys: list[str], last: int) -> DataFrame:
    """All checkpoints 0..last: one that wasn't reached takes the value before it, or 0."""
    grid = trajectory.select(*keys).distinct().withColumn("ckpt", F.explode(F.sequence(F.lit(0), F.lit(last))))
    run = Window.partitionBy(*keys).orderBy("ckpt").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(trajectory, [*keys, "ckpt"], "left").select(*keys, "ckpt", F.coalesce(F.last("value", ignorenulls=True).over(run), F.lit(0.0)).alias("value"))
