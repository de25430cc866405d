"""Sums of values over a group of players."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrispark.functions import draws
from attrispark.functions.spec import Semivalue, by_size, number
from attrispark.operators.estimators import Unsupported, worth
from attrispark.operators.exact import group_mask


def summed(values: DataFrame, group: list[int]) -> DataFrame:
    """(value[, other keys]): individual values (player, value) summed over the group."""
    keys = [c for c in values.columns if c not in ("player", "value")]
    return values.where(F.col("player").isin(group)).groupBy(*keys).agg(F.sum("value").alias("value"))


def _hypergeometric(n: int, g: int, s: int) -> dict[int, float]:
    return {r: comb(g, r) * comb(n - g, s - r) / comb(n, s) for r in range(max(0, s - n + g), min(g, s) + 1)}


def _strata(n: int, g: int, threshold: int) -> dict[tuple[int, int], float]:
    """Weight of the mean worth of each stratum (size, overlap) in the group's Shapley value less its share of both ends.

    Below the threshold a size's whole spread of overlaps is used (exact);
    from there on, a difference quotient around the expected overlap.
    """
    weights: dict[tuple[int, int], float] = {}
    for s in range(1, n):
        law = _hypergeometric(n, g, s)
        if s < threshold:
            for r, p in law.items():  # n / (s (n - s)) * cov(overlap, worth)
                weights[s, r] = weights.get((s, r), 0.0) + p * (r - g * s / n) * n / (s * (n - s))
            continue
        r = min(max(round(g * s / n), min(law)), max(law))
        spread = g / n * (1 - g / n)  # of a member drawn with replacement; the exact spread is n / (n - 1) times that
        hi, lo = (r + 1 if r + 1 in law else r), (r - 1 if r - 1 in law else r)
        if hi == lo:
            continue  # a single overlap is possible: the size says nothing about the group
        for x, sign in ((hi, 1.0), (lo, -1.0)):
            weights[s, x] = weights.get((s, x), 0.0) + sign * spread / (hi - lo)
    return {k: v for k, v in weights.items() if v}


def strata_shapley(game, spec: Semivalue, group: list[int], threshold: int = 5, per_stratum: int | None = None, seed: int = 0) -> DataFrame:
    """(value): the group's Shapley value from means over strata of size and overlap.

    per_stratum None: means over all coalitions.  A threshold of n or more is
    unbiased; a smaller one approximates large sizes by a difference quotient.
    """
    if not spec.is_shapley:
        raise Unsupported("strata_shapley estimates Shapley values only")
    n, g, mask = game.n, len(group), group_mask(group, game.n)
    weights = _strata(n, g, threshold)
    u0, u1 = game.bounds()
    overlap = F.bit_count(F.col("mask").bitwiseAND(F.lit(mask).cast("bigint"))).cast("int")
    if per_stratum is None:
        drawn = game.table()
    else:
        cells = sorted(weights)
        base = game.spark.range(per_stratum * len(cells)).withColumnRenamed("id", "k").withColumn("c", (F.col("k") % len(cells)).cast("int"))
        order = draws.ranked_players(F.col("k"), n, seed)
        pick = lambda which: F.element_at(F.array(*[F.lit(c[which]) for c in cells]), F.col("c") + 1)
        base = base.select("k", order.alias("o"), pick(0).alias("s"), pick(1).alias("r"))
        side = lambda inside: F.filter("o", lambda i: F.getbit(F.lit(mask).cast("bigint"), i) == inside)
        masks = base.select(draws.bits(F.slice(side(1), F.lit(1), F.col("r"))).bitwiseOR(draws.bits(F.slice(side(0), F.lit(1), F.col("s") - F.col("r")))).alias("mask"))
        drawn = worth(game, masks)
    means = drawn.groupBy(F.bit_count("mask").cast("int").alias("s"), overlap.alias("r")).agg(F.avg("u").alias("m"))
    weight = F.expr(by_size([weights.get((s, r), 0.0) for s in range(n + 1) for r in range(g + 1)], column=f"(s * {g + 1} + r)"))
    return means.agg((F.lit(g / n * (u1 - u0)) + F.coalesce(F.sum(weight * F.col("m")), F.expr(number(0.0)))).alias("value"))
