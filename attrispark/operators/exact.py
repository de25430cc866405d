"""Exact semivalues: enumeration, coefficient form, closed form, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrispark.functions.spec import Semivalue, by_size


def enumerated(game, spec: Semivalue) -> DataFrame:
    """(player, value): weighted marginals over all coalitions of the others, by a join of each with itself plus the player."""
    table = game.table()
    without = table.select("mask", "u", F.explode(F.sequence(F.lit(0), F.lit(game.n - 1))).alias("player")).where("getbit(mask, player) = 0")
    plus = without.withColumn("more", F.expr("mask | shiftleft(1L, player)"))
    joined = plus.join(table.select(F.col("mask").alias("more"), F.col("u").alias("u_more")), "more")
    weight = F.expr(by_size(spec.p(game.n), column="bit_count(mask)"))
    return joined.groupBy("player").agg(F.sum(weight * (F.col("u_more") - F.col("u"))).alias("value"))


def coefficients(game, spec: Semivalue) -> DataFrame:
    """(player, value) as one weighted sum over the coalition table: n aggregates, one scan, no join."""
    p = spec.p(game.n)
    inside, outside = by_size(p, first=1, column="bit_count(mask)"), by_size(p, column="bit_count(mask)")
    sums = [F.sum(F.expr(f"u * (CASE WHEN getbit(mask, {i}) = 1 THEN {inside} ELSE -{outside} END)")) for i in range(game.n)]
    return game.table().agg(F.array(*sums).alias("a")).select(F.posexplode("a").alias("player", "value"))


def closed_form(game, spec: Semivalue) -> DataFrame:
    """(player, value) of a game of unanimity terms: each term's weight goes to its members; no coalition is enumerated."""
    share = F.expr(by_size([spec.unanimity(s) for s in range(1, game.n + 1)], first=1, column="bit_count(mask)"))
    sums = [F.coalesce(F.sum(F.when(F.getbit("mask", F.lit(i)) == 1, F.col("w") * share)), F.lit(0.0)) for i in range(game.n)]
    return game.terms.agg(F.array(*sums).alias("a")).select(F.posexplode("a").alias("player", "value"))


def group_mask(group: list[int], n: int) -> int:
    """The mask of a group of distinct players."""
    if not group or len(set(group)) != len(group) or min(group) < 0 or max(group) >= n:
        raise ValueError(f"{group} isn't a group of distinct players below {n}")
    return sum(1 << i for i in group)


def group_weight(spec: Semivalue, n: int, size: int, overlap: int, members: int) -> float:
    """Weight of a coalition in the sum of a group's values, by its size and its members inside the group."""
    p = spec.p(n)
    inside = overlap * p[size - 1] if size else 0.0
    outside = (members - overlap) * p[size] if size < n else 0.0
    return inside - outside


def group_sum(game, spec: Semivalue, group: list[int]) -> DataFrame:
    """(value): the sum of the group's semivalues by one scan of the coalition table."""
    n, g = game.n, len(group)
    mask = group_mask(group, n)
    cells = [group_weight(spec, n, s, r, g) if r <= s <= n - g + r else 0.0 for s in range(n + 1) for r in range(g + 1)]
    weight = F.expr(by_size(cells, column=f"(bit_count(mask) * {g + 1} + bit_count(mask & {mask}L))"))
    return game.table().agg(F.sum(weight * F.col("u")).alias("value"))
