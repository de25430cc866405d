"""Games of up to 30 players over all their coalitions: a superset-sum transform spread over the cluster.

A coalition's mask is cut in two.  Coalitions of equal high bits are one block,
in which the low bits' sums are taken in place; blocks are then cut into strips
of low bits and dealt anew, a strip holding all high bits, and the same is done
along those.  So the worths of all 2**n coalitions take one shuffle, no join,
and no row per coalition; values are weighted sums over a strip, added up over
strips.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrispark.functions.ship import ship
from attrispark.functions.spec import Semivalue
from attrispark.operators.exact import group_mask

#: Players beyond which all coalitions are too many; low bits of a block; coalitions of a strip (8 MB of worths).
MOST_PLAYERS, LOW, STRIP = 30, 16, 1 << 20


def spread(values: np.ndarray) -> np.ndarray:
    """values[S, ...] replaced by their sums over the subsets of S, along the first axis, in place."""
    size, step = len(values), 1
    while step < size:
        halves = values.reshape(size // (2 * step), 2, step, *values.shape[1:])
        halves[:, 1] += halves[:, 0]
        step *= 2
    return values


def strips(game) -> tuple[DataFrame, int, int]:
    """((strip, high, v binary), low bits, low bits inside a strip): the worths summed along low bits, of the blocks that have terms."""
    n = game.n
    if n > MOST_PLAYERS:
        raise ValueError(f"{n} players have too many coalitions; {MOST_PLAYERS} is the most")
    ship(game.spark)
    low = min(LOW, n)
    inner = max(0, min(low, STRIP.bit_length() - 1 - (n - low)))

    def block(rows):
        import pyarrow as pa

        mask = rows.column("mask").to_numpy()
        worths = np.zeros(1 << low)
        np.add.at(worths, mask & ((1 << low) - 1), rows.column("w").to_numpy())
        spread(worths)
        cut = worths.reshape(-1, 1 << inner)
        return pa.table({"strip": pa.array(np.arange(len(cut), dtype=np.int32)), "high": pa.array(np.full(len(cut), mask[0] >> low, np.int32)), "v": pa.array([row.tobytes() for row in cut], pa.binary())})

    terms = game.terms.select(F.shiftright("mask", low).alias("high"), "mask", "w")
    return terms.groupBy("high").applyInArrow(block, "strip int, high int, v binary"), low, inner


def over_strips(game, run, schema: str) -> DataFrame:
    """run(strip masks' high part, low part, worths) for every strip; worths[h, l] is that of the coalition high[h] | low[l]."""
    n = game.n
    parts, low, inner = strips(game)
    # Strips without a single term are worth nothing, but they count.
    every = game.spark.range(1 << (low - inner)).select(F.col("id").cast("int").alias("strip"))

    def strip(table, mine):
        worths = np.zeros((1 << (n - low), 1 << inner))
        for high, v in zip(table.column("high").to_pylist(), table.column("v"), strict=True):
            worths[high] = np.frombuffer(v.as_buffer(), np.float64)
        spread(worths)
        at = mine.column("strip")[0].as_py()
        return run(np.arange(1 << (n - low), dtype=np.int64) << low, (at << inner) | np.arange(1 << inner, dtype=np.int64), worths)

    return parts.groupBy("strip").cogroup(every.groupBy("strip")).applyInArrow(strip, schema)


def exact(game, spec: Semivalue) -> DataFrame:
    """(player, value) by the weights of all 2**n coalitions of a game of terms."""
    n = game.n
    p = np.array([0.0, *spec.p(n), 0.0])  # p[s] at s + 1

    def run(high, low, worths):
        import pyarrow as pa

        size = np.bitwise_count(high)[:, None].astype(np.intp) + np.bitwise_count(low)[None, :]
        out = (p[size + 1] * worths).sum()
        both = (p[size] + p[size + 1]) * worths  # what a coalition's worth moves by when the player is taken in
        by_high, by_low = both.sum(axis=1), both.sum(axis=0)
        values = [by_high[high >> i & 1 == 1].sum() + by_low[low >> i & 1 == 1].sum() - out for i in range(n)]  # a player's bit is high or low
        return pa.table({"player": pa.array(np.arange(n, dtype=np.int32)), "value": pa.array(values, pa.float64())})

    return over_strips(game, run, "player int, value double").groupBy("player").agg(F.sum("value").alias("value"))


def exact_group(game, spec: Semivalue, group: list[int]) -> DataFrame:
    """(value): the sum of a group's semivalues, by size and overlap of all coalitions."""
    n, g, mask = game.n, len(group), group_mask(group, game.n)
    p = [*spec.p(n), 0.0]
    weight = np.array([[(r * p[s - 1] if s else 0.0) - (g - r) * p[s] for r in range(g + 1)] for s in range(n + 1)])

    def run(high, low, worths):
        import pyarrow as pa

        size = np.bitwise_count(high)[:, None].astype(np.intp) + np.bitwise_count(low)[None, :]
        overlap = np.bitwise_count(high & mask)[:, None].astype(np.intp) + np.bitwise_count(low & mask)[None, :]
        return pa.table({"value": pa.array([float((weight[size, overlap] * worths).sum())])})

    return over_strips(game, run, "value double").agg(F.sum("value").alias("value"))


def by_size(game) -> DataFrame:
    """(s, coalitions, mean, least, most) of the worths of all coalitions of each size."""

    def run(high, low, worths):
        import pyarrow as pa

        size = (np.bitwise_count(high)[:, None].astype(np.intp) + np.bitwise_count(low)[None, :]).reshape(-1)
        flat = worths.reshape(-1)
        order = np.argsort(size, kind="stable")
        found, at = np.unique(size[order], return_index=True)
        cut = flat[order]
        return pa.table({"s": pa.array(found.astype(np.int32)), "c": pa.array(np.diff([*at, len(flat)]).astype(np.int64)), "total": pa.array(np.add.reduceat(cut, at)), "least": pa.array(np.minimum.reduceat(cut, at)), "most": pa.array(np.maximum.reduceat(cut, at))})

    parts = over_strips(game, run, "s int, c bigint, total double, least double, most double")
    return parts.groupBy("s").agg(F.sum("c").alias("coalitions"), (F.sum("total") / F.sum("c")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))


def table(game) -> DataFrame:
    """(mask, u) of all coalitions, a row each: 2**n of them."""

    def run(high, low, worths):
        import pyarrow as pa

        return pa.table({"mask": pa.array((high[:, None] | low[None, :]).reshape(-1)), "u": pa.array(worths.reshape(-1))})

    return over_strips(game, run, "mask bigint, u double")


def evaluate(game, masks: DataFrame) -> DataFrame:
    """(mask, u) of the distinct masks asked for, looked up in the strips that hold them: no mask meets the terms one by one."""
    n = game.n
    parts, low, inner = strips(game)
    strip_of = F.shiftright(F.col("mask").bitwiseAND(F.lit((1 << low) - 1).cast("bigint")), inner).cast("int")
    asked = masks.select("mask").distinct().select(strip_of.alias("strip"), "mask")

    def look(table, mine):
        import pyarrow as pa

        if not mine.num_rows:
            return pa.table({"mask": pa.array([], pa.int64()), "u": pa.array([], pa.float64())})
        worths = np.zeros((1 << (n - low), 1 << inner))
        for high, v in zip(table.column("high").to_pylist(), table.column("v"), strict=True):
            worths[high] = np.frombuffer(v.as_buffer(), np.float64)
        spread(worths)
        mask = mine.column("mask").to_numpy()
        return pa.table({"mask": pa.array(mask), "u": pa.array(worths[mask >> low, mask & ((1 << inner) - 1)])})

    return parts.groupBy("strip").cogroup(asked.groupBy("strip")).applyInArrow(look, "mask bigint, u double")
