"""Additive and ridge games evaluated for the coalitions that are asked for, of any number of players that a mask has bits for.

What a player holds is summed once: one weight, or the d x d products of its
rows.  That is n small records, which travel with every task; a coalition is
evaluated in place from them, so nothing of size 2^n is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrispark.functions import draws
from attrispark.functions.ship import ship
from attrispark.functions.spec import number
from attrispark.sources.games import MASK_PLAYERS, TABLE_PLAYERS, few, inverse_normal

#: Features of a ridge game: a player's products are their square in numbers.
MOST_FEATURES = 64


class _Lazy:
    """What games share that evaluate masks in place: attach(samples, column) adds u."""

    @property
    def full(self) -> int:
        return (1 << self.n) - 1

    def evaluate(self, masks: DataFrame) -> DataFrame:
        return self.attach(masks.select("mask").distinct())

    def table(self) -> DataFrame:
        if self.n > TABLE_PLAYERS:
            raise ValueError(f"{self.n} players have too many coalitions to tabulate")
        return self.attach(self.spark.range(1 << self.n).select(F.col("id").alias("mask")))

    def bounds(self) -> tuple[float, float]:
        """U of no player and of all players."""
        rows = {r["mask"]: r["u"] for r in self.attach(self.spark.createDataFrame([(0,), (self.full,)], "mask bigint")).collect()}
        return float(rows[0]), float(rows[self.full])


def _players(n: int) -> None:
    if not 0 < n <= MASK_PLAYERS:
        raise ValueError(f"at most {MASK_PLAYERS} players fit a mask; there are {n}")


@dataclass
class AdditiveGame(_Lazy):
    """U(S) = f((1 - lam) sum of weights + lam sigma Z(S)) over weights (player, w), as games.additive tabulates it.

    Players without a weight weigh nothing; their weights are summed where they repeat.
    """

    n: int
    weights: DataFrame
    transform: Callable[[Column], Column] | None = None
    lam: float = 0.0
    sigma: float = 1.0
    seed: int = 0
    noise: Callable[[Column], Column] | None = None
    name: str = "additive"
    _known: list = field(default_factory=list, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.weights.sparkSession

    def _weights(self) -> list[float]:
        if not self._known:
            _players(self.n)
            rows = few(self.weights.groupBy("player").agg(F.sum("w").alias("w"))).collect()
            self._known = [[float({r["player"]: r["w"] for r in rows}.get(i) or 0.0) for i in range(self.n)]]
        return self._known[0]

    def attach(self, samples: DataFrame, column: str = "mask") -> DataFrame:
        players = F.sequence(F.lit(0), F.lit(self.n - 1))
        mine = F.filter(players, lambda i: F.getbit(F.col(column), i) == 1)
        held = F.expr(f"array({', '.join(map(number, self._weights()))})")
        value = F.aggregate(mine, F.lit(0.0), lambda a, i: a + F.get(held, i))
        if self.lam:
            keys = F.expr(f"array({', '.join(f'{int(md5(f"zobrist:{self.seed}:{i}".encode()).hexdigest()[:13], 16)}L' for i in range(self.n))})")
            z = (F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, i: a.bitwiseXOR(F.get(keys, i))) + 0.5) / F.lit(float(1 << draws.BITS))
            value = (1 - self.lam) * value + self.lam * self.sigma * (self.noise or inverse_normal)(z)
        return samples.withColumn("u", self.transform(value) if self.transform else value)


@dataclass
class RidgeGame(_Lazy):
    """Squared error of a coalition's ridge coefficients, for rows (player, x array, y) of any width up to MOST_FEATURES.

    averaged: the penalty grows with the coalition's rows, as for the mean
    loss.  Rows with a null take no part; the empty coalition's coefficients
    are 0.
    """

    n: int
    rows: DataFrame
    beta: list[float]
    penalty: float
    averaged: bool = False
    name: str = "ridge"
    _known: list = field(default_factory=list, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def _sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products of features, of features with y, and rows, by player; summed in Spark, a row per player."""
        if not self._known:
            _players(self.n)
            d = len(self.beta)
            if self.penalty <= 0 or not 0 < d <= MOST_FEATURES:
                raise ValueError(f"penalty must be positive, and features from 1 to {MOST_FEATURES}")
            x = [F.col("x")[i].cast("double") for i in range(d)]
            y = F.col("y").cast("double")
            whole = self.rows.where(F.col("player").isNotNull() & y.isNotNull() & F.forall("x", lambda v: v.isNotNull()) & (F.size("x") == d))
            cells = [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)] + [F.sum(v * y) for v in x]
            found = few(whole.groupBy("player").agg(F.array(*cells).alias("c"), F.count("*").alias("m"))).collect()
            gram, right, count = np.zeros((self.n, d, d)), np.zeros((self.n, d)), np.zeros(self.n)
            upper = np.triu_indices(d)
            for r in found:
                if 0 <= r["player"] < self.n:
                    c = np.array(r["c"])
                    gram[r["player"]][upper] = c[: len(upper[0])]
                    right[r["player"]], count[r["player"]] = c[len(upper[0]) :], r["m"]
            gram = gram + np.transpose(np.triu(gram, 1), (0, 2, 1))
            self._known = [(gram, right, count)]
        return self._known[0]

    def attach(self, samples: DataFrame, column: str = "mask") -> DataFrame:
        ship(self.spark)
        gram, right, count = self._sums()
        n, d, beta, penalty, averaged = self.n, len(self.beta), np.array(self.beta, float), self.penalty, self.averaged
        names = samples.columns
        at = names.index(column)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                u = np.zeros(batch.num_rows)
                for lo in range(0, batch.num_rows, 1024):
                    bits = ((batch.column(at).slice(lo, 1024).to_numpy()[:, None] >> np.arange(n)) & 1).astype(float)
                    weight = penalty * np.maximum(1, bits @ count) if averaged else np.full(len(bits), penalty)
                    left = (bits @ gram.reshape(n, -1)).reshape(-1, d, d) + weight[:, None, None] * np.eye(d)
                    fit = np.linalg.solve(left, (bits @ right)[:, :, None])[:, :, 0]
                    u[lo : lo + 1024] = ((fit - beta) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u)], names=[*names, "u"])

        return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField("u", T.DoubleType())]))
