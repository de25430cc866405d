"""A black-box game of training sets: what a model trained on a coalition's rows scores on a fixed set.

The model is a softmax regression trained for one pass of single-row gradient
steps.  A coalition is trained in one task; distinct coalitions run in
parallel as Arrow batches of masks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrispark.functions import draws
from attrispark.functions.ship import ship
from attrispark.sources.games import CallableGame, TableGame


class Training:
    """metric: accuracy, or the mean log-likelihood (cross_entropy, higher is better).

    extra: rows that every coalition trains on besides its own.  order: the
    places of all rows, the extra ones last, in the one pass; else a coalition
    shuffles its rows by the seed.  spread: deviation of the first weights.
    """

    def __init__(self, x, y, x_score, y_score, classes: int, metric: str = "accuracy", rate: float = 0.1, seed: int = 0, extra: tuple | None = None, order=None, spread: float = 0.01):
        if metric not in ("accuracy", "cross_entropy"):
            raise NotImplementedError(f"unknown metric {metric!r}")
        self.x, self.y = np.asarray(x, float), np.asarray(y, int)
        self.x_score, self.y_score = np.asarray(x_score, float), np.asarray(y_score, int)
        self.classes, self.metric, self.rate, self.seed = classes, metric, rate, seed
        self.extra = None if extra is None else (np.asarray(extra[0], float), np.asarray(extra[1], int))
        self.order, self.spread = order, spread

    def fit(self, rows: np.ndarray) -> np.ndarray:
        x, y = self.x[rows], self.y[rows]
        if self.extra is not None:
            x, y = np.vstack([x, self.extra[0]]), np.concatenate([y, self.extra[1]])
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, self.spread, (self.x.shape[1] + 1, self.classes))
        turns = rng.permutation(len(x)) if self.order is None else np.argsort(np.append(np.asarray(self.order)[rows], np.asarray(self.order)[len(self.x) :]))
        for i in turns:
            row = np.append(x[i], 1.0)
            z = row @ w
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            w -= self.rate * np.outer(row, p)
        return w

    def score(self, w: np.ndarray) -> float:
        z = np.hstack([self.x_score, np.ones((len(self.x_score), 1))]) @ w
        if self.metric == "accuracy":
            return float((z.argmax(axis=1) == self.y_score).mean())
        z -= z.max(axis=1, keepdims=True)
        return float((z[np.arange(len(z)), self.y_score] - np.log(np.exp(z).sum(axis=1))).mean())

    def __call__(self, masks: list[int]) -> list[float]:
        n = len(self.x)
        return [self.score(self.fit(np.flatnonzero([m >> i & 1 for i in range(n)]))) for m in masks]


def training_game(spark: SparkSession, training: Training) -> CallableGame:
    """Each row of the training set is a player."""
    ship(spark)
    return CallableGame(len(training.x), spark, training, "training")


def _design(batch, at: int) -> np.ndarray:
    x = np.array(batch.column(at).to_pylist(), np.float64)
    return np.hstack([x, np.ones((len(x), 1))])


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def trained_on_tables(train: DataFrame, score: DataFrame, n: int, classes: int, steps: int = 20, rate: float = 1.0, metric: str = "cross_entropy") -> TableGame:
    """The training game of n players who each own any number of rows of train (player, x, y), scored on the rows of score (x, y).

    The softmax regressions of all coalitions are trained together by full
    gradient steps from zero: a step is one pass over train, in which a task
    adds every row's gradient to the coalitions that hold its player, and the
    driver gets one gradient per coalition, 2^n (features + 1) classes numbers
    whatever the number of rows.  Null rows and rows of null class take no part.
    """
    if metric not in ("accuracy", "cross_entropy"):
        raise NotImplementedError(f"unknown metric {metric!r}")
    if n > 10:
        raise ValueError(f"{n} players have too many coalitions to train together")
    spark = train.sparkSession
    ship(spark)
    numbers = F.col("x").cast("array<double>").alias("x")
    train = train.where("x is not null and y is not null and player is not null").select(F.col("player").cast("int").alias("player"), numbers, F.col("y").cast("int").alias("y"))
    score = score.where("x is not null and y is not null").select(numbers, F.col("y").cast("int").alias("y"))
    wide = train.select(F.size("x").alias("d")).agg(F.max("d")).first()[0] or 0
    masks = np.arange(1 << n)
    weights = np.zeros((1 << n, wide + 1, classes))

    def summed(frame: DataFrame, part, shape) -> np.ndarray:
        def run(batches):
            import pyarrow as pa

            total = np.zeros(shape)
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    total += part(batch.slice(lo, 512))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["at", "v"])

        rows = frame.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(int(np.prod(shape)))
        out[rows["at"]] = rows["v"]
        return out.reshape(shape)

    def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.moveaxis((x @ np.moveaxis(w, 0, 1).reshape(w.shape[1], -1)).reshape(len(x), len(masks), classes), 1, 0)

    for _ in range(steps):
        w = weights.copy()

        def gradient(batch, w=w):
            x, player, y = _design(batch, 1), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            p = np.exp(_log_softmax(logits(x, w)))
            p[:, np.arange(len(y)), y] -= 1
            p *= ((masks[:, None] >> player[None, :]) & 1)[:, :, None]
            # The last entry counts each coalition's rows.
            return np.concatenate([np.einsum("bi,sbc->sic", x, p), np.broadcast_to(((masks[:, None] >> player[None, :]) & 1).sum(axis=1)[:, None, None], (len(masks), 1, classes))], axis=1)

        found = summed(train, gradient, (1 << n, wide + 2, classes))
        weights -= rate * found[:, :-1] / np.maximum(found[:, -1:], 1)
    final = weights.copy()

    def scored(batch):
        x, y = _design(batch, 0), batch.column(1).to_numpy()
        z = _log_softmax(logits(x, final))
        good = (z.argmax(axis=2) == y).sum(axis=1) if metric == "accuracy" else z[:, np.arange(len(y)), y].sum(axis=1)
        return np.stack([good, np.full(len(masks), len(y))], axis=1).astype(np.float64)

    found = summed(score, scored, (1 << n, 2))
    return TableGame(n, spark.createDataFrame([(int(m), float(a / max(c, 1))) for m, (a, c) in zip(masks, found, strict=True)], "mask bigint, u double"), "training")


def trained_in_order(train: DataFrame, score: DataFrame, n: int, classes: int, rate: float = 0.1, metric: str = "cross_entropy", seed: int = 0, spread: float = 0.01) -> TableGame:
    """The training game by one pass of single-row gradient steps, n players each owning any number of rows of train (id, player, x, y).

    Rows come in one order for all coalitions, that of their ids' digests, which
    any engine can make.  A row without a player trains every coalition.  Single
    steps follow one another, so a model reads all rows in turn; the 2^n models
    are dealt into groups, each fed by a sorted stream of the rows in one task
    that holds its models and a batch of rows, however long the table is.  Rows
    of null x or y take no part, nor do null ids.
    """
    if metric not in ("accuracy", "cross_entropy"):
        raise NotImplementedError(f"unknown metric {metric!r}")
    if n > 10:
        raise ValueError(f"{n} players have too many coalitions to train together")
    spark = train.sparkSession
    ship(spark)
    numbers = F.col("x").cast("array<double>").alias("x")
    rows = train.where("x is not null and y is not null and id is not null").select(F.col("id"), F.coalesce(F.col("player").cast("int"), F.lit(-1)).alias("player"), numbers, F.col("y").cast("int").alias("y"), draws.digest(F.col("id"), "order", seed).alias("turn"))
    score = score.where("x is not null and y is not null").select(numbers, F.col("y").cast("int").alias("y"))
    wide = train.select(F.size("x").alias("d")).agg(F.max("d")).first()[0] or 0
    first = np.random.default_rng(seed).normal(0, spread, (wide + 1, classes))
    groups = min(1 << n, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fed = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g").sortWithinPartitions("g", "turn", "id").select("g", "player", "x", "y")

    def stream(batches):
        import pyarrow as pa

        now, masks, w = None, None, None

        def trained():
            return pa.RecordBatch.from_arrays([pa.array(masks), pa.array([x.tobytes() for x in w], pa.binary())], names=["mask", "w"])

        for batch in batches:
            group, player, y = (batch.column(k).to_numpy() for k in (0, 1, 3))
            for lo in range(0, batch.num_rows, 2048):
                x = _design(batch.slice(lo, 2048), 2)
                for j, row in enumerate(x, start=lo):
                    if group[j] != now:
                        if now is not None:
                            yield trained()
                        now, masks = group[j], np.arange(group[j], 1 << n, groups)
                        w = np.repeat(first[None], len(masks), axis=0)
                    mine = np.arange(len(masks)) if player[j] < 0 else np.flatnonzero(masks >> player[j] & 1)
                    z = np.einsum("kdc,d->kc", w[mine], row)
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    p[:, y[j]] -= 1
                    w[mine] -= rate * row[None, :, None] * p[:, None, :]
        if now is not None:
            yield trained()

    weights = np.repeat(first[None], 1 << n, axis=0)
    for r in fed.mapInArrow(stream, "mask bigint, w binary").collect():  # 2^n times (features + 1) classes numbers
        weights[r["mask"]] = np.frombuffer(r["w"], np.float64).reshape(first.shape)

    def scored(batches):
        import pyarrow as pa

        total, seen = np.zeros(1 << n), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                x, y = _design(some, 0), some.column(1).to_numpy()
                z = _log_softmax(np.einsum("bd,sdc->sbc", x, weights))
                total += (z.argmax(axis=2) == y).sum(axis=1) if metric == "accuracy" else z[:, np.arange(len(y)), y].sum(axis=1)
                seen += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << n)), pa.array(total), pa.array(np.full(1 << n, seen))], names=["mask", "total", "seen"])

    found = score.mapInArrow(scored, "mask bigint, total double, seen bigint").groupBy("mask").agg((F.sum("total") / F.greatest(F.sum("seen"), F.lit(1))).alias("u"))
    return TableGame(n, found, "training")
