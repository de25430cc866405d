"""Streaming attribution: additive estimator state over unbounded inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attrispark.functions.spec import Semivalue, by_size
from attrispark.operators import regression


def running_values(evaluated: DataFrame, n: int) -> DataFrame:
    """(player, value) of a stream of evaluated samples (mask, u): mean worth with less without each player; for complete mode."""
    spread = evaluated.select("u", "mask", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("player"))
    inside = F.expr("getbit(mask, player) = 1")
    mean = lambda hit: F.coalesce(F.avg(F.when(hit, F.col("u"))), F.lit(0.0))
    return spread.groupBy("player").agg((mean(inside) - mean(~inside)).alias("value"))


def windowed_terms(events: DataFrame, time: str, group: list[str], player: str, measure: str, width: str, late: str) -> DataFrame:
    """Unanimity terms (window, group..., mask, w) of a stream of facts, one per group and tumbling window, closed by the watermark."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(player).cast("int"))
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a time with a zone
    return events.withWatermark(time, late).groupBy(F.window(time, width), *group).agg(F.bit_or(one).alias("mask"), F.sum(measure).alias("w"))


def attribute_terms(terms: DataFrame, spec: Semivalue, n: int, keys: list[str]) -> DataFrame:
    """(keys..., player, value) of finished terms in closed form: narrow, so it runs on a stream in append mode before a batch sums it."""
    share = F.expr(by_size([spec.unanimity(s) for s in range(1, n + 1)], first=1, column="bit_count(mask)"))
    return terms.select(*keys, (F.col("w") * share).alias("value"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)).alias("player"))


def store_values(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Starts a query that appends each batch's attributed values, summed per key and player, to a Parquet folder partitioned by batch.

    A batch that is run again overwrites its own folder, so values count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys, "player").agg(F.sum("value").alias("value")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


class SummedStrips(StatefulProcessor):
    """The running sum of one strip of a matrix of `size` numbers, over all batches so far."""

    def __init__(self, size: int, strip: int):
        self.size, self.strip = size, strip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "v binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        whole = np.frombuffer(self.total.get()[0], np.float64).copy() if self.total.exists() else np.zeros(min(self.strip, self.size - key[1] * self.strip))
        for part in rows:
            for at, v in zip(part["at"], part["v"], strict=True):
                regression.thicken(bytes(at), v, whole)
        self.total.update((whole.tobytes(),))
        yield pd.DataFrame({"f": [key[0]], "i": [key[1]], "at": [b""], "v": [whole.tobytes()]})

    def close(self) -> None:
        pass


def fitted_values(evaluated: DataFrame, fit: regression.Fit, path: str, checkpoint: str):
    """Starts a query that keeps the Gram matrix of a stream of evaluated samples (mask, s, u, and k where the fit has folds) and solves it after every batch.

    Tasks add their rows up; the strips of the matrix are keyed state, so a
    batch moves one partial matrix per task, and a restart goes on from the
    checkpoint.  The values after batch b, of all samples until then, are a
    Parquet folder batch=b, which a batch that is run again overwrites.  State
    needs the RocksDB store.
    """
    spark = evaluated.sparkSession
    width, strip, rows = fit.width, regression.STRIP, fit.rows
    shapes = [(width, width)]
    parts = regression.partial_products(evaluated, lambda c: [(rows(c), None)], shapes) if fit.folds == 1 else None
    if parts is None:
        raise ValueError("a stream's samples can't be sorted by fold; use an estimator of one matrix")
    state = parts.groupBy("f", "i").transformWithStateInPandas(SummedStrips(width * width, strip), outputStructType="f int, i int, at binary, v binary", outputMode="Update", timeMode="None")

    def solve(batch: DataFrame, number: int) -> None:
        strips = batch.collect()  # one matrix
        if strips:
            (gram,) = regression.matrices(strips, shapes, 1, strip)
            regression.values_frame(spark, fit.solve(gram)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(solve).trigger(availableNow=True).start()
