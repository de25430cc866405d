"""Experiment analytics: errors against the truth, areas under convergence curves, grids and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def errors(trajectory: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, ckpt): squared and relative squared error, L2, relative L2 and RMSE over players.

    A truth of norm 0 counts as norm 1 in relative errors.
    """
    joined = trajectory.join(truth.select("player", F.col("value").alias("truth")), "player")
    diff = F.col("value") - F.col("truth")
    sums = joined.groupBy(*keys, "ckpt").agg(F.sum(diff * diff).alias("sq_error"), F.sum(F.col("truth") * F.col("truth")).alias("norm"), F.count("*").alias("players"))
    norm = F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0))
    return sums.select(*keys, "ckpt", "sq_error", (F.col("sq_error") / norm).alias("rel_sq_error"), F.sqrt("sq_error").alias("l2_error"), F.sqrt(F.col("sq_error") / norm).alias("rel_l2_error"), F.sqrt(F.col("sq_error") / F.col("players")).alias("rmse"))


def aucc(summary: DataFrame, setting: list[str], run: str) -> DataFrame:
    """Per setting the mean, population deviation and number of runs' mean relative L2 error over checkpoints."""
    per_run = summary.groupBy(*setting, run).agg(F.avg("rel_l2_error").alias("a"))
    return per_run.groupBy(*setting).agg(F.avg("a").alias("aucc_mean"), F.stddev_pop("a").alias("aucc_std"), F.count("*").alias("runs"))


def aucc_matrix(table: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Mean areas as a matrix of settings by methods."""
    return table.groupBy(row).pivot(column, columns).agg(F.first("aucc_mean"))


def trapezoid(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area under each curve over the length of its range; a single point counts as its value."""
    by = Window.partitionBy(*keys).orderBy(x)
    step = (F.col(x) - F.lag(x).over(by)) * (F.col(y) + F.lag(y).over(by)) / 2
    area = curve.withColumn("_a", step).groupBy(*keys).agg(F.sum("_a").alias("a"), (F.max(x) - F.min(x)).alias("w"), F.avg(y).alias("m"))
    return area.select(*keys, F.when(F.col("w") > 0, F.col("a") / F.col("w")).otherwise(F.col("m")).alias("aucc"))


def curves(summary: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and population deviation of a metric over runs."""
    return summary.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count("*").alias("runs"))


def grid(settings: DataFrame, methods: DataFrame) -> DataFrame:
    """Settings with the methods that can run on them.

    settings (setting, semivalue, a, b), methods (method, compatibility): all,
    shapley, non_shapley, symmetric or ame.
    """
    is_shapley = (F.col("semivalue") == "shapley") | ((F.col("semivalue") == "beta_shapley") & (F.col("a") == 1) & (F.col("b") == 1))
    symmetric = is_shapley | ((F.col("semivalue") == "weighted_banzhaf") & (F.col("a") == 0.5)) | ((F.col("semivalue") == "beta_shapley") & (F.col("a") == F.col("b")))
    ame = (F.col("semivalue") == "weighted_banzhaf") | ((F.col("semivalue") == "beta_shapley") & (F.col("a") > 1) & (F.col("b") > 1))
    need = F.col("compatibility")
    fits = (need == "all") | ((need == "shapley") & is_shapley) | ((need == "non_shapley") & ~is_shapley) | ((need == "symmetric") & symmetric) | ((need == "ame") & ame)
    # Either side has a row per setting or method; whichever is small is broadcast by its size.
    return settings.join(methods, F.coalesce(fits, F.lit(False)))


def method_order(summary: DataFrame, seen: str, order: list[str] = (), hidden: list[str] = (), requested: list[str] = ()) -> DataFrame:
    """(method, place): which methods a report shows and in which order.

    Requested methods come as requested, and one that the summary lacks stops
    the query.  Else hidden ones are left out, those of `order` come first and
    the others follow as they were first seen, ties by name.
    """
    spark = summary.sparkSession
    found = summary.groupBy("method").agg(F.min(seen).alias("_seen"))
    listed = [(m, i) for i, m in enumerate(dict.fromkeys(requested or order))]
    places = spark.createDataFrame(listed, "method string, _place int")
    if requested:
        known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no such method in the summary: "), "method")).cast("int")).otherwise(F.col("_place"))
        return places.join(found.select("method", F.lit(True).alias("_known")), "method", "left").select("method", known.alias("place"))
    shown = found.where(~F.col("method").isin(list(hidden))) if hidden else found
    ranked = shown.join(places, "method", "left")
    by = Window.orderBy(F.col("_place").asc_nulls_last(), "_seen", "method")  # a row per method
    return ranked.select("method", (F.row_number().over(by) - 1).alias("place"))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished run."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def balanced_pick(data: DataFrame, label: str, order: str, count: int) -> DataFrame:
    """count rows taken from the classes in turn, each class in the given order."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return data.withColumn("_turn", turn).where(F.col("_turn") <= count).orderBy("_turn", label).limit(count).drop("_turn")


def standardised(data: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less the training mean, over the training population deviation; a constant column becomes 0."""
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = data.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*[c for c in data.columns if c not in columns], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) for c in columns])
