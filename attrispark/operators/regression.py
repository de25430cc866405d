"""Estimators that fit a surrogate: distributed Gram matrices, small dense solves on the driver.

Samples stay distributed.  Each task adds its rows' products to the matrices of
one fold at a time; the tasks' partial matrices are cut into strips and summed
as a tree, so neither a worker nor a group holds more with more tasks, and what
reaches the driver is one matrix per fold whatever the number of samples.  Its
size depends on the surrogate alone and is checked against LARGEST.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrispark.functions import clock, draws
from attrispark.functions.ship import ship
from attrispark.functions.spec import Semivalue, number
from attrispark.operators import exact, subsets
from attrispark.operators.estimators import Law, Unsupported, checkpoint, coin_of, even_sizes, kernel_sizes, population, sample, worth

#: Doubles of all folds' matrices that the driver may hold: 512 MB.
LARGEST = 1 << 26
#: Doubles of a strip of a matrix, and partial strips that are added in one group.
STRIP, FAN = 1 << 16, 16
#: Doubles of the rows that a task multiplies at a time.
ROWS = 1 << 20


def bit_matrix(masks: np.ndarray, n: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(n)) & 1).astype(np.float64)


def values_frame(spark, values) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "player int, value double")


def partial_products(samples: DataFrame, blocks: Callable, shapes: list[tuple[int, int]], folds: int = 1) -> DataFrame:
    """(f, i, task, at binary, v binary): the strips of each task's sums of w * l^T r per fold, for each (l, r) of blocks(columns); r None is l.

    Instead of (l, r) a block may be a list of (l, r, rows, columns of l,
    columns of r): products of some rows that touch some columns.  A
    partition's rows are sorted by fold, so a task holds the matrices of one.
    A strip is its values v, or those at the places `at` where most are 0.
    """
    sizes = [a * b for a, b in shapes]
    total, widest = sum(sizes), max(max(x) for x in shapes)
    ship(samples.sparkSession)
    columns = ["mask", "s", "u", "w", "q", "t", "fold"]
    have = set(samples.columns)
    cast = {"mask": "bigint", "s": "int", "fold": "int"}
    slim = samples.select(*[(F.col(c) if c in have else F.lit(1.0 if c in ("w", "q") else 0.0)).cast(cast.get(c, "double")).alias(c) for c in columns])
    if folds > 1:
        slim = slim.sortWithinPartitions("fold")
    step = max(256, min(4096, ROWS // widest))
    strip = STRIP

    def partial(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, now, flat, views = TaskContext.get().partitionId(), None, None, []

        def strips():
            for i in range(0, total, strip):
                at, v = _thin(flat[i : i + strip])
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([i // strip], pa.int32()), pa.array([task], pa.int32()), pa.array([at], pa.binary()), pa.array([v], pa.binary())], names=["f", "i", "task", "at", "v"])

        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                c = {name: batch.column(k).slice(lo, step).to_numpy(zero_copy_only=False) for k, name in enumerate(columns)}
                for f in np.unique(c["fold"]).tolist():
                    if f != now:
                        if now is not None:
                            yield from strips()
                        now, flat = f, np.zeros(total)
                        ends = np.cumsum([0, *sizes])
                        views = [flat[a:b].reshape(shape) for a, b, shape in zip(ends[:-1], ends[1:], shapes, strict=True)]
                    some = c if folds == 1 else {name: x[c["fold"] == f] for name, x in c.items()}
                    for view, block in zip(views, blocks(some), strict=True):
                        for left, right, at, of_left, of_right in block if isinstance(block, list) else [(*block, slice(None), None, None)]:
                            sums = (left * some["w"][at][:, None]).T @ (left if right is None else right)
                            if of_left is None:
                                view += sums
                            else:
                                view[np.ix_(of_left, of_right)] += sums
        if now is not None:
            yield from strips()

    return slim.mapInArrow(partial, STRIPS)


#: A strip of a task's partial matrix.
STRIPS = "f int, i int, task int, at binary, v binary"


def _thin(strip: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of the entries that aren't 0, where these are few; else no places and all values."""
    at = np.flatnonzero(strip)
    if 2 * len(at) < len(strip):
        return at.astype(np.int32).tobytes() or b"-", strip[at].tobytes()
    return b"", strip.tobytes()


def thicken(at: bytes, v: bytes, onto: np.ndarray) -> None:
    """Adds a strip to an array of its length."""
    if at == b"-":
        return
    if at:
        onto[np.frombuffer(at, np.int32)] += np.frombuffer(v, np.float64)
    else:
        onto += np.frombuffer(v, np.float64)


def matrices(strips, shapes: list[tuple[int, int]], folds: int, strip: int) -> list[np.ndarray]:
    """A stack of matrices per shape from whole strips (f, i, at, v)."""
    sizes = [a * b for a, b in shapes]
    flat = np.zeros((folds, sum(sizes)))
    for x in strips:
        thicken(bytes(x["at"]), x["v"], flat[x["f"], x["i"] * strip : (x["i"] + 1) * strip])
    ends = np.cumsum([0, *sizes])
    return [flat[:, a:b].reshape(folds, *shape) for a, b, shape in zip(ends[:-1], ends[1:], shapes, strict=True)]


def products(samples: DataFrame, blocks: Callable, shapes: list[tuple[int, int]], folds: int = 1) -> list[np.ndarray]:
    """Sums over samples (mask, s, u[, w, q, t, fold]) of w * l^T r per fold, a stack of matrices for each (l, r) of blocks(columns).

    Tasks' strips are added FAN at a time, level by level, for as many tasks
    as the session runs a stage in.
    """
    total = sum(a * b for a, b in shapes)
    if folds * total > LARGEST:
        raise MemoryError(f"{folds} times {total} doubles don't fit the driver")
    spark, strip = samples.sparkSession, STRIP

    def add(table):
        import pyarrow as pa

        i = table.column("i")[0].as_py()
        whole = np.zeros(min(strip, total - i * strip))
        for at, v in zip(table.column("at"), table.column("v"), strict=True):
            thicken(at.as_py(), v.as_buffer(), whole)
        at, v = _thin(whole)
        return pa.table({"f": table.column("f")[:1], "i": table.column("i")[:1], "task": table.column("task")[:1], "at": pa.array([at], pa.binary()), "v": pa.array([v], pa.binary())})

    found, tasks, group = partial_products(samples, blocks, shapes, folds), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), FAN
    while tasks > FAN:
        found = found.groupBy("f", "i", F.floor(F.col("task") / group).alias("g")).applyInArrow(add, STRIPS)
        tasks, group = -(-tasks // FAN), group * FAN
    return matrices(found.groupBy("f", "i").applyInArrow(add, STRIPS).collect(), shapes, folds, strip)


def running(samples: DataFrame, blocks: Callable, shapes: list[tuple[int, int]], folds: int, steps: int) -> Iterator[list[np.ndarray]]:
    """The products of the samples of the checkpoints 0..k (column ckpt) for each k below `steps`.

    Every sample enters one partial sum; checkpoints are prefix sums of those.
    A job takes as many checkpoints as the driver has room for, which is all of
    them unless the surrogate is wide.
    """
    at_once = max(1, LARGEST // (folds * sum(a * b for a, b in shapes)))
    fold = F.col("fold") if "fold" in samples.columns else F.lit(0)
    kept = at_once < steps and not samples.is_cached  # so that no job evaluates them again
    samples = samples.cache() if kept else samples
    total: list[np.ndarray] | None = None
    try:
        for lo in range(0, steps, at_once):
            hi = min(steps, lo + at_once)
            some = samples if hi - lo == steps else samples.where(F.col("ckpt").between(lo, hi - 1))
            found = products(some.withColumn("fold", (F.col("ckpt") - lo) * folds + fold), blocks, shapes, (hi - lo) * folds)
            for k in range(hi - lo):
                part = [x[k * folds : (k + 1) * folds] for x in found]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                yield total
    finally:
        if kept:
            samples.unpersist()


def gram(samples: DataFrame, rows: Callable, width: int, folds: int = 1) -> np.ndarray:
    """Sum over samples of w * r r^T per fold; rows(columns) gives the matrix of rows r of a batch."""
    return products(samples, lambda c: [(rows(c), None)], [(width, width)], folds)[0]


@dataclass(frozen=True)
class Fit:
    """An estimator with a solve: its law, the rows whose Gram matrix it needs, and the values of players from that matrix, one per fold."""

    law: Law
    rows: Callable
    width: int
    solve: Callable[[np.ndarray], np.ndarray]
    folds: int = 1


def _samples(game, law: Law, players: int, count: int | None, seed: int, paired: bool) -> DataFrame:
    """Evaluated samples with weight w: sampled ones count equally, the population by its probabilities."""
    if count is None:
        return worth(game, population(game.spark, law, players)).withColumnRenamed("weight", "w")
    return worth(game, sample(game.spark, law, players, count, seed, paired)).withColumn("w", F.lit(1.0 / count))


def _only_shapley(spec: Semivalue, name: str) -> None:
    if not spec.is_shapley:
        raise Unsupported(f"{name} estimates Shapley values only")


def _estimate(game, fit: Fit, count: int | None, seed: int, paired: bool, drawn: DataFrame | None = None) -> DataFrame:
    drawn = _samples(game, fit.law, game.n, count, seed, paired) if drawn is None else drawn
    sums = gram(drawn, fit.rows, fit.width, fit.folds)
    with clock.readout():
        values = fit.solve(sums)
    return values_frame(game.spark, values)


def kernel_fit(game, spec: Semivalue) -> Fit:
    _only_shapley(spec, "kernel_shap")
    n = game.n
    u0, u1 = game.bounds()

    def solve(g: np.ndarray) -> np.ndarray:
        inverse = np.linalg.pinv(g[0, :n, :n])
        free, slope = inverse @ g[0, :n, n], inverse @ np.ones(n)
        return free - slope * (free.sum() - (u1 - u0)) / slope.sum()

    return Fit(Law(kernel_sizes(n)), lambda c: np.hstack([bit_matrix(c["mask"], n), (c["u"] - u0)[:, None]]), n + 1, solve)


def kernel_shap(game, spec: Semivalue, count: int | None = None, seed: int = 0, paired: bool = False) -> DataFrame:
    """Efficiency-constrained least squares on membership bits; count None: over the whole population."""
    return _estimate(game, kernel_fit(game, spec), count, seed, paired)


def leverage_fit(game, spec: Semivalue) -> Fit:
    _only_shapley(spec, "leverage")
    n = game.n
    u0, u1 = game.bounds()
    mass = kernel_sizes(n)
    norm = sum(mass.values())
    root_of = np.sqrt(np.array([n * mass.get(s, 0.0) / norm for s in range(n + 1)]))

    def rows(c):
        share = c["s"] / n
        return np.hstack([bit_matrix(c["mask"], n) - share[:, None], (c["u"] - u0 - (u1 - u0) * share)[:, None]]) * root_of[c["s"]][:, None]

    return Fit(Law(even_sizes(1, n - 1)), rows, n + 1, lambda g: np.linalg.lstsq(g[0, :n, :n], g[0, :n, n], rcond=1e-10)[0] + (u1 - u0) / n)


def leverage(game, spec: Semivalue, count: int | None = None, seed: int = 0, paired: bool = False) -> DataFrame:
    """Least squares on centred bits with sizes drawn evenly and weighed by the kernel."""
    return _estimate(game, leverage_fit(game, spec), count, seed, paired)


def ame_fit(game, spec: Semivalue, paired: bool = False) -> Fit:
    n = game.n
    if spec.kind == "weighted_banzhaf":
        scale = 1 / (spec.params[0] * (1 - spec.params[0]))
    elif spec.kind == "beta_shapley" and min(spec.params) > 1:
        a, b = spec.params
        scale = (a + b - 1) * (a + b - 2) / ((a - 1) * (b - 1))
    else:
        raise Unsupported(f"ame needs contrasts of finite variance, not {spec}")
    if paired and not spec.symmetric:
        raise Unsupported("pairs need a symmetric semivalue")

    def rows(c):
        x, t = bit_matrix(c["mask"], n), c["t"][:, None]
        return np.hstack([x / t - (1 - x) / (1 - t), np.ones((len(x), 1)), c["u"][:, None]])

    return Fit(coin_of(spec), rows, n + 2, lambda g: scale * np.linalg.lstsq(g[0, :-1, :-1], g[0, :-1, -1], rcond=1e-12)[0][:n])


def ame(game, spec: Semivalue, count: int | None = None, seed: int = 0, paired: bool = False) -> DataFrame:
    """Regression of worth on inverse-probability contrasts of the bits, scaled by their variance."""
    fit = ame_fit(game, spec, paired)
    drawn = None
    if count is None:
        drawn = _samples(game, fit.law, game.n, None, seed, paired).withColumn("t", F.lit(float(fit.law.coin)))
    return _estimate(game, fit, count, seed, paired, drawn)


def subsets_up_to(n: int, order: int) -> list[np.ndarray]:
    """The subsets of 1, 2, ... order players, a matrix of members for each size."""
    return [np.array(list(combinations(range(n), r)), np.intp).reshape(-1, r) for r in range(1, order + 1)]


def monomials(x: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """The products of bits over each of the sets."""
    out = []
    for members in sets:
        column = x[:, members[:, 0]]
        for k in range(1, members.shape[1]):
            column *= x[:, members[:, k]]
        out.append(column)
    return out


def poly_fit(game, spec: Semivalue, order: int = 2) -> Fit:
    _only_shapley(spec, "poly_shap")
    n = game.n
    u0, u1 = game.bounds()
    sets = subsets_up_to(n, order)
    width = sum(len(x) for x in sets)

    def solve(stack: np.ndarray) -> np.ndarray:
        g = stack[0]
        inverse = np.linalg.pinv(g[:width, :width], rcond=1e-10, hermitian=True)
        # Directions that no sample determines are free to meet the constraint with the least coefficients.
        ones = np.ones(width)
        free = inverse @ g[:width, width]
        null = ones - inverse @ (g[:width, :width] @ ones)
        slope = null / max(null @ ones, 1e-300) if null @ ones > 1e-6 else inverse @ ones / (ones @ inverse @ ones)
        fit = free - slope * (free.sum() - (u1 - u0))
        values, at = np.zeros(n), 0
        for members in sets:
            np.add.at(values, members, (fit[at : at + len(members)] / members.shape[1])[:, None])
            at += len(members)
        return values

    return Fit(Law(kernel_sizes(n)), lambda c: np.hstack([*monomials(bit_matrix(c["mask"], n), sets), (c["u"] - u0)[:, None]]), width + 1, solve)


def poly_shap(game, spec: Semivalue, order: int = 2, count: int | None = None, seed: int = 0, paired: bool = False) -> DataFrame:
    """Constrained least squares on the products of up to `order` bits; each coefficient is shared by its members."""
    return _estimate(game, poly_fit(game, spec, order), count, seed, paired)


# ------------------------------------------------- surrogate plus residual correction


def size_weight(spec: Semivalue, n: int) -> list[float]:
    """Sum over players of the squared coefficient of a coalition, by size."""
    p = spec.p(n)
    return [(s * p[s - 1] ** 2 if s else 0.0) + ((n - s) * p[s] ** 2 if s < n else 0.0) for s in range(n + 1)]


def balanced_law(spec: Semivalue, n: int, lo: int = 0, hi: int | None = None) -> dict[int, float]:
    """Sizes drawn so that a coalition's chance grows with the root of its squared coefficients."""
    a = size_weight(spec, n)
    return {s: comb(n, s) * a[s] ** 0.5 for s in range(lo, (n if hi is None else hi) + 1)}


def coalition_chance(law: dict[int, float], n: int) -> np.ndarray:
    """Probability of one coalition by size."""
    total = sum(law.values())
    return np.array([law.get(s, 0.0) / total / comb(n, s) for s in range(n + 1)])


def coefficients(spec: Semivalue, n: int, masks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Coefficient of each coalition's worth in each player's value."""
    p = np.array([0.0, *spec.p(n), 0.0])  # p[s] at s + 1
    x = bit_matrix(masks, n)
    return x * p[sizes][:, None] - (1 - x) * p[sizes + 1][:, None]


def msr_fit(game, spec: Semivalue, folds: int = 10, unbiased: bool = True, special: bool = True, law: dict[int, float] | None = None, chance: np.ndarray | None = None, paired: bool = False) -> Fit:
    """law, chance: sizes and the chance of a coalition by size where they aren't those of draws by the balanced law."""
    if paired and not spec.symmetric:
        raise Unsupported("pairs need a symmetric semivalue")
    n = game.n
    law = balanced_law(spec, n) if law is None else law
    chance = coalition_chance(law, n) if chance is None else chance
    kernel, kernelled = kernel_sizes(n), spec.is_shapley and special
    fit_by_size = np.array([kernel.get(s, 0.0) / comb(n, s) for s in range(n + 1)]) if kernelled else np.ones(n + 1) * chance.mean()
    # Of the row: bits, 1, worth (fit columns, scaled by the fit weight), then coefficient / chance for the correction.
    sides = 2 if not unbiased else 1
    width = 2 * (n + 2) + sides * n + (2 * n if not unbiased else 0)
    u0, u1 = game.bounds()

    def rows(c):
        x = bit_matrix(c["mask"], n)
        plain = np.hstack([x, np.ones((len(x), 1)), c["u"][:, None]])
        root = np.sqrt(fit_by_size[c["s"]] / chance[c["s"]])
        g = coefficients(spec, n, c["mask"], c["s"]) / chance[c["s"]][:, None]
        parts = [plain * root[:, None], plain]
        parts += [g] if unbiased else [g * x, g * (1 - x), x, 1 - x]
        return np.hstack(parts)

    def solve(stats: np.ndarray) -> np.ndarray:
        m, total = n + 2, stats.sum(axis=0)
        value, weight = np.zeros(n), 0.0
        for f in range(len(stats)):
            train, test = (total - stats[f] if len(stats) > 1 else total), (stats[f] if len(stats) > 1 else total)
            mass = test[m + n, m + n]
            if mass <= 0:
                continue
            a = train[:m, :m]
            if kernelled:  # kernel-weighted, through both ends
                b = np.linalg.pinv(a[:n, :n])
                free, slope = b @ (a[:n, n + 1] - u0 * a[:n, n]), b @ np.ones(n)
                fit = np.append(free - slope * (free.sum() - (u1 - u0)) / slope.sum(), u0)
            else:
                fit = np.linalg.lstsq(a[: n + 1, : n + 1], a[: n + 1, n + 1], rcond=1e-12)[0]
            residual = np.append(-fit, 1.0)  # row (bits, 1, worth) . residual = worth - fit
            block = test[m : 2 * m]
            if unbiased:
                correction = residual @ block[:, 2 * m : 2 * m + n] / mass
            else:
                inside, outside = block[:, 2 * m : 2 * m + n], block[:, 2 * m + n : 2 * m + 2 * n]
                drawn_in = test[m + n, 2 * m + 2 * n : 2 * m + 3 * n]
                drawn_out = test[m + n, 2 * m + 3 * n : 2 * m + 4 * n]
                p_in = sum(v * s / n for s, v in law.items()) / sum(law.values())
                correction = np.divide(residual @ inside, drawn_in, out=np.zeros(n), where=drawn_in > 0) * p_in + np.divide(residual @ outside, drawn_out, out=np.zeros(n), where=drawn_out > 0) * (1 - p_in)
            value += mass * (fit[:n] + correction)
            weight += mass
        return value / weight

    return Fit(Law({s: v for s, v in law.items() if v > 0}), rows, width, solve, folds)


def in_fold(samples: DataFrame, folds: int, seed: int, k=None) -> DataFrame:
    """samples with fold: that of their number k."""
    return samples.withColumn("fold", F.floor(draws.uniform(F.col("k") if k is None else k, "fold", seed) * folds).cast("int"))


#: From so many players on coalitions are drawn with replacement unless that is said: equal ones are then rare.
MANY_PLAYERS = 50


def regression_msr(game, spec: Semivalue, count: int | None = None, seed: int = 0, paired: bool = False, folds: int = 10, unbiased: bool = True, replacement: bool | None = True, special: bool = True) -> DataFrame:
    """A linear surrogate per fold, corrected by the other folds' residuals.

    replacement False: distinct coalitions, whose inclusion chances take the
    place of draw chances; None: from MANY_PLAYERS on with replacement, below
    without.  special False: Shapley values too are fitted by plain least
    squares, not by the kernel through both ends.

    unbiased: the correction is the plain mean of coefficient over chance; else
    means over the samples with and without the player, each scaled by how
    often that side is drawn.  Everything needed is in the products of (bits,
    1, worth, correction terms), so one pass over the samples suffices.
    """
    n = game.n
    replacement = n >= MANY_PLAYERS if replacement is None else replacement
    if count is None:
        fit = msr_fit(game, spec, 1, unbiased, special, paired=paired)
        return _estimate(game, fit, None, seed, paired, _samples(game, fit.law, n, None, seed, paired).withColumn("fold", F.lit(0)))
    if replacement:
        fit = msr_fit(game, spec, folds, unbiased, special, paired=paired)
        return _estimate(game, fit, count, seed, paired, in_fold(_samples(game, fit.law, n, count, seed, paired), folds, seed))
    if paired and not spec.symmetric:
        raise Unsupported("pairs need a symmetric semivalue")
    law = balanced_law(spec, n)
    distinct = subsets.without_replacement(game.spark, {s: v for s, v in law.items() if v > 0}, n, count, seed, paired)
    taken = {r["s"]: (r["n"], r["chance"]) for r in distinct.groupBy("s").agg(F.count("*").alias("n"), F.first("chance").alias("chance")).collect()}
    met = sum(m for m, _ in taken.values())
    chance = np.array([taken.get(s, (0, 0.0))[1] / max(1, met) for s in range(n + 1)])
    k = F.least("mask", F.lit(game.full).bitwiseXOR(F.col("mask"))) if paired else F.col("mask")  # a pair shares its fold
    drawn = worth(game, distinct.select("mask", "s", k.alias("k"))).withColumn("w", F.lit(1.0 / max(1, met)))
    fit = msr_fit(game, spec, folds, unbiased, special, {s: float(m) for s, (m, _) in taken.items()}, chance, paired)
    return _estimate(game, fit, count, seed, paired, in_fold(drawn, folds, seed))


#: Estimators by name whose trajectory is a prefix sum of Gram matrices.
FITS: dict[str, Callable[..., Fit]] = {
    "kernel_shap": lambda game, spec, paired: kernel_fit(game, spec),
    "leverage": lambda game, spec, paired: leverage_fit(game, spec),
    "ame": ame_fit,
    "poly_shap": lambda game, spec, paired: poly_fit(game, spec),
    "regression_msr": lambda game, spec, paired: msr_fit(game, spec, unbiased=False, paired=paired),
    "regression_msr_unbiased": lambda game, spec, paired: msr_fit(game, spec, paired=paired),
}


def converged(name: str, game, spec: Semivalue, counts: list[int], seed: int = 0, paired: bool = False) -> DataFrame:
    """(ckpt, player, value): what the named estimator gives for each of the rising counts, from samples drawn, evaluated and multiplied once."""
    fit = FITS[name](game, spec, paired)
    drawn = worth(game, sample(game.spark, fit.law, game.n, counts[-1], seed, paired)).withColumn("ckpt", checkpoint(counts, paired))
    if fit.folds > 1:
        drawn = in_fold(drawn, fit.folds, seed)
    rows = fit.rows
    found = running(drawn, lambda c: [(rows(c), None)], [(fit.width, fit.width)], fit.folds, len(counts))
    values = []
    for k, (g,) in enumerate(found):
        with clock.readout():
            values += [(k, i, float(v)) for i, v in enumerate(fit.solve(g / counts[k]))]
    return game.spark.createDataFrame(values, "ckpt int, player int, value double")


# ------------------------------------------------------------------ tree surrogate


@dataclass
class Trees:
    """A sum of trees over players' bits.  Node 1 is a root, and the children of k are 2k without and 2k + 1 with the player it asks for."""

    base: float
    asked: list[np.ndarray]  # of each tree: the player by node, -1 where the node asks for none
    paid: list[np.ndarray]  # the value by node; what a node that asks would pay isn't used

    def leaf(self, tree: int, masks: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of the tree where each coalition ends, after so many levels."""
        asked = self.asked[tree]
        node = np.ones(len(masks), np.intp)
        for _ in range(len(asked).bit_length() - 2 if levels is None else levels):
            player = asked[node]
            node = np.where(player >= 0, 2 * node + ((masks >> np.maximum(player, 0)) & 1), node)
        return node

    def predict(self, masks: np.ndarray) -> np.ndarray:
        return self.base + sum((self.paid[t][self.leaf(t, masks)] for t in range(len(self.asked))), np.zeros(len(masks)))

    def leaves(self) -> list[tuple[float, int, int, float]]:
        """(1, bits required, bits excluded, value) of each leaf."""
        found = []

        def descend(t: int, node: int, need: int, bar: int) -> None:
            player = int(self.asked[t][node])
            if player < 0:
                found.append((1.0, need, bar, float(self.paid[t][node])))
            else:
                descend(t, 2 * node, need, bar | 1 << player)
                descend(t, 2 * node + 1, need | 1 << player, bar)

        for t in range(len(self.asked)):
            descend(t, 1, 0, 0)
        return found


def boosted(samples: DataFrame, n: int, trees: int, depth: int, rate: float, penalty: float, scale: float) -> Trees:
    """Second-order boosting of squared loss on samples (mask, u, w), `scale` times w being a sample's weight.

    A level is one pass: tasks sum gradients and weights by node and player,
    and the driver, from at most 2^depth by n sums, splits where the loss falls
    most.  A leaf pays the Newton step -G / (H + penalty) times the rate.
    """
    (first,) = products(samples, lambda c: [(np.ones((len(c["u"]), 1)), np.stack([c["u"], np.ones(len(c["u"]))], axis=1))], [(1, 2)])
    model = Trees(float(first[0, 0, 0] / first[0, 0, 1]) if first[0, 0, 1] else 0.0, [], [])
    size = 1 << (depth + 1)
    for t in range(trees):
        model.asked.append(np.full(size, -1))
        model.paid.append(np.zeros(size))
        for level in range(depth):
            seen = Trees(model.base, model.asked[:t], model.paid[:t])
            here = Trees(0.0, [model.asked[t].copy()], [model.paid[t]])

            def blocks(c, seen=seen, here=here, level=level):
                node = np.eye(size)[here.leaf(0, c["mask"], level)]
                with_one = np.hstack([bit_matrix(c["mask"], n), np.ones((len(node), 1))])
                return [(node * (seen.predict(c["mask"]) - c["u"])[:, None], with_one), (node, with_one)]

            gradient, weight = (scale * x[0] for x in products(samples, blocks, [(size, n + 1)] * 2))
            reached = [k for k in range(1 << level, 2 << level) if weight[k, n] > 0]
            for k in reached:
                g1, h1, g, h = gradient[k, :n], weight[k, :n], gradient[k, n], weight[k, n]
                g0, h0 = g - g1, h - h1
                gain = np.where((h1 > 1e-9 * h) & (h0 > 1e-9 * h), g1**2 / (h1 + penalty) + g0**2 / (h0 + penalty) - g**2 / (h + penalty), 0.0)
                best = int(np.argmax(gain))
                if gain[best] > 1e-9 * g**2 / (h + penalty):
                    model.asked[t][k] = best
                    model.paid[t][2 * k], model.paid[t][2 * k + 1] = -rate * g0[best] / (h0[best] + penalty), -rate * g1[best] / (h1[best] + penalty)
                if k == 1:
                    model.paid[t][1] = -rate * g / (h + penalty)
    return model


def tree_semivalue(leaves, spec: Semivalue, n: int) -> np.ndarray:
    """Semivalue of a sum of leaves: each is the game that pays its prediction where P is inside and Q outside."""
    p = spec.p(n)
    out = np.zeros(n)
    for weight, need, bar, value in leaves:
        if need & bar:
            continue
        a, b = need.bit_count(), bar.bit_count()
        free = n - a - b
        if a:
            gain = sum(comb(free, j) * p[a - 1 + j] for j in range(free + 1))
        if b:
            loss = sum(comb(free, j) * p[a + j] for j in range(free + 1))
        for i in range(n):
            if need >> i & 1:
                out[i] += weight * value * gain
            elif bar >> i & 1:
                out[i] -= weight * value * loss
    return out


def _tree_values(game, spec: Semivalue, drawn: DataFrame, chance: np.ndarray, scale: float, trees: int, depth: int, rate: float, penalty: float) -> np.ndarray:
    n = game.n
    data = drawn.select("mask", "s", "u", "w").cache()
    try:
        model = boosted(data, n, trees, depth, rate, penalty, scale)

        def rows(c):
            left = (c["u"] - model.predict(c["mask"]))[:, None]
            return [(np.hstack([np.ones((len(left), 1)), left * coefficients(spec, n, c["mask"], c["s"]) / chance[c["s"]][:, None]]), np.ones((len(left), 1)))]

        (sums,) = products(data, rows, [(n + 1, 1)])
    finally:
        data.unpersist()
    with clock.readout():
        return tree_semivalue(model.leaves(), spec, n) + sums[0, 1:, 0] / sums[0, 0, 0]


def tree_msr(game, spec: Semivalue, count: int | None = None, seed: int = 0, trees: int = 10, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> DataFrame:
    """Boosted-tree surrogate with exact leaf semivalues, corrected by the mean residual over chance."""
    law = balanced_law(spec, game.n)
    drawn = _samples(game, Law({s: v for s, v in law.items() if v > 0}), game.n, count, seed, False)
    return values_frame(game.spark, _tree_values(game, spec, drawn, coalition_chance(law, game.n), float(count or 1 << game.n), trees, depth, rate, penalty))


def trees_converged(game, spec: Semivalue, counts: list[int], seed: int = 0, paired: bool = False, trees: int = 10, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> DataFrame:
    """(ckpt, player, value): what tree_msr gives for each of the rising counts; samples are drawn and evaluated once, trees grown for each."""
    if paired:
        raise Unsupported("tree_msr draws no pairs")
    law = balanced_law(spec, game.n)
    drawn = worth(game, sample(game.spark, Law({s: v for s, v in law.items() if v > 0}), game.n, counts[-1], seed)).withColumn("w", F.lit(1.0)).cache()
    try:
        values = [_tree_values(game, spec, drawn.where(F.col("k") < c), coalition_chance(law, game.n), 1.0, trees, depth, rate, penalty) for c in counts]
    finally:
        drawn.unpersist()
    return game.spark.createDataFrame([(k, i, float(v)) for k, row in enumerate(values) for i, v in enumerate(row)], "ckpt int, player int, value double")


# ------------------------------------------------------------- two-stage, cross-fitted


@dataclass
class TwoStage:
    """Two-stage estimator with a profiled ridge surrogate, for all players or for the sum over a group.

    Stage 1 draws coalitions by the root of their squared coefficients, fits
    the surrogate, and measures residuals by size (by size and overlap for a
    group).  Stage 2 draws in proportion to what is left unexplained.  Sizes 0,
    1, n-1 and n are exact.  The estimate is cross-fitted: each fold is
    corrected with a surrogate from the others, by subtracting its statistics.
    """

    game: object
    spec: Semivalue
    group: list[int] | None = None
    basis: int | str = 1
    nonlinear: bool = True
    ridge: float = 1.0
    ridge_schedule: str = "fixed"
    folds: int = 10
    pilot_fraction: float = 0.2
    size_floor: float = 1e-8
    min_count: int = 2
    overlap_ratio: bool = True
    seed: int = 0
    pairs: bool = True

    def __post_init__(self):
        n = self.game.n
        if n < 4:
            raise Unsupported("two stages need four players or more")
        if not 0 < self.pilot_fraction < 1 or self.folds < 2 or self.ridge < 0 or self.ridge_schedule not in ("fixed", "times_m"):
            raise ValueError("bad two-stage parameters")
        # The accepted names of the two bases that aren't an order.
        names = {"none": 0, "constant": 0, "intercept": 0, "size_by_player": "size_player", "player_size": "size_player", "i_s": "size_player", "is": "size_player"}
        self.basis = names.get(self.basis, self.basis)
        self.n, self.gmask = n, exact.group_mask(self.group, n) if self.group is not None else 0
        self.g = len(self.group) if self.group else 0
        self.sizes = range(2, n - 1)
        self.sets = subsets_up_to(n, self.basis) if isinstance(self.basis, int) else []
        self.width = self.features(np.zeros(1, np.int64)).shape[1]
        self.targets = 1 if self.group is not None else n
        self.paired = self.pairs and self.group is None and self.spec.symmetric
        self.cells = self._cells()

    def __getstate__(self):  # workers get the numbers, not the game
        return {k: v for k, v in self.__dict__.items() if k != "game"}

    def features(self, masks: np.ndarray) -> np.ndarray:
        x = bit_matrix(masks, self.n)
        s = x.sum(axis=1)
        cols = [np.ones((len(x), 1))]
        if self.nonlinear:
            cols += [np.log1p(s)[:, None], ((s / self.n) ** 2)[:, None]]
        if self.group is not None and self.overlap_ratio:
            r = x[:, self.group].sum(axis=1)
            cols.append(np.divide(r, s, out=np.zeros(len(x)), where=s > 0)[:, None])
        if self.basis == "size_player":
            by_size = np.zeros((len(x), len(self.sizes), self.n))
            inner = np.flatnonzero((s >= 2) & (s <= self.n - 2))
            by_size[inner, s[inner].astype(np.intp) - 2] = x[inner]
            cols.append(by_size.reshape(len(x), -1))
        else:
            cols += monomials(x, self.sets)
        return np.hstack(cols)

    def gamma(self, masks: np.ndarray) -> np.ndarray:
        """Coefficient of each coalition in each target."""
        c = coefficients(self.spec, self.n, masks, np.bitwise_count(masks).astype(np.int64))
        return c if self.group is None else c[:, self.group].sum(axis=1, keepdims=True)

    def readout(self) -> np.ndarray:
        """Targets of each feature over the sizes 2..n-2: what the surrogate stands for."""
        n, p = self.n, np.array([0.0, *self.spec.p(self.n), 0.0])
        out = np.zeros((n, self.width))
        at = 0

        def by_size(f):  # a feature of the size alone has the same coefficient sum for everyone
            return sum((comb(n - 1, s - 1) * p[s] - comb(n - 1, s) * p[s + 1]) * f(s) for s in self.sizes)

        plain = [lambda s: 1.0] + ([lambda s: np.log1p(s), lambda s: (s / n) ** 2] if self.nonlinear else [])
        for f in plain:
            out[:, at] = by_size(f)
            at += 1
        if self.group is not None and self.overlap_ratio:
            total = sum(comb(self.g, r) * comb(n - self.g, s - r) * (r * p[s] - (self.g - r) * p[s + 1]) * r / s for s in self.sizes for r in range(max(0, s - n + self.g), min(self.g, s) + 1))
            out[self.group, at] = total / self.g  # only the sum over the group is used
            at += 1
        if self.basis == "size_player":
            for s in self.sizes:
                block = out[:, at : at + n]
                block[:] = comb(n - 2, s - 2) * p[s] - comb(n - 2, s - 1) * p[s + 1]
                np.fill_diagonal(block, comb(n - 1, s - 1) * p[s])
                at += n
        for members in self.sets:
            r = members.shape[1]
            inside = sum(comb(n - r, s - r) * p[s] for s in self.sizes if s >= r)
            outside = sum((comb(n - r - 1, s - r - 1) if s > r else 0) * p[s] - comb(n - r - 1, s - r) * p[s + 1] for s in self.sizes if s >= r)
            columns = np.arange(at, at + len(members))
            out[:, columns] = outside
            for k in range(r):
                out[members[:, k], columns] = inside
            at += len(members)
        return out if self.group is None else out[self.group].sum(axis=0, keepdims=True)

    def boundary_value(self) -> np.ndarray:
        n, full = self.n, self.game.full
        masks = sorted({0, full, *(1 << i for i in range(n)), *(full ^ (1 << i) for i in range(n))})
        asked = self.game.spark.createDataFrame([(m,) for m in masks], "mask bigint")
        rows = self.game.evaluate(asked).collect()
        m = np.array([r["mask"] for r in rows], np.int64)
        return self.gamma(m).T @ np.array([r["u"] for r in rows])

    # Laws are over cells: (size,) for individuals, (size, overlap) for a group.

    def _cells(self) -> dict[int, tuple[int, float]]:
        """cell code -> (number of coalitions, root of the squared coefficients)."""
        n, g = self.n, self.g
        if self.group is None:
            a = size_weight(self.spec, n)
            return {s: (comb(n, s), a[s] ** 0.5) for s in self.sizes}
        p = [*self.spec.p(n), 0.0]
        return {s * (g + 1) + r: (comb(g, r) * comb(n - g, s - r), abs(r * p[s - 1] - (g - r) * p[s])) for s in self.sizes for r in range(max(0, s - n + g), min(g, s) + 1)}

    def law(self, scale: dict[int, float] | None = None) -> dict[int, float]:
        """Chance of one coalition by cell."""
        raw = {c: root * ((scale or {}).get(c, 1.0)) for c, (_, root) in self.cells.items()}
        if self.paired:
            raw = {s: (raw[s] + raw[self.n - s]) / 2 for s in raw}
        raw = {c: v for c, v in raw.items() if v > 0}
        total = sum(v * self.cells[c][0] for c, v in raw.items())
        return {c: v / total for c, v in raw.items()}

    def draw(self, law: dict[int, float], count: int, salt: str) -> DataFrame:
        """(k, mask, s, q, fold) drawn by cell; a pair shares its fold."""
        spark, n, seed = self.game.spark, self.n, self.seed
        mass = {c: q * self.cells[c][0] for c, q in law.items()}
        base = spark.range(-(-count // 2) if self.paired else count).withColumnRenamed("id", "k")
        key = F.concat(F.col("k").cast("string"), F.lit(salt))
        order = draws.ranked_players(key, n, seed)
        cell = draws.draw_size(draws.uniform(key, "cell", seed), mass)
        drawn = base.select("k", cell.alias("cell"), order.alias("o"))
        if self.group is None:
            mask = draws.bits(F.slice("o", F.lit(1), F.col("cell")))
        else:
            inside = F.filter("o", lambda i: F.getbit(F.lit(self.gmask).cast("bigint"), i) == 1)
            outside = F.filter("o", lambda i: F.getbit(F.lit(self.gmask).cast("bigint"), i) == 0)
            r = (F.col("cell") % (self.g + 1)).cast("int")
            s = F.floor(F.col("cell") / (self.g + 1)).cast("int")
            mask = draws.bits(F.slice(inside, F.lit(1), r)).bitwiseOR(draws.bits(F.slice(outside, F.lit(1), s - r)))
        fold = F.floor(draws.uniform(key, "fold", seed) * self.folds).cast("int")
        out = drawn.select("k", mask.alias("mask"), fold.alias("fold"))
        if self.paired:
            out = out.select("k", "fold", F.explode(F.array("mask", F.lit(self.game.full).bitwiseXOR(F.col("mask")).cast("bigint"))).alias("mask"))
        return self.with_chance(out, law)

    def code(self, mask) -> object:
        s = F.bit_count(mask).cast("int")
        return s if self.group is None else s * (self.g + 1) + F.bit_count(mask.bitwiseAND(F.lit(self.gmask).cast("bigint"))).cast("int")

    def with_chance(self, masks: DataFrame, law: dict[int, float]) -> DataFrame:
        """masks with s and q, looked up by cell in one array; null where the law has no such cell."""
        by_cell = ", ".join(number(law[c]) if c in law else "cast(null AS double)" for c in range(max(law) + 1))
        return masks.withColumn("s", F.bit_count("mask").cast("int")).withColumn("q", F.get(F.expr(f"array({by_cell})"), self.code(F.col("mask"))))

    def blocks(self):
        """Left and right factors, and their shapes, of what fit and correction need: the weighted fit, targets by features, the number of samples."""
        features, gamma_of, d, t = self.features, self.gamma, self.width, self.targets
        if self.basis == "size_player":
            return self._blocks_by_size, [(d + 1, d + 1), (t, d + 2), (1, 1)]

        def factors(c):
            z = np.hstack([features(c["mask"]), c["u"][:, None], np.ones((len(c["u"]), 1))])
            gamma = gamma_of(c["mask"]) / c["q"][:, None]
            weight = np.sqrt((gamma**2).sum(axis=1))
            return [(z[:, :-1] * weight[:, None], None), (gamma, z), (z[:, -1:], None)]

        return factors, [(d + 1, d + 1), (t, d + 2), (1, 1)]

    def _blocks_by_size(self, c):
        """The same for players by size: rows of one size touch the columns of that size alone, so they are multiplied by themselves."""
        n, d, x, s = self.n, self.width, bit_matrix(c["mask"], self.n), np.bitwise_count(c["mask"]).astype(np.intp)
        before = d - n * len(self.sizes)  # features of the size and of the overlap
        plain = np.hstack([np.ones((len(s), 1)), *([np.log1p(s)[:, None], ((s / n) ** 2)[:, None]] if self.nonlinear else []), *([x[:, self.group].sum(axis=1, keepdims=True) / s[:, None]] if self.group is not None and self.overlap_ratio else [])])
        z = np.hstack([plain, x, c["u"][:, None], np.ones((len(s), 1))])
        gamma = self.gamma(c["mask"]) / c["q"][:, None]
        weighted = z[:, :-1] * np.sqrt((gamma**2).sum(axis=1))[:, None]
        fit, cross, targets = [], [], np.arange(self.targets)
        for size in np.unique(s).tolist():
            at = np.flatnonzero(s == size)
            columns = np.concatenate([np.arange(before), before + (size - 2) * n + np.arange(n), [d, d + 1]])
            fit.append((weighted[at], None, at, columns[:-1], columns[:-1]))
            cross.append((gamma[at], z[at], at, targets, columns))
        return [fit, cross, (z[:, -1:], None)]

    def statistics(self, evaluated: DataFrame) -> list[np.ndarray]:
        """Per fold the products that fit and correction need."""
        return products(evaluated, *self.blocks(), self.folds)

    def parts(self, stats: list[np.ndarray]):
        """A, c (weighted fit), B, b (targets) and the number of samples, of one fold or of sums over folds."""
        fit, cross, count = stats
        d = self.width
        return fit[:d, :d], fit[:d, d], cross[:, :d], cross[:, d], count[0, 0]

    def fit(self, stats: list[np.ndarray]) -> np.ndarray:
        """Ridge whose objective is the variance left once the mean of the targets' residuals is profiled out."""
        a, c, bz, by, m = self.parts(stats)
        lam = self.ridge * (m if self.ridge_schedule == "times_m" else 1.0)
        left, right = a - bz.T @ bz / m + lam * np.eye(self.width), c - bz.T @ by / m
        try:
            return np.linalg.solve(left, right)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(left, right, rcond=None)[0]

    def combine(self, stats: list[np.ndarray], boundary: np.ndarray, zeta: np.ndarray | None = None) -> np.ndarray:
        with clock.readout():
            total, zeta = [x.sum(axis=0) for x in stats], self.readout() if zeta is None else zeta
            value, weight = np.zeros(self.targets), 0.0
            for f in range(self.folds):
                _, _, bz, by, m = self.parts([x[f] for x in stats])
                if m <= 0:
                    continue
                others = [x - y[f] for x, y in zip(total, stats, strict=True)]
                beta = self.fit(others if others[2][0, 0] > 0 else total)
                value += m * (zeta @ beta) + by - bz @ beta
                weight += m
            return boundary + (value / weight if weight else 0.0)

    def residual_law(self, evaluated: DataFrame, beta: np.ndarray) -> dict[int, float]:
        """Stage 2: chances by the root of squared coefficients times the mean squared residual of the cell."""
        features = self.features
        ship(self.game.spark)

        def residuals(batches):
            import pyarrow as pa

            for batch in batches:
                masks = batch.column(0).to_numpy()
                r = batch.column(1).to_numpy() - features(masks) @ beta
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(r), batch.column(3)], names=["mask", "k", "r", "w"])

        seen = evaluated.select("mask", "u", F.col("k").cast("bigint").alias("k"), F.lit(1.0).alias("w")).mapInArrow(residuals, "mask bigint, k bigint, r double, w double")
        if self.paired:  # a pair's two residuals enter with opposite signs, so only their difference counts, for both sizes
            difference = seen.groupBy("k").agg(F.max_by("r", "mask").alias("a"), F.min_by("r", "mask").alias("b"), F.collect_list("mask").alias("m"))
            seen = difference.select(F.explode("m").alias("mask"), (F.col("a") - F.col("b")).alias("r"))
        moments = seen.groupBy(self.code(F.col("mask")).alias("cell")).agg(F.avg(F.col("r") * F.col("r")).alias("v"), F.count("*").alias("n")).collect()
        overall = sum(r["v"] * r["n"] for r in moments) / max(1, sum(r["n"] for r in moments))
        by_cell = {r["cell"]: max(1e-12, r["v"]) for r in moments if r["n"] >= self.min_count}
        moved = self.law({c: by_cell.get(c, max(1e-12, overall)) ** 0.5 for c in self.cells})
        pilot = self.law()
        return {c: (1 - self.size_floor) * moved.get(c, 0.0) + self.size_floor * pilot.get(c, 0.0) for c in pilot}

    def estimate(self, count: int, pilot: int | None = None) -> np.ndarray:
        """From `count` evaluations, those of the boundary included; no more interior ones than are left.  pilot: how many of these stage 1 takes."""
        return self.trajectory([count], pilot)[0]

    def trajectory(self, counts: list[int], pilot: int | None = None) -> np.ndarray:
        """The estimates after each of the rising counts of evaluations, a row each, from one run of both stages.

        Stage 1 is sized by the last count, unless `pilot` says how many it
        takes; a checkpoint sees the samples drawn so far, those of the boundary
        first.  Sums per checkpoint and fold are added up in turn.
        """
        left = [max(2, c - 2 * self.n - 2) for c in counts]
        pilot = max(2, int(left[-1] * self.pilot_fraction)) if pilot is None else min(pilot, left[-1])
        factors, shapes = self.blocks()
        steps, boundary, zeta = len(counts), self.boundary_value(), self.readout()
        in_first, in_second = [min(pilot, x) for x in left], [max(0, x - pilot) for x in left]
        first = worth(self.game, self.draw(self.law(), pilot, "a").withColumn("ckpt", checkpoint(in_first, self.paired))).cache()
        try:
            seen = list(running(first, factors, shapes, self.folds, steps)) if steps > 1 else [self.statistics(first)]
            if left[-1] > pilot:
                second_law = self.residual_law(first, self.fit([x.sum(axis=0) for x in seen[-1]]))
        finally:
            first.unpersist()
        if left[-1] <= pilot:
            return np.stack([self.combine(x, boundary, zeta) for x in seen])
        second = worth(self.game, self.draw(second_law, left[-1] - pilot, "b").withColumn("ckpt", checkpoint(in_second, self.paired)))
        later = running(second, factors, shapes, self.folds, steps) if steps > 1 else [self.statistics(second)]
        return np.stack([self.combine([a + b for a, b in zip(x, y, strict=True)], boundary, zeta) for x, y in zip(seen, later, strict=True)])

    def exact(self) -> np.ndarray:
        """The estimate over the whole population of stage 1: the exact values."""
        law = self.law()
        masks = self.game.spark.range(1 << self.n).select(F.col("id").alias("mask")).where(F.bit_count("mask").between(2, self.n - 2))
        masks = self.with_chance(masks, law).where("q is not null").withColumn("fold", F.pmod(F.crc32(F.col("mask").cast("string").cast("binary")), F.lit(self.folds)).cast("int"))
        total = [x.sum(axis=0) for x in self.statistics(worth(self.game, masks).withColumn("w", F.col("q")))]
        _, _, bz, by, m = self.parts(total)
        beta = self.fit(total)
        return self.boundary_value() + self.readout() @ beta + (by - bz @ beta) / m

    def frame(self, values: np.ndarray) -> DataFrame:
        if self.group is None:
            return values_frame(self.game.spark, values)
        return self.game.spark.createDataFrame([(float(values[0]),)], "value double")
