"""One entry to every estimator by name, with a budget in evaluations per player and checkpoints."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrispark.functions import clock
from attrispark.functions.spec import Semivalue
from attrispark.operators import estimators as est
from attrispark.operators import exact, groups, regression, transform
from attrispark.sources import games


@dataclass(frozen=True)
class Entry:
    """run(game, spec, samples, seed, paired) -> (player, value); cost: evaluations of one sample among n players."""

    run: Callable
    cost: Callable[[int], float] = lambda n: 1


def _solved(function: Callable, **options) -> Entry:
    return Entry(lambda g, c, m, seed, paired: function(g, c, count=m, seed=seed, paired=paired, **options))


def _two_stage(game, spec, samples, seed, paired) -> DataFrame:
    stage = regression.TwoStage(game, spec, seed=seed, pairs=paired or spec.symmetric)
    return regression.values_frame(game.spark, stage.estimate(samples))


def _tree(game, spec, samples, seed, paired) -> DataFrame:
    if paired:
        raise est.Unsupported("tree_msr draws no pairs")
    return regression.tree_msr(game, spec, samples, seed)


def _strata(name: str) -> Callable:
    return lambda game, spec, samples, seed, paired: est._strata_value(est.STRATA[name](game, spec, samples, seed, paired))


def _exact(game, spec) -> DataFrame:
    """By all coalitions: tabulated, or in strips where a game of terms has too many for a table."""
    large = isinstance(game, games.TermsGame) and game.n > games.TABLE_PLAYERS
    return transform.exact(game, spec) if large else exact.enumerated(game, spec)


REGISTRY: dict[str, Entry] = {
    "exact": Entry(lambda g, c, m, seed, paired: _exact(g, c)),
    **{name: Entry(lambda g, c, m, seed, paired, name=name: est.estimate(name, g, c, m, seed, paired), (lambda n: 2) if rule.outside_law else (lambda n: 1)) for name, rule in est.RULES.items()},
    **{name: Entry(lambda g, c, m, seed, paired, name=name: est.estimate_marginal(name, g, c, m, seed, paired), lambda n: 2 * n) for name in est.MARGINAL},
    **{name: Entry(lambda g, c, m, seed, paired, name=name: est.one_for_all(name, g, c, m, seed, paired)) for name in est.OFA_SIZES},
    "ofa_baseline": Entry(lambda g, c, m, seed, paired: est.one_for_all_baseline(g, c, m, seed, paired), lambda n: 2 * n),
    "permutation": Entry(lambda g, c, m, seed, paired: est.permutation(g, c, m, seed, paired), lambda n: n),
    "complement": Entry(_strata("complement"), lambda n: 2),
    "kernel_shap": _solved(regression.kernel_shap),
    "leverage": _solved(regression.leverage),
    "ame": _solved(regression.ame),
    "poly_shap": Entry(lambda g, c, m, seed, paired: regression.poly_shap(g, c, 2, m, seed, paired)),
    "regression_msr": _solved(regression.regression_msr, unbiased=False),
    "regression_msr_unbiased": _solved(regression.regression_msr),
    "tree_msr": Entry(_tree),
    "two_stage": Entry(_two_stage),
}


def samples_for(name: str, n: int, per_player: int) -> int:
    """Samples that a budget of evaluations per player buys; those of the boundary that an estimator needs anyway are free, except for two_stage."""
    return max(1, int(per_player * n / REGISTRY[name].cost(n)))


def run(game, name: str, spec: Semivalue, per_player: int, seed: int = 0, paired: bool = False, group: list[int] | None = None) -> DataFrame:
    """(player, value), or (value) for a group."""
    if name not in REGISTRY:
        raise KeyError(f"no estimator {name!r}; there are {', '.join(sorted(REGISTRY))}")
    count = samples_for(name, game.n, per_player)
    if group is None:
        return REGISTRY[name].run(game, spec, count, seed, paired)
    if name == "two_stage":
        stage = regression.TwoStage(game, spec, group=group, seed=seed)
        return stage.frame(stage.estimate(count))
    if name == "exact":
        large = isinstance(game, games.TermsGame) and game.n > games.TABLE_PLAYERS
        return (transform.exact_group if large else exact.group_sum)(game, spec, group)
    exact.group_mask(group, game.n)
    return groups.summed(REGISTRY[name].run(game, spec, count, seed, paired), group)


#: Estimators of a group's sum by name: a name of REGISTRY, and whether pairs are drawn (None: where the semivalue is symmetric).
GROUP_NAMES: dict[str, tuple[str, bool | None]] = {
    "two_stage": ("two_stage", None),
    "individual_regression_msr_unbiased": ("regression_msr_unbiased", None),
    "individual_regression_msr_unbiased_unpaired": ("regression_msr_unbiased", False),
    "individual_ofa_fixed": ("ofa_fixed", False),
}


def run_group(game, name: str, spec: Semivalue, per_player: int, group: list[int], seed: int = 0) -> DataFrame:
    """(value): the sum of a group's values, by its own two stages, by strata, or by an estimator of individual values bound to its options."""
    if name == "strata":
        return strata_group(game, spec, group, per_player, seed=seed)
    if name not in GROUP_NAMES:
        raise KeyError(f"no estimator of groups {name!r}; there are {', '.join(sorted([*GROUP_NAMES, 'strata']))}")
    bound, pairs = GROUP_NAMES[name]
    return run(game, bound, spec, per_player, seed, spec.symmetric if pairs is None else pairs, group)


def converge(game, name: str, spec: Semivalue, per_player: int, every: int, seed: int = 0, paired: bool = False, group: list[int] | None = None) -> DataFrame:
    """(ckpt, evaluations[, player], value): the estimate after each `every` evaluations per player.

    Samples are nested: a checkpoint's are the first of the next one's.  They
    are drawn and evaluated once.  Means, strata and Gram matrices have partial
    sums per checkpoint, and what follows adds those up; two_stage is one run
    whose pilot is sized by the whole budget; trees are grown anew from the
    samples kept, as nothing of them can be added up.
    """
    steps = range(every, per_player + 1, every)
    if not steps:
        raise ValueError("no checkpoint within the budget")
    if name not in REGISTRY:
        raise KeyError(f"no estimator {name!r}; there are {', '.join(sorted(REGISTRY))}")
    counts = [samples_for(name, game.n, b) for b in steps]
    spark = game.spark
    if name == "two_stage":
        stage = regression.TwoStage(game, spec, group=group, seed=seed, pairs=paired or spec.symmetric)
        found = stage.trajectory(counts)
        rows = [(k, i, float(v)) for k, row in enumerate(found) for i, v in enumerate(row)]
        frame = spark.createDataFrame(rows, "ckpt int, player int, value double")
        frame = frame if group is None else frame.select("ckpt", "value")
    else:
        if name == "exact":
            frame = _exact(game, spec).withColumn("ckpt", F.explode(F.sequence(F.lit(0), F.lit(len(counts) - 1)))).select("ckpt", "player", "value")
        elif name == "tree_msr":
            frame = regression.trees_converged(game, spec, counts, seed, paired)
        elif name in regression.FITS:
            frame = regression.converged(name, game, spec, counts, seed, paired)
        else:
            frame = est.converged(name, game, spec, counts, seed, paired)
        if group is not None:
            exact.group_mask(group, game.n)
            frame = groups.summed(frame, group)
    return frame.withColumn("evaluations", (F.col("ckpt") + 1) * (every * game.n))


def timed(game, name: str, spec: Semivalue, per_player: int, seed: int = 0, paired: bool = False) -> tuple[list, float]:
    """The rows of a run and the seconds it took."""
    began = time.monotonic()
    rows = run(game, name, spec, per_player, seed, paired).collect()
    return rows, time.monotonic() - began


@dataclass(frozen=True)
class Phases:
    """Seconds of a run: all of it, drawing, evaluating and summing (regular), and the solves (readout); and the evaluations it was given."""

    elapsed: float
    regular: float
    readout: float
    evaluations: int


def phases(game, name: str, spec: Semivalue, per_player: int, seed: int = 0, paired: bool = False, group: list[int] | None = None, every: int | None = None) -> tuple[list, Phases]:
    """The rows of `run`, or of `converge` where `every` is given, and the seconds of its phases.

    The run's jobs carry its name as their group, so the listeners and pages of
    a session tell them apart.  Estimators without a solve read their values
    out in the query itself, which counts as regular.
    """
    sc = game.spark.sparkContext
    sc.setJobGroup(f"attrispark {name}", f"{name}, {spec}, {per_player} evaluations a player")
    try:
        with clock.watch() as took:
            made = run(game, name, spec, per_player, seed, paired, group) if every is None else converge(game, name, spec, per_player, every, seed, paired, group)
            rows = made.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    return rows, Phases(**took, evaluations=per_player * game.n)


def strata_group(game, spec: Semivalue, group: list[int], per_player: int, threshold: int = 5, seed: int = 0) -> DataFrame:
    """(value) by strata of size and overlap, the budget dealt evenly over them."""
    cells = max(1, len(groups._strata(game.n, len(group), threshold)))
    return groups.strata_shapley(game, spec, group, threshold, max(1, per_player * game.n // cells), seed)
