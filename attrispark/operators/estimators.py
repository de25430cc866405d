"""Estimators of semivalues whose statistic is an aggregate over sampled coalitions.

An estimator is a sampling law and a per-sample statistic.  The statistic is
one SQL expression of the player's bit x, the coalition's size s, its worth u
and the worths u0, u1 of no player and of all; weights by size are constant
CASE tables.  All players are aggregated in one pass over the samples, in as
many columns as there are players, so nothing is exploded or shuffled but one
partial row per task.

Samples come from counters (see functions.draws); coalitions are evaluated
once per distinct mask and joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrispark.functions import draws
from attrispark.functions.spec import BANZHAF, SHAPLEY, Semivalue, by_size, number


class Unsupported(ValueError):
    """The estimator doesn't support the semivalue."""


# ---------------------------------------------------------------- sampling laws


@dataclass(frozen=True)
class Law:
    """How a coalition is drawn.

    sizes: a law over sizes, then a uniform set of that size.
    coin: each player joins with probability t; t is a number, "uniform", or
    ("beta", a, b): whole a and b take the a-th smallest of a + b - 1 uniforms,
    real ones a ratio of gamma variates.
    """

    sizes: dict[int, float] | None = None
    coin: float | str | tuple | None = None


def kernel_sizes(n: int) -> dict[int, float]:
    return {s: 1.0 / (s * (n - s)) for s in range(1, n)}


def even_sizes(lo: int, hi: int) -> dict[int, float]:
    return {s: 1.0 for s in range(lo, hi + 1)}


def coin_of(spec: Semivalue) -> Law:
    """t fixed for weighted Banzhaf, uniform for Shapley, Beta(beta, alpha) for Beta-Shapley."""
    if spec.kind == "weighted_banzhaf":
        return Law(coin=spec.params[0])
    if spec.kind == "shapley":
        return Law(coin="uniform")
    a, b = spec.params
    return Law(coin=("beta", b, a))


def sample(spark, law: Law, players: int, count: int, seed: int, paired: bool = False, salt: str = "") -> DataFrame:
    """(k, side, mask, s, t): count coalitions; paired: half as many, each followed by its complement."""
    base = spark.range(-(-count // 2) if paired else count).withColumnRenamed("id", "k")
    k = F.concat(F.col("k").cast("string"), F.lit(salt)) if salt else F.col("k")
    if law.sizes is not None:
        size = draws.draw_size(draws.uniform(k, "size", seed), law.sizes)
        chosen = base.select("k", size.alias("s"), F.lit(None).cast("double").alias("t")).withColumn("mask", draws.bits(F.slice(draws.ranked_players(k, players, seed), F.lit(1), F.col("s"))))
    else:
        if law.coin == "uniform":
            t = draws.uniform(k, "t", seed)
        elif isinstance(law.coin, tuple):
            _, a, b = law.coin
            if a == int(a) and b == int(b):  # an order statistic
                t = F.element_at(F.array_sort(F.array(*[draws.uniform(k, f"t{j}", seed) for j in range(int(a + b) - 1)])), int(a))
            else:
                t = draws.beta_variate(k, a, b, seed)
        else:
            t = F.lit(float(law.coin))
        flips = F.aggregate(
            F.sequence(F.lit(0), F.lit(players - 1)),
            F.lit(0).cast("bigint"),
            lambda m, i: F.when(draws.uniform(k, i, seed) < F.col("t"), m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(m),
        )
        chosen = base.select("k", t.alias("t")).withColumn("mask", flips).withColumn("s", F.bit_count("mask"))
    chosen = chosen.select("k", F.lit(0).alias("side"), "mask", "s", "t")
    if not paired:
        return chosen
    full = (1 << players) - 1
    other = F.struct(F.lit(1).alias("side"), F.lit(full).bitwiseXOR(F.col("mask")).cast("bigint").alias("mask"), (players - F.col("s")).cast("int").alias("s"), (1 - F.col("t")).alias("t"))
    return chosen.select("k", F.explode(F.array(F.struct("side", "mask", F.col("s").cast("int").alias("s"), "t"), other)).alias("e")).select("k", "e.*")


def population(spark, law: Law, players: int) -> DataFrame:
    """(mask, s, weight): every coalition with its probability under a law over sizes or a fixed coin."""
    masks = spark.range(1 << players).select(F.col("id").alias("mask"), F.bit_count("id").cast("int").alias("s"))
    if law.sizes is not None:
        total = sum(law.sizes.values())
        weights = [law.sizes.get(s, 0.0) / total / comb(players, s) for s in range(players + 1)]
    else:
        t = float(law.coin)
        weights = [t**s * (1 - t) ** (players - s) for s in range(players + 1)]
    return masks.withColumn("weight", F.expr(by_size(weights))).where("weight > 0")


def worth(game, samples: DataFrame, null_player: bool = False) -> DataFrame:
    """samples with u; a null player's bit is taken off before the game sees the mask."""
    in_place = getattr(game, "attach", lambda *_: None)
    if not null_player:
        found = in_place(samples)
        return samples.join(game.evaluate(samples), "mask") if found is None else found
    bare = samples.withColumn("bare", F.col("mask").bitwiseAND(F.lit(game.full)))
    found = in_place(bare, "bare")
    if found is None:
        found = bare.join(game.evaluate(bare.select(F.col("bare").alias("mask"))).withColumnRenamed("mask", "bare"), "bare")
    return found.drop("bare")


# ------------------------------------------------------------ mean and ratio rows


@dataclass(frozen=True)
class Rule:
    """One estimator of the aggregate kind.

    inside/outside: with outside None, the value is the mean of `inside`; else
    the mean of `inside` over samples with the player less that of `outside`
    over those without, an empty side counting 0.  readout: SQL of the raw
    value v, the sum `total` of all raw values, u0, u1 (and v_null).
    """

    law: Callable[[Semivalue, int], Law]
    inside: Callable[[Semivalue, int], str]
    outside: Callable[[Semivalue, int], str] | None = None
    readout: Callable[[Semivalue, int], str] = lambda spec, n: "v"
    supports: Callable[[Semivalue], bool] = lambda spec: True
    null_player: bool = False
    pairable: Callable[[Semivalue], bool] = lambda spec: True
    outside_law: Callable[[Semivalue, int], Law] | None = None


def _shapley(spec: Semivalue) -> bool:
    return spec.is_shapley


def _not_shapley(spec: Semivalue) -> bool:
    return not spec.is_shapley


def _half(spec: Semivalue) -> bool:
    return spec == BANZHAF


def _before(values: list[float], factor: float = 1.0) -> str:
    """Weight of the size less one."""
    return by_size([v * factor for v in values], first=1)


def _at(values: list[float], factor: float = 1.0) -> str:
    return by_size([v * factor for v in values])


def _harmonic(n: int) -> float:
    return sum(1.0 / k for k in range(1, n))


def _pair_mass(n: int) -> float:
    return sum(1.0 / (s * (n - s)) for s in range(1, n))


def _target(n: int) -> str:
    return f"(u - u0 - (u1 - u0) * s / {number(n)})"


def _left_sizes(spec: Semivalue, n: int) -> dict[int, float]:
    return {s: w / s for s, w in enumerate(spec.d(n), start=1)}


def _right_sizes(spec: Semivalue, n: int) -> dict[int, float]:
    return {s: w / (n - s) for s, w in enumerate(spec.d(n))}


def _link_sizes(spec: Semivalue, n: int) -> dict[int, float]:
    """Sizes over n players plus a null player whose inclusion contrasts give the semivalue."""
    return {s: w / (s * (n + 1 - s)) for s, w in enumerate(spec.d(n), start=1)}


def _link_scale(spec: Semivalue, n: int) -> float:
    return sum(n * w / (n - s) for s, w in enumerate(spec.d(n)))


_CENTRED = "(x - s / {n})"

RULES: dict[str, Rule] = {
    "msr": Rule(lambda c, n: Law(coin=c.params[0]), lambda c, n: "u", lambda c, n: "u", supports=lambda c: c.kind == "weighted_banzhaf", pairable=_half),
    "improved_ame": Rule(lambda c, n: coin_of(c), lambda c, n: "u * (x / t - (1e0 - x) / (1e0 - t))", pairable=lambda c: c.symmetric),
    "weighted_msr": Rule(lambda c, n: Law(coin=0.5), lambda c, n: f"u * {_before(c.p(n), 2.0 ** (n - 1))}", lambda c, n: f"u * {_at(c.p(n), 2.0 ** (n - 1))}", supports=lambda c: not _half(c)),
    "modified_leverage": Rule(lambda c, n: Law(even_sizes(1, n - 1)), lambda c, n: f"{number(n - 1)} / (s * ({number(n)} - s)) * {_target(n)} * {_CENTRED.format(n=number(n))}", readout=lambda c, n: f"{number(n)} * v - total + (u1 - u0) / {number(n)}", supports=_shapley),
    "test_leverage": Rule(lambda c, n: Law(kernel_sizes(n)), lambda c, n: f"{number(_pair_mass(n))} * {_target(n)} * {_CENTRED.format(n=number(n))}", readout=lambda c, n: f"{number(n)} * v - total + (u1 - u0) / {number(n)}", supports=_shapley),
    "unbiased_kernel_shap": Rule(lambda c, n: Law(kernel_sizes(n)), lambda c, n: f"{_CENTRED.format(n=number(n))} * (u - u0)", readout=lambda c, n: f"(u1 - u0) / {number(n)} + {number(2 * _harmonic(n))} * v", supports=_shapley),
    "arm": Rule(lambda c, n: Law(_left_sizes(c, n)), lambda c, n: "u", lambda c, n: "u", outside_law=lambda c, n: Law(_right_sizes(c, n)), pairable=lambda c: False),
    "arm_shapley": Rule(lambda c, n: Law(_left_sizes(SHAPLEY, n)), lambda c, n: f"u * {_before(c.d(n), n)}", lambda c, n: f"u * {_at(c.d(n), n)}", outside_law=lambda c, n: Law(_right_sizes(SHAPLEY, n)), supports=_not_shapley, pairable=lambda c: False),
    "arm_banzhaf": Rule(lambda c, n: Law(_left_sizes(BANZHAF, n)), lambda c, n: f"u * {_before(c.p(n), 2.0 ** (n - 1))}", lambda c, n: f"u * {_at(c.p(n), 2.0 ** (n - 1))}", outside_law=lambda c, n: Law(_right_sizes(BANZHAF, n)), pairable=lambda c: False),
    "group_testing": Rule(lambda c, n: Law({s: 1 / s + 1 / (n + 1 - s) for s in range(1, n + 1)}), lambda c, n: "u * x", readout=lambda c, n: f"{number(sum(1 / s + 1 / (n + 1 - s) for s in range(1, n + 1)))} * (v - v_null)", supports=_shapley, null_player=True),
    "gels_ranking": Rule(lambda c, n: Law(_link_sizes(c, n - 1)), lambda c, n: "u", lambda c, n: "0e0", pairable=lambda c: c.symmetric),
    "gels": Rule(lambda c, n: Law(_link_sizes(c, n)), lambda c, n: "u", lambda c, n: "0e0", readout=lambda c, n: f"{number(_link_scale(c, n))} * (v - v_null)", null_player=True, pairable=lambda c: c.symmetric),
    "wgels_shapley": Rule(lambda c, n: Law(_link_sizes(SHAPLEY, n)), lambda c, n: f"u * (CASE WHEN x_null = 1 THEN {by_size([v * n for v in c.d(n)], column='(s - 1)')} ELSE {_before(c.d(n), n)} END)", lambda c, n: "0e0", readout=lambda c, n: f"{number(_link_scale(SHAPLEY, n))} * (v - v_null)", supports=_not_shapley, null_player=True),
    "wgels_banzhaf": Rule(lambda c, n: Law(_link_sizes(BANZHAF, n)), lambda c, n: f"u * (CASE WHEN x_null = 1 THEN {by_size([v * 2.0 ** (n - 1) for v in c.p(n)], column='(s - 1)')} ELSE {_before(c.p(n), 2.0 ** (n - 1))} END)", lambda c, n: "0e0", readout=lambda c, n: f"{number(_link_scale(BANZHAF, n))} * (v - v_null)", supports=lambda c: not _half(c), null_player=True),
    "gels_shapley": Rule(lambda c, n: Law(kernel_sizes(n)), lambda c, n: "u", lambda c, n: "0e0", readout=lambda c, n: f"{number(_harmonic(n))} * v + (u1 - u0 - {number(_harmonic(n))} * total) / {number(n)}", supports=_shapley),
    "sim_shap": Rule(lambda c, n: Law(kernel_sizes(n)), lambda c, n: f"{number(_pair_mass(n))} * (({number(n)} - s) * x - s * (1e0 - x)) * u", readout=lambda c, n: f"v + (u1 - u0) / {number(n)}", supports=_shapley),
    "shap_iq": Rule(lambda c, n: Law(kernel_sizes(n)), lambda c, n: f"(x * ({number(n)} - s) * {_before(c.d(n))} - (1e0 - x) * s * {_at(c.d(n))}) * (u - u0)", readout=lambda c, n: f"(u1 - u0) * {number(c.d(n)[-1])} + {number(2 * _harmonic(n))} * v"),
}


def _bit(i: int) -> str:
    return f"cast(getbit(mask, {i}) AS double)"


def _column(stat: str, i: int, null: int | None) -> str:
    """The statistic of player i over the columns mask, s, u, u0, u1, t."""
    import re

    out = re.sub(r"\bx_null\b", _bit(null), stat) if null is not None else stat
    return re.sub(r"\bx\b", _bit(i), out)


def aggregate_rule(rule: Rule, spec: Semivalue, game, left: DataFrame, right: DataFrame | None, weight: str | None = None) -> DataFrame:
    """(player, value) from evaluated samples; weight: a probability per row instead of equal weights."""
    n = game.n
    slots = n + 1 if rule.null_player else n
    null = n if rule.null_player else None
    u0, u1 = game.bounds()
    bounds = {"u0": F.lit(u0), "u1": F.lit(u1)}

    def mean(stat: str, i: int, side: int | None) -> Column:
        value = F.expr(_column(stat, i, null))
        if side is None:
            return F.sum(value * F.col(weight)) / F.sum(weight) if weight else F.avg(value)
        hit = F.getbit("mask", F.lit(i)) == side
        if weight:
            mass = F.sum(F.when(hit, F.col(weight)))
            return F.coalesce(F.try_divide(F.sum(F.when(hit, value * F.col(weight))), mass), F.lit(0.0))
        return F.coalesce(F.avg(F.when(hit, value)), F.lit(0.0))

    inside = rule.inside(spec, n)
    outside = rule.outside(spec, n) if rule.outside else None
    first = left.withColumns(bounds).agg(F.array(*[mean(inside, i, None if outside is None else 1) for i in range(slots)]).alias("a"))
    if outside is not None and outside != "0e0":
        second = (right if right is not None else left).withColumns(bounds).agg(F.array(*[mean(outside, i, 0) for i in range(slots)]).alias("b"))
        first = first.crossJoin(second).select(F.zip_with("a", "b", lambda x, y: x - y).alias("a"))
    return _read_out(rule, spec, n, first, bounds)


def _read_out(rule: Rule, spec: Semivalue, n: int, means: DataFrame, bounds: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, player, value) from rows of keys and an array a of means per slot."""
    null = [F.element_at("a", n + 1).alias("v_null")] if rule.null_player else []
    raw = means.select(*keys, F.slice("a", 1, n).alias("a"), *null)
    raw = raw.withColumn("total", F.aggregate("a", F.lit(0.0), lambda s, x: s + x)).withColumns(bounds)
    return raw.select(F.posexplode("a").alias("player", "v"), *[c for c in raw.columns if c != "a"]).select(*keys, "player", F.expr(rule.readout(spec, n)).alias("value"))


def checkpoint(counts: list[int], paired: bool = False) -> Column:
    """The first checkpoint that holds sample k, of rising counts of samples."""
    ends = ", ".join(f"{-(-c // 2) if paired else c}L" for c in counts)
    return F.size(F.filter(F.expr(f"array({ends})"), lambda b: b <= F.col("k"))).alias("ckpt")


def _running(parts: DataFrame, slots: int, checkpoints: int) -> DataFrame:
    """(ckpt, slot, m): running means at every checkpoint from sums s and counts c by checkpoint; 0 before there is a sample."""
    grid = parts.sparkSession.range(checkpoints).select(F.col("id").cast("int").alias("ckpt"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    run = Window.partitionBy("slot").orderBy("ckpt").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(parts, ["ckpt", "slot"], "left").select("ckpt", "slot", F.coalesce(F.try_divide(F.sum("s").over(run), F.sum("c").over(run)), F.lit(0.0)).alias("m"))


def converged(name: str, game, spec: Semivalue, counts: list[int], seed: int = 0, paired: bool = False) -> DataFrame:
    """(ckpt, player, value): what the named estimator gives for each of the rising counts, from one pass.

    Samples are drawn and evaluated once; each checkpoint has partial sums of
    its own, and a running sum over them is all that follows.
    """
    n = game.n
    if name in STRATA:
        strata = STRATA[name](game, spec, counts[-1], seed, paired)
        return _strata_running(strata, n, counts, paired)
    if name == "permutation":
        drawn = prefix_marginals(game, permutations(game.spark, n, counts[-1], seed, paired)).withColumn("_v", F.col("delta") * F.expr(_by_place(spec, n)))
        parts = drawn.groupBy(checkpoint(counts, paired), F.col("player").alias("slot")).agg(F.sum("_v").alias("s"), F.count("*").alias("c"))
        return _running(parts, n, len(counts)).select("ckpt", F.col("slot").alias("player"), F.col("m").alias("value"))
    if name in MARGINAL:
        law, weight, supports = MARGINAL[name]
        if not supports(spec) or paired and name == "sampling_lift" and not spec.symmetric:
            raise Unsupported(f"{name} doesn't estimate {spec}" + " from pairs" * paired)
        drawn = marginals(game, sample(game.spark, law(spec), n, counts[-1], seed, paired)).withColumn("_v", F.col("delta") * F.expr(weight(spec, n)))
        parts = drawn.groupBy(checkpoint(counts, paired), F.col("player").alias("slot")).agg(F.sum("_v").alias("s"), F.count("*").alias("c"))
        return _running(parts, n, len(counts)).select("ckpt", F.col("slot").alias("player"), F.col("m").alias("value"))
    rule = RULES[name]
    if not rule.supports(spec) or paired and not rule.pairable(spec):
        raise Unsupported(f"{name} doesn't estimate {spec}" + " from pairs" * paired)
    slots = n + rule.null_player
    null = n if rule.null_player else None
    u0, u1 = game.bounds()
    bounds = {"u0": F.lit(u0), "u1": F.lit(u1)}

    def drawn(law: Law, salt: str = "") -> DataFrame:
        return worth(game, sample(game.spark, law, slots, counts[-1], seed, paired, salt), rule.null_player).withColumns(bounds)

    def means(rows: DataFrame, stat: str, side: int | None) -> DataFrame:
        def part(i: int) -> Column:
            value = F.expr(_column(stat, i, null))
            value = value if side is None else F.when(F.getbit("mask", F.lit(i)) == side, value)
            return F.struct(F.sum(value).alias("s"), F.count(value).alias("c"))

        sums = rows.groupBy(checkpoint(counts, paired)).agg(F.array(*[part(i) for i in range(slots)]).alias("a"))
        return _running(sums.select("ckpt", F.posexplode("a").alias("slot", "x")).select("ckpt", "slot", "x.*"), slots, len(counts))

    outside = rule.outside(spec, n) if rule.outside else None
    left = drawn(rule.law(spec, n), "L" if rule.outside_law else "")
    value = means(left, rule.inside(spec, n), None if outside is None else 1)
    if outside is not None and outside != "0e0":
        right = drawn(rule.outside_law(spec, n), "R") if rule.outside_law else left
        value = value.join(means(right, outside, 0).withColumnRenamed("m", "m0"), ["ckpt", "slot"]).select("ckpt", "slot", (F.col("m") - F.col("m0")).alias("m"))
    listed = value.groupBy("ckpt").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "m"))), lambda x: x["m"]).alias("a"))
    return _read_out(rule, spec, n, listed, bounds, "ckpt")


def estimate(name: str, game, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> DataFrame:
    """(player, value) by the named rule from `count` sampled coalitions."""
    rule = RULES[name]
    if not rule.supports(spec) or paired and not rule.pairable(spec):
        raise Unsupported(f"{name} doesn't estimate {spec}" + " from pairs" * paired)
    players = game.n + rule.null_player
    if rule.outside_law is not None:
        left = worth(game, sample(game.spark, rule.law(spec, game.n), players, count, seed, salt="L"))
        right = worth(game, sample(game.spark, rule.outside_law(spec, game.n), players, count, seed, salt="R"))
        return aggregate_rule(rule, spec, game, left, right)
    return aggregate_rule(rule, spec, game, worth(game, sample(game.spark, rule.law(spec, game.n), players, count, seed, paired), rule.null_player), None)


def exact_by_rule(name: str, game, spec: Semivalue) -> DataFrame:
    """(player, value) by the named rule over the whole population of its law: the exact semivalue where the rule is unbiased."""
    rule = RULES[name]
    if not rule.supports(spec):
        raise Unsupported(f"{name} doesn't estimate {spec}")
    players = game.n + rule.null_player
    left = worth(game, population(game.spark, rule.law(spec, game.n), players), rule.null_player)
    right = worth(game, population(game.spark, rule.outside_law(spec, game.n), players)) if rule.outside_law else None
    return aggregate_rule(rule, spec, game, left.withColumn("t", F.lit(spec.params[0] if spec.kind == "weighted_banzhaf" else 0.5)), right, "weight")


# ------------------------------------------------------------------ marginal rows


def marginals(game, samples: DataFrame) -> DataFrame:
    """(k, side, player, s, delta): what each player adds to the rest of each sampled coalition."""
    players = F.explode(F.sequence(F.lit(0), F.lit(game.n - 1))).alias("player")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("player"))
    spread = samples.select("k", "side", "mask", players).select("k", "side", "player", F.col("mask").bitwiseAND(F.bitwise_not(one)).alias("lo"), F.col("mask").bitwiseOR(one).alias("hi"))
    both = game.evaluate(spread.select(F.explode(F.array("lo", "hi")).alias("mask")))
    joined = spread.join(both.select(F.col("mask").alias("lo"), F.col("u").alias("u_lo")), "lo").join(both.select(F.col("mask").alias("hi"), F.col("u").alias("u_hi")), "hi")
    return joined.select("k", "side", "player", F.bit_count("lo").cast("int").alias("s"), (F.col("u_hi") - F.col("u_lo")).alias("delta"))


MARGINAL: dict[str, tuple[Callable, Callable, Callable]] = {
    # name: (law, weight of a marginal by the size of the rest, supports)
    "sampling_lift": (coin_of, lambda c, n: "1e0", lambda c: True),
    "wsl": (lambda c: Law(coin="uniform"), lambda c, n: _at(c.d(n), n), _not_shapley),
    "wsl_banzhaf": (lambda c: Law(coin=0.5), lambda c, n: _at(c.p(n), 2.0 ** (n - 1)), lambda c: not _half(c)),
}


def estimate_marginal(name: str, game, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> DataFrame:
    law, weight, supports = MARGINAL[name]
    if not supports(spec) or paired and name == "sampling_lift" and not spec.symmetric:
        raise Unsupported(f"{name} doesn't estimate {spec}" + " from pairs" * paired)
    drawn = marginals(game, sample(game.spark, law(spec), game.n, count, seed, paired))
    return drawn.groupBy("player").agg(F.avg(F.col("delta") * F.expr(weight(spec, game.n))).alias("value"))


# --------------------------------------------------------------- permutation rows


def permutations(spark, players: int, count: int, seed: int, paired: bool = False) -> DataFrame:
    """(k, side, players array); paired: each permutation is followed by its inverse."""
    base = spark.range(-(-count // 2) if paired else count).withColumnRenamed("id", "k")
    order = base.select("k", draws.ranked_players(F.col("k"), players, seed).alias("o"))
    if not paired:
        return order.select("k", F.lit(0).alias("side"), "o")
    inverse = F.transform(F.sequence(F.lit(0), F.lit(players - 1)), lambda i: (F.array_position("o", i) - 1).cast("int"))
    return order.select("k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("o").alias("o")), F.struct(F.lit(1).alias("side"), inverse.alias("o")))).alias("e")).select("k", "e.*")


def prefix_marginals(game, orders: DataFrame) -> DataFrame:
    """(k, side, player, pos, delta): what each player adds to those before it; prefixes are masks built inside the row."""
    steps = F.transform("o", lambda x, i: F.struct(x.alias("player"), i.alias("pos"), draws.bits(F.slice(F.col("o"), F.lit(1), i)).alias("before"), draws.bits(F.slice(F.col("o"), F.lit(1), i + 1)).alias("after")))
    spread = orders.select("k", "side", F.explode(steps).alias("e")).select("k", "side", "e.*")
    worths = game.evaluate(spread.select(F.explode(F.array("before", "after")).alias("mask")))
    joined = spread.join(worths.select(F.col("mask").alias("before"), F.col("u").alias("a")), "before").join(worths.select(F.col("mask").alias("after"), F.col("u").alias("b")), "after")
    return joined.select("k", "side", "player", "pos", (F.col("b") - F.col("a")).alias("delta"))


def _by_place(spec: Semivalue, n: int) -> str:
    """Weight of a marginal by its position; 1 for Shapley."""
    return "1e0" if spec.is_shapley else by_size([v * n for v in spec.d(n)], column="pos")


def permutation(game, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> DataFrame:
    """Prefix marginals, weighted by position where the semivalue isn't Shapley's."""
    drawn = prefix_marginals(game, permutations(game.spark, game.n, count, seed, paired))
    return drawn.groupBy("player").agg(F.avg(F.col("delta") * F.expr(_by_place(spec, game.n))).alias("value"))


# -------------------------------------------------------------------- strata rows


@dataclass
class Strata:
    """Sampled rows (k, player, s, inside, v); the value of a player is the weighted sum of its strata's means.

    weights is SQL over s and inside; fixed: strata (player, s, inside, m) that are known.
    """

    rows: DataFrame
    weights: str
    fixed: DataFrame | None = None


def _strata_value(strata: Strata) -> DataFrame:
    means = strata.rows.groupBy("player", "s", "inside").agg(F.avg("v").alias("m"))
    means = means if strata.fixed is None else means.unionByName(strata.fixed)
    return means.groupBy("player").agg(F.sum(F.col("m") * F.expr(strata.weights)).alias("value"))


def _strata_running(strata: Strata, n: int, counts: list[int], paired: bool) -> DataFrame:
    """(ckpt, player, value): the same at every checkpoint, by running sums and counts of each stratum; one without a sample counts 0."""
    parts = strata.rows.groupBy(checkpoint(counts, paired), "player", "s", "inside").agg(F.sum("v").alias("a"), F.count("*").alias("c"))
    key = ["player", "s", "inside"]
    grid = parts.select(*key).distinct().withColumn("ckpt", F.explode(F.sequence(F.lit(0), F.lit(len(counts) - 1))))
    run = Window.partitionBy(*key).orderBy("ckpt").rowsBetween(Window.unboundedPreceding, 0)
    means = grid.join(parts, [*key, "ckpt"], "left").select(*key, "ckpt", F.coalesce(F.try_divide(F.sum("a").over(run), F.sum("c").over(run)), F.lit(0.0)).alias("m"))
    if strata.fixed is not None:
        means = means.unionByName(strata.fixed.withColumn("ckpt", F.explode(F.sequence(F.lit(0), F.lit(len(counts) - 1)))))
    return means.groupBy("ckpt", "player").agg(F.sum(F.col("m") * F.expr(strata.weights)).alias("value"))


def complement_strata(game, count: int, seed: int = 0) -> Strata:
    n = game.n
    drawn = sample(game.spark, Law(even_sizes(1, n)), n, count, seed)
    other = F.lit(game.full).bitwiseXOR(F.col("mask")).cast("bigint")
    drawn = drawn.select("k", "mask", other.alias("rest"))
    worths = game.evaluate(drawn.select(F.explode(F.array("mask", "rest")).alias("mask")))
    both = drawn.join(worths, "mask").join(worths.select(F.col("mask").alias("rest"), F.col("u").alias("u_rest")), "rest")
    each = both.select("k", F.explode(F.array(F.struct(F.col("mask").alias("m"), (F.col("u") - F.col("u_rest")).alias("g")), F.struct(F.col("rest").alias("m"), (F.col("u_rest") - F.col("u")).alias("g")))).alias("e")).select("k", "e.*")
    members = each.select("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.col("m"), i) == 1)).alias("player"), F.bit_count("m").alias("s"), F.lit(1).alias("inside"), F.col("g").alias("v"))
    return Strata(members, number(1 / n))


def complement_contributions(game, count: int, seed: int = 0) -> DataFrame:
    """Shapley from worths of coalitions less those of their complements, averaged by player and size, then over sizes."""
    return _strata_value(complement_strata(game, count, seed))


def boundary(game) -> DataFrame:
    """(player, s, inside, m): exact means of the strata of sizes 0, 1, n-1 and n."""
    n, full = game.n, game.full
    masks = [0, full] + [1 << i for i in range(n)] + [full ^ (1 << i) for i in range(n)]
    edge = game.spark.range(len(masks)).select(F.element_at(F.array(*[F.lit(m) for m in masks]), (F.col("id") + 1).cast("int")).cast("bigint").alias("mask")).distinct()
    worths = game.evaluate(edge).join(edge, "mask")
    spread = worths.select(F.bit_count("mask").cast("int").alias("s"), "u", "mask", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("player"))
    return spread.groupBy("player", "s", F.expr("getbit(mask, player)").cast("int").alias("inside")).agg(F.avg("u").alias("m"))


OFA_SIZES: dict[str, tuple[Callable, Callable]] = {
    "ofa": (lambda c, n, s: 1.0, lambda c: True),
    "ofa_optimal": (lambda c, n, s: (n / s + n / (n - s)) ** 0.5, _not_shapley),
    "ofa_fixed": (lambda c, n, s: (c.d(n)[s - 1] ** 2 / s + c.d(n)[s] ** 2 / (n - s)) ** 0.5, lambda c: True),
}


def one_for_all_strata(name: str, game, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> Strata:
    law, supports = OFA_SIZES[name]
    n = game.n
    if not supports(spec) or n < 4 or paired and name == "ofa_fixed" and not spec.symmetric:
        raise Unsupported(f"{name} doesn't estimate {spec} of {n} players" + " from pairs" * paired)
    drawn = worth(game, sample(game.spark, Law({s: law(spec, n, s) for s in range(2, n - 1)}), n, count, seed, paired))
    rows = drawn.select("k", "s", F.col("u").alias("v"), "mask", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("player")).select("k", "player", "s", F.expr("getbit(mask, player)").cast("int").alias("inside"), "v")
    return Strata(rows, f"(CASE WHEN inside = 1 THEN {_before(spec.d(n))} ELSE -{_at(spec.d(n))} END)", boundary(game))


def one_for_all(name: str, game, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> DataFrame:
    """Strata means by player, size and side, interior sizes sampled and the outer ones exact."""
    return _strata_value(one_for_all_strata(name, game, spec, count, seed, paired))


def baseline_strata(game, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> Strata:
    n = game.n
    others = permutations(game.spark, n - 1, count, seed, paired).withColumn("player", (F.col("k") % n).cast("int"))
    lifted = others.withColumn("o", F.transform("o", lambda x: F.when(x >= F.col("player"), x + 1).otherwise(x)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("pos"), draws.bits(F.slice(F.col("o"), F.lit(1), i)).alias("before")))
    spread = lifted.select("k", "player", F.explode(steps).alias("e")).select("k", "player", "e.pos", "e.before")
    spread = spread.withColumn("after", F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("player"))))
    worths = game.evaluate(spread.select(F.explode(F.array("before", "after")).alias("mask")))
    joined = spread.join(worths.select(F.col("mask").alias("before"), F.col("u").alias("a")), "before").join(worths.select(F.col("mask").alias("after"), F.col("u").alias("b")), "after")
    return Strata(joined.select("k", "player", F.col("pos").alias("s"), F.lit(1).alias("inside"), (F.col("b") - F.col("a")).alias("v")), _at(spec.d(n)))


def one_for_all_baseline(game, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> DataFrame:
    """Sample k belongs to player k mod n, which joins a random order of the others at every place."""
    return _strata_value(baseline_strata(game, spec, count, seed, paired))


def _complement_by_name(game, spec: Semivalue, count: int, seed: int, paired: bool) -> Strata:
    if not spec.is_shapley or paired:
        raise Unsupported("complement estimates Shapley values, from coalitions with their complements")
    return complement_strata(game, count, seed)


#: Estimators by name whose state is a sum and a count per stratum: (game, spec, count, seed, paired).
STRATA: dict[str, Callable[..., Strata]] = {
    **{name: lambda *given, name=name: one_for_all_strata(name, *given) for name in OFA_SIZES},
    "ofa_baseline": baseline_strata,
    "complement": _complement_by_name,
}
