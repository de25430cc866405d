"""Closed forms and sampled estimators of games of many players, over coalitions of several words.

A statistic is linear in a player's bit, so a sample needs two numbers of it,
with the bit on and off; a task multiplies them with the samples' bits, and one
row per player and task is all that moves.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrispark.functions import draws
from attrispark.functions.ship import ship
from attrispark.functions.spec import Semivalue, number
from attrispark.operators.estimators import RULES, Law, Unsupported
from attrispark.sources import wide
from attrispark.sources.wide import WORD, WideGame


def closed_form(game: WideGame, spec: Semivalue) -> DataFrame:
    """(player, value): each term's weight goes to its members by the term's size; players of no term have 0."""
    most = int(game.terms.agg(F.max(F.size("members"))).first()[0] or 0)
    share = F.get(F.expr(f"array({', '.join(['0e0', *(number(spec.unanimity(s)) for s in range(1, most + 1))])})"), F.size("members"))
    paid = game.terms.select(F.explode("members").alias("player"), (F.col("w") * share).alias("v")).groupBy("player").agg(F.sum("v").alias("v"))
    everyone = game.spark.range(game.n).select(F.col("id").cast("int").alias("player"))
    return everyone.join(paid, "player", "left").select("player", F.coalesce("v", F.lit(0.0)).alias("value"))


def sample(spark, law: Law, n: int, count: int, seed: int, paired: bool = False, salt: str = "") -> DataFrame:
    """(k, side, mask array, s, t): as estimators.sample draws them, over n players of any number."""
    base = spark.range(-(-count // 2) if paired else count).withColumnRenamed("id", "k")
    k = F.concat(F.col("k").cast("string"), F.lit(salt)) if salt else F.col("k")
    if law.sizes is not None:
        size = draws.draw_size(draws.uniform(k, "size", seed), law.sizes)
        chosen = base.select("k", size.alias("s"), F.lit(None).cast("double").alias("t")).withColumn("mask", wide.words_of_first(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: draws.digest(k, i, seed)), F.col("s"), n))
    else:
        t = draws.uniform(k, "t", seed) if law.coin == "uniform" else draws.beta_variate(k, law.coin[1], law.coin[2], seed) if isinstance(law.coin, tuple) else F.lit(float(law.coin))

        def word(j: Column) -> Column:
            inside = F.sequence(j * WORD, F.least(F.lit(n), j * WORD + WORD) - 1)
            return F.aggregate(inside, F.lit(0).cast("bigint"), lambda m, i: F.when(draws.uniform(k, i, seed) < F.col("t"), m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (i - j * WORD).cast("int")))).otherwise(m))

        chosen = base.select("k", t.alias("t")).withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(wide.words_for(n) - 1)), word))
        chosen = chosen.withColumn("s", F.aggregate("mask", F.lit(0), lambda a, m: a + F.bit_count(m).cast("int")))
    first = F.struct(F.lit(0).alias("side"), F.col("mask"), F.col("s").cast("int").alias("s"), F.col("t"))
    if not paired:
        return chosen.select("k", first.alias("e")).select("k", "e.*")
    full = F.expr(f"array({', '.join(f'{w}L' for w in wide.full_words(n))})")
    other = F.struct(F.lit(1).alias("side"), F.zip_with("mask", full, lambda a, b: a.bitwiseXOR(b)).alias("mask"), (n - F.col("s")).cast("int").alias("s"), (1 - F.col("t")).alias("t"))
    return chosen.select("k", F.explode(F.array(first, other)).alias("e")).select("k", "e.*")


def bare(samples: DataFrame, n: int) -> DataFrame:
    """samples of n players and a null player, with x_null and without its bit (and, where it has a word of its own, without that)."""
    at, bit = n // WORD, n % WORD
    cut = F.transform("mask", lambda m, j: F.when(j == at, m.bitwiseAND(F.lit(~(1 << bit)).cast("bigint"))).otherwise(m))
    return samples.withColumn("x_null", F.getbit(F.get("mask", F.lit(at)), F.lit(bit)).cast("double")).withColumn("mask", F.slice(cut, 1, wide.words_for(n)))


def _sums(samples: DataFrame, n: int, null: bool, columns: dict[str, Column]) -> DataFrame:
    """(slot, in_<c>, all_<c>, ...): each column summed over the samples with the player and over all; slot n is the null player's."""
    ship(samples.sparkSession)
    names = list(columns)
    slim = samples.select("mask", *([F.col("x_null")] if null else []), *[c.cast("double").alias(name) for name, c in columns.items()])
    kind = ", ".join(["slot int", *(f"in_{c} double, all_{c} double" for c in names)])

    def run(batches):
        import pyarrow as pa

        slots, step = n + null, max(1, min(1024, wide.CELLS // n))
        inside, every = np.zeros((slots, len(names))), np.zeros(len(names))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                bits = wide.bits_of(some.column(0), n).astype(np.float64)
                if null:
                    bits = np.hstack([bits, some.column(1).to_numpy()[:, None]])
                values = np.stack([some.column(k + 1 + null).to_numpy(zero_copy_only=False) for k in range(len(names))], axis=1)
                inside += bits.T @ values
                every += values.sum(axis=0)
        found = {"slot": pa.array(np.arange(slots, dtype=np.int32))}
        for k, c in enumerate(names):
            found |= {f"in_{c}": pa.array(inside[:, k]), f"all_{c}": pa.array(np.full(slots, every[k]))}
        yield pa.RecordBatch.from_pydict(found)

    parts = slim.mapInArrow(run, kind)
    return parts.groupBy("slot").agg(*[F.sum(f"{side}_{c}").alias(f"{side}_{c}") for c in names for side in ("in", "all")])


def estimate(name: str, game: WideGame, spec: Semivalue, count: int, seed: int = 0, paired: bool = False) -> DataFrame:
    """(player, value) by the named rule of estimators.RULES, from `count` sampled coalitions."""
    rule = RULES[name]
    if not rule.supports(spec) or paired and not rule.pairable(spec):
        raise Unsupported(f"{name} doesn't estimate {spec}" + " from pairs" * paired)
    n, null = game.n, rule.null_player
    u0, u1 = game.bounds()

    def drawn(law: Law, salt: str = "") -> DataFrame:
        samples = sample(game.spark, law, n + null, count, seed, paired, salt)
        return game.attach(bare(samples, n) if null else samples).withColumn("u0", F.lit(u0)).withColumn("u1", F.lit(u1))

    def stat(of: Callable, x: str) -> Column:
        return F.expr(re.sub(r"\bx\b", x, of(spec, n)))

    left = drawn(rule.law(spec, n), "L" if rule.outside_law else "")
    if rule.outside is None:
        off = stat(rule.inside, "0e0")
        sums = _sums(left, n, null, {"lift": stat(rule.inside, "1e0") - off, "off": off, "one": F.lit(1.0)})
        means = sums.select("slot", ((F.col("in_lift") + F.col("all_off")) / F.col("all_one")).alias("v"))
    else:
        columns = {"on": stat(rule.inside, "1e0"), "one": F.lit(1.0)}
        inside = F.coalesce(F.try_divide("in_on", "in_one"), F.lit(0.0))
        if rule.outside(spec, n) == "0e0":
            means = _sums(left, n, null, columns).select("slot", inside.alias("v"))
        else:
            off = {"off": stat(rule.outside, "0e0"), "one": F.lit(1.0)}
            outside = F.coalesce(F.try_divide(F.col("all_off") - F.col("in_off"), F.col("all_one") - F.col("in_one")), F.lit(0.0))
            if rule.outside_law:
                right = _sums(drawn(rule.outside_law(spec, n), "R"), n, null, off).select("slot", outside.alias("b"))
                means = _sums(left, n, null, columns).select("slot", inside.alias("a")).join(right, "slot").select("slot", (F.col("a") - F.col("b")).alias("v"))
            else:
                means = _sums(left, n, null, columns | off).select("slot", (inside - outside).alias("v"))
    every = Window.partitionBy()  # a row per player
    whole = means.withColumn("total", F.sum(F.when(F.col("slot") < n, F.col("v"))).over(every)).withColumn("v_null", F.max(F.when(F.col("slot") == n, F.col("v"))).over(every))
    own = whole.where(F.col("slot") < n).withColumn("u0", F.lit(u0)).withColumn("u1", F.lit(u1))
    return own.select(F.col("slot").alias("player"), F.expr(rule.readout(spec, n)).alias("value"))
