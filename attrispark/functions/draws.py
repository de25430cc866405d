"""Counter-based randomness: every draw is a function of (sample, slot, seed).

Draws don't depend on partitions, order or retries, so a lost executor
recomputes the same samples, and another engine can draw them too.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from attrispark.functions.spec import number

BITS = 52


def digest(sample: Column, slot: Column | str, seed: int) -> Column:
    slot = F.lit(slot) if isinstance(slot, str) else slot.cast("string")
    return F.md5(F.concat(sample.cast("string"), F.lit(":"), slot, F.lit(f":{seed}")).cast("binary"))


def uniform(sample: Column, slot: Column | str, seed: int) -> Column:
    """A uniform number in [0, 1) of 52 bits."""
    return F.conv(F.substring(digest(sample, slot, seed), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << BITS))


def ranked_players(sample: Column, players: int, seed: int, first: int = 0) -> Column:
    """Players in random order: an array sorted by their digests."""
    pairs = F.transform(F.sequence(F.lit(first), F.lit(players - 1)), lambda i: F.struct(digest(sample, i, seed).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda x: x["i"])


def bits(players: Column) -> Column:
    """The mask of an array of players."""
    return F.aggregate(players, F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))


#: Beyond so many sizes (or cells) a law is searched in an array, not spelled out as cases.
CASES = 16


def draw_size(u: Column, law: dict[int, float]) -> Column:
    """The size whose share of [0, 1) holds u."""
    sizes = sorted(law)
    total = sum(law.values())
    steps = list(accumulate(law[s] / total for s in sizes))
    if len(sizes) == 1:
        return F.lit(sizes[0]).cast("int")
    if len(sizes) <= CASES:
        out = F.when(u < F.lit(steps[0]), F.lit(sizes[0]))
        for s, at in zip(sizes[1:-1], steps[1:-1], strict=True):
            out = out.when(u < F.lit(at), F.lit(s))
        return out.otherwise(F.lit(sizes[-1])).cast("int")
    # Halving steps: the place is the number of steps that u has reached, at most all but the last.
    ends = F.expr(f"array({', '.join(number(x) for x in steps[:-1])})")
    halves = [1 << k for k in reversed(range(len(sizes).bit_length()))]
    reached = lambda x, at, by: F.when((at + by < len(sizes)) & (F.get(ends, at + by - 1) <= x), at + by).otherwise(at)
    place = F.transform(F.array(u), lambda x: F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda at, by: reached(x, at, by)))
    return F.get(F.expr(f"array({', '.join(map(str, sizes))})"), F.get(place, F.lit(0))).cast("int")


#: Attempts at a fractional shape; each fails with probability below 0.22, so all do in less than one of 10^15 samples.
TRIES = 24


def _gamma(sample: Column, slot: str, shape: float, seed: int) -> Column:
    """A gamma variate: exponentials for the whole part of the shape, an exponential times a beta variate for the rest."""
    whole = int(shape)
    rest = shape - whole
    one = lambda name: -F.log(F.lit(1.0) - uniform(sample, name, seed))
    total = F.lit(0.0)
    for j in range(whole):
        total = total + one(f"{slot}e{j}")
    if not rest:
        return total

    def share(c: Column) -> Column:
        x, y = (F.pow(uniform(sample, F.concat(F.lit(slot + part), c.cast("string")), seed), F.lit(1 / power)) for part, power in (("x", rest), ("y", 1 - rest)))
        return F.when((x + y <= 1) & (x + y > 0), x / (x + y))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda got, c: F.coalesce(got, share(c)))
    return total + F.coalesce(found, F.lit(rest)) * one(f"{slot}g")


def beta_variate(sample: Column, a: float, b: float, seed: int) -> Column:
    """A beta variate of real parameters, as one gamma variate over the sum of two."""
    x, y = _gamma(sample, "p", a, seed), _gamma(sample, "q", b, seed)
    return x / (x + y)


def _gamma_sql(sample: str, slot: str, shape: float, seed: int) -> str:
    whole = int(shape)
    rest = shape - whole
    one = lambda name: f"-ln(1e0 - {uniform_sql(sample, repr(name), seed)})"
    terms = [one(f"{slot}e{j}") for j in range(whole)]
    if rest:
        tries = []
        for c in range(TRIES):
            x, y = (f"pow({uniform_sql(sample, repr(f'{slot}{part}{c}'), seed)}, {1 / power!r}::double)" for part, power in (("x", rest), ("y", 1 - rest)))
            tries.append(f"CASE WHEN {x} + {y} <= 1 AND {x} + {y} > 0 THEN {x} / ({x} + {y}) END")
        terms.append(f"coalesce({', '.join(tries)}, {rest!r}::double) * ({one(f'{slot}g')})")
    return f"({' + '.join(f'({x})' for x in terms)})"


def beta_variate_sql(sample: str, a: float, b: float, seed: int) -> str:
    x, y = _gamma_sql(sample, "p", a, seed), _gamma_sql(sample, "q", b, seed)
    return f"({x} / ({x} + {y}))"


def uniform_sql(sample: str, slot: str, seed: int) -> str:
    """The same uniform number in DuckDB SQL; slot is an expression or a quoted name."""
    text = f"cast({sample} AS varchar) || ':' || {slot} || ':{seed}'"
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / {float(1 << BITS)!r}::double)"


def draw_size_sql(u: str, law: dict[int, float]) -> str:
    sizes = sorted(law)
    total = sum(law.values())
    steps = list(accumulate(law[s] / total for s in sizes))
    cases = " ".join(f"WHEN {u} < {at!r}::double THEN {s}" for s, at in zip(sizes[:-1], steps[:-1], strict=True))
    return f"(CASE {cases} ELSE {sizes[-1]} END)" if cases else str(sizes[-1])
