"""Semivalue functionals: how much weight a coalition size has."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, exp, lgamma, log, log1p


def _log_beta(a: float, b: float) -> float:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def _log_comb(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


#: Players from which binomials are taken as logarithms: they don't fit a double.
BINOMIAL_PLAYERS = 500


@dataclass(frozen=True)
class Semivalue:
    """Shapley, weighted Banzhaf(p) or Beta-Shapley(alpha, beta).

    d(n)[s] is the weight of all coalitions of s other players together
    (the weights sum to 1), p(n)[s] that of one of them.
    """

    kind: str
    params: tuple[float, ...] = ()

    def __post_init__(self):
        if self.kind == "shapley":
            ok = not self.params
        elif self.kind == "weighted_banzhaf":
            ok = len(self.params) == 1 and 0 < self.params[0] < 1
        elif self.kind == "beta_shapley":
            ok = len(self.params) == 2 and min(self.params) > 0
        else:
            raise NotImplementedError(f"unknown semivalue {self.kind!r}")
        if not ok:
            raise ValueError(f"bad parameters {self.params} of {self.kind}")

    def d(self, n: int) -> list[float]:
        if self.kind == "shapley":
            return [1.0 / n] * n
        if self.kind == "weighted_banzhaf":
            q = self.params[0]
            if n >= BINOMIAL_PLAYERS:
                return [exp(_log_comb(n - 1, s) + s * log(q) + (n - 1 - s) * log1p(-q)) for s in range(n)]
            return [comb(n - 1, s) * q**s * (1 - q) ** (n - 1 - s) for s in range(n)]
        a, b = self.params
        if n >= BINOMIAL_PLAYERS:
            return [exp(_log_comb(n - 1, s) + _log_beta(b + s, a + n - 1 - s) - _log_beta(b, a)) for s in range(n)]
        return [comb(n - 1, s) * exp(_log_beta(b + s, a + n - 1 - s) - _log_beta(b, a)) for s in range(n)]

    def p(self, n: int) -> list[float]:
        if n >= BINOMIAL_PLAYERS:  # may come out as 0, where a single coalition weighs less than a double tells
            return [x * exp(-_log_comb(n - 1, s)) for s, x in enumerate(self.d(n))]
        return [x / comb(n - 1, s) for s, x in enumerate(self.d(n))]

    def unanimity(self, size: int) -> float:
        """Value of each member of a unit unanimity game of the given size."""
        if self.kind == "shapley":
            return 1.0 / size
        if self.kind == "weighted_banzhaf":
            return self.params[0] ** (size - 1)
        a, b = self.params
        return exp(_log_beta(b + size - 1, a) - _log_beta(b, a))

    @property
    def is_shapley(self) -> bool:
        return self.kind == "shapley" or self.kind == "beta_shapley" and self.params == (1.0, 1.0)

    @property
    def symmetric(self) -> bool:
        """Whether a coalition weighs as much as its complement."""
        if self.kind == "weighted_banzhaf":
            return self.params[0] == 0.5
        return self.kind == "shapley" or self.params[0] == self.params[1]


SHAPLEY = Semivalue("shapley")
BANZHAF = Semivalue("weighted_banzhaf", (0.5,))


def banzhaf(p: float) -> Semivalue:
    return Semivalue("weighted_banzhaf", (p,))


def beta(a: float, b: float) -> Semivalue:
    return Semivalue("beta_shapley", (float(a), float(b)))


def by_size(values: list[float], first: int = 0, column: str = "s") -> str:
    """SQL that looks a weight up by coalition size; 0 outside.  Double literals in Spark and in ANSI SQL alike."""
    cases = " ".join(f"WHEN {first + i} THEN {v!r}" if "e" in repr(v) else f"WHEN {first + i} THEN {v!r}e0" for i, v in enumerate(values))
    return f"(CASE {column} {cases} ELSE 0e0 END)"


def number(v: float) -> str:
    """A double literal."""
    r = repr(float(v))
    return r if "e" in r else f"{r}e0"
