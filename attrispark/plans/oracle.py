"""The same quantities in ANSI SQL over the test tables, for DuckDB."""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

from attrispark.functions.draws import beta_variate_sql, draw_size_sql, uniform_sql
from attrispark.functions.spec import Semivalue, by_size, number
from attrispark.operators.estimators import MARGINAL, OFA_SIZES, RULES, Law, coin_of, even_sizes, kernel_sizes
from attrispark.operators.regression import balanced_law, coalition_chance

PLAYERS = {"region": 5, "nation": 25, "brand": 25, "segment": 5, "event": 5, "share": 10}

_FACTS = {
    "region": "SELECT l_orderkey AS g, n_regionkey AS player, l_extendedprice * (1 - l_discount) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "nation": "SELECT l_orderkey AS g, s_nationkey AS player, l_extendedprice * (1 - l_discount) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "brand": "SELECT l_orderkey AS g, player, l_extendedprice * (1 - l_discount) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT b, row_number() OVER (ORDER BY b) - 1 AS player FROM (SELECT DISTINCT p_brand AS b FROM part)) ON b = p_brand",
    "segment": "SELECT l_partkey::varchar || ':' || year(l_shipdate)::varchar AS g, player, l_extendedprice * (1 - l_discount) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN (SELECT b, row_number() OVER (ORDER BY b) - 1 AS player FROM (SELECT DISTINCT c_mktsegment AS b FROM customer)) ON b = c_mktsegment",
    "share": "SELECT l_orderkey AS g, l_suppkey % 10 AS player, l_extendedprice * (1 - l_discount) AS v FROM lineitem",
    "event": "SELECT user_id::varchar || ':' || cast(ts AS date)::varchar AS g, player, value AS v FROM events JOIN (SELECT b, row_number() OVER (ORDER BY b) - 1 AS player FROM (SELECT DISTINCT event_type AS b FROM events)) ON b = event_type",
}


def terms(game: str) -> str:
    return f"f AS ({_FACTS[game]}), t0 AS (SELECT g, bit_or(1::bigint << player::int) AS mask, sum(v) AS w FROM f GROUP BY g), terms AS (SELECT mask, sum(w) AS w FROM t0 GROUP BY mask)"


def table(game: str) -> str:
    """CTEs terms, util(mask, u) over all coalitions and ends(u0, u1)."""
    n = PLAYERS[game]
    return f"{terms(game)}, util AS (SELECT m.mask, coalesce(sum(w), 0) AS u FROM (SELECT range AS mask FROM range({1 << n})) m LEFT JOIN terms t ON (t.mask & m.mask) = t.mask GROUP BY m.mask), ends AS (SELECT sum(CASE WHEN mask = 0 THEN u END) AS u0, sum(CASE WHEN mask = {(1 << n) - 1} THEN u END) AS u1 FROM util)"


def closed_form(game: str, spec: Semivalue, digits: int = 2) -> str:
    n = PLAYERS[game]
    share = by_size([spec.unanimity(s) for s in range(1, n + 1)], first=1, column="bit_count(mask)")
    return f"WITH {terms(game)} SELECT p.i::int AS player, round(coalesce(sum(CASE WHEN (mask >> p.i) & 1 = 1 THEN w * {share} END), 0), {digits}) AS value FROM (SELECT range::int AS i FROM range({n})) p CROSS JOIN terms GROUP BY 1"


def exact_body(n: int, spec: Semivalue) -> str:
    weight = by_size(spec.p(n), column="bit_count(a.mask)")
    return f"SELECT p.i::int AS player, sum({weight} * (b.u - a.u)) AS value FROM (SELECT range::int AS i FROM range({n})) p JOIN util a ON (a.mask >> p.i) & 1 = 0 JOIN util b ON b.mask = a.mask | (1::bigint << p.i) GROUP BY 1"


def exact(game: str, spec: Semivalue, digits: int = 2) -> str:
    return f"WITH {table(game)}, x AS ({exact_body(PLAYERS[game], spec)}) SELECT player, round(value, {digits}) AS value FROM x"


def exact_group(game: str, spec: Semivalue, group: list[int], digits: int = 2) -> str:
    return f"WITH {table(game)}, x AS ({exact_body(PLAYERS[game], spec)}) SELECT round(sum(value), {digits}) AS value FROM x WHERE player IN ({', '.join(map(str, group))})"


def _bases(count: int | str, paired: bool) -> str:
    return f"{f'({count} + 1) // 2' if paired else count}"


def samples(law: Law, players: int, count: int | str, seed: int, paired: bool = False, salt: str = "", name: str = "smp") -> str:
    """CTEs that end in name(k, side, mask, s, t).  count may be SQL."""
    bases = _bases(count, paired)
    k = f"(k.range::varchar || '{salt}')" if salt else "k.range"
    full = (1 << players) - 1
    if law.sizes is not None:
        size = draw_size_sql(uniform_sql(k, "'size'", seed), law.sizes)
        base = f"{name}_z AS (SELECT k.range AS k, {size} AS s FROM range({bases}) k), {name}_r AS (SELECT k.range AS k, i.range AS i, row_number() OVER (PARTITION BY k.range ORDER BY md5(cast({k} AS varchar) || ':' || i.range::varchar || ':{seed}'), i.range) AS r FROM range({bases}) k CROSS JOIN range({players}) i), {name}_b AS (SELECT k, sum(CASE WHEN r <= s THEN 1::bigint << i::int ELSE 0 END)::bigint AS mask, any_value(s)::int AS s, NULL::double AS t FROM {name}_z JOIN {name}_r USING (k) GROUP BY k)"
    else:
        if law.coin == "uniform":
            t = uniform_sql(k, "'t'", seed)
        elif isinstance(law.coin, tuple):
            _, a, b = law.coin
            if a == int(a) and b == int(b):
                t = f"list_sort([{', '.join(uniform_sql(k, repr(f't{j}'), seed) for j in range(int(a + b) - 1))}])[{int(a)}]"
            else:
                t = beta_variate_sql(k, a, b, seed)
        else:
            t = number(float(law.coin))
        slot = "i.range::varchar"
        base = f"{name}_z AS (SELECT k.range AS k, {t} AS t FROM range({bases}) k), {name}_b AS (SELECT k.range AS k, sum(CASE WHEN {uniform_sql(k, slot, seed)} < t THEN 1::bigint << i.range::int ELSE 0 END)::bigint AS mask, sum(CASE WHEN {uniform_sql(k, slot, seed)} < t THEN 1 ELSE 0 END)::int AS s, any_value(t) AS t FROM range({bases}) k JOIN {name}_z z ON z.k = k.range CROSS JOIN range({players}) i GROUP BY 1)"
    if paired:
        return f"{base}, {name} AS (SELECT k, 0 AS side, mask, s, t FROM {name}_b UNION ALL SELECT k, 1, xor({full}::bigint, mask), ({players} - s)::int, 1 - t FROM {name}_b)"
    return f"{base}, {name} AS (SELECT k, 0 AS side, mask, s, t FROM {name}_b)"


def rule(name: str, game: str, spec: Semivalue, count: int, seed: int, paired: bool = False, digits: int = 4) -> str:
    r, n = RULES[name], PLAYERS[game]
    players = n + r.null_player
    parts = [table(game)]
    if r.outside_law is not None:
        parts += [samples(r.law(spec, n), players, count, seed, salt="L", name="lt"), samples(r.outside_law(spec, n), players, count, seed, salt="R", name="rt")]
        sides = ("lt", "rt")
    else:
        parts.append(samples(r.law(spec, n), players, count, seed, paired, name="lt"))
        sides = ("lt", "lt")

    def rows(of: str) -> str:
        return f"(SELECT p.range::int AS player, (({of}.mask >> p.range::int) & 1)::double AS x, (({of}.mask >> {n}) & 1)::double AS x_null, {of}.s, {of}.t, util.u, u0, u1 FROM {of} JOIN util ON util.mask = {of}.mask & {(1 << n) - 1} CROSS JOIN ends CROSS JOIN range({players}) p)"

    inside = r.inside(spec, n)
    outside = r.outside(spec, n) if r.outside else None
    if outside is None:
        parts.append(f"raw AS (SELECT player, avg({inside}) AS v FROM {rows(sides[0])} GROUP BY 1)")
    else:
        parts.append(f"ri AS (SELECT player, coalesce(avg(CASE WHEN x = 1 THEN {inside} END), 0) AS v FROM {rows(sides[0])} GROUP BY 1), ro AS (SELECT player, coalesce(avg(CASE WHEN x = 0 THEN {outside} END), 0) AS v FROM {rows(sides[1])} GROUP BY 1), raw AS (SELECT ri.player, ri.v - ro.v AS v FROM ri JOIN ro USING (player))")
    parts.append(f"own AS (SELECT player, v, sum(v) OVER () AS total, (SELECT max(v) FROM raw WHERE player = {n}) AS v_null, u0, u1 FROM raw CROSS JOIN ends WHERE player < {n})")
    return f"WITH {', '.join(parts)} SELECT player, round({r.readout(spec, n)}, {digits}) AS value FROM own"


def marginal(name: str, game: str, spec: Semivalue, count: int, seed: int, paired: bool = False, digits: int = 4) -> str:
    law, weight, _ = MARGINAL[name]
    n = PLAYERS[game]
    w = re.sub(r"\bs\b", "bit_count(lo)", weight(spec, n))
    return f"WITH {table(game)}, {samples(law(spec), n, count, seed, paired)}, m AS (SELECT p.range::int AS player, mask & ~(1::bigint << p.range::int) AS lo, mask | (1::bigint << p.range::int) AS hi FROM smp CROSS JOIN range({n}) p) SELECT player, round(avg((b.u - a.u) * {w}), {digits}) AS value FROM m JOIN util a ON a.mask = lo JOIN util b ON b.mask = hi GROUP BY 1"


def orders(players: int, count: int | str, seed: int, paired: bool) -> str:
    """CTE ord(k, side, pos, player).  count may be SQL."""
    bases = _bases(count, paired)
    base = f"ord0 AS (SELECT k.range AS k, (row_number() OVER (PARTITION BY k.range ORDER BY md5(k.range::varchar || ':' || i.range::varchar || ':{seed}'), i.range) - 1)::int AS pos, i.range::int AS player FROM range({bases}) k CROSS JOIN range({players}) i)"
    return f"{base}, ord AS (SELECT k, 0 AS side, pos, player FROM ord0{' UNION ALL SELECT k, 1, player, pos FROM ord0' if paired else ''})"


def permutation(game: str, spec: Semivalue, count: int, seed: int, paired: bool = False, digits: int = 4) -> str:
    n = PLAYERS[game]
    weight = "1" if spec.is_shapley else by_size([v * n for v in spec.d(n)], column="pos")
    return f"WITH {table(game)}, {orders(n, count, seed, paired)}, m AS (SELECT player, pos, sum(1::bigint << player) OVER (PARTITION BY k, side ORDER BY pos)::bigint AS hi FROM ord) SELECT player, round(avg((b.u - a.u) * {weight}), {digits}) AS value FROM m JOIN util b ON b.mask = hi JOIN util a ON a.mask = xor(hi, 1::bigint << player) GROUP BY 1"


def complement(game: str, count: int, seed: int, digits: int = 4) -> str:
    n = PLAYERS[game]
    law = Law({s: 1.0 for s in range(1, n + 1)})
    return f"WITH {table(game)}, {samples(law, n, count, seed)}, g AS (SELECT smp.mask AS m, a.u - b.u AS v FROM smp JOIN util a ON a.mask = smp.mask JOIN util b ON b.mask = xor({(1 << n) - 1}::bigint, smp.mask)), e AS (SELECT m, v FROM g UNION ALL SELECT xor({(1 << n) - 1}::bigint, m), -v FROM g), st AS (SELECT p.range::int AS player, bit_count(m) AS s, avg(v) AS v FROM e JOIN range({n}) p ON (m >> p.range::int) & 1 = 1 GROUP BY 1, 2) SELECT player, round(sum(v) / {n}, {digits}) AS value FROM st GROUP BY 1"


def one_for_all(name: str, game: str, spec: Semivalue, count: int, seed: int, paired: bool = False, digits: int = 4) -> str:
    law, _ = OFA_SIZES[name]
    n = PLAYERS[game]
    sizes = Law({s: law(spec, n, s) for s in range(2, n - 1)})
    weight = f"(CASE WHEN x = 1 THEN {by_size(spec.d(n), first=1)} ELSE -{by_size(spec.d(n))} END)"
    return f"WITH {table(game)}, {samples(sizes, n, count, seed, paired)}, e AS (SELECT smp.mask, u FROM smp JOIN util USING (mask) UNION ALL SELECT mask, u FROM util WHERE bit_count(mask) IN (0, 1, {n - 1}, {n})), st AS (SELECT p.range::int AS player, bit_count(mask) AS s, (mask >> p.range::int) & 1 AS x, avg(u) AS v FROM e CROSS JOIN range({n}) p GROUP BY 1, 2, 3) SELECT player, round(sum(v * {weight}), {digits}) AS value FROM st GROUP BY 1"


def one_for_all_baseline(game: str, spec: Semivalue, count: int, seed: int, paired: bool = False, digits: int = 4) -> str:
    n = PLAYERS[game]
    return f"WITH {table(game)}, {orders(n - 1, count, seed, paired)}, l AS (SELECT k, side, (k % {n})::int AS me, pos, CASE WHEN player >= k % {n} THEN player + 1 ELSE player END AS player FROM ord), m AS (SELECT me, pos + 1 AS s, sum(1::bigint << player::int) OVER (PARTITION BY k, side ORDER BY pos)::bigint AS lo FROM l UNION ALL SELECT me, 0, 0 FROM l WHERE pos = 0), st AS (SELECT me AS player, s, avg(b.u - a.u) AS v FROM m JOIN util a ON a.mask = lo JOIN util b ON b.mask = lo | (1::bigint << me) GROUP BY 1, 2) SELECT player, round(sum(v * {by_size(spec.d(n))}), {digits}) AS value FROM st GROUP BY 1"


# Linear systems: Gram matrices as sums, solved by unrolled elimination, a column per entry.


def gram(rows: str, features: list[str], right: list[str], weight: str = "1e0", keys: str = "", name: str = "e0") -> str:
    """CTE name(keys, a_i_j, b_i_r): weighted products of the features with each other and with the right-hand sides."""
    cells = [f"sum({weight} * ({x}) * ({y})) AS a_{i}_{j}" for i, x in enumerate(features) for j, y in enumerate(features)]
    cells += [f"sum({weight} * ({x}) * ({y})) AS b_{i}_{r}" for i, x in enumerate(features) for r, y in enumerate(right)]
    return f"{name} AS (SELECT {keys}{', ' if keys else ''}{', '.join(cells)} FROM {rows}{f' GROUP BY {keys}' if keys else ''})"


def solved(size: int, right: int, keys: str = "", begin: str = "e0", name: str = "e") -> str:
    """CTEs that end in name{size}: b_i_r is then the solution; for positive definite matrices, without pivots."""
    steps, before = [], begin
    for p in range(size):
        columns = [f"{k}" for k in keys.split(", ") if k]
        for i in range(size):
            for c in [*(f"a_{{}}_{j}" for j in range(p + 1, size)), *(f"b_{{}}_{r}" for r in range(right))]:
                of, own = c.format(p), c.format(i)
                columns.append(f"{of} / a_{p}_{p} AS {own}" if i == p else f"{own} - a_{i}_{p} * {of} / a_{p}_{p} AS {own}")
        steps.append(f"{name}{p + 1} AS (SELECT {', '.join(columns)} FROM {before})")
        before = f"{name}{p + 1}"
    return ", ".join(steps)


def _evaluated(game: str, law: Law, count: int, seed: int, paired: bool) -> str:
    """CTEs that end in ev(k, mask, s, t, u, u0, u1, x0, x1, ...)."""
    n = PLAYERS[game]
    bits = ", ".join(f"((smp.mask >> {i}) & 1)::double AS x{i}" for i in range(n))
    return f"{table(game)}, {samples(law, n, count, seed, paired)}, ev AS (SELECT smp.*, u, u0, u1, {bits} FROM smp JOIN util USING (mask) CROSS JOIN ends)"


def _list(values: list[str], last: str, digits: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS player, {v} AS value FROM {last} CROSS JOIN ends" for i, v in enumerate(values))
    return f"SELECT player::int AS player, round(value, {digits}) AS value FROM ({rows})"


def _constrained(size: int, gain: str = "(u1 - u0)") -> list[str]:
    """Solutions b_i_0 moved along b_i_1 so that they add up to the gain."""
    free, slope = (" + ".join(f"b_{i}_{r}" for i in range(size)) for r in (0, 1))
    return [f"(b_{i}_0 - b_{i}_1 * ({free} - {gain}) / ({slope}))" for i in range(size)]


def kernel_shap(game: str, count: int, seed: int, paired: bool, digits: int = 2) -> str:
    n = PLAYERS[game]
    x = [f"x{i}" for i in range(n)]
    begin = gram("ev", x, ["u - u0"])
    ones = f"e0 AS (SELECT *, {', '.join(f'1e0 AS b_{i}_1' for i in range(n))} FROM eg)"
    return f"WITH {_evaluated(game, Law(kernel_sizes(n)), count, seed, paired)}, {begin.replace('e0 AS', 'eg AS', 1)}, {ones}, {solved(n, 2)} {_list(_constrained(n), f'e{n}', digits)}"


def leverage(game: str, count: int, seed: int, paired: bool, digits: int = 2) -> str:
    n = PLAYERS[game]
    mass = kernel_sizes(n)
    weight = by_size([n * mass.get(s, 0.0) / sum(mass.values()) for s in range(n + 1)])
    x = [f"x{i} - s / {n}e0" for i in range(n)]
    begin = gram("ev", x, [f"u - u0 - (u1 - u0) * s / {n}e0"], weight).replace("e0 AS", "eg AS", 1)
    # Centred bits add up to nothing: the solution of least norm is that of the matrix plus one.
    cells = ", ".join([*(f"a_{i}_{j} + 1e0 AS a_{i}_{j}" for i in range(n) for j in range(n)), *(f"b_{i}_0" for i in range(n))])
    return f"WITH {_evaluated(game, Law(even_sizes(1, n - 1)), count, seed, paired)}, {begin}, e0 AS (SELECT {cells} FROM eg), {solved(n, 1)} {_list([f'b_{i}_0 + (u1 - u0) / {n}e0' for i in range(n)], f'e{n}', digits)}"


def ame(game: str, spec: Semivalue, count: int, seed: int, paired: bool, digits: int = 2) -> str:
    n = PLAYERS[game]
    a, b = spec.params
    scale = (a + b - 1) * (a + b - 2) / ((a - 1) * (b - 1))
    z = [f"x{i} / t - (1e0 - x{i}) / (1e0 - t)" for i in range(n)] + ["1e0"]
    return f"WITH {_evaluated(game, coin_of(spec), count, seed, paired)}, {gram('ev', z, ['u'])}, {solved(n + 1, 1)} {_list([f'{number(scale)} * b_{i}_0' for i in range(n)], f'e{n + 1}', digits)}"


def poly_shap(game: str, order: int, count: int, seed: int, paired: bool, digits: int = 2) -> str:
    n = PLAYERS[game]
    sets = [t for r in range(1, order + 1) for t in combinations(range(n), r)]
    m = len(sets)
    begin = gram("ev", [" * ".join(f"x{i}" for i in t) for t in sets], ["u - u0"]).replace("e0 AS", "eg AS", 1)
    ones = f"e0 AS (SELECT *, {', '.join(f'1e0 AS b_{i}_1' for i in range(m))} FROM eg)"
    fit = _constrained(m)
    named = f"fit AS (SELECT {', '.join(f'{f} AS c{i}' for i, f in enumerate(fit))} FROM e{m} CROSS JOIN ends)"
    values = [" + ".join(f"c{k} / {len(t)}e0" for k, t in enumerate(sets) if i in t) for i in range(n)]
    return f"WITH {_evaluated(game, Law(kernel_sizes(n)), count, seed, paired)}, {begin}, {ones}, {solved(m, 2)}, {named} {_list(values, 'fit', digits)}"


def regression_msr(game: str, spec: Semivalue, count: int, seed: int, paired: bool, unbiased: bool, folds: int = 10, digits: int = 2, special: bool = True, distinct: bool = False) -> str:
    """Fits per fold on the other folds, then the mean of fit and correction over folds by their samples.

    distinct: different coalitions, of each size as many as are expected; a coalition's chance is its share of those.
    """
    n = PLAYERS[game]
    law = balanced_law(spec, n)
    chance = coalition_chance(law, n).tolist()
    if distinct:
        from attrispark.operators.subsets import taken

        drawn = {s: v for s, v in law.items() if v > 0}
        law = {s: float(m) for s, m in taken(drawn, n, count).items()}
        chance = [law.get(s, 0.0) / comb(n, s) / sum(law.values()) for s in range(n + 1)]
        bits = ", ".join(f"((d.mask >> {i}) & 1)::double AS x{i}" for i in range(n))
        evaluated = f"{table(game)}, d AS ({without_replacement(drawn, n, count, seed)}), ev AS (SELECT d.mask AS k, d.mask, d.s, u, u0, u1, {bits} FROM d JOIN util USING (mask) CROSS JOIN ends)"
    else:
        evaluated = _evaluated(game, Law({s: v for s, v in law.items() if v > 0}), count, seed, paired)
    q = by_size(chance)
    kernel, kernelled = kernel_sizes(n), spec.is_shapley and special
    root = by_size([(kernel.get(s, 0.0) / comb(n, s) if kernelled else sum(chance) / len(chance)) / chance[s] if chance[s] else 0.0 for s in range(n + 1)])
    x = [f"x{i}" for i in range(n)]
    fold = f"floor({uniform_sql('k', repr('fold'), seed)} * {folds})::int"
    parts = [evaluated, f"fd AS (SELECT *, {fold} AS f FROM ev), pair AS (SELECT o.f AS g, fd.* FROM fd JOIN (SELECT DISTINCT f FROM fd) o ON o.f <> fd.f)"]
    if kernelled:
        parts.append(gram("pair", x, ["u - u0"], root, "g").replace("e0 AS", "eg AS", 1))
        parts.append(f"e0 AS (SELECT *, {', '.join(f'1e0 AS b_{i}_1' for i in range(n))} FROM eg)")
        parts.append(solved(n, 2, "g"))
        parts.append(f"fit AS (SELECT g, u0 AS c{n}, {', '.join(f'{v} AS c{i}' for i, v in enumerate(_constrained(n)))} FROM e{n} CROSS JOIN ends)")
    else:
        parts.append(gram("pair", [*x, "1e0"], ["u"], root, "g"))
        parts.append(solved(n + 1, 1, "g"))
        parts.append(f"fit AS (SELECT g, {', '.join(f'b_{i}_0 AS c{i}' for i in range(n + 1))} FROM e{n + 1})")
    fitted = " + ".join([*(f"c{i} * x{i}" for i in range(n)), f"c{n}"])
    parts.append(f"res AS (SELECT fd.*, u - ({fitted}) AS r, {', '.join(f'c{i}' for i in range(n))} FROM fd JOIN fit ON fit.g = fd.f)")
    inside, outside = by_size(spec.p(n), first=1), by_size(spec.p(n))
    pieces = []
    p_in = sum(v * s / n for s, v in law.items()) / sum(law.values())
    for i in range(n):
        g = f"(x{i} * {inside} - (1e0 - x{i}) * {outside}) / {q}"
        mean = f"avg(r * {g})" if unbiased else f"coalesce(sum(r * {g} * x{i}) / nullif(sum(x{i}), 0), 0) * {number(p_in)} + coalesce(sum(r * {g} * (1e0 - x{i})) / nullif(sum(1e0 - x{i}), 0), 0) * {number(1 - p_in)}"
        pieces.append(f"SELECT {i} AS player, count(*) AS m, any_value(c{i}) + {mean} AS v FROM res GROUP BY f")
    return f"WITH {', '.join(parts)} SELECT player::int AS player, round(sum(m * v) / sum(m), {digits}) AS value FROM ({' UNION ALL '.join(pieces)}) GROUP BY 1"


def two_stage(game: str, spec: Semivalue, count: int, seed: int, group: list[int] | None = None, folds: int = 10, fraction: float = 0.2, floor: float = 1e-8, least: int = 2, ridge: float = 1.0, digits: int = 2, pilot: int | None = None) -> str:
    """Both stages: a pilot by the first law, the ridge fit, the second law from its residuals, then the fits across folds.

    What the surrogate stands for is summed over all coalitions here, not read off formulas.
    """
    n, g = PLAYERS[game], len(group or [])
    mask, w = sum(1 << i for i in group or []), g + 1
    paired = group is None and spec.symmetric
    left = max(2, count - 2 * n - 2)
    pilot = max(2, int(left * fraction)) if pilot is None else min(pilot, left)
    p = spec.p(n)
    cells = {}
    for s in range(2, n - 1):
        for r in range(max(0, s - n + g), min(g, s) + 1):
            root = (s * p[s - 1] ** 2 + (n - s) * p[s] ** 2) ** 0.5 if group is None else abs(r * p[s - 1] - (g - r) * p[s])
            if root:
                cells[s * w + r] = (comb(g, r) * comb(n - g, s - r), root)
    raw = {c: (root + cells[n - c][1]) / 2 if paired else root for c, (_, root) in cells.items()}
    total = sum(v * cells[c][0] for c, v in raw.items())
    values = ", ".join(f"({c}, {m}, {root!r}::double, {raw[c] / total!r}::double)" for c, (m, root) in cells.items())

    bits = ", ".join(f"((mask >> {i}) & 1)::double AS x{i}" for i in range(n))
    z = ["1e0", "ln(1e0 + s)", f"(s / {n}e0) ** 2", *([f"r / s::double"] if group else []), *(f"x{i}" for i in range(n))]
    inside, outside = by_size(p, first=1), by_size(p)
    gamma = [f"(r * {inside} - ({g} - r) * {outside})"] if group else [f"(x{i} * {inside} - (1e0 - x{i}) * {outside})" for i in range(n)]
    d, t = len(z), len(gamma)
    shaped = f"bit_count(mask)::int AS s, bit_count(mask & {mask})::int AS r, {bits}"

    def draw(name: str, salt: str, wanted: int, law: str) -> str:
        """CTEs that end in name(k, mask, f, code, u, z_j, h_t, w2): law has (cell, q, upto)."""
        key = f"(k.range::varchar || '{salt}')"
        bases = -(-wanted // 2) if paired else wanted
        want = f"CASE WHEN mine = 1 THEN cell % {w} ELSE cell // {w} - cell % {w} END"
        both = f" UNION ALL SELECT k, xor({(1 << n) - 1}::bigint, mask), f FROM {name}_m" if paired else ""
        return f"""{name}_c AS (SELECT k.range AS k, coalesce(min(CASE WHEN {uniform_sql(key, "'cell'", seed)} < upto THEN cell END), max(cell)) AS cell, any_value(floor({uniform_sql(key, "'fold'", seed)} * {folds})::int) AS f FROM range({bases}) k CROSS JOIN {law} GROUP BY 1),
{name}_r AS (SELECT k.range AS k, i.range::int AS i, ({mask} >> i.range::int) & 1 AS mine, row_number() OVER (PARTITION BY k.range, ({mask} >> i.range::int) & 1 ORDER BY md5({key} || ':' || i.range::varchar || ':{seed}'), i.range) AS o FROM range({bases}) k CROSS JOIN range({n}) i),
{name}_m AS (SELECT k, sum(CASE WHEN o <= {want} THEN 1::bigint << i ELSE 0 END)::bigint AS mask, any_value(f) AS f FROM {name}_r JOIN {name}_c USING (k) GROUP BY 1),
{name}_x AS (SELECT k, mask, f, u, {shaped} FROM (SELECT * FROM {name}_m{both}) JOIN util USING (mask)),
{name} AS (SELECT k, mask, f, cell AS code, u, {", ".join(f"{e} AS z_{j}" for j, e in enumerate(z))}, {", ".join(f"{e} / q AS h_{j}" for j, e in enumerate(gamma))}, ({" + ".join(f"{e} ** 2" for e in gamma)}) / q ** 2 AS w2 FROM {name}_x JOIN {law} ON cell = s * {w} + r)"""

    sums = [*(f"sum(w2 * z_{i} * z_{j}) AS s_{i}_{j}" for i in range(d) for j in range(d)), *(f"sum(w2 * z_{i} * u) AS s_{i}_u" for i in range(d))]
    sums += [*(f"sum(h_{k} * z_{i}) AS b_{k}_{i}" for k in range(t) for i in range(d)), *(f"sum(h_{k} * u) AS b_{k}_u" for k in range(t)), "count(*)::double AS m"]
    names = [x.rsplit(" AS ", 1)[1] for x in sums]
    cell_of = lambda i, j: f"s_{i}_{j} - ({' + '.join(f'b_{k}_{i} * b_{k}_{j}' for k in range(t))}) / m"
    system = ", ".join([*(f"{cell_of(i, j)}{f' + {number(ridge)}' if i == j else ''} AS a_{i}_{j}" for i in range(d) for j in range(d)), *(f"{cell_of(i, 'u')} AS b_{i}_0" for i in range(d))])
    fitted = " + ".join(f"b_{i}_0 * z_{i}" for i in range(d))
    law = lambda name, of, q: f"{name} AS (SELECT cell, cnt, root, q, sum(q * cnt / whole) OVER (ORDER BY cell) AS upto FROM (SELECT *, {q} AS q FROM {of}), (SELECT sum({q} * cnt) AS whole FROM {of}))"
    seen = "SELECT mask, x.d AS r FROM one JOIN (SELECT k, max_by(r, mask) - min_by(r, mask) AS d FROM one GROUP BY 1) x USING (k)" if paired else "SELECT mask, r FROM one"
    mirror = f"(own + (SELECT own FROM scaled o WHERE o.cell = {n} - scaled.cell)) / 2" if paired else "own"
    ends = f"bit_count(mask) IN (0, 1, {n - 1}, {n})"
    whole = f"""every AS (SELECT u, {ends} AS edge, {", ".join(f"{e} AS z_{j}" for j, e in enumerate(z)).replace("r / s::double", "coalesce(r / nullif(s, 0)::double, 0)")}, {", ".join(f"{e} AS g_{k}" for k, e in enumerate(gamma))} FROM (SELECT mask, u, {shaped} FROM util)),
zeta AS (SELECT {", ".join(f"sum(CASE WHEN NOT edge THEN g_{k} * z_{i} END) AS y_{k}_{i}" for k in range(t) for i in range(d))}, {", ".join(f"sum(CASE WHEN edge THEN g_{k} * u END) AS e_{k}" for k in range(t))} FROM every)"""
    values_of = [f"sum(st.m * ({' + '.join(f'y_{k}_{i} * b.b_{i}_0' for i in range(d))}) + st.b_{k}_u - ({' + '.join(f'st.b_{k}_{i} * b.b_{i}_0' for i in range(d))})) / sum(st.m) + any_value(e_{k})" for k in range(t)]
    rows = " UNION ALL ".join(f"SELECT {f'{k}::int AS player, ' if group is None else ''}round({v}, {digits}) AS value FROM st JOIN b USING (f) CROSS JOIN zeta" for k, v in enumerate(values_of))
    return f"""WITH {table(game)}, cells(cell, cnt, root, q1) AS (VALUES {values}), {law("law1", "cells", "q1")}, {draw("one_", "a", pilot, "law1")},
p0 AS (SELECT {system} FROM (SELECT {", ".join(sums)} FROM one_)), {solved(d, 1, begin="p0", name="p")},
one AS (SELECT k, mask, code, u - ({fitted}) AS r FROM one_ CROSS JOIN p{d}), seen AS ({seen}),
moment AS (SELECT bit_count(mask) * {w} + bit_count(mask & {mask}) AS cell, avg(r * r) AS v, count(*) AS c FROM seen GROUP BY 1),
scaled AS (SELECT cells.*, root * sqrt(greatest(1e-12, CASE WHEN c >= {least} THEN v ELSE (SELECT sum(v * c) / sum(c) FROM moment) END)) AS own FROM cells LEFT JOIN moment USING (cell)),
moved AS (SELECT cell, cnt, root, q1, {mirror} AS raw FROM scaled), settled AS (SELECT *, {1 - floor!r} * raw / (SELECT sum(raw * cnt) FROM moved) + {floor!r} * q1 AS q2 FROM moved), {law("law2", "settled", "q2")},
{draw("two_", "b", left - pilot, "law2")}, al AS (SELECT * FROM one_ UNION ALL SELECT * FROM two_), st AS (SELECT f, {", ".join(sums)} FROM al GROUP BY f), tot AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in names)} FROM st),
rest AS (SELECT st.f, {", ".join(f"tot.{c} - st.{c} AS {c}" for c in names)} FROM st CROSS JOIN tot), q0 AS (SELECT f, {system} FROM rest), {solved(d, 1, "f", "q0", "q")}, b AS (SELECT * FROM q{d}), {whole}
{rows}"""


def inverse_normal(z: str) -> str:
    """The standard normal quantile by Newton steps on the series of the distribution function."""
    odd, factors = 1, []
    for k in range(61):
        odd = odd * (2 * k + 1) if k else 1
        factors.append(float(odd))
    cdf = f"(0.5e0 + list_sum(list_transform(range(61), lambda k: x ** (2 * k + 1) / {factors}[k + 1])) * exp(-x * x / 2) / 2.5066282746310002e0)"
    step = f"x - greatest(-1e0, least(1e0, ({cdf} - {z}) * 2.5066282746310002e0 * exp(x * x / 2)))"
    return f"list_reduce(list_transform(range(12), lambda i: i::double), lambda x, i: {step}, 0e0)"


def structured_terms(n: int, count: str, seed: int, alpha: float, digits: int = 6) -> str:
    """Single players and pairs by id, then larger sets; variances shared out as the number of terms says."""
    low = n + n * (n - 1) // 2
    pairs = [1 << i for i in range(n)] + [(1 << i) | (1 << j) for i in range(n) for j in range(i + 1, n)]
    size = draw_size_sql(uniform_sql("k", "'size'", seed), {s: 1.0 for s in range(3, n)})
    z = uniform_sql("k", "'w'", seed)
    return f"""WITH c AS (SELECT {count} AS n), ids AS (SELECT r.range AS k FROM range({low}, {low} + {count}) r), r AS (SELECT k, i.range AS i, row_number() OVER (PARTITION BY k ORDER BY md5(k::varchar || ':' || i.range::varchar || ':{seed}'), i.range) AS o FROM ids CROSS JOIN range({n}) i),
t AS (SELECT k, sum(CASE WHEN o <= s THEN 1::bigint << i::int ELSE 0 END)::bigint AS mask FROM (SELECT k, {size} AS s FROM ids) JOIN r USING (k) GROUP BY 1 UNION ALL SELECT range, {pairs}[range + 1]::bigint FROM range({low})),
u AS (SELECT k, mask, greatest(1e-12, least(1 - 1e-12, {z})) AS z, CASE WHEN k < {low} THEN sqrt({alpha * alpha!r}::double * ({low} + n) / {low}) ELSE sqrt({1 - alpha * alpha!r}::double * ({low} + n) / n) END AS scale FROM t CROSS JOIN c)
SELECT mask, round(sum(scale * {inverse_normal("z")}), {digits}) AS w FROM u GROUP BY 1"""


def group_strata_sampled(game: str, group: list[int], per_stratum: int, seed: int, digits: int = 2) -> str:
    """Sample k is of stratum k mod their number; a stratum's mean worth weighs as the covariance of overlap and worth says (all sizes below the threshold)."""
    n, g = PLAYERS[game], len(group)
    mask = sum(1 << i for i in group)
    cells = [(s, r, comb(g, r) * comb(n - g, s - r) / comb(n, s) * (r - g * s / n) * n / (s * (n - s))) for s in range(1, n) for r in range(max(0, s - n + g), min(g, s) + 1)]
    cells = sorted(c for c in cells if c[2])
    values = ", ".join(f"({i}, {s}, {r}, {w!r}::double)" for i, (s, r, w) in enumerate(cells))
    return f"""WITH {table(game)}, cell(c, s, r, w) AS (VALUES {values}), o AS (SELECT k.range AS k, i.range::int AS i, ({mask} >> i.range::int) & 1 AS mine, row_number() OVER (PARTITION BY k.range, ({mask} >> i.range::int) & 1 ORDER BY md5(k.range::varchar || ':' || i.range::varchar || ':{seed}'), i.range) AS o FROM range({per_stratum * len(cells)}) k CROSS JOIN range({n}) i),
m AS (SELECT k, sum(CASE WHEN o <= CASE WHEN mine = 1 THEN r ELSE s - r END THEN 1::bigint << i ELSE 0 END)::bigint AS mask, any_value(c) AS c FROM o JOIN cell ON c = k % {len(cells)} GROUP BY 1),
v AS (SELECT w * avg(u) AS v FROM m JOIN util USING (mask) JOIN cell USING (c) GROUP BY c, w)
SELECT round({g}e0 / {n} * any_value(u1 - u0) + sum(v), {digits}) AS value FROM v CROSS JOIN ends"""


def group_strata(game: str, group: list[int], threshold: int, digits: int = 4) -> str:
    """A group's Shapley value from stratum means: the covariance of overlap and worth below the threshold, a difference quotient from there on."""
    n, g = PLAYERS[game], len(group)
    mask = sum(1 << i for i in group)
    cells = ", ".join(f"({s}, {r}, {float(comb(g, r) * comb(n - g, s - r) / comb(n, s))!r}::double)" for s in range(1, n) for r in range(max(0, s - n + g), min(g, s) + 1))
    lo, hi = f"greatest(0, s - {n - g})", f"least({g}, s)"
    middle = f"round_even({g}e0 * s / {n}, 0)::int"
    return f"""WITH {table(game)}, law(s, r, p) AS (VALUES {cells}), m AS (SELECT bit_count(mask)::int AS s, bit_count(mask & {mask})::int AS r, avg(u) AS m FROM util GROUP BY 1, 2),
below AS (SELECT sum(p * (law.r - {g}e0 * law.s / {n}) * m * {n}e0 / (law.s * ({n} - law.s))) AS v FROM law JOIN m USING (s, r) WHERE s < {threshold}),
q AS (SELECT s, least({hi}, {middle} + 1) AS up, greatest({lo}, {middle} - 1) AS down FROM (SELECT DISTINCT s FROM law WHERE s >= {threshold})),
above AS (SELECT sum((a.m - b.m) / (up - down)) * {g / n * (1 - g / n)!r}::double AS v FROM q JOIN m a ON a.s = q.s AND a.r = up JOIN m b ON b.s = q.s AND b.r = down WHERE up > down)
SELECT round({g}e0 / {n} * (u1 - u0) + coalesce(below.v, 0) + coalesce(above.v, 0), {digits}) AS value FROM ends CROSS JOIN below CROSS JOIN above"""


def without_replacement(law: dict[int, float], n: int, count: int, seed: int) -> str:
    """Ranks of each size: all of them by digest where few, else the first that differ among draws; then the sets in lexicographic order."""
    from attrispark.operators.subsets import ENUMERATED, taken

    picks, shares = [], {}
    for s, m in taken(law, n, count).items():
        total = comb(n, s)
        shares[s] = m / total
        if total <= ENUMERATED * m:
            picks.append(f"SELECT {s} AS s, rank FROM (SELECT range AS rank, row_number() OVER (ORDER BY md5(range::varchar || ':pick{s}:{seed}'), range) AS o FROM range({total})) WHERE o <= {m}")
        elif m:
            tried = 64 * (m + 16)
            picks.append(f"SELECT {s} AS s, rank FROM (SELECT rank, row_number() OVER (ORDER BY min(id)) AS o FROM (SELECT range AS id, ('0x' || substr(md5(range::varchar || ':pick{s}:{seed}'), 1, 15))::bigint % {total} AS rank FROM range({tried})) GROUP BY rank) WHERE o <= {m}")
    order = ", ".join(f"(m.range >> {i}) & 1 DESC" for i in range(n))
    share = "CASE s " + " ".join(f"WHEN {s} THEN {v!r}::double" for s, v in shares.items()) + " END"
    return f"WITH m AS (SELECT range AS mask, bit_count(range)::int AS s, row_number() OVER (PARTITION BY bit_count(range) ORDER BY {order}) - 1 AS rank FROM range({1 << n}) m), p AS ({' UNION ALL '.join(picks)}) SELECT mask, s, round({share}, 8) AS chance FROM m JOIN p USING (s, rank)"


def tree_msr(game: str, spec: Semivalue, count: int, seed: int, trees: int = 10, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, digits: int = 2) -> str:
    """Boosting level by level; every coalition goes through the trees with weight 0, so that what they stand for is summed, not read off leaves."""
    n = PLAYERS[game]
    law = balanced_law(spec, n)
    q = by_size(coalition_chance(law, n).tolist())
    parts = [f"{table(game)}, {samples(Law({s: v for s, v in law.items() if v > 0}), n, count, seed)}"]
    parts.append("r0 AS MATERIALIZED (SELECT mask, u, 1e0 AS w, (SELECT avg(u) FROM smp JOIN util USING (mask)) AS f FROM smp JOIN util USING (mask) UNION ALL SELECT mask, u, 0e0, (SELECT avg(u) FROM smp JOIN util USING (mask)) FROM util)")
    share = lambda g, h: f"({g}) ** 2 / ({h} + {penalty!r}::double)"
    for t in range(trees):
        parts.append(f"n{t}_0 AS (SELECT *, 1 AS node FROM r{t})")
        for level in range(depth):
            of = f"n{t}_{level}"
            parts.append(f"g{t}_{level} AS (SELECT node, p.range::int AS i, sum(w * (f - u)) AS g, sum(w) AS h, sum(w * (f - u) * ((mask >> p.range::int) & 1)) AS g1, sum(w * ((mask >> p.range::int) & 1)) AS h1 FROM {of} CROSS JOIN range({n}) p GROUP BY 1, 2)")
            parts.append(f"b{t}_{level} AS MATERIALIZED (SELECT node, i FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, i) AS o FROM (SELECT *, {share('g1', 'h1')} + {share('g - g1', 'h - h1')} - {share('g', 'h')} AS gain FROM g{t}_{level} WHERE node >= {1 << level} AND h1 > 1e-9 * h AND h - h1 > 1e-9 * h)) WHERE o = 1 AND gain > 0)")
            parts.append(f"n{t}_{level + 1} AS MATERIALIZED (SELECT mask, u, w, f, CASE WHEN i IS NULL THEN node ELSE 2 * node + ((mask >> i) & 1) END AS node FROM {of} LEFT JOIN b{t}_{level} USING (node))")
        parts.append(f"r{t + 1} AS MATERIALIZED (SELECT mask, u, w, f - {rate!r}::double * sum(w * (f - u)) OVER (PARTITION BY node) / (sum(w) OVER (PARTITION BY node) + {penalty!r}::double) AS f FROM n{t}_{depth})")
    inside, outside = by_size(spec.p(n), first=1, column="bit_count(mask)"), by_size(spec.p(n), column="bit_count(mask)")
    gamma = f"(CASE WHEN (mask >> p.range::int) & 1 = 1 THEN {inside} ELSE -{outside} END)"
    chance = q.replace("CASE s ", "CASE bit_count(mask) ")
    return f"WITH {', '.join(parts)} SELECT p.range::int AS player, round(sum(CASE WHEN w = 0 THEN {gamma} * f END) + avg(CASE WHEN w = 1 THEN {gamma} * (u - f) / {chance} END), {digits}) AS value FROM r{trees} CROSS JOIN range({n}) p GROUP BY 1"


# All suppliers as players, by membership rows instead of masks.

_SUPPLIERS = """sup AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS player FROM supplier), nn AS (SELECT count(*)::int AS n FROM sup),
tm AS MATERIALIZED (SELECT DISTINCT l_orderkey AS g, player FROM lineitem JOIN sup ON l_suppkey = s_suppkey),
tw AS MATERIALIZED (SELECT g, count(*) AS size, any_value(w) AS w FROM tm JOIN (SELECT l_orderkey AS g, sum(l_extendedprice * (1 - l_discount)) AS w FROM lineitem GROUP BY 1) USING (g) GROUP BY 1)"""


def wide_closed_form(share: str, digits: int = 2) -> str:
    """share: SQL over the term's size."""
    return f"WITH {_SUPPLIERS} SELECT player::int AS player, round(coalesce(sum(w * {share}), 0), {digits}) AS value FROM sup LEFT JOIN tm USING (player) LEFT JOIN tw USING (g) GROUP BY 1"


def wide_estimate(inside: str, outside: str | None, value: str, count: int, seed: int, coin: str | None = None, sizes: str | None = None, paired: bool = False, digits: int = 2) -> str:
    """coin: SQL of the probability t of a sample k; sizes: SQL of a size's mass over s and n.  inside, outside and value as in estimators.RULES."""
    bases = -(-count // 2) if paired else count
    slot = "player::varchar"
    if coin is not None:
        drawn = f"smp0 AS (SELECT k.range AS k, player, {uniform_sql('k.range', slot, seed)} < t AS x, t FROM range({bases}) k JOIN (SELECT range AS kk, {coin} AS t FROM range({bases}) k) ON kk = k.range CROSS JOIN sup)"
    else:
        drawn = f"""law AS (SELECT s, sum(v / (SELECT sum(v) FROM mass)) OVER (ORDER BY s) AS upto FROM mass), size AS (SELECT k.range AS k, coalesce(min(CASE WHEN {uniform_sql('k.range', "'size'", seed)} < upto THEN s END), max(s)) AS want FROM range({bases}) k CROSS JOIN law GROUP BY 1),
smp0 AS (SELECT k, player, row_number() OVER (PARTITION BY k ORDER BY md5(k::varchar || ':' || player::varchar || ':{seed}'), player) <= want AS x, NULL::double AS t FROM size CROSS JOIN sup)"""
        drawn = f"mass AS (SELECT s.range AS s, {sizes} AS v FROM nn, range(1, (SELECT n FROM nn)) s), {drawn}"
    side = " UNION ALL SELECT k, 1 AS side, player, NOT x, 1 - t FROM smp0" if paired else ""
    mean = f"avg({inside})" if outside is None else f"coalesce(avg(CASE WHEN x = 1 THEN {inside} END), 0) - coalesce(avg(CASE WHEN x = 0 THEN {outside} END), 0)"
    return f"""WITH {_SUPPLIERS}, {drawn}, smp AS MATERIALIZED (SELECT k, 0 AS side, player, x, t FROM smp0{side}),
u AS (SELECT k, side, sum(w) AS u FROM (SELECT k, side, g, count(*) AS held FROM smp JOIN tm USING (player) WHERE x GROUP BY ALL) JOIN tw USING (g) WHERE held = size GROUP BY ALL),
ends AS (SELECT 0e0 AS u0, sum(w) AS u1 FROM tw), sz AS (SELECT k, side, sum(x::int) AS s FROM smp GROUP BY ALL),
row AS (SELECT player, smp.x::int::double AS x, t, s, n, u0, u1, coalesce(u.u, 0) AS u FROM smp JOIN sz USING (k, side) LEFT JOIN u USING (k, side) CROSS JOIN ends CROSS JOIN nn),
raw AS (SELECT player, {mean} AS v, any_value(u0) AS u0, any_value(u1) AS u1, any_value(n) AS n FROM row GROUP BY 1), own AS (SELECT *, sum(v) OVER () AS total FROM raw)
SELECT player::int AS player, round({value}, {digits}) AS value FROM own"""


def training(n: int, every: int, rate: float, seed: int, extra: str = "false", digits: int = 8) -> str:
    """One pass of single-row steps of a two-class softmax regression, a step of the recursion per row; `extra` tells rows that train every coalition."""
    dot = lambda w: f"list_dot_product({w}, x)"
    p0, p1 = f"1e0 / (1e0 + exp({dot('w1')} - {dot('w0')}))", f"1e0 / (1e0 + exp({dot('w0')} - {dot('w1')}))"
    moved = lambda w, p, c: f"CASE WHEN mine THEN list_transform(list_zip({w}, x), lambda a: a[1] - {rate!r}::double * ({p} - (y = {c})::int) * a[2]) ELSE {w} END"
    zero = "list_transform(range((SELECT max(len(x)) FROM e)), lambda i: 0e0)"
    own = f"WITH RECURSIVE e AS (SELECT vec_id, list_append(list_transform(embedding, lambda v: v::double), 1e0) AS x, label % 2 AS y FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), t AS MATERIALIZED (SELECT *, {extra} AS everyone, row_number() OVER (ORDER BY md5(vec_id::varchar || ':order:{seed}'), vec_id) AS o FROM e WHERE vec_id % {every} <> 0)"
    steps = f"s(k, mask, w0, w1) AS (SELECT 0::bigint, m.range, {zero}, {zero} FROM range({1 << n}) m UNION ALL SELECT o, mask, {moved('w0', p0, 0)}, {moved('w1', p1, 1)} FROM (SELECT s.*, t.*, everyone OR (mask >> (vec_id % {n})::int) & 1 = 1 AS mine FROM s JOIN t ON t.o = s.k + 1))"
    scored = f"util AS (SELECT mask, avg(CASE WHEN y = 0 THEN ln({p0}) ELSE ln({p1}) END) AS u FROM (SELECT * FROM s WHERE k = (SELECT max(o) FROM t)) CROSS JOIN (SELECT * FROM e WHERE vec_id % {every} = 0) GROUP BY 1)"
    return f"{own}, {steps}, {scored}, x AS ({exact_body(n, Semivalue('shapley'))}) SELECT player, round(value, {digits}) AS value FROM x"
