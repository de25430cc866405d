"""Every query by name, with the SQL that must give the same rows.

Estimators with a solve on the driver, and the two-stage ones, are registered
over the whole population of their law, where they equal the exact values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrispark.functions import draws
from attrispark.functions.spec import BANZHAF, SHAPLEY, Semivalue, banzhaf, beta
from attrispark.operators import estimators as est
from attrispark.operators import exact, groups, regression, report, subsets, trajectory, transform
from attrispark.operators import wide as many
from attrispark.plans import oracle
from attrispark.sources import games, lazy, store, wide

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SPECS: dict[str, Semivalue] = {"shapley": SHAPLEY, "banzhaf_p50": BANZHAF, "banzhaf_p25": banzhaf(0.25), "beta_4_1": beta(4, 1), "beta_1_4": beta(1, 4)}
#: Samples and seed of the registered estimators.  Means of cents over 300 samples have no ties at four digits.
COUNT, SEED = 300, 7


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Values as both engines print them; players as plain integers."""
    out = df
    for c in columns or ("value",):
        out = out.withColumn(c, F.round(F.col(c), digits))
    return out.withColumn("player", F.col("player").cast("int")) if "player" in out.columns else out


def on(game: str, run: Callable, digits: int = 4) -> Query:
    return lambda spark, sf_dir: rounded(run(games.GAMES[game](spark, sf_dir)), digits)


# Closed forms, enumeration, groups.

for _game in ("region", "segment", "event", "nation", "brand"):
    for _name, _spec in SPECS.items():
        add(f"sou_{_name}_{_game}", on(_game, lambda g, s=_spec: exact.closed_form(g, s), 2), oracle.closed_form(_game, _spec))
for _name, _spec in SPECS.items():
    add(f"exact_{_name}_region", on("region", lambda g, s=_spec: exact.enumerated(g, s), 2), oracle.exact("region", _spec))
for _game in ("segment", "event"):
    add(f"exact_shapley_{_game}", on(_game, lambda g: exact.enumerated(g, SHAPLEY), 2), oracle.exact(_game, SHAPLEY))
add("exact_coefficient_form", on("region", lambda g: exact.coefficients(g, beta(2, 3)), 2), oracle.exact("region", beta(2, 3)))
for _name, _spec in SPECS.items():
    add(f"exact_group_{_name}", on("segment", lambda g, s=_spec: exact.group_sum(g, s, [0, 2, 4]), 2), oracle.exact_group("segment", _spec, [0, 2, 4]))

# All coalitions of 25 players; the closed form must give the same.

for _name, _spec, _game in (("shapley", SHAPLEY, "nation"), ("banzhaf_p25", banzhaf(0.25), "nation"), ("beta_4_1", beta(4, 1), "brand")):
    add(f"transform_{_name}_{_game}", on(_game, lambda g, s=_spec: transform.exact(g, s), 2), oracle.closed_form(_game, _spec))
add("transform_group_nation", on("nation", lambda g: transform.exact_group(g, beta(4, 1), [1, 3, 17, 24]), 2), f"SELECT round(sum(value), 2) AS value FROM ({oracle.closed_form('nation', beta(4, 1), 12)}) WHERE player IN (1, 3, 17, 24)")
add("transform_by_size_segment", lambda spark, d: rounded(transform.by_size(games.segment_part_year(spark, d)), 2, "mean", "least", "most"), f"WITH {oracle.table('segment')} SELECT bit_count(mask)::int AS s, count(*) AS coalitions, round(avg(u), 2) AS mean, round(min(u), 2) AS least, round(max(u), 2) AS most FROM util GROUP BY 1")
add("transform_table_event", lambda spark, d: rounded(transform.table(games.event_user_day(spark, d)), 2, "u"), f"WITH {oracle.table('event')} SELECT mask, round(u, 2) AS u FROM util")

# As many players as there are suppliers.

add("wide_shapley", lambda spark, d: rounded(many.closed_form(wide.supplier_revenue(spark, d), SHAPLEY), 2), oracle.wide_closed_form("1e0 / size"))
add("wide_banzhaf_p25", lambda spark, d: rounded(many.closed_form(wide.supplier_revenue(spark, d), banzhaf(0.25)), 2), oracle.wide_closed_form("0.25e0 ** (size - 1)"))
add("wide_beta_4_1", lambda spark, d: rounded(many.closed_form(wide.supplier_revenue(spark, d), beta(4, 1)), 2), oracle.wide_closed_form("24e0 / (size * (size + 1) * (size + 2) * (size + 3))"))
_HARMONIC = "(SELECT sum(1e0 / range) FROM range(1, (SELECT n FROM nn)))"
_KERNEL = "1e0 / (s.range * (n - s.range))"
for _name, _spec, _paired, _sql in (
    ("msr", BANZHAF, False, oracle.wide_estimate("u", "u", "v", COUNT, SEED, coin="0.5e0")),
    ("msr", BANZHAF, True, oracle.wide_estimate("u", "u", "v", COUNT, SEED, coin="0.5e0", paired=True)),
    ("improved_ame", SHAPLEY, False, oracle.wide_estimate("u * (x / t - (1e0 - x) / (1e0 - t))", None, "v", COUNT, SEED, coin=draws.uniform_sql("k.range", "'t'", SEED))),
    ("unbiased_kernel_shap", SHAPLEY, False, oracle.wide_estimate("(x - s / n::double) * (u - u0)", None, f"(u1 - u0) / n + 2 * {_HARMONIC} * v", COUNT, SEED, sizes=_KERNEL)),
    ("gels_shapley", SHAPLEY, True, oracle.wide_estimate("u", "0e0", f"{_HARMONIC} * v + (u1 - u0 - {_HARMONIC} * total) / n", COUNT, SEED, sizes=_KERNEL, paired=True)),
):
    add(f"wide_est_{_name}{'_paired' * _paired}", lambda spark, d, n=_name, c=_spec, p=_paired: rounded(many.estimate(n, wide.supplier_revenue(spark, d), c, COUNT, SEED, p), 2), _sql)

# Utilities.

add("utility_table_region", lambda spark, d: rounded(games.region_revenue(spark, d).table(), 2, "u").select("mask", "u"), f"WITH {oracle.table('region')} SELECT mask, round(u, 2) AS u FROM util")


def _utility_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    game = games.nation_revenue(spark, sf_dir)
    return rounded(game.evaluate(est.sample(spark, est.Law(coin=0.5), game.n, 200, SEED)), 4, "u").select("mask", "u")


add("utility_sampled_nation", _utility_sampled, f"WITH {oracle.terms('nation')}, {oracle.samples(est.Law(coin=0.5), 25, 200, SEED)}, d AS (SELECT DISTINCT mask FROM smp) SELECT d.mask, round(coalesce(sum(w), 0), 4) AS u FROM d LEFT JOIN terms t ON (t.mask & d.mask) = t.mask GROUP BY 1")
add("boundary_values", lambda spark, d: rounded(est.boundary(games.event_user_day(spark, d)), 4, "m").select("player", "s", "inside", "m"), f"WITH {oracle.table('event')} SELECT p.range::int AS player, bit_count(mask)::int AS s, ((mask >> p.range::int) & 1)::int AS inside, round(avg(u), 4) AS m FROM util CROSS JOIN range(5) p WHERE bit_count(mask) IN (0, 1, 4, 5) GROUP BY 1, 2, 3")


def _segment_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = games.read(spark, sf_dir, "customer")
    number = games.few(customer.select("c_mktsegment").distinct().withColumn("player", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("int")), 5)
    return customer.join(F.broadcast(number), "c_mktsegment").groupBy("player").agg(F.sum("c_acctbal").alias("w"))


_BALANCE = "b AS (SELECT player::int AS player, sum(c_acctbal) AS w FROM customer JOIN (SELECT b, row_number() OVER (ORDER BY b) - 1 AS player FROM (SELECT DISTINCT c_mktsegment AS b FROM customer)) ON b = c_mktsegment GROUP BY 1)"
add("additive_utility", lambda spark, d: rounded(games.additive(_segment_balance(spark, d), 5).table(), 2, "u").select("mask", "u"), f"WITH {_BALANCE} SELECT m.range AS mask, round(coalesce(sum(CASE WHEN (m.range >> player) & 1 = 1 THEN w END), 0), 2) AS u FROM range(32) m CROSS JOIN b GROUP BY 1")
add("additive_transformed", lambda spark, d: rounded(games.additive(_segment_balance(spark, d), 5, transform=lambda x: F.sqrt(F.abs(x))).table(), 4, "u").select("mask", "u"), f"WITH {_BALANCE} SELECT m.range AS mask, round(sqrt(abs(coalesce(sum(CASE WHEN (m.range >> player) & 1 = 1 THEN w END), 0))), 4) AS u FROM range(32) m CROSS JOIN b GROUP BY 1")
add("additive_shapley", lambda spark, d: rounded(exact.enumerated(games.additive(_segment_balance(spark, d), 5), SHAPLEY), 2), f"WITH {_BALANCE} SELECT player, round(w, 2) AS value FROM b")
add("additive_noise", lambda spark, d: rounded(games.additive(_segment_balance(spark, d), 5, lam=0.5, sigma=100.0, seed=3, noise=lambda z: z).table(), 4, "u").select("mask", "u"), f"WITH {_BALANCE}, z AS (SELECT player, w, ('0x' || substr(md5('zobrist:3:' || player::varchar), 1, 13))::bigint AS key FROM b), h AS (SELECT m.range AS mask, coalesce(sum(CASE WHEN (m.range >> player) & 1 = 1 THEN w END), 0) AS a, coalesce(bit_xor(CASE WHEN (m.range >> player) & 1 = 1 THEN key ELSE 0 END), 0) AS h FROM range(32) m CROSS JOIN z GROUP BY 1) SELECT mask, round(0.5e0 * a + 50e0 * ((h + 0.5e0) / 4503599627370496e0), 4) AS u FROM h")


add("additive_noise_normal", lambda spark, d: rounded(games.additive(_segment_balance(spark, d), 5, lam=0.5, sigma=100.0, seed=3).table(), 4, "u").select("mask", "u"), f"WITH {_BALANCE}, z AS (SELECT player, w, ('0x' || substr(md5('zobrist:3:' || player::varchar), 1, 13))::bigint AS key FROM b), h AS (SELECT m.range AS mask, coalesce(sum(CASE WHEN (m.range >> player) & 1 = 1 THEN w END), 0) AS a, (coalesce(bit_xor(CASE WHEN (m.range >> player) & 1 = 1 THEN key ELSE 0 END), 0) + 0.5e0) / 4503599627370496e0 AS z FROM range(32) m CROSS JOIN z GROUP BY 1) SELECT mask, round(0.5e0 * a + 50e0 * {oracle.inverse_normal('z')}, 4) AS u FROM h")

#: The query set of a search: every row whose id is divisible by this, against all other rows.
_EVERY = 50
_K, _OWNERS = 3, 8


def _knn_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = games.read(spark, sf_dir, "embeddings").where("embedding is not null")
    points = e.where(f"vec_id % {_EVERY} <> 0").select(F.col("vec_id").alias("player"), "embedding", "label")
    return points, e.where(f"vec_id % {_EVERY} = 0").select(F.col("vec_id").alias("query"), "embedding", "label")


def _knn_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.knn_ranks(*_knn_sides(spark, sf_dir))


def _knn_game(spark: SparkSession, sf_dir: str):
    """Eight owners hold all points by turns of their id."""
    points, queries = _knn_sides(spark, sf_dir)
    owned = points.select((F.col("player") % _OWNERS).alias("player"), F.col("player").alias("id"), "embedding", "label")
    return games.knn_game(games.knn_nearest(owned, queries, _K), _OWNERS, _K)


_KNN = f"e AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL), pr AS (SELECT q.vec_id AS query, p.vec_id AS player, (p.label = q.label)::int AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(range(1, len(p.embedding) + 1), lambda j: (p.embedding[j]::double - q.embedding[j]::double) ** 2)), p.vec_id) AS r FROM e p, e q WHERE p.vec_id % {_EVERY} <> 0 AND q.vec_id % {_EVERY} = 0)"
_KNN_TABLE = f"{_KNN}, n AS (SELECT m.range AS mask, query, hit, row_number() OVER (PARTITION BY m.range, query ORDER BY r) AS p FROM range({1 << _OWNERS}) m JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, player % {_OWNERS} ORDER BY r) AS near FROM pr) WHERE near <= {_K}) x ON (m.range >> (player % {_OWNERS})::int) & 1 = 1), h AS (SELECT mask, sum(hit) AS h FROM n WHERE p <= {_K} GROUP BY 1), util AS (SELECT m.range AS mask, coalesce(h, 0) / ({_K}.0e0 * (SELECT count(DISTINCT query) FROM pr)) AS u FROM range({1 << _OWNERS}) m LEFT JOIN h ON h.mask = m.range)"
add("knn_utility", lambda spark, d: rounded(_knn_game(spark, d).table(), 8, "u").select("mask", "u"), f"WITH {_KNN_TABLE} SELECT mask, round(u, 8) AS u FROM util")
add("knn_ranks", lambda spark, d: _knn_ranks(spark, d).select(F.col("query").cast("int").alias("query"), "player", F.col("r").cast("int").alias("r"), "hit"), f"WITH {_KNN} SELECT query::int AS query, player::int AS player, r::int AS r, hit FROM pr")
_KNN_EXACT = f"WITH {_KNN}, z AS (SELECT *, max(r) OVER (PARTITION BY query) AS n FROM pr), s AS (SELECT query, player, r, CASE WHEN r = n THEN hit / greatest(n, {_K})::double ELSE (hit - lead(hit) OVER (PARTITION BY query ORDER BY r)) / {_K}e0 * least({_K}, r) / r END AS d FROM z), v AS (SELECT player, sum(d) OVER (PARTITION BY query ORDER BY r DESC) AS v FROM s) SELECT player::int AS player, round(avg(v), 8) AS value FROM v GROUP BY 1"
add("knn_shapley", lambda spark, d: rounded(games.knn_shapley(*_knn_sides(spark, d), _K), 8).select("player", "value"), _KNN_EXACT)
add("knn_shapley_enumerated", lambda spark, d: rounded(exact.enumerated(_knn_game(spark, d), SHAPLEY), 7), f"WITH {_KNN_TABLE}, x AS ({oracle.exact_body(_OWNERS, SHAPLEY)}) SELECT player, round(value, 7) AS value FROM x")


def _ridge(spark: SparkSession, sf_dir: str, averaged: bool) -> DataFrame:
    """Players are the line numbers: each holds all lines of that number."""
    rows = games.read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("player"), (F.col("l_quantity") / 50).alias("x1"), (10 * F.col("l_discount")).alias("x2"), (F.col("l_extendedprice") / 1e5).alias("y"))
    return rounded(games.ridge(rows, 7, (1.0, 0.5), 0.1, averaged).table(), 8, "u").select("mask", "u")


def _ridge_sql(weight: str) -> str:
    return f"WITH r AS (SELECT (l_linenumber - 1)::int AS player, l_quantity / 50 AS x1, 10 * l_discount AS x2, l_extendedprice / 1e5 AS y FROM lineitem), s AS (SELECT m.range AS mask, coalesce(sum(x1 * x1), 0) AS a, coalesce(sum(x1 * x2), 0) AS b, coalesce(sum(x2 * x2), 0) AS c, coalesce(sum(x1 * y), 0) AS p, coalesce(sum(x2 * y), 0) AS q, count(player) AS n FROM range(128) m LEFT JOIN r ON (m.range >> player) & 1 = 1 GROUP BY 1), t AS (SELECT mask, a + {weight} AS a, b, c + {weight} AS c, p, q FROM s) SELECT mask, round(((p * c - q * b) / (a * c - b * b) - 1) ** 2 + ((q * a - p * b) / (a * c - b * b) - 0.5) ** 2, 8) AS u FROM t"


add("ridge_utility", lambda spark, d: _ridge(spark, d, False), _ridge_sql("0.1e0"))
add("ridge_utility_mean_loss", lambda spark, d: _ridge(spark, d, True), _ridge_sql("0.1e0 * greatest(1, n)"))

# Forty players: additive and ridge games whose coalitions are evaluated where they are drawn.

_FORTY, _HALF = 40, est.Law(coin=0.5)


def _balance_shares(spark: SparkSession, sf_dir: str, **options) -> lazy.AdditiveGame:
    """Customers share forty players by turns of their key; a player weighs its balances."""
    weights = games.read(spark, sf_dir, "customer").select((F.col("c_custkey") % _FORTY).cast("int").alias("player"), F.col("c_acctbal").alias("w"))
    return lazy.AdditiveGame(_FORTY, weights, **options)


_SHARES = f"b AS (SELECT c_custkey % {_FORTY} AS player, sum(c_acctbal) AS w FROM customer GROUP BY 1), {oracle.samples(_HALF, _FORTY, COUNT, SEED)}"
add("additive_40_sampled", lambda spark, d: rounded(est.worth(_balance_shares(spark, d), est.sample(spark, _HALF, _FORTY, COUNT, SEED)), 2, "u").select("k", "mask", "u"), f"WITH {_SHARES} SELECT k, mask, round(coalesce(sum(w), 0), 2) AS u FROM smp LEFT JOIN b ON (mask >> player::int) & 1 = 1 GROUP BY 1, 2")
add("additive_40_noise", lambda spark, d: rounded(est.worth(_balance_shares(spark, d, lam=0.5, sigma=100.0, seed=3), est.sample(spark, _HALF, _FORTY, COUNT, SEED)), 4, "u").select("k", "mask", "u"), f"WITH {_SHARES}, z AS (SELECT range AS player, ('0x' || substr(md5('zobrist:3:' || range::varchar), 1, 13))::bigint AS key FROM range({_FORTY})), h AS (SELECT k, mask, coalesce(sum(w), 0) AS a, (coalesce(bit_xor(key), 0) + 0.5e0) / 4503599627370496e0 AS z FROM smp JOIN z ON (mask >> player::int) & 1 = 1 LEFT JOIN b USING (player) GROUP BY 1, 2) SELECT k, mask, round(0.5e0 * a + 50e0 * {oracle.inverse_normal('z')}, 4) AS u FROM h")
add("additive_40_msr", lambda spark, d: rounded(est.estimate("msr", _balance_shares(spark, d, transform=lambda x: F.sqrt(F.abs(x))), BANZHAF, COUNT, SEED), 6), f"WITH {_SHARES}, u AS (SELECT k, mask, sqrt(abs(coalesce(sum(w), 0))) AS u FROM smp LEFT JOIN b ON (mask >> player::int) & 1 = 1 GROUP BY 1, 2) SELECT p.range::int AS player, round(avg(CASE WHEN (mask >> p.range::int) & 1 = 1 THEN u END) - avg(CASE WHEN (mask >> p.range::int) & 1 = 0 THEN u END), 6) AS value FROM u CROSS JOIN range({_FORTY}) p GROUP BY 1")
_BETA = [1.0, 0.5, -0.25, 0.0, 0.75, 0.1]
_FEATURES = ["l_quantity / 50", "10 * l_discount", "10 * l_tax", "l_extendedprice / 100000.0e0", "l_linenumber / 7.0e0", "1.0e0"]


def _line_shares(spark: SparkSession, sf_dir: str, averaged: bool = False) -> lazy.RidgeGame:
    """Lines share forty players by turns of their supplier; whether a line came back is fitted from six numbers of it."""
    rows = games.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % _FORTY).cast("int").alias("player"), F.array(*[F.expr(f).cast("double") for f in _FEATURES]).alias("x"), F.expr("cast(l_returnflag = 'R' AS double)").alias("y"))
    return lazy.RidgeGame(_FORTY, rows, _BETA, 0.1, averaged)


def _line_shares_sql(weight: str) -> str:
    d = len(_BETA)
    names = [*(f"a_{i}_{j}" for i in range(d) for j in range(d)), *(f"b_{i}_0" for i in range(d))]
    own = oracle.gram(f"(SELECT l_suppkey % {_FORTY} AS player, * FROM lineitem)", [f"({f})::double" for f in _FEATURES], ["(l_returnflag = 'R')::int::double"], keys="player", name="own").replace("SELECT player, ", "SELECT player, count(*) AS m, ")
    sums = f"held AS (SELECT k, mask, coalesce(sum(m), 0) AS m, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in names)} FROM smp LEFT JOIN own ON (mask >> player::int) & 1 = 1 GROUP BY 1, 2)"
    begin = f"e0 AS (SELECT k, mask, {', '.join(f'{c} + {weight} AS {c}' if c.startswith('a_') and c.split('_')[1] == c.split('_')[2] else c for c in names)} FROM held)"
    error = " + ".join(f"(b_{i}_0 - {b!r}) ** 2" for i, b in enumerate(_BETA))
    return f"WITH {oracle.samples(_HALF, _FORTY, COUNT, SEED)}, {own}, {sums}, {begin}, {oracle.solved(d, 1, 'k, mask')} SELECT k, mask, round({error}, 8) AS u FROM e{d}"


add("ridge_40_sampled", lambda spark, d: rounded(est.worth(_line_shares(spark, d), est.sample(spark, _HALF, _FORTY, COUNT, SEED)), 8, "u").select("k", "mask", "u"), _line_shares_sql("0.1e0"))
add("ridge_40_mean_loss", lambda spark, d: rounded(est.worth(_line_shares(spark, d, True), est.sample(spark, _HALF, _FORTY, COUNT, SEED)), 8, "u").select("k", "mask", "u"), _line_shares_sql("0.1e0 * greatest(1, m)"))

# Samplers: a coalition of the 25 nations for each customer.

_EACH = "(SELECT count(*) FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> int:
    return games.read(spark, sf_dir, "customer").count()


def _sampler(name: str, law: Callable[[int], est.Law], paired: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        players = games.read(spark, sf_dir, "nation").count()
        drawn = est.sample(spark, law(players), players, _customers(spark, sf_dir), SEED, paired)
        return drawn.select("k", F.col("side").cast("int").alias("side"), "mask", F.col("s").cast("int").alias("s"), F.round("t", 10).alias("t"))

    add(f"sample_{name}", query, f"WITH {oracle.samples(law(25), 25, _EACH, SEED, paired)} SELECT k, side::int AS side, mask, s::int AS s, round(t, 10) AS t FROM smp")


_sampler("bernoulli_half", lambda n: est.Law(coin=0.5))
_sampler("bernoulli_uniform", lambda n: est.Law(coin="uniform"))
_sampler("bernoulli_beta", lambda n: est.Law(coin=("beta", 1, 4)))
_sampler("bernoulli_beta_real", lambda n: est.Law(coin=("beta", 1.5, 0.25)))
_sampler("size_law_kernel", lambda n: est.Law(est.kernel_sizes(n)))
_sampler("size_law_even", lambda n: est.Law(est.even_sizes(1, n - 1)))
_sampler("paired", lambda n: est.Law(est.kernel_sizes(n)), True)
for _paired in (False, True):
    add(f"sample_permutation{'_paired' if _paired else ''}", lambda spark, d, p=_paired: est.permutations(spark, 12, _customers(spark, d), SEED, p).select("k", F.col("side").cast("int").alias("side"), F.posexplode("o").alias("pos", "player")).select("k", "side", "pos", F.col("player").cast("int").alias("player")), f"WITH {oracle.orders(12, _EACH, SEED, _paired)} SELECT k, side::int AS side, pos, player FROM ord")

# Coalitions without replacement and by rank, and the kernel law, with the worths of the game of supplier shares.

_WITHOUT = {s: 1.0 / (s * (10 - s)) for s in range(1, 10)}


def _with_worth(masks: Callable[[SparkSession], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(est.worth(games.supplier_shares(spark, sf_dir), masks(spark)), 4, "u")

    return query


add("sample_without_replacement", _with_worth(lambda spark: rounded(subsets.without_replacement(spark, _WITHOUT, 10, 300, SEED), 8, "chance").select("mask", "s", "chance")), f"WITH {oracle.table('share')}, d AS ({oracle.without_replacement(_WITHOUT, 10, 300, SEED)}) SELECT d.mask, s, chance, round(u, 4) AS u FROM d JOIN util USING (mask)")
add("unrank_subsets", _with_worth(lambda spark: spark.range(120).select(F.col("id").alias("rank"), subsets.unrank(F.col("id"), 10, 3).alias("mask"))), f"WITH {oracle.table('share')}, d AS (SELECT row_number() OVER (ORDER BY a.range, b.range, c.range) - 1 AS rank, (1::bigint << a.range::int) | (1::bigint << b.range::int) | (1::bigint << c.range::int) AS mask FROM range(10) a, range(10) b, range(10) c WHERE a.range < b.range AND b.range < c.range) SELECT rank, mask, round(u, 4) AS u FROM d JOIN util USING (mask)")


def _law_of_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = est.kernel_sizes(10)
    shares = spark.createDataFrame([(s, v / sum(law.values())) for s, v in law.items()], "s int, share double")
    return rounded(transform.by_size(games.supplier_shares(spark, sf_dir)).join(shares, "s").select("s", "share", (F.col("share") * F.col("mean")).alias("part")), 10, "share").withColumn("part", F.round("part", 2))


add("law_kernel", _law_of_sizes, f"WITH {oracle.table('share')}, k AS (SELECT range::int AS s, 1e0 / (range * (10 - range)) AS v FROM range(1, 10)), m AS (SELECT bit_count(mask)::int AS s, avg(u) AS u FROM util GROUP BY 1), p AS (SELECT s, v / sum(v) OVER () AS share FROM k) SELECT s, round(share, 10) AS share, round(share * u, 2) AS part FROM p JOIN m USING (s)")

# Aggregate estimators, by sampling, on the event game.

_RULE_SPECS = {"msr": banzhaf(0.25), "improved_ame": beta(4, 1), "weighted_msr": beta(4, 1), "arm": beta(4, 1), "arm_shapley": beta(4, 1), "arm_banzhaf": beta(4, 1), "gels_ranking": beta(4, 1), "gels": beta(4, 1), "wgels_shapley": beta(4, 1), "wgels_banzhaf": beta(4, 1), "shap_iq": beta(4, 1)}
_PAIR_SPECS = {"msr": BANZHAF, "improved_ame": SHAPLEY, "weighted_msr": SHAPLEY, "gels_ranking": SHAPLEY, "gels": beta(2, 2), "wgels_shapley": beta(4, 1), "wgels_banzhaf": beta(4, 1), "shap_iq": beta(4, 1)}
for _name, _rule in est.RULES.items():
    _spec = _RULE_SPECS.get(_name, SHAPLEY)
    add(f"est_{_name}", on("event", lambda g, n=_name, s=_spec: est.estimate(n, g, s, COUNT, SEED)), oracle.rule(_name, "event", _spec, COUNT, SEED))
    if _rule.outside_law is None:
        _spec = _PAIR_SPECS.get(_name, SHAPLEY)
        add(f"est_{_name}_paired", on("event", lambda g, n=_name, s=_spec: est.estimate(n, g, s, COUNT, SEED, True)), oracle.rule(_name, "event", _spec, COUNT, SEED, True))
add("est_improved_ame_real_beta", on("event", lambda g: est.estimate("improved_ame", g, beta(3.5, 2.25), COUNT, SEED)), oracle.rule("improved_ame", "event", beta(3.5, 2.25), COUNT, SEED))
add("est_sampling_lift_real_beta", on("event", lambda g: est.estimate_marginal("sampling_lift", g, beta(2.5, 2.5), COUNT, SEED, True)), oracle.marginal("sampling_lift", "event", beta(2.5, 2.5), COUNT, SEED, True))
for _name in est.MARGINAL:
    _spec = SHAPLEY if _name == "sampling_lift" else beta(4, 1)
    for _paired in (False, True):
        add(f"est_{_name}{'_paired' if _paired else ''}", on("event", lambda g, n=_name, s=_spec, p=_paired: est.estimate_marginal(n, g, s, COUNT, SEED, p)), oracle.marginal(_name, "event", _spec, COUNT, SEED, _paired))
for _name, _spec in (("permutation", SHAPLEY), ("weighted_permutation", beta(4, 1))):
    for _paired in (False, True):
        add(f"est_{_name}{'_paired' if _paired else ''}", on("event", lambda g, s=_spec, p=_paired: est.permutation(g, s, COUNT, SEED, p)), oracle.permutation("event", _spec, COUNT, SEED, _paired))
add("est_complement", on("event", lambda g: est.complement_contributions(g, COUNT, SEED)), oracle.complement("event", COUNT, SEED))
for _name in est.OFA_SIZES:
    for _paired in (False, True):
        if _name == "ofa" and _paired:
            continue
        _spec = BANZHAF if _paired else beta(4, 1)
        add(f"est_{_name}{'_paired' if _paired else ''}", on("event", lambda g, n=_name, s=_spec, p=_paired: est.one_for_all(n, g, s, COUNT, SEED, p)), oracle.one_for_all(_name, "event", _spec, COUNT, SEED, _paired))
for _paired in (False, True):
    add(f"est_ofa_baseline{'_paired' if _paired else ''}", on("event", lambda g, p=_paired: est.one_for_all_baseline(g, beta(4, 1), COUNT, SEED, p)), oracle.one_for_all_baseline("event", beta(4, 1), COUNT, SEED, _paired))

# Surrogates and two stages over their population, equal to the exact values.


def _population(name: str, spec: Semivalue, run: Callable) -> None:
    digits = 6 if spec == BANZHAF else 5  # where sixteenths and sixtieths of a cent have no ties
    add(f"pop_{name}", on("event", run, digits), oracle.exact("event", spec, digits))


_population("kernel_shap", SHAPLEY, lambda g: regression.kernel_shap(g, SHAPLEY))
_population("leverage", SHAPLEY, lambda g: regression.leverage(g, SHAPLEY))
_population("ame", banzhaf(0.25), lambda g: regression.ame(g, banzhaf(0.25)))
for _order in (1, 2, 3):
    _population(f"poly_shap_order{_order}", SHAPLEY, lambda g, o=_order: regression.poly_shap(g, SHAPLEY, o))
for _name, _spec in SPECS.items():
    _population(f"regression_msr_unbiased_{_name}", _spec, lambda g, s=_spec: regression.regression_msr(g, s))
    _population(f"two_stage_{_name}", _spec, lambda g, s=_spec: regression.values_frame(g.spark, regression.TwoStage(g, s).exact()))
_population("regression_msr", beta(4, 1), lambda g: regression.regression_msr(g, beta(4, 1), unbiased=False))
_population("tree_msr", beta(4, 1), lambda g: regression.tree_msr(g, beta(4, 1)))
for _basis, _label in ((0, "intercept"), (2, "pairs"), ("size_player", "size_player")):
    _population(f"two_stage_{_label}", SHAPLEY, lambda g, b=_basis: regression.values_frame(g.spark, regression.TwoStage(g, SHAPLEY, basis=b).exact()))


def _two_stage_group(game, spec: Semivalue, basis) -> DataFrame:
    stage = regression.TwoStage(game, spec, group=[0, 3], basis=basis)
    return stage.frame(stage.exact())


for _name, _spec in SPECS.items():
    add(f"pop_group_two_stage_{_name}", on("event", lambda g, s=_spec: _two_stage_group(g, s, 1), 5), oracle.exact_group("event", _spec, [0, 3], 5))
add("group_strata_exact", on("event", lambda g: groups.strata_shapley(g, SHAPLEY, [0, 3], threshold=5), 5), oracle.exact_group("event", SHAPLEY, [0, 3], 5))
add("group_strata_quotient", on("event", lambda g: groups.strata_shapley(g, SHAPLEY, [0, 3], threshold=2), 4), oracle.group_strata("event", [0, 3], 2))
add("group_wrapper_msr", on("event", lambda g: groups.summed(est.estimate("msr", g, banzhaf(0.25), COUNT, SEED), [0, 3]), 5), f"SELECT round(sum(value), 5) AS value FROM ({oracle.rule('msr', 'event', banzhaf(0.25), COUNT, SEED, digits=12)}) WHERE player IN (0, 3)")

# The sampled forms of the estimators that solve on the driver.
_SOLVED: dict[str, Callable] = {
    "kernel_shap": lambda g: regression.kernel_shap(g, SHAPLEY, COUNT, SEED),
    "kernel_shap_paired": lambda g: regression.kernel_shap(g, SHAPLEY, COUNT, SEED, True),
    "leverage": lambda g: regression.leverage(g, SHAPLEY, COUNT, SEED),
    "leverage_paired": lambda g: regression.leverage(g, SHAPLEY, COUNT, SEED, True),
    "ame": lambda g: regression.ame(g, beta(4, 2), COUNT, SEED),
    "ame_paired": lambda g: regression.ame(g, beta(2, 2), COUNT, SEED, True),
    "poly_shap": lambda g: regression.poly_shap(g, SHAPLEY, 2, COUNT, SEED),
    "poly_shap_paired": lambda g: regression.poly_shap(g, SHAPLEY, 2, COUNT, SEED, True),
    "regression_msr": lambda g: regression.regression_msr(g, beta(4, 1), COUNT, SEED, unbiased=False),
    "regression_msr_unbiased": lambda g: regression.regression_msr(g, SHAPLEY, COUNT, SEED, True),
    "regression_msr_plain": lambda g: regression.regression_msr(g, SHAPLEY, COUNT, SEED, special=False),
    "tree_msr": lambda g: regression.tree_msr(g, SHAPLEY, COUNT, SEED),
    "tree_msr_beta": lambda g: regression.tree_msr(g, beta(4, 1), COUNT, SEED, trees=4, depth=2),
    "two_stage": lambda g: regression.values_frame(g.spark, regression.TwoStage(g, SHAPLEY, seed=SEED).estimate(COUNT)),
    "two_stage_unpaired": lambda g: regression.values_frame(g.spark, regression.TwoStage(g, beta(4, 1), seed=SEED).estimate(COUNT)),
}
_SOLVED_SQL: dict[str, str] = {
    **{f"kernel_shap{'_paired' * p}": oracle.kernel_shap("event", COUNT, SEED, bool(p)) for p in (0, 1)},
    **{f"leverage{'_paired' * p}": oracle.leverage("event", COUNT, SEED, bool(p)) for p in (0, 1)},
    "ame": oracle.ame("event", beta(4, 2), COUNT, SEED, False),
    "ame_paired": oracle.ame("event", beta(2, 2), COUNT, SEED, True),
    **{f"poly_shap{'_paired' * p}": oracle.poly_shap("event", 2, COUNT, SEED, bool(p)) for p in (0, 1)},
    "regression_msr": oracle.regression_msr("event", beta(4, 1), COUNT, SEED, False, False),
    "regression_msr_unbiased": oracle.regression_msr("event", SHAPLEY, COUNT, SEED, True, True),
    "regression_msr_plain": oracle.regression_msr("event", SHAPLEY, COUNT, SEED, False, True, special=False),
    "tree_msr": oracle.tree_msr("event", SHAPLEY, COUNT, SEED),
    "tree_msr_beta": oracle.tree_msr("event", beta(4, 1), COUNT, SEED, trees=4, depth=2),
    "two_stage": oracle.two_stage("event", SHAPLEY, COUNT, SEED),
    "two_stage_unpaired": oracle.two_stage("event", beta(4, 1), COUNT, SEED),
}
for _name, _run in _SOLVED.items():
    add(f"est_{_name}", on("event", _run, 2), _SOLVED_SQL.get(_name))
add("est_group_two_stage", on("event", lambda g: (lambda t: t.frame(t.estimate(COUNT)))(regression.TwoStage(g, beta(4, 1), group=[0, 3], seed=SEED)), 2), oracle.two_stage("event", beta(4, 1), COUNT, SEED, [0, 3]))
add("est_group_strata", on("event", lambda g: groups.strata_shapley(g, SHAPLEY, [0, 3], threshold=5, per_stratum=20, seed=SEED), 2), oracle.group_strata_sampled("event", [0, 3], 20, SEED))
add("est_regression_msr_distinct", on("event", lambda g: regression.regression_msr(g, beta(4, 1), 20, SEED, replacement=None), 2), oracle.regression_msr("event", beta(4, 1), 20, SEED, False, True, distinct=True))


# Trajectories and reports.

_MSR = est.Law(coin=0.5)


def _msr_trajectory(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    game = games.event_user_day(spark, sf_dir)
    return trajectory.inclusion_trajectory(est.worth(game, est.sample(spark, _MSR, 5, COUNT, seed)), 5, 50)


def _msr_sql(seed: int = SEED, name: str = "tr") -> str:
    """CTEs after util that end in name(player, ckpt, value)."""
    return f"{oracle.samples(_MSR, 5, COUNT, seed, name=f'{name}_s')}, {name}_e AS (SELECT k // 50 AS ckpt, p.range::int AS player, (mask >> p.range::int) & 1 AS x, u FROM {name}_s JOIN util USING (mask) CROSS JOIN range(5) p), {name} AS (SELECT c.range::int AS ckpt, player, coalesce(avg(CASE WHEN x = 1 THEN u END), 0) - coalesce(avg(CASE WHEN x = 0 THEN u END), 0) AS value FROM range({COUNT // 50}) c JOIN {name}_e ON {name}_e.ckpt <= c.range GROUP BY 1, 2)"


add("trajectory_msr", lambda spark, d: rounded(_msr_trajectory(spark, d), 6), f"WITH {oracle.table('event')}, {_msr_sql()} SELECT player, ckpt, round(value, 6) AS value FROM tr")


def _lift_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    game = games.event_user_day(spark, sf_dir)
    return trajectory.mean_trajectory(est.marginals(game, est.sample(spark, _MSR, 5, COUNT, SEED)), 50)


add("trajectory_marginal", lambda spark, d: rounded(_lift_trajectory(spark, d), 6), f"WITH {oracle.table('event')}, {oracle.samples(_MSR, 5, COUNT, SEED)}, m AS (SELECT k // 50 AS ck, p.range::int AS player, b.u - a.u AS v FROM smp CROSS JOIN range(5) p JOIN util a ON a.mask = smp.mask & ~(1::bigint << p.range::int) JOIN util b ON b.mask = smp.mask | (1::bigint << p.range::int)) SELECT player, c.range::int AS ckpt, round(avg(v), 6) AS value FROM range({COUNT // 50}) c JOIN m ON ck <= c.range GROUP BY 1, 2")
add("trajectory_filled", lambda spark, d: rounded(trajectory.filled(_msr_trajectory(spark, d).where("ckpt % 3 = 0"), ["player"], 9), 4), f"WITH {oracle.table('event')}, {_msr_sql()}, g AS (SELECT p.range::int AS player, c.range::int AS ckpt FROM range(5) p, range(10) c) SELECT g.player, g.ckpt, round(coalesce((SELECT arg_max(value, tr.ckpt) FROM tr WHERE tr.player = g.player AND tr.ckpt <= g.ckpt AND tr.ckpt % 3 = 0), 0), 4) AS value FROM g")

_RUNS = (7, 11, 13)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of three runs of the inclusion estimator against the exact Banzhaf values."""
    from functools import reduce

    game = games.event_user_day(spark, sf_dir)
    drawn = reduce(DataFrame.unionByName, [est.sample(spark, _MSR, 5, COUNT, seed).withColumn("run_idx", F.lit(i)) for i, seed in enumerate(_RUNS)])
    runs = trajectory.inclusion_trajectory(est.worth(game, drawn), 5, 50, ["run_idx"])
    truth = exact.coefficients(game, BANZHAF)
    return report.errors(runs, truth, ["run_idx"]).withColumn("setting", F.lit("event")).withColumn("method", F.when(F.col("run_idx") < 2, "msr_a").otherwise("msr_b"))


def _summary_sql() -> str:
    runs = ", ".join(_msr_sql(seed, f"tr{i}") for i, seed in enumerate(_RUNS))
    union = " UNION ALL ".join(f"SELECT {i} AS run_idx, * FROM tr{i}" for i in range(len(_RUNS)))
    return f"WITH {oracle.table('event')}, x AS ({oracle.exact_body(5, BANZHAF)}), {runs}, al AS ({union}), er AS (SELECT run_idx, ckpt, sum((al.value - x.value) ** 2) AS sq_error, sum((al.value - x.value) ** 2) / sum(x.value ** 2) AS rel_sq_error, sqrt(sum((al.value - x.value) ** 2)) AS l2_error, sqrt(sum((al.value - x.value) ** 2) / sum(x.value ** 2)) AS rel_l2_error, sqrt(avg((al.value - x.value) ** 2)) AS rmse FROM al JOIN x USING (player) GROUP BY 1, 2)"


add("error_metrics", lambda spark, d: rounded(rounded(rounded(_summary(spark, d), 0, "sq_error"), 8, "rel_sq_error", "rel_l2_error"), 3, "l2_error", "rmse").select("run_idx", "ckpt", "sq_error", "rel_sq_error", "l2_error", "rel_l2_error", "rmse"), f"{_summary_sql()} SELECT run_idx, ckpt, round(sq_error, 0) AS sq_error, round(rel_sq_error, 8) AS rel_sq_error, round(l2_error, 3) AS l2_error, round(rel_l2_error, 8) AS rel_l2_error, round(rmse, 3) AS rmse FROM er")
add("aucc_mean", lambda spark, d: rounded(report.aucc(_summary(spark, d), ["setting", "method"], "run_idx"), 8, "aucc_mean", "aucc_std"), f"{_summary_sql()}, a AS (SELECT run_idx, avg(rel_l2_error) AS a FROM er GROUP BY 1) SELECT 'event' AS setting, CASE WHEN run_idx < 2 THEN 'msr_a' ELSE 'msr_b' END AS method, round(avg(a), 8) AS aucc_mean, round(stddev_pop(a), 8) AS aucc_std, count(*) AS runs FROM a GROUP BY 1, 2")
add("aucc_pivot", lambda spark, d: rounded(report.aucc_matrix(report.aucc(_summary(spark, d), ["setting", "method"], "run_idx"), "setting", "method", ["msr_a", "msr_b"]), 8, "msr_a", "msr_b"), f"{_summary_sql()}, a AS (SELECT run_idx, avg(rel_l2_error) AS a FROM er GROUP BY 1) SELECT 'event' AS setting, round(avg(CASE WHEN run_idx < 2 THEN a END), 8) AS msr_a, round(avg(CASE WHEN run_idx >= 2 THEN a END), 8) AS msr_b FROM a")
add("aucc_trapz", lambda spark, d: rounded(report.trapezoid(_summary(spark, d), ["run_idx"], "ckpt", "rel_l2_error"), 8, "aucc"), f"{_summary_sql()}, t AS (SELECT run_idx, ckpt, (ckpt - lag(ckpt) OVER w) * (rel_l2_error + lag(rel_l2_error) OVER w) / 2 AS a FROM er WINDOW w AS (PARTITION BY run_idx ORDER BY ckpt)) SELECT run_idx, round(sum(a) / (max(ckpt) - min(ckpt)), 8) AS aucc FROM t GROUP BY 1")
add("curve_mean_std", lambda spark, d: rounded(report.curves(_summary(spark, d), ["ckpt"], "rel_l2_error"), 8, "mean", "std"), f"{_summary_sql()} SELECT ckpt, round(avg(rel_l2_error), 8) AS mean, round(stddev_pop(rel_l2_error), 8) AS std, count(*) AS runs FROM er GROUP BY 1")

# A setting is a market segment's game with a semivalue.
_SEMIVALUES = [("shapley", None, None), ("weighted_banzhaf", 0.5, None), ("weighted_banzhaf", 0.25, None), ("beta_shapley", 4.0, 1.0), ("beta_shapley", 1.0, 4.0), ("beta_shapley", 2.0, 2.0)]
_METHODS = [("msr", "all"), ("kernel_shap", "shapley"), ("wsl", "non_shapley"), ("paired", "symmetric"), ("ame", "ame")]


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = games.read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(f"_{k}_{a}_{b}").alias("end"), F.lit(k).alias("semivalue"), F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b")) for k, a, b in _SEMIVALUES]))
    settings = segments.select("c_mktsegment", each.alias("x")).select(F.concat("c_mktsegment", "x.end").alias("setting"), "x.semivalue", "x.a", "x.b")
    return report.grid(settings, spark.createDataFrame(_METHODS, "method string, compatibility string")).select("setting", "method")


def _grid_sql() -> str:
    def lit(v):
        return "NULL" if v is None else repr(v)

    specs = ", ".join(f"('_{k}_{a}_{b}', {lit(k)}, {lit(a)}, {lit(b)})" for k, a, b in _SEMIVALUES)
    return f"v(e, semivalue, a, b) AS (VALUES {specs}), s AS (SELECT c_mktsegment || e AS setting, semivalue, a, b FROM (SELECT DISTINCT c_mktsegment FROM customer), v), m(method, need) AS (VALUES {', '.join(map(str, _METHODS))}), g AS (SELECT setting, method FROM s, m WHERE need = 'all' OR (need = 'shapley' AND semivalue = 'shapley') OR (need = 'non_shapley' AND semivalue <> 'shapley') OR (need = 'symmetric' AND (semivalue = 'shapley' OR (semivalue = 'weighted_banzhaf' AND a = 0.5) OR (semivalue = 'beta_shapley' AND a = b))) OR (need = 'ame' AND (semivalue = 'weighted_banzhaf' OR (semivalue = 'beta_shapley' AND a > 1 AND b > 1))))"


add("compatibility_grid", lambda spark, d: _grid(spark, d), f"WITH {_grid_sql()} SELECT * FROM g")
add("resume_anti_join", lambda spark, d: report.pending(_grid(spark, d), _grid(spark, d).where("method = 'msr' or setting like 'BUILDING%'"), ["setting", "method"]), f"WITH {_grid_sql()} SELECT * FROM g WHERE NOT (method = 'msr' OR setting LIKE 'BUILDING%')")
_ORDER, _HIDDEN = ["wsl", "absent", "ame"], ["paired"]
add("method_order", lambda spark, d: report.method_order(_grid(spark, d), "setting", _ORDER, _HIDDEN), f"WITH {_grid_sql()}, o(method, p) AS (VALUES ('wsl', 0), ('absent', 1), ('ame', 2)) SELECT method, (row_number() OVER (ORDER BY p NULLS LAST, s, method) - 1)::int AS place FROM (SELECT method, min(setting) AS s FROM g WHERE method <> 'paired' GROUP BY 1) LEFT JOIN o USING (method)")
add("method_order_requested", lambda spark, d: report.method_order(_grid(spark, d), "setting", requested=["paired", "msr"]), f"WITH {_grid_sql()} SELECT DISTINCT method, CASE method WHEN 'paired' THEN 0 ELSE 1 END AS place FROM g WHERE method IN ('paired', 'msr')")


def _stored(form: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = games.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("double")).alias("balance"))
        path = f"{store.shared(spark)}/stored-{spark.sparkContext.applicationId}-{form}"
        store.save(table, path, form)
        return store.load(spark, path, form, table.schema)

    return query


for _form in store.FORMS:
    add(f"sink_{_form}", _stored(_form), "SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal::double END AS balance FROM customer")


def _kept_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact values of a game whose table is computed at the first use and read at the second."""
    names = {"game": "segment_part_year", "data": sf_dir, "run": spark.sparkContext.applicationId}
    for _ in range(2):
        table = store.kept(spark, store.shared(spark), lambda: games.segment_part_year(spark, sf_dir).table(), **names)
    return rounded(exact.enumerated(games.TableGame(oracle.PLAYERS["segment"], table), BANZHAF), 2)


add("game_cache", _kept_game, oracle.exact("segment", BANZHAF))
add("dataset_balanced_pick", lambda spark, d: report.balanced_pick(games.read(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 57), "WITH t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT vec_id, label FROM t ORDER BY r, label LIMIT 57")


def _standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = games.read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(report.standardised(rows, rows.where("p_partkey % 5 <> 0"), ["p_size", "p_retailprice"]), 8, "p_size", "p_retailprice")


add("dataset_standardised", _standardised, "WITH s AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS d FROM part WHERE p_partkey % 5 <> 0) SELECT p_partkey, round((p_size - a) / b, 8) AS p_size, round((p_retailprice - c) / d, 8) AS p_retailprice FROM part CROSS JOIN s")

# Runs by name: nested checkpoints, groups, and a black-box game.


def _converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attrispark.plans.run import converge

    return rounded(converge(games.event_user_day(spark, sf_dir), "msr", BANZHAF, 60, 20, SEED), 4).select("ckpt", "evaluations", "player", "value")


add("run_checkpoints", _converged, " UNION ALL ".join(f"SELECT {k} AS ckpt, {b * 5} AS evaluations, * FROM ({oracle.rule('msr', 'event', BANZHAF, b * 5, SEED)})" for k, b in enumerate((20, 40, 60))))


def _checkpointed(name: str, spec: Semivalue, sql: Callable[[int], str], digits: int = 4) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from attrispark.plans.run import converge

        return rounded(converge(games.event_user_day(spark, sf_dir), name, spec, 90, 30, SEED), digits).select("ckpt", "evaluations", "player", "value")

    from attrispark.plans.run import samples_for

    add(f"run_checkpoints_{name}", query, " UNION ALL ".join(f"SELECT {k} AS ckpt, {b * 5} AS evaluations, * FROM ({sql(samples_for(name, 5, b))})" for k, b in enumerate((30, 60, 90))))


_checkpointed("permutation", SHAPLEY, lambda m: oracle.permutation("event", SHAPLEY, m, SEED))
_checkpointed("complement", SHAPLEY, lambda m: oracle.complement("event", m, SEED))
_checkpointed("ofa_fixed", beta(4, 1), lambda m: oracle.one_for_all("ofa_fixed", "event", beta(4, 1), m, SEED))
_checkpointed("kernel_shap", SHAPLEY, lambda m: oracle.kernel_shap("event", m, SEED, False), 2)
_checkpointed("ame", beta(4, 2), lambda m: oracle.ame("event", beta(4, 2), m, SEED, False), 2)
_checkpointed("regression_msr_unbiased", SHAPLEY, lambda m: oracle.regression_msr("event", SHAPLEY, m, SEED, False, True), 2)


add("run_checkpoints_two_stage", lambda spark, d: rounded(_two_stage_converged(spark, d), 2).select("ckpt", "evaluations", "player", "value"), " UNION ALL ".join(f"SELECT {k} AS ckpt, {c} AS evaluations, * FROM ({oracle.two_stage('event', beta(4, 1), c, SEED, pilot=87)})" for k, c in enumerate((150, 300, 450))))


def _two_stage_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last budget sizes the pilot: a fifth of the 438 evaluations beside the boundary."""
    from attrispark.plans.run import converge

    return converge(games.event_user_day(spark, sf_dir), "two_stage", beta(4, 1), 90, 30, SEED)


def _bound(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from attrispark.plans.run import run_group

        return rounded(run_group(games.event_user_day(spark, sf_dir), name, SHAPLEY, 60, [0, 3], SEED), 2)

    return query


for _name, _sql in (
    ("individual_regression_msr_unbiased", oracle.regression_msr("event", SHAPLEY, 300, SEED, True, True, digits=9)),
    ("individual_regression_msr_unbiased_unpaired", oracle.regression_msr("event", SHAPLEY, 300, SEED, False, True, digits=9)),
    ("individual_ofa_fixed", oracle.one_for_all("ofa_fixed", "event", SHAPLEY, 300, SEED, digits=9)),
):
    add(f"group_{_name}", _bound(_name), f"SELECT round(sum(value), 2) AS value FROM ({_sql}) WHERE player IN (0, 3)")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attrispark.plans.run import run

    return rounded(run(games.event_user_day(spark, sf_dir), "arm", beta(4, 1), 60, SEED, group=[1, 2]), 4)


add("run_group", _grouped, f"SELECT round(sum(value), 4) AS value FROM ({oracle.rule('arm', 'event', beta(4, 1), 150, SEED, digits=12)}) WHERE player IN (1, 2)")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six owners hold all rows by turns of their id but the scored ones."""
    from attrispark.sources.training import trained_on_tables

    rows = games.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), (F.col("label") % 2).cast("int").alias("y"))
    train = rows.where(f"vec_id % {_EVERY} <> 0").withColumn("player", (F.col("vec_id") % 6).cast("int"))
    return rounded(exact.enumerated(trained_on_tables(train, rows.where(f"vec_id % {_EVERY} = 0"), 6, 2, steps=8), SHAPLEY), 8)


add("training_shapley", _training)


def _one_pass(extra: str) -> Query:
    """The same owners, by one pass of single-row steps; rows that `extra` tells train every coalition."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from attrispark.sources.training import trained_in_order

        rows = games.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), (F.col("label") % 2).cast("int").alias("y"))
        train = rows.where(f"id % {_EVERY} <> 0").withColumn("player", F.expr(f"CASE WHEN {extra} THEN null ELSE cast(id % 6 AS int) END"))
        return rounded(exact.enumerated(trained_in_order(train, rows.where(f"id % {_EVERY} = 0"), 6, 2, 0.1, seed=SEED, spread=0.0), SHAPLEY), 8)

    return query


add("training_one_pass_shapley", _one_pass("false"), oracle.training(6, _EVERY, 0.1, SEED))
add("training_one_pass_extra_rows", _one_pass("id % 7 = 3"), oracle.training(6, _EVERY, 0.1, SEED, "vec_id % 7 = 3"))

# Random games: as many terms as there are customers.

add("random_terms_plain", lambda spark, d: rounded(games.random_terms(spark, 20, _customers(spark, d), 42).terms, 6, "w"), f"WITH {oracle.samples(est.Law({s: 1.0 for s in range(1, 20)}), 20, _EACH, 42)} SELECT mask, round(sum((2e0 * {draws.uniform_sql('k', repr('w'), 42)} - 1e0) * 20), 6) AS w FROM smp GROUP BY 1")
add("random_terms_paper", lambda spark, d: rounded(games.random_terms(spark, 8, _customers(spark, d), 42, "paper").terms, 8, "w"), f"WITH {oracle.samples(est.Law({s: 1.0 for s in range(1, 8)}), 8, _EACH, 42)}, m AS (SELECT k, mask, avg(p.range % 4) AS a FROM smp JOIN range(8) p ON (mask >> p.range::int) & 1 = 1 GROUP BY 1, 2) SELECT mask, round(sum(a / {_EACH}), 8) AS w FROM m GROUP BY 1")
add("random_terms_structured", lambda spark, d: rounded(games.random_terms(spark, 7, _customers(spark, d), 123, "structured", 0.4).terms, 6, "w"), oracle.structured_terms(7, _EACH, 123, 0.4))
