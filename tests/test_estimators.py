"""Every estimator against exact values on a seeded table game, and rejection of what it doesn't support."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrispark.functions.spec import BANZHAF, SHAPLEY, Semivalue, banzhaf, beta
from attrispark.operators import estimators as est
from attrispark.operators import exact, groups, regression, subsets
from attrispark.sources import games

SPECS = [SHAPLEY, BANZHAF, banzhaf(0.3), beta(4, 1), beta(2, 3)]
VALUES = np.random.default_rng(321).normal(size=32)


def brute(spec: Semivalue, n: int, values) -> np.ndarray:
    p = spec.p(n)
    return np.array([sum(p[m.bit_count()] * (values[m | 1 << i] - values[m]) for m in range(1 << n) if not m >> i & 1) for i in range(n)])


def vector(df) -> np.ndarray:
    return np.array([r["value"] for r in df.orderBy("player").collect()])


@pytest.fixture(scope="module")
def game(spark):
    return games.TableGame(5, spark.createDataFrame([(m, float(v)) for m, v in enumerate(VALUES)], "mask bigint, u double").cache())


def test_weights_sum_to_one_and_bad_parameters_are_refused():
    for spec in SPECS:
        assert sum(spec.d(7)) == pytest.approx(1)
    for bad in (("nothing", ()),):
        with pytest.raises(NotImplementedError):
            Semivalue(*bad)
    for bad in (("weighted_banzhaf", (1.0,)), ("beta_shapley", (1.0,)), ("shapley", (2.0,))):
        with pytest.raises(ValueError):
            Semivalue(*bad)


@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_exact_forms_agree(game, spec):
    want = brute(spec, 5, VALUES)
    assert vector(exact.enumerated(game, spec)) == pytest.approx(want)
    assert vector(exact.coefficients(game, spec)) == pytest.approx(want)
    assert exact.group_sum(game, spec, [0, 3]).first()["value"] == pytest.approx(want[[0, 3]].sum())


@pytest.mark.parametrize("name", est.RULES)
def test_rules_are_exact_over_their_population(game, name):
    rule = est.RULES[name]
    for spec in SPECS:
        if not rule.supports(spec):
            with pytest.raises(est.Unsupported):
                est.exact_by_rule(name, game, spec)
        elif name != "improved_ame" or spec.kind == "weighted_banzhaf":  # a random coin has no finite population
            got, want = vector(est.exact_by_rule(name, game, spec)), brute(spec, 5, VALUES)
            if name == "gels_ranking":
                assert (np.argsort(got) == np.argsort(want)).all()
            else:
                assert got == pytest.approx(want)


def test_solved_estimators_are_exact_over_their_population(game):
    want = brute(SHAPLEY, 5, VALUES)
    for run in (regression.kernel_shap, regression.leverage, lambda g, s: regression.poly_shap(g, s, 2)):
        assert vector(run(game, SHAPLEY)) == pytest.approx(want)
    for spec in SPECS:
        want = brute(spec, 5, VALUES)
        assert vector(regression.regression_msr(game, spec)) == pytest.approx(want)
        assert regression.TwoStage(game, spec).exact() == pytest.approx(want)
        assert regression.TwoStage(game, spec, group=[0, 2, 4]).exact()[0] == pytest.approx(want[[0, 2, 4]].sum())
    assert vector(regression.ame(game, banzhaf(0.3))) == pytest.approx(brute(banzhaf(0.3), 5, VALUES))
    assert vector(regression.tree_msr(game, beta(4, 1))) == pytest.approx(brute(beta(4, 1), 5, VALUES))


@pytest.mark.parametrize("basis", [0, 2, "size_player"])
def test_two_stage_bases(game, basis):
    assert regression.TwoStage(game, SHAPLEY, basis=basis).exact() == pytest.approx(brute(SHAPLEY, 5, VALUES))


def test_sampled_estimates_come_near(game):
    want = brute(SHAPLEY, 5, VALUES)
    for run in (
        lambda: est.permutation(game, SHAPLEY, 800, 1, True),
        lambda: est.complement_contributions(game, 1500, 1),
        lambda: est.one_for_all("ofa", game, SHAPLEY, 1500, 1),
        lambda: est.estimate("arm", game, SHAPLEY, 1500, 1),
        lambda: regression.kernel_shap(game, SHAPLEY, 1500, 1, True),
        lambda: regression.regression_msr(game, SHAPLEY, 1500, 1),
    ):
        assert np.abs(vector(run()) - want).max() < 0.25
    assert np.abs(regression.TwoStage(game, SHAPLEY).estimate(600) - want).max() < 0.1
    assert abs(regression.TwoStage(game, beta(4, 1), group=[0, 1]).estimate(600)[0] - brute(beta(4, 1), 5, VALUES)[[0, 1]].sum()) < 0.25


def test_unsupported_combinations_are_refused(game):
    for run in (
        lambda: regression.kernel_shap(game, BANZHAF),
        lambda: regression.ame(game, SHAPLEY),
        lambda: est.estimate("msr", game, banzhaf(0.3), 10, paired=True),
        lambda: est.estimate_marginal("wsl", game, SHAPLEY, 10),
        lambda: est.one_for_all("ofa_optimal", game, SHAPLEY, 10),
        lambda: groups.strata_shapley(game, BANZHAF, [0]),
    ):
        with pytest.raises(est.Unsupported):
            run()
    for group in ([], [0, 0], [5]):
        with pytest.raises(ValueError):
            exact.group_mask(group, 5)


def test_strata_of_a_group_are_exact_at_full_threshold(game):
    want = brute(SHAPLEY, 5, VALUES)[[1, 4]].sum()
    assert groups.strata_shapley(game, SHAPLEY, [1, 4], threshold=5).first()["value"] == pytest.approx(want)


def test_without_replacement_draws_distinct_coalitions(spark):
    law = {s: 1.0 for s in range(1, 8)}
    rows = subsets.without_replacement(spark, law, 8, 60, 3).collect()
    assert len({r["mask"] for r in rows}) == len(rows)
    assert abs(len(rows) - 60) <= 4
    assert all(0 < r["chance"] <= 1 for r in rows)
    pairs = subsets.without_replacement(spark, law, 8, 60, 3, paired=True).collect()
    masks = {r["mask"] for r in pairs}
    assert len(masks) == len(pairs) and all(255 ^ m in masks for m in masks)
    # Many players: no 2^n anywhere, and nothing twice.
    wide = subsets.without_replacement(spark, {s: 1.0 for s in range(1, 50)}, 50, 500, 3).collect()
    assert len({r["mask"] for r in wide}) == len(wide) and abs(len(wide) - 500) <= 50
    with pytest.raises(ValueError):
        subsets.distinct_ranks(spark, {1: (5, 6)}, 1)


def test_regression_without_replacement(game):
    """All coalitions, drawn once each, leave nothing to chance; the surrogate makes no difference then."""
    for spec in (SHAPLEY, beta(4, 1)):
        for special in (True, False):
            got = vector(regression.regression_msr(game, spec, 32, 1, replacement=False, special=special, folds=4))
            assert np.abs(got - brute(spec, 5, VALUES)).max() < 1.0
    near = vector(regression.regression_msr(game, SHAPLEY, 24, 1, True, replacement=False))
    assert np.abs(near - brute(SHAPLEY, 5, VALUES)).max() < 1.0


def test_unanimity_terms_match_the_definition(spark):
    game = games.random_terms(spark, 6, 25, 5)
    table = {r["mask"]: r["u"] for r in game.table().collect()}
    terms = game.terms.collect()
    assert all(u == pytest.approx(sum(t["w"] for t in terms if t["mask"] & m == t["mask"])) for m, u in table.items())
    for spec in SPECS:
        assert vector(exact.closed_form(game, spec)) == pytest.approx(brute(spec, 6, [table[m] for m in range(64)]))


def test_structured_games(spark):
    game = games.random_terms(spark, 7, 19, 123, "structured", 0.4, distinct=True)
    sizes = [r["mask"].bit_count() for r in game.terms.collect()]
    assert sizes.count(1) == 7 and sizes.count(2) == 21 and len(sizes) == 7 + 21 + 19
    again = games.random_terms(spark, 7, 19, 123, "structured", 0.4, distinct=True)
    assert {(r["mask"], r["w"]) for r in game.terms.collect()} == {(r["mask"], r["w"]) for r in again.terms.collect()}
    with pytest.raises(ValueError):
        games.random_terms(spark, 3, 5, 1, "structured")
    # 5 players have 15 sets of 3 or 4; drawing them all meets many repeats.
    assert games.random_terms(spark, 5, 15, 1, "structured", distinct=True).terms.count() == 15 + 15
    with pytest.raises(ValueError):
        games.random_terms(spark, 5, 16, 1, "structured", distinct=True)


def test_no_player_is_left_out_silently(spark):
    many = spark.range(63).selectExpr("cast(id AS int) AS player", "1.0 AS w", "1.0 AS x1", "1.0 AS x2", "1.0 AS y")
    for run in (lambda: games.additive(many, 3).table(), lambda: games.ridge(many, 3, (1.0, 0.5), 0.1).table(), lambda: games._numbered(many, "player", 25)):
        with pytest.raises(Exception, match="there are 63"):
            run().collect()
    assert games.few(many.where("player < 62")).count() == 62


def test_points_of_one_owner(spark):
    rng = np.random.default_rng(3)
    x, q, labels = rng.normal(size=(30, 4)), rng.normal(size=(5, 4)), rng.integers(0, 2, 35)
    points = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(30)], "player bigint, embedding array<double>, label int")
    queries = spark.createDataFrame([(i, q[i].tolist(), int(labels[30 + i])) for i in range(5)], "query bigint, embedding array<double>, label int")
    ranks = games.knn_ranks(points, queries, block=7)
    order = {i: sorted(range(30), key=lambda p: ((x[p] - q[i]) ** 2).sum()) for i in range(5)}
    assert {(r["query"], r["player"]): (r["r"], r["hit"]) for r in ranks.collect()} == {(i, p): (k + 1, int(labels[p] == labels[30 + i])) for i in range(5) for k, p in enumerate(order[i])}
    values = {r["player"]: r["value"] for r in games.knn_shapley(points, queries, 4, block=7).collect()}
    want = np.zeros(30)
    for i in range(5):
        hit = [int(labels[p] == labels[30 + i]) for p in order[i]]
        v = hit[-1] / 30
        want[order[i][-1]] += v / 5
        for j in range(28, -1, -1):
            v += (hit[j] - hit[j + 1]) / 4 * min(4, j + 1) / (j + 1)
            want[order[i][j]] += v / 5
    assert [values[p] for p in range(30)] == pytest.approx(want)
    near = games.knn_nearest(points.withColumn("id", F.col("player")).withColumn("player", F.col("player") % 3), queries, 4, block=7)
    assert near.count() == 5 * 3 * 4
    fewer = {r["mask"]: r["u"] for r in games.knn_game(near, 3, 4).table().collect()}
    table = {r["mask"]: r["u"] for r in games.knn_game(ranks.withColumn("player", F.col("player") % 3), 3, 4).table().collect()}
    for m in range(8):
        hits = sum(labels[p] == labels[30 + i] for i in range(5) for p in [p for p in order[i] if m >> p % 3 & 1][:4])
        assert table[m] == fewer[m] == pytest.approx(hits / 20)


def test_pairs_of_queries_and_points_are_not_moved(spark, monkeypatch):
    """Points that a task can hold are ordered where a query is; ties, odd labels and distances come out as by ranges."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[:40] = x[40:80]
    odd = {5: [float("nan"), 0.0, 0.0], 6: [None, 0.0, 0.0], 7: [float("inf"), 0.0, 0.0]}
    kind = "array<float>, label string"
    points = spark.createDataFrame([(3 * i % 301, odd.get(i, x[i].tolist()), None if i % 9 == 0 else str(i % 4)) for i in range(300)], f"player bigint, embedding {kind}").repartition(5)
    queries = spark.createDataFrame([(1000 + i, x[7 * i].tolist(), str(i % 4)) for i in range(20)], f"query bigint, embedding {kind}")

    def found():
        ranks, values = games.knn_ranks(points, queries), games.knn_shapley(points, queries, 4)
        plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (ranks, values)]
        return plans, {tuple(r) for r in ranks.collect()}, {r["player"]: r["value"] for r in values.collect()}

    plans, ranks, values = found()
    assert not any("Window" in p or "CoGroup" in p for p in plans)
    monkeypatch.setattr(games, "SMALL_POINTS", 10)
    plans, by_range, summed = found()
    assert all("Window" in p for p in plans)
    assert len(ranks) == 300 * 20 and ranks == by_range
    assert values == pytest.approx(summed)
    monkeypatch.undo()
    none = games.knn_shapley(points, queries.limit(0), 4), games.knn_ranks(points.limit(0), queries)
    assert [d.count() for d in none] == [0, 0]


@pytest.mark.parametrize("n", [20, 35])
def test_large_term_tables_are_met_in_strips_or_chunks(spark, monkeypatch, n):
    game = games.random_terms(spark, n, 300, 9)
    masks = est.sample(spark, est.Law(coin=0.7), n, 50, 1)
    whole = {r["mask"]: r["u"] for r in game.evaluate(masks).collect()}
    monkeypatch.setattr(games, "SMALL_TERMS", 40)
    chunked = games.random_terms(spark, n, 300, 9)
    assert chunked.attach(masks) is None
    parts = {r["mask"]: r["u"] for r in chunked.evaluate(masks).collect()}
    assert whole.keys() == parts.keys()
    assert all(parts[m] == pytest.approx(u) for m, u in whole.items())


def test_black_box_utilities(spark):
    game = games.CallableGame(4, spark, lambda masks: [float(m.bit_count() ** 2) for m in masks])
    assert vector(exact.enumerated(game, SHAPLEY)) == pytest.approx([4.0] * 4)


def test_games_evaluated_where_they_are_asked(spark):
    from attrispark.sources import lazy

    rng = np.random.default_rng(8)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(rng.normal(size=6))], "player int, w double")
    for options in ({}, {"lam": 0.3, "sigma": 2.0, "seed": 5}, {"transform": lambda x: x * x}):
        want = {r["mask"]: r["u"] for r in games.additive(weights, 6, **options).table().collect()}
        assert {r["mask"]: r["u"] for r in lazy.AdditiveGame(6, weights, **options).table().collect()} == pytest.approx(want)
    game = lazy.AdditiveGame(6, weights)
    assert vector(exact.enumerated(game, SHAPLEY)) == pytest.approx([r["w"] for r in weights.orderBy("player").collect()])
    x, y, player = rng.normal(size=(50, 3)), rng.normal(size=50), rng.integers(0, 5, 50)
    rows = spark.createDataFrame([(int(p), a.tolist(), float(b)) for p, a, b in zip(player, x, y, strict=True)] + [(1, [1.0, None, 2.0], 1.0), (None, [1.0] * 3, 1.0), (2, [1.0] * 3, None)], "player int, x array<double>, y double").repartition(4)
    for averaged in (False, True):
        ridge = lazy.RidgeGame(5, rows, [0.5, -1.0, 2.0], 0.7, averaged)
        for r in ridge.table().collect():
            mine = (r["mask"] >> player) & 1 == 1
            a = x[mine].T @ x[mine] + 0.7 * (max(1, mine.sum()) if averaged else 1) * np.eye(3)
            assert r["u"] == pytest.approx(((np.linalg.solve(a, x[mine].T @ y[mine]) - [0.5, -1.0, 2.0]) ** 2).sum())
    assert ridge.bounds()[0] == pytest.approx(5.25)
    near = vector(regression.kernel_shap(lazy.AdditiveGame(40, spark.range(40).selectExpr("cast(id AS int) AS player", "cast(id AS double) AS w")), SHAPLEY, 300, 1))
    assert near == pytest.approx(np.arange(40.0), abs=1e-6)
    for bad in (lambda: lazy.AdditiveGame(63, weights).bounds(), lambda: lazy.RidgeGame(5, rows, [1.0], 0.0).bounds(), lambda: game.__class__(17, weights).table(), lambda: games.additive(weights, 17)):
        with pytest.raises(ValueError):
            bad()
