"""Many players, all coalitions of 25, Gram sums by strips, and trajectories from one pass."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrispark.functions.spec import BANZHAF, SHAPLEY, banzhaf, beta
from attrispark.operators import estimators as est
from attrispark.operators import exact, regression, transform
from attrispark.operators import wide as many
from attrispark.plans.run import REGISTRY, converge, run, samples_for
from attrispark.sources import games, wide

SPECS = [SHAPLEY, BANZHAF, banzhaf(0.3), beta(4, 1)]


def vector(df) -> np.ndarray:
    return np.array([r["value"] for r in df.orderBy("player").collect()])


@pytest.fixture(scope="module")
def small(spark):
    values = np.random.default_rng(9).normal(size=32)
    return games.TableGame(5, spark.createDataFrame([(m, float(v)) for m, v in enumerate(values)], "mask bigint, u double").cache())


# ------------------------------------------------------------------ Gram sums


@pytest.mark.parametrize("folds", [1, 4])
def test_products_by_strips_and_levels(spark, monkeypatch, folds):
    monkeypatch.setattr(regression, "STRIP", 7)
    monkeypatch.setattr(regression, "FAN", 2)
    monkeypatch.setattr(regression, "ROWS", 64)
    rng = np.random.default_rng(0)
    rows = [(int(m), int(m).bit_count(), float(u), float(w), int(f)) for m, u, w, f in zip(rng.integers(0, 64, 700), rng.normal(size=700), rng.random(700), rng.integers(0, folds, 700), strict=True)]
    samples = spark.createDataFrame(rows, "mask bigint, s int, u double, w double, fold int").repartition(13)
    blocks = lambda c: [(regression.bit_matrix(c["mask"], 6), c["u"][:, None] * np.ones((1, 3))), (c["u"][:, None], None)]
    got = regression.products(samples, blocks, [(6, 3), (1, 1)], folds)
    for f in range(folds):
        mine = [r for r in rows if r[4] == f]
        x, u, w = regression.bit_matrix(np.array([r[0] for r in mine]), 6), np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        assert got[0][f] == pytest.approx((x * w[:, None]).T @ np.repeat(u[:, None], 3, axis=1))
        assert got[1][f] == pytest.approx(np.array([[(u * u * w).sum()]]))
    none = regression.products(samples.limit(0), blocks, [(6, 3), (1, 1)], folds)
    assert not none[0].any() and not none[1].any()
    with pytest.raises(MemoryError):
        regression.products(samples, blocks, [(1 << 14, 1 << 13)], 1)


def test_running_products_are_prefix_sums_in_any_number_of_jobs(spark, monkeypatch):
    samples = spark.range(90).select(F.col("id").alias("mask"), F.bit_count("id").cast("int").alias("s"), F.lit(1.0).alias("u"), (F.col("id") % 3).cast("int").alias("fold"), F.floor(F.col("id") / 20).cast("int").alias("ckpt"))
    blocks = lambda c: [(np.ones((len(c["u"]), 1)), c["mask"][:, None].astype(float))]
    whole = list(regression.running(samples, blocks, [(1, 1)], 3, 5))
    for k, (sums,) in enumerate(whole):
        assert sums.reshape(-1).tolist() == [sum(i for i in range(min(90, 20 * k + 20)) if i % 3 == f) for f in range(3)]
    monkeypatch.setattr(regression, "LARGEST", 6)
    parts = list(regression.running(samples, blocks, [(1, 1)], 3, 5))
    assert all((a[0] == b[0]).all() for a, b in zip(whole, parts, strict=True))


# ------------------------------------------------------------------ trajectories


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in est.RULES and n not in est.MARGINAL and n != "two_stage"])
def test_one_pass_gives_what_each_checkpoint_alone_gives(small, name):
    done = 0
    for spec, paired in ((SHAPLEY, False), (SHAPLEY, True), (beta(4, 2), False)):
        try:
            rows = converge(small, name, spec, 60, 20, seed=4, paired=paired).collect()
        except est.Unsupported:
            continue
        done += 1
        for k in (0, 2):
            want = {r["player"]: r["value"] for r in run(small, name, spec, 20 * (k + 1), seed=4, paired=paired).collect()}
            assert {r["player"]: r["value"] for r in rows if r["ckpt"] == k} == pytest.approx(want, abs=1e-8)
            assert {r["evaluations"] for r in rows if r["ckpt"] == k} == {100 * (k + 1)}
        if name == "tree_msr":
            break
    assert done


@pytest.mark.parametrize(("spec", "group"), [(SHAPLEY, None), (beta(4, 1), None), (beta(4, 1), [0, 3])])
def test_two_stage_trajectory_is_one_run(small, spec, group):
    stage = regression.TwoStage(small, spec, group=group, seed=3)
    counts = [30, 60, 160, 300]
    got = stage.trajectory(counts)
    pilot = int((300 - 12) * stage.pilot_fraction)
    for k, c in enumerate(counts):
        assert got[k] == pytest.approx(stage.estimate(c, pilot), abs=1e-9)
    assert got[-1] == pytest.approx(stage.estimate(300))


def test_a_hundred_checkpoints(small):
    rows = converge(small, "kernel_shap", SHAPLEY, 400, 4, seed=1).collect()
    assert len(rows) == 500
    last = {r["player"]: r["value"] for r in rows if r["ckpt"] == 99}
    assert last == pytest.approx({r["player"]: r["value"] for r in run(small, "kernel_shap", SHAPLEY, 400, seed=1).collect()})
    grouped = converge(small, "kernel_shap", SHAPLEY, 400, 200, seed=1, group=[0, 2]).collect()
    assert [r["value"] for r in grouped if r["ckpt"] == 1] == pytest.approx([last[0] + last[2]])
    assert samples_for("kernel_shap", 5, 400) == 2000


# ------------------------------------------------------------------ forty players


@pytest.fixture(scope="module")
def forty(spark):
    game = games.random_terms(spark, 40, 1600, 42, "structured", 0.5)
    game.terms = game.terms.cache()
    return game


@pytest.mark.parametrize("size", [5, 10, 20])
def test_two_stage_of_a_group_of_forty_players(forty, size):
    group = list(range(0, 2 * size, 2))
    truth = vector(exact.closed_form(forty, SHAPLEY))
    began = time.monotonic()
    got = regression.TwoStage(forty, SHAPLEY, group=group, seed=1).estimate(20_000)[0]
    assert time.monotonic() - began < 60
    assert abs(got - truth[group].sum()) < 0.05 * np.abs(truth).sum()


@pytest.mark.parametrize("group", [None, [0, 2, 3, 7]])
def test_players_by_size_are_multiplied_by_themselves(spark, group):
    """Products of the rows of each size equal those of whole rows."""
    game = games.random_terms(spark, 9, 40, 5)
    stage = regression.TwoStage(game, SHAPLEY, group=group, basis="size_player", folds=3)
    drawn = est.worth(game, stage.draw(stage.law(), 150, "a")).cache()
    got = stage.statistics(drawn)

    def whole(c):
        z = np.hstack([stage.features(c["mask"]), c["u"][:, None], np.ones((len(c["u"]), 1))])
        gamma = stage.gamma(c["mask"]) / c["q"][:, None]
        return [(z[:, :-1] * np.sqrt((gamma**2).sum(axis=1))[:, None], None), (gamma, z), (z[:, -1:], None)]

    c = {k: np.array([r[k] for r in drawn.collect()]) for k in ("mask", "u", "q", "fold")}
    for f in range(3):
        mine = {k: v[c["fold"] == f] for k, v in c.items()}
        for a, (left, right) in zip(got, whole(mine), strict=True):
            assert a[f] == pytest.approx(left.T @ (left if right is None else right))


def test_laws_of_many_cells(spark):
    from attrispark.functions import draws

    law = {3 * i + 1: 1.0 + (i * 7) % 5 for i in range(200)}
    rows = spark.range(3000).select(draws.uniform(F.col("id"), "c", 1).alias("u")).withColumn("c", draws.draw_size(F.col("u"), law)).collect()
    steps = np.cumsum([law[s] / sum(law.values()) for s in sorted(law)])
    sizes = sorted(law)
    assert [r["c"] for r in rows] == [sizes[min(int((steps <= r["u"]).sum()), 199)] for r in rows]


# ------------------------------------------------------------------ all coalitions


@pytest.mark.parametrize(("low", "strip"), [(16, 1 << 20), (4, 64), (3, 1 << 9), (20, 4)])
def test_transform_over_all_coalitions(spark, monkeypatch, low, strip):
    monkeypatch.setattr(transform, "LOW", low)
    monkeypatch.setattr(transform, "STRIP", strip)
    terms = [(0, 2.5), (1, 1.0), (0b1000000001, -3.0), (0b1111111111, 4.0), (0b0110000000, 0.5)]
    game = games.TermsGame(10, spark.createDataFrame(terms, "mask bigint, w double"))
    worth = [sum(w for t, w in terms if t & m == t) for m in range(1024)]
    assert {r["mask"]: r["u"] for r in transform.table(game).collect()} == pytest.approx(dict(enumerate(worth)))
    for spec in SPECS:
        assert vector(transform.exact(game, spec)) == pytest.approx(vector(exact.closed_form(game, spec)))
        want = vector(exact.closed_form(game, spec))[[0, 7, 9]].sum()
        assert transform.exact_group(game, spec, [9, 0, 7]).first()["value"] == pytest.approx(want)
    for r in transform.by_size(game).collect():
        mine = [u for m, u in enumerate(worth) if m.bit_count() == r["s"]]
        assert (r["coalitions"], r["mean"], r["least"], r["most"]) == pytest.approx((len(mine), sum(mine) / len(mine), min(mine), max(mine)))
    asked = [0, 1, 513, 1023, 700, 700]
    found = transform.evaluate(game, spark.createDataFrame([(m,) for m in asked], "mask bigint")).collect()
    assert {r["mask"]: r["u"] for r in found} == pytest.approx({m: worth[m] for m in asked}) and len(found) == 5
    with pytest.raises(ValueError):
        transform.exact(games.TermsGame(31, game.terms), SHAPLEY)


def test_exact_values_by_name_beyond_a_table(spark):
    game = games.random_terms(spark, 18, 60, 3)
    want = vector(exact.closed_form(game, SHAPLEY))
    assert vector(run(game, "exact", SHAPLEY, 1)) == pytest.approx(want)
    assert run(game, "exact", SHAPLEY, 1, group=[2, 17]).first()["value"] == pytest.approx(want[[2, 17]].sum())


# ------------------------------------------------------------------ many players


def as_wide(game: games.TermsGame, shift=lambda i: i, n: int | None = None) -> wide.WideGame:
    rows = [(sorted(shift(i) for i in range(game.n) if r["mask"] >> i & 1), r["w"]) for r in game.terms.collect()]
    return wide.WideGame(n or game.n, game.spark.createDataFrame(rows, "members array<int>, w double"))


@pytest.mark.parametrize("name", est.RULES)
def test_wide_rules_draw_and_count_as_narrow_ones(spark, name):
    narrow = games.random_terms(spark, 9, 40, 5)
    broad = as_wide(narrow)
    done = 0
    for spec, paired in ((SHAPLEY, False), (SHAPLEY, True), (beta(4, 2), False), (BANZHAF, True)):
        try:
            want = vector(est.estimate(name, narrow, spec, 40, 3, paired))
        except est.Unsupported:
            with pytest.raises(est.Unsupported):
                many.estimate(name, broad, spec, 40, 3, paired)
            continue
        got = vector(many.estimate(name, broad, spec, 40, 3, paired))
        if name == "improved_ame" and spec.kind == "beta_shapley":  # other draws of t
            assert np.isfinite(got).all()
        else:
            assert got == pytest.approx(want)
        done += 1
        if done == 2:
            break
    assert done


@pytest.mark.parametrize("n", [62, 63, 124, 200])
def test_words(spark, n):
    rng = np.random.default_rng(n)
    sets = [sorted(rng.permutation(n)[: int(rng.integers(0, n + 1))].tolist()) for _ in range(20)] + [[], list(range(n))]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k bigint, p array<int>").withColumn("mask", wide.words_of(F.col("p"), n))
    rows = frame.withColumn("ok", wide.contains(F.col("mask"), F.col("p"))).orderBy("k").collect()
    assert all(r["ok"] for r in rows)
    bits = wide.bits_of(frame.orderBy("k").select("mask").toArrow().column("mask").combine_chunks(), n)
    assert [np.flatnonzero(b).tolist() for b in bits] == sets
    other = many.sample(spark, est.Law({s: 1.0 for s in range(1, n)}), n, 20, 1, paired=True).collect()
    for k in range(10):
        a, b = sorted((r for r in other if r["k"] == k), key=lambda r: r["side"])
        assert [x | y for x, y in zip(a["mask"], b["mask"], strict=True)] == wide.full_words(n) and not any(x & y for x, y in zip(a["mask"], b["mask"], strict=True))
        assert a["s"] + b["s"] == n and a["s"] == sum(x.bit_count() for x in a["mask"])


def test_a_game_of_many_players(spark, monkeypatch):
    narrow = games.random_terms(spark, 8, 30, 7)
    broad = as_wide(narrow, lambda i: 60 * i + 3, 500)
    broad.terms = broad.terms.unionByName(spark.createDataFrame([([], 2.0)], "members array<int>, w double"))
    for spec in SPECS:
        got = vector(many.closed_form(broad, spec))
        assert got[[60 * i + 3 for i in range(8)]] == pytest.approx(vector(exact.closed_form(narrow, spec)))
        assert np.count_nonzero(got) <= 8
    assert broad.bounds()[0] == 2.0
    samples = many.sample(spark, est.Law(coin=0.8), 500, 40, 2, paired=True)
    whole = {(r["k"], r["side"]): r["u"] for r in broad.attach(samples).collect()}
    terms = broad.terms.collect()
    for r in samples.collect():
        held = {62 * j + i for j, m in enumerate(r["mask"]) for i in range(62) if m >> i & 1}
        assert whole[r["k"], r["side"]] == pytest.approx(sum(t["w"] for t in terms if set(t["members"]) <= held))
    monkeypatch.setattr(wide, "SMALL_MEMBERS", 40)
    chunked = wide.WideGame(500, broad.terms)
    assert {(r["k"], r["side"]): r["u"] for r in chunked.attach(samples).collect()} == pytest.approx(whole)
    assert np.abs(vector(many.estimate("msr", broad, BANZHAF, 600, 1)) - vector(many.closed_form(broad, BANZHAF))).max() < 4


def test_terms_of_many_players_move_once_for_a_block_of_coalitions(spark, monkeypatch):
    """Neither the shuffle partitions nor the number of words decide how often a term or a player is met."""
    rng = np.random.default_rng(4)
    rows = [(sorted(rng.choice(3000, 3, replace=False).tolist()), float(w)) for w in rng.normal(size=200)]
    terms = spark.createDataFrame(rows, "members array<int>, w double")
    samples = many.sample(spark, est.Law(coin=0.9), 3000, 20, 2)
    whole = {r["k"]: r["u"] for r in wide.WideGame(3000, terms).attach(samples).collect()}
    monkeypatch.setattr(wide, "SMALL_MEMBERS", 100)
    plan = wide.WideGame(3000, terms).attach(samples)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the coalitions by chunk; no term by block
    for block in (wide.BLOCK, 3000 * 7):  # one block of coalitions, three
        monkeypatch.setattr(wide, "BLOCK", block)
        found = wide.WideGame(3000, terms).attach(samples)
        assert found.columns == [*samples.columns, "u"]
        got = found.collect()
        assert {r["k"]: r["u"] for r in got} == pytest.approx(whole)
        assert {r["k"]: (r["mask"], r["s"], r["t"]) for r in got} == {r["k"]: (r["mask"], r["s"], r["t"]) for r in samples.collect()}


def test_a_set_of_very_many_players_is_drawn_in_one_pass(spark):
    n = 20_000
    drawn = many.sample(spark, est.Law({7: 1.0, 12_000: 1.0, n - 1: 1.0}), n, 12, 5)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan  # no word looks through all chosen players
    for r in drawn.collect():
        ranked = sorted(range(n), key=lambda i: hashlib.md5(f"{r['k']}:{i}:5".encode()).hexdigest())[: r["s"]]
        assert {62 * j + i for j, m in enumerate(r["mask"]) for i in range(62) if m >> i & 1} == set(ranked)


def test_weights_of_very_many_players():
    for spec in SPECS:
        assert sum(spec.d(3000)) == pytest.approx(1)
        assert spec.d(500) == pytest.approx(spec.__class__(spec.kind, spec.params).d(500))
        low, high = spec.d(499), spec.d(501)
        assert max(abs(a - b) for a, b in zip(low, high, strict=False)) < 0.02
        assert all(np.isfinite(spec.p(3000)))


# ------------------------------------------------------------------ boosted trees


def test_boosted_trees(spark):
    """Splits by the largest fall of the loss, Newton leaf weights, and leaves that add up to the prediction."""
    rng = np.random.default_rng(2)
    masks = rng.integers(0, 64, 300)
    u = 3.0 * (masks & 1) - 2.0 * ((masks >> 3) & 1) * ((masks >> 4) & 1) + rng.normal(size=300) * 0.1
    samples = spark.createDataFrame([(int(m), float(x), 1.0) for m, x in zip(masks, u, strict=True)], "mask bigint, u double, w double").repartition(4)
    model = regression.boosted(samples, 6, 12, 3, 0.5, 1.0, 1.0)
    assert model.base == pytest.approx(u.mean()) and model.asked[0][1] == 0
    inside = (masks & 1) == 1
    once = regression.boosted(samples, 6, 1, 1, 0.5, 1.0, 1.0)
    assert once.paid[0][[2, 3]] == pytest.approx([0.5 * (u[at] - u.mean()).sum() / (at.sum() + 1) for at in (~inside, inside)])
    assert np.abs(model.predict(masks) - u).mean() < 0.3
    every = np.arange(64)
    leaves = model.leaves()
    summed = model.base + sum(v * ((every & need) == need) * ((every & bar) == 0) for _, need, bar, v in leaves)
    assert model.predict(every) == pytest.approx(summed)
    for spec in SPECS:
        p = spec.p(6)
        want = [sum(p[m.bit_count()] * (summed[m | 1 << i] - summed[m]) for m in range(64) if not m >> i & 1) for i in range(6)]
        assert regression.tree_semivalue(leaves, spec, 6) == pytest.approx(want)
    flat = regression.boosted(samples.withColumn("u", F.lit(2.0)), 6, 2, 2, 0.5, 1.0, 1.0)
    assert flat.predict(every) == pytest.approx(np.full(64, 2.0))
