import numpy as np
import pytest

from attrispark.functions.spec import BANZHAF, SHAPLEY, banzhaf
from attrispark.operators import estimators, exact, report, trajectory
from attrispark.operators.estimators import Unsupported
from attrispark.plans.run import GROUP_NAMES, REGISTRY, converge, phases, run, run_group, samples_for, strata_group, timed
from attrispark.sources import games, store
from attrispark.sources.training import Training, trained_in_order, trained_on_tables, training_game


@pytest.fixture(scope="module")
def game(spark):
    values = np.random.default_rng(9).normal(size=32)
    return games.TableGame(5, spark.createDataFrame([(m, float(v)) for m, v in enumerate(values)], "mask bigint, u double").cache())


@pytest.mark.parametrize("name", REGISTRY)
def test_every_name_runs_or_refuses(game, name):
    done = 0
    for spec in (SHAPLEY, banzhaf(0.3)):
        try:
            rows = run(game, name, spec, 30, seed=2).collect()
        except Unsupported:
            continue
        done += 1
        assert sorted(r["player"] for r in rows) == [0, 1, 2, 3, 4]
        assert all(np.isfinite(r["value"]) for r in rows)
    assert done


def test_random_probabilities_of_real_parameters(spark):
    for a, b in ((0.5, 0.5), (2.5, 0.75), (3.25, 4.0)):
        t = np.array([r["t"] for r in estimators.sample(spark, estimators.Law(coin=("beta", a, b)), 3, 4000, 5).select("t").collect()])
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert ((t >= 0) & (t <= 1)).all()
        assert t.mean() == pytest.approx(mean, abs=4 * (var / 4000) ** 0.5)
        assert t.var() == pytest.approx(var, rel=0.15)


def test_stored_tables_and_kept_games(spark, tmp_path):
    rows = [(1, "a", None, 0.1), (2, None, "x,y\n\"q\"", None), (3, "", " pad ", -1e300), (3, "", " pad ", -1e300)]
    table = spark.createDataFrame(rows, "k bigint, a string, b string, v double")
    for form in store.FORMS:
        for part in (table, table.limit(0)):
            store.save(part, f"{tmp_path}/{form}", form)
            back = store.load(spark, f"{tmp_path}/{form}", form, table.schema)
            assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, part.collect()), key=str)
    with pytest.raises(ValueError):
        store.save(table, f"{tmp_path}/x", "pickle")
    built = []

    def build():
        built.append(1)
        return table

    for players in (3, 3, 4):
        assert store.kept(spark, f"{tmp_path}/games", build, players=players, seed=1).count() == 4
    assert len(built) == 2


@pytest.mark.parametrize("name", [*estimators.RULES, *estimators.MARGINAL])
def test_one_pass_gives_what_each_checkpoint_alone_gives(game, name):
    done = 0
    for spec, paired in ((SHAPLEY, False), (SHAPLEY, True), (banzhaf(0.3), False)):
        try:
            rows = converge(game, name, spec, 24, 8, seed=4, paired=paired).collect()
        except Unsupported:
            continue
        done += 1
        for k in range(3):
            want = {r["player"]: r["value"] for r in run(game, name, spec, 8 * (k + 1), seed=4, paired=paired).collect()}
            assert {r["player"]: r["value"] for r in rows if r["ckpt"] == k} == pytest.approx(want)
            assert {r["evaluations"] for r in rows if r["ckpt"] == k} == {40 * (k + 1)}
    assert done


def test_method_order(spark):
    summary = spark.createDataFrame([("b", 3), ("a", 5), ("c", 1), ("b", 9), ("z", 2)], "method string, line int")
    order = lambda **options: [r["method"] for r in report.method_order(summary, "line", **options).orderBy("place").collect()]
    assert order() == ["c", "z", "b", "a"]
    assert order(order=["a", "none", "z"], hidden=["b"]) == ["a", "z", "c"]
    assert order(requested=["b", "c"], hidden=["b"]) == ["b", "c"]
    with pytest.raises(Exception, match="no such method"):
        order(requested=["b", "none"])
    assert report.method_order(summary.limit(0), "line").collect() == []


def test_budgets_and_names(game):
    assert samples_for("permutation", 5, 100) == 100
    assert samples_for("arm", 5, 100) == 250
    assert samples_for("msr", 5, 100) == 500
    with pytest.raises(KeyError):
        run(game, "nothing", SHAPLEY, 10)
    rows, seconds = timed(game, "msr", BANZHAF, 10)
    assert len(rows) == 5 and seconds > 0


def test_phases_of_a_run(game):
    for name, options in (("two_stage", {}), ("kernel_shap", {"every": 10}), ("msr", {})):
        spec = BANZHAF if name == "msr" else SHAPLEY
        rows, took = phases(game, name, spec, 30, seed=2, **options)
        assert len(rows) == (15 if options else 5) and took.evaluations == 150
        assert took.elapsed == pytest.approx(took.regular + took.readout) and took.regular > 0
        assert (took.readout > 0) == (name != "msr")


def test_groups_by_name(game):
    want = exact.group_sum(game, SHAPLEY, [0, 3]).first()["value"]
    assert run(game, "exact", SHAPLEY, 1, group=[3, 0]).first()["value"] == pytest.approx(want)
    assert abs(run(game, "two_stage", SHAPLEY, 200, group=[0, 3]).first()["value"] - want) < 0.3
    assert abs(strata_group(game, SHAPLEY, [0, 3], 400).first()["value"] - want) < 0.3
    parts = {r["player"]: r["value"] for r in run(game, "arm", SHAPLEY, 50, seed=1).collect()}
    assert run(game, "arm", SHAPLEY, 50, seed=1, group=[0, 3]).first()["value"] == pytest.approx(parts[0] + parts[3])


def test_bindings_of_groups(game):
    want = exact.group_sum(game, SHAPLEY, [0, 3]).first()["value"]
    for name in (*GROUP_NAMES, "strata"):
        assert abs(run_group(game, name, SHAPLEY, 300, [3, 0], 2).first()["value"] - want) < 0.3
    parts = {r["player"]: r["value"] for r in run(game, "regression_msr_unbiased", SHAPLEY, 40, 2).collect()}
    assert run_group(game, "individual_regression_msr_unbiased_unpaired", SHAPLEY, 40, [0, 3], 2).first()["value"] == pytest.approx(parts[0] + parts[3])
    for bad in (lambda: run_group(game, "msr", SHAPLEY, 10, [0]), lambda: converge(game, "nothing", SHAPLEY, 10, 5)):
        with pytest.raises(KeyError):
            bad()
    for group in ([], [1, 1], [9]):
        with pytest.raises(ValueError):
            run_group(game, "individual_ofa_fixed", SHAPLEY, 10, group)


def test_checkpoints_are_nested(game):
    rows = converge(game, "arm", SHAPLEY, 30, 10, seed=4).collect()
    assert sorted({(r["ckpt"], r["evaluations"]) for r in rows}) == [(0, 50), (1, 100), (2, 150)]
    last = {r["player"]: r["value"] for r in rows if r["ckpt"] == 2}
    assert last == pytest.approx({r["player"]: r["value"] for r in run(game, "arm", SHAPLEY, 30, seed=4).collect()})


def test_training_game(spark):
    rng = np.random.default_rng(1)
    y = np.arange(6) % 2
    x = rng.normal(size=(6, 3)) + 3 * y[:, None]
    training = Training(x, y, x, y, 2)
    game = training_game(spark, training)
    values = {r["player"]: r["value"] for r in exact.enumerated(game, SHAPLEY).collect()}
    assert sum(values.values()) == pytest.approx(training([63])[0] - training([0])[0])
    more = Training(x[:4], y[:4], x, y, 2, "cross_entropy", extra=(x[4:], y[4:]))
    assert np.isfinite(more([0, 15])).all()
    with pytest.raises(NotImplementedError):
        Training(x, y, x, y, 2, "f1")


def test_training_on_tables_equals_training_in_memory(spark):
    rng = np.random.default_rng(4)
    x, y, player = rng.normal(size=(60, 3)), rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    x += y[:, None]
    rows = spark.createDataFrame([(int(p), a.tolist(), int(b)) for p, a, b in zip(player, x, y)] + [(0, None, 1), (1, [0.0] * 3, None)], "player int, x array<double>, y int")
    for metric in ("cross_entropy", "accuracy"):
        got = {r["mask"]: r["u"] for r in trained_on_tables(rows.repartition(5), rows.select("x", "y"), 3, 3, 6, 0.5, metric).table().collect()}
        for m in range(8):
            mine = (m >> player) & 1 == 1
            a, w = np.hstack([x, np.ones((60, 1))]), np.zeros((4, 3))
            for _ in range(6):
                p = np.exp(a[mine] @ w)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(mine.sum()), y[mine]] -= 1
                w -= 0.5 * a[mine].T @ p / max(1, mine.sum())
            z = a @ w
            want = (z.argmax(axis=1) == y).mean() if metric == "accuracy" else (z[np.arange(60), y] - np.log(np.exp(z).sum(axis=1))).mean()
            assert got[m] == pytest.approx(want)


@pytest.mark.parametrize("metric", ["cross_entropy", "accuracy"])
def test_one_pass_over_tables_equals_training_in_memory(spark, metric):
    """All embeddings, some of which train every coalition, and one start of the weights."""
    from hashlib import md5

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding is not null and label is not null").select("vec_id", "embedding", "label").collect()
    x, y = np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows]) % 3
    ids = [r["vec_id"] for r in rows]
    order = np.argsort(np.argsort([md5(f"{i}:order:5".encode()).hexdigest() for i in ids]))
    extra = np.array([i % 5 == 0 for i in ids])
    table = spark.createDataFrame([(i, None if e else i % 3, a.tolist(), int(b)) for i, e, a, b in zip(ids, extra, x, y, strict=True)] + [(None, 0, x[0].tolist(), 1), (10**9, 0, None, 1)], "id bigint, player int, x array<double>, y int").repartition(7)
    score = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x[:40], y[:40], strict=True)], "x array<double>, y int")
    got = {r["mask"]: r["u"] for r in trained_in_order(table, score, 3, 3, 0.05, metric, 5).table().collect()}
    own = ~extra
    for m in range(8):
        mine = own & (((m >> (np.array(ids) % 3)) & 1) == 1)
        training = Training(x[mine], y[mine], x[:40], y[:40], 3, metric, 0.05, 5, (x[extra], y[extra]), np.append(order[mine], order[extra]))
        assert got[m] == pytest.approx(training.score(training.fit(np.arange(mine.sum()))))


def test_reports(spark):
    truth = spark.createDataFrame([(0, 0.0), (1, 0.0)], "player int, value double")
    rows = spark.createDataFrame([(0, 0, 0, 3.0), (0, 0, 1, 4.0)], "run int, ckpt int, player int, value double")
    found = report.errors(rows, truth, ["run"]).first()
    assert found["l2_error"] == 5 and found["rel_l2_error"] == 5  # a truth of norm 0 counts as 1
    curve = spark.createDataFrame([(0, 1, 2.0), (0, 3, 4.0), (1, 5, 7.0)], "run int, x int, y double")
    assert {r["run"]: r["aucc"] for r in report.trapezoid(curve, ["run"], "x", "y").collect()} == {0: 3.0, 1: 7.0}
    flat = report.standardised(truth, truth, ["value"]).collect()
    assert [r["value"] for r in flat] == [0.0, 0.0]
    gaps = spark.createDataFrame([(0, 1, 5.0)], "player int, ckpt int, value double")
    assert [r["value"] for r in trajectory.filled(gaps, ["player"], 3).orderBy("ckpt").collect()] == [0.0, 5.0, 5.0, 5.0]


def test_shared_folders(spark, monkeypatch):
    from types import SimpleNamespace

    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=SimpleNamespace(master=master))
    assert store.shared(session("spark://a:1", "hdfs://b/c/")) == "hdfs://b/c"
    assert store.shared(session("local[4]")) == store.shared(session("local"))
    for master in ("spark://a:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            store.shared(session(master))
