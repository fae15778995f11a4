import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.functions.noise import Uniforms
from veilstat.operators import mechanisms
from veilstat.plans import budget, composition, glm, histograms, regression, specs, trees
from veilstat.sources import metadata

QUIET = Uniforms.silent()


def test_mean(spark):
    spec = specs.MeanSpec("mechanismLaplace", "numeric", "x", 10_000, (0, 100), epsilon=0.1)
    assert spec.sens == 0.01 and round(spec.accuracy, 1) == 0.3
    assert round(specs.MeanSpec("mechanismLaplace", "numeric", "x", 10_000, (0, 100), accuracy=0.3).epsilon, 1) == 0.1
    df = spark.createDataFrame([(0.0,), (150.0,), (None,)], "x double")
    got = spec.release(df, QUIET, F.lit(0.5))
    assert got["release"] == pytest.approx(50) and got["upper"] - got["release"] == pytest.approx(spec.accuracy)
    flags = specs.MeanSpec("mechanismLaplace", "logical", "x", 4, epsilon=1.0).release(spark.createDataFrame([(1,), (1,), (0,), (1,)], "x int"), QUIET, F.lit(0.5))
    assert flags["histogram"] == {0: 1, 1: 3} and flags["median"] == 1 and flags["std_dev"] == pytest.approx(math.sqrt(0.1875))
    assert specs.release_frame(df, got).count() == 1
    assert specs.MeanSpec("mechanismLaplace", "logical", "x", 4, epsilon=1.0).logical(1.2)["std_dev"] is None


def test_variance(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9, 3, 10)], "x double")
    spec = specs.VarianceSpec("mechanismLaplace", "numeric", "x", 6, (0, 10), epsilon=1.0)
    assert spec.release(df, QUIET)["release"] == pytest.approx(np.var([0, 1, 5, 9, 3, 10], ddof=1))
    assert spec.release(df, Uniforms(fixed=[1e-9]))["std_dev"] is None


@pytest.mark.parametrize(
    ("args", "chosen"),
    [
        (("numeric", None, [0, 1], None, None), "mechanismLaplace"),
        (("logical", None, None, None, None), "mechanismLaplace"),
        (("numeric", (0, 1), None, 5, None), "mechanismLaplace"),
        (("numeric", None, None, 5, None), "mechanismStability"),
        (("integer", (0, 1), None, None, 10), "mechanismLaplace"),
        (("character", None, None, None, None), "mechanismStability"),
    ],
)
def test_mechanism_choice(args, chosen):
    assert histograms.mechanism_of(*args) == chosen


def test_histogram_rules():
    with pytest.raises(ValueError, match="number of bins or granularity"):
        histograms.mechanism_of("numeric", (0, 1), None, None, None)
    with pytest.raises(ValueError, match="at least 2"):
        histograms.check_n_bins(1)
    with pytest.warns(UserWarning, match="next highest"):
        assert histograms.check_n_bins(16.5) == 17
    with pytest.raises(ValueError, match="Bins must be numeric"):
        histograms.check_bins(["a"], None, "numeric")
    with pytest.raises(ValueError, match="of type `character`"):
        histograms.check_bins([1], None, "character")
    with pytest.raises(ValueError, match="0, 1, or NA"):
        histograms.check_bins([2], None, "logical")
    with pytest.warns(UserWarning, match="both bins and a data range"):
        histograms.check_bins([0, 1], (0, 1), "numeric")
    assert histograms.bins_of("logical", None, None, None, False, None, 5) == [0, 1, None]
    assert len(histograms.bins_of("numeric", (0, 16), None, None, False, 1000, 10_000)) == 11
    with pytest.warns(UserWarning, match="left out"):
        assert histograms.imputation_bins(["a", "z"], ["a", "b"], "character") == ["a"]
    assert histograms.normalize([-1, 5, 15], 10) == pytest.approx([0, 10 / 3, 20 / 3])
    assert sum(histograms.normalize([3, 4, 5.5], 20)) == pytest.approx(20)
    assert histograms.intervals([0, 3], 5) == [(0, 5), (0, 8)]
    assert histograms.herfindahl([5, 5], 10) == 0.5


def test_histograms(spark):
    df = spark.createDataFrame([(1,), (0,), (1,), (None,)], "x int")
    three = specs.HistogramSpec("logical", "x", 4, epsilon=1.0).release(df, QUIET)
    assert three["release"] == {"0": 1, "1": 2, "NA": 1} and three["mean"] == pytest.approx(2 / 3)
    two = specs.HistogramSpec("logical", "x", 4, epsilon=1.0, impute=True).release(df, QUIET, F.lit(0.9))
    assert two["release"] == {"0": 1, "1": 3}
    words = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10 + [("z",)], "x string")
    got = specs.HistogramSpec("character", "x", 40, epsilon=1.0, bins=["a", "b", "c"]).release(words, QUIET, F.lit(0.99))
    assert got["release"] == pytest.approx({"a": 30 * 40 / 41, "b": 10 * 40 / 41, "c": 40 / 41})
    stable = specs.HistogramSpec("character", "x", 41, epsilon=3.0, delta=1e-6)
    assert stable.mechanism == "mechanismStability" and list(stable.release(words, QUIET)["release"]) == ["a"]
    with pytest.raises(ValueError, match="privacy risk"):
        specs.HistogramSpec("character", "x", 100_000, epsilon=1.0)
    numbers = spark.createDataFrame([(float(k),) for k in range(100)], "x double")
    found = specs.HistogramSpec("numeric", "x", 100, epsilon=50.0, n_bins=2, delta=1e-9).release(numbers, QUIET)
    assert sorted(found["release"].values()) == [50, 50]


def covariance(**more):
    return specs.CovarianceSpec("mechanismLaplace", "numeric", 10_000, ["a", "b", "c"], [(0, 1)] * 3, **more)


@pytest.mark.filterwarnings("ignore:an epsilon of")
def test_covariance_budgets():
    assert covariance(epsilon=[1.0] * 6).global_eps == 6
    assert covariance(global_eps=6).epsilon == [1] * 6
    assert covariance(global_eps=6, epsilon_dist=[0.1, 0.1, 0.1, 0.5, 0.1, 0.1]).epsilon == pytest.approx([0.6, 0.6, 0.6, 3, 0.6, 0.6])
    assert len(covariance(accuracy=1).epsilon) == 6
    assert covariance(accuracy_vals=[1.0] * 6).epsilon == covariance(accuracy=1.0).epsilon
    for bad in ({"epsilon": 1.0}, {"epsilon": [1.0] * 3}):
        with pytest.raises(ValueError, match="epsilons are wanted"):
            covariance(**bad)


def test_regressions(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    y = 2 * x[:, 0] - 3 * x[:, 1] + 0.01 * rng.random(500)
    df = spark.createDataFrame([(float(c), float(a), float(b), 1.0) for c, (a, b) in zip(y, x)], "y double, p double, q double, w double")
    spec = specs.CovarianceSpec("mechanismLaplace", "numeric", 500, ["p", "y", "q"], [(0, 1), (-4, 4), (0, 1)], epsilon=[1.0] * 6, formula="y ~ p + q", intercept=True)
    got = spec.release(df, QUIET)
    assert got["columns"][0] == "intercept" and np.allclose(got["matrix"], got["matrix"].T)
    (found,) = got["regression"]
    assert found["p"][0] == pytest.approx(2, abs=0.01) and found["q"][0] == pytest.approx(-3, abs=0.01)
    later = regression.coefficient_release(["y ~ p", "p ~ q"], got, 500)
    assert later[0]["p"][0] == pytest.approx(np.polyfit(x[:, 0], y, 1)[0])
    assert regression.linear_regression("y ~ x", np.zeros((2, 2)), ["y", "x"], 5) == regression.NOT_INVERTIBLE
    assert regression.linear_regression("y ~ x", np.array([[1, 2], [2, 1]]), ["y", "x"], 5) == regression.NOT_POSITIVE
    g = rng.random((4, 4))
    g = g @ g.T
    assert np.allclose(regression.sweep(g, [True] * 4), -np.linalg.inv(g)) and np.allclose(regression.sweep(g, [False] * 4), g)
    for bad in ("y", "y ~", "~ x"):
        with pytest.raises(ValueError):
            regression.parse_formula(bad)


def test_trees(spark):
    df = spark.range(640).select((F.col("id") % 64 + 1).cast("double").alias("x"))
    spec = specs.TreeSpec("x", 640, (1, 64), 1, epsilon=1.0, percentiles=(0.25,))
    got = spec.release(df, QUIET)
    assert got["release"][0] == 640 and got["cdf"][-1] == (64.0, 1.0)
    assert got["median"] == pytest.approx(33, abs=2) and got["percentiles"][0] == pytest.approx(17, abs=2)
    true = np.array([640 / 2 ** int(math.log2(i)) for i in range(1, 64)])
    noisy = true + np.random.default_rng(0).laplace(0, 20, 63)
    better = trees.consistent(noisy, 640, 20 * 2**0.5)["efficient"][1:]
    assert better[0] == 640 and np.abs(better - true)[1:].mean() < np.abs(noisy - true)[1:].mean()
    assert trees.rounded([0.5, 1.5, -3]).tolist() == [0, 2, 0]


def test_subset_weights_against_all_subsets():
    sizes, weights = [2, 3, 3, 7, 11], [0.5, 1.5, 2.0, 0.25, 3.0]
    for bound in (0, 5, 9, 26):
        all_of = sum(math.prod(weights[i] for i in s) for k in range(6) for s in itertools.combinations(range(5), k) if sum(sizes[i] for i in s) <= bound)
        assert composition.bounded_subset_weight(sizes, weights, bound) == pytest.approx(all_of)


def test_composition_bounds():
    for k, e in ((2, 0.1), (10, 0.2), (30, 0.05)):
        params = [(e, 1e-9)] * k
        best = composition.optimal_homogeneous(params, 1e-5)
        assert 0 < best <= k * e + 1e-9
        assert composition.is_private(params, 1e-5, best + 1e-6) and not composition.is_private(params, 1e-5, best * 0.9)
    mixed = [(0.1, 1e-9), (0.2, 1e-9), (0.3, 1e-9)]
    bound = composition.upper_bound(mixed, 1e-6)
    near = composition.approximate(mixed, 1e-6)
    assert near <= bound + 0.01 and bound <= 0.6 + 1e-9
    assert composition.is_private(mixed, 1e-6, near + 0.02) and not composition.is_private(mixed, 1e-6, near * 0.8)
    almost = composition.approximate([(0.2, 1e-9), (0.2, 1e-9), (0.2000001, 1e-9)], 1e-6)
    assert almost == pytest.approx(composition.optimal_homogeneous([(0.2, 1e-9)] * 3, 1e-6), abs=0.02)


def test_budget(spark):
    assert budget.update_parameters([(None, 0.0)], [], 1.0, 1e-6) == [(1.0, 1e-6)]
    even = budget.update_parameters([(None, 1e-9)] * 3, [], 1.0, 1e-6)
    assert len({e for e, _ in even}) == 1 and composition.is_private(even, 1e-6, 1.0 + 1e-6)
    held = budget.update_parameters([(0.1, 1e-9), (0.3, 1e-9), (0.3, 1e-9)], [0], 1.0, 1e-6)
    assert held[0][0] == 0.1 and held[1][0] == pytest.approx(held[2][0])
    with pytest.raises(budget.HeldOverBudget):
        budget.update_parameters([(3.0, 1e-9), (0.3, 1e-9)], [0], 1.0, 1e-6)
    mixed = budget.update_parameters([(0.2, 1e-9), (0.4, 1e-9), (None, 1e-9)], [], 1.0, 1e-6)
    assert mixed[1][0] == pytest.approx(2 * mixed[0][0], rel=0.2) and composition.is_private(mixed, 1e-6, 1.02)
    ledger = budget.Ledger(spark, 1.0, 1e-6)
    ledger.spend("mean", 0.6)
    with pytest.raises(ValueError, match="exceed the budget"):
        ledger.spend("variance", 0.6)
    assert ledger.totals().first()["epsilon"] == pytest.approx(0.6)


def test_glm(spark):
    rng = np.random.default_rng(3)
    x = rng.random(2000)
    df = spark.createDataFrame([(float(a), float(1 + 2 * a + 0.1 * rng.normal()), float(rng.random() < 1 / (1 + np.exp(2 - 4 * a)))) for a in x], "x double, y double, z double")
    ols = glm.GlmSpec("y ~ x", "ols", 2000, [(-1, 5), (0, 1)], epsilon=1.0).release(df, QUIET)["coefficients"]
    assert ols["intercept"] == pytest.approx(1, abs=0.05) and ols["x"] == pytest.approx(2, abs=0.1)
    logit = glm.GlmSpec("z ~ x", "logit", 2000, [(0, 1), (0, 1)], epsilon=1.0).release(df, QUIET)["coefficients"]
    assert logit["intercept"] == pytest.approx(-2, abs=0.4) and logit["x"] == pytest.approx(4, abs=0.7)
    draws = glm.GlmSpec("y ~ x", "ols", 2000, [(-1, 5), (0, 1)], epsilon=1.0, n_boot=3).release(df, QUIET, seed=1)
    assert draws["summary"]["x"]["lower"] <= draws["summary"]["x"]["estimate"] <= draws["summary"]["x"]["upper"]
    assert glm.scale_release([1, 2, 4], 2, 3) == [3, 3, 6]
    with pytest.raises(ValueError, match="objective"):
        glm.loss_terms("x", F.lit(1), F.lit(1))


def test_documents(spark):
    spec = specs.MeanSpec("mechanismLaplace", "numeric", "x", 10, (0, 1), epsilon=1.0)
    result = spec.release(spark.createDataFrame([(0.5,)], "x double"), QUIET)
    one = json.loads(metadata.releases_json([("x", "numeric", result), ("x", "numeric", {"std_dev": 1.0}), ("f", "logical", {"release": 1})]))
    assert one["dataset"] == {"private": True} and one["variables"]["x"]["std_dev"] == 1 and one["variables"]["f"]["plottype"] == "bar"
    assert set(json.loads(metadata.catalog_json())["DP Statistics"][0]) == {"histogram"}
    assert json.loads(metadata.statistic_json("Mean"))["mechanisms"] == ["Laplace"]
    doc = json.loads(metadata.release_document([metadata.release_entry("mean", spec, result)], "d", "row", 1, "https://example.com"))
    entry = doc["dp-releases"][0]
    assert {"statistic", "variables", "releaseInfo", "postprocess", "algorithmInfo", "accuracy", "batch", "privacyLoss"} <= set(entry)
    assert entry["privacyLoss"] == {"name": "pure", "epsilon": 1.0} and doc["dataset"]["rowCount"] == "private"


def test_batches_stop_when_the_budget_is_spent(spark, tmp_path):
    from veilstat.streaming.budgeted import release_batches

    for k in range(3):
        spark.createDataFrame([(0.5,)], "x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spec, ledger, got = specs.MeanSpec("mechanismLaplace", "numeric", "x", 10, (0, 1), epsilon=0.4), budget.Ledger(spark, 1.0, 0.0), []
    query = release_batches(stream, spec, ledger, lambda n, r: got.append(r["epsilon"]), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert got == [0.4, 0.4]


def test_replayed_batches_are_paid_for_and_released_once(spark, tmp_path):
    from veilstat.streaming.budgeted import BatchLedger

    def ledger():
        return BatchLedger(budget.Ledger(spark, 1.0, 0.0), str(tmp_path / "ledger"))

    assert ledger().pay(spark, 0, 0.6, 0.0) and not ledger().pay(spark, 0, 0.6, 0.0)
    assert not ledger().pay(spark, 1, 0.6, 0.0) and ledger().pay(spark, 1, 0.4, 0.0)
    assert ledger().spent(spark) == {0: (0.6, 0.0), 1: (0.4, 0.0)}


def _likelihood(objective, z, y):
    if objective == "logit":
        return y * z - np.logaddexp(0, z)
    if objective == "poisson":
        return y * z - np.exp(z)
    phi = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in z])
    return y * np.log(phi) + (1 - y) * np.log1p(-phi)


def test_glm_reaches_the_optimum_with_five_covariates(spark):
    rng = np.random.default_rng(12)
    x = rng.random((1500, 5))
    z = x @ [1.5, -2.0, 0.5, 1.0, -0.5] - 0.3
    y = {"logit": rng.random(1500) < 1 / (1 + np.exp(-z)), "probit": z + rng.normal(size=1500) > 0, "poisson": rng.poisson(np.exp(z))}
    names = [f"x{k}" for k in range(5)]
    for objective, own in y.items():
        df = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, own)], "y double, " + ", ".join(f"{n} double" for n in names))
        spec = glm.GlmSpec("y ~ " + " + ".join(names), objective, 1500, [(0, 50)] + [(0, 1)] * 5, epsilon=1.0)
        got = np.array(list(spec.release(df, QUIET)["coefficients"].values()))
        scale = np.sqrt((x**2).sum(1)).max()

        def loss(t):
            ridge = 0.5 * (t[0] ** 2 + (t[1:] ** 2).sum() * scale**2) if objective == "logit" else 0.0
            return ridge - _likelihood(objective, t[0] + x @ t[1:], own.astype(float)).sum()

        for k in range(6):
            for step in (-1e-3, 1e-3):
                assert loss(got) <= loss(got + step * np.eye(6)[k]) + 1e-7, (objective, k)


def test_search_that_finds_no_minimum_raises():
    with pytest.raises(RuntimeError, match="no minimum"):
        glm.newton(lambda t: (float(np.exp(-t[0])), -np.exp(-t), np.diag(np.exp(-t))), np.zeros(1), tolerance=0.0, most=20)


def test_normal_tails(spark):
    zs = [-30.0, -8.0, -5.0, -3.0, -0.5, 0.0, 0.5, 3.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(glm._normal_log_cdf(F.col("z"))).collect()]
    for z, v in zip(zs, got):
        want = math.log(math.erfc(-z / math.sqrt(2)) / 2) if z < 0 else math.log1p(-math.erfc(z / math.sqrt(2)) / 2)
        assert v == pytest.approx(want, rel=1e-6, abs=1e-8), z


def test_empty_tables_have_defined_releases(spark):
    df = spark.createDataFrame([], "x double, y double, b boolean, s string")
    assert math.isnan(specs.MeanSpec("mechanismLaplace", "numeric", "x", 10, (0, 1), epsilon=1.0).release(df)["release"])
    flags = specs.MeanSpec("mechanismLaplace", "logical", "b", 10, epsilon=1.0).release(df.withColumn("b", F.col("b").cast("int")))
    assert math.isnan(flags["release"]) and flags["histogram"] is None
    assert specs.VarianceSpec("mechanismLaplace", "numeric", "x", 10, (0, 1), epsilon=1.0).release(df)["std_dev"] is None
    assert np.isnan(specs.CovarianceSpec("mechanismLaplace", "numeric", 10, ["x", "y"], [(0, 1)] * 2, epsilon=[1.0] * 3).release(df)["matrix"]).all()
    assert math.isnan(specs.fused(df, [specs.MeanSpec("mechanismLaplace", "numeric", "x", 10, (0, 1), epsilon=1.0)])[0])
    assert specs.HistogramSpec("character", "s", 10, epsilon=1.0, delta=1e-6).release(df)["release"] == {}
    assert sum(specs.HistogramSpec("numeric", "x", 10, epsilon=1.0, bins=[0, 1, 2]).release(df, QUIET)["release"].values()) == 0


def test_true_values_need_no_python_worker(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    plan = specs.MeanSpec("mechanismLaplace", "numeric", "x", 10, (0, 1), epsilon=1.0).true(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bootstrap_histogram(spark):
    df = spark.createDataFrame([("abc"[k % 3 % 2],) for k in range(300)], "x string")
    spec = specs.HistogramSpec("character", "x", 300, epsilon=1.0, bins=["a", "b"], mechanism="mechanismBootstrap", n_boot=6)
    got = spec.release(df, QUIET, seed=4)
    assert len(got["replicas"]) == 6 and all(sum(r.values()) == pytest.approx(300) for r in got["replicas"])
    assert got["release"]["a"] == pytest.approx(200, abs=20) and len({r["a"] for r in got["replicas"]}) > 1
    assert got["errors"]["a"]["sd"] == pytest.approx(math.sqrt(300 * 2 / 9), rel=0.8)
    ages = spark.createDataFrame([(float(k % 10),) for k in range(100)], "x double")
    numbers = specs.HistogramSpec("numeric", "x", 100, epsilon=1.0, rng=(0, 10), n_bins=2, mechanism="mechanismBootstrap", n_boot=2).release(ages, QUIET, seed=1)
    assert set(numbers["release"]) == {"[0,5]", "(5,10]"}
    with pytest.raises(ValueError, match="declared bins"):
        specs.HistogramSpec("character", "x", 300, epsilon=1.0, delta=1e-6, mechanism="mechanismBootstrap")


def test_exchange_entries(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)], "x string")
    stable = specs.HistogramSpec("character", "x", 61, epsilon=1.0, delta=1e-6)
    entry = metadata.release_entry("histogram", stable, stable.release(df, QUIET))
    assert entry["algorithmInfo"]["argument"] == {"constraint": {"lowerbound": 0, "upperbound": 0}, "n": 61, "bins": ["a"]}
    assert entry["privacyLoss"] == {"name": "approx dp", "epsilon": 1.0, "delta": 1e-6} and entry["releaseInfo"]["mechanism"] == "Laplace"
    named = specs.HistogramSpec("character", "x", 61, epsilon=1.0, bins=["a", "b"])
    assert metadata.release_entry("histogram", named, named.release(df, QUIET))["algorithmInfo"]["argument"]["constraint"] == {"lowerbound": 0, "upperbound": 1}
    tree = specs.TreeSpec("x", 10, (0, 7), 1, epsilon=1.0)
    with pytest.raises(ValueError, match="no statistic"):
        metadata.release_entry("tree", tree, {"release": []})


@pytest.mark.parametrize("mechanism", ["mechanismLaplace", "mechanismGaussian"])
def test_any_statistic_is_bounded_imputed_and_released(spark, mechanism):
    df = spark.createDataFrame([(0.0,), (9.0,), (None,), (2.0,)], "x double")
    got = mechanisms.released(df, ["x"], "numeric", [(0, 3)], [F.sum("x"), F.max("x")], 1.0, 0.5, delta=1e-6, mechanism=mechanism, source=QUIET, uniform=F.lit(0.5))
    assert got == [6.5, 3.0]
    noisy = mechanisms.released(df, ["x"], "numeric", [(0, 3)], [F.sum("x")], 1.0, 0.5, delta=1e-6, mechanism=mechanism, source=Uniforms(fixed=[0.9]), uniform=F.lit(0.5))
    scale = -math.log(0.2) * 2 if mechanism == "mechanismLaplace" else 1.2815515655446004 * math.sqrt(2 * math.log(1.25e6)) * 2
    assert noisy == [pytest.approx(6.5 + scale)]
    with pytest.raises(ValueError, match="no mechanism"):
        mechanisms.released(df, ["x"], "numeric", [(0, 3)], [F.sum("x")], 1.0, 0.5, mechanism="mechanismStability")


def test_huge_trees_are_refused():
    with pytest.raises(ValueError, match="larger steps"):
        specs.TreeSpec("x", 10, (0, 1e9), 1, epsilon=1.0)


def test_many_releases_compose_without_overflow():
    for k, eps in ((800, 1.0), (5000, 0.01)):
        got = composition.optimal_homogeneous([(eps, 0.0)] * k, 1e-6)
        assert 0 < got < k * eps
    assert composition.optimal_homogeneous([(0.1, 0.0)] * 10, 0.0) == pytest.approx(1.0, abs=1e-6)
