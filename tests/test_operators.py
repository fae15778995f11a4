import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.functions.noise import Uniforms, keyed_uniform
from veilstat.operators import aggregate, clean, mechanisms
from veilstat.sources.shared import written


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_clamp_keeps_missing_values(spark):
    got = [r[0] for r in column(spark, [float(k) for k in range(1, 11)] + [None, float("nan")]).select(clean.clamp(F.col("x"), 2.5, 7.0)).collect()]
    assert got[:10] == [2.5, 2.5, 3, 4, 5, 6, 7, 7, 7, 7] and got[10] is None
    nan = column(spark, [float("nan")])
    assert nan.select(clean.clamp(clean.null_of_nan(nan, "x"), 0.0, 1.0)).first()[0] is None


def test_censor_forms(spark):
    df = spark.createDataFrame([(float(a), float(a + 5)) for a in range(1, 6)], "a double, b double")
    got = df.select(*clean.censor(df, ["a", "b"], "numeric", [(1.0, 5.0), (7.0, 9.0)], rng_format="list")).collect()
    assert [tuple(r) for r in got] == [(1, 7), (2, 7), (3, 8), (4, 9), (5, 9)]
    with pytest.raises(ValueError, match="rngFormat"):
        clean.censor(df, ["a"], "numeric", (0, 1), rng_format="x")
    with pytest.raises(ValueError, match="do not match"):
        clean.censor(df, ["a"], "other", (0, 1))
    letters = column(spark, ["a", "b", "c", "c", "d"], "string")
    assert [r[0] for r in letters.select(*clean.censor(letters, ["x"], "character", levels=["a", "b", "c"])).collect()] == ["a", "b", "c", "c", None]


def test_imputed_values_stay_in_range(spark):
    df = spark.range(500).select(F.lit(None).cast("double").alias("x"), "id")
    u = keyed_uniform(F.col("id"), 1)
    got = df.select(clean.impute(F.col("x"), u, "numeric", 2, 3).alias("n"), clean.scale_values(u, "integer", 1, 6).alias("i"), clean.scale_values(u, "logical").alias("l"), clean.scale_values(u, "character", categories=["p", "q", "r"]).alias("c")).collect()
    assert all(2 <= r.n <= 3 for r in got)
    assert {r.i for r in got} == {1, 2, 3, 4, 5, 6} and {r.l for r in got} == {0, 1} and {r.c for r in got} == {"p", "q", "r"}
    secure = [r[0] for r in spark.range(100).select(clean.secure_uniform()).collect()]
    assert len(set(secure)) == 100 and all(0 < u < 1 for u in secure)


def test_recoding(spark):
    assert [r[0] for r in clean.make_logical(column(spark, [3.0, 8.0, None, 8.0]), "x").collect()] == [0, 1, None, 1]
    assert [r[0] for r in clean.make_logical(column(spark, ["a", "b", "a"], "string"), "x").collect()] == [0, 1, 0]
    with pytest.raises(ValueError, match="more than two values"):
        clean.make_logical(column(spark, [1.0, 2.0, 3.0]), "x")
    got = clean.make_dummies(spark.createDataFrame([("a", 1), ("c", 2), ("b", 3)], "k string, n int"), ["k"])
    assert got.columns == ["n", "k_b", "k_c"] and [tuple(r) for r in got.collect()] == [(1, 0, 0), (2, 0, 1), (3, 1, 0)]
    trimmed = [r[0] for r in clean.trim(column(spark, [float(k) for k in range(1, 101)]), "x", 0.1).collect()]
    assert min(trimmed) == 6 and max(trimmed) == 95


def test_norms(spark):
    df = spark.createDataFrame([(3.0, 4.0), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(clean.row_norm(["a", "b"])).collect()] == [5, 1]
    assert clean.column_norms(df, ["a", "b"], 1).first()[1] == 5
    scaled, most = clean.unit_ball(df, ["a", "b"])
    assert most == 5 and tuple(scaled.first()) == pytest.approx((0.6, 0.8))


def test_right_closed_bins(spark):
    df = column(spark, [0.0, 5.0, 5.1, 10.0, 10.1, None])
    assert [r[0] for r in df.select(aggregate.right_closed_bin(F.col("x"), [0, 5, 10])).collect()] == [0, 0, 1, 1, None, None]
    got = aggregate.binned_counts(df, F.col("x"), [0, 5, 10, 20]).orderBy("bin").collect()
    assert [(r.label, r["count"]) for r in got] == [("[0,5]", 2), ("(5,10]", 2), ("(10,20]", 1)]


def test_covariance_and_triangle(spark):
    df = spark.createDataFrame([(0.0, 1.0), (5.0, 2.0), (3.0, 3.0)], "x1 double, x2 double")
    assert [round(v, 3) for v in df.agg(*aggregate.covariances(["x1", "x2"])).first()] == [6.333, 1.5, 1.0]
    assert len(aggregate.lower_triangle("abc")) == 6 and len(aggregate.lower_triangle("abcd")) == 10


def test_tree_counts_add_up(spark):
    df = column(spark, [1.0, 2.0, 2.0, 7.0, 8.0, None])
    got = {r.node: r["count"] for r in aggregate.tree_nodes(df, F.col("x"), 1, 8, 1).collect()}
    assert got == {1: 5, 2: 3, 3: 2, 4: 3, 5: 0, 6: 0, 7: 2}


def test_noise_vanishes_without_sensitivity(spark):
    df = column(spark, [0.0, 1.0, 2.0, 3.0, None])
    own = mechanisms.prepared(df, ["x"], "numeric", [(0, 3)], uniform=F.lit(0.5))
    assert sorted(r[0] for r in own.collect()) == [0, 1, 1.5, 2, 3]
    assert mechanisms.laplace([1.0, 2.0], 0, 1) == [1, 2]
    assert mechanisms.gaussian([1.0, 2.0], 0, 1, 1) == [1, 2]
    assert mechanisms.evaluate(df, [F.sum("x"), F.max("x")]) == [6, 3]


def test_stability_drops_small_counts(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 3), ("c", 0)], "bin string, count long")
    assert mechanisms.stability_histogram(counts, 1000, 1.0, 1e-9, source=Uniforms.silent()) == [("a", 500.0)]
    with pytest.raises(ValueError, match="privacy risk"):
        mechanisms.stability_histogram(counts, 1000, 1.0, 1e-3)


def test_bootstrap(spark):
    df = spark.createDataFrame([(float(k % 7),) for k in range(400)], "x double").repartition(3)
    with written(mechanisms.placed(df)) as held:
        rows, found = mechanisms.numbered(held)
        assert found == 400 and sorted(r["__row"] for r in rows.collect()) == list(range(400))
        drawn = mechanisms.drawn_rows(rows, 400, 3, 5)
        assert [r[1] for r in drawn.groupBy("__replica").agg(F.sum("__times")).orderBy("__replica").collect()] == [400] * 3
        assert mechanisms.drawn_rows(rows, 400, 2).agg(F.sum("__times")).first()[0] == 800
    (got,) = mechanisms.bootstrap(df, [aggregate.declared_mean(F.col("x"), 400)], 400, 0.0, 1.0, 4, Uniforms.silent(), seed=3)
    assert len(got) == 4 and all(abs(v - 3) < 0.6 for v in got)
    error = mechanisms.bootstrap_error(got, 4, 1.0, 0.0)
    assert error["naive"] == pytest.approx(error["sd"])


def test_bootstrap_draws_from_all_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(50)], "x double")
    for n in (20, 80):
        with pytest.raises(ValueError, match="there are 50 rows"):
            mechanisms.bootstrap(df, [aggregate.declared_mean(F.col("x"), n)], n, 0.0, 1.0, 2, Uniforms.silent(), seed=3)


def test_quantiles_by_brackets(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=3001), np.round(rng.random(2000) * 5), np.ones(500), np.repeat([1.0, 2.0], [400, 600])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        shares = [0.0, 0.025, 0.5, 0.975, 1.0]
        ranks = [0, 7, 399, 400, len(values) // 2, len(values) - 1]
        assert clean.quantiles(df, "x", shares) == pytest.approx(np.quantile(values, shares).tolist())
        assert clean.order_statistics(df, "x", ranks, few=40) == pytest.approx(np.sort(values)[ranks].tolist())
    assert all(math.isnan(v) for v in clean.quantiles(df.where("false"), "x", [0.5]))


def test_stability_noise_on_executors(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 400), ("c", 1), ("d", 0)], "bin string, count long")
    got = dict(mechanisms.stability_histogram(counts, 1000, 1.0, 1e-9))
    assert set(got) == {"a", "b"} and abs(got["a"] - 500) < 80
