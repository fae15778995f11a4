"""Registered queries over the standard tables, and SQL with the same result where SQL can express it.

Noise is off or comes from fixed uniforms here, so that both engines agree; missing values are made from keys.
Floats are rounded, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calibration as cal
from .functions import noise as nz
from .operators import aggregate, clean, mechanisms
from .plans import budget, composition, glm, histograms, specs, trees
from .sources import metadata
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(x, digits) + F.lit(0.0)


#: A key's uniform in SQL, as ``keyed_uniform`` gives it.
U = "((('0x' || substr(md5({key} || '|{seed}'), 1, 8))::UBIGINT + 0.5) / 4294967296)"
LINE_SQL = "(l_orderkey || '-' || l_linenumber)"


def line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber")


def holed() -> Column:
    """Quantities with every seventh order's missing."""
    return F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_quantity"))


HOLED_SQL = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END"


def clamped(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END)"


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


# Bounding and imputing


@register(f"SELECT l_orderkey, l_linenumber, {clamped('l_quantity', 5.0, 40.0)} AS q FROM lineitem")
def clamp_project(spark, sf):
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", clean.clamp(F.col("l_quantity"), 5.0, 40.0).alias("q"))


@register(f"SELECT l_orderkey, l_linenumber, {clamped('q', 5.0, 40.0)} AS q FROM (SELECT *, {HOLED_SQL} AS q FROM lineitem)")
def clamp_null_preserving(spark, sf):
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", clean.clamp(holed(), 5.0, 40.0).alias("q"))


@register(f"SELECT l_orderkey, l_linenumber, {clamped('l_quantity', 5.0, 40.0)} AS l_quantity, {clamped('l_discount', 0.02, 0.07)} AS l_discount FROM lineitem")
def clamp_matrix(spark, sf):
    df = lineitem(spark, sf)
    return df.select("l_orderkey", "l_linenumber", *clean.censor(df, ["l_quantity", "l_discount"], "numeric", [(5.0, 40.0), (0.02, 0.07)], rng_format="list"))


@register(f"SELECT l_orderkey, l_linenumber, round(coalesce({HOLED_SQL}, {U.format(key=LINE_SQL, seed=1)} * 49 + 1), 6) AS q FROM lineitem")
def impute_numeric_fixed_u(spark, sf):
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", r6(clean.impute(holed(), nz.keyed_uniform(line_key(), 1), "numeric", 1, 50)).alias("q"))


@register(f"SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END, CAST(floor({U.format(key='p_partkey', seed=2)} * 50) + 1 AS INTEGER)) AS p_size FROM part")
def impute_integer_fixed_u(spark, sf):
    x = F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_size").cast("int"))
    return table(spark, sf, "part").select("p_partkey", clean.impute(x, nz.keyed_uniform(F.col("p_partkey"), 2), "integer", 1, 50).alias("p_size"))


@register(f"SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END, CAST(floor({U.format(key='doc_id', seed=3)} * 2) AS INTEGER)) AS quality FROM labels")
def impute_logical_fixed_u(spark, sf):
    x = F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("quality").cast("int"))
    return table(spark, sf, "labels").select("doc_id", clean.impute(x, nz.keyed_uniform(F.col("doc_id"), 3), "logical").alias("quality"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
SEGMENTS_SQL = ", ".join(f"'{s}'" for s in SEGMENTS)


@register(f"SELECT c_custkey, CASE WHEN c_mktsegment IN ({SEGMENTS_SQL}) THEN c_mktsegment END AS seg FROM customer")
def category_restrict(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean.restrict(F.col("c_mktsegment"), SEGMENTS).alias("seg"))


@register(f"SELECT c_custkey, CASE WHEN c_mktsegment IN ({SEGMENTS_SQL}) THEN c_mktsegment ELSE list_extract([{SEGMENTS_SQL}], CAST(floor({U.format(key='c_custkey', seed=4)} * 4) + 1 AS INTEGER)) END AS seg FROM customer")
def impute_category_fixed_u(spark, sf):
    x = clean.restrict(F.col("c_mktsegment"), SEGMENTS)
    return table(spark, sf, "customer").select("c_custkey", clean.impute(x, nz.keyed_uniform(F.col("c_custkey"), 4), "character", categories=SEGMENTS).alias("seg"))


@register("SELECT doc_id, CAST(quality = (SELECT max(quality) FROM labels) AS INTEGER) AS quality FROM labels")
def make_logical(spark, sf):
    return clean.make_logical(table(spark, sf, "labels").select("doc_id", "quality"), "quality")


@register("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS \"c_mktsegment_{s}\"" for s in ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM customer")
def make_dummies(spark, sf):
    levels = {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
    return clean.make_dummies(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], levels)


@register("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS norm2, round(abs(l_quantity) + abs(l_discount), 6) AS norm1 FROM lineitem")
def row_norms(spark, sf):
    c = ["l_quantity", "l_discount"]
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", r6(clean.row_norm(c)).alias("norm2"), r6(clean.row_norm(c, 1)).alias("norm1"))


@register("SELECT round(sqrt(sum(l_quantity * l_quantity)), 4) AS l_quantity, round(sqrt(sum(l_discount * l_discount)), 4) AS l_discount FROM lineitem")
def column_norms(spark, sf):
    got = clean.column_norms(lineitem(spark, sf), ["l_quantity", "l_discount"])
    return got.select(*[r6(F.col(c), 4).alias(c) for c in got.columns])


@register("SELECT o_orderkey, round(o_totalprice / (SELECT max(abs(o_totalprice)) FROM orders), 8) AS x FROM orders")
def unit_ball_scale(spark, sf):
    got, _ = clean.unit_ball(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return got.select("o_orderkey", r6(F.col("o_totalprice"), 8).alias("x"))


@register("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.05) FROM customer) AND c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.95) FROM customer)")
def trim_quantiles(spark, sf):
    return clean.trim(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.1)


# Means and variances

N = 60_000
MEAN = dict(mechanism="mechanismLaplace", var_type="numeric", variable="l_quantity", n=N, rng=(5, 40), epsilon=0.1)


def qlap(u: float, b: str) -> str:
    return f"(({b}) * ln({2 * u}))" if u < 0.5 else f"(-({b}) * ln({2 - 2 * u}))"


@register(f"SELECT round(avg({clamped('l_quantity', 5, 40)}), 6) AS mean FROM lineitem")
def true_mean_clamped(spark, sf):
    return specs.MeanSpec(**MEAN).true(lineitem(spark, sf)).select(r6(F.col("mean")).alias("mean"))




@register(f"""
    SELECT 'l_quantity' AS variable, round(m + {qlap(0.3, f'35.0 / {N} / 0.1')}, 6) AS release, round(ln(20) * 35.0 / {N} / 0.1, 8) AS accuracy, 0.1::DOUBLE AS epsilon,
           round(m + {qlap(0.3, f'35.0 / {N} / 0.1')} - ln(20) * 35.0 / {N} / 0.1, 6) AS lower, round(m + {qlap(0.3, f'35.0 / {N} / 0.1')} + ln(20) * 35.0 / {N} / 0.1, 6) AS upper
    FROM (SELECT avg(coalesce({clamped('q', 5, 40)}, {U.format(key=LINE_SQL, seed=5)} * 35 + 5)) AS m FROM (SELECT *, {HOLED_SQL} AS q FROM lineitem))
""")
def mean_release_fixed_u(spark, sf):
    df = lineitem(spark, sf).select("l_orderkey", "l_linenumber", holed().alias("l_quantity"))
    got = specs.release_frame(df, specs.MeanSpec(**MEAN).release(df, nz.Uniforms(fixed=[0.3]), nz.keyed_uniform(line_key(), 5)))
    return got.select("variable", "epsilon", r6(F.col("accuracy"), 8).alias("accuracy"), *[r6(F.col(c)).alias(c) for c in ("release", "lower", "upper")])


@register("""
    SELECT round(m, 8) AS mean, round(sqrt(m * (1 - m)), 8) AS std_dev, CASE WHEN m < 0.5 THEN 0 ELSE 1 END AS median,
           CAST(n - round_even(m * n, 0) AS BIGINT) AS zeros, CAST(round_even(m * n, 0) AS BIGINT) AS ones
    FROM (SELECT avg(quality) AS m, count(*) AS n FROM labels)
""")
def mean_logical_post(spark, sf):
    """The size of the table is public here."""
    df = table(spark, sf, "labels")
    spec = specs.MeanSpec("mechanismLaplace", "logical", "quality", df.count(), epsilon=1.0)
    got = spec.release(df, nz.Uniforms.silent(), nz.keyed_uniform(F.lit("x"), 1))
    row = (got["release"], got["std_dev"], got["median"], got["histogram"][0], got["histogram"][1])
    made = spark.createDataFrame([row], "mean double, std_dev double, median int, zeros long, ones long")
    return made.withColumns({c: r6(F.col(c), 8) for c in ("mean", "std_dev")})


@register(f"SELECT round(var_samp({clamped('o_totalprice', 10000, 400000)}), 2) AS variance FROM orders")
def true_variance_clamped(spark, sf):
    spec = specs.VarianceSpec("mechanismLaplace", "numeric", "o_totalprice", 15000, (10000, 400000), epsilon=0.5)
    return spec.true(table(spark, sf, "orders")).select(r6(F.col("variance"), 2).alias("variance"))


@register(f"""
    SELECT round(x, 4) AS release, round(CASE WHEN x >= 0 THEN sqrt(x) END, 4) AS std_dev
    FROM (SELECT var_samp(l_discount * 100) + {qlap(0.8, f'100.0 / {N} / 0.5')} AS x FROM lineitem)
""")
def variance_release_fixed_u(spark, sf):
    spec = specs.VarianceSpec("mechanismLaplace", "numeric", "x", N, (0, 10), epsilon=0.5)
    df = lineitem(spark, sf).select((F.col("l_discount") * 100).alias("x"))
    got = spec.release(df, nz.Uniforms(fixed=[0.8]), nz.keyed_uniform(F.lit("x"), 1))
    made = spark.createDataFrame([(got["release"], got["std_dev"])], "release double, std_dev double")
    return made.select(r6(F.col("release"), 4).alias("release"), r6(F.col("std_dev"), 4).alias("std_dev"))


@register("SELECT round(avg(l_quantity), 6) AS mean_quantity, round(var_samp(l_discount), 8) AS var_discount, round(avg(l_tax), 8) AS mean_tax FROM lineitem")
def fused_releases(spark, sf):
    """Several statistics in one pass over the table."""
    chosen = [
        specs.MeanSpec("mechanismLaplace", "numeric", "l_quantity", N, (1, 50), epsilon=1.0),
        specs.VarianceSpec("mechanismLaplace", "numeric", "l_discount", N, (0, 1), epsilon=1.0),
        specs.MeanSpec("mechanismLaplace", "numeric", "l_tax", N, (0, 1), epsilon=1.0),
    ]
    values = specs.fused(lineitem(spark, sf), chosen, nz.keyed_uniform(line_key(), 6))
    return spark.createDataFrame([tuple(values)], "a double, b double, c double").select(r6(F.col("a")).alias("mean_quantity"), r6(F.col("b"), 8).alias("var_discount"), r6(F.col("c"), 8).alias("mean_tax"))


@register()
def mean_release_secure(spark, sf):
    """With secure noise; the values differ from run to run."""
    df = lineitem(spark, sf)
    return specs.release_frame(df, specs.MeanSpec("mechanismLaplace", "numeric", "l_quantity", N, (1, 50), epsilon=0.1).release(df))


@register()
def mean_bootstrap(spark, sf):
    """Over all rows at each scale; the size of the table is public here."""
    df = table(spark, sf, "part")
    spec = specs.MeanSpec("mechanismBootstrap", "integer", "p_size", df.count(), (1, 50), epsilon=1.0, n_boot=5)
    got = spec.release(df, nz.Uniforms(seed=3), seed=3)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(got["release"])], "replica int, release double")


@register("""
    SELECT times, round(sum(l_quantity * 1.0) / 60000, 6) AS value, count(*) AS n_rows
    FROM (SELECT *, ((l_orderkey + l_linenumber) % 4) AS times FROM lineitem) WHERE times > 0 GROUP BY times
""")
def bootstrap_partition_sum(spark, sf):
    drawn = lineitem(spark, sf).withColumn("__times", (F.col("l_orderkey") + F.col("l_linenumber")) % 4).where("__times > 0").withColumn("__replica", F.lit(0))
    pieces = mechanisms.bootstrap_pieces(drawn, F.struct(aggregate.declared_mean(F.col("l_quantity"), N).alias("v"), F.count("*").alias("n")))
    return pieces.select("times", r6(F.col("value.v")).alias("value"), F.col("value.n").alias("n_rows"))


# Histograms

P_BREAKS = [1 + 49 * k / 10 for k in range(11)]
E_BREAKS = [0, 50, 100, 200, 500]


def bins_sql(source: str, x: str, breaks: list[float]) -> str:
    labels = aggregate.bin_labels(breaks)
    cases = " ".join(f"WHEN x <= {b!r} THEN {i}" for i, b in enumerate(breaks[1:]))
    values = ", ".join(f"({i}, '{s}')" for i, s in enumerate(labels))
    return f"SELECT b.bin AS bin, b.label AS label, coalesce(c.n, 0) AS count FROM (VALUES {values}) b(bin, label) LEFT JOIN (SELECT CASE WHEN x < {breaks[0]!r} OR x > {breaks[-1]!r} THEN NULL {cases} END AS bin, count(*) AS n FROM (SELECT {x} AS x FROM {source}) GROUP BY 1) c ON c.bin = b.bin"


def _numeric_histogram(spark, sf, name, column, var_type, **more):
    df = table(spark, sf, name)
    return specs.HistogramSpec(var_type, column, 10_000, epsilon=1.0, **more).true(df, nz.keyed_uniform(F.lit("x"), 1))


@register(bins_sql("part", "p_size", P_BREAKS))
def hist_numeric_right_closed(spark, sf):
    return _numeric_histogram(spark, sf, "part", "p_size", "integer", rng=(1, 50), n_bins=10)


@register(bins_sql("events", clamped("value", 0, 500), E_BREAKS))
def hist_user_bins(spark, sf):
    return _numeric_histogram(spark, sf, "events", "value", "numeric", bins=E_BREAKS)


@register(bins_sql("events", clamped("value", 0, 400), [0 + 400 * k / 20 for k in range(21)]))
def hist_granularity(spark, sf):
    return _numeric_histogram(spark, sf, "events", "value", "numeric", rng=(0, 400), granularity=500)


@register(bins_sql("orders", clamped("o_totalprice", 0, 1000000), [0 + 1000000 * k / 8 for k in range(9)]))
def hist_zero_bins(spark, sf):
    return _numeric_histogram(spark, sf, "orders", "o_totalprice", "numeric", rng=(0, 1_000_000), n_bins=8)


ALL_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("SELECT c_mktsegment AS bin, count(*) AS count FROM customer GROUP BY 1")
def hist_categorical(spark, sf):
    return specs.HistogramSpec("character", "c_mktsegment", 1500, epsilon=1.0, bins=ALL_SEGMENTS).true(table(spark, sf, "customer"))


@register("SELECT CAST(v AS VARCHAR) AS bin, coalesce(n, 0) AS count FROM (VALUES (0), (1)) t(v) LEFT JOIN (SELECT quality, count(*) AS n FROM labels GROUP BY 1) c ON c.quality = t.v")
def hist_logical_2bin(spark, sf):
    return specs.HistogramSpec("logical", "quality", 400, epsilon=1.0, impute=True).true(table(spark, sf, "labels"), nz.keyed_uniform(F.lit("x"), 1))


def _holed_quality() -> Column:
    return F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("quality").cast("int")).alias("quality")


@register("SELECT v AS bin, coalesce(n, 0) AS count FROM (VALUES ('0'), ('1'), ('NA')) t(v) LEFT JOIN (SELECT coalesce(CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS VARCHAR), 'NA') AS q, count(*) AS n FROM labels GROUP BY 1) c ON c.q = t.v")
def hist_logical_3bin(spark, sf):
    return specs.HistogramSpec("logical", "quality", 400, epsilon=1.0).true(table(spark, sf, "labels").select(_holed_quality()))


def _segments(spark, sf) -> tuple[list[str], list[float]]:
    rows = sorted((r["bin"], float(r["count"])) for r in hist_categorical(spark, sf).collect())
    return [b for b, _ in rows], [c for _, c in rows]


_SEG = "(SELECT c_mktsegment AS bin, count(*) AS c FROM customer GROUP BY 1)"


@register(f"SELECT bin, round(least(greatest(c, 0), 1200) * 1200.0 / sum(least(greatest(c, 0), 1200)) OVER (), 6) AS value FROM {_SEG}")
def hist_normalised(spark, sf):
    bins, counts = _segments(spark, sf)
    return spark.createDataFrame([(b, round(x, 6)) for b, x in zip(bins, histograms.normalize(counts, 1200))], "bin string, value double")


@register(f"SELECT bin, round(CASE WHEN c = 0 THEN 0 ELSE greatest(0, c - ln(20) * 2 / 0.1) END, 6) AS lower, round(CASE WHEN c = 0 THEN ln(20) * 2 / 0.1 ELSE c + ln(20) * 2 / 0.1 END, 6) AS upper FROM {_SEG}")
def hist_ci(spark, sf):
    bins, counts = _segments(spark, sf)
    rows = [(b, round(low, 6), round(high, 6)) for b, (low, high) in zip(bins, histograms.intervals(counts, cal.laplace_accuracy(2, 0.1)))]
    return spark.createDataFrame(rows, "bin string, lower double, upper double")


@register(f"SELECT round(sum(power(c / 1500.0, 2)), 8) AS herfindahl FROM {_SEG}")
def hist_herfindahl(spark, sf):
    return spark.createDataFrame([(round(histograms.herfindahl(_segments(spark, sf)[1], 1500), 8),)], "herfindahl double")


@register("SELECT round(m, 8) AS mean, CASE WHEN m < 0.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS median, round(m * (1 - m), 8) AS variance, round(sqrt(m * (1 - m)), 8) AS std_dev FROM (SELECT avg(quality) AS m FROM labels WHERE doc_id % 3 <> 0)")
def hist_moments(spark, sf):
    held = {r["bin"]: float(r["count"]) for r in hist_logical_3bin(spark, sf).collect()}
    m = histograms.logical_moments(held["0"], held["1"])
    return spark.createDataFrame([(round(m["mean"], 8), m["median"], round(m["variance"], 8), round(m["std_dev"], 8))], "mean double, median double, variance double, std_dev double")


def _stability(spark, sf, name, column, n, delta, epsilon):
    counts = specs.HistogramSpec("character", column, n, epsilon=epsilon, delta=delta).true(table(spark, sf, name))
    kept = mechanisms.stability_histogram(counts, n, epsilon, delta, source=nz.Uniforms(fixed=[0.4]))
    return spark.createDataFrame([(b, round(x, 6)) for b, x in kept], "bin string, value double")


@register(f"SELECT bin, round(v, 6) AS value FROM (SELECT o_orderpriority AS bin, count(*) + {qlap(0.4, '2 / 0.5')} AS v FROM orders GROUP BY 1) WHERE v > 1 + 2 * ln(2 / 1e-12) / 0.5")
def hist_stability_threshold(spark, sf):
    return _stability(spark, sf, "orders", "o_orderpriority", 15_000, 1e-12, 0.5)


@register(f"SELECT bin, round(v, 6) AS value FROM (SELECT lang AS bin, count(*) + {qlap(0.4, '2 / 0.5')} AS v FROM documents GROUP BY 1) WHERE v > 1 + 2 * ln(2 / 1e-12) / 0.5")
def hist_stability_languages(spark, sf):
    return _stability(spark, sf, "documents", "lang", 1000, 1e-12, 0.5)


@register("SELECT source AS bin, count(*) AS count FROM documents GROUP BY 1")
def hist_stability_true(spark, sf):
    return specs.HistogramSpec("character", "source", 1000, epsilon=1.0, delta=1e-12).true(table(spark, sf, "documents"))


# Covariance and regression

COLS = ["l_quantity", "l_discount", "l_tax"]
RNGS = [(1, 50), (0, 0.1), (0, 0.08)]
_COV = [(a, b) for a, b in aggregate.lower_triangle(COLS)]


def _cov_spec(**more):
    return specs.CovarianceSpec("mechanismLaplace", "numeric", N, COLS, RNGS, **({"epsilon": [1.0] * 6} | more))


@register("SELECT " + ", ".join(f"round(covar_samp({a}, {b}), 8) AS cov_{a}_{b}" for a, b in _COV) + " FROM lineitem")
def cov_lower_triangle(spark, sf):
    got = _cov_spec().true(lineitem(spark, sf), nz.keyed_uniform(F.lit("x"), 1))
    return got.select(*[r6(F.col(c), 8).alias(c) for c in got.columns])


@register(" UNION ALL ".join(f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(covar_samp({a}, {b}) + {qlap(0.35, f'2.0 / {N} * {RNGS[COLS.index(a)][1] - RNGS[COLS.index(a)][0]} * {RNGS[COLS.index(b)][1] - RNGS[COLS.index(b)][0]}')}, 8) AS value FROM lineitem" for a, b in _COV))
def cov_release_fixed_u(spark, sf):
    got = _cov_spec().release(lineitem(spark, sf), nz.Uniforms(fixed=[0.35]), nz.keyed_uniform(F.lit("x"), 1))
    m = got["matrix"]
    return spark.createDataFrame([(a, b, round(float(m[COLS.index(a), COLS.index(b)]), 8)) for a, b in _COV], "row_name string, col_name string, value double")


@register(" UNION ALL ".join(f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(2.0 / {N} * {RNGS[COLS.index(a)][1] - RNGS[COLS.index(a)][0]} * {RNGS[COLS.index(b)][1] - RNGS[COLS.index(b)][0]}, 12) AS sens" for a, b in _COV))
def cov_sensitivity(spark, sf):
    return spark.createDataFrame([(a, b, round(s, 12)) for (a, b), s in zip(_COV, cal.covariance_sensitivity(N, RNGS))], "row_name string, col_name string, sens double")


def _regression(spark, sf, formula: str) -> DataFrame:
    cols, rngs = ["l_extendedprice", "l_quantity", "l_tax"], [(0, 200000), (1, 50), (0, 0.08)]
    spec = specs.CovarianceSpec("mechanismLaplace", "numeric", N, cols, rngs, epsilon=[1.0] * 6, formula=formula)
    (got,) = spec.release(lineitem(spark, sf), nz.Uniforms.silent(), nz.keyed_uniform(F.lit("x"), 1))["regression"]
    return spark.createDataFrame([(x, round(e, 3)) for x, (e, _) in got.items()], "term string, estimate double")


@register("SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 3) AS estimate FROM lineitem")
def regression_one_x(spark, sf):
    return _regression(spark, sf, "l_extendedprice ~ l_quantity")


@register("""
    SELECT unnest(['l_quantity', 'l_tax']) AS term, unnest([round((s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12), 3), round((s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12), 3)]) AS estimate
    FROM (SELECT var_samp(l_quantity) AS s11, var_samp(l_tax) AS s22, covar_samp(l_quantity, l_tax) AS s12, covar_samp(l_quantity, l_extendedprice) AS s1y, covar_samp(l_tax, l_extendedprice) AS s2y FROM lineitem)
""")
def regression_two_x(spark, sf):
    return _regression(spark, sf, "l_extendedprice ~ l_quantity + l_tax")


@register("""
    SELECT 'l_quantity' AS term, round(sqrt((syy - sxy * sxy / sxx) / 60000 / sxx), 8) AS std_error
    FROM (SELECT var_samp(l_extendedprice) AS syy, var_samp(l_quantity) AS sxx, covar_samp(l_quantity, l_extendedprice) AS sxy FROM lineitem)
""")
def regression_error(spark, sf):
    cols, rngs = ["l_extendedprice", "l_quantity"], [(0, 200000), (1, 50)]
    spec = specs.CovarianceSpec("mechanismLaplace", "numeric", N, cols, rngs, epsilon=[1.0] * 3, formula="l_extendedprice ~ l_quantity")
    (got,) = spec.release(lineitem(spark, sf), nz.Uniforms.silent(), nz.keyed_uniform(F.lit("x"), 1))["regression"]
    return spark.createDataFrame([(x, round(e, 8)) for x, (_, e) in got.items()], "term string, std_error double")


_HOLED_SUM = f"SELECT sum(coalesce({clamped('q', 5, 40)}, {U.format(key=LINE_SQL, seed=7)} * 35 + 5)) AS s FROM (SELECT *, {HOLED_SQL} AS q FROM lineitem)"


def _evaluated(spark, sf, mechanism: str) -> DataFrame:
    """A statistic of the caller's own, with missing values, through bounding, imputing, aggregating and noise."""
    df = lineitem(spark, sf).select("l_orderkey", "l_linenumber", holed().alias("l_quantity"))
    (value,) = mechanisms.released(df, ["l_quantity"], "numeric", [(5, 40)], [F.sum("l_quantity")], 35.0, 0.5, 1e-6, mechanism, source=nz.Uniforms(fixed=[0.2]), uniform=nz.keyed_uniform(line_key(), 7))
    return spark.createDataFrame([(round(value, 4),)], "release double")


@register(f"SELECT round(s + {qlap(0.2, '35 / 0.5')}, 4) AS release FROM ({_HOLED_SUM})")
def laplace_evaluate(spark, sf):
    return _evaluated(spark, sf, "mechanismLaplace")


@register(f"SELECT round(s - 0.8416212335729143 * 35 * sqrt(2 * ln(1.25 / 1e-6)) / 0.5, 4) AS release FROM ({_HOLED_SUM})")
def gaussian_evaluate(spark, sf):
    return _evaluated(spark, sf, "mechanismGaussian")


# Trees

_TREE = """WITH leaf AS (SELECT p_size - 1 + 64 AS i FROM part), node AS (SELECT i >> k AS node, count(*) AS c FROM leaf, range(1, 7) t(k) GROUP BY 1),
    nodes AS (SELECT r.node AS node, coalesce(n.c, 0) AS c FROM range(1, 64) r(node) LEFT JOIN node n ON n.node = r.node),
    cdf AS (SELECT least(1 + 2.0 * (node - 31), 50) AS val, CAST(sum(c) OVER (ORDER BY node) AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE) AS share FROM nodes WHERE node >= 32
            UNION ALL SELECT 1.0, 0.0) """


def _tree(spark, sf) -> DataFrame:
    spec = specs.TreeSpec("p_size", 2000, (1, 50), 1, "integer", epsilon=1.0)
    return spec.true(table(spark, sf, "part"), nz.keyed_uniform(F.lit("x"), 1))


def _cdf(spark, sf) -> list[tuple[float, float]]:
    """The distribution at the terminal nodes' edges. There are as many rows as nodes of one level."""
    rows = sorted((r["node"], float(r["count"])) for r in _tree(spark, sf).where("node >= 32").collect())
    return trees.cdf([c for _, c in rows], 1, 50, 1)


@register(_TREE + "SELECT node, c AS count FROM nodes")
def tree_nodes(spark, sf):
    return _tree(spark, sf)


@register(_TREE + "SELECT CAST(val AS DOUBLE) AS val, round(share, 8) AS share FROM cdf")
def tree_cdf(spark, sf):
    return spark.createDataFrame([(x, round(p, 8)) for x, p in _cdf(spark, sf)], "val double, share double")


@register(_TREE + "SELECT round(sum(d * val), 6) AS mean FROM (SELECT val, share - lag(share, 1, 0.0) OVER (ORDER BY val, share) AS d FROM cdf)")
def tree_mean(spark, sf):
    return spark.createDataFrame([(round(trees.mean(_cdf(spark, sf)), 6),)], "mean double")


@register(_TREE + "SELECT CAST(p AS DOUBLE) AS p, round(avg(val), 6) AS value FROM (SELECT p, val, rank() OVER (PARTITION BY p ORDER BY abs(p - share)) AS r FROM cdf, (VALUES (0.1), (0.25), (0.5), (0.9)) q(p)) WHERE r = 1 GROUP BY p")
def tree_percentiles(spark, sf):
    ps = [0.1, 0.25, 0.5, 0.9]
    return spark.createDataFrame([(p, round(x, 6)) for p, x in zip(ps, trees.percentiles(_cdf(spark, sf), ps))], "p double, value double")


def _efficient_sql() -> str:
    """Both sweeps level by level. All nodes of a level have equal weights: a node's own estimate of variance v beside one of variance u has u / (u + v)."""
    own, steps, below, above = 1.0, [], {5: 1.0}, {0: 0.0}
    for k in range(4, 0, -1):
        w = 2 * below[k + 1] / (own + 2 * below[k + 1])
        below[k] = own * w
        steps.append(f"u{k} AS (SELECT n.node, {w!r} * n.x + {1 - w!r} * sum(c.x) AS x FROM noisy n JOIN u{k + 1} c ON c.node // 2 = n.node GROUP BY n.node, n.x)")
    steps.append("below AS (SELECT node, greatest(x, 0) AS x FROM (" + " UNION ALL ".join(f"SELECT * FROM u{k}" for k in range(1, 6)) + "))")
    for k in range(1, 6):
        u = above[k - 1] + below[k]
        w = u / (own + u)
        above[k] = own * w
        steps.append(f"d{k} AS (SELECT n.node, {w!r} * n.x + {1 - w!r} * (p.x - s.x) AS x FROM noisy n JOIN d{k - 1} p ON p.node = n.node // 2 JOIN below s ON s.node = xor(n.node, 1))")
    steps.append("above AS (SELECT node, greatest(x, 0) AS x FROM (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(6)) + "))")
    for k in range(1, 6):
        u = above[k - 1] + below[k]
        w = u / (below[k] + u)
        steps.append(f"e{k} AS (SELECT b.node, {w!r} * b.x + {1 - w!r} * (p.x - s.x) AS x FROM below b JOIN above p ON p.node = b.node // 2 JOIN below s ON s.node = xor(b.node, 1) WHERE b.node BETWEEN {1 << k} AND {(2 << k) - 1})")
    every = " UNION ALL ".join(["SELECT 1 AS node, 2000.0 AS x", *(f"SELECT * FROM e{k}" for k in range(1, 6))])
    return (
        _TREE.rstrip()
        + f", noisy AS (SELECT node, greatest(round_even(c + 2 * log2(50) * ln(0.8), 0), 0)::DOUBLE AS x FROM nodes), u5 AS (SELECT * FROM noisy WHERE node >= 32), d0 AS (SELECT 1 AS node, 2000.0::DOUBLE AS x), {', '.join(steps)} "
        + f"SELECT CAST(n.node AS INTEGER) AS node, n.x AS noisy, round_even(greatest(e.x, 0), 0)::DOUBLE AS efficient FROM noisy n JOIN ({every}) e ON e.node = n.node"
    )


@register(_efficient_sql())
def tree_efficient(spark, sf):
    spec = specs.TreeSpec("p_size", 2000, (1, 50), 1, "integer", epsilon=1.0, percentiles=(0.25, 0.75))
    got = spec.release(table(spark, sf, "part"), nz.Uniforms(fixed=[0.4]), nz.keyed_uniform(F.lit("x"), 1))
    return spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(got["release"], got["efficient"]))], "node int, noisy double, efficient double")


# Scalar functions over grids

_UB = "(VALUES (0.05, 1.0), (0.2, 0.5), (0.4, 3.0), (0.7, 5.0), (0.99, 2.0)) t(p, b)"


def _grid(spark, rows, schema):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], schema)


_UB_ROWS = [(0.05, 1), (0.2, 0.5), (0.4, 3), (0.7, 5), (0.99, 2)]


@register(f"SELECT p::DOUBLE AS p, b::DOUBLE AS b, round(CASE WHEN p < 0.5 THEN b * ln(2 * p::DOUBLE) ELSE -b * ln(2 - 2 * p::DOUBLE) END, 8) AS q FROM {_UB}")
def qlap_grid(spark, sf):
    return _grid(spark, _UB_ROWS, "p double, b double").select("p", "b", r6(nz.laplace_quantile(F.col("p"), 0.0, F.col("b")), 8).alias("q"))


_XB = "(VALUES (-3.0, 1.0), (-0.2, 0.5), (0.4, 3.0), (2.7, 5.0)) t(x, b)"
_XB_ROWS = [(-3, 1), (-0.2, 0.5), (0.4, 3), (2.7, 5)]


@register(f"SELECT x::DOUBLE AS x, b::DOUBLE AS b, round(0.5 + 0.5 * (CASE WHEN x < 0 THEN -1 ELSE 1 END) * (1 - exp(-abs(x) / b)), 8) AS p FROM {_XB}")
def plap_grid(spark, sf):
    return _grid(spark, _XB_ROWS, "x double, b double").select("x", "b", r6(nz.laplace_cdf(F.col("x"), 0.0, F.col("b")), 8).alias("p"))


@register(f"SELECT x::DOUBLE AS x, b::DOUBLE AS b, round(exp(-abs(x) / b) / (2 * b), 8) AS d FROM {_XB}")
def dlap_grid(spark, sf):
    return _grid(spark, _XB_ROWS, "x double, b double").select("x", "b", r6(nz.laplace_density(F.col("x"), 0.0, F.col("b")), 8).alias("d"))


_SE = "(VALUES (0.1, 0.2), (0.5, 2.0), (1.0, 1.0), (2.0, 0.01)) t(e, s)"
_SE_ROWS = [(0.1, 0.2), (0.5, 2), (1, 1), (2, 0.01)]


@register(f"SELECT e::DOUBLE AS e, s::DOUBLE AS s, round(ln(20) * s / e, 8) AS laplace, round(s / e * ln(2 / (0.05 * 1e-6)) + 1, 8) AS stability, round(ln(20) / (1000 * e), 8) AS glm, round(2 * sqrt(2) / e * sqrt(ln(40)) * power(log2(50), 1.5), 6) AS tree FROM {_SE}")
def accuracy_grid(spark, sf):
    e, s = F.col("e"), F.col("s")
    return _grid(spark, _SE_ROWS, "e double, s double").select("e", "s", r6(cal.laplace_accuracy(s, e), 8).alias("laplace"), r6(cal.stability_accuracy(s, e, 1e-6), 8).alias("stability"), r6(cal.glm_accuracy(e, 1000), 8).alias("glm"), r6(cal.tree_accuracy(e, 1, 50, 1)).alias("tree"))


@register(f"SELECT e::DOUBLE AS a, s::DOUBLE AS s, round(ln(20) * s / e, 8) AS laplace, round(s * ln(2 / (0.05 * 1e-6)) / (e + 1 - 1), 6) AS stability, round(ln(20) / (1000 * e), 8) AS glm, round(2 * sqrt(2) / e * sqrt(ln(40)) * power(log2(50), 1.5), 6) AS tree FROM {_SE}")
def epsilon_grid(spark, sf):
    a, s = F.col("a"), F.col("s")
    return _grid(spark, _SE_ROWS, "a double, s double").select("a", "s", r6(cal.laplace_epsilon(s, a), 8).alias("laplace"), r6(cal.stability_epsilon(s, a + 1, 1e-6)).alias("stability"), r6(cal.glm_epsilon(a, 1000), 8).alias("glm"), r6(cal.tree_epsilon(a, 1, 50, 1)).alias("tree"))


@register(f"SELECT e::DOUBLE AS e, s::DOUBLE AS s, round((50 - 1) / (e * 1000), 8) AS mean, round(49 * 49 / (e * 1000), 8) AS variance, round(2 * log2(49 / e + 1), 8) AS tree FROM {_SE}")
def sensitivity_grid(spark, sf):
    e = F.col("e")
    return _grid(spark, _SE_ROWS, "e double, s double").select("e", "s", r6(cal.mean_sensitivity(1.0, 50.0, e * 1000), 8).alias("mean"), r6(cal.variance_sensitivity(e * 1000, F.lit(1.0), F.lit(50.0)), 8).alias("variance"), r6(cal.tree_sensitivity(F.lit(1.0), F.lit(50.0), e), 8).alias("tree"))


@register(f"SELECT e::DOUBLE AS e, s::DOUBLE AS s, round(s * sqrt(2 * ln(1.25 / 1e-5)) / e, 8) AS sd FROM {_SE}")
def gaussian_scale(spark, sf):
    return _grid(spark, _SE_ROWS, "e double, s double").select("e", "s", r6(cal.gaussian_scale(F.col("s"), F.col("e"), F.lit(1e-5)), 8).alias("sd"))


LEDGER_ROWS = [("mean", 0.1, 1e-8, False), ("variance", 0.2, 1e-8, False), ("histogram", 0.3, 2e-8, True)]
_LEDGER = "(VALUES (0.1::DOUBLE, 1e-8), (0.2, 1e-8), (0.3, 2e-8)) t(e, d)"


@register(f"SELECT round(sum(e), 8) AS epsilon, round(sum(d), 12) AS delta FROM {_LEDGER}")
def budget_basic(spark, sf):
    got = budget.Ledger(spark, 1.0, 1e-6, LEDGER_ROWS).totals()
    return got.select(r6(F.col("epsilon"), 8).alias("epsilon"), r6(F.col("delta"), 12).alias("delta"))


@register(f"""
    SELECT round(least(total, drift + sqrt(2 * sq * ln(exp(1) + sqrt(sq) / slack)), drift + sqrt(2 * sq * ln(1 / slack))), 8) AS epsilon
    FROM (SELECT sum(e) AS total, sum(e * e) AS sq, sum((exp(e) - 1) * e / (exp(e) + 1)) AS drift, 1 - (1 - 1e-6) / exp(sum(ln(1 - d))) AS slack FROM {_LEDGER})
""")
def kov_het_ledger(spark, sf):
    return budget.Ledger(spark, 1.0, 1e-6, LEDGER_ROWS).frame().agg(r6(budget.upper_bound_column(1e-6), 8).alias("epsilon"))


def _pascal(k: int) -> list[int]:
    row = [1]
    for i in range(k):
        row.append(row[-1] * (k - i) // (i + 1))
    return row


_KOV = [(k, e) for k in (2, 5, 10, 30) for e in (0.05, 0.2)]


@register(f"""
    WITH RECURSIVE c AS (SELECT * FROM (VALUES {", ".join(f"({k}, {e}::DOUBLE, {i}, {x}::DOUBLE)" for k, e in _KOV for i, x in enumerate(_pascal(k)))}) t(k, e, i, n)),
    h AS (
        SELECT k, e, 0 AS step, 0.0::DOUBLE AS low, k * e AS high FROM c GROUP BY k, e
        UNION ALL
        SELECT h.k, h.e, h.step + 1, CASE WHEN s.good THEN h.low ELSE (h.low + h.high) / 2 END, CASE WHEN s.good THEN (h.low + h.high) / 2 ELSE h.high END
        FROM h, LATERAL (
            SELECT coalesce(sum(c.n * greatest(exp(c.i * h.e) - exp((h.low + h.high) / 2 + (h.k - c.i) * h.e), 0)), 0) <= power(1 + exp(h.e), h.k) * (1 - (1 - 1e-6) / power(1 - 1e-9, h.k)) AS good
            FROM c WHERE c.k = h.k AND c.e = h.e
        ) s WHERE h.step < 50
    )
    SELECT k, e AS epsilon, round(high, 6) AS total FROM h WHERE step = 50
""")
def kov_hom(spark, sf):
    rows = [(k, e, round(composition.optimal_homogeneous([(e, 1e-9)] * k, 1e-6), 6)) for k, e in _KOV]
    return spark.createDataFrame(rows, "k int, epsilon double, total double")


@register(f"""
    WITH p AS (SELECT row_number() OVER () AS i, e, d FROM {_LEDGER}),
    g AS (SELECT unnest([1e-7::DOUBLE, 1e-6, 1e-4]) AS delta),
    b AS (SELECT 0.01 / (count(*) + sum(e) + 1) AS beta FROM p),
    a AS (SELECT i, ceil(e * (1 / beta + 1)) AS a, ln(1 + beta) AS u FROM p, b),
    subsets AS (SELECT m, sum(CASE WHEN (m >> (i - 1)::INTEGER) & 1 = 1 THEN a ELSE 0 END) AS size FROM a, range(0, 8) r(m) GROUP BY m),
    facts AS (
        SELECT delta, least(total, drift + sqrt(2 * sq * ln(exp(1) + sqrt(sq) / slack)), drift + sqrt(2 * sq * ln(1 / slack))) AS bound, slack
        FROM (SELECT delta, sum(e) AS total, sum(e * e) AS sq, sum((exp(e) - 1) * e / (exp(e) + 1)) AS drift, 1 - (1 - delta) / exp(sum(ln(1 - d))) AS slack FROM p, g GROUP BY delta)
    ),
    guess AS (
        SELECT f.delta, k, (SELECT max(u) FROM a) AS u FROM facts f, range(0, 5000) r(k) WHERE (
            SELECT coalesce(sum(exp(-size * u) - exp((k - total) * u + size * u)), 0) <= (SELECT exp(sum(ln(1 + exp(-a * u)))) FROM a) * f.slack
            FROM subsets, (SELECT sum(a) AS total, max(u) AS u FROM a) t WHERE size <= floor((total - k) / 2)
        )
    )
    SELECT f.delta, round((SELECT least(min(k), ceil(f.bound / max(u))) * max(u) FROM guess WHERE guess.delta = f.delta), 8) AS approximate, round(f.bound, 8) AS bound FROM facts f
""")
def approx_comp(spark, sf):
    params = [(e, d) for _, e, d, _ in LEDGER_ROWS]
    rows = [(g, round(composition.approximate(params, g), 8), round(composition.upper_bound(params, g), 8)) for g in (1e-7, 1e-6, 1e-4)]
    return spark.createDataFrame(rows, "delta double, approximate double, bound double")


_NEW = {"all_unset": (1 / 3, 1 / 3, 1 / 3), "one_unset": (1 / 3, 1 / 3, 1 / 3), "held": (0.1, 0.45, 0.45)}


@register("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {i}, {round(e, 8)}::DOUBLE, 1e-9::DOUBLE)" for name, own in _NEW.items() for i, e in enumerate(own)) + ") t(name, stat, epsilon, delta)")
def update_parameters(spark, sf):
    """In SQL the values that enumerating all subsets of releases gives."""
    cases = {"all_unset": ([(None, 1e-9)] * 3, []), "one_unset": ([(0.2, 1e-9), (0.2, 1e-9), (None, 1e-9)], []), "held": ([(0.1, 1e-9), (0.3, 1e-9), (0.3, 1e-9)], [0])}
    rows = [(name, i, round(e, 8), d) for name, (params, hold) in cases.items() for i, (e, d) in enumerate(budget.update_parameters(params, hold, 1.0, 1e-6))]
    return spark.createDataFrame(rows, "name string, stat int, epsilon double, delta double")


# Models and documents


def _glm(spark, sf, objective: str, formula: str, rng, digits: int = 6) -> DataFrame:
    df = lineitem(spark, sf).select("l_orderkey", "l_quantity", "l_discount", (F.col("l_quantity") > 25).cast("double").alias("large"))
    spec = glm.GlmSpec(formula, objective, N, rng, epsilon=1.0)
    got = spec.release(df, nz.Uniforms.silent(), nz.keyed_uniform(F.lit("x"), 1))
    return spark.createDataFrame([(k, round(float(x), digits)) for k, x in got["coefficients"].items()], "term string, estimate double")


def _newton_sql(y: str, first: str, second: str, ridge: float, more: str = "", digits: int = 6) -> str:
    """Newton's method over the few distinct pairs of y and x, x over its largest value; ``z`` is the linear predictor."""
    return f"""
        WITH RECURSIVE m AS (SELECT max(abs(l_discount)) AS m FROM lineitem),
        d AS (SELECT {y} AS y, l_discount / (SELECT m FROM m) AS x, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL),
        it AS (
            SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
            UNION ALL
            SELECT it.k + 1, it.a + (s.f0 * s.h11 - s.f1 * s.h01) / (s.h00 * s.h11 - s.h01 * s.h01), it.b + (s.f1 * s.h00 - s.f0 * s.h01) / (s.h00 * s.h11 - s.h01 * s.h01)
            FROM it, LATERAL (
                SELECT sum(w * {first}) - {ridge} * it.a AS f0, sum(w * x * {first}) - {ridge} * it.b AS f1,
                       sum(w * {second}) + {ridge} AS h00, sum(w * x * {second}) AS h01, sum(w * x * x * {second}) + {ridge} AS h11
                FROM (SELECT *{more} FROM (SELECT *, it.a + it.b * x AS z FROM d))
            ) s WHERE it.k < 40
        )
        SELECT unnest(['intercept', 'l_discount']) AS term, unnest([round(a, {digits}), round(b / (SELECT m FROM m), {digits})]) AS estimate FROM it WHERE k = 40
    """


@register("SELECT unnest(['intercept', 'l_quantity']) AS term, unnest([round(regr_intercept(l_discount, l_quantity), 6), round(regr_slope(l_discount, l_quantity), 6)]) AS estimate FROM lineitem")
def glm_ols(spark, sf):
    return _glm(spark, sf, "ols", "l_discount ~ l_quantity", [(0, 0.1), (1, 50)])


@register(_newton_sql("(l_quantity > 25)::DOUBLE", "(y - 1 / (1 + exp(-z)))", "(1 / (1 + exp(-z)) * (1 - 1 / (1 + exp(-z))))", 1.0))
def glm_logit(spark, sf):
    return _glm(spark, sf, "logit", "large ~ l_discount", [(0, 1), (0, 0.1)])


#: The normal density and, by its series, the normal distribution function.
_NORMAL = (
    ", exp(-z * z / 2) / sqrt(2 * pi()) AS f, 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * "
    "list_sum(list_transform(range(0, 80), lambda j: exp((2 * j + 1) * ln(greatest(abs(z), 1e-300)) - lgamma(2 * j + 2) + j * ln(2) + lgamma(j + 1)))) AS c"
)


@register(_newton_sql("(l_quantity > 25)::DOUBLE", "(y * f / c - (1 - y) * f / (1 - c))", "(y * f / c * (f / c + z) + (1 - y) * f / (1 - c) * (f / (1 - c) - z))", 0.0, _NORMAL, 4))
def glm_probit(spark, sf):
    """To four digits, as the distribution function is exact to seven."""
    return _glm(spark, sf, "probit", "large ~ l_discount", [(0, 1), (0, 0.1)], 4)


@register(_newton_sql("l_quantity", "(y - exp(z))", "exp(z)", 0.0))
def glm_poisson(spark, sf):
    return _glm(spark, sf, "poisson", "l_quantity ~ l_discount", [(1, 50), (0, 0.1)])


@register(_newton_sql("least(greatest(l_quantity, 1), 50)", "(y - exp(z))", "exp(z)", 0.0))
def glm_secure_imputation_free(spark, sf):
    """Without missing values nothing random is left, so secure imputation gives the same."""
    df = lineitem(spark, sf)
    got = glm.GlmSpec("l_quantity ~ l_discount", "poisson", N, [(1, 50), (0, 0.1)], epsilon=1.0).release(df, nz.Uniforms.silent())
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in got["coefficients"].items()], "term string, estimate double")


@register("SELECT c_mktsegment AS bin, count(*)::DOUBLE AS total FROM customer GROUP BY 1")
def hist_bootstrap_draws(spark, sf):
    """Every row is drawn once on average: here each replica takes every row exactly once, so that the sums are the counts."""
    df = table(spark, sf, "customer").select("c_mktsegment").withColumn("__times", F.lit(1)).withColumn("__replica", F.lit(0))
    counts = [F.count_if(F.col("c_mktsegment") == b).cast("double").alias(b) for b in ALL_SEGMENTS]
    got = mechanisms.bootstrap_pieces(df, F.struct(*counts)).first()
    pieces = [[(got["times"], got["value"][b])] for b in ALL_SEGMENTS]
    rows = [(b, float(round(mechanisms.bootstrap_replication(p, 1500, 0.0, 1.0, nz.Uniforms.silent())))) for b, p in zip(ALL_SEGMENTS, pieces)]
    return spark.createDataFrame(rows, "bin string, total double")


@register()
def release_documents(spark, sf):
    spec = specs.MeanSpec(**MEAN)
    result = spec.release(lineitem(spark, sf), nz.Uniforms(seed=1), nz.keyed_uniform(F.lit("x"), 1))
    entry = metadata.release_entry("mean", spec, result)
    docs = [("variables", metadata.releases_json([("l_quantity", "numeric", result)])), ("catalog", metadata.catalog_json()), ("exchange", metadata.release_document([entry], "line items", "line", 16, "https://example.com/schema.json"))]
    return spark.createDataFrame(docs, "kind string, document string")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The mean quantity of a line with its accuracy and interval."""
    df = lineitem(spark, sf)
    return specs.release_frame(df, specs.MeanSpec("mechanismLaplace", "numeric", "l_quantity", 6000, (1, 50), epsilon=0.1).release(df))
