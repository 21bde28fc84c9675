"""Statistics against closed forms and numpy on small literal frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlab.functions.distributions import T975, norm_ppf, t_ppf, t_quantile_975, t_sf
from eventlab.operators.design import build_design, with_design
from eventlab.operators.linear import (
    anova,
    backward_eliminate,
    coef_table,
    effect_curve,
    fit_ols,
)
from eventlab.operators.means import marginal_means
from eventlab.operators.mixed import fit_random_intercepts, normal_scores
from eventlab.operators.summary import mean_ci, paired_t_test, simple_regression


def test_t_table_and_series(spark):
    assert T975[0] == pytest.approx(12.7062047, abs=1e-7)
    assert T975[9] == pytest.approx(2.2281389, abs=1e-7)
    df = spark.range(1, 201).select(F.col("id").alias("df"))
    got = {r["df"]: r["q"] for r in df.select("df", t_quantile_975("df").alias("q")).collect()}
    exact = t_ppf(np.full(200, 0.975), np.arange(1, 201))
    assert max(abs(got[i + 1] - exact[i]) for i in range(200)) < 5e-8
    assert t_sf(2.0, 10) == pytest.approx(0.0366940, abs=1e-6)
    assert norm_ppf(np.array([0.975]))[0] == pytest.approx(1.959963985, abs=1e-9)


def test_mean_ci_matches_numpy(spark):
    rng = random.Random(1)
    rows = [(g, rng.gauss(10, 3)) for g in "abc" for _ in range(rng.randint(2, 40))]
    out = {r["g"]: r for r in mean_ci(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    for g in "abc":
        x = np.array([v for h, v in rows if h == g])
        n, m, sd = len(x), x.mean(), x.std(ddof=1)
        q = float(t_ppf(0.975, n - 1))
        assert out[g]["mean"] == pytest.approx(m)
        assert out[g]["lb"] == pytest.approx(m - q * sd / math.sqrt(n), rel=1e-7)


def test_paired_t_known_values(spark):
    df = spark.createDataFrame([("s", float(a), float(a - d)) for a, d in zip([10, 20, 30, 40, 50], [1, 2, 3, 4, 5])],
                               "g string, a double, b double")
    r = paired_t_test(df, ["g"], "a", "b").first()
    assert r["t"] == pytest.approx(4.242641, rel=1e-6) and r["df"] == 4
    assert r["p_value"] == pytest.approx(0.013236, abs=2e-6)


def test_simple_regression_exact_line(spark):
    df = spark.createDataFrame([("g", float(x), 2.0 + 3.0 * x) for x in range(10)], "g string, x double, y double")
    r = simple_regression(df, ["g"], "y", "x").first()
    assert r["slope"] == pytest.approx(3.0) and r["intercept"] == pytest.approx(2.0)
    assert r["r2"] == pytest.approx(1.0)


def _model_rows(seed=4, n=400):
    rng = np.random.default_rng(seed)
    T = rng.choice(["c", "s"], n)
    B = rng.choice(["x", "y", "z"], n)
    q = rng.normal(5, 2, n)
    y = 1 + 0.5 * (T == "s") + 0.3 * q + 0.2 * (T == "s") * q - 0.4 * (B == "z") + rng.normal(0, 1, n)
    return [(str(a), str(b), float(c), float(d)) for a, b, c, d in zip(T, B, q, y)]


def test_ols_matches_numpy(spark):
    rows = _model_rows()
    df = spark.createDataFrame(rows, "T string, B string, q double, y double")
    d = build_design([("T",), ("q",), ("T", "q"), ("B",)], {"T": ["c", "s"], "B": ["x", "y", "z"]})
    fit = fit_ols(df, "y", d)
    X = np.array([[1, t == "s", q, (t == "s") * q, b == "y", b == "z"] for t, b, q, _ in rows], float)
    Y = np.array([r[3] for r in rows])
    beta, *_ = np.linalg.lstsq(X, Y, rcond=None)
    assert np.allclose(fit.beta, beta, rtol=1e-8, atol=1e-9)
    resid = Y - X @ beta
    s2 = resid @ resid / (len(Y) - 6)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    tab = {r["term"]: r for r in coef_table(spark, fit).collect()}
    assert tab["T[s]:q"]["se"] == pytest.approx(se[3], rel=1e-7)
    assert tab["q"]["estimate"] == pytest.approx(beta[2], rel=1e-8)


def test_anova_one_way_and_aliasing(spark):
    rows = [(g, float(v)) for g, vals in {"a": [1, 2, 3], "b": [4, 5, 6], "c": [7, 8, 9]}.items() for v in vals]
    df = spark.createDataFrame(rows, "g string, y double").withColumn("g2", F.col("g"))
    d = build_design([("g",), ("g2",)], {"g": ["a", "b", "c"], "g2": ["a", "b", "c"]})
    fit = fit_ols(df, "y", d)
    tab = {r["term"]: r for r in anova(spark, fit).collect()}
    assert tab["g"]["sum_sq"] == pytest.approx(54.0) and tab["g"]["df"] == 2
    assert tab["g2"]["df"] == 0                       # fully aliased term
    assert tab["Residuals"]["sum_sq"] == pytest.approx(6.0)
    coefs = {r["term"]: r["estimate"] for r in coef_table(spark, fit).collect()}
    assert coefs["g2[b]"] is None                      # aliased coefficient reported as NULL


def test_backward_elimination_respects_hierarchy(spark):
    rows = _model_rows(seed=8, n=600)
    df = spark.createDataFrame(rows, "T string, B string, q double, y double")
    d = build_design([("T",), ("q",), ("T", "q"), ("B",), ("T", "B")], {"T": ["c", "s"], "B": ["x", "y", "z"]})
    fit = fit_ols(df, "y", d)
    final, steps = backward_eliminate(spark, fit, alpha=0.1)
    dropped = [r["term"] for r in steps.collect() if r["action"] == "drop"]
    assert "T:B" in dropped and "T" not in dropped and ("T", "q") in final.terms


def test_marginal_means_one_way(spark):
    rows = [(g, float(v)) for g, vals in {"a": [1, 2, 3, 6], "b": [4, 5, 9]}.items() for v in vals]
    df = spark.createDataFrame(rows, "g string, y double")
    d = build_design([("g",)], {"g": ["a", "b"]})
    fit = fit_ols(df, "y", d)
    means, contr = marginal_means(spark, fit, "g")
    m = {r["level"]: r["emmean"] for r in means.collect()}
    assert m == pytest.approx({"a": 3.0, "b": 6.0})
    c = contr.first()
    s2 = (14.0 + 14.0) / 5
    assert c["estimate"] == pytest.approx(-3.0) and c["se"] == pytest.approx(math.sqrt(s2 * (1 / 4 + 1 / 3)))


def test_moments_balanced_one_way(spark):
    rng = np.random.default_rng(0)
    G, n = 12, 6
    eff = rng.normal(0, 2, G)
    rows = [(f"g{g}", float(5 + eff[g] + rng.normal(0, 1))) for g in range(G) for _ in range(n)]
    df = spark.createDataFrame(rows, "grp string, y double")
    d = build_design([], {})
    fit = fit_random_intercepts(df, "y", d, ["grp"])
    y = np.array([r[1] for r in rows]).reshape(G, n)
    msw = ((y - y.mean(1, keepdims=True)) ** 2).sum() / (G * n - G)
    msb = n * ((y.mean(1) - y.mean()) ** 2).sum() / (G - 1)
    assert fit.variances["Residual"] == pytest.approx(msw, rel=1e-9)
    assert fit.variances["grp"] == pytest.approx(max((msb - msw) / n, 0.0), rel=1e-9)
    lam = n * fit.variances["grp"] / (n * fit.variances["grp"] + msw)
    effects = {r["grp"]: r["effect"] for r in fit.effects["grp"].collect()}
    assert effects["g0"] == pytest.approx(lam * (y[0].mean() - y.mean()), rel=1e-7)


def test_normal_scores_exact_ranks(spark):
    rng = random.Random(5)
    vals = [rng.gauss(0, 1) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, r double")
    out = {r["i"]: r["theoretical"] for r in normal_scores(df, "r", tiebreak=["i"]).collect()}
    order = np.argsort(vals)
    p = (np.arange(1, 501) - 0.5) / 500
    z = norm_ppf(p)
    for rank, idx in enumerate(order):
        assert out[int(idx)] == pytest.approx(z[rank], abs=1e-9)


def test_effect_curve_line(spark):
    df = spark.createDataFrame([(float(x), 1.0 + 2.0 * x + (0.1 if x % 2 else -0.1)) for x in range(20)],
                               "q double, y double")
    d = build_design([("q",)], {})
    fit = fit_ols(df, "y", d)
    cur = {r["x"]: r["fit"] for r in effect_curve(spark, fit, "q", [0.0, 10.0]).collect()}
    assert cur[10.0] - cur[0.0] == pytest.approx(10 * fit.beta[1])


def test_moments_recover_crossed_components(spark):
    # crossed A x B with an A:B interaction, unbalanced cells; known variances
    rng = np.random.default_rng(11)
    na, nb, n = 40, 30, 24000
    a_eff, b_eff = rng.normal(0, 1.0, na), rng.normal(0, math.sqrt(0.5), nb)
    ab_eff = rng.normal(0, math.sqrt(0.7), (na, nb))
    ia, ib = rng.integers(0, na, n), rng.integers(0, nb, n)
    x = rng.normal(0, 1, n)
    y = 2.0 + 0.5 * x + a_eff[ia] + b_eff[ib] + ab_eff[ia, ib] + rng.normal(0, 1.2, n)
    rows = [(f"a{i}", f"b{j}", f"a{i}:b{j}", float(u), float(v)) for i, j, u, v in zip(ia, ib, x, y)]
    df = spark.createDataFrame(rows, "A string, B string, AB string, x double, y double")
    d = build_design([("x",)], {})
    fit = fit_random_intercepts(df, "y", d, ["A", "B", "AB"])
    v = fit.variances
    # sample variances of the drawn effects (what the data can identify)
    assert v["A"] == pytest.approx(np.var(a_eff, ddof=1), rel=0.3)
    assert v["B"] == pytest.approx(np.var(b_eff, ddof=1), rel=0.35)
    assert v["AB"] == pytest.approx(np.var(ab_eff, ddof=1), rel=0.2)
    assert v["Residual"] == pytest.approx(1.44, rel=0.05)
    assert fit.fixed.beta[1] == pytest.approx(0.5, abs=0.03)


def _crossed(seed=3, na=15, nb=12, n=900):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1.0, na), rng.normal(0, 0.8, nb)
    ia, ib = rng.integers(0, na, n), rng.integers(0, nb, n)
    between = rng.normal(0, 1, na)[ia]          # a covariate that is constant within A
    x = rng.normal(0, 1, n)
    y = 1.0 + 0.5 * x + 0.3 * between + a[ia] + b[ib] + rng.normal(0, 1.0, n)
    return ia, ib, x, between, y


def test_mixed_fit_equals_a_dense_solve(spark):
    ia, ib, x, w, y = _crossed()
    rows = [(f"a{i}", f"b{j}", float(u), float(v), float(t)) for i, j, u, v, t in zip(ia, ib, x, w, y)]
    df = spark.createDataFrame(rows, "A string, B string, x double, w double, y double")
    fit = fit_random_intercepts(df, "y", build_design([("x",), ("w",)], {}), ["A", "B"])
    v = fit.variances
    X = np.column_stack([np.ones(len(y)), x, w])
    ZA, ZB = np.eye(ia.max() + 1)[ia], np.eye(ib.max() + 1)[ib]
    V = v["A"] * ZA @ ZA.T + v["B"] * ZB @ ZB.T + v["Residual"] * np.eye(len(y))
    Vi = np.linalg.inv(V)
    cov = np.linalg.inv(X.T @ Vi @ X)
    beta = cov @ X.T @ Vi @ y
    assert fit.fixed.beta == pytest.approx(beta, rel=1e-7)
    assert fit.fixed.cov == pytest.approx(cov, rel=1e-6)
    u = v["A"] * ZA.T @ Vi @ (y - X @ beta)
    got = {r["A"]: r["effect"] for r in fit.effects["A"].collect()}
    assert [got[f"a{i}"] for i in range(len(u))] == pytest.approx(u, rel=1e-6, abs=1e-9)
    tab = {r["term"]: r for r in coef_table(spark, fit).collect()}
    assert tab["w"]["se"] == pytest.approx(math.sqrt(cov[2, 2]), rel=1e-6)
    ols = fit_ols(df, "y", fit.design)
    assert tab["w"]["se"] > 3 * math.sqrt(ols.cov[2, 2])      # a between-group covariate
    wald = beta[2] ** 2 / cov[2, 2]
    a3 = {r["term"]: r["F"] for r in anova(spark, fit, "type3").collect()}
    assert a3["w"] == pytest.approx(wald, rel=1e-6)


def test_null_groups_and_undeclared_levels_drop_out(spark):
    rows = [("a", "g1", 1.0), ("a", "g2", 3.0), ("b", "g1", 2.0), ("b", "g2", 5.0), ("b", "g2", 4.0)]
    d = build_design([("t",)], {"t": ["a", "b"]})
    clean = spark.createDataFrame(rows, "t string, grp string, y double")
    dirty = spark.createDataFrame(rows + [("z", "g1", 101.0), (None, "g1", 9.0)], clean.schema)
    assert fit_ols(dirty, "y", d).beta == pytest.approx(fit_ols(clean, "y", d).beta)
    assert fit_ols(dirty, "y", d).gram.n == 5 and with_design(dirty, d).count() == 5
    nulls = spark.createDataFrame(rows + [("a", None, 50.0)], clean.schema)
    a, b = (fit_random_intercepts(x, "y", d, ["grp"]) for x in (clean, nulls))
    assert a.variances == pytest.approx(b.variances) and a.fixed.beta == pytest.approx(b.fixed.beta)


def test_type3_does_not_depend_on_the_reference_level(spark):
    df = spark.createDataFrame(_model_rows(seed=8, n=300), "T string, B string, q double, y double")
    terms = [("T",), ("q",), ("B",), ("T", "q"), ("T", "B")]
    tables = []
    for levels in (["x", "y", "z"], ["z", "x", "y"]):
        d = build_design(terms, {"T": ["c", "s"], "B": levels})
        tables.append({r["term"]: r["sum_sq"] for r in anova(spark, fit_ols(df, "y", d), "type3").collect()})
    assert tables[0] == pytest.approx(tables[1], rel=1e-8)
    marginal = {r["term"] for r in anova(spark, fit_ols(df, "y", d), "marginal").collect()}
    assert marginal == {"T:q", "T:B", "Residuals"}


def test_normal_quantile_expression(spark):
    from pyspark.sql import functions as F
    from eventlab.functions.distributions import normal_quantile
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.02, 0.075, 0.3, 0.5, 0.77, 0.925, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = [r["z"] for r in df.orderBy("i").select(normal_quantile(F.col("p")).alias("z")).collect()]
    assert got[2:] == pytest.approx(norm_ppf(np.array(p[2:])), abs=1e-9)
    assert got[1] == pytest.approx(-9.262340089798409, rel=1e-12)


def test_diagnostics_rank_ties_by_ids(spark):
    from eventlab.operators.mixed import diagnostics
    rows = [(i, 1.0 if i % 10 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y double")
    out = diagnostics(fit_random_intercepts(df, "y", build_design([], {}), []), ["id"]).orderBy("id").collect()
    assert [r["index"] for r in out] == list(range(1, 201))
    want = norm_ppf((np.arange(1, 201) - 0.5) / 200)
    order = sorted(range(200), key=lambda i: (rows[i][1], i))
    assert [out[i]["theoretical"] for i in order] == pytest.approx(want, abs=1e-9)


def test_diagnostics_compute_scores_once_and_last(spark, monkeypatch):
    from eventlab.operators import mixed
    ranked, given = mixed.global_rank, []

    def seen(df, order, out):
        given.append((out, df.columns))
        return ranked(df, order, out)

    monkeypatch.setattr(mixed, "global_rank", seen)
    left = spark.createDataFrame([(i, float(i * 7919 % 500)) for i in range(500)], "id long, y double")
    right = spark.createDataFrame([(i, f"g{i % 3}") for i in range(500)], "id long, g string")
    fit = fit_random_intercepts(left.join(right, "id"), "y", build_design([], {}), ["g"], keep_rows=True)
    assert "Join" not in fit.rows._jdf.queryExecution().optimizedPlan().toString()
    out = mixed.diagnostics(fit, ["id"])
    # what is range-partitioned is computed twice: the scores are not part of it
    assert [name for name, _ in given] == ["_rank", "index"] and not any("theoretical" in columns for _, columns in given)
    assert out.columns == ["id", "g", "fitted", "resid", "std_resid", "theoretical", "index"]
    rows = out.orderBy("resid", "id").collect()
    assert [r["theoretical"] for r in rows] == pytest.approx(norm_ppf((np.arange(1, 501) - 0.5) / 500), abs=1e-9)
    assert [r["index"] for r in out.orderBy("id").collect()] == list(range(1, 501))


def test_quantile_columns_equal_the_expression(spark):
    from pyspark.sql import functions as F
    from eventlab.functions.distributions import normal_quantile, with_normal_quantile
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.02, 0.075, 0.3, 0.5, 0.77, 0.925, 0.999, 1 - 1e-9, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = with_normal_quantile(df.withColumn("z", normal_quantile(F.col("p"))), F.col("p"), "y")
    assert got.columns == ["i", "p", "z", "y"] and got.where("not (y <=> z)").count() == 0


def test_screen_of_a_mixed_fit(spark):
    from eventlab.operators.linear import screen_covariates
    ia, ib, x, w, y = _crossed(n=400)
    df = spark.createDataFrame([(f"a{i}", "t" if j % 2 else "s", float(u), float(v), float(t))
                                for i, j, u, v, t in zip(ia, ib, x, w, y)], "A string, T string, x double, w double, y double")
    d = build_design([("T",), ("x",), ("w",)], {"T": ["s", "t"]})
    plain = {r["variable"]: r for r in screen_covariates(spark, df, "y", d, [("T",)], ["x", "w"], "T", ("s", "t")).collect()}
    mixed = {r["variable"]: r for r in screen_covariates(spark, df, "y", d, [("T",)], ["x", "w"], "T", ("s", "t"),
                                                         fit=fit_random_intercepts(df, "y", d, ["A"])).collect()}
    assert mixed["x"]["F"] > 30 and mixed["w"]["F"] < plain["w"]["F"]
    one = fit_ols(df, "y", d.subset([("T",), ("x",)]))
    t = {r["term"]: r["t"] for r in coef_table(spark, one).collect()}["x"]
    assert plain["x"]["F"] == pytest.approx(t * t, rel=1e-6)
