"""Mixed models with many levels: the distributed equations against the dense ones,
refits against separate fits, simultaneous contrasts against published values."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlab.functions.distributions import studentized_range_sf
from eventlab.operators import mixed
from eventlab.operators.design import build_design
from eventlab.operators.linear import backward_eliminate, coef_table, screen_covariates
from eventlab.operators.means import adjusted_p, marginal_means, most_true

FACTORS = {"T": ["a", "b", "c"]}


def _data(spark, n=3000, seed=4):
    rng = random.Random(seed)
    e1, e2, e3 = ([rng.gauss(0, s) for _ in range(k)] for s, k in ((1.0, 40), (0.6, 25), (0.8, 200)))
    rows = []
    for _ in range(n):
        g, h, x = rng.randrange(40), rng.randrange(25), rng.gauss(2, 1)
        t = rng.choice("abc")
        rows.append((e1[g] + e2[h] + e3[(g * 7 + h) % 200] + 0.5 * x + "abc".index(t) + rng.gauss(0, 1.2), t, x, rng.gauss(0, 1),
                     f"g{g}", h, f"{(g * 7 + h) % 200}"))
    return spark.createDataFrame(rows, "y double, T string, x double, z double, g string, h int, gh string")


@pytest.fixture(scope="module")
def data(spark):
    return _data(spark).cache()


DESIGN = build_design([("T",), ("x",), ("z",), ("T", "x")], FACTORS)


@pytest.mark.parametrize("groups", [["g"], ["g", "h", "gh"]])
def test_distributed_equations_equal_the_dense_ones(spark, data, monkeypatch, groups):
    dense = mixed.fit_random_intercepts(data, "y", DESIGN, groups)
    monkeypatch.setattr(mixed, "MAX_GROUP_LEVELS", 0)
    spread = mixed.fit_random_intercepts(data, "y", DESIGN, groups)
    assert isinstance(spread.sums, mixed.LevelTables)
    assert spread.variances == pytest.approx(dense.variances, rel=1e-9)
    assert np.allclose(spread.fixed.beta, dense.fixed.beta, rtol=0, atol=1e-8)
    assert np.allclose(spread.fixed.cov, dense.fixed.cov, rtol=0, atol=1e-8)
    for g in groups:
        a, b = ({r[g]: r for r in fit.effects[g].collect()} for fit in (dense, spread))
        assert a.keys() == b.keys()
        assert all(abs(a[k]["effect"] - b[k]["effect"]) < 1e-8 and a[k]["n"] == b[k]["n"] for k in a)
        if groups == ["g"]:
            assert all(abs(a[k]["se"] - b[k]["se"]) < 1e-8 for k in a)
    assert mixed.diagnostics(spread, ["y", "x"]).count() == data.count()


def test_a_hundred_thousand_levels(spark):
    n, big = 250_000, 100_000
    noise = lambda s: F.randn(s)
    df = spark.range(n).select(
        (F.pmod(F.xxhash64("id"), F.lit(big))).alias("g"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300))).cast("int").alias("h"), noise(1).alias("x"),
        noise(2).alias("e"))
    effect = lambda c, s: (F.pmod(F.xxhash64(c, F.lit(s)), F.lit(2001)) / 1000.0 - 1.0)  # noqa: E731  uniform on -1..1
    df = df.withColumn("y", 1 + 0.5 * F.col("x") + 2 * effect("g", 7) + effect("h", 8) + F.col("e")).drop("e")
    fit = mixed.fit_random_intercepts(df, "y", build_design([("x",)], {}), ["g", "h"])
    assert isinstance(fit.sums, mixed.LevelTables)
    assert fit.variances["g"] == pytest.approx(4 / 3, rel=0.05) and fit.variances["Residual"] == pytest.approx(1.0, rel=0.05)
    assert fit.fixed.beta[1] == pytest.approx(0.5, abs=0.02)
    # the effects satisfy the equations (Z'Z + ridge) u = Z'(y - X b)
    rows = df.toPandas()
    u = {g: fit.effects[g].toPandas().set_index(g)["effect"] for g in ("g", "h")}
    rest = rows["y"] - fit.fixed.beta[0] - fit.fixed.beta[1] * rows["x"] - u["g"].reindex(rows["g"]).to_numpy() - u["h"].reindex(rows["h"]).to_numpy()
    for g in ("g", "h"):
        left = rest.groupby(rows[g]).sum() - u[g].sort_index() * fit.variances["Residual"] / fit.variances[g]
        assert np.abs(left).max() < 1e-7


@pytest.mark.parametrize("dense", [True, False])
def test_screen_refits_variances(spark, data, monkeypatch, dense):
    base, groups = [("T",)], ["g", "h"]
    d = build_design([*base, ("x",), ("z",)], FACTORS)
    if not dense:
        monkeypatch.setattr(mixed, "MAX_GROUP_LEVELS", 0)
    fit = mixed.fit_random_intercepts(data, "y", d, groups)
    got = {r["variable"]: r for r in screen_covariates(spark, None, "y", d, base, ["x", "z"], "T", ("b", "a"), fit=fit).collect()}
    for c in ("x", "z"):
        alone = mixed.fit_random_intercepts(data, "y", build_design([*base, (c,)], FACTORS), groups)
        table = {r["term"]: r for r in coef_table(spark, alone).collect()}
        assert got[c]["F"] == pytest.approx(table[c]["t"] ** 2, rel=1e-7)
        assert got[c]["estimate"] == pytest.approx(table["T[b]"]["estimate"], rel=1e-7)
        assert got[c]["se"] == pytest.approx(table["T[b]"]["se"], rel=1e-7)


def test_steps_refit_variances(spark, data):
    d = build_design([("T",), ("x",), ("z",)], FACTORS)
    fit = mixed.fit_random_intercepts(data, "y", d, ["g"])
    last, steps = backward_eliminate(spark, fit, 0.1)
    assert [r["term"] for r in steps.collect()][0] == "z" and [t for t in last.terms] == [("T",), ("x",)]
    alone = mixed.fit_random_intercepts(data, "y", build_design([("T",), ("x",)], FACTORS), ["g"])
    kept = [i for i, b in enumerate(last.beta) if not np.isnan(b)]
    assert np.allclose(np.array(last.beta)[kept], alone.fixed.beta, atol=1e-8)


def test_groups_of_one_level_and_no_groups(spark, data, monkeypatch):
    monkeypatch.setattr(mixed, "MAX_GROUP_LEVELS", 0)
    one = mixed.fit_random_intercepts(data.withColumn("g", F.lit("all")), "y", DESIGN, ["g"])
    assert one.variances["g"] == 0.0 and [r["effect"] for r in one.effects["g"].collect()] == [0.0]


# simultaneous contrasts

def test_studentized_range_against_published_values():
    # Upper 5 % and 1 % points of the studentized range (standard tables).
    for q, k, df, tail in [(3.877, 3, 10, 0.05), (5.270, 3, 10, 0.01), (3.958, 4, 20, 0.05), (3.314, 3, float("inf"), 0.05),
                           (3.633, 4, float("inf"), 0.05), (4.474, 10, float("inf"), 0.05), (2.772, 2, float("inf"), 0.05)]:
        assert studentized_range_sf(q, k, df)[0] == pytest.approx(tail, abs=1e-4), (q, k, df)


def test_shaffer_counts_hypotheses_that_hold_together():
    pairs = list(combinations("abcd", 2))
    assert most_true(pairs, []) == 6
    assert most_true(pairs, [("a", "b")]) == 3          # one mean apart from three others
    assert most_true(pairs, [("a", "b"), ("a", "c"), ("a", "d")]) == 3
    assert most_true(pairs, [("a", "b"), ("c", "d")]) == 2
    assert most_true(pairs, pairs) == 0
    # three means: 3, 1, 1 hypotheses
    assert adjusted_p([4.0, 2.5, 1.0], [("a", "b"), ("a", "c"), ("b", "c")], 3, "shaffer") == pytest.approx(
        [3 * 6.334248e-05, 0.012419331, 0.31731051], rel=1e-5)
    assert adjusted_p([None, 1.0], [("a", "b"), ("a", "c")], 3, "shaffer")[0] is None


def test_adjusted_contrasts_of_a_fit(spark, data):
    fit = mixed.fit_random_intercepts(data, "y", build_design([("T",)], FACTORS), ["g"])
    plain, tukey, shaffer = (marginal_means(spark, fit, "T", adjust=a)[1].orderBy("contrast").collect() for a in (None, "tukey", "shaffer"))
    for p, t, s in zip(plain, tukey, shaffer):
        assert p["z"] == t["z"] and p["p_value"] <= s["p_value"] <= 1 and p["p_value"] <= t["p_value"] + 1e-12


# intervals of variances

def test_poisson_draws(spark):
    from eventlab.operators.bootstrap import poisson_draw
    rows = spark.range(20000).select(poisson_draw(1, F.lit(3), 0, F.col("id")).alias("w"), poisson_draw(2, F.lit(3), 0, F.col("id")).alias("v")).toPandas()
    assert rows["w"].mean() == pytest.approx(1, abs=0.03) and rows["w"].var() == pytest.approx(1, abs=0.05)
    assert (rows["w"] == 0).mean() == pytest.approx(np.exp(-1), abs=0.01) and abs(np.corrcoef(rows["w"], rows["v"])[0, 1]) < 0.03


def test_variance_intervals_of_balanced_groups(spark):
    from eventlab.operators.bootstrap import replicate_variances, variance_intervals
    rng = random.Random(12)
    groups, n, sa, se = 120, 8, 1.0, 2.0
    rows = [(f"g{g}", a + rng.gauss(0, se)) for g, a in ((g, rng.gauss(0, sa)) for g in range(groups)) for _ in range(n)]
    fit = mixed.fit_random_intercepts(spark.createDataFrame(rows, "g string, y double"), "y", build_design([], {}), ["g"])
    got = {r["component"]: r for r in variance_intervals(fit, 300, seed=5).collect()}
    again = {r["component"]: r for r in variance_intervals(fit, 300, seed=5).collect()}
    assert got == again and set(got) == {"g", "Residual", "ICC"}
    # standard errors of the balanced estimators
    between = sa**2 + se**2 / n
    want = {"g": np.sqrt(2 * between**2 / (groups - 1) + 2 * (se**2 / n) ** 2 / (groups * (n - 1))), "Residual": np.sqrt(2 * se**4 / (groups * (n - 1)))}
    for c, truth in (("g", sa**2), ("Residual", se**2)):
        assert got[c]["se"] == pytest.approx(want[c], rel=0.3)
        assert got[c]["lower"] < truth < got[c]["upper"]
    other = replicate_variances(fit, 20, seed=6)
    assert not np.allclose(other["g"], replicate_variances(fit, 20, seed=5)["g"])


def test_crossed_replicates_solve_the_same_equations(spark, data, monkeypatch):
    """With every level drawn once a replicate is the estimate itself."""
    from eventlab.operators import bootstrap
    monkeypatch.setattr(bootstrap, "poisson_draw", lambda *a: F.lit(1))
    fit = mixed.fit_random_intercepts(data, "y", DESIGN, ["g", "h", "gh"])
    drawn = bootstrap.replicate_variances(fit, 2)
    for c, v in fit.variances.items():
        assert drawn[c] == pytest.approx([v, v], rel=1e-6)
