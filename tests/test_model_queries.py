"""Rows-only (driver-solved) registered queries against brute force on the
smallest driver tables: the same model refit with numpy."""

import numpy as np
import pytest

import __spark_entry__ as entry
from eventlab.functions.distributions import norm_ppf
from eventlab.plans import stat_queries as sq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    pdf = sq.model_df(spark, SF).select("y", "Treatment", "qty", "crop").toPandas()
    cols = [np.ones(len(pdf))]
    names = ["(Intercept)"]
    T, C, q = pdf["Treatment"].to_numpy(), pdf["crop"].to_numpy(), pdf["qty"].to_numpy()
    for lv in sq.FLAGS[1:]:
        cols.append((T == lv).astype(float)); names.append(f"Treatment[{lv}]")
    cols.append(q); names.append("qty")
    for lv in sq.FLAGS[1:]:
        cols.append((T == lv) * q); names.append(f"Treatment[{lv}]:qty")
    for lv in sq.PRIORITIES[1:]:
        cols.append((C == lv).astype(float)); names.append(f"crop[{lv}]")
    for a in sq.FLAGS[1:]:
        for b in sq.PRIORITIES[1:]:
            cols.append(((T == a) & (C == b)).astype(float)); names.append(f"Treatment[{a}]:crop[{b}]")
    return np.column_stack(cols), pdf["y"].to_numpy(), names


def test_ols_coefficients_match_lstsq(spark, model):
    X, y, names = model
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    got = {r["term"]: r["estimate"] for r in entry.queries()["ols_coefficients"](spark, SF).collect()}
    for n, b in zip(names, beta):
        assert got[n] == pytest.approx(b, rel=1e-7, abs=1e-9), n


def test_sequential_anova_matches_nested_fits(spark, model):
    X, y, names = model
    def rss(k):
        b, *_ = np.linalg.lstsq(X[:, :k], y, rcond=None)
        r = y - X[:, :k] @ b
        return r @ r
    # column blocks in term order: T(2), qty(1), T:qty(2), crop(4), T:crop(8)
    edges = [1, 3, 4, 6, 10, 18]
    ss = [rss(edges[i]) - rss(edges[i + 1]) for i in range(5)]
    got = {r["term"]: r["sum_sq"] for r in entry.queries()["anova_sequential"](spark, SF).collect()}
    for term, want in zip(["Treatment", "qty", "Treatment:qty", "crop", "Treatment:crop"], ss):
        assert got[term] == pytest.approx(want, rel=1e-6, abs=1e-9), term


def test_residual_diagnostics_qq_is_sorted_normal_scores(spark):
    rows = entry.queries()["residual_diagnostics"](spark, SF).select("resid", "theoretical").collect()
    r = np.array([x["resid"] for x in rows])
    z = np.array([x["theoretical"] for x in rows])
    n = len(r)
    expected = norm_ppf((np.arange(1, n + 1) - 0.5) / n)
    assert np.allclose(np.sort(z), expected, atol=1e-9)
    assert np.all(np.diff(z[np.argsort(r, kind="stable")]) >= -1e-12)   # monotone in the residual
