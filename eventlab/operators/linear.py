"""Linear models from one Spark pass.

``gram`` builds X'X, X'y and y'y from one grouped aggregate of per-cell
moments (cells = combinations of factor levels, a bounded set); only those
cell sums reach the driver. Every sub-model (sequential ANOVA, drop-one
tests, backward elimination, covariate screens) is solved from index subsets
of that same Gram, without another scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from eventlab.functions.distributions import Z975, f_sf, norm_sf, t_ppf, t_sf
from eventlab.operators.design import Design, Term, column_expr, model_rows, row_vector, term_name

INTERCEPT = "(Intercept)"
MAX_CELLS = 200_000        # factor cells collected by ``gram`` (bounded by the design)


@dataclass
class Gram:
    """Sums of products about the means: columns are 1 and x - xbar, the
    response is y - ybar, so no digits are lost where means are large."""
    names: list[str]      # intercept first, then design columns
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    n: int
    xbar: np.ndarray      # 1 for the intercept
    ybar: float
    raw: np.ndarray                # plain sums of products of all columns and y (last)
    scale: float | None = None     # a known residual variance

    @property
    def means(self) -> np.ndarray:
        return self.xbar

    @property
    def to_centred(self) -> np.ndarray:
        """The raw columns written in the centred ones."""
        u = np.eye(len(self.names))
        u[0, 1:] = self.xbar[1:]
        return u


def monomial_of(design: Design, col: str | None) -> tuple[str, ...]:
    """Numeric part of a design column (sorted variable names; () for 1)."""
    if col is None:
        return ()
    return tuple(sorted(v for v, lvl in design.column_parts[col] if lvl is None))


def indicator_of(design: Design, col: str | None) -> dict:
    """Factor levels at which a design column is on."""
    if col is None:
        return {}
    return {v: lvl for v, lvl in design.column_parts[col] if lvl is not None}


def monomials(design: Design) -> list[tuple[str, ...]]:
    """Distinct numeric parts of the design columns; the first is the constant."""
    return sorted({monomial_of(design, c) for c in [None, *design.columns]})


def moment_aggs(y: str, design: Design) -> list[Column]:
    """Rows (_n), means of the monomials (_a_i) and y (_b), and their centred sums
    of products: _c_i_j, _d_i (with y), _e (of y). Spark merges them stably."""
    Y = F.col(y).cast("double")
    n = F.count(F.lit(1))

    def prod(vars_):
        e = F.lit(1.0)
        for v in vars_:
            e = e * F.col(v).cast("double")
        return e

    monos = monomials(design)
    aggs = [n.alias("_n"), F.avg(Y).alias("_b"), (F.var_pop(Y) * n).alias("_e")]
    for i, a in enumerate(monos):
        aggs += [F.avg(prod(a)).alias(f"_a_{i}"), (F.covar_pop(prod(a), Y) * n).alias(f"_d_{i}")]
        aggs += [(F.covar_pop(prod(a), prod(monos[j])) * n).alias(f"_c_{i}_{j}") for j in range(i, len(monos))]
    return aggs


def merge_cells(cells: DataFrame, keys: Sequence[str], design: Design) -> DataFrame:
    """The moments of unions of cells: those of all cells with equal ``keys``."""
    k = len(monomials(design))
    means = cells.groupBy(*keys).agg(*[(F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"_m{c}")
                                       for c in ["_b", *(f"_a_{i}" for i in range(k))]])
    joined = cells.join(F.broadcast(means), list(keys)) if keys else cells.crossJoin(F.broadcast(means))

    def off(c):
        return F.col(c) - F.col(f"_m{c}")

    aggs = [F.sum("_n").alias("_n"), F.first("_m_b").alias("_b"),
            F.sum(F.col("_e") + F.col("_n") * off("_b") * off("_b")).alias("_e")]
    for i in range(k):
        aggs += [F.first(f"_m_a_{i}").alias(f"_a_{i}"),
                 F.sum(F.col(f"_d_{i}") + F.col("_n") * off(f"_a_{i}") * off("_b")).alias(f"_d_{i}")]
        aggs += [F.sum(F.col(f"_c_{i}_{j}") + F.col("_n") * off(f"_a_{i}") * off(f"_a_{j}")).alias(f"_c_{i}_{j}")
                 for j in range(i, k)]
    return joined.groupBy(*keys).agg(*aggs)


def factors_of(design: Design) -> list[str]:
    """Factors of the design; their declared levels bound the cells."""
    factors = [v for v in design.variables if v in design.factors]
    n_cells = 1
    for v in factors:
        n_cells *= len(design.factors[v])
    if n_cells > MAX_CELLS:
        raise ValueError(f"design has up to {n_cells} factor cells (> {MAX_CELLS}); "
                         "reduce factor levels or model them as random effects")
    return factors


def columns_on(design: Design, row) -> list[bool]:
    """Which columns (intercept first) are on in the factor cell of ``row``."""
    return [all(row[v] == lvl for v, lvl in indicator_of(design, c).items()) for c in [None, *design.columns]]


def gram_from_cells(design: Design, cells) -> Gram:
    """Expand per-cell moments to the Gram of all columns."""
    names = [INTERCEPT, *design.columns]
    p = len(names)
    monos = monomials(design)
    mono_of = [monos.index(monomial_of(design, c)) for c in [None, *design.columns]]
    cells = [r for r in cells if r["_n"]]
    n = sum(int(r["_n"]) for r in cells)
    on = [np.array(columns_on(design, r), float) for r in cells]
    mean = [o * np.array([r[f"_a_{m}"] for m in mono_of]) for o, r in zip(on, cells)]
    xbar = sum((r["_n"] * m for r, m in zip(cells, mean)), np.zeros(p)) / max(n, 1)
    xbar[0] = 1.0
    ybar = sum(r["_n"] * r["_b"] for r in cells) / max(n, 1)
    xtx, xty, yty = np.zeros((p, p)), np.zeros(p), 0.0
    raw = np.zeros((p + 1, p + 1))
    for r, o, m in zip(cells, on, mean):
        yty += r["_e"] + r["_n"] * (r["_b"] - ybar) ** 2
        xty += o * np.array([r[f"_d_{k}"] for k in mono_of]) + r["_n"] * (m - xbar) * (r["_b"] - ybar)
        inner = np.array([[r[f"_c_{min(i, j)}_{max(i, j)}"] for j in mono_of] for i in mono_of])
        xtx += np.outer(o, o) * inner + r["_n"] * np.outer(m - xbar, m - xbar)
        raw[:p, :p] += np.outer(o, o) * inner + r["_n"] * np.outer(m, m)
        raw[:p, p] += o * np.array([r[f"_d_{k}"] for k in mono_of]) + r["_n"] * m * r["_b"]
        raw[p, p] += r["_e"] + r["_n"] * r["_b"] ** 2
    xtx[0, :] = xtx[:, 0] = 0.0
    xtx[0, 0], xty[0] = n, 0.0
    return Gram(names, xtx, xty, float(yty), n, xbar, float(ybar), raw)


def gram(df: DataFrame, y: str, design: Design) -> Gram:
    """The Gram of ``y`` on the design, from ONE grouped aggregate.

    Every design column is (factor indicators) x (a numeric monomial), so
    X'X, X'y and y'y are fixed sums of per-cell moments: group the rows by
    the declared factor levels (a bounded number of cells; rows at other levels
    are dropped first), aggregate the means and centred products of the distinct
    numeric monomials (and y) per cell, and expand on the driver. A hash aggregate with partial
    sums: each task pre-reduces its rows, so a cell holding a third of the data
    costs no more than the others, and the expressions are evaluated once per
    row, not per pair."""
    factors = factors_of(design)
    cells = model_rows(df, design, [y]).groupBy(*factors).agg(*moment_aggs(y, design)).collect()
    return gram_from_cells(design, cells)


GRAM_LAYOUT = "n, sy, syy, s_i, sy_i, s_i_j (i <= j) over the design columns"


def gram_frame(spark: SparkSession, g: Gram) -> DataFrame:
    """The Gram as one row: n, sy, syy, s_i, sy_i, s_i_j (design columns)."""
    p = len(g.names) - 1
    r = g.raw
    vals = {"n": int(g.n), "sy": float(r[0, -1]), "syy": float(r[-1, -1])}
    vals.update({f"s_{i}": float(r[0, i + 1]) for i in range(p)})
    vals.update({f"sy_{i}": float(r[i + 1, -1]) for i in range(p)})
    vals.update({f"s_{i}_{j}": float(r[i + 1, j + 1]) for i in range(p) for j in range(i, p)})
    fields = [StructField("n", LongType())] + [StructField(k, DoubleType()) for k in vals if k != "n"]
    return spark.createDataFrame([tuple(vals[f.name] for f in fields)], StructType(fields))


def solve(g: Gram, idx: Sequence[int], tol: float = 1e-9) -> dict:
    """Least squares on the columns ``idx`` of the Gram. Aliased columns
    (Schur complement below ``tol`` of their scale) are dropped and reported."""
    kept: list[int] = []
    aliased: list[int] = []
    for j in idx:
        if kept:
            a = g.xtx[np.ix_(kept, kept)]
            b = g.xtx[kept, j]
            s = g.xtx[j, j] - b @ np.linalg.solve(a, b)
        else:
            s = g.xtx[j, j]
        if s <= tol * max(g.xtx[j, j], 1e-300):
            aliased.append(j)
        else:
            kept.append(j)
    a = g.xtx[np.ix_(kept, kept)]
    inv = np.linalg.inv(a) if kept else np.zeros((0, 0))
    beta = inv @ g.xty[kept] if kept else np.zeros(0)
    rss = float(g.yty - beta @ g.xty[kept]) if kept else g.yty
    rss = max(rss, 0.0)
    return {"kept": kept, "aliased": aliased, "beta": beta, "inv": inv, "rss": rss,
            "rank": len(kept), "df_resid": g.n - len(kept)}


def _scale(g: Gram, s: dict) -> float:
    """Residual variance: the known one of a mixed model, else rss / df."""
    if g.scale is not None:
        return g.scale
    return s["rss"] / s["df_resid"] if s["df_resid"] > 0 else float("nan")


def linear_part(fit) -> "OLSFit":
    """The fit that tests and means work on: of a mixed model the generalised
    least squares fit of its fixed part."""
    return getattr(fit, "fixed", fit)


@dataclass
class OLSFit:
    design: Design
    gram: Gram
    beta: np.ndarray     # full length (intercept first), NaN where aliased
    cov: np.ndarray      # full, NaN rows/cols where aliased
    sigma2: float
    rss: float
    df_resid: int
    terms: list[Term]

    @property
    def names(self) -> list[str]:
        return self.gram.names

    def beta0(self) -> np.ndarray:
        """Coefficients with aliased ones set to 0 (for predictions)."""
        return np.nan_to_num(self.beta)


def _columns_of(design: Design, terms: Sequence[Term]) -> list[int]:
    pos = {c: i + 1 for i, c in enumerate(design.columns)}
    return [0] + [pos[c] for t in terms for c in design.term_columns[t]]


def fit_from_gram(design: Design, g: Gram, terms: Sequence[Term] | None = None) -> OLSFit:
    terms = list(terms) if terms is not None else list(design.terms)
    s = solve(g, _columns_of(design, terms))
    p = len(g.names)
    beta = np.full(p, np.nan)
    cov = np.full((p, p), np.nan)
    sigma2 = _scale(g, s)
    # back from centred columns: only the intercept differs
    back = np.eye(len(s["kept"]))
    back[0, 1:] = -g.xbar[s["kept"][1:]]
    beta[s["kept"]] = back @ s["beta"]
    beta[0] += g.ybar
    cov[np.ix_(s["kept"], s["kept"])] = sigma2 * back @ s["inv"] @ back.T
    return OLSFit(design, g, beta, cov, sigma2, s["rss"], s["df_resid"], terms)


def fit_ols(df: DataFrame, y: str, design: Design) -> OLSFit:
    """H4: OLS of ``y`` on the design over the raw variables: one pass."""
    return fit_from_gram(design, gram(df, y, design))


def predict_expr(fit: OLSFit, design: Design):
    """Xb as a Catalyst expression over the raw model variables."""
    b = fit.beta0()
    expr = F.lit(float(b[0]))
    for i, c in enumerate(design.columns):
        if b[i + 1] != 0.0:
            expr = expr + F.lit(float(b[i + 1])) * column_expr(design, c)
    return expr


COEF_SCHEMA = StructType([StructField("term", StringType()), StructField("estimate", DoubleType()),
                          StructField("se", DoubleType()), StructField("t", DoubleType()),
                          StructField("p_value", DoubleType())])


def coef_table(spark: SparkSession, fit) -> DataFrame:
    """Coefficient table: estimate, se, t, two-sided p (aliased: NULL)."""
    fit = linear_part(fit)
    rows = []
    for i, name in enumerate(fit.names):
        b = fit.beta[i]
        if i != 0 and not any(name in fit.design.term_columns[t] for t in fit.terms):
            continue
        if np.isnan(b):
            rows.append((name, None, None, None, None))
            continue
        se = float(np.sqrt(fit.cov[i, i]))
        t = float(b / se) if se > 0 else None
        p = float(2 * t_sf(abs(t), fit.df_resid)) if t is not None else None
        rows.append((name, float(b), se, t, p))
    return spark.createDataFrame(rows, COEF_SCHEMA)


ANOVA_SCHEMA = StructType([StructField("term", StringType()), StructField("df", LongType()),
                           StructField("sum_sq", DoubleType()), StructField("mean_sq", DoubleType()),
                           StructField("F", DoubleType()), StructField("p_value", DoubleType())])


def _f_row(name, ss, df, full, g: Gram) -> tuple:
    if df <= 0:
        return (name, 0, 0.0, None, None, None)
    ms = ss / df
    scale = _scale(g, full)
    f = ms / scale if scale > 0 else None
    p = float(f_sf(f, df, full["df_resid"])) if f is not None else None
    return (name, int(df), float(ss), float(ms), f, p)


def sum_to_zero(design: Design, terms: Sequence[Term]) -> np.ndarray:
    """Columns of the model in sum-to-zero coding, written in its own columns
    (intercept first): a level's column is its indicator less that of the first
    level, which is one less all other indicators. The products expand over
    contained terms, so a term's contained terms must be in the model."""
    pos = {frozenset(design.column_parts[c]): i + 1 for i, c in enumerate(design.columns)}
    pos[frozenset()] = 0
    out = np.zeros((len(pos), len(pos)))
    out[0, 0] = 1.0
    for c in [c for t in terms for c in design.term_columns[t]]:
        expanded = {frozenset(): 1.0}
        for v, lvl in design.column_parts[c]:
            if lvl is None:
                part = {frozenset([(v, None)]): 1.0}
            else:
                part = {frozenset([(v, other)]): 1.0 + (other == lvl) for other in design.factors[v][1:]}
                part[frozenset()] = -1.0
            expanded = {a | b: x * y for a, x in expanded.items() for b, y in part.items()}
        for parts, weight in expanded.items():
            if parts not in pos:
                raise ValueError(f"{c}: the model lacks a term that it contains")
            out[pos[parts], pos[frozenset(design.column_parts[c])]] = weight
    return out


def anova(spark: SparkSession, fit, kind: str = "sequential") -> DataFrame:
    """H5: ANOVA table of an OLS or mixed fit, from its Gram.

    ``sequential``: type I (R's ``anova(lm)``). ``type3``: each term dropped
    while all others stay, in sum-to-zero coding, so the table doesn't depend on
    the reference levels. ``marginal``: the same for the terms that no other
    term contains, where coding doesn't matter. For a mixed fit the tests are
    Wald tests with the variances as estimated; the denominator has the residual
    degrees of freedom."""
    fit = linear_part(fit)
    d, g = fit.design, fit.gram
    full = solve(g, _columns_of(d, fit.terms))
    rows = []
    if kind == "sequential":
        prev = solve(g, [0])
        for k in range(len(fit.terms)):
            cur = solve(g, _columns_of(d, fit.terms[:k + 1]))
            rows.append(_f_row(term_name(fit.terms[k]), prev["rss"] - cur["rss"],
                               cur["rank"] - prev["rank"], full, g))
            prev = cur
    elif kind in ("marginal", "type3"):
        terms = removable(fit.terms) if kind == "marginal" else fit.terms
        if kind == "type3":
            m = g.to_centred @ sum_to_zero(d, fit.terms)
            g = Gram(g.names, m.T @ g.xtx @ m, m.T @ g.xty, g.yty, g.n, g.xbar, g.ybar, g.raw, g.scale)
        for t in terms:
            red = solve(g, _columns_of(d, [u for u in fit.terms if u != t]))
            rows.append(_f_row(term_name(t), red["rss"] - full["rss"], full["rank"] - red["rank"], full, g))
    else:
        raise ValueError(f"unknown kind of ANOVA: {kind}")
    rows.append(("Residuals", int(full["df_resid"]), float(full["rss"]),
                 float(full["rss"] / full["df_resid"]) if full["df_resid"] > 0 else None, None, None))
    return spark.createDataFrame(rows, ANOVA_SCHEMA)


def removable(terms: Sequence[Term]) -> list[Term]:
    """Terms not contained in a higher-order remaining term (hierarchy)."""
    return [t for t in terms if not any(u != t and set(t) < set(u) for u in terms)]


STEP_SCHEMA = StructType([StructField("step", LongType()), StructField("term", StringType()),
                          StructField("df", LongType()), StructField("F", DoubleType()),
                          StructField("p_value", DoubleType()), StructField("action", StringType())])


def backward_eliminate(spark: SparkSession, fit: OLSFit, alpha: float = 0.1
                       ) -> tuple[OLSFit, DataFrame]:
    """H9: drop the least significant removable term while its drop-F p-value
    exceeds ``alpha``; all sub-models come from the one Gram (no rescans). A
    mixed fit is refitted at every step: its variances are estimated again for
    the terms that are left."""
    refit = getattr(fit, "refit", None)
    fit = linear_part(fit)
    d = fit.design
    terms = list(fit.terms)
    rows, step = [], 0
    while True:
        g = refit(terms).gram if refit else fit.gram
        full = solve(g, _columns_of(d, terms))
        cands = []
        for t in removable(terms):
            red = solve(g, _columns_of(d, [u for u in terms if u != t]))
            r = _f_row(term_name(t), red["rss"] - full["rss"], full["rank"] - red["rank"], full, g)
            cands.append((r[5] if r[5] is not None else 1.0, t, r))
        if not cands:
            break
        step += 1
        pmax, t, r = max(cands, key=lambda c: c[0])
        if pmax > alpha:
            rows.append((step, r[0], r[1], r[4], r[5], "drop"))
            terms.remove(t)
        else:
            rows.append((step, r[0], r[1], r[4], r[5], "keep all"))
            break
    return fit_from_gram(d, g, terms), spark.createDataFrame(rows, STEP_SCHEMA)


def numeric_means(fit: OLSFit) -> dict[str, float]:
    """Means of the numeric variables that are main-effect columns."""
    out = {}
    for i, c in enumerate(fit.design.columns):
        parts = fit.design.column_parts[c]
        if len(parts) == 1 and parts[0][1] is None:
            out[parts[0][0]] = float(fit.gram.means[i + 1])
    return out


def grid_rows(fit: OLSFit, fixed: Mapping[str, object]) -> list[dict]:
    """Reference grid: every combination of the model's factor levels, with
    numeric variables at ``fixed`` or their means."""
    d = fit.design
    used = [v for v in d.variables if v in d.factors]
    means = numeric_means(fit)
    rows = [dict()]
    for v in used:
        levels = [fixed[v]] if v in fixed else d.factors[v]
        rows = [dict(r, **{v: lv}) for r in rows for lv in levels]
    for v in d.variables:
        if v not in d.factors:
            for r in rows:
                r[v] = fixed.get(v, means.get(v, 0.0))
    return rows


def averaged_vector(fit: OLSFit, fixed: Mapping[str, object]) -> np.ndarray:
    """Equal-weight average of design rows over the grid (emmeans' rule)."""
    rows = grid_rows(fit, fixed)
    return np.mean([row_vector(fit.design, r) for r in rows], axis=0)


def estimate(fit: OLSFit, L: np.ndarray) -> tuple[float, float]:
    """L'b and its standard error (aliased coefficients count as 0)."""
    b = fit.beta0()
    cov = np.nan_to_num(fit.cov)
    return float(L @ b), float(np.sqrt(max(L @ cov @ L, 0.0)))


SCREEN_SCHEMA = StructType([StructField("variable", StringType()), StructField("F", DoubleType()),
                            StructField("df", LongType()), StructField("p_value", DoubleType()),
                            StructField("contrast", StringType()),
                            StructField("estimate", DoubleType()), StructField("se", DoubleType()),
                            StructField("lb", DoubleType()), StructField("ub", DoubleType())])


def screen_covariates(spark: SparkSession, df: DataFrame | None, y: str, design: Design,
                      base_terms: Sequence[Term], candidates: Sequence[str], factor: str | None = None,
                      levels: tuple[str, str] | None = None, fit=None) -> DataFrame:
    """Added-variable screen. ``design`` must contain ``base_terms`` and a
    main-effect term for every candidate. ONE Spark pass builds the Gram of
    all columns; per candidate, the F test of adding it to the base model
    and the ``levels[0] - levels[1]`` contrast of ``factor`` at the means (none
    without a factor). With ``fit``, a fit of ``design``, no data are read: an OLS
    fit gives its Gram; a mixed fit is refitted for every candidate, variances
    included, from the sums it holds of all columns."""
    refit = getattr(fit, "refit", None)
    g = None if refit else linear_part(fit).gram if fit is not None else gram(df, y, design)
    rows = []
    for c in candidates:
        terms = [*base_terms, (c,)]
        own = refit(terms) if refit else fit_from_gram(design, g, terms)
        base, full = solve(own.gram, _columns_of(design, base_terms)), solve(own.gram, _columns_of(design, terms))
        r = _f_row(c, base["rss"] - full["rss"], full["rank"] - base["rank"], full, own.gram)
        contrast = (None,) * 5
        if factor is not None:
            means = numeric_means(own)
            fixed = {v: means.get(v, 0.0) for v in design.variables if v not in design.factors}
            la, lb = (averaged_vector(own, dict(fixed, **{factor: lv})) for lv in levels)
            est, se = estimate(own, la - lb)
            q = float(t_ppf(0.975, own.df_resid))
            contrast = (f"{levels[0]} - {levels[1]}", est, se, est - q * se, est + q * se)
        rows.append((c, r[4], r[1], r[5], *contrast))
    return spark.createDataFrame(rows, SCREEN_SCHEMA)


CURVE_SCHEMA = StructType([StructField("x", DoubleType()), StructField("fit", DoubleType()),
                           StructField("se", DoubleType()), StructField("lower", DoubleType()),
                           StructField("upper", DoubleType())])


def effect_curve(spark: SparkSession, fit: OLSFit, var: str, values: Sequence[float],
                 fixed: Mapping[str, object] | None = None) -> DataFrame:
    """Prediction over a covariate grid, other factors averaged with equal
    weights, numeric variables at their means; normal 95 % band."""
    fit = linear_part(fit)
    fixed = dict(fixed or {})
    rows = []
    for x in values:
        L = averaged_vector(fit, dict(fixed, **{var: float(x)}))
        est, se = estimate(fit, L)
        rows.append((float(x), est, se, est - Z975 * se, est + Z975 * se))
    return spark.createDataFrame(rows, CURVE_SCHEMA)


def covariate_grid(df: DataFrame, var: str, points: int = 11) -> list[float]:
    """``points`` equally spaced values from min to max of ``var`` (one agg)."""
    lo, hi = df.agg(F.min(var), F.max(var)).first()
    if lo is None:
        return []
    return [float(lo + (hi - lo) * i / (points - 1)) for i in range(points)]


def two_sided_normal_p(z: float) -> float:
    return float(min(1.0, 2 * norm_sf(abs(z))))
