"""Random-intercept models by the method of moments.

The reference fits REML on one machine. Here ONE aggregate over the rows gives
the moments of every (factor cell, group combination); the Gram, the sums per
group and the counts per pair of groups are sums of those, and everything after
runs on them. Variances are Henderson-type moment estimates for crossed/nested
random intercepts (see Gao & Owen 2017; Ghosh, Hastie & Owen 2022).

With residuals r from the OLS fixed part, for factor k with groups g:

    U_k = sum r^2 - sum_g S_g^2 / n_g,              S_g = sum of r in g
    E[U_k] = sum_{j != k} s_j^2 (N - sum_g sum_h n_gh^2 / n_g) + s_e^2 (N - G_k)
    U_0 = sum r^2 - (sum r)^2 / N
    E[U_0] = sum_j s_j^2 (N - sum_h n_jh^2 / N) + s_e^2 (N - 1)

Negative solutions are clipped at 0 (the reference's "singular fit").
Given the variances, the fixed effects are generalised least squares and the
group effects their best linear predictors, both from Henderson's mixed-model
equations: with W = Z'Z + diag(s_e^2 / s_k^2), the weighted Gram is
X'X - X'Z W^-1 Z'X, and the effects are W^-1 (Z'y - Z'X b). So standard errors,
tests and means of a mixed fit are those of the random-intercept model.
Up to ``MAX_GROUP_LEVELS`` levels W is factored on the driver; beyond, the levels
stay in Spark and W is solved by conjugate gradients (``mixed_solver``).
Numbers differ from REML on unbalanced data; they agree on balanced data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from eventlab.functions.distributions import with_normal_quantile
from eventlab.operators.design import Design, Term, model_rows
from eventlab.operators.linear import (
    Gram,
    OLSFit,
    columns_on,
    factors_of,
    fit_from_gram,
    gram_from_cells,
    merge_cells,
    moment_aggs,
    monomial_of,
    monomials,
    predict_expr,
)
from eventlab.operators.mixed_solver import LevelTables, level_effects, level_moments, level_tables, weighted_sums
from eventlab.sources.files import stage

#: Levels of all group factors together (the mixed-model equations have one row for
#: each) up to which they are solved on the driver.
MAX_GROUP_LEVELS = 4_000


@dataclass
class GroupSums:
    """What the mixed-model equations need of the data."""
    gram: Gram
    levels: dict[str, list]               # group factor -> its values
    n: dict[str, np.ndarray]              # rows per level
    zx: dict[str, np.ndarray]             # sums of the Gram's (centred) columns per level
    zy: dict[str, np.ndarray]             # sums of y less its mean per level
    pairs: dict[tuple[str, str], np.ndarray]   # rows per pair of levels


@dataclass
class MixedFit:
    design: Design
    fixed: OLSFit                         # generalised least squares, on the weighted Gram
    groups: list[str]
    variances: dict[str, float]           # per group factor, plus "Residual"
    effects: dict[str, DataFrame]         # group factor -> (group value, n, effect, se)
    rows: DataFrame                       # the model's rows, all columns of the input
    y: str
    sums: GroupSums | LevelTables
    cells: DataFrame                      # moments per factor cell and group combination, staged

    def refit(self, terms: Sequence[Term]) -> OLSFit:
        """The fixed part with only ``terms``, after the variances are estimated
        again for them; from the sums, with no pass over the rows."""
        var = estimate_variances(self.sums, fit_from_gram(self.design, self.sums.gram, terms))
        return weighted_fit(self.design, self.sums, var, terms)[0]

    def fitted_expr(self):
        """Fixed part plus the effects joined as ``_b_<group>``."""
        expr = predict_expr(self.fixed, self.design)
        for g in self.groups:
            expr = expr + F.coalesce(F.col(f"_b_{g}"), F.lit(0.0))
        return expr


def _solve_clipped(A: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Solve A s = u with s >= 0: clip the most negative and re-solve the
    rest (least squares) until all are non-negative."""
    free = list(range(len(u)))
    s = np.zeros(len(u))
    while free:
        sol, *_ = np.linalg.lstsq(A[:, free], u, rcond=None)
        if (sol >= 0).all():
            s[free] = sol
            return s
        worst = free[int(np.argmin(sol))]
        free.remove(worst)
    return s


def group_sums(rows: DataFrame, y: str, design: Design, groups: Sequence[str]) -> tuple[GroupSums | LevelTables, DataFrame]:
    """ONE aggregate over the rows; the rest are sums of its cells, which are
    staged and come second. Only sums per factor cell, and with few levels per (level, factor
    cell) and per pair of levels, reach the driver."""
    factors = factors_of(design)
    keys = list(dict.fromkeys([*factors, *groups]))
    cells = stage(rows.groupBy(*keys).agg(*moment_aggs(y, design)), "mixed-cells")
    found = sum(cells.agg(*[F.count_distinct(g).alias(g) for g in groups]).first()) if groups else 0
    by_factors = merge_cells(cells, factors, design) if len(keys) > len(factors) and factors else None
    if by_factors is None:
        by_factors = cells if not groups else merge_cells(cells.withColumn("_all", F.lit(1)), ["_all"], design)
    g = gram_from_cells(design, by_factors.collect())
    if found > MAX_GROUP_LEVELS:
        return level_tables(cells, design, groups, g), cells
    monos = monomials(design)
    mono_of = [monos.index(monomial_of(design, c)) for c in [None, *design.columns]]
    wanted = sorted(set(mono_of))
    total = [F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_b")).alias("_sy"),
             *[F.sum(F.col("_n") * F.col(f"_a_{m}")).alias(f"_s_{m}") for m in wanted]]
    out = GroupSums(g, {}, {}, {}, {}, {})
    for k in groups:
        per = cells.groupBy(*dict.fromkeys([k, *factors])).agg(*total).collect()
        levels = sorted({r[k] for r in per})
        at = {v: i for i, v in enumerate(levels)}
        n, zy, zx = np.zeros(len(levels)), np.zeros(len(levels)), np.zeros((len(levels), len(g.names)))
        for r in per:
            i = at[r[k]]
            n[i] += r["_n"]
            zy[i] += r["_sy"]
            zx[i] += [r[f"_s_{m}"] if on else 0.0 for m, on in zip(mono_of, columns_on(design, r))]
        zx[:, 1:] -= np.outer(n, g.xbar[1:])
        out.levels[k], out.n[k], out.zy[k], out.zx[k] = levels, n, zy - n * g.ybar, zx
    for i, a in enumerate(groups):
        for b in groups[i + 1:]:
            count = np.zeros((len(out.levels[a]), len(out.levels[b])))
            at_a, at_b = ({v: i for i, v in enumerate(out.levels[x])} for x in (a, b))
            for r in cells.groupBy(a, b).agg(F.sum("_n").alias("_n")).collect():
                count[at_a[r[a]], at_b[r[b]]] = r["_n"]
            out.pairs[a, b] = count
    return out, cells


def centred_beta(fit: OLSFit) -> np.ndarray:
    """Coefficients for the centred columns and response."""
    b, g = fit.beta0(), fit.gram
    return np.concatenate([[b[0] - g.ybar + g.xbar[1:] @ b[1:]], b[1:]])


def moment_equations(sums: GroupSums | LevelTables, ols: OLSFit) -> tuple[np.ndarray, np.ndarray]:
    """The (K+1) x (K+1) moment system of the OLS residuals."""
    groups, beta = list(sums.levels), centred_beta(ols)
    if isinstance(sums, LevelTables):
        own, cross = level_moments(sums, beta)
    else:
        own, cross = [], {}
        for k, a in enumerate(groups):
            s = sums.zy[a] - sums.zx[a] @ beta
            own.append((float((s * s / sums.n[a]).sum()), len(sums.n[a]), float((sums.n[a] ** 2).sum())))
            for j, b in enumerate(groups):
                if j != k:
                    count = sums.pairs[a, b] if k < j else sums.pairs[b, a].T
                    cross[k, j] = float(((count ** 2).sum(1) / sums.n[a]).sum())
    return moment_system(own, cross, float(sums.gram.n), ols.rss)


def moment_system(own: Sequence[tuple], cross: Mapping[tuple[int, int], float], n: float, ss: float) -> tuple[np.ndarray, np.ndarray]:
    """The moment equations from, per factor, (sum of s^2 / n, levels, sum of n^2)
    and, per pair of factors, the sum of n_gh^2 / n_g; ``ss`` is the residuals' sum
    of squares about their mean."""
    K = len(own)
    u, A = np.zeros(K + 1), np.zeros((K + 1, K + 1))
    u[0] = ss
    A[0, K] = n - 1
    for k, (between, levels, squares) in enumerate(own):
        u[k + 1] = ss - between
        A[k + 1, K] = n - levels
        A[0, k] = n - squares / n
        for j in range(K):
            if j != k:
                A[k + 1, j] = n - cross[k, j]
    return A, u


def estimate_variances(sums: GroupSums | LevelTables, ols: OLSFit) -> dict[str, float]:
    """H6: moment estimates, no further pass over the data."""
    s = _solve_clipped(*moment_equations(sums, ols))
    out = {g: float(s[k]) for k, g in enumerate(sums.levels)}
    return out | {"Residual": float(s[-1])}


def _weighted_levels(design: Design, sums: LevelTables, var: dict[str, float], terms: Sequence[Term] | None
                     ) -> tuple[OLSFit, Callable[[str, str], DataFrame]]:
    g, se2 = sums.gram, var["Residual"]
    ridge = {i: se2 / var[k] for i, k in enumerate(sums.levels) if var[k] > 0 and se2 > 0}
    solved, weighted = None, replace(g, scale=se2 or None)
    if ridge:
        solved, part = weighted_sums(sums, ridge)
        part = (part + part.T) / 2
        weighted = replace(g, xtx=g.xtx - part[:-1, :-1], xty=g.xty - part[:-1, -1], yty=float(g.yty - part[-1, -1]), scale=se2)
    fit = fit_from_gram(design, weighted, terms)
    return fit, lambda group, kind: level_effects(sums, solved, group, kind, centred_beta(fit), se2, ridge)


def weighted_fit(design: Design, sums: GroupSums | LevelTables, var: dict[str, float], terms: Sequence[Term] | None = None):
    """Generalised least squares (of ``terms``, all by default) from the mixed-model
    equations, and the predicted effects with their conditional standard errors:
    arrays per group factor, or with many levels a function that gives a table."""
    if isinstance(sums, LevelTables):
        return _weighted_levels(design, sums, var, terms)
    g, se2 = sums.gram, var["Residual"]
    active = [k for k in sums.levels if var[k] > 0 and se2 > 0]
    effects = {k: (np.zeros(len(v)), np.zeros(len(v))) for k, v in sums.levels.items()}
    if not active:
        fit = fit_from_gram(design, replace(g, scale=se2 or None), terms)
        return fit, effects
    # the factor with most levels has a diagonal block, which is eliminated first
    active.sort(key=lambda k: -len(sums.levels[k]))
    block = lambda a, b: (np.diag(sums.n[a] + se2 / var[a]) if a == b else
                          sums.pairs[a, b] if (a, b) in sums.pairs else sums.pairs[b, a].T)
    big, rest = active[0], active[1:]
    d = sums.n[big] + se2 / var[big]
    z_big, z_rest = (np.vstack([np.column_stack([sums.zx[a], sums.zy[a]]) for a in part] or [np.zeros((0, len(g.names) + 1))])
                     for part in ([big], rest))
    if rest:
        c = np.hstack([block(big, b) for b in rest])
        s_inv = np.linalg.inv(np.block([[block(a, b) for b in rest] for a in rest]) - c.T @ (c / d[:, None]))
        top = s_inv @ (z_rest - c.T @ (z_big / d[:, None]))
        half = c / d[:, None]
        diag = np.concatenate([1 / d + ((half @ s_inv) * half).sum(1), np.diag(s_inv)])
        solved = np.vstack([(z_big - c @ top) / d[:, None], top])
    else:
        diag, solved = 1 / d, z_big / d[:, None]
    z = np.vstack([z_big, z_rest])
    zx, zy, wx, wy = z[:, :-1], z[:, -1], solved[:, :-1], solved[:, -1]
    weighted = replace(g, xtx=g.xtx - zx.T @ wx, xty=g.xty - zx.T @ wy,
                       yty=float(g.yty - zy @ wy), scale=se2)
    fit = fit_from_gram(design, weighted, terms)
    b = wy - wx @ centred_beta(fit)
    sd = np.sqrt(se2 * diag)
    at = 0
    for a in active:
        m = len(sums.levels[a])
        effects[a] = (b[at:at + m], sd[at:at + m])
        at += m
    return fit, effects


def fit_random_intercepts(df: DataFrame, y: str, design: Design, groups: Sequence[str], keep_rows: bool = False) -> MixedFit:
    """H6: fixed effects from ``design`` plus random intercepts for each
    column in ``groups`` (composite groups are plain concatenated columns).
    Rows with a NULL among them, or a factor at an undeclared level, are
    dropped. With ``keep_rows`` the rows are staged, so that what reads them after
    the fit does not make them again."""
    groups = list(groups)
    rows = model_rows(df, design, [y, *groups])
    if keep_rows:
        rows = stage(rows, "mixed-rows")
    sums, cells = group_sums(rows, y, design, groups)
    var = estimate_variances(sums, fit_from_gram(design, sums.gram))
    fixed, found = weighted_fit(design, sums, var)
    effects = {}
    for g in groups:
        if isinstance(sums, LevelTables):
            effects[g] = found(g, df.schema[g].dataType.simpleString())
            continue
        schema = StructType([StructField(g, df.schema[g].dataType), StructField("n", LongType()),
                             StructField("effect", DoubleType()), StructField("se", DoubleType())])
        data = [(v, int(n), float(e), float(s)) for v, n, e, s in zip(sums.levels[g], sums.n[g], *found[g])]
        effects[g] = df.sparkSession.createDataFrame(data, schema)
    return MixedFit(design, fixed, groups, var, effects, rows, y, sums, cells)


VC_SCHEMA = StructType([StructField("component", StringType()), StructField("variance", DoubleType()),
                        StructField("sd", DoubleType())])


def variance_table(spark: SparkSession, fit: MixedFit) -> DataFrame:
    rows = [(k, v, math.sqrt(v)) for k, v in fit.variances.items()]
    return spark.createDataFrame(rows, VC_SCHEMA)


R2_SCHEMA = StructType([StructField("var_fixed", DoubleType()), StructField("var_random", DoubleType()),
                        StructField("var_residual", DoubleType()), StructField("icc", DoubleType()),
                        StructField("r2_marginal", DoubleType()),
                        StructField("r2_conditional", DoubleType())])


def icc_r2(spark: SparkSession, fit: MixedFit) -> DataFrame:
    """H7: adjusted ICC and Nakagawa marginal / conditional R^2; the variance
    of the fixed part's predictions comes from the Gram."""
    g, b = fit.sums.gram, fit.fixed.beta0()[1:]
    vf = float(b @ g.xtx[1:, 1:] @ b / g.n)
    vr = sum(v for k, v in fit.variances.items() if k != "Residual")
    ve = fit.variances["Residual"]
    tot = vf + vr + ve
    icc = vr / (vr + ve) if vr + ve > 0 else None
    return spark.createDataFrame([(float(vf), vr, ve, icc, vf / tot if tot else None,
                                   (vf + vr) / tot if tot else None)], R2_SCHEMA)


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Rank 1..n by ``order`` without a global window: rows are range
    partitioned (rows that tie in the first column are split by the others),
    sorted there and written with their place in the partition; the partitions'
    counts then give each one's offset. One shuffle and one write in all."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(max(2, parts), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged = stage(ranged.withColumn("_id", place), "ranked")
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for p, n in counts:                                          # one row per partition
        offsets.append((p, before))
        before += n
    off = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    return (ranged.withColumn("_part", part).join(F.broadcast(off), "_part")
            .withColumn(out, F.col("_offset") + local + 1).drop("_part", "_offset", "_id"))


def normal_scores(df: DataFrame, col: str, out: str = "theoretical", tiebreak: Sequence[str] = ()) -> DataFrame:
    """QQ scores: z = qnorm(ppoints(n))[rank(x)], with an exact global rank;
    equal values are ranked by ``tiebreak``."""
    return _scores(global_rank(df.withColumn(col, F.col(col).cast("double")), [col, *tiebreak], "_rank"), out)


def _scores(ranked: DataFrame, out: str) -> DataFrame:
    """The normal scores of the column ``_rank``, in its place."""
    n = ranked.count()
    a = 0.375 if n <= 10 else 0.5
    return with_normal_quantile(ranked, (F.col("_rank") - F.lit(a)) / F.lit(n + 1 - 2 * a), out).drop("_rank")


def diagnostics(fit: MixedFit, ids: Sequence[str] = ()) -> DataFrame:
    """Fitted (fixed + group effects), residual, standardised residual,
    normal QQ score and, with ``ids``, the row's index in their order."""
    cur = fit.rows.select(*dict.fromkeys([*ids, fit.y, *fit.design.variables, *fit.groups]))
    few = not isinstance(fit.sums, LevelTables)      # at most MAX_GROUP_LEVELS rows
    for g, eff in fit.effects.items():
        part = eff.select(g, F.col("effect").alias(f"_b_{g}"))
        cur = cur.join(F.broadcast(part) if few else part, g, "left")
    sd = math.sqrt(fit.variances["Residual"]) if fit.variances["Residual"] > 0 else float("nan")
    out = (cur.withColumn("fitted", fit.fitted_expr())
           .withColumn("resid", F.col(fit.y) - F.col("fitted"))
           .withColumn("std_resid", F.col("resid") / F.lit(sd)))
    names = [*dict.fromkeys([*ids, *fit.groups]), "fitted", "resid", "std_resid"]
    ranked = global_rank(out.select(*names), ["resid", *ids], "_rank")
    if ids:
        ranked = global_rank(ranked, list(ids), "index")
    # scores come last: a range partition computes what it is given twice, to find its bounds and to deal the rows
    return _scores(ranked, "theoretical").select(*names, "theoretical", *(["index"] if ids else []))


RANEF_SCHEMA = StructType([StructField("factor", StringType()), StructField("group", StringType()),
                           StructField("n", LongType()), StructField("effect", DoubleType()),
                           StructField("se", DoubleType()), StructField("lower", DoubleType()),
                           StructField("upper", DoubleType())])


def random_effects(fit: MixedFit) -> DataFrame:
    """Group effects with +/- 1.96 se (caterpillar data), all factors."""
    parts = []
    for g, eff in fit.effects.items():
        parts.append(eff.select(F.lit(g).alias("factor"), F.col(g).cast("string").alias("group"),
                                F.col("n").cast("long").alias("n"), "effect", "se",
                                (F.col("effect") - 1.96 * F.col("se")).alias("lower"),
                                (F.col("effect") + 1.96 * F.col("se")).alias("upper")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
