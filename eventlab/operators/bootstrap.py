"""H6/H7: intervals of variance components by a Poisson bootstrap over groups.

In replicate b every level of every group factor is drawn a Poisson(1) number of
times, by a hash of (seed, b, factor, level); a row counts as often as the product
of its levels' draws (the pigeonhole bootstrap for crossed factors). The copies of
a level are groups of their own. All replicates come from one table, the residual
moments of the group combinations, exploded over the replicates and summed per
level; the moment equations of each replicate are solved on the driver, (K+1) x
(K+1) for K factors. Equal seeds give equal draws, whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.operators.linear import OLSFit, fit_from_gram, indicator_of, monomial_of, monomials
from eventlab.operators.mixed import MixedFit, _solve_clipped, moment_system
from eventlab.sources.files import stage

#: Draws above the largest threshold have a probability below 1e-12.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])


def poisson_draw(seed: int, replicate: Column, factor: int, level: Column) -> Column:
    """A Poisson(1) draw as a column, fixed by its arguments."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), replicate, F.lit(factor), level.cast("string")), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return sum(((u >= F.lit(float(c))).cast("int") for c in _POISSON), F.lit(0))


def residual_moments(fit: MixedFit, ols: OLSFit) -> DataFrame:
    """Per group combination: rows, sum and sum of squares of the OLS residuals,
    from the model's cells."""
    d, beta = ols.design, ols.beta0()
    monos = monomials(d)
    weight = [F.lit(0.0)] * len(monos)
    for name, b in zip([None, *d.columns], beta):
        on = F.lit(True)
        for v, lvl in indicator_of(d, name).items():
            on = on & (F.col(v) == F.lit(lvl))
        m = monos.index(monomial_of(d, name))
        weight[m] = weight[m] + F.when(on, F.lit(float(b))).otherwise(0.0)
    mean = F.col("_b") - sum((w * F.col(f"_a_{i}") for i, w in enumerate(weight)), F.lit(0.0))
    spread = F.col("_e")
    for i, w in enumerate(weight):
        spread = spread - 2 * w * F.col(f"_d_{i}")
        for j in range(len(monos)):
            spread = spread + w * weight[j] * F.col(f"_c_{min(i, j)}_{max(i, j)}")
    n = F.col("_n").cast("double")
    return fit.cells.groupBy(*fit.groups).agg(F.sum(n).alias("n"), F.sum(n * mean).alias("s"), F.sum(spread + n * mean * mean).alias("ss"))


def replicate_variances(fit: MixedFit, replicates: int = 200, seed: int = 1) -> dict[str, np.ndarray]:
    """The variances of every replicate, per component."""
    groups, k = list(fit.groups), len(fit.groups)
    ols = fit_from_gram(fit.design, fit.sums.gram)
    w = [F.col(f"_w{i}") for i in range(k)]
    rows = residual_moments(fit, ols).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumns({f"_w{i}": poisson_draw(seed, F.col("_r"), i, F.col(g)) for i, g in enumerate(groups)})
    for x in w:
        rows = rows.where(x > 0)
    rows = stage(rows, "replicates")

    def but(*left: int) -> Column:
        """The product of the other factors' draws."""
        out = F.lit(1.0)
        for i, x in enumerate(w):
            if i not in left:
                out = out * x
        return out

    every = F.lit(1.0) * but()
    total = {r["_r"]: r for r in rows.groupBy("_r").agg(F.sum(every * F.col("n")).alias("n"), F.sum(every * F.col("s")).alias("s"),
                                                        F.sum(every * F.col("ss")).alias("ss")).collect()}
    own, cross = [], {}
    sizes = []
    for i, g in enumerate(groups):
        per = rows.groupBy("_r", g).agg(F.first(w[i]).alias("w"), F.sum(but(i) * F.col("n")).alias("n"), F.sum(but(i) * F.col("s")).alias("s"))
        sizes.append(per.select("_r", g, F.col("n").alias("ng")))
        own.append({r["_r"]: r for r in per.groupBy("_r").agg(
            F.sum(F.col("w") * F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("w").alias("g"),
            F.sum(F.col("w") * F.col("n") * F.col("n")).alias("n2")).collect()})
    for i, a in enumerate(groups):
        for j, b in enumerate(groups):
            if i != j:
                both = rows.groupBy("_r", a, b).agg(F.first(w[i] * w[j]).alias("w"), F.sum(but(i, j) * F.col("n")).alias("n"))
                found = both.join(sizes[i], ["_r", a]).groupBy("_r").agg(F.sum(F.col("w") * F.col("n") * F.col("n") / F.col("ng")).alias("c"))
                cross[i, j] = {r["_r"]: r["c"] for r in found.collect()}
    out = []
    for r in sorted(total):
        t = total[r]
        u = [(o[r]["b"] - t["s"] ** 2 / t["n"], o[r]["g"], o[r]["n2"]) for o in own]      # about the replicate's mean
        a, rhs = moment_system(u, {p: c[r] for p, c in cross.items()}, t["n"], t["ss"] - t["s"] ** 2 / t["n"])
        out.append(_solve_clipped(a, rhs))
    found = np.array(out).reshape(-1, k + 1)
    return {name: found[:, i] for i, name in enumerate([*groups, "Residual"])}


def variance_intervals(fit: MixedFit, replicates: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(component, variance, se, lower, upper): percentile intervals; ``se`` is the
    replicates' standard deviation. Rows for each component, ICC last."""
    drawn = replicate_variances(fit, replicates, seed)
    random = sum((drawn[g] for g in fit.groups), np.zeros(len(drawn["Residual"])))
    all_of = random + drawn["Residual"]
    drawn["ICC"] = np.divide(random, all_of, out=np.zeros_like(random), where=all_of > 0)
    vr = sum(fit.variances[g] for g in fit.groups)
    given = dict(fit.variances) | {"ICC": vr / (vr + fit.variances["Residual"]) if vr + fit.variances["Residual"] > 0 else 0.0}
    tail = (1 - level) / 2
    rows = [(c, float(given[c]), float(x.std(ddof=1)), float(np.quantile(x, tail)), float(np.quantile(x, 1 - tail)))
            for c, x in drawn.items() if len(x) > 1]
    return fit.rows.sparkSession.createDataFrame(rows, "component string, variance double, se double, lower double, upper double")
