"""Student t and normal quantiles / tails.

Spark SQL has no t or normal inverse. Two forms are given:

* ``t_quantile_975(df)`` -- a pure Catalyst expression (codegen, no Python):
  an exact table for df <= 30 and the 4-term Cornish-Fisher series in 1/df
  above (abs. error < 4e-8 at df = 31, falling as df grows). The DuckDB
  oracle uses the same table and series, so both sides agree.
* ``t_quantile_udf`` / ``t_sf_udf`` / ``norm_*`` -- Arrow pandas UDFs with
  exact numerics, meant for **aggregated** rows only (one row per group).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Two-sided 95 % Student t quantiles t(0.975, df), df = 1..30.
T975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836,
    2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546,
    2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553,
    2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)
Z975 = 1.959963984540054  # standard normal 0.975 quantile


def _cornish_fisher(z, nu):
    """t quantile from the normal quantile z, series in 1/nu (4 terms)."""
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0
    return z + g1 / nu + g2 / nu ** 2 + g3 / nu ** 3 + g4 / nu ** 4


def t_quantile_975(df: Column | str) -> Column:
    """t(0.975, df) as a Catalyst expression; NULL for df < 1 or NULL."""
    d = F.col(df) if isinstance(df, str) else df
    table = F.array(*[F.lit(v) for v in T975])
    nu = d.cast("double")
    series = _cornish_fisher(F.lit(Z975), nu)
    return (F.when(d.isNull() | (d < 1), F.lit(None).cast("double"))
            .when(d <= len(T975), F.element_at(table, d.cast("int")))
            .otherwise(series))


def t_quantile_975_sql(df_expr: str) -> str:
    """The same rule as DuckDB SQL text (for oracles)."""
    table = "CAST([" + ", ".join(repr(v) for v in T975) + "] AS DOUBLE[])"
    z = f"CAST({Z975!r} AS DOUBLE)"
    nu = f"CAST({df_expr} AS DOUBLE)"
    series = (f"({z} + ({z}^3 + {z})/4.0/{nu} + (5*{z}^5 + 16*{z}^3 + 3*{z})/96.0/({nu}^2)"
              f" + (3*{z}^7 + 19*{z}^5 + 17*{z}^3 - 15*{z})/384.0/({nu}^3)"
              f" + (79*{z}^9 + 776*{z}^7 + 1482*{z}^5 - 1920*{z}^3 - 945*{z})/92160.0/({nu}^4))")
    return (f"(CASE WHEN {df_expr} IS NULL OR {df_expr} < 1 THEN NULL "
            f"WHEN {df_expr} <= {len(T975)} THEN {table}[CAST({df_expr} AS INTEGER)] "
            f"ELSE {series} END)")


# ---------------------------------------------------------------- numpy side

def _betacf(a, b, x, iters=300):
    """Continued fraction for the incomplete beta (modified Lentz), vectorised."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc_reg(a, b, x):
    """Regularised incomplete beta I_x(a, b) for arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lbt = _lgamma(am + bm) - _lgamma(am) - _lgamma(bm) + am * np.log(xm) + bm * np.log1p(-xm)
        bt = np.exp(lbt)
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = bt[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        if (~direct).any():
            nd = ~direct
            res[nd] = 1.0 - bt[nd] * _betacf(bm[nd], am[nd], 1.0 - xm[nd]) / bm[nd]
        out[mid] = res
    return out


def t_sf(t, df):
    """Upper tail P(T > t) for Student t with ``df`` degrees of freedom."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    x = df / (df + t * t)
    half = 0.5 * betainc_reg(df / 2.0, 0.5, x)
    return np.where(t >= 0, half, 1.0 - half)


def norm_sf(z):
    z = np.asarray(z, dtype=float)
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2.0))


def norm_ppf(p):
    """Normal quantile: Acklam's rational start refined by Newton steps."""
    p = np.asarray(p, dtype=float)
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    plow = 0.02425
    q = np.where(p < 0.5, p, 1 - p)
    r_tail = np.sqrt(-2 * np.log(np.clip(q, 1e-300, None)))
    tail = (((((c[0] * r_tail + c[1]) * r_tail + c[2]) * r_tail + c[3]) * r_tail + c[4]) * r_tail + c[5]) / \
           ((((d[0] * r_tail + d[1]) * r_tail + d[2]) * r_tail + d[3]) * r_tail + 1)
    qc = p - 0.5
    r = qc * qc
    central = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * qc / \
              (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    x = np.where(q < plow, np.where(p < 0.5, tail, -tail), central)
    for _ in range(2):      # the smaller tail keeps its digits
        e = np.where(p < 0.5, norm_sf(-x) - p, (1.0 - p) - norm_sf(x))
        x = x - e * math.sqrt(2 * math.pi) * np.exp(x * x / 2.0)
    return np.where((p > 0) & (p < 1), x, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


# Rational approximations of the normal quantile (Wichura, AS 241, 16 digits);
# numerator and denominator, lowest power first, for the centre, the tails and the far tails.
NORMAL_QUANTILE = {
    "centre": ((3.3871328727963666080e0, 1.3314166789178437745e+2, 1.9715909503065514427e+3, 1.3731693765509461125e+4,
                4.5921953931549871457e+4, 6.7265770927008700853e+4, 3.3430575583588128105e+4, 2.5090809287301226727e+3),
               (1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
                2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4, 5.2264952788528545610e+3)),
    "tail": ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
              1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
             (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
              1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    "far": ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
             2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
            (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
             7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
}


def _horner(coefs, x):
    out = coefs[-1] + 0.0 * x
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def normal_quantile(p):
    """Normal quantile of a probability column, as a Catalyst expression."""
    q = p - F.lit(0.5)
    return _quantile(q, F.lit(0.180625) - q * q, F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p))))


def _quantile(q, near, r):
    def ratio(part, x):
        top, bottom = NORMAL_QUANTILE[part]
        return _horner([F.lit(c) for c in top], x) / _horner([F.lit(c) for c in bottom], x)

    tail = F.when(r <= 5.0, ratio("tail", r - F.lit(1.6))).otherwise(ratio("far", r - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * ratio("centre", near)).otherwise(F.signum(q) * tail)


def with_normal_quantile(df, p, out: str):
    """``df`` with the same quantile of ``p`` as the column ``out``. What the polynomials
    are taken of are columns: as one expression, roots and logarithms stand in
    every term and the code is too long for Java to compile."""
    df = df.withColumn("_p", p).withColumn("_q", F.col("_p") - F.lit(0.5))
    df = df.withColumns({"_near": F.lit(0.180625) - F.col("_q") * F.col("_q"), "_r": F.sqrt(-F.ln(F.least("_p", F.lit(1.0) - F.col("_p"))))})
    return df.withColumn(out, _quantile(F.col("_q"), F.col("_near"), F.col("_r"))).drop("_p", "_q", "_near", "_r")


def normal_quantile_sql(p: str) -> str:
    """DuckDB text of the same expression."""
    def poly(coefs, x):
        out = repr(coefs[-1])
        for c in reversed(coefs[:-1]):
            out = f"({out} * {x} + {c!r})"
        return out

    def ratio(part, x):
        top, bottom = NORMAL_QUANTILE[part]
        return f"{poly([float(c) for c in top], x)} / {poly([float(c) for c in bottom], x)}"

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    near, t, f_ = f"(0.180625 - {q} * {q})", f"({r} - 1.6)", f"({r} - 5.0)"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio('centre', near)} "
            f"ELSE sign({q}) * CASE WHEN {r} <= 5.0 THEN {ratio('tail', t)} ELSE {ratio('far', f_)} END END")


def t_ppf(p, df):
    """Student t quantile: the smaller tail is bracketed, then bisected."""
    p = np.asarray(p, dtype=float)
    df = np.asarray(df, dtype=float)
    p, df = np.broadcast_arrays(p, df)
    tail = np.clip(np.minimum(p, 1.0 - p), 1e-300, 0.5)
    lo, hi = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(1100):
        short = t_sf(hi, df) > tail
        if not short.any():
            break
        lo, hi = np.where(short, hi, lo), np.where(short, 2 * hi, hi)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        more = t_sf(mid, df) > tail
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
        if np.all(hi - lo <= 1e-15 * hi):
            break
    out = np.where(p == 0.5, 0.0, np.sign(p - 0.5) * 0.5 * (lo + hi))
    return np.where((df > 0) & (p > 0) & (p < 1), out, np.nan)


@F.pandas_udf(DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    """Exact t quantile, for aggregated rows."""
    return pd.Series(t_ppf(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_two_sided_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value 2 * P(T > |t|), for aggregated rows."""
    tv = np.abs(t.to_numpy(float))
    return pd.Series(np.minimum(1.0, 2.0 * t_sf(tv, df.to_numpy(float))))


@F.pandas_udf(DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution, for aggregated rows."""
    return pd.Series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_two_sided_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series(np.minimum(1.0, 2.0 * norm_sf(np.abs(z.to_numpy(float)))))


def f_sf(f, d1, d2):
    """P(F > f) for the F(d1, d2) distribution."""
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    x = d2 / (d2 + d1 * f)
    return np.where(f > 0, betainc_reg(d2 / 2.0, d1 / 2.0, x), 1.0)


def studentized_range_sf(q, k: int, df: float = math.inf) -> np.ndarray:
    """P(Q > q) for the studentized range of ``k`` means with ``df`` degrees of
    freedom of the error (infinite: known variance), by Gauss-Legendre sums."""
    q = np.atleast_1d(np.asarray(q, dtype=float))
    x, w = np.polynomial.legendre.leggauss(200)
    z, wz = 8.5 * x, 8.5 * w                       # the largest mean's place
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = 1.0 - norm_sf(z)

    def known(width):
        """P(range <= width) of k standard normal values."""
        inside = np.clip(cdf - (1.0 - norm_sf(z - width[:, None])), 0.0, 1.0)
        return (k * density * inside ** (k - 1) * wz).sum(1)

    if math.isinf(df):
        return np.clip(1.0 - known(q), 0.0, 1.0)
    # the error's standard deviation relative to the true one: chi / sqrt(df)
    x, w = np.polynomial.legendre.leggauss(120)
    spread = 8.0 / math.sqrt(2 * df)
    lo, hi = max(1e-8, 1 - spread), 1 + spread + 8.0 / df
    s, ws = (hi - lo) / 2 * x + (hi + lo) / 2, (hi - lo) / 2 * w
    log_f = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return np.clip(1.0 - np.array([(np.exp(log_f) * ws * known(v * s)).sum() for v in q]), 0.0, 1.0)
