"""Grouped summaries, t-intervals, paired tests and per-group regression.

All statistics are single-pass hash aggregates (partial aggregation on the
map side), so a group holding a third of the rows is reduced before the
shuffle. Quantiles and tails are computed on the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.functions.columns import ln_offset
from eventlab.functions.distributions import (
    t_quantile_975,
    t_two_sided_p_udf,
)
from eventlab.operators.events import strict_sum

STATS = ("n", "mean", "sd", "sum", "min", "max")


def profile(df: DataFrame, by: Sequence[str], value: str, stats: Sequence[str] = STATS,
            prefix: str = "") -> DataFrame:
    """n, mean, sd (sample), sum, min, max of ``value`` per group, one pass."""
    x = F.col(value)
    exprs = {
        "n": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x),
        "sum": F.sum(x), "min": F.min(x), "max": F.max(x),
    }
    return df.groupBy(*by).agg(*[exprs[s].alias(prefix + s) for s in stats])


def with_t_interval(df: DataFrame, n: str = "n", mean: str = "mean", sd: str = "sd",
                    prefix: str = "") -> DataFrame:
    """F4 tail: se = sd/sqrt(n); lb/ub = mean -/+ t(0.975, n-1) * se."""
    se = F.col(sd) / F.sqrt(F.col(n).cast("double"))
    q = t_quantile_975(F.col(n) - 1)
    return (df.withColumn(prefix + "se", se)
            .withColumn(prefix + "lb", F.col(mean) - q * F.col(prefix + "se"))
            .withColumn(prefix + "ub", F.col(mean) + q * F.col(prefix + "se")))


def mean_ci(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd, se and the 95 % t-interval of the mean per group."""
    return with_t_interval(profile(df, by, value, ("n", "mean", "sd")))


def log_summary(df: DataFrame, by: Sequence[str], value: str, offset: float) -> DataFrame:
    """raw mean/sd next to mean/sd of ln(x + c), each with its own se."""
    lx = ln_offset(value, offset)
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.avg(lx).alias("ln_mean"), F.stddev_samp(lx).alias("ln_sd"))
    return (out.withColumn("se", F.col("sd") / F.sqrt("n"))
            .withColumn("ln_se", F.col("ln_sd") / F.sqrt("n")))


def total_then_log(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str,
                   offset: float = 0.0) -> DataFrame:
    """sum per inner group, then mean/sd of ln(total + c) per outer group."""
    totals = df.groupBy(*inner).agg(F.sum(value).alias("total"))
    lt = ln_offset("total", offset)
    return totals.groupBy(*outer).agg(F.count("total").alias("n"),
                                      F.avg(lt).alias("ln_total_mean"),
                                      F.stddev_samp(lt).alias("ln_total_sd"))


def keyed_sum(df: DataFrame, by: Sequence[str], value: str, out: str,
              na: str = "skip") -> DataFrame:
    """keyed sum; ``na='propagate'`` gives NULL when any input is NULL."""
    agg = strict_sum(value) if na == "propagate" else F.sum(value)
    return df.groupBy(*by).agg(agg.alias(out))


def cell_counts(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    """rows per cell."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def subset_summary(df: DataFrame, subsets: Mapping[str, Column], by: Sequence[str],
                   value: str, label: str = "subset") -> DataFrame:
    """the same summary for several (possibly overlapping) subsets in one
    scan. Every subset has its own conditional aggregates, so a row is counted
    where it stands, never copied; the cells are unpivoted to a row for each
    subset that has rows."""
    x = F.col(value)

    def cell(cond: Column) -> Column:
        mine = F.when(cond, x)
        return F.struct(F.count_if(cond).alias("rows"), F.count(mine).alias("n"), F.avg(mine).alias("mean"),
                        F.stddev_samp(mine).alias("sd"))

    wide = df.groupBy(*by).agg(*[cell(cond).alias(name) for name, cond in subsets.items()])
    tall = wide.unpivot(list(by), list(subsets), label, "_cell").where("_cell.rows > 0")
    return with_t_interval(tall.select(label, *by, "_cell.n", "_cell.mean", "_cell.sd"))


def paired_t_test(df: DataFrame, by: Sequence[str], a: str, b: str,
                  p_values: bool = True) -> DataFrame:
    """H1: paired t-test of a - b per group: n, mean/sd of the difference,
    t, df, 95 % interval and the two-sided p (tail on aggregated rows)."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"),
                              F.stddev_samp(d).alias("sd_diff"))
    out = (out.withColumn("se", F.col("sd_diff") / F.sqrt(F.col("n").cast("double")))
           .withColumn("t", F.try_divide(F.col("mean_diff"), F.col("se")))
           .withColumn("df", (F.col("n") - 1).cast("long")))
    q = t_quantile_975(F.col("df"))
    out = (out.withColumn("lb", F.col("mean_diff") - q * F.col("se"))
           .withColumn("ub", F.col("mean_diff") + q * F.col("se")))
    if p_values:
        out = out.withColumn("p_value", t_two_sided_p_udf(F.col("t"), F.col("df").cast("double")))
    return out


def simple_regression(df: DataFrame, by: Sequence[str], y: str, x: str,
                      p_values: bool = False) -> DataFrame:
    """H2: y ~ x per group with the built-in regr_* aggregates: slope,
    intercept, R^2, and the slope's se and t."""
    Y, X = F.col(y), F.col(x)
    out = df.groupBy(*by).agg(
        F.regr_count(Y, X).alias("n"), F.regr_slope(Y, X).alias("slope"),
        F.regr_intercept(Y, X).alias("intercept"), F.regr_r2(Y, X).alias("r2"),
        F.regr_sxx(Y, X).alias("sxx"), F.regr_syy(Y, X).alias("syy"),
        F.regr_sxy(Y, X).alias("sxy"))
    sse = F.col("syy") - F.col("slope") * F.col("sxy")
    out = (out.withColumn("slope_se", F.sqrt(F.try_divide(sse, (F.col("n") - 2) * F.col("sxx"))))
           .withColumn("slope_t", F.try_divide(F.col("slope"), F.col("slope_se"))))
    if p_values:
        out = out.withColumn("slope_p", t_two_sided_p_udf(F.col("slope_t"),
                                                          (F.col("n") - 2).cast("double")))
    return out.drop("sxx", "syy", "sxy")
