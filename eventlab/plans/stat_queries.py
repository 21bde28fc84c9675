"""Summary and model queries (F2-F10, H1-H13) on the model table
(lineitem ⋈ orders ⋈ customer ⋈ nation, see ``shapes.model_table``).

Model: y = ln(price + c) with Treatment = return flag (A/N/R), crop = order
priority, covariate qty; random intercepts for SiteID:Treatment,
Year:crop and SiteID:Year:crop.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.functions.columns import ln_offset
from eventlab.functions.distributions import normal_quantile_sql, t_quantile_975, t_quantile_975_sql, t_quantile_udf
from eventlab.operators.bootstrap import variance_intervals
from eventlab.operators.design import Design, build_design, with_design
from eventlab.operators.filters import keep_first
from eventlab.operators.linear import (
    anova,
    backward_eliminate,
    coef_table,
    covariate_grid,
    effect_curve,
    fit_ols,
    gram,
    gram_frame,
    screen_covariates,
)
from eventlab.operators.means import marginal_means
from eventlab.operators.mixed import (
    diagnostics,
    fit_random_intercepts,
    icc_r2,
    random_effects,
    variance_table,
)
from eventlab.operators.reshape import pivot_wider
from eventlab.operators.summary import (
    cell_counts,
    keyed_sum,
    log_summary,
    mean_ci,
    paired_t_test,
    profile,
    simple_regression,
    subset_summary,
    total_then_log,
)
from eventlab.plans.event_queries import CI_SELECT, ci_sql
from eventlab.plans.registry import register, with_ctes
from eventlab.plans.shapes import SQL_MODEL, model_table
from eventlab.sources.files import stage

Y_OFFSET = 0.036                     # offset of ln(y + c), one of the study's values
FLAGS = ["A", "N", "R"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FACTORS = {"Treatment": FLAGS, "crop": PRIORITIES}
TERMS = [("Treatment",), ("qty",), ("Treatment", "qty"), ("crop",), ("Treatment", "crop")]
RANDOM = ["site_flag", "year_crop", "site_year_crop"]
MODEL_SQL_Y = f"ln(price + {Y_OFFSET})"


def model_df(spark, sf_dir):
    m = model_table(spark, sf_dir)
    return m.withColumns({
        "y": ln_offset("price", Y_OFFSET),
        "ln_qty": F.ln("qty"),
        "site_flag": F.concat_ws(":", "SiteID", "Treatment"),
        "year_crop": F.concat_ws(":", F.col("Year").cast("string"), "crop"),
        "site_year_crop": F.concat_ws(":", "SiteID", F.col("Year").cast("string"), "crop"),
    })


def design() -> Design:
    return build_design(TERMS, FACTORS)


def design_sql(d: Design) -> list[str]:
    """DuckDB text of the design columns (same recipe as ``column_expr``)."""
    out = []
    for name, sname in zip(d.columns, d.spark_columns):
        parts = []
        for v, lvl in d.column_parts[name]:
            parts.append(f"CAST(CASE WHEN {v} = '{lvl}' THEN 1 ELSE 0 END AS DOUBLE)"
                         if lvl is not None else f"CAST({v} AS DOUBLE)")
        out.append(f"CAST(1 AS DOUBLE) * {' * '.join(parts)} AS {sname}")
    return out


def _fit(spark, sf_dir):
    return fit_ols(model_df(spark, sf_dir), "y", design())


# ------------------------------------------------------------- summaries

@register("cell_counts", with_ctes([SQL_MODEL],
    "SELECT SiteID, Year, Treatment, count(*) AS n FROM model GROUP BY ALL"))
def q_cell_counts(spark, sf_dir):
    """rows per site x year x treatment cell."""
    return cell_counts(model_table(spark, sf_dir), ["SiteID", "Year", "Treatment"])


@register("keyed_totals", with_ctes([SQL_MODEL],
    "SELECT SiteID, Year, sum(price) AS total FROM model GROUP BY ALL"))
def q_keyed_totals(spark, sf_dir):
    """keyed sum."""
    return keyed_sum(model_table(spark, sf_dir), ["SiteID", "Year"], "price", "total")


@register("price_profile", with_ctes([SQL_MODEL], """SELECT Year, count(price) AS n,
  avg(price) AS mean, stddev_samp(price) AS sd, sum(price) AS sum, min(price) AS min,
  max(price) AS max FROM model GROUP BY Year"""))
def q_price_profile(spark, sf_dir):
    """n, mean, sd, sum, min, max per year in one aggregate."""
    return profile(model_table(spark, sf_dir), ["Year"], "price")


@register("price_ci", with_ctes([SQL_MODEL, *ci_sql("model", "crop, Treatment", "price")],
                                CI_SELECT.format(by="crop, Treatment")))
def q_price_ci(spark, sf_dir):
    """mean, se and 95 % t-interval per priority x flag."""
    return mean_ci(model_table(spark, sf_dir), ["crop", "Treatment"], "price")


SMALL_CELL = "SiteID, Year, crop, Treatment, discount"


@register("small_cell_ci", with_ctes([SQL_MODEL, *ci_sql("model", SMALL_CELL, "price")],
                                     CI_SELECT.format(by=SMALL_CELL)))
def q_small_cell_ci(spark, sf_dir):
    """F4 with small cells (df inside the exact t table; one row: no interval)."""
    return mean_ci(model_table(spark, sf_dir), SMALL_CELL.split(", "), "price")


@register("log_summary", with_ctes([SQL_MODEL], f"""SELECT Treatment, crop, count(price) AS n,
  avg(price) AS mean, stddev_samp(price) AS sd, avg(ln(price + {Y_OFFSET})) AS ln_mean,
  stddev_samp(ln(price + {Y_OFFSET})) AS ln_sd, stddev_samp(price) / sqrt(count(price)) AS se,
  stddev_samp(ln(price + {Y_OFFSET})) / sqrt(count(price)) AS ln_se FROM model GROUP BY ALL"""))
def q_log_summary(spark, sf_dir):
    """raw and log-scale mean/sd/se per cell."""
    return log_summary(model_table(spark, sf_dir), ["Treatment", "crop"], "price", Y_OFFSET)


@register("log_of_totals", with_ctes([SQL_MODEL,
    "tot AS (SELECT SiteID, Year, Treatment, sum(price) AS total FROM model GROUP BY ALL)"],
    """SELECT Treatment, count(total) AS n, avg(ln(total)) AS ln_total_mean,
  stddev_samp(ln(total)) AS ln_total_sd FROM tot GROUP BY Treatment"""))
def q_log_of_totals(spark, sf_dir):
    """total per site-year-flag, then mean/sd of its log per flag."""
    return total_then_log(model_table(spark, sf_dir), ["SiteID", "Year", "Treatment"],
                          ["Treatment"], "price")


@register("annual_totals_dedup", with_ctes([SQL_MODEL, """firsts AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
    SiteID, Year, crop, Treatment, qty, discount, price) AS _k FROM model) WHERE _k = 1)"""],
    """SELECT Year, count(*) AS n, sum(price) AS total, avg(qty) AS mean_qty FROM firsts GROUP BY Year"""))
def q_annual_totals_dedup(spark, sf_dir):
    """F8: keep the first row per (order, line) (C9), then annual totals."""
    first = keep_first(model_table(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_partkey"])
    return first.groupBy("Year").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"),
                                     F.avg("qty").alias("mean_qty"))


@register("seasonal_rollup", with_ctes([SQL_MODEL, """per AS (SELECT Year, SiteID, Treatment, crop,
  sum(price) AS tss_sum, sum(qty) AS rain FROM model GROUP BY ALL)"""],
    """SELECT Year, SiteID, Treatment, sum(tss_sum) AS tss_sum, sum(rain) AS rain
  FROM per GROUP BY ALL"""))
def q_seasonal_rollup(spark, sf_dir):
    """per-season totals rolled up to the year."""
    per = (model_table(spark, sf_dir).groupBy("Year", "SiteID", "Treatment", "crop")
           .agg(F.sum("price").alias("tss_sum"), F.sum("qty").alias("rain")))
    return per.groupBy("Year", "SiteID", "Treatment").agg(F.sum("tss_sum").alias("tss_sum"),
                                                          F.sum("rain").alias("rain"))


SUBSETS_SQL = """tagged AS (
  SELECT 'all' AS subset, Treatment, price FROM model
  UNION ALL SELECT 'urgent', Treatment, price FROM model WHERE crop = '1-URGENT'
  UNION ALL SELECT 'high', Treatment, price FROM model WHERE crop IN ('1-URGENT', '2-HIGH'))"""


@register("subset_ci", with_ctes([SQL_MODEL, SUBSETS_SQL, *ci_sql("tagged", "subset, Treatment", "price")],
                                 CI_SELECT.format(by="subset, Treatment")))
def q_subset_ci(spark, sf_dir):
    """the same interval for overlapping subsets in one scan."""
    crop = F.col("crop")
    subsets = {"all": F.lit(True), "urgent": crop == "1-URGENT",
               "high": crop.isin("1-URGENT", "2-HIGH")}
    return subset_summary(model_table(spark, sf_dir), subsets, ["Treatment"], "price")


PAIRED_SQL = [SQL_MODEL, """pairs AS (SELECT crop, SiteID,
  avg(price) FILTER (WHERE Treatment = 'A') AS A, avg(price) FILTER (WHERE Treatment = 'R') AS R
  FROM model GROUP BY crop, SiteID)""", """pt AS (SELECT crop, count(A - R) AS n,
  avg(A - R) AS mean_diff, stddev_samp(A - R) AS sd_diff FROM pairs GROUP BY crop)""",
    """pt2 AS (SELECT *, sd_diff / sqrt(n) AS se, mean_diff / (sd_diff / sqrt(n)) AS t,
  n - 1 AS df FROM pt)"""]


def _paired(spark, sf_dir, p_values):
    cell = (model_table(spark, sf_dir).where(F.col("Treatment").isin("A", "R"))
            .groupBy("crop", "SiteID", "Treatment").agg(F.avg("price").alias("v")))
    wide = pivot_wider(cell, ["crop", "SiteID"], "Treatment", "v", ["A", "R"])
    return paired_t_test(wide, ["crop"], "A", "R", p_values=p_values)


@register("paired_t", with_ctes(PAIRED_SQL, f"""SELECT crop, n, mean_diff, sd_diff, se, t, df,
  mean_diff - {t_quantile_975_sql('df')} * se AS lb, mean_diff + {t_quantile_975_sql('df')} * se AS ub
  FROM pt2"""))
def q_paired_t(spark, sf_dir):
    """H1: paired t-test of mean price, flag A vs R, paired by site, per priority."""
    return _paired(spark, sf_dir, p_values=False)


@register("paired_t_pvalue")
def q_paired_t_pvalue(spark, sf_dir):
    """H1 + H12: the same with the two-sided p-value (tail on aggregated rows)."""
    return _paired(spark, sf_dir, p_values=True)


@register("group_regression", with_ctes([SQL_MODEL], """SELECT Treatment,
  CAST(regr_count(price, qty) AS BIGINT) AS n, regr_slope(price, qty) AS slope,
  regr_intercept(price, qty) AS intercept, regr_r2(price, qty) AS r2,
  sqrt((regr_syy(price, qty) - regr_slope(price, qty) * regr_sxy(price, qty))
       / ((regr_count(price, qty) - 2) * regr_sxx(price, qty))) AS slope_se,
  regr_slope(price, qty) / sqrt((regr_syy(price, qty) - regr_slope(price, qty) * regr_sxy(price, qty))
       / ((regr_count(price, qty) - 2) * regr_sxx(price, qty))) AS slope_t
  FROM model GROUP BY Treatment"""))
def q_group_regression(spark, sf_dir):
    """H2: price ~ qty per flag: slope, intercept, R^2, slope se and t."""
    return simple_regression(model_table(spark, sf_dir), ["Treatment"], "price", "qty")


@register("t_quantiles", with_ctes([SQL_MODEL,
    "c1 AS (SELECT SiteID || ':' || crop || ':' || CAST(Year AS VARCHAR) AS cell, count(*) AS n FROM model GROUP BY ALL)",
    "c2 AS (SELECT SiteID || ':' || CAST(Year AS VARCHAR) AS cell, count(*) AS n FROM model GROUP BY ALL)",
    "cells AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2)"],
    f"SELECT cell, n, {t_quantile_975_sql('(n - 1)')} AS q975 FROM cells"))
def q_t_quantiles(spark, sf_dir):
    """t(0.975, n-1) for cells of all sizes (table and series regions)."""
    year = F.col("Year").cast("string")
    fine = stage(model_table(spark, sf_dir).groupBy("SiteID", "crop", "Year").agg(F.count(F.lit(1)).alias("n")), "t-cells")
    c1 = fine.select(F.concat_ws(":", "SiteID", "crop", year).alias("cell"), "n")
    c2 = fine.groupBy(F.concat_ws(":", "SiteID", year).alias("cell")).agg(F.sum("n").alias("n"))
    cells = c1.unionByName(c2)
    return cells.withColumn("q975", t_quantile_975(F.col("n") - 1))


@register("t_quantiles_exact")
def q_t_quantiles_exact(spark, sf_dir):
    """Exact t quantiles (Arrow UDF on aggregated rows) at 0.95 and 0.975."""
    m = model_table(spark, sf_dir)
    cells = m.groupBy("SiteID", "crop").agg(F.count(F.lit(1)).alias("n"))
    df = (F.col("n") - 1).cast("double")
    return cells.select("SiteID", "crop", "n", t_quantile_udf(F.lit(0.95), df).alias("q95"),
                        t_quantile_udf(F.lit(0.975), df).alias("q975"))


# ------------------------------------------------------------------ models

def _design_select_sql() -> str:
    d = design()
    return with_ctes([SQL_MODEL], "SELECT l_orderkey, l_linenumber, l_partkey, "
                     f"{MODEL_SQL_Y} AS y, " + ", ".join(design_sql(d)) + " FROM model")


@register("design_matrix", _design_select_sql())
def q_design_matrix(spark, sf_dir):
    """H3: treatment-contrast design columns for Treatment*qty + Treatment*crop."""
    return with_design(model_df(spark, sf_dir), design(), keep=["l_orderkey", "l_linenumber",
                                                                 "l_partkey", "y"])


def _gram_sql() -> str:
    d = design()
    xs = d.spark_columns
    aggs = ["count(*) AS n", "sum(y) AS sy", "sum(y * y) AS syy"]
    aggs += [f"sum({x}) AS s_{i}" for i, x in enumerate(xs)]
    aggs += [f"sum({x} * y) AS sy_{i}" for i, x in enumerate(xs)]
    aggs += [f"sum({xs[i]} * {xs[j]}) AS s_{i}_{j}" for i in range(len(xs)) for j in range(i, len(xs))]
    inner = ("SELECT " + f"{MODEL_SQL_Y} AS y, " + ", ".join(design_sql(d)) + " FROM model")
    return with_ctes([SQL_MODEL, f"dm AS ({inner})"], "SELECT " + ", ".join(aggs) + " FROM dm")


@register("gram_matrix", _gram_sql())
def q_gram_matrix(spark, sf_dir):
    """H4 data pass: the Gram sums of the model in one aggregate."""
    return gram_frame(spark, gram(model_df(spark, sf_dir), "y", design()))


@register("ols_coefficients")
def q_ols_coefficients(spark, sf_dir):
    """H4: OLS coefficient table (estimate, se, t, p)."""
    return coef_table(spark, _fit(spark, sf_dir))


@register("anova_sequential")
def q_anova_sequential(spark, sf_dir):
    """H5: type I ANOVA from the Gram."""
    return anova(spark, _fit(spark, sf_dir), "sequential")


@register("anova_marginal")
def q_anova_marginal(spark, sf_dir):
    """H5: drop-one ANOVA of the terms that no other term contains."""
    return anova(spark, _fit(spark, sf_dir), "marginal")


@register("anova_type3")
def q_anova_type3(spark, sf_dir):
    """H5: type III ANOVA (sum-to-zero coding), from the Gram."""
    return anova(spark, _fit(spark, sf_dir), "type3")


@register("backward_steps")
def q_backward_steps(spark, sf_dir):
    """H9: backward elimination at alpha = 0.1, hierarchy respected."""
    return backward_eliminate(spark, _fit(spark, sf_dir), alpha=0.1)[1]


@register("covariate_screen")
def q_covariate_screen(spark, sf_dir):
    """Add each covariate to Treatment + crop; F row and R - A contrast."""
    base_terms = [("Treatment",), ("crop",)]
    cands = ["qty", "discount", "ln_qty"]
    d = build_design(base_terms + [(c,) for c in cands], FACTORS)
    return screen_covariates(spark, model_df(spark, sf_dir), "y", d, base_terms, cands,
                             "Treatment", ("R", "A"))


@register("effect_curve")
def q_effect_curve(spark, sf_dir):
    """Predicted ln price over an 11-point qty grid with 95 % band."""
    fit = _fit(spark, sf_dir)
    grid = covariate_grid(model_table(spark, sf_dir), "qty", 11)
    return effect_curve(spark, fit, "qty", grid)


@register("marginal_means")
def q_marginal_means(spark, sf_dir):
    """H8: flag means per priority, back-transformed exp(eta) - c."""
    return marginal_means(spark, _fit(spark, sf_dir), "Treatment", by="crop",
                          back_offset=Y_OFFSET)[0]


@register("marginal_contrasts")
def q_marginal_contrasts(spark, sf_dir):
    """H8: pairwise flag contrasts (log scale) per priority."""
    return marginal_means(spark, _fit(spark, sf_dir), "Treatment", by="crop")[1]


ROW_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _mixed(spark, sf_dir, keep_rows=False):
    d = design()
    return fit_random_intercepts(model_df(spark, sf_dir).select(
        "y", "Treatment", "qty", "crop", *RANDOM, *ROW_IDS), "y", d, RANDOM, keep_rows)


@register("variance_components")
def q_variance_components(spark, sf_dir):
    """H6: random-intercept variances by moments (three grouping factors)."""
    return variance_table(spark, _mixed(spark, sf_dir))


@register("icc_r2")
def q_icc_r2(spark, sf_dir):
    """H7: ICC and marginal / conditional R^2."""
    return icc_r2(spark, _mixed(spark, sf_dir))


@register("random_effects")
def q_random_effects(spark, sf_dir):
    """Group effects with +/- 1.96 se (caterpillar data)."""
    return random_effects(_mixed(spark, sf_dir))


@register("residual_diagnostics")
def q_residual_diagnostics(spark, sf_dir):
    """Fitted, residual, standardised residual, QQ score and index per row."""
    return diagnostics(_mixed(spark, sf_dir, keep_rows=True), ROW_IDS)


@register("mixed_coefficients")
def q_mixed_coefficients(spark, sf_dir):
    """H6: fixed effects of the mixed model with its standard errors."""
    return coef_table(spark, _mixed(spark, sf_dir))


@register("mixed_anova_type3")
def q_mixed_anova_type3(spark, sf_dir):
    """H5 on the mixed model: type III Wald tests."""
    return anova(spark, _mixed(spark, sf_dir), "type3")


@register("mixed_marginal_means")
def q_mixed_marginal_means(spark, sf_dir):
    """H8 on the mixed model: flag means per priority."""
    return marginal_means(spark, _mixed(spark, sf_dir), "Treatment", by="crop", back_offset=Y_OFFSET)[0]


@register("mixed_backward_steps")
def q_mixed_backward_steps(spark, sf_dir):
    """H9 on the mixed model."""
    return backward_eliminate(spark, _mixed(spark, sf_dir), alpha=0.1)[1]


@register("mixed_effect_curve")
def q_mixed_effect_curve(spark, sf_dir):
    """H13 on the mixed model."""
    fit = _mixed(spark, sf_dir)
    return effect_curve(spark, fit, "qty", covariate_grid(model_table(spark, sf_dir), "qty", 11))


ONE_WAY_SQL = [SQL_MODEL, f"""ow0 AS (SELECT SiteID || ':' || Treatment AS g, {MODEL_SQL_Y} AS y0 FROM model)""",
    """ow AS (SELECT g, y0 - (SELECT avg(y0) FROM ow0) AS y FROM ow0)""",
    """ow_g AS (SELECT g, count(*) AS n, sum(y) AS s FROM ow GROUP BY g)""",
    """ow_t AS (SELECT CAST(count(*) AS DOUBLE) AS N, sum(y) AS S, sum(y * y) AS SS FROM ow)""",
    """ow_m AS (SELECT N, SS - S * S / N AS U0, SS - (SELECT sum(s * s / n) FROM ow_g) AS U1,
         CAST((SELECT count(*) FROM ow_g) AS DOUBLE) AS G,
         (SELECT sum(CAST(n AS DOUBLE) * n) FROM ow_g) AS N2 FROM ow_t)""",
    """ow_s AS (SELECT *, U1 / (N - G) AS se0,
         (U0 - U1 / (N - G) * (N - 1)) / (N - N2 / N) AS sa0 FROM ow_m)""",
    """ow_v AS (SELECT CASE WHEN sa0 >= 0 THEN sa0 ELSE 0.0 END AS sa,
         CASE WHEN sa0 >= 0 THEN se0 ELSE (U0 * (N - 1) + U1 * (N - G))
              / ((N - 1) * (N - 1) + (N - G) * (N - G)) END AS se FROM ow_s)"""]


def _one_way(spark, sf_dir):
    m = model_df(spark, sf_dir).select("y", F.concat_ws(":", "SiteID", "Treatment").alias("g"))
    return fit_random_intercepts(m, "y", build_design([], {}), ["g"])


@register("one_way_variance", with_ctes(ONE_WAY_SQL, """SELECT 'g' AS component, sa AS variance,
  sqrt(sa) AS sd FROM ow_v UNION ALL SELECT 'Residual', se, sqrt(se) FROM ow_v"""))
def q_one_way_variance(spark, sf_dir):
    """H6 with one random factor (site:flag) and an intercept: the moment
    estimates have a closed form, so this one has an exact SQL oracle."""
    return variance_table(spark, _one_way(spark, sf_dir))


@register("one_way_icc", with_ctes(ONE_WAY_SQL, """SELECT CAST(0 AS DOUBLE) AS var_fixed,
  sa AS var_random, se AS var_residual, sa / (sa + se) AS icc, CAST(0 AS DOUBLE) AS r2_marginal,
  sa / (sa + se) AS r2_conditional FROM ow_v"""))
def q_one_way_icc(spark, sf_dir):
    """H7 for the one-factor model: ICC = R^2 conditional, R^2 marginal = 0."""
    return icc_r2(spark, _one_way(spark, sf_dir))


AT_QTY = (10.0, 25.0, 40.0)     # covariate values of the reference grid (``at=``)


@register("marginal_means_at")
def q_marginal_means_at(spark, sf_dir):
    """H8 with ``at=``: flag means (back-transformed) at given qty values,
    averaged over priorities; one fit, a small grid per value."""
    fit = _fit(spark, sf_dir)
    parts = [marginal_means(spark, fit, "Treatment", at={"qty": q}, back_offset=Y_OFFSET)[0]
             .withColumn("qty", F.lit(q)) for q in AT_QTY]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("by")


# ------------------------------------------------- closed forms, exact in SQL

ONE_FACTOR_SQL = [SQL_MODEL, f"m0 AS (SELECT *, {MODEL_SQL_Y} AS y FROM model)",
    "lv AS (SELECT Treatment, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM m0 GROUP BY Treatment)",
    """tt AS (SELECT sum(n) AS n, sum(ss) AS within, sum(ss) / (sum(n) - count(*)) AS mse, count(*) AS k,
         sum(n * m) / sum(n) AS gm FROM lv)"""]


def _one_factor(spark, sf_dir):
    return fit_ols(model_df(spark, sf_dir), "y", build_design([("Treatment",)], FACTORS))


@register("one_factor_ols", with_ctes(ONE_FACTOR_SQL, """
  SELECT '(Intercept)' AS term, a.m AS estimate, sqrt(mse / a.n) AS se, a.m / sqrt(mse / a.n) AS t
  FROM lv a, tt WHERE a.Treatment = 'A'
  UNION ALL SELECT 'Treatment[' || b.Treatment || ']', b.m - a.m, sqrt(mse * (1.0 / a.n + 1.0 / b.n)),
    (b.m - a.m) / sqrt(mse * (1.0 / a.n + 1.0 / b.n)) FROM lv a, lv b, tt
  WHERE a.Treatment = 'A' AND b.Treatment <> 'A'"""))
def q_one_factor_ols(spark, sf_dir):
    """H4, one factor: coefficients are differences of means."""
    return coef_table(spark, _one_factor(spark, sf_dir)).drop("p_value")


@register("one_way_anova", with_ctes(ONE_FACTOR_SQL, """
  SELECT 'Treatment' AS term, CAST(k - 1 AS BIGINT) AS df, bs AS sum_sq, bs / (k - 1) AS mean_sq,
    bs / (k - 1) / mse AS F FROM tt, (SELECT sum(lv.n * (m - gm) * (m - gm)) AS bs FROM lv, tt)
  UNION ALL SELECT 'Residuals', CAST(n - k AS BIGINT), within, mse, NULL FROM tt"""))
def q_one_way_anova(spark, sf_dir):
    """H5, one factor: between and within sums of squares."""
    return anova(spark, _one_factor(spark, sf_dir)).drop("p_value")


TWO_LEVEL = {"Treatment": ["A", "R"], "crop": PRIORITIES}


def _saturated(spark, sf_dir):
    d = build_design([("Treatment",), ("crop",), ("Treatment", "crop")], TWO_LEVEL)
    return fit_ols(model_df(spark, sf_dir), "y", d)


SATURATED_SQL = [SQL_MODEL, f"s0 AS (SELECT *, {MODEL_SQL_Y} AS y FROM model WHERE Treatment IN ('A', 'R'))",
    "sc AS (SELECT Treatment, crop, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM s0 GROUP BY ALL)",
    "sm AS (SELECT sum(ss) / (sum(n) - count(*)) AS mse FROM sc)"]


@register("anova_type3_two_level", with_ctes([*SATURATED_SQL,
    """l AS (SELECT avg(a.m - r.m) AS d, sum(1.0 / a.n + 1.0 / r.n) / (count(*) * count(*)) AS v
      FROM sc a JOIN sc r USING (crop) WHERE a.Treatment = 'A' AND r.Treatment = 'R')"""],
    "SELECT 'Treatment' AS term, CAST(1 AS BIGINT) AS df, d * d / v AS sum_sq, d * d / v / mse AS F FROM l, sm"))
def q_anova_type3_two_level(spark, sf_dir):
    """H5, type III of a two-level factor in a saturated two-way table: the
    squared difference of unweighted means over its variance. Rows at the third
    flag are an undeclared level and drop out."""
    t = anova(spark, _saturated(spark, sf_dir), "type3")
    return t.where(F.col("term") == "Treatment").select("term", "df", "sum_sq", "F")


@register("saturated_means", with_ctes(SATURATED_SQL, f"""
  SELECT Treatment AS level, avg(m) AS emmean, sqrt(mse * sum(1.0 / n)) / count(*) AS se,
    exp(avg(m)) - {Y_OFFSET} AS response FROM sc, sm GROUP BY Treatment, mse"""))
def q_saturated_means(spark, sf_dir):
    """H8, saturated two-way table: means of cell means."""
    means, _ = marginal_means(spark, _saturated(spark, sf_dir), "Treatment", back_offset=Y_OFFSET)
    return means.select("level", "emmean", "se", "response")


@register("saturated_contrasts", with_ctes(SATURATED_SQL, """
  SELECT crop AS by, 'A - R' AS contrast, a.m - r.m AS estimate, sqrt(mse * (1.0 / a.n + 1.0 / r.n)) AS se
  FROM sc a JOIN sc r USING (crop), sm WHERE a.Treatment = 'A' AND r.Treatment = 'R'"""))
def q_saturated_contrasts(spark, sf_dir):
    """H8, contrasts within each priority: differences of cell means."""
    _, contrasts = marginal_means(spark, _saturated(spark, sf_dir), "Treatment", by="crop")
    return contrasts.select("by", "contrast", "estimate", "se")


LINE_SQL = [SQL_MODEL, f"l0 AS (SELECT {MODEL_SQL_Y} AS y, qty, discount, ln(qty) AS ln_qty FROM model)",
    """line AS (SELECT regr_slope(y, qty) AS b, avg(y) AS my, avg(qty) AS mx, regr_sxx(y, qty) AS sxx,
      CAST(count(*) AS DOUBLE) AS n, min(qty) AS lo, max(qty) AS hi,
      (regr_syy(y, qty) - regr_slope(y, qty) * regr_sxy(y, qty)) / (count(*) - 2) AS mse FROM l0)"""]


@register("line_effect_curve", with_ctes([*LINE_SQL,
    "g AS (SELECT lo + (hi - lo) * i / 10.0 AS x, line.* FROM line, generate_series(0, 10) t(i))"],
    """SELECT x, my + b * (x - mx) AS fit, sqrt(mse * (1.0 / n + (x - mx) * (x - mx) / sxx)) AS se FROM g"""))
def q_line_effect_curve(spark, sf_dir):
    """H13, one covariate: the regression line and its standard error."""
    m = model_df(spark, sf_dir)
    fit = fit_ols(m, "y", build_design([("qty",)], {}))
    return effect_curve(spark, fit, "qty", covariate_grid(m, "qty", 11)).select("x", "fit", "se")


@register("line_screen", with_ctes(LINE_SQL, " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST(1 AS BIGINT) AS df, pow(corr(y, {c}), 2) * (count(*) - 2) / (1 - pow(corr(y, {c}), 2)) AS F FROM l0"
    for c in ("qty", "discount", "ln_qty"))))
def q_line_screen(spark, sf_dir):
    """H10 without a base model: F of each covariate alone, from the screen."""
    covariates = ["qty", "discount", "ln_qty"]
    d = build_design([(c,) for c in covariates], {})
    return screen_covariates(spark, model_df(spark, sf_dir), "y", d, [], covariates).select("variable", "df", "F")


TWO_BY_TWO = {"Treatment": ["A", "R"], "crop": ["1-URGENT", "5-LOW"]}
STEPS_SQL = [SQL_MODEL,
    f"w0 AS (SELECT *, {MODEL_SQL_Y} AS y FROM model WHERE Treatment IN ('A', 'R') AND crop IN ('1-URGENT', '5-LOW'))",
    "wc AS (SELECT Treatment, crop, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM w0 GROUP BY ALL)",
    """w1 AS (SELECT sum(n) AS n, sum(ss) AS within, sum(1 / n) AS inv,
      sum(CASE WHEN (Treatment = 'A') = (crop = '1-URGENT') THEN m ELSE -m END) AS twist FROM wc)""",
    # interaction; then each factor adjusted for the other: weighted differences within the other's levels
    """wt AS (SELECT sum(w * d) * sum(w * d) / sum(w) AS ss FROM (SELECT a.m - r.m AS d, 1 / (1 / a.n + 1 / r.n) AS w
      FROM wc a JOIN wc r USING (crop) WHERE a.Treatment = 'A' AND r.Treatment = 'R'))""",
    """wk AS (SELECT sum(w * d) * sum(w * d) / sum(w) AS ss FROM (SELECT u.m - l.m AS d, 1 / (1 / u.n + 1 / l.n) AS w
      FROM wc u JOIN wc l USING (Treatment) WHERE u.crop = '1-URGENT' AND l.crop = '5-LOW'))""",
    """w2 AS (SELECT n, twist * twist / inv AS ss_i, within, within + twist * twist / inv AS rss, wt.ss AS ss_t, wk.ss AS ss_k,
      wt.ss / ((within + twist * twist / inv) / (n - 3)) AS f_t, wk.ss / ((within + twist * twist / inv) / (n - 3)) AS f_k FROM w1, wt, wk)""",
    """wa AS (SELECT CASE WHEN f_t <= f_k THEN 'crop' ELSE 'Treatment' END AS left_term, ss_i / (within / (n - 4)) AS f1,
      least(f_t, f_k) AS f2, rss + least(ss_t, ss_k) AS rss3, n FROM w2)""",
    """ws AS (SELECT CASE WHEN left_term = 'crop' THEN
        (SELECT pow(u.m - l.m, 2) / (1 / u.n + 1 / l.n) FROM
          (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM wc WHERE crop = '1-URGENT') u,
          (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM wc WHERE crop = '5-LOW') l)
      ELSE (SELECT pow(a.m - r.m, 2) / (1 / a.n + 1 / r.n) FROM
          (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM wc WHERE Treatment = 'A') a,
          (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM wc WHERE Treatment = 'R') r) END AS ss3 FROM wa)""",
    "wf AS (SELECT f1, f2, ss3 / (rss3 / (n - 2)) AS f3, left_term, n FROM wa, ws)"]
# Fixed value: F(0.9; 1, infinity), the square of the normal quantile at 0.95; thousands of rows stand behind it.
F_CUT = 2.705543454095404


@register("two_by_two_steps", with_ctes(STEPS_SQL, f"""
  SELECT CAST(1 AS BIGINT) AS step, 'Treatment:crop' AS term, CAST(1 AS BIGINT) AS df, f1 AS F,
    CASE WHEN f1 < {F_CUT} THEN 'drop' ELSE 'keep all' END AS action FROM wf
  UNION ALL SELECT 2, CASE WHEN left_term = 'crop' THEN 'Treatment' ELSE 'crop' END, 1, f2,
    CASE WHEN f2 < {F_CUT} THEN 'drop' ELSE 'keep all' END FROM wf WHERE f1 < {F_CUT}
  UNION ALL SELECT 3, left_term, 1, f3, CASE WHEN f3 < {F_CUT} THEN 'drop' ELSE 'keep all' END
    FROM wf WHERE f1 < {F_CUT} AND f2 < {F_CUT}"""))
def q_two_by_two_steps(spark, sf_dir):
    """H9 on a two-by-two table, where every test has a closed form."""
    d = build_design([("Treatment",), ("crop",), ("Treatment", "crop")], TWO_BY_TWO)
    fit = fit_ols(model_df(spark, sf_dir), "y", d)
    return backward_eliminate(spark, fit, alpha=0.1)[1].select("step", "term", "df", "F", "action")


@register("mixed_covariate_screen")
def q_mixed_covariate_screen(spark, sf_dir):
    """H10 on the mixed model: for each covariate variances, fixed part, F row and
    R - A contrast are estimated again."""
    base, candidates = [("Treatment",), ("crop",)], ["qty", "discount", "ln_qty"]
    d = build_design(base + [(c,) for c in candidates], FACTORS)
    fit = fit_random_intercepts(model_df(spark, sf_dir), "y", d, RANDOM)
    return screen_covariates(spark, None, "y", d, base, candidates, "Treatment", ("R", "A"), fit=fit)


@register("variance_intervals")
def q_variance_intervals(spark, sf_dir):
    """H6/H7: intervals of the variances and the ICC by a bootstrap over groups."""
    return variance_intervals(_mixed(spark, sf_dir), replicates=100)


@register("adjusted_contrasts")
def q_adjusted_contrasts(spark, sf_dir):
    """H8 with simultaneous p-values: priorities compared in pairs on the mixed
    model, plain, by the studentized range and step-down."""
    fit = _mixed(spark, sf_dir)
    parts = [marginal_means(spark, fit, "crop", adjust=a)[1].withColumn("adjust", F.lit(a or "none")) for a in (None, "tukey", "shaffer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("by")


@register("one_way_effects", with_ctes(ONE_WAY_SQL, """SELECT 'g' AS factor, g AS "group", n,
  n * sa / (n * sa + se) * (s / n - mu) AS effect, sqrt(sa * se / (n * sa + se)) AS se
  FROM ow_g, ow_v, (SELECT sum(s / n * w) / sum(w) AS mu FROM (
    SELECT s, n, 1.0 / (sa + se / n) AS w FROM ow_g, ow_v))"""))
def q_one_way_effects(spark, sf_dir):
    """H11 with one random factor: means shrunken to the weighted mean."""
    return random_effects(_one_way(spark, sf_dir)).drop("lower", "upper")


@register("one_way_mean", with_ctes([*ONE_WAY_SQL, f"sh AS (SELECT avg(y0) AS m0 FROM ow0)",
    "w AS (SELECT s / n AS m, 1.0 / (sa + se / n) AS w FROM ow_g, ow_v)"],
    "SELECT '(Intercept)' AS term, m0 + sum(m * w) / sum(w) AS estimate, sqrt(1.0 / sum(w)) AS se FROM w, sh GROUP BY m0"))
def q_one_way_mean(spark, sf_dir):
    """H6: the fixed intercept with one random factor is the mean of group
    means weighted by their variances; its error is that of the weights."""
    return coef_table(spark, _one_way(spark, sf_dir)).select("term", "estimate", "se")


@register("plain_diagnostics", with_ctes([SQL_MODEL,
    f"r0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {MODEL_SQL_Y} AS y FROM model)",
    """r1 AS (SELECT *, y - avg(y) OVER () AS resid, count(*) OVER () AS n, var_samp(y) OVER () AS v,
      row_number() OVER (ORDER BY y, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k,
      row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS index FROM r0)"""],
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, index, resid, resid / sqrt(v) AS std_resid,
  {normal_quantile_sql('((k - 0.5) / n)')} AS theoretical FROM r1"""))
def q_plain_diagnostics(spark, sf_dir):
    """H11 for a mean only: residual, its standardised form, QQ score, index."""
    m = model_df(spark, sf_dir).select("y", *ROW_IDS)
    out = diagnostics(fit_random_intercepts(m, "y", build_design([], {}), [], keep_rows=True), ROW_IDS)
    return out.select(*ROW_IDS, "index", "resid", "std_resid", "theoretical")


@register("pooled_regression", with_ctes([SQL_MODEL], """SELECT CAST(regr_count(price, qty) AS BIGINT) AS n,
  regr_slope(price, qty) AS slope, regr_intercept(price, qty) AS intercept, regr_r2(price, qty) AS r2,
  sqrt((regr_syy(price, qty) - regr_slope(price, qty) * regr_sxy(price, qty))
       / ((regr_count(price, qty) - 2) * regr_sxx(price, qty))) AS slope_se FROM model"""))
def q_pooled_regression(spark, sf_dir):
    """H2 over all rows, next to the per-flag one."""
    return simple_regression(model_table(spark, sf_dir), [], "price", "qty").select(
        "n", "slope", "intercept", "r2", "slope_se")


@register("pooled_regression_pvalue")
def q_pooled_regression_pvalue(spark, sf_dir):
    """H2 + H12: the pooled and the per-flag slopes with their p-values."""
    m = model_table(spark, sf_dir)
    each = simple_regression(m, ["Treatment"], "price", "qty", p_values=True)
    pooled = simple_regression(m, [], "price", "qty", p_values=True).withColumn("Treatment", F.lit("all"))
    return each.unionByName(pooled)
