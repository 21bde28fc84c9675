"""Mixed-model equations of many group levels, kept distributed (H6).

The sums of a random-intercept model are two tables: ``per``, a row for each level
of each group factor with its number of rows and its sums of the (centred) design
columns and response, and ``pairs``, a row for each pair of levels that occur
together with their number of rows. Everything else follows from them:

* the moment equations of the variances are aggregates of both tables;
* the equations W u = z, W = Z'Z + diag(s_e^2 / s_k^2), are solved for all columns
  of z at once by preconditioned conjugate gradients. A product W u is a join of
  ``pairs`` with u and a grouped sum. The preconditioner is the diagonal plus a
  coarse solve for the factors' common shifts, which confound with each other and
  are what plain diagonal scaling is slow on.

Each iteration writes one table of the levels' vectors (so a lost executor costs
one step) and reads one row of scalars for each factor; levels never meet in one
place. The recurrences are those of Chronopoulos and Gear, which need one
reduction a step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.operators.design import Design
from eventlab.operators.linear import Gram, indicator_of, monomial_of, monomials
from eventlab.sources.files import stage

#: Relative size of the residuals at which the iteration ends, and its longest run.
TOLERANCE, MOST_STEPS = 1e-12, 500


@dataclass
class LevelTables:
    """The sums of a model with many levels (``l`` is a level as text)."""
    gram: Gram
    levels: list[str]          # group factors; a factor's number is its place
    per: DataFrame             # (f, l, n, z): z are the sums of the Gram's centred columns and of y less its mean
    pairs: DataFrame           # (fa, la, fb, lb, n), both ways round


def level_tables(cells: DataFrame, design: Design, groups: Sequence[str], gram: Gram) -> LevelTables:
    """The tables of the model's cells (one row for each factor cell and group combination)."""
    monos = monomials(design)
    sums = []
    for name, mean in zip([None, *design.columns], gram.xbar):
        on = F.lit(True)
        for v, lvl in indicator_of(design, name).items():
            on = on & (F.col(v) == F.lit(lvl))
        m = monos.index(monomial_of(design, name))
        total = F.sum(F.when(on, F.col("_n") * F.col(f"_a_{m}")).otherwise(0.0))
        sums.append(total - F.sum("_n") * F.lit(float(mean) if name is not None else 0.0))
    sums.append(F.sum(F.col("_n") * F.col("_b")) - F.sum("_n") * F.lit(float(gram.ybar)))
    per = pairs = None
    for i, k in enumerate(groups):
        one = cells.groupBy(F.lit(i).alias("f"), F.col(k).cast("string").alias("l")).agg(
            F.sum("_n").cast("double").alias("n"), F.array(*sums).alias("z"))
        per = one if per is None else per.unionByName(one)
        for j in range(i + 1, len(groups)):
            both = cells.groupBy(F.col(k).cast("string").alias("la"), F.col(groups[j]).cast("string").alias("lb")).agg(
                F.sum("_n").cast("double").alias("n"))
            turned = both.select(F.lit(j).alias("fa"), F.col("lb").alias("la"), F.lit(i).alias("fb"), F.col("la").alias("lb"), "n")
            both = both.select(F.lit(i).alias("fa"), "la", F.lit(j).alias("fb"), "lb", "n").unionByName(turned)
            pairs = both if pairs is None else pairs.unionByName(both)
    per = stage(per, "mixed-levels")
    if pairs is None:
        pairs = per.where("false").select(F.col("f").alias("fa"), F.col("l").alias("la"), F.col("f").alias("fb"), F.col("l").alias("lb"), "n")
    return LevelTables(gram, list(groups), per, stage(pairs, "mixed-pairs"))


def _dot(z: str, weights: Sequence[float]) -> Column:
    """Sum of the leading elements of an array column times ``weights``."""
    return sum((F.col(z)[i] * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


def level_moments(t: LevelTables, beta: np.ndarray) -> tuple[list, dict]:
    """Per factor (sum of s^2 / n, levels, sum of n^2) with s the sums of the
    residuals, and per pair of factors the sum of n_gh^2 / n_g."""
    s = F.col("z")[len(beta)] - _dot("z", beta)
    rows = t.per.groupBy("f").agg(F.sum(s * s / F.col("n")).alias("ss"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2")).collect()
    own = [None] * len(t.levels)
    for r in rows:
        own[r["f"]] = (r["ss"], r["g"], r["n2"])
    of = t.per.select(F.col("f").alias("fa"), F.col("l").alias("la"), F.col("n").alias("na"))
    cross = t.pairs.join(of, ["fa", "la"]).groupBy("fa", "fb").agg(F.sum(F.col("n") * F.col("n") / F.col("na")).alias("c")).collect()
    return own, {(r["fa"], r["fb"]): r["c"] for r in cross}


def _array(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _plus(x: str | Column, factor: Column, y: str | Column) -> Column:
    """x + factor * y, element by element."""
    scaled = F.zip_with(y, factor, lambda a, b: a * b)
    return F.zip_with(x, scaled, lambda a, b: a + b)


def _outer(rows: DataFrame, a: str, b: str, shape: tuple[int, int]) -> np.ndarray:
    """Sum over the rows of the outer products of two array columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (0, 1))
            if batch.num_rows:
                total += x.T @ y
        i, j = np.indices(shape)
        yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros(shape)
    for r in rows.select(a, b).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def solve_levels(t: LevelTables, ridge: dict[int, float]) -> DataFrame:
    """(f, l, n, z, x) with W x = z over the factors in ``ridge`` (their s_e^2 / s_k^2)."""
    active = sorted(ridge)
    lam = F.coalesce(*[F.when(F.col("f") == f, F.lit(float(v))) for f, v in ridge.items()])
    per = t.per.where(F.col("f").isin(active)).withColumn("d", F.col("n") + lam)
    pairs = t.pairs.where(F.col("fa").isin(active) & F.col("fb").isin(active))
    q = len(t.per.select("z").first()["z"])

    sums = {r["f"]: r for r in per.groupBy("f").agg(F.sum("d").alias("d"), *[F.sum(F.col("z")[j]).alias(f"z{j}") for j in range(q)],
                                                    *[F.sum(F.col("z")[j] * F.col("z")[j]).alias(f"zz{j}") for j in range(q)]).collect()}
    coarse = np.diag([sums[f]["d"] for f in active])
    for r in pairs.groupBy("fa", "fb").agg(F.sum("n").alias("n")).collect():
        coarse[active.index(r["fa"]), active.index(r["fb"])] = r["n"]
    coarse = np.linalg.pinv(coarse)
    shift = np.array([[sums[f][f"z{j}"] for j in range(q)] for f in active])       # factors' sums of the residuals
    size = np.array([sum(sums[f][f"zz{j}"] for f in active) for j in range(q)])

    zero = _array(np.zeros(q))
    now = per.select("f", "l", "n", "d", "z", zero.alias("x"), F.col("z").alias("r"), zero.alias("p"), zero.alias("s"))
    gamma_old, alpha_old = np.ones(q), np.ones(q)
    shift_s, done = np.zeros_like(shift), size <= 0
    for step in range(MOST_STEPS):
        common = coarse @ shift
        by_factor = F.coalesce(*[F.when(F.col("f") == f, _array(common[i])) for i, f in enumerate(active)])
        u = F.zip_with(F.transform("r", lambda v: v / F.col("d")), by_factor, lambda a, b: a + b)
        now = now.withColumn("u", u)
        other = now.select(F.col("f").alias("fb"), F.col("l").alias("lb"), F.col("u").alias("ub"))
        met = pairs.join(other, ["fb", "lb"]).groupBy(F.col("fa").alias("f"), F.col("la").alias("l")).agg(
            F.array(*[F.sum(F.col("n") * F.col("ub")[j]) for j in range(q)]).alias("c"))
        own = F.transform("u", lambda v: v * F.col("d"))
        w = F.zip_with(own, F.coalesce("c", zero), lambda a, b: a + b)
        now = stage(now.join(met, ["f", "l"], "left").withColumn("w", w).drop("c"), "mixed-step")
        cells = [F.sum(F.col(a)[j] * F.col(b)[j]).alias(f"{name}{j}") for name, a, b in (("g", "r", "u"), ("d", "w", "u"), ("rr", "r", "r")) for j in range(q)]
        rows = {r["f"]: r for r in now.groupBy("f").agg(*cells, *[F.sum(F.col("w")[j]).alias(f"w{j}") for j in range(q)]).collect()}
        gamma, delta, left = (np.array([sum(r[f"{name}{j}"] for r in rows.values()) for j in range(q)]) for name in ("g", "d", "rr"))
        done = done | (left <= TOLERANCE**2 * size) | (gamma <= 0)
        if done.all():
            break
        safe = np.where(done, 1.0, gamma)
        beta = np.where(done | (step == 0), 0.0, safe / gamma_old)
        bottom = delta - beta * safe / alpha_old
        alpha = np.where(done | (bottom <= 0), 0.0, safe / np.where(bottom <= 0, 1.0, bottom))
        shift_s = np.array([[rows[f][f"w{j}"] for j in range(q)] for f in active]) + beta * shift_s
        shift = shift - alpha * shift_s
        now = now.withColumns({"p": _plus("u", _array(beta), "p"), "s": _plus("w", _array(beta), "s")})
        now = now.withColumns({"x": _plus("x", _array(alpha), "p"), "r": _plus("r", _array(-alpha), "s")}).drop("u", "w")
        gamma_old, alpha_old = np.where(done, gamma_old, safe), np.where(alpha > 0, alpha, alpha_old)
    return now.select("f", "l", "n", "z", "x")


def weighted_sums(t: LevelTables, ridge: dict[int, float]) -> tuple[DataFrame, np.ndarray]:
    """(the solved levels, staged; z' W^-1 z of all columns and y)."""
    solved = stage(solve_levels(t, ridge), "mixed-solved")
    q = len(t.gram.names) + 1
    return solved, _outer(solved, "z", "x", (q, q))


def level_effects(t: LevelTables, solved: DataFrame | None, group: str, kind: str, beta: np.ndarray, se2: float, ridge: dict[int, float]
                  ) -> DataFrame:
    """(group, n, effect, se) of one factor. The standard error is exact with one
    active factor; with several it is that given the other factors' effects."""
    f = t.levels.index(group)
    value = F.col("l").cast(kind).alias(group)
    n = F.col("n").cast("long").alias("n")
    if f not in ridge:
        zero = F.lit(0.0)
        return t.per.where(F.col("f") == f).select(value, n, zero.alias("effect"), zero.alias("se"))
    effect = F.col("x")[len(beta)] - _dot("x", beta)
    return solved.where(F.col("f") == f).select(value, n, effect.alias("effect"), F.sqrt(F.lit(se2) / (F.col("n") + F.lit(ridge[f]))).alias("se"))
