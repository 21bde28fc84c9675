"""H8: estimated marginal means and pairwise contrasts from a fitted model.

The reference grid is every combination of factor levels with numeric
variables at their means (or ``at`` values); means average the grid rows with
equal weights. Intervals use the normal quantile (asymptotic df). Means can be
back-transformed from ``ln(y + c)`` as ``exp(eta) - c``; contrasts stay on the
model scale, labelled ``"a - b"``. Everything here is p-dimensional: the
data pass happened when the Gram was built.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from eventlab.functions.distributions import Z975, studentized_range_sf
from eventlab.operators.linear import averaged_vector, estimate, linear_part, two_sided_normal_p

MEANS_SCHEMA = StructType([StructField("by", StringType()), StructField("level", StringType()),
                           StructField("emmean", DoubleType()), StructField("se", DoubleType()),
                           StructField("lower", DoubleType()), StructField("upper", DoubleType()),
                           StructField("response", DoubleType()),
                           StructField("response_lower", DoubleType()),
                           StructField("response_upper", DoubleType())])
CONTRAST_SCHEMA = StructType([StructField("by", StringType()), StructField("contrast", StringType()),
                              StructField("estimate", DoubleType()), StructField("se", DoubleType()),
                              StructField("z", DoubleType()), StructField("p_value", DoubleType()),
                              StructField("lower", DoubleType()), StructField("upper", DoubleType())])


def marginal_means(spark: SparkSession, fit, factor: str, by: str | None = None,
                   at: Mapping[str, object] | None = None, back_offset: float | None = None,
                   pairs: Sequence[tuple[str, str]] | None = None, adjust: str | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """Means of ``factor`` (within each level of ``by``), and contrasts, of an
    OLS or mixed fit. ``adjust`` makes the p-values simultaneous over the pairs of
    one ``by`` level: "tukey" (studentized range) or "shaffer" (step-down over
    the sets of hypotheses that can be true together)."""
    fit = linear_part(fit)
    d = fit.design
    at = dict(at or {})
    by_levels = d.factors[by] if by else [None]
    means, contrasts = [], []
    for bl in by_levels:
        fixed = dict(at, **({by: bl} if by else {}))
        vecs = {}
        for lv in d.factors[factor]:
            L = averaged_vector(fit, dict(fixed, **{factor: lv}))
            vecs[lv] = L
            est, se = estimate(fit, L)
            lo, hi = est - Z975 * se, est + Z975 * se
            if back_offset is not None:
                resp = (math.exp(est) - back_offset, math.exp(lo) - back_offset,
                        math.exp(hi) - back_offset)
            else:
                resp = (None, None, None)
            means.append((None if bl is None else str(bl), str(lv), est, se, lo, hi, *resp))
        todo = list(pairs or combinations(d.factors[factor], 2))
        found = []
        for a, b in todo:
            est, se = estimate(fit, vecs[a] - vecs[b])
            found.append((est, se, est / se if se > 0 else None))
        p = adjusted_p([z for _, _, z in found], todo, len(d.factors[factor]), adjust)
        contrasts += [(None if bl is None else str(bl), f"{a} - {b}", est, se, z, pv, est - Z975 * se, est + Z975 * se)
                      for (a, b), (est, se, z), pv in zip(todo, found, p)]
    return (spark.createDataFrame(means, MEANS_SCHEMA),
            spark.createDataFrame(contrasts, CONTRAST_SCHEMA))


def _partitions(items: Sequence) -> Iterator[list[list]]:
    """All ways to part ``items`` into blocks of equal means."""
    if not items:
        yield []
        return
    for rest in _partitions(items[1:]):
        yield [[items[0]], *rest]
        for i, block in enumerate(rest):
            yield [*rest[:i], [items[0], *block], *rest[i + 1:]]


def most_true(pairs: Sequence[tuple], rejected: Sequence[tuple]) -> int:
    """How many of the equalities ``pairs`` can hold together when those in
    ``rejected`` don't: means fall into blocks of equal ones."""
    names = sorted({v for p in pairs for v in p})
    gone = {frozenset(p) for p in rejected}
    best = 0
    for blocks in _partitions(names):
        true = [p for p in pairs if any(p[0] in b and p[1] in b for b in blocks)]
        if not any(frozenset(p) in gone for p in true):
            best = max(best, len(true))
    return best


#: Levels up to which all partitions are gone through; with more the number of
#: hypotheses left bounds them (Holm), which is never too small.
SHAFFER_LEVELS = 8


def adjusted_p(z: Sequence[float | None], pairs: Sequence[tuple], k: int, adjust: str | None = None) -> list[float | None]:
    """Two-sided p-values of contrasts between pairs of ``k`` means."""
    plain = [two_sided_normal_p(v) if v is not None else None for v in z]
    if adjust is None:
        return plain
    if adjust == "tukey":
        return [float(studentized_range_sf(abs(v) * math.sqrt(2), k)[0]) if v is not None else None for v in z]
    if adjust != "shaffer":
        raise ValueError(f"unknown adjustment: {adjust}")
    out: list[float | None] = [None] * len(plain)
    order = sorted((i for i, p in enumerate(plain) if p is not None), key=lambda i: (plain[i], i))
    known, largest = [pairs[i] for i in order], 0.0
    few = len({v for p in known for v in p}) <= SHAFFER_LEVELS
    for place, i in enumerate(order):
        true = most_true(known, known[:place]) if few else len(known) - place
        largest = max(largest, min(1.0, true * plain[i]))
        out[i] = largest
    return out
