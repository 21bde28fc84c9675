"""H3: design matrices with treatment contrasts, as native Spark columns.

A model is an explicit term list, e.g. ``[("T",), ("x",), ("T", "x")]`` for
``T * x``. A variable named in ``factors`` is categorical with the given
level order (first level is the reference and gets no column); any other
variable is numeric. A term's columns are the products of its variables'
encodings, so ``T:x`` gives one ``T[level]:x`` column per non-reference level
(no collinear duplicates, unlike RFormula's interaction expansion).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = tuple[str, ...]


@dataclass
class Design:
    """Column layout of a model: ``terms`` in order, their column names, and
    the factor levels used."""
    terms: list[Term]
    factors: dict[str, list]
    term_columns: dict[Term, list[str]] = field(default_factory=dict)
    column_parts: dict[str, list[tuple[str, object]]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c for t in self.terms for c in self.term_columns[t]]

    @property
    def spark_columns(self) -> list[str]:
        """Plain internal names of the design columns in Spark (``_x0`` ...)."""
        return [f"_x{i}" for i in range(len(self.columns))]

    @property
    def variables(self) -> list[str]:
        seen = []
        for t in self.terms:
            for v in t:
                if v not in seen:
                    seen.append(v)
        return seen

    def subset(self, terms: Sequence[Term]) -> "Design":
        keep = [t for t in self.terms if t in set(terms)]
        return Design(keep, self.factors, {t: self.term_columns[t] for t in keep},
                      self.column_parts)


def term_name(term: Term) -> str:
    return ":".join(term)


def build_design(terms: Sequence[Sequence[str]], factors: Mapping[str, Sequence]) -> Design:
    """Column names and recipes for ``terms`` (no data touched)."""
    d = Design([tuple(t) for t in terms], {k: list(v) for k, v in factors.items()})
    for t in d.terms:
        choices = []
        for v in t:
            if v in d.factors:
                choices.append([(v, lvl) for lvl in d.factors[v][1:]])
            else:
                choices.append([(v, None)])
        cols = []
        for combo in product(*choices):
            name = ":".join(f"{v}[{lvl}]" if lvl is not None else v for v, lvl in combo)
            d.column_parts[name] = list(combo)
            cols.append(name)
        d.term_columns[t] = cols
    return d


def column_expr(design: Design, name: str) -> Column:
    """The Catalyst expression of one design column."""
    expr = F.lit(1.0)
    for v, lvl in design.column_parts[name]:
        part = (F.when(F.col(v) == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0))
                if lvl is not None else F.col(v).cast("double"))
        expr = expr * part
    return expr


def model_rows(df: DataFrame, design: Design, present: Sequence[str] = ()) -> DataFrame:
    """Rows with every model variable (and ``present``) there and every factor
    at one of its declared levels; R drops the others the same way."""
    rows = df.dropna(subset=[*present, *design.variables])
    for v in design.variables:
        if v in design.factors:
            rows = rows.where(F.col(v).isin(design.factors[v]))
    return rows


def with_design(df: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """``model_rows`` projected to ``keep`` plus the design columns under
    ``design.spark_columns``."""
    return model_rows(df, design).select(*keep, *[column_expr(design, c).alias(s)
                                for c, s in zip(design.columns, design.spark_columns)])


def row_vector(design: Design, values: Mapping[str, object]) -> list[float]:
    """Design row (with leading intercept 1) for one point of a reference grid."""
    out = [1.0]
    for c in design.columns:
        x = 1.0
        for v, lvl in design.column_parts[c]:
            if lvl is not None:
                x *= 1.0 if values[v] == lvl else 0.0
            else:
                x *= float(values[v])
        out.append(x)
    return out
