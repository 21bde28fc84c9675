"""Scalar column functions (projection, recode, units, logs, time parsing).

All of these build Catalyst expressions, so they stay inside whole-stage
codegen and are pushed/pruned with the rest of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed unit factors used by the field study (values must stay as stated).
M_TO_MM = 1000.0          # rain depth, metres -> millimetres
LB_AC_TO_KG_HA = 1.12     # load, lb/ac -> kg/ha
AC_TO_HA = 0.404686       # area, acres -> hectares
MIN_TO_H = 1.0 / 60.0     # duration, minutes -> hours

# Fixed text formats of timestamps seen in the study's tables, in the order
# they are tried (Spark datetime patterns).
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy/M/d H:mm",
    "M/d/yyyy H:mm",
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Value map with a literal default; NULL input stays NULL.

    The mapping becomes a literal map expression (no join). For mappings
    that come from data, join a lookup table instead (``filters.attach``).
    """
    x = _col(c)
    m = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    hit = F.element_at(m, x) if mapping else F.lit(None)
    out = hit if default is None else F.coalesce(hit, F.lit(default))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def label_when(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """Multi-branch label: first true condition wins, else ``default``."""
    expr = None
    for cond, value in cases:
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def positive_flag(c: str | Column) -> Column:
    """1 when x > 0, 0 when x <= 0, NULL when x is NULL."""
    return (_col(c) > 0).cast("int")


def rate(num: str | Column, den: str | Column) -> Column:
    """num / den; NULL where den is 0 or NULL (R would give Inf/NA)."""
    return F.try_divide(_col(num), _col(den))


def ln_offset(c: str | Column, offset: float = 0.0) -> Column:
    """ln(x + offset). Spark's ln(0) is NULL (R gives -Inf); the offset keeps
    zero loads finite, as the study does."""
    x = _col(c)
    return F.ln(x + F.lit(offset)) if offset else F.ln(x)


def with_logs(df: DataFrame, mapping: Mapping[str, str], offset: float = 0.0) -> DataFrame:
    """Add ln columns in one projection: ``{new_name: source_col}``."""
    return df.withColumns({k: ln_offset(v, offset) for k, v in mapping.items()})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]


def clamp_nonnegative(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Floor numeric columns at zero; NULL stays NULL."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0).cast(df.schema[c].dataType))
                           .otherwise(F.col(c)) for c in cols})


def zero_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Turn placeholder zeros into NULL."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in cols})


def fill_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def prefix_upper(c: str | Column, n: int = 3) -> Column:
    return F.upper(F.substring(_col(c), 1, n))


def suffix(c: str | Column, n: int = 3) -> Column:
    return F.right(_col(c), F.lit(n))


def parse_timestamp(c: str | Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """Parse text in any of ``formats`` to TIMESTAMP_NTZ (first match wins)."""
    x = _col(c)
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def duration_minutes(start: str | Column, end: str | Column, plus: float = 1.0) -> Column:
    """Inclusive duration in minutes: (end - start) + ``plus`` minutes."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return micros / F.lit(60_000_000.0) + F.lit(plus)


def floor_time(c: str | Column, seconds: int) -> Column:
    """Floor a TIMESTAMP_NTZ to a multiple of ``seconds`` since the epoch
    (time-zone independent)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    secs = F.timestamp_diff("SECOND", epoch, _col(c))
    return F.timestamp_add("SECOND", F.floor(secs / seconds) * seconds, epoch)


def time_bucket_index(c: str | Column, seconds: int) -> Column:
    """Integer bucket number of a timestamp (epoch seconds // seconds)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, _col(c)) / seconds).cast("long")


def factor_code(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of x in the ordered ``levels``; NULL if absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return F.when(pos > 0, pos.cast("int"))


def split_key(df: DataFrame, col: str, names: Sequence[str], sep: str = ":") -> DataFrame:
    """Split a composite key ``a:b:c`` into named columns."""
    parts = F.split(F.col(col), sep)
    return df.withColumns({n: parts.getItem(i) for i, n in enumerate(names)})


def join_resolve(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                 prefer: str = "left", suffixes: tuple[str, str] | None = None) -> DataFrame:
    """Join on ``on`` and resolve clashing non-key columns.

    ``prefer='left'`` keeps the left copy under the plain name (R's
    ``Year = Year.x``); with ``suffixes`` both copies are kept, renamed.
    """
    l, r = left.alias("_l"), right.alias("_r")
    clash = [c for c in left.columns if c in right.columns and c not in on]
    j = l.join(r, list(on), how)
    cols = [F.col(k) for k in on]
    for c in left.columns:
        if c in on:
            continue
        if c in clash and suffixes:
            cols.append(F.col(f"_l.{c}").alias(c + suffixes[0]))
        elif c in clash and prefer == "right":
            continue
        else:
            cols.append(F.col(f"_l.{c}"))
    for c in right.columns:
        if c in on:
            continue
        if c in clash and suffixes:
            cols.append(F.col(f"_r.{c}").alias(c + suffixes[1]))
        elif c in clash and prefer == "left":
            continue
        else:
            cols.append(F.col(f"_r.{c}"))
    return j.select(*cols)
