"""Column expressions with IEEE float semantics.

Spark's ANSI mode raises on division by zero and sorts NaN above every number;
price arithmetic wants plain IEEE results with NULL reserved for "not there".
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
NAN = float("nan")


def utc_literal(at: datetime) -> Column:
    """Timestamp literal; a time without a zone is UTC, wherever the driver runs."""
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ieee_div(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with x/0 = +-inf and 0/0 = NaN; NULL in, NULL out."""
    num, den = _c(num), _c(den)
    return F.when(den == 0, num * F.lit(INF)).otherwise(num / F.nullif(den, F.lit(0)))


def is_finite(x: Column | str) -> Column:
    """True for ordinary numbers; false for NULL, NaN and infinities."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def finite_or_zero(x: Column | str) -> Column:
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(0.0)).otherwise(x)


def inf_to_nan(x: Column | str) -> Column:
    x = _c(x)
    return F.when(F.abs(x) == F.lit(INF), F.lit(NAN)).otherwise(x)


def replace_infinite_with_nan(df: DataFrame) -> DataFrame:
    """Turn +-inf into NaN in floating columns; other columns stay as they are."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            inf_to_nan(f.name).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows without NULLs. NaN is a value here, so ``na.drop`` will not do."""
    columns = df.columns if columns is None else columns
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def clip_lower(x: Column | str, bound: float) -> Column:
    x = _c(x)
    return F.when(x < bound, F.lit(bound)).otherwise(x)


def clip_upper(x: Column | str, bound: float) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x) & (x > bound), F.lit(bound)).otherwise(x)


def log1p_ieee(x: Column | str) -> Column:
    """log(1+x) with log1p(-1) = -inf and NaN below, where Spark gives NULL."""
    x = _c(x).cast("double")
    return (
        F.when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x))
    )


def iso_weekday(ts: Column | str) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(_c(ts)) + 1


def month_key(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")
