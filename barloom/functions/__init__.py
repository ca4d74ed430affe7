from barloom.functions.exprs import (
    clip_lower,
    clip_upper,
    drop_null_rows,
    finite_or_zero,
    ieee_div,
    inf_to_nan,
    is_finite,
    iso_weekday,
    log1p_ieee,
    month_key,
    replace_infinite_with_nan,
    utc_literal,
)

__all__ = [
    "clip_lower",
    "clip_upper",
    "drop_null_rows",
    "finite_or_zero",
    "ieee_div",
    "inf_to_nan",
    "is_finite",
    "iso_weekday",
    "log1p_ieee",
    "month_key",
    "replace_infinite_with_nan",
    "utc_literal",
]
