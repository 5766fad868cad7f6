"""Column functions: normalisation, safe arithmetic and codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The text that stands for a missing dimension value, and the bounds for infinite ratios.
MISSING = "none"
INFINITE = 999.0


def col_of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Drop all leading and trailing white space (``trim`` drops spaces only)."""
    return F.regexp_replace(col_of(x).cast("string"), r"^\s+|\s+$", "")


def normalize_value(x: Column | str, floating: bool = False) -> Column:
    """Trimmed text; NULL and blank become ``'none'``, and NaN too for a floating-point source."""
    text = F.nullif(strip(x), F.lit(""))
    if floating:
        text = F.nullif(text, F.lit("NaN"))
    return F.coalesce(text, F.lit(MISSING))


def numeric(x: Column | str, digits: int = 4) -> Column:
    """Report rounding: NULL and NaN to 0, infinities to +-999, half-even to ``digits``."""
    d = col_of(x).cast("double")
    return (
        F.when(d.isNull() | F.isnan(d), F.lit(0.0))
        .when(d == float("inf"), F.lit(INFINITE))
        .when(d == float("-inf"), F.lit(-INFINITE))
        .otherwise(F.bround(d, digits))
    )


def ratio_or_zero(n: Column, d: Column) -> Column:
    """n / d, 0 where the denominator is not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def ratio_or_null(n: Column, d: Column) -> Column:
    """n / d, NULL where the denominator is 0 or NULL."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def normalized_code(x: Column | str) -> Column:
    """Code text without a trailing ``.0``; NULL becomes the empty text."""
    return F.regexp_replace(F.coalesce(strip(x), F.lit("")), r"\.0$", "")


def safe_double(x: Column | str) -> Column:
    """Double, NULL where the text is not a number (a plain cast raises in ANSI mode)."""
    return col_of(x).try_cast("double")


def rate_label(x: Column | str, missing: str = "null") -> Column:
    """Shortest text of a rate with up to six digits (0.5, 1, 0.05)."""
    text = F.bround(col_of(x).cast("double"), 6).cast("string")
    return F.coalesce(F.regexp_replace(text, r"\.0$", ""), F.lit(missing))


def valid_partition_id(x: Column | str) -> Column:
    """Eight digits that form a real date."""
    c = col_of(x)
    return F.coalesce(c.rlike("^[0-9]{8}$") & F.try_to_timestamp(c, F.lit("yyyyMMdd")).isNotNull(), F.lit(False))


def partition_day(x: Column | str) -> Column:
    return F.to_date(F.try_to_timestamp(col_of(x), F.lit("yyyyMMdd")))


def code_map(mapping: dict) -> Column:
    parts: list[Column] = []
    for key, value in mapping.items():
        parts += [F.lit(key), F.lit(value)]
    return F.create_map(*parts)


def ladder(x: Column, steps: Sequence[tuple[float | None, object]]) -> Column:
    """First step whose upper bound is above x; the last step has bound None and takes the rest."""
    out: Column | None = None
    for bound, value in steps[:-1]:
        cond = x < F.lit(float(bound))
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    last = F.lit(steps[-1][1])
    return last if out is None else out.otherwise(last)


def json_number(x: Column | str) -> Column:
    """Double that JSON can carry: non-finite values become NULL."""
    d = col_of(x).cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d)


def with_absent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table with every named column; those it lacks hold NULL, so that results have the same columns anywhere."""
    lacking = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("double") for n in lacking}) if lacking else df
