"""Scalar column functions (all JVM-side, codegen-friendly ``Column`` builders).

Each returns a ``Column``; nothing here runs a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as numeric before casting (plain decimal or scientific
# notation, optional sign and surrounding blanks).  Spark's try_cast alone accepts
# suffixes such as '12d' or '1.0f'; the reference treats those as missing.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Tokens read as boolean true by the tolerant text parser.
TRUE_TOKENS = ["1", "true", "t", "yes", "y"]
# Tokens read as boolean false by the tolerant text parser.
FALSE_TOKENS = ["0", "false", "f", "no", "n"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c) -> Column:
    """Text or number to double; bad text, NaN and +/-infinity become NULL."""
    col = _c(c)
    txt = col.cast("string")
    val = F.when(txt.rlike(NUMERIC_PATTERN), F.trim(txt).try_cast("double"))
    return F.when(is_finite(val), val)


def safe_int(c) -> Column:
    """P5: year-like text/number to int (via double, so '1995.0' is 1995), cut towards 0;
    out of int range is NULL."""
    return safe_double(c).try_cast("int")


def is_finite(c) -> Column:
    """True when the value is a real, finite number (not NULL, NaN or +/-inf)."""
    col = _c(c)
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def non_negative_or_null(c) -> Column:
    """Negative becomes unknown (NULL), not 0."""
    col = _c(c)
    return F.when(col >= 0, col)


def thousands_to_units(c) -> Column:
    """Unit conversion."""
    return _c(c) * F.lit(1000.0)


def log1p_zero(c) -> Column:
    """log(1 + x) with NULL read as 0."""
    return F.log1p(F.coalesce(_c(c).cast("double"), F.lit(0.0)))


def guarded_ratio(num, den) -> Column:
    """num/den when den > 0 else 0 (NULLs read as 0).  The guard also keeps ANSI
    mode from raising on division by zero."""
    n = F.coalesce(_c(num).cast("double"), F.lit(0.0))
    d = F.coalesce(_c(den).cast("double"), F.lit(0.0))
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def presence_flag(c) -> Column:
    """1 when the count is positive, else 0."""
    return (F.coalesce(_c(c), F.lit(0)) > 0).cast("int")


def square(c) -> Column:
    """square of time, computed in 64 bits."""
    col = _c(c).cast("bigint")
    return col * col


def regime_dummy(c, cutoff: int) -> Column:
    """1 from the cut-off period on."""
    return (_c(c) >= F.lit(cutoff)).cast("int")


def year_of(c) -> Column:
    """calendar year of a date, timestamp or date text."""
    return F.year(F.to_timestamp(_c(c)))


def month_index(c) -> Column:
    """Period index ``year*12 + month - 1`` of a date/timestamp."""
    col = _c(c)
    return F.year(col) * 12 + F.month(col) - 1


def error(y, p) -> Column:
    """signed error y - p."""
    return _c(y) - _c(p)


def abs_error(y, p) -> Column:
    """absolute error."""
    return F.abs(_c(y) - _c(p))


def tag_flags(tag) -> dict[str, Column]:
    """F8: run configuration read back from tag text."""
    t = F.lower(_c(tag))
    return {
        "mode": F.when(t.contains("nowcast"), F.lit("nowcast")).otherwise(F.lit("forecast")),
        "include_covid": t.contains("ex_post"),
        "include_macro": t.contains("macro"),
        "include_oil": t.contains("oil"),
        "restricted": t.contains("restricted"),
    }


def config_tag(*parts) -> Column:
    """tag text from configuration parts (NULL parts are skipped)."""
    return F.concat_ws("_", *[_c(p) for p in parts])


def tolerant_bool(c, default: bool = False) -> Column:
    """text or number to boolean.  Listed tokens count first, then any number (true
    unless 0); other text is false, and only a missing value takes the default."""
    t = F.lower(F.trim(_c(c).cast("string")))
    number = safe_double(t)
    return (F.when(t.isNull(), F.lit(default))
             .when(t.isin(TRUE_TOKENS), F.lit(True))
             .when(t.isin(FALSE_TOKENS), F.lit(False))
             .otherwise(F.coalesce(number != 0, F.lit(False))))


def tolerant_int(c, default: int | None = None) -> Column:
    """tolerant text to int with a default."""
    v = safe_int(c)
    return v if default is None else F.coalesce(v, F.lit(default))


def tolerant_float(c, default: float | None = None) -> Column:
    """tolerant text to double with a default."""
    v = safe_double(c)
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def format_number3(c) -> Column:
    """three decimals, blank when missing or not finite."""
    col = _c(c).cast("double")
    return F.when(is_finite(col), F.format_string("%.3f", col)).otherwise(F.lit(""))


def clip_lower0(c) -> Column:
    """clip at 0 after reading NULL as 0."""
    return F.greatest(F.coalesce(_c(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def sentinel_to_null(c) -> Column:
    """``-1`` ("no start year") back to NULL."""
    col = _c(c)
    return F.when(col >= 0, col)


def null_to_sentinel(c) -> Column:
    """NULL start year to the ``-1`` sentinel."""
    return F.coalesce(_c(c), F.lit(-1))


def sanitize(p, fallback) -> Column:
    """Non-finite prediction replaced by a fallback (e.g. the train mean)."""
    col = _c(p)
    return F.when(is_finite(col), col).otherwise(_c(fallback) if not isinstance(fallback, (int, float)) else F.lit(float(fallback)))


def column_or_zero(df, name: str) -> Column:
    """A missing column reads as zeros."""
    return F.col(name) if name in df.columns else F.lit(0.0)
