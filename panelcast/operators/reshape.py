"""Reshape operators: wide to long, long to wide, labels to periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import safe_double, safe_int

YEAR_LABEL_PATTERN = r"\[YR(\d{4})\]"


def year_label_columns(columns: Sequence[str]) -> list[str]:
    """R2: columns whose name carries a ``[YRdddd]`` label."""
    return [c for c in columns if isinstance(c, str) and "[YR" in c]


def melt(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
         var_name: str, value_name: str) -> DataFrame:
    """Wide to long with ``DataFrame.unpivot`` (physical ``Expand``).  Values are
    cast to string first so mixed text/number columns share one type."""
    wide = df.select(*[F.col(f"`{c}`") for c in id_cols],
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in value_cols])
    return wide.unpivot([F.col(f"`{c}`") for c in id_cols], list(value_cols), var_name, value_name)


def year_from_label(c) -> F.Column:
    """Year out of a ``... [YRdddd]`` label (NULL when absent)."""
    col = F.col(c) if isinstance(c, str) else c
    txt = F.regexp_extract(col, YEAR_LABEL_PATTERN, 1)
    return F.when(txt != "", txt.cast("int"))


def pivot_mean(df: DataFrame, index: str, columns: str, values: str,
               column_values: Sequence[str] | None = None) -> DataFrame:
    """Long to wide with a mean per cell.  Passing the column values saves the
    distinct-values job Spark would otherwise run."""
    g = df.groupBy(index)
    g = g.pivot(columns, list(column_values)) if column_values is not None else g.pivot(columns)
    return g.agg(F.avg(values))


def wide_extract_to_long(df: DataFrame, entity_col: str, value_name: str,
                         entities=None, id_cols: Sequence[str] | None = None) -> DataFrame:
    """Plain wide extract (one column per year, header = year) to
    ``(entity, t, value)``: entity filter first (pushed below the Expand), melt all
    non-id columns, coerce, drop NULLs."""
    ids = list(id_cols) if id_cols is not None else [
        c for c in df.columns if not safe_year_header(c)]
    src = df if entities is None else df.filter(F.col(f"`{entity_col}`").isin(list(entities)))
    years = [c for c in df.columns if c not in ids]
    long = melt(src, ids, years, "year_raw", "value_raw")
    return (long.select(F.col(f"`{entity_col}`").alias("entity"),
                        safe_int("year_raw").alias("t"),
                        safe_double("value_raw").alias(value_name))
                .dropna(subset=["t", value_name]))


def safe_year_header(name: str) -> bool:
    try:
        float(name)
        return True
    except (TypeError, ValueError):
        return False


def coded_extract_to_long(df: DataFrame, value_name: str, entities=None,
                          entity_col: str = "Country Code", series_col: str = "Series Code") -> DataFrame:
    """Coded wide extract (``[YRdddd]`` columns) to ``(entity, t, value)``.
    Rows without a series code are preamble or footer and are dropped first."""
    src = df.filter(F.col(f"`{series_col}`").isNotNull())
    if entities is not None:
        src = src.filter(F.col(f"`{entity_col}`").isin(list(entities)))
    years = year_label_columns(df.columns)
    long = melt(src, [series_col, entity_col], years, "year_raw", "value_raw")
    return (long.select(F.col(f"`{entity_col}`").alias("entity"),
                        year_from_label("year_raw").alias("t"),
                        safe_double("value_raw").alias(value_name))
                .dropna(subset=[value_name]))
