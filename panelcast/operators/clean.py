"""Projection, filter, cast and null-handling operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StringType

from panelcast.functions.scalar import (is_finite, non_negative_or_null, safe_double, safe_int,
                                        thousands_to_units)

# The event-list columns kept by the loader and their new names.
EVENT_RENAMES = {
    "Disaster Type": "disaster_type",
    "Disaster Subtype": "disaster_subtype",
    "Event Name": "event_name",
    "Magnitude": "magnitude",
    "Magnitude Scale": "magnitude_scale",
    "Total Deaths": "deaths",
    "Total Damage ('000 US$)": "damage_usd_thousands",
    "Start Year": "year",
}


class MissingColumnsError(ValueError):
    """Raised when required columns are absent."""


def keep_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns and rename them (one projection)."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])


def filter_entities(df: DataFrame, entities: Iterable | None, col: str = "entity") -> DataFrame:
    """Entity filter; ``None`` keeps all entities."""
    if entities is None:
        return df
    return df.filter(F.col(col).isin(list(entities)))


def drop_null_keys(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any key column."""
    return df.dropna(subset=list(subset))


def require_columns(df: DataFrame, required: Sequence[str], what: str = "input") -> DataFrame:
    """Named error when required columns are missing (checks the schema only)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing columns in {what}: {missing}")
    return df


def fill_zero(df: DataFrame, columns: Sequence[str], int_columns: Sequence[str] = ()) -> DataFrame:
    """NULL to zero on named columns; ``int_columns`` become bigint counts."""
    present = [c for c in columns if c in df.columns]
    out = df.fillna(0.0, subset=[c for c in present if c not in int_columns])
    for c in int_columns:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    return out


def to_double(df: DataFrame, c: str):
    """P4 that only parses text when the column *is* text; numeric columns are cast
    directly (no string round trip in the hot path), NaN/inf still become NULL."""
    if isinstance(df.schema[c].dataType, StringType):
        return safe_double(c)
    x = F.col(c).cast("double")
    return F.when(is_finite(x), x)


def to_int(df: DataFrame, c: str):
    """P5 with the same text/number distinction."""
    if isinstance(df.schema[c].dataType, StringType):
        return safe_int(c)
    x = F.col(c).cast("double")
    return F.when(is_finite(x), x.try_cast("int"))


def clean_events(df: DataFrame, time_col: str = "t") -> DataFrame:
    """S3 cleaning chain on an event list that already has the short names:
    P4/P5 numeric coercion, rows without a period dropped, P6 unit conversion,
    P7 negative damages to unknown (both the thousands and the unit column)."""
    out = df.withColumn(time_col, to_int(df, time_col)).dropna(subset=[time_col])
    out = (out.withColumn("deaths", to_double(out, "deaths"))
              .withColumn("damage_usd_thousands", to_double(out, "damage_usd_thousands"))
              .withColumn("magnitude", to_double(out, "magnitude")))
    out = out.withColumn("damage_usd", thousands_to_units("damage_usd_thousands"))
    return (out.withColumn("damage_usd", non_negative_or_null("damage_usd"))
               .withColumn("damage_usd_thousands", non_negative_or_null("damage_usd_thousands")))


def start_filter(df: DataFrame, start: int | None, time_col: str = "t") -> DataFrame:
    """P10: start-of-sample filter.  Apply it *after* the lag/rolling window so lags
    reach back before the start (Catalyst keeps it above the Window node)."""
    return df if start is None else df.filter(F.col(time_col) >= F.lit(int(start)))


def exclude_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Exclude rows whose name starts with a prefix."""
    return df.filter(~F.col(col).startswith(prefix))


def with_zero_if_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absent columns read as zeros."""
    out = df
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    return out


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P4 over several columns."""
    return df.select(*[to_double(df, c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
