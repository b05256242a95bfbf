"""Readers of raw extracts.

The reference reads spreadsheets; here the same extracts arrive as CSV or Parquet
(a spreadsheet is a single-machine format: export it once).  Readers use an explicit
all-string schema for dirty CSV text and coerce with the guarded casts, so a bad
cell becomes NULL instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.scalar import safe_double
from panelcast.operators.clean import EVENT_RENAMES, clean_events, keep_rename
from panelcast.operators.panel import merge_series
from panelcast.operators.reshape import coded_extract_to_long, wide_extract_to_long
from panelcast.sources.headed import headed_files


def _read(spark: SparkSession, path: str, fmt: str, skip_rows: int = 0, header: bool = True) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if skip_rows == 0:
        return spark.read.option("header", header).option("inferSchema", False).csv(path)
    return _read_after_preamble(spark, path, skip_rows)


def _read_after_preamble(spark: SparkSession, path: str, skip_rows: int) -> DataFrame:
    """CSV files that each start with ``skip_rows`` lines of preamble (blank ones included)
    and a header; all must have the same columns, in any order."""
    parts = headed_files(spark, path, skip_rows)
    out = None
    for names, rows in parts:
        if sorted(names) != sorted(parts[0][0]):
            raise ValueError(f"{path}: files with different headers")
        rows = rows.select(*[F.col(f"`{n}`") for n in parts[0][0]])
        out = rows if out is None else out.unionByName(rows)
    return out


def _has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def load_wide_indicator(spark: SparkSession, path: str, value_name: str, entities: Iterable[str] | None = None,
                        *, fmt: str = "csv", skip_rows: int = 3, entity_col: str = "Country Code",
                        id_cols=("Country Name", "Country Code", "Indicator Name", "Indicator Code")) -> DataFrame:
    """Wide indicator extract (preamble rows, one column per year) to
    ``(entity, t, value_name)``; entity filter before the melt, NULLs dropped."""
    df = _read(spark, path, fmt, skip_rows)
    return wide_extract_to_long(df, entity_col, value_name, entities, id_cols=list(id_cols))


def load_coded_extract(spark: SparkSession, path: str, value_name: str, entities: Iterable[str] | None = None,
                       *, fmt: str = "csv") -> DataFrame:
    """Coded extract (``[YRdddd]`` columns).  When the header lacks ``Series Code``
    or ``Country Code``, re-read skipping the 3 preamble rows."""
    df = _read(spark, path, fmt)
    if fmt == "csv":
        df = _read_after_preamble(spark, path, 0 if _has_columns(df, "Series Code", "Country Code") else 3)
    return coded_extract_to_long(df, value_name, entities)


def load_macros(spark: SparkSession, paths: Mapping[str, str], entities: Iterable[str] | None = None,
                *, fmt: str = "csv") -> DataFrame:
    """Several coded extracts merged into one block (J3, full outer on keys)."""
    series = [load_coded_extract(spark, p, name, entities, fmt=fmt) for name, p in paths.items()]
    return merge_series(series)


def load_event_list(spark: SparkSession, path: str, entity: str | None = None, *, fmt: str = "csv",
                    entity_col: str | None = None) -> DataFrame:
    """S3: event list -> keep 8 columns, rename, clean (P4-P7).  ``entity`` tags a
    single-entity file; ``entity_col`` reads it from a column."""
    df = _read_after_preamble(spark, path, 0) if fmt == "csv" else _read(spark, path, fmt)    # names may hold line ends
    mapping = dict(EVENT_RENAMES)
    if entity_col:
        mapping[entity_col] = "entity"
    out = keep_rename(df, mapping).withColumnRenamed("year", "t")
    if not entity_col:
        out = out.withColumn("entity", F.lit(entity))
    return clean_events(out)


def load_dated_series(spark: SparkSession, path: str, *, fmt: str = "csv", date_col: str = "observation_date",
                      value_col: str = "POILAPSPUSDA", value_name: str = "oil_price_usd",
                      average_per_year: bool = False) -> DataFrame:
    """Two-column dated series to ``(t = year, value)``."""
    return dated_series_to_annual(_read(spark, path, fmt), date_col=date_col, value_col=value_col,
                                  value_name=value_name, average_per_year=average_per_year)


def dated_series_to_annual(df: DataFrame, *, date_col: str = "observation_date", value_col: str = "POILAPSPUSDA",
                           value_name: str = "oil_price_usd", average_per_year: bool = False) -> DataFrame:
    """S6 on a DataFrame: named columns when present, else first and second column;
    year of the date; NULL values dropped.  The reference does not group (the file
    must already be annual); ``average_per_year`` averages duplicates instead."""
    dcol = date_col if date_col in df.columns else df.columns[0]
    vcol = value_col if value_col in df.columns else df.columns[1]
    out = df.select(F.year(F.to_timestamp(F.col(f"`{dcol}`"))).alias("t"),
                    safe_double(F.col(f"`{vcol}`")).alias(value_name)).dropna(subset=[value_name])
    if average_per_year:
        out = out.groupBy("t").agg(F.avg(value_name).alias(value_name))
    return out
