"""Result tables: write, read, scan.

Tables are partitioned by ``tag``: a run overwrites only its own partition
(dynamic partition overwrite) and a read of one tag prunes every other partition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources.headed import headed_files


class MissingResultError(FileNotFoundError):
    """S8 with ``missing="error"``: the table or the tag is absent."""


def write_tagged(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a tagged result table; only the partitions of the tags present in
    ``df`` are replaced."""
    if "tag" not in df.columns:
        raise ValueError("result tables need a 'tag' column")
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("tag")
       .format(fmt)
       .save(path))


def _load(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_tagged(spark: SparkSession, path: str, tag: str | None = None, *, missing: str = "empty",
                schema: str | None = None, fmt: str = "parquet") -> DataFrame | None:
    """Read one tag (partition pruning) or all.  When missing: ``"empty"`` returns
    an empty frame (needs ``schema``), ``"error"`` raises, ``"none"`` returns None."""
    df = _load(spark, path, fmt)
    if df is None:
        return _missing(spark, path, missing, schema)
    if tag is not None:
        df = df.filter(F.col("tag") == tag)
        if missing != "empty" and df.limit(1).count() == 0:
            return _missing(spark, f"{path} [tag={tag}]", missing, schema)
    return df


def _missing(spark, what, missing, schema):
    if missing == "error":
        raise MissingResultError(what)
    if missing == "none":
        return None
    return spark.createDataFrame([], schema or "tag string")


def latest_tag(spark: SparkSession, path: str, fmt: str = "parquet") -> str | None:
    """Tag of the newest run by file modification time (one row to the driver)."""
    df = spark.read.format(fmt).load(path).select("tag", F.col("_metadata.file_modification_time").alias("mt"))
    row = df.orderBy(F.col("mt").desc(), F.col("tag").desc()).limit(1).collect()
    return row[0]["tag"] if row else None


def write_runs(df: DataFrame, root: str, *, prefix: str = "model_metrics_", fmt: str = "csv", mode: str = "overwrite") -> str:
    """Every run's table in a folder of its own, ``<root>/<prefix>runs/tag=<tag>``, by one
    partitioned write.  Returns the glob that finds them all."""
    path = f"{root.rstrip('/')}/{prefix}runs"
    w = df.repartition("tag").write.mode(mode).partitionBy("tag")   # one file a run
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return f"{path}/tag=*"


def _tag_of(path, prefix: str):
    """The tag in ``.../tag=<tag>/...`` or ``.../<prefix><tag>.<ext>[/...]``."""
    folder = F.url_decode(F.regexp_extract(path, r"/tag=([^/]+)/", 1))
    return F.when(folder != "", folder).otherwise(
        F.regexp_extract(path, f"{prefix}([^/]+?)\\.[A-Za-z0-9]+(/[^/]*)?$", 1))


def latest_run(spark: SparkSession, glob: str, *, prefix: str = "model_metrics_") -> DataFrame:
    """S9 over per-run files: the run whose file was modified last (ties: larger tag), as a
    one-row DataFrame.  A listing answers it; no file is opened."""
    runs = spark.read.format("binaryFile").load(glob).select(_tag_of(F.col("path"), prefix).alias("tag"), "modificationTime")
    return runs.orderBy(F.col("modificationTime").desc(), F.col("tag").desc()).limit(1).select("tag")


def scan_runs(spark: SparkSession, glob: str, *, prefix: str = "model_metrics_", fmt: str = "csv",
              schema: str | None = None) -> DataFrame:
    """Read every per-run file matching a glob (a file, or a folder of part files, named
    ``<prefix><tag>.<ext>`` or ``tag=<tag>``); the tag comes from that name; unreadable files
    are skipped.

    With a ``schema``, CSV columns are taken by their name in each file's header and cast;
    a column that a file lacks, or a value that does not fit, is NULL."""
    if fmt != "csv" or not schema:
        reader = spark.read.option("ignoreCorruptFiles", "true")
        reader = reader.option("header", True).option("inferSchema", True) if fmt == "csv" else reader
        df = reader.format(fmt).load(glob)
        return df.withColumn("tag", _tag_of(F.col("_metadata.file_path"), prefix))
    fields = T.StructType.fromDDL(schema).fields
    out = None
    for names, rows in headed_files(spark, glob, corrupt="skip"):
        columns = [(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in fields]
        part = rows.select(*columns, _tag_of(F.col("_file"), prefix).alias("tag"))
        out = part if out is None else out.unionByName(part)
    return out


def read_best_params(spark: SparkSession, path: str, tag: str, model: str) -> dict:
    """Tuned parameters of a tag and model (NULLs dropped); on any error, an empty
    dict so the caller keeps its defaults."""
    try:
        df = read_tagged(spark, path, tag, missing="none")
        if df is None:
            return {}
        df = df.filter(F.col("model") == model) if "model" in df.columns else df
        rows = df.drop("tag", "model").limit(1).collect()
        if not rows:
            return {}
        from panelcast.operators.trees import PARAM_NAMES
        out = {}
        for k, v in rows[0].asDict().items():
            if v is None:
                continue
            name = k.replace("model__", "")
            out[PARAM_NAMES.get(name, name)] = v
        return out
    except Exception:
        return {}


def apply_params(estimator, params: Mapping):
    """Copy of an MLlib estimator with the given params (unknown names ignored)."""
    pm = {}
    for k, v in params.items():
        if estimator.hasParam(k):
            p = estimator.getParam(k)
            cur = estimator.getOrDefault(p) if estimator.isDefined(p) else None
            pm[p] = type(cur)(v) if cur is not None and v is not None else v
    return estimator.copy(pm)
