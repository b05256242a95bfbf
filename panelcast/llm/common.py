"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; one of our own only for a local
    master where none is named (tests).  On a cluster a missing setting is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="corpus-ckpt-")
    sc.setCheckpointDir(folder)


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and go on from its files,
    so that several readers, a later step or a lost executor never run its plan again.
    (A plan read from files also has true sizes; those of checkpointed joins multiply.)"""
    spark = df.sparkSession
    folder = folder or _folder(spark)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def materialize_by(df: DataFrame, key: str) -> DataFrame:
    """As ``materialize``, with the files bucketed by ``key``: grouping by it reads them without
    a shuffle.  (Buckets need a table's name; it goes at once, the files stay.)"""
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), key).option("path", _folder(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


class Steps:
    """The states of an iteration, written to two folders in turn: each state replaces the
    last but one, so the folder does not grow with the number of steps."""

    def __init__(self, spark: SparkSession):
        self.folders = [_folder(spark), _folder(spark)]

    def put(self, df: DataFrame) -> DataFrame:
        self.folders.reverse()
        return materialize(df, self.folders[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def train_fold(key: Column) -> Column:
    """True for rows whose labels may be learned: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """All rows of ``df`` if there are at most ``bound``, else about ``bound`` of them, picked by
    a seeded hash of the key (the same rows every time, without a sort)."""
    n = df.count()
    if n <= bound:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(scale)) < int(scale * bound / n))


def train_labels(labels: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """(doc_id, y) of at most about ``bound`` labelled ids of the training fold.  Ids that
    are labelled more than once take the label most of their rows give (1 on a tie)."""
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train_fold(F.col("doc_id")))
            .groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y")))
    return bounded_sample(rows, "doc_id", bound, seed)
