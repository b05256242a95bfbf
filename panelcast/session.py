"""Session helpers: one place that knows about Spark configuration.

Library functions never create sessions; they take DataFrames.  These helpers are
for scripts, tests and ``bench.py``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "panelcast") -> SparkSession:
    """Session tuned for the panel workload.

    * AQE on: shuffle partitions are coalesced at run time and small derived sides
      (period tables, per-group statistics) become broadcast joins only after their
      materialised size has been measured.
    * Session time zone pinned to UTC so calendar derivations are stable.
    * UI off (no server).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master is None or master.startswith("local"):
        # single JVM: partitions ~ cores, memory is the driver's.  On a cluster the
        # cluster's shuffle-partition setting stays and AQE coalesces small stages.
        cpus = os.cpu_count() or 8
        b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
              .config("spark.driver.memory", os.environ.get("PANELCAST_DRIVER_MEMORY", "16g")))
    elif shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``.  Only where it is unset and the master is
    local (tests), a folder of our own, which goes when the process ends."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder every "
                               "executor can reach (a machine-local folder does not survive "
                               "executor loss)")
        configured = tempfile.mkdtemp(prefix="panelcast-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used before loops that reuse one table many times (model search, folds), so a
    lost executor re-reads the checkpoint instead of re-running the whole plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
