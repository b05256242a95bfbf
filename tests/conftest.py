import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from panelcast.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def series_frame(spark, n, entity=1, start=100, y=None, extra=None):
    """One entity, n consecutive periods, simple target values."""
    import numpy as np
    rng = np.random.default_rng(entity)
    ys = y if y is not None else rng.normal(2.0, 1.5, n).round(6).tolist()
    rows = [(entity, start + i, float(ys[i])) for i in range(n)]
    return spark.createDataFrame(rows, "entity int, t int, y double")
