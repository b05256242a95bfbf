"""CSV text files that each carry their own preamble and header.

Spark's CSV reader takes one header for a whole folder and knows no preamble.  Here the
header is found in every file, and a quoted value may hold line ends.

*Records by quote parity.*  A line end ends a record where an even number of quotes comes
before it.  Every split of a file reports the parity of its quotes; a running sum over the
file's splits (a row each) says whether a split begins inside a quoted value, and a running
sum inside the split does the rest.  Lines of one record are then joined.  Files without
such values, all lines of which have an even number of quotes, skip that step.

Lines are numbered once and written, so that every later step sees the same numbers.  Only
the distinct headers (a few lines) reach the driver.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.session import materialize


def _numbered(lines: DataFrame) -> DataFrame:
    """(_file, _record, value) from lines (_file, _block, _at, value): records, from 0, of files whose
    quoted values hold line ends.  No task holds more than a split or a record."""
    split = ["_file", "_block"]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("_odd", quotes % 2)
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)     # a row a split
    inside = Window.partitionBy(*split).orderBy("_at")

    def so_far(column: str) -> DataFrame:
        """The sum of a column over the splits of the file before each."""
        sums = lines.groupBy(*split).agg(F.sum(column).alias("_sum"))
        return sums.select(*split, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))

    own = F.coalesce(F.sum("_odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = (lines.join(so_far("_odd"), split)
             .withColumn("_begins", (((F.col("_before") + own) % 2) == 0).cast("int")).drop("_before"))
    number = F.col("_before") + F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1
    lines = lines.join(so_far("_begins"), split).withColumn("_record", number)
    parts = F.sort_array(F.collect_list(F.struct("_block", "_at", "value")))    # the lines of one record
    return lines.groupBy("_file", "_record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))


def headed_files(spark: SparkSession, path: str, skip_rows: int = 0, corrupt: str = "fail") -> list[tuple[list[str], DataFrame]]:
    """[(column names, rows)], an entry for each distinct header among the files at ``path``.

    The header is the record after ``skip_rows`` lines of each file; lines before it and
    blank records are no data.  A quoted value may hold line ends (read as ``\\n``).  Rows
    hold one string column per name and ``_file``.  ``corrupt="skip"`` passes over files
    that can't be read or are too short; else a short file is an error.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(corrupt == "skip").lower())
    lines = (reader.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
             .withColumn("_at", F.monotonically_increasing_id()))
    lines = materialize(lines)      # numbered once
    starts = lines.filter("_block = 0").groupBy("_file").agg(F.min("_at").alias("_start"))
    # the lines of a file's first split keep their order: a line's number is its distance from the first
    body = lines.join(starts, "_file").filter((F.col("_block") > 0) | (F.col("_at") - F.col("_start") >= skip_rows))
    quoted = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if body.filter(quoted % 2 == 1).limit(1).count():
        rows = materialize(_numbered(body.drop("_start"))).withColumn("_first", F.col("_record") == 0)
    else:
        rows = body.withColumn("_first", (F.col("_block") == 0) & (F.col("_at") - F.col("_start") == skip_rows))
    rows = rows.select("_file", "_first", "value")
    heads = rows.filter("_first").select("_file", F.col("value").alias("_head"))
    found = [r["_head"] for r in heads.select("_head").distinct().collect()]
    if corrupt != "skip" and heads.count() < starts.count() or not found:
        raise ValueError(f"{path}: a file has no line {skip_rows + 1}, where its header should be")
    data = rows.filter(~F.col("_first") & (F.trim("value") != "")).join(heads, "_file")
    out = []
    for head in sorted(found):
        names = next(csv.reader(head.splitlines(keepends=True)))
        fields = ", ".join(f"c{i} STRING" for i in range(len(names)))
        own = data.filter(F.col("_head") == head).select(F.from_csv("value", F.lit(fields), {"multiLine": "true", "escape": '"'}).alias("r"), "_file")
        out.append((names, own.select(*[F.col("r")[f"c{i}"].alias(n) for i, n in enumerate(names)], "_file")))
    return out
