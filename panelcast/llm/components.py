"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import Steps

#: The rows of a hub (a node with very many links) meet its minimum in this many places.
HUB_SALT = 32
#: A state of the iteration is kept in files of about so many links.
LINKS_PER_FILE = 200_000


def _with_minimum(rows: DataFrame, minima: DataFrame, salts: int) -> DataFrame:
    """``rows`` (u, v) with m, the minimum that ``minima`` (u, m) holds for u, or null.  With
    salts, both sides are salted, so that a hub's rows are spread over as many tasks."""
    if salts < 2:
        return rows.join(minima, "u", "left")
    salted = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    copies = minima.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), ["u", "s"], "left").drop("s")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(id, component): for every id in ``links`` the smallest id it can reach.

    Alternates two steps until nothing moves: every node hands its smallest neighbour to
    its larger neighbours, then to its smaller ones; chains shorten geometrically.  A
    node's minimum is a partial aggregate, and only nodes whose minimum changes anything
    are joined back, salted, so a hub is never gathered.  Each round is a
    table in the checkpoint folder; the only values that reach the driver are one count and one sum.
    Links to oneself keep a node that has no other; rows with a null end are ignored.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    stars, halves = Steps(links.sparkSession), Steps(links.sparkSession)
    edges = stars.put(links.where(x.isNotNull() & y.isNotNull())
                      .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    files = 1 + edges.count() // LINKS_PER_FILE
    salts = HUB_SALT if files > 1 else 1  # a hub of fewer links than a file holds is a small task
    state = None
    for _ in range(max_rounds):
        # the larger neighbours of u go to the smallest of u and its neighbours
        proper = edges.where("v < u")
        low = proper.groupBy("u").agg(F.min("v").alias("m"))
        up = proper.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = (_with_minimum(up, low, salts).select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
                 .unionByName(edges.where("u = v")).distinct())
        # the smaller neighbours of u, and u, go to the smallest of them
        large = halves.put(large.coalesce(files))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        several = low.where("n > 1").select("u", "m")
        small = (_with_minimum(large, several, salts).where("m is not null and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = stars.put(small.coalesce(files))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    reached = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return reached.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))
