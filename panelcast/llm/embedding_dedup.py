"""Near-duplicate embeddings by randomly rotated binary codes.

Every vector is scaled to length 1, turned by one seeded random rotation, and kept as its
sign code together with a correction factor: the inner product f of the turned vector and
its code (the code scaled to length 1).  For a turned vector q and a code c,
``<q, c> / f`` estimates the inner product of q and the coded vector without bias over
random rotations.  The code also bounds it: q and the coded vector can be no closer than

    f * <q, c> + sqrt(1 - f^2) * sqrt(1 - <q, c>^2)

so a pair whose bound lies under the threshold needs no exact work, and every other pair
is computed again in double precision.  The bound holds for certain (its confidence is 1),
so no link is lost.

Vectors of one label are cut into blocks and every pair of blocks is a cell of its own; a
cell returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialize
from panelcast.llm.components import connected_components

#: Vectors of a block: a cell holds at most about this many squared estimates at a time.
BLOCK_ROWS = 2048
#: Rounding room of the float32 estimates.
SLACK = 1e-4


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a seeded Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.where(np.diag(r) == 0, 1.0, np.diag(r)))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(turned vectors, sign codes of length 1, correction factors) of unit vectors."""
    turned = unit @ turn
    codes = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(max(1, unit.shape[1]))
    return turned, codes, np.einsum("ij,ij->i", turned, codes)


def estimate(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of every vector and every coded vector."""
    return (turned @ codes.T) / factors[None, :]


def upper_bound(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """What the inner products can be at most."""
    near = (turned.astype(np.float32) @ codes.astype(np.float32).T)
    rest = np.sqrt(np.maximum(0, 1 - near * near))
    f = factors.astype(np.float32)[None, :]
    return f * near + np.sqrt(np.maximum(0, 1 - f * f)) * rest


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of ``a`` and j of ``b`` (unit vectors, doubles) with cosine >= threshold."""
    turn = rotation(a.shape[1], seed)
    turned, _, _ = encode(a, turn)
    _, codes, factors = encode(b, turn)
    i, j = np.nonzero(upper_bound(turned, codes, factors) >= threshold - SLACK)
    exact = np.concatenate([np.einsum("ij,ij->i", a[i[s:s + 65536]], b[j[s:s + 65536]])
                            for s in range(0, max(1, len(i)), 65536)])
    keep = exact >= threshold
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable row for each of ``n`` rows under the links (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            return low


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                    vec_col: str = "embedding", group_col: str = "label", seed: int = 17) -> DataFrame:
    """One row per vector: id, n_links (other rows linked directly), component_id (smallest id
    reachable by links, itself included), kept (whether it is that id).

    Two rows link when their groups are equal and not null and the cosine of their vectors,
    in double precision, is at least ``threshold``.

    Defined cases: a vector that is null, of length zero or holds a null or non-finite
    component, and a row of null group, links with nothing; vectors link only with those of
    as many components; rows that share an id are rows of their own that stand for one node;
    a null id is returned with no links and itself null as its component; an empty table
    gives no rows; other columns are not read.
    """
    x = F.col(vec_col)
    usable = (x.isNotNull() & (F.size(x) > 0) & F.col(group_col).isNotNull() & F.col(id_col).isNotNull()
              & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
              & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)))
    rows = (vectors.where(usable)
            .select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"),
                    x.cast("array<double>").alias("vec"), F.size(x).alias("dim"))
            .withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("grp", "dim").agg(F.count("*").alias("n"))
    blocked = (rows.join(sizes, ["grp", "dim"])
               .withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
               .withColumn("block", F.pmod(F.xxhash64("id", "row"), F.col("blocks")).cast("int")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        x = x / np.abs(x).max(axis=1, keepdims=True)  # else very large or small components leave the range
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return pd.DataFrame([{"grp": key[0], "dim": key[1], "block": key[2], "blocks": key[3],
                              "ids": pdf["id"].to_numpy(np.int64).tobytes(), "unit": unit.tobytes()}])

    packed = materialize(blocked.groupBy("grp", "dim", "block", "blocks").applyInPandas(
        pack, "grp string, dim int, block int, blocks int, ids binary, unit binary"))
    left = packed.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = packed.select("grp", "dim", F.col("block").alias("other"), F.col("ids").alias("ids_b"),
                          F.col("unit").alias("unit_b"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            ids, ids_b = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ids_b"], np.int64)
            a = np.frombuffer(row["unit"]).reshape(len(ids), row["dim"])
            b = np.frombuffer(row["unit_b"]).reshape(len(ids_b), row["dim"])
            i, j = linked_pairs(a, b, threshold, seed)
            if row["block"] == row["other"]:
                i, j = i[i < j], j[i < j]
                counts = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                nodes = ids
            else:
                counts = np.concatenate([np.bincount(i, minlength=len(ids)), np.bincount(j, minlength=len(ids_b))])
                nodes, j = np.concatenate([ids, ids_b]), j + len(ids)
            low = forest(len(nodes), i, j)
            hit = counts > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[hit]), pa.array(nodes[low][hit]), pa.array(counts[hit].astype(np.int64))],
                names=["id", "other_id", "links"])

    found = materialize(left.join(right, ["grp", "dim", "other"])
                        .mapInArrow(cells, "id long, other_id long, links long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    groups = connected_components(found, "id", "other_id")
    node = F.col(id_col).cast("long")
    out = vectors.select(F.col(id_col), node.alias("id"))
    component = F.coalesce(F.col("component"), F.col("id"))
    return (out.join(counts.join(groups, "id"), "id", "left")
            .select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), (F.col("id") == component).alias("kept")))
