"""Exact top-k inner-product search by a three-phase uniform threshold.

The score of a (query, vector) pair is the sum of partial scores, one per group of vector
components.  Each component group acts as a node that knows its own partial scores only:

1. every node sends its k best partial scores per query; the pairs so gathered are scored
   in full, and the k-th best total is a cutoff t no top-k score can lie below;
2. a pair with total >= t has a partial score >= t / nodes in at least one node, so every
   node sends just the pairs that reach this uniform threshold;
3. the pairs sent are scored exactly, and the k best per query stay.

Vectors travel in blocks: the grid of (query block, vector block) cells is an equi-join on
replicated block ids, and a cell is a few matrix products.  No task holds more than one
query block and one vector block, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import materialize

#: Rows of a block: a cell holds at most about QUERY_ROWS x VECTOR_ROWS scores at a time.
QUERY_ROWS, VECTOR_ROWS = 512, 2048
#: Scores stay below this (a little below 2**62, as norms are computed in doubles).
LARGEST = (1 << 62) - (1 << 32)
NO_CUTOFF = -(1 << 62)


class ScoreRangeError(ValueError):
    """A score might not fit the integers it is computed in."""


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec: array<long>, key, n): the different quantised vectors of each id among the
    rows that take part, and how many rows hold each.  ``key`` stands for id and vector."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = (df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"), quantised(x.cast("array<double>"), scale).alias("vec")))
    key = F.md5(F.concat_ws(",", F.col("id").cast("string"), F.col("vec").cast("array<string>")).cast("binary"))
    return rows.groupBy("id", "vec").agg(F.count("*").alias("n")).withColumn("key", key)


def check_range(queries: DataFrame, vectors: DataFrame) -> None:
    """Raise ``ScoreRangeError`` unless every score and partial score lies within 62 bits:
    none exceeds the product of the two vectors' norms."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    longest = [df.groupBy(F.size("vec").alias("dim")).agg(F.max(norm).alias(side))
               for df, side in ((queries, "a"), (vectors, "b"))]
    over = longest[0].join(longest[1], "dim").where(F.col("a") * F.col("b") >= float(LARGEST)).agg(F.min("dim")).first()[0]
    if over is not None:
        raise ScoreRangeError(f"scores of vectors of {over} components may leave 62 bits: choose a smaller scale")


def quantised(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))


def _packed(df: DataFrame, rows: int, total: int, name: str, more: str = "") -> DataFrame:
    """Blocks of about ``rows`` vectors each: ids, values and the column ``more`` as bytes."""
    blocks = max(1, -(-total // rows))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "key"])
        row = {"dim": key[0], name: key[1], f"{name}_ids": pdf["id"].to_numpy(np.int64).tobytes(),
               f"{name}_keys": "".join(pdf["key"]),
               f"{name}_values": np.stack(pdf["vec"].to_numpy()).astype(np.int64).tobytes()}
        if more:
            row[more] = pdf[more].to_numpy(np.int64).tobytes()
        return pd.DataFrame([row])

    schema = f"dim int, {name} long, {name}_ids binary, {name}_keys string, {name}_values binary" + (f", {more} binary" if more else "")
    copy = ["copy"] if more == "copy" else []
    keyed = df.withColumn("dim", F.size("vec")).withColumn(name, F.pmod(F.xxhash64("id", "key", *copy), F.lit(blocks)))
    return keyed.groupBy("dim", name).applyInPandas(pack, schema)


def _grid(queries: DataFrame, vectors: DataFrame, query_blocks: int) -> DataFrame:
    """A row for each (query block, vector block) of the same dimension."""
    copies = vectors.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    return copies.join(queries, ["dim", "q"])


def _keys(joined: str) -> list[str]:
    return [joined[i:i + 32] for i in range(0, len(joined), 32)]


def _own(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Query and vector places of the pairs that are one row: a vector's first copy is left
    out for the query of the same id and vector, its other copies are not."""
    at = {k: i for i, k in enumerate(_keys(row["q_keys"]))}
    first = np.frombuffer(row["copy"], np.int64) == 0
    pairs = [(at[k], j) for j, k in enumerate(_keys(row["v_keys"])) if first[j] and k in at]
    i, j = zip(*pairs, strict=True) if pairs else ((), ())
    return np.array(i, dtype=int), np.array(j, dtype=int)


def _cell(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q_ids, v_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["v_ids"], np.int64)
    q = np.frombuffer(row["q_values"], np.int64).reshape(len(q_ids), row["dim"])
    v = np.frombuffer(row["v_values"], np.int64).reshape(len(v_ids), row["dim"])
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, row["dim"])
    if top < 2.0**52:  # whole numbers stay exact in doubles, whose products are much faster
        q, v = q.astype(np.float64), v.astype(np.float64)
    return q_ids, v_ids, q, v


def _parts(dim: int, nodes: int) -> list[slice]:
    edges = np.linspace(0, dim, min(nodes, max(1, dim)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest entries."""
    k = min(k, scores.shape[1])
    if not k or not len(scores):
        return np.empty(0, int), np.empty(0, int)
    cols = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(scores)), k), cols.ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, nodes: int = 2, scale: int = 256,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` highest-scoring ``vectors`` of each query, its own row left out.

    Score: integer inner product of floor(scale * component).  Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id; all vectors, if fewer than k.

    Defined cases: rows with a null id, a null vector or a null or non-finite component take
    no part; every other row of ``vectors`` is a candidate, rows that share an id or are
    equal too; a query's own row is one row of its id and its vector; equal query rows have
    one answer, query rows that share an id but not the vector one each; vectors meet only
    vectors of the same length (those of no components score 0); an empty table gives no
    rows; other columns are not read.  Where a score might leave 62 bits (largest norms of
    queries and vectors of one length), ``ScoreRangeError`` is raised before any search.
    """
    v = materialize(clean_vectors(vectors, id_col, vec_col, scale))
    q = materialize(clean_vectors(queries, id_col, vec_col, scale).drop("n"))
    check_range(q, v)
    # of equal rows no query can return more than k besides its own
    copies = v.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(k + 1)) - 1)))
    n_vectors, n_queries = v.agg(F.coalesce(F.sum(F.least("n", F.lit(k + 1))), F.lit(0))).first()[0], q.count()
    q_blocks = max(1, -(-n_queries // QUERY_ROWS))
    blocks = materialize(_packed(copies, VECTOR_ROWS, n_vectors, "v", "copy"))

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1 in a cell: per query and node the k best partial scores."""
        for row in _rows(batches):
            q_ids, v_ids, a, b = _cell(row)
            keys, v_keys = np.array(_keys(row["q_keys"]), dtype=object), np.array(_keys(row["v_keys"]), dtype=object)
            copy, own = np.frombuffer(row["copy"], np.int64), _own(row)
            for node, part in enumerate(_parts(row["dim"], nodes)):
                scores = a[:, part] @ b[:, part].T
                scores[own] = NO_CUTOFF
                i, j = _best(scores, k)
                keep = scores[i, j] != NO_CUTOFF
                i, j = i[keep], j[keep]
                # the pair's full score rides along: a list entry is resolved where it is made
                total = np.einsum("ij,ij->i", a[i], b[j]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i], pa.string()), pa.array(np.full(len(i), node, np.int32)), pa.array(v_ids[j]),
                     pa.array(v_keys[j], pa.string()), pa.array(copy[j]), pa.array(scores[i, j].astype(np.int64)),
                     pa.array(total)],
                    names=["key", "node", "vec_id", "vec_key", "copy", "partial", "total"])

    lists = (_grid(_packed(q, QUERY_ROWS, n_queries, "q"), blocks, q_blocks)
             .mapInArrow(local_lists, "key string, node int, vec_id long, vec_key string, copy long, partial long, total long"))
    in_node = Window.partitionBy("key", "node").orderBy(F.desc("partial"), "vec_id", "vec_key", "copy")
    gathered = (lists.withColumn("r", F.row_number().over(in_node)).where(F.col("r") <= k)
                .select("key", "vec_key", "copy", "total").distinct())
    by_total = Window.partitionBy("key").orderBy(F.desc("total"))
    cutoffs = (gathered.withColumn("r", F.row_number().over(by_total)).where(F.col("r") == k)
               .select("key", F.col("total").alias("cutoff")))
    with_cutoff = q.join(cutoffs, "key", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NO_CUTOFF)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3 in a cell: pairs that reach the uniform threshold in some node,
        scored exactly; of those the k best at or above the cutoff."""
        for row in _rows(batches):
            q_ids, v_ids, a, b = _cell(row)
            keys = np.array(_keys(row["q_keys"]), dtype=object)
            cutoff = np.frombuffer(row["cutoff"], np.int64)
            parts = _parts(row["dim"], nodes)
            sent = np.zeros((len(q_ids), len(v_ids)), dtype=bool)
            for part in parts:
                sent |= (a[:, part] @ b[:, part].T) >= (cutoff // len(parts))[:, None]
            sent[_own(row)] = False
            i, j = np.nonzero(sent)
            total = np.concatenate([np.einsum("ij,ij->i", a[i[s:s + 65536]], b[j[s:s + 65536]])
                                    for s in range(0, max(1, len(i)), 65536)]).astype(np.int64)
            keep = total >= cutoff[i]
            i, j, total = i[keep], j[keep], total[keep]
            order = np.lexsort((v_ids[j], -total, i))
            i, j, total = i[order], j[order], total[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, total = i[place < k], j[place < k], total[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(keys[i], pa.string()), pa.array(q_ids[i]), pa.array(v_ids[j]), pa.array(total)],
                                             names=["key", "query_id", "vec_id", "score"])

    found = (_grid(_packed(with_cutoff, QUERY_ROWS, n_queries, "q", "cutoff"), blocks, q_blocks)
             .mapInArrow(candidates, "key string, query_id long, vec_id long, score long"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
