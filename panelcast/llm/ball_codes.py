"""Vector codes from codebooks found by ball k-means.

Vectors of integers are cut into equal parts; the parts of one position share a codebook of
at most 16 entries, found by Lloyd rounds; a vector's code is the index of the nearest entry
of each of its parts.  All arithmetic is on integers, so results are exact.

*Balls.*  A part lies in the ball of the entry it was last assigned to: centre the entry,
radius the farthest part.  With d a part's distance to its own entry, another entry can be
as near only if it is at most 2 d away from that entry.  So

* the neighbours of an entry are those at most twice its radius away: no part of the ball
  looks at any other (the radius is that of the last round, plus how far the entry moved);
* neighbours in order of their distance cut the ball into rings: parts in ring j are
  compared with the nearest j neighbours only, parts inside the first ring (the stable core)
  with none;
* a ball whose entry and neighbours did not move keeps its parts without a distance taken.

The state (vectors and codes) is a table in the shared checkpoint folder, written once a
round; a task adds one row with what its parts changed in counts, sums and radii.  Only
such totals (entries x components) reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import Steps, materialize
from panelcast.llm.spread import spread_join

#: Components must stay below this, so that squared distances fit 64 bits.
LARGEST = 1 << 27


@dataclass
class Balls:
    """Codebooks (parts x entries x components) and what the next assignment may skip."""
    book: np.ndarray
    radii: np.ndarray    # squared, at least that of each ball around its entry
    still: np.ndarray    # neither the entry nor a neighbour moved

    @property
    def near(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each part and entry its neighbours and their squared distances, nearest first."""
        out = []
        for book, radii in zip(self.book, self.radii, strict=True):
            gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            rows = []
            for i, gap in enumerate(gaps):
                order = np.lexsort((np.arange(len(gap)), gap))
                order = order[(order != i) & (gap[order] <= 4 * radii[i])]
                rows.append((order, gap[order]))
            out.append(rows)
        return out


def _unbounded(shape: tuple[int, int]) -> np.ndarray:
    return np.full(shape, 1 << 60, dtype=np.int64)


def assign(parts: np.ndarray, codes: np.ndarray, balls: Balls, radii: np.ndarray | None = None) -> np.ndarray:
    """Nearest entries (ties: lower index) of parts (n x parts x components), given the entries
    they were assigned to.  ``radii`` takes up the squared distances of all parts but those
    of still balls."""
    new = codes.copy()
    for p, near in enumerate(balls.near):
        book, own = balls.book[p], codes[:, p]
        for i, (others, gaps) in enumerate(near):
            if balls.still[p, i]:
                continue
            ball = np.flatnonzero(own == i)
            if not len(ball):
                continue
            x = parts[ball, p]
            best = ((x - book[i]) ** 2).sum(axis=1)
            at = np.full(len(ball), i, dtype=codes.dtype)
            ring = np.searchsorted(gaps, 4 * best, side="right")  # so many neighbours may be as near
            for k in range(int(ring.max(initial=0))):
                out = np.flatnonzero(ring > k)
                j = others[k]
                d = ((x[out] - book[j]) ** 2).sum(axis=1)
                closer = (d < best[out]) | ((d == best[out]) & (j < at[out]))
                best[out[closer]], at[out[closer]] = d[closer], j
            new[ball, p] = at
            if radii is not None:
                np.maximum.at(radii[p], at, best)
    return new


def _moved(old: Balls, counts: np.ndarray, sums: np.ndarray, radii: np.ndarray) -> Balls:
    """The next round's balls: entries are floors of means, unused ones stay."""
    used = counts > 0
    book = np.where(used[:, :, None], np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), old.book)
    shift = ((book - old.book) ** 2).sum(axis=2)
    reach = np.array([[math.isqrt(int(r)) + (math.isqrt(int(s)) + 1 if s else 0) + (1 if s else 0) for r, s in zip(*rows, strict=True)]
                      for rows in zip(radii, shift, strict=True)], dtype=np.int64).reshape(shift.shape)
    bound = np.where(shift == 0, radii, reach ** 2)
    after = Balls(book, bound, np.zeros(shift.shape, dtype=bool))
    for p, rows in enumerate(after.near):
        for i, (others, _) in enumerate(rows):
            after.still[p, i] = shift[p, i] == 0 and not shift[p, others].any()
    return after


def quantised(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v): floor(scale * x) of every vector without null or non-finite components, as
    32-bit integers."""
    types = dict(vectors.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, value in enumerate(batch.column(2)):
                if not value.is_valid:
                    continue
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(scale * x)
                if (np.abs(whole) >= LARGEST).any():
                    raise ValueError(f"a component is beyond {LARGEST // scale}")
                keep.append(k)
                out.append(whole.astype("<i4").tobytes())
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], names=["id", "label", "v"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("v is not null").mapInArrow(cut, f"id {types[id_col]}, label {types[label_col]}, v binary")


def _matrix(column: pa.Array, shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The values of a binary column, all of one length, as an array without a row loop."""
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty((0, *shape), kind)
    at = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, kind, offset=int(at[0]), count=int(at[-1] - at[0]) // np.dtype(kind).itemsize).reshape(len(column), *shape)


def _round(state: DataFrame, balls: Balls, first: bool) -> DataFrame:
    """The state after one assignment, and of each task one row with stats: per part and entry
    the changes of count and sums, and the radius."""
    n_parts, n_entries, width = balls.book.shape
    kinds = dict(state.dtypes)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((n_parts, n_entries, 1 + width), dtype=np.int64)
        radii = np.zeros((n_parts, n_entries), dtype=np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            parts = _matrix(batch.column(2), (n_parts, width), "<i4").astype(np.int64)
            codes = np.zeros((len(batch), n_parts), np.uint8) if first else _matrix(batch.column(3), (n_parts,), "u1")
            new = assign(parts, codes, balls, radii)
            for p in range(n_parts):
                moved = np.flatnonzero(first | (new[:, p] != codes[:, p]))
                x = np.concatenate([np.ones((len(moved), 1), np.int64), parts[moved, p]], axis=1)
                np.add.at(change[p], new[moved, p], x)
                if not first:
                    np.subtract.at(change[p], codes[moved, p], x)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n_parts), len(batch), [None, pa.py_buffer(np.ascontiguousarray(new).tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], flat.cast(pa.binary()), pa.nulls(len(batch), pa.binary())],
                                             names=["id", "label", "v", "code", "stats"])
        if schema is not None:
            none = [pa.nulls(1, schema.field(k).type) for k in ("id", "label", "v")]
            stats = np.concatenate([change, radii[:, :, None]], axis=2).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.array([stats], pa.binary())], names=["id", "label", "v", "code", "stats"])

    columns = ["id", "label", "v"] if first else ["id", "label", "v", "code"]
    return state.select(*columns).mapInArrow(step, f"id {kinds['id']}, label {kinds['label']}, v binary, code binary, stats binary")


def _totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of counts and of sums, and radii, over all tasks."""
    n_parts, n_entries, width = shape
    cells = n_parts * n_entries * (width + 2)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(np.frombuffer(value.as_py(), "<i8"))], names=["cell", "x"])

    far = F.col("cell") % (width + 2) == width + 1
    rows = state.where("stats is not null").select("stats").mapInArrow(unpack, "cell long, x long")
    total = np.zeros(cells, dtype=np.int64)
    for r in rows.groupBy("cell").agg(F.when(F.first(far), F.max("x")).otherwise(F.sum("x")).alias("x")).collect():  # parts x entries x components
        total[r["cell"]] = r["x"]
    total = total.reshape(n_parts, n_entries, width + 2)
    return total[:, :, 0], total[:, :, 1:-1], total[:, :, -1]


def train_and_encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
                     id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(``id_col``, ``label_col``, code: one byte a part, error: squared distances to the entries)
    of every vector, and the codebooks (parts x entries x components).

    The codebooks start as the parts of the vectors with the smallest ids (null ids last,
    ties by their bytes).

    Defined cases: vectors that are null or hold null or non-finite components are dropped;
    with fewer vectors than entries there are as many entries as vectors; repeated rows and
    ids are vectors of their own; a null label or id is kept; an empty table gives no rows
    and codebooks without entries; other columns are not read.  Vectors of several lengths,
    of a length that the parts do not divide, or with components so large that squared
    distances leave 64 bits raise a ValueError.
    """
    kept = materialize(quantised(vectors, scale, id_col, label_col, vector_col))
    least, most = kept.agg(F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least // 4} and of {most // 4} components")
    if (least or 0) % (4 * parts):
        raise ValueError(f"{parts} parts do not divide {least // 4} components")
    width = (least or 0) // (4 * parts)
    starts = kept.orderBy(F.col("id").asc_nulls_last(), F.col("v")).limit(entries)
    first = [np.frombuffer(bytes(r["v"]), "<i4").reshape(parts, width) for r in starts.select("v").collect()]  # one row an entry
    book = np.stack(first, axis=1).astype(np.int64) if first else np.empty((parts, 0, width), np.int64)
    shape = book.shape
    balls = Balls(book, _unbounded(shape[:2]), np.zeros(shape[:2], dtype=bool))
    steps, state = Steps(vectors.sparkSession), kept
    counts, sums, radii = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    for k in range(rounds if first else 0):
        state = steps.put(_round(state, balls, k == 0))
        more, added, far = _totals(state, shape)
        counts, sums = counts + more, sums + added
        radii = np.maximum(far, np.where(balls.still, radii, 0))
        balls = _moved(balls, counts, sums, radii)
        state = state.where("stats is null")
    kinds = dict(kept.dtypes)
    final = balls

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(2), (parts, width), "<i4").astype(np.int64)
            codes = _matrix(batch.column(3), (parts,), "u1") if rounds else np.zeros((len(batch), parts), np.uint8)
            new = assign(own, codes, final)
            error = ((own - final.book[np.arange(parts)[None, :], new]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in new], pa.binary()), pa.array(error)],
                                             names=["id", "label", "code", "error"])

    schema = f"id {kinds['id']}, label {kinds['label']}, code binary, error long"
    if not first:
        out = kept.select("id", "label", F.col("v").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        out = state.select("id", "label", "v", "code" if rounds else F.lit(None).cast("binary").alias("code")).mapInArrow(encode, schema)
    return out.withColumnsRenamed({"id": id_col, "label": label_col}), final.book


def codebook_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors of all vectors with that
    label, nulls together) and codebooks_sha256 of every vector that is kept."""
    found, book = train_and_encode(vectors, **options)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    rows = materialize(found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", key.alias("__label")))
    labels = materialize(rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")))
    out = spread_join(rows, labels, ["__label"], "__n", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(book)).alias("codebooks_sha256"))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same rows in SQL: every part against every entry, round by round."""
    ctes = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
            f"""cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1:(p + 1) * w] AS x
      FROM (SELECT *, len(v) // {parts} AS w, unnest(range(0, {parts})) AS p FROM kept))""",
            f"""b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut
      WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, p, min(d) AS d, min_by(e, d * {entries} + e) AS e, any_value(x) AS x FROM
      (SELECT vec_id, label, cut.p, e, x, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
       FROM cut JOIN b{k} b ON b.p = cut.p) GROUP BY vec_id, label, p)""")
        if k < rounds:
            ctes.append(f"""m{k} AS (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM
      (SELECT p, e, unnest(x) AS y, unnest(range(0, len(x))) AS i FROM a{k}) GROUP BY p, e, i)""")
            ctes.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b
      LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM m{k} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)""")
    return f"""WITH {', '.join(ctes)},
      coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
      books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""
