"""Repeated word windows by compaction of a De Bruijn graph.

The edges of the graph are the texts' windows of 35 words (k-mers of tokens); its nodes are
their first and last 34 words.  A window is repeated where its edge occurs at two places.

*Compaction.*  Every window has an anchor: of the runs of 10 words in it the one with the
least hash, the first of equal ones.  Successive windows of a text with one anchor are a
path; it lies on the words from the first window's start to the last one's end, and one
record (anchor, hash of these words, source coordinates) stands for its up to 26 edges.
Equal windows have equal anchors, so edges are equal only on paths with one anchor:

* an anchor that occurs once has no repeated edge;
* an anchor whose paths are all equal does not branch: all edges of all its paths repeat;
* at an anchor that branches, paths that occur at several places repeat as a whole, and one
  representative of each distinct path is opened into its edges, whose hashes are counted.

Paths and edges come back to the texts by joins on anchors and source coordinates (text
number, first window, number of windows).  There the spans are laid together and checked:
each must lie inside its text.  A path is known by 128 bits (hashes of anchor and words),
an edge by 128 bits as well.

Texts go through tasks in runs, as numpy arrays.  Keys with very many rows (an anchor, a
path or an edge of passages that everybody quotes) are counted by partial aggregates and
joined by ``spread_join``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialize
from panelcast.llm.shingles import mixed
from panelcast.llm.spread import spread_join

#: Words of an anchor.
ANCHOR = 10
#: Texts are handled in runs of about so many bytes; longer ones are hashed in pieces of it.
RUN_BYTES = 1 << 20
#: Bytes of kept text in an output batch.
BATCH_BYTES = 8 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_rng = np.random.default_rng(20260712)
_PLACES = 1 << 12


def _odd(n: int) -> np.ndarray:
    return _rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES, _AT = _odd(256), _odd(_PLACES)
_BASES = [int(b) for b in (_odd(2) & ~np.uint64(7)) | np.uint64(3)]  # 3 modulo 8: powers stay apart
_LENGTH = _odd(1)[0]


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a buffer."""
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    head = np.flatnonzero(first[at])
    lengths = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, lengths)
    value = _BYTES[raw[at]] * (_AT[place % _PLACES] + (place // _PLACES).astype(np.uint64))
    return mixed(np.add.reduceat(value, head) + lengths.astype(np.uint64)), at[head]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than ASCII white space) and where they start."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = len(data)
        if to - at > RUN_BYTES:
            cut = _BREAK.search(data, at + RUN_BYTES)
            to = cut.end() if cut else to
        h, s = _piece_hashes(np.frombuffer(data, np.uint8, to - at, at))
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


class Sums:
    """Hashes of any run of words, from sums over all words before."""

    def __init__(self, words: np.ndarray, which: int):
        n = len(words)
        base = _BASES[which]
        factors = np.full((2, n + 1), base, dtype=np.uint64)
        factors[1] = np.uint64(pow(base, -1, 1 << 64))
        factors[:, 0] = 1
        up, self.down = np.cumprod(factors, axis=1, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        whole = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mixed(whole + np.asarray(length, np.uint64) * _LENGTH)


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive keys, by doubling."""
    low, have = keys, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    return low


def paths(words: np.ndarray, upto: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, words' hash) of every path of texts laid end to
    end; ``upto`` holds the number of words before each text and in all."""
    n = len(words)
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    sums = Sums(words, 0)
    marks = sums.of(np.arange(n - anchor + 1), anchor)
    bits = np.uint64(n.bit_length())
    keys = (marks >> bits << bits) | np.arange(len(marks), dtype=np.uint64)
    at = (_least_of(keys, window - anchor + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.repeat(upto[1:], np.diff(upto))[:len(at)]
    own = np.flatnonzero(np.arange(len(at)) + window <= ends)  # windows that lie in one text
    if not len(own):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    at = at[own]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 1) | (np.diff(at) != 0)]))
    count = np.diff(np.append(head, len(own)))
    start = own[head]
    text = np.searchsorted(upto, start, side="right") - 1
    return (text, start - upto[text], count, marks[at[head]].view(np.int64),
            Sums(words, 1).of(start, count + (window - 1)).view(np.int64))


def _expanded(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(v.as_py()) for v in column]


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, hashes, words before each): the texts in runs of about RUN_BYTES."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= RUN_BYTES):
            size += len(texts[to]) + 1
            to += 1
        ends = np.cumsum([0] + [len(t) + 1 for t in texts[at:to]])
        hashes, starts = word_hashes(b" ".join(texts[at:to]))
        yield at, to, hashes, np.searchsorted(starts, ends)
        at = to


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, packed): a number of its own for every row, and its text, compressed.  Written
    once, so that the numbers stay."""
    kind = dict(docs.dtypes)[id_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = [squeeze.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], names=["uid", "id", "packed"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(pack, f"uid long, id {kind}, packed binary"))


def _all_paths(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, c, uid, start, n): every path of the texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for at, to, words, upto in _runs(_expanded(batch.column(1))):
                text, start, n, a, c = paths(words, upto, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(c), pa.array(uids[at:to][text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["a", "c", "uid", "start", "n"])

    return texts.select("uid", "packed").mapInArrow(find, "a long, c long, uid long, start int, n int")


def _edges(texts: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """(h, g, uid, start, weight): the edges of the opened paths (uid, start, n, weight)."""
    wanted = opened.groupBy("uid").agg(F.collect_list(F.struct("start", "n", "weight")).alias("paths"))  # one text's own paths

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _expanded(batch.column(1))
            for k, data in enumerate(raw):
                words, _ = word_hashes(data)
                own = pa.StructArray.from_arrays(batch.column(2)[k].values.flatten(), names=["start", "n", "weight"])
                start, n, weight = (own.field(i).to_numpy().astype(np.int64) for i in range(3))
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                edges = [pa.array(Sums(words, i).of(at, window).view(np.int64)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*edges, pa.array(np.full(len(at), batch.column(0)[k].as_py())), pa.array(at.astype(np.int32)),
                     pa.array(np.repeat(weight, n).astype(np.int32))], names=["h", "g", "uid", "start", "weight"])

    joined = texts.select("uid", "packed").join(wanted, "uid").select("uid", "packed", "paths")
    return joined.mapInArrow(cut, "h long, g long, uid long, start int, weight int")


def repeated_paths(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(uid, start, n): runs of n windows, from word ``start`` on, that occur elsewhere too."""
    every = materialize(_all_paths(texts, window, anchor))
    total = every.count()
    several = materialize(every.groupBy("a").agg(F.count(F.lit(1)).alias("of_a"), (F.min("c") == F.max("c")).alias("plain"))
                          .where("of_a > 1"))
    met = materialize(spread_join(every, several, ["a"], "of_a", total).drop("of_a"))
    plain = met.where("plain").select("uid", "start", "n")
    branching = met.where("not plain")
    distinct = materialize(branching.groupBy("a", "c").agg(F.count(F.lit(1)).alias("of_c"), F.min(F.struct("uid", "start", "n")).alias("first")))
    whole = spread_join(branching, distinct.where("of_c > 1").select("a", "c", "of_c"), ["a", "c"], "of_c", total).select("uid", "start", "n")
    # a path of several places lends its representative's edges to the count
    opened = distinct.select("first.*", F.when(F.col("of_c") > 1, 2).otherwise(1).alias("weight"))
    edges = materialize(_edges(texts, opened, window))
    common = materialize(edges.groupBy("h", "g").agg(F.sum("weight").alias("places"), F.count(F.lit(1)).alias("of_edge")).where("places > 1"))
    single = spread_join(edges.where("weight = 1"), common.drop("places"), ["h", "g"], "of_edge", total)
    return plain.unionByName(whole).unionByName(single.select("uid", "start", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_removed, kept (the words left, joined by one space) and spans (start
    and end, in words, of what was removed) of every row.

    A word goes where a window of ``window`` words covers it whose words also start anywhere
    else, in the same text or another; all windows are those of the input.

    Defined cases: null and empty texts and texts of fewer words than a window keep all they
    have; a null id is kept; rows that share an id, and repeated rows, are texts of their
    own (so repeated rows lose their windows); an empty table gives no rows; other columns
    are not read.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has at least one word and at most those of a window")
    texts = _packed(docs, id_col, text_col)
    kind = dict(texts.dtypes)["id"]
    found = repeated_paths(texts, window, anchor).groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("marks"))  # one text's own

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            ids, n, gone, kept, spans = zip(*rows, strict=True)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                               pa.array(kept, pa.string()), pa.array(spans, span)], names=["id", "n_words", "n_removed", "kept", "spans"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for k, data in enumerate(_expanded(batch.column(1))):
                words, spans = data.split(), []
                n = len(words)
                marks = batch.column(2)[k]
                if marks.is_valid:
                    start, count = (marks.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                    end = start + count + window - 1
                    if (start < 0).any() or (end > n).any():
                        raise ValueError("a span does not lie in its text")
                    change = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                    covered = np.cumsum(change[:n]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    words = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                kept = b" ".join(words).decode("utf-8", "surrogatepass")
                out.append((batch.column(0)[k].as_py(), n, n - len(words), kept, spans))
                held += len(kept)
                if held > BATCH_BYTES:
                    yield batch_of(out, id_type)
                    out, held = [], 0
            if out:
                yield batch_of(out, id_type)
                out, held = [], 0

    joined = texts.join(found, "uid", "left").select("id", "packed", "marks")
    done = joined.mapInArrow(finish, f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")
    return done.withColumnRenamed("id", id_col)


ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS uid, doc_id,
                      coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
windows AS MATERIALIZED (SELECT uid, i, hash(array_to_string(w[i:i + 34], ' ')) AS h, md5_number(array_to_string(w[i:i + 34], ' ')) AS m
  FROM (SELECT uid, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)),
again AS (SELECT h, m FROM windows GROUP BY h, m HAVING count(*) > 1),
gone AS (SELECT DISTINCT uid, unnest(range(i, i + 35)) AS p FROM windows JOIN again USING (h, m)),
words AS (SELECT uid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
kept AS (SELECT uid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (uid, p) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (uid)
"""
