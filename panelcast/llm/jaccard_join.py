"""N-gram Jaccard join by token-group matrices.

Documents are sets of word shingles; two link when their Jaccard similarity is at least a
ratio.  Sets that are equal are one class with a key of its own (a hash of the set); all
steps work on classes, and only the last one joins them to document ids, of which several
rows with different texts may share one.

*Partition.*  Linked sets of sizes n and m differ in at most k = (n + m)(1 - t)/(1 + t)
shingles.  Shingles are dealt by hash into more than k parts, so linked sets agree on whole
parts; the hash of a part is a signature (very small sets use their first shingles in hash
order instead).  Linked sets share a least number of signatures (parts less k, less the empty
ones).  Shared ones are counted for each pair; only a pair with that many is a candidate, so
that a common line alone connects no texts.  Pairs are not formed where many sets share a
signature (a hot one): how many hot ones a set has lowers what its pairs need, and only sets
with as many hot ones as a link needs are joined by them, as stars to the smallest.  No link
crosses a block, the candidates that are connected.

*Token-group matrix.*  Inside a block, neighbouring sets in minhash order form groups and
the matrix says which shingles a group's union holds.  A row sum over a query's shingles
bounds its overlap with any member; only groups whose bound reaches the ratio are opened
and their members compared exactly.  Groups that are already connected with the query are
passed over, and a task returns a spanning forest of its links, never the pairs.

*Large blocks* are first cut by the least shingle hash of their sets, which near copies mostly
share; what is connected after that is one component.  Sets of different components can link
only where their sizes are in the same or neighbouring classes, so only sub-blocks of such
classes meet, in cells of two.  There, sets come as 16-bit codes of their shingles, packed to
about a byte each: codes in common are never fewer than shingles in common, so a set goes on
to the exact comparison, with its shingles, only where its codes reach the ratio with a set
of another component.  All steps are exact: caps, samples and prefixes of texts occur nowhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialize, shuffle_partitions
from panelcast.llm.components import connected_components
from panelcast.llm.shingles import mixed, shingle_sets
from panelcast.llm.spread import spread_join

#: Sets below this size use prefixes instead of parts.
SMALL = 24
#: Signatures a task holds before it hands them on.
HELD = 1 << 21
#: Pairs are counted in groups of at most so many sets that share a signature; others are hot.
FEW = 8
_LOW_40 = np.uint64((1 << 40) - 1)
#: Sets in a sub-block, and in a group of the token-group matrix.
SUB_BLOCK, GROUP = 96, 32
#: Sets of each side of a cell, where sets are codes.
CELL_SIDE = 1024
#: At most so many document ids (16 MB) are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


class Bands:
    """Size classes of which linked sets occupy the same or neighbouring ones, and for each
    class the number of parts for pairs with that and the next class."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the ratio must be in (0, 1]")
        self.num, self.den = num, den
        self.low = [1]  # least size of each class; grows with the sizes that are asked for

    def _reach(self, classes: int) -> None:
        while len(self.low) <= classes:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self._reach(len(self.low))
        return bisect_right(self.low, size) - 1

    def column(self, size: Column, largest: int) -> Column:
        """The class of a size of at most ``largest``."""
        self.of(largest)
        return F.size(F.filter(F.array(*map(F.lit, self.low)), lambda least: least <= size)) - 1

    def mismatches(self, band: int) -> tuple[int, bool]:
        """The most shingles in which two linked sets of the band differ; whether it is small."""
        self._reach(band + 2)
        high = self.low[band + 1] - 1
        most = min(self.low[band + 2] - 1, high * self.den // self.num)
        return (high + most) * (self.den - self.num) // (self.den + self.num), high < SMALL


def signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a sorted set, with the parity of their size class as lowest bit; any two
    sets that link share, in one class, at least as many as ``needed`` says of either."""
    n, out = len(tokens), []
    if not n:
        return tokens
    own = bands.of(n)
    for band in (own - 1, own):
        if band < 0:
            continue
        k, small = bands.mismatches(band)
        seed = mixed(np.array([2 * band + small], dtype=np.uint64))
        if small:  # linked sets share one of their first n - ceil(t n) + 1 shingles
            found = [mixed(tokens[:n + (-n * bands.num // bands.den) + 1] ^ seed)]
        else:
            parts, part, first = _parts(tokens, k)
            sums = np.add.reduceat(tokens, first)
            found = [mixed(mixed(sums ^ seed) + part[first])]
            if parts - len(first) >= parts - k:  # so many empty parts that they may be all that agree
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
                found.append(mixed(mixed(seed) + empty))
        out += [sigs & ~np.uint64(1) | np.uint64(band & 1) for sigs in found]
    return np.concatenate(out)


def _parts(tokens: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of parts where linked sets differ in at most k shingles, each token's part, and
    the places where parts begin."""
    parts = k + 3 + k // 8
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return parts, part, np.flatnonzero(np.append(True, part[1:] != part[:-1]))


def needed(tokens: np.ndarray, bands: Bands) -> tuple[int, int]:
    """For the size classes of even and of odd number: the least number of signatures that the set
    shares with any set it links with.  Of all parts no more than k differ; those that are empty
    have no signatures, or where they have, the other set's may have none."""
    least = [1, 1]
    own = bands.of(len(tokens)) if len(tokens) else 0
    for band in (own - 1, own):
        k, small = bands.mismatches(max(band, 0))
        if band >= 0 and not small:
            parts, _, first = _parts(tokens, k)
            least[band & 1] = max(1, len(first) - k)
    return least[0], least[1]


def _class_key(tokens: np.ndarray, seed: int) -> tuple[int, int, int]:
    """A 128-bit fingerprint of a set, and a 64-bit key made of it."""
    f = tokens.sum(dtype=np.uint64, keepdims=True)
    g = np.bitwise_xor.reduce(tokens * (tokens | np.uint64(1)), initial=np.uint64(0), keepdims=True)
    key = mixed(mixed(f + np.uint64(seed)) ^ g)
    return int(f.view(np.int64)[0]), int(g.view(np.int64)[0]), int(key.view(np.int64)[0])


def _pairs(ids: np.ndarray, sigs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, class parity) for all pairs of different ids in the groups that begin at ``starts``."""
    out = [(ids[:0], ids[:0], ids[:0])]
    for size in np.unique(sizes):
        group = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        a, b = ids[group[:, None] + i].ravel(), ids[group[:, None] + j].ravel()
        out.append((np.minimum(a, b), np.maximum(a, b), np.repeat((sigs[group] & np.uint64(1)).astype(np.int64), len(i))))
    a, b, odd = (np.concatenate(c) for c in zip(*out, strict=True))
    return a[a != b], b[a != b], odd[a != b]


def _meetings(docs: DataFrame, words: int, bands: Bands, buckets: int, seed: int) -> DataFrame:
    """(a, b, odd, hot, n): n signatures of a class parity that the keys a and b share, in groups of
    at most FEW keys; for larger groups (hot) one row for each signature a and key b."""

    def blobs(sigs: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(sigs, kind="stable")
        sigs, ids = sigs[order], ids[order]
        first = np.append(True, sigs[1:] != sigs[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(sigs)), 0))
        bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        more = np.arange(len(sigs)) - head > FEW  # a hot signature's bucket sees that it is hot from FEW + 1 keys
        names, far = (bucket[more] << np.uint64(40) | sigs[more] & _LOW_40).view(np.int64), ids[more]
        order = np.lexsort((ids[~more], bucket[~more]))
        sigs, ids, bucket = sigs[~more][order], ids[~more][order], bucket[~more][order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[k], cuts[k + 1])
            known, times = np.unique(ids[s], return_counts=True)
            # 40 bits beyond the bucket tell signatures apart; a chance meeting is only a candidate
            yield int(k), (sigs[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), \
                ((sigs[s] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes(), \
                times.astype(np.uint32).tobytes(), known.tobytes()
        place = buckets + far % buckets
        for k in np.unique(place):
            yield int(k), names[place == k].tobytes(), b"", b"", far[place == k].tobytes()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            rows = list(blobs(np.concatenate(sigs), np.concatenate(ids)))
            sigs.clear()
            ids.clear()
            seen.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]],
                names=["bucket", "low", "high", "times", "ids"])

        for batch in batches:
            for tokens in shingle_sets(batch.column(0), words):
                key = _class_key(tokens, seed)[2]
                if not len(tokens) or key in seen:
                    continue
                seen.add(key)
                own = signatures(tokens, bands)
                sigs.append(own)
                ids.append(np.full(len(own), key, np.int64))
                held += len(own)
                if held >= HELD:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= buckets:
            names, ids = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("low", "ids"))
            return pd.DataFrame({"a": names, "b": ids, "odd": names & 1, "hot": True, "n": 1})
        low = np.frombuffer(b"".join(pdf["low"]), np.uint32).astype(np.uint64)
        high = np.frombuffer(b"".join(pdf["high"]), np.uint8).astype(np.uint64)
        known = np.frombuffer(b"".join(pdf["ids"]), np.int64)
        once = np.zeros(len(known), bool)
        once[np.unique(known, return_index=True)[1]] = True  # of a class that several tasks read, one task's
        times = np.frombuffer(b"".join(pdf["times"]), np.uint32)
        keep = np.repeat(once, times)
        sigs, ids = ((high << np.uint64(32)) | low)[keep], np.repeat(known, times)[keep]
        order = np.argsort(sigs, kind="stable")
        sigs, ids = sigs[order], ids[order]
        starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
        sizes = np.diff(np.append(starts, len(sigs)))
        few = (sizes > 1) & (sizes <= FEW)
        a, b, odd = _pairs(ids, sigs, starts[few], sizes[few])
        many = np.repeat(sizes > FEW, sizes)
        names = (np.uint64(int(key[0]) << 40) | sigs[many]).view(np.int64)
        return pd.DataFrame({"a": np.concatenate([a, names]), "b": np.concatenate([b, ids[many]]), "odd": np.concatenate([odd, names & 1]),
                             "hot": np.arange(len(a) + len(names)) >= len(a), "n": 1})

    signed = (docs.where(F.col("id").isNotNull()).select("text")
              .mapInArrow(sign, "bucket int, low binary, high binary, times binary, ids binary"))
    return (signed.groupBy("bucket").applyInPandas(gather, "a long, b long, odd long, hot boolean, n long")
            .groupBy("a", "b", "odd", "hot").agg(F.sum("n").alias("n")))


def _candidates(docs: DataFrame, classes: DataFrame, words: int, bands: Bands, buckets: int, seed: int) -> DataFrame:
    """(a, b): keys of classes that share as many signatures as linked ones do, or are connected so.

    A pair that links shares ``needed`` signatures of either set.  Hot ones among these are no
    more than the hot ones that either set has; so the others, which are counted for each pair,
    make up the rest, or both sets have that many hot ones.  Only the sets that do are joined
    by hot signatures, as stars.
    """
    met = materialize(_meetings(docs, words, bands, buckets, seed))
    hot = met.where("hot").groupBy(F.col("b").alias("key"), "odd").agg(F.sum("n").alias("hots"))
    both = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("odd"), F.col(f"need{k}").alias("need")) for k in (0, 1))))
    least = materialize(classes.select("key", both.alias("of")).select("key", "of.*").join(hot, ["key", "odd"], "left").fillna(0, ["hots"]))
    pairs = met.where("not hot").select("a", "b", "odd", "n")
    for side in ("a", "b"):
        own = least.select(F.col("key").alias(side), "odd", F.col("need").alias(f"need_{side}"), F.col("hots").alias(f"hots_{side}"))
        pairs = pairs.join(own, [side, "odd"])
    pairs = pairs.where("n + least(hots_a, hots_b) >= greatest(need_a, need_b)").select("a", "b")
    ends = materialize(met.where("hot").select(F.col("a").alias("sig"), F.col("b").alias("key"), "odd")
                       .join(least.where("hots >= need").select("key", "odd"), ["key", "odd"]).select("sig", "key"))
    heads = materialize(ends.groupBy("sig").agg(F.min("key").alias("head"), F.count("*").alias("__n")))
    stars = spread_join(ends, heads, ["sig"], "__n", ends.count()).where("key <> head")
    return pairs.unionByName(stars.select(F.col("key").alias("a"), F.col("head").alias("b"))).distinct()


def _sizes(docs: DataFrame, words: int, bands: Bands, seed: int) -> DataFrame:
    """(id, n, f, g, key, least, need0, need1) of every row: size of its set, a 128-bit fingerprint,
    the key of it, the set's least token and ``needed``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks = [], []
            for tokens in shingle_sets(batch.column(1), words):
                n.append(len(tokens))
                marks.append((*_class_key(tokens, seed), int(tokens[:1].view(np.int64)[0]) if len(tokens) else 0, *needed(tokens, bands)))
            own = [pa.array(c, pa.int64()) for c in (zip(*marks, strict=True) if marks else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *own],
                                             names=["id", "n", "f", "g", "key", "least", "need0", "need1"])

    return docs.select("id", "text").mapInArrow(measure, "id long, n long, f long, g long, key long, least long, need0 long, need1 long")


def _classes(rows: DataFrame, words: int, bands: Bands) -> tuple[DataFrame, DataFrame, int]:
    """``_sizes`` of the rows, (n, f, g, key, least, need0, need1, rep, copies) of each class (rep: its
    smallest id), and the seed of the keys: the first with which no two classes have one key."""
    for seed in range(8):
        sized = materialize(_sizes(rows, words, bands, seed))
        classes = materialize(sized.where("n > 0 and id is not null").groupBy("n", "f", "g", "key", "least", "need0", "need1")
                              .agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
        if not classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
            return sized, classes, seed
    raise RuntimeError("classes without keys of their own")


class _Forest:
    """Union-find over the rows of a task."""

    def __init__(self, names: np.ndarray, parts: np.ndarray | None = None):
        self.names, (_, self.label) = names, np.unique(names if parts is None else parts, return_inverse=True)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.links.append((int(self.names[i]), int(self.names[j])))
            self.label[self.label == max(a, b)] = min(a, b)


def connect(names: np.ndarray, sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None,
            parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` (with ``side``, of those across its values;
    with ``parts``, sets of one part are connected already)."""
    forest = _Forest(names, parts)
    sizes = np.array([len(s) for s in sets])
    flat, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.lexsort((sizes, np.array([s[0] for s in sets])))
    groups = [order[i:i + GROUP] for i in range(0, len(order), GROUP)]
    if side is not None:
        groups = [g[side[g] == v] for g in groups for v in (0, 1)]
        groups = [g for g in groups if len(g)]
    own = [codes[a:a + n] for a, n in zip(starts, sizes, strict=True)]
    mark = np.zeros(len(flat), dtype=np.int32)
    for members in groups:
        tokens = np.concatenate([own[i] for i in members])
        union = np.unique(tokens)
        mark[union] = 1  # this group's row of the token-group matrix
        overlap = np.add.reduceat(mark[codes], starts)
        mark[union] = 0
        least, most = sizes[members].min(), sizes[members].max()
        # with a member of m shingles a link needs num (n + m) <= (num + den) overlap
        may = ((num + den) * overlap >= num * (sizes + least)) & (den * sizes >= num * least) & (den * most >= num * sizes)
        if side is not None:
            may &= side != side[members[0]]
        cuts = np.concatenate([[0], np.cumsum(sizes[members])[:-1]])
        for q in np.flatnonzero(may):
            if (forest.label[members] == forest.label[q]).all():
                continue
            mark[own[q]] = 1
            shared = np.add.reduceat(mark[tokens], cuts)
            mark[own[q]] = 0
            for i in members[(num + den) * shared >= num * (sizes[q] + sizes[members])]:
                forest.join(q, i)
    return forest.links


def may_link(sizes: np.ndarray, codes: list[np.ndarray], parts: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which sets share enough codes with a set of another part (with ``side``, of another side)."""
    flat = np.concatenate(codes)
    lengths = np.array([len(c) for c in codes])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.lexsort((sizes, np.array([c[0] for c in codes]), parts, side if side is not None else np.zeros(len(sizes), int)))
    cut = np.flatnonzero(np.diff(side[order])) + 1 if side is not None else []
    groups = [run[i:i + GROUP] for run in np.split(order, cut) for i in range(0, len(run), GROUP)]
    mark, opened = np.zeros(1 << 16, dtype=np.int32), np.zeros(len(sizes), dtype=bool)
    for members in groups:
        tokens = np.concatenate([codes[i] for i in members])
        mark[tokens] = 1  # this group's row of the token-group matrix
        overlap = np.add.reduceat(mark[flat], starts)
        mark[tokens] = 0
        least, most = sizes[members].min(), sizes[members].max()
        may = ((num + den) * overlap >= num * (sizes + least)) & (den * sizes >= num * least) & (den * most >= num * sizes)
        if side is not None:
            may &= side > side[members[0]]  # each pair of sides once
        if (parts[members] == parts[members[0]]).all():
            may &= parts != parts[members[0]]
        cuts = np.concatenate([[0], np.cumsum(lengths[members])[:-1]])
        for q in np.flatnonzero(may):
            mark[codes[q]] = 1
            shared = np.add.reduceat(mark[tokens], cuts)
            mark[codes[q]] = 0
            hit = members[((num + den) * shared >= num * (sizes[q] + sizes[members])) & (parts[members] != parts[q])]
            if len(hit):
                opened[q] = True
                opened[hit] = True
    return opened


def pack_codes(tokens: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """16-bit codes of a set's tokens (as many as tokens), sorted, as steps, compressed."""
    codes = np.sort((tokens & np.uint64(0xFFFF)).astype(np.uint16))
    return squeeze.compress(np.diff(codes, prepend=np.uint16(0)).tobytes())


def unpack_codes(packed: bytes, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.cumsum(np.frombuffer(expand.decompress(packed), np.uint16), dtype=np.uint16)


_LINKS = "a long, b long"


def _link_frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (smallest id reachable by links).

    Two documents link when den * |intersection| >= num * |union| of their shingle sets.

    Defined cases: null, empty and blank texts have no shingles and link with nothing; equal
    sets link; rows that share an id are rows of their own that stand for one node; a null
    id is returned with a null component; an empty table gives no rows; other columns are
    not read.  ``docs`` is read several times and must be stable (a table).
    """
    spark = docs.sparkSession
    bands = Bands(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sized, classes, seed = _classes(rows, words, bands)
    several = materialize(classes.where("copies > 1").select("key", "rep"))  # a table of its own: a hot class's rows can then be split
    copies = materialize(sized.where("n > 0 and id is not null").join(several, "key").where("id <> rep").select("id", "rep").distinct())

    near = materialize(_candidates(rows, classes, words, bands, 4 * shuffle_partitions(spark), seed))
    block = materialize(connected_components(near).select(F.col("id").alias("key"), F.col("component").alias("block")))

    sizes = materialize(block.groupBy("block").agg(F.count("*").alias("__n")))
    total = block.count()
    placed = spread_join(block, sizes, ["block"], "__n", total).withColumn("large", F.col("__n") > SUB_BLOCK).drop("__n")
    placed = placed.join(classes.select("key", "rep", "n", "least"), "key")
    # a large block is cut by least tokens (two cuts under one hash are compared with each other, no more)
    placed = materialize(placed.withColumn("cut", F.when(F.col("large"), F.xxhash64("block", "least")).otherwise(F.col("block"))))
    cuts = materialize(placed.groupBy("cut").agg(F.count("*").alias("__n"), F.min("key").alias("head")).withColumn(
        "subs", F.ceil(F.col("__n") / SUB_BLOCK).cast("int")))
    placed = materialize(spread_join(placed, cuts, ["cut"], "__n", total).withColumn("alone", F.col("__n") < 2).drop("__n", "least"))
    few = placed.count() <= BROADCAST_IDS

    def sent(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    # rows of an id that is no class's smallest are not read; of the others, those of a class in a block
    wanted = rows.join(sent(placed.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows of one id and text: one from each task
        for batch in batches:
            keys, sets = [], []
            for s in shingle_sets(batch.column("text"), words):
                key = _class_key(s, seed)[2]
                if len(s) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "tokens"])

    held = materialize(wanted.select("text").mapInArrow(tokenise, "key long, tokens binary")
                       .join(sent(placed.where("large or not alone").select("key", "large", "alone", "cut", "subs", "head")), "key")
                       .withColumnRenamed("key", "id"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        return _link_frame(connect(pdf["id"].to_numpy(np.int64), sets, num, den))

    # the first set of a cut is in every sub-block of it: what is near it is connected at once
    everywhere = F.sequence(F.lit(0), F.col("subs") - 1)
    own = F.array(F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    subs = held.where("not alone").withColumn("sub", F.explode(F.when(F.col("id") == F.col("head"), everywhere).otherwise(own)))
    first = materialize(subs.select("cut", "sub", "id", "tokens").groupBy("cut", "sub").applyInPandas(inside, _LINKS))

    links = first
    large = placed.where("large").select(F.col("key").alias("id"), "block", "n")
    largest = large.agg(F.max("n")).first()[0]
    if largest is not None:
        band = bands.column(F.col("n"), largest)
        links = links.unionByName(_across(large.withColumn("band", band), held.where("large").select("id", "tokens"), first, num, den))
    # from classes to documents: an id's texts are in one component
    for side in ("a", "b"):
        links = links.join(sent(placed.select(F.col("key").alias(side), "rep")), side).withColumn(side, F.col("rep")).drop("rep")
    links = links.select("a", "b").unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    groups = connected_components(links).withColumnRenamed("component", "component_id")
    return (sized.join(groups, "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id")))


def _across(large: DataFrame, tokens: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components of large blocks: ``large`` (id, block, n, band) places
    the sets, ``tokens`` (id, tokens) holds them, ``links`` are those so far."""
    row = materialize(large.join(connected_components(links), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"))
    total = row.count()
    sizes = row.groupBy("block", "band", "part").agg(F.count("*").alias("__n"))
    # a large component has sub-blocks of its own, small ones share some
    big = F.col("__n") >= CELL_SIDE // 2
    shares = sizes.where(~big).groupBy("block", "band").agg(F.ceil(F.sum("__n") / CELL_SIDE).cast("int").alias("shares"))
    sizes = materialize(sizes.join(shares, ["block", "band"], "left")
                        .withColumn("pure", F.when(big, F.col("part")))
                        .withColumn("cuts", F.when(big, F.ceil(F.col("__n") / CELL_SIDE)).otherwise(F.col("shares")).cast("int"))
                        .select("block", "band", "part", "pure", "cuts", "__n"))
    cut = F.pmod(F.xxhash64(F.when(F.col("pure").isNull(), F.col("part")).otherwise(F.col("id"))), F.col("cuts"))
    placed = spread_join(row, sizes, ["block", "band", "part"], "__n", total).withColumn(
        "sub", F.concat_ws("/", "band", F.coalesce(F.col("pure").cast("string"), F.lit("-")), cut.cast("string")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [pack_codes(np.frombuffer(t.as_py(), np.uint64), squeeze) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "codes"])

    codes = tokens.mapInArrow(pack, "id long, codes binary")
    placed = materialize(placed.join(codes, "id").select("block", "band", "sub", "pure", "id", "part", "n", "codes"))
    names = placed.select("block", "band", "sub", "pure").distinct()
    x, y = names.alias("x"), names.alias("y")
    cells = (x.join(y, F.col("x.block") == F.col("y.block"))
             .where("x.sub <= y.sub and abs(x.band - y.band) <= 1")  # linked sets are in neighbouring size classes
             .where("x.sub < y.sub or x.pure is null")
             .where("x.pure is null or y.pure is null or x.pure <> y.pure")
             .select(F.col("x.block").alias("block"), F.col("x.sub").alias("s"), F.col("y.sub").alias("t")))
    ends = materialize(cells.select("block", "s", "t", F.lit(0).alias("side"), F.col("s").alias("sub"))
                       .unionByName(cells.where("s <> t").select("block", "s", "t", F.lit(1).alias("side"), F.col("t").alias("sub"))))

    def open_some(pdf: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor()
        side = pdf["side"].to_numpy()
        opened = may_link(pdf["n"].to_numpy(np.int64), [unpack_codes(c, expand) for c in pdf["codes"]], pdf["part"].to_numpy(np.int64),
                          num, den, side if side.any() else None)
        return pdf.loc[opened, ["block", "s", "t", "side", "id", "part"]]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        side = pdf["side"].to_numpy()
        return _link_frame(connect(pdf["id"].to_numpy(np.int64), sets, num, den, side if side.any() else None, pdf["part"].to_numpy(np.int64)))

    opened = (ends.join(placed.drop("band", "pure"), ["block", "sub"]).groupBy("block", "s", "t")
              .applyInPandas(open_some, "block long, s string, t string, side int, id long, part long"))
    return materialize(opened).join(tokens, "id").groupBy("block", "s", "t").applyInPandas(meet, _LINKS)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (with doc_id and text) without those whose component has a smaller document; of
    rows that share a kept id one stays (whatever their texts, they stand for one node; the one
    with the smallest hash, the same in every run), rows of a null id all stay."""
    nodes = materialize(components(docs, **options).where(F.col("doc_id").isNotNull())
                        .groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
                        .where("c <> doc_id or n > 1"))
    few = nodes.count() <= BROADCAST_IDS

    def ids(condition: str) -> DataFrame:
        found = nodes.where(condition).select("doc_id")
        return F.broadcast(found) if few else found

    alone = docs.join(ids("true"), "doc_id", "left_anti").select(*docs.columns)
    repeated = (docs.join(ids("c = doc_id"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id"))
                .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*"))
    return alone.unionByName(repeated)
