"""Merkle manifest of a dataset, with proofs by descent of a content-addressed DAG.

*Records.*  Every row is a leaf, the digest of its fields.  The leaves of a group (a source)
are numbered by key; every 16 consecutive nodes become the digest of their concatenation
until one node, the subroot, is left; the subroots, in the order of their groups, make the
tree above in the same way.  Each inner node is one record, digest to children, in a store
that holds equal nodes once.

*Descent.*  A request names a leaf by its group's number and its rank.  Their digits in base
16 are the way from the root: at each level the node's record is looked up by digest, the
digit picks the child, the children not picked are a segment of the proof, and the child is
the next node.  Requests that agree in their leading digits go down together as one row and
part only below; reversed, the segments are the proof from leaf to root.

Everything is DataFrame functions.  Ranks come from a range-partitioned sort and partition
sizes, runs are grouped by (group, rank / 16): no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialize
from panelcast.llm.spread import placed

#: Children of a node.
FANOUT = 16
#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots (trees of groups have the place of their first leaf, 0 or more).
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_text(value: Column) -> Column:
    """A digest as lower-case hex."""
    return F.lower(F.hex(value))


def joined_text(digests: Column) -> Column:
    """The hex texts of an array of digests, one after the other."""
    return F.array_join(F.transform(digests, as_text), "")


def levels_over(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FANOUT), levels + 1
    return levels


@dataclass
class Manifest:
    """The tables of a manifest.

    leaves   the rows' columns asked for, group, tree, rank, leaf
    groups   group, tree, n_leaves, height, subroot, number (place of the group, from 0)
    records  digest, children
    root     lower-case hex; None for an empty dataset
    """
    leaves: DataFrame
    groups: DataFrame
    records: DataFrame
    root: str | None
    height: int
    top_height: int


def _grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (tree, n, idx, digest) of one level, with n nodes in their tree: the inner
    nodes of all levels, with children, and each tree's root (tree, height, digest)."""
    levels, roots = [], []
    for level in range(levels_over(most) + 1):
        roots.append(nodes.where("n = 1").select("tree", F.lit(level).alias("height"), "digest"))
        if level == levels_over(most):
            break
        run = F.floor(F.col("idx") / FANOUT).cast("long")
        grouped = (nodes.where("n > 1").groupBy("tree", "n", run.alias("idx"))
                   .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda s: s["digest"]).alias("children")))
        made = materialize(grouped.withColumn("digest", digest(joined_text(F.col("children")))))
        levels.append(made.select("digest", "children"))
        nodes = made.select("tree", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), "idx", "digest")
    return levels, reduce(DataFrame.unionByName, roots)


def manifest(rows: DataFrame, group: Column, key: str, leaf: str, keep: Sequence[str] = ()) -> Manifest:
    """The manifest of ``rows``, whose column ``leaf`` holds each row's digest (32 bytes).

    Groups ascend by UTF-8 bytes, null first; leaves of a group ascend by ``key``, null
    first, then by digest.  ``rows`` is read once.  An empty table has a manifest without
    a root.
    """
    tag = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))  # null comes first
    named = rows.select(*[F.col(c) for c in keep], F.col(key).alias("__key"), F.col(leaf).alias("leaf"), tag.alias("group"),
                        F.spark_partition_id().alias("__salt"))
    # written before it is sorted: a sort by ranges reads its input twice
    at = placed(materialize(named), ["group", "__key", "leaf", "__salt"], "place")
    cells = materialize(at.groupBy("group", "__part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    trees = materialize(cells.groupBy("group").agg(F.min("first").alias("tree"), F.sum("n").alias("n_leaves")))
    # a group's rows meet its first place partition by partition
    known = cells.select("group", "__part").join(trees, "group")
    leaves = materialize(at.join(known, ["group", "__part"])
                         .select(*keep, "group", "tree", (F.col("place") - F.col("tree")).alias("rank"), "leaf", "n_leaves"))
    most = trees.agg(F.max("n_leaves"), F.count(F.lit(1))).first()
    if not most[1]:
        none = leaves.select("leaf", F.array("leaf").alias("children")).withColumnRenamed("leaf", "digest").limit(0)
        groups = trees.select("group", "tree", "n_leaves", F.lit(0).alias("height"), F.lit(b"").alias("subroot"), F.lit(0).cast("long").alias("number"))
        return Manifest(leaves.drop("n_leaves"), groups, none, None, 0, 0)
    below, subroots = _grow(leaves.select("tree", F.col("n_leaves").alias("n"), F.col("rank").alias("idx"), F.col("leaf").alias("digest")), most[0])
    found = subroots.withColumnRenamed("digest", "subroot").join(trees, "tree")
    groups = materialize(placed(found, ["tree"], "number").drop("__part"))  # trees ascend as their groups do
    above, top = _grow(groups.select(F.lit(TOP).cast("long").alias("tree"), F.lit(most[1]).cast("long").alias("n"),
                                     F.col("number").alias("idx"), F.col("subroot").alias("digest")), most[1])
    stored = below + above
    if not stored:  # one leaf in all
        stored = [leaves.select(F.col("leaf").alias("digest"), F.array("leaf").alias("children")).limit(0)]
    records = materialize(reduce(DataFrame.unionByName, stored).groupBy("digest").agg(F.first("children").alias("children")))
    return Manifest(leaves.drop("n_leaves"), groups, records, top.select(as_text(F.col("digest"))).first()[0],
                    levels_over(most[0]), levels_over(most[1]))


def _prefixes(ends: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes (tree, idx) on the way to ``ends``, by level; level 0 is ``ends`` itself."""
    out = [ends]
    for _ in range(levels):
        out.append(materialize(out[-1].select("tree", F.floor(F.col("idx") / FANOUT).cast("long").alias("idx")).distinct()))
    return out


def _opened(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes (tree, idx, digest, segments) with their children, looked up by digest."""
    return nodes.join(records, "digest").select("tree", F.col("idx").alias("up"), "children", "segments")


def _down(wanted: DataFrame, nodes: DataFrame, records: DataFrame) -> DataFrame:
    """One level: each wanted (tree, idx, ...) with its digest and segments, from the nodes above."""
    digit = F.col("idx") % FANOUT
    found = (wanted.withColumn("up", F.floor(F.col("idx") / FANOUT).cast("long")).join(_opened(nodes, records), ["tree", "up"])
             .withColumn("digit", digit.cast("int")))
    others = F.concat(F.expr("slice(children, 1, digit)"), F.expr(f"slice(children, digit + 2, {FANOUT})"))
    segment = F.array(F.struct(F.col("digit"), others.alias("others")))
    return (found.withColumn("digest", F.expr("element_at(children, digit + 1)"))
            .withColumn("segments", F.concat("segments", segment)).drop("up", "children", "digit"))


def prove(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, rank and any other columns but idx, digest, segments, height) with
    digest, the leaf that the descent arrives at, and path: for each level from the leaf
    up to the root the digit of the node in its run and the other digests of the run."""
    start = (made.leaves.sparkSession.range(1)
             .select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("idx"), F.unhex(F.lit(made.root)).alias("digest"),
                     F.array().cast("array<struct<digit:int,others:array<binary>>>").alias("segments")))
    asked = made.groups.join(requests.select("tree").distinct(), "tree", "left_semi")
    nodes = start
    tops = _prefixes(asked.select(F.lit(TOP).cast("long").alias("tree"), F.col("number").alias("idx"), F.col("tree").alias("own"), "height"), made.top_height)
    for level in reversed(range(made.top_height)):
        nodes = _down(tops[level], nodes, made.records)
    if not made.top_height:  # one group: its subroot is the root
        nodes = tops[0].join(start.drop("idx"), "tree")
    heads = materialize(nodes.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("idx"), "digest", "segments", "height"))

    ends = requests.withColumnRenamed("rank", "idx")
    ways = _prefixes(ends, max(0, made.height - 1))
    shape = ["tree", "idx", "digest", "segments"]
    nodes = heads.where(F.col("height") == made.height).select(*shape)
    for level in reversed(range(1, made.height)):
        here = heads.where(F.col("height") == level).select(*shape)
        nodes = materialize(_down(ways[level], nodes, made.records).select(*shape).unionByName(here))
    if made.height:
        lone = heads.where("height = 0").select(*shape)
        out = _down(ends, nodes, made.records).unionByName(ends.join(lone, ["tree", "idx"]), allowMissingColumns=False)
    else:
        out = ends.join(nodes, ["tree", "idx"])
    return out.withColumnRenamed("idx", "rank").withColumn("path", F.reverse("segments")).drop("segments")


def fold(leaf: Column, path: Column) -> Column:
    """The root (lower-case hex) that ``leaf`` (32 bytes) and a path lead to."""
    def step(node: Column, run: Column) -> Column:
        left, right = F.slice(run["others"], F.lit(1), run["digit"]), F.slice(run["others"], run["digit"] + 1, F.lit(FANOUT))
        return F.sha2(F.concat(joined_text(left), node, joined_text(right)).cast("binary"), 256)
    return F.aggregate(path, as_text(leaf), step)


def proof_digest(path: Column) -> Column:
    """SHA-256 (lower-case hex) of all digests of a path, one after the other."""
    return F.sha2(F.array_join(F.transform(path, lambda run: joined_text(run["others"])), "").cast("binary"), 256)


def document_leaf(text: Column | None = None) -> Column:
    """The leaf of a document; with another text than its own where ``text`` is given."""
    parts = [field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]
    return digest(F.concat(*parts))


def audit(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and check against the manifest of ``docs``.

    Rows whose crc32 (of doc_id as decimal text) 5 divides are tampered with: their text has
    A-Z lower-cased when they are folded.  Returns doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    Defined cases: null fields are ``-``; a null source is a group of its own and comes
    first; null ids come first in their group and are not tampered with; rows that share an
    id follow the order of their digests, repeated rows are leaves of their own; an empty
    table gives no rows; other columns are not read.
    """
    texts = {c: F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")}
    rows = docs.select(*[texts.get(c, F.col(c)) for c in FIELDS])
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = rows.select("doc_id", "source", document_leaf().alias("leaf0"),
                         F.when(marked & F.col("text").rlike("[A-Z]"), document_leaf(lower)).alias("tampered"))
    made = manifest(leaves, F.col("source"), "doc_id", "leaf0", keep=["doc_id", "tampered"])
    if made.root is None:
        none = [F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        return docs.select("doc_id", *none, F.lit(False).alias("verified")).limit(0)
    proven = prove(made, made.leaves.select("doc_id", "tampered", "leaf", "tree", "rank"))
    # a group's subroot is the digest that its rows' paths lead to below the top tree
    below = F.slice(F.col("path"), F.lit(1), F.size("path") - made.top_height)
    out = proven.select(
        "doc_id", as_text(F.col("leaf")).alias("leaf"), fold(F.col("leaf"), below).alias("subroot"), F.lit(made.root).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 5, top_levels: int = 3) -> str:
    """The same rows in SQL, for at most 16 ** levels leaves of a source and 16 ** top_levels sources."""
    def value(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    whole = " || ".join(value(c) for c in FIELDS)
    other = " || ".join(value(c) if c != "text" else value(lower) for c in FIELDS)
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
    ctes = [f"""leaves AS (SELECT doc_id, source, sha256({whole}) AS leaf, sha256(CASE WHEN {crc} % 5 = 0 THEN {other} ELSE {whole} END) AS own
          FROM documents)""", """
        ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
          count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM leaves)""",
            "t0 AS (SELECT s, r AS i, n AS c, leaf AS h FROM ranked)",
            "w0 AS (SELECT *, '' AS proof, own AS f, leaf AS up FROM ranked)"]

    def grow(k: int, prefix: str, tree: str, rank: str, nxt: str, last: str) -> None:
        ctes.append(f"g{prefix}{k} AS MATERIALIZED (SELECT s, i // 16 AS p, any_value(c) AS c, list(h ORDER BY i) AS hs FROM {nxt} GROUP BY s, i // 16)")
        ctes.append(f"t{prefix}{k + 1} AS (SELECT s, p AS i, (c + 15) // 16 AS c, CASE WHEN c > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM g{prefix}{k})")
        d = f"(({rank} // {16 ** k}) % 16)"
        left, right = f"array_to_string(hs[1:{d}], '')", f"array_to_string(hs[{d} + 2:], '')"
        ctes.append(f"""w{prefix}{k + 1} AS (SELECT w.* EXCLUDE (proof, f), CASE WHEN c > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
          CASE WHEN c > 1 THEN sha256({left} || f || {right}) ELSE f END AS f
          FROM {last} w JOIN g{prefix}{k} g ON g.s = {tree} AND g.p = {rank} // {16 ** (k + 1)})""")

    for k in range(levels):
        grow(k, "", "w.s", "w.r", f"t{k}", f"w{k}")
    ctes.append(f"tt0 AS (SELECT 0 AS s, s AS i, (SELECT count(*) FROM t{levels}) AS c, h FROM t{levels})")
    ctes.append(f"wt0 AS (SELECT w.* EXCLUDE (up), t.h AS subroot FROM w{levels} w JOIN t{levels} t ON t.s = w.s)")
    for k in range(top_levels):
        grow(k, "t", "0", "w.s", f"tt{k}", f"wt{k}")
    return f"""WITH {', '.join(ctes)}
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
        FROM wt{top_levels}, (SELECT h FROM tt{top_levels})"""
