"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of token counts.  Cell weights are
raked: scaled to the target tokens of each source, then of each language, then of each
topic, and over again until no probability moves any more.  A cell's weight divided by its tokens, times the fraction of all
tokens wanted, is the probability with which its documents are sampled.

A document can't be taken more than once, so some targets may be out of reach; ``margins``
says which, and by how much.

Everything is DataFrame work.  The raked table has a row per cell, not per document; a
round is a grouped sum and an equi-join on each margin's column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import Steps, materialize

MARGINS = ("source", "lang", "topic")
#: A word is a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Topic rules, the first that holds counts; documents without a match are ``prose``.
TOPIC_MARKS = {"contact": "@", "licence": "icense", "credential": 'token = "', "table": " | ", "slogan": "!!"}
NO_TOPIC, NO_VALUE = "prose", "(none)"
#: How strongly target shares lean to equal shares: share ~ tokens ** power.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: A table of at most so many cells is broadcast to the documents (a few MB).
BROADCAST_CELLS = 50_000
#: The raked table is kept in files of about so many cells.
CELLS_PER_FILE = 200_000
#: Raking ends when no probability moved by more than this in a round, or after so many rounds.
TOLERANCE, ROUNDS = 1e-12, 200
#: Rounds of one job while all cells are one file.
CHAINED = 5


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column) -> Column:
    out = F
    for name, mark in TOPIC_MARKS.items():
        out = out.when(F.contains(text, F.lit(mark)), name)
    return out.otherwise(NO_TOPIC)


def uniform(key: Column, seed: int, content: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone, or the content where the
    key is null (52 bits of a digest)."""
    instead = F.concat(F.lit("null:"), F.md5(F.coalesce(content, F.lit("")).cast("binary")))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), instead))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): the tokens each value shall have; shares go as tokens ** power."""
    sums = cells.groupBy(margin).agg(F.sum("base").alias("t")).where("t > 0")
    total = sums.agg(F.sum("t").alias("all"), F.sum(F.pow("t", F.lit(power))).alias("weight"))
    # one row by construction
    return (sums.join(F.broadcast(total))
            .select(margin, (F.pow("t", F.lit(power)) / F.col("weight") * F.col("all")).alias("target")))


def rake(cells: DataFrame, targets: dict[str, DataFrame], fraction: float, rounds: int = ROUNDS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins and base) with ``w``, raked to the targets.

    After each round weights are held to base / fraction, where a document's probability
    is 1; the next round lets the margin's other cells take up what is missing.  The rounds
    end when no probability moved by more than ``tolerance``, or after ``rounds``.  Values
    without a target keep their weight.
    """
    steps = Steps(cells.sparkSession)
    files = 1 + cells.count() // CELLS_PER_FILE
    state = cells.withColumn("w", F.col("base").cast("double"))
    for margin, target in targets.items():
        state = state.join(target.select(margin, F.col("target").alias(f"__goal_{margin}")), margin, "left")
    state = steps.put(state.coalesce(files))
    one_round, chained = (_round_of_one_file, CHAINED) if files == 1 else (_round, 1)
    moved = F.max(F.abs(_chance("w", fraction) - _chance("__before", fraction)))
    for done in range(0, rounds, chained):
        for _ in range(min(chained, rounds - done)):
            state = one_round(state.withColumn("__before", F.col("w")), list(targets))
            state = state.withColumn("w", F.least("w", F.col("base") / F.lit(float(fraction))))
        state = steps.put(state.coalesce(files))
        if (state.agg(moved).first()[0] or 0.0) <= tolerance:
            break
    return state.select(*cells.columns, "w")


def _round(state: DataFrame, held: list[str]) -> DataFrame:
    """One round over many files: per margin a sum, combined in every task first, and a join."""
    for margin in held:
        sums = state.groupBy(F.col(margin).alias("__value")).agg(F.sum("w").alias("__sum"))
        state = state.join(sums, F.col(margin) == F.col("__value")).withColumn("w", _scaled(margin)).drop("__value", "__sum")
    return state


def _round_of_one_file(state: DataFrame, held: list[str]) -> DataFrame:
    """The same round where all cells are one file, so one task without a shuffle: sums over
    windows, so that rounds can be chained in a job."""
    state = state.coalesce(1)
    for margin in held:
        state = (state.withColumn("__sum", F.sum("w").over(Window.partitionBy(margin)))
                 .withColumn("w", _scaled(margin)).drop("__sum"))
    return state


def _scaled(margin: str) -> Column:
    return F.col("w") * F.coalesce(F.col(f"__goal_{margin}") / F.col("__sum"), F.lit(1.0))


def _chance(weight: str, fraction: float) -> Column:
    """A document's probability in a cell of that weight."""
    return F.least(F.lit(1.0), F.lit(float(fraction)) * F.col(weight) / F.col("base"))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return (docs.withColumn("topic", topic(F.coalesce(F.col(text_col), F.lit(""))))
            .withColumn("tokens", token_count(F.col(text_col)))
            .withColumn("__s", F.coalesce(F.col("source").cast("string"), F.lit(NO_VALUE)))
            .withColumn("__l", F.coalesce(F.col("lang").cast("string"), F.lit(NO_VALUE))))


def _raked(keyed: DataFrame, fraction: float, rounds: int, powers: dict[str, float] | None,
           targets: dict[str, DataFrame] | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The raked cells, and each margin's targets."""
    given, powers = targets or {}, powers or POWERS
    cells = materialize(keyed.groupBy(F.col("__s").alias("source"), F.col("__l").alias("lang"), "topic")
                        .agg(F.sum("tokens").alias("base")))
    full = cells.where("base > 0")
    goals = {m: given.get(m) if m in given else tempered_targets(full, m, powers[m]) for m in MARGINS}
    return rake(full, goals, fraction, rounds), goals


def margins(docs: DataFrame, fraction: float = 0.5, rounds: int = ROUNDS, text_col: str = "text",
            powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
            near: float = 0.01) -> DataFrame:
    """One row per value of each margin: margin, value, target and expected tokens of the
    sample, exhausted (tokens of cells whose documents are all taken), unreached (expected
    tokens differ from the target by more than ``near`` of it).

    Defined cases: those of ``sampling_plan``; a target for a value that no document has is a
    row of 0 expected tokens; a value without a target has a null target and is not unreached.
    """
    raked, goals = _raked(_keyed(docs, text_col), fraction, rounds, powers, targets)
    chance, out = _chance("w", fraction), None
    for margin, goal in goals.items():
        sums = raked.groupBy(F.col(margin).alias("value")).agg(
            F.sum(chance * F.col("base")).alias("expected"),
            F.sum(F.when(chance >= 1.0, F.col("base")).otherwise(0)).cast("long").alias("exhausted"))
        wanted = goal.select(F.col(margin).alias("value"), (F.col("target") * F.lit(float(fraction))).alias("target"))
        rows = wanted.join(sums, "value", "full").select(
            F.lit(margin).alias("margin"), "value", "target", F.coalesce("expected", F.lit(0.0)).alias("expected"),
            F.coalesce("exhausted", F.lit(0)).cast("long").alias("exhausted"))
        out = rows if out is None else out.unionByName(rows)
    off = F.abs(F.col("expected") - F.col("target")) > F.lit(near) * F.col("target")
    return out.withColumn("unreached", F.coalesce(off, F.lit(False)))


def sampling_plan(docs: DataFrame, fraction: float = 0.5, rounds: int = ROUNDS, id_col: str = "doc_id",
                  text_col: str = "text", powers: dict[str, float] | None = None,
                  targets: dict[str, DataFrame] | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with topic, tokens, probability and sampled.

    ``targets`` may give a table (value, target tokens) by margin; the others are tempered
    shares of the documents' own tokens (``powers``).  ``fraction`` of the tokens is
    expected in the sample.  A target that needs more tokens than a value's documents can
    give is not met: see ``margins``.

    Defined cases: a null source or language is a value of its own, ``(none)``; null and
    empty texts have no tokens, and a cell without tokens is sampled at ``fraction``;
    repeated rows with one id share one draw, rows of null id draw by their text; an empty
    table gives no rows.  A column named topic, tokens, probability or sampled is replaced;
    others stay.
    """
    keyed = _keyed(docs, text_col)
    raked, _ = _raked(keyed, fraction, rounds, powers, targets)
    chance = raked.select(
        F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"),
        _chance("w", fraction).alias("__p"))
    if raked.count() <= BROADCAST_CELLS:
        chance = F.broadcast(chance)
    joined = keyed.withColumn("__t", F.col("topic")).join(chance, ["__s", "__l", "__t"], "left")
    p = F.coalesce("__p", F.lit(float(fraction)))
    return (joined.withColumn("probability", p)
            .withColumn("sampled", uniform(F.col(id_col), seed, F.col(text_col)) < p)
            .drop("__s", "__l", "__t", "__p"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns."""
    columns = docs.columns
    hidden = {c: f"__own_{c}" for c in ("topic", "tokens", "probability", "sampled") if c in columns}
    plan = sampling_plan(docs.withColumns({h: F.col(c) for c, h in hidden.items()}), **options).where("sampled")
    return plan.select(*[F.col(hidden.get(c, c)).alias(c) for c in columns])


def oracle_sql(fraction: float = 0.5, rounds: int = 60, seed: int = 7) -> str:
    """The same result for the table ``documents`` as DuckDB SQL (rounds unrolled; so many
    leave nothing that moves)."""
    marks = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPIC_MARKS.items())
    out = [f"""WITH keyed AS MATERIALIZED (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(source, '{NO_VALUE}') AS source, coalesce(lang, '{NO_VALUE}') AS lang,
         CASE {marks} ELSE '{NO_TOPIC}' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents),
full_cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS base FROM keyed
  GROUP BY ALL HAVING sum(tokens) > 0)"""]
    for m in MARGINS:
        out.append(f"""goal_{m} AS MATERIALIZED (SELECT {m}, pow(t, {POWERS[m]}) / sum(pow(t, {POWERS[m]})) OVER () * sum(t) OVER () AS target
  FROM (SELECT {m}, sum(base) AS t FROM full_cells GROUP BY {m}))""")
    last = "(SELECT source, lang, topic, base, base AS w FROM full_cells)"
    for r in range(rounds):
        for m in MARGINS:
            w = f"w * (target / sum(w) OVER (PARTITION BY {m}))"
            if m == MARGINS[-1]:
                w = f"least({w}, base / {float(fraction)})"
            name = f"s{r}_{m}"
            out.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, base, {w} AS w FROM {last} JOIN goal_{m} USING ({m}))")
            last = name
    u = f"CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || digest)), 1, 13)) AS BIGINT) / {float(16**13)}"
    return ",\n".join(out) + f"""
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, {u} < p AS sampled
FROM (SELECT k.*, coalesce(least(1.0, {float(fraction)} * w / base), {float(fraction)}) AS p
      FROM keyed k LEFT JOIN {last} s USING (source, lang, topic))"""
