"""Toxicity by non-negative positive-unlabelled learning.

The classifier is trained from confirmed toxic documents and unlabelled text only; no
document is taken as clean.  With the class prior p (the share of toxic documents), the
risk of calling unlabelled text clean is corrected for the toxic part hidden in it:

    p * R_toxic(+)  +  max(0, R_unlabelled(-) - p * R_toxic(-))

and when the corrected part falls below 0 its gradient is turned round, so that the model
can't win by overfitting (the non-negative estimator).

A text is the set of its words and word beginnings (4 and 5 letters).  The terms that set
confirmed documents most apart from unlabelled ones are chosen by a distributed count over
every unlabelled document of the training fold; a linear model over them is trained with
numpy on the driver from a bounded sample.

The class prior comes from confirmed and unlabelled text alone: at any cut of a score, the
unlabelled share above it holds at least p times the confirmed share above it, so p is at
most their ratio, and the least upper end of such a ratio is taken.  The score sums the odds
of terms chosen on one half of the confirmed documents and reads those of the other half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import bounded_sample, materialize, train_fold, train_labels

#: At most about so many confirmed and unlabelled documents are fitted.
CONFIRMED_ROWS, UNLABELLED_ROWS = 6_000, 18_000
#: Terms of the model, by how many of its standard errors the share of confirmed documents
#: with a term must pass the unlabelled share, and how many times commoner it must be there.
TERMS, LEAST_ERRORS, LEAST_RATIO = 1_000, 1.5, 2.0
#: The share of confirmed documents that must pass a cut from which the class prior is read.
LEAST_PASS = 0.2
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
#: A task hands its counts on when it holds this many terms.
HELD_TERMS = 300_000


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms_of(text: str | None) -> set[str]:
    """Distinct words and, marked by a star, their first 4 and 5 letters."""
    words = words_of(text)
    return words | {w[:4] + "*" for w in words} | {w[:5] + "*" for w in words}


def _indexed(vocabulary: dict[str, int], text: str | None) -> list[int]:
    return sorted(vocabulary[t] for t in terms_of(text) & vocabulary.keys())


@dataclass
class Linear:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, texts: pd.Series) -> np.ndarray:
        known = self.vocabulary.keys()
        total = np.array([self.bias + sum(self.weights[self.vocabulary[t]] for t in terms_of(v) & known) for v in texts])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def nnpu_fit(rows: list[list[int]], confirmed: np.ndarray, start: np.ndarray, prior: float, steps: int = 400,
             rate: float = 0.05, l2: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model: full-batch Adam on the non-negative risk with the
    sigmoid loss (bounded, as the estimator needs), from the weights ``start``."""
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows] or [np.empty(0, np.int64)])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known, hidden = confirmed.astype(bool), ~confirmed.astype(bool)
    n_p, n_u = max(1, known.sum()), max(1, hidden.sum())
    w = np.append(start, np.log(prior / (1 - prior)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = np.bincount(of, w[flat], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # loss of calling a row clean; 1 - p: toxic
        rest = p[hidden].sum() / n_u - prior * p[known].sum() / n_p
        bend = p * (1 - p)
        slope = np.zeros(len(rows))
        if rest >= 0:
            slope[known] = -2 * prior * bend[known] / n_p
            slope[hidden] = bend[hidden] / n_u
        else:  # the corrected part may not go below 0: step back up
            slope[known] = prior * bend[known] / n_p
            slope[hidden] = -bend[hidden] / n_u
        grad = np.append(np.bincount(flat, slope[of], len(start)), slope.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def class_prior(confirmed: np.ndarray, unlabelled: np.ndarray, errors: float = 2.0) -> float:
    """The share of positives among the unlabelled, from scores of confirmed and unlabelled rows:
    the least ratio of their shares above a cut.  Only cuts that a fifth of the confirmed rows
    pass count, each with the upper end of its error (``errors`` standard errors): the share is
    at most that, and close to it where rows are many.  Rows that chose the score must not be among them."""
    cuts = np.unique(confirmed)
    cuts = cuts[cuts <= np.quantile(confirmed, 1 - LEAST_PASS)]
    n_p, n_u = len(confirmed), len(unlabelled)
    p = 1 - np.searchsorted(np.sort(confirmed), cuts) / n_p
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / n_u
    ratio = u / p
    off = np.sqrt((u * (1 - u) + 1 / n_u) / n_u + ratio**2 * p * (1 - p) / n_p) / p
    return float(np.clip((ratio + errors * off).min(), 0.005, 0.9))


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, first, second, unlabelled): rows that hold the term, confirmed ones by half."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter(), Counter(), Counter()]  # confirmed of half 0 and 1, unlabelled

        def out() -> pa.RecordBatch:
            terms = [pa.array([*c], pa.string()) for c in held]
            counts = [pa.array([0] * sum(map(len, held[:i])) + [*c.values()] + [0] * sum(map(len, held[i + 1:])), pa.int64())
                      for i, c in enumerate(held)]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(terms), *counts], names=["term", "first", "second", "unlabelled"])

        for batch in batches:
            for text, known, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[half if known else 2].update(terms_of(text))
                if sum(map(len, held)) > HELD_TERMS:
                    yield out()
        yield out()

    return (rows.select("text", "known", "half").mapInArrow(count, "term string, first long, second long, unlabelled long")
            .groupBy("term").agg(*[F.sum(c).alias(c) for c in ("first", "second", "unlabelled")]))


def _apart(counts: DataFrame, confirmed: Column, n_p: int, n_u: int, n_terms: int) -> dict[str, float]:
    """The ``n_terms`` terms that set confirmed documents most apart, with the log of their odds."""
    if not n_p:
        return {}
    a, b = confirmed / n_p, F.col("unlabelled") / n_u
    share = (n_p * a + n_u * b) / (n_p + n_u)
    apart = (a - b) / F.sqrt(share * (1 - share) + 1e-6)
    odds = F.log((a + 1 / n_p) / (b + 1 / n_p))
    chosen = (counts.where((a > LEAST_RATIO * b) & (a - b >= LEAST_ERRORS * F.sqrt(a / n_p)))
              .select("term", odds.alias("odds"), apart.alias("apart")).orderBy(F.desc("apart"), "term").limit(n_terms))
    return {r["term"]: r["odds"] for r in chosen.collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", confirmed_rows: int = CONFIRMED_ROWS,
        unlabelled_rows: int = UNLABELLED_ROWS, n_terms: int = TERMS, seed: int = 4) -> Linear:
    """The model learnt from the training fold: confirmed documents and unlabelled text.

    Terms are counted over the confirmed sample (at most about ``confirmed_rows`` labelled
    ids) and over all documents of the fold; at most about ``unlabelled_rows`` of these are
    fitted.  An id that several rows share gives one row to the fit, that of its least text.
    """
    toxic = train_labels(labels, label, 1 << 62, seed).where("y = 1").select("doc_id")
    picked = bounded_sample(toxic, "doc_id", confirmed_rows, seed)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    fold = texts.where(train_fold(F.col("doc_id")))

    def one_each(rows: DataFrame, known: int) -> DataFrame:
        return (rows.groupBy("doc_id").agg(F.min("text").alias("text"))
                .select("*", F.lit(known).alias("known"), F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id"), F.lit(2)).cast("int").alias("half")))

    # the picked ids are bounded by the parameter above
    confirmed = one_each(texts.join(F.broadcast(picked), "doc_id"), 1)
    unlabelled = one_each(bounded_sample(fold, "doc_id", unlabelled_rows, seed + 1), 0)
    sample = materialize(confirmed.unionByName(unlabelled))
    n_p, n_u = sample.where("known = 1").count(), fold.count()
    if not n_p or not n_u:
        return Linear({}, np.zeros(0), float(np.log(0.005 / 0.995)))
    counted = materialize(_term_counts(sample.unionByName(fold.select("*", F.lit(0).alias("known"), F.lit(-1).alias("half")))
                                       .where("known = 1 or half < 0")).where("first + second > 0"))
    sizes = {r["half"]: r["n"] for r in sample.where("known = 1").groupBy("half").agg(F.count("*").alias("n")).collect()}
    n_of = [sizes.get(0, 0), sizes.get(1, 0)]
    whole, *halves = [_apart(counted, c, n, n_u, n_terms) for c, n in
                      ((F.col("first") + F.col("second"), n_p), (F.col("first"), n_of[0]), (F.col("second"), n_of[1]))]
    vocabulary = {t: i for i, t in enumerate(sorted({t for part in (whole, *halves) for t in part}))}

    @F.pandas_udf("array<int>")
    def index(text: pd.Series) -> pd.Series:
        return pd.Series([_indexed(vocabulary, t) for t in text])

    got = sample.select("doc_id", "known", "half", index("text").alias("at")).orderBy("known", "doc_id").toPandas()
    rows, known, half = got["at"].tolist(), got["known"].to_numpy(), got["half"].to_numpy()

    def weights_of(part: dict[str, float]) -> np.ndarray:
        out = np.zeros(len(vocabulary))
        out[[vocabulary[t] for t in part]] = list(part.values())
        return out

    by_half = [weights_of(part) for part in halves]
    total = np.array([by_half[1 - h][r].sum() for r, h in zip(rows, half, strict=True)])
    prior = class_prior(total[known == 1], total[known == 0])
    own = weights_of(whole)
    kept = [[i for i in r if own[i] > 0] for r in rows]
    weights, bias = nnpu_fit(kept, known, own, prior)
    vocabulary, weights = {t: i for i, t in enumerate(whole)}, weights[[vocabulary[t] for t in whole]]
    return Linear(vocabulary, weights, bias)


def score(model: Linear, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(t), dtype=float)

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with score (probability of being toxic) and predicted (score >= threshold).

    Defined cases: null and empty texts hold no term and get the score of the bias; rows
    that share an id are scored each by its own text; without confirmed documents every
    score is 0.005, the least class prior; an empty table gives no rows.  Columns named score
    or predicted are replaced.
    """
    scored = docs.withColumn("score", score(fit(docs, labels, **options), F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
