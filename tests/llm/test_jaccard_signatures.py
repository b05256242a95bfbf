"""Jaccard join: sets meet only when they share as many signatures as linked sets do."""

import numpy as np
import pytest

from panelcast.llm import jaccard_join, shingles


def linked_components(rows, words, num, den):
    sets = []
    for i, text in rows:
        w = text.split()
        sets.append((i, {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))}))
    low = {i: i for i, _ in rows}
    links = [(i, j) for k, (i, s) in enumerate(sets) for j, t in sets[k + 1:] if den * len(s & t) >= num * len(s | t)]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            m = min(low[i], low[j])
            moved |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return low


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_share_the_signatures_they_need(num, den):
    rng = np.random.default_rng(num)
    bands = jaccard_join.Bands(num, den)
    hit, more = 0, 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 5, 9, 20, 23, 24, 25, 30, 45, 60, 120, 200, 900]))
        pool = shingles.mixed(rng.integers(0, 1 << 62, 2 * n + 10).astype(np.uint64))
        drop, add = (int(x) for x in rng.integers(0, n // 4 + 2, 2))
        a, b = np.unique(pool[:n]), np.unique(pool[drop:n + add])
        if not len(b) or den * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
            continue
        hit += 1
        shared = np.intersect1d(jaccard_join.signatures(a, bands), jaccard_join.signatures(b, bands))
        odd = bands.of(min(len(a), len(b))) & 1
        need = max(jaccard_join.needed(a, bands)[odd], jaccard_join.needed(b, bands)[odd])
        assert (shared & np.uint64(1) == odd).sum() >= need
        more += need > 1
    assert hit > 100 and (more > 50 or num < 80)
    assert jaccard_join.needed(np.empty(0, np.uint64), bands) == (1, 1)


@pytest.mark.parametrize("few", [1, 100])
def test_groups_of_any_size_give_the_same_components(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "SUB_BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "HELD", 900)
    rng = np.random.default_rng(few)
    line, rows = [f"c{k}" for k in range(15)], []
    for _ in range(9):
        base = [f"w{k}" for k in rng.integers(0, 5000, int(rng.choice([8, 25, 40, 90, 200])))]
        for _ in range(int(rng.choice([1, 2, 5, 12]))):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = "x"
            rows.append((len(rows) * 7 % 1009, " ".join((line if rng.random() < 0.5 else []) + w)))
    rows += [(i + 2000, text) for i, text in rows[:9]]
    got = {r.doc_id: r.component_id for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()}
    assert got == linked_components(rows, 3, 80, 100) and len(set(got.values())) < len(rows) - 9


def test_texts_that_share_only_a_common_line_are_not_compared(spark, monkeypatch):
    """Signatures of a common line put such texts into one large block, whose cells grow with the
    square of the texts; few of them may be tokenised again, besides the 20 that are near copies."""
    rng = np.random.default_rng(5)
    line, rows = [f"c{k}" for k in range(14)], []
    for i in range(400):
        w = [f"w{k}" for k in rng.integers(0, 10 ** 6, 90)]
        rows.append((i, " ".join(line + w)))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join(line + w[:88])))
    written, write = [], jaccard_join.materialize

    def noted(df, *folder):
        out = write(df, *folder)
        if {"tokens", "codes"} & set(out.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(df, 5, 80, 100).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert written and max(written) <= 60
