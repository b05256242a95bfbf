"""Jaccard join: rows that share an id but not a text."""

import pytest

import numpy as np

from panelcast.llm import jaccard_join


@pytest.mark.parametrize("sub_block", [96, 2])
def test_every_text_of_a_repeated_id_is_compared(spark, monkeypatch, sub_block):
    monkeypatch.setattr(jaccard_join, "SUB_BLOCK", sub_block)
    words = [f"w{k}" for k in range(80)]
    a, near, b = " ".join(words), " ".join(words[:79]), "quite another text of some words"
    rows = [(5, a), (5, b), (2, b), (7, near), (8, near + " end"), (9, a), (4, "alone in the world"), (7, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.components(df).collect()}
    assert got == {(2, 2), (5, 2), (7, 2), (8, 2), (9, 2), (4, 4)}
    kept = sorted(tuple(r) for r in jaccard_join.one_of_each(df).collect())
    assert kept == [(2, b), (4, "alone in the world")]


def test_codes_open_every_set_that_links():
    """Codes never miss a link: whatever ``connect`` finds across parts, ``may_link`` opens."""
    import zstandard
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 300), dtype=np.uint64)) for _ in range(12)]
    sets, parts = [], []
    for k in range(150):
        own = base[k % 12]
        keep = own[rng.random(len(own)) > rng.choice([0.0, 0.05, 0.15, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, 3, dtype=np.uint64)])))
        parts.append(k if k % 5 else k % 12)
    names, parts, sizes = np.arange(150), np.array(parts), np.array([len(s) for s in sets])
    squeeze, expand = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    codes = [jaccard_join.unpack_codes(jaccard_join.pack_codes(s, squeeze), expand) for s in sets]
    assert all((np.sort((s & np.uint64(0xFFFF)).astype(np.uint16)) == c).all() for s, c in zip(sets, codes, strict=True))
    for side in (None, names // 12 % 2):
        opened = jaccard_join.may_link(sizes, codes, parts, 80, 100, side)
        links = [(i, j) for i in range(150) for j in range(i) if parts[i] != parts[j] and (side is None or side[i] != side[j])
                 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert links and all(opened[i] and opened[j] for i, j in links)
        assert opened.sum() < 150
