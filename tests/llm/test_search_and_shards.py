"""Sharding, exact search, embedding near-duplicates and components against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelcast.llm import components, embedding_dedup, sharding, topk_search
from panelcast.llm.components import connected_components


def slow_jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def smallest(nodes, links):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_jump_shards_match_the_sequential_form():
    keys = np.array([0, 1, 2, 5, -1, -7, 10**12, 2**63 - 1], dtype=np.int64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump_shards(keys.view(np.uint64), n).tolist() == [slow_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_shards(keys.view(np.uint64), 0)


def test_shards_slots_and_edge_rows(spark):
    rows = [(i, f"text {i % 7} é", "x", 1) for i in range(300)] + [(5, "text 5 é", "x", 1)] * 40 + [(5, "other", "y", 2)]
    rows += [(None, "n", None, 0), (301, None, None, 0), (302, "", None, 0), (-9, "neg", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        key = r.doc_id or 0
        assert r.shard == slow_jump(key, 8) and r.grown_shard == slow_jump(key, 9)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    want = sorted((d if d is not None else -10**9, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -10**9, r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_documents(df.limit(0), 8).count() == 0


def test_top_k_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 6) / 4], 9) for i in range(240)]
    rows += [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1002, [float("nan")] * 6, 1),
             (1003, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (1050, [1.0, 1.0], 1), (1051, [0.5, 1.0], 1)]
    # rows are candidates of their own: copies, and other vectors of an id, a query's own too
    rows += [rows[3]] * 2 + [(4, rows[9][1], 0), (50, rows[50][1], 1), (100, rows[7][1], 2)] + [(260, rows[150][1], 0)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = topk_search.top_k(df.where("vec_id % 50 = 0"), df, k=5).collect()
    good = [(i, tuple(int(x) for x in np.floor(256 * np.array(v)))) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {r for r in good if r[0] % 50 == 0}:
        others = list(good)
        others.remove(q)
        scores = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i) for i, v in others if len(v) == len(q[1]))
        want += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert (1050, 1, 1051) in {(q, r, i) for q, r, i, _ in want}
    assert topk_search.top_k(df.limit(0), df, k=5).count() == 0
    assert topk_search.top_k(df.where("vec_id = 0"), df.limit(0), k=5).count() == 0


def test_top_k_near_and_beyond_the_range_of_scores(spark):
    big = [(i, [float(2**22 + i), float(-i)]) for i in range(8)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df.where("vec_id = 0"), df, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [
        (7, 65536 * 2**22 * (2**22 + 7)), (6, 65536 * 2**22 * (2**22 + 6))]
    for odd in ([1e7, 1e7], [1e15, 1.0], [1e300, 0.0], [-1e300, 1.0]):
        far = spark.createDataFrame([*big, (50, odd), (51, odd)], "vec_id long, embedding array<double>")
        with pytest.raises(topk_search.ScoreRangeError):
            topk_search.top_k(far.where("vec_id = 50"), far, k=2)


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk_search, "VECTOR_ROWS", 40)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df.where("vec_id % 20 = 0"), df, k=4, nodes=4).collect()
    f = np.floor(256 * x)
    for q in range(0, 200, 20):
        order = sorted((-int(f[q] @ f[i]), i) for i in range(200) if i != q)[:4]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in order]


def test_codes_estimate_without_bias_and_bound_for_certain():
    rng = np.random.default_rng(3)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((20, 32)), rng.standard_normal((30, 32))))
    b[:20] = a + 0.05 * b[:20]
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    errors = []
    for seed in range(200):
        turn = embedding_dedup.rotation(32, seed)
        assert np.allclose(turn @ turn.T, np.eye(32))
        turned, _, _ = embedding_dedup.encode(a, turn)
        _, codes, factors = embedding_dedup.encode(b, turn)
        assert (embedding_dedup.upper_bound(turned, codes, factors) >= a @ b.T - 1e-5).all()
        errors.append(embedding_dedup.estimate(turned, codes, factors) - a @ b.T)
    assert np.abs(np.mean(errors, axis=0)).max() < 0.05


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_embedding_components_match_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 16))
    x = np.concatenate([base + s * rng.standard_normal((20, 16)) for s in (0, 0.15, 0.25, 0.4)])
    rows = [(i, [float(v) for v in x[i] * (1 + i)], int(i % 20) % 3) for i in range(80)]
    extra = [(100, None, 1), (101, [0.0] * 16, 1), (102, [None] + [1.0] * 15, 1), (103, [1.0] * 16, None), (104, [1.0] * 4, 1),
             (105, [2.0] * 4, 1), (None, [1.0] * 4, 1), (106, [1e300] * 4, 2), (107, [1e-300] * 4, 2), (108, [], 1)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>, label int")
    links = []
    u = {i: np.array(v, float) / max(v, key=abs) for i, v, _ in rows}
    u |= {104: np.ones(4), 105: np.ones(4), 106: np.ones(4), 107: np.ones(4)}
    label = {i: g for i, _, g in rows + extra}
    for i in u:
        for j in u:
            if i < j and label[i] == label[j] and len(u[i]) == len(u[j]):
                c = abs(u[i] @ u[j]) / np.linalg.norm(u[i]) / np.linalg.norm(u[j]) * np.sign((u[i] @ u[j]) * (1 if i > 99 else np.sign(max(rows[i][1], key=abs)) * np.sign(max(rows[j][1], key=abs))))
                if c >= 0.93:
                    links.append((i, j))
    low = smallest([i for i, _, _ in rows + extra if i is not None], links)
    n = defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(extra)
    for i, c in low.items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], c, c == i), i
    assert len(links) > 20 and got[None].component_id is None
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("links_per_file", [200_000, 20])
def test_components_of_chains_hubs_and_loops(spark, monkeypatch, links_per_file):
    monkeypatch.setattr(components, "LINKS_PER_FILE", links_per_file)
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(200, 200)]
    links += [tuple(int(v) for v in rng.integers(300, 400, 2)) for _ in range(60)]
    want = smallest({v for e in links for v in e}, links)
    rng.shuffle(links)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in links] + [(None, 1), (7, None)], "a long, b long")
    assert {r.id: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0
