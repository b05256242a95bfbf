"""Manifest proofs, repeated windows and ball codes against plain forms of them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelcast.llm import ball_codes, merkle, spread, substring_dedup


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- op11

def slow_leaf(row, text):
    parts = [row[0], row[3], row[2], row[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def slow_tree(nodes):
    """All levels, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def slow_way(levels, at):
    """(siblings left, siblings right) of each level."""
    out = []
    for level in levels[:-1]:
        run, k = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
        out.append((run[:k], run[k + 1:]))
        at //= 16
    return out


def slow_audit(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r, r[1])))
        trees[name] = slow_tree([slow_leaf(r, r[1]) for r in own])
    top = slow_tree([trees[n][-1][0] for n in names])
    out = []
    for s, name in enumerate(names):
        for k, r in enumerate(groups[name]):
            way = slow_way(trees[name], k) + slow_way(top, s)
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            node = slow_leaf(r, text)
            for left, right in way:
                node = sha("".join(left) + node + "".join(right))
            out.append((r[0], trees[name][0][k], trees[name][-1][0], top[-1][0],
                        sha("".join("".join(a + b) for a, b in way)), node, node == top[-1][0]))
    return out


DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def some_documents():
    rows = [(k, f"Text {k} É", "en", f"s{k % 3}", k, "x", 1) for k in range(900)]
    rows += [(1000 + k, "HOT " * (k % 5), None, "hot", None, None, 0) for k in range(1100)]
    rows += [(7, "Same", "en", "twice", 4, None, 1)] * 40 + [(7, "Other", "en", "twice", 5, None, 1)]
    rows += [(None, "No id", "en", None, 5, None, 2), (None, None, None, None, None, None, 2), (5, None, None, "", 0, None, 3)]
    rows += [(-3, "A" * 300_000, "de", "é", 1, "y", 1)]
    return rows


def key(row):
    return tuple((v is not None, v) for v in row)


def test_audit_matches_the_plain_form(spark):
    rows = some_documents()
    got = merkle.audit(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow_audit(rows), key=key)
    assert 0 < sum(not r.verified for r in got) < len(got) / 4


@pytest.mark.parametrize("rows", [[(4, "Only", "en", "a", 1, None, 1)], [(4, "A", "en", "a", 1, None, 1), (5, "B", "en", "b", 1, None, 1)],
                                  [(k, "A", "en", None, 1, None, 1) for k in range(17)]])
def test_small_manifests(spark, rows):
    got = merkle.audit(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow_audit(rows), key=key)


def test_empty_manifest(spark):
    out = merkle.audit(spark.createDataFrame([], DOC))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_some_requests_only(spark):
    rows = some_documents()
    df = spark.createDataFrame(rows, DOC)
    leaves = df.select("doc_id", "source", merkle.document_leaf().alias("l"))
    made = merkle.manifest(leaves, leaves["source"], "doc_id", "l", keep=["doc_id"])
    some = made.leaves.where("doc_id in (1000, 1777, 7) and rank % 2 = 0").select("doc_id", "tree", "rank", "leaf")
    out = merkle.prove(made, some).select("doc_id", "digest", "leaf", merkle.fold(some["leaf"], merkle.F.col("path")).alias("f")).collect()
    assert len(out) == some.count() > 2
    assert all(r.digest == r.leaf and r.f == made.root for r in out)


# ---------------------------------------------------------------- op12

def slow_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def repeated_texts(rng, window):
    """Texts with passages that share beginnings, ends and middles, with few different words."""
    pool = [f"w{k}" for k in range(6)] + ["É", "x y", "\x1c"]
    passages = [[str(w) for w in rng.choice(pool, rng.integers(window, 4 * window))] for _ in range(8)]
    texts = []
    for k in range(120):
        parts = []
        for _ in range(rng.integers(1, 5)):
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, len(p) // 2)
            parts += p[a:a + rng.integers(3, max(4, len(p)))] + [f"own{k}-{rng.integers(9)}" for _ in range(rng.integers(0, 3))]
        texts.append(("\n" if k % 2 else " ").join(parts))
    texts += ["a " * 200, "a b " * 100, "a " * 34 + "b", None, "", "  \t ", " ".join(map(str, range(500))), "A", texts[0], texts[0].upper()]
    return texts


@pytest.mark.parametrize("window, anchor", [(35, 10), (6, 3), (4, 4), (3, 1)])
def test_repeated_windows_match_brute_force(spark, window, anchor):
    texts = repeated_texts(np.random.default_rng(window), window)
    df = spark.createDataFrame([(k // 2 if k % 7 else None, t, "kept", 1) for k, t in enumerate(texts)], "doc_id long, text string, kept string, start int")
    got = substring_dedup.remove_repeats(df.repartition(5), window=window, anchor=anchor).collect()
    want = slow_repeats(texts, window)
    assert Counter((r.n_words, r.n_removed, r.kept) for r in got) == Counter(want)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)
    assert substring_dedup.remove_repeats(df.limit(0), window=window, anchor=anchor).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    data = (" ".join(f"word{k % 97}" for k in range(5000)) + "  \n tail").encode()
    whole, starts = substring_dedup.word_hashes(data)
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 64)
    pieces, at = substring_dedup.word_hashes(data)
    assert (whole == pieces).all() and (starts == at).all() and len(whole) == 5001
    assert substring_dedup.word_hashes(b"x" * 1000)[0].shape == (1,)


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST_HOT", 10)
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 1), (3, 1)], "k int, v int")
    table = spark.createDataFrame([(1, 50, "hot"), (2, 1, "cold")], "k int, n int, name string")
    got = spread.spread_join(rows, table, ["k"], "n", 52).collect()
    assert Counter((r.k, r.name) for r in got) == {(1, "hot"): 50, (2, "cold"): 1}


# ---------------------------------------------------------------- op13

def slow_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, np.floor(4096 * np.array(v, dtype=float)).astype(np.int64).reshape(parts, -1)) for i, lab, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    book = np.stack([v for _, _, v in kept[:entries]], axis=1)
    x = np.stack([v for _, _, v in kept])

    def nearest():
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    book[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code, d = nearest()
    by = defaultdict(int)
    for (_, lab, _), e in zip(kept, d.sum(axis=1)):
        by[lab] += int(e)
    digest = hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in own), int(e), by[lab], digest) for (i, lab, _), own, e in zip(kept, code, d.sum(axis=1)))


VEC = "vec_id long, label int, embedding array<double>, code string, error int"


def some_vectors(n, width, rng, copies=20):
    centres = rng.normal(size=(6, width))
    rows = [(k * 3, int(k % 4) if k % 9 else None, (centres[k % 6] + rng.normal(scale=0.05, size=width)).tolist()) for k in range(n)]
    rows += [(10_000 + k, 1, [0.25] * width) for k in range(copies)]
    return rows


def test_codes_match_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = some_vectors(400, 32, rng)
    odd = [(2, 1, None), (4, 1, [None] * 32), (5, 1, [float("nan")] * 32), (7, 1, [float("inf")] + [0.0] * 31)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], VEC).repartition(4)
    got = sorted(tuple(r) for r in ball_codes.codes(df).collect())
    assert got == slow_codes(rows)


def test_codes_of_few_equal_and_no_vectors(spark):
    rows = [(k, None, [float(k // 2)] * 8) for k in range(5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VEC)
    assert sorted(tuple(r) for r in ball_codes.codes(df).collect()) == slow_codes(rows)
    assert ball_codes.codes(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        ball_codes.codes(spark.createDataFrame([(1, 1, [1.0] * 8, "x", 1), (2, 1, [1.0] * 16, "x", 1)], VEC)).collect()
    with pytest.raises(ValueError):
        ball_codes.codes(spark.createDataFrame([(1, 1, [1.0] * 7, "x", 1)], VEC)).collect()


def test_rings_and_still_balls_change_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, size=(500, 2, 3))
    x[:50] = x[0]
    balls = ball_codes.Balls(x[:8].transpose(1, 0, 2).copy(), ball_codes._unbounded((2, 8)), np.zeros((2, 8), bool))
    codes = np.zeros((500, 2), np.uint8)
    radii = np.zeros((2, 8), np.int64)
    skipped = 0
    for _ in range(30):
        far = np.zeros((2, 8), np.int64)
        codes = ball_codes.assign(x, codes, balls, far)
        d = ((x[:, :, None, :] - balls.book[None]) ** 2).sum(axis=3)
        assert (codes == d.argmin(axis=2)).all()
        counts = np.stack([np.bincount(codes[:, p], minlength=8) for p in range(2)])
        sums = np.stack([[x[codes[:, p] == e, p].sum(axis=0) for e in range(8)] for p in range(2)])
        radii = np.maximum(far, np.where(balls.still, radii, 0))
        assert all(d[codes[:, p] == e, p, e].max(initial=0) <= radii[p, e] for p in range(2) for e in range(8))
        balls = ball_codes._moved(balls, counts, sums, radii)
        skipped += balls.still.sum()
    assert skipped
