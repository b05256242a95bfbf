"""Jaccard join, BPE word table, chat formatting against brute force."""

import hashlib
import re

import numpy as np
import pytest

from panelcast.llm import bpe_table, chat, jaccard_join, queries, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def slow_set(text, words):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def slow_components(rows, words, num, den):
    sets = [(i, slow_set(t, words)) for i, t in rows]
    low = {i: i for i, _ in rows}
    moved = True
    links = [(i, j) for a, (i, s) in enumerate(sets) for j, t in sets[a + 1:]
             if s and t and den * len(s & t) >= num * len(s | t)]
    while moved:
        moved = False
        for i, j in links:
            m = min(low[i], low[j])
            moved |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return {i: (len(s), low[i]) for i, s in sets}, len(links)


def corpus(seed, n_base=12, copies=14):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "naïve", "日本", "x'y", "A", "B C"]
    out = []
    shared = " ".join(rng.choice(vocabulary, 60))
    for _ in range(n_base):
        size = int(rng.choice([1, 2, 3, 5, 9, 12, 20, 30, 60, 150, 400]))
        base = [str(w) for w in rng.choice(vocabulary, size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 30 + 2)))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocabulary))
            if rng.random() < 0.2:
                w = w + [str(rng.choice(vocabulary))]
            sep = str(rng.choice([" ", "\n", "\t ", " \x0b"]))
            text = sep.join(w)
            out.append(text.upper().replace("É", "é") if rng.random() < 0.1 and text.isascii() else text)
            if rng.random() < 0.1:
                out.append(" ".join(w) + " " + shared)
    return [(int(i), t) for i, t in enumerate(out)]


def test_shingle_hashes_stand_for_shingles():
    import pyarrow as pa
    texts = [t for _, t in corpus(9)] + [None, "", " \n", "one", "one two", " wide", "a" * 9000 + " b c d", "a b c" * 3]
    for words in (3, 5):
        seen = {}
        for text, got in zip(texts, shingles.shingle_sets(pa.array(texts), words), strict=True):
            want = slow_set(text, words)
            assert len(got) == len(want) and (np.diff(got.astype(float)) > 0).all()
            key = frozenset(got.tolist())
            assert seen.setdefault(key, want) == want
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2), (1, 1)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(num)
    bands = jaccard_join.Bands(num, den)
    hit = 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 4, 8, 9, 10, 11, 19, 20, 23, 24, 25, 30, 60, 200, 900]))
        pool = shingles.mixed(rng.integers(0, 1 << 62, 2 * n + 10).astype(np.uint64))
        a = np.unique(pool[:n])
        drop = int(rng.integers(0, max(1, n // 5) + 1))
        add = int(rng.integers(0, max(1, n // 5) + 1))
        b = np.unique(np.concatenate([pool[drop:n], pool[n:n + add]]))
        if not len(b):
            continue
        inter = len(np.intersect1d(a, b))
        if den * inter >= num * (len(a) + len(b) - inter):
            hit += 1
            assert np.intersect1d(jaccard_join.signatures(a, bands), jaccard_join.signatures(b, bands)).size
    assert hit > 100


@pytest.mark.parametrize("words,num,den,sub_block", [(3, 90, 100, 96), (3, 90, 100, 5), (5, 80, 100, 7)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, words, num, den, sub_block):
    monkeypatch.setattr(jaccard_join, "SUB_BLOCK", sub_block)
    rows = corpus(sub_block) + [(9000, None), (9001, ""), (9002, "  \n"), (9003, "Hello"), (9004, "hello"), (9005, "a b"), (-4, "A\tb")]
    want, links = slow_components(rows, words, num, den)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df, words, num, den).collect()}
    assert links > 30 and got == want
    left = {r.doc_id for r in jaccard_join.one_of_each(df, words=words, num=num, den=den).collect()}
    assert left == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "q r s t"), (2, "q r s t"), (None, "a b c d"), (3, "z")],
                               "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, (r.component_id or 0)) for r in jaccard_join.components(df).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3)]
    assert jaccard_join.components(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in jaccard_join.one_of_each(df).collect()) == [0, 1, 3]


HOSTILE = [None, "", " ", "Hello  WORLD's don't I'LL <|endoftext|> x<|startoftext|>", "½ ² ﬁ İstanbul ΣΑΣ straße ǅ ŉ",
           "é ̧́ a b c​d \x85 \x1c \x0b \x0c \x00", "日本語 русский עברית 👩‍👩‍👧 1234 ٣٤", "''s 'S !!'s '’s a'b",
           "<|endoftext|><|endoftext|>", "<|end", "long " + "word" * 3000, "K Å ſ", "\n\n\t", "x" * 20]


@pytest.mark.parametrize("hot_words", [500_000, 5, 0])
def test_bpe_ids_equal_the_library(spark, hot_words):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = HOSTILE + [t for _, t in corpus(3, 4, 4)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, "other text", "y"), (2, "other text", "y"), (None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, bytes(r.ids), r.decoded)
                 for r in bpe_table.encode(df, path, hot_words=hot_words).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe_table.encode(df.limit(0), path).count() == 0


def test_bpe_words_over_all_characters():
    from tokenizers import Tokenizer
    spec = bpe_table.read_spec(queries.tokenizer_path())
    words, library = bpe_table.Words(spec), Tokenizer.from_str(spec)
    rng = np.random.default_rng(8)
    plain = bpe_table._plain_characters()
    for alphabet in (plain, plain + "'́Σİ日 ‍<|"):
        for _ in range(300):
            text = "".join(rng.choice(list(alphabet), 40)) + "'s don't <|endoftext|>"
            ids = b"".join(words.encode(words.cut(text)))
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_chat_is_read_back_unchanged(spark):
    rows = [(1, 0, "system", "be # nice: <ok>"), (1, 1, "user", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "a\n### b: c</turn>\n"),
            (1, 3, "assistant", None), (2, 1, "assistant", "x" * 5000 + "\\"), (2, 0, "user:", "\\\\:"), (3, 0, None, ""),
            (3, None, "user", "no turn"), (3, 0, None, ""), (None, 0, "user", "lost"), (4, 0, "assistant", "é👩‍👩‍👧日")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df.withColumn("message", df.turn))
    got = {r.conv_id: r.formatted for r in formatted.collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1]))
        assert [(role, text) for role, text, _, _ in chat.parse(got[conv])] == [(r[2] or "", r[3] or "") for r in own]
    read = {r.conv_id: r for r in chat.digests(formatted).collect()}
    learnt = "a\n### b: c</turn>\n"
    assert (read[1].loss_chars, read[1].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert read[4].loss_chars == len("é👩‍👩‍👧日") and read[1].n_turns == 4 and read[1].formatted_chars == len(got[1])
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("### user: open")


def test_events_fold_to_the_last_state(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 3)
    e = [(1, 0, 0, "open", "user", None), (1, 0, 1, "delta", None, "Hel"), (1, 0, 2, "delta", None, "lo"),
         (1, 1, 0, "open", "assistant", ""), (1, 1, 1, "delta", None, "wrong"), (1, 1, 2, "regenerate", None, None),
         (1, 1, 3, "delta", None, "ri"), (1, 1, 9, "delta", None, "ght"), (1, 2, 0, "open", "user", "first"),
         (1, 2, 1, "edit", None, "second"), (1, 2, 2, None, None, "!"), (2, 0, 4, "delta", "user", "only"), (1, 1, 12, "delta", None, "")]
    df = spark.createDataFrame(e[::-1], "conv_id long, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "right"), (1, 2): ("user", "second!"), (2, 0): ("user", "only")}
    text = {r.conv_id: r.formatted for r in chat.render(chat.fold_events(df)).collect()}
    assert text[1] == "### user: Hello</turn>\n### assistant: right</turn>\n### user: second!</turn>\n"


def slow_fold(events):
    """Plain replay: order events, start anew where the kind says so."""
    out = {}
    for conv, message in {(e[0], e[1]) for e in events}:
        own = [(-1 if e[2] is None else e[2], e[3] or "delta", e[4], e[5] or "") for e in events if (e[0], e[1]) == (conv, message)]
        text = ""
        for _, kind, _, piece in sorted(own, key=lambda e: (e[0], e[1] == "delta", e[1], e[3])):
            text = text + piece if kind == "delta" else piece
        roles = sorted((e[0], e[2]) for e in own if e[2] is not None)
        out[conv, message] = (roles[0][1] if roles else "", text)
    return out


def test_events_of_null_and_tied_sequence(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 4)
    rng = np.random.default_rng(8)
    kinds = ["delta"] * 5 + [None, "edit", "regenerate", "open"]
    events = [(c, int(rng.integers(3)), None if rng.random() < 0.15 else int(rng.integers(6)), kinds[int(rng.integers(9))],
               [None, "user", "assistant"][int(rng.integers(3))], [None, "", "a", "b", "c"][int(rng.integers(5))])
              for c in [None, *range(30)] for _ in range(int(rng.integers(1, 16)))]
    events += [(90, 0, 1, "edit", "user", "E1"), (90, 0, 1, "edit", "user", "E2"), (90, 0, 1, "edit", "user", "E2"),
               (91, 0, None, "delta", "user", "lost"), (91, 0, 0, "open", "user", ""), (92, 0, None, "edit", "user", "kept"),
               (92, 0, None, "delta", None, "!"), (92, 0, 3, "delta", None, "?"), (92, 0, 3, "delta", None, "?")]
    df = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == slow_fold(events)
    assert (got[90, 0][1], got[91, 0][1], got[92, 0][1]) == ("E2", "", "kept!??")


def test_log_of_finished_turns_holds_edits_and_regenerations(spark):
    rows = [(i // 4, i % 4, "user", f"turn {i} " + "x" * (i * 37 % 900)) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.events_of(df)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate"}
    got = {(r.conv_id, r.message.turn): r.text for r in chat.fold_events(log).collect()}
    assert got == {(c, t): text for c, t, _, text in rows}
