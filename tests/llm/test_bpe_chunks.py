"""BPE chunks: texts are cut once, whatever the chunks and batches are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import bpe_table, queries


def texts(n):
    rng = np.random.default_rng(4)
    pool = [f"w{k}" for k in range(40)] + ["don't", "É", "日本", "<|endoftext|>"]
    return [None, "", " "] + [" ".join(rng.choice(pool, rng.integers(0, 30))) + f" own{k}" for k in range(n)]


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = list(enumerate(texts(40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", seen.asNondeterministic()("text").alias("text"))
    assert len(bpe_table.encode(docs, queries.tokenizer_path(), hot_words=20).collect()) == len(rows)
    assert read.value == len(rows)


@pytest.mark.parametrize("hot_words", [0, 20, 400_000])
@pytest.mark.parametrize("held, words, batch, asked", [(1, 1, 1, 1), (30, 10_000, 40, 7), (10_000, 100, 10_000, 10_000)])
def test_chunks_of_any_size_give_the_librarys_ids(spark, monkeypatch, hot_words, held, words, batch, asked):
    from tokenizers import Tokenizer
    for name, value in (("HELD_WORDS", held), ("CHUNK_WORDS", words), ("BATCH_WORDS", batch), ("ASKED_WORDS", asked)):
        monkeypatch.setattr(bpe_table, name, value)
    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(k // 2 if k % 9 else None, t) for k, t in enumerate(texts(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    got = bpe_table.encode(docs, queries.tokenizer_path(), hot_words=hot_words).collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in got) == sorted(want)
    assert "decoded" not in bpe_table.encode(docs, queries.tokenizer_path(), hot_words, decode=False).columns


def test_text_ids_and_null_ids_only(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, "x"), (None, None)], "doc_id string, text string")
    got = bpe_table.encode(docs, queries.tokenizer_path(), decode=False).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in got) == [("None", False), ("None", True), ("a", True)]
