"""BPE word table: rows of a hot id."""

import numpy as np

from panelcast.llm import bpe_table, queries


def test_rows_of_a_hot_id_keep_groups_of_their_own(spark):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = [(None if k % 2 else 7, f"rare{k}word zebra{k} common") for k in range(60)] + [(7, "rare0word zebra0 common"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bpe_table.keyed(df).select("key").distinct().count() == len(set(rows))
    got = sorted((str(r.doc_id), bytes(r.ids)) for r in bpe_table.encode(df, path, hot_words=0).collect())
    want = [(str(i), np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in rows]
    assert got == sorted(want)
