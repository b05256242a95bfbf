"""The pipeline's stages, each judged on its own input, and the query contract."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from panelcast.llm import mixing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_filter_as_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in kept.collect()}
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        after = [tuple(r) for r in out.collect()]
        assert set(after) <= before
        if name == "toxicity":
            assert {r for r in before} - set(after) == {tuple(r)[:5] for r in toxicity.classify(kept, labels).where("predicted = 1").collect()}
        if name == "quality":
            assert {r for r in before} - set(after) == {tuple(r)[:5] for r in quality.classify(kept, labels).where("predicted = 0").collect()}
        if name == "mixing":
            assert set(after) == {tuple(r)[:5] for r in mixing.sampling_plan(kept).where("sampled").collect()}
        kept = spark.createDataFrame(after, docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sorted((r.doc_id or -1) for r in out) == sorted((r.doc_id or -1) for r in kept.collect())
    assert all(len(r.ids) == 4 * r.n_tokens and np.frombuffer(r.ids, "<u4").max(initial=0) < 49408 for r in out)


def test_run_gives_the_stages_in_turn(spark):
    got = entry.queries()["pipeline"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(got) < docs.count() and len({r.doc_id for r in got}) == len(got)


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in names)
    assert {"op1_mixing", "op2_chat", "op5_jaccard_join", "op8_topk", "op9_embedding_dedup"} <= set(entry.oracle_sql())


def test_operators_match_their_sql_on_the_smallest_tables(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            frame = entry.queries()[name](spark, SF)
            res = con.execute(sql)
            columns = [c[0] for c in res.description]
            assert sorted(columns) == sorted(frame.columns)
            assert sorted(map(str, res.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in frame.collect()), name
