"""Registered queries against their oracles, and the pipeline against its stages' plain versions."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from metasift.llm.queries import ORACLES, QUERIES
from tests.harness import compare
from tests.llm.test_groups import bags, groups_of
from tests.llm.test_texts import plain_contamination

RUNS = {"op1_lm_score": "documents", "op2_secret_scan": "documents", "op4_pii": "documents", "op6_quality": "documents", "op7_main_text": "pages", "op9_minhash_dedup": "documents", "op11_fill_in_middle": "documents", "op12_cross_tokenizer": "documents", "op13_host_rules": "documents"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf, key):
    assert compare(spark, con, SimpleNamespace(key=key, run=QUERIES[key], oracle=ORACLES[key]), sf) is None


@pytest.mark.parametrize("key", sorted(RUNS))
def test_query_gives_a_row_for_each_input_row(spark, sf, key):
    assert QUERIES[key](spark, sf).count() == spark.read.parquet(f"{sf}/{RUNS[key]}.parquet").count()


def test_entry_registers_every_operator():
    keys = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in keys} and "pipeline" in keys
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_stages_do_what_their_plain_versions_do(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns
            rows = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in before}
            good = [k for k, r in labels.items() if r.quality == 1 and not r.toxic]
            assert sum(k in rows for k in good) >= 0.97 * len(good)
            assert sum(k in rows for k, r in labels.items() if r.quality == 0) <= 0.05 * len(labels)
        elif name == "near_duplicates":
            ids = sorted(before)
            groups = groups_of([before[k].text for k in ids])
            assert sorted(rows) == [k for j, k in enumerate(ids) if groups[j] == j]
        elif name == "decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            for k, r in before.items():
                n, hit, _ = plain_contamination(r.text, items)
                assert (k in rows) == (hit == 0 or 20 * hit < n)
        elif name == "pii":
            assert sorted(rows) == sorted(before)
            for k, r in rows.items():
                assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)
                if "[" not in r.text:
                    assert r.text == before[k].text and r.n_chars == before[k].n_chars
        else:
            got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
            assert sorted(r.doc_id for r in got) == sorted(before) and all(r.n == r.t for r in got)
            return
        docs = spark.createDataFrame(list(rows.values()), docs.schema)


def test_pipeline_runs_whole(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_of_odd_documents(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "An ordinary sentence about nothing much, said twice for good measure.", "en", "s", 71)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() == (1 if data else 0)


def test_queries_and_stages_take_clashing_columns(spark, sf, tmp_path):
    clash = ["n_words", "contamination", "secrets", "pii", "near", "judged", "row", "sign", "more", "added", "spans", "plain", "main_text", "host", "wrapper", "hits", "items", "keys", "score", "held_out", "text_", "part", "middle", "aligned", "rated", "rules", "verdict", "host_bad", "same"]
    for name in ("documents", "pages", "embeddings", "benchmark", "labels"):
        df = spark.read.parquet(f"{sf}/{name}.parquet").limit(60)
        df.withColumns({c: F.lit(None).cast("string") for c in clash if c not in df.columns}).write.parquet(f"{tmp_path}/{name}.parquet")
    for key, run in QUERIES.items():
        least = 50 if key in ("op7_main_text", "op10_warc") else 60  # the rows that the smallest tables have
        assert run(spark, str(tmp_path)).count() >= least, key
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_bags_are_multisets():
    assert bags("a b c d e a b c d e a b c d e")[("a", "b", "c", "d", "e")] == 3
