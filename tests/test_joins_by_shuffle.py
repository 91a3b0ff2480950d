"""Sides with a row per document are never broadcast; document tables are spread by rows; graph documents come up from blocks."""

import contextlib
import io
import json
import math

import pytest

from metasift.operators import configs as cf
from metasift.operators import jobspecs as js
from metasift.operators import jsonwalk as jw
from metasift.operators import lineage as ln
from metasift.plans import catalog


def plan(df):
    with contextlib.redirect_stdout(text := io.StringIO()):
        df.explain()
    return text.getvalue()


DOCS = [(1, '{"a":{"b":1,"c":[{"d":2}]},"e":"x"}'), (None, '{"a":1}'), (2, '{"f":null}'), (2, '{"f":3}')]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "config_id long, doc string")


def test_job_layers(spark):
    source = spark.createDataFrame([(i, "postgres", {"pg_host": "h"}, []) for i in ("j1", "j2", "j2")], "job_id string, source_type string, fields map<string,string>, errors array<string>")
    layers = spark.createDataFrame([("j1",), ("j2",), (None,)], "job_id string")
    runtime = js.merge_layers(source, layers, layers, "2024-01-01T00:00:00")
    assert "Broadcast" not in plan(runtime)
    assert sorted(r["job_id"] for r in runtime.collect()) == ["j1", "j2", "j2"]
    assert "Broadcast" not in plan(js.job_parameters(runtime))


def test_diff_tree(spark):
    tree = cf.diff_tree(docs(spark), docs(spark, DOCS[:1]), "doc")
    assert "Broadcast" not in plan(tree) and "Broadcast" not in plan(cf.tree_summary(tree))


def test_merges(spark):
    example, core = (cf.leaves(docs(spark, [(1, d)]), "doc") for d in ('{"title":"t","sink_configuration":{"storage":""}}', '{"ingestion_configs":{"destination":"x"}}'))
    done = cf.compose_final(example, core)
    assert "Broadcast" not in plan(done)
    got = {r["path"]: r["value"] for r in done.collect()}
    assert got["sink_configuration.storage"] == '"x"' and got["title"] == '"t"'
    updates = core.select("config_id", "path", "value", "kind")
    assert "Broadcast" not in plan(jw.set_by_path(example, ["config_id"], updates))


def test_final_state(spark):
    row = (1, "", "batch", '{"ingestion_configs":{"destination":"a"},"flow":{"text":"x -> a"}}', '{"ingestion_configs":{"destination":"b"}}', '{"ingestion_configs":{"mode":"batch"}}')
    done, _ = cf.finalize(spark.createDataFrame([row], "config_id long, raw_text string, ingestion_type string, raw string, extracted string, example string"))
    assert "Broadcast" not in plan(done) and done.count() == 1


@pytest.mark.parametrize("name", ["fx_merge", "fx_config", "fx_fabric"])
def test_tasks_follow_rows(spark, sf, monkeypatch, name):
    monkeypatch.setattr(catalog, "TASK_ROWS", 10)
    rows = catalog.table(spark, sf, catalog.DOCUMENTS[name]).count()
    assert catalog.fixture(spark, sf, name).rdd.getNumPartitions() >= math.ceil(rows / 10)
    assert spark.table(catalog.DOCUMENTS[name]).rdd.getNumPartitions() < math.ceil(rows / 10)


def test_graph_documents_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ln, "BLOCK", 2)
    rows = [("g", f"s{n}", None if n == 3 else "t", "k", None if n == 4 else n) for n in (5, 2, 4, 1, 3, 2)] + [(None, "s", "t", "k", 1)]
    got = dict(ln.graph_documents(spark.createDataFrame(rows, "g string, source_urn string, target_urn string, edge_type string, seq long"), "g", "seq").collect())
    edge = lambda n: {"source_urn": f"s{n}", "target_urn": "t", "edge_type": "k"}
    want = [edge(4), edge(1), edge(2), edge(2), {"source_urn": "s3", "edge_type": "k"}, edge(5)]
    assert json.loads(got["g"])["edges"] == want and json.loads(got[None])["edges"] == [{"source_urn": "s", "target_urn": "t", "edge_type": "k"}]
