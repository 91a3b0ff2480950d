"""One source per pipeline: what its candidates say is kept, and pipelines without candidates have a row."""

import json

from metasift.operators import activities as ac

COLUMNS = "pipeline_id long, pos int, source_type string, service_name string, table string, path string, endpoint string, method string, artifact string, schema string, format string"


def test_details_of_all_candidates_in_order_and_empty_pipelines(spark):
    rows = [(1, 2, "File", "Lakehouse", None, "raw/a", None, None, None, None, "csv"), (1, 1, "API", "REST API", None, None, "https://h/x", "GET", None, None, None),
            (2, 1, "DB", "Lakehouse", "t", None, None, None, "unknown", "dbo", None), (4, 1, None, None, None, "p", None, None, None, None, None)]
    pipelines = spark.createDataFrame([(1, "w1"), (2, "w2"), (3, "w3"), (4, None), (5, None)], "pipeline_id long, workspace_id string")
    got = {r.pipeline_id: r for r in ac.merge_candidates(spark.createDataFrame(rows, COLUMNS), pipelines).collect()}
    assert {k: (r.source_type, r.service_name, r.sources) for k, r in got.items()} == {
        1: ("Mixed", "Mixed", 2), 2: ("DB", "Lakehouse", 1), 3: (None, None, 0), 4: (None, None, 1), 5: (None, None, 0)}
    assert {k: json.loads(r.connection_details) for k, r in got.items()} == {
        1: {"sources": [{"workspaceId": "w1", "endpoint": "https://h/x", "method": "GET"}, {"workspaceId": "w1", "path": "raw/a", "format": "csv"}], "workspaceId": "w1", "workspace": "w1"},
        2: {"workspaceId": "w2", "schema": "dbo", "table": "t", "workspace": "w2"}, 3: {"workspaceId": "w3", "workspace": "w3"}, 4: {"path": "p"}, 5: {}}


def test_pipelines_keep_their_rows(spark):
    rows = [(1, 1, "File", "File", None, "a", None, None, None, None, None)]
    pipelines = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "pipeline_id long, name string")
    got = sorted(((r.name, r.source_type, r.connection_details) for r in ac.merge_candidates(spark.createDataFrame(rows, COLUMNS), pipelines).collect()))
    assert got == [("x", "File", '{"path":"a"}'), ("y", "File", '{"path":"a"}'), ("z", None, "{}")]
