"""Report tables have a row per pipeline or activity, so none is broadcast."""

import contextlib
import io

from metasift.operators import activities as ac
from metasift.plans.activities import report_row

ACTIVITIES = ('[{"name":"Load","type":"Copy","dependsOn":[{"activity":"Fetch"}],"typeProperties":{"source":{"datasetSettings":{"type":"LakehouseTable","path":"raw/a"}},"sink":{"type":"AzureSqlTable","table":"t"}}},'
              '{"name":"Fetch","type":"WebActivity","typeProperties":{"url":"https://h/x"}}]')


def plan(df):
    with contextlib.redirect_stdout(text := io.StringIO()):
        df.explain()
    return text.getvalue()


def reports(spark):
    rows = [(k, "{}", '{"output":"lake"}' if k == 1 else "{}", f'{{"type":"adf_pipeline","name":"p{k % 2}","activities":{ACTIVITIES if k else "[]"}}}') for k in range(4)]
    p = ac.adf_definitions(spark.createDataFrame(rows, "payload_id long, metadata string, config string, raw_json string"))
    return p, ac.analyze_activities(p, ac.activities_of(p, "definition", "$.activities"))


def test_reports_are_joined_by_shuffle(spark):
    p, r = reports(spark)
    out = report_row(r)
    acts = ac.activities_of(p, "definition", "$.activities").withColumn("pos", ac.F.col("idx"))
    edges = ac.dependency_edges(acts)
    flagged = ac.terminal_and_roots(acts, edges)
    frames = [out, r["nodes"], r["edges"], edges, flagged, ac.destinations(flagged), ac.detect_trigger(p), ac.ingestion_details(acts, p), ac.loading_flow(acts, r["candidates"], r["destinations"])]
    assert [k for k, df in enumerate(frames) if "Broadcast" in plan(df)] == []
    got = {x.pipeline_id: (x.source_type, x.destination, x.nodes, x.edges) for x in out.collect()}
    assert got == {0: (None, None, 1, None), 1: ("Mixed", "lake", 4, 2), 2: ("Mixed", "t", 4, 2), 3: ("Mixed", "t", 4, 2)}


def test_alike_reports_are_found_without_broadcasts(spark):
    _, r = reports(spark)
    alike = ac.structural_dedup(r["nodes"], r["edges"], r["text"], ac.P)
    assert "Broadcast" not in plan(alike)
    assert sorted((x.pipeline_id, x.copies) for x in alike.collect()) == [(0, 1), (1, 1), (2, 2)]
