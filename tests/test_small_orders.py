"""Pipelines of bounded size are ordered in one row as by joins; keys are sought without walking documents whole."""

import json
import random

from pyspark.sql import functions as F

from metasift.operators import activities as ac
from metasift.operators import jsonwalk as jw
from metasift.operators import ordering

SCHEMA = "pipeline_id long, idx int, name string, type string, deps array<string>, src string, sink string, url string, method string"


def rows():
    rng, out = random.Random(5), []
    for p in range(40):
        n = rng.randint(1, 12)
        for i in range(1, n + 1):
            deps = [f"n{rng.randint(1, n if p % 5 == 0 else max(1, i - 1))}" for _ in range(rng.randint(0, 3))] if i > 1 else []
            name = None if rng.random() < 0.05 else f"n{i if rng.random() < 0.9 else rng.randint(1, n)}"
            out.append((p, i, name, "Copy", [*deps, "ghost"] if p % 3 else deps or None, None, '{"table":"t"}', None, None))
    return [*out, (None, 1, "lost", "Copy", [], None, None, None, None)]


def order(df):
    return sorted((r.pipeline_id, r.idx, r.name or "", r.pos, -1 if r.level is None else r.level, r.cyclic) for r in ac.order_activities(df).collect())


def test_small_pipelines_as_by_joins(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(ac, "SMALL_ACTIVITIES", 0)
        by_joins = order(df)
    assert any(r[5] for r in by_joins) and not all(r[5] for r in by_joins)

    def never(*_):
        raise AssertionError("small pipelines need no joins")

    monkeypatch.setattr(ac, "queue_order", never)
    assert order(df) == by_joins


def test_repeated_numbers_and_large_pipelines_go_by_joins(spark, monkeypatch):
    df = spark.createDataFrame([r for r in rows() if r[0] in (1, 2, 3)], SCHEMA)
    odd = df.unionByName(df.where("pipeline_id = 1 and idx = 1"))
    seen = []
    plain = ac.queue_order
    monkeypatch.setattr(ac, "queue_order", lambda n, e, g: seen.append({r[0] for r in n.select(g).collect()}) or plain(n, e, g))
    got = order(odd)
    assert seen == [{1}]
    monkeypatch.setattr(ac, "SMALL_ACTIVITIES", 0)
    assert order(odd) == got and seen[1] == {1, 2, 3}


def test_seek_as_walk(spark, monkeypatch):
    deep = {"Key": 1}
    for k in range(30):
        deep = {"a": [deep]} if k % 2 else {"b": deep, "key": None}
    docs = [{"x": [{"KEY": {"key": [1, {"kEy": "v"}]}}, "key"], "key": {}}, deep, {"x": 'say "key"', "y": {"z": 1}}, [{"key": 2}], {"other": 1}, "key"]
    texts = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{broken"), (92, '{"k\\u0065y": 5, "a": {"k\\u0045y": 6}}')]
    df = spark.createDataFrame(texts, "id int, doc string")
    want = jw.walk(df, "doc", ["id"], containers=True).where(F.lower("key") == "key")
    show = lambda x: sorted(map(repr, x.collect()))
    expected = show(want)

    def never(*_, **__):
        raise AssertionError("documents are not walked whole")

    monkeypatch.setattr(jw, "walk", never)
    assert show(jw.collect_values(df, "doc", ["id"], "KEY").select(*want.columns)) == expected
    assert len(expected) > 20


def test_ranked_as_positions(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.hash("id").alias("v"))
    show = lambda: sorted(map(tuple, ordering.ranked(df, ["k"], ["v"]).select("k", "v", "pos").collect()))
    small = show()
    monkeypatch.setattr(ordering, "GROUP_ROWS", 3)
    assert show() == small


def test_flow_texts(spark):
    ordered = spark.createDataFrame([
        (1, 1, "A", "Copy", [], '{"type":"Parquet","path":"p"}', None, None, None, 1), (1, 2, "B", "Script", [], None, None, None, None, 2),
        (1, 3, "Mail", "Office365Email", [], None, None, None, None, 3)], SCHEMA + ", pos int")
    cands = spark.createDataFrame([(1, 1, "File", "File", None, None), (1, 2, "API", "REST API", None, "https://h/x"), (None, 1, "DB", "DB", None, None)],
                                  "pipeline_id long, pos int, source_type string, service_name string, table string, endpoint string").withColumn("path", F.lit(None).cast("string"))
    dests = spark.createDataFrame([(1, 1, "d1"), (1, 2, "d2")], "pipeline_id long, pos int, label string")
    pipes = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "pipeline_id long, pipeline_name string")
    gated = spark.createDataFrame([(1,), (2,)], "pipeline_id long")
    assert {r.pipeline_id: r.text for r in ac.flow_text(pipes, ordered, cands, dests, gated).collect()} == {
        1: "File, REST API -> A -> B -> d1, d2 with validation gates", 2: "No explicit source -> two -> no explicit sink with validation gates",
        None: "No explicit source -> none -> no explicit sink"}
    flow = {r.pipeline_id: r.text for r in ac.loading_flow(ordered, cands, dests).collect()}
    assert list(flow) == [1] and flow[1].endswith(" -> TRANSFORMATION: B -> DESTINATION: d1, d2") and "SOURCE: p" in flow[1]


def test_repeated_activities_are_not_multiplied(spark):
    chain = [(1, i, f"n{i}", "Copy", [f"n{d}" for d in (i - 1, i - 2) if d > 0], None, None, None, None) for i in range(1, 7)]
    got = [(r.idx, r.pos, r.level, r.cyclic) for r in ac.order_activities(spark.createDataFrame(chain * 3, SCHEMA)).collect()]
    assert sorted(got) == sorted([(i, i, i - 1, False) for i in range(1, 7)] * 3)
