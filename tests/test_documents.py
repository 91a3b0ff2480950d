"""Nested documents from leaves against a recursive build."""

import json
import random

from pyspark.sql import functions as F

from metasift.operators import configs as cf
from metasift.operators import documents as ds


def random_value(rng, depth):
    kind = rng.choice(["object", "list", "leaf", "leaf"]) if depth else "leaf"
    if kind == "object":
        return {rng.choice(["a", "b", "c", "d e", 'q"uote', "é", "back\\slash"]): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if kind == "list":
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 12))]
    return rng.choice([1, 0, -2.5, True, None, "", "text, \"quoted\"\n", "é☃", 10**15])


def built(rows):
    """Recursive build of (path steps, value) rows by the documented rules."""
    if [] in [s for s, _ in rows] and len(rows) == 1:
        return rows[0][1]
    deep = [(s, v) for s, v in rows if s]
    keys = sorted({s[0] for s, _ in deep})
    parts = {}
    for k in keys:
        below = [(s[1:], v) for s, v in deep if s[0] == k]
        under = [x for x in below if x[0]]
        parts[k] = built(under) if under else json.loads(max(json.dumps(v, ensure_ascii=False, separators=(",", ":")) for _, v in below))
    if all(k.startswith("[") and k.endswith("]") and k[1:-1].isdigit() for k in parts):
        size = 1 + max(int(k[1:-1]) for k in parts)
        return [parts.get(f"[{i}]") for i in range(size)]
    return parts


def test_documents_come_back(spark):
    rng = random.Random(5)
    docs = [{"k": random_value(rng, 5)} for _ in range(60)] + [{}, {"only": []}, {"x": {"y": {}}}]
    deep = 1
    for k in range(30):
        deep = {"n": deep} if k % 3 else [deep, k]
    docs.append({"deep": deep})
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    got = {r.id: json.loads(r.d) for r in ds.assemble(ds.document_leaves(df, "doc", ["id"]), ["id"]).select("id", F.to_json("document").alias("d")).collect()}
    assert got == dict(enumerate(docs))


def test_leaves_that_overlap_or_leave_gaps(spark):
    cases = {
        "gap": [("l[2]", 1), ("l[0].x", 2)], "nested": [("m[1][0]", "a"), ("m[0][2]", "b")], "both": [("a", 1), ("a.b", 2)], "empty": [("a", {}), ("a.b.c", 2)],
        "mixed": [("a[0]", 1), ("a.k", 2)], "twice": [("a", 1), ("a", 2)], "many": [(f"l[{k}]", k) for k in range(25)], "root": [("", 5)], "top": [("[1]", "x"), ("[0].y", None)],
    }
    rows = [(c, p, json.dumps(v, separators=(",", ":"))) for c, some in cases.items() for p, v in some] + [(None, "x", "1"), ("null", "v", None)]
    out = ds.assemble(spark.createDataFrame(rows, "id string, path string, value string"), ["id"]).select("id", F.to_json("document").alias("d"))
    got = {r.id: json.loads(r.d) for r in out.collect()}

    def steps(path):
        return [s for s in path.replace("[", ".[").split(".") if s]

    for c, some in cases.items():
        assert got[c] == built([(steps(p), v) for p, v in some]), c
    assert got[None] == {"x": 1} and got["null"] == {"v": None}
    assert ds.assemble(spark.createDataFrame([], "id string, path string, value string"), ["id"]).count() == 0


def test_one_container_holds_most_leaves(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("id"),
                                      F.concat(F.lit("a.n"), F.col("id"), F.lit(".v")).alias("path"), F.col("id").cast("string").alias("value"))
    out = ds.assemble(rows, ["id"]).select("id", F.size(F.map_keys(F.try_variant_get("document", "$.a", "map<string,variant>"))).alias("n"))
    got = {r.id: r.n for r in out.collect()}
    assert got["hot"] == 20_000 and sum(got.values()) == 60_000


CONFIGS = "config_id int, raw string, raw_text string, extracted string, example string, ingestion_type string"


def test_finalize_as_one_call(spark):
    rows = [
        (1, '{"ingestion_configs":{"destination":"dw"},"flow":"A -> Send Email -> dw"}', "select count(*) is null",
         '{"source_config":{"service_name":"S3"},"ingestion_configs":{"destination":"Send Email"},"dq_rules":["row_count_check","null_check"]}',
         '{"title":"t","ingestion_configs":{"frequency":"daily"},"list":[{"a":1},[]]}', "streaming"),
        (2, None, None, None, None, None),
        (3, "not json", "", '{"ingestion_configs":{"destination":"Teams alert","mode":"batch"}}', "{}", ""),
    ]
    done, report = cf.finalize(spark.createDataFrame(rows, CONFIGS))
    got = {r.config_id: r for r in done.withColumn("d", F.to_json("document")).collect()}
    one = json.loads(got[1].d)
    assert got[1].destination == "dw" and got[1].dq_rules == ["row_count_check", "null_check"] and got[1].flow_text == "A -> dw"
    assert one["ingestion_configs"] == {"destination": "dw", "frequency": "daily", "mode": "streaming"} and one["list"] == [{"a": 1}, []]
    assert one["source_configs"] == {"service_name": "S3"} and one["final_definition"] == "A -> dw"
    assert one["pipeline_extracted_overlay"]["missing_fields_analysis"] == one["missing_fields_analysis"] == [{"field": m.field, "reason": m.reason} for m in got[1].missing]
    two = json.loads(got[2].d)
    assert two["dq_rules"] == [] and two["flow"] == {"text": None} and "pipeline_extracted_overlay" not in two
    assert got[3].destination is None and json.loads(got[3].d)["ingestion_configs"] == {"destination": None, "mode": "batch"}
    events = {(r.config_id, r.field, r.action) for r in report.collect()}
    assert {(1, "ui_inputs.ingestion_type", "from_example"), (3, "ingestion_configs.destination", "corrected")} <= events
    assert cf.finalize(spark.createDataFrame([], CONFIGS))[0].count() == 0
