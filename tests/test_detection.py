"""Small payloads with known labels."""

import json

import pytest
from pyspark.sql import functions as F

from metasift.operators import detect as dt
from metasift.operators import payload as pl


def payload(spark, metadata=None, config=None, raw=None):
    rows = [(1, json.dumps(metadata or {}), json.dumps(config or {}), json.dumps(raw or {}))]
    return spark.createDataFrame(rows, "payload_id long, metadata string, config string, raw_json string")


def labels(spark, **parts):
    r = dt.analyze(payload(spark, **parts)).first()
    return {c: list(r[c]) for c in dt.CATEGORIES}


def test_empty_payload_finds_nothing(spark):
    assert labels(spark) == {c: [] for c in dt.CATEGORIES}
    conf = dt.confidence(dt.analyze(payload(spark))).first()
    assert all(conf[c] == 0.0 for c in dt.CATEGORIES)


@pytest.mark.parametrize("parts, category, expected", [
    (dict(metadata={"platform": "glue"}, config={"out": "jdbc:redshift://h/db"}), "framework", ["AWS Glue", "Amazon Redshift", "Combo: Glue → Redshift"]),
    (dict(raw={"type": "adf_pipeline", "compute": "databricks_cluster"}), "framework", ["Azure Data Factory", "Databricks", "Combo: ADF → Databricks"]),
    (dict(config={"source": "abfss://c@a.dfs.core.windows.net/x"}), "source", ["ADLS Gen2"]),
    (dict(config={"in": "s3://bucket/key"}), "source", ["S3"]),
    (dict(raw={"dag_id": "d"}), "ingestion", ["Apache Airflow DAGs"]),
    (dict(config={"checks": ["SELECT COUNT(*) > 0 FROM t", "select 1 from t WHERE x IS NULL"]}), "dq_rules", ["SQL: Row count assertion", "SQL: Null check"]),
    (dict(raw={"suite_name": "orders", "expectations": [{"expectation_type": "expect_column_values_to_not_be_null"}, {"expectation_type": "expect_new"}]}),
     "dq_rules", ["Great Expectations Suite: orders", "GE: Not Null check", "GE: expect_new"]),
])
def test_labels(spark, parts, category, expected):
    found = labels(spark, **parts)[category]
    assert sorted(found) == sorted(expected)


def test_find_key_order_and_truthiness(spark):
    p = payload(spark, {"Region": "meta", "port": 0, "flag": False}, {"region": "conf", "port": 7}, {"region": "raw", "deep": {"x": 1}, "flag": True})
    row = pl.with_lookups(p).select(pl.find_key("region").alias("r"), pl.find_key("port").alias("p"), pl.find_key("deep").alias("d"), pl.find_key("flag").alias("f")).first()
    assert (row.r, row.p, row.d, row.f) == ("meta", "7", None, "true")


def test_literal_stem_is_part_of_every_match():
    assert dt.literal_stem(r"\bglue\b") == "glue"
    assert dt.literal_stem(r"elastic.?map.?reduce") == "elastic"
    assert dt.literal_stem(r"event.?hubs?") == "event"
    assert dt.literal_stem(r"a|b") == ""


def test_registry(spark):
    reg = dt.DetectorRegistry()
    reg.register("a", lambda p: p)
    with pytest.raises(ValueError):
        reg.register("a", lambda p: p)
    with pytest.raises(KeyError):
        reg.unregister("b")
    assert reg.names() == ["a"] and reg.get("b") is None


def test_entities(spark):
    rows = [(1, "urn:li:dataset:(urn:li:dataPlatform:snowflake,t,PROD)", "assertion", None, "n", "FIELD"),
            (1, "urn:li:dataJob:x", "dataJob", "GlueJob", "debezium", None)]
    e = spark.createDataFrame(rows, "payload_id long, urn string, type string, job_type string, name string, assertion_type string")
    got = {(r.category, r.label) for r in dt.detect_entities(e).collect()}
    assert got == {("framework", "Snowflake"), ("dq_rules", "DataHub Assertion: FIELD"), ("ingestion", "AWS Glue Jobs")}


def test_custom_rules_are_literal(spark):
    run = dt.custom_rule_detector([("team", "Finance", r"ledger_\d+"), ("team", "Finance", "invoice")])
    got = run(payload(spark, config={"t": "LEDGER_12"})).select("category", "label").collect()
    assert [tuple(r) for r in got] == [("team", "Finance")]


def test_overrides(spark):
    p = dt.analyze(payload(spark, config={"in": "s3://b"}))
    o = spark.createDataFrame([(1, ["X"])], "payload_id long, labels array<string>")
    assert dt.override_category(p, o, "source").select(F.col("source")[0]).first()[0] == "X"
