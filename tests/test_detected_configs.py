"""Settings per detected label: read before a join by shuffle, and the literal guards of rules and fields lose nothing."""

from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.operators import detect as dt
from metasift.operators import extract as ex


def payloads(spark):
    rows = [(k % 3 if k < 6 else k, '{"region":"r1"}', f'{{"Port":{k},"database":"db{k}"}}', t) for k, t in enumerate([
        '{"u":"JDBC:Redshift://wh:5439/dev"}', '{"u":"gs://b-1/x abfss://raw@acct/p"}', '{"u":"s3a://lake/y"}', '{"u":"jdbc:oracle:thin"}', "", "{}",
        '{"a":"pymongo"}', '{"a":"mongo"}', '{"a":"aws copy to s3 "}', '{"a":"s3 copy to aws"}', '{"a":"azure event hub"}', '{"a":"mysql odbc connector"}'])]
    return spark.createDataFrame([*rows, (None, "{}", "{}", '{"u":"gs://none"}')], "payload_id long, metadata string, config string, raw_json string")


def test_labels_are_not_broadcast(spark):
    p = payloads(spark)
    found = ex.detected_configs(p, dt.detect_text(p, "source").select("payload_id", "label"), {"GCS": "gcs", "ADLS Gen2": "adls", "JDBC/Redshift": "redshift"})
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_settings_are_those_of_every_extractor_alone(spark):
    p = payloads(spark)
    labels = dt.detect_text(p, "source").select("payload_id", "label")
    mapping = {k: v for k, v in ex.SOURCE_EXTRACTORS.items() if v in ("s3", "adls", "gcs", "redshift", "jdbc")}
    found = ex.detected_configs(p, labels, mapping).select("payload_id", "label", "field", "value").collect()
    pairs = spark.createDataFrame(list(mapping.items()), "label string, extractor string")
    alone = None
    for name in dict.fromkeys(mapping.values()):
        one = ex.typed_config(p, name)
        alone = one if alone is None else alone.unionByName(one)
    plain = labels.join(F.broadcast(pairs), "label").join(alone, ["payload_id", "extractor"]).select("payload_id", "label", "field", "value").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, plain)) and len(found) > 20
    assert {r["value"] for r in found if r["field"] == "paths"} == {"gs://b-1/x", "abfss://raw@acct/p", "s3a://lake/y"}


def test_guards_lose_no_match(spark):
    texts = payloads(spark).withColumn("txt", F.lower("raw_json"))
    for some in (rules.SOURCE_RULES, rules.FRAMEWORK_RULES, rules.INGESTION_RULES, rules.SQL_CHECK_RULES, rules.DQ_TOOL_RULES):
        words = [p.replace("\\b", "").replace(".*", " x ").replace("?", "").replace("\\", "") for _, ps in some for p in ps]
        t = texts.select("txt").unionByName(spark.createDataFrame([(w,) for w in words], "txt string"))
        r = t.select(dt.rule_hits("txt", some, "e").alias("a"), dt.rule_hits("txt", some, "e", prefilter=False).alias("b"))
        assert r.where("a <> b").count() == 0 and r.where("size(a) > 0").count() > 2


def test_patterns_with_a_shared_literal_stand_behind_it():
    assert dt.neighbours([r"\bmongodb\b", "pymongo", "mongo://", "redis"]) == [("mongo", [r"\bmongodb\b", "pymongo", "mongo://"]), ("", ["redis"])]
    assert dt.literal_runs(r"event.?hubs?") == ["event", "hub"] and dt.literal_stem(r"azure.*data.*lake") == "azure"
    assert dt.matches("t", "s3://") == "contains(t, 's3://')"


def test_every_label_with_an_extractor_is_dispatched_and_the_inventory_stands_in(spark):
    texts = ["aws copy s3 ", "s3a://lake/y", "openapi", "https://h/api/v1 openapi", "copy into t", "gs://b/x"]
    p = spark.createDataFrame([(k, '{"auth_type":"oauth"}', '{"account":"a1","bq_dataset":"d"}', f'{{"u":"{t}"}}') for k, t in enumerate(texts)], "payload_id long, metadata string, config string, raw_json string")
    labels = dt.detect_text(p, "source").select("payload_id", "label").unionByName(spark.createDataFrame([(5, "BigQuery"), (5, "Microsoft Fabric"), (5, "MongoDB")], "payload_id long, label string"))
    assets = spark.createDataFrame(
        [(k, 0, i, s, f"us || {s}-{i}", c) for k in (0, 1, 2, 3, 5) for i, (s, c) in enumerate([("s3", '{"Region":"eu"}'), ("s3", "{}"), ("apigateway", '{"PublicInvokeURL":"https://api/1"}'), ("apigateway", "{}"), ("fabric_items", '{"Type":"Lakehouse"}')])],
        "payload_id long, dump_pos int, item_pos int, service string, id string, configuration string")
    rows = ex.detected_configs(p, labels, ex.SOURCE_EXTRACTORS, assets).collect()
    got = {}
    for r in rows:
        got.setdefault((r.payload_id, r.label), {})[r.field] = r.value
    assert got == {
        (0, "S3"): {"type": "Amazon S3", "paths": "s3://s3-0/", "bucket": "s3-0", "region": "eu", "access_key_configured": "false"},
        (1, "S3"): {"type": "Amazon S3", "paths": "s3a://lake/y", "bucket": "lake", "access_key_configured": "false"},
        (2, "REST API"): {"type": "REST API", "endpoints": "https://api/1", "auth_type": "oauth", "api_key_configured": "false", "discovery_notes": "Discovered 2 endpoints"},
        (3, "REST API"): {"type": "REST API", "endpoints": "https://h/api/v1", "auth_type": "oauth", "api_key_configured": "false", "discovery_notes": "Discovered 2 endpoints"},
        (4, "Snowflake Stage"): {"type": "Snowflake", "account": "a1"},
        (5, "GCS"): {"type": "Google Cloud Storage", "paths": "gs://b/x", "bucket": "b"},
        (5, "BigQuery"): {"type": "Google BigQuery", "dataset": "d"},
        (5, "Microsoft Fabric"): {"type": "Microsoft Fabric", "workspace_names": "fabric_items-4", "item_types": "Lakehouse"}}


def test_the_query_dispatches_every_source_extractor(spark, sf):
    from metasift.plans.extraction import detected_source_configs

    assert {r.label for r in detected_source_configs(spark, sf).select("label").distinct().collect()} >= {"S3", "GCS", "ADLS Gen2", "JDBC/Redshift", "Kafka Topic"}
