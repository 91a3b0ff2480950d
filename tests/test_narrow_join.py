"""Storage settings: payloads are read before the join, and only the keys looked up are kept."""

from metasift.operators import extract as ex
from metasift.operators.payload import find_key, with_lookups

ASSET = "payload_id long, dump_pos int, service string, item_pos long, id string, configuration string"


def test_texts_stay_out_of_the_join(spark):
    rows = [(1, '{"Account":"A","account":0,"warehouse":"w"}', '{"in":"S3://lake/x"}', '{"n":[1]}'),
            (1, None, '{"bq_dataset":"d","Project":"p"}', '{"project":7}'), (2, "{}", "broken", "gs://g/x"), (None, '{"account":"z"}', None, None)]
    p = spark.createDataFrame(rows, "payload_id long, metadata string, config string, raw_json string")
    a = spark.createDataFrame([(3, 0, "s3", 0, "us || b1", "{}"), (1, 0, "s3", 1, "us || b2", "{}")], ASSET)
    df = ex.storage_config(p, a)
    got = {(r.payload_id, r.field, r.value) for r in df.collect()}
    assert {(1, "snowflake.account", "A"), (1, "snowflake.warehouse", "w"), (1, "bigquery.dataset", "d"), (1, "bigquery.project_id", "p"),
            (1, "s3.paths", "s3://lake/x"), (2, "gcs.paths", "gs://g/x"), (None, "snowflake.account", "z"), (3, "s3.bucket_count", "1"),
            (3, "s3.path_count", "1")} <= got
    assert not [r for r in got if r[0] == 3 and r[1].startswith(("snowflake", "gcs"))]
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(plan) if "Join FullOuter" in x)
    assert "txt#" not in "".join(plan[:join]) and "metadata_m#" not in "".join(plan[:join])


def test_lookups_of_some_keys(spark):
    p = spark.createDataFrame([('{"b":1,"A":"x","a":"","c":true}', '{"a":"y"}', None)], "metadata string, config string, raw_json string")
    row = with_lookups(p, ["a"]).select("metadata_m", "config_m", find_key("a").alias("v")).first()
    assert (row.metadata_m, row.config_m, row.v) == ({"A": "x"}, {"a": "y"}, with_lookups(p).select(find_key("a").alias("v")).first().v)
