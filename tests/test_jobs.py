"""Ingestion rules, sinks and code findings."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from metasift.operators import code as cd
from metasift.operators import ingest as ig
from metasift.operators import jobspecs as js
from metasift.sources import files, listings


def test_spec_conflicts():
    with pytest.raises(ValueError):
        ig.ExtractSpec(include=["a"], exclude=["a"])
    with pytest.raises(ValueError):
        ig.ExtractSpec(row_limit=1, sample_percent=2.0)
    with pytest.raises(ValueError):
        files.check_output("csv", "snappy")
    with pytest.raises(NotImplementedError):
        files.check_output("delta", "none")
    with pytest.raises(ValueError):
        ig.jdbc_partition_options("id", 0, 10, 64, 1000)


def test_filter_reaches_the_scan(spark, sf):
    df = ig.incremental(spark.read.parquet(f"{sf}/events.parquet"), "ts", "2024-01-20 00:00:00", lookback_minutes=30).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "struct<event_id:bigint,ts:timestamp_ntz>" in plan.lower()


def test_first_n_limits_before_the_shuffle(spark, sf):
    from metasift.operators.lineage import first_n

    plan = first_n(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_suppkey"], ["l_orderkey"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_source_specs(spark):
    rows = [("j1", '{"source_type":"postgres","pg_host":"h","pg_database":"d","pg_user":"u","pg_password":"p","pg_table":"t"}'),
            ("j2", '{"source_type":"oracle"}'), ("j3", "{}"), ("j4", '{"source_type":"aws","aws_region":"eu","file_format":"csv"}')]
    p = js.parse_source(spark.createDataFrame(rows, "job_id string, source string"))
    got = {r.job_id: list(r.errors) for r in p.collect()}
    assert got == {"j1": [], "j2": ["unknown_type:oracle"], "j3": ["missing:source_type"], "j4": ["missing:source_bucket"]}
    clean, hidden = js.credential_split(p.where("size(errors) = 0"))
    assert "pg_password" not in clean.select("fields.*").columns
    assert hidden.first().secrets == {"pg_password": "p"} and clean.first().source_secret_name == "etl-src-postgres-j1"


def test_code_findings_and_archives(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.py", "import json\ns3.get_object(Bucket='in')\nq.send_message(QueueUrl='u')\n")
        z.writestr("b.py", "def broken(:")
        z.writestr("c.txt", "import csv")
    (tmp_path / "p.zip").write_bytes(buf.getvalue())
    src = cd.unzip_python(spark.read.format("binaryFile").load(str(tmp_path)))
    found = {(r.kind, r.value) for r in cd.code_findings(src, ["package"]).collect()}
    assert found == {("format", "json"), ("operation", "read"), ("target", "s3://in"), ("target", "u")}
    edges = {(r.from_id.split(":")[0], r.to_id.split(":")[0]) for r in cd.stitch_lineage(cd.code_findings(src, ["package"]), "package").collect()}
    assert edges == {("s3", "package"), ("package", "u")}


def test_file_listing(spark, tmp_path):
    (tmp_path / "dags").mkdir()
    (tmp_path / "dags" / "d.py").write_text("x")
    (tmp_path / "dbt_project.yml").write_text("y")
    f = listings.file_listing(spark, str(tmp_path))
    rel = f.select(F.lit(1).alias("root"), F.expr(f"replace(substring(path, instr(path, '{tmp_path.name}')), '{tmp_path.name}/', '')").alias("path"))
    tags = listings.framework_set(listings.source_tree(rel)).first().frameworks
    assert tags == ["Apache Airflow DAGs", "dbt", "dbt Jobs"]


def test_decode_and_salvage(spark):
    df = spark.createDataFrame([("eyJhIjoxfQ==", "<think>{no}</think> ok {\"a\": [1]} end"), ("plain!", "{broken")], "b string, t string")
    rows = df.select(listings.decode_text(F.col("b")).alias("b"), listings.salvage_json(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [('{"a":1}', '{"a":[1]}'), ("plain!", None)]
