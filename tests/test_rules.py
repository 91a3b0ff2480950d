"""Corrections of rules that the fixtures do not reach."""

from pyspark.sql import functions as F

from metasift.operators import code, detect, ingest, lineage

PAYLOAD = "payload_id int, metadata string, config string, raw_json string"


def test_missing_surfaces_keep_their_labels(spark):
    df = spark.createDataFrame([(1, '{"x":"soda scan"}', None, None)], PAYLOAD)
    assert detect.analyze(df).first().dq_rules == ["Soda DQ"]


def test_expectations_keep_their_order_of_appearance(spark):
    raw = "{" + ",".join(f'"e{k}":{{"expectation_type":"{t}"}}' for k, t in enumerate(["expect_zeta", "expect_alpha", "expect_mid", "expect_zeta"])) + "}"
    got = detect.analyze(spark.createDataFrame([(1, "{}", "{}", raw)], PAYLOAD)).first().dq_rules
    assert [x for x in got if x.startswith("GE: ")] == ["GE: expect_zeta", "GE: expect_alpha", "GE: expect_mid"]


def test_entity_labels_join_the_analysis(spark):
    df = spark.createDataFrame([(1, '{"x":"soda scan"}', None, None), (2, "{}", None, None)], PAYLOAD)
    entities = spark.createDataFrame([(2, "urn:li:assertion:1", "assertion", None, "n", "DATASET")] * 2, "payload_id int, urn string, type string, job_type string, name string, assertion_type string")
    rows = {r.payload_id: r for r in detect.analyze(df, entities).collect()}
    assert rows[1].dq_rules == ["Soda DQ"]
    assert len(rows[2].dq_rules) == len(set(rows[2].dq_rules)) == 1


def test_rules_look_across_line_breaks(spark):
    flat, broken = '{"kafka":1,"x":"topic"}', '{\n  "kafka": 1,\r\n  "x": "topic"\n}'
    rows = detect.analyze(spark.createDataFrame([(1, flat, None, None), (2, broken, None, None)], PAYLOAD)).orderBy("payload_id").collect()
    assert rows[0].source == rows[1].source and rows[0].source


def test_user_rules_take_any_pattern(spark):
    run = detect.custom_rule_detector([("framework", "A", "(?i)Foo"), ("framework", "B", "\\\\p{Alpha}+bar".replace("\\\\", "\\"))])
    rows = run(spark.createDataFrame([(1, "foobar", None, None)], PAYLOAD)).collect()
    assert sorted(r.label for r in rows) == ["A", "B"]


def test_rows_without_an_order_are_not_lost(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", 5, 2), ("b", None, 3)], "k string, seq int, v int")
    assert {r.k: r.v for r in lineage.first_write_wins(df, ["k"], "seq").collect()} == {"a": 1, "b": 2}
    assert {r.k: r.v for r in ingest.latest_per_key(df, ["k"], F.col("seq")).collect()} == {"a": 1, "b": 2}


def test_newest_sequence_wins_whatever_came_last(spark):
    state = spark.createDataFrame([(1, 10, "kept"), (2, 1, "old"), (3, 4, "tie"), (4, 9, "stays")], "k int, seq int, v string")
    changes = spark.createDataFrame([(1, 5, "late", "U"), (2, 2, "new", "U"), (3, 4, "replayed", "U"), (4, 3, "x", "D"), (5, 1, "y", "D")], "k int, seq int, v string, _op string")
    got = {r.k: r.v for r in ingest.cdc_apply(state, changes, ["k"], "seq").collect()}
    assert got == {1: "kept", 2: "new", 3: "replayed", 4: "stays"}


def test_upsert_keeps_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "c", 2), (1, "d", 1), (3, "e", 1)], "k int, v string, seq int")
    assert sorted(tuple(r) for r in ingest.upsert(old, new, ["k"], "seq").collect()) == [(1, "c", 2), (2, "b", 0), (3, "e", 1)]
    assert ingest.upsert(old, new, ["k"]).count() == 3


def test_archives_give_their_files_or_an_error(spark):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/m.py", "import json")
        z.writestr("b.txt", "no")
    df = spark.createDataFrame([("good.zip", data.getvalue()), ("bad.zip", b"nothing")], "path string, content binary")
    rows = {(r.package, r.path, r.source, r.error is None) for r in code.unzip_python(df).collect()}
    assert rows == {("good.zip", "a/m.py", "import json", True), ("bad.zip", None, None, False)}
    found = code.code_findings(code.unzip_python(df), ["package"]).collect()
    assert [tuple(r) for r in found] == [("good.zip", "format", "json", "import")]


def test_jobs_hold_to_their_spec(spark, tmp_path):
    import pytest

    from metasift.operators.jobspecs import run_job

    df = spark.createDataFrame([(1, 5, "a"), (2, 9, None), (3, None, "c")], "k int, seq int, v string")
    spec = {"job_id": "j", "source_type": "aws", "add_metadata_cols": False, "watermark_column": "seq", "write_mode": "merge", "key_columns": ["k"], "null_check_columns": ["v"]}
    path = str(tmp_path / "out")
    assert run_job(df, spec, path) == 9
    assert sorted(r.k for r in spark.read.parquet(path + "/clean").collect()) == [1, 3]
    assert [r.k for r in spark.read.parquet(path + "/quarantine").collect()] == [2]
    later = spark.createDataFrame([(1, 12, "z"), (4, 11, "n")], df.schema)
    assert run_job(later, spec, path) == 12
    assert {r.k: r.v for r in spark.read.parquet(path + "/clean").collect()} == {1: "z", 3: "c", 4: "n"}
    with pytest.raises(ValueError, match="rows extracted"):
        run_job(df, spec | {"row_count_min": 4}, path)
    with pytest.raises(ValueError, match="columns differ"):
        run_job(df, spec | {"expected_columns": ["k"], "schema_drift_action": "fail"}, path)
    run_job(df, {**spec, "write_mode": "append", "expected_columns": ["k", "seq"], "schema_drift_action": "ignore", "null_check_columns": [], "sample_percent": 100.0, "sample_key": "k"}, str(tmp_path / "two"))
    assert spark.read.parquet(str(tmp_path / "two/clean")).columns == ["k", "seq"]
