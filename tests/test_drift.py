"""Sinks whose schema drifts: each way to meet a difference, over several deliveries."""

import pytest
from pyspark.sql import types as T

from metasift.sources import files

FIRST, SECOND, THIRD = "k int, v string", "k bigint, v string, w double", "w float, z date"
ROWS = {FIRST: [(1, "a")], SECOND: [(2**40, "b", 0.5)], THIRD: [(1.5, None)]}


def deliver(spark, path, action):
    for ddl, rows in ROWS.items():
        files.append_drifting(spark.createDataFrame(rows, ddl), path, action)
    out = files.read_drifting(spark, path)
    return out.dtypes, sorted(map(tuple, out.collect()), key=repr)


def test_evolve_gains_columns_and_wider_types(spark, tmp_path):
    types, rows = deliver(spark, f"{tmp_path}/t", "evolve")
    assert types == [("k", "bigint"), ("v", "string"), ("w", "double"), ("z", "date")]
    assert rows == sorted([(1, "a", None, None), (2**40, "b", 0.5, None), (None, None, 1.5, None)], key=repr)


def test_ignore_and_warn_keep_the_sink(spark, tmp_path):
    for action in ("ignore", "warn"):
        types, rows = deliver(spark, f"{tmp_path}/{action}", action)
        assert types == [("k", "int"), ("v", "string")]
        assert rows == sorted([(1, "a"), (None, "b"), (None, None)], key=repr)
    notes = {(r.column, r.status) for r in files.drift_notes(spark, f"{tmp_path}/warn").collect()}
    assert notes == {("k", "type_changed"), ("w", "added"), ("z", "added"), ("k", "removed"), ("v", "removed")}
    assert files.drift_notes(spark, f"{tmp_path}/ignore").count() == 0


def test_fail_and_types_without_a_widening(spark, tmp_path):
    files.append_drifting(spark.createDataFrame(ROWS[FIRST], FIRST), f"{tmp_path}/t", "fail")
    for action, ddl, row in (("fail", SECOND, ROWS[SECOND]), ("evolve", "k string", [("x",)])):
        with pytest.raises(ValueError):
            files.append_drifting(spark.createDataFrame(row, ddl), f"{tmp_path}/t", action)
    assert files.read_drifting(spark, f"{tmp_path}/t").count() == 1
    with pytest.raises(ValueError):
        files.append_drifting(spark.createDataFrame(ROWS[FIRST], FIRST), f"{tmp_path}/t", "hope")


def test_schemas_fold_in_any_order():
    a, b = T.StructType.fromDDL("x int, y float"), T.StructType.fromDDL("y double, x bigint, z string")
    assert {(f.name, f.dataType) for f in files.evolved(a, b).fields} == {(f.name, f.dataType) for f in files.evolved(b, a).fields}
