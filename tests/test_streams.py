"""State, late rows and metrics of streams over several arrivals and restarts."""

import datetime as dt
import os

from pyspark.sql import functions as F

from metasift.operators import quality as dq
from metasift.streaming import streams as st

SCHEMA = "event_id long, event_type string, ts timestamp_ntz, value double"


def at(minute):
    return dt.datetime(2024, 5, 1, 12) + dt.timedelta(minutes=minute)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return st.event_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)


def test_marks_live_in_the_state_store(spark, tmp_path):
    src, ck = f"{tmp_path}/src", f"{tmp_path}/ck"
    batches = [[(1, "a", at(5), 1.0), (2, "b", at(9), 1.0)], [(3, "a", at(2), 1.0), (4, None, at(1), 1.0)], [(5, "a", at(30), 1.0)]]
    for rows in batches:
        st.incremental_state(arrive(spark, src, rows), ck)
    got = {r.source: r.watermark for r in st.current_state(spark, ck).collect()}
    assert got == {"a": at(30), "b": at(9), None: at(1)}
    assert any(f.endswith(".changelog") for _, _, files in os.walk(f"{ck}/state") for f in files)


def test_late_rows_are_judged_by_the_batches_before(spark, tmp_path):
    src, ok, late, ck = (f"{tmp_path}/{n}" for n in ("src", "ok", "late", "ck"))
    batches = [[(1, "a", at(100), 1.0), (2, "a", at(0), 1.0)], [(3, "a", at(39), 1.0), (4, "a", at(40), 1.0), (5, "a", at(200), 1.0)], [(6, "a", at(139), 1.0), (7, "a", None, 1.0)]]
    for rows in batches:
        st.late_split(arrive(spark, src, rows), ok, late, ck, 60)
    ids = lambda p: sorted(r.event_id for r in spark.read.parquet(p).collect())
    assert ids(late) == [3, 6] and ids(ok) == [1, 2, 4, 5, 7]
    assert spark.read.parquet(ok).columns[:4] == ["event_id", "event_type", "ts", "value"]


def test_metrics_come_from_the_write(spark, tmp_path):
    src, out, sink, ck = (f"{tmp_path}/{n}" for n in ("src", "out", "sink", "ck"))
    checks = [dq.between("value", 1, 60), dq.not_null("ts")]
    batches = [[(1, "a", at(0), 0.0), (2, "b", None, 5.0)], [(3, "z", at(1), 99.0), (4, None, at(1), None), (5, "a", at(1), 3.0)]]
    for rows in batches:
        st.monitor(arrive(spark, src, rows), out, sink, ck, checks, ["a", "b"])
    got = sorted((r.batch, r.event_type, r.rows, r.between_value, r.not_null_ts) for r in spark.read.parquet(sink).collect())
    assert got == [(0, "a", 1, 1, 0), (0, "b", 1, 0, 1), (1, "a", 1, 0, 0), (1, "other", 2, 1, 0)]
    assert spark.read.parquet(out).count() == 5
    assert spark.read.parquet(sink).agg(F.sum("rows")).first()[0] == 5
