"""Job runs, merges, ranged extracts and sketches: one read of the source, whole sinks after failures."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from metasift.operators import ingest as ig
from metasift.operators import quality as dq
from metasift.operators.jobspecs import run_job
from metasift.sources import files

SPEC = {"job_id": "j", "source_type": "aws", "add_metadata_cols": False}


def frame(spark, path, n=100):
    spark.range(n).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("half"), F.lit(None).cast("string").alias("bare")).write.parquet(path)
    return spark.read.parquet(path)


def test_a_broken_check_leaves_the_sink_as_it_was(spark, tmp_path):
    src, out = frame(spark, f"{tmp_path}/src"), f"{tmp_path}/out"
    spec = SPEC | {"watermark_column": "id", "watermark_type": "integer", "extraction_mode": "incremental", "last_watermark": "9"}
    assert run_job(src, spec | {"row_count_max": 90, "not_empty_columns": ["half"], "custom_checks": ["id < 10"]}, out) == 99
    assert spark.read.parquet(f"{out}/clean").count() == 90
    for broken in ({"row_count_max": 89}, {"not_empty_columns": ["bare"]}, {"custom_checks": ["k = 3"]}, {"row_count_min": 91}):
        with pytest.raises(ValueError):
            run_job(src, spec | broken, out)
    assert spark.read.parquet(f"{out}/clean").count() == 90


def test_the_source_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            reads.add(len(r))
            yield r

    src = frame(spark, f"{tmp_path}/src").mapInPandas(count, "id long, k long, half string, bare string")
    spec = SPEC | {"watermark_column": "id", "row_count_min": 1, "custom_checks": ["id < 0"], "dedup_columns": ["k"], "null_check_columns": ["half"]}
    assert run_job(src, spec, f"{tmp_path}/out") == 99 and reads.value == 100
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/out/clean").collect()} == {86, 88, 90, 92, 94, 96, 98}


def test_limits_and_bounds(spark, tmp_path):
    src = frame(spark, f"{tmp_path}/src")
    mark = run_job(src, SPEC | {"extraction_mode": "incremental", "watermark_column": "id", "watermark_type": "integer", "last_watermark": "10", "upper_bound_column": "id",
                                "upper_bound_value": "40", "row_limit": 5, "order_by": ["id"]}, f"{tmp_path}/out")
    assert mark == 15 and spark.read.parquet(f"{tmp_path}/out/clean").agg(F.min("id"), F.max("id")).first()[:] == (11, 15)


def test_change_capture_kinds(spark, tmp_path):
    rows = [(1, 1, "a", None), (1, 2, "b", None), (2, 3, "c", "2024-01-02"), (3, None, "d", None)]
    src = spark.createDataFrame(rows, "k int, seq int, v string, gone string")
    for kind in ("log_based", "trigger"):
        run_job(src, SPEC | {"extraction_mode": "cdc", "cdc_mode": kind, "key_columns": ["k"], "lsn_column": "seq"}, f"{tmp_path}/{kind}")
        assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/{kind}/clean").collect()) == ["b", "c"]
    run_job(src, SPEC | {"extraction_mode": "cdc", "deleted_at_column": "gone", "include_deletes": False}, f"{tmp_path}/soft")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/soft/clean").collect()) == ["a", "b", "d"]
    for bad in ({"cdc_mode": "soft_delete"}, {"cdc_mode": "log_based", "key_columns": ["k"]}, {"cdc_mode": "query_based"}):
        with pytest.raises(ValueError):
            run_job(src, SPEC | {"extraction_mode": "cdc"} | bad, f"{tmp_path}/bad")


def listing(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_merge_touches_only_the_partitions_of_its_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(60).select((F.col("id") % 3).cast("int").alias("p"), F.col("id").alias("k"), F.lit("old").alias("v"))
    files.merge(rows, path, keys=["p", "k"], partition_by=["p"])
    before = listing(path)
    new = rows.where("p = 1 and k < 30").withColumn("v", F.lit("new"))
    files.merge(new.unionByName(new.limit(1).withColumn("k", F.lit(1000).cast("bigint"))), path, keys=["p", "k"], partition_by=["p"])
    after = listing(path)
    assert {f: t for f, t in before.items() if "/p=1/" not in f} == {f: t for f, t in after.items() if "/p=1/" not in f}
    got = {r.k: r.v for r in files.read(spark, path, "parquet", rows.schema).collect()}
    assert got == {k: "new" if k % 3 == 1 and k < 30 else "old" for k in range(60)} | {1000: "new"}
    failing = new.withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception):  # noqa: B017
        files.merge(failing, path, keys=["p", "k"], partition_by=["p"])
    assert listing(path) == after


def test_merge_without_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, keys=["k"])
    files.merge(spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string"), path, keys=["k"], order="v")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "e")]


@pytest.mark.parametrize("parts", [1, 4, 100])
def test_ranges_part_the_rows_without_a_shuffle(spark, tmp_path, parts):
    spark.range(5000).select(F.when(F.col("id") % 10 != 0, F.when(F.col("id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("id"))).alias("k"), "id").write.parquet(f"{tmp_path}/s")
    src = spark.read.parquet(f"{tmp_path}/s")
    ranges = ig.partitioned_extract(src, parts, "k")
    assert 1 <= len(ranges) <= parts
    ids = [r.id for part in ranges for r in part.collect()]
    assert sorted(ids) == list(range(5000))
    for part in ranges:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and (parts == 1 or "PushedFilters: [" in plan and "k" in plan.split("PushedFilters: [")[1].split("]")[0])
    if parts == 4:
        assert max(part.count() for part in ranges) < 3000
    assert len(ig.partitioned_extract(src.limit(0), parts, "k")) == 1
    with pytest.raises(ValueError):
        ig.partitioned_extract(src, 0, "k")


def test_sketches_merge_to_the_sketch_of_the_whole(spark):
    rows = spark.range(60_000).select((F.col("id") % 17_000).alias("v"), (F.col("id") % 5).alias("batch"), F.lit(1).alias("all"))
    rows = rows.unionByName(rows.limit(10).withColumn("v", F.lit(None).cast("bigint")))
    merged = dq.merged_distinct(dq.distinct_sketches(rows, "v", ["batch"]), "v").first()
    whole = dq.merged_distinct(dq.distinct_sketches(rows, "v", ["all"]), "v").first()
    assert merged.total == 60_010 and abs(merged.distinct_values - 17_000) <= 17_000 * 0.03 and abs(merged.distinct_values - whole.distinct_values) <= 17_000 * 0.01
