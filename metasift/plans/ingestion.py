"""Declarative ingestion and sink queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.operators import ingest as ig
from metasift.operators import quality as dq
from metasift.plans.catalog import fixture, query, table
from metasift.session import scratch_path
from metasift.sources import files

EVENT_COLS = "event_id, user_id, event_type, value"


@query("P16", "row_filter_where", """
select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000""")
def row_filter_where(spark, sf):
    return ig.where(table(spark, sf, "orders"), "o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("P17", "project_include_exclude", "select o_orderkey, o_orderstatus from orders")
def project_include_exclude(spark, sf):
    return ig.project(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"], ["o_totalprice"])


@query("P18", "row_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def row_limit(spark, sf):
    return ig.limit_rows(table(spark, sf, "orders"), 100, [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("P19", "sample_percent", """
select o_orderkey, o_totalprice from orders where cast('0x' || md5(cast(o_orderkey as varchar))[1:8] as bigint) % 10000 < 1000""")
def sample_percent(spark, sf):
    return ig.sample(table(spark, sf, "orders"), 10.0, key="o_orderkey").select("o_orderkey", "o_totalprice")


@query("P20", "add_metadata_columns", """
select o_orderkey, timestamp '2024-01-01' as _ingested_at, 'postgres' as _source_type, 'job-1' as _job_id from orders""")
def add_metadata_columns(spark, sf):
    return ig.add_metadata(table(spark, sf, "orders").select("o_orderkey"), "postgres", "job-1", ig.META_TIME)


@query("P21", "masked_projection", """
select c_custkey, c_mktsegment, '***' as c_name, 'xxxxxxxx#nnnnnnnnn' as partial from customer""")
def masked_projection(spark, sf):
    from metasift.operators.jobspecs import mask_columns

    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name", F.mask("c_name", F.lit("x"), F.lit("x"), F.lit("n")).alias("partial"))
    return mask_columns(c, ["c_name"])


@query("I01", "ingest_full_load", """
select o_orderkey, o_totalprice, timestamp '2024-01-01' as _ingested_at, 'postgres' as _source_type, 'job-1' as _job_id
from orders where o_orderstatus = 'O' order by o_orderkey limit 500""")
def ingest_full_load(spark, sf):
    return ig.full_load(table(spark, sf, "orders"), ig.ExtractSpec(
        where="o_orderstatus = 'O'", include=["o_orderkey", "o_totalprice"], row_limit=500, order_by=["o_orderkey"],
        source_type="postgres", job_id="job-1", ingested_at=ig.META_TIME))


@query("I02", "ingest_incremental", """
select 'timestamp' as kind, event_id from events where ts > timestamp '2024-01-20'
union all select 'integer', event_id from events where event_id > 5000""")
def ingest_incremental(spark, sf):
    e = table(spark, sf, "events")
    a = ig.incremental(e, "ts", "2024-01-20 00:00:00").select(F.lit("timestamp").alias("kind"), "event_id")
    return a.unionByName(ig.incremental(e, "event_id", "5000", "integer").select(F.lit("integer").alias("kind"), "event_id"))


@query("I03", "incremental_lookback", "select event_id from events where ts > timestamp '2024-01-20' - interval 90 minute")
def incremental_lookback(spark, sf):
    return ig.incremental(table(spark, sf, "events"), "ts", "2024-01-20 00:00:00", lookback_minutes=90).select("event_id")


@query("I04", "incremental_bounded", """
select event_id from events where ts > timestamp '2024-01-10' and ts <= timestamp '2024-01-20'""")
def incremental_bounded(spark, sf):
    return ig.incremental(table(spark, sf, "events"), "ts", "2024-01-10 00:00:00", upper="2024-01-20 00:00:00").select("event_id")


@query("I05", "next_watermark", """
with old as (select event_type as source, max(ts) as w from events where ts <= timestamp '2024-01-15' group by 1),
new as (select event_type as source, max(ts) as w from events where ts > timestamp '2024-01-15' and event_type <> 'error' group by 1)
select source, coalesce(new.w, old.w) as watermark from old full join new using (source)""")
def next_watermark(spark, sf):
    e = table(spark, sf, "events")
    cut = "2024-01-15 00:00:00"
    state = ig.incremental(e, "ts", None, upper=cut).groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("watermark"))
    return ig.next_watermark(state, ig.incremental(e, "ts", cut).where("event_type <> 'error'"), "event_type", "ts")


@query("I06", "hybrid_incremental", """
select o_orderkey from orders where o_orderdate > timestamp '2000-01-01' or o_orderdate + to_days((o_custkey % 30)::int) > timestamp '1999-12-15'""")
def hybrid_incremental(spark, sf):
    o = table(spark, sf, "orders").withColumn("seen", F.expr("o_orderdate + make_interval(0, 0, 0, cast(o_custkey % 30 as int))"))
    return ig.hybrid_incremental(o, "o_orderdate", "2000-01-01", "seen", "1999-12-15").select("o_orderkey")


CDC = "(select *, ts + to_hours((event_id % 100)::int) as updated from events)"


def cdc_events(spark, sf):
    return table(spark, sf, "events").withColumn("updated", F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 100 as int))"))


@query("I07", "cdc_query_based", f"""
select event_id, case when ts > timestamp '2024-01-20' then 'I' else 'U' end as op from {CDC}
where ts > timestamp '2024-01-20' or updated > timestamp '2024-01-20'""")
def cdc_query_based(spark, sf):
    return ig.cdc_query_based(cdc_events(spark, sf), "ts", "updated", "2024-01-20 00:00:00").select("event_id", F.col("_op").alias("op"))


@query("I08", "cdc_soft_delete", """
select 'with' as mode, event_id, case when event_type = 'error' then 'D' else 'U' end as op from events
union all select 'without', event_id, 'U' from events where event_type <> 'error'""")
def cdc_soft_delete(spark, sf):
    e = table(spark, sf, "events").withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts")))
    pick = lambda mode, keep: ig.cdc_soft_delete(e, "deleted_at", keep).select(F.lit(mode).alias("mode"), "event_id", F.col("_op").alias("op"))
    return pick("with", True).unionByName(pick("without", False))


@query("I09", "cdc_log_based", """
select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_id > 3000 group by 1""")
def cdc_log_based(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return ig.cdc_log_based(e, ["user_id"], "event_id", 3000)


@query("I10", "cdc_apply", """
with cur as (select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_type = 'signup' group by 1),
ch as (select user_id, max(event_id) as event_id, arg_max(value, event_id) as value, arg_max(event_type, event_id) as op from events where event_type in ('view','error') group by 1)
select user_id, arg_max(event_id, event_id) as event_id, arg_max(value, event_id) as value
from (select user_id, event_id, value, 'keep' as op from cur union all select * from ch) group by 1 having arg_max(op, event_id) <> 'error'""")
def cdc_apply(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    cur = ig.latest_per_key(e.where("event_type = 'signup'").drop("event_type"), ["user_id"], F.col("event_id"))
    ch = e.where("event_type in ('view', 'error')").withColumn("_op", F.when(F.col("event_type") == "error", "D").otherwise("U"))
    return ig.cdc_apply(cur, ch, ["user_id"], "event_id")


@query("W11", "dedup_columns", """
select user_id, event_type, max(event_id) as event_id, max(ts) as ts from events group by 1, 2""")
def dedup_columns(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return ig.latest_per_key(e, ["user_id", "event_type"], F.struct("ts", "event_id"))


@query("I11", "partitioned_extract", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice from lineitem""")
def partitioned_extract(spark, sf):
    parts = ig.partitioned_extract(table(spark, sf, "lineitem"), 48, "l_orderkey")
    return reduce(DataFrame.unionByName, parts).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query("I12", "schema_drift", """
with f as (select 'id' as field, 'BIGINT' as dtype, count(*) as n from fx_dirty union all select 'custkey', 'BIGINT', count(custkey) from fx_dirty
 union all select 'amount', 'BIGINT', count(try_cast(amount_text as bigint)) from fx_dirty
 union all select 'amount', 'STRING', count(*) filter (try_cast(amount_text as bigint) is null) from fx_dirty union all select 'email', 'STRING', count(*) from fx_dirty),
e as (select * from (values ('id','BIGINT'),('custkey','BIGINT'),('amount','BIGINT'),('phone','STRING')) e(field, expected))
select field, expected, dtype, coalesce(n, 0) as n, case when expected is null then 'added' when dtype is null then 'removed'
 when dtype <> expected then 'type_changed' else 'same' end as status, 'warn' as action from f full join e using (field)""", "fx_dirty")
def schema_drift(spark, sf):
    d = fixture(spark, sf, "fx_dirty")
    number = F.col("amount_text").try_cast("bigint")
    doc = F.concat(F.lit('{"id":'), F.col("id"), F.lit(',"custkey":'), F.coalesce(F.col("custkey").cast("string"), F.lit("null")),
                   F.lit(',"email":"'), "email", F.lit('","amount":'),
                   F.when(number.isNull(), F.concat(F.lit('"'), "amount_text", F.lit('"'))).otherwise(number.cast("string")), F.lit("}"))
    return ig.schema_drift(d.select(doc.alias("doc")), "doc", {"id": "BIGINT", "custkey": "BIGINT", "amount": "BIGINT", "phone": "STRING"})


@query("I12", "append_with_drift", """
with o as (select o_orderkey, o_orderstatus, o_orderpriority, o_orderstatus = 'F' as second from orders),
a as (select unnest(['evolve', 'ignore', 'warn']) as action)
select action, o_orderkey::bigint as o_orderkey, case when second and action = 'evolve' then null else o_orderstatus end as o_orderstatus,
 case when second and action = 'evolve' then o_orderpriority end as priority, 0 as notes from o, a where action = 'evolve'
union all select action, o_orderkey, case when second then null else o_orderstatus end, null, 0 from o, a where action <> 'evolve'
union all select action, null, null, null, case action when 'warn' then 3 else 0 end from a""")
def append_with_drift(spark, sf):
    """A second delivery without the status, with a wider key and a new column, under each way to meet it."""
    o = table(spark, sf, "orders")
    out = []
    for action in ("evolve", "ignore", "warn"):
        path = scratch_path(spark, f"drift-{action}")
        files.append_drifting(o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").cast("int").alias("o_orderkey"), "o_orderstatus"), path, action)
        files.append_drifting(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_orderpriority").alias("priority")), path, action)
        rows = files.read_drifting(spark, path)
        if "priority" not in rows.columns:
            rows = rows.withColumn("priority", F.lit(None).cast("string"))
        out.append(rows.select(F.lit(action).alias("action"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "priority", F.lit(0).alias("notes")))
        out.append(files.drift_notes(spark, path).agg(F.count("*").cast("int").alias("notes")).select(
            F.lit(action).alias("action"), F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(None).cast("string").alias("o_orderstatus"), F.lit(None).cast("string").alias("priority"), "notes"))
    return reduce(DataFrame.unionByName, out)


@query("I13", "schema_map_normalize", """
select o_orderkey as order_id, floor(o_totalprice)::bigint as price, try_cast(split_part(o_orderpriority, '-', 1) as int) as priority,
 cast(o_orderdate as date) as order_date from orders""")
def schema_map_normalize(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").cast("string").alias("o_totalprice"),
                                          F.split("o_orderpriority", "-")[0].alias("o_orderpriority"), "o_orderdate")
    return ig.map_schema(o, {"o_orderkey": "order_id", "o_totalprice": "price", "o_orderpriority": "priority", "o_orderdate": "order_date"},
                         {"price": "bigint", "priority": "int", "order_date": "date"})


@query("S15", "dead_letter_split", """
select case when try_cast(amount_text as bigint) is null or custkey is null then 'error' else 'good' end as part, id, amount_text from fx_dirty""", "fx_dirty")
def dead_letter_split(spark, sf):
    d = fixture(spark, sf, "fx_dirty")
    bad = F.col("amount_text").try_cast("bigint").isNull() | F.col("custkey").isNull()
    good, err = ig.dead_letter_split(d, bad)
    return good.select(F.lit("good").alias("part"), "id", "amount_text").unionByName(
        err.select(F.lit("error").alias("part"), "id", "amount_text"))


@query("S09", "read_write_formats", """
select f.fmt, o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders, (values ('parquet'),('csv'),('json'),('orc')) f(fmt)""")
def read_write_formats(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = None
    for fmt, codec in (("parquet", "snappy"), ("csv", "gzip"), ("json", "none"), ("orc", "zstd")):
        path = scratch_path(spark, f"fmt-{fmt}")
        files.write(o, path, fmt, codec, "overwrite")
        back = files.read(spark, path, fmt, o.schema).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query("S10", "write_partitioned", """
select year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, hour(ts)::int as hour, count(*) as n, round(sum(value), 4) as total from events group by all""")
def write_partitioned(spark, sf):
    path = scratch_path(spark, "layout")
    parts = ["year", "month", "day", "hour"]
    files.write(files.with_time_parts(table(spark, sf, "events"), "ts"), path, partition_by=parts, max_file_size_mb=64)
    return spark.read.parquet(path).groupBy(*parts).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("S11", "write_mode_append_overwrite", """
select 'append' as mode, o_orderstatus, 2 * count(*) as n from orders group by 2 union all select 'overwrite', o_orderstatus, count(*) from orders group by 2""")
def write_mode_append_overwrite(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    out = []
    for mode in ("append", "overwrite"):
        path = scratch_path(spark, mode)
        files.write(o, path, mode=mode)
        files.write(o, path, mode=mode)
        out.append(spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("mode", F.lit(mode)))
    return out[0].unionByName(out[1])


@query("S12", "upsert_merge", """
select o_orderkey, case when o_orderstatus = 'F' then 'new' else 'old' end as version from orders where o_orderstatus <> 'P' or o_orderpriority = '5-LOW'""")
def upsert_merge(spark, sf):
    o = table(spark, sf, "orders")
    existing = o.where("o_orderstatus <> 'P' or o_orderpriority = '5-LOW'").select("o_orderkey", F.lit("old").alias("version"))
    incoming = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("new").alias("version"))
    return ig.upsert(existing, incoming, ["o_orderkey"])


@query("I14", "run_job_spec", """
with k as (select user_id, event_type, max(event_id) as event_id from events where ts > timestamp '2024-01-10' - interval 60 minute and value >= 1 and event_type <> 'error' group by 1, 2)
select event_type, count(*) as n, sum(event_id)::bigint as ids, '2024-01-30' as watermark_day, 'aws' as source from k group by 1""")
def run_job_spec(spark, sf):
    from metasift.operators.jobspecs import run_job

    spec = {
        "job_id": "job-7", "source_type": "aws", "extraction_mode": "incremental", "watermark_column": "ts", "watermark_type": "timestamp",
        "last_watermark": "2024-01-10 00:00:00", "lookback_minutes": 60, "where_clause": "value >= 1",
        "include_columns": ["event_id", "user_id", "event_type", "ts"], "dedup_columns": ["user_id", "event_type"],
        "file_format": "parquet", "compression": "zstd", "write_mode": "overwrite", "add_metadata_cols": True,
    }
    checks = [dq.not_in_set("event_type", ["error"], severity="quarantine")]
    path = scratch_path(spark, "job")
    mark = run_job(table(spark, sf, "events"), spec, path, checks)
    out = spark.read.parquet(path + "/clean")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"),
                                         F.first("_source_type").alias("source")).withColumn("watermark_day", F.lit(str(mark)[:10]))


def spec_of(**fields):
    return {"job_id": "job-7", "source_type": "aws", "file_format": "parquet", "compression": "zstd", "write_mode": "overwrite", "add_metadata_cols": False} | fields


@query("I14", "run_job_log_based", """
select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_id > 100 group by 1""")
def run_job_log_based(spark, sf):
    from metasift.operators.jobspecs import run_job

    path = scratch_path(spark, "job")
    spec = spec_of(extraction_mode="cdc", cdc_mode="log_based", key_columns=["user_id"], lsn_column="event_id", last_lsn=100, max_file_size_mb=64)
    run_job(table(spark, sf, "events"), spec, path)
    return spark.read.parquet(path + "/clean").select("user_id", "event_id", "value")


@query("I14", "run_job_soft_delete", """
select o_orderkey, case when o_orderstatus = 'F' then 'D' else 'U' end as op, 'clean' as part from orders where o_custkey is not null and o_orderkey % 7 <> 0
union all select o_orderkey, case when o_orderstatus = 'F' then 'D' else 'U' end, 'held' from orders where o_custkey is not null and o_orderkey % 7 = 0""")
def run_job_soft_delete(spark, sf):
    from metasift.operators.jobspecs import run_job

    path = scratch_path(spark, "job")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("gone"),
                                          F.when(F.col("o_orderkey") % 7 != 0, "c").alias("clerk"), F.lit(1).alias("extra"))
    spec = spec_of(extraction_mode="cdc", cdc_mode="query_based", deleted_at_column="gone", where_clause="o_custkey is not null", null_check_columns=["clerk"],
                   row_count_min=1, expected_columns=["o_orderkey", "o_custkey", "gone", "clerk"], schema_drift_action="ignore")
    run_job(o, spec, path)
    part = lambda p: spark.read.parquet(f"{path}/{p}").select("o_orderkey", F.col("_op").alias("op"))
    return part("clean").withColumn("part", F.lit("clean")).unionByName(part("quarantine").withColumn("part", F.lit("held")))


@query("S12", "upsert_touched_partitions", """
select o_orderstatus, o_orderkey, case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'new' else 'old' end as version from orders
union all select 'F', -o_orderkey, 'new' from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0""")
def upsert_touched_partitions(spark, sf):
    path = scratch_path(spark, "merged")
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.lit("old").alias("version"))
    keys = {"keys": ["o_orderstatus", "o_orderkey"], "partition_by": ["o_orderstatus"]}
    files.merge(o, path, **keys)
    new = o.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("version", F.lit("new"))
    files.merge(new.unionByName(new.withColumn("o_orderkey", -F.col("o_orderkey"))), path, **keys)
    return files.read(spark, path, "parquet", o.schema)


@query("I14", "run_job_bounded_checks", """
select event_id, user_id from events where ts > timestamp '2024-01-10' and ts <= timestamp '2024-01-20'
union all select -1, count(*) from events where ts > timestamp '2024-01-10' and ts <= timestamp '2024-01-20' having count(*) > 0""")
def run_job_bounded_checks(spark, sf):
    """An upper bound, and a job that only runs because its checks hold; broken ones leave the sink alone."""
    from metasift.operators.jobspecs import run_job

    path = scratch_path(spark, "job")
    e = table(spark, sf, "events")
    spec = spec_of(extraction_mode="incremental", watermark_column="ts", last_watermark="2024-01-10 00:00:00", upper_bound_column="ts", upper_bound_value="2024-01-20 00:00:00",
                   row_count_min=1, row_count_max=10**12, not_empty_columns=["user_id", "value"], custom_checks=["event_id < 0", "event_type is null"])
    run_job(e, spec, path)
    failed = 0
    for broken in ({"row_count_max": 1}, {"row_count_min": 10**12}, {"custom_checks": ["event_id >= 0"]}):
        try:
            run_job(e, spec | broken, path)
        except ValueError:
            failed += 1
    rows = spark.read.parquet(path + "/clean").select("event_id", "user_id")
    return rows.unionByName(rows.agg(F.lit(-1).cast("bigint").alias("event_id"), F.count("*").alias("user_id"))) if failed == 3 else rows


@query("I14", "run_job_trigger", """
select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where event_id > 50 group by 1""")
def run_job_trigger(spark, sf):
    from metasift.operators.jobspecs import run_job

    path = scratch_path(spark, "job")
    spec = spec_of(extraction_mode="cdc", cdc_mode="trigger", key_columns=["user_id"], lsn_column="event_id", last_lsn=50)
    run_job(table(spark, sf, "events").select("user_id", "event_id", "event_type"), spec, path)
    return spark.read.parquet(path + "/clean")


@query("I14", "run_job_merge", """
select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1""")
def run_job_merge(spark, sf):
    from metasift.operators.jobspecs import run_job

    path = scratch_path(spark, "job")
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    spec = spec_of(write_mode="merge", key_columns=["user_id"], dedup_columns=["user_id"], watermark_column="event_id", watermark_type="integer", extraction_mode="incremental")
    # Two runs; the second goes on after the first one's mark and meets its users again.
    middle = e.agg(F.expr("cast(avg(event_id) as bigint)")).first()[0]
    mark = run_job(e.where(F.col("event_id") <= middle), spec, path)
    run_job(e, spec | {"last_watermark": str(mark)}, path)
    return spark.read.parquet(path + "/clean")
