"""Streaming queries: events replayed through file streams, results read back from the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.operators import quality as dq
from metasift.plans.catalog import fixture, query, table
from metasift.plans.detection import TXT, hits_sql
from metasift.session import scratch_path
from metasift.streaming import streams as st


def events(spark, sf):
    schema = table(spark, sf, "events").schema
    return st.event_stream(spark, sf, schema, "events.parquet")


def spots(spark, name, n):
    """Fresh sink and checkpoint folders for one run."""
    root = scratch_path(spark, name)
    return [f"{root}/{i}" for i in range(n)]


@query("T01", "stream_ingest_events", """
select year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, event_type, count(*) as n, sum(event_id)::bigint as ids from events group by all""")
def stream_ingest_events(spark, sf):
    sink, ck = spots(spark, "bronze", 2)
    st.ingest_events(events(spark, sf), sink, ck)
    return spark.read.parquet(sink).groupBy("year", "month", "day", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("T02", "stream_watermark_dedup", "select event_id, user_id, event_type from events")
def stream_watermark_dedup(spark, sf):
    src, sink, ck = spots(spark, "dedup", 3)
    e = table(spark, sf, "events")
    e.unionByName(e).repartition(4).write.parquet(src)
    st.dedup_events(st.event_stream(spark, src, e.schema), sink, ck)
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


@query("T03", "tumbling_window_agg", """
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def tumbling_window_agg(spark, sf):
    sink, ck = spots(spark, "windows", 2)
    st.tumbling_counts(events(spark, sf), sink, ck)
    w = st.latest_windows(spark.read.parquet(sink))
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("T04", "late_data_split", """
with m as (select max(ts) - interval 60 minute as floor from events where event_type <> 'error')
select event_id, case when event_type = 'error' and ts < (select floor from m) then 'late' else 'on_time' end as part from events""")
def late_data_split(spark, sf):
    src, sink, late, ck = spots(spark, "late", 4)
    e = table(spark, sf, "events")
    # Two arrivals and a restart in between: errors come after everything else.
    for part in (e.where("event_type <> 'error'"), e.where("event_type = 'error'")):
        part.write.mode("append").parquet(src)
        st.late_split(st.event_stream(spark, src, e.schema), sink, late, ck, 60)
    return spark.read.parquet(sink).select("event_id", F.lit("on_time").alias("part")).unionByName(
        spark.read.parquet(late).select("event_id", F.lit("late").alias("part")))


@query("T05", "stream_incremental_state", "select event_type as source, max(ts) as watermark from events group by 1")
def stream_incremental_state(spark, sf):
    src, ck = spots(spark, "marks", 2)
    e = table(spark, sf, "events")
    for part in (e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")):
        part.write.mode("append").parquet(src)
        st.incremental_state(st.event_stream(spark, src, e.schema), ck)
    return st.current_state(spark, ck)


@query("T06", "stream_cdc_upsert", """
select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1 having arg_max(event_type, event_id) <> 'error'""")
def stream_cdc_upsert(spark, sf):
    src, out, ck = spots(spark, "upsert", 3)
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    for part in (e.where("event_type not in ('view', 'error')"), e.where("event_type in ('view', 'error')")):
        part.write.mode("append").parquet(src)
        st.cdc_upsert(st.event_stream(spark, src, e.schema), out, ck, ["user_id"], "event_id", "event_type = 'error'")
    return st.current_table(spark, out).select("user_id", "event_id", "value")


def checks():
    return [dq.between("value", 1, 60, severity="quarantine"), dq.in_set("event_type", ["view", "click", "purchase", "signup"], severity="warn")]


@query("T07", "stream_dq_quarantine", """
select event_id, case when value not between 1 and 60 then 'held' else 'clean' end as part,
 array_to_string(list_filter([case when value not between 1 and 60 then 'quarantine:between:value' end, case when event_type = 'error' then 'warn:in_set:event_type' end], lambda x: x is not null), '|') as codes from events""")
def stream_dq_quarantine(spark, sf):
    clean, held, ck = spots(spark, "dq", 3)
    st.quarantine(events(spark, sf), clean, held, ck, checks())
    pick = lambda p, part: spark.read.parquet(p).select("event_id", F.lit(part).alias("part"), F.array_join("codes", "|").alias("codes"))
    return pick(clean, "clean").unionByName(pick(held, "held"))


@query("T08", "stream_detect_payloads", f"""
with {TXT} select payload_id, 'framework' as category, label from {hits_sql(rules.FRAMEWORK_RULES, 'x')} union all select payload_id, 'source', label from {hits_sql(rules.SOURCE_RULES, 'x')}
union all select payload_id, 'ingestion', label from {hits_sql(rules.INGESTION_RULES, 'x')} union all select payload_id, 'dq_rules', label from {hits_sql(rules.SQL_CHECK_RULES, 'x')}
union all select payload_id, 'dq_rules', label from {hits_sql(rules.DQ_TOOL_RULES, 'x')}""", "fx_payload")
def stream_detect_payloads(spark, sf):
    src, sink, ck = spots(spark, "payloads", 3)
    fixture(spark, sf, "fx_payload").repartition(8).write.json(src)
    st.detect_payloads(spark, src, "payload_id bigint, metadata string, config string, raw_json string", sink, ck)
    return spark.read.parquet(sink).select("payload_id", "category", "label")


@query("T09", "stream_monitor_metrics", """
select event_type, count(*) as rows, count(*) filter (value not between 1 and 60) as breaches from events group by 1""")
def stream_monitor_metrics(spark, sf):
    out, sink, ck = spots(spark, "metrics", 3)
    st.monitor(events(spark, sf), out, sink, ck, checks()[:1], ["view", "click", "purchase", "signup", "error"])
    m = spark.read.parquet(sink)
    return m.groupBy("event_type").agg(F.sum("rows").alias("rows"), F.sum("between_value").alias("breaches"))
