"""Activity-graph and pipeline-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import text as tx
from metasift.operators import activities as ac
from metasift.operators import payload as pl
from metasift.operators import reports as rp
from metasift.plans.catalog import fixture, query
from metasift.session import cut_lineage, shuffled

ACT = "fx_activity"
P = "pipeline_id"
NOTE = "type = 'Office365Email'"


def activities(spark, sf):
    a = fixture(spark, sf, ACT)
    none = F.lit(None).cast("string")
    return a.select(P, "idx", "name", "type", F.array_compact(F.array("depends_on")).alias("deps"), "src", "sink",
                    none.alias("url"), none.alias("method"))


def flagged(spark, sf):
    a = cut_lineage(ac.order_activities(activities(spark, sf)))
    e = cut_lineage(ac.dependency_edges(a))
    return a, e, cut_lineage(ac.terminal_and_roots(a, e))


EDGES = """e as materialized (select a.pipeline_id, b.idx as from_idx, a.depends_on as from_name, a.idx as to_idx, a.name as to_name
 from fx_activity a join fx_activity b on a.pipeline_id = b.pipeline_id and a.depends_on = b.name)"""
LEVELS = """lv(pipeline_id, idx, level) as (select pipeline_id, idx, 0 from fx_activity where depends_on is null
 union all select e.pipeline_id, e.to_idx, lv.level + 1 from lv join e on e.pipeline_id = lv.pipeline_id and e.from_idx = lv.idx)"""


@query("R03", "order_activities", f"""
with recursive {EDGES}, {LEVELS}
select pipeline_id, idx::int as idx, row_number() over (partition by pipeline_id order by level, idx)::int as pos, level, false as cyclic from lv""", ACT)
def order_activities(spark, sf):
    return ac.order_activities(activities(spark, sf)).select(P, "idx", "pos", "level", "cyclic")


@query("X04", "kahn_order", f"""
with recursive {EDGES}, {LEVELS}
select pipeline_id, count(*) as n, sum(idx * row)::bigint as checksum from (select *, row_number() over (partition by pipeline_id order by level, idx) as row from lv) group by 1""", ACT)
def kahn_order(spark, sf):
    return ac.order_activities(activities(spark, sf)).groupBy(P).agg(
        F.count("*").alias("n"), F.sum(F.col("idx").cast("bigint") * F.col("pos")).alias("checksum"))


@query("W06", "activity_level", f"""
with recursive {EDGES}, {LEVELS} select pipeline_id, idx::int as idx, level, false as cyclic from lv""", ACT)
def activity_level(spark, sf):
    return ac.order_activities(activities(spark, sf)).select(P, "idx", "level", "cyclic")


@query("R04", "dependency_edges", f"with {EDGES} select pipeline_id, from_name, to_name from e", ACT)
def dependency_edges(spark, sf):
    return ac.dependency_edges(activities(spark, sf)).select(P, "from_name", "to_name")


@query("W08", "terminal_and_root_nodes", f"""
with {EDGES} select pipeline_id, idx, not exists (select 1 from e where e.pipeline_id = a.pipeline_id and e.from_idx = a.idx) as terminal,
 depends_on is null as root from fx_activity a""", ACT)
def terminal_and_root_nodes(spark, sf):
    a = activities(spark, sf)
    return ac.terminal_and_roots(a, ac.dependency_edges(a)).select(P, "idx", "terminal", "root")


CAND = """c as (select pipeline_id, min(idx) as pos, source_type, service_name, path from (
 select pipeline_id, idx, case when type = 'WebActivity' then 'API' when src like '%Lakehouse%' then 'File' end as source_type,
 case when type = 'WebActivity' then 'REST API' when src like '%Lakehouse%' then 'Lakehouse' end as service_name,
 case when type <> 'WebActivity' then json_extract_string(src, '$.path') end as path
 from fx_activity where type = 'WebActivity' or src is not null) group by 1, 3, 4, 5)"""


@query("R05", "source_candidates", f"with {CAND} select pipeline_id, pos::int as pos, source_type, service_name, path from c", ACT)
def source_candidates(spark, sf):
    return ac.source_candidates(ac.order_activities(activities(spark, sf))).select(P, "pos", "source_type", "service_name", "path")


@query("R07", "merge_source_candidates", f"""
with {CAND}, w as (select *, case when path is null then '{{}}' else '{{"path":"' || path || '"}}' end as detail from c),
p as (select distinct pipeline_id from fx_activity)
select p.pipeline_id, case when count(distinct source_type) = 1 then min(source_type) when count(distinct source_type) > 1 then 'Mixed' end as source_type,
 case when count(distinct service_name) = 1 then min(service_name) when count(distinct service_name) > 1 then 'Mixed' end as service_name, count(pos) as sources,
 case count(pos) when 0 then '{{}}' when 1 then min(detail) else '{{"sources":[' || string_agg(detail, ',' order by pos) || ']}}' end as connection_details
from p left join w on w.pipeline_id = p.pipeline_id group by 1""", ACT)
def merge_source_candidates(spark, sf):
    ordered = ac.order_activities(activities(spark, sf))
    return ac.merge_candidates(ac.source_candidates(ordered), ordered.select(P).distinct())


@query("R08", "classify_dataset", """
select pipeline_id, idx, case when src like '%Lakehouse%' then 'File' end as source_type, case when src like '%Lakehouse%' then 'Lakehouse' end as service_name,
 json_extract_string(src,'$.path') as path, 'DB' as sink_type, 'Database' as sink_service, json_extract_string(sink,'$.table') as sink_table
from fx_activity where src is not null""", ACT)
def classify_dataset(spark, sf):
    a = activities(spark, sf).where("src is not null").select(P, "idx", ac.classify_dataset(F.col("src")).alias("a"), ac.classify_dataset(F.col("sink")).alias("b"))
    return a.select(P, "idx", "a.source_type", "a.service_name", "a.path", F.col("b.source_type").alias("sink_type"),
                    F.col("b.service_name").alias("sink_service"), F.col("b.table").alias("sink_table"))


@query("R06", "payload_source_fallback", """
select payload_id, case when u like 'abfss%' then 'File' when u like 'http%' then 'API' when j is not null then 'DB' end as source_type,
 case when u like 'abfss%' then 'ADLS Gen2' when u like 'http%' then 'REST API' when j is not null then upper(split_part(j, ':', 2)) end as service_name,
 case when u like 'abfss%' then split_part(u,'@',2) || '.dfs.core.windows.net' when u like 'http%' then u else j end as endpoint
from (select payload_id, json_extract_string(config,'$.input') as u, case when config like '%"jdbc:%' then regexp_extract(config, 'jdbc:[a-z0-9]+://[^"]+') end as j from fx_payload)""", "fx_payload")
def payload_source_fallback(spark, sf):
    p = pl.with_text(fixture(spark, sf, "fx_payload")).select("payload_id", ac.payload_candidate(F.col("txt")).alias("g"))
    return p.select("payload_id", "g.source_type", "g.service_name", "g.endpoint")


AUTH_WORDS = ["ManagedIdentity", "Managed Identity", "OAuth2", "oauth", "apiKey", "API_KEY", "Basic", "connectionName", "none", "key"]


@query("R09", "detect_auth", """
with t as (select payload_id, lower(raw_json || ([{0}])[payload_id % 10 + 1] || ' ' || ([{0}])[payload_id // 10 % 10 + 1]) as s from fx_payload)
select payload_id, case when contains(s, 'managedidentity') or contains(s, 'managed identity') then 'Managed Identity' when contains(s, 'oauth') then 'OAuth'
 when contains(s, 'apikey') or contains(s, 'api_key') then 'Key' when contains(s, 'basic') then 'Basic' when contains(s, 'connection') then 'Connection Reference' end as auth from t""".format(
    ", ".join(f"'{w}'" for w in AUTH_WORDS)), "fx_payload")
def detect_auth(spark, sf):
    words, n = F.array(*[F.lit(w) for w in AUTH_WORDS]), F.col("payload_id")
    pick = lambda i: F.element_at(words, (F.pmod(i, F.lit(10)) + 1).cast("int"))
    text = F.concat("raw_json", pick(n), F.lit(" "), pick(F.floor(n / 10)))
    return fixture(spark, sf, "fx_payload").select("payload_id", ac.detect_auth(text).alias("auth"))


@query("R11", "detect_mode", """
select payload_id, case when metadata like '%kafka%' then 'streaming' else 'batch' end as mode from fx_payload""", "fx_payload")
def detect_mode(spark, sf):
    return pl.with_text(fixture(spark, sf, "fx_payload")).select("payload_id", ac.detect_mode(F.col("txt")).alias("mode"))


def adf(spark, sf):
    return ac.adf_definitions(fixture(spark, sf, "fx_adf"))


@query("R12", "detect_trigger_frequency", """
select payload_id as pipeline_id, case when payload_id % 3 = 0 then 'tumbling' else 'schedule' end as trigger_type,
 case when payload_id % 3 = 0 then '0 2 * * *' else 'Day' end as frequency from fx_adf""", "fx_adf")
def detect_trigger_frequency(spark, sf):
    return ac.detect_trigger(adf(spark, sf))


DEST = f"""t as (select a.*, (a.pipeline_id, a.idx) not in (select pipeline_id, from_idx from e) as terminal,
 case when sink is not null then json_extract_string(sink,'$.table') when type = 'TridentNotebook' then name end as label from fx_activity a where type <> 'Office365Email'),
g as (select pipeline_id, count(*) filter (terminal and label is not null) as n1, max(idx) filter (label is not null) as last from t group by 1),
d as (select t.pipeline_id, idx as pos, coalesce(label, name) as label from t join g using (pipeline_id)
 where case when n1 > 0 then terminal and label is not null when last is not null then idx = last else terminal and label is null and type <> 'IfCondition' end)"""


@query("R10", "detect_destination", f"with {EDGES}, {DEST} select pipeline_id, pos::int as pos, label from d", ACT)
def detect_destination(spark, sf):
    return ac.destinations(flagged(spark, sf)[2])


@query("R13", "detect_data_format", """
select 'activity' as part, pipeline_id, format, min(k)::int as at_pos from (
 select pipeline_id, idx * 2 as k, json_extract_string(src,'$.type') as format from fx_activity where src is not null
 union all select pipeline_id, idx * 2 + 1, json_extract_string(sink,'$.type') from fx_activity where sink is not null) group by 2, 3
union all select 'payload', payload_id, unnest(string_split(case when raw_json like '%f.csv%' then 'gzip,CSV' else 'gzip' end, ',')), 0 from fx_adf""", (ACT, "fx_adf"))
def detect_data_format(spark, sf):
    rows = ac.data_formats(ac.order_activities(activities(spark, sf))).select(F.lit("activity").alias("part"), P, "format", F.col("at").alias("at_pos"))
    texts = adf(spark, sf).select(P, F.explode(ac.text_formats(F.col("txt"), F.lit("gzip"))).alias("format"))
    return rows.unionByName(texts.select(F.lit("payload").alias("part"), P, "format", F.lit(0).alias("at_pos")))


KIND = "case when type = 'IfCondition' then 'validation' when type = 'Copy' then 'ingestion' else 'process' end"
GRAPH = f"""s as (select pipeline_id, row_number() over (partition by pipeline_id order by pos) as i from c),
k as (select * from fx_activity where type <> 'Office365Email'),
ke as materialized (select e.* from e join k a on a.pipeline_id = e.pipeline_id and a.idx = e.from_idx join k b on b.pipeline_id = e.pipeline_id and b.idx = e.to_idx),
r as (select pipeline_id, name, row_number() over (partition by pipeline_id order by idx) as i from k
 left join (select distinct pipeline_id, to_idx as idx, true as fed from ke) x using (pipeline_id, idx) where fed is null)"""


@query("R15", "flow_graph", f"""
with {EDGES}, {CAND}, {GRAPH}
select 'node' as part, pipeline_id, 'source_' || i as a, 'source' as b from s
union all select 'node', pipeline_id, name, {KIND} from k
union all select 'edge', pipeline_id, 'source_' || s.i, r.name from s join r using (pipeline_id, i)
union all select 'edge', pipeline_id, from_name, to_name from ke""", ACT)
def flow_graph(spark, sf):
    a, e, f = flagged(spark, sf)
    nodes, edges = ac.flow_graph(f, e, ac.source_candidates(a))
    return nodes.select(F.lit("node").alias("part"), P, F.col("node_id").alias("a"), F.col("node_type").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("part"), P, F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@query("R16", "flow_text", f"""
with {EDGES}, {CAND}, {DEST},
x as (select pipeline_id, string_agg(coalesce(service_name, path, 'Source'), ', ' order by pos) as t from c group by 1),
y as (select pipeline_id, string_agg(name, ' -> ' order by idx) as t from fx_activity where type <> 'Office365Email' group by 1),
z as (select pipeline_id, string_agg(label, ', ' order by pos) as t from d group by 1)
select p.pipeline_id, coalesce(x.t, 'No explicit source') || ' -> ' || coalesce(y.t, 'pipe_' || p.pipeline_id) || ' -> ' || coalesce(z.t, 'no explicit sink')
 || case when bool_or_if then ' with validation gates' else '' end as text
from (select pipeline_id, bool_or(type = 'IfCondition') as bool_or_if from fx_activity group by 1) p
left join x using (pipeline_id) left join y using (pipeline_id) left join z using (pipeline_id)""", ACT)
def flow_text(spark, sf):
    a, e, f = flagged(spark, sf)
    pipes = a.groupBy(P).agg(F.concat(F.lit("pipe_"), F.col(P)).alias("pipeline_name"))
    gated = a.where("type = 'IfCondition'").select(P).distinct()
    return ac.flow_text(pipes, a, ac.source_candidates(a), ac.destinations(f), gated)


@query("R17", "loading_flow", f"""
with {EDGES}, {CAND}, {DEST},
st as (select pipeline_id, 0 as ph, pos as k, 0 as sub, 'SOURCE' as s, 'REST API' as l from c where source_type = 'API'
 union all select pipeline_id, 1, idx, 0, 'SOURCE', json_extract_string(src,'$.path') from fx_activity where src is not null
 union all select pipeline_id, 2, idx, 0, 'SOURCE', name from fx_activity where type = 'WebActivity'
 union all select pipeline_id, 2, idx, 2, 'TRANSFORMATION', name from fx_activity where type in ('TridentNotebook','Script')
 union all select pipeline_id, 2, idx, 3, 'DESTINATION', json_extract_string(sink,'$.table') from fx_activity where sink is not null),
u as (select pipeline_id, s, l, min(ph * 1000000 + k * 10 + sub) as o from st group by 1, 2, 3),
f as (select pipeline_id, 'DESTINATION' as s, string_agg(label, ', ' order by pos) as l, 999999999 as o from d where pipeline_id not in (select pipeline_id from u where s = 'DESTINATION') group by 1)
select pipeline_id, string_agg(s || ': ' || l, ' -> ' order by o) as text from (select pipeline_id, s, l, o from u union all select pipeline_id, s, l, o from f) group by 1""", ACT)
def loading_flow(spark, sf):
    a, e, f = flagged(spark, sf)
    return ac.loading_flow(a, ac.source_candidates(a), ac.destinations(f))


@query("R18", "ingestion_details", """
with a as (select pipeline_id, bool_or(type = 'WebActivity') as api, bool_or(src is not null) as file, bool_or(sink is not null) as db,
 min(idx) filter (src like '%Delimited%') as d, min(idx) filter (src like '%Parquet%') as p from fx_activity group by 1)
select 'details' as part, pipeline_id, array_to_string(list_filter([case when api then 'API' end, case when file then 'File-based' end, case when db then 'Database' end], lambda x: x is not null), '|') as types,
 case when d is null and p is null then case when api then 'JSON' else '' end when p is null then 'DelimitedText' when d is null then 'Parquet'
 when d < p then 'DelimitedText|Parquet' else 'Parquet|DelimitedText' end as files from a
union all select 'delimiter', payload_id, ';', null from fx_adf where raw_json like '%columnDelimiter%'""", (ACT, "fx_adf"))
def ingestion_details(spark, sf):
    a = ac.order_activities(activities(spark, sf))
    pipes = a.groupBy(P).agg(F.lit("").alias("definition"))
    d = ac.ingestion_details(a, pipes).select(F.lit("details").alias("part"), P, F.array_join("ingestion_types", "|").alias("types"),
                                              F.array_join("file_types_in", "|").alias("files"))
    return d.unionByName(ac.delimiters(adf(spark, sf)).select(F.lit("delimiter").alias("part"), P, F.col("column_delimiter").alias("types"),
                                                              F.lit(None).cast("string").alias("files")))


@query("F14", "normalize_file_type", """
select pipeline_id, idx, case json_extract_string(src,'$.type') when 'DelimitedText' then 'DelimitedText' when 'Parquet' then 'Parquet' end as file_type from fx_activity""", ACT)
def normalize_file_type(spark, sf):
    return activities(spark, sf).select(P, "idx", tx.normalize_file_type(ac.member(F.upper("src"), "TYPE")).alias("file_type"))


@query("F15", "normalize_node_id", """
select pipeline_id, idx, regexp_replace(lower(trim(n)), '_?[0-9]+$', '') as norm from (select pipeline_id, idx, case idx % 4 when 0 then ' ' || upper(name) || ' '
 when 1 then type || idx when 2 then '12_' || type || '_v2x' else ' Step' || pipeline_id || '_' end as n from fx_activity)""", ACT)
def normalize_node_id(spark, sf):
    kind, idx = F.col("idx") % 4, F.col("idx").cast("string")
    n = (F.when(kind == 0, F.concat(F.lit(" "), F.upper("name"), F.lit(" "))).when(kind == 1, F.concat("type", idx))
         .when(kind == 2, F.concat(F.lit("12_"), "type", F.lit("_v2x"))).otherwise(F.concat(F.lit(" Step"), F.col(P), F.lit("_"))))
    return activities(spark, sf).select(P, "idx", tx.normalize_node_id(n).alias("norm"))


ADF_TEXT = """w as (select payload_id, regexp_extract(raw_json, '"name":"(pipe_[0-9]+)"', 1) as name, raw_json, config,
 case when raw_json like '%Lakehouse%' then 'Lakehouse' when raw_json like '%Blob%' then 'File' else 'File' end as svc from fx_adf),
v as (select *, case when config like '%lake_out%' then 'lake_out' else regexp_extract(raw_json, '"table":"([^"]+)"', 1) end as dest,
 case when raw_json like '%DelimitedText%' then 'Source' else svc end as label from w)"""


@query("R01", "adf_activity_report", f"""
with {ADF_TEXT} select payload_id as pipeline_id, name as pipeline_name, case when label = 'Source' then 'API' else 'Mixed' end as source_type,
 case when label = 'Source' then 'REST API' else 'Mixed' end as service_name, case when payload_id % 3 = 0 then 'Connection Reference' else 'Managed Identity' end as authentication_type,
 'batch' as mode, case when payload_id % 3 = 0 then 'tumbling' else 'schedule' end as trigger_type, dest as destination, 5::bigint as nodes, 3::bigint as edges,
 'REST API, ' || label || ' -> Fetch -> Load -> Check -> ' || dest || ' with validation gates' as text, 'API|File-based|Database' as types from v""", "fx_adf")
def adf_activity_report(spark, sf):
    p = adf(spark, sf)
    return report_row(ac.analyze_activities(p, ac.activities_of(p, "definition", "$.activities")))


def report_row(r):
    n = r["nodes"].groupBy(P).agg(F.count("*").alias("nodes"))
    e = r["edges"].groupBy(P).agg(F.count("*").alias("edges"))
    t = r["text"]
    d = r["details"].select(P, F.array_join("ingestion_types", "|").alias("types"))
    return r["report"].join(shuffled(n), P, "left").join(shuffled(e), P, "left").join(shuffled(t), P, "left").join(shuffled(d), P, "left").select(
        P, "pipeline_name", "source_type", "service_name", "authentication_type", "mode", "trigger_type", "destination", "nodes",
        "edges", "text", "types")


FABRIC = """f as (select pipeline_id, string_split(id, ' || ')[2] as name, configuration from fx_fabric
 where service = 'fabric_items' and regexp_matches(configuration, '"Type":"(DataPipeline|Pipeline)"'))"""


@query("R02", "fabric_activity_report", f"""
with {FABRIC} select pipeline_id, name as pipeline_name, 'File' as source_type, 'File' as service_name, null::varchar as authentication_type, 'batch' as mode, null::varchar as trigger_type,
 'Clean' as destination, 3::bigint as nodes, 2::bigint as edges, 'File -> Copy In -> Clean -> Clean' as text, 'File-based' as types from f""", "fx_fabric")
def fabric_activity_report(spark, sf):
    p = ac.fabric_definitions(fixture(spark, sf, "fx_fabric"))
    return report_row(ac.analyze_activities(p, ac.activities_of(p, "definition", ac.FABRIC_PATH)))


@query("R21", "analyze_activity_reports", f"""
with {ADF_TEXT}, {FABRIC}, t as (select payload_id as pipeline_id, 'REST API, ' || label || dest as sig from v union all select pipeline_id + 1000000000, 'fabric' from f)
select min(pipeline_id) as pipeline_id, count(*) as copies from t group by sig""", ("fx_adf", "fx_fabric"))
def analyze_activity_reports(spark, sf):
    one, two = adf(spark, sf), ac.fabric_definitions(fixture(spark, sf, "fx_fabric")).withColumn(P, F.col(P) + 1000000000)
    acts = ac.activities_of(one, "definition", "$.activities").unionByName(ac.activities_of(two, "definition", ac.FABRIC_PATH))
    r = ac.analyze_activities(one.unionByName(two), acts)
    return ac.structural_dedup(r["nodes"], r["edges"], r["text"], P)


@query("W02", "structural_dedup", """
with n as (select pipeline_id, case when type = 'IfCondition' then 'validation' when type = 'Copy' then 'ingestion' when type = 'Office365Email' then 'notification' else 'process' end as k, idx, depends_on from fx_activity),
s as (select pipeline_id, string_agg(k, ',' order by k) || '#' || count(depends_on) as sig from n group by 1)
select min(pipeline_id) as pipeline_id, count(*) as copies from s group by sig""", ACT)
def structural_dedup(spark, sf):
    a = activities(spark, sf)
    e = ac.dependency_edges(a)
    nodes = a.select(P, F.col("name").alias("node_id"), ac.node_type(F.col("type")).alias("node_type"))
    edges = e.select(P, F.col("from_name").alias("from_id"), F.col("to_name").alias("to_id"))
    texts = a.select(P, F.lit("same").alias("text")).distinct()
    return ac.structural_dedup(nodes, edges, texts, P)


CAP = "fx_capability"


def cap_tables(spark, sf):
    n = fixture(spark, sf, CAP)
    reports = n.groupBy("report_id").agg(F.lit("").alias("source_text"), F.count_if(F.col("node_id").like("if_condition%") & (F.col("report_id") % 2 == 0)).alias("rule_count"))
    return n, reports


CAPS_SQL = """g as (select report_id, bool_or(node_id like 'http%') as api, bool_or(node_id like '%csv%') as f, bool_or(node_id like '%table%') as d, bool_or(node_id like 'foreach%') as b,
 bool_or(node_id like 'event%') as s, bool_or(node_id like 'if_cond%') as c, bool_or(node_id like 'email%') as n from fx_capability group by 1),
m as (select report_id, unnest(['API Ingestion','File Ingestion','Database/Table Ingestion','Batch Processing','Streaming','Data Quality','Notifications']) as capability,
 unnest([case when api then 'SUPPORTED' else 'NOT_SUPPORTED' end, case when f then 'SUPPORTED' else 'NOT_SUPPORTED' end, case when d then 'SUPPORTED' else 'NOT_SUPPORTED' end,
 case when b then 'SUPPORTED' else 'NOT_SUPPORTED' end, case when s then 'SUPPORTED' else 'NOT_SUPPORTED' end,
 case when c and report_id % 2 = 0 then 'SUPPORTED' when c then 'PARTIAL' else 'NOT_SUPPORTED' end, case when n then 'SUPPORTED' else 'NOT_SUPPORTED' end]) as status from g)"""


@query("R19", "capability_matrix", f"with {CAPS_SQL} select report_id, capability, status from m", CAP)
def capability_matrix(spark, sf):
    return ac.capability_matrix(*cap_tables(spark, sf)).select("report_id", "capability", "status")


@query("A01", "capability_summary", f"""
with {CAPS_SQL} select report_id, count(*) filter (status = 'SUPPORTED') as supported_count, count(*) filter (status = 'NOT_SUPPORTED') as not_supported_count,
 count(*) filter (status = 'PARTIAL') as partial_count from m group by 1""", CAP)
def capability_summary(spark, sf):
    return ac.capability_summary(ac.capability_matrix(*cap_tables(spark, sf)))


REPORT = "fx_report"
FIELD_OF = """case node_type when 'source' then 'source_configs.source_type' when 'ingestion' then 'ingestion_configs.destination' when 'process' then 'flow.text' else 'dq_rules' end"""


@query("R20", "missing_fields", f"""
with have as (select distinct report_id, {FIELD_OF} as field from fx_report), r as (select distinct report_id from fx_report),
w as (select report_id, unnest([{", ".join(f"'{f}'" for f in ac.REPORT_REASONS)}]) as field from r)
select w.report_id, w.field, case when report_id % 2 = 0 and (w.field like '%trigger_type' or w.field like '%frequency') then 'recurrence' when report_id % 2 = 1 and w.field like '%endpoint' then 'web' else 'plain' end as why
from w anti join have using (report_id, field)""", REPORT)
def missing_fields(spark, sf):
    n = fixture(spark, sf, REPORT)
    reports = n.groupBy("report_id").agg(F.expr("if(report_id % 2 = 0, '{\"recurrence\":1}', '{\"type\":\"WebActivity\"}')").alias("original"))
    leaves = n.select("report_id", F.expr(FIELD_OF).alias("path"), F.lit('"x"').alias("value"))
    why = F.when(F.col("reason").startswith("Recurrence metadata"), "recurrence").when(F.col("reason").startswith("A WebActivity"), "web").otherwise("plain")
    return ac.report_missing_fields(reports, leaves).select("report_id", "field", why.alias("why"))


@query("D34", "adf_activity_extract", """
select 'source' as part, pipeline_id, arg_max(json_extract_string(src,'$.path'), idx) as a, arg_max(json_extract_string(src,'$.type'), idx) as b from fx_activity where type = 'Copy' group by 2
union all select 'activity', pipeline_id, name, type from fx_activity
union all select 'dq', pipeline_id, 'check_' || idx, type from fx_activity where type = 'IfCondition'""", ACT)
def adf_activity_extract(spark, sf):
    a = activities(spark, sf)
    named = a.withColumn("name", F.when(F.col("type") == "IfCondition", F.concat(F.lit("check_"), "idx")).otherwise(F.col("name")))
    src = rp.last_copy_source(a)
    return (src.select(F.lit("source").alias("part"), P, F.col("dataset").alias("a"), F.col("source_type").alias("b"))
            .unionByName(a.select(F.lit("activity").alias("part"), P, F.col("name").alias("a"), F.col("type").alias("b")))
            .unionByName(rp.dq_activities(named).select(F.lit("dq").alias("part"), P, F.col("name").alias("a"), F.col("type").alias("b"))))


@query("W05", "linear_chain_edges", """
with n as (select pipeline_id, max(idx) as n from fx_activity group by 1)
select pipeline_id, idx::int as seq, case when idx = 1 then 'source_1' else 'step_' || (idx - 1) end as from_id, 'step_' || idx as to_id from fx_activity
union all select pipeline_id, (n + 1)::int, 'step_' || n, 'sink_1' from n""", ACT)
def linear_chain_edges(spark, sf):
    steps = fixture(spark, sf, ACT).select(P, F.col("idx").cast("int").alias("pos"))
    return rp.linear_chain(steps, P)


@query("J14", "node_report_lookup", """
with k as (select trim(regexp_replace(lower(pipeline_name), '[^a-z0-9]+', ' ', 'g')) as key, report_id from fx_report
 union all select trim(regexp_replace(lower(node_id), '[^a-z0-9]+', ' ', 'g')), report_id from fx_report),
m as (select key, min(report_id) as report_id from k group by 1),
q as (select distinct 'fabric || ' || upper(replace(pipeline_name,'_','-')) as id, trim(regexp_replace(lower(pipeline_name), '[^a-z0-9]+', ' ', 'g')) as key from fx_report
 union select 'x || Nothing ' || pipeline_name, 'nothing ' || replace(pipeline_name, '_', ' ') from fx_report)
select q.id, m.report_id from q left join m using (key)""", REPORT)
def node_report_lookup(spark, sf):
    r = fixture(spark, sf, REPORT)
    ids = r.select(F.concat(F.lit("fabric || "), F.upper(F.replace("pipeline_name", F.lit("_"), F.lit("-")))).alias("id")).distinct().unionByName(
        r.select(F.concat(F.lit("x || Nothing "), "pipeline_name").alias("id")).distinct())
    return rp.node_report_lookup(ids, r)


@query("J15", "scoped_graph_union", """
select 'node' as part, platform || ':' || pipeline_name || ':' || node_id as a, arg_min(case node_type when 'source' then 'source' else 'compute' end, report_id * 10 + seq) as b,
 arg_min(case node_type when 'source' then 'source_configs' when 'validation' then 'dq_rules' else 'ingestion_configs' end, report_id * 10 + seq) as c
from (select *, row_number() over (partition by report_id order by node_id, node_type) as seq from fx_report) group by 2
union all select distinct 'framework', platform, '', '' from fx_report""", REPORT)
def scoped_graph_union(spark, sf):
    r = fixture(spark, sf, REPORT)
    nodes = rp.scoped_nodes(r.withColumn("seq", F.struct("report_id", "node_id", "node_type")))
    return nodes.select(F.lit("node").alias("part"), F.col("scoped_id").alias("a"), F.col("role").alias("b"), F.col("config").alias("c")).unionByName(
        r.select(F.lit("framework").alias("part"), F.col("platform").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).distinct())


@query("J16", "bipartite_edges", """
select distinct pipe_id, a, b from (
 select pipe_id, source as a, coalesce(ingestion, framework) as b from fx_pipeline
 union all select pipe_id, ingestion, framework from fx_pipeline where ingestion is not null)""", "fx_pipeline")
def bipartite_edges(spark, sf):
    p = fixture(spark, sf, "fx_pipeline")
    return rp.bipartite_edges(p.select("pipe_id", F.array("source").alias("source"), F.array_compact(F.array("ingestion")).alias("ingestion"),
                                       F.array("framework").alias("framework")))


@query("J17", "merge_with_reports", """
with a as (select distinct report_id, 'framework' as category, 'own ' || platform as label from fx_report where report_id % 2 = 0),
b as (select distinct report_id, 'framework' as category, platform as label from fx_report union select report_id, 'dq_rules', dq_rule from fx_report where dq_rule is not null)
select * from a union all select * from b anti join a using (report_id, category)""", REPORT)
def merge_with_reports(spark, sf):
    r = fixture(spark, sf, REPORT)
    own = r.where("report_id % 2 = 0").select("report_id", F.lit("framework").alias("category"), F.concat(F.lit("own "), "platform").alias("label")).distinct()
    return rp.merge_with_reports(own, rp.report_labels(r), "report_id")


@query("W04", "report_dedup_exact", """
with s as (select report_id, platform, pipeline_name, string_agg(node_id || ':' || node_type, ',' order by node_id, node_type) as g from fx_report group by all)
select min(report_id) as report_id, count(*) as copies from s group by platform, pipeline_name, g""", REPORT)
def report_dedup_exact(spark, sf):
    r = fixture(spark, sf, REPORT)
    return rp.report_dedup(r, "report_id")


@query("S13", "bridge_projection", """
select report_id, pipeline_name, platform, 'flow ' || node_id as flow, case when dq_rule is null then '[]' else '["' || dq_rule || '"]' end as dq_rules
from fx_report where type = 'DataPipeline'""", REPORT)
def bridge_projection(spark, sf):
    r = fixture(spark, sf, REPORT)
    doc = F.concat(
        F.lit('{"platform":"'), "platform", F.lit('","flow":'),
        F.when(F.col("node_type") == "source", F.concat(F.lit('"flow '), "node_id", F.lit('"'))).otherwise(F.concat(F.lit('{"text":"flow '), "node_id", F.lit('"}'))),
        F.coalesce(F.concat(F.lit(',"dq_rules":["'), "dq_rule", F.lit('"]')), F.lit("")), F.lit(',"pipeline_name":"'), "pipeline_name", F.lit('"}'))
    reports = r.select("report_id", "type", F.when(F.col("report_id") % 2 == 0, F.col("pipeline_name")).alias("pipeline_name"),
                       F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("platform"), doc.alias("reformatted"), F.lit("{}").alias("original"))
    return rp.bridge_projection(reports).select("report_id", "pipeline_name", "platform", "flow", "dq_rules")
