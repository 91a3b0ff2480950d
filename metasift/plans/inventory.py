"""Cloud-inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.operators import inventory as inv
from metasift.plans.catalog import fixture, query, table

ASSET, DUMP = "fx_asset", "fx_dump"
ITEMS = """i as (select payload_id, 0 as dump_pos, 's3' as service, 0 as item_pos, 'us-east-1 || ' || p_name as id, 'r' || (p_size % 4) as region, p_partkey from fx_dump join part on p_partkey = payload_id
 union all select payload_id, 0, 'glue', 0, 'us-west-2 || g' || p_size, null, p_partkey from fx_dump join part on p_partkey = payload_id
 union all select payload_id, 1, 's3', 0, 'eu || second' || p_size, 'eu', p_partkey from fx_dump join part on p_partkey = payload_id where p_partkey % 3 = 1)"""


def assets(spark, sf):
    a = fixture(spark, sf, ASSET)
    conf = F.expr("case item_pos % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' end")
    return a.select(
        "payload_id", "dump_pos", "item_pos", "service", "id", "item_type", "configuration", F.array_compact(F.array("env_target")).alias("env_targets"),
        F.when(F.col("item_pos") % 2 == 0, F.array(F.lit("call"))).otherwise(F.array().cast("array<string>")).alias("code_evidence"), conf.alias("confidence"))


@query("S02", "scan_inventory_dump", f"with {ITEMS} select payload_id, dump_pos, service, item_pos, id, region from i", DUMP)
def scan_inventory_dump(spark, sf):
    return inv.assets_of(fixture(spark, sf, DUMP)).select("payload_id", "dump_pos", "service", "item_pos", "id", inv.config_text("Region").alias("region"))


@query("P13", "normalize_inventory", f"""
with {ITEMS} select payload_id, dump_pos, item_pos, id, upper(service) as label from i
union all select payload_id, 0, 1, 'loose ' || payload_id, 'UNKNOWN' from fx_dump""", DUMP)
def normalize_inventory(spark, sf):
    return inv.normalized_inventory(inv.dump_items(fixture(spark, sf, DUMP))).select("payload_id", "dump_pos", "item_pos", "id", "label")


@query("P14", "detailed_inventory", f"""
with {ITEMS} select payload_id, id, upper(service) as service, case when region is null then '{{}}' else '{{"Region":"' || region || '"}}' end as configuration from i where dump_pos = 0""", DUMP)
def detailed_inventory(spark, sf):
    return inv.detailed_inventory(inv.dump_items(fixture(spark, sf, DUMP)))


ROLES = """a as (select *, case item_pos % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence, trim(string_split(id,'||')[-1]) as name from fx_asset),
r as (select payload_id, item_pos, id, name, confidence, env_target, case service when 'apigateway' then 'source' when 'storage_accounts' then 'source' when 'lambda' then 'ingest' when 'glue' then 'ingest' when 's3' then 'target'
  else case item_type when 'Lakehouse' then 'target' when 'Pipeline' then 'ingest' when 'Notebook' then 'ingest' else 'source' end end as role from a
 union all select payload_id, item_pos, id, name, confidence, env_target, 'target' from a where service = 'storage_accounts')"""


@query("J01", "asset_roles", f"with {ROLES} select payload_id, item_pos, id, role from r", ASSET)
def asset_roles(spark, sf):
    return inv.with_roles(assets(spark, sf)).select("payload_id", "item_pos", "id", "role")


UP = """ing as (select distinct payload_id, id, lower(string_split(name,'-')[-1]) as link_key from r where role = 'ingest'),
src as (select distinct payload_id, id from r where role = 'source'),
hit as (select distinct i.payload_id, i.link_key, s.id from (select distinct payload_id, link_key from ing) i join src s on s.payload_id = i.payload_id and contains(lower(s.id), i.link_key)
 union select payload_id, '*api*', id from src where contains(lower(id), 'api')),
up as (select distinct i.payload_id, h.link_key, 'ingest' as side, i.id from ing i join hit h on h.payload_id = i.payload_id and h.link_key in (i.link_key, '*api*')
 union all select distinct payload_id, link_key, 'source', id from hit where payload_id in (select payload_id from ing))"""
DOWN = """tv as (select distinct payload_id, id, lower(env_target) as link_key from r where role = 'ingest' and env_target is not null),
tg as (select distinct payload_id, id, lower(name) as name from r where role = 'target'),
dh as (select distinct v.payload_id, v.link_key, t.id from (select distinct payload_id, link_key from tv) v join tg t on t.payload_id = v.payload_id and (contains(v.link_key, t.name) or contains(lower(t.id), v.link_key))),
down as (select distinct v.payload_id, v.link_key, 'ingest' as side, v.id from tv v join dh using (payload_id, link_key) union all select payload_id, link_key, 'target', id from dh)"""


@query("J02", "link_upstream_theta", f"with {ROLES}, {UP} select payload_id, link_key, side, id from up", ASSET)
def link_upstream_theta(spark, sf):
    return inv.link_upstream(inv.with_roles(assets(spark, sf)))


@query("J03", "link_downstream_theta", f"with {ROLES}, {DOWN} select payload_id, link_key, side, id from down", ASSET)
def link_downstream_theta(spark, sf):
    return inv.link_downstream(inv.with_roles(assets(spark, sf)))


LINKED = """x as (select i.payload_id, i.id, count(distinct s.id) as n, string_agg(distinct upper(trim(string_split(s.id,'||')[1])), ',') as c from ing i join src s on s.payload_id = i.payload_id
  and (contains(lower(s.id), i.link_key) or contains(lower(s.id), 'api')) group by 1, 2),
y as (select v.payload_id, v.id, count(distinct d.id) as n, count(*) as every, string_agg(distinct upper(trim(string_split(d.id,'||')[1])), ',') as c from tv v join dh d using (payload_id, link_key) group by 1, 2),
g as (select distinct payload_id, id, name, confidence, item_pos from r where role = 'ingest'),
j as (select g.payload_id, g.name || ' Architecture' as name, g.id as ingestion, coalesce(x.n, 0) as source_links, coalesce(y.n, 0) as target_links,
 array_to_string(list_sort(list_distinct(string_split(concat_ws(',', upper(trim(string_split(g.id,'||')[1])), x.c, y.c), ','))), '|') as cloud_path, g.confidence,
 1 + (case when g.item_pos % 2 = 0 then 1 else 0 end) + coalesce(x.n, 0) + coalesce(y.every, 0) as evidence_lines from g left join x using (payload_id, id) left join y using (payload_id, id)
 union all select payload_id, 'Discovered Standalone Assets', null, count(*) filter (role = 'source'), count(*) filter (role = 'target'), 'MULTICLOUD', 'LOW', 1 from r group by 1 having count(*) filter (role = 'ingest') = 0)"""


def assembled(spark, sf):
    roles = inv.with_roles(assets(spark, sf))
    return inv.assemble_links(roles, inv.link_upstream(roles), inv.link_downstream(roles)).withColumn("cloud_path", F.array_join("cloud_path", "|"))


@query("J04", "assemble_asset_links", f"with {ROLES}, {UP}, {DOWN}, {LINKED} select * from j", ASSET)
def assemble_asset_links(spark, sf):
    return assembled(spark, sf)


@query("A10", "distinct_cloud_path", f"with {ROLES}, {UP}, {DOWN}, {LINKED} select payload_id, ingestion, cloud_path from j", ASSET)
def distinct_cloud_path(spark, sf):
    return assembled(spark, sf).select("payload_id", "ingestion", "cloud_path")


ROLLUP = """o as (select *, trim(string_split(id,'||')[-1]) as name, json_extract_string(configuration,'$.Region') as region, dump_pos * 100000000 + item_pos as k from fx_asset),
names as (select payload_id, service, string_agg(name, '|' order by k) as names from (select *, row_number() over (partition by payload_id, service order by k) as rn from o) group by 1, 2),
regs as (select payload_id, service, region, min(k) as k from o group by 1, 2, 3),
cnt as (select payload_id, count(*) filter (service = 's3') as bucket_count, count(*) filter (service = 'storage_accounts') as account_count,
 coalesce(bool_or(json_extract_string(configuration,'$.IsHnsEnabled') = 'true') filter (service = 'storage_accounts'), false) as any_hns from o group by 1),
ro as (select cnt.*, n1.names as buckets, n2.names as accounts from cnt
 left join names n1 on n1.payload_id = cnt.payload_id and n1.service = 's3'
 left join names n2 on n2.payload_id = cnt.payload_id and n2.service = 'storage_accounts' where bucket_count + account_count > 0),
rv as (select payload_id, case service when 's3' then 'regions' else 'locations' end as field, region as value from regs where service in ('s3','storage_accounts'))"""


@query("A03", "storage_rollup", f"""
with {ROLLUP} select payload_id, bucket_count, account_count, any_hns, buckets, accounts, null::varchar as field, null::varchar as value from ro
union all select payload_id, null, null, null, null, null, field, value from rv""", ASSET)
def storage_rollup(spark, sf):
    a = assets(spark, sf)
    return inv.storage_rollup(a).unionByName(inv.storage_values(a).drop("at"), allowMissingColumns=True)


@query("A04", "service_counts_with_examples", """
with f as (select *, row_number() over (partition by payload_id, service order by item_pos) as rn from fx_asset where dump_pos = 0)
select payload_id, service, 0 as line, 'Discovered ' || count(*) || ' active ' || upper(service) || ' resources:' as text from f group by 1, 2
union all select payload_id, service, rn, '  - ' || id || ' (Runtime: ' || json_extract_string(configuration,'$.Runtime') || ')' from f""", ASSET)
def service_counts_with_examples(spark, sf):
    return inv.service_examples(assets(spark, sf))


@query("A06", "union_scans", """
select service as key, name as item, min(item_pos)::bigint as seq, 'aws' as provider from (select *, trim(string_split(id,'||')[-1]) as name from fx_asset) where service in ('s3','lambda','apigateway','glue') group by 1, 2""", ASSET)
def union_scans(spark, sf):
    a = assets(spark, sf).select("service", F.trim(F.element_at(F.split("id", r"\|\|"), -1)).alias("item"), F.col("item_pos").alias("seq"))
    cloud = {"aws": ["s3", "lambda", "apigateway", "glue"], "azure": ["storage_accounts"], "fabric": ["fabric_items"]}
    scans = [a.where(F.col("service").isin(*s)).select(F.lit(p).alias("provider"), F.col("service").alias("key"), "item", "seq") for p, s in cloud.items()]
    return inv.union_scans(scans + [scans[0]], ["aws"])


@query("W07", "first_asset_per_service", """
select payload_id, service, arg_min(id, dump_pos * 100000000 + item_pos) as id from fx_asset where service in ('s3','lambda','glue') group by 1, 2""", ASSET)
def first_asset_per_service(spark, sf):
    a = assets(spark, sf)
    parts = [inv.first_asset(a, s).select("payload_id", F.lit(s).alias("service"), "id") for s in ("s3", "lambda", "glue")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("D29", "env_target_heuristic", """
select p_partkey, case when p_partkey % 3 = 0 then 'in-' || p_size else '' end || case when p_partkey % 3 = 0 and p_partkey % 5 = 0 then '|' else '' end || case when p_partkey % 5 = 0 then 's3://code' else '' end as targets,
 case when p_partkey % 5 = 0 then 'HIGH' when p_partkey % 3 = 0 then 'MEDIUM' else 'LOW' end as confidence, case when p_size % 2 = 0 then 'SQS' else 'DYNAMODB' end as trigger from part""")
def env_target_heuristic(spark, sf):
    p = table(spark, sf, "part")
    env = F.create_map(F.lit("mode"), F.lit("prod"), F.when(F.col("p_partkey") % 3 == 0, "my_bucket").otherwise("other"), F.concat(F.lit("in-"), "p_size"))
    code = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("s3://code"), F.lit("s3://code")))
    arn = F.concat(F.lit("arn:aws:"), F.when(F.col("p_size") % 2 == 0, "sqs").otherwise("dynamodb"), F.lit(":us-east-1:1:x"))
    return p.select("p_partkey", inv.env_targets(env, code).alias("e"), inv.trigger_type(arn).alias("trigger")).select(
        "p_partkey", F.array_join("e.targets", "|").alias("targets"), "e.confidence", "trigger")


@query("D30", "bucket_posture", """
select p_partkey, not (p_partkey % 2 = 0 and p_partkey % 3 = 0) as is_public, case when p_size % 2 = 0 then 'Enabled' else 'Disabled' end as versioning,
 case when p_size % 3 = 0 then 'Enabled' else 'Disabled' end as encryption, p_partkey % 5 = 0 as has_policy, (case when p_partkey % 5 = 0 then length(p_name) else 0 end)::int as policy_length from part""")
def bucket_posture(spark, sf):
    k = F.col("p_partkey")
    block = F.create_map(F.lit("BlockPublicAcls"), k % 2 == 0, F.lit("IgnorePublicAcls"), k % 3 == 0)
    return table(spark, sf, "part").select("p_partkey", inv.bucket_posture(
        block, F.when(k % 5 == 0, F.col("p_name")), F.when(F.col("p_size") % 2 == 0, "Enabled"), F.col("p_size") % 3 == 0).alias("b")).select("p_partkey", "b.*")


@query("D32", "api_gateway_summary", """
with m as (select l_orderkey as api, l_linenumber * 1000000 + l_partkey as seq, case l_partkey % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'OPTIONS' else 'PUT' end as method,
 case l_suppkey % 3 when 0 then 'NONE' when 1 then 'IAM' else 'JWT' end as auth, case l_suppkey % 2 when 0 then 'https://x/' || l_suppkey else 'https://q.amazonaws.com/' || l_suppkey end as uri from lineitem)
select 'api' || api as api_id, 'us-east-1' as region, array_to_string(list_sort(list(distinct method)), '|') as methods, coalesce(arg_max(auth, seq) filter (auth <> 'NONE'), 'NONE') as auth,
 coalesce(min(uri) filter (uri not like '%amazonaws%'), 'Unknown/Internal') as first_url, count(*) filter (uri not like '%amazonaws%') as external_urls,
 'https://api' || api || '.execute-api.us-east-1.amazonaws.com/prod' as invoke_url from m where method <> 'OPTIONS' group by api""")
def api_gateway_summary(spark, sf):
    return inv.api_summary(api_methods(spark, sf)).withColumn("methods", F.array_join("methods", "|"))


def api_methods(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "concat('api', l_orderkey) as api_id", "'us-east-1' as region", "l_linenumber * 1000000 + l_partkey as seq",
        "case l_partkey % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'OPTIONS' else 'PUT' end as method",
        "case l_suppkey % 3 when 0 then 'NONE' when 1 then 'IAM' else 'JWT' end as auth",
        "concat(case l_suppkey % 2 when 0 then 'https://x/' else 'https://q.amazonaws.com/' end, l_suppkey) as uri")


@query("D32", "api_external_urls", """
select 'api' || l_orderkey as api_id, 'https://x/' || l_suppkey as url, min(l_linenumber * 1000000 + l_partkey)::bigint as at
from lineitem where l_suppkey % 2 = 0 and l_partkey % 4 <> 2 group by 1, 2""")
def api_external_urls(spark, sf):
    return inv.api_external_urls(api_methods(spark, sf))


@query("D33", "azure_resource_shape", """
select item_pos, case when item_pos % 7 = 0 then 'unknown' else 'rg' || (item_pos % 5) end as resource_group, item_type = 'Notebook' is true as is_function_app from fx_asset""", ASSET)
def azure_resource_shape(spark, sf):
    rid = F.when(F.col("item_pos") % 7 == 0, "plain").otherwise(F.concat(F.lit("/subscriptions/s/resourceGroups/rg"), F.col("item_pos") % 5, F.lit("/providers/p")))
    kind = F.when(F.col("item_type") == "Notebook", "FunctionApp,linux").otherwise(F.col("item_type"))
    return fixture(spark, sf, ASSET).select("item_pos", inv.azure_shape(rid, kind).alias("s")).select("item_pos", "s.*")


@query("D35", "databricks_job_extract", """
select job_id, 'load|task_' || task_pos as task_keys, coalesce(source_type, 'unknown') as source_type,
 case when package like 'great%' then 'great_expectations' when package like 'soda%' then 'soda' else 'deequ' end as dq_framework from fx_job""", "fx_job")
def databricks_job_extract(spark, sf):
    doc = F.concat(
        F.lit('{"settings":{"tasks":[{"task_key":"load"},{"task_key":"task_'), "task_pos", F.lit('"'),
        F.coalesce(F.concat(F.lit(',"notebook_task":{"base_parameters":{"source_type":"'), "source_type", F.lit('"}}')), F.lit("")),
        F.lit('}],"job_clusters":[{"new_cluster":{"libraries":[{"pypi":{"package":"pydeequ"}},{"pypi":{"package":"'), "package", F.lit('"}},{"jar":"x"}]}}]}}'))
    return fixture(spark, sf, "fx_job").select("job_id", inv.job_document(doc).alias("j")).select(
        "job_id", F.array_join("j.task_keys", "|").alias("task_keys"), "j.source_type", "j.dq_framework")


@query("D36", "task_stream_listing", """
with h as (select case when item_pos % 2 = 0 then 'task' else 'stream' end as kind, id as name, item_pos as seq from fx_asset where contains(upper(id), 'RING')),
r as (select *, row_number() over (partition by kind order by name, seq) as rn, count(*) over (partition by kind) as total from h)
select kind, name, seq, total as listed from r""", ASSET)
def task_stream_listing(spark, sf):
    o = fixture(spark, sf, ASSET).select(F.when(F.col("item_pos") % 2 == 0, "task").otherwise("stream").alias("kind"), F.col("id").alias("name"), F.col("item_pos").alias("seq"))
    return inv.task_stream_listing(o, "ring")
