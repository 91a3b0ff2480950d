"""Payload scan, lookup and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import text as tx
from metasift.operators import documents as ds
from metasift.operators import jsonwalk as jw
from metasift.operators import payload as pl
from metasift.plans.catalog import fixture, query, table

PAYLOAD = "fx_payload"


@query("S01", "scan_payloads", """
select payload_id, json_extract_string(metadata,'$.platform') as platform,
 json_extract_string(config,'$.input') as input, json_extract_string(raw_json,'$.type') as kind,
 '{}' as entities
from fx_payload""", PAYLOAD)
def scan_payloads(spark, sf):
    p = fixture(spark, sf, PAYLOAD).withColumn("entities", F.lit(None).cast("string"))
    return pl.scan_payloads(p).select(
        "payload_id",
        F.try_variant_get("metadata_v", "$.platform", "string").alias("platform"),
        F.try_variant_get("config_v", "$.input", "string").alias("input"),
        F.try_variant_get("raw_json_v", "$.type", "string").alias("kind"),
        F.to_json("entities_v").alias("entities"),
    )


@query("P01", "payload_text", """
select payload_id, lower(metadata || ' ' || config || ' ' || raw_json) as txt from fx_payload""", PAYLOAD)
def payload_text(spark, sf):
    return pl.with_text(fixture(spark, sf, PAYLOAD)).select("payload_id", "txt")


@query("P02", "find_key_precedence", """
with inv as (
 select payload_id, arg_min(json_extract_string(configuration,'$.Region'), dump_pos * 100000000000 + item_pos) as v
 from fx_asset where json_extract_string(configuration,'$.Region') <> '' group by 1),
pays as (select payload_id, metadata, config, raw_json from fx_payload)
select p.payload_id,
 coalesce(nullif(json_extract_string(metadata,'$.platform'),''), nullif(json_extract_string(raw_json,'$.type'),'')) as found,
 json_extract_string(metadata,'$.name') as any_case,
 case when json_extract_string(config,'$.output') <> '' then json_extract_string(config,'$.output') else json_extract_string(raw_json,'$.type') end as config_first,
 inv.v as from_inventory
from pays p left join inv using (payload_id)""", (PAYLOAD, "fx_asset"))
def find_key_precedence(spark, sf):
    p = fixture(spark, sf, PAYLOAD)
    assets = fixture(spark, sf, "fx_asset").withColumn("service", F.lit("any"))
    base = pl.with_lookups(p).select(
        "payload_id",
        pl.find_key("platform", "type").alias("found"),
        pl.find_key("NAME").alias("any_case"),
        pl.find_key("output", "type", "checks").alias("config_first"),
    )
    inv = pl.find_anywhere(p, assets, "Region").withColumnRenamed("value", "from_inventory")
    return base.join(inv, "payload_id")


@query("P03", "collect_values_recursive", """
select config_id, side, t.fullkey[3:] as path, t.value::varchar as value
from fx_config, json_tree(doc) t
where lower(t.key) in ('host','tags')""", "fx_config")
def collect_values_recursive(spark, sf):
    c = fixture(spark, sf, "fx_config")
    hosts = jw.collect_values(c, "doc", ["config_id", "side"], "HOST")
    tags = jw.collect_values(c, "doc", ["config_id", "side"], "tags")
    return hosts.unionByName(tags).select("config_id", "side", "path", "value")


@query("P04", "find_first_key_value", """
select config_id, side, t.value::varchar as value
from fx_config, json_tree(doc) t where lower(t.key) = 'port'""", "fx_config")
def find_first_key_value(spark, sf):
    return jw.first_key_value(fixture(spark, sf, "fx_config"), "doc", ["config_id", "side"], "port")


@query("P05", "flatten_strings", """
select payload_id, json_extract_string(raw_json,'$.checks[0]') || '|' || json_extract_string(config,'$.input') as flat
from fx_payload""", PAYLOAD)
def flatten_strings(spark, sf):
    p = pl.scan_payloads(fixture(spark, sf, PAYLOAD))
    doc = F.concat(
        F.lit("["), F.to_json(F.try_variant_get("raw_json_v", "$.checks", "variant")), F.lit(","),
        F.to_json(F.try_variant_get("raw_json_v", "$.checks", "variant")), F.lit(',null,"  ",["'),
        F.try_variant_get("config_v", "$.input", "string"), F.lit('"]]'))
    return p.select("payload_id", F.array_join(jw.flatten_strings(F.try_parse_json(doc)), "|").alias("flat"))


LEAF_TREE = """
select config_id, side, t.fullkey[3:] as path, t.atom::varchar as value
from fx_config, json_tree(doc) t where t.type not in ('OBJECT','ARRAY')"""


@query("P06", "flatten_paths_indexed", LEAF_TREE, "fx_config")
def flatten_paths_indexed(spark, sf):
    return jw.flatten_paths(fixture(spark, sf, "fx_config"), "doc", ["config_id", "side"]).select(
        "config_id", "side", "path", "value")


@query("P07", "flatten_paths_list_leaf", """
select config_id, side, t.fullkey[3:] as path, t.value::varchar as value
from fx_config, json_tree(doc) t where t.type <> 'OBJECT' and t.fullkey not like '%[%'""", "fx_config")
def flatten_paths_list_leaf(spark, sf):
    return jw.flatten_paths(fixture(spark, sf, "fx_config"), "doc", ["config_id", "side"], list_leaves=True).select(
        "config_id", "side", "path", "value")


@query("P08", "get_by_path", """
select config_id, side, json_extract(doc, '$.connection.port')::varchar as value
from fx_config where json_extract(doc, '$.connection.port') is not null""", "fx_config")
def get_by_path(spark, sf):
    ids = ["config_id", "side"]
    leaves = jw.flatten_paths(fixture(spark, sf, "fx_config"), "doc", ids)
    return jw.get_by_path(leaves, ids, "connection.port").select(*ids, "value")


@query("P09", "set_by_path", """
with leaf as (
 select config_id, side, t.fullkey[3:] as path, t.atom::varchar as value
 from fx_config, json_tree(doc) t where t.type not in ('OBJECT','ARRAY'))
select config_id, side, path, value from leaf where not (path like 'connection.%' or path like 'name%')
union all select config_id, side, 'connection', '"moved"' from fx_config
union all select config_id, side, 'name.first', '1' from fx_config""", "fx_config")
def set_by_path(spark, sf):
    ids = ["config_id", "side"]
    c = fixture(spark, sf, "fx_config")
    leaves = jw.flatten_paths(c, "doc", ids)
    u = c.select(*ids, F.explode(F.array(
        F.struct(F.lit("connection").alias("path"), F.lit('"moved"').alias("value"), F.lit("string").alias("kind")),
        F.struct(F.lit("name.first").alias("path"), F.lit("1").alias("value"), F.lit("number").alias("kind")),
    )).alias("u")).select(*ids, "u.*")
    return jw.set_by_path(leaves, ids, u).select(*ids, "path", "value")


@query("P09", "set_in_documents", """
with d as (select config_id, side, json_extract(doc,'$.connection.host')::varchar as host, json_extract(doc,'$.connection.port')::varchar as port,
 json_extract(doc,'$.extra')::varchar as extra, json_extract(doc,'$.tags[0]')::varchar as tag, json_extract(doc,'$.tags[1]')::varchar as tag2 from fx_config)
select config_id, side, '{"connection":{"auth":{"kind":"key"},"host":' || host || coalesce(',"port":' || port, '') || '}'
 || coalesce(',"extra":' || extra, '') || ',"name":{"first":1},"tags":[' || tag || coalesce(',' || tag2, ',null') || ',null,"last"]}' as document from d""", "fx_config")
def set_in_documents(spark, sf):
    ids = ["config_id", "side"]
    c = fixture(spark, sf, "fx_config")
    u = c.select(*ids, F.explode(F.expr(
        "array(named_struct('path','connection.auth.kind','kind','string','value','\"key\"'), named_struct('path','name.first','kind','number','value','1'),"
        " named_struct('path','tags[3]','kind','string','value','\"last\"'))")).alias("u")).select(*ids, "u.*")
    return ds.set_in_documents(c, "doc", ids, u).select(*ids, F.to_json("document").alias("document"))


@query("P10", "drop_empty_fields", """
select payload_id, 'output' as path, json_extract_string(config,'$.output') as value from fx_payload
 where json_extract_string(config,'$.output') <> 'none'
union all select payload_id, 'zero', '0' from fx_payload
union all select payload_id, 'off', 'false' from fx_payload""", PAYLOAD)
def drop_empty_fields(spark, sf):
    p = pl.scan_payloads(fixture(spark, sf, PAYLOAD))
    out = F.try_variant_get("config_v", "$.output", "string")
    doc = F.concat(F.lit('{"zero":0,"off":false,"gone":null,"blank":"","none":[],"nil":{},"output":"'),
                   F.when(out == "none", "").otherwise(out), F.lit('"}'))
    leaves = jw.flatten_paths(p.select("payload_id", doc.alias("doc")), "doc", ["payload_id"], list_leaves=True)
    return jw.drop_empty(leaves).select("payload_id", "path", jw.plain(F.col("value"), F.col("kind")).alias("value"))


@query("P11", "is_missing_predicate", """
select config_id, side, json_extract(doc,'$.connection.port') is null as missing_port,
 json_extract(doc,'$.name') is null as missing_name from fx_config""", "fx_config")
def is_missing_predicate(spark, sf):
    c = fixture(spark, sf, "fx_config").withColumn("v", F.try_parse_json("doc"))
    return c.select(
        "config_id", "side",
        jw.is_missing(F.to_json(F.try_variant_get("v", "$.connection.port", "variant"))).alias("missing_port"),
        jw.is_missing(F.to_json(F.try_variant_get("v", "$.name", "variant"))).alias("missing_name"))


@query("P12", "first_nonblank", """
select payload_id, case when json_extract_string(config,'$.output') <> 'none' then json_extract_string(config,'$.output')
 else json_extract_string(metadata,'$.name') end as value from fx_payload""", PAYLOAD)
def first_nonblank(spark, sf):
    p = pl.scan_payloads(fixture(spark, sf, PAYLOAD))
    out = F.try_variant_get("config_v", "$.output", "string")
    return p.select("payload_id", tx.first_nonblank(
        F.lit(None).cast("string"), F.lit("  "), F.when(out == "none", "").otherwise(F.concat(F.lit(" "), out)),
        F.try_variant_get("metadata_v", "$.name", "string")).alias("value"))


@query("P15", "search_terms", """
select payload_id, unnest([json_extract_string(metadata,'$.name'), json_extract_string(metadata,'$.platform')]) as term,
 unnest([1,2]) as pos from fx_payload""", PAYLOAD)
def search_terms(spark, sf):
    p = pl.scan_payloads(fixture(spark, sf, PAYLOAD))
    return p.select("payload_id", F.posexplode(pl.search_terms()).alias("p", "term")).select(
        "payload_id", "term", (F.col("p") + 1).alias("pos"))


@query("P28", "import_target_classify", """
select payload_id,
 case when json_extract(raw_json,'$.type') is not null then 'raw_json' else 'metadata' end as raw_target,
 case when lower(config) like '%datafactory%' or lower(config) like '%fabric%' then 'raw_json' else 'config' end as config_target,
 case when lower(metadata) like '%datafactory%' or lower(metadata) like '%fabric%' then 'raw_json' else 'metadata' end as metadata_target
from fx_payload""", PAYLOAD)
def import_target_classify(spark, sf):
    p = fixture(spark, sf, PAYLOAD)
    return p.select("payload_id", pl.import_target(F.col("raw_json")).alias("raw_target"),
                    pl.import_target(F.col("config")).alias("config_target"),
                    pl.import_target(F.col("metadata")).alias("metadata_target"))


@query("P29", "platform_hint_classify", """
select payload_id,
 case when json_extract_string(raw_json,'$.type') = 'adf_pipeline' then 'adf' end as raw_hint,
 case when metadata like '%glue%' or metadata like '%lambda%' then 'aws' end as metadata_hint
from fx_payload""", PAYLOAD)
def platform_hint_classify(spark, sf):
    p = fixture(spark, sf, PAYLOAD)
    return p.select("payload_id", pl.platform_hint(F.col("raw_json")).alias("raw_hint"),
                    pl.platform_hint(F.col("metadata")).alias("metadata_hint"))


# --- scalar functions over payload text ------------------------------------------------

@query("F09", "storage_uri_parts", r"""
with t as (select payload_id, json_extract_string(config,'$.input') as u from fx_payload)
select payload_id,
 case when u like 's3://%' then 's3' when u like 'abfss://%' then 'abfss' when u like 'gs://%' then 'gs' end as scheme,
 case when u like 's3://%' then split_part(u[6:], '/', 1) when u like 'gs://%' then split_part(u[6:], '/', 1)
      when u like 'abfss://%' then split_part(u[9:], '@', 1) end as container,
 case when u like 'abfss://%' then split_part(split_part(u, '@', 2), '/', 1) end as account
from t""", PAYLOAD)
def storage_uri_parts(spark, sf):
    p = fixture(spark, sf, PAYLOAD).select("payload_id", tx.storage_uri(F.col("config")).alias("u"))
    return p.select("payload_id", "u.scheme", "u.container", "u.account")


@query("F10", "jdbc_parts", r"""
with t as (select payload_id, nullif(regexp_extract(json_extract_string(config,'$.output'), '^jdbc:redshift://.*$'),'') as u from fx_payload)
select payload_id, case when u is not null then 'redshift' end as engine, split_part(split_part(u,'//',2),':',1) as host,
 split_part(u,'/',4) as database from t""", PAYLOAD)
def jdbc_parts(spark, sf):
    out = F.get_json_object("config", "$.output")
    p = fixture(spark, sf, PAYLOAD).select("payload_id", tx.jdbc_parts(out).alias("j"))
    return p.select("payload_id", "j.engine", "j.host", "j.database")


@query("F11", "find_all_pattern", r"""
select payload_id, array_to_string(regexp_extract_all(lower(config), '[a-z]+-[0-9]'), ',') as hits from fx_payload""", PAYLOAD)
def find_all_pattern(spark, sf):
    return fixture(spark, sf, PAYLOAD).select(
        "payload_id", F.array_join(tx.find_all(F.lower("config"), r"[A-Z]+-[0-9]"), ",").alias("hits"))


@query("F12", "find_first_pattern", r"""
select payload_id, nullif(regexp_extract(config, '(s3|gs)://[^"]+'), '') as hit from fx_payload""", PAYLOAD)
def find_first_pattern(spark, sf):
    return fixture(spark, sf, PAYLOAD).select(
        "payload_id", tx.find_first(F.col("config"), r'(s3|gs)://[^"]+').alias("hit"))


@query("F24", "platform_label", """
select payload_id, case json_extract_string(metadata,'$.platform') when 'adf' then 'Azure Data Factory'
 when 'glue' then 'AWS Glue' else case when raw_json like '%fabric%' then 'Microsoft Fabric'
 else json_extract_string(metadata,'$.platform') end end as label from fx_payload""", PAYLOAD)
def platform_label(spark, sf):
    return fixture(spark, sf, PAYLOAD).select("payload_id", tx.platform_label(
        F.get_json_object("metadata", "$.platform"), F.col("raw_json")).alias("label"))


@query("R22", "slug", r"""
select p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g') as slug from part""")
def slug(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", tx.slug(F.concat(F.lit("#"), F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("!"))).alias("slug"))


@query("F13", "lambda_from_integration_uri", r"""
select p_partkey, case when p_partkey % 3 = 0 then replace(p_name,' ','-') else 'UNKNOWN' end as fn from part""")
def lambda_from_integration_uri(spark, sf):
    uri = F.when(F.col("p_partkey") % 3 == 0, F.concat(
        F.lit("arn:aws:apigateway:us-east-1:lambda:path/functions/arn:aws:lambda:us-east-1:1:function:"),
        F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/invocations"))).otherwise("https://host/api")
    return table(spark, sf, "part").select("p_partkey", tx.lambda_of_integration(uri).alias("fn"))


@query("F08", "url_last_segment", r"""
with s as (select page_id, url, list_filter(string_split(regexp_replace(split_part(split_part(url,'?',1),'#',1), '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '') as segs from pages)
select page_id, case when len(segs) > 0 then segs[-1] || ' API' else url end as label from s""")
def url_last_segment(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.endpoint_label(F.col("url")).alias("label"))


@query("F17", "try_int", r"""
select id, custkey, order_date, case when amount_text = 'abc' then null else cast(amount_text as bigint) end as amount from fx_dirty""", "fx_dirty")
def try_int(spark, sf):
    return fixture(spark, sf, "fx_dirty").select("id", "custkey", "order_date", tx.try_int(F.col("amount_text")).alias("amount"))
