"""Typed-configuration queries; oracles read the JSON text with regular expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.operators import detect as dt
from metasift.operators import extract as ex
from metasift.plans.catalog import fixture, query
from metasift.plans.detection import TXT, hits_sql
from metasift.plans.inventory import ASSET, ROLLUP, assets

CONN = "fx_connector"
TEXT = "t as (select payload_id, metadata, config, raw_json, lower(metadata || ' ' || config || ' ' || raw_json) as txt from fx_connector)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def find(*keys: str) -> str:
    arms = []
    for s in ("metadata", "config", "raw_json"):
        for flag in ("", "(?i)"):
            arms += [f"""nullif(nullif(regexp_extract({s}, '{flag}"{k}":"?([^",}}\\[{{]+)', 1), ''), '0')""" for k in keys]
    return f"coalesce({', '.join(arms)})"


def all_of(pattern: str, group: int = 0) -> str:
    return f"nullif(array_to_string(regexp_extract_all(txt, {q('(?i)' + pattern)}, {group}), '|'), '')"


def first_of(pattern: str) -> str:
    return f"nullif(regexp_extract(txt, {q('(?i)' + pattern)}, 0), '')"


def cap(expr: str, pattern: str) -> str:
    return f"nullif(regexp_extract({expr}, {q(pattern)}, 1), '')"


def spec_sql(spec) -> str:
    if isinstance(spec, list):
        return find(*spec)
    mode, pattern = spec
    return first_of(pattern) if mode == "first" else all_of(pattern, 1 if mode == "group" else 0)


def flag(*keys):
    return f"case when {find(*keys)} is not null then 'true' else 'false' end"


S3, ABFSS, GCS = ex.tx.S3_PATH, ex.tx.ABFSS_PATH, ex.tx.GCS_PATH
RS = r"jdbc:redshift://[^\s\"'>,]+"
SPECIAL = {
    "adls": {"type": "'Azure Data Lake Storage Gen2'", "paths": all_of(ABFSS), "container": cap(first_of(ABFSS), "abfss?://([^@]+)@"),
             "storage_account": find("storage_account", "azure_storage_account"), "tenant_id": find("azure_tenant_id", "tenant_id")},
    "gcs": {"type": "'Google Cloud Storage'", "paths": all_of(GCS), "bucket": cap(first_of(GCS), "gs://([^/]+)"), "project_id": find("gcp_project_id", "project_id", "project")},
    "redshift": {"type": "'Amazon Redshift'", "host": f"coalesce({find('redshift_host', 'cluster_endpoint')}, {cap(first_of(RS), 'jdbc:redshift://([^:/]+)')})",
                 "port": f"coalesce({find('redshift_port', 'port')}, '5439')", "database": f"coalesce({find('redshift_database', 'database', 'db')}, {cap(first_of(RS), '/([^?]+)$')})",
                 "jdbc_url": first_of(RS), "username": find("redshift_user", "db_user", "username")},
}


def sql_fields(name: str) -> dict[str, str]:
    if name in SPECIAL:
        return SPECIAL[name]
    kind, spec = ex.EXTRACTORS[name]
    return {"type": q(kind), **{f: spec_sql(s) for f, s in spec.items()}}


def rows_sql(fields: dict[str, str], source: str, extra: str = "payload_id") -> str:
    names = ", ".join(q(f) for f in fields)
    values = ", ".join(f"({e})::varchar" for e in fields.values())
    return f"select * from (select {extra}, unnest([{names}]) as field, unnest([{values}]) as value from {source}) where value <> ''"


IDS = {"adls": "C02", "gcs": "C03", "redshift": "C04", "snowflake": "C05", "kafka": "C06", "bigquery": "C07", "jdbc": "C08", "glue": "C11", "adf": "C12",
       "databricks": "C13", "airflow": "C14", "spark": "C15", "dbt": "C16", "fivetran": "C18", "kafka_connect": "C19", "step_functions": "C20", "dataflow": "C21"}


def extractor_query(name, ident):
    @query(ident, f"cfg_{name}", f"with {TEXT} {rows_sql(sql_fields(name), 't')}", CONN)
    def run(spark, sf):
        return ex.typed_config(fixture(spark, sf, CONN), name).select("payload_id", "field", "value")


for _name, _ident in IDS.items():
    extractor_query(_name, _ident)

FIRST = """fa as (select payload_id, service, arg_min(trim(string_split(id,'||')[-1]), k) as name, arg_min(region, k) as region, arg_min(runtime, k) as runtime
 from (select *, dump_pos * 100000000 + item_pos as k, json_extract_string(configuration,'$.Region') as region, json_extract_string(configuration,'$.Runtime') as runtime from fx_asset) group by 1, 2)"""


S3_FROM = f"(select t.*, fa.name as a, fa.region as ar, {all_of(S3)} as p from t left join fa on fa.payload_id = t.payload_id and fa.service = 's3')"
S3_FIELDS = {"type": "'Amazon S3'", "paths": "coalesce(p, 's3://' || a || '/')", "bucket": f"case when p is null then a else {cap(first_of(S3), 's3[an]?://([^/]+)')} end",
             "region": f"coalesce({find('aws_region', 'region')}, case when p is null then ar end)", "access_key_configured": flag("aws_access_key_id", "access_key")}


@query("C01", "cfg_s3", f"""
with {TEXT}, {FIRST}, j as {S3_FROM}
""" + rows_sql(S3_FIELDS, "j"), (CONN, ASSET))
def cfg_s3(spark, sf):
    return ex.s3_config(fixture(spark, sf, CONN), assets(spark, sf)).select("payload_id", "field", "value")


API_COUNT = "n as (select payload_id, count(*) as n from fx_asset where service = 'apigateway' group by 1)"
REST_FIELDS = {"type": "'REST API'", "endpoints": "nullif(array_to_string(regexp_extract_all(txt, 'https?://[^\\s\"''>,]+api[^\\s\"''>,]*'), '|'), '')",
               "auth_type": find("auth_type", "authentication"), "api_key_configured": flag("api_key", "x_api_key"), "discovery_notes": "'Discovered ' || n || ' endpoints'"}


@query("C09", "cfg_rest_api", f"""
with {TEXT}, {API_COUNT}, j as (select t.*, n.n from t left join n using (payload_id))
""" + rows_sql(REST_FIELDS, "j"), (CONN, ASSET))
def cfg_rest_api(spark, sf):
    return ex.rest_api_config(fixture(spark, sf, CONN), assets(spark, sf)).select("payload_id", "field", "value")


@query("C17", "cfg_lambda", f"""
with {TEXT}, {FIRST}, j as (select t.*, fa.name as a, fa.runtime as rt from t left join fa on fa.payload_id = t.payload_id and fa.service = 'lambda')
""" + rows_sql({"type": "'AWS Lambda'", "function_name": f"coalesce({find('function_name', 'lambda_function')}, a)", "runtime": f"coalesce({find('runtime')}, rt)",
                "region": find("aws_region", "region"), "role_arn": first_of(ex.ROLE_ARN),
                "function_arn": first_of(r"arn:aws:lambda:[a-z0-9-]+:[0-9]+:function:[^\s\"'>,]+")}, "j"), (CONN, ASSET))
def cfg_lambda(spark, sf):
    return ex.lambda_config(fixture(spark, sf, CONN), assets(spark, sf)).select("payload_id", "field", "value")


@query("C22", "cfg_azure_function", f"""
with {TEXT}, {FIRST}, j as (select t.payload_id, '{{}}' as metadata, t.config, '{{}}' as raw_json, fa.name as a, fa.region as ar from t left join fa on fa.payload_id = t.payload_id and fa.service = 'glue')
""" + rows_sql({"type": "'Azure Functions'", "function_name": f"coalesce({find('function_name', 'name')}, a)", "location": f"coalesce({find('location', 'region')}, ar)"}, "j"), (CONN, ASSET))
def cfg_azure_function(spark, sf):
    a = assets(spark, sf).where("service = 'glue'").withColumns({
        "service": F.lit("functions"), "configuration": F.replace("configuration", F.lit("Region"), F.lit("Location"))})
    p = fixture(spark, sf, CONN).withColumns({"metadata": F.lit("{}"), "raw_json": F.lit("{}")})
    return ex.azure_function_config(p, a).select("payload_id", "field", "value")


FAB = """fab as (select payload_id, dump_pos * 100000000 + item_pos as k, trim(string_split(id,'||')[-1]) as name, item_type, 'lake/' || (item_pos % 7) as lake from fx_asset where service = 'fabric_items')"""


def fabric_assets(spark, sf):
    conf = F.concat(F.lit('{"Type":"'), "item_type", F.lit('","OneLakeFilesPath":"lake/'), F.col("item_pos") % 7, F.lit('"}'))
    return assets(spark, sf).where("service = 'fabric_items'").withColumn("configuration", conf)


@query("C10", "cfg_fabric_source", f"""
with {FAB}, v as (select payload_id, 'workspace_names' as field, name as value, min(k) as k from fab group by 1, 3 union all select payload_id, 'item_types', item_type, min(k) from fab group by 1, 3
 union all select payload_id, 'onelake_paths', lake, min(k) from fab group by 1, 3)
select payload_id, field, value, rn::int as rn from (select *, row_number() over (partition by payload_id, field order by k) as rn from v)""", ASSET)
def cfg_fabric_source(spark, sf):
    return ex.fabric_source_config(fabric_assets(spark, sf))


@query("C23", "cfg_fabric_ingestion", f"""
with {FAB} select distinct payload_id, case item_type when 'Pipeline' then 'pipeline_items' else 'notebook_items' end as field, name as value from fab where item_type in ('Pipeline','Notebook')""", ASSET)
def cfg_fabric_ingestion(spark, sf):
    return ex.fabric_ingestion_config(fabric_assets(spark, sf))


@query("C24", "storage_config", f"""
with {TEXT}, {ROLLUP}, {FAB}, s as (select payload_id, metadata, config, raw_json, txt, bucket_count, account_count, any_hns, buckets, accounts,
 regexp_extract_all(coalesce(txt,''), {q(S3)}) as sp, regexp_extract_all(coalesce(txt,''), {q(GCS)}) as gp from t full join ro using (payload_id)),
m as (select *, coalesce(bucket_count, 0) > 0 or len(sp) > 0 as has_s3, coalesce(account_count, 0) > 0 as has_az, {find('snowflake_account', 'account')} as acct, {find('bq_dataset', 'dataset', 'bigquery_dataset')} as ds from s),
y as (""" + rows_sql({
    "s3.bucket_count": "case when has_s3 then case when coalesce(bucket_count, 0) > 0 then bucket_count else len(list_distinct(list_transform(sp, lambda p: regexp_extract(p, 's3[an]?://([^/]+)', 1)))) end end",
    "s3.path_count": "case when has_s3 then case when len(sp) > 0 then len(sp) else bucket_count end end", "s3.paths": "array_to_string(sp, '|')",
    "s3.buckets": "case when has_s3 then coalesce(buckets, array_to_string(list_transform(sp, lambda p: regexp_extract(p, 's3[an]?://([^/]+)', 1)), '|')) end",
    "azure.account_count": "case when has_az then account_count end", "azure.accounts": "case when has_az then accounts end", 
    "azure.hierarchical_namespace_enabled": "case when has_az then any_hns end", "gcs.path_count": "nullif(len(gp), 0)", "gcs.paths": "array_to_string(gp, '|')",
    "snowflake.account": "acct", "snowflake.warehouse": f"case when acct is not null then {find('warehouse', 'snowflake_warehouse')} end", "bigquery.dataset": "ds",
    "bigquery.project_id": f"case when ds is not null then {find('gcp_project_id', 'project_id', 'project')} end"}, "m") + """)
select * from y union all select payload_id, case field when 'locations' then 'azure.' else 's3.' end || field, value from rv union all select payload_id, 'onelake.path_count', count(*)::varchar from fab group by 1 union all select distinct payload_id, 'onelake.paths', lake from fab""", (CONN, ASSET))
def storage_config(spark, sf):
    return ex.storage_config(fixture(spark, sf, CONN), assets(spark, sf)).unionByName(ex.onelake_config(fabric_assets(spark, sf)))


@query("C25", "dq_config", """
with e as (select payload_id, json_extract_string(raw_json,'$.suite_name') as s, json_extract_string(raw_json,'$.dq.expectations[0].expectation_type') as t, json_extract_string(raw_json,'$.dq.expectations[0].kwargs.column') as c from fx_expectation)
select payload_id, unnest(['suite_names','expectation_types','columns','expectation_count']) as field, unnest([s, t, c, '1']) as value from e
union all select payload_id + 1000000000, unnest(['checks','check_count']), unnest([json_extract_string(raw_json,'$.checks[0]'), '1']) from fx_payload""", ("fx_expectation", "fx_payload"))
def dq_config(spark, sf):
    e = fixture(spark, sf, "fx_expectation").select("payload_id", F.lit("{}").alias("config"), "raw_json")
    p = fixture(spark, sf, "fx_payload").select((F.col("payload_id") + 1000000000).alias("payload_id"), "config", "raw_json")
    return ex.dq_config(e.unionByName(p))


@query("C26", "expert_extraction", f"""
with {FIRST}, api as (select * from fa where service = 'apigateway'), fn as (select * from fa where service = 'lambda'), b as (select payload_id, trim(string_split(id,'||')[-1]) as name from fx_asset where service = 's3'),
e as (select payload_id, unnest([1,2,3,4,5,6]) as i from api)
select payload_id, 'source' as section, unnest(['service','endpoint','method','integration_type','target_lambda','auth']) as field, unnest(['API Gateway','UNKNOWN','["UNKNOWN"]','lambda','fn' || payload_id,'UNKNOWN']) as value from api
union all select fn.payload_id, 'ingestion', unnest(['function_name','runtime','timeout','memory','handler','event_source']), unnest([fn.name, fn.runtime, 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', case when api.payload_id is null then 'UNKNOWN' else 'API Gateway' end]) from fn left join api using (payload_id)
union all select payload_id, 'target', unnest(['service','format']), unnest(['S3', case when payload_id in (select payload_id from fn) then 'JSON' else 'UNKNOWN' end]) from (select distinct payload_id from b)
union all select payload_id, 'target', 'bucket', name from b""", ASSET)
def expert_extraction(spark, sf):
    a = assets(spark, sf)
    more = F.when(F.col("service") == "apigateway", F.concat(F.lit('{"Integrations":[{"type":"lambda","uri":"arn:x:function:fn'), "payload_id", F.lit('/invocations"}]}'))).when(
        F.col("service") == "lambda", F.concat(F.expr("substring(configuration, 1, length(configuration) - 1)"), F.lit(',"DataFormats":["json"]}'))).otherwise(F.col("configuration"))
    return ex.expert_extraction(a.withColumn("configuration", more))


NAMES = list(dict.fromkeys([n for n, _ in rules.SOURCE_RULES] + rules.SUPPORTED_SOURCES))


@query("C27", "source_support_matrix", f"""
with {TXT}, h as (select distinct payload_id, label from {hits_sql(rules.SOURCE_RULES, 'x')}),
c as (select * from (values {", ".join(f"({q(n)}, {q('supported' if n in rules.SUPPORTED_SOURCES else 'detected_only')})" for n in NAMES)}) c(name, support_level))
select t.payload_id, c.name, c.support_level, h.label is not null as detected from t, c left join h on h.payload_id = t.payload_id and h.label = c.name""", "fx_payload")
def source_support_matrix(spark, sf):
    return ex.support_matrix(dt.analyze(fixture(spark, sf, "fx_payload")).select("payload_id", "source")).drop("explanation")


@query("C28", "to_unified_schema", """
select config_id, coalesce(extracted_destination, 'Unknown') as source_type, 'svc' as service_name, 'oauth' as authentication_type, 'host=h|table=' || example_destination as details,
 coalesce(extracted_mode, 'batch') as mode, null::varchar as trigger_type, 'daily' as frequency, 'csv' as data_format, 'lake' as destination,
 extracted_rule || '|custom_check' as dq_rules, 'ADF: source_1 -> step_1 -> step_2 -> sink_1' as flow_text,
 'artifactId|schema|endpoint|path|trigger_type' as missing from fx_merge""", "fx_merge")
def to_unified_schema(spark, sf):
    m = fixture(spark, sf, "fx_merge")
    doc = F.to_json(F.struct(
        F.struct(F.col("extracted_destination").alias("type"), F.lit("svc").alias("linked_service"), F.lit("csv").alias("file_format"), F.lit("h").alias("host"),
                 F.struct(F.lit("oauth").alias("auth_type"), F.col("example_destination").alias("table")).alias("connection")).alias("source_config"),
        F.struct(F.col("extracted_mode").alias("mode"), F.struct(F.lit("daily").alias("frequency")).alias("schedule"), F.struct(F.lit("lake").alias("bucket")).alias("output"),
                 F.array(F.lit("a"), F.lit("b")).alias("steps")).alias("ingestion_config"),
        F.struct(F.array(F.struct(F.col("extracted_rule").alias("rule_type")), F.struct(F.lit(None).cast("string").alias("rule_type"))).alias("rules")).alias("dq_config"),
        F.lit("ADF").alias("framework")))
    u = ex.unified_schema(m.select("config_id", doc.alias("result")))
    return u.select(
        "config_id", "source_type", "service_name", "authentication_type",
        F.array_join(F.transform(F.array_sort(F.map_entries("connection_details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("details"),
        "mode", "trigger_type", "frequency", "data_format", "destination", F.array_join("dq_rules", "|").alias("dq_rules"), "flow_text",
        F.array_join(F.transform("missing", lambda x: F.element_at(F.split(x, r"\."), -1)), "|").alias("missing"))


TEXT_NAMES = [n for n in dict.fromkeys(ex.SOURCE_EXTRACTORS.values()) if n not in ("s3", "rest_api", "fabric")]


@query("2.4", "detected_source_configs", f"""
with {TEXT}, {FIRST}, {API_COUNT}, js as {S3_FROM}, jr as (select t.*, n.n from t left join n using (payload_id)),
h as (select distinct payload_id, label from {hits_sql(rules.SOURCE_RULES, 'x')}),
r as (select * from ({" union all ".join(f"select payload_id, {q(n)} as extractor, field, value from ({rows_sql(fields, source)})" for n, fields, source in (
    [(n, sql_fields(n), 't') for n in TEXT_NAMES] + [('s3', S3_FIELDS, 'js'), ('rest_api', REST_FIELDS, 'jr')]))}))
select r.payload_id, h.label, r.field, r.value from r join (values {", ".join(f"({q(a)},{q(b)})" for a, b in ex.SOURCE_EXTRACTORS.items())}) m(label, extractor) using (extractor)
 join h on h.payload_id = r.payload_id and h.label = m.label""", (CONN, ASSET))
def detected_source_configs(spark, sf):
    p = fixture(spark, sf, CONN)
    labels = dt.detect_text(p, "source").select("payload_id", "label")
    return ex.detected_configs(p, labels, ex.SOURCE_EXTRACTORS, assets(spark, sf)).select("payload_id", "label", "field", "value")
