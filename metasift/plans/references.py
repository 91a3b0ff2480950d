"""Reference parsing, naming and ARN grouping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.functions import text as tx
from metasift.operators import inventory as inv
from metasift.plans.catalog import fixture, query, table

URN = "fx_urn"
JOB = r"^urn:li:dataJob:\(urn:li:dataFlow:\(([^,]+),([^,]+),([^)]+)\),([^)]+)\)$"
FLOW = r"^urn:li:dataFlow:\(([^,]+),([^,]+),([^)]+)\)$"
DATASET = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\)$"
PARSED = f"""p as (select k, ref, case when regexp_matches(ref,'{JOB}') then regexp_extract(ref,'{JOB}',['a','b','c','d'])
 when regexp_matches(ref,'{FLOW}') then regexp_extract(ref || '#','^urn:li:dataFlow:\\(([^,]+),([^,]+),([^)]+)\\)(#)$',['a','b','c','d'])
 when regexp_matches(ref,'{DATASET}') then regexp_extract(ref || '#','^urn:li:dataset:\\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\\)(#)$',['a','b','c','d']) end as s from fx_urn)"""


@query("F01", "parse_urn", f"""
with {PARSED} select k, ref, s.a as platform, s.c as environment, s.b as flow_id, nullif(s.d, '#') as job_id from p""", URN)
def parse_urn(spark, sf):
    return fixture(spark, sf, URN).withColumn("u", tx.parse_urn(F.col("ref"))).select(
        "k", "ref", "u.platform", "u.environment", "u.flow_id", "u.job_id")


@query("F02", "format_urn", f"with {PARSED} select k, ref as again from p where s is not null", URN)
def format_urn(spark, sf):
    return fixture(spark, sf, URN).withColumn("u", tx.parse_urn(F.col("ref"))).where("u is not null").select(
        "k", tx.format_urn(F.col("u")).alias("again"))


ARN = """a as (select k, ref, string_split(ref, ':') as s from fx_urn),
arn as (select k, ref, s[3] as service, s[4] as region, s[5] as account_id, array_to_string(s[6:], ':') as resource_id
 from a where s[1] = 'arn' and len(s) >= 6)"""


@query("F03", "parse_arn", f"with {ARN} select k, service, region, account_id, resource_id from arn", URN)
def parse_arn(spark, sf):
    return fixture(spark, sf, URN).withColumn("a", tx.parse_arn(F.col("ref"))).where("a is not null").select(
        "k", "a.service", "a.region", "a.account_id", "a.resource_id")


@query("F06", "arn_environment", f"""
with {ARN} select distinct 'aws' as provider, region, account_id from arn""", URN)
def arn_environment(spark, sf):
    return inv.arn_environments(fixture(spark, sf, URN).select(F.col("ref").alias("urn"))).select(
        "provider", "region", "account_id").distinct()


@query("A08", "group_cloud_environments", f"""
with {ARN} select region, account_id, count(distinct ref) as nodes, min(ref) as first_urn, max(ref) as last_urn
from arn group by 1, 2""", URN)
def group_cloud_environments(spark, sf):
    g = inv.cloud_environments(fixture(spark, sf, URN).select(F.col("ref").alias("urn")))
    return g.groupBy("region", "account_id").agg(
        F.count("*").alias("nodes"), F.min("urn").alias("first_urn"), F.max("urn").alias("last_urn"))


@query("D31", "tagged_resource_inventory", """
with a as (select distinct ref, string_split(ref, ':') as s from fx_urn where len(string_split(ref, ':')) >= 3),
r as (select s[3] as service, string_split(s[-1], '/')[-1] as identifier, ref,
 row_number() over (partition by s[3] order by ref) as rn from a)
select service, identifier, rn::int as rn from r""", URN)
def tagged_resource_inventory(spark, sf):
    refs = fixture(spark, sf, URN).select("ref").distinct()
    return inv.tagged_resources(refs).select("service", "identifier", "rn")


@query("F07", "asset_name", """
select payload_id, item_pos, trim(string_split(id,'||')[-1]) as name from fx_asset""", "fx_asset")
def asset_name(spark, sf):
    return fixture(spark, sf, "fx_asset").select("payload_id", "item_pos", tx.asset_name(F.col("id")).alias("name"))


@query("F16", "lookup_key", """
select item_pos, lower(trim(regexp_replace(trim(string_split(id,'||')[-1]), '[^a-zA-Z0-9]+', ' ', 'g'))) as k from fx_asset""",
       "fx_asset")
def lookup_key(spark, sf):
    return fixture(spark, sf, "fx_asset").select("item_pos", tx.lookup_key(F.col("id")).alias("k"))


@query("P30", "display_name", """
with a as (select item_pos, lower(id) as low, string_split(id,' || ')[-1] as name from fx_asset),
c as (select item_pos, low, regexp_replace(regexp_replace(name, '-[a-f0-9]{8,}$', '', 'i'), '[_-]', ' ', 'g') as cut from a),
t as (select item_pos, low, array_to_string(list_transform(string_split(cut,' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as t from c)
select item_pos, t as title,
 case """ + " ".join(f"when contains(low,'{w}') then '{v}'" for w, v in rules.RESOURCE_LABELS) + """ else 'Lambda Function' end as subtitle
from t""", "fx_asset")
def display_name(spark, sf):
    return fixture(spark, sf, "fx_asset").withColumn("d", tx.display_name(F.col("id"))).select(
        "item_pos", "d.title", "d.subtitle")


@query("D27", "detect_platform_by_name", """
select item_pos, case when item_pos % 11 = 0 then 'gcp' """ + " ".join(
    "when " + " or ".join(f"contains(lower(id), '{w}')" for w in ws) + f" then '{p}'" for p, ws in rules.PLATFORM_WORDS
) + """ else 'unknown' end as platform from (select item_pos, id || case item_pos % 4 when 0 then '-glue' when 1 then '-adf' when 2 then '-dlt' else '' end as id from fx_asset)""",
       "fx_asset")
def detect_platform_by_name(spark, sf):
    a = fixture(spark, sf, "fx_asset")
    tail = F.expr("case item_pos % 4 when 0 then '-glue' when 1 then '-adf' when 2 then '-dlt' else '' end")
    hint = F.when(F.col("item_pos") % 11 == 0, "GCP")
    return a.select("item_pos", tx.platform_by_name(F.concat("id", tail), hint).alias("platform"))


def template_case(platform: str) -> str:
    keys = rules.TEMPLATE_KEYS[platform]
    arms = " ".join(f"when contains('{k}', n) or contains(n, '{k}') then '{k}'" for k in keys)
    return f"case {arms} else '{keys[0]}' end as {platform}"


@query("J13", "template_lookup", f"""
select p_partkey, {template_case('azure')}, {template_case('databricks')}, {template_case('snowflake')}
from (select p_partkey, case p_partkey % 4 when 0 then 'dbt' when 1 then 'sf-cdc-pipeline-' || p_partkey
 when 2 then 'api' else lower(p_name) end as n from part)""")
def template_lookup(spark, sf):
    n = F.expr("case p_partkey % 4 when 0 then 'DBT' when 1 then concat('SF-CDC-pipeline-', p_partkey)"
               " when 2 then 'api' else p_name end")
    return table(spark, sf, "part").select("p_partkey", *[tx.template_for(n, p).alias(p) for p in rules.TEMPLATE_KEYS])
