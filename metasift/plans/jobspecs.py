"""Job-specification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import text as tx
from metasift.operators import jobspecs as js
from metasift.plans.catalog import fixture, query

JOB = "fx_jobspec"


def specs(spark, sf):
    return fixture(spark, sf, JOB)


def sources(spark, sf):
    """Source documents: every type's own fields, some incomplete."""
    j = specs(spark, sf)
    doc = F.to_json(F.struct(
        F.nullif("source_type", F.lit("ftp")).alias("source_type"), F.lit("eu").alias("aws_region"), F.col("bucket").alias("source_bucket"), "file_format",
        F.col("secret_value").alias("aws_secret_access_key"), F.lit("p1").alias("gcp_project_id"), F.col("secret_value").alias("service_account_json"),
        F.when(F.col("compression") == "snappy", F.lit("ds")).alias("bq_dataset"), F.lit("tb").alias("bq_table"), F.col("bucket").alias("gcs_bucket"),
        F.lit("acc").alias("sf_account"), F.lit("me").alias("sf_user"), F.col("secret_value").alias("sf_password"), F.lit("wh").alias("sf_warehouse"),
        F.col("bucket").alias("sf_database"), F.lit("t").alias("sf_table"), F.lit("h").alias("pg_host"), F.col("bucket").alias("pg_database"), F.lit("u").alias("pg_user"),
        F.col("secret_value").alias("pg_password"), F.when(F.col("file_format") != "csv", "t").alias("pg_table"), F.lit("https://sf").alias("sf_instance_url"),
        F.lit("id").alias("sf_client_id"), F.col("secret_value").alias("sf_client_secret"), F.lit("Lead").alias("object_name")))
    return js.parse_source(j.select("job_id", doc.alias("source")))


BAD = "source_type = 'ftp' or (source_type = 'postgres' and file_format = 'csv')"
LABEL = """case source_type when 'aws' then 's3://' || bucket || '/' when 'gcp' then case when compression = 'snappy' then 'p1.ds.tb' else 'gs://' || bucket || '/' end
 when 'snowflake' then bucket || '.PUBLIC.t' when 'postgres' then 'h/' || bucket || '.public.t' when 'salesforce' then 'https://sf/sobjects/Lead' end"""


@query("P25", "parse_source_spec", """
select job_id, nullif(source_type, 'ftp') as source_type, case when source_type = 'ftp' then 'missing:source_type' when source_type = 'postgres' and file_format = 'csv' then 'missing:pg_table' else '' end as errors,
 case source_type when 'postgres' then '5432' end as pg_port from fx_jobspec""", JOB)
def parse_source_spec(spark, sf):
    return sources(spark, sf).select("job_id", "source_type", F.array_join("errors", "|").alias("errors"), F.col("fields.pg_port").alias("pg_port"))


@query("P26", "source_label", f"select job_id, {LABEL} as label from fx_jobspec where not ({BAD})", JOB)
def source_label(spark, sf):
    return sources(spark, sf).where(F.size("errors") == 0).select("job_id", js.source_label(F.col("fields"), F.col("source_type")).alias("label"))


@query("P22", "credential_split", f"""
select 'clean' as part, 'etl-src-' || source_type || '-' || job_id[1:8] as secret_name, job_id, null as secret from fx_jobspec where not ({BAD})
union all select 'secret', 'etl-src-' || source_type || '-' || job_id[1:8], null, secret_value from fx_jobspec where not ({BAD})""", JOB)
def credential_split(spark, sf):
    clean, hidden = js.credential_split(sources(spark, sf).where(F.size("errors") == 0))
    leak = F.to_json("fields").contains("secret-")
    none = F.lit(None).cast("string")
    return clean.select(F.lit("clean").alias("part"), F.col("source_secret_name").alias("secret_name"), "job_id", F.when(leak, "leak").alias("secret")).unionByName(
        hidden.select(F.lit("secret").alias("part"), F.col("source_secret_name").alias("secret_name"), none.alias("job_id"), F.element_at(F.map_values("secrets"), 1).alias("secret")))


@query("P23", "partition_pattern_columns", """
select job_id, case when job_id like '%7' then 'given' when partition_pattern is null then '' else 'year,month' end as cols from fx_jobspec""", JOB)
def partition_pattern_columns(spark, sf):
    given = F.when(F.col("job_id").endswith("7"), F.array(F.lit("given"))).otherwise(F.array().cast("array<string>"))
    return specs(spark, sf).select("job_id", F.array_join(js.partition_columns(F.col("partition_pattern"), given), ",").alias("cols"))


FLAT = """f as (select *, cast(job_id[10:] as bigint) as n from fx_jobspec)"""
FLAT_RULES = [
    ("access_key_auth", "source_type = 'aws' and n % 5 = 0"), ("cron_fields", "cron_expression = 'bad cron'"), ("cron_required", "n % 2 = 1 and cron_expression is null"),
    ("watermark_spaces", "watermark_column is not null and n % 11 = 0"), ("cdc_lsn", "extraction_mode = 'cdc' and n % 3 = 0"), ("column_overlap", "n % 4 = 0"),
    ("limit_and_sample", "n % 13 = 0"), ("csv_snappy", "file_format = 'csv' and compression = 'snappy'"), ("row_count_range", "n % 17 = 0"), ("email", "email = 'not-an-email'"),
    ("slack_url", "n % 6 = 1"), ("incremental_block", "extraction_mode = 'incremental' and watermark_column is null"), ("cdc_block", "extraction_mode = 'cdc' and n % 3 = 1"),
    ("range:batch_size", "batch_size not between 100 and 5000000"), ("range:max_active_runs", "n % 15 not between 1 and 10"), ("range:parallelism", "n % 40 not between 1 and 32"),
    ("range:max_file_size_mb", "n % 3000 not between 16 and 2048"), ("description_length", "n % 8 = 0"), ("sas_auth", "source_type = 'aws' and n % 5 = 1"),
]


@query("P24", "validate_job_spec", f"with {FLAT} " + " union all ".join(
    f"select job_id, '{c}' as code from f where {w}" for c, w in FLAT_RULES), JOB)
def validate_job_spec(spark, sf):
    n = F.col("n")
    flat = specs(spark, sf).withColumn("n", F.expr("substring(job_id, 10)").cast("bigint")).withColumns({
        "aws_auth_type": F.when(n % 5 == 0, "Access Key").when(n % 5 == 1, "SAS Token").otherwise("IAM Role"), "aws_access_key_id": F.lit("AK"),
        "aws_secret_access_key": F.lit(""), "aws_sas_token": F.lit(None).cast("string"), "schedule_enabled": n % 2 == 1,
        "watermark_column": F.when(n % 11 == 0, F.concat("watermark_column", F.lit(" x"))).otherwise(F.col("watermark_column")),
        "cdc_mode": F.when(n % 3 == 0, "log_based").when(n % 3 == 2, "query_based"), "lsn_column": F.when(F.col("extraction_mode") != "cdc", "lsn"),
        "include_columns": F.array(F.lit("a"), F.lit("b")), "exclude_columns": F.when(n % 4 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("z"))),
        "row_limit": F.when(n % 13 == 0, 10), "sample_percent": F.lit(5.0), "row_count_min": F.lit(10), "row_count_max": F.when(n % 17 == 0, 5).otherwise(50),
        "slack_webhook_url": F.when(n % 6 == 1, "http://x").otherwise("https://hooks.slack.com/x"), "max_active_runs": n % 15, "parallelism": n % 40,
        "max_file_size_mb": n % 3000, "description": F.when(n % 8 == 0, F.repeat(F.lit("d"), 501)).otherwise("ok")})
    return js.validate(flat)


@query("U03", "column_overlap", """
select job_id, case when file_format = 'csv' then 'bucket|email' else 'email' end as overlap from fx_jobspec""", JOB)
def column_overlap(spark, sf):
    inc = F.array(F.lit("bucket"), F.lit("x"), F.lit("email"))
    exc = F.when(F.col("file_format") == "csv", F.array(F.lit("email"), F.lit("bucket"))).otherwise(F.array(F.lit("email")))
    return specs(spark, sf).select("job_id", F.array_join(js.column_overlap(inc, exc), "|").alias("overlap"))


@query("F20", "valid_email", "select job_id, email <> 'not-an-email' as ok from fx_jobspec", JOB)
def valid_email(spark, sf):
    return specs(spark, sf).select("job_id", tx.valid_email(F.col("email")).alias("ok"))


@query("F21", "valid_cron_shape", "select job_id, cron_expression <> 'bad cron' as ok from fx_jobspec", JOB)
def valid_cron_shape(spark, sf):
    return specs(spark, sf).select("job_id", tx.valid_cron_shape(F.col("cron_expression")).alias("ok"))


@query("F19", "template_fill", "select job_id, 'landing/' || source_type || '/' || job_id || '/x' as path from fx_jobspec", JOB)
def template_fill(spark, sf):
    return specs(spark, sf).select("job_id", tx.fill_template(F.lit("landing/{source_type}/{job_id}/x"), source_type=F.col("source_type"), job_id=F.col("job_id")).alias("path"))


@query("F18", "to_text_param", """
select job_id, coalesce(partition_pattern, '') as pattern, case when file_format = 'csv' then 'true' else 'false' end as flag, bucket || ',' || email as items from fx_jobspec""", JOB)
def to_text_param(spark, sf):
    return specs(spark, sf).select("job_id", tx.text_param(F.col("partition_pattern")).alias("pattern"), tx.text_param(F.col("file_format") == "csv").alias("flag"),
                                   tx.text_param(F.array("bucket", "email"), "list").alias("items"))


@query("P27", "route_fields_to_sections", """
with l as (select config_id, case when k = 'owner' then 'auth' else k end as k, v from fx_field where v <> '')
select 'a' as variant, config_id, case k when 'auth' then 'authentication' else k end as k, v, case k when 'host' then 'connection' when 'auth' then 'connection' when 'mode' then 'extraction' else 'data_profile' end as section from l
union all select 'b', config_id, case k when 'owner' then 'owner' else k end, v, case k when 'host' then 'connection' when 'owner' then 'connection' when 'mode' then 'extraction' else 'data_profile' end from fx_field where v <> ''""", "fx_field")
def route_fields_to_sections(spark, sf):
    f = fixture(spark, sf, "fx_field")
    a = js.route_fields(f.withColumn("k", F.when(F.col("k") == "owner", "auth").otherwise(F.col("k")))).withColumn("variant", F.lit("a"))
    return a.unionByName(js.route_fields(f, "connection").withColumn("variant", F.lit("b")))


def runtime(spark, sf):
    j = specs(spark, sf)
    ing = j.select("job_id", "extraction_mode", "batch_size", "watermark_column", F.col("cron_expression").alias("schedule_cron"), "file_format", "compression",
                   F.col("email").alias("notify_email"), F.create_map(F.lit("team"), F.lit("data"), F.lit("env"), F.lit("dev")).alias("tags"),
                   F.array(F.lit("a"), F.lit("b")).alias("include_columns"))
    sink = j.select("job_id", F.lit("pl").alias("adf_pipeline_name"), F.lit("lake").alias("adls_account_name"), F.lit("raw").alias("adls_container"),
                    F.lit("stg_{source_type}").alias("synapse_table"), F.lit("kv").alias("key_vault_name"))
    return js.merge_layers(sources(spark, sf), ing, sink, "2024-01-01T00:00:00", {"env": "prod"})


@query("M20", "merge_job_layers", f"""
select job_id, source_type, {LABEL} as source_label, extraction_mode, batch_size, 1::int as parallelism, 'UTC' as schedule_timezone, cron_expression as schedule_cron, watermark_column, file_format, compression,
 256::int as max_file_size_mb, 'landing/' || source_type || '/' || job_id || '/' as adls_sink_path, 'stg_' || source_type as synapse_table, 'append' as write_mode,
 'etl-src-' || source_type || '-' || job_id[1:8] as source_secret_name, 'validated' as status, 'env=prod|source_type=' || source_type || '|team=data' as tags, 49::int as n_columns from fx_jobspec where not ({BAD})""", JOB)
def merge_job_layers(spark, sf):
    r = runtime(spark, sf)
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return r.select("job_id", "source_type", "source_label", "extraction_mode", "batch_size", "parallelism", "schedule_timezone", "schedule_cron", "watermark_column",
                    "file_format", "compression", "max_file_size_mb", "adls_sink_path", "synapse_table", "write_mode", "source_secret_name", "status", tags.alias("tags"),
                    F.lit(len(r.columns)).alias("n_columns"))


FIXED = {
    "createdAt": "'2024-01-01T00:00:00'", "sourceType": "source_type", "sourceLabel": f"({LABEL})", "sourceSecretName": "'etl-src-' || source_type || '-' || job_id[1:8]",
    "keyVaultName": "'kv'", "extractionMode": "extraction_mode", "batchSize": "batch_size::varchar", "parallelism": "'1'", "scheduleEnabled": "'false'",
    "scheduleCron": "coalesce(cron_expression, '')", "scheduleTimezone": "'UTC'", "watermarkColumn": "coalesce(watermark_column, '')", "lookbackMinutes": "'0'",
    "includeColumns": "'a,b'", "fileFormat": "file_format", "compression": "compression", "maxFileSizeMb": "'256'", "addMetadataCols": "'true'", "schemaDriftAction": "'warn'",
    "maxRetries": "'3'", "retryIntervalSecs": "'60'", "timeoutSeconds": "'3600'", "notifyOnFailure": "'true'", "notifyEmail": "email", "adfPipelineName": "'pl'",
    "adlsAccountName": "'lake'", "adlsContainer": "'raw'", "adlsSinkPath": "'landing/' || source_type || '/' || job_id || '/'", "writeMode": "'append'",
    "synapseTable": "'stg_' || source_type", "jobId": "job_id", "tags": "'{\"source_type\":\"' || source_type || '\",\"team\":\"data\",\"env\":\"prod\"}'",
}


@query("M21", "job_parameters", "select job_id, name, value from (select job_id, unnest([" + ", ".join(f"'{n}'" for _, n, _ in js.PARAMETERS) + "]) as name, unnest(["
       + ", ".join(FIXED.get(n, "''") for _, n, _ in js.PARAMETERS) + f"]) as value from fx_jobspec where not ({BAD}))", JOB)
def job_parameters(spark, sf):
    return js.job_parameters(runtime(spark, sf))
