"""Typed connection settings from payloads.

An extractor is a list of fields, each a Column over a frame prepared by :func:`prepared`.
Results are long rows ``(payload_id, extractor, field, value)`` without empty values; lists
are ``|``-joined texts.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.functions import text as tx
from metasift.operators import inventory as inv
from metasift.operators.detect import literal_runs
from metasift.operators.jsonwalk import holding, walk
from metasift.operators.payload import find_key, with_lookups, with_text
from metasift.session import cut_lineage, shuffled

ROLE_ARN = r"arn:aws:iam::[0-9]+:role/[^\s\"'>,]+"

# Per extractor its display type and fields.  A field is a list of keys to look up,
# or (mode, pattern): all = every match, group = first group of every match, first = first match.
EXTRACTORS: dict[str, tuple[str, dict]] = {
    "snowflake": ("Snowflake", {
        "account": ["snowflake_account", "account"], "warehouse": ["warehouse", "snowflake_warehouse"],
        "database": ["snowflake_database", "database"], "schema": ["snowflake_schema", "schema"],
        "role": ["snowflake_role", "role"], "username": ["snowflake_user", "username"]}),
    "kafka": ("Apache Kafka", {
        "bootstrap_servers": ["bootstrap_servers", "kafka_brokers", "brokers"],
        "topics": ("group", r"kafka[._-]topic[s]?\s*[=:]\s*['\"]?([^\s\"',]+)"),
        "security_protocol": ["security_protocol"], "sasl_mechanism": ["sasl_mechanism"]}),
    "bigquery": ("Google BigQuery", {
        "project_id": ["gcp_project_id", "project_id", "project"], "dataset": ["bq_dataset", "dataset", "bigquery_dataset"],
        "table": ["bq_table", "table"], "location": ["bq_location", "location"]}),
    "jdbc": ("JDBC", {"jdbc_url": ("first", tx.JDBC_URL), "username": ["db_user", "username", "user"]}),
    "glue": ("AWS Glue", {
        "job_name": ["job_name", "glue_job_name", "name"], "region": ["aws_region", "region"], "role_arn": ("first", ROLE_ARN),
        "script_location": ["script_location", "script_path"], "temp_dir": ["temp_dir", "temp_directory"], "worker_type": ["worker_type"],
        "number_of_workers": ["number_of_workers", "num_workers"], "glue_version": ["glue_version"], "connections": ("all", tx.JDBC_URL)}),
    "adf": ("Azure Data Factory", {
        "factory_name": ["factory_name", "adf_name", "data_factory_name"], "resource_group": ["resource_group"],
        "subscription_id": ["subscription_id", "azure_subscription_id"], "pipeline_name": ["pipeline_name", "name"],
        "trigger_type": ["trigger_type", "trigger"], "linked_services": ("group", r"linked.?service[s]?\s*[=:]\s*['\"]?([^\s\"',]+)")}),
    "databricks": ("Databricks", {
        "host": ["databricks_host", "workspace_url"], "cluster_id": ["cluster_id", "databricks_cluster_id"],
        "notebook_path": ["notebook_path", "notebook"], "job_name": ["job_name", "name"],
        "runtime_version": ["spark_version", "runtime_version"], "node_type": ["node_type_id", "node_type"],
        "num_workers": ["num_workers", "number_of_workers"]}),
    "airflow": ("Apache Airflow", {
        "dag_id": ["dag_id"], "schedule": ["schedule_interval", "schedule", "cron"], "start_date": ["start_date"],
        "catchup": ["catchup"], "tags": ("group", r"tags\s*=\s*\[([^\]]+)\]")}),
    "spark": ("Apache Spark", {
        "app_name": ["app_name", "spark_app_name"], "master": ["master", "spark_master"], "deploy_mode": ["deploy_mode"],
        "executor_memory": ["executor_memory"], "executor_cores": ["executor_cores"], "num_executors": ["num_executors"],
        "packages": ("group", r"--packages\s+([^\s]+)")}),
    "dbt": ("dbt", {
        "project_name": ["project_name", "dbt_project"], "target": ["target", "dbt_target"], "profile": ["profile", "dbt_profile"],
        "models": ("group", r"dbt.*model[s]?\s*[=:]\s*['\"]?([^\s\"',]+)"), "schema": ["schema", "target_schema"]}),
    "fivetran": ("Fivetran", {
        "connector_id": ["connector_id", "fivetran_connector"], "destination": ["destination", "fivetran_destination"],
        "sync_frequency": ["sync_frequency"]}),
    "kafka_connect": ("Kafka Connect", {
        "connector_name": ["connector_name", "name"], "connector_class": ["connector_class"],
        "bootstrap_servers": ["bootstrap_servers"], "topics": ["topics"], "tasks_max": ["tasks_max"]}),
    "step_functions": ("AWS Step Functions", {
        "state_machine_name": ["state_machine_name", "name"],
        "state_machine_arn": ("first", r"arn:aws:states:[a-z0-9-]+:[0-9]+:stateMachine:[^\s\"'>,]+"),
        "region": ["aws_region", "region"], "role_arn": ("first", ROLE_ARN)}),
    "dataflow": ("GCP Dataflow", {
        "job_name": ["job_name", "dataflow_job", "name"], "project_id": ["gcp_project_id", "project_id", "project"],
        "region": ["region", "gcp_region"], "template": ["template", "dataflow_template"], "temp_location": ["temp_location"],
        "staging_location": ["staging_location"]}),
}

# Keys that the extractors with fields of their own look up.
KEYS: dict[str, dict[str, list[str]]] = {
    "s3": {"region": ["aws_region", "region"], "access_key_configured": ["aws_access_key_id", "access_key"]},
    "adls": {"storage_account": ["storage_account", "azure_storage_account"], "tenant_id": ["azure_tenant_id", "tenant_id"]},
    "gcs": {"project_id": ["gcp_project_id", "project_id", "project"]},
    "redshift": {"host": ["redshift_host", "cluster_endpoint"], "port": ["redshift_port", "port"],
                 "database": ["redshift_database", "database", "db"], "username": ["redshift_user", "db_user", "username"]},
    "rest_api": {"auth_type": ["auth_type", "authentication"], "api_key_configured": ["api_key", "x_api_key"]},
}

# Detected label to extractor.
SOURCE_EXTRACTORS = {
    "S3": "s3", "ADLS Gen2": "adls", "WASB/Azure Blob": "adls", "GCS": "gcs", "JDBC/Redshift": "redshift", "Snowflake Stage": "snowflake",
    "Kafka Topic": "kafka", "BigQuery": "bigquery", "JDBC/PostgreSQL": "jdbc", "JDBC/MySQL": "jdbc", "JDBC/MSSQL": "jdbc",
    "JDBC/Oracle": "jdbc", "JDBC/Generic": "jdbc", "REST API": "rest_api", "Microsoft Fabric": "fabric",
}
INGESTION_EXTRACTORS = {
    "AWS Glue Jobs": "glue", "ADF Pipelines": "adf", "Databricks Jobs": "databricks", "Apache Airflow DAGs": "airflow",
    "Apache Spark Jobs": "spark", "dbt Jobs": "dbt", "Fivetran": "fivetran", "Kafka Connect": "kafka_connect",
    "AWS Step Functions": "step_functions", "GCP Dataflow": "dataflow",
}


def prepared(payloads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Payloads with lookup maps, of ``keys`` alone if given, and lower-case text, each computed once."""
    return with_text(with_lookups(payloads, keys))


def where_held(pattern: str, found: Column) -> Column:
    """``found`` where the lower-case text holds all literal parts of ``pattern``, so that the regex seldom runs."""
    held = [F.col("txt").contains(r.lower()) for r in literal_runs(pattern)]
    return F.when(functools.reduce(operator.and_, held), found) if held else found


def all_matches(pattern: str, group: int = 0) -> Column:
    return where_held(pattern, F.nullif(F.array_join(tx.find_all(F.col("txt"), pattern, group), "|"), F.lit("")))


def first_match(pattern: str) -> Column:
    return where_held(pattern, tx.find_first(F.col("txt"), pattern))


def one_field(spec) -> Column:
    if isinstance(spec, list):
        return find_key(*spec)
    mode, pattern = spec
    if mode == "first":
        return first_match(pattern)
    return all_matches(pattern, 1 if mode == "group" else 0)


def first_path(pattern: str, capture: str) -> Column:
    return where_held(pattern, tx.capture(tx.find_first(F.col("txt"), pattern), capture))


def keys_of(name: str) -> list[str]:
    """Every key that an extractor looks up."""
    lists = KEYS[name].values() if name in KEYS else [s for s in EXTRACTORS[name][1].values() if isinstance(s, list)]
    return [k for keys in lists for k in keys]


def fields_of(name: str) -> dict[str, Column]:
    """Fields of an extractor as Columns."""
    if name in EXTRACTORS:
        kind, spec = EXTRACTORS[name]
        return {"type": F.lit(kind), **{f: one_field(s) for f, s in spec.items()}}
    look = {f: find_key(*keys) for f, keys in KEYS[name].items()}
    flag = lambda f: F.when(look[f].isNotNull(), "true").otherwise("false")
    if name == "s3":
        return {"type": F.lit("Amazon S3"), "paths": all_matches(tx.S3_PATH), "bucket": first_path(tx.S3_PATH, "s3[an]?://([^/]+)"),
                "region": look["region"], "access_key_configured": flag("access_key_configured")}
    if name == "adls":
        return {"type": F.lit("Azure Data Lake Storage Gen2"), "paths": all_matches(tx.ABFSS_PATH),
                "container": first_path(tx.ABFSS_PATH, "abfss?://([^@]+)@"), **look}
    if name == "gcs":
        return {"type": F.lit("Google Cloud Storage"), "paths": all_matches(tx.GCS_PATH), "bucket": first_path(tx.GCS_PATH, "gs://([^/]+)"), **look}
    if name == "redshift":
        pattern = r"jdbc:redshift://[^\s\"'>,]+"
        url = tx.find_first(F.col("txt"), pattern)
        return {"type": F.lit("Amazon Redshift"), "host": F.coalesce(look["host"], where_held(pattern, tx.capture(url, "jdbc:redshift://([^:/]+)"))),
                "port": F.coalesce(look["port"], F.lit("5439")),
                "database": F.coalesce(look["database"], where_held(pattern, tx.capture(url, "/([^?]+)$"))),
                "jdbc_url": first_match(pattern), "username": look["username"]}
    urls = tx.find_all(F.col("txt"), r"https?://[^\s\"'>,]+api[^\s\"'>,]*")
    return {"type": F.lit("REST API"), "endpoints": F.nullif(F.array_join(urls, "|"), F.lit("")),
            "auth_type": look["auth_type"], "api_key_configured": flag("api_key_configured")}


ROWS = "array<struct<extractor:string,field:string,value:string>>"
ALL_NAMES = ["s3", "adls", "gcs", "redshift", "rest_api", *EXTRACTORS]


def field_rows(name: str, fields: dict[str, Column]) -> Column:
    """Array of (extractor, field, value) without empty values."""
    return F.filter(F.array(*[F.struct(F.lit(name).alias("extractor"), F.lit(f).alias("field"), c.cast("string").alias("value"))
                              for f, c in fields.items()]), lambda x: F.coalesce(x["value"], F.lit("")) != "")


def typed_config(payloads: DataFrame, name: str) -> DataFrame:
    """One extractor over every payload."""
    return prepared(payloads).select("payload_id", F.explode(field_rows(name, fields_of(name))).alias("r")).select("payload_id", "r.*")


def detected_configs(payloads: DataFrame, labels: DataFrame, mapping: dict[str, str], assets: DataFrame | None = None) -> DataFrame:
    """Typed settings for every detected label ``labels(payload_id, label)`` that ``mapping`` names an extractor for.

    What a payload gives is read once per extractor, before a join by shuffle that moves neither texts nor lookup
    maps; the labels then pick the extractor per row.  With ``assets`` the first discovered bucket and the discovered endpoints
    stand in where a text has none (C01, C09), and Fabric items give their settings, one row per value (C10).
    """
    names = list(dict.fromkeys(n for n in mapping.values() if n != "fabric"))
    p = prepared(payloads, [k for n in names for k in keys_of(n)]).select(
        "payload_id", *[field_rows(n, fields_of(n)).alias(f"of_{n}") for n in names])
    none = F.array().cast(ROWS)
    labels = labels.where(F.col("label").isin(*mapping))
    fabric = [label for label, name in mapping.items() if name == "fabric" and assets is not None]
    if fabric:
        labels = cut_lineage(labels)  # two branches read them
    rows = F.when(F.lit(False), none)
    for label, name in mapping.items():
        if name in names:
            rows = rows.when(F.col("label") == label, F.col(f"of_{name}"))
    found = p.join(shuffled(labels), "payload_id").select("payload_id", "label", rows.alias("rows"))
    if assets is not None:
        def instead(x: Column) -> Column:
            own = x["extractor"] == F.get("rows", F.lit(0))["extractor"]
            return own & ~F.exists("rows", lambda r: (r["field"] == x["field"]) | ((x["extractor"] == "s3") & (r["field"] == "paths")))

        found = found.join(shuffled(discovered(assets)), "payload_id", "left").select(
            "payload_id", "label", F.concat("rows", F.coalesce(F.filter("more", instead), none)).alias("rows"))
    typed = found.select("payload_id", "label", F.explode("rows").alias("r")).select("payload_id", "label", "r.*")
    if not fabric:
        return typed
    named = labels.where(F.col("label").isin(*fabric))
    items = named.join(shuffled(fabric_source_config(assets)), "payload_id").select("payload_id", "label", "field", "value").unionByName(
        named.select("payload_id", "label", F.lit("type").alias("field"), F.lit("Microsoft Fabric").alias("value")))
    return typed.unionByName(items.select("payload_id", "label", F.lit("fabric").alias("extractor"), "field", "value"))


def discovered(assets: DataFrame) -> DataFrame:
    """(payload_id, more): settings that the inventory gives the extractors s3 and rest_api, as :func:`field_rows`."""
    name = tx.asset_name(F.col("id"))
    s3 = inv.first_asset(assets, "s3").select("payload_id", field_rows("s3", {
        "paths": F.concat(F.lit("s3://"), name, F.lit("/")), "bucket": name, "region": F.coalesce(inv.config_text("region"), inv.config_text("Region"))}).alias("s3"))
    api = assets.where("service = 'apigateway'")
    n = api.groupBy("payload_id").agg(F.count("*").alias("n"))
    urls = api.select("payload_id", inv.config_text("PublicInvokeURL").alias("value"), "dump_pos", "item_pos").where("value is not null")
    found = inv.joined(inv.first_n(urls, ["payload_id"], ["dump_pos", "item_pos"], None), "found")
    rest = n.join(shuffled(found), "payload_id", "left").select("payload_id", field_rows("rest_api", {
        "endpoints": F.col("found"), "discovery_notes": F.concat(F.lit("Discovered "), F.col("n"), F.lit(" endpoints"))}).alias("rest"))
    return s3.join(shuffled(rest), "payload_id", "full_outer").select("payload_id", F.concat(
        *[F.coalesce(c, F.array().cast(ROWS)) for c in ("s3", "rest")]).alias("more"))


def config_rows(df: DataFrame, name: str, fields: dict[str, Column]) -> DataFrame:
    return df.select("payload_id", F.explode(field_rows(name, fields)).alias("r")).select("payload_id", "r.*")


def s3_config(payloads: DataFrame, assets: DataFrame) -> DataFrame:
    """S3 settings; without a path in the text the first discovered bucket stands in."""
    f = fields_of("s3")
    a = inv.first_asset(assets, "s3").select("payload_id", F.col("id").alias("a_id"), "configuration")
    p = prepared(payloads).join(a, "payload_id", "left")
    guess = f["paths"].isNull() & F.col("a_id").isNotNull()
    name = tx.asset_name(F.col("a_id"))
    f["bucket"] = F.when(guess, name).otherwise(f["bucket"])
    f["paths"] = F.when(guess, F.concat(F.lit("s3://"), name, F.lit("/"))).otherwise(f["paths"])
    f["region"] = F.coalesce(f["region"], F.when(guess, F.coalesce(inv.config_text("region"), inv.config_text("Region"))))
    return config_rows(p, "s3", f)


def rest_api_config(payloads: DataFrame, assets: DataFrame, shown: int | None = None) -> DataFrame:
    """REST settings; without URLs in the text the discovered invoke URLs, the first ``shown`` if given."""
    f = fields_of("rest_api")
    api = assets.where("service = 'apigateway'")
    n = api.groupBy("payload_id").agg(F.count("*").alias("n"))
    urls = api.select("payload_id", inv.config_text("PublicInvokeURL").alias("value"), "dump_pos", "item_pos").where("value is not null")
    five = inv.joined(inv.first_n(urls, ["payload_id"], ["dump_pos", "item_pos"], shown), "found")
    p = prepared(payloads).join(n, "payload_id", "left").join(five, "payload_id", "left")
    f["endpoints"] = F.coalesce(f["endpoints"], F.col("found"))
    f["discovery_notes"] = F.concat(F.lit("Discovered "), F.col("n"), F.lit(" endpoints"))
    return config_rows(p, "rest_api", f)


def lambda_config(payloads: DataFrame, assets: DataFrame) -> DataFrame:
    """Function settings, discovered ones where the payload has none (C17)."""
    a = inv.first_asset(assets, "lambda").withColumnRenamed("id", "a_id")
    p = prepared(payloads).join(a, "payload_id", "left")
    c = inv.config_text
    return config_rows(p, "lambda", {
        "type": F.lit("AWS Lambda"), "function_name": F.coalesce(find_key("function_name", "lambda_function"), tx.asset_name(F.col("a_id"))),
        "runtime": F.coalesce(find_key("runtime"), c("Runtime")), "handler": F.coalesce(find_key("handler"), c("Handler")),
        "region": find_key("aws_region", "region"), "role_arn": tx.find_first(F.col("txt"), ROLE_ARN),
        "memory_size": F.coalesce(find_key("memory_size"), c("MemorySizeMB")), "timeout": F.coalesce(find_key("timeout"), c("TimeoutSeconds")),
        "function_arn": tx.find_first(F.col("txt"), r"arn:aws:lambda:[a-z0-9-]+:[0-9]+:function:[^\s\"'>,]+"),
        "ingestion_ops": c("IngestionOperations"), "data_formats": c("DataFormats"), "discovered_targets": c("IngestionTargets")})


def azure_function_config(payloads: DataFrame, assets: DataFrame) -> DataFrame:
    """Azure function settings with the first discovered function behind them."""
    a = inv.first_asset(assets, "functions").withColumnRenamed("id", "a_id")
    p = prepared(payloads).join(a, "payload_id", "left")
    return config_rows(p, "azure_function", {
        "type": F.lit("Azure Functions"), "function_name": F.coalesce(find_key("function_name", "name"), tx.asset_name(F.col("a_id"))),
        "location": F.coalesce(find_key("location", "region"), inv.config_text("Location")), "kind": inv.config_text("Kind"), "tags": inv.config_text("Tags")})


def fabric_source_config(assets: DataFrame, cap: int | None = None) -> DataFrame:
    """Workspace names, item types and lake paths, first 20 distinct each, long form."""
    fab = assets.where(F.col("service").isin("fabric_items", "fabric_workspaces"))
    values = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("field"), v.alias("value"), F.lit(i).alias("sub")))
        for i, (k, v) in enumerate([("workspace_names", tx.asset_name(F.col("id"))), ("item_types", inv.config_text("Type")),
                                    ("onelake_paths", inv.config_text("OneLakeFilesPath")), ("onelake_paths", inv.config_text("OneLakeTablesPath"))])]))
    rows = fab.select("payload_id", "dump_pos", "service", "item_pos", F.explode(values).alias("v"))
    once = rows.groupBy("payload_id", "v.field", "v.value").agg(F.min(F.struct("service", "dump_pos", "item_pos", "v.sub")).alias("at"))
    return inv.first_n(once, ["payload_id", "field"], ["at"], cap).select("payload_id", "field", "value", "rn")


def fabric_ingestion_config(assets: DataFrame) -> DataFrame:
    """Distinct item names by kind of item, long form."""
    t = F.lower(inv.config_text("Type"))
    bucket = (F.when(t.isin("pipeline", "datapipeline"), "pipeline_items").when(t == "notebook", "notebook_items").when(t == "sparkjob", "spark_job_items"))
    return assets.where("service = 'fabric_items'").select("payload_id", bucket.alias("field"), tx.asset_name(F.col("id")).alias("value")).where(
        "field is not null and value <> ''").distinct()


def storage_config(payloads: DataFrame, assets: DataFrame, cap: int | None = None) -> DataFrame:
    """Storage blocks per payload: inventory rollups beside paths and keys from the text."""
    roll = inv.storage_rollup(assets, cap)
    found = {"account": ["snowflake_account", "account"], "warehouse": ["warehouse", "snowflake_warehouse"],
             "dataset": ["bq_dataset", "dataset", "bigquery_dataset"], "project": ["gcp_project_id", "project_id", "project"]}
    # What a payload gives is read before the join, which then moves neither texts nor lookup maps.
    p = prepared(payloads, [k for keys in found.values() for k in keys]).select(
        "payload_id", tx.find_all(F.col("txt"), tx.S3_PATH).alias("s3"), tx.find_all(F.col("txt"), tx.GCS_PATH).alias("gs"),
        *[find_key(*keys).alias(f) for f, keys in found.items()])
    j = p.join(roll, "payload_id", "full_outer")
    s3, gs = (F.coalesce(c, F.array().cast("array<string>")) for c in ("s3", "gs"))
    text_buckets = F.array_distinct(F.transform(s3, lambda p: F.regexp_extract(p, "(?i)s3[an]?://([^/]+)", 1)))
    none = F.lit(0).cast("bigint")
    buckets = F.coalesce("bucket_count", none)
    text = lambda arr: F.nullif(F.array_join(tx.leading(arr, cap), "|"), F.lit(""))
    has_s3, has_az = (buckets > 0) | (F.size(s3) > 0), F.coalesce("account_count", none) > 0
    account, dataset = F.col("account"), F.col("dataset")
    fields = {
        "s3.bucket_count": F.when(has_s3, F.when(buckets > 0, buckets).otherwise(F.size(text_buckets))),
        "s3.path_count": F.when(has_s3, F.when(F.size(s3) > 0, F.size(s3)).otherwise(buckets)),
        "s3.paths": text(s3), "s3.buckets": F.when(has_s3, F.coalesce("buckets", text(text_buckets))),
        "azure.account_count": F.when(has_az, F.col("account_count")), "azure.accounts": F.when(has_az, F.col("accounts")),
        "azure.hierarchical_namespace_enabled": F.when(has_az, F.col("any_hns")),
        "gcs.path_count": F.when(F.size(gs) > 0, F.size(gs)), "gcs.paths": text(gs),
        "snowflake.account": account, "snowflake.warehouse": F.when(account.isNotNull(), F.col("warehouse")),
        "bigquery.dataset": dataset, "bigquery.project_id": F.when(dataset.isNotNull(), F.col("project")),
    }
    places = inv.storage_values(assets).select(
        "payload_id", F.concat(F.when(F.col("field") == "locations", "azure.").otherwise("s3."), "field").alias("field"), "value")
    return config_rows(j, "storage", fields).drop("extractor").unionByName(places)


def onelake_config(assets: DataFrame, cap: int | None = None) -> DataFrame:
    """The lake block of C24: path count and first distinct paths, long form."""
    paths = F.array_compact(F.array(inv.config_text("OneLakeFilesPath"), inv.config_text("OneLakeTablesPath")))
    rows = assets.where(F.col("service").isin("fabric_items", "fabric_workspaces")).select("payload_id", "dump_pos", "item_pos", F.posexplode(paths).alias("k", "value"))
    count = rows.groupBy("payload_id").agg(F.count("*").cast("string").alias("value")).select("payload_id", F.lit("onelake.path_count").alias("field"), "value")
    once = rows.groupBy("payload_id", "value").agg(F.min(F.struct("dump_pos", "item_pos", "k")).alias("at"))
    return count.unionByName(inv.first_n(once, ["payload_id"], ["at"], cap).select("payload_id", F.lit("onelake.paths").alias("field"), "value"))


# Keys whose values make up each part of the data-quality settings.
DQ_KEYS = {
    "checks": {"config": ["checks", "assertion", "freshness_check"], "raw_json": ["checks", "validation_sql", "validation", "check"]},
    "dbt_tests": {"raw_json": ["dbt_test"], "config": ["dbt_test"]},
    "suite_names": {"raw_json": ["suite_name", "checkpoint_name"], "config": ["suite_name", "checkpoint_name"]},
    "custom_framework_markers": {"raw_json": ["tool", "monitor", "validator", "class"], "config": ["tool", "monitor", "validator", "class"]},
}


def dq_config(payloads: DataFrame, check_cap: int | None = None) -> DataFrame:
    """Checks, expectations, suites, tests and markers, distinct long rows with counts.

    One walk per surface; a value counts where its own key, or the key of the list it stands
    in, is one of the wanted names.
    """
    parts = []
    for rank, surface in enumerate(("config", "raw_json")):
        if surface not in payloads.columns:
            continue
        wanted = [k for keys in DQ_KEYS.values() for k in keys.get(surface, [])] + ["expectations"]
        w = walk(holding(payloads, surface, wanted), surface, ["payload_id"]).where("kind in ('string', 'number')")
        steps = F.filter(F.col("ord.key"), lambda k: k != "")
        text = F.trim(F.regexp_replace("value", '^"|"$', ""))
        owner = F.lower(F.element_at(steps, -1))
        fields = [F.when(owner.isin(*keys[surface]), F.lit(f)) for f, keys in DQ_KEYS.items() if surface in keys]
        if surface == "raw_json":
            in_exp = F.exists(F.slice("ord", 1, F.size("ord")), lambda s: F.lower(s["key"]) == "expectations")
            fields += [F.when(in_exp & (F.col("key") == "expectation_type"), "expectation_types"),
                       F.when(in_exp & (F.col("key") == "column") & F.col("parent").like("%kwargs"), "columns")]
        parts.append(w.select("payload_id", F.explode(F.array_compact(F.array(*fields))).alias("field"), text.alias("value"),
                              F.struct(F.lit(rank).alias("s"), F.col("ord")).alias("at")).where("value <> ''"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = cut_lineage(rows)  # the wanted values only; four branches read them
    counts = rows.where("field = 'expectation_types'").groupBy("payload_id").agg(F.count("*").cast("string").alias("value"))
    once = rows.groupBy("payload_id", "field", "value").agg(F.min("at").alias("at"))
    n_checks = once.where("field = 'checks'").groupBy("payload_id").agg(F.count("*").cast("string").alias("value"))
    top = inv.first_n(once.where("field = 'checks'"), ["payload_id", "field"], ["at"], check_cap).select("payload_id", "field", "value")
    return (once.where("field <> 'checks'").select("payload_id", "field", "value").unionByName(top)
            .unionByName(counts.select("payload_id", F.lit("expectation_count").alias("field"), "value"))
            .unionByName(n_checks.select("payload_id", F.lit("check_count").alias("field"), "value")))


def expert_extraction(assets: DataFrame) -> DataFrame:
    """Source, ingestion and target from the first API, function and the buckets, long form."""
    c = inv.config_text
    unknown = F.lit("UNKNOWN")
    api = inv.first_asset(assets, "apigateway")
    fn = inv.first_asset(assets, "lambda")
    uri = F.try_variant_get(F.try_parse_json("configuration"), "$.Integrations[0].uri", "string")
    kind = F.try_variant_get(F.try_parse_json("configuration"), "$.Integrations[0].type", "string")
    trigger = F.try_variant_get(F.try_parse_json("configuration"), "$.VerifiedTriggers[0]", "string")
    fmt = F.try_variant_get(F.try_parse_json("configuration"), "$.DataFormats[0]", "string")
    source = config_rows(api, "source", {
        "service": F.lit("API Gateway"), "endpoint": F.coalesce(c("PublicInvokeURL"), unknown), "method": F.coalesce(c("Methods"), F.lit('["UNKNOWN"]')),
        "integration_type": F.coalesce(kind, unknown), "target_lambda": F.coalesce(F.when(uri.contains("function:"), tx.lambda_of_integration(uri)), unknown),
        "auth": F.coalesce(c("AuthType"), unknown)})
    ingestion = config_rows(fn.join(api.select("payload_id", F.lit(True).alias("has_api")), "payload_id", "left"), "ingestion", {
        "function_name": tx.asset_name(F.col("id")), "runtime": F.coalesce(c("Runtime"), unknown), "timeout": F.coalesce(c("TimeoutSeconds"), unknown),
        "memory": F.coalesce(c("MemorySizeMB"), unknown), "handler": F.coalesce(c("Handler"), unknown),
        "event_source": F.coalesce(trigger, F.when(F.col("has_api"), "API Gateway"), unknown)})
    s3 = assets.where("service = 's3'")
    has = s3.select("payload_id").distinct().join(fn.select("payload_id", F.upper(fmt).alias("fmt")), "payload_id", "left")
    target = config_rows(has, "target", {"service": F.lit("S3"), "format": F.coalesce("fmt", unknown)})
    buckets = s3.where(F.col("id").contains(" || ")).select("payload_id", F.lit("target").alias("extractor"), F.lit("bucket").alias("field"), tx.asset_name(F.col("id")).alias("value"))
    return source.unionByName(ingestion).unionByName(target).unionByName(buckets).withColumnRenamed("extractor", "section")


DETECTED_ONLY = ["DynamoDB", "Cosmos DB", "MongoDB", "Kinesis", "Event Hubs", "GraphQL", "SOAP/WS", "SFTP", "FTP", "Local FS"]


def support_matrix(labels: DataFrame) -> DataFrame:
    """Every known source type per payload: support level and whether it was detected.

    ``labels(payload_id, source)`` carries the detected labels as an array.
    """
    names = list(dict.fromkeys([n for n, _ in rules.SOURCE_RULES] + rules.SUPPORTED_SOURCES))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("supported" if n in rules.SUPPORTED_SOURCES else "detected_only").alias("support_level"),
                              F.lit("typed extractor" if n in rules.SUPPORTED_SOURCES else ("known gap" if n in DETECTED_ONLY else "no extractor yet")).alias("explanation"))
                     for n in names])
    return labels.select("payload_id", "source", F.explode(rows).alias("r")).select(
        "payload_id", "r.*", F.array_contains("source", F.col("r.name")).alias("detected"))


# Connection keys carried into the unified schema.
CONNECTION_KEYS = ["workspaceId", "workspace", "artifactId", "schema", "table", "endpoint", "path", "host", "port", "database", "bucket", "prefix",
                   "brokers", "topic", "account", "warehouse", "container", "folder_path", "base_url", "uri"]


def unified_schema(results: DataFrame, doc: str = "result") -> DataFrame:
    """Any extractor result document in the unified layout (C28): scalars, rules, flow text and gaps.

    Connection details are a map; steps and rules stay inside their row.
    """
    v = F.col("v")

    texts: dict[str, str] = {}  # path to the column that holds its text

    def t(path: str) -> Column:
        text = F.col(texts.setdefault(path, f"t{len(texts)}"))
        # Only a container's text, or a string like one, opens so; just these are asked for their type.
        opens = text.startswith("{") | text.startswith("[")
        container = F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")).rlike("^(OBJECT|ARRAY)")
        return F.when(~opens | ~container, F.nullif(text, F.lit("")))

    src, ing = "source_config", "ingestion_config"
    details = F.map_filter(F.create_map(*[x for k in CONNECTION_KEYS for x in (F.lit(k), F.coalesce(t(f"{src}.connection.{k}"), t(f"{src}.{k}")))]),
                           lambda _, x: x.isNotNull())
    rules_raw = F.coalesce(F.try_variant_get(v, "$.dq_config.rules", "array<variant>"), F.array().cast("array<variant>"))

    def rule_name(r: Column) -> Column:
        parts = [F.try_variant_get(r, f"$.{k}", "string") for k in ("rule_type", "type", "name")]
        is_obj = F.try_variant_get(r, "$", "map<string,variant>").isNotNull()
        return F.when(is_obj, F.coalesce(*parts, F.lit("custom_check"))).otherwise(F.try_variant_get(r, "$", "string"))

    named = F.array_distinct(F.array_compact(F.transform(rules_raw, rule_name)))
    steps = F.coalesce(F.size(F.try_variant_get(v, f"$.{ing}.steps", "array<variant>")), F.lit(0))
    mids = F.when(steps > 0, F.transform(F.sequence(F.lit(1), steps), lambda i: F.concat(F.lit("step_"), i))).otherwise(F.array().cast("array<string>"))
    chain = F.concat(F.array(F.lit("source_1")), mids, F.array(F.lit("sink_1")))
    framework = F.coalesce(t("framework"), t("platform"), F.lit("Unknown"))
    trigger, frequency = t(f"{ing}.trigger_type"), F.coalesce(t(f"{ing}.schedule.frequency"), t(f"{ing}.frequency"), t(f"{ing}.schedule"))
    d = F.col("connection_details")
    gone = lambda *keys: F.coalesce(*[d[k] for k in keys]).isNull()
    gaps = {"source_configs.connection_details.artifactId": gone("artifactId"), "source_configs.connection_details.schema": gone("schema"),
            "source_configs.connection_details.table": gone("table"), "source_configs.connection_details.endpoint": gone("endpoint", "base_url"),
            "source_configs.connection_details.path": gone("path", "prefix", "folder_path"),
            "ingestion_configs.trigger_type": F.col("trigger_type").isNull(), "ingestion_configs.frequency": F.col("frequency").isNull()}
    columns = [
        F.coalesce(t(f"{src}.type"), t(f"{src}.source_type"), F.lit("Unknown")).alias("source_type"),
        F.coalesce(t(f"{src}.service_name"), t(f"{src}.linked_service"), t(f"{ing}.pipeline_type"), t("framework"), t("platform"), F.lit("Unknown")).alias("service_name"),
        F.coalesce(t(f"{src}.connection.auth_type"), t(f"{src}.auth_type"), t(f"{src}.authentication_type"), F.lit("Unknown")).alias("authentication_type"),
        details.alias("connection_details"),
        F.coalesce(t(f"{src}.extraction_mode"), t(f"{ing}.mode"), t(f"{ing}.batch_mode"), F.lit("batch")).alias("mode"),
        trigger.alias("trigger_type"), frequency.alias("frequency"),
        F.coalesce(t(f"{src}.format"), t(f"{src}.file_format"), t(f"{ing}.format")).alias("data_format"),
        F.coalesce(t(f"{ing}.output.type"), t(f"{ing}.output.bucket"), t(f"{ing}.target.type"), t(f"{ing}.target.bucket"), t(f"{src}.type"), F.lit("Unknown")).alias("destination"),
        F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("row_count_check"), F.lit("schema_check"))).alias("dq_rules"),
        F.concat(framework, F.lit(": "), F.array_join(chain, " -> ")).alias("flow_text")]
    # Rows of their own bind the parsed document and its texts, or every field would parse and search it again.
    parsed = results.select("config_id", F.inline(F.array(F.struct(F.try_parse_json(F.col(doc)).alias("v")))))
    read = parsed.select("config_id", "v", F.inline(F.array(F.struct(*[F.try_variant_get(v, f"$.{p}", "string").alias(c) for p, c in texts.items()]))))
    out = read.select("config_id", *columns)
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in gaps.items()])))
