"""Ingestion job specifications as data: parse, validate, merge, parameterise, run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from metasift.operators import ingest as ig
from metasift.operators import quality as dq
from metasift.session import cut_lineage, shuffled
from metasift.sources import files


def mask_columns(df: DataFrame, secrets: list[str]) -> DataFrame:
    """Secret columns rendered as ``***``."""
    return df.withColumns({c: F.lit("***") for c in secrets})


def extracted(source: DataFrame, spec: dict) -> DataFrame:
    """The rows a spec's extraction mode asks for: full, incremental, or change capture.

    ``query_based`` reads rows by their clocks, with deletes from ``deleted_at_column``; ``log_based`` and ``trigger`` read a change
    table, whose newest row per key by ``lsn_column`` counts (a trigger's table may go by ``updated_at_column`` instead).
    """
    mode = spec.get("extraction_mode", "full_load")
    if mode == "incremental":
        out = ig.incremental(source, spec["watermark_column"], spec.get("last_watermark"), spec.get("watermark_type", "timestamp"),
                             spec.get("lookback_minutes") or 0)
        bound = spec.get("upper_bound_column")
        if bound:
            given = spec.get("upper_bound_value")
            top = ig.watermark_literal(given, spec.get("watermark_type", "timestamp")) if given is not None else F.current_timestamp()
            out = out.where(F.col(bound) <= top)
        return out
    if mode != "cdc":
        return source
    kind = spec.get("cdc_mode", "query_based")
    if kind not in CDC_MODES:
        raise ValueError(f"unknown change capture {kind!r}")
    if kind != "query_based":
        column = spec.get("lsn_column") or (spec.get("updated_at_column") if kind == "trigger" else None)
        if not column:
            raise ValueError(f"{kind} needs a column that orders changes")
        if spec.get("lsn_column"):
            return ig.cdc_log_based(source, spec["key_columns"], column, spec.get("last_lsn") or 0)
        return ig.latest_per_key(ig.incremental(source, column, spec.get("last_watermark"), spec.get("watermark_type", "timestamp")), spec["key_columns"], F.col(column))
    gone = spec.get("deleted_at_column")
    if spec.get("created_at_column") and spec.get("updated_at_column"):
        out = ig.cdc_query_based(source, spec["created_at_column"], spec["updated_at_column"], spec["last_watermark"])
        if not gone:
            return out
        out = out.withColumn("_op", F.when(F.col(gone).isNotNull(), "D").otherwise(F.col("_op")))
        return out if spec.get("include_deletes", True) else out.where("_op <> 'D'")
    if not gone:
        raise ValueError("query_based needs created_at_column and updated_at_column, or deleted_at_column")
    return ig.cdc_soft_delete(source, gone, bool(spec.get("include_deletes", True)))


def drifted(df: DataFrame, expected: list[str] | None, action: str) -> DataFrame:
    """Meet a schema that differs from the expected columns: fail, keep all (warn, evolve) or keep the expected (ignore)."""
    if not expected or set(expected) == set(df.columns):
        return df
    if action == "fail":
        raise ValueError(f"columns differ: missing {sorted(set(expected) - set(df.columns))}, new {sorted(set(df.columns) - set(expected))}")
    if action == "ignore":
        return df.select(*[c for c in expected if c in df.columns])
    return df


#: Kinds of change capture.
CDC_MODES = ("log_based", "query_based", "trigger")


def run_job(source: DataFrame, spec: dict, path: str, checks: list[dq.Check] | None = None):
    """Run one runtime row against its source: extract, check, deduplicate, write.

    The spec is a handful of driver-side scalars; the data never leaves the executors.  The source is read once: row count,
    high-water mark and the spec's checks are observed on the extracted rows in the pass that writes them to the shared folder.  If
    ``row_count_min``, ``row_count_max``, ``not_empty_columns`` or a rule of ``custom_checks`` (an expression that holds on bad rows) is
    broken, the job fails there and the sink stays as it was; else the rows go on to the sink from what was written.
    ``merge`` folds the batch into what the path holds by the key columns.  Returns the mark.
    """
    df = drifted(source, spec.get("expected_columns"), spec.get("schema_drift_action", "warn"))
    df = ig.where(extracted(df, spec), spec.get("where_clause"))
    marked = spec.get("watermark_column") or spec.get("lsn_column")
    filled, rules = spec.get("not_empty_columns") or [], spec.get("custom_checks") or []
    if spec.get("row_limit") and spec.get("sample_percent"):
        raise ValueError("use row_limit or sample_percent, not both")
    if spec.get("row_limit"):
        df = ig.limit_rows(df, spec["row_limit"], spec.get("order_by"))
    elif spec.get("sample_percent"):
        df = ig.sample(df, spec["sample_percent"], spec.get("sample_key"))
    seen = Observation()
    df = df.observe(seen, F.count("*").alias("rows"), (F.max(marked) if marked else F.max(F.lit(None).cast("string"))).alias("mark"),
                    *[F.count(c).alias(f"filled_{i}") for i, c in enumerate(filled)],
                    *[F.count_if(F.coalesce(F.expr(r), F.lit(False))).alias(f"broken_{i}") for i, r in enumerate(rules)])
    df = ig.full_load(df, ig.ExtractSpec(
        include=spec.get("include_columns") or [], exclude=spec.get("exclude_columns") or [],
        source_type=spec["source_type"], job_id=spec["job_id"], add_metadata=bool(spec.get("add_metadata_cols", True))))
    checks = [*(checks or []), *[dq.not_null(c, severity="quarantine") for c in spec.get("null_check_columns") or []]]
    batch = cut_lineage(df)
    found = seen.get
    n, mark, least, most = found["rows"], found["mark"], spec.get("row_count_min") or 0, spec.get("row_count_max")
    if n < least or (most is not None and n > most):
        raise ValueError(f"{n} rows extracted, expected {least} to {'any' if most is None else most}")
    if bare := [c for i, c in enumerate(filled) if not found[f"filled_{i}"]]:
        raise ValueError(f"columns without a value: {bare}")
    if broken := [r for i, r in enumerate(rules) if found[f"broken_{i}"]]:
        raise ValueError(f"custom checks failed: {broken}")
    clean, held = dq.actions_split(batch, checks) if checks else (batch, None)
    keys = spec.get("dedup_columns") or []
    if keys:
        clean = ig.latest_per_key(clean, keys, F.col(marked or keys[0]))
    mode = spec.get("write_mode", "append")
    layout = {"partition_by": spec.get("partition_by"), "max_file_size_mb": spec.get("max_file_size_mb") or 256}
    form = spec.get("file_format", "parquet"), spec.get("compression", "snappy")
    if mode == "merge":
        files.merge(clean, f"{path}/clean", *form, keys=spec.get("key_columns") or keys, order=marked if marked in clean.columns else None, **layout)
    else:
        files.write(clean, f"{path}/clean", *form, mode, **layout)
    if held is not None:
        files.write(held, f"{path}/quarantine", *form, "append" if mode == "merge" else mode, **layout)
    return mark


# Required and defaulted fields per source type, and which are secret.
SOURCE_FIELDS = {
    "aws": (["aws_region", "source_bucket", "file_format"], {"source_prefix": "", "aws_auth_type": "Access Key"},
            ["aws_secret_access_key", "aws_sas_token"]),
    "gcp": (["gcp_project_id", "service_account_json"], {"gcs_prefix": "", "bq_location": "US"}, ["service_account_json"]),
    "snowflake": (["sf_account", "sf_user", "sf_password", "sf_warehouse", "sf_database", "sf_table"], {"sf_schema": "PUBLIC"}, ["sf_password"]),
    "postgres": (["pg_host", "pg_database", "pg_user", "pg_password", "pg_table"], {"pg_port": "5432", "pg_schema": "public", "ssl_mode": "require"}, ["pg_password"]),
    "salesforce": (["sf_instance_url", "sf_client_id", "sf_client_secret", "object_name"], {"sf_api_version": "v58.0", "bulk_api": "true"},
                   ["sf_client_secret", "sf_password"]),
}
# Every field any source type may carry; all text.
ALL_FIELDS = sorted({f for required, defaults, secrets in SOURCE_FIELDS.values() for f in [*required, *defaults, *secrets]}
                    | {"bq_dataset", "bq_table", "gcs_bucket", "sf_role", "sf_username", "aws_role_arn", "aws_access_key_id"})


def parse_source(jobs: DataFrame, doc: str = "source") -> DataFrame:
    """Source documents by ``source_type``: a struct of fields with defaults, and what is wrong (P25).

    The document is parsed once with a fixed all-text schema; ``errors`` lists missing or
    unknown parts.
    """
    schema = ", ".join(f"{f} string" for f in ["source_type", *ALL_FIELDS])
    rest = [c for c in jobs.columns if c not in (doc, "source_type")]
    # Generating the fields keeps later filters from parsing the document again per field.
    j = jobs.select(*rest, F.inline(F.array(F.from_json(F.col(doc), schema))))
    st = F.col("source_type")
    fields, errors = [], []
    for f in ALL_FIELDS:
        value = F.col(f)
        for kind, (_, defaults, _) in SOURCE_FIELDS.items():
            if f in defaults:
                value = F.coalesce(value, F.when(st == kind, F.lit(defaults[f])))
        fields.append(value.alias(f))
        kinds = [k for k, (required, _, _) in SOURCE_FIELDS.items() if f in required]
        if kinds:
            errors.append(F.when(st.isin(*kinds) & (F.coalesce(F.col(f), F.lit("")) == ""), F.lit(f"missing:{f}")))
    blank = F.coalesce(st, F.lit("")) == ""
    errors += [F.when(blank, "missing:source_type"), F.when(~blank & ~st.isin(*SOURCE_FIELDS), F.concat(F.lit("unknown_type:"), st))]
    return j.select(*rest, st.alias("source_type"), F.struct(*fields).alias("fields"), F.array_compact(F.array(*errors)).alias("errors"))


def source_label(f: Column, source_type: Column) -> Column:
    """Display label of a parsed source."""
    dot = lambda *parts: F.concat_ws(".", *parts)
    return (
        F.when(source_type == "aws", F.concat(F.lit("s3://"), f["source_bucket"], F.lit("/"), f["source_prefix"]))
        .when((source_type == "gcp") & (F.coalesce(f["bq_dataset"], F.lit("")) != ""), dot(f["gcp_project_id"], f["bq_dataset"], f["bq_table"]))
        .when(source_type == "gcp", F.concat(F.lit("gs://"), f["gcs_bucket"], F.lit("/"), f["gcs_prefix"]))
        .when(source_type == "snowflake", dot(f["sf_database"], f["sf_schema"], f["sf_table"]))
        .when(source_type == "postgres", F.concat(f["pg_host"], F.lit("/"), dot(f["pg_database"], f["pg_schema"], f["pg_table"])))
        .when(source_type == "salesforce", F.concat(f["sf_instance_url"], F.lit("/sobjects/"), f["object_name"]))
        .otherwise(source_type))


def secret_name(source_type: Column, job_id: Column) -> Column:
    """Name under which a job's credentials are kept."""
    return F.concat(F.lit("etl-src-"), source_type, F.lit("-"), F.substring(job_id, 1, 8))


def credential_split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sanitised sources and a separate secret frame, linked by secret name only."""
    name = secret_name(F.col("source_type"), F.col("job_id"))
    every = sorted({x for _, _, secrets in SOURCE_FIELDS.values() for x in secrets})
    clean = parsed.select("job_id", "source_type", name.alias("source_secret_name"), F.col("fields").dropFields(*every).alias("fields"))
    held = F.create_map().cast("map<string,string>")
    for kind, (_, _, secrets) in SOURCE_FIELDS.items():
        own = F.create_map(*[x for k in secrets for x in (F.lit(k), F.col(f"fields.{k}"))])
        held = F.when(F.col("source_type") == kind, F.map_filter(own, lambda _, v: v.isNotNull())).otherwise(held)
    return clean, parsed.select(name.alias("source_secret_name"), held.alias("secrets"))


def partition_columns(pattern: Column, given: Column) -> Column:
    """Column names of a layout such as ``year={YYYY}/month={MM}``, unless they are given."""
    found = F.regexp_extract_all(pattern, F.lit(r"([^/{}=]+)=\{[^}]+\}"), F.lit(1))
    return F.when(F.size(given) > 0, given).otherwise(F.coalesce(found, F.array().cast("array<string>")))


# Violation code, the columns it reads, and when it applies.
RULES: list[tuple[str, list[str], str]] = [
    ("access_key_auth", ["source_type", "aws_auth_type", "aws_access_key_id", "aws_secret_access_key"],
     "source_type = 'aws' and aws_auth_type = 'Access Key' and (coalesce(aws_access_key_id, '') = '' or coalesce(aws_secret_access_key, '') = '')"),
    ("sas_auth", ["source_type", "aws_auth_type", "aws_sas_token"], "source_type = 'aws' and aws_auth_type = 'SAS Token' and coalesce(aws_sas_token, '') = ''"),
    ("cron_fields", ["cron_expression"], "size(split(trim(cron_expression), '\\\\s+')) not in (5, 6)"),
    ("cron_required", ["schedule_enabled", "cron_expression"], "schedule_enabled and coalesce(cron_expression, '') = ''"),
    ("watermark_spaces", ["watermark_column"], "contains(watermark_column, ' ')"),
    ("cdc_lsn", ["cdc_mode", "lsn_column"], "cdc_mode = 'log_based' and coalesce(lsn_column, '') = ''"),
    ("column_overlap", ["include_columns", "exclude_columns"], "arrays_overlap(include_columns, exclude_columns)"),
    ("limit_and_sample", ["row_limit", "sample_percent"], "row_limit > 0 and sample_percent > 0"),
    ("csv_snappy", ["file_format", "compression"], "file_format = 'csv' and compression = 'snappy'"),
    ("row_count_range", ["row_count_min", "row_count_max"], "row_count_min > 0 and row_count_max > 0 and row_count_min > row_count_max"),
    ("email", ["email"], "email <> '' and not email rlike '^[^@\\\\s]+@[^@\\\\s]+\\\\.[^@\\\\s]+$'"),
    ("slack_url", ["slack_webhook_url"], "slack_webhook_url <> '' and not startswith(slack_webhook_url, 'https://hooks.slack.com/')"),
    ("incremental_block", ["extraction_mode", "watermark_column"], "extraction_mode = 'incremental' and watermark_column is null"),
    ("cdc_block", ["extraction_mode", "cdc_mode"], "extraction_mode = 'cdc' and cdc_mode is null"),
    *[(f"range:{c}", [c], f"{c} not between {low} and {high}") for c, low, high in (
        ("max_active_runs", 1, 10), ("lookback_minutes", 0, 2147483647), ("row_limit", 1, 9223372036854775807), ("sample_percent", 0.01, 100),
        ("max_file_size_mb", 16, 2048), ("max_retries", 0, 10), ("retry_interval_seconds", 10, 3600), ("backoff_multiplier", 1, 5),
        ("timeout_seconds", 60, 86400), ("batch_size", 100, 5000000), ("parallelism", 1, 32), ("row_count_min", 0, 9223372036854775807),
        ("row_count_max", 1, 9223372036854775807))],
    *[(f"enum:{c}", [c], f"{c} not in ({', '.join(repr(v) for v in values)})") for c, values in (
        ("extraction_mode", ["full_load", "incremental", "cdc"]), ("file_format", ["parquet", "delta", "csv", "json", "orc"]),
        ("compression", ["snappy", "gzip", "zstd", "none"]), ("watermark_type", ["timestamp", "date", "integer"]),
        ("schema_drift_action", ["warn", "fail", "ignore", "evolve"]), ("write_mode", ["append", "overwrite", "merge"]),
        ("cdc_mode", list(CDC_MODES)))],
    ("description_length", ["description"], "length(description) > 500"),
]


def validate(specs: DataFrame) -> DataFrame:
    """Violations ``(job_id, code)`` of flat job specs, all rules in one expression.

    A rule applies when the frame has the columns it reads.
    """
    rows = [F.when(F.expr(cond), F.lit(code)) for code, cols, cond in RULES if set(cols) <= set(specs.columns)]
    return specs.select("job_id", F.explode(F.array_compact(F.array(*rows))).alias("code"))


def column_overlap(include: Column, exclude: Column) -> Column:
    """Columns named on both lists."""
    return F.array_intersect(include, exclude)


def route_fields(fields: DataFrame, fallback: str = "extra") -> DataFrame:
    """Form fields ``(config_id, k, v)`` with aliases applied and their section.

    Empty values vanish; ``name`` stands alone; unknown names go to ``fallback``
    (``connection`` for the second variant).
    """
    from metasift.functions import rules

    k = F.col("k")
    for a, b in rules.FIELD_ALIASES.items():
        k = F.when(F.col("k") == a, F.lit(b)).otherwise(k)
    live = fields.where("coalesce(v, '') <> ''").select("config_id", k.alias("k"), "v")
    section = (F.when(F.col("k") == "name", "name").when(F.col("k").isin(*rules.CONNECTION_FIELDS), "connection")
               .when(F.col("k").isin(*rules.EXTRACTION_FIELDS), "extraction").when(F.col("k").isin(*rules.PROFILE_FIELDS), "data_profile").otherwise(fallback))
    return live.withColumn("section", section)


# Runtime column, parameter name, how it renders.
PARAMETERS = [
    ("job_id", "jobId", "scalar"), ("created_at", "createdAt", "scalar"), ("source_type", "sourceType", "scalar"), ("source_label", "sourceLabel", "scalar"),
    ("source_secret_name", "sourceSecretName", "scalar"), ("key_vault_name", "keyVaultName", "scalar"), ("extraction_mode", "extractionMode", "scalar"),
    ("batch_size", "batchSize", "scalar"), ("parallelism", "parallelism", "scalar"), ("schedule_enabled", "scheduleEnabled", "scalar"),
    ("schedule_cron", "scheduleCron", "scalar"), ("schedule_timezone", "scheduleTimezone", "scalar"), ("watermark_column", "watermarkColumn", "scalar"),
    ("watermark_type", "watermarkType", "scalar"), ("last_watermark", "lastWatermarkValue", "scalar"), ("lookback_minutes", "lookbackMinutes", "scalar"),
    ("cdc_mode", "cdcMode", "scalar"), ("updated_at_column", "updatedAtColumn", "scalar"), ("deleted_at_column", "deletedAtColumn", "scalar"),
    ("last_lsn_value", "lastLsnValue", "scalar"), ("where_clause", "whereClause", "scalar"), ("include_columns", "includeColumns", "list"),
    ("exclude_columns", "excludeColumns", "list"), ("row_limit", "rowLimit", "truthy"), ("file_format", "fileFormat", "scalar"),
    ("compression", "compression", "scalar"), ("partition_by", "partitionBy", "list"), ("max_file_size_mb", "maxFileSizeMb", "scalar"),
    ("add_metadata_cols", "addMetadataCols", "scalar"), ("null_check_columns", "nullCheckColumns", "list"), ("row_count_min", "rowCountMin", "truthy"),
    ("schema_drift_action", "schemaDriftAction", "scalar"), ("dedup_columns", "dedupColumns", "list"), ("max_retries", "maxRetries", "scalar"),
    ("retry_interval_seconds", "retryIntervalSecs", "scalar"), ("timeout_seconds", "timeoutSeconds", "scalar"), ("notify_on_failure", "notifyOnFailure", "scalar"),
    ("notify_email", "notifyEmail", "scalar"), ("adf_pipeline_name", "adfPipelineName", "scalar"), ("adls_account_name", "adlsAccountName", "scalar"),
    ("adls_container", "adlsContainer", "scalar"), ("adls_sink_path", "adlsSinkPath", "scalar"), ("write_mode", "writeMode", "scalar"),
    ("synapse_pool", "synapsePool", "scalar"), ("synapse_schema", "synapseSchema", "scalar"), ("synapse_table", "synapseTable", "scalar"), ("tags", "tags", "json"),
]

# Ingestion and sink columns with their types and defaults.
INGESTION_DEFAULTS = {
    "description": ("string", None), "extraction_mode": ("string", "full_load"), "batch_size": ("bigint", 100_000), "parallelism": ("int", 1),
    "schedule_enabled": ("boolean", False), "schedule_cron": ("string", None), "schedule_timezone": ("string", "UTC"), "watermark_column": ("string", None),
    "watermark_type": ("string", None), "last_watermark": ("string", None), "lookback_minutes": ("int", 0), "cdc_mode": ("string", None),
    "updated_at_column": ("string", None), "deleted_at_column": ("string", None), "last_lsn_value": ("string", None), "where_clause": ("string", None),
    "include_columns": ("array<string>", []), "exclude_columns": ("array<string>", []), "row_limit": ("bigint", None), "file_format": ("string", "parquet"),
    "compression": ("string", "snappy"), "partition_by": ("array<string>", []), "max_file_size_mb": ("int", 256), "add_metadata_cols": ("boolean", True),
    "null_check_columns": ("array<string>", []), "row_count_min": ("bigint", None), "schema_drift_action": ("string", "warn"),
    "dedup_columns": ("array<string>", []), "max_retries": ("int", 3), "retry_interval_seconds": ("int", 60), "timeout_seconds": ("int", 3600),
    "notify_on_failure": ("boolean", True), "notify_email": ("string", None),
}
SINK_DEFAULTS = {
    "adf_pipeline_name": ("string", None), "adls_account_name": ("string", None), "adls_container": ("string", None),
    "adls_sink_path": ("string", "landing/{source_type}/{job_id}/"), "write_mode": ("string", "append"), "synapse_pool": ("string", None),
    "synapse_schema": ("string", None), "synapse_table": ("string", None), "key_vault_name": ("string", None),
}


def with_defaults(df: DataFrame, defaults: dict) -> list[Column]:
    out = []
    for c, (dtype, default) in defaults.items():
        value = F.array().cast(dtype) if default == [] else F.lit(default).cast(dtype)
        out.append((F.coalesce(F.col(c).cast(dtype), value) if c in df.columns else value).alias(c))
    return out


def merge_layers(source: DataFrame, ingestion: DataFrame, sink: DataFrame, created_at: str, extra_tags: dict[str, str] | None = None) -> DataFrame:
    """Source, ingestion and sink specs to one runtime row per job.

    ``source`` comes from :func:`parse_source`; missing settings take their defaults;
    sink path and table are templates; later tags win over earlier ones.
    """
    from metasift.functions.text import fill_template

    s = source.where(F.size("errors") == 0).select("job_id", "source_type", source_label(F.col("fields"), F.col("source_type")).alias("source_label"))
    tags = F.col("tags") if "tags" in ingestion.columns else F.create_map().cast("map<string,string>")
    i = ingestion.select("job_id", *with_defaults(ingestion, INGESTION_DEFAULTS), tags.alias("_tags"))
    k = sink.select("job_id", *with_defaults(sink, SINK_DEFAULTS))
    j = s.join(shuffled(i), "job_id").join(shuffled(k), "job_id")
    st, job = F.col("source_type"), F.col("job_id")
    extra = F.create_map(*[F.lit(x) for kv in (extra_tags or {}).items() for x in kv]).cast("map<string,string>")
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda key, _: ~F.map_contains_key(b, key)), b)
    own = F.create_map(F.lit("source_type"), st)
    return j.withColumns({
        "created_at": F.lit(created_at), "status": F.lit("validated"),
        "adls_sink_path": fill_template(F.col("adls_sink_path"), source_type=st, job_id=job),
        "synapse_table": fill_template(F.col("synapse_table"), source_type=st), "source_secret_name": secret_name(st, job),
        "tags": later(later(own, F.coalesce("_tags", F.create_map().cast("map<string,string>"))), extra)}).drop("_tags")


def job_parameters(runtime: DataFrame) -> DataFrame:
    """Runtime rows as ``(job_id, name, value)`` text parameters."""
    from metasift.functions.text import text_param

    rows = []
    for c, name, kind in PARAMETERS:
        col = F.col(c)
        if kind == "truthy":
            col, kind = F.nullif(col, F.lit(0).cast("bigint")), "scalar"
        rows.append(F.struct(F.lit(name).alias("name"), text_param(col, kind).alias("value")))
    return runtime.select("job_id", F.explode(F.array(*rows)).alias("p")).select("job_id", "p.*")
