"""Source-code corpora: pattern inference, line rules, call findings, stitched lineage."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Environment names per connection field.
ENV_NAMES = {
    "postgresql": {"host": ["PG_HOST", "POSTGRES_HOST", "DB_HOST"], "database": ["PG_DATABASE", "POSTGRES_DATABASE", "DB_NAME"],
                   "schema": ["PG_SCHEMA", "POSTGRES_SCHEMA", "DB_SCHEMA"], "table": ["PG_TABLE", "POSTGRES_TABLE", "DB_TABLE"]},
    "kafka": {"brokers": ["KAFKA_BROKERS", "BOOTSTRAP_SERVERS"], "topic": ["KAFKA_TOPIC", "TOPIC"]},
    "snowflake": {"account": ["SNOWFLAKE_ACCOUNT", "SF_ACCOUNT"], "warehouse": ["SNOWFLAKE_WAREHOUSE", "SF_WAREHOUSE"],
                  "database": ["SNOWFLAKE_DATABASE", "SF_DATABASE"]},
    "rest_api": {"base_url": ["API_BASE_URL", "API_URL", "BASE_URL", "ENDPOINT_URL"]},
    "s3": {"bucket": ["SOURCE_BUCKET", "S3_BUCKET", "BUCKET"]},
    "adls_gen2": {"account": ["ADLS_ACCOUNT", "STORAGE_ACCOUNT"]},
    "sftp": {"host": ["SFTP_HOST", "FTP_HOST"]},
    "mysql": {"host": ["MYSQL_HOST", "DB_HOST"]},
    "mongodb": {"uri": ["MONGO_URI", "MONGODB_URI"]},
}
TARGET_BUCKETS = ["OUTPUT_BUCKET", "SINK_BUCKET", "TARGET_BUCKET", "DEST_BUCKET"]
WATERMARKS = ["WATERMARK_COLUMN", "WATERMARK", "INCREMENTAL_COLUMN"]
SCHEDULES = ["SCHEDULE", "CRON", "CRON_EXPRESSION"]


def has(code: Column, *words: str) -> Column:
    """The lower-case code holds one of the words."""
    low = F.lower(code)
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def env_default(code: Column, names: list[str]) -> Column:
    """Default of the first environment name used, ``${NAME}`` without one, or an assigned text."""
    arms = []
    for n in names:
        call = rf"""os\.environ(?:\.get)?\s*[\[(]\s*['"]{n}['"](?:\s*,\s*['"]([^'"]+)['"])?"""
        arms.append(F.when(code.rlike(call), F.coalesce(F.nullif(F.regexp_extract(code, call, 1), F.lit("")), F.lit("${" + n + "}"))))
        arms.append(F.nullif(F.regexp_extract(code, rf"""(?m)^{n}\s*[=:]\s*['"]([^'"]+)['"]""", 1), F.lit("")))
    return F.coalesce(*arms)


def source_type(code: Column) -> Column:
    """Source a program reads, first match wins."""
    return (
        F.when(has(code, "psycopg2", "postgresql", "pg_host"), "postgresql").when(has(code, "kafka", "bootstrap.servers", "msk"), "kafka")
        .when(has(code, "snowflake") & has(code, "connector", "snowflake.connect"), "snowflake")
        .when(has(code, "requests.get", "httpx", "api_url", "base_url"), "rest_api").when(has(code, "s3") & has(code, "boto3", "s3://"), "s3")
        .when(has(code, "adls", "dfs.core.windows.net", "abfss://"), "adls_gen2").when(has(code, "sftp", "paramiko"), "sftp")
        .when(has(code, "mysql", "pymysql"), "mysql").when(has(code, "mongodb", "pymongo"), "mongodb").otherwise("unknown"))


def framework(code: Column) -> Column:
    """struct(framework, pipeline_type) of a program."""
    def pair(a, b) -> Column:
        return F.struct((F.lit(a) if isinstance(a, str) else a).alias("framework"), F.lit(b).alias("pipeline_type"))

    spark = F.when(has(code, "databricks"), "Databricks_Spark").otherwise("AWS_EMR")
    return (
        F.when(has(code, "awsglue", "gluecontext"), pair("AWS_Glue", "glue")).when(has(code, "lambda_handler", "def handler"), pair("AWS_Lambda", "lambda"))
        .when(has(code, "statemachine", "stepfunctions"), pair("AWS_StepFunctions", "step_functions"))
        .when(has(code, "dlt.", "delta live"), pair("Databricks_DLT", "dlt")).when(has(code, "sparksession", "pyspark"), pair(spark, "spark"))
        .when(has(code, "{{ config(", "{{ ref("), pair("dbt", "dbt")).when(has(code, "create task", "create stream"), pair("Snowflake", "snowflake_task"))
        .when(has(code, "datafactory", "linkedservice"), pair("ADF", "adf")).otherwise(pair("unknown", "unknown")))


def extraction_mode(code: Column) -> Column:
    """streaming / cdc / incremental / full_load; "cdc, or stream with kafka" (D20)."""
    return (
        F.when(has(code, "cdc") | (has(code, "stream") & has(code, "kafka")), F.when(has(code, "kafka"), "streaming").otherwise("cdc"))
        .when(env_default(code, WATERMARKS).isNotNull() | has(code, "watermark", "incremental"), "incremental").otherwise("full_load"))


def line_rules(files: DataFrame, ids: list[str], width: int | None = None) -> DataFrame:
    """Data-quality rules line by line (D21): asserts, null tests, expectations; the condition is the line, cut at ``width`` if given."""
    lines = files.select(*ids, F.posexplode(F.split("source", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    low = F.lower("line")
    quoted = F.coalesce(F.nullif(F.regexp_extract("line", r"""["'](\w+)["']""", 1), F.lit("")), F.lit("unknown"))
    named = F.coalesce(F.nullif(F.regexp_extract("line", r"""dlt\.expect\w*\(["'](\w+)["']""", 1), F.lit("")), F.lit("unknown"))

    def rule(column: Column, kind: str, severity: str, action: str) -> Column:
        return F.struct(column.alias("column"), F.lit(kind).alias("rule_type"), (F.col("line") if width is None else F.substring("line", 1, width)).alias("condition"),
                        F.lit(severity).alias("severity"), F.lit(action).alias("action"))

    r = (F.when(F.col("line").startswith("assert ") | F.col("line").startswith("assert("), rule(F.lit("inferred"), "custom", "high", "reject"))
         .when(low.contains("is not null") | low.contains("isnull") | low.contains("isnotnull"), rule(quoted, "not_null", "critical", "reject"))
         .when(low.contains("dlt.expect"), rule(named, "dlt_expectation", "high", "drop")))
    return lines.select(*ids, "line_no", r.alias("r")).where("r is not null").select(*ids, "line_no", "r.*")


def rule_types(code: Column, first: int | None = None) -> Column:
    """Rule types of a program's lines, in-row; of the first rules only if asked."""
    def kind(line: Column) -> Column:
        t = F.trim(line)
        low = F.lower(t)
        return (F.when(t.startswith("assert ") | t.startswith("assert("), "custom")
                .when(low.contains("is not null") | low.contains("isnull") | low.contains("isnotnull"), "not_null")
                .when(low.contains("dlt.expect"), "dlt_expectation"))

    found = F.filter(F.transform(F.split(code, "\n"), kind), lambda x: x.isNotNull())
    return found if first is None else F.slice(found, 1, first)


def dq_framework(code: Column) -> Column:
    """Data-quality framework of a program."""
    return (F.when(has(code, "great_expectations", "great-expectations", "expectation_suite"), "great_expectations").when(has(code, "deequ"), "deequ")
            .when(has(code, "soda") & has(code, "scan"), "soda").when(has(code, "dlt.expect"), "dlt_expectations")
            .when(has(code, "awsgluedq", "evaluatedataquality"), "glue_dq").when(F.size(rule_types(code)) > 0, "custom").otherwise("none"))


def target_type(code: Column) -> Column:
    """Target a program writes."""
    return (F.when(has(code, ".writestream", ".write.format", ".write.mode"), F.when(has(code, "delta"), "delta").otherwise("parquet"))
            .when(has(code, "redshift"), "redshift").when(has(code, "snowflake") & has(code, "write"), "snowflake")
            .when(env_default(code, TARGET_BUCKETS).isNotNull(), "s3").when(has(code, "adls", "abfss://"), "adls_gen2").otherwise("unknown"))


def infer_document(files: DataFrame, ids: list[str]) -> DataFrame:
    """Inferred configuration of every program."""
    code = F.col("source")
    st = source_type(code)
    conn = F.create_map().cast("map<string,string>")
    for kind, names in ENV_NAMES.items():
        pairs = [x for f, n in names.items() for x in (F.lit(f), F.coalesce(env_default(code, n), F.lit("public") if (kind, f) == ("postgresql", "schema") else F.lit(None).cast("string")))]
        conn = F.when(F.col("source_type") == kind, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())).otherwise(conn)
    types = F.array_sort(F.array_distinct(rule_types(code)))
    d = F.col("connection_details")
    gaps = [F.when(d[f].isNull(), F.lit(f"source_configs.connection_details.{f}")) for f in ("artifactId", "schema", "table", "endpoint", "path")]
    late = [F.when(F.col("frequency").isNull(), F.lit(f"ingestion_configs.{f}")) for f in ("trigger_type", "frequency")]
    mode = extraction_mode(code)
    return (
        files.withColumn("source_type", st).select(
            *ids, "source_type", framework(code)["framework"].alias("service_name"), conn.alias("connection_details"),
            F.when(mode == "full_load", "batch").otherwise(mode).alias("mode"), env_default(code, SCHEDULES).alias("frequency"),
            target_type(code).alias("destination"), F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("row_count_check"), F.lit("schema_check"))).alias("dq_rules"),
            F.when(F.col("source_type") != "unknown", "medium").otherwise("low").alias("confidence"))
        .withColumns({"missing": F.array_compact(F.array(*gaps, *late)), "flow_text": F.concat("service_name", F.lit(": source_1 -> sink_1"))}))


def classify_snippet(code: Column) -> Column:
    """struct(framework, cloud_provider, pattern) of a snippet."""
    def out(fw: str, cloud: str, pattern: str) -> Column:
        return F.struct(F.lit(fw).alias("framework"), F.lit(cloud).alias("cloud_provider"), F.lit(pattern).alias("pattern"))

    return (
        F.when(has(code, "awsglue", "gluecontext"), out("AWS_Glue", "aws", "etl")).when(has(code, "lambda_handler"), out("AWS_Lambda", "aws", "etl"))
        .when(has(code, "sparksession") & has(code, "databricks"), out("Databricks_Spark", "azure", "etl")).when(has(code, "dlt."), out("Databricks_DLT", "azure", "streaming"))
        .when(has(code, "{{ config("), out("dbt", "multi", "elt")).when(has(code, "create task", "create stream"), out("Snowflake", "snowflake", "batch"))
        .when(has(code, "readstream", "writestream"), out("Spark_Streaming", "multi", "streaming")).when(has(code, "datafactory"), out("ADF", "azure", "etl"))
        .otherwise(out("unknown", "unknown", "unknown")))


# --- call findings -----------------------------------------------------------------------

# Client methods and modules that count.
WRITES = ("put_object", "upload_file", "put_record", "put_item")
READS = ("get_object", "download_file", "query", "scan", "invoke")
FORMATS = ("json", "csv", "xml", "yaml", "avro")
FROM_FORMATS = ("json", "csv", "yaml")

FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("method", T.StringType())])


ARROW_FINDINGS = pa.list_(pa.struct([(f, pa.string()) for f in ("kind", "value", "method")]))


def python_findings(source: str):
    """(kind, value, method) of one Python file; nothing when it does not parse."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError):
        return
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
            name = n.func.attr
            if name in WRITES or name in READS:
                yield "operation", "write" if name in WRITES else "read", name
            consts = {k.arg: k.value.value for k in n.keywords if isinstance(k.value, ast.Constant)}
            if name in ("put_object", "get_object") and "Bucket" in consts:
                yield "target", f"s3://{consts['Bucket']}", name
            if name in ("publish", "send_message"):
                for arg in ("TopicArn", "QueueUrl"):
                    if arg in consts:
                        yield "target", str(consts[arg]), name
        elif isinstance(n, ast.Import):
            yield from (("format", a.name, "import") for a in n.names if a.name in FORMATS)
        elif isinstance(n, ast.ImportFrom) and n.module in FROM_FORMATS:
            yield "format", n.module, "import"


class CodeFindings:
    """Table function over one file's text."""

    def eval(self, source: str):
        if source is not None:
            yield from python_findings(source)


def code_findings_udtf():
    """The table function, ready for ``spark.udtf.register`` or a lateral join."""
    return F.udtf(CodeFindings, returnType=FINDING)


def findings_of(sources: pa.Array) -> pa.Array:
    """Findings of a batch of files."""
    return pa.array([[dict(zip(("kind", "value", "method"), f, strict=True)) for f in python_findings(s or "")] for s in sources.to_pylist()], ARROW_FINDINGS)


def code_findings(files: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct findings of every file, long form (D28); files go to Python in Arrow batches."""
    found = F.arrow_udf(findings_of, T.ArrayType(FINDING))
    return files.select(*ids, F.explode(found("source")).alias("f")).select(*ids, "f.*").distinct()


def stitch_lineage(findings: DataFrame, package: str) -> DataFrame:
    """Edges source -> package and package -> target.

    A package that reads A and writes B links them through its own node; the pairs are
    never multiplied out.
    """
    t = findings.where("kind = 'target'")
    node = F.concat(F.lit("package:"), F.col(package).cast("string"))
    reads = t.where(F.col("method") == "get_object").select(F.col("value").alias("from_id"), node.alias("to_id"))
    writes = t.where(F.col("method") != "get_object").select(node.alias("from_id"), F.col("value").alias("to_id"))
    return reads.unionByName(writes).distinct()


def unzip_python(archives: DataFrame) -> DataFrame:
    """Python files of zip archives read as ``binaryFile`` rows ``(path, content)``.

    Archives are opened one at a time inside their task and their members stream out.  A file
    that is no archive gives one row that says so in ``error``, and so does each member that cannot be read.
    """
    import io
    import zipfile
    import zlib

    def members(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, TypeError, ValueError) as e:
                    yield pa.RecordBatch.from_pylist([{"package": path, "path": None, "source": None, "error": str(e)}], shape)
                    continue
                for name in z.namelist():
                    if name.endswith(".py"):
                        text = error = None
                        try:
                            text = z.read(name).decode("utf-8", "ignore")
                        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError, OSError) as e:
                            error = str(e) or type(e).__name__  # wrong checksum, damaged data, password, unknown method
                        yield pa.RecordBatch.from_pylist([{"package": path, "path": name, "source": text, "error": error}], shape)

    shape = pa.schema([(c, pa.string()) for c in ("package", "path", "source", "error")])
    return archives.select("path", "content").mapInArrow(members, "package string, path string, source string, error string")
