"""Source-code queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from metasift.operators import code as cd
from metasift.plans.catalog import fixture, query

CODE = "fx_code"
# Lines appended per package so that every cascade has work, the same text in both engines.
EXTRA = """case package_id % 10 when 0 then 'from awsglue import x' when 1 then 'def lambda_handler(e): kafka cdc' when 2 then 'SparkSession databricks .write.format("delta")'
 when 3 then 'dlt.expect("valid_id") adls' when 4 then '{{ config( }} requests.get' when 5 then 'create task t; snowflake.connector write' when 6 then 'datafactory incremental'
 when 7 then 'assert df.count() > 0' when 8 then 'df.where("col_a is not null") boto3 s3' else 'WATERMARK = "ts" mysql' end"""
TAIL = """case package_id % 4 when 0 then 'TOPIC = os.environ.get("KAFKA_TOPIC", "t1")' when 1 then 'B = os.environ["OUTPUT_BUCKET"]' when 2 then 'CRON = "0 1 * * *"' else '' end"""
C = f"""c as (select package_id, path, source || {EXTRA} || chr(10) || {TAIL} as source, package_id % 10 as e, package_id % 4 as v from fx_code)"""


def files(spark, sf):
    f = fixture(spark, sf, CODE)
    return f.withColumn("source", F.concat("source", F.expr(EXTRA), F.lit("\n"), F.expr(TAIL)))


def out(df, col, name):
    return df.select("package_id", "path", col.alias(name))




@query("D18", "pattern_infer_source_type", f"""
with {C} select package_id, path, 'postgresql' as plain, case when e = 1 or v = 0 then 'kafka' when e = 5 then 'snowflake' when e = 4 then 'rest_api' when e = 8 then 's3' when e = 3 then 'adls_gen2' when e = 9 then 'mysql' else 'unknown' end as masked from c""", CODE)
def pattern_infer_source_type(spark, sf):
    return files(spark, sf).select("package_id", "path", cd.source_type(F.col("source")).alias("plain"),
                                   cd.source_type(F.replace("source", F.lit("PG_HOST"), F.lit("XX"))).alias("masked"))


@query("D19", "pattern_infer_framework", f"""
with {C} select package_id, path, case e when 0 then 'AWS_Glue' when 1 then 'AWS_Lambda' when 2 then 'Databricks_Spark' when 3 then 'Databricks_DLT' when 4 then 'dbt' when 5 then 'Snowflake' when 6 then 'ADF' else 'unknown' end as framework,
 case e when 0 then 'glue' when 1 then 'lambda' when 2 then 'spark' when 3 then 'dlt' when 4 then 'dbt' when 5 then 'snowflake_task' when 6 then 'adf' else 'unknown' end as pipeline_type from c""", CODE)
def pattern_infer_framework(spark, sf):
    return files(spark, sf).select("package_id", "path", cd.framework(F.col("source")).alias("f")).select("package_id", "path", "f.*")


@query("D20", "pattern_infer_mode", f"with {C} select package_id, path, case when e = 1 then 'streaming' when e in (6, 9) then 'incremental' else 'full_load' end as mode from c", CODE)
def pattern_infer_mode(spark, sf):
    return out(files(spark, sf), cd.extraction_mode(F.col("source")), "mode")


@query("D21", "extract_line_dq_rules", f"""
with {C} select package_id, path, 'inferred' as "column", 'custom' as rule_type, 'assert df.count() > 0' as condition, 'reject' as action from c where e = 7
union all select package_id, path, 'unknown', 'not_null', 'df.where("col_a is not null") boto3 s3', 'reject' from c where e = 8
union all select package_id, path, 'valid_id', 'dlt_expectation', 'dlt.expect("valid_id") adls', 'drop' from c where e = 3""", CODE)
def extract_line_dq_rules(spark, sf):
    return cd.line_rules(files(spark, sf), ["package_id", "path"]).select("package_id", "path", "column", "rule_type", "condition", "action")


@query("D22", "pattern_infer_dq_framework", f"with {C} select package_id, path, case when e = 3 then 'dlt_expectations' when e in (7, 8) then 'custom' else 'none' end as dq from c", CODE)
def pattern_infer_dq_framework(spark, sf):
    return out(files(spark, sf), cd.dq_framework(F.col("source")), "dq")


@query("D23", "pattern_infer_target", f"""
with {C} select package_id, path, case when e = 2 then 'delta' when e = 5 then 'snowflake' when v = 1 then 's3' when e = 3 then 'adls_gen2' else 'unknown' end as target from c""", CODE)
def pattern_infer_target(spark, sf):
    return out(files(spark, sf), cd.target_type(F.col("source")), "target")


@query("D24", "extract_env_default", f"""
with {C} select package_id, path, regexp_extract(source, 'PG_HOST = ''([^'']+)''', 1) as host, case when v = 0 then 't1' end as topic, case when v = 1 then '${{OUTPUT_BUCKET}}' end as bucket,
 case when v = 2 then '0 1 * * *' end as cron from c""", CODE)
def extract_env_default(spark, sf):
    s = F.col("source")
    return files(spark, sf).select("package_id", "path", cd.env_default(s, ["DB_HOST", "PG_HOST"]).alias("host"), cd.env_default(s, ["KAFKA_TOPIC"]).alias("topic"),
                                   cd.env_default(s, cd.TARGET_BUCKETS).alias("bucket"), cd.env_default(s, cd.SCHEDULES).alias("cron"))


@query("D25", "infer_config_document", f"""
with {C} select package_id, path, 'postgresql' as source_type, case when e = 1 then 'streaming' when e in (6, 9) then 'incremental' else 'batch' end as mode,
 'host=' || regexp_extract(source, 'PG_HOST = ''([^'']+)''', 1) || '|schema=public' as details, case when v = 2 then '0 1 * * *' end as frequency,
 case when e = 7 then 'custom' when e = 8 then 'not_null' when e = 3 then 'dlt_expectation' else 'row_count_check|schema_check' end as dq_rules, 'medium' as confidence,
 'artifactId|table|endpoint|path' || case when v = 2 then '' else '|trigger_type|frequency' end as missing from c""", CODE)
def infer_config_document(spark, sf):
    d = cd.infer_document(files(spark, sf), ["package_id", "path"])
    details = F.array_join(F.transform(F.array_sort(F.map_entries("connection_details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return d.select("package_id", "path", "source_type", "mode", details.alias("details"), "frequency", F.array_join("dq_rules", "|").alias("dq_rules"), "confidence",
                    F.array_join(F.transform("missing", lambda x: F.element_at(F.split(x, r"\."), -1)), "|").alias("missing"))


@query("D26", "classify_code_framework", f"""
with {C} select package_id, path, case e when 0 then 'AWS_Glue' when 1 then 'AWS_Lambda' when 2 then 'Databricks_Spark' when 3 then 'Databricks_DLT' when 4 then 'dbt' when 5 then 'Snowflake' when 6 then 'ADF' else 'unknown' end as framework,
 case when e in (0, 1) then 'aws' when e in (2, 3, 6) then 'azure' when e = 4 then 'multi' when e = 5 then 'snowflake' else 'unknown' end as cloud_provider,
 case when e in (0, 1, 2, 6) then 'etl' when e = 3 then 'streaming' when e = 4 then 'elt' when e = 5 then 'batch' else 'unknown' end as pattern from c""", CODE)
def classify_code_framework(spark, sf):
    return files(spark, sf).select("package_id", "path", cd.classify_snippet(F.col("source")).alias("f")).select("package_id", "path", "f.*")


# Programs of two phrases each, all pairs of phrases in turn: the oracle reads the text itself, rule by rule.
PHRASES = """psycopg2|postgresql|pg_host|kafka|bootstrap.servers|msk|snowflake connector|snowflake.connect|requests.get|httpx|api_url|base_url|boto3 s3|s3://|adls|dfs.core.windows.net|abfss://
sftp|paramiko|mysql|pymongo|mongodb|awsglue|gluecontext|lambda_handler|def handler|statemachine|stepfunctions|dlt.expect("a")|delta live|SparkSession|pyspark databricks|{{ config(|{{ ref(
CREATE TASK|create stream|datafactory|linkedService|cdc|stream|watermark|incremental|WATERMARK = "w"|os.environ["INCREMENTAL_COLUMN"]|great_expectations|deequ|soda scan|awsgluedq
assert x|assert(y)|z is not null|.writeStream delta|.write.format|.write.mode("delta")|redshift|snowflake write|os.environ.get("SINK_BUCKET", "b")|plain|readStream""".replace("\n", "|").split("|")
N = len(PHRASES)
LISTED = ", ".join("'" + w + "'" for w in PHRASES)
PAIRED = f"""k as (select package_id, path, cast(regexp_extract(path, '[0-9]+') as bigint) as p from fx_code),
w as (select package_id, path, 'x = 1' || chr(10) || ([{LISTED}])[p % {N} + 1] || chr(10) || ([{LISTED}])[p // {N} % {N} + 1] as source from k),
t as (select *, lower(source) as s from w)"""


def paired(spark, sf):
    n = F.regexp_extract("path", "[0-9]+", 0).cast("bigint")
    words = F.array(*[F.lit(w) for w in PHRASES])
    pick = lambda i: F.element_at(words, (F.pmod(i, F.lit(N)) + 1).cast("int"))
    return fixture(spark, sf, CODE).withColumn("source", F.concat(F.lit("x = 1\n"), pick(n), F.lit("\n"), pick(F.floor(n / N))))


def holds(*words):
    return "(" + " or ".join(f"contains(s, '{w}')" for w in words) + ")"


def env_set(*names):
    either = "|".join(names)
    return f"""regexp_matches(source, 'os\\.environ(\\.get)?\\s*[\\[(]\\s*[''"]({either})[''"]|(^|\\n)({either})\\s*[=:]\\s*[''"][^''"]+[''"]')"""


TEXT_ORACLES = {
    "source_type": f"""case when {holds('psycopg2', 'postgresql', 'pg_host')} then 'postgresql' when {holds('kafka', 'bootstrap.servers', 'msk')} then 'kafka'
 when contains(s, 'snowflake') and {holds('connector', 'snowflake.connect')} then 'snowflake' when {holds('requests.get', 'httpx', 'api_url', 'base_url')} then 'rest_api'
 when contains(s, 's3') and {holds('boto3', 's3://')} then 's3' when {holds('adls', 'dfs.core.windows.net', 'abfss://')} then 'adls_gen2' when {holds('sftp', 'paramiko')} then 'sftp'
 when {holds('mysql', 'pymysql')} then 'mysql' when {holds('mongodb', 'pymongo')} then 'mongodb' else 'unknown' end""",
    "framework": f"""case when {holds('awsglue', 'gluecontext')} then 'AWS_Glue/glue' when {holds('lambda_handler', 'def handler')} then 'AWS_Lambda/lambda'
 when {holds('statemachine', 'stepfunctions')} then 'AWS_StepFunctions/step_functions' when {holds('dlt.', 'delta live')} then 'Databricks_DLT/dlt'
 when {holds('sparksession', 'pyspark')} then case when contains(s, 'databricks') then 'Databricks_Spark/spark' else 'AWS_EMR/spark' end
 when {holds('{{ config(', '{{ ref(')} then 'dbt/dbt' when {holds('create task', 'create stream')} then 'Snowflake/snowflake_task'
 when {holds('datafactory', 'linkedservice')} then 'ADF/adf' else 'unknown/unknown' end""",
    "mode": f"""case when contains(s, 'cdc') or (contains(s, 'stream') and contains(s, 'kafka')) then case when contains(s, 'kafka') then 'streaming' else 'cdc' end
 when {env_set('WATERMARK_COLUMN', 'WATERMARK', 'INCREMENTAL_COLUMN')} or {holds('watermark', 'incremental')} then 'incremental' else 'full_load' end""",
    "dq": f"""case when {holds('great_expectations', 'great-expectations', 'expectation_suite')} then 'great_expectations' when contains(s, 'deequ') then 'deequ'
 when contains(s, 'soda') and contains(s, 'scan') then 'soda' when contains(s, 'dlt.expect') then 'dlt_expectations' when {holds('awsgluedq', 'evaluatedataquality')} then 'glue_dq'
 when regexp_matches(source, '(^|\\n)[ \\t]*assert[ (]') or {holds('is not null', 'isnull', 'isnotnull')} then 'custom' else 'none' end""",
    "target": f"""case when {holds('.writestream', '.write.format', '.write.mode')} then case when contains(s, 'delta') then 'delta' else 'parquet' end
 when contains(s, 'redshift') then 'redshift' when contains(s, 'snowflake') and contains(s, 'write') then 'snowflake'
 when {env_set('OUTPUT_BUCKET', 'SINK_BUCKET', 'TARGET_BUCKET', 'DEST_BUCKET')} then 's3' when {holds('adls', 'abfss://')} then 'adls_gen2' else 'unknown' end""",
    "snippet": f"""case when {holds('awsglue', 'gluecontext')} then 'AWS_Glue/aws/etl' when contains(s, 'lambda_handler') then 'AWS_Lambda/aws/etl'
 when contains(s, 'sparksession') and contains(s, 'databricks') then 'Databricks_Spark/azure/etl' when contains(s, 'dlt.') then 'Databricks_DLT/azure/streaming'
 when contains(s, '{{{{ config(') then 'dbt/multi/elt' when {holds('create task', 'create stream')} then 'Snowflake/snowflake/batch'
 when {holds('readstream', 'writestream')} then 'Spark_Streaming/multi/streaming' when contains(s, 'datafactory') then 'ADF/azure/etl' else 'unknown/unknown/unknown' end""",
}


def text_oracle(what):
    return f"with {PAIRED} select package_id, path, {TEXT_ORACLES[what]} as found from t"


@query("D18", "source_type_of_pairs", text_oracle("source_type"), CODE)
def source_type_of_pairs(spark, sf):
    return out(paired(spark, sf), cd.source_type(F.col("source")), "found")


@query("D19", "framework_of_pairs", text_oracle("framework"), CODE)
def framework_of_pairs(spark, sf):
    f = cd.framework(F.col("source"))
    return out(paired(spark, sf), F.concat_ws("/", f["framework"], f["pipeline_type"]), "found")


@query("D20", "mode_of_pairs", text_oracle("mode"), CODE)
def mode_of_pairs(spark, sf):
    return out(paired(spark, sf), cd.extraction_mode(F.col("source")), "found")


@query("D22", "dq_framework_of_pairs", text_oracle("dq"), CODE)
def dq_framework_of_pairs(spark, sf):
    return out(paired(spark, sf), cd.dq_framework(F.col("source")), "found")


@query("D23", "target_of_pairs", text_oracle("target"), CODE)
def target_of_pairs(spark, sf):
    return out(paired(spark, sf), cd.target_type(F.col("source")), "found")


@query("D26", "snippet_of_pairs", text_oracle("snippet"), CODE)
def snippet_of_pairs(spark, sf):
    f = cd.classify_snippet(F.col("source"))
    return out(paired(spark, sf), F.concat_ws("/", f["framework"], f["cloud_provider"], f["pattern"]), "found")


FOUND = """g as (select package_id, path, source from fx_code where source not like '%def broken%'),
f as (select package_id, 'format' as kind, regexp_extract(source, '(json|csv|yaml)', 1) as value, 'import' as method from g
 union select package_id, 'operation', case when source like '%get_object%' then 'read' else 'write' end, regexp_extract(source, '(get_object|put_object)', 1) from g where source like '%_object%'
 union select package_id, 'target', 's3://' || regexp_extract(source, 'Bucket=''([^'']+)''', 1), regexp_extract(source, '(get_object|put_object)', 1) from g where source like '%_object%'
 union select package_id, 'target', regexp_extract(source, 'TopicArn=''([^'']+)''', 1), 'publish' from g where source like '%TopicArn%')"""


@query("D28", "code_findings", f"with {FOUND} select package_id, kind, value, method from f", CODE)
def code_findings(spark, sf):
    return cd.code_findings(fixture(spark, sf, CODE), ["package_id"])


@query("D28", "unzip_code_corpus", """
select 'p' || cast(regexp_extract(path, '[0-9]+') as bigint) // 50 as package, path, source, null::varchar as error from fx_code where path like '%.py'""", CODE)
def unzip_code_corpus(spark, sf):
    """Fifty files at a time zipped in a task, then read back as archives."""
    import io
    import zipfile

    @F.pandas_udf("binary")
    def zipped(files: pd.Series) -> pd.Series:
        def one(members):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for m in members:
                    z.writestr(m["path"], m["source"])
            return out.getvalue()

        return files.map(one)

    number = F.floor(F.regexp_extract("path", "[0-9]+", 0).cast("bigint") / 50)  # packages of 50 files
    files = fixture(spark, sf, CODE).groupBy(F.concat(F.lit("p"), number).alias("package")).agg(F.collect_list(F.struct("path", "source")).alias("files"))
    return cd.unzip_python(files.select(F.col("package").alias("path"), zipped("files").alias("content")))


@query("X03", "code_findings_udtf", f"with {FOUND} select kind, value, count(*) as packages from (select distinct package_id, kind, value from f) group by 1, 2", CODE)
def code_findings_udtf(spark, sf):
    spark.udtf.register("code_findings", cd.code_findings_udtf())
    fixture(spark, sf, CODE).createOrReplaceTempView("code_corpus")
    return spark.sql("select f.kind, f.value, count(distinct package_id) as packages from code_corpus, lateral code_findings(source) f group by 1, 2")


@query("J18", "stitch_code_lineage", f"""
with {FOUND} select distinct value as from_id, 'package:' || package_id as to_id from f where kind = 'target' and method = 'get_object'
union select 'package:' || package_id, value from f where kind = 'target' and method <> 'get_object'""", CODE)
def stitch_code_lineage(spark, sf):
    return cd.stitch_lineage(cd.code_findings(fixture(spark, sf, CODE), ["package_id"]), "package_id")
