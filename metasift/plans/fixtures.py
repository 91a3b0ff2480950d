"""Portable fixture queries: the same text runs in Spark SQL and in DuckDB.

Each block derives one of the library's input tables from the driver's tables.
"""

FIXTURES: dict[str, str] = {
    "fx_payload": r"""
select o_orderkey as payload_id,
 concat('{"platform":"', case o_orderkey % 8 when 0 then 'glue' when 1 then 'adf' when 2 then 'snowflake' when 3 then 'databricks' when 4 then 'airflow' when 5 then 'kafka' when 6 then 'dbt' else 'custom' end, '","name":"job_', o_custkey % 50, '"}') as metadata,
 concat('{"input":"', case o_custkey % 5 when 0 then 's3://landing-' when 1 then 'abfss://raw@acct' when 2 then 'gs://lake-' when 3 then 'jdbc:postgresql://db-' else 'https://host/api.v' end, o_custkey % 7, '/orders/","output":"', case o_orderkey % 3 when 0 then 'jdbc:redshift://wh:5439/dev' when 1 then 'databricks_cluster' else 'none' end, '"}') as config,
 concat('{"type":"', case when o_orderkey % 8 = 1 then 'adf_pipeline' else 'job' end, '","checks":["', case o_orderpriority when '1-URGENT' then 'select count(*) > 0 from t' when '2-HIGH' then 'select * from t where x is null' when '3-MEDIUM' then 'soda scan' else 'noop' end, '"]}') as raw_json
from orders
""",
    "fx_expectation": r"""
select o_orderkey as payload_id,
 concat('{"suite_name":"suite_', o_custkey % 9, '","dq":{"expectations":[{"expectation_type":"', case o_orderkey % 4 when 0 then 'expect_column_values_to_not_be_null' when 1 then 'expect_column_values_to_be_unique' when 2 then 'expect_column_values_to_be_between' else 'expect_custom_thing' end, '","kwargs":{"column":"c', o_custkey % 5, '"}}]}}') as raw_json
from orders
""",
    "fx_edge": r"""
select concat('urn:li:dataset:(urn:li:dataPlatform:s3,part_', l_partkey, ',PROD)') as source_urn,
 concat('urn:li:dataJob:(urn:li:dataFlow:(glue,flow_', l_orderkey % 20, ',PROD),order_', l_orderkey, ')') as target_urn, 'DownstreamOf' as edge_type from lineitem
union all
select concat('urn:li:dataJob:(urn:li:dataFlow:(glue,flow_', o_orderkey % 20, ',PROD),order_', o_orderkey, ')'),
 concat('urn:li:dataset:(urn:li:dataPlatform:snowflake,customer_', o_custkey, ',PROD)'), 'DownstreamOf' from orders
union all
select concat('urn:li:dataJob:(urn:li:dataFlow:(glue,flow_', o_orderkey % 20, ',PROD),order_', o_orderkey, ')'),
 concat('urn:li:dataFlow:(glue,flow_', o_orderkey % 20, ',PROD)'), 'IsPartOf' from orders
""",
    "fx_entity": r"""
select p_partkey as entity_id, concat('urn:li:dataset:(urn:li:dataPlatform:', case p_partkey % 5 when 0 then 'glue' when 1 then 'snowflake' when 2 then 'kafka' when 3 then 'mysql' else 'other' end, ',', p_partkey, ',PROD)') as urn,
 case p_partkey % 4 when 0 then 'dataJob' when 1 then 'DATA_FLOW' when 2 then 'assertion' else 'dataset' end as type,
 case p_partkey % 6 when 0 then 'GlueJob' when 1 then 'AirflowTask' when 2 then 'SparkJob' else 'Other' end as job_type,
 concat(p_name, case when p_partkey % 7 = 0 then ' debezium' else '' end) as name
from part
""",
    "fx_urn": r"""
select l_orderkey * 1000000 + l_partkey as k, case l_partkey % 6
 when 0 then concat('urn:li:dataset:(urn:li:dataPlatform:s3,t', l_suppkey, ',PROD)')
 when 1 then concat('urn:li:dataFlow:(airflow,f', l_suppkey, ',DEV)')
 when 2 then concat('urn:li:dataJob:(urn:li:dataFlow:(glue,f', l_suppkey, ',PROD),j', l_partkey, ')')
 when 3 then concat('arn:aws:glue:us-east-', l_suppkey % 3, ':', 100000000000 + l_suppkey % 4, ':job/j', l_partkey)
 when 4 then concat('arn:aws:s3:::bucket-', l_suppkey)
 else concat('urn:li:dataset:broken', l_partkey) end as ref
from lineitem
""",
    "fx_asset": r"""
select p_partkey % 50 as payload_id, cast(p_partkey % 2 as int) as dump_pos, p_partkey as item_pos,
 case p_partkey % 6 when 0 then 's3' when 1 then 'lambda' when 2 then 'apigateway' when 3 then 'storage_accounts' when 4 then 'glue' else 'fabric_items' end as service,
 concat(case p_partkey % 3 when 0 then 'us-east-1' when 1 then 'azure' else 'fabric' end, ' || ', replace(p_name, ' ', '-'), '-', p_partkey % 20) as id,
 case when p_partkey % 6 = 1 then concat('s3://', replace(p_name, ' ', '-'), '-', p_partkey % 20) end as env_target,
 case when p_partkey % 6 = 5 then case p_size % 4 when 0 then 'Lakehouse' when 1 then 'Pipeline' when 2 then 'Notebook' else 'Report' end end as item_type,
 concat('{"Region":"r', p_size % 4, '","Runtime":"python3.', p_size % 5, '","IsHnsEnabled":', case when p_size % 2 = 0 then 'true' else 'false' end, '}') as configuration
from part
""",
    "fx_activity": r"""
select l_orderkey as pipeline_id, idx, concat('act_', idx) as name,
 case l_partkey % 6 when 0 then 'Copy' when 1 then 'WebActivity' when 2 then 'TridentNotebook' when 3 then 'IfCondition' when 4 then 'Office365Email' else 'Script' end as type,
 case when idx > 1 then concat('act_', case when idx % 3 = 0 then idx - 2 else idx - 1 end) end as depends_on,
 case when l_partkey % 6 = 0 then concat('{"type":"', case l_suppkey % 3 when 0 then 'DelimitedText' when 1 then 'Parquet' else 'LakehouseTable' end, '","path":"raw/', l_suppkey, '"}') end as src,
 case when l_partkey % 6 = 0 then concat('{"type":"AzureSqlTable","table":"t_', l_suppkey, '"}') end as sink
from (select l_orderkey, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as idx from lineitem) z
""",
    "fx_config": r"""
select c_custkey as config_id, 'baseline' as side,
 concat('{"name":"', c_name, '","connection":{"host":"h', c_nationkey, '","port":', 1000 + c_nationkey, '},"tags":["', c_mktsegment, '","x"]}') as doc from customer
union all
select c_custkey, 'candidate',
 concat('{"name":"', case when c_custkey % 5 = 0 then lower(c_name) else c_name end, '","connection":{"host":"h', case when c_custkey % 3 = 0 then 99 else c_nationkey end, '"', case when c_custkey % 4 = 0 then '' else concat(',"port":', 1000 + c_nationkey) end, '},"tags":["', c_mktsegment, '"', case when c_custkey % 2 = 0 then ',"y"' else '' end, '],"extra":', c_custkey % 2, '}') from customer
""",
    "fx_merge": r"""
select o_orderkey as config_id,
 case when o_orderkey % 4 = 0 then null else concat('tbl_', o_custkey % 10) end as raw_destination,
 case o_orderkey % 5 when 0 then 'Send Email' when 1 then null else concat('tbl_', o_custkey % 7) end as extracted_destination,
 concat('example_', o_custkey % 3) as example_destination,
 case o_orderkey % 3 when 0 then null else 'batch' end as extracted_mode,
 case o_orderkey % 2 when 0 then 'row_count_check' else 'schema_check' end as extracted_rule,
 case o_orderkey % 6 when 0 then 'select count(*) from t' when 1 then 'x is null' else 'noop' end as raw_text,
 case o_orderkey % 7 when 0 then null else concat('REST API -> Load -> Send Email -> tbl_', o_custkey % 10, case when o_orderkey % 2 = 0 then ' with validation gates' else '' end) end as raw_flow
from orders
""",
    "fx_report": r"""
select l_orderkey as report_id, case when l_orderkey % 2 = 0 then 'ADF' else 'Fabric' end as platform, concat('pipe_', l_orderkey % 100) as pipeline_name,
 concat('node_', l_linenumber) as node_id, case l_partkey % 4 when 0 then 'source' when 1 then 'ingestion' when 2 then 'process' else 'validation' end as node_type,
 case when l_orderkey % 3 = 0 then 'null_check' end as dq_rule, case when l_orderkey % 11 = 0 then 'Other' else 'DataPipeline' end as type
from lineitem
""",
    "fx_pipeline": r"""
select o_orderkey as pipe_id, concat('src_', o_custkey % 9) as source, case when o_orderkey % 4 = 0 then null else concat('ing_', o_custkey % 6) end as ingestion, concat('fw_', o_custkey % 4) as framework from orders
""",
    "fx_jobspec": r"""
select concat('00000000-', lpad(cast(o_orderkey as string), 8, '0')) as job_id,
 case o_orderkey % 6 when 0 then 'aws' when 1 then 'gcp' when 2 then 'snowflake' when 3 then 'postgres' when 4 then 'salesforce' else 'ftp' end as source_type,
 concat('b', o_custkey % 9) as bucket, case when o_orderkey % 3 = 0 then 'year={YYYY}/month={MM}' end as partition_pattern,
 case o_custkey % 3 when 0 then 'full_load' when 1 then 'incremental' else 'cdc' end as extraction_mode,
 case when o_custkey % 6 = 1 then null else 'updated_at' end as watermark_column,
 case o_orderkey % 4 when 0 then '0 2 * * *' when 1 then 'bad cron' end as cron_expression,
 case when o_orderkey % 5 = 0 then 'csv' else 'parquet' end as file_format, case when o_orderkey % 2 = 0 then 'snappy' else 'gzip' end as compression,
 case when o_orderkey % 9 = 0 then 'not-an-email' else concat('u', o_custkey, '@x.com') end as email,
 cast(floor(o_totalprice) as bigint) as batch_size, concat('secret-', o_custkey) as secret_value
from orders
""",
    "fx_field": r"""
select c_custkey as config_id, 'host' as k, concat('h', c_nationkey) as v from customer
union all select c_custkey, 'mode', case when c_custkey % 3 = 0 then '' else 'incremental' end from customer
union all select c_custkey, 'format', 'csv' from customer
union all select c_custkey, 'owner', c_mktsegment from customer
""",
    "fx_file": r"""
select doc_id % 10 as root,
 concat(case doc_id % 6 when 0 then 'dags/' when 1 then 'jobs/glue/' when 2 then 'node_modules/' when 3 then 'terraform/' when 4 then 'a/b/c/d/e/f/g/' else '' end,
  case doc_id % 4 when 0 then concat('f', doc_id, '.py') when 1 then 'dbt_project.yml' when 2 then 'pom.xml' else concat('n', doc_id, '.txt') end) as path,
 n_chars as length
from documents
""",
    "fx_definition": r"""
select p_partkey as item_id, case when p_partkey % 5 = 0 then null else 'pipeline-content.json' end as path,
 case p_partkey % 3 when 0 then 'eyJhIjoxfQ==' when 1 then '{"a":2}' else 'plain text!' end as payload from part
""",
    "fx_freetext": r"""
select conv_id, turn, concat(case when turn % 2 = 0 then '<think>x {no} </think>' else '' end, text, case turn % 3 when 0 then ' {"a":1}' when 1 then ' {broken' else '' end) as text from conversations
""",
    "fx_code": r"""
select p_partkey % 40 as package_id, concat('m', p_partkey, '.py') as path,
 concat(case p_partkey % 3 when 0 then 'import json' when 1 then 'import csv' else 'from yaml import load' end, chr(10),
  case p_partkey % 4 when 0 then concat('s3.get_object(Bucket=''in-', p_size, ''', Key=''k'')') when 1 then concat('s3.put_object(Bucket=''out-', p_size, ''', Key=''k'')') when 2 then concat('sns.publish(TopicArn=''arn:aws:sns:us-east-1:1:t', p_size, ''')') else 'def broken(:' end, chr(10),
  'PG_HOST = ''h', p_size, '''', chr(10)) as source
from part
""",
    "fx_job": r"""
select s_suppkey as job_id, s_nationkey as task_pos, case when s_suppkey % 3 = 0 then 'great-expectations==0.18' when s_suppkey % 3 = 1 then 'soda-core' else 'pandas' end as package, case when s_suppkey % 4 = 0 then null else concat('type_', s_suppkey % 5) end as source_type from supplier
""",
    "fx_dirty": r"""
select o_orderkey as id, case when o_orderkey % 17 = 0 then null else o_custkey end as custkey,
 case when o_orderkey % 13 = 0 then 'abc' else cast(cast(floor(o_totalprice) as bigint) as string) end as amount_text,
 case when o_orderkey % 19 = 0 then 'bad' else concat('u', o_custkey, '@x.com') end as email, o_orderdate as order_date from orders
union all
select o_orderkey, case when o_orderkey % 17 = 0 then null else o_custkey end, case when o_orderkey % 13 = 0 then 'abc' else cast(cast(floor(o_totalprice) as bigint) as string) end,
 case when o_orderkey % 19 = 0 then 'bad' else concat('u', o_custkey, '@x.com') end, o_orderdate from orders where o_orderpriority = '1-URGENT'
""",
    "fx_adf": r"""
select o_orderkey as payload_id,
 concat('{"platform":"adf","workspaceId":"ws-', o_custkey % 4, '"}') as metadata,
 concat('{"region":"r1"', case when o_orderkey % 7 = 0 then ',"output":"lake_out"' else '' end, '}') as config,
 concat('{"type":"', case when o_orderkey % 2 = 0 then 'adf_pipeline' else 'ADF_Pipeline' end, '","name":"pipe_', o_custkey, '","activities":[',
  '{"name":"Load","type":"Copy","dependsOn":[{"activity":"Fetch"}],"typeProperties":{"source":{"type":"x","datasetSettings":',
  case o_custkey % 3 when 0 then '{"type":"LakehouseTable","path":"raw/a"}' when 1 then '{"type":"AzureBlob","fileName":"f.csv"}' else '{"type":"DelimitedText","columnDelimiter":";"}' end,
  '},"sink":{"type":"AzureSqlTable","table":"t_', o_custkey % 9, '"}}},',
  '{"name":"Fetch","type":"WebActivity","dependsOn":[],"typeProperties":{"url":"https://host/api/v', o_custkey % 5, '","method":"GET"}},',
  '{"name":"Check","type":"IfCondition","dependsOn":["Load"]},',
  '{"name":"Notify Team","type":"Office365Email","dependsOn":[{"activity":"Check"},{"activity":"Ghost"}]}],',
  case when o_orderkey % 3 = 0 then '"connection":"c1","trigger":"Tumbling","schedule":"0 2 * * *"}' else '"identity":"ManagedIdentity","recurrence":{"frequency":"Day","interval":1}}' end) as raw_json
from orders
""",
    "fx_fabric": r"""
select p_partkey as pipeline_id, case when p_size % 5 = 0 then 's3' else 'fabric_items' end as service,
 concat('fabric || item_', p_size) as id,
 concat('{"Type":"', case p_partkey % 3 when 0 then 'DataPipeline' when 1 then 'Pipeline' else 'Notebook' end, '","WorkspaceId":"w', p_size % 3, '","Definition":{"pipeline-content.json":{"properties":{"activities":[',
  '{"name":"Clean","type":"TridentNotebook","dependsOn":[{"activity":"Copy In"}]},{"name":"Copy In","type":"Copy","dependsOn":[],"typeProperties":{"source":{"datasetSettings":{"type":"Parquet","path":"onelake/p', p_size % 4, '"}}}}]}}}}') as configuration
from part
""",
    "fx_capability": r"""
select l_orderkey as report_id, l_linenumber as seq,
 concat(case l_suppkey % 9 when 0 then 'http_call' when 1 then 'foreach_x' when 2 then 'if_condition' when 3 then 'email_team' when 4 then 'load_csv' when 5 then 'copy_table' when 6 then 'event_in' else 'step' end, '_', l_linenumber) as node_id,
 case l_partkey % 4 when 0 then 'source' when 1 then 'ingestion' when 2 then 'process' else 'validation' end as node_type
from lineitem
""",
    "fx_dump": r"""
select p_partkey as payload_id,
 concat('{"raw_cloud_dump":[{"s3":[{"id":"us-east-1 || ', p_name, '","configuration":{"Region":"r', p_size % 4, '"}},"loose ', p_partkey, '",null,"  "],"lambda":"not a list","glue":[{"id":"us-west-2 || g', p_size, '"}]}',
  case when p_partkey % 3 = 0 then ',"junk"' when p_partkey % 3 = 1 then concat(',{"s3":[{"id":"eu || second', p_size, '","configuration":{"Region":"eu"}}],"sns":[7]}') else '' end, ']}') as raw_json
from part
""",
    "fx_connector": r"""
select o_orderkey as payload_id,
 concat('{"name":"job_', o_custkey % 50, '","platform":"custom","Snowflake_Account":"acct', o_custkey % 3, '","warehouse":"wh', o_custkey % 4, '","role":"r', o_custkey % 2, '"',
  case when o_orderkey % 2 = 0 then concat(',"region":"us-east-', o_custkey % 3, '"') else '' end, case when o_orderkey % 5 = 0 then concat(',"project":"proj', o_custkey % 5, '"') else '' end, '}') as metadata,
 concat('{"input":"', case o_custkey % 4 when 0 then 's3://lake-a/x s3a://lake-b/y' when 1 then 'abfss://raw@acct/p' when 2 then 'gs://bucket-1/z' else 'jdbc:redshift://wh:5439/dev' end,
  '","database":"db', o_custkey % 6, '","schema":"sc","username":"u', o_custkey % 8, '","bootstrap_servers":"b:9092","security_protocol":"SSL","port":', case when o_orderkey % 3 = 0 then 0 else 5000 + o_custkey % 3 end,
  ',"num_workers":', o_custkey % 4, ',"Schedule":"@daily","auth_type":"oauth"', case when o_orderkey % 4 = 0 then ',"api_key":"k1","aws_access_key_id":"AK"' else '' end, ',"dag_id":"dag_', o_custkey % 9, '","connector_id":"c', o_custkey % 7, '"}') as config,
 concat('{"cmd":"spark-submit --packages org.x:y:1 kafka.topic=orders_', o_custkey % 3, ' tags=[a;b] dbt model=m', o_custkey % 3, ' linked_service=ls', o_custkey % 4, '","iam":"arn:aws:iam::123:role/r', o_custkey % 5,
  '","sm":"arn:aws:states:us-east-1:123:stateMachine:sm', o_custkey % 3, '","fn":"arn:aws:lambda:us-east-1:123:function:f', o_custkey % 4, '","urls":["https://h/api/v', o_custkey % 3, '","jdbc:postgresql://db', o_custkey % 4, ':5432/x"],"bq_dataset":"ds', o_custkey % 2,
  '","factory_name":"adf', o_custkey % 3, '","master":"yarn","template":"tpl","target":"prod","topics":"a;b","state_machine_name":"sm","cluster_id":"cl', o_custkey % 6, '","runtime":"py3","azure_tenant_id":"tn"}') as raw_json
from orders
""",
}
