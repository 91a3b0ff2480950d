"""Listing, definition and free-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.plans.catalog import fixture, query, table
from metasift.sources import listings as ls

FILE = "fx_file"


def tags_case(col: str, table: dict) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then [{', '.join(repr(t) for t in v)}]" for k, v in table.items()) + " else [] end"


TREE = f"""p as (select root, path, string_split(path, '/') as s from fx_file),
v as (select root, path, s[-1] as name, s[:-2] as dirs from p where not list_has_any(s[:-2], [{", ".join(f"'{d}'" for d in rules.SKIP_DIRS)}])),
m as (select *, array_to_string(dirs, '/') as folder, {tags_case('lower(name)', rules.MARKER_FILES)} as marks from v),
w as (select *, case when len(marks) > 0 then marks when lower(dirs[-1]) = 'dags' and name like '%.py' then ['Apache Airflow DAGs'] when contains(lower(folder), 'glue') and name like '%.py' then ['AWS Glue Jobs'] else [] end as tags from m),
d as (select distinct root, array_to_string(dirs[1:k], '/') as dir from (select root, dirs, unnest(range(1, len(dirs) + 1)) as k from v)),
dt as (select root, dir, {tags_case("lower(string_split(dir,'/')[-1])", rules.MARKER_DIRS)} as tags from d),
t as (select root, 'tag' as kind, unnest(tags) as value from w union select root, 'file', path from w where len(tags) > 0 union select root, 'tag', unnest(tags) from dt
 union select root, 'dir', dir from dt where len(tags) > 0 union select root, 'folder', dir from dt where len(tags) > 0
 union select root, 'folder', case when folder = '' then '.' else folder end from w where len(marks) > 0 and regexp_matches(lower(name), '[.](yml|yaml|tf|toml)$'))"""


@query("S03", "scan_source_tree", f"with {TREE} select root, kind, value from t", FILE)
def scan_source_tree(spark, sf):
    return ls.source_tree(fixture(spark, sf, FILE)).where("kind <> 'evidence'")


@query("W09", "sorted_framework_set", f"with {TREE} select root, string_agg(value, '|' order by value) as frameworks from t where kind = 'tag' group by 1", FILE)
def sorted_framework_set(spark, sf):
    return ls.framework_set(ls.source_tree(fixture(spark, sf, FILE))).select("root", F.array_join("frameworks", "|").alias("frameworks"))


@query("W10", "global_cap_with_marker", """
with r as (select root, path, row_number() over (partition by root order by path) as rn, count(*) over (partition by root) as n from fx_file)
select root, path from r where rn <= 40 union all select distinct root, 'Stopped recording file paths after 40 entries (cap).' from r where n > 40""", FILE)
def global_cap_with_marker(spark, sf):
    return ls.cap_with_marker(fixture(spark, sf, FILE), 40)


@query("S04", "list_objects_prefix", """
with h as (select path as key from fx_file where path like 'jobs/%' and path not like '%/' order by path limit 100)
select ltrim(key[6:], '/') as name, (select count(*) from h) as count, (select count(*) from h) >= 100 as truncated from h""", FILE)
def list_objects_prefix(spark, sf):
    return ls.list_objects(fixture(spark, sf, FILE).select(F.col("path").alias("key")), "jobs/", 100)


@query("S05", "list_names_sorted_limit", """
select trim(string_split(id,'||')[-1]) as name from fx_asset where service = 'glue' and starts_with(trim(string_split(id,'||')[-1]), 's') order by 1 limit 50""", "fx_asset")
def list_names_sorted_limit(spark, sf):
    a = fixture(spark, sf, "fx_asset").select(F.trim(F.element_at(F.split("id", r"\|\|"), -1)).alias("name"), F.col("service").alias("schema"))
    return ls.list_names(a, 50, "s", "glue")


@query("S05", "list_api_names", """
select p_partkey, 0 as pos, '/parts/{id}' as name from part where p_partkey % 5 = 0 union all select p_partkey, 1, '/size/' || p_size from part where p_partkey % 5 = 0
union all select p_partkey, 0, 'name' from part where p_partkey % 5 = 1 union all select p_partkey, 1, 'size' from part where p_partkey % 5 = 1
union all select p_partkey, 0, 'brand' from part where p_partkey % 5 = 2 union all select p_partkey, 1, 'k' || p_size from part where p_partkey % 5 = 2""")
def list_api_names(spark, sf):
    p = table(spark, sf, "part")
    kind, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    doc = (F.when(kind == 0, F.concat(F.lit('{"openapi":"3.0","paths":{"/size/'), size, F.lit('":{},"/parts/{id}":{"get":{}}}}')))
           .when(kind == 1, F.concat(F.lit('[{"size":'), size, F.lit(',"name":"x"},{"other":1}]')))
           .when(kind == 2, F.concat(F.lit('{"k'), size, F.lit('":null,"brand":[]}'))).when(kind == 3, F.lit("[]")).otherwise("not json"))
    return ls.api_names(p.select("p_partkey", doc.alias("doc")), "doc", ["p_partkey"])


@query("S06", "decode_definition_parts", """
select item_id, path, case payload when 'eyJhIjoxfQ==' then '{"a":1}' when '{"a":2}' then '{"a":2}' else '"plain text!"' end as document from fx_definition where path is not null
union all select item_id, 'second', '[3]' from fx_definition""", "fx_definition")
def decode_definition_parts(spark, sf):
    d = fixture(spark, sf, "fx_definition")
    first = F.struct("path", "payload")
    second = F.struct(F.lit("second").alias("path"), F.lit("").alias("payload"), F.lit("WzNd").alias("payloadBase64"))
    doc = F.concat(F.lit('{"definition":{"parts":['), F.to_json(first), F.lit(","), F.to_json(second), F.lit(',"junk"]}}'))
    return ls.definition_parts(d.select("item_id", doc.alias("definition")))


@query("S07", "salvage_json_text", """
select conv_id, turn, case when turn % 3 = 0 and not contains(text[case when turn % 2 = 0 then 24 else 1 end:], 'zzz') then '{"a":1}' end as doc from fx_freetext""", "fx_freetext")
def salvage_json_text(spark, sf):
    return fixture(spark, sf, "fx_freetext").select("conv_id", "turn", ls.salvage_json(F.col("text")).alias("doc"))


@query("S08", "truncate_large_doc", """
select doc_id, case when length(text) > 2000 then text[1:2000] || '... [truncated]' else text end as text from documents""")
def truncate_large_doc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ls.truncate_text(F.col("text"), 2000).alias("text"))
