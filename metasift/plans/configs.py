"""Diff, reconcile and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import text as tx
from metasift.operators import configs as cf
from metasift.operators import documents as ds
from metasift.operators import jsonwalk as jw
from metasift.plans.catalog import fixture, query

CONFIG, MERGE = "fx_config", "fx_merge"
LEAF = """leaf as (select config_id, side, t.fullkey[3:] as path, t.type as kind, t.atom::varchar as value
 from fx_config, json_tree(doc) t where t.type not in ('OBJECT','ARRAY')),
b as (select * from leaf where side = 'baseline'), c as (select * from leaf where side = 'candidate'),
d as (select config_id, path, b.value as bv, c.value as cv, case when b.path is null then 'added' when c.path is null then 'removed'
 when b.value = c.value then 'match' else 'mismatch' end as status from b full join c using (config_id, path))"""
WHOLE = """leaf as (select config_id, side, t.fullkey[3:] as path, t.type as kind, t.value::varchar as value
 from fx_config, json_tree(doc) t where t.type <> 'OBJECT' and t.fullkey not like '%[%'),
b as (select * from leaf where side = 'baseline'), c as (select * from leaf where side = 'candidate')"""


def two(spark, sf, list_leaves=False):
    f = fixture(spark, sf, CONFIG)
    return [cf.leaves(f.where(F.col("side") == s), "doc", list_leaves) for s in ("baseline", "candidate")]


@query("M13", "diff_flat", f"with {LEAF} select config_id, path, status, bv as baseline_val, cv as candidate_val from d", CONFIG)
def diff_flat(spark, sf):
    return cf.diff_flat(*two(spark, sf))


TREE = """n as (select config_id, side, 'root.' || t.fullkey[3:] as path, t.type as kind, t.value::varchar as value
 from fx_config, json_tree(doc) t where t.fullkey <> '$'),
b as (select * from n where side = 'baseline'), c as (select * from n where side = 'candidate'),
j as (select config_id, path, case when b.path is null then 'added' when c.path is null then 'removed'
 when b.kind in ('OBJECT','ARRAY') then 'nested' when lower(b.value) = lower(c.value) then 'match' else 'mismatch' end as status,
 b.value as lv, c.value as rv from b full join c using (config_id, path))"""


@query("A02", "diff_summary", f"""
with {TREE}, {LEAF.replace("b as (", "fb as (").replace("c as (", "fc as (").replace("from b full join c", "from fb b full join fc c")},
t as (select config_id, status from j)
select 'flat' as form, config_id, count(*) filter (status = 'match') as match, count(*) filter (status = 'mismatch') as mismatch,
 count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed, 0::bigint as type_change, 0::bigint as nested from d group by 2
union all select 'tree', config_id, count(*) filter (status = 'match'), count(*) filter (status = 'mismatch'),
 count(*) filter (status = 'added'), count(*) filter (status = 'removed'), 0, 4 from t group by 2""", CONFIG)
def diff_summary(spark, sf):
    flat = cf.diff_summary(cf.diff_flat(*two(spark, sf)), ["match", "mismatch", "added", "removed"])
    f = fixture(spark, sf, CONFIG)
    tree = cf.tree_summary(cf.diff_tree(f.where("side = 'baseline'"), f.where("side = 'candidate'"), "doc"))
    zero = F.lit(0).cast("bigint")
    return flat.withColumns({"type_change": zero, "nested": zero, "form": F.lit("flat")}).unionByName(
        tree.withColumn("form", F.lit("tree")))


@query("M14", "diff_tree", f"""
with {TREE} select config_id, path, status, case when status <> 'nested' then lv end as left_val,
 case when status <> 'nested' then rv end as right_val from j""", CONFIG)
def diff_tree(spark, sf):
    f = fixture(spark, sf, CONFIG)
    return cf.diff_tree(f.where("side = 'baseline'"), f.where("side = 'candidate'"), "doc").select(
        "config_id", "path", "status", "left_val", "right_val")


@query("U01", "key_union", f"with {LEAF} select distinct config_id, path from leaf", CONFIG)
def key_union(spark, sf):
    return cf.key_union(*two(spark, sf))


@query("M15", "reconcile_documents", f"""
with {WHOLE}
select 'candidate_wins' as strategy, config_id, path, coalesce(c.value, b.value) as value from b full join c using (config_id, path)
union all select 'baseline_wins', config_id, path, coalesce(b.value, c.value) from b full join c using (config_id, path)
union all select 'manual', config_id, path, value from b""", CONFIG)
def reconcile_documents(spark, sf):
    b, c = two(spark, sf, True)
    out = [cf.reconcile(b, c, s).select(F.lit(s).alias("strategy"), "config_id", "path", "value")
           for s in ("candidate_wins", "baseline_wins", "manual")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def override_rows(spark, sf):
    ids = fixture(spark, sf, CONFIG).where("side = 'baseline'").select("config_id")
    return ids.select("config_id", F.explode(F.expr(
        "array(named_struct('path','connection.host','kind','string','value','\"override\"'),"
        " named_struct('path','owner.team','kind','string','value','\"data\"'))")).alias("o")).select("config_id", "o.*")


OVERRIDE = """o as (select config_id, unnest(['connection.host','owner.team']) as path, unnest(['"override"','"data"']) as value
 from fx_config where side = 'baseline'),
m as (select config_id, path, coalesce(c.value, b.value) as value from b full join c using (config_id, path))"""


SORTED_DOC = """d as (select config_id, side, '{"connection":{"host":' || json_extract(doc,'$.connection.host')::varchar
 || coalesce(',"port":' || json_extract(doc,'$.connection.port')::varchar, '') || '}' as conn, json_extract(doc,'$.connection.port')::varchar as port,
 json_extract(doc,'$.connection.host')::varchar as host, json_extract(doc,'$.name')::varchar as name, json_extract(doc,'$.tags')::varchar as tags, json_extract(doc,'$.extra')::varchar as extra from fx_config)"""


@query("M15", "reconciled_document", f"""
with {SORTED_DOC}, b as (select * from d where side = 'baseline'), c as (select * from d where side = 'candidate'),
r as (select 'candidate_wins' as strategy, c.config_id, c.host, coalesce(c.port, b.port) as port, c.extra, c.name, c.tags from b join c using (config_id)
 union all select 'baseline_wins', b.config_id, b.host, b.port, c.extra, b.name, b.tags from b join c using (config_id)
 union all select 'manual', config_id, host, port, extra, name, tags from b)
select strategy, config_id, '{{"connection":{{"host":' || host || ',"port":' || port || '}}' || coalesce(',"extra":' || extra, '') || ',"name":' || name || ',"tags":' || tags || '}}' as document from r""", CONFIG)
def reconciled_document(spark, sf):
    b, c = two(spark, sf, True)
    out = [cf.reconcile(b, c, s).withColumn("strategy", F.lit(s)) for s in ("candidate_wins", "baseline_wins", "manual")]
    whole = out[0].unionByName(out[1]).unionByName(out[2])
    return ds.assemble(whole, ["strategy", "config_id"]).select("strategy", "config_id", F.to_json("document").alias("document"))


@query("M16", "apply_overrides", f"""
with {WHOLE}, {OVERRIDE}
select 'doc' as part, config_id, path, null as from_val, coalesce(o.value, m.value) as value from m full join o using (config_id, path)
union all select 'log', o.config_id, o.path, m.value, o.value from o left join m using (config_id, path)""", CONFIG)
def apply_overrides(spark, sf):
    b, c = two(spark, sf, True)
    doc, log = cf.apply_overrides(cf.reconcile(b, c), override_rows(spark, sf))
    return doc.select(F.lit("doc").alias("part"), "config_id", "path", F.lit(None).cast("string").alias("from_val"), "value").unionByName(
        log.select(F.lit("log").alias("part"), "config_id", "path", "from_val", F.col("to_val").alias("value")))


@query("M17", "reconcile_change_log", f"""
with {LEAF} select config_id, path, bv as baseline_val, cv as candidate_val, coalesce(cv, case when path not like 'tags%' then bv end) as result_val
from d where status <> 'match' and path <> 'connection.host'""", CONFIG)
def reconcile_change_log(spark, sf):
    f = fixture(spark, sf, CONFIG)
    b, c = two(spark, sf)
    wb, wc = two(spark, sf, True)
    merged = cf.reconcile(wb, wc)
    # Indexed leaves of the merged document: lists open up, other leaves stay.
    lists = merged.where("kind = 'array'")
    opened = jw.walk(lists.select(F.struct("config_id", "path").alias("k"), "value"), "value", ["k"]).select(
        "k.config_id", F.concat("k.path", "path").alias("path"), "kind", "value")
    flat = merged.where("kind not in ('array', 'object')").unionByName(opened)
    return cf.change_log(b, c, flat, override_rows(spark, sf).where("path = 'connection.host'"))


@query("M18", "merge_additive", f"""
with {WHOLE} select config_id, path, case when b.kind = 'ARRAY' and c.kind = 'ARRAY' then
 '[' || array_to_string(list_concat(from_json(b.value,'["JSON"]')::varchar[], list_filter(from_json(c.value,'["JSON"]')::varchar[], lambda x: not list_contains(from_json(b.value,'["JSON"]')::varchar[], x))), ',') || ']'
 else coalesce(b.value, c.value) end as value from b full join c using (config_id, path)""", CONFIG)
def merge_additive(spark, sf):
    b, c = two(spark, sf, True)
    return cf.merge_additive(b, c).select("config_id", "path", "value")


@query("U04", "list_union_ordered", """
with t as (select config_id, max(json_extract_string(doc,'$.tags[0]')) filter (side = 'baseline') as a,
 max(json_extract_string(doc,'$.tags[0]')) filter (side = 'candidate') as b, max(json_extract_string(doc,'$.tags[1]')) filter (side = 'candidate') as c from fx_config group by 1)
select config_id, a || '|x' || coalesce('|' || c, '') as tags from t""", CONFIG)
def list_union_ordered(spark, sf):
    f = fixture(spark, sf, CONFIG)
    tags = F.from_json(F.get_json_object("doc", "$.tags"), "array<string>")
    one = [f.where(F.col("side") == s).select("config_id", tags.alias(s)) for s in ("baseline", "candidate")]
    return one[0].join(one[1], "config_id").select(
        "config_id", F.array_join(cf.list_union(F.col("baseline"), F.col("candidate")), "|").alias("tags"))


@query("F22", "equals_loose", """
with t as (select config_id, max(json_extract_string(doc,'$.name')) filter (side = 'baseline') as a,
 max(json_extract_string(doc,'$.name')) filter (side = 'candidate') as b,
 max(json_extract_string(doc,'$.connection.port')) filter (side = 'baseline') as p from fx_config group by 1)
select config_id, lower(trim(a)) = lower(trim(b)) as same_name, true as same_port, false as same_kind from t""", CONFIG)
def equals_loose(spark, sf):
    f = fixture(spark, sf, CONFIG)
    name = F.to_json(F.try_variant_get(F.try_parse_json("doc"), "$.name", "variant"))
    port = F.get_json_object("doc", "$.connection.port")
    s, n, k = F.lit("string"), F.lit("number"), F.lit("boolean")
    one = [f.where(F.col("side") == x).select("config_id", name.alias(x), port.alias("p" + x)) for x in ("baseline", "candidate")]
    return one[0].join(one[1], "config_id").select(
        "config_id",
        tx.equals_loose(F.concat(F.lit('" '), F.expr("substring(baseline, 2)")), F.col("candidate"), s, s).alias("same_name"),
        tx.equals_loose(F.col("pbaseline"), F.concat("pbaseline", F.lit(".0")), n, n).alias("same_port"),
        tx.equals_loose(F.col("pbaseline"), F.lit("true"), n, k).alias("same_kind"))


# --- three-way merge ---------------------------------------------------------------------

def merge_sides(spark, sf):
    """Ingestion sections of the raw, extracted and example documents."""
    m = fixture(spark, sf, MERGE)
    x = F.to_json(F.struct(F.col("extracted_destination").alias("destination"), F.col("extracted_mode").alias("mode")))
    r = F.to_json(F.struct(F.col("raw_destination").alias("destination")))
    e = F.to_json(F.struct(F.col("example_destination").alias("destination"), F.lit("batch").alias("mode"),
                           F.lit("daily").alias("frequency")))
    return [cf.leaves(m.select("config_id", d.alias("doc")), "doc") for d in (x, r, e)]


MERGED = """m as (select config_id, raw_destination as r, extracted_destination as x, example_destination as e, extracted_mode as mode, coalesce(raw_destination, extracted_destination) as now from fx_merge)"""


@query("M03", "merge_three_way", f"""
with {MERGED}
select 'value' as part, config_id, 'destination' as field, '' as action, '"' || coalesce(now, e) || '"' as new_value from m
union all select 'value', config_id, 'mode', '', '"batch"' from m
union all select 'value', config_id, 'frequency', '', '"daily"' from m
union all select 'report', config_id, 'ingestion_configs.destination', 'filled', '"' || r || '"' from m where r is not null and x is null
union all select 'report', config_id, 'ingestion_configs.destination', 'corrected', '"' || r || '"' from m where r <> x
union all select 'report', config_id, 'ingestion_configs.destination', 'conflict_raw_wins', null from m where r <> x
union all select 'report', config_id, 'ingestion_configs.destination', 'from_extracted', null from m where now is not null
union all select 'report', config_id, 'ingestion_configs.destination', 'from_example', '"' || e || '"' from m where now is null
union all select 'report', config_id, 'ingestion_configs.destination', 'conflict_extracted_kept', null from m where now <> e and (r is null or r <> now)
union all select 'report', config_id, 'ingestion_configs.mode', case when mode is null then 'from_example' else 'from_extracted' end, case when mode is null then '"batch"' end from m
union all select 'report', config_id, 'ingestion_configs.frequency', 'from_example', '"daily"' from m""", MERGE)
def merge_three_way(spark, sf):
    x, r, e = merge_sides(spark, sf)
    doc, report = cf.merge_three_way(x, r, e, "ingestion_configs")
    return doc.select(F.lit("value").alias("part"), "config_id", F.col("path").alias("field"), F.lit("").alias("action"),
                      F.col("value").alias("new_value")).unionByName(
        report.select(F.lit("report").alias("part"), "config_id", "field", "action", "new_value"))


@query("M19", "diff_three_way_view", f"""
with {MERGED}, rows as (
 select config_id, 'destination' as path, '"' || x || '"' as extracted, '"' || e || '"' as example, '"' || coalesce(now, e) || '"' as final from m
 union all select config_id, 'mode', '"' || mode || '"', '"batch"', '"batch"' from m
 union all select config_id, 'frequency', null, '"daily"', '"daily"' from m)
select *, (extracted is distinct from final or example is distinct from final) as changed from rows""", MERGE)
def diff_three_way_view(spark, sf):
    x, r, e = merge_sides(spark, sf)
    doc, _ = cf.merge_three_way(x, r, e, "ingestion_configs")
    return cf.three_way_view(x, e, doc)


@query("M01", "normalize_config", """
select config_id, '{"destination":"' || example_destination || '"}' as source_configs, '{}' as ingestion_configs,
 '["' || extracted_rule || '"]' as dq_rules, case when raw_flow is null then '{}' else '{"text":"' || raw_flow || '"}' end as flow,
 '[]' as missing from fx_merge""", MERGE)
def normalize_config(spark, sf):
    m = fixture(spark, sf, MERGE)
    doc = F.concat(F.lit('{"source_config":{"destination":"'), "example_destination", F.lit('"},"ingestion_configs":[1],"dq_rules":["'),
                   "extracted_rule", F.lit('"],"missing_fields_analysis":"none","flow":'),
                   F.coalesce(F.concat(F.lit('"'), "raw_flow", F.lit('"')), F.lit("null")), F.lit("}"))
    n = m.select("config_id", cf.normalize_config(doc).alias("n"))
    return n.select("config_id", "n.source_configs", "n.ingestion_configs", "n.dq_rules", "n.flow",
                    F.col("n.missing_fields_analysis").alias("missing"))


@query("M02", "derive_from_raw", """
select config_id, raw_destination is not null as from_raw, coalesce(raw_destination, extracted_destination) as destination,
 case when raw_destination is not null then raw_flow else 'extracted flow' end as flow_text from fx_merge""", MERGE)
def derive_from_raw(spark, sf):
    m = fixture(spark, sf, MERGE).withColumn("extracted_flow", F.lit("extracted flow"))
    reports = m.where("raw_destination is not null").select(
        "config_id", F.posexplode(F.array("raw_destination", F.lit("later"))).alias("seq", "destination"),
        F.col("raw_flow").alias("flow_text"))
    return cf.derive_from_raw(m, reports)


SUPPORT = """s as (select config_id, case when raw_text like '%count(*)%' then 'row_count_check' when raw_text like '%is null%' then 'null_check' end as rule,
 extracted_rule, raw_destination as rd, extracted_destination as xd, example_destination as ed, extracted_mode as mode, raw_flow from fx_merge)"""


def rule_arrays():
    none = F.array().cast("array<string>")
    supported = cf.supported_rules(F.col("raw_text"), none)
    return none, F.array("extracted_rule"), F.array(F.lit("null_check"), F.lit("range_check")), supported


@query("M08", "supported_dq_rules", f"with {SUPPORT} select config_id, coalesce(rule, '') as rules from s", MERGE)
def supported_dq_rules(spark, sf):
    return fixture(spark, sf, MERGE).select("config_id", F.array_join(rule_arrays()[3], "|").alias("rules"))


@query("M04", "merge_dq_rules", f"""
with {SUPPORT} select config_id, case when rule = extracted_rule or rule = 'null_check' then rule else '' end as rules,
 case when rule = 'null_check' then 'range_check' else 'null_check|range_check' end as ignored from s""", MERGE)
def merge_dq_rules(spark, sf):
    raw, extracted, example, supported = rule_arrays()
    return fixture(spark, sf, MERGE).select(
        "config_id", F.array_join(cf.merge_dq_rules(raw, extracted, example, supported), "|").alias("rules"),
        F.array_join(cf.ignored_rules(example, supported), "|").alias("ignored"))


@query("U02", "unsupported_rules", f"""
with {SUPPORT} select config_id, array_to_string(list_sort(list_filter([extracted_rule, 'range_check'], lambda x: x is distinct from rule)), '|') as rules from s""", MERGE)
def unsupported_rules(spark, sf):
    *_, supported = rule_arrays()
    final = F.array(F.lit("range_check"), F.col("extracted_rule"))
    return fixture(spark, sf, MERGE).select("config_id", F.array_join(cf.unsupported_rules(final, supported), "|").alias("rules"))


FLOW = "replace(raw_flow, 'Send Email -> ', '')"


@query("M06", "sanitize_flow_text", f"select config_id, {FLOW} as flow from fx_merge", MERGE)
def sanitize_flow_text(spark, sf):
    return fixture(spark, sf, MERGE).select("config_id", cf.sanitize_flow(F.col("raw_flow")).alias("flow"))


@query("M05", "merge_flow", f"select config_id, coalesce({FLOW}, 'A -> ' || example_destination) as flow from fx_merge", MERGE)
def merge_flow(spark, sf):
    return fixture(spark, sf, MERGE).select("config_id", cf.merge_flow(
        F.col("raw_flow"), F.lit(""), F.concat(F.lit("A -> Teams Alert ->"), "example_destination")).alias("flow"))


@query("M07", "fill_mode_from_input", """
select config_id, coalesce(extracted_mode, 'streaming') as mode, extracted_mode is null as from_input from fx_merge""", MERGE)
def fill_mode_from_input(spark, sf):
    return fixture(spark, sf, MERGE).select("config_id", cf.fill_mode(F.col("extracted_mode"), F.lit("streaming")).alias("m")).select("config_id", "m.mode", "m.from_input")


@query("F23", "looks_like_notification", """
select config_id, coalesce(lower(extracted_destination) like '%email%', false) as notify from fx_merge""", MERGE)
def looks_like_notification(spark, sf):
    return fixture(spark, sf, MERGE).select("config_id", tx.looks_like_notification(F.col("extracted_destination")).alias("notify"))


@query("M09", "correct_notification_destination", """
select config_id, case when extracted_destination = 'Send Email' then raw_destination else extracted_destination end as destination from fx_merge""", MERGE)
def correct_notification_destination(spark, sf):
    return fixture(spark, sf, MERGE).select("config_id", cf.correct_destination(
        F.col("extracted_destination"), F.col("raw_destination")).alias("destination"))


def core_rows(spark, sf):
    raw, extracted, example, supported = rule_arrays()
    return fixture(spark, sf, MERGE).select(
        "config_id", "raw_text", cf.merge_dq_rules(raw, extracted, example, supported).alias("dq_rules"),
        cf.merge_flow(F.col("raw_flow"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("flow_text"),
        supported.alias("supported"), "raw_destination", "raw_flow")


def final_leaves(spark, sf):
    x, r, e = merge_sides(spark, sf)
    doc, _ = cf.merge_three_way(x, r, e, "ingestion_configs")
    return doc.withColumn("path", F.concat(F.lit("ingestion_configs."), "path"))


MISSING_FIXED = [f for f in cf.REQUIRED if f not in ("ingestion_configs.destination", "ingestion_configs.frequency")]
REASON = """case when f like '%artifactId' then 'Requires external metadata.'
 when f like '%source_type' or f like '%service_name' then 'Not derivable from activities.' else 'Not present in pipeline JSON.' end"""
MISSING_SQL = f"""
select config_id, f as field, {REASON} as reason from fx_merge, (select unnest([{", ".join(f"'{f}'" for f in MISSING_FIXED)}]) as f)
union all select config_id, 'dq_rules', 'Not present in pipeline JSON or not derivable from validation activities.' from s
 where not coalesce(rule = extracted_rule or rule = 'null_check', false)
union all select config_id, 'flow.text', 'Not derivable from activities.' from s where raw_flow is null"""


@query("M10", "final_missing_fields", f"with {SUPPORT} {MISSING_SQL}", MERGE)
def final_missing_fields(spark, sf):
    return cf.missing_fields(core_rows(spark, sf), final_leaves(spark, sf))


SCORE = f"""a as (select config_id, coalesce(rd, xd, ed) as dest, rd, rule = extracted_rule or rule = 'null_check' as has_rule, {FLOW} as flow, raw_flow from s),
sc as (select config_id, dest, case when lower(dest) like '%email%' then rd else dest end as final_dest, coalesce(has_rule, false) as has_rule, flow, raw_flow, rd from a),
score as (select *, round((0.6::double + (case when lower(coalesce(final_dest,'')) like '%email%' then 0.0::double when rd is not null and final_dest is distinct from rd then 0.5::double else 1.0::double end)
 + (case when has_rule then 1.0::double else 0.9::double end) + (case when raw_flow is not null and flow = raw_flow then 1.0::double when flow is not null then 0.7::double else 0.4::double end)) / 4, 2) as score,
 case when raw_flow is null then 'flow missing' when flow <> raw_flow then 'flow differs from raw' else '' end as issues from sc)"""


def scored(spark, sf):
    dest = final_leaves(spark, sf).where("path = 'ingestion_configs.destination'").select(
        "config_id", jw.plain(F.col("value"), F.col("kind")).alias("merged_destination"))
    core = core_rows(spark, sf).join(dest, "config_id", "left")
    final = cf.correct_destination(F.col("merged_destination"), F.col("raw_destination"))
    core = core.withColumn("destination", final)
    return core.withColumn("a", cf.accuracy(
        F.lit(None).cast("string"), F.col("destination"), F.col("raw_destination"), F.col("dq_rules"),
        F.col("supported"), F.col("flow_text"), F.col("raw_flow")))


@query("A05", "accuracy_score", f"with {SUPPORT}, {SCORE} select config_id, score, issues from score", MERGE)
def accuracy_score(spark, sf):
    return scored(spark, sf).select("config_id", "a.score", F.array_join("a.issues", "|").alias("issues"))


def config_documents(spark, sf):
    """What raw evidence, extraction and an example say about every configuration."""
    def section(destination, *more):
        return F.struct(F.col(destination).alias("destination"), *more).alias("ingestion_configs")

    mode = F.col("extracted_mode").alias("mode")
    return fixture(spark, sf, MERGE).select(
        "config_id", "raw_text", F.lit("streaming").alias("ingestion_type"),
        F.to_json(F.struct(section("raw_destination"), F.struct(F.col("raw_flow").alias("text")).alias("flow"))).alias("raw"),
        F.to_json(F.struct(section("extracted_destination", mode), F.array("extracted_rule").alias("dq_rules"))).alias("extracted"),
        F.to_json(F.struct(section("example_destination", F.lit("batch").alias("mode"), F.lit("daily").alias("frequency")),
                           F.array(F.lit("null_check"), F.lit("range_check")).alias("dq_rules"))).alias("example"))


# Fields are missing in the final state: a destination that was only a notification is gone by then.
FINAL_MISSING = f"""{MISSING_SQL}
union all select config_id, 'ingestion_configs.destination', 'Not derivable from activities.' from sc where final_dest is null"""


@query("M12", "finalize_config", f"""
with {SUPPORT}, {SCORE}, mf as (select config_id, count(*) as n from ({FINAL_MISSING}) group by 1)
select score.config_id, final_dest as destination, case when has_rule then s.rule else '' end as dq_rules, flow, mf.n as missing, score
from score join s using (config_id) join mf using (config_id)""", MERGE)
def finalize_config(spark, sf):
    done, _ = cf.finalize(config_documents(spark, sf))
    return done.select("config_id", "destination", F.array_join("dq_rules", "|").alias("dq_rules"), F.col("flow_text").alias("flow"),
                       F.size("missing").cast("bigint").alias("missing"), "score")


FINAL = f"""{SCORE}, q as (select s.config_id, '"' || final_dest || '"' as dest, case when has_rule then '["' || s.rule || '"]' else '[]' end as rules,
 '"' || flow || '"' as flow, '"' || ed || '"' as example from score join s using (config_id)),
core as (select *, '{{' || case when dest is null then '"destination":null' else '"destination":' || dest end || ',"frequency":"daily","mode":"batch"}}' as ing,
 case when dest is null then '' else '"destination":' || dest || ',' end || '"frequency":"daily","mode":"batch"' as live,
 '{{"text":' || coalesce(flow, 'null') || '}}' as ft from q),
mf as (select config_id, '[' || string_agg('{{"field":"' || field || '","reason":"' || reason || '"}}', ',' order by field) || ']' as miss from ({FINAL_MISSING}) group by 1)"""


@query("M12", "finalize_config_document", f"""
with {SUPPORT}, {FINAL}
select config_id, '{{"adf_ingestion_pipeline":{{"pipeline_extracted_ingestion":{{' || live || '}}}},"dq_rules":' || rules
 || case when flow is null then '' else ',"final_definition":' || flow end || ',"flow":' || ft
 || case when rules = '[]' and flow is null then '' else ',"governance_lineage":{{' || concat_ws(',', case when rules <> '[]' then '"data_quality_rules":' || rules end, '"lineage_tracking":' || flow) || '}}' end
 || ',"ingestion_configs":' || ing || ',"ingestion_overview":{{"triggers":{{"streaming":"daily"}}}},"missing_fields_analysis":' || miss
 || ',"pipeline_extracted_overlay":{{"dq_rules":' || rules || ',"flow":' || ft || ',"ingestion_configs":' || ing || ',"missing_fields_analysis":' || miss || '}}'
 || case when dest is null then '' else ',"sink_configuration":{{"storage":' || dest || '}}' end || '}}' as document
from core join mf using (config_id)""", MERGE)
def finalize_config_document(spark, sf):
    done, _ = cf.finalize(config_documents(spark, sf))
    return done.select("config_id", F.to_json("document").alias("document"))


@query("M11", "compose_final_document", f"""
with {MERGED}, core as (select config_id, 'ingestion_configs.destination' as path, '"' || coalesce(now, e) || '"' as value from m
 union all select config_id, 'ingestion_configs.mode', '"batch"' from m union all select config_id, 'ingestion_configs.frequency', '"daily"' from m),
f as (select * from fx_merge)
select config_id, path, value from core
union all select config_id, 'pipeline_extracted_overlay.' || path, value from core
union all select config_id, 'adf_ingestion_pipeline.pipeline_extracted_ingestion.' || path[19:], value from core
union all select config_id, 'sink_configuration.storage', case when extracted_mode is null then (select c.value from core c where c.config_id = f.config_id and c.path like '%destination') else '"kept"' end from f
union all select config_id, 'ingestion_overview.triggers.streaming', '"daily"' from f
union all select config_id, 'title', '"' || example_destination || '"' from f""", MERGE)
def compose_final_document(spark, sf):
    m = fixture(spark, sf, MERGE)
    doc = F.to_json(F.struct(
        F.struct(F.lit("old").alias("destination")).alias("ingestion_configs"), F.col("example_destination").alias("title"),
        F.struct(F.when(F.col("extracted_mode").isNull(), "").otherwise("kept").alias("storage")).alias("sink_configuration")))
    example = cf.leaves(m.select("config_id", doc.alias("doc")), "doc")
    return cf.compose_final(example, final_leaves(spark, sf)).select("config_id", "path", "value")


@query("M11", "final_nested_document", f"""
with {MERGED}, c as (select config_id, '"' || coalesce(now, e) || '"' as dest, case when mode is null then '"' || coalesce(now, e) || '"' else '"kept"' end as store, e from m),
k as (select *, '{{"destination":' || dest || ',"frequency":"daily","mode":"batch"}}' as ing from c)
select config_id, '{{"adf_ingestion_pipeline":{{"pipeline_extracted_ingestion":' || ing || '}},"ingestion_configs":' || ing || ',"ingestion_overview":{{"triggers":{{"streaming":"daily"}}}},"pipeline_extracted_overlay":{{"ingestion_configs":'
 || ing || '}},"sink_configuration":{{"storage":' || store || '}},"steps":[{{"kind":"load","of":[1,{{"x":null}}]}},[],{{}}],"title":"' || e || '"}}' as document from k""", MERGE)
def final_nested_document(spark, sf):
    m = fixture(spark, sf, MERGE)
    doc = F.concat(
        F.lit('{"ingestion_configs":{"destination":"old"},"steps":[{"kind":"load","of":[1,{"x":null}]},[],{}],"title":"'), "example_destination",
        F.lit('","sink_configuration":{"storage":"'), F.when(F.col("extracted_mode").isNull(), "").otherwise("kept"), F.lit('"}}'))
    example = cf.leaves(m.select("config_id", doc.alias("doc")), "doc")
    return ds.assemble(cf.compose_final(example, final_leaves(spark, sf)), ["config_id"]).select("config_id", F.to_json("document").alias("document"))
