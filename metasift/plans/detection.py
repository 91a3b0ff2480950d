"""Detection queries; oracle texts are generated from the same fixed vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.operators import detect as dt
from metasift.operators import jsonwalk as jw
from metasift.operators import payload as pl
from metasift.operators import rule_index as ri
from metasift.plans.catalog import fixture, query, table

PAYLOAD = "fx_payload"
TXT = "t as (select payload_id, lower(metadata || ' ' || config || ' ' || raw_json) as txt, raw_json, metadata from fx_payload)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_values(rule_list, base: int = 0) -> str:
    """(rule_order, label, pattern_no, pattern) rows."""
    rows = []
    for i, (label, patterns) in enumerate(rule_list):
        rows += [f"({base + i}, {q(label)}, {n}, {q(p)})" for n, p in enumerate(patterns)]
    return ", ".join(rows)


def hits_sql(rule_list, lead: str, base: int = 0, source: str = "t", key: str = "payload_id", txt: str = "txt") -> str:
    return f"""(select {key}, rule_order, label, {q(lead + " '")} || arg_min(pattern, n) || '''' || ' → ' || label as evidence
 from {source}, (values {rule_values(rule_list, base)}) r(rule_order, label, n, pattern)
 where regexp_matches({txt}, '(?i)' || pattern) group by {key}, rule_order, label)"""


def detect_query(ident, key, category, rule_list, lead):
    oracle = f"with {TXT} select payload_id, label, evidence from {hits_sql(rule_list, lead)}"

    @query(ident, key, oracle, PAYLOAD)
    def run(spark, sf):
        return dt.detect_text(fixture(spark, sf, PAYLOAD), category).select("payload_id", "label", "evidence")


detect_query("D01", "detect_framework", "framework", rules.FRAMEWORK_RULES, "pattern match")
detect_query("D04", "detect_source", "source", rules.SOURCE_RULES, "source pattern")
detect_query("D06", "detect_ingestion", "ingestion", rules.INGESTION_RULES, "ingestion pattern")

ENTITY_PLATFORM = """case when urn like '%dataPlatform:%' then
 trim(split_part(split_part(urn,'dataPlatform:',2),',',1), ')') else urn end"""
PLATFORM_VALUES = ", ".join(f"({q(k)},{q(v)})" for k, v in rules.PLATFORM_LABELS.items())
JOB_VALUES = ", ".join(f"({q(k)},{q(v)})" for k, v in rules.JOB_TYPE_LABELS.items())


@query("D02", "enrich_entity_platform", f"""
select e.entity_id, m.label from fx_entity e join (values {PLATFORM_VALUES}) m(platform, label)
 on lower({ENTITY_PLATFORM}) = m.platform""", "fx_entity")
def enrich_entity_platform(spark, sf):
    return fixture(spark, sf, "fx_entity").select("entity_id", dt.entity_framework(F.col("urn")).alias("label")).where(
        "label is not null")


COMBO_SQL = " union all ".join(
    f"select payload_id, {q(label)} as label from found where list_has_all(labels, [{', '.join(map(q, need))}])"
    for need, label in rules.COMBINATION_RULES)


@query("D03", "combination_labels", f"""
with {TXT}, h as (select * from {hits_sql(rules.FRAMEWORK_RULES, 'pattern match')}),
found as (select payload_id, list(label) as labels from h group by 1) {COMBO_SQL}""", PAYLOAD)
def combination_labels(spark, sf):
    hits = dt.detect_text(fixture(spark, sf, PAYLOAD), "framework")
    return dt.with_combinations(hits).where("rule_order >= 1000").select("payload_id", "label")


UPSTREAM_CASE = "case " + " ".join(f"when contains(lower(source_urn), {q(p)}) then {q(v)}"
                                   for p, v in rules.UPSTREAM_LABELS) + " end"


@query("D05", "classify_upstream_urn", f"""
select target_urn, {UPSTREAM_CASE} as label, count(*) as n from fx_edge where {UPSTREAM_CASE} is not null group by 1, 2""",
       "fx_edge")
def classify_upstream_urn(spark, sf):
    e = fixture(spark, sf, "fx_edge").withColumn("label", dt.classify_upstream(F.col("source_urn")))
    return e.where("label is not null").groupBy("target_urn", "label").agg(F.count("*").alias("n"))


@query("D07", "entity_job_type", f"""
select e.entity_id, m.label from fx_entity e join (values {JOB_VALUES}) m(jt, label) on e.job_type = m.jt
where e.type in ('dataJob','dataFlow','DATA_JOB','DATA_FLOW')""", "fx_entity")
def entity_job_type(spark, sf):
    e = fixture(spark, sf, "fx_entity")
    return e.select("entity_id", dt.entity_job_label(F.col("type"), F.col("job_type")).alias("label")).where(
        "label is not null")


@query("D08", "entity_name_fallback", f"""
select entity_id, label from {hits_sql(rules.INGESTION_RULES, 'x', 0, 'fx_entity', 'entity_id, type', 'name')} h
where type in ('dataJob','dataFlow','DATA_JOB','DATA_FLOW')""", "fx_entity")
def entity_name_fallback(spark, sf):
    return dt.entity_name_hits(fixture(spark, sf, "fx_entity")).select("entity_id", "label")


@query("D09", "detect_ge_suite", """
select payload_id, 'Great Expectations Suite: ' || json_extract_string(raw_json,'$.suite_name') as label from fx_expectation
union all
select payload_id + 1000000000, null from fx_payload""", ("fx_expectation", PAYLOAD))
def detect_ge_suite(spark, sf):
    e = fixture(spark, sf, "fx_expectation")
    p = fixture(spark, sf, PAYLOAD).select((F.col("payload_id") + 1000000000).alias("payload_id"), "raw_json")
    both = e.unionByName(p).withColumn("txt", F.lower("raw_json"))
    return both.select("payload_id", F.try_element_at(dt.suite_hit("txt", "raw_json"), F.lit(1))["label"]
                       .alias("label"))


EXP_CASE = "case json_extract_string(raw_json,'$.dq.expectations[0].expectation_type') " + " ".join(
    f"when {q(k)} then {q(v)}" for k, v in rules.EXPECTATION_LABELS.items()
) + " else 'GE: ' || json_extract_string(raw_json,'$.dq.expectations[0].expectation_type') end"


@query("D10", "scan_ge_expectations", f"select payload_id, {EXP_CASE} as label from fx_expectation", "fx_expectation")
def scan_ge_expectations(spark, sf):
    return dt.scan_expectations(fixture(spark, sf, "fx_expectation")).select("payload_id", "label")


def dq_rule_query(ident, key, rule_list, lead, base):
    oracle = f"with {TXT} select payload_id, label from {hits_sql(rule_list, lead, base)}"

    @query(ident, key, oracle, PAYLOAD)
    def run(spark, sf):
        p = pl.with_text(fixture(spark, sf, PAYLOAD))
        return p.select("payload_id", F.explode(dt.rule_hits("txt", rule_list, lead, base)).alias("h")).select(
            "payload_id", "h.label")


dq_rule_query("D11", "detect_sql_dq", rules.SQL_CHECK_RULES, "SQL DQ pattern", 200)
dq_rule_query("D12", "detect_dq_tools", rules.DQ_TOOL_RULES, "custom DQ pattern", 300)


@query("D13", "detect_assertion_entities", """
select entity_id, case when job_type <> 'Other' then 'DataHub Assertion: ' || job_type else 'DataHub Assertion' end as label
from fx_entity where type in ('assertion','ASSERTION')""", "fx_entity")
def detect_assertion_entities(spark, sf):
    e = fixture(spark, sf, "fx_entity")
    kind = F.when(F.col("job_type") != "Other", F.col("job_type"))
    return e.select("entity_id", dt.assertion_label(F.col("type"), kind).alias("label")).where("label is not null")


DQ_UNION = f"""(select * from {hits_sql(rules.SQL_CHECK_RULES, 'SQL DQ pattern', 200)}
 union all select * from {hits_sql(rules.DQ_TOOL_RULES, 'custom DQ pattern', 300)})"""
ALL_HITS = f"""h as (
 select 'framework' as category, * from {hits_sql(rules.FRAMEWORK_RULES, 'pattern match')}
 union all select 'source', * from {hits_sql(rules.SOURCE_RULES, 'source pattern')}
 union all select 'ingestion', * from {hits_sql(rules.INGESTION_RULES, 'ingestion pattern')}
 union all select 'dq_rules', * from {DQ_UNION}),
found as (select payload_id, list(label) as labels from h where category = 'framework' group by 1),
combo as ({COMBO_SQL}),
every as (select payload_id, category, rule_order, label, evidence from h
 union all select c.payload_id, 'framework', 1000 + r.o, c.label, '' from combo c
  join (values {", ".join(f"({i}, {q(label)})" for i, (_, label) in enumerate(rules.COMBINATION_RULES))}) r(o, label) using (label))"""


def cat(c: str, value: str = "label") -> str:
    return f"coalesce(string_agg({value}, ' | ' order by rule_order) filter (category = {q(c)}), '')"


@query("D14", "detection_confidence", f"""
with {TXT}, {ALL_HITS}, n as (select payload_id, {", ".join(f"count(*) filter (category = {q(c)}) as {c}" for c in dt.CATEGORIES)}
 from every group by 1)
select t.payload_id, {", ".join(f"case when coalesce(n.{c},0) > 0 then {v}::double else 0.0::double end as {c}" for c, v in rules.CATEGORY_CONFIDENCE.items())}
from t left join n using (payload_id)""", PAYLOAD)
def detection_confidence(spark, sf):
    return dt.confidence(dt.analyze(fixture(spark, sf, PAYLOAD)))


@query("D15", "merge_detection_results", f"""
with {TXT}, f as (select * from {hits_sql(rules.FRAMEWORK_RULES, 'x')}), i as (select * from {hits_sql(rules.INGESTION_RULES, 'x')}),
u as (select payload_id, label, rule_order as seq, 0.95::double as confidence from f
 union all select payload_id, label, rule_order + 100, 0.9::double from f union all select payload_id, label, rule_order + 200, 0.85::double from i),
tot as (select payload_id, min(confidence) as confidence, count(*) as evidence_count from u group by 1)
select payload_id, label, min(seq)::int as seq, any_value(tot.confidence) as confidence, any_value(evidence_count) as evidence_count
from u join tot using (payload_id) group by 1, 2""", PAYLOAD)
def merge_detection_results(spark, sf):
    p = fixture(spark, sf, PAYLOAD)
    f, i = dt.detect_text(p, "framework"), dt.detect_text(p, "ingestion")
    one = f.select("payload_id", "label", F.col("rule_order").alias("seq"), F.lit(0.95).alias("confidence"))
    two = f.select("payload_id", "label", (F.col("rule_order") + 100).alias("seq"), F.lit(0.9).alias("confidence"))
    three = i.select("payload_id", "label", (F.col("rule_order") + 200).alias("seq"), F.lit(0.85).alias("confidence"))
    return dt.merge_results(one.unionByName(two).unionByName(three), "payload_id")


@query("D16", "analyze_payloads", f"""
with {TXT}, {ALL_HITS}
select t.payload_id, {", ".join(f"{cat(c)} as {c}" for c in dt.CATEGORIES)},
 {cat('source', 'evidence')} as source_evidence
from t left join every using (payload_id) group by 1""", PAYLOAD)
def analyze_payloads(spark, sf):
    a = dt.analyze(fixture(spark, sf, PAYLOAD))
    return a.select("payload_id", *[F.array_join(c, " | ").alias(c) for c in dt.CATEGORIES],
                    F.array_join("source_evidence", " | ").alias("source_evidence"))


@query("D17", "override_categories", f"""
with {TXT}, h as (select * from {hits_sql(rules.SOURCE_RULES, 'x')}),
l as (select payload_id, string_agg(label, ' | ' order by rule_order) as labels from h group by 1)
select t.payload_id, case when json_extract_string(metadata,'$.platform') = 'custom' then 'Microsoft Fabric | S3'
 else coalesce(l.labels, '') end as source from t left join l using (payload_id)""", PAYLOAD)
def override_categories(spark, sf):
    p = fixture(spark, sf, PAYLOAD)
    o = p.where(F.get_json_object("metadata", "$.platform") == "custom").select(
        "payload_id", F.array(F.lit("Microsoft Fabric"), F.lit("S3")).alias("labels"))
    out = dt.override_category(dt.analyze(p), o, "source")
    return out.select("payload_id", F.array_join("source", " | ").alias("source"))


@query("U05", "label_union", f"""
with {TXT} select distinct payload_id, label from (
 select payload_id, label from {hits_sql(rules.FRAMEWORK_RULES, 'x')} union all select payload_id, label from {hits_sql(rules.SOURCE_RULES, 'x')}
 union all select payload_id, label from {hits_sql(rules.INGESTION_RULES, 'x')} union all select payload_id, label from {DQ_UNION})""",
       PAYLOAD)
def label_union(spark, sf):
    return dt.detect_all(fixture(spark, sf, PAYLOAD)).select("payload_id", "label").distinct()


@query("A09", "category_overview", f"""
with {TXT}, {ALL_HITS}, l as (select category, label, count(distinct payload_id) as n from h group by 1, 2)
select category, count(*) as labels, sum(n)::bigint as hits,
 case when count(*) > 10 then 'High' when count(*) > 5 then 'Medium' else 'Low' end as complexity from l group by 1""", PAYLOAD)
def category_overview(spark, sf):
    return dt.category_overview(dt.detect_all(fixture(spark, sf, PAYLOAD)))


@query("X01", "register_detector", f"""
with {TXT} select payload_id, 'source' as category, label from {hits_sql(rules.SOURCE_RULES, 'x')}
union all select payload_id, 'team', 'Job ' || split_part(json_extract_string(metadata,'$.name'),'_',2) from t""", PAYLOAD)
def register_detector(spark, sf):
    reg = dt.default_registry()
    for name in ("framework_detector", "ingestion_detector", "dq_rules_detector"):
        reg.unregister(name)
    reg.register("team_detector", lambda p: p.select(
        "payload_id", F.lit("team").alias("category"), F.lit(0).alias("rule_order"),
        F.concat(F.lit("Job "), F.split(F.get_json_object("metadata", "$.name"), "_")[1]).alias("label"),
        F.lit("name").alias("evidence")))
    return reg.run(fixture(spark, sf, PAYLOAD)).select("payload_id", "category", "label")


USER_RULES = [("zone", "Landing", r"landing-\d"), ("zone", "Raw", r"raw@"), ("zone", "Raw", r"lake-[0-3]"),
              ("kind", "Checked", r"select .* from")]
USER_SQL = [(c, label, [p for cc, ll, p in USER_RULES if (cc, ll) == (c, label)])
            for c, label in dict.fromkeys((c, x) for c, x, _ in USER_RULES)]


@query("X02", "custom_rule_detector", f"with {TXT} " + " union all ".join(
    f"select payload_id, {q(c)} as category, {q(label)} as label from t where " +
    " or ".join(f"regexp_matches(txt, {q(p)})" for p in ps) for c, label, ps in USER_SQL), PAYLOAD)
def custom_rule_detector(spark, sf):
    return dt.custom_rule_detector(USER_RULES)(fixture(spark, sf, PAYLOAD)).select("payload_id", "category", "label")


@query("X02", "custom_rules_indexed", f"""
with {TXT}, c as (select distinct payload_id, 'job' as category, 'J' || c_custkey as label from t join customer on cast(regexp_extract(txt, '"job_([0-9]+)"', 1) as bigint) = c_custkey)
select * from c union all select distinct payload_id, 'zone', 'Z' || (n_nationkey % 9) from t join nation on regexp_matches(txt, '[a-z]+-' || (n_nationkey % 9) || '/orders')
union all select payload_id, 'store', 'S' || r_regionkey from t join region on regexp_matches(txt, '(?:lake|landing)-' || r_regionkey)""", PAYLOAD)
def custom_rules_indexed(spark, sf):
    """As many rules as there are customers, and some more."""
    parts = [
        table(spark, sf, "customer").select(F.lit("job").alias("category"), F.concat(F.lit("J"), "c_custkey").alias("label"),
                                            F.concat(F.lit('"job_'), "c_custkey", F.lit('"')).alias("pattern"), F.col("c_custkey").cast("long").alias("rule_order")),
        table(spark, sf, "nation").select(F.lit("zone"), F.concat(F.lit("Z"), F.col("n_nationkey") % 9), F.concat(F.lit("[a-z]+-"), F.col("n_nationkey") % 9, F.lit("/orders")),
                                          -1 - F.col("n_nationkey").cast("long")),
        table(spark, sf, "region").select(F.lit("store"), F.concat(F.lit("S"), "r_regionkey"), F.concat(F.lit("(?:lake|landing)-"), "r_regionkey"), -1000 - F.col("r_regionkey").cast("long")),
    ]
    return ri.detect_rules(fixture(spark, sf, PAYLOAD), parts[0].union(parts[1]).union(parts[2])).select("payload_id", "category", "label")


@query("R14", "detect_report_dq_rules", """
with r as (select payload_id, lower(raw_json) as t, json_extract_string(raw_json,'$.dq.expectations[0].expectation_type') as e,
 json_extract_string(raw_json,'$.dq.expectations[0].kwargs.column') as c from fx_expectation
 union all select payload_id + 1000000000, lower(metadata || ' ' || config || ' ' || raw_json), null, null from fx_payload)
select distinct payload_id, case e when 'expect_column_values_to_not_be_null' then 'null_check:' || c
 when 'expect_column_values_to_be_unique' then 'uniqueness_check:' || c when 'expect_column_values_to_be_between' then 'range_check:' || c end as rule
 from r where e in ('expect_column_values_to_not_be_null','expect_column_values_to_be_unique','expect_column_values_to_be_between')
union select payload_id, rule from r, (values """ + ", ".join(f"({q(p)},{q(r)})" for p, r in rules.PHRASE_RULES) + """) p(phrase, rule)
 where contains(t, phrase)""", ("fx_expectation", PAYLOAD))
def detect_report_dq_rules(spark, sf):
    from metasift.operators.activities import detect_dq_rules

    e = fixture(spark, sf, "fx_expectation").withColumn("txt", F.lower("raw_json"))
    p = pl.with_text(fixture(spark, sf, PAYLOAD)).withColumn("payload_id", F.col("payload_id") + 1000000000)
    both = e.select("payload_id", "raw_json", "txt").unionByName(p.select("payload_id", "raw_json", "txt"))
    return detect_dq_rules(both).select("payload_id", "rule")
