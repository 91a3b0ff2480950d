"""Lineage queries over the edge and entity fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.functions import text as tx
from metasift.operators import lineage as ln
from metasift.operators import payload as pl
from metasift.plans.catalog import fixture, query, table

EDGE = "fx_edge"
KIND = """case when {c} like 'urn:li:dataJob:%' then 'dataJob' when {c} like 'urn:li:dataFlow:%' then 'dataFlow' else 'dataset' end"""
PLATFORM = """case when {c} like 'urn:li:dataset:(%' then split_part(split_part({c},'dataPlatform:',2),',',1)
 when {c} like '%dataFlow:(%' then split_part(split_part({c},'dataFlow:(',2),',',1) else 'unknown' end"""
NODES = f"""n as (select distinct urn, {KIND.format(c='urn')} as node_type, {PLATFORM.format(c='urn')} as platform
 from (select source_urn as urn from fx_edge union all select target_urn from fx_edge))"""


@query("F04", "urn_node_type", f"with {NODES} select urn, node_type from n", EDGE)
def urn_node_type(spark, sf):
    return ln.nodes_of(fixture(spark, sf, EDGE)).select("urn", "node_type")


@query("F05", "urn_platform", f"with {NODES} select urn, platform from n", EDGE)
def urn_platform(spark, sf):
    return ln.nodes_of(fixture(spark, sf, EDGE)).select("urn", "platform")


@query("J05", "lineage_upstream", f"""
with {NODES} select e.target_urn as urn, e.edge_type, e.source_urn as upstream_urn, n.node_type, n.platform
from fx_edge e join n on n.urn = e.source_urn where n.platform <> 'glue'""", EDGE)
def lineage_upstream(spark, sf):
    e = fixture(spark, sf, EDGE)
    return ln.upstream(e, ln.nodes_of(e).where("platform <> 'glue'"))


@query("J06", "lineage_downstream", f"""
with {NODES} select e.source_urn as urn, e.edge_type, e.target_urn as downstream_urn, n.node_type, n.platform
from fx_edge e join n on n.urn = e.target_urn""", EDGE)
def lineage_downstream(spark, sf):
    e = fixture(spark, sf, EDGE)
    return ln.downstream(e, ln.nodes_of(e))


@query("J07", "impact_closure", """
with recursive e as (select distinct source_urn, target_urn from fx_edge),
walk(urn, hops) as (
 select distinct source_urn, 0 from e where source_urn like '%dataPlatform:s3,%'
 union select e.target_urn, walk.hops + 1 from walk join e on e.source_urn = walk.urn)
select 's3' as seed, urn, min(hops)::int as hops from walk where hops > 0 group by 2""", EDGE)
def impact_closure(spark, sf):
    e = fixture(spark, sf, EDGE)
    seeds = e.where("source_urn like '%dataPlatform:s3,%'").select(F.lit("s3").alias("seed"),
                                                                  F.col("source_urn").alias("urn"))
    return ln.impact_closure(e, seeds)


@query("J08", "flow_members", """
select target_urn as flow_urn, source_urn as job_urn from fx_edge where edge_type = 'IsPartOf'""", EDGE)
def flow_members(spark, sf):
    return ln.flow_members(fixture(spark, sf, EDGE))


RELATED_SQL = """
with d as (select distinct urn, case when urn like '%dataJob%' then 'UPSTREAM' else 'DOWNSTREAM' end as direction
 from (select source_urn as urn from fx_edge union all select target_urn from fx_edge))
select d.urn, d.direction, e.source_urn as related_urn from fx_edge e join d on d.urn = e.target_urn and d.direction = 'UPSTREAM' where e.edge_type = 'DownstreamOf'
union all select d.urn, d.direction, e.target_urn from fx_edge e join d on d.urn = e.source_urn and d.direction = 'DOWNSTREAM' where e.edge_type = 'DownstreamOf'"""


@query("J09", "lineage_by_type_direction", RELATED_SQL, EDGE)
def lineage_by_type_direction(spark, sf):
    e = fixture(spark, sf, EDGE)
    d = ln.nodes_of(e).select("urn", F.when(F.col("urn").contains("dataJob"), "UPSTREAM").otherwise("DOWNSTREAM")
                              .alias("direction"))
    return ln.related(e, d)


LINEAGE = """l as (select target_urn as seed_urn, case when edge_type = 'IsPartOf' then '' else source_urn end as related_urn,
 case when source_urn like '%s3%' then null else edge_type end as type from fx_edge)"""


@query("J10", "graph_from_lineage", f"""
with {LINEAGE}, ends as (select distinct seed_urn, seed_urn as urn from l union select seed_urn, related_urn from l where related_urn <> '')
select 'node' as part, seed_urn, urn as a, {KIND.format(c='urn')} as b, {PLATFORM.format(c='urn')} as c from ends
union all select distinct 'edge', seed_urn, related_urn, seed_urn, coalesce(type,'DownstreamOf') from l where related_urn <> ''""", EDGE)
def graph_from_lineage(spark, sf):
    lineage = fixture(spark, sf, EDGE).selectExpr(
        "target_urn as seed_urn", "if(edge_type = 'IsPartOf', '', source_urn) as related_urn",
        "if(source_urn like '%s3%', null, edge_type) as type")
    nodes, edges = ln.graph_from_lineage(lineage)
    return nodes.select(F.lit("node").alias("part"), "seed_urn", F.col("urn").alias("a"),
                        F.col("node_type").alias("b"), F.col("platform").alias("c")).unionByName(
        edges.select(F.lit("edge").alias("part"), "seed_urn", F.col("source_urn").alias("a"),
                     F.col("target_urn").alias("b"), F.col("edge_type").alias("c")))


SEARCH = """terms as (select distinct lower(trim(s)) as term from (select unnest(string_split(p_name, ' ')) as s from part)),
hits as (select t.term, e.type, e.urn, row_number() over (partition by t.term, e.type order by e.urn) as rn
 from terms t join fx_entity e on contains(lower(e.name), t.term))"""


@query("J11", "entity_search", f"with {SEARCH} select term, type, urn, rn::int as rn from hits", "fx_entity")
def entity_search(spark, sf):
    terms = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return ln.entity_search(terms, fixture(spark, sf, "fx_entity")).select("term", "type", "urn", "rn")


@query("J12", "enrich_entities", f"""
with pt as (select p_partkey as payload_id, term, pos from (
  select p_partkey, lower(unnest(s)) as term, generate_subscripts(s, 1) as pos from (select p_partkey, string_split(p_name,' ') as s from part)) where term is not null),
{SEARCH}, h as (select * from hits),
two as (select term, urn from (select term, urn, row_number() over (partition by term order by type, rn) as k from h) where k <= 2),
ent as (select distinct payload_id, urn from pt join h using (term)),
edges as (select distinct e.urn as target_urn, x.source_urn, 'DownstreamOf' as edge_type from fx_entity e join (select entity_id, urn as source_urn from fx_entity) x on x.entity_id = e.entity_id + 1),
up as (select distinct pt.payload_id, two.urn, e.source_urn from pt join two using (term) join edges e on e.target_urn = two.urn)
select 'entity' as part, payload_id, urn, null as upstream_urn from ent union all select 'lineage', payload_id, urn, source_urn from up""",
       "fx_entity")
def enrich_entities(spark, sf):
    ents = fixture(spark, sf, "fx_entity")
    pt = table(spark, sf, "part").select(
        F.col("p_partkey").alias("payload_id"), F.posexplode(F.split("p_name", " ")).alias("pos", "term"))
    nxt = ents.select((F.col("entity_id") - 1).alias("entity_id"), F.col("urn").alias("source_urn"))
    edges = ents.select("entity_id", F.col("urn").alias("target_urn")).join(nxt, "entity_id").select(
        "source_urn", "target_urn", F.lit("DownstreamOf").alias("edge_type"))
    found, up = ln.enrich_entities(pt, ents, edges)
    return found.select(F.lit("entity").alias("part"), "payload_id", "urn",
                        F.lit(None).cast("string").alias("upstream_urn")).unionByName(
        up.select(F.lit("lineage").alias("part"), "payload_id", "urn", "upstream_urn"))


@query("W01", "first_write_wins", """
select source_urn, target_urn, edge_type, min(seq) as seq, count(*) > 1 as had_copies from (
 select e.*, length(source_urn) * 1000 + length(target_urn) as seq from fx_edge e) group by 1, 2, 3""", EDGE)
def first_write_wins(spark, sf):
    e = fixture(spark, sf, EDGE).withColumn("seq", (F.length("source_urn") * 1000 + F.length("target_urn")).cast("bigint"))
    keys = ["source_urn", "target_urn", "edge_type"]
    once = ln.first_write_wins(e, keys, "seq")
    copies = e.groupBy(*keys).agg((F.count("*") > 1).alias("had_copies"))
    return once.join(copies, keys)


@query("W03", "first_n_per_group", """
select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, rn::int as rn from (
 select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rn
 from lineitem) where rn <= 10""")
def first_n_per_group(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return ln.first_n(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 10)


@query("A07", "ordered_distinct", """
select l_suppkey, l_returnflag, min(struct_pack(a := l_orderkey, b := l_linenumber)).a as first_order from lineitem group by 1, 2""")
def ordered_distinct(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return ln.first_write_wins(li, ["l_suppkey", "l_returnflag"], "seq").select(
        "l_suppkey", "l_returnflag", F.col("seq.l_orderkey").alias("first_order"))


ASPECT_VALUES = ", ".join(f"({i}, '{a}')" for i, a in enumerate(rules.ASPECTS))


@query("C29", "aspect_pivot", f"""
with a as (select urn, m.aspect, type || ':' || job_type as value from fx_entity join (values {ASPECT_VALUES}) m(i, aspect) on entity_id % 5 <> m.i)
select urn, {", ".join(f'max(value) filter (aspect = {chr(39)}{a}{chr(39)}) as "{a}"' for a in rules.ASPECTS)} from a group by 1""", "fx_entity")
def aspect_pivot(spark, sf):
    names = F.array(*[F.lit(a) for a in rules.ASPECTS])
    a = fixture(spark, sf, "fx_entity").select("urn", "entity_id", F.posexplode(names).alias("i", "aspect"),
                                               F.concat("type", F.lit(":"), "job_type").alias("value"))
    return ln.aspect_pivot(a.where("entity_id % 5 <> i").select("urn", "aspect", "value"))


@query("S14", "emit_graph_document", """
with d as (select distinct regexp_extract(source_urn || target_urn, 'flow_([0-9]+)', 1) as graph_id, source_urn, target_urn, edge_type,
 cast(regexp_extract(source_urn || target_urn, 'order_([0-9]+)', 1) as bigint) as seq from fx_edge)
select graph_id, '{"edges":[' || string_agg('{"source_urn":"' || source_urn || '","target_urn":"' || target_urn || '","edge_type":"' || edge_type || '"}', ',' order by rn) || ']}' as doc
from (select *, row_number() over (partition by graph_id order by seq, source_urn, target_urn, edge_type) as rn from d) group by 1""", EDGE)
def emit_graph_document(spark, sf):
    both = F.concat("source_urn", "target_urn")
    e = fixture(spark, sf, EDGE).distinct().select(
        F.regexp_extract(both, r"flow_(\d+)", 1).alias("graph_id"), "source_urn", "target_urn", "edge_type",
        F.regexp_extract(both, r"order_(\d+)", 1).cast("bigint").alias("seq"))
    return ln.graph_documents(e, "graph_id", "seq")
