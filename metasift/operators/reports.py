"""Operators over pipeline reports: lookup, union, projection, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.functions import text as tx
from metasift.operators.activities import P, member, signatures, variant_text
from metasift.operators.jsonwalk import is_missing


def last_copy_source(acts: DataFrame) -> DataFrame:
    """Dataset and source type of the last Copy activity."""
    copies = acts.where("type = 'Copy'").select(P, "idx", member(F.col("src"), "referenceName", "path").alias("dataset"),
                                                F.coalesce(member(F.col("src"), "type"), F.lit("Unknown")).alias("source_type"))
    return copies.groupBy(P).agg(F.max_by(F.struct("dataset", "source_type"), "idx").alias("s")).select(P, "s.*")


def dq_activities(acts: DataFrame) -> DataFrame:
    """Activities whose name speaks of data quality."""
    return acts.where(F.lower("name").rlike(rules.DQ_ACTIVITY_WORDS)).select(P, "idx", "name", "type")


def linear_chain(steps: DataFrame, key: str) -> DataFrame:
    """Edges source_1 -> step_1 -> ... -> sink_1 of ``steps(key, pos)`` (W05); no window, no join."""
    step = lambda n: F.concat(F.lit("step_"), n.cast("string"))
    inner = steps.select(key, F.col("pos").alias("seq"),
                         F.when(F.col("pos") == 1, "source_1").otherwise(step(F.col("pos") - 1)).alias("from_id"), step(F.col("pos")).alias("to_id"))
    last = steps.groupBy(key).agg(F.max("pos").alias("n")).select(
        key, (F.col("n") + 1).alias("seq"), step(F.col("n")).alias("from_id"), F.lit("sink_1").alias("to_id"))
    return inner.unionByName(last)


def node_report_lookup(ids: DataFrame, reports: DataFrame) -> DataFrame:
    """First report whose name or a node matches each id after normalisation."""
    keys = reports.select("report_id", F.explode(F.array("pipeline_name", "node_id")).alias("k")).select(
        tx.lookup_key(F.col("k")).alias("key"), "report_id")
    first = keys.groupBy("key").agg(F.min("report_id").alias("report_id"))
    return ids.withColumn("key", tx.lookup_key(F.col("id"))).join(first, "key", "left").select("id", "report_id")


def scoped_nodes(nodes: DataFrame) -> DataFrame:
    """All report nodes in one graph, ids ``platform:name:local``, first holder wins."""
    t = F.lower("node_type")
    role = F.when(t == "source", "source").when(t.isin("destination", "sink"), "storage").otherwise("compute")
    config = (F.when(t == "source", "source_configs").when(t.isin("destination", "sink"), "destination")
              .when(t == "validation", "dq_rules").otherwise("ingestion_configs"))
    rows = nodes.select(F.concat_ws(":", F.coalesce("platform", F.lit("pipeline")), "pipeline_name", "node_id").alias("scoped_id"),
                        "seq", role.alias("role"), config.alias("config"))
    return rows.groupBy("scoped_id").agg(F.min_by(F.struct("role", "config"), "seq").alias("r")).select("scoped_id", "r.*")


def scoped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct scoped edges whose two ends are known nodes."""
    scope = lambda c: F.concat_ws(":", F.coalesce("platform", F.lit("pipeline")), "pipeline_name", c)
    e = edges.select(scope("from_id").alias("from_id"), scope("to_id").alias("to_id")).distinct()
    n = nodes.select("scoped_id")
    return (e.join(n.withColumnRenamed("scoped_id", "from_id"), "from_id", "left_semi")
            .join(n.withColumnRenamed("scoped_id", "to_id"), "to_id", "left_semi"))


def bipartite_edges(pipes: DataFrame) -> DataFrame:
    """Drawn edges of each pipeline's member lists."""
    mid = F.when(F.size("ingestion") > 0, F.col("ingestion")).otherwise(F.col("framework"))
    left = pipes.select("pipe_id", F.explode("source").alias("a"), mid.alias("m")).select("pipe_id", "a", F.explode("m").alias("b"))
    right = pipes.select("pipe_id", F.explode("ingestion").alias("a"), "framework").select("pipe_id", "a", F.explode("framework").alias("b"))
    return left.unionByName(right).distinct()


def report_labels(reports: DataFrame) -> DataFrame:
    """Label rows the reports offer per category."""
    pairs = F.array_compact(F.array(
        F.when(F.col("platform").isNotNull(), F.struct(F.lit("framework").alias("category"), F.col("platform").alias("label"))),
        F.when(F.col("dq_rule").isNotNull(), F.struct(F.lit("dq_rules").alias("category"), F.col("dq_rule").alias("label")))))
    return reports.select("report_id", F.explode(pairs).alias("p")).select("report_id", "p.*").distinct()


def merge_with_reports(analysis: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """Analysis labels where a category has any, else the reports' (J17)."""
    have = analysis.select(key, "category").distinct()
    return analysis.select(key, "category", "label").unionByName(offered.join(have, [key, "category"], "left_anti").select(key, "category", "label"))


def report_dedup(nodes: DataFrame, key: str) -> DataFrame:
    """First report per platform, name and exact graph."""
    parts = nodes.select(key, F.lit("n").alias("kind"), F.to_json(F.struct("node_id", "node_type")).alias("value")).unionByName(
        nodes.select(key, F.lit("p").alias("kind"), F.to_json(F.struct("platform", "pipeline_name")).alias("value")).distinct())
    return signatures(parts, key).groupBy("sig").agg(F.min(key).alias(key), F.count("*").alias("copies")).select(key, "copies")


def bridge_projection(reports: DataFrame) -> DataFrame:
    """Pipeline reports with a reformatted block, flattened for the configuration tool."""
    v = F.try_parse_json("reformatted")
    flow = F.try_variant_get(v, "$.flow", "variant")

    def section(*names: str):
        got = [F.to_json(F.try_variant_get(v, f"$.{n}", "variant")) for n in names]
        return F.coalesce(*[F.when(~is_missing(g), g) for g in got])

    live = F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) > 0
    return reports.where((F.col("type") == "DataPipeline") & live).select(
        "report_id",
        F.coalesce(tx.first_nonblank(F.col("pipeline_name"), F.col("name"), variant_text(v, "pipeline_name")), F.lit("unknown")).alias("pipeline_name"),
        F.coalesce("platform", variant_text(v, "platform")).alias("platform"),
        F.coalesce(variant_text(flow, "text"), F.when(F.schema_of_variant(flow) == "STRING", F.try_variant_get(flow, "$", "string"))).alias("flow"),
        section("source_configs", "source_config").alias("source_config"), section("ingestion_configs", "ingestion_config").alias("ingestion_config"),
        F.coalesce(section("dq_rules"), F.lit("[]")).alias("dq_rules"),
        F.coalesce(section("missing_fields_analysis"), F.lit("[]")).alias("missing_fields_analysis"), F.col("original").alias("raw_document"))
