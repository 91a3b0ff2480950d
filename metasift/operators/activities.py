"""Activity graphs of data pipelines, as long tables.

An activity row is ``pipeline_id, idx, name, type, deps`` (array of names) plus JSON texts
``src`` and ``sink`` (dataset settings), ``url`` and ``method`` of web calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.functions import text as tx
from metasift.operators.jsonwalk import as_variant, first_key_value, holding, is_missing, seek, walk
from metasift.operators.ordering import ranked
from metasift.operators.topology import queue_order, small_order
from metasift.session import cut_lineage, shuffled

P = "pipeline_id"


# --- reading activities ------------------------------------------------------------------

def variant_text(v: Column, *keys: str) -> Column:
    """First non-blank string among members of a variant."""
    got = []
    for k in keys:
        m = F.try_variant_get(v, f"$.{k}", "variant")
        got.append(F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string")))
    return tx.first_nonblank(*got)


def dataset_of(props: Column, side: str) -> Column:
    """Dataset settings (JSON text) of an activity's type properties: the side's own block, else shared ones."""
    def block(path: str) -> Column:
        g = F.try_variant_get(props, path, "variant")
        members = F.try_variant_get(g, "$", "map<string,variant>")
        return F.when(F.size(F.map_keys(members)) > 0, F.to_json(g))

    return F.coalesce(block(f"$.{side}.datasetSettings"), block(f"$.{side}"), block("$.datasetSettings"), block("$.storeSettings"))


def activities_of(definitions: DataFrame, doc: str, path: str) -> DataFrame:
    """Activity rows of ``definitions(pipeline_id, <doc>)`` (JSON text); ``path`` leads to the list."""
    items = F.try_variant_get(F.try_parse_json(F.col(doc)), path, "array<variant>")
    a = definitions.select(P, F.posexplode(items).alias("i", "a"))
    a = a.where(F.try_variant_get("a", "$", "map<string,variant>").isNotNull())
    dep = lambda d: F.coalesce(
        variant_text(d, "activity", "name", "referenceName"),
        F.when(F.schema_of_variant(d) == "STRING", F.try_variant_get(d, "$", "string")))
    props = F.try_variant_get("a", "$.typeProperties", "variant")
    return a.select(
        P, (F.col("i") + 1).alias("idx"),
        F.coalesce(variant_text(F.col("a"), "name"), variant_text(F.col("a"), "type"), F.lit("Activity")).alias("name"),
        F.coalesce(variant_text(F.col("a"), "type"), F.lit("")).alias("type"),
        F.array_compact(F.transform(F.coalesce(F.try_variant_get("a", "$.dependsOn", "array<variant>"),
                                               F.array().cast("array<variant>")), dep)).alias("deps"),
        dataset_of(props, "source").alias("src"), dataset_of(props, "sink").alias("sink"),
        variant_text(props, "url", "relativeUrl").alias("url"), variant_text(props, "method").alias("method"))


def adf_definitions(payloads: DataFrame) -> DataFrame:
    """Payloads whose raw document is an ADF pipeline, with their names."""
    p = payloads.withColumns({"m": as_variant(F.col("metadata")), "c": as_variant(F.col("config")), "r": as_variant(F.col("raw_json"))})
    m, c, r = F.col("m"), F.col("c"), F.col("r")
    return p.where(F.lower(F.try_variant_get(r, "$.type", "string")) == "adf_pipeline").select(
        F.col("payload_id").alias(P), F.lit("ADF").alias("platform"),
        F.coalesce(variant_text(r, "name"), variant_text(m, "name"), variant_text(c, "pipeline_name"),
                   variant_text(m, "pipeline_name"), F.lit("unknown")).alias("pipeline_name"),
        F.coalesce(variant_text(m, "workspaceId"), variant_text(c, "workspaceId")).alias("workspace_id"),
        F.coalesce(variant_text(c, "destination", "output"), variant_text(r, "destination", "output")).alias("explicit_destination"),
        F.lower(F.concat_ws(" ", "metadata", "config", "raw_json")).alias("txt"),
        F.col("raw_json").alias("definition"), "config", "raw_json")


def fabric_definitions(assets: DataFrame) -> DataFrame:
    """Fabric items of a pipeline type, with their definition documents.

    ``assets`` needs ``pipeline_id, service, id, configuration``.
    """
    a = assets.where("service = 'fabric_items'").withColumn("c", as_variant(F.col("configuration")))
    c = F.col("c")
    kind = F.lower(F.try_variant_get(c, "$.Type", "string"))
    definition = F.to_json(F.try_variant_get(c, "$.Definition", "variant"))
    return a.where(kind.isin("pipeline", "datapipeline")).select(
        P, F.lit("Fabric").alias("platform"), tx.asset_name(F.col("id")).alias("pipeline_name"),
        variant_text(c, "WorkspaceId", "workspaceId", "Workspace").alias("workspace_id"),
        F.lit(None).cast("string").alias("explicit_destination"),
        F.lower(F.concat_ws(" ", "configuration")).alias("txt"),
        F.coalesce(F.when(definition != "{}", definition), F.col("configuration")).alias("definition"),
        F.lit("{}").alias("config"), F.col("configuration").alias("raw_json"))


FABRIC_PATH = "$['pipeline-content.json'].properties.activities"


# --- order -------------------------------------------------------------------------------

def dependency_edges(acts: DataFrame) -> DataFrame:
    """(from, to) for dependencies that name a known activity; names resolve to their first holder."""
    first = acts.groupBy(P, F.col("name").alias("dep")).agg(F.min("idx").alias("from_idx"))
    d = acts.select(P, F.col("idx").alias("to_idx"), F.col("name").alias("to_name"), F.posexplode("deps").alias("dep_pos", "dep"))
    return d.join(shuffled(first), [P, "dep"]).select(
        P, "from_idx", F.col("dep").alias("from_name"), "to_idx", "to_name", "dep_pos")


#: Activities and characters of a pipeline that is ordered in one row; larger ones are ordered by joins.
SMALL_ACTIVITIES, SMALL_CHARS = 1_000, 1_000_000


def order_activities(acts: DataFrame) -> DataFrame:
    """Add ``pos`` (1-based execution order), ``level`` and ``cyclic`` to activity rows.

    Ready activities start in name order and queue first in, first out; a cycle leaves the input order.  Pipelines of bounded
    size are ordered in one row each; larger ones, and any whose numbers repeat or are null, by joins on activities.
    """
    acts = cut_lineage(acts.withColumn("idx", F.col("idx").cast("int")).where(F.col(P).isNotNull()))
    rest = [c for c in acts.columns if c not in (P, "idx")]
    wide = [F.coalesce(F.length(F.array_join(c, "") if t.startswith("array") else F.col(c).cast("string")), F.lit(0)) for c, t in acts.dtypes]
    deps = F.greatest(F.coalesce(F.size("deps"), F.lit(0)), F.lit(0))
    large = cut_lineage(acts.groupBy(P).agg(
        F.count("*").alias("n"), F.count("idx").alias("numbered"), F.sum(deps).alias("deps"), F.sum(reduce(Column.__add__, wide)).alias("chars")).where(
        (F.col("n") > SMALL_ACTIVITIES) | (F.col("deps") > SMALL_ACTIVITIES) | (F.col("chars") > SMALL_CHARS) | (F.col("numbered") < F.col("n"))).select(P))
    small = acts if large.isEmpty() else acts.join(large, P, "left_anti")
    rows = small.groupBy(P).agg(F.collect_list(F.struct("idx", *rest)).alias("a"))
    no_deps = F.array().cast("array<string>")
    order = small_order(F.col("a.idx"), F.col("a.name"), F.transform("a", lambda x: F.coalesce(x["deps"], no_deps)))
    rows = cut_lineage(rows.select(P, "a", order.alias("o")))
    done = rows.where("o is not null").select(P, F.inline(F.arrays_zip("a", F.expr("transform(sequence(1, size(a)), i -> named_struct('pos', o[i], 'level', nullif(o[size(a) + i], -1), 'cyclic', o[0] = 1))").alias("o")))).select(P, "a.idx", *[F.col(f"a.{c}").alias(c) for c in rest], "o.*")
    large = large.unionByName(rows.where("o is null").select(P))
    if large.isEmpty():
        return done
    others = cut_lineage(acts.join(large, P, "left_semi"))
    # Activities of one number share their place: as nodes of their own they would be multiplied by every join on nodes.
    nodes = others.groupBy(P, "idx").agg(F.min("name").alias("name"))
    out = queue_order(nodes, dependency_edges(others), P)
    return done.unionByName(others.join(shuffled(out), [P, "idx"]))


def terminal_and_roots(acts: DataFrame, edges: DataFrame) -> DataFrame:
    """Flags for activities without outgoing or incoming edges."""
    out = edges.select(P, F.col("from_idx").alias("idx")).distinct().withColumn("has_out", F.lit(True))
    inc = edges.select(P, F.col("to_idx").alias("idx")).distinct().withColumn("has_in", F.lit(True))
    return acts.join(shuffled(out), [P, "idx"], "left").join(shuffled(inc), [P, "idx"], "left").select(
        *acts.columns, F.col("has_out").isNull().alias("terminal"), F.col("has_in").isNull().alias("root"))


# --- classification ----------------------------------------------------------------------

def is_notification(kind: Column) -> Column:
    return F.lower(kind).isin(*rules.NOTIFICATION_TYPES) | F.lower(kind).contains("email")


def is_validation(kind: Column) -> Column:
    return F.lower(kind).isin(*rules.VALIDATION_TYPES)


def node_type(kind: Column) -> Column:
    return (F.when(is_notification(kind), "notification").when(is_validation(kind), "validation")
            .when(F.lower(kind).contains("copy"), "ingestion").otherwise("process"))


def parsed_once(doc: Column, fn) -> Column:
    """``fn`` of the parsed document; the one-element array binds it, so it is parsed a single time."""
    return F.element_at(F.transform(F.array(F.try_parse_json(doc)), fn), 1)


def member(doc: Column, *keys: str) -> Column:
    """First non-blank string member of a JSON text."""
    return parsed_once(doc, lambda v: variant_text(v, *keys))


def classify_dataset(doc: Column) -> Column:
    """struct(source_type, service_name, table, path, endpoint, artifact, schema, format) of dataset settings."""
    return parsed_once(doc, lambda v: classify_parsed(F.lower(doc), v))


def classify_parsed(t: Column, v: Column) -> Column:
    def member(*keys: str) -> Column:
        return variant_text(v, *keys)

    table = member("table", "tableName", "entity")
    api = t.contains("http") | t.contains("rest")
    plain_file = tx.contains_any(t, ["datalake", "blob", "file", "deltalake", "onelake"])
    kind = (F.when(api, "API").when(t.contains("warehouse"), "DB")
            .when(t.contains("lakehouse"), F.when(table.isNotNull(), "DB").otherwise("File"))
            .when(plain_file, "File").when(table.isNotNull(), "DB"))
    service = (F.when(api, "REST API").when(t.contains("warehouse"), "DataWarehouse").when(t.contains("lakehouse"), "Lakehouse")
               .when(plain_file, "File").when(table.isNotNull(), "Database"))
    return F.struct(
        kind.alias("source_type"), service.alias("service_name"), table.alias("table"),
        member("folderPath", "path", "fileName").alias("path"), member("relativeUrl", "url").alias("endpoint"),
        member("artifactId", "artifact_id").alias("artifact"), member("schema", "schemaName").alias("schema"),
        member("format", "formatType", "fileFormat").alias("format"))


def detect_auth(definition: Column) -> Column:
    """Authentication a definition speaks of, first match wins."""
    t = F.lower(definition)
    return (F.when(t.contains("managedidentity") | t.contains("managed identity"), "Managed Identity")
            .when(t.contains("oauth"), "OAuth").when(t.contains("apikey") | t.contains("api_key"), "Key")
            .when(t.contains("basic"), "Basic").when(t.contains("connection"), "Connection Reference"))


def is_file_dataset(doc: Column) -> Column:
    return F.coalesce(tx.contains_any(F.lower(doc), ["delimitedtext", "json", "parquet", "blob", "s3", "adls", "lakehouse", "file", "onelake"]), F.lit(False))


def is_database_dataset(doc: Column) -> Column:
    return F.coalesce(tx.contains_any(F.lower(doc), ["sql", "jdbc", "datawarehouse", "table", "warehousetable"]), F.lit(False))


def dataset_label(doc: Column) -> Column:
    return F.coalesce(member(doc, "table", "tableName", "entity", "path", "folderPath", "fileName", "artifactId", "type"), F.lit("unknown"))


def source_candidates(ordered: DataFrame) -> DataFrame:
    """Distinct source candidates per pipeline, first occurrence by execution order."""
    web = F.lower("type") == "webactivity"
    c = F.col("c")
    none = F.lit(None).cast("string")
    kept = ordered.where(web | F.col("src").isNotNull()).select(P, "pos", "type", "url", "method", classify_dataset(F.col("src")).alias("c"))
    rows = kept.select(
        P, "pos",
        F.when(web, "API").otherwise(c["source_type"]).alias("source_type"),
        F.when(web, "REST API").otherwise(c["service_name"]).alias("service_name"),
        F.when(web, none).otherwise(c["table"]).alias("table"), F.when(web, none).otherwise(c["path"]).alias("path"),
        F.when(web, F.col("url")).otherwise(c["endpoint"]).alias("endpoint"),
        F.when(web, F.col("method")).alias("method"), F.when(web, none).otherwise(c["artifact"]).alias("artifact"),
        F.when(web, none).otherwise(c["schema"]).alias("schema"), F.when(web, none).otherwise(c["format"]).alias("format"))
    ident = [c for c in rows.columns if c != "pos"]
    return rows.groupBy(*ident).agg(F.min("pos").alias("pos"))


def candidate_label() -> Column:
    return F.coalesce(tx.first_nonblank(*[F.col(c) for c in ("service_name", "table", "endpoint", "path")]), F.lit("Source"))


#: Members of a source's connection details and the candidate columns they come from.
DETAILS = {"artifactId": "artifact", "schema": "schema", "table": "table", "path": "path", "endpoint": "endpoint", "method": "method", "format": "format"}


def merge_candidates(cands: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One source for every row of ``pipelines(pipeline_id, ...)``, whose columns stay.

    Kind and service are the common value, else Mixed; minimum and maximum tell them apart.  ``connection_details`` (JSON text)
    are those of a lone candidate, or of all of them under ``sources`` in execution order, beside the ``workspace_id`` if
    ``pipelines`` has one.  A pipeline without candidates has neither kind nor service.
    """
    def common(c: str) -> Column:
        return F.when(F.min(c) == F.max(c), F.min(c)).when(F.min(c).isNotNull(), "Mixed").alias(c)

    each = F.struct("pos", F.struct(*[F.nullif(F.col(c), F.lit("unknown")).alias(k) for k, c in DETAILS.items()]).alias("of"))
    merged = cands.groupBy(P).agg(common("source_type"), common("service_name"), F.count("*").alias("sources"),
                                  F.array_sort(F.collect_list(each))["of"].alias("details"))
    given = F.col("workspace_id") if "workspace_id" in pipelines.columns else F.lit(None).cast("string")
    first, last = given.alias("workspaceId"), given.alias("workspace")

    def members(d: Column) -> list[Column]:
        return [first, *[d[k].alias(k) for k in DETAILS]]

    n = F.coalesce("sources", F.lit(0).cast("bigint"))
    several = F.when(n > 1, F.transform("details", lambda d: F.struct(*members(d))))
    details = F.when(n == 1, F.to_json(F.struct(*members(F.get("details", F.lit(0))), last))).otherwise(
        F.to_json(F.struct(several.alias("sources"), first, last)))
    return pipelines.join(shuffled(merged), P, "left").select(
        *pipelines.columns, "source_type", "service_name", n.alias("sources"), details.alias("connection_details"))


def payload_candidate(txt: Column) -> Column:
    """Source read off the payload text when no activity names one."""
    ab, url = tx.find_first(txt, tx.ABFSS_PATH), tx.find_first(txt, tx.HTTP_URL)
    jdbc = tx.find_first(txt, r"jdbc:[a-z0-9]+://[^\s\"'>,]+")

    def source(kind: str, service: Column, endpoint: Column, path: Column) -> Column:
        return F.struct(F.lit(kind).alias("source_type"), service.alias("service_name"), endpoint.alias("endpoint"), path.alias("path"))

    account = tx.capture(ab, r"(?i)abfss?://[^@]+@([^.]+)")
    none = F.lit(None).cast("string")
    return (F.when(ab.isNotNull(), source("File", F.lit("ADLS Gen2"), F.concat(account, F.lit(".dfs.core.windows.net")), ab))
            .when(url.isNotNull(), source("API", F.lit("REST API"), url, none))
            .when(jdbc.isNotNull(), source("DB", F.upper(tx.capture(jdbc, "(?i)jdbc:([a-z0-9]+)://")), jdbc, none)))


def detect_mode(txt: Column) -> Column:
    """R11"""
    return F.when(F.lower(txt).rlike("stream|eventhub|kafka"), "streaming").otherwise("batch")


def detect_trigger(pipelines: DataFrame) -> DataFrame:
    """Trigger and frequency from aliases, else from a recurrence block."""
    rec = first_key_value(pipelines, "definition", [P], "recurrence").withColumnRenamed("value", "rec")
    # Each text is parsed once, and only what was read from it meets the recurrence in a join.
    parsed = F.struct(*[F.try_parse_json(F.col(x)).alias(n) for n, x in (("d", "definition"), ("r", "raw_json"), ("c", "config"))])
    d, r, c = (F.col(x) for x in "drc")
    block = F.try_parse_json(F.col("rec"))
    has = F.try_variant_get(block, "$", "map<string,variant>").isNotNull()
    trigger = F.coalesce(*[variant_text(s, "trigger_type", "trigger") for s in (d, r, c)])
    freq = F.coalesce(*[variant_text(s, k) for k in ("frequency", "schedule", "cron") for s in (d, r, c)])
    said = pipelines.select(P, F.inline(F.array(parsed))).select(P, trigger.alias("trigger"), freq.alias("freq"))
    return said.join(shuffled(rec), P, "left").select(
        P, F.lower(F.coalesce("trigger", F.when(has, "schedule"))).alias("trigger_type"),
        F.coalesce("freq", F.when(has, variant_text(block, "frequency", "interval"))).alias("frequency"))


def detect_dq_rules(payloads: DataFrame) -> DataFrame:
    """Distinct report rules of ``payloads(payload_id, raw_json, txt)``: expectations, then phrases."""
    types = {"expect_column_values_to_not_be_null": "null_check", "expect_column_values_to_be_unique": "uniqueness_check",
             "expect_column_values_to_be_between": "range_check"}
    leaves = walk(holding(payloads, "raw_json", ["expectations"]), "raw_json", ["payload_id"]).where(
        "path rlike '(^|[.])expectations\\\\[[0-9]+\\\\][.](expectation_type|kwargs[.]column)$'")
    item = F.regexp_extract("path", r"^(.*expectations\[\d+\])", 1)
    text = F.regexp_replace("value", '^"|"$', "")
    items = leaves.groupBy("payload_id", item.alias("item")).agg(
        F.max(F.when(F.col("key") == "expectation_type", text)).alias("t"),
        F.max(F.when(F.col("key") == "column", text)).alias("c"))
    rule = F.coalesce(*[F.when(F.col("t") == k, F.concat(F.lit(v + ":"), F.coalesce("c", F.lit("column")))) for k, v in types.items()])
    phrases = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("txt").contains(p), F.lit(r)) for p, r in rules.PHRASE_RULES])))
    return items.select("payload_id", rule.alias("rule")).where("rule is not null").unionByName(
        payloads.select("payload_id", F.explode(phrases).alias("rule"))).distinct()


def data_formats(ordered: DataFrame) -> DataFrame:
    """Distinct dataset formats per pipeline with their place of first use."""
    fmt = lambda c: member(F.col(c), "format", "formatType", "fileFormat", "type")
    rows = ordered.select(P, F.explode(F.array(
        F.struct((F.col("pos") * 2).alias("at"), fmt("src").alias("format")),
        F.struct((F.col("pos") * 2 + 1).alias("at"), fmt("sink").alias("format")))).alias("f")).where("f.format is not null")
    return rows.groupBy(P, "f.format").agg(F.min("f.at").alias("at"))


def text_formats(txt: Column, explicit: Column) -> Column:
    """Formats a payload names: the explicit one, then those its text mentions."""
    words = [("parquet", "PARQUET"), ("json", "JSON"), ("csv", "CSV"), ("delta", "Delta")]
    return F.array_distinct(F.array_compact(F.array(explicit, *[F.when(txt.contains(w), F.lit(v)) for w, v in words])))


# --- destination, graph, texts -----------------------------------------------------------

def destination_label() -> Column:
    """Label of an activity's sink or notebook, else null."""
    def label(v: Column) -> Column:
        c = classify_parsed(F.lower("sink"), v)
        return F.coalesce(tx.first_nonblank(c["table"], c["path"], c["artifact"], c["service_name"], F.col("name")), F.lit("Sink"))

    sink = parsed_once(F.col("sink"), label)
    return F.when(F.col("sink").isNotNull(), sink).when(F.lower("type").isin(*rules.NOTEBOOK_TYPES), F.col("name"))


def destinations(flagged: DataFrame) -> DataFrame:
    """Destination labels per pipeline in order.

    Sinks of terminal activities; else the last sink anywhere; else terminal process names.
    """
    a = cut_lineage(flagged.where(~is_notification(F.col("type"))).select(
        P, "pos", "name", "terminal", is_validation(F.col("type")).alias("checks"), destination_label().alias("label")))
    tier1 = F.col("terminal") & F.col("label").isNotNull()
    tier3 = F.col("terminal") & F.col("label").isNull() & ~F.col("checks")
    agg = a.groupBy(P).agg(F.count_if(tier1).alias("n1"), F.max(F.when(F.col("label").isNotNull(), F.col("pos"))).alias("last"))
    j = a.join(shuffled(agg), P)
    keep = (F.when(F.col("n1") > 0, tier1).when(F.col("last").isNotNull(), F.col("pos") == F.col("last")).otherwise(tier3))
    return j.where(keep).select(P, "pos", F.coalesce("label", "name").alias("label"))


def flow_graph(flagged: DataFrame, edges: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables (R15): sources, activities without notifications, dependencies.

    The i-th source feeds the i-th root.
    """
    kept = flagged.where(~is_notification(F.col("type"))).select(
        P, "idx", "pos", tx.slug(F.col("name")).alias("node_id"), node_type(F.col("type")).alias("node_type"))
    src = ranked(cands.select(P, "pos"), [P], ["pos"], "i").select(P, "i", F.concat(F.lit("source_"), "i").alias("node_id"))
    nodes = src.select(P, F.col("i").alias("seq"), "node_id", F.lit("source").alias("node_type")).unionByName(
        kept.select(P, (F.col("pos") + 1_000_000_000).alias("seq"), "node_id", "node_type"))
    ids = kept.select(P, "idx", "node_id")
    inner = (edges.join(shuffled(ids.select(P, F.col("idx").alias("from_idx"), F.col("node_id").alias("from_id"))), [P, "from_idx"])
             .join(shuffled(ids.select(P, F.col("idx").alias("to_idx"), F.col("node_id").alias("to_id"))), [P, "to_idx"]))
    fed = inner.select(P, F.col("to_idx").alias("idx")).distinct()
    roots = ranked(kept.join(shuffled(fed), [P, "idx"], "left_anti"), [P], ["pos"], "i")
    start = src.select(P, "i", F.col("node_id").alias("from_id")).join(
        shuffled(roots.select(P, "i", F.col("node_id").alias("to_id"))), [P, "i"]).select(P, "from_id", "to_id")
    return nodes, start.unionByName(inner.select(P, "from_id", "to_id"))


def flow_text(pipelines: DataFrame, ordered: DataFrame, cands: DataFrame, dests: DataFrame, gated: DataFrame) -> DataFrame:
    """``sources -> steps -> destination[ with validation gates]``.

    ``pipelines(pipeline_id, pipeline_name)``; ``gated(pipeline_id)`` lists those with rules.
    """
    def section(df: DataFrame, n: int, label: Column) -> DataFrame:
        return df.where(F.col(P).isNotNull()).select(P, F.lit(n).alias("s"), F.col("pos").alias("k"), label.alias("label"))

    steps = ordered.where(~is_notification(F.col("type")))
    parts = [
        section(cands, 0, candidate_label()), section(steps, 1, F.col("name")), section(dests, 2, F.col("label")),
        gated.select(P, F.lit(3).alias("s"), F.lit(0).alias("k"), F.lit(" with validation gates").alias("label")),
        pipelines.select(P, F.lit(4).alias("s"), F.lit(0).alias("k"), F.col("pipeline_name").alias("label")),
    ]
    rows = reduce(DataFrame.unionByName, parts).groupBy(P).agg(F.collect_list(F.struct("s", "k", "label")).alias("l"))
    of = lambda n: F.filter("l", lambda x: x["s"] == n).alias(f"l{n}")
    rows = rows.select(P, *[of(n) for n in range(5)])

    def written(n: int, lead: str, default, glue: str) -> Column:
        start = F.array_min(F.col(f"l{n}.k"))
        tokens = F.transform(f"l{n}", lambda x: F.struct(x["k"].alias("k"), F.concat(F.when(x["k"] == start, lead).otherwise(glue), x["label"]).alias("token")))
        lone = F.transform("l4", lambda x: F.struct(x["k"].alias("k"), default(x["label"]).alias("token")))
        return F.array_join(F.array_sort(F.when(F.size(f"l{n}") > 0, tokens).otherwise(lone))["token"], "")

    return rows.select(P, F.concat(
        written(0, "", lambda name: F.lit("No explicit source"), ", "), written(1, " -> ", lambda name: F.concat(F.lit(" -> "), name), " -> "),
        written(2, " -> ", lambda name: F.lit(" -> no explicit sink"), ", "), F.array_join("l3.label", "")).alias("text"))


def loading_flow(ordered: DataFrame, cands: DataFrame, dests: DataFrame) -> DataFrame:
    """``STAGE: label`` steps, first use of each kept."""
    endpoint = F.when(tx.first_nonblank(F.col("endpoint")).isNotNull(), tx.endpoint_label(F.col("endpoint"))).otherwise(candidate_label())
    web = F.lower("type") == "webactivity"
    src, sink = F.col("src"), F.col("sink")

    def stage(cond: Column, phase: int, sub: int, name: str, label: Column) -> Column:
        return F.when(cond, F.struct(F.lit(phase).alias("phase"), F.col("pos").alias("at"), F.lit(sub).alias("sub"),
                                     F.lit(name).alias("stage"), label.alias("label")))

    web_label = F.when(F.col("url").isNotNull(), tx.endpoint_label(F.col("url"))).otherwise(F.col("name"))
    per_act = F.array_compact(F.array(
        stage(is_file_dataset(src) | is_database_dataset(src), 1, 0, "SOURCE", dataset_label(src)),
        stage(web, 2, 0, "SOURCE", web_label),
        stage(is_file_dataset(sink), 2, 1, "STAGING", dataset_label(sink)),
        stage(F.lower("type").isin(*rules.TRANSFORM_TYPES), 2, 2, "TRANSFORMATION", F.col("name")),
        stage(is_database_dataset(sink), 2, 3, "DESTINATION", dataset_label(sink))))
    rows = ordered.select(P, F.explode(per_act).alias("s")).select(P, "s.*").unionByName(
        cands.where("source_type = 'API'").select(P, F.lit(0).alias("phase"), F.col("pos").alias("at"), F.lit(0).alias("sub"),
                                                  F.lit("SOURCE").alias("stage"), endpoint.alias("label")))
    rows = rows.where(F.col(P).isNotNull())
    once = cut_lineage(rows.groupBy(P, "stage", "label").agg(F.min(F.struct("phase", "at", "sub")).alias("o")))
    done = once.where("stage = 'DESTINATION'").select(P).distinct()
    rest = dests.where(F.col(P).isNotNull()).join(shuffled(done), P, "left_anti").select(
        P, F.lit(None).cast("string").alias("stage"), "label",
        F.struct(F.lit(9).alias("phase"), F.col("pos").alias("at"), F.lit(0).alias("sub")).alias("o"))
    steps = once.unionByName(rest).groupBy(P).agg(F.collect_list(F.struct("o", "stage", "label")).alias("l"))
    steps = steps.select(P, F.filter("l", lambda x: x["stage"].isNotNull()).alias("body"), F.filter("l", lambda x: x["stage"].isNull()).alias("tail"))

    def written(part: str, token) -> Column:
        start = F.array_min(F.col(f"{part}.o"))
        tokens = F.transform(part, lambda x: F.struct(x["o"].alias("o"), token(x, x["o"] == start).alias("token")))
        return F.array_join(F.array_sort(tokens)["token"], "")

    # A default destination with several labels reads as one comma-joined step.
    lead = F.concat(F.when(F.size("body") > 0, " -> ").otherwise(""), F.lit("DESTINATION: "))
    return steps.select(P, F.concat(
        written("body", lambda x, first: F.concat(F.when(first, "").otherwise(" -> "), x["stage"], F.lit(": "), x["label"])),
        written("tail", lambda x, first: F.concat(F.when(first, lead).otherwise(", "), x["label"]))).alias("text"))


def ingestion_details(ordered: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Ingestion types and file types per pipeline (R18); ``pipelines(pipeline_id, definition)`` adds its text."""
    text = F.lower(F.concat_ws(" ", "name", "type", "src", "sink", "url"))
    kinds = {side: tx.normalize_file_type(member(F.col(side), "type", "format", "formatType", "fileFormat")) for side in ("src", "sink")}

    def any_row(c: Column) -> Column:
        return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))

    def types(side: str) -> Column:
        firsts = F.array(*[F.struct(F.min(F.when(kinds[side] == t, F.col("pos"))).alias("at"), F.lit(t).alias("t"))
                           for t in tx.FILE_TYPES.values()])
        return F.transform(F.array_sort(F.filter(firsts, lambda x: x["at"].isNotNull())), lambda x: x["t"])

    a = ordered.groupBy(P).agg(
        any_row(tx.contains_any(text, ["webactivity", "http", "rest", "graphql"])).alias("api"),
        any_row(is_file_dataset(F.col("src")) | is_file_dataset(F.col("sink")) | tx.contains_any(text, ["blob", "s3", "adls", "onelake"])).alias("file"),
        any_row(tx.contains_any(text, ["sql", "jdbc", "datawarehouse", "table", "sink to warehouse", "warehousetable"])).alias("db"),
        any_row(tx.contains_any(text, ["kafka", "eventhub", "kinesis"])).alias("stream"),
        types("src").alias("fin"), types("sink").alias("fout"))
    d = F.lower("definition")
    j = pipelines.join(shuffled(a), P, "left")
    yes = {
        "API": F.coalesce("api", F.lit(False)),
        "File-based": F.coalesce("file", F.lit(False)) | tx.contains_any(d, ["blob", "s3", "adls", "onelake"]),
        "Database": F.coalesce("db", F.lit(False)) | tx.contains_any(d, ["sql", "jdbc", "datawarehouse", "table", "sink to warehouse"]),
        "Streaming": F.coalesce("stream", F.lit(False)) | tx.contains_any(d, ["kafka", "eventhub", "kinesis"]),
    }
    empty = F.array().cast("array<string>")
    return j.select(
        P, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in yes.items()])).alias("ingestion_types"),
        F.when(yes["API"] & (F.coalesce(F.size("fin"), F.lit(0)) <= 0), F.array(F.lit("JSON"))).otherwise(F.coalesce("fin", empty)).alias("file_types_in"),
        F.coalesce("fout", empty).alias("file_types_out"))


def delimiters(pipelines: DataFrame) -> DataFrame:
    """Delimited-text options found anywhere in the definition."""
    keys = {"columndelimiter": "column_delimiter", "escapechar": "escape_char", "quotechar": "quote_char", "firstrowasheader": "header"}
    hits = seek(pipelines, "definition", [P], list(keys)).withColumn("k", F.lower("key")).where(~F.col("kind").isin("null", "object", "array"))
    text = F.regexp_replace("value", '^"|"$', "")
    return hits.groupBy(P).agg(*[F.min_by(F.when(F.col("k") == k, text), F.when(F.col("k") == k, F.col("ord"))).alias(v) for k, v in keys.items()])


# --- reports -----------------------------------------------------------------------------

CAPABILITIES = [
    # Capability, reason when supported, reason when not.
    ("API Ingestion", "Web/HTTP activity detected in pipeline flow", "No Web/API activity found"),
    ("File Ingestion", "File-based source or format detected", "No file-based sources detected"),
    ("Database/Table Ingestion", "Database or table source detected", "No database or table sources detected"),
    ("Batch Processing", "ForEach or loop activity detected in pipeline flow", "No batch/loop activities found"),
    ("Streaming", "Streaming or event trigger detected", "No streaming configs found"),
    ("Data Quality", "Explicit DQ rules detected", "No DQ rules or condition activities found"),
    ("Notifications", "Email or alert activity detected", "No notification activities found"),
]


def capability_matrix(nodes: DataFrame, reports: DataFrame, key: str = "report_id") -> DataFrame:
    """Seven capabilities per report with status and reason.

    ``nodes(report_id, node_id, node_type)``, ``reports(report_id, source_text, rule_count)``; node
    evidence is an any-of per report, which combines before the shuffle.
    """
    i, t = F.lower("node_id"), F.lower("node_type")
    node_text = F.concat_ws(" ", i, t)

    def has(c: Column) -> Column:
        return F.coalesce(F.bool_or(c), F.lit(False))

    words = {"file": ["csv", "json", "adls", "s3", "blob", "parquet", "delimited"],
             "db": ["warehouse", "lakehouse", "sql", "table", "database"], "stream": ["event", "stream", "kafka"]}
    a = nodes.groupBy(key).agg(
        has((t == "webactivity") | i.contains("http") | i.contains("rest")).alias("api"),
        has(t.isin("foreach", "until") | i.contains("foreach") | i.contains("loop")).alias("batch"),
        has(t.isin("ifcondition", "condition") | i.contains("condition")).alias("cond"),
        has(i.rlike("email|alert|notification")).alias("note"),
        *[has(tx.contains_any(node_text, w)).alias(n) for n, w in words.items()])
    j = reports.join(a, key, "left")
    flag = {n: F.coalesce(n, F.lit(False)) for n in ("api", "batch", "cond", "note", "file", "db", "stream")}
    s = F.lower("source_text")
    for n, w in words.items():
        flag[n] = flag[n] | F.coalesce(tx.contains_any(s, w), F.lit(False))
    ok = [flag["api"], flag["file"], flag["db"], flag["batch"], flag["stream"], F.col("rule_count") > 0, flag["note"]]
    rows = []
    for (name, yes, no), c in zip(CAPABILITIES, ok):
        partial = flag["cond"] if name == "Data Quality" else F.lit(False)
        rows.append(F.struct(
            F.lit(name).alias("capability"),
            F.when(c, "SUPPORTED").when(partial, "PARTIAL").otherwise("NOT_SUPPORTED").alias("status"),
            F.when(c, yes).when(partial, "Condition present but no explicit DQ rules").otherwise(no).alias("reason")))
    return j.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*")


def capability_summary(matrix: DataFrame, key: str = "report_id") -> DataFrame:
    """Counts by status."""
    return matrix.groupBy(key).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower() + "_count") for s in ("SUPPORTED", "NOT_SUPPORTED", "PARTIAL")])


REPORT_REASONS = {
    # Field and why it is missing.
    "source_configs.source_type": "No source activity or source dataset metadata was present to classify the upstream source.",
    "source_configs.service_name": "No linked service, dataset type, or activity pattern identified the backing source service.",
    "source_configs.authentication_type": "No explicit authentication, credential, or connection-reference metadata was found in the pipeline JSON.",
    "source_configs.connection_details.workspaceId": "Workspace metadata was not present on the pipeline item or the dataset definition.",
    "source_configs.connection_details.artifactId": "No lakehouse or warehouse artifact identifier was present in the referenced dataset settings.",
    "source_configs.connection_details.schema": "No explicit schema field was present in the referenced dataset settings.",
    "source_configs.connection_details.table": "No explicit table name was present in the referenced dataset settings.",
    "source_configs.connection_details.endpoint": "No API endpoint or service URL was present in the source activity metadata.",
    "source_configs.connection_details.path": "No folder path, file path, or OneLake path was present in the source dataset settings.",
    "ingestion_configs.trigger_type": "No trigger metadata, recurrence block, or schedule definition was present in the pipeline JSON.",
    "ingestion_configs.frequency": "No recurrence frequency, interval, cron, or schedule metadata was present in the pipeline JSON.",
    "ingestion_configs.data_format": "No source/sink format settings or recognizable format markers were found in the pipeline JSON.",
    "ingestion_configs.destination": "No warehouse, lakehouse, file sink, or final processing target could be inferred from terminal activities.",
    "dq_rules": "No expectations, conditional validations, status checks, row-count checks, or schema validation patterns were detected in the pipeline JSON.",
    "flow.text": "No ordered execution path could be built from activity dependencies in the pipeline definition.",
}


def report_missing_fields(reports: DataFrame, leaves: DataFrame, key: str = "report_id") -> DataFrame:
    """Required fields without a leaf, with the reason (R20); ``reports(report_id, original)``."""
    t = F.lower("original")
    rows = []
    for f, why in REPORT_REASONS.items():
        reason: Column = F.lit(why)
        if f.endswith(("trigger_type", "frequency")):
            reason = F.when(t.contains("recurrence"), "Recurrence metadata exists but does not contain a normalized frequency or trigger value.").otherwise(why)
        if f.endswith("endpoint"):
            reason = F.when(t.contains("webactivity"), "A WebActivity exists, but no explicit URL field was present in its typeProperties.").otherwise(why)
        rows.append(F.struct(F.lit(f).alias("field"), reason.alias("reason")))
    have = leaves.where(~is_missing(F.col("value"))).select(key, F.col("path").alias("field")).distinct()
    return reports.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.field", "r.reason").join(have, [key, "field"], "left_anti")


def signatures(parts: DataFrame, key: str) -> DataFrame:
    """128-bit signature of each report's multiset ``parts(key, kind, value)``.

    Equal parts are counted first; the hashes fold with xor, which is order-free and
    combines before the shuffle, so a report of any size needs no list.
    """
    n = parts.groupBy(key, "kind", "value").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.struct(
        F.bit_xor(F.xxhash64(F.lit("a"), "kind", "value", "n")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("b"), "value", "n", "kind")).alias("h2"),
        F.count("*").alias("c")).alias("sig"))


def structural_dedup(nodes: DataFrame, edges: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """First report (least key) of every flow structure (W02): normalised nodes, edges and text."""
    norm = tx.normalize_node_id
    parts = nodes.select(key, F.lit("n").alias("kind"), F.concat(norm(F.col("node_id")), F.lit("::"), F.lower(F.trim("node_type"))).alias("value"))
    parts = parts.unionByName(edges.select(key, F.lit("e").alias("kind"), F.concat(norm(F.col("from_id")), F.lit("->"), norm(F.col("to_id"))).alias("value")))
    parts = parts.unionByName(texts.select(key, F.lit("t").alias("kind"), F.lower(F.trim("text")).alias("value")))
    return signatures(parts, key).groupBy("sig").agg(F.min(key).alias(key), F.count("*").alias("copies")).select(key, "copies")


def analyze_activities(pipelines: DataFrame, acts: DataFrame) -> dict[str, DataFrame]:
    """All report tables of a set of pipelines.

    What the long texts say is boiled down to a few columns first, and these, the ordered
    activities and the edges are written once; every section reads them instead of parsing
    the documents again.
    """
    phrases = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("txt").contains(p), F.lit(r)) for p, r in rules.PHRASE_RULES])))
    facts = cut_lineage(pipelines.select(
        P, "platform", "pipeline_name", "workspace_id", "explicit_destination", detect_auth(F.col("definition")).alias("authentication_type"),
        detect_mode(F.concat_ws(" ", "txt", "definition")).alias("mode"), payload_candidate(F.col("txt")).alias("guess"), phrases.alias("rules")))
    ordered = cut_lineage(order_activities(cut_lineage(acts)))
    edges = cut_lineage(dependency_edges(ordered))
    flagged = cut_lineage(terminal_and_roots(ordered, edges))
    known = ordered.select(P).distinct()
    guess = facts.where("guess is not null").join(shuffled(known), P, "left_anti")
    none = F.lit(None).cast("string")
    cands = cut_lineage(source_candidates(ordered).unionByName(guess.select(
        P, "guess.source_type", "guess.service_name", none.alias("table"), "guess.path", "guess.endpoint", none.alias("method"),
        none.alias("artifact"), none.alias("schema"), none.alias("format"), F.lit(0).alias("pos"))))
    explicit = facts.where("explicit_destination is not null").select(P, F.lit(0).alias("pos"), F.col("explicit_destination").alias("label"))
    dests = cut_lineage(destinations(flagged).join(shuffled(explicit.select(P)), P, "left_anti").unionByName(explicit))
    rule_rows = facts.select(P, F.explode("rules").alias("rule"))
    nodes, links = flow_graph(flagged, edges, cands)
    lone = facts.join(shuffled(known), P, "left_anti").select(
        P, F.lit(0).alias("seq"), tx.slug(F.col("pipeline_name")).alias("node_id"), F.lit("process").alias("node_type"))
    report = (
        merge_candidates(cands, facts.drop("guess", "rules", "explicit_destination")).join(shuffled(detect_trigger(pipelines)), P, "left")
        .join(shuffled(dests.groupBy(P).agg(F.min_by("label", "pos").alias("destination"), F.count("*").alias("destinations"))), P, "left"))
    return {"report": report, "ordered": ordered, "nodes": nodes.unionByName(lone), "edges": links, "candidates": cands,
            "destinations": dests, "rules": rule_rows, "text": flow_text(facts, ordered, cands, dests, facts.where(F.size("rules") > 0).select(P)),
            "details": ingestion_details(ordered, pipelines)}
