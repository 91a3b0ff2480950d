"""Cloud inventory: dumps, roles, links, rollups, resource shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as tx
from metasift.operators.jsonwalk import kind_of, list_of, object_of
from metasift.operators.lineage import first_n


def arn_environments(refs: DataFrame) -> DataFrame:
    """Provider, region and account of every ARN in ``refs(urn)``."""
    return refs.withColumn("a", tx.parse_arn(F.col("urn"))).where("a is not null").select(
        "urn", F.lit("aws").alias("provider"), "a.region", "a.account_id")


def cloud_environments(refs: DataFrame) -> DataFrame:
    """Distinct members of every environment, long form.

    One row per environment and reference: an environment that owns a third of all
    references stays spread over the cluster.
    """
    return arn_environments(refs).distinct()


def tagged_resources(refs: DataFrame, per_service: int | None = None) -> DataFrame:
    """Service and identifier of tagged ARNs, ranked per service; the first ``per_service`` if given."""
    p = F.split("ref", ":", -1)
    rows = refs.where(F.size(p) >= 3).select(
        "ref", p[2].alias("service"), F.element_at(F.split(F.element_at(p, -1), "/", -1), -1).alias("identifier"))
    return first_n(rows, ["service"], ["ref"], per_service)


# --- dumps -------------------------------------------------------------------------------

def dump_items(payloads: DataFrame, doc: str = "raw_json") -> DataFrame:
    """Every inventory entry of every dump, tolerant of wrong types at each level.

    Columns: payload_id, dump_pos, service, item_pos, kind, item (JSON text), id, configuration.
    """
    dumps = F.try_variant_get(F.try_parse_json(F.col(doc)), "$.raw_cloud_dump", "array<variant>")
    d = payloads.select("payload_id", F.posexplode(dumps).alias("dump_pos", "dump"))
    s = d.select("payload_id", "dump_pos", F.explode(F.map_entries(object_of(F.col("dump")))).alias("s"))
    i = s.select("payload_id", "dump_pos", F.col("s.key").alias("service"), F.posexplode(list_of(F.col("s.value"))).alias("item_pos", "v"))
    v = F.col("v")
    return i.select(
        "payload_id", "dump_pos", "service", "item_pos", kind_of(v).alias("kind"), F.to_json(v).alias("item"),
        F.when(object_of(v).isNotNull(), F.try_variant_get(v, "$.id", "string")).alias("id"),
        F.coalesce(F.to_json(F.when(object_of(v).isNotNull(), F.try_variant_get(v, "$.configuration", "variant"))), F.lit("{}")).alias("configuration"))


def assets_of(payloads: DataFrame, doc: str = "raw_json") -> DataFrame:
    """Inventory entries that are objects."""
    return dump_items(payloads, doc).where("kind = 'object'").drop("kind", "item")


def normalized_inventory(items: DataFrame) -> DataFrame:
    """Objects as they are, non-blank strings as UNKNOWN entries, the rest dropped."""
    name = F.trim(F.try_variant_get(F.try_parse_json("item"), "$", "string"))
    string = F.col("kind") == "string"
    return items.where((F.col("kind") == "object") | (string & (name != ""))).select(
        "payload_id", "dump_pos", "service", "item_pos", F.when(string, name).otherwise(F.col("id")).alias("id"),
        F.when(string, "UNKNOWN").otherwise(F.upper("service")).alias("label"), "configuration")


def detailed_inventory(items: DataFrame) -> DataFrame:
    """Object entries of the first dump only."""
    return items.where("dump_pos = 0 and kind = 'object'").select("payload_id", "id", F.upper("service").alias("service"), "configuration")


# --- roles and links ---------------------------------------------------------------------

# Service (and Fabric item type) to roles.
SERVICE_ROLES = {
    "apigateway": ["source"], "storage_accounts": ["source", "target"], "lambda": ["ingest"], "glue": ["ingest"],
    "functions": ["ingest"], "datafactory": ["ingest"], "s3": ["target"], "fabric_workspaces": ["target"],
}


def with_roles(assets: DataFrame) -> DataFrame:
    """One row per asset and role (J01); Fabric items by type, storage accounts twice."""
    t = F.lower(F.coalesce("item_type", F.lit("")))
    fabric = (F.when(t.isin("lakehouse", "warehouse"), F.array(F.lit("target")))
              .when(t.isin("pipeline", "datapipeline", "notebook", "sparkjob"), F.array(F.lit("ingest")))
              .otherwise(F.array(F.lit("source"))))
    role = F.when(F.col("service") == "fabric_items", fabric)
    for svc, names in SERVICE_ROLES.items():
        role = role.when(F.col("service") == svc, F.array(*[F.lit(n) for n in names]))
    return assets.withColumn("role", F.explode(role))


API_KEY = "*api*"


def link_upstream(roles: DataFrame) -> DataFrame:
    """Ingest assets and the sources they link to (J02), as ``(payload_id, link_key, side, id)``.

    An ingest asset links to a source of its payload whose id holds the last ``-`` part of
    its name, or ``api``.  Both sides meet on that word, so the table grows with the assets:
    any ingest and any source with one key are linked, and no pair is ever spelled out.
    Sources are cut into the substrings that have a searched word's length, which makes the
    containment an equi-join.
    """
    ing = roles.where("role = 'ingest'").select(
        "payload_id", "id", F.lower(F.element_at(F.split(tx.asset_name(F.col("id")), "-", -1), -1)).alias("link_key")).distinct()
    words = ing.where("link_key <> ''").select("payload_id", "link_key").distinct()
    lengths = words.groupBy("payload_id").agg(F.collect_set(F.length("link_key")).alias("n"))
    src = roles.where("role = 'source'").select("payload_id", "id").distinct()
    cut = src.join(lengths, "payload_id").select("payload_id", "id", F.explode(tx.substrings(F.lower("id"), F.col("n"))).alias("link_key"))
    hit = cut.join(words, ["payload_id", "link_key"], "left_semi")
    api = src.where(F.lower("id").contains("api")).withColumn("link_key", F.lit(API_KEY))
    found = hit.select("payload_id", "link_key", "id").unionByName(api.select("payload_id", "link_key", "id"))
    keys = found.select("payload_id", "link_key").distinct()
    left = ing.unionByName(ing.select("payload_id", "id", F.lit(API_KEY).alias("link_key"))).join(keys, ["payload_id", "link_key"], "left_semi")
    known = left.select("payload_id", "link_key").distinct()
    return (left.select("payload_id", "link_key", F.lit("ingest").alias("side"), "id")
            .unionByName(found.join(known, ["payload_id", "link_key"], "left_semi").select("payload_id", "link_key", F.lit("source").alias("side"), "id"))
            .distinct())


def link_downstream(roles: DataFrame) -> DataFrame:
    """Environment targets and the assets they mean (J03), in the same shape.

    A target value matches an asset whose name lies in it or whose id holds it; each
    direction is an equi-join on substrings of the searched length.
    """
    ing = roles.where("role = 'ingest'").select("payload_id", "id", F.explode("env_targets").alias("t")).select(
        "payload_id", "id", F.lower("t").alias("link_key")).where("link_key <> ''").distinct()
    values = ing.select("payload_id", "link_key").distinct()
    tgt = roles.where("role = 'target'").select("payload_id", "id", F.lower(tx.asset_name(F.col("id"))).alias("name"), F.lower("id").alias("low")).distinct()
    name_len = tgt.groupBy("payload_id").agg(F.collect_set(F.length("name")).alias("n"))
    inside = (values.join(name_len, "payload_id")
              .select("payload_id", "link_key", F.explode(tx.substrings(F.col("link_key"), F.col("n"))).alias("name"))
              .join(tgt, ["payload_id", "name"]).select("payload_id", "link_key", "id"))
    value_len = values.groupBy("payload_id").agg(F.collect_set(F.length("link_key")).alias("n"))
    around = (tgt.join(value_len, "payload_id")
              .select("payload_id", "id", F.explode(tx.substrings(F.col("low"), F.col("n"))).alias("link_key"))
              .join(values, ["payload_id", "link_key"], "left_semi").select("payload_id", "link_key", "id"))
    found = inside.unionByName(around).distinct()
    left = ing.join(found.select("payload_id", "link_key").distinct(), ["payload_id", "link_key"], "left_semi")
    return left.select("payload_id", "link_key", F.lit("ingest").alias("side"), "id").unionByName(
        found.select("payload_id", "link_key", F.lit("target").alias("side"), "id"))


def assemble_links(roles: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    """One row per ingest asset with its link counts, cloud paths and confidence.

    Link tables are counted per key before they meet the assets.  ``target_links`` counts
    distinct targets, though several values of an asset may mean the same one; the evidence
    counts every value's.  Payloads with assets but no ingest asset give one standalone row.
    """
    def per_key(links: DataFrame, side: str) -> DataFrame:
        s = links.where(F.col("side") == side).withColumn("api", F.lower("id").contains("api"))
        return s.groupBy("payload_id", "link_key").agg(
            F.count("*").alias("n"), F.count_if("api").alias("n_api"), F.collect_set(tx.asset_cloud(F.col("id"))).alias("clouds"))

    ing = roles.where("role = 'ingest'").select("payload_id", "id", "confidence", F.size("code_evidence").alias("code"))
    sides = []
    for links, side in ((up, "source"), (down, "target")):
        k = per_key(links, side)
        n = F.when((F.col("link_key") != API_KEY) & F.lit(side == "source"), F.col("n") - F.col("n_api")).otherwise(F.col("n"))
        both = links.where("side = 'ingest'").select("payload_id", "link_key", "id").join(k, ["payload_id", "link_key"])
        # Without an "api" key the api sources of a word count with the word itself.
        if side == "source":
            has = links.where(F.col("link_key") == API_KEY).select("payload_id").distinct().withColumn("hub", F.lit(True))
            both = both.join(has, "payload_id", "left")
            n = F.when(F.col("hub").isNull(), F.col("n")).otherwise(n)
        sides.append(both.groupBy("payload_id", "id").agg(
            F.sum(n).alias(f"{side}_links"), F.array_distinct(F.flatten(F.collect_set("clouds"))).alias(f"{side}_clouds")))
    # Only assets with several values can meet a target twice.  Assets with the same values mean the same targets, so the
    # union of a set of values is taken once, however many assets have it.
    values = down.where("side = 'ingest'").groupBy("payload_id", "id").agg(F.array_sort(F.collect_set("link_key")).alias("keys")).where("size(keys) > 1")
    targets = down.where("side = 'target'").select("payload_id", "link_key", F.col("id").alias("target"))
    unions = values.select("payload_id", "keys").distinct().withColumn("link_key", F.explode("keys")).join(targets, ["payload_id", "link_key"])
    unions = unions.select("payload_id", "keys", "target").distinct().groupBy("payload_id", "keys").agg(F.count("*").alias("distinct_targets"))
    once = values.join(unions, ["payload_id", "keys"]).select("payload_id", "id", "distinct_targets")
    j = ing.join(sides[0], ["payload_id", "id"], "left").join(sides[1], ["payload_id", "id"], "left").join(once, ["payload_id", "id"], "left")
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("bigint")
    s, t = F.coalesce("source_links", zero), F.coalesce("target_links", zero)
    full = j.select(
        "payload_id", F.concat(tx.asset_name(F.col("id")), F.lit(" Architecture")).alias("name"), F.col("id").alias("ingestion"),
        s.alias("source_links"), F.coalesce("distinct_targets", t).alias("target_links"),
        F.array_sort(F.array_union(F.array(tx.asset_cloud(F.col("id"))), F.array_union(F.coalesce("source_clouds", none), F.coalesce("target_clouds", none)))).alias("cloud_path"),
        F.coalesce("confidence", F.lit("LOW")).alias("confidence"),
        (1 + F.when(F.col("code") > 0, 1).otherwise(0) + s + t).alias("evidence_lines"))
    lone = roles.groupBy("payload_id").agg(
        F.count_if(F.col("role") == "ingest").alias("i"), F.count_if(F.col("role") == "source").alias("source_links"),
        F.count_if(F.col("role") == "target").alias("target_links")).where("i = 0 and source_links + target_links > 0")
    alone = lone.select("payload_id", F.lit("Discovered Standalone Assets").alias("name"), F.lit(None).cast("string").alias("ingestion"), "source_links",
                        "target_links", F.array(F.lit("MULTICLOUD")).alias("cloud_path"), F.lit("LOW").alias("confidence"), F.lit(1).cast("bigint").alias("evidence_lines"))
    return full.unionByName(alone)


# --- rollups -----------------------------------------------------------------------------

def config_text(key: str) -> Column:
    """Configuration value of an asset row as text, null when empty."""
    return F.nullif(F.try_variant_get(F.try_parse_json("configuration"), f"$.{key}", "string"), F.lit(""))


def first_asset(assets: DataFrame, service: str) -> DataFrame:
    """First discovered item of a service per payload."""
    return assets.where(F.col("service") == service).groupBy("payload_id").agg(
        F.min_by(F.struct("id", "configuration"), F.struct("dump_pos", "item_pos")).alias("a")).select("payload_id", "a.*")


def ordered_values(assets: DataFrame, value: Column) -> DataFrame:
    """Distinct values per payload with their first place ``(payload_id, value, at)``; repeats collapse map-side."""
    v = assets.select("payload_id", value.alias("value"), F.struct("dump_pos", "item_pos").alias("at")).where("value is not null")
    return v.groupBy("payload_id", "value").agg(F.min("at").alias("at"))


def joined(values: DataFrame, name: str, order: str = "rn") -> DataFrame:
    """Capped values as one ``|`` text per payload."""
    return values.groupBy("payload_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]), "|").alias(name))


def storage_rollup(assets: DataFrame, cap: int | None = None) -> DataFrame:
    """Bucket and account counts, names (the first ``cap`` if given), any hierarchical namespace."""
    s3 = assets.where("service = 's3'")
    az = assets.where("service = 'storage_accounts'")
    name = tx.asset_name(F.col("id"))
    firsts = lambda df: first_n(df.select("payload_id", name.alias("value"), "dump_pos", "item_pos"), ["payload_id"], ["dump_pos", "item_pos"], cap)
    counts = assets.groupBy("payload_id").agg(
        F.count_if(F.col("service") == "s3").alias("bucket_count"), F.count_if(F.col("service") == "storage_accounts").alias("account_count"),
        F.coalesce(F.bool_or(F.when(F.col("service") == "storage_accounts", config_text("IsHnsEnabled") == "true")), F.lit(False)).alias("any_hns"))
    out = counts.where("bucket_count + account_count > 0")
    for df, col in ((firsts(s3), "buckets"), (firsts(az), "accounts")):
        out = out.join(joined(df, col), "payload_id", "left")
    return out


def storage_values(assets: DataFrame) -> DataFrame:
    """Distinct regions, versioning states and locations per payload, long form.

    One row per value with its place of first appearance; nothing is collected or cut.
    """
    s3, az = assets.where("service = 's3'"), assets.where("service = 'storage_accounts'")
    sets = [(s3, "regions", F.coalesce(config_text("Region"), config_text("region"))), (s3, "versioning", config_text("Versioning")),
            (az, "locations", F.coalesce(config_text("Location"), config_text("Region")))]
    out = None
    for df, field, value in sets:
        rows = ordered_values(df, value).select("payload_id", F.lit(field).alias("field"), "value", "at")
        out = rows if out is None else out.unionByName(rows)
    return out


def service_examples(items: DataFrame, n: int | None = None, shown: int | None = None) -> DataFrame:
    """Count line and resources (the first ``n``, with ``shown`` targets each, if given) of every service in the first dump."""
    first = items.where("dump_pos = 0")
    counts = first.groupBy("payload_id", "service").agg(F.count("*").alias("n")).select(
        "payload_id", "service", F.lit(0).alias("line"),
        F.concat(F.lit("Discovered "), F.col("n"), F.lit(" active "), F.upper("service"), F.lit(" resources:")).alias("text"))
    parts = [F.concat(F.lit(label), config_text(k), F.lit(end)) for label, k, end in
             (("Runtime: ", "Runtime", ""), ("Memory: ", "MemorySizeMB", "MB"), ("Endpoint: ", "PublicInvokeURL", ""))]
    # Fixed value: the two places that may list targets.
    targets = F.from_json(F.coalesce(config_text("InferredTargets"), config_text("IngestionTargets")), "array<string>")
    parts.append(F.when(F.size(targets) > 0, F.concat(F.lit("Targets: "), F.array_join(tx.leading(targets, shown), ", "))))
    summary = F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("Active"))
    top = first_n(first, ["payload_id", "service"], ["item_pos"], n).select(
        "payload_id", "service", F.col("rn").alias("line"),
        F.concat(F.lit("  - "), F.coalesce("id", F.lit("Unknown")), F.lit(" ("), summary, F.lit(")")).alias("text"))
    return counts.unionByName(top)


def union_scans(scans: list[DataFrame], providers: list[str] | None = None) -> DataFrame:
    """Provider outputs ``(provider, key, item, seq)`` merged, items once per key."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    if providers:
        out = out.where(F.col("provider").isin(*providers))
    return out.groupBy("key", "item").agg(F.min(F.struct("seq", "provider")).alias("f")).select("key", "item", "f.seq", "f.provider")


# --- resource shapes ---------------------------------------------------------------------

def env_targets(env: Column, code_targets: Column) -> Column:
    """struct(targets, confidence) from environment variables and code findings."""
    named = F.map_values(F.map_filter(env, lambda k, v: F.upper(k).rlike("BUCKET|TABLE|QUEUE|URL")))
    code = F.coalesce(code_targets, F.array().cast("array<string>"))
    return F.struct(
        F.array_distinct(F.concat(named, code)).alias("targets"),
        F.when(F.size(code) > 0, "HIGH").when(F.size(named) > 0, "MEDIUM").otherwise("LOW").alias("confidence"))


def trigger_type(arn: Column) -> Column:
    """Service part of an event-source ARN, upper case."""
    return F.upper(F.try_element_at(F.split(arn, ":"), F.lit(3)))


def bucket_posture(block: Column, policy: Column, versioning: Column, encrypted: Column) -> Column:
    """struct of a bucket's exposure (D30); ``block`` is the map of public-access flags."""
    return F.struct(
        (~F.forall(F.map_values(block), lambda x: x)).alias("is_public"), F.coalesce(versioning, F.lit("Disabled")).alias("versioning"),
        F.when(encrypted, "Enabled").otherwise("Disabled").alias("encryption"), policy.isNotNull().alias("has_policy"),
        F.coalesce(F.length(policy), F.lit(0)).alias("policy_length"))


def api_summary(methods: DataFrame) -> DataFrame:
    """Per API: methods, authentication, external URLs and invoke URL.

    ``methods(api_id, region, seq, method, auth, uri)``; the distinct sets hold HTTP verbs and
    integration URLs, which are long-form rows until this last step.
    """
    m = methods.where("method <> 'OPTIONS'")
    outside = F.when(F.col("uri").isNotNull() & ~F.col("uri").contains("amazonaws.com"), F.col("uri"))
    per = m.groupBy("api_id", "region").agg(
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.coalesce(F.max_by("auth", F.when(F.col("auth") != "NONE", F.col("seq"))), F.lit("NONE")).alias("auth"),
        F.coalesce(F.min(outside), F.lit("Unknown/Internal")).alias("first_url"), F.count(outside).alias("external_urls"))
    return per.withColumn("invoke_url", F.concat(F.lit("https://"), "api_id", F.lit(".execute-api."), "region", F.lit(".amazonaws.com/prod")))


def api_external_urls(methods: DataFrame) -> DataFrame:
    """Every external integration URL of every API with its first place, long form."""
    m = methods.where("method <> 'OPTIONS' and uri is not null and not contains(uri, 'amazonaws.com')")
    return m.groupBy("api_id", F.col("uri").alias("url")).agg(F.min("seq").alias("at"))


def azure_shape(resource_id: Column, kind: Column) -> Column:
    """struct(resource_group, is_function_app) of an Azure resource."""
    return F.struct(
        F.when(resource_id.contains("/"), F.try_element_at(F.split(resource_id, "/"), F.lit(5))).otherwise("unknown").alias("resource_group"),
        F.coalesce(F.lower(kind).contains("functionapp"), F.lit(False)).alias("is_function_app"))


def job_document(doc: Column) -> Column:
    """struct(task_keys, source_type, dq_framework) of a job document."""
    v = F.try_parse_json(doc)
    tasks = F.coalesce(F.try_variant_get(v, "$.settings.tasks", "array<variant>"), F.array().cast("array<variant>"))
    clusters = F.coalesce(F.try_variant_get(v, "$.settings.job_clusters", "array<variant>"), F.array().cast("array<variant>"))
    params = F.filter(F.transform(tasks, lambda t: F.try_variant_get(t, "$.notebook_task.base_parameters", "map<string,string>")),
                      lambda m: F.size(m) > 0)
    first = F.try_element_at(params, F.lit(1))
    packages = F.flatten(F.transform(clusters, lambda c: F.transform(
        F.coalesce(F.try_variant_get(c, "$.new_cluster.libraries", "array<variant>"), F.array().cast("array<variant>")),
        lambda lib: F.lower(F.coalesce(F.try_variant_get(lib, "$.pypi.package", "string"), F.lit(""))))))
    named = F.filter(F.transform(packages, lambda p: F.when(p.rlike("great[_-]expectations"), "great_expectations")
                                 .when(p.contains("deequ"), "deequ").when(p.contains("soda"), "soda")), lambda x: x.isNotNull())
    return F.struct(
        F.transform(tasks, lambda t: F.try_variant_get(t, "$.task_key", "string")).alias("task_keys"),
        F.when(first.isNull(), "unknown").otherwise(F.coalesce(F.nullif(first["source_type"], F.lit("")), first["SOURCE_TYPE"], F.lit("unknown"))).alias("source_type"),
        F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("unknown")).alias("dq_framework"))


def task_stream_listing(objects: DataFrame, pattern: str, n: int | None = None) -> DataFrame:
    """Tasks and streams whose name holds the pattern, the first ``n`` each if given, with totals."""
    hits = objects.where(F.upper("name").contains(pattern.upper()))
    total = hits.groupBy("kind").agg(F.count("*").alias("total"))
    return first_n(hits, ["kind"], ["name", "seq"], n).join(total, "kind").select("kind", "name", "seq", (F.col("total") if n is None else F.least("total", F.lit(n))).alias("listed"))
