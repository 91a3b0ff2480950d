"""Payload table: three optional JSON surfaces, their text and key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as tx
from metasift.operators.jsonwalk import as_variant, list_of, object_of, text_of

SURFACES = ("metadata", "config", "raw_json")


def scan_payloads(df: DataFrame) -> DataFrame:
    """VARIANT surfaces beside the original text; a missing surface is an empty object."""
    out = df
    for s in (*SURFACES, "entities"):
        if s in df.columns:
            out = out.withColumn(f"{s}_v", as_variant(F.col(s)))
    return out


def payload_text(df: DataFrame) -> Column:
    """Lower-case text of all parts, from the JSON as delivered, in one line: rules look across line breaks."""
    return F.regexp_replace(F.lower(F.concat_ws(" ", *[F.col(s) for s in (*SURFACES, "entities") if s in df.columns])), r"[\r\n]+", " ")


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("txt", payload_text(df))


def truthy_scalar(v: Column) -> Column:
    """Text of a scalar that is not empty, zero, false or null; null otherwise."""
    return truthy_text(F.schema_of_variant(v), v)


def truthy_text(kind: Column, v: Column) -> Column:
    text = text_of(v)
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.nullif(text, F.lit("false")))
        .when(kind.rlike("^(OBJECT|ARRAY|VOID)"), None)
        .otherwise(F.when(text.try_cast("double") != 0, text))
    )


def with_lookups(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add per-surface maps of truthy scalars, parsed once per row, for :func:`find_key`.

    With ``keys`` the maps hold these alone, in any case: all that is looked up, where a caller knows it.
    """
    wanted = None if keys is None else sorted({k.lower() for k in keys})

    def scalars(s: str) -> Column:
        members = object_of(as_variant(F.col(s)))
        if wanted is not None:
            members = F.map_filter(members, lambda k, _: F.lower(k).isin(*wanted))
        typed = F.transform_values(members, lambda _, v: F.struct(F.schema_of_variant(v).alias("k"), v.alias("v")))
        texts = F.transform_values(typed, lambda _, x: truthy_text(x["k"], x["v"]))
        return F.coalesce(F.map_filter(texts, lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))

    return df.select("*", *[scalars(s).alias(f"{s}_m") for s in SURFACES]).select(
        "*", *[F.transform(F.map_keys(f"{s}_m"), F.lower).alias(f"{s}_k") for s in SURFACES])


def find_key(*keys: str) -> Column:
    """First value of any key: surface by surface, exact spelling before any-case."""
    arms = []
    for s in SURFACES:
        arms += [f"{s}_m['{k}']" for k in keys]
        arms += [f"try_element_at(map_values({s}_m), cast(nullif(array_position({s}_k, '{k.lower()}'), 0) as int))"
                 for k in keys]
    return F.expr(f"coalesce({', '.join(arms)})")


def find_in_inventory(assets: DataFrame, keys: list[str]) -> DataFrame:
    """First inventory value of any key per payload: item order, key order, configuration first.

    ``assets`` holds ``payload_id, dump_pos, service, item_pos, id, configuration`` (JSON text).
    The minimum of (item, key) structs combines map-side, so a payload with very many
    assets costs one row per task.
    """
    m = object_of(as_variant(F.col("configuration")))
    cands = F.array_compact(
        F.array(*[
            F.when(truthy_scalar(F.try_element_at(m, F.lit(k))).isNotNull(),
                   F.struct(F.lit(i).alias("rank"), truthy_scalar(F.try_element_at(m, F.lit(k))).alias("value")))
            for i, k in enumerate(keys)
        ])
    )
    best = assets.select("payload_id", "dump_pos", "service", "item_pos", F.array_min(cands).alias("c")).where(
        "c is not null"
    )
    return best.groupBy("payload_id").agg(
        F.min_by("c.value", F.struct("dump_pos", "service", "item_pos")).alias("value")
    )


def find_anywhere(payloads: DataFrame, assets: DataFrame, *keys: str) -> DataFrame:
    """P02 with its last arm: the surfaces, then the discovered inventory."""
    inv = find_in_inventory(assets, list(keys)).withColumnRenamed("value", "inv")
    return (
        with_lookups(payloads)
        .select("payload_id", find_key(*keys).alias("v"))
        .join(inv, "payload_id", "left")
        .select("payload_id", F.coalesce("v", "inv").alias("value"))
    )


def search_terms(limit: int | None = None) -> Column:
    """Ordered distinct lookup terms, the first ``limit`` if given, of a payload prepared by :func:`scan_payloads`."""
    def text(s: str, k: str) -> Column:
        v = F.try_variant_get(F.col(f"{s}_v"), f"$.{k}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.nullif(text_of(v), F.lit("")))

    keys = ["name", "pipeline_name", "job_name", "flow_name", "dataset"]
    terms = [text(s, k) for k in keys for s in SURFACES]
    terms.append(F.coalesce(text("metadata", "platform"), text("raw_json", "platform")))
    return tx.leading(F.array_distinct(F.array_compact(F.array(*terms))), limit)


def import_target(doc: Column) -> Column:
    """Which surface an uploaded document belongs to."""
    keys = F.transform(F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>")), F.lower)
    text = F.lower(doc)

    def has(*names: str) -> Column:
        return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))

    raw = has("raw_cloud_dump", "activities", "definition", "type") | text.contains("pipeline-content.json") \
        | text.contains("datafactory") | text.contains("fabric")
    cfg = has("source", "destination", "connections", "input", "output", "schedule")
    return F.when(raw, "raw_json").when(cfg, "config").otherwise("metadata")


def platform_hint(doc: Column) -> Column:
    """Platform an uploaded document speaks of, first match wins."""
    t = F.lower(doc)

    def any_of(*words: str) -> Column:
        out = t.contains(words[0])
        for w in words[1:]:
            out = out | t.contains(w)
        return out

    return (
        F.when((F.get_json_object(doc, "$.type") == "adf_pipeline") | any_of("datafactory"), "adf")
        .when(any_of("fabric", "pipeline-content.json", "workspaceid"), "fabric")
        .when(any_of("glue", "lambda", "apigateway"), "aws")
        .when(any_of("bigquery", "gcp", "cloud run"), "gcp")
    )
