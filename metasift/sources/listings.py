"""File listings, definition parts and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.operators.lineage import first_n


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of all files below a folder, without reading their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def source_tree(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Repository markers of ``files(root, path)``, long form ``(root, kind, value)``.

    Kinds: tag, file, dir, folder, evidence.  Paths below a skipped folder, or deeper than
    ``max_depth`` folders if given, do not count.
    """
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    skip = F.array(*[F.lit(d) for d in rules.SKIP_DIRS])
    f = files.select("root", "path", F.element_at(parts, -1).alias("name"), dirs.alias("dirs")).where(
        ~F.arrays_overlap("dirs", skip) & (F.lit(True) if max_depth is None else F.size("dirs") <= max_depth))
    name, parent = F.lower("name"), F.lower(F.try_element_at("dirs", F.lit(-1)))
    folder = F.array_join("dirs", "/")
    none = F.array().cast("array<string>")
    py = name.endswith(".py")

    def lookup(key: Column, table: dict[str, list[str]]) -> Column:
        out = none
        for k, tags in table.items():
            out = F.when(key == k, F.array(*[F.lit(t) for t in tags])).otherwise(out)
        return out

    marked = lookup(name, rules.MARKER_FILES)
    tags = (F.when(F.size(marked) > 0, marked).when((parent == "dags") & py, F.array(F.lit("Apache Airflow DAGs")))
            .when(F.lower(folder).contains("glue") & py, F.array(F.lit("AWS Glue Jobs"))).otherwise(none))
    why = (F.when(F.size(marked) > 0, F.concat(F.lit("File `"), "path", F.lit("` → "), F.array_join(marked, ", ")))
           .when(parent == "dags", F.concat(F.lit("DAG candidate `"), "path", F.lit("`"))).otherwise(F.concat(F.lit("Glue-style script `"), "path", F.lit("`"))))
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    is_spec = (F.size(marked) > 0) & name.rlike(r"\.(yml|yaml|tf|toml)$")
    from_files = f.withColumns({"tags": tags, "why": why, "spec": F.when(is_spec, F.when(folder == "", ".").otherwise(folder))}).where(F.size("tags") > 0).select(
        "root", F.explode(F.concat(F.transform("tags", lambda t: row("tag", t)), F.array(row("file", F.col("path")), row("evidence", F.col("why"))),
                                   F.when(F.col("spec").isNotNull(), F.array(row("folder", F.col("spec")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))).alias("r"))
    d = f.where(F.size("dirs") > 0).select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda k: F.array_join(F.slice("dirs", F.lit(1), k), "/"))).alias("dir")).distinct()
    dtags = lookup(F.lower(F.element_at(F.split("dir", "/"), -1)), rules.MARKER_DIRS)
    from_dirs = d.withColumn("tags", dtags).where(F.size("tags") > 0).select("root", F.explode(F.concat(
        F.transform("tags", lambda t: row("tag", t)), F.array(row("dir", F.col("dir")), row("folder", F.col("dir")), row("evidence", F.concat(
            F.lit("Directory signal `"), F.col("dir"), F.lit("/` → "), F.array_join("tags", ", ")))))).alias("r"))
    return from_files.unionByName(from_dirs).select("root", "r.*").distinct()


def framework_set(tree: DataFrame) -> DataFrame:
    """Sorted distinct tags per root (W09); the tags come from the fixed marker tables."""
    return tree.where("kind = 'tag'").groupBy("root").agg(F.array_sort(F.collect_set("value")).alias("frameworks"))


def cap_with_marker(files: DataFrame, n: int) -> DataFrame:
    """First n paths per root, and a note where there were more."""
    top = first_n(files.select("root", "path"), ["root"], ["path"], n).select("root", "path")
    more = files.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > n).select(
        "root", F.lit(f"Stopped recording file paths after {n} entries (cap).").alias("path"))
    return top.unionByName(more)


def list_objects(keys: DataFrame, prefix: str, n: int) -> DataFrame:
    """Object keys below a prefix, the prefix stripped, at most n, with the truncation flag."""
    hits = keys.where(F.col("key").startswith(prefix) & ~F.col("key").endswith("/"))
    top = hits.select(F.ltrim(F.expr(f"substring(key, {len(prefix) + 1})"), F.lit("/")).alias("name"), "key").orderBy("key").limit(n)
    count = top.agg(F.count("*").alias("count"))
    return top.select("name", count.scalar().alias("count"), (count.scalar() >= n).alias("truncated"))


def list_names(names: DataFrame, n: int, prefix: str = "", schema: str | None = None) -> DataFrame:
    """Sorted names with an optional schema and prefix, at most n."""
    out = names.where(F.col("schema") == schema) if schema is not None else names
    return out.where(F.col("name").startswith(prefix)).select("name").orderBy("name").limit(n)


def api_names(responses: DataFrame, doc: str, ids: list[str], n: int | None = None) -> DataFrame:
    """Names that an API response offers, ``(ids, pos, name)``: paths of an OpenAPI document, else the keys of a list's first item or of the object.

    Names stand in their sorted order; the first ``n`` if given.  A response that is neither gives no rows.
    """
    def keys(path: str) -> Column:
        return F.map_keys(F.try_variant_get(F.try_parse_json(F.col(doc)), path, "map<string,variant>"))

    names = F.array_sort(F.coalesce(keys("$.paths"), keys("$[0]"), keys("$")))
    return responses.select(*ids, F.posexplode(names if n is None else F.slice(names, 1, n)).alias("pos", "name"))


def decode_text(raw: Column) -> Column:
    """Base64 text decoded when it is valid UTF-8, else the text as it is."""
    return F.coalesce(F.try_validate_utf8(F.try_to_binary(raw, F.lit("base64")).cast("string")), raw)


def definition_parts(items: DataFrame, doc: str = "definition") -> DataFrame:
    """Parts of item definitions as ``(item_id, path, document)``; document is JSON text."""
    v = F.try_parse_json(F.col(doc))
    parts = F.coalesce(F.try_variant_get(v, "$.definition.parts", "array<variant>"), F.try_variant_get(v, "$.parts", "array<variant>"))
    p = F.col("p")
    raw = F.coalesce(*[F.nullif(F.try_variant_get(p, f"$.{k}", "string"), F.lit("")) for k in ("payload", "content", "data", "payloadBase64")])
    text = decode_text(raw)
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    rows = items.select("item_id", F.explode(parts).alias("p")).select("item_id", F.nullif(F.try_variant_get(p, "$.path", "string"), F.lit("")).alias("path"), text.alias("text"))
    return rows.where("path is not null and text is not null").select(
        "item_id", "path", F.coalesce(F.to_json(F.try_parse_json("text")), quoted).alias("document"))


def salvage_json(text: Column) -> Column:
    """JSON object inside free text: reasoning blocks out, first ``{`` to last ``}``, null if it does not parse."""
    body = F.regexp_extract(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(\{[\s\S]*\})", 1)
    return F.to_json(F.try_parse_json(F.nullif(body, F.lit(""))))


def truncate_text(text: Column, n: int = 15000) -> Column:
    """Text cut at n characters with a marker."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("... [truncated]"))).otherwise(text)
