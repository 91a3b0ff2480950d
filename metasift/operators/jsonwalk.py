"""Walk JSON documents into path rows with VARIANT expressions only (no shuffle, no Python)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.session import cut_lineage, shuffled

#: Levels that one statement expands; deeper documents go on in rounds.
LEVELS = 12


def as_variant(doc: Column) -> Column:
    """JSON text to VARIANT; null text and invalid text give an empty object."""
    return F.coalesce(F.try_parse_json(doc), F.parse_json(F.lit("{}")))


def object_of(v: Column) -> Column:
    """The variant's members, or null when it is not an object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def list_of(v: Column) -> Column:
    """The variant's elements, or null when it is not an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    s = F.schema_of_variant(v)
    return (
        F.when(object_of(v).isNotNull(), "object")
        .when(list_of(v).isNotNull(), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .otherwise("number")
    )


def leaf_kind(v: Column) -> Column:
    """:func:`kind_of` for values whose schema is cheap to tell: scalars and flat lists."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("number")
    )


def walk(
    df: DataFrame,
    doc: str,
    ids: list[str],
    *,
    max_depth: int | None = None,
    containers: bool = False,
    list_leaves: bool = False,
    keep_empty: bool = False,
    root: str = "",
) -> DataFrame:
    """One row per JSON leaf, and per object/array too with ``containers``.

    Columns: the ids, ``path``, ``parent``, ``key``, ``depth``, ``kind``, ``value``
    (JSON text) and ``ord``, which sorts a document's rows depth first by array position,
    then key.  ``max_depth`` asks for a cut-off; without it documents are walked at any depth:
    a document that may nest deeper than one statement reaches is expanded in rounds, each
    written and holding only what is still open.  ``keep_empty`` keeps ``{}`` (and ``[]``)
    as leaves.
    """
    if max_depth is None:
        deep = may_nest_deeper(F.col(doc), LEVELS)
        if df.where(deep).limit(1).count():
            options = {"containers": containers, "list_leaves": list_leaves, "keep_empty": keep_empty, "root": root}
            flat = walk(df.where(~deep), doc, ids, max_depth=LEVELS, **options)
            return flat.unionByName(_finish(_walk_rounds(_start(df.where(deep), doc, ids, root), ids, containers, list_leaves), ids, containers, list_leaves, keep_empty))
        max_depth = LEVELS
    state = _expand(_start(df, doc, ids, root), ids, max_depth, containers, list_leaves)
    return _finish(state, ids, containers, list_leaves, keep_empty)


def may_nest_deeper(doc: Column, levels: int) -> Column:
    """Whether brackets outside strings may nest deeper than ``levels``; innermost pairs are removed level by level."""
    brackets = F.regexp_replace(doc, r'"(?:[^"\\]|\\.)*+"|[^\[\]{}"]++', "")
    for _ in range(levels):
        brackets = F.regexp_replace(brackets, r"\{\}|\[\]", "")
    many = F.length(doc) - F.length(F.translate(doc, "{[", "")) > levels
    return F.coalesce(F.when(many, brackets != "").otherwise(F.lit(False)), F.lit(False))


def _start(df: DataFrame, doc: str, ids: list[str], root: str) -> DataFrame:
    """Every document as one open row."""
    step = "array<struct<pos:int,key:string>>"
    return df.select(
        *ids,
        F.lit(root).alias("path"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("key"),
        F.lit(0).alias("depth"),
        F.array().cast(step).alias("ord"),
        # Generating the parsed value keeps the filter from parsing the text a second time.
        F.explode(F.array(F.try_parse_json(F.col(doc)))).alias("v"),
        F.lit(True).alias("open"),
    ).where("v is not null")


def _walk_rounds(start: DataFrame, ids: list[str], containers: bool, list_leaves: bool) -> DataFrame:
    """Expand until nothing is open; a round carries only the rows that the one before left open."""
    done, state = None, start
    while True:
        state = cut_lineage(_expand(state, ids, 4, containers, list_leaves))
        closed = state.where("not open")
        done = closed if done is None else done.unionByName(closed)
        state = state.where("open")
        if state.isEmpty():
            return done


def _expand(start: DataFrame, ids: list[str], levels: int, containers: bool, list_leaves: bool) -> DataFrame:
    """``levels`` more levels under the open rows."""
    # Each round expands the open containers by one level; four rounds make one statement.
    keep = ", ".join(f"s.`{c}`" for c in ids)
    is_object, is_list = (f"try_variant_get(v, '$', '{t}') is not null" for t in ("map<string,variant>", "array<variant>"))
    state, query = start, "{state}"
    for n in range(1, levels + 1):
        if containers:
            query = f"(select *, explode(if(open and ({is_object} or {is_list}), array(0, 2), array(1))) as t from {query})"
            source, last = "t = 2", "where s.t <> 2 or e.pos is not null"
        else:
            source, last = f"open and {is_object}" if list_leaves else "open", ""
        query = f"""(select {keep},
            case when e.pos is null then s.path when e.key is null then concat(s.path, '[', e.pos, ']')
                 when s.path = '' then e.key else concat(s.path, '.', e.key) end as path,
            if(e.pos is null, s.parent, s.path) as parent,
            if(e.pos is null, s.key, coalesce(e.key, concat('[', e.pos, ']'))) as key,
            if(e.pos is null, s.depth, s.depth + 1) as depth,
            if(e.pos is null, s.ord, concat(s.ord, array(named_struct(
                'pos', if(e.key is null, e.pos, 0), 'key', coalesce(e.key, ''))))) as ord,
            coalesce(e.value, s.v) as v, e.pos is not null as open
            from (select *, if({source}, v, null) as src from {query}) s, lateral variant_explode_outer(s.src) e {last})"""
        if n % 4 == 0 or n == levels:
            state, query = start.sparkSession.sql(f"select * from {query}", state=state), "{state}"
    return state


def _finish(state: DataFrame, ids: list[str], containers: bool, list_leaves: bool, keep_empty: bool) -> DataFrame:
    v = F.col("v")
    kind = kind_of(v) if containers else leaf_kind(v)
    out = state.select(*ids, "path", "parent", "key", "depth", kind.alias("kind"), F.to_json(v).alias("value"), "ord")
    if containers or keep_empty:
        return out
    return out.where("kind <> 'object'" if list_leaves else "kind not in ('object', 'array')")


def plain(value: Column, kind: Column) -> Column:
    """Leaf text without JSON quoting; null for JSON null."""
    return F.when(kind == "null", F.lit(None).cast("string")).otherwise(
        F.try_variant_get(F.try_parse_json(value), "$", "string")
    )


def holding(df: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """Documents whose text holds one of the keys; an escaped text is kept to be safe."""
    text = F.lower(F.col(doc))
    cond = text.contains("\\u")
    for k in keys:
        cond = cond | text.contains(f'"{k.lower()}"')
    return df.where(cond)


def collect_values(df: DataFrame, doc: str, ids: list[str], key: str, max_depth: int | None = None) -> DataFrame:
    """Every value under ``key`` (any case) at any level, in walk order.

    Documents whose text does not hold the key at all are skipped before the walk.
    """
    if max_depth is None:
        return seek(df, doc, ids, [key])
    return walk(holding(df, doc, [key]), doc, ids, containers=True, max_depth=max_depth).where(F.lower("key") == key.lower())


def seek(df: DataFrame, doc: str, ids: list[str], keys: list[str]) -> DataFrame:
    """The rows of :func:`walk` with containers whose key, in any case, is one of ``keys``.

    Only containers whose text holds a key are opened.  Rounds go on while there is such a container, so no depth is
    tested beforehand; each writes what was found and what is still open, seldom more than the values wanted.
    """
    wanted = [k.lower() for k in keys]
    # Member names stand in the text as JSON writes them.
    held = [json.dumps(k, ensure_ascii=False) for k in wanted]
    state, done = _start(holding(df, doc, keys), doc, ids, ""), None
    while True:
        state = cut_lineage(_seek(state, ids, LEVELS, wanted, held))
        closed = state.where("not open")
        done = closed if done is None else done.unionByName(closed)
        state = state.where("open")
        if state.isEmpty():
            return _finish(done, ids, True, False, False)


def _seek(start: DataFrame, ids: list[str], levels: int, wanted: list[str], held: list[str]) -> DataFrame:
    """Rows under wanted keys, closed, and what is left to look into after ``levels`` more levels, open."""
    def text(values: list[str]) -> list[str]:
        return ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]

    keep = ", ".join(f"s.`{c}`" for c in ids)
    hit = f"coalesce(lower(key) in ({', '.join(text(wanted))}), false)"
    holds = " or ".join(f"contains(doc, {v})" for v in text(held))
    # A row stays as itself (0) if its key is wanted, and gives its members (1) if its text holds a key; ``open`` rows were not looked at.
    ways = f"array_compact(array(if({hit}, 0, null), if(open and exists(array(lower(to_json(v))), doc -> {holds}), 1, null)))"
    state, query = start, "{state}"
    for n in range(1, levels + 1):
        query = f"""(select {keep},
            case when e.pos is null then s.path when e.key is null then concat(s.path, '[', e.pos, ']')
                 when s.path = '' then e.key else concat(s.path, '.', e.key) end as path,
            if(e.pos is null, s.parent, s.path) as parent,
            if(e.pos is null, s.key, coalesce(e.key, concat('[', e.pos, ']'))) as key,
            if(e.pos is null, s.depth, s.depth + 1) as depth,
            if(e.pos is null, s.ord, concat(s.ord, array(named_struct(
                'pos', if(e.key is null, e.pos, 0), 'key', coalesce(e.key, ''))))) as ord,
            coalesce(e.value, s.v) as v, e.pos is not null as open
            from (select *, if(t = 1, v, null) as src from (select *, explode({ways}) as t from {query})) s, lateral variant_explode_outer(s.src) e
            where s.t = 0 or e.pos is not null)"""
        if n % 4 == 0 or n == levels:
            state, query = start.sparkSession.sql(f"select * from {query}", state=state), "{state}"
    return state


def first_key_value(df: DataFrame, doc: str, ids: list[str], key: str) -> DataFrame:
    """First value under ``key`` in walk order."""
    hits = collect_values(df, doc, ids, key).where("kind <> 'null'")
    return hits.groupBy(*ids).agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord")).drop("ord")


def flatten_paths(df: DataFrame, doc: str, ids: list[str], list_leaves: bool = False) -> DataFrame:
    """Leaf table: ``a.b[0].c`` paths (P06), or lists kept whole."""
    return walk(df, doc, ids, list_leaves=list_leaves).where("path <> ''")


def is_missing(value: Column) -> Column:
    """Null, '', [] or {} as JSON text."""
    return value.isNull() | value.isin("null", '""', "[]", "{}")


def drop_empty(leaves: DataFrame, also_unknown: bool = False) -> DataFrame:
    """Leaf rows that hold something; 0 and false stay (P10)."""
    out = leaves.where(~is_missing(F.col("value")))
    return out.where("value <> '\"unknown\"'") if also_unknown else out


def get_by_path(leaves: DataFrame, ids: list[str], path: str) -> DataFrame:
    """Value at a dotted path per document; documents without it give no row."""
    return leaves.where(F.col("path") == path).select(*ids, "value", "kind")


def set_by_path(leaves: DataFrame, ids: list[str], updates: DataFrame) -> DataFrame:
    """Write ``updates(ids, path, value, kind)`` into a leaf table.

    Whatever lay at the path, under it, or as a scalar above it is replaced.
    Every path is looked up under its own prefixes, so the match is an equi-join.
    """
    u = updates.select(*ids, "path", "value", "kind")
    exact = leaves.withColumn("at", F.explode(path_prefixes(F.col("path")))).join(
        shuffled(u.select(*ids, F.col("path").alias("at")).distinct()), [*ids, "at"], "left_semi"
    ).select(*ids, "path").distinct()
    above = u.select(*ids, F.explode(path_prefixes(F.col("path"))).alias("path")).distinct()
    return (
        leaves.select(*ids, "path", "value", "kind")
        .join(shuffled(exact), [*ids, "path"], "left_anti")
        .join(shuffled(above), [*ids, "path"], "left_anti")
        .unionByName(u)
    )


def path_prefixes(path: Column) -> Column:
    """A dotted/indexed path and all its ancestors, e.g. a.b[0] -> a, a.b, a.b[0]."""
    parts = F.split(F.regexp_replace(path, r"\[", ".["), r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), k), "."), r"\.\[", "["),
    )


def flatten_strings(v: Column) -> Column:
    """Strings trimmed, numbers as text, lists flattened two levels, first occurrence kept."""
    def texts(x: Column) -> Column:
        return F.when(
            object_of(x).isNull() & list_of(x).isNull() & (F.schema_of_variant(x) != "BOOLEAN"),
            F.nullif(F.trim(text_of(x)), F.lit("")),
        )

    inner = F.flatten(F.transform(F.coalesce(list_of(v), F.array(v)),
                                  lambda x: F.coalesce(list_of(x), F.array(x))))
    inner = F.flatten(F.transform(inner, lambda x: F.coalesce(list_of(x), F.array(x))))
    return F.array_distinct(F.array_compact(F.transform(inner, texts)))
