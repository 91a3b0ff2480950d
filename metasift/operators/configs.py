"""Configuration documents as leaf tables: diff, reconcile, merge.

A leaf table holds ``config_id, path, kind, value, ord`` (``value`` is JSON text, ``ord`` the
list of steps).  Two or three sides meet by grouping their union on ``(config_id, path)``:
one shuffle, spread over all paths of all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.functions import text as tx
from metasift.operators.documents import assemble, quoted
from metasift.operators.jsonwalk import is_missing, path_prefixes, plain, walk
from metasift.session import cut_lineage, shuffled

ID = "config_id"


def leaves(df: DataFrame, doc: str, list_leaves: bool = True) -> DataFrame:
    """Leaf table of one JSON column; lists whole, empty objects kept."""
    out = walk(df, doc, [ID], list_leaves=list_leaves, keep_empty=list_leaves)
    return out.where("path <> ''").select(ID, "path", "kind", "value")


def sides(**tables: DataFrame) -> DataFrame:
    """Outer-join leaf tables on (config_id, path) by one grouped union: a struct(kind, value) per side."""
    parts = [t.select(ID, "path", F.lit(s).alias("side"), F.struct("kind", "value").alias("v"))
             for s, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(ID, "path").agg(
        *[F.max(F.when(F.col("side") == s, F.col("v"))).alias(s) for s in tables])


def same_value(a: Column, b: Column) -> Column:
    """Exact equality of two leaf structs, numbers by value."""
    number = (a["kind"] == "number") & (b["kind"] == "number")
    return F.when(number, a["value"].try_cast("double") == b["value"].try_cast("double")).otherwise(
        (a["kind"] == b["kind"]) & (a["value"] == b["value"]))


def diff_flat(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """match / mismatch / added / removed per indexed leaf path."""
    j = sides(b=baseline, c=candidate)
    b, c = F.col("b"), F.col("c")
    status = (F.when(b.isNull(), "added").when(c.isNull(), "removed")
              .when(same_value(b, c), "match").otherwise("mismatch"))
    return j.select(ID, "path", status.alias("status"), b["value"].alias("baseline_val"), c["value"].alias("candidate_val"))


def diff_summary(diff: DataFrame, names: list[str]) -> DataFrame:
    """Counts per status and document."""
    return diff.groupBy(ID).agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])


def diff_tree(left: DataFrame, right: DataFrame, doc: str, max_depth: int | None = None) -> DataFrame:
    """Node diff (M14): one-sided subtrees appear once at their root, strings compare loosely.

    Objects and lists of objects nest; other list elements compare whole.
    """
    cols = [ID, "path", "parent", "depth", "kind", "value", "ord"]

    def nodes(df: DataFrame, side: str) -> DataFrame:
        w = walk(df, doc, [ID], containers=True, root="root", max_depth=max_depth)
        return w.select(*cols).withColumn("side", F.lit(side))

    both = nodes(left, "l").unionByName(nodes(right, "r"))
    j = both.groupBy(ID, "ord").agg(
        F.first("path").alias("path"), F.first("depth").alias("depth"),
        *[F.max(F.when(F.col("side") == s, F.struct("kind", "value"))).alias(s) for s in ("l", "r")])
    l, r = F.col("l"), F.col("r")
    in_list = F.element_at("ord", -1)["key"] == ""
    loose = F.coalesce(tx.equals_loose(l["value"], r["value"], l["kind"], r["kind"]), F.lit(False))
    both_objects = (l["kind"] == "object") & (r["kind"] == "object")
    both_lists = (l["kind"] == "array") & (r["kind"] == "array")
    status = (
        F.when(l.isNull(), "added").when(r.isNull(), "removed")
        .when(both_objects | (both_lists & ((F.col("depth") == 0) | ~in_list)), "nested")
        .when((F.col("depth") > 0) & ~in_list & (l["kind"] != r["kind"]), "type_change")
        .when(loose, "match").otherwise("mismatch")
    )
    rows = j.select(ID, "ord", "path", "depth", status.alias("status"), l["value"].alias("left_val"),
                    r["value"].alias("right_val"))
    # A node shows only when every ancestor nests; others are inside an already reported subtree.
    closed = rows.where("status <> 'nested'").select(ID, F.col("ord").alias("above"))
    hidden = (
        rows.where("depth > 1")
        .select(ID, "ord", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth") - 1),
                                                 lambda k: F.slice("ord", F.lit(1), k))).alias("above"))
        .join(shuffled(closed), [ID, "above"], "left_semi").select(ID, "ord").distinct()
    )
    return rows.where("depth > 0").join(shuffled(hidden), [ID, "ord"], "left_anti").select(
        ID, "path", "depth", "ord", "status",
        F.when(F.col("status") != "nested", F.col("left_val")).alias("left_val"),
        F.when(F.col("status") != "nested", F.col("right_val")).alias("right_val"))


def tree_summary(tree: DataFrame) -> DataFrame:
    """Counts of a node diff (A02): leaves at any depth; top-level nests once, and once more with children."""
    parents = tree.where("depth = 2").select(ID, F.slice("ord", 1, 1).alias("ord")).distinct().withColumn(
        "has_children", F.lit(1))
    t = tree.join(shuffled(parents), [ID, "ord"], "left")
    return t.groupBy(ID).agg(
        *[F.count_if(F.col("status") == n).alias(n) for n in ("match", "mismatch", "added", "removed", "type_change")],
        F.sum(F.when((F.col("status") == "nested") & (F.col("depth") == 1),
                     1 + F.coalesce("has_children", F.lit(0))).otherwise(0)).cast("bigint").alias("nested"))


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of the path sets of two documents."""
    return a.select(ID, "path").union(b.select(ID, "path")).distinct()


def meet(**tables: DataFrame) -> DataFrame:
    """Like :func:`sides`, plus a flag per side for "has leaves below this path".

    Every leaf also marks its ancestors, so one grouped union answers both questions.
    """
    parts = []
    for s, t in tables.items():
        at = F.transform(path_prefixes(F.col("path")),
                         lambda p: F.struct(p.alias("path"), (p != F.col("path")).alias("below")))
        parts.append(t.select(ID, F.lit(s).alias("side"), F.struct("kind", "value").alias("v"), F.explode(at).alias("at")))
    rows = reduce(DataFrame.unionByName, parts).select(ID, "side", "v", "at.path", "at.below")
    aggs = []
    for s in tables:
        mine = F.col("side") == s
        aggs += [F.max(F.when(mine & ~F.col("below"), F.col("v"))).alias(s),
                 F.coalesce(F.max(F.when(mine, F.col("below"))), F.lit(False)).alias(f"{s}_below")]
    return rows.groupBy(ID, "path").agg(*aggs)


def uncovered(rows: DataFrame, blockers: DataFrame) -> DataFrame:
    """Leaf rows that lie under none of the blocking paths."""
    hidden = (
        rows.select(ID, "path", F.explode(path_prefixes(F.col("path"))).alias("at"))
        .join(shuffled(blockers.select(ID, F.col("path").alias("at"))), [ID, "at"], "left_semi").select(ID, "path").distinct()
    )
    return rows.join(shuffled(hidden), [ID, "path"], "left_anti")


def overlay(winner: DataFrame, loser: DataFrame) -> DataFrame:
    """Recursive merge of two leaf tables: objects merge, everything else of the winner replaces.

    A losing leaf goes when the winner has its path, a leaf above it, or anything below it;
    an empty object of the winner gives way where the loser has members.  The grouped union
    is written once, because three branches read it and merges nest.
    """
    g = cut_lineage(meet(w=winner, l=loser))
    hollow = F.col("w.kind") == "object"
    won = g.where(F.col("w").isNotNull() & ~(hollow & F.col("l_below"))).select(ID, "path", "w.kind", "w.value")
    lost = g.where(F.col("w").isNull() & F.col("l").isNotNull() & ~F.col("w_below")).select(ID, "path", "l.kind", "l.value")
    return won.unionByName(uncovered(lost, g.where(F.col("w").isNotNull() & ~hollow & F.col("l_below"))))


def reconcile(baseline: DataFrame, candidate: DataFrame, strategy: str = "candidate_wins") -> DataFrame:
    """candidate_wins, baseline_wins or manual."""
    if strategy == "candidate_wins":
        return overlay(candidate, baseline)
    if strategy == "baseline_wins":
        return overlay(baseline, candidate)
    return baseline.select(ID, "path", "kind", "value")


def apply_overrides(merged: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides ``(config_id, path, kind, value)`` always win; the log keeps the old leaf value."""
    log = overrides.select(ID, "path", F.col("value").alias("to_val")).join(
        merged.select(ID, "path", F.col("value").alias("from_val")), [ID, "path"], "left")
    return overlay(overrides, merged), log.select(ID, "path", "from_val", "to_val")


def change_log(baseline: DataFrame, candidate: DataFrame, merged: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Indexed paths whose sides differ, with the merged result; JSON null counts as absent."""
    j = sides(b=baseline.where("kind <> 'null'"), c=candidate.where("kind <> 'null'"), m=merged.where("kind <> 'null'"))
    b, c = F.col("b"), F.col("c")
    out = j.where((b.isNotNull() | c.isNotNull()) & ~F.coalesce(same_value(b, c), F.lit(False))).select(
        ID, "path", b["value"].alias("baseline_val"), c["value"].alias("candidate_val"), F.col("m")["value"].alias("result_val"))
    return out.join(shuffled(overrides.select(ID, "path")), [ID, "path"], "left_anti") if overrides is not None else out


def json_items(value: Column) -> Column:
    """Elements of a JSON list text as JSON texts."""
    return F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda x: F.to_json(x))


def list_union(first: Column, second: Column) -> Column:
    """Items of both lists in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(first, none), F.coalesce(second, none))


def merge_additive(first: DataFrame, second: DataFrame) -> DataFrame:
    """First wins; objects merge; lists join in order without repeats."""
    lists = sides(a=first.where("kind = 'array'"), b=second.where("kind = 'array'")).where("a is not null and b is not null")
    both = lists.select(ID, "path", F.lit("array").alias("kind"), F.concat(
        F.lit("["), F.array_join(F.array_union(json_items(F.col("a.value")), json_items(F.col("b.value"))), ","),
        F.lit("]")).alias("value"))
    return overlay(both, overlay(first, second))


def three_way_view(extracted: DataFrame, example: DataFrame, final: DataFrame) -> DataFrame:
    """Three sides per path with a changed flag."""
    j = sides(x=extracted, e=example, f=final)
    x, e, f = (F.col(c)["value"] for c in "xef")
    return j.select(ID, "path", x.alias("extracted"), e.alias("example"), f.alias("final"),
                    (~x.eqNullSafe(f) | ~e.eqNullSafe(f)).alias("changed"))


def normalize_config(doc: Column) -> Column:
    """Sections of a config document: plural or singular name, wrong types empty, flow text as object."""
    v = F.try_parse_json(doc)

    def obj(*names: str) -> Column:
        got = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
        ok = [F.when(F.try_variant_get(g, "$", "map<string,variant>").isNotNull(), F.to_json(g)) for g in got]
        return F.coalesce(*ok, F.lit("{}"))

    def arr(name: str) -> Column:
        g = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.try_variant_get(g, "$", "array<variant>").isNotNull(), F.to_json(g)).otherwise("[]")

    flow = F.try_variant_get(v, "$.flow", "variant")
    flow_doc = F.when(F.schema_of_variant(flow) == "STRING",
                      F.to_json(F.struct(F.try_variant_get(flow, "$", "string").alias("text")))).otherwise(obj("flow"))
    return F.struct(
        obj("source_configs", "source_config").alias("source_configs"),
        obj("ingestion_configs", "ingestion_config").alias("ingestion_configs"),
        arr("dq_rules").alias("dq_rules"), flow_doc.alias("flow"),
        arr("missing_fields_analysis").alias("missing_fields_analysis"))


def merge_three_way(extracted: DataFrame, raw: DataFrame, example: DataFrame, section: str) -> tuple[DataFrame, DataFrame]:
    """Raw evidence over extracted over example, per leaf, with the report rows."""
    have = raw.where(~is_missing(F.col("value")))
    wish = example.where(~is_missing(F.col("value")))
    j = cut_lineage(meet(x=extracted, r=have, e=wish))
    x, r, e = F.col("x"), F.col("r"), F.col("e")
    deeper = F.col("r_below") | F.col("e_below")
    gone = F.coalesce(is_missing(x["value"]), F.lit(True)) & ~F.col("x_below")
    now = F.coalesce(r, F.when(~is_missing(x["value"]), x))
    field = F.concat(F.lit(section + "."), F.col("path"))

    def row(cond: Column, action: str, old: Column, new: Column) -> Column:
        return F.when(cond, F.struct(F.lit(action).alias("action"), old.alias("old_value"), new.alias("new_value")))

    none = F.lit(None).cast("string")
    differ = r.isNotNull() & ~gone & ~F.coalesce(same_value(x, r), F.lit(False))
    events = F.array_compact(F.array(
        row(r.isNotNull() & gone, "filled", none, r["value"]),
        row(differ, "corrected", x["value"], r["value"]),
        row(differ, "conflict_raw_wins", none, none),
        row(now.isNotNull(), "from_extracted", none, none),
        row(e.isNotNull() & now.isNull() & ~F.col("x_below"), "from_example", none, e["value"]),
        row(e.isNotNull() & now.isNotNull() & ~same_value(now, e)
            & ~F.coalesce(same_value(r, now), F.lit(False)), "conflict_extracted_kept", none, none),
    ))
    report = j.select(ID, field.alias("field"), F.explode(events).alias("v")).select(ID, "field", "v.*")
    fill = F.when(now.isNull() & ~F.col("x_below") & ~F.col("r_below"), e)
    placed = j.select(ID, "path", F.coalesce(F.when(~F.col("e_below"), r), fill).alias("v"), r.isNotNull().alias("raw"),
                      F.when(~deeper, x).alias("x"))
    strong = placed.where("v is not null").select(ID, "path", "v.kind", "v.value")
    rest = placed.where("v is null and x is not null").select(ID, "path", "x.kind", "x.value")
    return strong.unionByName(uncovered(rest, j.where("r is not null and x_below"))), report


def supported_rules(raw_text: Column, raw_rules: Column) -> Column:
    """Raw-derived rules plus those the raw text itself supports."""
    t = F.lower(raw_text)
    by_text = F.array_compact(F.array(
        F.when(t.contains("count(*)") | t.contains("rowcount"), "row_count_check"),
        F.when(t.contains("is null"), "null_check"),
        F.when(t.contains("duplicate") | t.contains("distinct"), "uniqueness_check"),
        F.when(t.contains("schema"), "schema_check"),
        F.when(t.contains("between") | t.contains("range"), "range_check"),
    ))
    return F.array_union(raw_rules, by_text)


def merge_dq_rules(raw: Column, extracted: Column, example: Column, supported: Column) -> Column:
    """Supported raw rules, else supported extracted ones; supported example rules follow."""
    own = F.array_distinct(F.array_intersect(raw, supported))
    base = F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.array_intersect(extracted, supported)))
    return F.array_union(base, F.array_intersect(example, supported))


def ignored_rules(example: Column, supported: Column) -> Column:
    """Example rules the raw evidence does not support."""
    return F.array_except(example, supported)


def unsupported_rules(final: Column, supported: Column) -> Column:
    """Final rules without support, sorted."""
    return F.array_sort(F.array_except(final, supported))


GATES = " with validation gates"


def sanitize_flow(text: Column) -> Column:
    """Drop notification steps from an arrow text, keep the validation suffix."""
    cut = F.instr(text, GATES)
    head = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    tail = F.when(cut > 0, text.substr(cut, F.length(text))).otherwise("")
    parts = F.filter(F.transform(F.split(head, "->"), lambda p: F.trim(p)),
                     lambda s: (s != "") & ~F.lower(s).rlike(rules.NOTIFICATION_WORDS))
    clean = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " -> "), tail))
    return F.when(F.trim(text) == "", text).otherwise(clean)


def merge_flow(raw: Column, extracted: Column, example: Column) -> Column:
    """First text that is there, sanitised."""
    pick = F.coalesce(*[F.nullif(c, F.lit("")) for c in (raw, extracted, example)])
    return F.when(pick.isNotNull(), sanitize_flow(pick))


def fill_mode(mode: Column, ingestion_type: Column) -> Column:
    """struct(mode, from_input): the user's ingestion type only where no mode was found."""
    own, given = tx.first_nonblank(mode), tx.first_nonblank(ingestion_type)
    return F.struct(F.coalesce(own, given).alias("mode"), (own.isNull() & given.isNotNull()).alias("from_input"))


def correct_destination(destination: Column, raw_destination: Column) -> Column:
    """Notification-like destinations give way to the raw one."""
    return F.when(tx.looks_like_notification(destination), raw_destination).otherwise(destination)


REQUIRED = (
    [f"source_configs.{f}" for f in ("source_type", "service_name", "authentication_type")]
    + [f"source_configs.connection_details.{f}" for f in ("workspaceId", "artifactId", "schema", "table", "endpoint", "path")]
    + [f"ingestion_configs.{f}" for f in ("trigger_type", "frequency", "data_format", "destination")]
)


def missing_reason(field: str, raw_text: Column) -> Column:
    """Why a required field is missing."""
    name = field.rsplit(".", 1)[-1]
    if name == "artifactId":
        return F.lit("Requires external metadata.")
    if name in ("destination", "source_type", "service_name"):
        return F.when(F.lower(raw_text).contains("activities"), "Not present in pipeline JSON.").otherwise(
            "Not derivable from activities.")
    return F.lit("Not present in pipeline JSON.")


def missing_fields(core: DataFrame, final_leaves: DataFrame) -> DataFrame:
    """Required leaves without a value; ``core(config_id, raw_text, dq_rules, flow_text)``."""
    wanted = F.array(*[F.struct(F.lit(f).alias("field"), missing_reason(f, F.col("raw_text")).alias("reason"))
                       for f in REQUIRED])
    need = core.select(ID, F.explode(wanted).alias("w")).select(ID, "w.field", "w.reason")
    have = final_leaves.where(~is_missing(F.col("value"))).select(ID, F.col("path").alias("field"))
    rest = core.select(ID, F.explode(F.array_compact(F.array(
        F.when(F.size("dq_rules") == 0, F.struct(F.lit("dq_rules").alias("field"), F.lit(
            "Not present in pipeline JSON or not derivable from validation activities.").alias("reason"))),
        F.when(F.coalesce("flow_text", F.lit("")) == "", F.struct(F.lit("flow.text").alias("field"), F.lit(
            "Not derivable from activities.").alias("reason"))),
    ))).alias("w")).select(ID, "w.field", "w.reason")
    return need.join(shuffled(have), [ID, "field"], "left_anti").unionByName(rest)


def accuracy(service: Column, final_dest: Column, raw_dest: Column, dq: Column, supported: Column,
             final_flow: Column, raw_flow: Column) -> Column:
    """struct(score, issues) of a final config."""
    bad = F.array_except(dq, supported)
    note = tx.looks_like_notification(final_dest)
    moved = raw_dest.isNotNull() & ~final_dest.eqNullSafe(raw_dest)
    s1 = F.when(F.coalesce(service, F.lit("")) != "", 1.0).otherwise(0.6)
    s2 = F.when(note, 0.0).when(moved, 0.5).otherwise(1.0)
    s3 = F.when(F.size(dq) == 0, 0.9).when(F.size(bad) > 0, 0.4).otherwise(1.0)
    aligned = raw_flow.isNotNull() & final_flow.eqNullSafe(raw_flow)
    s4 = F.when(aligned, 1.0).when(final_flow.isNotNull(), 0.7).otherwise(0.4)
    issues = F.array_compact(F.array(
        F.when(note, "notification destination").when(moved, "destination differs from raw"),
        F.when((F.size(dq) > 0) & (F.size(bad) > 0), "unsupported rules"),
        F.when(~aligned & final_flow.isNotNull() & raw_flow.isNotNull(), "flow differs from raw")
        .when(final_flow.isNull(), "flow missing"),
    ))
    return F.struct(F.round((s1 + s2 + s3 + s4) / 4, 2).alias("score"), issues.alias("issues"))


def derive_from_raw(configs: DataFrame, raw_reports: DataFrame) -> DataFrame:
    """First report of each raw document, else the extracted config.

    ``raw_reports(config_id, seq, destination, flow_text)``; ``configs`` brings the
    extracted values as ``extracted_destination`` and ``extracted_flow``.
    """
    first = raw_reports.groupBy(ID).agg(F.min_by(F.struct("destination", "flow_text"), "seq").alias("r"))
    out = configs.join(shuffled(first), ID, "left")
    got = F.col("r").isNotNull()
    return out.select(
        ID, got.alias("from_raw"),
        F.when(got, F.col("r.destination")).otherwise(F.col("extracted_destination")).alias("destination"),
        F.when(got, F.col("r.flow_text")).otherwise(F.col("extracted_flow")).alias("flow_text"))


def compose_final(example: DataFrame, core: DataFrame) -> DataFrame:
    """Example document overlaid with the final core.

    ``core`` is a leaf table with paths ``source_configs.*``, ``ingestion_configs.*``, ``dq_rules``
    and ``flow.text``.  Core sections replace the example's; linked fields are set only where
    the example left them out; the overlay block repeats the core.  Documents without an
    example stay core only.
    """
    core = cut_lineage(core)
    section = F.regexp_extract("path", r"^[^.\[]+", 0)
    kept = example.where(~section.isin("source_configs", "ingestion_configs", "dq_rules", "flow", "missing_fields_analysis"))
    with_example = example.select(ID).distinct()
    # Core path and the example path it fills when empty.
    links = [
        ("ingestion_configs.trigger_type", "ingestion_overview.triggers.batch"),
        ("ingestion_configs.frequency", "ingestion_overview.triggers.streaming"),
        ("ingestion_configs.destination", "sink_configuration.storage"),
        ("ingestion_configs.data_format", "sink_configuration.format.type"),
        ("dq_rules", "governance_lineage.data_quality_rules"),
        ("flow.text", "governance_lineage.lineage_tracking"),
        ("flow.text", "final_definition"),
    ]
    table = F.array(*[F.struct(F.lit(a).alias("core"), F.lit(b).alias("path")) for a, b in links])
    mine = core.join(shuffled(with_example), ID, "left_semi")
    live = mine.where(~is_missing(F.col("value")))
    filled = live.withColumn("l", F.explode(table)).where("l.core = path").select(ID, F.col("l.path").alias("path"), "kind", "value")
    blocks = [("source_configs.", "source_configuration.pipeline_extracted_source."),
              ("ingestion_configs.", "adf_ingestion_pipeline.pipeline_extracted_ingestion.")]
    copies = [live.where(F.col("path").startswith(a)).select(
        ID, F.concat(F.lit(b), F.expr(f"substring(path, {len(a) + 1})")).alias("path"), "kind", "value") for a, b in blocks]
    defaults = reduce(DataFrame.unionByName, copies, filled)
    block = mine.select(ID, F.concat(F.lit("pipeline_extracted_overlay."), "path").alias("path"), "kind", "value")
    solid = kept.where(~is_missing(F.col("value")))
    doc = overlay(solid, defaults)
    return doc.unionByName(core.select(ID, "path", "kind", "value")).unionByName(block)


SECTIONS = ("source_configs", "ingestion_configs")
DESTINATION, MODE = "ingestion_configs.destination", "ingestion_configs.mode"


def finalize(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final configuration of every row, and the merge report.

    ``configs(config_id, raw, raw_text, extracted, example, ingestion_type)``: three JSON config documents (what raw evidence gives,
    what was extracted, an example), the raw pipeline text and the user's ingestion type.  The first table has config_id,
    ``document`` (VARIANT, nested), destination, dq_rules, unsupported, flow_text, missing (array of struct(field, reason)), score and issues;
    the second config_id, field, action, old_value, new_value.
    """
    names = ("raw", "extracted", "example")
    shaped = cut_lineage(configs.select(ID, "raw_text", "ingestion_type", F.col("example").alias("example_doc"),
                                        *[normalize_config(F.col(n)).alias(n) for n in names]))
    core, report = [], []
    for section in SECTIONS:
        side = {n: leaves(shaped.select(ID, F.col(n)[section].alias("doc")), "doc") for n in names}
        merged, events = merge_three_way(side["extracted"], side["raw"], side["example"], section)
        core.append(merged.select(ID, F.concat(F.lit(section + "."), "path").alias("path"), "kind", "value"))
        report.append(events)
    core = cut_lineage(reduce(DataFrame.unionByName, core))
    text = plain(F.col("value"), F.col("kind"))
    marks = core.where(F.col("path").isin(DESTINATION, MODE, "source_configs.service_name")).groupBy(ID).agg(
        *[F.max(F.when(F.col("path") == p, text)).alias(c) for p, c in ((DESTINATION, "merged"), (MODE, "mode"), ("source_configs.service_name", "service"))])

    def listed(n: str) -> Column:
        return F.coalesce(F.from_json(F.col(n)["dq_rules"], "array<string>"), F.array().cast("array<string>"))

    def flow(n: str) -> Column:
        return F.try_variant_get(F.try_parse_json(F.col(n)["flow"]), "$.text", "string")

    raw_destination = F.try_variant_get(F.try_parse_json(F.col("raw")["ingestion_configs"]), "$.destination", "string")
    supported = supported_rules(F.col("raw_text"), listed("raw"))
    rows = shaped.join(shuffled(marks), ID, "left").select(
        ID, "raw_text", "service", "merged", raw_destination.alias("raw_destination"), supported.alias("supported"),
        F.col("mode").isNull().alias("no_mode"), fill_mode(F.col("mode"), F.col("ingestion_type")).alias("mode"),
        merge_dq_rules(listed("raw"), listed("extracted"), listed("example"), supported).alias("dq_rules"),
        merge_flow(flow("raw"), flow("extracted"), flow("example")).alias("flow_text"), flow("raw").alias("raw_flow"), "example_doc")
    rows = cut_lineage(rows.withColumn("destination", correct_destination(F.col("merged"), F.col("raw_destination"))))
    none = F.lit(None).cast("string")
    moved = ~F.col("destination").eqNullSafe(F.col("merged"))
    report.append(rows.where(moved).select(ID, F.lit(DESTINATION).alias("field"), F.lit("corrected").alias("action"),
                                           quoted(F.col("merged")).alias("old_value"), F.when(F.col("destination").isNotNull(), quoted(F.col("destination"))).alias("new_value")))
    report.append(rows.where("mode.from_input").select(ID, F.lit("ui_inputs.ingestion_type").alias("field"), F.lit("from_example").alias("action"), none.alias("old_value"),
                                                       quoted(F.col("mode.mode")).alias("new_value")))

    def leaf(cond: Column, path: str, kind: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), value.alias("value")))

    gone = F.col("destination").isNull()
    extra = F.array_compact(F.array(
        leaf(moved & ~gone, DESTINATION, "string", quoted(F.col("destination"))), leaf(moved & gone, DESTINATION, "null", F.lit("null")),
        leaf(F.col("mode.from_input"), MODE, "string", quoted(F.col("mode.mode"))),
        leaf(F.lit(True), "dq_rules", "array", F.to_json("dq_rules")),
        leaf(F.col("flow_text").isNotNull(), "flow.text", "string", quoted(F.col("flow_text"))),
        leaf(F.col("flow_text").isNull(), "flow.text", "null", F.lit("null"))))
    added = rows.select(ID, F.explode(extra).alias("x")).select(ID, "x.*")
    replaced = added.select(ID, "path")
    core = core.join(shuffled(replaced), [ID, "path"], "left_anti").unionByName(added)
    gaps = missing_fields(rows, core).groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("field", "reason"))).alias("missing"))  # at most one per required field
    rows = cut_lineage(rows.join(shuffled(gaps), ID, "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<struct<field:string,reason:string>>"))))
    analysis = rows.select(ID, F.lit("missing_fields_analysis").alias("path"), F.lit("array").alias("kind"), F.to_json("missing").alias("value"))
    core = cut_lineage(core.unionByName(analysis))
    example = leaves(rows.select(ID, F.col("example_doc").alias("doc")), "doc")
    documents = assemble(compose_final(example, core), [ID])
    judged = rows.withColumn("a", accuracy(F.col("service"), F.col("destination"), F.col("raw_destination"), F.col("dq_rules"),
                                           F.col("supported"), F.col("flow_text"), F.col("raw_flow")))
    out = judged.join(shuffled(documents), ID).select(
        ID, "document", "destination", "dq_rules", unsupported_rules(F.col("dq_rules"), F.col("supported")).alias("unsupported"), "flow_text", "missing", "a.score", "a.issues")
    return out, reduce(DataFrame.unionByName, [r.select(ID, "field", "action", "old_value", "new_value") for r in report])
