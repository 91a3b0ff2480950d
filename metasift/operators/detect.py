"""Rule detection over payload text and entity rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.operators.jsonwalk import holding, walk
from metasift.operators.payload import with_text

CATEGORIES = ("framework", "source", "ingestion", "dq_rules")
HIT = "array<struct<rule_order:int,label:string,evidence:string>>"


def literal_runs(pattern: str) -> list[str]:
    """The literal runs that every match of ``pattern`` must hold, in order."""
    runs, run = [], ""
    for op, arg in re._parser.parse(pattern):
        if str(op) == "LITERAL":
            run += chr(arg)
        elif str(op) != "AT":
            runs.append(run)
            run = ""
    return [r for r in [*runs, run] if r]


def literal_stem(pattern: str) -> str:
    """Longest literal run every match of ``pattern`` must hold; '' when there is none."""
    return max(literal_runs(pattern), key=len, default="")


def shared_literal(patterns: list[str]) -> str:
    """Longest run of letters and digits that every match of any of ``patterns`` must hold, of four at least or with a digit; '' when there is none."""
    first, *others = [literal_runs(p) for p in patterns]
    parts = {r[i:j] for r in first for i in range(len(r)) for j in range(i + 2, len(r) + 1)}
    fit = [x for x in parts if x.isalnum() and (len(x) > 3 or not x.isalpha()) and all(any(x in r for r in runs) for runs in others)]
    return min(fit, key=lambda x: (-len(x), x), default="")


def neighbours(patterns: list[str]) -> list[tuple[str, list[str]]]:
    """Patterns in their order, next ones that share a literal together with it."""
    groups: list[tuple[str, list[str]]] = []
    for p in patterns:
        shared = shared_literal([*groups[-1][1], p]) if groups else ""
        if shared:
            groups[-1] = (shared, [*groups[-1][1], p])
        else:
            groups.append(("", [p]))
    return groups


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> str:
    """SQL condition: ``rlike`` behind plain ``contains`` of the pattern's literal parts, the longest first.

    The byte search rejects nearly every row, so the regex seldom runs on long texts; a pattern of
    nothing else needs none.
    """
    runs = sorted(dict.fromkeys(literal_runs(pattern)), key=len, reverse=True)
    tests = [f"contains({text}, {sql_text(r)})" for r in runs]
    if not all(str(op) == "LITERAL" for op, _ in re._parser.parse(pattern)):
        tests.append(f"{text} rlike {sql_text(pattern)}")
    return " and ".join(tests)


def rule_hits(text: str, rule_list, evidence: str, base: int = 0, prefilter: bool = True) -> Column:
    """Array of (rule_order, label, evidence), one per rule whose first matching pattern is the evidence.

    ``text`` names a lower-case column.  Patterns are literals, so each compiles once.  The
    prefilter reads a pattern's literal part, which suits the built-in rules; any pattern the
    engine accepts goes without it.
    """
    test = matches if prefilter else lambda t, p: f"{t} rlike {sql_text(p)}"
    hits = []
    for i, (label, patterns) in enumerate(rule_list):
        tried = []
        for shared, some in neighbours(patterns) if prefilter else [("", patterns)]:
            arms = " ".join(
                f"when {test(text, p)} then named_struct('rule_order', {base + i}, 'label', {sql_text(label)}, "
                f"'evidence', {sql_text(f"{evidence} '{p}' → {label}")})" for p in some)
            tried.append(f"case when contains({text}, {sql_text(shared)}) then case {arms} end end" if shared else f"case {arms} end")
        hits.append(f"coalesce({', '.join(tried)})")
    return F.expr(f"array_compact(array({', '.join(hits)}))").cast(HIT)


def suite_hit(text: str, raw: str) -> Column:
    """Expectation-suite marker; a named suite or checkpoint carries its name."""
    arms = []
    for p in rules.SUITE_MARKERS:
        label, extra = "'Great Expectations'", ""
        if p in ("suite_name", "checkpoint_name"):
            name = sql_text(f'(?i)"{p}"\\s*:\\s*"([^"]+)"')
            label = f"concat('Great Expectations Suite: ', regexp_extract({raw}, {name}, 1))"
            extra = f" and {raw} rlike {name}"
        proof = sql_text(f"suite marker '{p}'")
        arms.append(f"when {matches(text, p)}{extra} then named_struct('rule_order', 0, 'label', {label}, "
                    f"'evidence', {proof})")
    return F.expr(f"array_compact(array(case {' '.join(arms)} end))").cast(HIT)


def combination_hits(found: Column, base: int = 1000) -> Column:
    """Extra labels for rules whose required labels are all in ``found``."""
    hits = []
    for i, (need, label) in enumerate(rules.COMBINATION_RULES):
        ok = F.size(F.array_except(F.array(*[F.lit(n) for n in need]), found)) == 0
        hits.append(F.when(ok, F.struct(F.lit(base + i).alias("rule_order"), F.lit(label).alias("label"),
                                        F.lit("combination rule: " + " + ".join(need)).alias("evidence"))))
    return F.array_compact(F.array(*hits)).cast(HIT)


def category_hits(category: str, raw: str = "raw_json") -> Column:
    """All text hits of one category on a frame from :func:`with_text`."""
    txt = "txt"
    if category == "framework":
        return rule_hits(txt, rules.FRAMEWORK_RULES, "pattern match")
    if category == "source":
        return rule_hits(txt, rules.SOURCE_RULES, "source pattern")
    if category == "ingestion":
        return rule_hits(txt, rules.INGESTION_RULES, "ingestion pattern")
    return F.concat(
        suite_hit(txt, raw),
        rule_hits(txt, rules.SQL_CHECK_RULES, "SQL DQ pattern", 200),
        rule_hits(txt, rules.DQ_TOOL_RULES, "custom DQ pattern", 300),
    )


def detect_text(payloads: DataFrame, category: str) -> DataFrame:
    """Long detections of one category from the payload text: narrow, no shuffle."""
    return (
        with_text(payloads)
        .select("payload_id", F.explode(category_hits(category)).alias("h"))
        .select("payload_id", F.lit(category).alias("category"), "h.*")
    )


def scan_expectations(payloads: DataFrame) -> DataFrame:
    """Every expectation_type in raw_json, any level, as a label."""
    hits = walk(holding(payloads, "raw_json", ["expectation_type"]), "raw_json", ["payload_id"]).where("key = 'expectation_type' and kind = 'string'")
    kind = F.regexp_replace("value", '^"|"$', "")
    label = F.concat(F.lit("GE: "), kind)
    for k, v in rules.EXPECTATION_LABELS.items():
        label = F.when(kind == k, v).otherwise(label)
    return (
        hits.groupBy("payload_id", label.alias("label"))
        .agg(F.min("ord").alias("ord"), F.min_by(kind, "ord").alias("kind"))
        .select("payload_id", F.lit("dq_rules").alias("category"), F.lit(100).alias("rule_order"), "label",
                F.concat(F.lit("GE expectation type '"), "kind", F.lit("'")).alias("evidence"))
    )


def map_value(c: Column, table: dict[str, str]) -> Column:
    """Small fixed mapping as a CASE; null when not listed."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def entity_platform(ref: Column) -> Column:
    """Platform text inside a catalog reference."""
    inner = F.regexp_replace(F.split(F.element_at(F.split(ref, "dataPlatform:", -1), -1), ",")[0], r"^\)+|\)+$", "")
    return F.when(ref.contains("dataPlatform:"), inner).otherwise(F.nullif(ref, F.lit("")))


def entity_framework(ref: Column) -> Column:
    """Framework label of an entity's platform, null when unmapped."""
    return map_value(F.lower(entity_platform(ref)), rules.PLATFORM_LABELS)


def classify_upstream(ref: Column) -> Column:
    """Source label of an upstream reference, first part wins."""
    low = F.lower(ref)
    return F.coalesce(*[F.when(low.contains(part), F.lit(label)) for part, label in rules.UPSTREAM_LABELS])


def entity_job_label(etype: Column, job_type: Column) -> Column:
    """Ingestion engine of a job or flow entity."""
    return F.when(etype.isin(*rules.JOB_ENTITY_TYPES), map_value(job_type, rules.JOB_TYPE_LABELS))


def entity_name_hits(entities: DataFrame) -> DataFrame:
    """Ingestion rules over the names of job and flow entities."""
    name = F.concat(F.coalesce("name", F.lit("")),
                    F.coalesce("description", F.lit("")) if "description" in entities.columns else F.lit(""))
    hits = rule_hits("nm", rules.INGESTION_RULES, "entity name pattern", 500)
    return (
        entities.withColumn("nm", F.lower(name)).where(F.col("type").isin(*rules.JOB_ENTITY_TYPES))
        .select("entity_id", F.explode(hits).alias("h"))
        .select("entity_id", "h.label", "h.evidence")
    )


def assertion_label(etype: Column, assertion_type: Column) -> Column:
    """Label of an assertion entity, with its type when known."""
    return F.when(
        etype.isin("assertion", "ASSERTION"),
        F.when(F.coalesce(assertion_type, F.lit("")) != "",
               F.concat(F.lit("DataHub Assertion: "), assertion_type)).otherwise("DataHub Assertion"),
    )


def detect_entities(entities: DataFrame) -> DataFrame:
    """Long detections from entity rows ``(payload_id, urn, type, job_type, name[, assertion_type])``."""
    a_type = F.col("assertion_type") if "assertion_type" in entities.columns else F.lit(None).cast("string")
    one = lambda cat, order, label, why: F.struct(
        F.lit(cat).alias("category"), F.lit(order).alias("rule_order"), label.alias("label"),
        F.concat(F.lit(why), label).alias("evidence"))
    fw = entity_framework(F.col("urn"))
    job = entity_job_label(F.col("type"), F.col("job_type"))
    ass = assertion_label(F.col("type"), a_type)
    arr = F.array(
        F.when(fw.isNotNull(), one("framework", 500, fw, "entity platform → ")),
        F.when(job.isNotNull(), one("ingestion", 500, job, "entity job type → ")),
        F.when(ass.isNotNull(), one("dq_rules", 500, ass, "assertion entity → ")),
    )
    return entities.select("payload_id", F.explode(F.array_compact(arr)).alias("h")).select("payload_id", "h.*")


def first_labels(detections: DataFrame) -> DataFrame:
    """One row per payload, category and label: the earliest rule's evidence.

    ``min_by`` combines before the shuffle, so copies of one label collapse map-side.
    """
    return detections.groupBy("payload_id", "category", "label").agg(
        F.min("rule_order").alias("rule_order"),
        F.min_by("evidence", F.struct("rule_order", "evidence")).alias("evidence"),
    )


def detect_all(payloads: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Every detection of every category, long form, first evidence per label."""
    parts = [detect_text(payloads, c) for c in CATEGORIES] + [scan_expectations(payloads)]
    if entities is not None:
        parts.append(detect_entities(entities))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_labels(out)


def with_combinations(detections: DataFrame) -> DataFrame:
    """Add combination labels; the set collected per payload holds at most the fixed framework labels."""
    known = [n for n, _ in rules.FRAMEWORK_RULES]
    found = (
        detections.where((F.col("category") == "framework") & F.col("label").isin(*known))
        .groupBy("payload_id").agg(F.collect_set("label").alias("found"))
    )
    combos = found.select("payload_id", F.explode(combination_hits(F.col("found"))).alias("h")).select(
        "payload_id", F.lit("framework").alias("category"), "h.label", "h.rule_order", "h.evidence")
    return detections.unionByName(combos)


def entity_hits(entities: DataFrame) -> DataFrame:
    """Per payload the labels of its entity rows, an array per category; few labels exist, and copies combine per task."""
    found = first_labels(detect_entities(entities))
    hit = F.struct("rule_order", "label", "evidence")
    return found.groupBy("payload_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("category") == c, hit))).alias(f"_{c}") for c in CATEGORIES])


def analyze(payloads: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Labels and evidence arrays per category in rule order, one narrow pass.

    Expectation labels come from the JSON text by pattern, in order of appearance.
    With ``entities`` the labels of a payload's entity rows follow, unless the text gave them.
    """
    df = with_text(payloads)
    types = F.array_distinct(F.coalesce(
        F.regexp_extract_all("raw_json", F.lit(r'"expectation_type"\s*:\s*"([^"]+)"'), F.lit(1)), F.array().cast("array<string>")))

    def expectation(t: Column, at: Column) -> Column:
        label = F.coalesce(map_value(t, rules.EXPECTATION_LABELS), F.concat(F.lit("GE: "), t))
        return F.struct((at + 100).alias("rule_order"), label.alias("label"),
                        F.concat(F.lit("GE expectation type '"), t, F.lit("'")).alias("evidence"))

    for c in CATEGORIES:
        df = df.withColumn(c, category_hits(c))
    df = df.withColumn("framework", F.concat("framework", combination_hits(F.col("framework.label"))))
    df = df.withColumn("dq_rules", F.array_sort(F.concat("dq_rules", F.transform(types, expectation).cast(HIT))))
    if entities is not None:
        df = df.join(entity_hits(entities), "payload_id", "left")
        for c in CATEGORIES:
            more = F.filter(F.coalesce(F.col(f"_{c}"), F.array().cast(HIT)), unseen(c))
            df = df.withColumn(c, F.concat(c, more.cast(HIT)))
    return df.select(
        "payload_id",
        *[F.col(f"{c}.label").alias(c) for c in CATEGORIES],
        *[F.col(f"{c}.evidence").alias(f"{c}_evidence") for c in CATEGORIES],
    )


def unseen(category: str) -> Callable[[Column], Column]:
    """Whether a hit's label is not among the category's own."""
    return lambda h: ~F.array_contains(F.col(f"{category}.label"), h["label"])


def confidence(labels: DataFrame) -> DataFrame:
    """Payload confidence per category; categories with nothing score 0."""
    return labels.select(
        "payload_id",
        *[F.when(F.size(c) > 0, F.lit(rules.CATEGORY_CONFIDENCE[c])).otherwise(0.0).alias(c) for c in CATEGORIES],
    )


def merge_results(results: DataFrame, key: str) -> DataFrame:
    """Merge ``(key, seq, label, confidence)``: ordered distinct labels, least confidence.

    Long form: one row per key and label, ``seq`` being its first occurrence, with the
    key's confidence and evidence count beside it.
    """
    first = results.groupBy(key, "label").agg(
        F.min("seq").alias("seq"), F.min("confidence").alias("c"), F.count("*").alias("n"))
    total = first.groupBy(key).agg(F.min("c").alias("confidence"), F.sum("n").alias("evidence_count"))
    return first.select(key, "label", "seq").join(total, key)


def category_overview(found: DataFrame, item: str = "payload_id") -> DataFrame:
    """Labels and hits per category of ``found(item, category, label)``, and how varied it is."""
    n = found.groupBy("category", "label").agg(F.count_distinct(item).alias("n"))
    return n.groupBy("category").agg(
        F.count("*").alias("labels"), F.sum("n").alias("hits"),
        F.when(F.count("*") > 10, "High").when(F.count("*") > 5, "Medium").otherwise("Low").alias("complexity"))


def override_category(labels: DataFrame, overrides: DataFrame, category: str) -> DataFrame:
    """Replace a category's list where ``overrides(payload_id, labels)`` holds one."""
    o = overrides.select("payload_id", F.col("labels").alias("_o"))
    return labels.join(o, "payload_id", "left").withColumn(category, F.coalesce("_o", category)).drop("_o")


class DetectorRegistry:
    """Named detectors, each ``payloads -> detections``; order of registration kept."""

    def __init__(self) -> None:
        self._detectors: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._detectors:
            raise ValueError(f"detector {name!r} is already registered")
        self._detectors[name] = fn

    def unregister(self, name: str) -> None:
        if name not in self._detectors:
            raise KeyError(f"no detector named {name!r}")
        del self._detectors[name]

    def get(self, name: str):
        return self._detectors.get(name)

    def names(self) -> list[str]:
        return list(self._detectors)

    def run(self, payloads: DataFrame) -> DataFrame:
        parts = [fn(payloads) for fn in self._detectors.values()]
        if not parts:
            raise ValueError("no detectors registered")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def default_registry() -> DetectorRegistry:
    reg = DetectorRegistry()
    for c in CATEGORIES:
        reg.register(f"{c}_detector", lambda p, c=c: detect_text(p, c))
    return reg


def tagged(category: str, hits: Column) -> Column:
    """Hits with their category beside them."""
    return F.transform(hits, lambda h: F.struct(
        F.lit(category).alias("category"), h["rule_order"].alias("rule_order"), h["label"].alias("label"),
        h["evidence"].alias("evidence")))


def custom_rule_detector(rule_rows: list[tuple[str, str, str]]) -> Callable[[DataFrame], DataFrame]:
    """Detector from user rows ``(category, label, pattern)``; patterns become literals."""
    by_cat: dict[str, dict[str, list[str]]] = {}
    for cat, label, pattern in rule_rows:
        by_cat.setdefault(cat, {}).setdefault(label, []).append(pattern)

    def run(payloads: DataFrame) -> DataFrame:
        df = with_text(payloads)
        arrays = [tagged(cat, rule_hits("txt", list(labels.items()), "user rule", prefilter=False))
                  for cat, labels in by_cat.items()]
        return df.select("payload_id", F.explode(F.concat(*arrays)).alias("h")).select("payload_id", "h.*")

    return run
