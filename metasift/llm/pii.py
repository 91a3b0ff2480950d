"""Personal data: rule spans, and unseen identifiers found by bootstrapped context patterns.  DataFrame functions only.

Spans that the rules find are the seeds.  An identifier-like token with the words before it is an *instance* in a
lexical *pattern* (the two words, and what stands between the last one and the token).  On the graph of patterns and instances scores
are iterated: a pattern is as good as the share of its instances believed to be of a kind, an instance is believed
as far as its patterns are good (noisy or).  Patterns of high confidence that several different seeds support
then take in their other instances, if their shape fits the kind.

Positions come from the lengths of what lies between matches, so all counts are in code points.  Per-document work is
narrow; only instances are shuffled.

Cases: null and empty texts have no spans; repeated rows are rows of their own; a null id stays null; an empty table, or one without
seeds, discovers nothing; other columns pass through, clashing names are avoided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import fresh, saved, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The rule patterns.  Possessive and anchored so that no run is read twice; they match what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SMALL_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: Two words, up to three marks or blanks, and a token: an address with its sign plain or in brackets, never begun midway, or digits.
BEFORE = r"(?:\p{L}++[\s,]{1,2}+)?\p{L}++"
TOKEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|\+?+[0-9][0-9().\x20-]{4,24}[0-9](?![0-9])"
CONTEXT = rf"{BEFORE}[\s:=#-]{{1,3}}(?:{TOKEN})"
PARTS = rf"^({BEFORE})([\s:=#-]{{1,3}})({TOKEN})$"
ROUNDS = 3
#: A pattern takes in unseen instances from this confidence, with so many different seeds behind it.
CONFIDENCE, SUPPORT = 0.8, 3


def _located(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    """Matches of ``pattern`` and the pieces between them, where ``guard`` says that there can be any."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none), F.when(guard, F.split(text, pattern, -1)).otherwise(none)


def _positions(found: Column, between: Column) -> Column:
    """(start, end, value) of every match."""
    empty = F.expr("cast(named_struct('at', 0L, 'out', array()) as struct<at:bigint,out:array<struct<start:bigint,end:bigint,value:string>>>)")

    def step(acc: Column, k: Column) -> Column:
        value = F.element_at(found, k)
        start = acc["at"] + F.length(F.element_at(between, k))
        end = (start + F.length(value)).cast("long")
        one = F.struct(start.cast("long").alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(1), F.size(found)), empty, step, lambda a: a["out"])).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    back = F.reverse(digits)

    def step(acc: Column, k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(SMALL_PART))
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(value))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _fits(kind: Column, value: Column) -> Column:
    """Whether a token has the shape of a kind that the rules were too strict for."""
    n = F.length(_digits(value))
    at = value.rlike(r"@|\(at\)|\[at\]")
    return F.when(kind == "email", at).when(kind == "card", ~at & n.between(13, 19)).when(kind == "phone", ~at & n.between(7, 15)).when(kind == "ip", value.rlike(r"^[0-9]+(\.[0-9]+){3}$")).otherwise(F.lit(False))


def _valid_spans(found: Column, kind: str) -> Column:
    valid = F.filter(found, lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def rule_spans(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with arrays ``name`` (kind, start, end by kind as listed, then start) and ``name``_tokens (contexts)."""
    t = F.col(text)
    guards = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": t.contains("+"), "tokens": t.rlike(r"[0-9@]|\(at\)|\[at\]")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "tokens": CONTEXT}
    for key, pattern in patterns.items():
        found, between = _located(t, pattern, guards[key])
        rows = rows.withColumn(f"{name}_{key}_f", found).withColumn(f"{name}_{key}_b", between)
    for key in patterns:
        rows = rows.withColumn(f"{name}_{key}", _positions(F.col(f"{name}_{key}_f"), F.col(f"{name}_{key}_b"))).drop(f"{name}_{key}_f", f"{name}_{key}_b")
    spans = [_valid_spans(F.col(f"{name}_{k}"), k) for k in KINDS]
    return rows.withColumn(name, F.concat(*spans)).drop(*[f"{name}_{k}" for k in KINDS])


def _instances(base: DataFrame, row: str, name: str) -> DataFrame:
    """(row, start, end, pattern, instance, kind): tokens in context; kind where a rule span overlaps, else null."""
    rows = base.where(F.size(f"{name}_tokens") > 0).select(F.col(row).alias("row"), F.col(name).alias("base"), F.explode(f"{name}_tokens").alias("t"))
    part = lambda k: F.regexp_extract(F.col("t.value"), PARTS, k)
    rows = rows.select("row", "base", F.col("t.end").alias("end"), part(1).alias("left"), part(2).alias("sep"), part(3).alias("value"))
    rows = rows.withColumn("start", F.col("end") - F.length("value"))
    seed = F.try_element_at(F.transform(F.filter("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), lambda s: s["kind"]), F.lit(1))
    pattern = F.concat_ws("|", F.lower(F.regexp_replace("left", r"[\s,]+", " ")), F.regexp_replace("sep", r"\s+", " "))
    plain = F.when(F.col("value").contains("@"), F.lower("value")).otherwise(F.regexp_replace(F.lower("value"), r"[\s()-]", ""))
    return rows.select("row", "start", "end", "value", pattern.alias("pattern"), plain.alias("instance"), seed.alias("kind"))


def patterns(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) after ``rounds`` of scoring on the pattern-instance graph."""
    edges = saved(instances.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("belief"))
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    beliefs = seeds
    for k in range(rounds):
        sums = edges.select("pattern", "instance").join(beliefs, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.sum((F.col("belief") >= 1).cast("long")).alias("support"))
        scored = sums.join(size, "pattern").select("pattern", "kind", "support", (F.col("mass") / (F.col("n") + 1)).alias("confidence"))
        scored = saved(scored.where(F.col("support") >= 2), "patterns")
        if k + 1 < rounds:
            likely = edges.select("pattern", "instance").join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"))
            beliefs = saved(seeds.unionByName(likely.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti")), "beliefs")
    return scored


def discover(base: DataFrame, row: str, name: str) -> DataFrame:
    """(row, more): spans that high-confidence patterns add, none over a rule span."""
    instances = saved(_instances(base, row, name), "instances")
    good = patterns(instances).where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern", F.col("kind").alias("as"), "confidence")
    unseen = instances.where("kind is null").join(good, "pattern").where(_fits(F.col("as"), F.col("value")))
    best = unseen.groupBy("row", "start", "end").agg(F.max_by("as", F.struct("confidence", "as")).alias("kind"))
    return best.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))


def find(docs: DataFrame, text: str = "text", name: str = "pii", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless kept) with a struct column ``name``: base and spans (all spans), by kind, then start."""
    row, clean, spans = fresh(docs, "row"), fresh(docs, "plain"), fresh(docs, "spans")
    rows = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(clean, text_or_empty(text))
    rows = rule_spans(rows, clean, spans).drop(clean)
    base = saved(rows if keep_text else rows.drop(text), "pii")
    added = fresh(base, "added")
    more = saved(discover(base, row, spans), "more").select(F.col("row").alias(row), F.col("more").alias(added))
    out = base.join(more, row, "left")
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    every = F.concat(F.col(spans), F.coalesce(added, none))
    order = F.transform(every, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    merged = F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    kept = [c for c in docs.columns if keep_text or c != text]
    return out.select(*[F.col(c) for c in kept], F.struct(F.col(spans).alias("base"), merged.alias("spans")).alias(name))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans give one mark."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), mark.alias("out"))

    whole = F.aggregate(order, begin, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)

