"""Rule detection for rule sets of any size: rules are rows of a table, never part of a plan.

Every match of a rule holds the literal text in its pattern, and with it each of that text's grams of three characters.  A rule stands
in an index under the one of its grams that texts hold most seldom; a text meets the rules of its own grams in a join, and the pattern
confirms.  Rules without a literal of that length are taken in blocks against all texts.

Cases: a null pattern or an invalid one for the literal reader has no literal; an invalid regular expression fails the job as it does elsewhere;
payloads of one id are one; an empty rule set or table gives no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metasift.operators.detect import literal_stem
from metasift.operators.documents import bound
from metasift.operators.payload import with_text
from metasift.session import cut_lineage, shuffled

GRAM = 3
#: Texts in which the grams of rules are counted to pick each rule's rarest; the choice changes the cost, never the rows.
COUNTED = 10_000
#: Of the counted texts, those beyond which a gram is spread over so many tasks, its rules going to each.
HOT, SPREAD = 100, 64
#: Rules without a literal that meet a text at once.
BLOCK = 200


def literal_of(pattern: str | None) -> str:
    """A text that every match holds, or '' where the reader is not sure to read as the engine does."""
    if pattern is None or re.search(r"\(\?(?!:)|\\[^dDsSwWbBntr\W]", pattern):
        return ""
    try:
        return literal_stem(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""


@F.pandas_udf(T.StringType())
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(literal_of, na_action=None)


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct runs of ``n`` characters, in time linear in the text."""
    def runs(letters: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(letters) - n + 1)
        return F.when(F.size(letters) >= n, F.array_distinct(F.transform(at, lambda i: F.concat(*[F.element_at(letters, (i + k).cast("int")) for k in range(n)]))))

    return F.coalesce(bound(F.split(text, ""), runs), F.array().cast("array<string>"))


def detect_rules(payloads: DataFrame, rules: DataFrame) -> DataFrame:
    """(payload_id, category, label, rule_order, evidence) of ``rules(category, label, pattern, rule_order)`` on lower-case payload text.

    ``rule_order`` tells rules apart.  Of several matching patterns of a label the first by ``rule_order`` is the evidence.
    """
    texts = with_text(payloads).select("payload_id", "txt").where("txt is not null")
    rules = cut_lineage(rules.select("rule_order", "category", "label", "pattern", _literals("pattern").alias("literal")).where("pattern is not null"))
    held = rules.where(F.length("literal") >= GRAM)
    own = held.select("rule_order", F.explode(grams(F.col("literal"))).alias("gram"))
    seen = texts.limit(COUNTED).select(F.explode(grams(F.col("txt"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    index = own.join(seen, "gram", "left").groupBy("rule_order").agg(F.min_by("gram", rank).alias("gram"), F.min(rank)["n"].alias("n"))
    index = cut_lineage(index)
    # Few grams are in so many texts; which ones are spread changes the cost, never the rows.
    hot = [r.gram for r in index.where(F.col("n") > HOT).select("gram").distinct().collect()]
    salt = F.when(F.col("gram").isin(hot), F.pmod(F.xxhash64("payload_id"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int").alias("salt")
    salts = F.when(F.col("gram").isin(hot), F.lit(SPREAD - 1)).otherwise(F.lit(0))
    ready = index.select("rule_order", "gram").join(shuffled(held), "rule_order").withColumn("salt", F.explode(F.sequence(F.lit(0), salts)))
    # Texts' grams that no rule stands under, nearly all, go before the shuffle.
    wanted = cut_lineage(index.select("gram").distinct())
    kept = texts.select("payload_id", F.explode(grams(F.col("txt"))).alias("gram")).join(wanted, "gram", "left_semi")
    # A rule goes with its gram, so one that most texts meet gathers no texts in one task.
    met = kept.select("payload_id", "gram", salt).join(shuffled(ready), ["gram", "salt"])
    named = met.join(shuffled(texts), "payload_id").where("contains(txt, literal) and regexp_like(txt, pattern)")
    found = named.select("payload_id", "category", "label", "rule_order", "pattern")
    bare = rules.where(F.length("literal") < GRAM)
    n = -(-bare.count() // BLOCK)
    if n:
        block = F.pmod(F.xxhash64("rule_order"), F.lit(n)).alias("block")
        blocks = bare.select(block, F.struct("category", "label", "rule_order", "pattern").alias("r")).groupBy("block").agg(F.collect_list("r").alias("rules"))
        every = texts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(blocks, "block")
        hits = every.select("payload_id", F.explode(F.filter("rules", lambda r: F.regexp_like(F.col("txt"), r["pattern"]))).alias("r"))
        found = found.unionByName(hits.select("payload_id", "r.category", "r.label", "r.rule_order", "r.pattern"))
    return found.groupBy("payload_id", "category", "label").agg(F.min("rule_order").alias("rule_order"), F.min_by("pattern", "rule_order").alias("pattern")).select(
        "payload_id", "category", "label", "rule_order", F.concat(F.lit("user rule '"), "pattern", F.lit("' → "), "label").alias("evidence"))
