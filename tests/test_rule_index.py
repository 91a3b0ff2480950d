"""Indexed rules against every rule on every text."""

import random
import re

from metasift.operators import rule_index as ri

SCHEMA = "category string, label string, pattern string, rule_order long"


def texts(spark, n, rng):
    words = [f"w{k}" for k in range(400)] + ["select", "from", "landing-7", "é☃ü", "a.b", "((", "tab\tbed"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40))).upper() if k % 5 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 40))), "{}", None if k % 7 == 0 else "x") for k in range(n)]
    return rows, spark.createDataFrame(rows, "payload_id long, metadata string, config string, raw_json string")


def rule_rows(n, rng):
    kinds = [lambda k: f"w{k % 500}\\b", lambda k: f"w{k % 90} w[0-9]+", lambda k: f"(w{k % 400}|tab)", lambda k: f"w{k % 30}.*from", lambda k: "a\\.b", lambda k: f"\\bw{k % 9}\\b",
             lambda k: "é☃?ü", lambda k: f"(?i)W{k % 400} ", lambda k: f"sele?ct w{k % 50}", lambda k: f"w{k % 7}{{2}}", lambda k: f"\\({{2}} w{k % 300}"]
    return [(f"c{k % 5}", f"l{k % (n // 2)}", rng.choice(kinds)(k), k) for k in range(n)]


def test_literals_are_in_every_match():
    cases = {"abc": "abc", "ab+cd": "cd", "ab?cde": "cde", "a|b": "", "(?:abc)def": "abcdef", "x\\.y": "x.y", "\\Qabc\\E": "", "(?i)abc": "", "[abc]def": "def", "(": "", "\\d{3}-end": "-end", "abc|abd": "ab"}
    assert {p: ri.literal_of(p) for p in cases} == cases and ri.literal_of(None) == ""


def test_rules_equal_every_rule_on_every_text(spark):
    rng = random.Random(3)
    rows, payloads = texts(spark, 150, rng)
    rules = rule_rows(3_000, rng) + [("c", "none", None, -1)]
    got = {(r.payload_id, r.category, r.label): (r.rule_order, r.evidence) for r in ri.detect_rules(payloads, spark.createDataFrame(rules, SCHEMA)).collect()}
    want = {}
    compiled = [(c, label, re.compile(p), p, k) for c, label, p, k in rules if p is not None]
    lower = {r[0]: " ".join(x for x in r[1:] if x is not None).lower() for r in rows}
    for ident, text in lower.items():
        for c, label, rx, p, k in compiled:
            if rx.search(text) and want.get((ident, c, label), (k + 1,))[0] > k:
                want[ident, c, label] = (k, f"user rule '{p}' → {label}")
    assert want and got == want


def test_plan_does_not_grow_with_the_rules(spark):
    rng = random.Random(4)
    _, payloads = texts(spark, 20, rng)
    sizes = [len(ri.detect_rules(payloads, spark.createDataFrame(rule_rows(n, rng), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()) for n in (100, 20_000)]
    assert abs(sizes[0] - sizes[1]) < 500


def test_no_rules_or_texts(spark):
    rng = random.Random(5)
    _, payloads = texts(spark, 10, rng)
    assert ri.detect_rules(payloads, spark.createDataFrame([], SCHEMA)).count() == 0
    assert ri.detect_rules(payloads.limit(0), spark.createDataFrame(rule_rows(50, rng), SCHEMA)).count() == 0


def test_spread_grams_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    _, payloads = texts(spark, 60, rng)
    rules = spark.createDataFrame(rule_rows(300, rng), SCHEMA)
    show = lambda: sorted(map(tuple, ri.detect_rules(payloads, rules).collect()))
    plain = show()
    monkeypatch.setattr(ri, "HOT", 0)
    monkeypatch.setattr(ri, "SPREAD", 5)
    assert plain and show() == plain


def test_neither_texts_nor_rules_are_broadcast(spark):
    """Only the distinct grams of rules may be: texts and rules grow with the input."""
    texts = spark.createDataFrame([(k, "{}", f'{{"name":"job_{k}"}}', "{}") for k in range(20)], "payload_id long, metadata string, config string, raw_json string")
    rules = spark.createDataFrame([("job", f"J{k}", f'"job_{k}"', k) for k in range(30)], "category string, label string, pattern string, rule_order long")
    found = ri.detect_rules(texts, rules)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert all("LeftSemi" in line for line in joins), joins
    assert sorted(r.label for r in found.collect()) == sorted(f"J{k}" for k in range(20))
