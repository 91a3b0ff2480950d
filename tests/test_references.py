"""Reference parsing: round trips and malformed texts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metasift.functions import text as tx

word = st.text("abcdefghijklmnopqrstuvwxyz0123456789_-.", min_size=1, max_size=12)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(word, word, word, word), min_size=1, max_size=20))
def test_urn_round_trip(spark, parts):
    urns = [f"urn:li:dataFlow:({a},{b},{c})" for a, b, c, _ in parts]
    urns += [f"urn:li:dataJob:(urn:li:dataFlow:({a},{b},{c}),{d})" for a, b, c, d in parts]
    urns += [f"urn:li:dataset:(urn:li:dataPlatform:{a},{b},{c})" for a, b, c, _ in parts]
    df = spark.createDataFrame([(u,) for u in urns], "u string").withColumn("p", tx.parse_urn(F.col("u")))
    rows = df.select("u", tx.format_urn(F.col("p")).alias("again"), "p.platform").collect()
    assert all(r.u == r.again for r in rows)
    assert [r.platform for r in rows] == [a for a, *_ in parts] * 3


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(word, word, word, st.lists(word, min_size=1, max_size=3)), min_size=1, max_size=20))
def test_arn_parts(spark, parts):
    arns = [f"arn:aws:{s}:{r}:{a}:{':'.join(res)}" for s, r, a, res in parts]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(arns)], "i int, u string").withColumn("p", tx.parse_arn(F.col("u")))
    rows = df.orderBy("i").select("p.*").collect()
    assert [tuple(r) for r in rows] == [(s, r, a, ":".join(res)) for s, r, a, res in parts]


def test_malformed(spark):
    bad = ["", "urn:li:dataset:x", "urn:li:dataFlow:(a,b)", "arn:aws:s3", "arn:aws::r:a:x", "arn:aws:s3:::", "nra:aws:s3:::b"]
    df = spark.createDataFrame([(b,) for b in bad], "u string")
    rows = df.select(tx.parse_urn(F.col("u")).alias("a"), tx.parse_arn(F.col("u")).alias("b")).collect()
    assert all(r.a is None and r.b is None for r in rows)
    assert tuple(df.limit(1).select(tx.parse_arn(F.lit("arn:aws:s3:::bucket")).alias("p")).select("p.*").first()) == ("s3", "", "", "bucket")


def test_names(spark):
    df = spark.range(1)
    row = df.select(
        tx.slug(F.lit("--Load & Go!")), tx.slug(F.lit("!!")), tx.endpoint_label(F.lit("https://h.x/api/v1/orders/")), tx.endpoint_label(F.lit("https://h")),
        tx.normalize_node_id(F.lit(" Step_12 ")), tx.lookup_key(F.lit("a || My-Pipe_1 ")), tx.display_name(F.lit("us || my-fn-0123456789"))["title"],
        tx.display_name(F.lit("arn:aws:lambda:r:1:function/x_y"))["subtitle"], tx.display_name(F.lit("s3://bkt/k"))["title"]).first()
    assert tuple(row) == ("load_go", "node", "orders API", "https://h", "step", "my pipe 1", "My Fn", "LAMBDA", "bkt")
