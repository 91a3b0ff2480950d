"""Cut-offs are the caller's; by default nothing is lost.  Ranks of hot keys, archives with damaged members, names of responses."""

import io
import zipfile

from pyspark.sql import functions as F

from metasift.functions import text as tx
from metasift.operators import code as cd
from metasift.operators import lineage as ln
from metasift.sources import listings as ls


def test_long_conditions_and_late_rules_stay(spark):
    line = "assert " + "x" * 200
    source = "\n".join([line] * 30 + ["df.where('a is not null')"])
    df = spark.createDataFrame([(1, source)], "id int, source string")
    got = cd.line_rules(df, ["id"]).collect()
    assert len(got) == 31 and got[0].condition == line
    assert {len(r.condition) for r in cd.line_rules(df, ["id"], width=80).collect()} == {80, 25}
    kinds = df.select(cd.rule_types(F.col("source")).alias("all"), cd.rule_types(F.col("source"), 20).alias("some")).first()
    assert set(kinds["all"]) == {"custom", "not_null"} and set(kinds["some"]) == {"custom"} and len(kinds["some"]) == 20


def test_titles_and_deep_paths(spark):
    name = "a very long resource name that goes on"
    r = spark.range(1).select(tx.display_name(F.lit(f"us || {name}"))["title"].alias("a"), tx.display_name(F.lit(f"us || {name}"), 24)["title"].alias("b")).first()
    assert r.a.lower() == name and len(r.b) == 25 and r.b.endswith("...")
    deep = spark.createDataFrame([("r", "a/b/c/d/e/f/g/h/dags/x.py")], "root string, path string")
    assert "Apache Airflow DAGs" in {r.value for r in ls.source_tree(deep).collect()}
    assert ls.source_tree(deep, max_depth=6).count() == 0


def test_all_ranks_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 50 == 1, "cold").otherwise("hot")).alias("k"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = ln.first_n(df, ["k"], ["v"], None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.replace("WindowGroupLimit", "") or "partitionBy" not in plan
    want = {}
    for k, v in sorted(((r.k, r.v) for r in df.collect()), key=lambda x: x[1]):
        want.setdefault(k, []).append(v)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.k, {})[r.rn] = r.v
    assert {k: [rows[k][i] for i in range(1, len(rows[k]) + 1)] for k in rows} == want


def test_damaged_members_give_rows(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("good.py", "x = 1")
        z.writestr("bad.py", "y = 'marker'")
        z.writestr("note.txt", "no")
    data = bytearray(out.getvalue())
    data[data.index(b"marker")] ^= 1
    df = spark.createDataFrame([("a.zip", data), ("b.zip", bytearray(b"no archive")), ("c.zip", None)], "path string, content binary")
    rows = {(r.package, r.path): (r.source, r.error) for r in cd.unzip_python(df).collect()}
    assert rows["a.zip", "good.py"] == ("x = 1", None) and rows["a.zip", "bad.py"][0] is None and "CRC" in rows["a.zip", "bad.py"][1]
    assert rows["b.zip", None][1] and rows["c.zip", None][1] and len(rows) == 4


def test_names_of_responses(spark):
    docs = ['{"paths":{"/b":{},"/a":{}},"x":1}', '[{"k":1,"j":2},{"z":3}]', '{"q":1}', "[]", "[1]", "5", "bad", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = {}
    for r in ls.api_names(df, "doc", ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.name)
    assert got == {0: ["/a", "/b"], 1: ["j", "k"], 2: ["q"]}
    assert ls.api_names(df, "doc", ["id"], 1).count() == 3
