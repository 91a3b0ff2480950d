"""The paths for oversized and skewed groups, against brute force."""

import random
from collections import deque

from pyspark.sql import functions as F

from metasift.operators import activities as ac
from metasift.operators import inventory as inv
from metasift.operators import lineage as ln
from metasift.operators.ordering import fragments, positions


def random_pipelines(seed, n=25, size=14):
    rng = random.Random(seed)
    rows = []
    for p in range(n):
        k = rng.randint(1, size) if p else size * 4
        for i in range(1, k + 1):
            deps = [f"n{rng.randint(1, i - 1):02d}" for _ in range(rng.randint(0, 3))] if i > 1 else []
            if p % 5 == 4 and i == 2:
                deps = [f"n{k:02d}"] + deps
            rows.append((p, i, f"n{i:02d}", "Copy", deps + (["ghost"] if rng.random() < 0.2 else []), None, None, None, None))
    rng.shuffle(rows)
    return rows


SCHEMA = "pipeline_id long, idx int, name string, type string, deps array<string>, src string, sink string, url string, method string"


def kahn(acts):
    acts = sorted(acts, key=lambda r: r[1])
    known = {r[2] for r in acts}
    edges, waits = {r[2]: [] for r in acts}, {r[2]: 0 for r in acts}
    for r in acts:
        for d in r[4]:
            if d in known:
                edges[d].append(r[2])
                waits[r[2]] += 1
    q, out = deque(sorted(n for n, w in waits.items() if w == 0)), []
    while q:
        cur = q.popleft()
        out.append(cur)
        for nxt in edges[cur]:
            waits[nxt] -= 1
            if waits[nxt] == 0:
                q.append(nxt)
    return out if len(out) == len(acts) else [r[2] for r in acts]


def test_order_matches_the_queue(spark):
    rows = random_pipelines(7)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {p: kahn([r for r in rows if r[0] == p]) for p in {r[0] for r in rows}}
    got = {}
    for r in ac.order_activities(df).orderBy("pipeline_id", "pos").collect():
        got.setdefault(r.pipeline_id, []).append(r.name)
    assert got == want


def test_order_of_a_chain_of_any_depth(spark):
    n = 12_000
    rows = [(1, i, f"n{i}", "Copy", [f"n{i - 1}"] if i > 1 else [], None, None, None, None) for i in range(n, 0, -1)]
    got = ac.order_activities(spark.createDataFrame(rows, SCHEMA)).agg(
        F.count("*"), F.max("level"), F.count_if("cyclic"), F.count_if(F.col("idx") != F.col("pos"))).first()
    assert tuple(got) == (n, n - 1, 0, 0)


def test_positions_by_range(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", rng.randint(0, 10**6), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    want = {}
    for k in {r[0] for r in rows}:
        for pos, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = pos
    assert {r.i: r.pos for r in positions(df, ["k"], ["v", "i"]).collect()} == want
    assert {r.i: r.pos for r in positions(df, ["k"], ["v", "i"], partitions=3).collect()} == want


def test_fragments_concatenate_to_the_whole(spark):
    rows = [("a", i, f"{i};") for i in range(2500)] + [("b", 0, "x")]
    df = spark.createDataFrame(rows, "k string, s int, token string")
    got = {r.k: r.text for r in fragments(df, "k", ["s"]).collect()}
    assert got == {"a": "".join(f"{i};" for i in range(2500)), "b": "x"}


def random_assets(spark, seed, n=200):
    rng = random.Random(seed)
    words = ["api", "prod", "lake", "x1", "orders", "a", "ord"]
    rows = []
    for i in range(n):
        name = "-".join(rng.sample(words, rng.randint(1, 3))) + ("-" if rng.random() < 0.1 else "")
        svc = rng.choice(["s3", "lambda", "glue", "apigateway", "storage_accounts", "fabric_items"])
        env = [rng.choice(["s3://lake", "orders-lake", "x", "ord", "a"]) for _ in range(rng.randint(0, 2))]
        rows.append((0 if rng.random() < 0.6 else rng.randint(1, 4), 0, i, svc, f"us-{rng.randint(1, 2)} || {name}", rng.choice(["Lakehouse", "Notebook", "Report", None]), "{}", env, [], None))
    return rows, spark.createDataFrame(rows, "payload_id int, dump_pos int, item_pos int, service string, id string, item_type string, configuration string, "
                                             "env_targets array<string>, code_evidence array<string>, confidence string")


def roles_of(r):
    t = (r[5] or "").lower()
    if r[3] == "fabric_items":
        return ["target"] if t in ("lakehouse", "warehouse") else ["ingest"] if t in ("pipeline", "notebook") else ["source"]
    return {"s3": ["target"], "lambda": ["ingest"], "glue": ["ingest"], "apigateway": ["source"], "storage_accounts": ["source", "target"]}[r[3]]


def test_links_equal_all_pairs(spark):
    rows, df = random_assets(spark, 5)
    by = lambda role: [r for r in rows if role in roles_of(r)]
    name = lambda r: r[4].split("||")[-1].strip()
    up, down = set(), set()
    for i in by("ingest"):
        word = name(i).split("-")[-1].lower()
        for s in by("source"):
            if s[0] == i[0] and ((word and word in s[4].lower()) or "api" in s[4].lower()):
                up.add((i[0], i[4], s[4]))
        for v in i[7]:
            for t in by("target"):
                if t[0] == i[0] and (name(t).lower() in v.lower() or v.lower() in t[4].lower()):
                    down.add((i[0], i[4], t[4]))
    roles = inv.with_roles(df)

    def pairs(links, side):
        left = links.where("side = 'ingest'").select("payload_id", "link_key", F.col("id").alias("a"))
        right = links.where(F.col("side") == side).select("payload_id", "link_key", F.col("id").alias("b"))
        return {(r.payload_id, r.a, r.b) for r in left.join(right, ["payload_id", "link_key"]).collect()}

    u, d = inv.link_upstream(roles), inv.link_downstream(roles)
    assert pairs(u, "source") == up
    assert pairs(d, "target") == down
    links = inv.assemble_links(roles, u, d).where("ingestion is not null").collect()
    assert {(r.payload_id, r.ingestion): r.source_links for r in links} == {(i[0], i[4]): len({x for x in up if x[:2] == (i[0], i[4])}) for i in by("ingest")}
    assert {(r.payload_id, r.ingestion): r.target_links for r in links} == {(i[0], i[4]): len({x for x in down if x[:2] == (i[0], i[4])}) for i in by("ingest")}


def test_search_equals_substring_scan(spark):
    rng = random.Random(2)
    ents = [(f"u{i:03d}", rng.choice(["a", "b"]), "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))) for i in range(150)]
    terms = ["a", "ab", "ca", "bcb", "zzz", "AB"]
    e = spark.createDataFrame(ents, "urn string, type string, name string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.term, r.type, r.urn) for r in ln.entity_search(t, e, 1000).collect()}
    assert got == {(x.lower(), k, u) for x in terms for u, k, n in ents if x.lower() in n}


def test_closure_with_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")]
    e = spark.createDataFrame(edges, "source_urn string, target_urn string")
    seeds = spark.createDataFrame([("s", "a"), ("t", "x")], "seed string, urn string")
    got = {(r.seed, r.urn, r.hops) for r in ln.impact_closure(e, seeds).collect()}
    assert got == {("s", "b", 1), ("s", "c", 2), ("s", "d", 3), ("t", "y", 1)}


def test_closure_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(200)], "source_urn string, target_urn string")
    got = ln.impact_closure(e, spark.createDataFrame([("s", "n0")], "seed string, urn string"))
    assert got.count() == 200 and got.agg(F.max("hops")).first()[0] == 200


def test_signature_ignores_order_and_counts_copies(spark):
    rows = [(1, "n", "a"), (1, "n", "b"), (2, "n", "b"), (2, "n", "a"), (3, "n", "a"), (3, "n", "a"), (3, "n", "b")]
    s = {r.k: tuple(r.sig) for r in ac.signatures(spark.createDataFrame(rows, "k int, kind string, value string"), "k").collect()}
    assert s[1] == s[2] != s[3]
