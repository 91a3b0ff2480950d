"""Pairs of payload and entity: each comes out once, without a shuffle of the pairs."""

from metasift.operators import lineage as ln


def test_pairs_come_once_from_tiles(spark, monkeypatch):
    monkeypatch.setattr(ln, "TILE", 2)
    names = ["red bolt", "red ring", "blue bolt", "RED Bolt red", "plain", "red blue bolt", "redbolt"]
    terms = [(p % 9, i, t) for p, n in enumerate(names * 3) for i, t in enumerate(n.split(" "))] + [(None, 0, "red"), (3, 7, None), (4, 0, "absent")]
    ents = [(f"u{i % 5}" if i % 4 else None, f"t{i % 2}", n) for i, n in enumerate(names * 2)]
    edges = spark.createDataFrame([("x", "u1", "DownstreamOf")], "source_urn string, target_urn string, edge_type string")
    found, _ = ln.enrich_entities(spark.createDataFrame(terms, "payload_id long, pos int, term string"),
                                  spark.createDataFrame(ents, "urn string, type string, name string"), edges)
    want = {}
    for p, i, t in terms:
        for u, _, n in ents:
            if t is not None and t.lower() in n.lower():
                want[p, u] = min(i, want.get((p, u), i))
    got = [((r.payload_id, r.urn), r.pos) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top and "Repartition" not in top
