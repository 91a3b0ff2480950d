"""Queue order of many graphs against a plain queue: joins, ladders, stars, deep parallel chains, cycles, a hot graph."""

import random
from collections import deque

import pytest

from metasift.operators.topology import queue_order


def plain_queue(nodes, edges):
    """(pos, level, cyclic) per node of one graph; ``nodes`` is {idx: name}."""
    after, waits = {i: [] for i in nodes}, dict.fromkeys(nodes, 0)
    for a, b in sorted(set(edges), key=lambda e: (e[1], e[0])):
        after[a].append(b)
        waits[b] += 1
    queue = deque(sorted((i for i in nodes if not waits[i]), key=lambda i: (nodes[i], i)))
    level, out = dict.fromkeys(queue, 0), []
    while queue:
        i = queue.popleft()
        out.append(i)
        for b in after[i]:
            waits[b] -= 1
            if not waits[b]:
                level[b] = level[i] + 1
                queue.append(b)
    cyclic = len(out) < len(nodes)
    return {i: (k, level.get(i), cyclic) for k, i in enumerate(sorted(nodes) if cyclic else out, 1)}


def random_dag(rng, n, reach, most):
    order = list(range(1, n + 1))
    rng.shuffle(order)
    edges = []
    for k in range(1, n):
        for _ in range(rng.randint(0, most)):
            edges.append((order[max(0, k - rng.randint(1, reach))], order[k]))
    return {i: rng.choice("abc") for i in order}, edges


def graphs():
    rng = random.Random(11)
    out = {f"r{k}": random_dag(rng, rng.randint(1, 25), rng.randint(1, 8), rng.randint(0, 3)) for k in range(25)}
    out["ladder"] = ({k: "x" for k in range(1, 17)}, [(k, k + d) for k in range(1, 15) for d in ((1, 2, 3) if k % 2 == 0 else (2, 3)) if k + d <= 16])
    out["grid"] = ({10 * i + j: "g" for i in range(5) for j in range(5)}, [(10 * i + j, 10 * (i + 1) + t) for i in range(4) for j in range(5) for t in (j, (j + 2) % 5)])
    out["star"] = ({k: f"n{k % 7}" for k in range(300)}, [(299, k) for k in range(299)])
    out["combs"] = ({100 * c + k: f"c{9 - c}" for c in range(4) for k in range(40)}, [(100 * c + k, 100 * c + k + 1) for c in range(4) for k in range(39)])
    out["loop"] = ({k: "n" for k in range(1, 9)}, [(1, 2), (2, 3), (3, 4), (4, 2), (4, 5), (1, 6), (5, 7), (6, 7)])
    out["self"] = ({1: "a", 2: "b"}, [(1, 1), (1, 2)])
    out["ring"] = ({k: "n" for k in range(20)}, [(k, (k + 1) % 20) for k in range(20)])
    out["hot"] = random_dag(rng, 400, 60, 2)
    return out


def test_queue_order_matches_plain_queue(spark):
    all_graphs = graphs()
    nodes = [(g, i, name) for g, (names, _) in all_graphs.items() for i, name in names.items()]
    edges = [(g, a, b) for g, (_, some) in all_graphs.items() for a, b in some]
    rows = queue_order(spark.createDataFrame(nodes, "g string, idx int, name string"),
                       spark.createDataFrame(edges, "g string, from_idx int, to_idx int"), "g").collect()
    assert len(rows) == len(nodes)
    got = {}
    for r in rows:
        got.setdefault(r.g, {})[r.idx] = (r.pos, r.level, r.cyclic)
    for g, (names, some) in all_graphs.items():
        assert got[g] == plain_queue(names, some), g


def test_queue_order_without_rows_or_edges(spark):
    nodes = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "g string, idx int, name string")
    edges = spark.createDataFrame([], "g string, from_idx int, to_idx int")
    assert queue_order(nodes.limit(0), edges, "g").count() == 0
    assert {(r.g, r.idx): (r.pos, r.level) for r in queue_order(nodes, edges, "g").collect()} == {("a", 2): (1, 0), ("a", 1): (2, 0), ("b", 1): (1, 0)}


@pytest.mark.parametrize("turn", [1, -1])
def test_deep_parallel_chains(spark, turn):
    """Ways of 700 steps: several windows of ranks."""
    nodes = [("g", turn * (1000 * c + k), f"c{c}") for c in range(3) for k in range(700)]
    edges = [("g", turn * (1000 * c + k), turn * (1000 * c + k + 1)) for c in range(3) for k in range(699)]
    rows = queue_order(spark.createDataFrame(nodes, "g string, idx int, name string"), spark.createDataFrame(edges, "g string, from_idx int, to_idx int"), "g").collect()
    assert {r.idx: (r.pos, r.level, r.cyclic) for r in rows} == plain_queue({i: n for _, i, n in nodes}, [(a, b) for _, a, b in edges])
