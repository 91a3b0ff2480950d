"""First-in-first-out topological order of many graphs at once.

:func:`small_order` orders a graph whose size the caller has bounded.  :func:`queue_order` orders graphs of any size by joins:
nothing holds a graph in one row, task or group, all joins are on a node, and a graph with most of the rows stays spread.

The queue of such an order runs by level (the longest way from a start); within a level a node stands by the place of its
last dependency, the one it waited for, then by its number; starts stand by name, then number.  So:

1. Nodes with one dependency hang on it; pointer doubling finds the head of each chain in logarithmic rounds.
2. Nodes with several get their level in rounds over chain heads alone; what never gets one lies on or behind a cycle.
3. A node's last dependency is its parent.  Order within a level is order of the ways down from a start, compared in windows of
   eight steps that doubling gathers and a sort replaces by ranks.  A level with one node ends the way.
4. Where several dependencies share the highest level, the parent is picked once their order is known, nearest first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metasift.operators.ordering import positions
from metasift.session import cut_lineage

#: Doublings between two sorts: windows of eight steps.
DOUBLINGS = 3
#: Parts that the rows of a graph with a cycle are spread over when they learn of it.
SALTS = 64


def small_queue(idx: list, names: list, deps: list) -> list[int] | None:
    """Place and level of every node of one graph, as :func:`queue_order` gives them; None where numbers repeat.

    One list: 1 if there is a cycle, else 0; the places; the levels, -1 for none."""
    if len(set(idx)) < len(idx):
        return None
    nodes = sorted(zip(idx, names, deps), key=lambda x: x[0])
    first: dict = {}
    for i, name, _ in nodes:
        if name is not None:
            first.setdefault(name, i)
    after: dict = {}
    waits = {}
    start = []
    for i, name, some in nodes:
        known = {first[d] for d in some if d in first} if some else ()
        waits[i] = len(known)
        for d in known:
            after.setdefault(d, []).append(i)
        if not known:
            start.append((name is not None, name or "", i))
    order = [i for _, _, i in sorted(start)]
    level = dict.fromkeys(order, 0)
    for i in order:  # grows as it is read
        for b in after.get(i, ()):
            waits[b] -= 1
            if not waits[b]:
                level[b] = level[i] + 1
                order.append(b)
    cyclic = len(order) < len(idx)
    pos = {i: k for k, i in enumerate([x[0] for x in nodes] if cyclic else order, 1)}
    return [int(cyclic), *[pos[i] for i in idx], *[level.get(i, -1) for i in idx]]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def small_order(idx: pa.Array, names: pa.Array, deps: pa.Array) -> pa.Array:
    """:func:`small_queue` of the arrays ``idx``, ``names`` and ``deps`` (names that each node waits for)."""
    return pa.array(map(small_queue, idx.to_pylist(), names.to_pylist(), deps.to_pylist()), pa.list_(pa.int32()))


def _any(df: DataFrame) -> bool:
    return not df.isEmpty()


def chain_heads(nodes: DataFrame, group: str) -> DataFrame:
    """(group, idx, up, d) with ``up`` the head of the chain and ``d`` the steps to it; null and 0 for heads.

    ``nodes(group, idx, up, d)`` holds single steps.  Nodes whose way runs into a cycle are left out."""
    state = cut_lineage(nodes.withColumn("done", F.col("up").isNull()))
    most, rounds = None, 0
    while _any(state.where(~F.col("done"))):
        if rounds >= 4 and most is None:
            most = state.groupBy(group).count().agg(F.max("count")).first()[0]
        if most is not None and 2 ** rounds > 2 * most:  # one round to reach the head, one to know it
            return state.where("done").drop("done")
        to = state.select(group, F.col("idx").alias("up"), F.col("up").alias("_up"), F.col("d").alias("_d"))
        moved = state.where(~F.col("done")).join(to, [group, "up"]).select(
            group, "idx", F.coalesce("_up", "up").alias("up"), (F.col("d") + F.col("_d")).alias("d"), F.col("_up").isNull().alias("done"))
        state = cut_lineage(state.where("done").unionByName(moved))
        rounds += 1
    return state.drop("done")


def levels(nodes: DataFrame, edges: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(group, idx, level), null on and behind cycles; and (group, idx, n, up): distinct dependencies and the least of them."""
    pre = edges.groupBy(group, F.col("to_idx").alias("idx")).agg(F.count("*").alias("n"), F.min("from_idx").alias("up"))
    base = cut_lineage(nodes.join(pre, [group, "idx"], "left").select(group, "idx", F.coalesce("n", F.lit(0)).alias("n"), "up"))
    single = F.col("n") == 1
    chains = cut_lineage(chain_heads(base.select(
        group, "idx", F.when(single, F.col("up")).alias("up"), F.when(single, 1).otherwise(0).alias("d")), group))
    known = frontier = base.where("n = 0").select(group, "idx", F.lit(0).alias("level"))
    several = base.where("n > 1")
    if _any(several):
        ways = chains.select(group, F.col("idx").alias("from_idx"), F.coalesce("up", "idx").alias("head"), (F.col("d") + 1).alias("w"))
        ways = cut_lineage(edges.join(several.select(group, F.col("idx").alias("to_idx")), [group, "to_idx"]).join(ways, [group, "from_idx"])
                           .select(group, F.col("to_idx").alias("idx"), "head", "w"))
        waits = several.select(group, "idx", "n", F.lit(0).alias("level"))
        found = [known]
        while _any(frontier):
            met = ways.join(frontier.select(group, F.col("idx").alias("head"), F.col("level").alias("at")), [group, "head"])
            met = met.groupBy(group, "idx").agg(F.count("*").alias("met"), F.max(F.col("at") + F.col("w")).alias("at"))
            waits = cut_lineage(waits.join(met, [group, "idx"], "left").select(
                group, "idx", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"), F.greatest("level", F.coalesce("at", F.lit(0))).alias("level")))
            frontier = waits.where("n = 0").select(group, "idx", "level")
            found.append(frontier)
            waits = waits.where("n > 0")
        known = found[0]
        for more in found[1:]:
            known = known.unionByName(more)
    heads = known.select(group, F.col("idx").alias("up"), F.col("level").alias("base"))
    hung = chains.where("d > 0").join(heads, [group, "up"]).select(group, "idx", (F.col("base") + F.col("d")).cast("int").alias("level"))
    placed = hung.unionByName(known.select(group, "idx", F.col("level").cast("int").alias("level")))
    return cut_lineage(nodes.select(group, "idx").join(placed, [group, "idx"], "left")), base


def _ways(tree: DataFrame, group: str) -> DataFrame:
    """Nodes of ``tree(group, idx, level, up, keys, open)`` with ``keys`` of their whole way, comparable within a level, and no ``up``."""
    state, rounds = tree, 0
    while _any(state.where("up is not null")):
        to = state.select(group, F.col("idx").alias("up"), F.col("up").alias("_up"), F.col("keys").alias("_keys"), F.col("open").alias("_open"))
        moved = state.where("up is not null").join(to, [group, "up"]).select(
            group, "idx", "level", F.col("_up").alias("up"), F.concat("_keys", "keys").alias("keys"), F.col("_open").alias("open"))
        state = cut_lineage(state.where("up is null").unionByName(moved))
        rounds += 1
        going = state.where("up is not null")
        if rounds % DOUBLINGS == 0 and _any(going):
            ranked = positions(going, [group, "level"], ["keys"], "rank").select(
                group, "idx", "level", "up", F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("rank").alias("at"))).alias("keys"), "open")
            state = cut_lineage(state.where("up is null").unionByName(ranked))
    return state


def queue_order(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, idx, pos, level, cyclic) of ``nodes(group, idx, name)`` under ``edges(group, from_idx, to_idx)``.

    Graphs with a cycle keep the order of ``idx``; what can be reached before the cycle still has its level."""
    nodes = cut_lineage(nodes.select(group, F.col("idx").cast("int").alias("idx"), "name"))
    edges = cut_lineage(edges.select(group, F.col("from_idx").cast("int").alias("from_idx"), F.col("to_idx").cast("int").alias("to_idx")).distinct())
    level, base = levels(nodes, edges, group)
    bad = level.where("level is null").select(group).distinct()
    whole = level
    if cyclic := _any(bad):
        salted = cut_lineage(bad).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("cyclic", F.lit(True))
        whole = cut_lineage(level.withColumn("salt", F.pmod(F.hash("idx"), F.lit(SALTS))).join(salted, [group, "salt"], "left").drop("salt")
                            .withColumn("cyclic", F.coalesce("cyclic", F.lit(False))))
        level = whole.where(~F.col("cyclic")).drop("cyclic")
    # Parents: the only dependency, or those on the level before.
    alone = level.groupBy(group, "level").agg(F.count("*").alias("n"), F.min("idx").alias("idx")).where("n = 1").select(group, "idx", F.lit(True).alias("alone"))
    tree = level.join(base, [group, "idx"]).join(alone, [group, "idx"], "left").join(nodes, [group, "idx"])
    key = F.struct(F.when(F.col("level") == 0, F.col("name")).alias("name"), F.col("idx").alias("at"))
    end = F.col("alone").isNotNull() | (F.col("level") == 0)
    tree = cut_lineage(tree.select(
        group, "idx", "level", F.when(~end & (F.col("n") == 1), F.col("up")).alias("up"), F.array(key).alias("keys"), (~end & (F.col("n") > 1)).alias("open")))
    choice = None
    while True:
        unsure = tree.where("open")
        if not _any(unsure):
            ways = _ways(tree, group)
            break
        if choice is None:
            at = level.select(group, F.col("idx").alias("from_idx"), (F.col("level") + 1).alias("level"))
            choice = cut_lineage(unsure.select(group, F.col("idx").alias("to_idx"), "level").join(edges, [group, "to_idx"]).join(at, [group, "from_idx", "level"]))
        ways = _ways(tree, group)
        seen = ways.select(group, F.col("idx").alias("from_idx"), F.col("keys").alias("way"), F.col("open").alias("vague"))
        best = choice.join(seen, [group, "from_idx"]).groupBy(group, F.col("to_idx").alias("idx")).agg(
            F.count("*").alias("n"), F.bool_or("vague").alias("vague"), F.max_by("from_idx", "way").alias("parent"))
        # With one candidate there is nothing to wait for.
        best = best.where((F.col("n") == 1) | ~F.col("vague")).select(group, "idx", "parent")
        tree = cut_lineage(tree.join(best, [group, "idx"], "left").select(
            group, "idx", "level", F.coalesce("up", F.when(F.col("open"), F.col("parent"))).alias("up"), "keys", (F.col("open") & F.col("parent").isNull()).alias("open")))
    rows = ways.select(group, "idx", "level", "keys", F.lit(False).alias("cyclic"), F.col("level").alias("first"))
    if cyclic:
        stuck = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("idx").alias("at")))
        rows = rows.unionByName(whole.where("cyclic").select(group, "idx", "level", stuck.alias("keys"), "cyclic", F.lit(0).alias("first")))
    return positions(rows, [group], ["first", "keys"]).select(group, "idx", "pos", "level", "cyclic")
