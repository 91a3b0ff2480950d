"""Lineage graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metasift.functions import rules
from metasift.functions import text as tx
from metasift.operators.ordering import positions
from metasift.session import cut_lineage, shuffled


def first_write_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Earliest row per key.

    ``min_by`` over a struct combines before the shuffle, so a key with very many copies
    sends one row per task instead of all of them.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(seq).isNull(), F.col(seq))  # a missing sequence comes last, but is not lost
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first_n(df: DataFrame, keys: list[str], order: list, n: int | None) -> DataFrame:
    """First n rows per key with their rank ``rn``, or all of them ranked.

    A rank filter becomes a group limit before the shuffle; without one a key of any size is ranked over many tasks."""
    if n is None:
        return positions(df, keys, order, "rn")
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct nodes of an edge table with their kind and platform."""
    ends = edges.select(F.explode(F.array("source_urn", "target_urn")).alias("urn")).distinct()
    return ends.select("urn", tx.urn_node_type(F.col("urn")).alias("node_type"),
                       tx.urn_platform(F.col("urn")).alias("platform"))


def upstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(urn, edge_type, upstream node), one row per edge with a known source."""
    n = nodes.select(F.col("urn").alias("source_urn"), "node_type", "platform")
    return edges.join(n, "source_urn").select(
        F.col("target_urn").alias("urn"), "edge_type", F.col("source_urn").alias("upstream_urn"), "node_type", "platform")


def downstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mirror of :func:`upstream`."""
    n = nodes.select(F.col("urn").alias("target_urn"), "node_type", "platform")
    return edges.join(n, "target_urn").select(
        F.col("source_urn").alias("urn"), "edge_type", F.col("target_urn").alias("downstream_urn"), "node_type",
        "platform")


def impact_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything downstream of ``seeds(seed, urn)`` with the least hop count.

    Breadth first: each round joins only the newest frontier with the edges and is written
    to the checkpoint folder, so neither the plan nor recovery grows with the depth.
    Start nodes that share a ``seed`` label search as one set and keep the result linear
    in the number of nodes.  Every round reaches new nodes or is the last.
    """
    hop = cut_lineage(edges.select(F.col("source_urn").alias("urn"), "target_urn").distinct())
    frontier = cut_lineage(seeds.select("seed", "urn").distinct().withColumn("hops", F.lit(0)))
    reached = frontier
    depth = 0
    while True:
        depth += 1
        nxt = (
            frontier.join(hop, "urn").select("seed", F.col("target_urn").alias("urn")).distinct()
            .join(reached.select("seed", "urn"), ["seed", "urn"], "left_anti")
            .withColumn("hops", F.lit(depth))
        )
        frontier = cut_lineage(nxt)
        if frontier.isEmpty():
            return reached.where("hops > 0")
        reached = reached.unionByName(frontier)
        if depth % 10 == 0:
            reached = cut_lineage(reached)


def flow_members(edges: DataFrame) -> DataFrame:
    """Jobs of every flow."""
    return edges.where("edge_type = 'IsPartOf'").select(
        F.col("target_urn").alias("flow_urn"), F.col("source_urn").alias("job_urn"))


def related(edges: DataFrame, queries: DataFrame, edge_type: str = "DownstreamOf") -> DataFrame:
    """Neighbours of ``queries(urn, direction)`` along one edge type."""
    e = edges.where(F.col("edge_type") == edge_type)
    both = e.select(F.col("target_urn").alias("urn"), F.lit("UPSTREAM").alias("direction"),
                    F.col("source_urn").alias("related_urn")).unionByName(
        e.select(F.col("source_urn").alias("urn"), F.lit("DOWNSTREAM").alias("direction"),
                 F.col("target_urn").alias("related_urn")))
    return both.join(queries, ["urn", "direction"])


def graph_from_lineage(lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of ``lineage(seed_urn, related_urn, type, seq)``.

    Every seed is a node; rows without a related reference add nothing; a missing type is
    DownstreamOf; nodes are kept once per seed graph, edges once per triple.
    """
    rel = lineage.where("coalesce(related_urn, '') <> ''")
    ends = lineage.select("seed_urn", F.col("seed_urn").alias("urn")).unionByName(
        rel.select("seed_urn", F.col("related_urn").alias("urn"))).distinct()
    nodes = ends.select("seed_urn", "urn", tx.urn_node_type(F.col("urn")).alias("node_type"),
                        tx.urn_platform(F.col("urn")).alias("platform"))
    edges = rel.select("seed_urn", F.col("related_urn").alias("source_urn"), F.col("seed_urn").alias("target_urn"),
                       F.coalesce("type", F.lit("DownstreamOf")).alias("edge_type")).distinct()
    return nodes, edges


def entity_search(terms: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities whose name holds a term, ranked per term and type; the first ``limit`` if one is given.

    ``terms(term)`` and ``entities(urn, type, name)``.  Names are cut into the substrings
    that have a term's length, so the match is an equi-join spread over all terms rather
    than a comparison of every pair.
    """
    t = terms.select(F.lower("term").alias("term")).distinct()
    lengths = t.agg(F.collect_set(F.length("term")).alias("n"))
    keyed = entities.select("urn", "type", "name", F.lower("name").alias("low"), lengths.scalar().alias("n")).select(
        "urn", "type", "name", F.explode(tx.substrings(F.col("low"), F.col("n"))).alias("term"))
    hits = keyed.join(t, "term")
    return first_n(hits, ["term", "type"], ["urn"], limit)


def enrich_entities(payload_terms: DataFrame, entities: DataFrame, edges: DataFrame, lead: int = 2) -> tuple[DataFrame, DataFrame]:
    """Entities and upstream lineage for ``payload_terms(payload_id, term, pos)``.

    Entities are distinct by urn per payload; lineage follows the ``lead`` first hits of a term.
    """
    hits = entity_search(payload_terms, entities)
    found = first_pairs(payload_terms.select("payload_id", "pos", F.lower("term").alias("term")), hits.select("urn", "term"))
    ranked = hits.withColumn("k", F.struct("type", "rn"))
    two = first_n(ranked.drop("rn"), ["term"], ["k"], lead).select("term", "urn")
    lineage = related(edges, two.select("urn").distinct().withColumn("direction", F.lit("UPSTREAM")))
    up = (
        payload_terms.select("payload_id", F.lower("term").alias("term")).distinct()
        .join(two, "term").select("payload_id", "urn").distinct()
        .join(lineage, "urn").select("payload_id", "urn", F.col("related_urn").alias("upstream_urn")).distinct()
    )
    return found, up


#: Terms' rows of one side of a tile of :func:`first_pairs`, and pairs that one task compares.
TILE, TASK_PAIRS = 1_000, 2_000_000


def first_pairs(payload_terms: DataFrame, hits: DataFrame) -> DataFrame:
    """Every pair of payload and urn that share a term, once, with the first place ``pos`` of such a term.

    ``payload_terms(payload_id, pos, term)`` and ``hits(urn, term)``.  Pairs are never grouped: a pair that shares several
    terms comes from the first of them, because a payload's term carries the terms before it and an urn all of its
    own.  A term's pairs are cut into tiles of :data:`TILE` rows by as many, so no term lies in one task; the terms of a payload,
    and of an urn, meet in one row.
    """
    places = payload_terms.where("term is not null").groupBy("payload_id", "term").agg(F.min("pos").alias("pos"))
    terms = places.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("terms"))
    left = cut_lineage(terms.select("payload_id", "terms", F.posexplode("terms").alias("k", "at")).select(
        "payload_id", "at.pos", "at.term", F.slice(F.col("terms.term"), F.lit(1), F.col("k")).alias("before")))
    urns = hits.groupBy("urn").agg(F.collect_set("term").alias("has"))
    right = cut_lineage(urns.select("urn", "has", F.explode("has").alias("term")))
    sizes = cut_lineage(left.groupBy("term").agg(F.count("*").alias("n_left")).join(
        right.groupBy("term").agg(F.count("*").alias("n_right")), "term"))
    pairs = sizes.agg(F.sum(F.col("n_left").cast("double") * F.col("n_right"))).first()[0] or 0
    n = max(left.sparkSession.sparkContext.defaultParallelism, -(-int(pairs) // TASK_PAIRS))

    def tiled(df: DataFrame, own: str, other: str, own_id: str) -> DataFrame:
        """Rows with the tile they lie in on their side, once for each tile of the other side."""
        tiles = lambda c: F.ceil(F.col(c) / TILE)
        rows = df.join(sizes, "term").withColumn(own, F.pmod(F.xxhash64(own_id), tiles(f"n_{own}")))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), tiles(f"n_{other}") - 1)))
        # A number of its own keeps adaptive execution from joining tasks whose input is small, but whose pairs are many.
        return rows.drop("n_left", "n_right").repartition(n, "term", "left", "right")

    new = ~F.arrays_overlap("k.before", "h.has")
    same = (F.col("k.term") == F.col("h.term")) & (F.col("k.left") == F.col("h.left")) & (F.col("k.right") == F.col("h.right"))
    return tiled(left, "left", "right", "payload_id").alias("k").join(
        shuffled(tiled(right, "right", "left", "urn")).alias("h"), same & new).select("k.payload_id", "h.urn", "k.pos")


def aspect_pivot(aspects: DataFrame) -> DataFrame:
    """``(urn, aspect, value)`` to one row per urn with the five named aspects."""
    return aspects.groupBy("urn").pivot("aspect", rules.ASPECTS).agg(F.first("value", ignorenulls=True))


def graph_documents(edges: DataFrame, key: str, seq: str) -> DataFrame:
    """The edges of each graph as one JSON document, order kept.

    Edges are put in order over all tasks and rendered in blocks of :data:`BLOCK`.  A document is one value, so the finished
    texts of a graph's blocks meet in one row by definition, but never its edges.
    """
    ends = ["source_urn", "target_urn", "edge_type"]
    rows = positions(edges.select(key, seq, *ends), [key], [seq, *ends])
    item = F.struct("pos", F.to_json(F.struct(*ends)).alias("text"))
    blocks = rows.groupBy(key, F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(joined_in_order(item))
    return blocks.groupBy(key).agg(joined_in_order(F.struct("block", "text"))).select(
        key, F.concat(F.lit('{"edges":['), "text", F.lit("]}")).alias("doc"))


#: Edges whose texts are joined in one row before a graph's document is.
BLOCK = 10_000


def joined_in_order(item: Column) -> Column:
    """The texts of struct(place, text) by place, comma-joined."""
    return F.array_join(F.array_sort(F.collect_list(item))["text"], ",").alias("text")
