"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions; each projection, shifted and quantised with step ``w``,
gives one part of a bucket key, ``k`` parts make a key and every table has its own key.  ``k`` follows from the number
of vectors (unrelated vectors should seldom meet), the number of tables from the wanted recall at the threshold.

Vectors with equal unit vectors are one class, compared once with its number of copies.  Buckets are compared many at a time; a
large one in tiles of ``tile`` x ``tile`` classes, so a hot bucket spreads over many tasks.  A pair is counted in the first table where it
meets.  A task gives per class the number of links it found and a spanning forest of its links, never the pairs.

Cases: null, empty, zero and non-finite vectors link with nothing; vectors of every length are hashed by directions of their own, and those of
different lengths never link; rows of a repeated id are vectors of their own that share a component; a null id links with nothing; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import components, mix, saved, tidy

THRESHOLD = 0.95
STEP = 1.5
RECALL = 0.99
TILE = 512
#: Rows of dealt buckets that one task compares at a time, a whole tile pair at least.
GROUP_ROWS = 8_192
#: Up to this size a bucket's rows are compared by their distance in the sorted order, all buckets at once.
SMALL = 48
SEED = 20_011


def collision(distance: float, step: float) -> float:
    """The chance that one quantised projection agrees for vectors so far apart."""
    r = step / distance
    cdf = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float = THRESHOLD, step: float = STEP, recall: float = RECALL) -> tuple[int, int]:
    """Projections a key and number of tables: in a table a vector meets an unrelated (orthogonal) one with a chance of a quarter."""
    near, far = collision(math.sqrt(2 - 2 * threshold), step), collision(math.sqrt(2), step)
    k = max(2, math.ceil(math.log(4 * max(rows, 2)) / -math.log(far)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - near**k))
    return k, tables


def unit(values: list | np.ndarray | None) -> np.ndarray | None:
    """The normalised vector in double precision, or None where it links with nothing."""
    if values is None or not len(values):
        return None
    v = np.array([np.nan if x is None else x for x in values], np.float64) if not isinstance(values, np.ndarray) else values.astype(np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max(initial=0)
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def keys(x: np.ndarray, k: int, tables: int, step: float = STEP, seed: int = SEED) -> np.ndarray:
    """Bucket keys (rows x tables) of unit vectors, from directions that only ``seed`` and the sizes fix."""
    rng = np.random.default_rng([seed, x.shape[1], k, tables])
    directions = rng.standard_normal((x.shape[1], k * tables))
    shifts = rng.uniform(0, step, k * tables)
    cells = np.floor((x @ directions + shifts) / step).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
    out = np.zeros((len(x), tables), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x100000001B3) + cells[:, :, j] + np.uint64(j + 1))
    return out.view(np.int64)


def stacked(packed: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(u) for u in packed])


def _hasher(k: int, tables: int):
    @tidy
    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                rows = batch.slice(lo, 2_000).to_pylist()
                units = [unit(r["embedding"]) for r in rows]
                size = np.array([0 if u is None else len(u) for u in units])
                found: list = [None] * len(units)
                for d in set(size.tolist()) - {0}:
                    at = np.flatnonzero(size == d).tolist()
                    for i, own in zip(at, keys(np.stack([units[i] for i in at]), k, tables).tolist(), strict=True):
                        found[i] = own
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["row"] for r in rows], pa.int64()), pa.array([r["node"] for r in rows], pa.int64()),
                    pa.array([None if u is None else u.tobytes() for u in units], pa.binary()),
                    pa.array(found, pa.list_(pa.int64())),
                ], ["row", "node", "unit", "keys"])

    return hash_rows


def close_pairs(x: np.ndarray, cell: np.ndarray, side: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of linked rows of one cell.  Rows come sorted by cell; ``apart`` marks cells that compare two tiles."""
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(first, len(cell)))
    out = []
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:])
        if not len(i):
            break
        i = i[~apart[i] | (side[i] != side[i + d])]
        for lo in range(0, len(i), 8_192):
            k = i[lo:lo + 8_192]
            k = k[np.einsum("ij,ij->i", x[k], x[k + d]) >= threshold]
            out.append((k, k + d))
    for lo, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        close = np.triu(x[lo:lo + n] @ x[lo:lo + n].T >= threshold, 1)
        if apart[lo]:
            close &= side[lo:lo + n, None] != side[None, lo:lo + n]
        i, j = np.nonzero(close)
        out.append((i + lo, j + lo))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[i for i, _ in out]]), np.concatenate([none, *[j for _, j in out]])


def meet_first(x: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Which pairs meet in no table before ``table``."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own = keys(x[used], k, tables)
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 50_000):
        hi = min(lo + 50_000, len(i))
        same = own[at[lo:hi]] == own[at[len(i) + lo:len(i) + hi]]
        out[lo:hi] = np.argmax(same, axis=1) == table[lo:hi]
    return out


def forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Indices of edges that span the graph's components."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for e, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = top(p), top(q)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(e)
    return out


def _linker(k: int, tables: int, threshold: float):
    def link(part: pd.DataFrame) -> pd.DataFrame:
        """Classes of many cells, of one length: links per class (other is null), and a spanning forest of vectors (n is null)."""
        part = part.sort_values(["t", "key", "ta", "tb"], ignore_index=True)
        x, table = stacked(part["unit"]), part["t"].to_numpy()
        name = part[["t", "key", "ta", "tb"]].to_numpy()
        cell = np.cumsum(np.append(True, (name[1:] != name[:-1]).any(axis=1)))
        i, j = close_pairs(x, cell, part["side"].to_numpy(), (part["ta"] != part["tb"]).to_numpy(), threshold)
        if len(i):
            first = meet_first(x, i, j, table[i], k, tables)
            i, j = i[first], j[first]
        row, node, copies = part["row"].to_numpy(), part["node"].to_numpy(), part["copies"].to_numpy()
        rows, at = np.unique(np.concatenate([row[i], row[j]]), return_inverse=True)
        n = np.zeros(len(rows), np.int64)
        np.add.at(n, at, np.concatenate([copies[j], copies[i]]))
        span = forest(node[i], node[j])
        return pd.DataFrame({
            "node": np.concatenate([rows, node[i][span]]).astype("int64"),
            "other": pd.array([pd.NA] * len(rows) + node[j][span].tolist(), "Int64"),
            "n": pd.array(n.tolist() + [pd.NA] * len(span), "Int64"),
        })

    return link


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id``, n_links, component_id (smallest reachable id), kept (id equals component)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("node"), F.col(embedding).cast("array<double>").alias("embedding"))
    size = rows.where("size(embedding) > 0").count()
    k, tables = plan(size, threshold)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "node", "embedding")
    hashed = saved(rows.mapInArrow(_hasher(k, tables), "row long, node long, unit binary, keys array<long>").withColumn("same", F.sha2("unit", 256)), "hashed")
    live = hashed.where("node is not null and unit is not null")
    sizes = saved(live.groupBy("same").agg(F.min("row").alias("row"), F.min("node").alias("least"), F.count("*").alias("copies")), "classes")
    classes = saved(sizes.join(live.select("row", "unit", "keys"), "row").select("row", F.col("least").alias("node"), "copies", "unit", F.octet_length("unit").alias("d"), "keys"), "hashed")
    met = classes.select("row", "d", F.posexplode("keys").alias("t", "key"))
    counts = saved(met.groupBy("d", "t", "key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    work = counts.agg(F.sum(F.col("size") * F.ceil(F.col("size") / tile))).first()[0] or 0
    groups = max(1, math.ceil(work / GROUP_ROWS))
    buckets = met.join(counts, ["d", "t", "key"]).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    buckets = buckets.withColumn("mine", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    dealt = buckets.select("d", "t", "key", "row", F.explode(F.transform(every, lambda o: F.struct(
        F.least("mine", o).alias("ta"), F.greatest("mine", o).alias("tb"), F.when(F.col("mine") <= o, 0).otherwise(1).alias("side"),
    ))).alias("x")).select("d", "t", "key", "row", "x.*")
    group = F.pmod(F.xxhash64("t", "key", "ta", "tb"), F.lit(groups)).alias("g")
    tiles = dealt.join(classes.select("row", "node", "copies", "unit"), "row").select("*", group).groupBy("d", "g")
    found = saved(tiles.applyInPandas(_linker(k, tables, threshold), "node long, other long, n long"), "links")
    degree = found.where("n is not null").groupBy(F.col("node").alias("row")).agg(F.sum("n").alias("links"))
    of_class = saved(sizes.join(degree, "row", "left").select("same", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "degrees")
    # Copies hang on the least id of their class; ids that occur in several classes tie these together.
    known = saved(hashed.select("node", F.when(F.col("node").isNotNull(), F.col("same")).alias("same")).join(of_class, "same", "left").select("node", "least", "n_links"), "known")
    edges = found.where("other is not null").select("node", "other").unionByName(known.where("least <> node").select("node", F.col("least").alias("other")).distinct())
    linked = components(edges, "node", "other")
    root = F.coalesce("component", "node")
    return known.join(linked, "node", "left").select(
        F.col("node").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        root.alias("component_id"), (root == F.col("node")).alias("kept"),
    )
