"""Near-duplicate documents: BagMinHash signatures of word-shingle multisets, banding, exact overlap.

Every shingle owns Poisson processes over (time, weight): one for each of the weight intervals [0,1), [1,2), [2,4),
[4,8) ...  A point is kept when its weight coordinate lies under the shingle's count; it names a signature slot,
and a slot keeps the earliest time.  Two slots agree with the chance of the weighted Jaccard similarity.
Rates double with the intervals, so a count costs its logarithm, and points later than the latest slot
of a document are never drawn.

Documents with the same words form a class first; one of each class is banded.  In a bucket every member is checked
against the smallest one.  Buckets whose other members still lie in different groups are then compared in
tiles, each task giving a spanning forest.  No pair that shares a band goes unchecked unless its sides are linked already.

Cases: null and empty texts have no words and are alone, each its own class; fewer than ``width`` words are one shingle;
repeated ids and repeated rows are rows of their own, of which one is kept; a null id is never a class id if any
member has one; clashing names are avoided; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import chunks, components, fresh, mix, run_hashes, saved, text_or_empty, tidy, utf8, word_hashes, words

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
SLOTS = BANDS * ROWS
TILE = 128
#: Row numbers that may be broadcast; beyond that rows are joined.
BROADCAST_ROWS = 4_000_000
SIGNED = "n_words long, fp array<long>, keys array<long>"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def multisets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of every distinct shingle of every text; words per text; two fingerprints per text."""
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    at = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
    marks = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    for j, salt in enumerate((GOLDEN, np.uint64(0xD6E8FEB86659FD93))):
        if len(some):
            marks[some, j] = np.add.reduceat(mix(h + (at + np.uint64(j + 1)) * salt), first[some])
    g, begin = run_hashes(h, first, width)
    row = np.repeat(np.arange(len(n)), np.diff(begin))
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], g[at], np.diff(np.append(at, len(g))), n, marks


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, g: np.ndarray, count: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """Earliest kept time per row and slot; infinite for rows without shingles."""
    out = np.full((rows, slots), np.inf)
    # Roots: the weight intervals that begin under a shingle's count.
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    src = np.repeat(np.arange(len(g)), levels)
    level = np.arange(len(src)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    size = np.where(level == 0, 1.0, low)
    row, weight = row[src], count[src]
    state = mix(g[src] + level.astype(np.uint64) * GOLDEN)
    step = -1.0 / (slots * size)
    state = mix(state + GOLDEN)
    time = np.log(_uniform(state)) * step
    total = np.bincount(row, weight * (level == 0), rows)
    bound = (np.log(slots) + 4) / np.maximum(total, 1)
    top = np.where(total > 0, np.inf, 0.0)
    flat = out.reshape(-1)
    alive = np.arange(len(src))
    while True:
        limit = np.minimum(bound, top)
        at = alive[time[alive] < limit[row[alive]]]
        while len(at):
            place = mix(state[at] ^ np.uint64(0xA0761D6478BD642F))
            kept = low[at] + (_uniform(place) - 2.0**-53) * size[at] < weight[at]
            slot = (mix(state[at] ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(slots)).astype(np.int64)
            hit = at[kept]
            np.minimum.at(flat, row[hit] * slots + slot[kept], time[hit])
            state[at] = mix(state[at] + GOLDEN)
            time[at] += np.log(_uniform(state[at])) * step[at]
            touched = np.unique(row[at])
            top[touched] = out[touched].max(axis=1)
            limit[touched] = np.minimum(bound[touched], top[touched])
            at = at[time[at] < limit[row[at]]]
        open_rows = top > bound
        if not open_rows.any():
            return out
        bound[open_rows] *= 2
        alive = alive[open_rows[row[alive]]]


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key per row and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        out = mix(out * np.uint64(0x100000001B3) + bits[:, :, j])
    return out.view(np.int64)


_TYPE = pa.struct([("n_words", pa.int64()), ("fp", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


@tidy
def _sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in batches:
        data, offsets = utf8(col)
        parts = []
        for lo, hi in chunks(offsets):
            off = offsets[lo:hi + 1]
            row, g, count, n, marks = multisets(data[off[0]:off[-1]], off - off[0])
            keys = band_keys(signatures(row, g, count, hi - lo))
            some = n > 0
            lists = lambda x: pa.ListArray.from_arrays(np.append(0, np.cumsum(some * x.shape[1])).astype(np.int32), pa.array(x[some].view(np.int64).ravel()))
            parts.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists(marks), lists(keys)], fields=list(_TYPE)))
        yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)


def elements(col: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element) where a shingle's k-th repetition is an element of its own, and elements per row."""
    data, offsets = utf8(col)
    rows, out, n = [], [], []
    for lo, hi in chunks(offsets):
        off = offsets[lo:hi + 1]
        row, g, count, _, _ = multisets(data[off[0]:off[-1]], off - off[0], width)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows.append(np.repeat(row, count) + lo)
        out.append(mix(np.repeat(g, count) + nth.astype(np.uint64) * GOLDEN))
        n.append(np.bincount(rows[-1] - lo, minlength=hi - lo))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(out), np.concatenate(n)


@tidy
def _similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Weighted Jaccard similarity of the texts' shingle multisets."""
    for a, b in batches:
        out = np.zeros(len(a))
        for lo in range(0, len(a), 256):
            ra, ea, na = elements(a[lo:lo + 256])
            rb, eb, nb = elements(b[lo:lo + 256])
            row, e = np.concatenate([ra, rb]), np.concatenate([ea, eb])
            order = np.lexsort((e, row))
            row, e = row[order], e[order]
            both = (e[1:] == e[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][both], minlength=len(na))
            out[lo:lo + 256] = common / np.maximum(na + nb - common, 1)
        yield pa.array(out)


def overlaps(row: np.ndarray, e: np.ndarray, rows: int, block: int = 16_384) -> np.ndarray:
    """Common elements of every two rows; only elements that two rows share are looked at."""
    order = np.argsort(e, kind="stable")
    row, e = row[order], e[order]
    new = np.ones(len(e), bool)
    new[1:] = e[1:] != e[:-1]
    ident = np.cumsum(new) - 1
    often = np.bincount(ident) > 1
    keep = often[ident] if len(ident) else np.zeros(0, bool)
    ident, row = (np.cumsum(often) - 1)[ident[keep]], row[keep]
    out = np.zeros((rows, rows), np.float32)
    for lo in range(0, int(often.sum()), block):
        a, b = np.searchsorted(ident, [lo, lo + block])
        grid = np.zeros((rows, min(block, int(often.sum()) - lo)), np.float32)
        grid[row[a:b], ident[a:b] - lo] = 1
        out += grid @ grid.T
    return out


def _tile_links(threshold: float):
    def link(part: pd.DataFrame) -> pd.DataFrame:
        """Spanning links between rows of different groups in one tile pair; texts are read 2 x tile at most."""
        row, e, n = elements(pa.array(part["text"], pa.large_string()))
        common = overlaps(row, e, len(part))
        group, side, node = part["root"].to_numpy(), part["side"].to_numpy(), part["row"].to_numpy()
        wanted = np.triu(group[:, None] != group[None, :], 1)
        if part["ta"].iat[0] != part["tb"].iat[0]:
            wanted &= side[:, None] != side[None, :]
        i, j = np.nonzero(wanted & (common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6) & (common > 0))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(int(group[p])), top(int(group[q]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(node[p]), int(node[q])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return link


def narrowed(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """``rows`` whose ``on`` is (left_semi) or is not (left_anti) among ``ids``: few ids are broadcast, more are joined."""
    few = ids.count() <= BROADCAST_ROWS  # a written table: its files know
    return rows.join(F.broadcast(ids) if few else ids, on, how)


def _links(reps: DataFrame, texts: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Links (a, b) between rows of ``reps`` that connect whatever shares a band and is similar."""
    met = reps.select("row", F.explode("keys").alias("key"))
    lead = met.groupBy("key").agg(F.min("row").alias("lead"), F.count("*").alias("size")).where("size > 1")
    met = saved(met.join(lead, "key").where("row <> lead"), "met")
    involved = saved(met.select(F.explode(F.array("row", "lead")).alias("row")).distinct(), "involved")
    texts = saved(narrowed(texts, involved, "row", "left_semi"), "texts")
    pairs = met.select("row", "lead").distinct()
    similar = F.arrow_udf(_similar, "double").asNondeterministic()
    pairs = pairs.join(texts, "row").join(texts.select(F.col("row").alias("lead"), F.col("text").alias("lead_text")), "lead")
    star = saved(pairs.select("row", "lead", similar("text", "lead_text").alias("sim")).where(F.col("sim") >= threshold - 1e-9).select(F.col("row").alias("a"), F.col("lead").alias("b")), "star")
    groups = components(star, "a", "b")
    # The members besides the first are linked among themselves only if they lie in one group by now.
    met = met.where("size > 2").select("key", "row").join(groups.withColumnRenamed("node", "row"), "row", "left")
    met = met.select("key", "row", F.coalesce("component", "row").alias("root"))
    mixed = met.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "size")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    left = met.join(mixed, "key").withColumn("tiles", tiles).withColumn("mine", F.pmod(F.xxhash64("row", "key"), F.col("tiles")).cast("int"))
    dealt = left.select("key", "row", "root", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(
        F.least("mine", o).alias("ta"), F.greatest("mine", o).alias("tb"), F.when(F.col("mine") <= o, 0).otherwise(1).alias("side"),
    ))).alias("x")).select("key", "row", "root", "x.*")
    rest = dealt.join(texts, "row").groupBy("key", "ta", "tb").applyInPandas(_tile_links(threshold), "a long, b long")
    return star.unionByName(saved(rest, "rest"))


def _resolved(docs: DataFrame, doc_id: str, text: str, threshold: float, tile: int) -> tuple[DataFrame, DataFrame, str, str]:
    """``docs`` written with row numbers and signatures; (row, best: id and row of its group's kept row); both columns' names."""
    row, sign = fresh(docs, "row"), fresh(docs, "sign")
    signer = F.arrow_udf(_sign, SIGNED).asNondeterministic()
    base = saved(docs.select("*", F.monotonically_increasing_id().alias(row), signer(text_or_empty(text)).alias(sign)), "signed")
    ident: Column = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    rows = base.select(F.col(row).alias("row"), ident.alias("ident"), f"{sign}.fp", f"{sign}.keys").where("size(fp) > 0")
    first = rows.groupBy("fp").agg(F.min("ident").alias("first")).select("fp", F.col("first.row").alias("rep"))
    mapped = saved(rows.join(first, "fp").select("row", "rep", "ident", F.when(F.col("row") == F.col("rep"), F.col("keys")).alias("keys")), "mapped")
    reps = mapped.where("row = rep")
    links = _links(reps, base.select(F.col(row).alias("row"), text_or_empty(text).alias("text")), threshold, tile)
    groups = components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("root"))
    reps = reps.select("rep", "ident").join(groups, "rep", "left").select("rep", "ident", F.coalesce("root", "rep").alias("root"))
    best = reps.groupBy("root").agg(F.min("ident").alias("best"))
    known = mapped.select("row", "rep").join(reps.join(best, "root").select("rep", "best"), "rep").select(F.col("row").alias(row), "best")
    return base, known, row, sign


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "near", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, class_id (smallest id of the group), kept (one row of each group)."""
    base, known, row, sign = _resolved(docs, doc_id, text, threshold, tile)
    out = base.join(known.withColumnRenamed("best", sign + "_best"), row, "left")
    found = F.col(sign + "_best")
    return out.select(*[F.col(c) for c in docs.columns], F.struct(
        F.col(sign)["n_words"].alias("n_words"), F.when(found.isNull(), F.col(doc_id)).otherwise(found["id"]).alias("class_id"),
        (found.isNull() | (found["row"] == F.col(row))).alias("kept"),
    ).alias(name))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` does not keep."""
    base, known, row, _ = _resolved(docs, doc_id, text, threshold, tile)
    gone = saved(known.where(F.col("best.row") != F.col(row)).select(row), "gone")
    return narrowed(base, gone, row, "left_anti").select(*docs.columns)
