"""Benchmark decontamination: Wu-Manber search for many word windows at once.

A *window* is ``width`` consecutive words of a benchmark item, or the whole item if it has fewer words.
Windows of one length form a group.  For each group a shift table over hashed two-word blocks says how far
a text position may move without passing an occurrence; where the shift is zero, the block's suffix bucket
gives the windows to test, and direct comparison of the words' bytes confirms them.  Texts are walked in many
lanes at once, each lane a stretch of window ends.

Cases: null and empty texts have no words and no hits; null items have no windows; repeated items count
once by id, a null id reads as an empty one; an empty benchmark hits nothing; all other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import LOWER, chunks, fresh, mix, saved, text_or_empty, tidy, utf8, word_hashes, words

WIDTH = 13
#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is searched in blocks of that size.
BLOCK_BYTES = 2_000_000
LANE = 128
RESULT = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


@dataclass
class Group:
    """The windows of one length."""

    length: int
    shift: np.ndarray
    buckets: dict[int, list[int]]
    windows: list[bytes]
    owners: list[list[str]]


@dataclass
class Patterns:
    width: int = WIDTH
    groups: list[Group] = field(default_factory=list)


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each position; the first positions are not used."""
    if size == 1:
        return h
    out = h.copy()
    out[1:] = mix(h[1:] + h[:-1] * np.uint64(31))
    return out


def compile_patterns(items: list[tuple[str | None, str | None]], width: int = WIDTH) -> Patterns:
    """Shift tables and suffix buckets for the windows of ``items``."""
    by_length: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for ident, text in items:
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]))
        parts = [raw[s:e].lower() for s, e in zip(starts, ends, strict=True)]
        if parts:
            m = min(width, len(parts))
            for k in range(len(parts) - m + 1):
                by_length[m][b" ".join(parts[k:k + m])].add("" if ident is None else ident)
    out = Patterns(width)
    for m, found in sorted(by_length.items()):
        size = min(2, m)
        bits = max(12, int(np.ceil(np.log2(len(found) * m + 1))) + 3)
        shift = np.full(1 << bits, m - size + 1, np.int64)
        buckets: dict[int, list[int]] = defaultdict(list)
        windows = sorted(found)
        for k, window in enumerate(windows):
            data = np.frombuffer(window, np.uint8)
            s, e, _ = words(data, np.array([0, len(data)]))
            block = _blocks(word_hashes(data, s, e), size)[size - 1:]
            slot = (block & np.uint64(len(shift) - 1)).astype(np.int64)
            np.minimum.at(shift, slot, m - size - np.arange(len(slot)))
            buckets[int(block[-1])].append(k)
        out.groups.append(Group(m, shift, dict(buckets), windows, [sorted(found[w]) for w in windows]))
    return out


def _candidates(block: np.ndarray, first: np.ndarray, group: Group) -> np.ndarray:
    """Positions of window ends that the shift table cannot rule out."""
    n = np.diff(first)
    ends = np.maximum(n - group.length + 1, 0)
    lanes = -(-ends // LANE)
    row = np.repeat(np.arange(len(n)), lanes)
    at = first[row] + group.length - 1 + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(at + LANE, first[row] + n[row])
    slot_mask = np.uint64(len(group.shift) - 1)
    found = []
    while len(at):
        step = group.shift[(block[at] & slot_mask).astype(np.int64)]
        found.append(at[step == 0])
        at = at + np.maximum(step, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def search(data: np.ndarray, offsets: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Per text: number of words; merged hit ranges of word positions; items with occurring windows."""
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    raw = LOWER[data].tobytes() if patterns.groups else b""
    for group in patterns.groups:
        block = _blocks(h, min(2, group.length))
        for at in _candidates(block, first, group).tolist():
            bucket = group.buckets.get(int(block[at]))
            if not bucket:
                continue
            lo = at - group.length + 1
            text = b" ".join([raw[s:e] for s, e in zip(starts[lo:at + 1].tolist(), ends[lo:at + 1].tolist(), strict=True)])
            for k in bucket:
                if group.windows[k] == text:
                    row = int(np.searchsorted(first, at, "right")) - 1
                    hits[row].append((lo - int(first[row]), at + 1 - int(first[row])))
                    items[row].update(group.owners[k])
    return np.diff(first), {r: merge(v) for r, v in hits.items()}, items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges as a sorted list without overlaps."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _finder(shared) -> Column:
    @tidy
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = shared.value
        for col in batches:
            data, offsets = utf8(col)
            rows: list[dict] = []
            for lo, hi in chunks(offsets):
                part = offsets[lo:hi + 1]
                n, hits, items = search(data[part[0]:part[-1]], part - part[0], patterns)
                rows += [{"n_words": int(c), "hits": [{"start": a, "end": b} for a, b in hits.get(r, ())], "items": sorted(items.get(r, ()))} for r, c in enumerate(n)]
            yield pa.array(rows, _TYPE)

    return F.arrow_udf(find, RESULT).asNondeterministic()


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "contamination", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, hits (merged word ranges, end exclusive), items, n_hit, contaminated.

    The benchmark is measured first.  Up to ``block_bytes`` of it is broadcast at a time; a larger one is searched
    block by block, each block's finds written to the shared folder before the next."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), text_or_empty(item_text).alias("t")).where("t <> ''")
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    out, done = docs, []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        shared = spark.sparkContext.broadcast(compile_patterns([(r.i, r.t) for r in part.collect()], width))
        done.append(fresh(out, f"found_{k}"))
        out = out.withColumn(done[-1], _finder(shared)(text_or_empty(text)))
        if n > 1:
            out = saved(out, "contamination")
    first = F.col(done[0])
    if n == 1:
        ranges, ids = first["hits"], first["items"]
    else:
        every = F.array_sort(F.flatten(F.array(*[F.col(c)["hits"] for c in done])))
        ranges = F.aggregate(every, F.expr("cast(array() as array<struct<start:long,end:long>>)"), _absorb)
        ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["items"] for c in done]))))
    out = out.withColumn(name, F.struct(first["n_words"].alias("n_words"), ranges.alias("hits"), ids.alias("items"))).drop(*done)
    n_hit = F.aggregate(F.col(name)["hits"], F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.withColumn(name, F.col(name).withField("n_hit", n_hit)).withColumn(
        name, F.col(name).withField("contaminated", (F.col(name)["n_hit"] > 0) & (F.col(name)["n_hit"] * 20 >= F.col(name)["n_words"]))
    )


def _absorb(acc: Column, r: Column) -> Column:
    """Append ``r``, or widen the last range by it."""
    last = F.element_at(acc, -1)
    touches = (F.size(acc) > 0) & (r["start"] <= F.try_element_at(acc, F.lit(-1))["end"])
    widened = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
    return F.when(touches, widened).otherwise(F.concat(acc, F.array(r)))

