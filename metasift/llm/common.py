"""Shared pieces of the training-data operators: tables, scratch tables, byte-level words, components."""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.session import scratch_path

#: Bytes of text that the vectorised routines hold at once; a longer single text is held alone.
CHUNK_BYTES = 1_000_000


def release() -> None:
    """Give freed memory back to the system; workers stay between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(work: Callable | None = None, seconds: float = 0) -> Callable:
    """A batch function that gives memory back after what it hands on, at most once in so many seconds, and at its end."""
    if work is None:
        return functools.partial(tidy, seconds=seconds)

    @functools.wraps(work)
    def run(batches):
        last = time.monotonic()
        for out in work(batches):
            yield out
            del out
            if time.monotonic() - last >= seconds:
                release()
                last = time.monotonic()
        release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, columns still prune."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession, rows: int = 2_000) -> str:
    """Arrow batches of at most so many rows from here on, for texts are long; the setting before."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000):
    """:func:`lean` while the block runs."""
    before = lean(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str | Column) -> Column:
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("string"), F.lit(""))


def joined_spans(spans: str | Column) -> Column:
    """``kind:start:end`` of an array of (kind, start, end), comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# --- texts as bytes -------------------------------------------------------------------------

def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and the offset of each text; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "").cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row comes alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _lower() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


LOWER = _lower()
#: Word bytes once A-Z is lower case: digits, a-z and everything outside ASCII.
WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of ``member`` bytes, and per text the index of its first run (one more at the end)."""
    inside = member[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = False
    after[edges[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 65_536)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


_DIGITS = LOWER.astype(np.uint64) + np.uint64(1)


def hash_prefix(data: np.ndarray, digits: np.ndarray = _DIGITS) -> np.ndarray:
    """Sums from which the hash of any run of ``data`` follows, A-Z read as lower case unless ``digits`` tells them apart."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    digits = digits[data]
    digits *= _powers(len(data) + 1)[0][:len(data)]
    np.cumsum(digits, out=prefix[1:])
    return prefix


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run, A-Z read as lower case; equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if prefix is None:
        prefix = hash_prefix(data)
    down = _powers(len(data) + 1)[1]
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``width`` consecutive words at every position that has them, and per text the index of its first one.

    A text with fewer words, but not none, has one run: all its words."""
    n = np.diff(first)
    per = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(per)))
    total = int(begin[-1])
    row = np.repeat(np.arange(len(n)), per)
    at = np.arange(total) - begin[row] + first[row]
    left = np.minimum(width, n[row])
    out = np.zeros(total, np.uint64)
    for k in range(width):
        here = k < left
        word = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(here, out * np.uint64(0x100000001B3) + word, out)
    return mix(out + left.astype(np.uint64)), begin


# --- connected components -------------------------------------------------------------------

def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every node that has an edge.

    Alternating star contraction: each round hangs every node's larger neighbours, then its smaller ones,
    on its smallest neighbour.  Only minima are aggregated, so a node with many edges combines before the
    shuffle, and the joins back on it may be split.  Rounds grow with the logarithm of the diameter.
    Each round is written to the shared folder; the driver sees one checksum a round."""
    links = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = saved(small, "links")
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
