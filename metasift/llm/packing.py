"""Packing: examples into sequences of bounded tokens, segments and loss-bearing tokens.

Each task tokenises its texts and packs them in blocks by vector bin packing.  A bin is filled one example at a time:
of the examples that fit all three limits, the one with the largest dot product of its demand with the room
left, weighted by the block's mean demand per dimension.  Examples longer than a sequence are cut into whole
sequences and a rest.  Nothing is shuffled: every task packs thousands of examples, so its last sequence hardly counts.

Cases: a null or empty text is its end token alone; a null id stays null; repeated rows are packed each; an empty table gives no rows;
a very long text is tokenised whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import chunks, text_or_empty, tidy, utf8
from metasift.llm.subwords import REMEMBERED, Subwords, default_tokenizer

LENGTH = 4096
#: Segments (pieces of examples) that one sequence may hold.
SEGMENTS = 512
END_ID = 2
#: Tokens and pieces a task holds before it packs them.
BLOCK_TOKENS, BLOCK_PIECES = 24_000_000, 100_000


def fill(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every item and its place in the bin.  ``demand`` has one row per item: tokens, segments, loss tokens."""
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    taken = np.cumsum(left) - left
    share = kinds / limits
    weight = demand.mean(axis=0) / limits
    weighted = share * weight
    bins, places = np.zeros(len(demand), np.int64), np.zeros(len(demand), np.int64)
    done, b = 0, 0
    alive = np.arange(len(kinds))
    while done < len(demand):
        room, place = limits.astype(np.float64).copy(), 0
        fits = alive
        while len(fits):
            fits = fits[(kinds[fits] <= room).all(axis=1)]
            if not len(fits):
                break
            best = fits[np.argmax(weighted[fits] @ (room / limits))]
            item = order[taken[best]]
            bins[item], places[item] = b, place
            taken[best] += 1
            left[best] -= 1
            done, place = done + 1, place + 1
            room -= kinds[best]
            if not left[best]:
                fits = fits[fits != best]
        alive = alive[left[alive] > 0]
        b += 1
    return bins, places


def cut(total: int, prompt: int, length: int) -> list[tuple[int, int, int]]:
    """(start, length, loss tokens) of an example's pieces; the first ``prompt`` tokens bear no loss."""
    return [(s, min(length, total - s), max(0, min(s + length, total) - max(s, prompt))) for s in range(0, total, length)]


def _packer(path: str, length: int, segments: int, loss: int, end_id: int, with_ids: bool, out: pa.Schema, remembered: int):
    limits = np.array([length, segments, loss])
    step = min(length, loss)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), Subwords.of(path, remembered)
        next_id = part << 40
        docs: list = []
        rows: list[tuple] = []
        held = 0
        end = np.array([end_id], "<u4")

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            own = np.array([r[1:4] for r in rows], np.int64)
            demand = np.stack([own[:, 1], np.ones(len(rows), np.int64), own[:, 2]], axis=1)
            bins, places = fill(demand, limits)
            order = np.lexsort((places, bins))
            sizes = own[order, 1]
            before = np.cumsum(sizes) - sizes
            new = np.append(True, bins[order][1:] != bins[order][:-1])
            offset = np.empty(len(rows), np.int64)
            offset[order] = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(rows))))
            for lo in range(0, len(rows), 10_000):
                some = rows[lo:lo + 10_000]
                cols = [docs[lo:lo + 10_000], [r[1] for r in some], [r[2] for r in some], [r[4] for r in some], [r[5] for r in some], (bins[lo:lo + 10_000] + next_id).tolist(), offset[lo:lo + 10_000].tolist(), [r[3] for r in some]]
                if with_ids:
                    cols.append([r[6] for r in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)
            next_id += int(bins.max()) + 1

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in chunks(offsets):
                off = offsets[lo:hi + 1]
                bodies, at = tokens.encode(data[off[0]:off[-1]], off - off[0])
                prompts, before = tokens.encode(*utf8(batch.column(1).slice(lo, hi - lo)))
                for k, ident in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    lead = int(before[k + 1] - before[k])
                    ids = np.concatenate([prompts[before[k]:before[k + 1]], bodies[at[k]:at[k + 1]], end])
                    for s, n, bearing in cut(len(ids), lead, step):
                        piece = ids[s:s + n]
                        docs.append(ident)
                        rows.append((ident, s, n, bearing, zlib.crc32(piece.tobytes()), len(ids), piece.tolist() if with_ids else None))
                        held += n
                if held >= BLOCK_TOKENS // (8 if with_ids else 1) or len(rows) >= BLOCK_PIECES:
                    yield from close()
                    docs.clear()
                    rows.clear()
                    held = 0
        if rows:
            yield from close()

    return pack


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None, tokenizer: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, end_id: int = END_ID, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if asked, ids.

    ``prompt`` names a column of text that comes first and bears no loss.  ``sequence_id`` holds the task in its upper bits."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    ddl = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names) + (", ids array<long>" if with_ids else "")
    schema = pa.schema([("doc_id", to_arrow_type(kind))] + [(n, pa.int64()) for n in names] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (text_or_empty(prompt) if prompt else F.lit("")).alias("p"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(_packer(tokenizer or default_tokenizer(), length, segments, loss or length, end_id, with_ids, schema, remembered), ddl)
