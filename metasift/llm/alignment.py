"""Alignment of two tokenizers over the same texts: where their tokens end together, and which tokens then face each other.

Texts are tokenised whole by both.  Both id sequences are cut into windows at anchors: byte offsets where a token of each
starts with a blank, which the offsets of all tokens before them show to be ends shared by both.  A window, mostly one word, is aligned
once; its alignment is remembered by the ids on both sides, and equal windows of a batch are looked up once.

How often each pair of ids is linked is counted over all texts.  Counts go back to the texts in two ways: the most frequent
``HEAD`` pairs are broadcast, and links of rarer ones, none of which is hot, are joined.

Cases: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros
and empty groups.  Null and repeated ids are rows like others; an empty table gives no rows; a very long text is held alone; other
columns are kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import chunks, fresh, mix, saved, text_or_empty, tidy, utf8

#: Pairs that are broadcast with their counts (17 bytes each).
HEAD = 1_000_000
#: Windows whose alignments a worker remembers.
REMEMBERED = 300_000
#: Bytes of text that are aligned at once: the more, the fewer windows are looked up.
ALIGNED_BYTES = 4_000_000
#: An id pair is one number: the first id times this, plus the second.
SECOND = 1 << 24
_BLANK = 32


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Bytes of every id, one after another."""

    def __init__(self, entries: list[bytes]):
        self.pool = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blank = np.array([e[:1] == b" " for e in entries])

    def text(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.pool[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def byte_letters() -> dict[str, int]:
    """Byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file.  Ids that follow the order of the merges are ranks, which ``tiktoken`` reads faster; texts that its pattern
    engine gives up on (long runs of white space) and other files go through ``tokenizers``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
        entries = {k: bytes(letters[c] for c in t) for t, k in vocabulary.items() if k not in added}
        size = max([*entries, *added]) + 1
        self.vocabulary = Vocabulary([entries.get(k, added.get(k, b"")) for k in range(size)])
        merged = [vocabulary.get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in spec["model"]["merges"]]
        step = spec.get("pre_tokenizer") or {}
        ranked = set(letters) <= set(vocabulary) and merged == sorted(x for x in merged if x is not None) and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = None
        if ranked:
            import public_tokenizers

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: k for k, e in entries.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return self._plain(texts)
        out = []
        for t in texts:
            try:
                out.append(self.fast.encode_to_numpy(t))
            except ValueError:
                out += self._plain([t])
        return out

    def gives(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        """Whether the ids' bytes are those of the text.  With every byte in the vocabulary and no normaliser nothing else can come out."""
        if self.fast is not None:
            return int(self.vocabulary.length[ids].sum()) == len(raw)
        return np.array_equal(self.vocabulary.text(ids), raw)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentence-piece model, which puts a blank before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = Vocabulary([self._bytes(k) for k in range(self.model.get_piece_size())])

    def _bytes(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()

    def gives(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        return np.array_equal(self.vocabulary.text(ids), raw)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


class Aligner:
    _copies: dict[tuple[str, str], Aligner] = {}

    def __init__(self, first: str, second: str, remembered: int = REMEMBERED):
        self.a, self.b = ByteLevel(first), Pieces(second)
        # How an id reads inside its group and at the end of it, for both sides.
        sizes = [len(x.vocabulary.length) for x in (self.a, self.b)]
        self.written = np.array([f"{k}{mark}" for n, marks in zip(sizes, (",|", ",;"), strict=True) for mark in marks for k in range(n)], object)
        self.shift = (sizes[0], 2 * sizes[0], 2 * sizes[0] + sizes[1])
        #: By the ids of both sides, four bytes each.
        self.memo: dict[tuple[bytes, bytes], tuple[str, np.ndarray]] = {}
        self.remembered = remembered

    @classmethod
    def of(cls, first: str, second: str) -> Aligner:
        """The worker's own copy."""
        if (first, second) not in cls._copies:
            cls._copies[first, second] = cls(first, second)
        return cls._copies[first, second]

    def windows(self, ids: list[tuple[bytes, bytes]]) -> list[tuple[str, np.ndarray]]:
        """Groups as text and linked pairs of every window; those not remembered are aligned together."""
        found = list(map(self.memo.get, ids))
        new = [k for k, got in enumerate(found) if got is None]
        if new:
            sides = [np.frombuffer(b"".join([ids[k][side] for k in new]), "<u4").astype(np.int64) for side in (0, 1)]
            counts = [np.array([len(ids[k][side]) // 4 for k in new]) for side in (0, 1)]
            for k, got in zip(new, self.align_windows(*sides, *counts), strict=True):
                found[k] = got
                if len(self.memo) < self.remembered:
                    self.memo[ids[k]] = got
        return found

    def align_windows(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Alignments of windows that stand one after another, ``n_a`` and ``n_b`` ids each; their bytes are the same on both sides."""
        ends = [np.cumsum(v.length[side]) for side, v in ((a, self.a.vocabulary), (b, self.b.vocabulary))]
        spot = np.zeros(int(ends[0][-1]) + 1, np.uint8)
        for k, e in enumerate(ends):
            spot[e] |= 1 << k
        closing = [spot[e] == 3 for e in ends]
        last = [np.flatnonzero(c) for c in closing]
        # A group's ids of the first side stand before those of the second: each id moves by the other side's ids before it.
        group = [np.cumsum(c) - c for c in closing]
        before = np.append(0, last[1] + 1)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before[group[0]]] = a + closing[0] * self.shift[0]
        order[np.arange(len(b)) + last[0][group[1]] + 1] = b + np.where(closing[1], self.shift[2], self.shift[1])
        written = self.written[order].tolist()
        links = a[last[0]] * SECOND + b[last[1]]
        stop = np.cumsum(n_a + n_b)
        of_links = group[0][np.cumsum(n_a) - 1] + 1
        for lo, hi, p, q in zip((stop - n_a - n_b).tolist(), stop.tolist(), [0, *of_links[:-1].tolist()], of_links.tolist(), strict=True):
            yield "".join(written[lo:hi])[:-1], links[p:q]

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text: ids on both sides and groups as text; then the pair of every link and each text's first link."""
        n = len(texts)
        sizes = np.zeros((2, n), np.int64)
        kept, ids, total = [], ([], []), 0
        full = [k for k in range(n) if texts[k]]
        spaced = [" " + texts[k] for k in full]
        for k, text, x, y in zip(full, spaced, self.a.encode(spaced), self.b.encode([texts[k] for k in full]), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            if self.a.gives(x, raw) and self.b.gives(y, raw):
                kept.append((k, total))
                ids[0].append(x)
                ids[1].append(y)
                sizes[:, k] = len(x), len(y)
                total += len(raw)
        groups, links, first = [""] * n, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if not kept:
            return sizes[0], sizes[1], groups, links, first
        sides, starts = [np.concatenate(x) for x in ids], []
        for side, v in zip(sides, (self.a.vocabulary, self.b.vocabulary), strict=True):
            long = v.length[side]
            starts.append(np.cumsum(long) - long)
        # Anchors: shared ends before tokens that start with a blank on both sides, and the beginnings of texts.
        heads = np.array([at for _, at in kept], np.int64)
        spot = np.zeros(total, np.uint8)
        for k, (side, v) in enumerate(zip(sides, (self.a.vocabulary, self.b.vocabulary), strict=True)):
            spot[starts[k][v.blank[side]]] |= 1 << k
        spot[heads] = 3
        anchors = np.flatnonzero(spot == 3)
        cuts, key = [], np.zeros(len(anchors), np.uint64)
        for side, start in zip(sides, starts, strict=True):
            number = np.zeros(total, np.int32)  # of the token that starts at a byte
            number[start] = np.arange(len(start), dtype=np.int32)
            cuts.append(np.append(number[anchors], len(start)))
            key = mix(key) + _run_keys(side, cuts[-1])
        _, some, which = np.unique(key, return_index=True, return_inverse=True)
        raw = [side.astype("<u4").tobytes() for side in sides]
        bounds = [((4 * c[some]).tolist(), (4 * c[some + 1]).tolist()) for c in (x.astype(np.int64) for x in cuts)]
        found = self.windows([(raw[0][p:q], raw[1][r:s]) for p, q, r, s in zip(*bounds[0], *bounds[1], strict=True)])
        words = np.empty(len(found), object)
        words[:] = [t for t, _ in found]
        count = np.array([len(p) for _, p in found], np.int64)
        pool = np.concatenate([p for _, p in found])
        begin = np.cumsum(count) - count
        per = count[which]
        links = pool[np.repeat(begin[which] - np.cumsum(per) + per, per) + np.arange(int(per.sum()))]
        before = np.append(0, np.cumsum(per))
        edge = np.append(np.searchsorted(anchors, heads), len(anchors))
        for j, (k, _) in enumerate(kept):
            groups[k] = ";".join(words[which[edge[j]:edge[j + 1]]].tolist())
            first[k + 1] = before[edge[j + 1]] - before[edge[j]]
        return sizes[0], sizes[1], groups, links, np.cumsum(first)


def _run_keys(ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ids between neighbouring cuts."""
    at = np.arange(len(ids), dtype=np.uint64) - np.repeat(cut[:-1].astype(np.uint64), np.diff(cut))
    total = np.append(np.uint64(0), np.cumsum(mix(ids.astype(np.uint64) + (at << np.uint64(32)) + np.uint64(1)), dtype=np.uint64))
    return mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64))


ALIGNED = "n_a long, n_b long, groups string, pairs array<long>, times array<int>"
_TYPE = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _aligner(first: str, second: str):
    @tidy(seconds=1)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = Aligner.of(first, second)
        for col in batches:
            _, offsets = utf8(col)
            parts = []
            for lo, hi in chunks(offsets, ALIGNED_BYTES):
                n_a, n_b, groups, links, at = tool.align(col.slice(lo, hi - lo).to_pylist())
                # Equal pairs of a text once, with their number.
                text = np.repeat(np.arange(hi - lo), np.diff(at))
                order = np.lexsort((links, text))
                text, links = text[order], links[order]
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (links[1:] != links[:-1]))[:len(links)])
                lists = pa.array(np.searchsorted(text[new], np.arange(hi - lo + 1)), pa.int32())
                parts.append(pa.StructArray.from_arrays([
                    pa.array(n_a), pa.array(n_b), pa.array(groups, pa.string()), pa.ListArray.from_arrays(lists, pa.array(links[new], pa.int64())),
                    pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(new, len(links))), pa.int32())),
                ], fields=list(_TYPE)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)

    return F.arrow_udf(run, ALIGNED).asNondeterministic()


def align(docs: DataFrame, text: str = "text", name: str = "aligned", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``name``: n_a, n_b (ids on each side), groups (``a1,a2|b1;...``, a1 an id of the first),
    pairs (linked ids, see ``SECOND``) and times (links of each pair in the text)."""
    return docs.withColumn(name, _aligner(*(tokenizers or default_tokenizers()))(text_or_empty(text)))


def pair_counts(aligned: DataFrame, name: str = "aligned") -> DataFrame:
    """(pair, n, best): links of each pair over all rows, and whether no pair of its second id has more."""
    rows = aligned.select(F.explode(F.arrays_zip(F.col(name)["pairs"].alias("pair"), F.col(name)["times"].alias("times"))).alias("x"))
    counts = saved(rows.groupBy("x.pair").agg(F.sum("x.times").alias("n")), "pairs").withColumn("second", F.col("pair") % SECOND)
    top = counts.groupBy("second").agg(F.max("n").alias("top"))  # one row per id of the second vocabulary
    return counts.join(F.broadcast(top), "second").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _rater(shared):
    @tidy(seconds=1)
    def rate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, n, best = shared.value
        for pairs, times in batches:
            at = np.append(0, np.cumsum(np.diff(pairs.offsets.to_numpy())))
            code, k = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(pairs)), np.diff(at))
            spot = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[spot] == code if len(known) else np.zeros(len(code), bool)
            total, won = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            np.add.at(total, text[hit], k[hit] * n[spot[hit]])
            np.add.at(won, text[hit], k[hit] * best[spot[hit]])
            rest = pa.array(np.searchsorted(text[~hit], np.arange(len(pairs) + 1)), pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.array(won), pa.array(total), pa.ListArray.from_arrays(rest, pa.array(code[~hit], pa.int64())), pa.ListArray.from_arrays(rest, pa.array(k[~hit], pa.int64()))],
                names=["n_best", "count_sum", "pairs", "times"])

    return F.arrow_udf(rate, "n_best long, count_sum long, pairs array<long>, times array<long>").asNondeterministic()


def rated(aligned: DataFrame, counts: DataFrame, name: str = "aligned", out: str = "rated", head: int = HEAD) -> DataFrame:
    """``aligned`` (a written table) with a struct column ``out``: n_best, count_sum over each row's links."""
    counts = saved(counts, "counts")
    spark, size, least = aligned.sparkSession, counts.count(), 0
    if size > head:
        # Above this count there are about ``head`` pairs at most; every other pair is in the tail.
        least = int(counts.approxQuantile("n", [1 - head / size], 1e-4)[0])
    top = counts.where(F.col("n") > least).toArrow().sort_by("pair")  # bounded by ``head``
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    lists = F.col(name)
    if size <= head:
        return aligned.withColumn(out, _struct(_rater(shared)(lists["pairs"], lists["times"])))
    row, part = fresh(aligned, "row"), fresh(aligned, "part")
    first = saved(aligned.withColumn(row, F.monotonically_increasing_id()).withColumn(part, _rater(shared)(lists["pairs"], lists["times"])), "rated")
    links = first.select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(part)["pairs"].alias("pair"), F.col(part)["times"].alias("times"))).alias("x"))
    links = links.select("row", "x.pair", "x.times").join(counts.where(F.col("n") <= least), "pair")
    more = links.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    more = more.select(F.col("row").alias(fresh(first, "of")), F.struct("n_best", "count_sum").alias(fresh(first, "more")))
    whole = first.join(more, F.col(row) == F.col(more.columns[0]), "left")
    tail = F.col(more.columns[1])
    return whole.withColumn(out, F.struct(*[(F.col(part)[c] + F.coalesce(tail[c], F.lit(0))).alias(c) for c in ("n_best", "count_sum")])).drop(row, part, *more.columns)


def _struct(found: Column) -> Column:
    return F.struct(found["n_best"].alias("n_best"), found["count_sum"].alias("count_sum"))
