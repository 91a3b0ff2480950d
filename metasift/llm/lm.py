"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy, beside a smoothed unigram base.

The model reads a window of subwords and predicts the class of the next one by masked softmax attention with a
residual; within its class a subword has its share after the class of the subword before it.  Classes come from what
precedes a subword, input vectors from what follows it, both from counts of all training texts.  Training passes once
over all windows of all training texts, in rounds: every task trains its own copy on its texts, and the copies are
averaged by their tokens.  Scoring reads windows that overlap by a quarter; a token is scored once, in the window where it
has most context.  Probabilities sum to one over all subwords and the end.

The base counts words of the training texts.  The most frequent ones, a bounded number, are broadcast; the others of a text are
joined with their counts.  Words are known by 64-bit hashes.

Cases: a null or empty text is its end token alone; a null id counts as an empty one when texts are held out;
repeated rows are texts of their own; without training texts the base and the model are uniform; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.llm.common import chunks, hash_prefix, saved, small_batches, text_or_empty, tidy, utf8, word_hashes, words
from metasift.llm.subwords import Subwords, default_tokenizer

WINDOW, STRIDE, WIDTH, CLASSES = 32, 24, 16, 64
ROUNDS = 4
#: Windows of one training step, and of one scoring batch.
STEP, BATCH = 64, 64
RATE = 4e-3
#: Words whose counts are broadcast.
HEAD = 700_000
#: Columns of the sketch of a subword's neighbours: hashed ids before it and after it.
SKETCH = 64
BLOCK = 1024
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: White space that parts words, but not the tokenizer's chunks.
_OTHER_WHITE = (b"\t", b"\x0b", b"\x0c", b"\r")
SMOOTH = 0.1


def read(tokens: Subwords, raw: np.ndarray, off: np.ndarray) -> tuple:
    """Word hashes with each text's first one, and subword ids with each text's first one; runs are looked for once."""
    runs, prefix = words(raw, off, ~_WHITE), hash_prefix(raw)
    h = word_hashes(raw, runs[0], runs[1], prefix)
    data = raw.tobytes()
    ids, at = tokens.encode(raw, off) if any(x in data for x in _OTHER_WHITE) else tokens.encode(raw, off, runs, h, prefix)
    return h, runs[2], ids, at


def held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 10 == 0


# --- counts ---------------------------------------------------------------------------------

def _sketch(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)


def stream(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's subwords with its end, one after another, and the offset of each text."""
    n = np.diff(at)
    offsets = at + np.arange(len(at))
    out = np.full(len(ids) + len(n), end, np.int64)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] - 1] = False
    out[inside] = ids
    return out, offsets


def previous(seq: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """The subword before each one; a text begins after an end."""
    out = np.empty_like(seq)
    out[1:] = seq[:-1]
    out[offsets[:-1]] = end
    return out


class Tally:
    """Counts of codes, gathered before they are counted."""

    def __init__(self, rows: int, columns: int, held: int = 1_000_000):
        self.counts, self.columns, self.held = np.zeros(rows * columns, np.int32), columns, held
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        self.codes.append(codes.astype(np.int32))
        self.size += len(codes)
        if self.size >= self.held:
            self.flush()

    def flush(self) -> None:
        if self.codes:
            codes = np.sort(np.concatenate(self.codes))
            new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            self.counts[codes[new]] += np.diff(np.append(new, len(codes))).astype(np.int32)
        self.codes, self.size = [], 0

    def table(self) -> np.ndarray:
        self.flush()
        return self.counts.reshape(-1, self.columns)


def _packed(cells: np.ndarray) -> bytes:
    """The cells that are not zero and their counts: most are, so they cost far less to pack and add than whole blocks."""
    at = np.flatnonzero(cells)
    return zlib.compress(at.astype("<u4").tobytes() + cells[at].astype("<i8").tobytes(), 1)


def _add(data: bytes, into: np.ndarray) -> None:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    into[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)


def _blocks(counts: np.ndarray, name: str) -> Iterator[dict]:
    for k in range(0, len(counts), BLOCK):
        part = counts[k:k + BLOCK]
        if part.any():
            yield {"kind": name, "a": k, "n": None, "data": _packed(part.ravel())}


COUNTED = "kind string, part long, a long, n long, data binary, words array<long>, counts array<long>"
_COUNTED = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": None, "words": None, "counts": None} | r for r in rows], _COUNTED)


def _counter(path: str, rounds: int):
    """Word counts, neighbour sketches and subword ids of training texts."""

    @tidy(seconds=1)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Subwords.of(path)
        end = tokens.size
        sketch = Tally((end + 1) * 2, SKETCH)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = docs = 0

        def words_out() -> Iterator[pa.RecordBatch]:
            h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)
            cut = np.append(np.arange(0, len(h), 10_000), len(h)).astype(np.int32)
            m = len(cut) - 1
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (h.view(np.int64), n)]
            yield pa.RecordBatch.from_arrays([pa.array(["word"] * m), *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], *lists], schema=_COUNTED)

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            part = np.array(batch.column("part").to_pylist(), np.int64)
            docs += len(part)
            for lo, hi in chunks(offsets):
                off = offsets[lo:hi + 1]
                raw, off = data[off[0]:off[-1]], off - off[0]
                h, _, ids, at = read(tokens, raw, off)
                h, n = np.unique(h, return_counts=True)
                held.append((h, n))
                size += len(h)
                if size > 800_000:
                    yield from words_out()
                    held.clear()
                    size = 0
                seq, begin = stream(ids, at, end)
                before = previous(seq, begin, end)
                # The first half of the table has what precedes a subword, the second what follows it.
                sketch.add(seq * SKETCH + _sketch(before))
                sketch.add((before + end + 1) * SKETCH + _sketch(seq))
                small = ids.astype("<u2")
                yield _batch([
                    {"kind": "ids", "part": r, "a": int(sum(at[k + 1] - at[k] for k in np.flatnonzero(part[lo:hi] == r))), "n": None,
                     "data": b"".join([np.append(small[at[k]:at[k + 1]], np.uint16(0xFFFF)).tobytes() for k in np.flatnonzero(part[lo:hi] == r)])}
                    for r in range(rounds) if (part[lo:hi] == r).any()
                ])
        if held:
            yield from words_out()
        yield _batch([*_blocks(sketch.table(), "sketch"), {"kind": "docs", "a": 0, "n": docs, "data": None}])

    return count


def _totals(cells: int):
    """The sum of a task's blocks of each range; a task holds the table once, however many blocks it reads."""

    @tidy(seconds=1)
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for a, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a not in total:
                    total[a] = np.zeros(cells, np.int64)
                _add(data, total[a])
        for a, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([_packed(sums)], pa.binary())], ["a", "data"])

    return add


def gathered(rows: DataFrame, kind: str, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' count blocks; its size is that of the vocabulary, whatever the input."""
    out = np.zeros(shape[0] * shape[1], np.int64)
    # In two steps, so that a range's task gets one block from each task instead of all.
    add, blocks = _totals(BLOCK * shape[1]), rows.where(F.col("kind") == kind).select("a", "data")
    for r in blocks.mapInArrow(add, "a long, data binary").repartition("a").mapInArrow(add, "a long, data binary").collect():
        _add(r["data"], out[r["a"] * shape[1]:])
    return out.reshape(shape)


# --- the model ------------------------------------------------------------------------------

@dataclass
class Network:
    """Input vectors and classes of subwords; attention and output weights in one vector."""

    inputs: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    share: np.ndarray | None = None

    def parts(self, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w, d, c = self.weights if w is None else w, WIDTH, CLASSES
        a, b, e = 3 * d * d, 3 * d * d + WINDOW * d, 3 * d * d + WINDOW * d + d * c
        return w[:a].reshape(d, 3 * d), w[a:b].reshape(WINDOW, d), w[b:e].reshape(d, c), w[e:]


def fresh_network(sketch: np.ndarray) -> Network:
    """Classes by weighted spherical k-means of what precedes, inputs by principal directions of what follows."""
    half = len(sketch) // 2
    before, after = sketch[:half].astype(np.float64), sketch[half:].astype(np.float64)
    n = before.sum(axis=1)

    def lifted(x: np.ndarray) -> np.ndarray:
        total = max(x.sum(), 1)
        expected = x.sum(axis=1, keepdims=True) * x.sum(axis=0, keepdims=True) / total
        return np.log((x + 1) / (expected + 1))

    rng = np.random.default_rng(11)
    x = lifted(before)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    weight = np.sqrt(n)
    top = np.argsort(-n[:-1], kind="stable")[:CLASSES - 1]
    center = x[top]
    for _ in range(12):
        at = np.argmax(x @ center.T, axis=1)
        for c in range(CLASSES - 1):
            mine = at == c
            if weight[mine].sum() > 0:
                center[c] = weight[mine] @ x[mine]
                center[c] /= np.linalg.norm(center[c]) + 1e-9
    at[-1] = CLASSES - 1  # the end has a class of its own
    y = lifted(after)
    y -= np.average(y, axis=0, weights=n + 1e-9)
    values, vectors = np.linalg.eigh((y * (n[:, None] + 1e-9)).T @ y / max(n.sum(), 1))
    z = y @ vectors[:, ::-1][:, :WIDTH]
    z /= np.sqrt(np.average(z * z, axis=0, weights=n + 1e-9)) + 1e-9
    weights = np.concatenate([
        rng.standard_normal(3 * WIDTH * WIDTH) * 0.5 / math.sqrt(WIDTH), rng.standard_normal(WINDOW * WIDTH) * 0.1,
        rng.standard_normal(WIDTH * CLASSES) * 0.05, np.log(np.bincount(at, n, CLASSES) + 1) - math.log(n.sum() + CLASSES),
    ])
    return Network(np.clip(z, -4, 4).astype(np.float32), at.astype(np.int64), weights.astype(np.float32))


_CAUSAL = np.tri(WINDOW, dtype=np.float32)
_SCALE = np.float32(1 / math.sqrt(WIDTH))
#: Exponents are cut here, far above what trained scores reach.
_MOST = np.float32(60)


def _exp(x: np.ndarray) -> None:
    """Exponentials in place."""
    if x.max(initial=0) > _MOST:
        np.minimum(x, _MOST, out=x)
    np.exp(x, out=x)


def forward(net: Network, w: np.ndarray, tokens: np.ndarray, first: int = 0) -> tuple:
    """Unnormalised class weights for windows of subwords (windows x WINDOW), and what the backward pass needs.

    Positions before ``first`` are only looked back at and get none.  Values and outputs carry a column of ones, so one product gives a sum and its normaliser, or adds the bias."""
    qkv, place, out, bias = net.parts(w)
    m, d = len(tokens), WIDTH
    h = np.take(net.inputs, tokens, axis=0)
    h += place
    x = h.reshape(-1, d) @ np.concatenate([qkv[:, :d] * _SCALE, qkv[:, d:], np.zeros((d, 1), qkv.dtype)], axis=1)
    x[:, 3 * d] = 1
    x = x.reshape(m, WINDOW, 3 * d + 1)
    q, k, v = x[:, first:, :d], x[..., d:2 * d], x[..., 2 * d:]
    s = np.matmul(q, k.transpose(0, 2, 1))
    _exp(s)
    s *= _CAUSAL[first:]
    o = np.matmul(s, v)
    z = o[..., d:].copy()
    o /= z
    o[..., :d] += h[:, first:]
    p = o.reshape(-1, d + 1) @ np.concatenate([out, bias[None]])
    _exp(p)
    return p, h, x, s, o, z


def gradient(net: Network, w: np.ndarray, tokens: np.ndarray, target: np.ndarray, valid: np.ndarray, with_loss: bool = True) -> tuple[float, np.ndarray]:
    """Mean loss (nats a token; 0 if not asked for) and its gradient."""
    p, h, x, s, o, z = forward(net, w, tokens)
    qkv, _, out, _ = net.parts(w)
    m, d = len(tokens), WIDTH
    ok = valid.reshape(-1)
    at = np.arange(len(p)), target.reshape(-1)
    total = p @ np.ones(CLASSES, p.dtype)
    n = max(int(ok.sum()), 1)
    loss = -float(np.log(np.maximum(p[at] / total, 1e-30)) @ ok) / n if with_loss else 0.0
    p *= (ok / (total * n))[:, None]
    p[at] -= ok / n
    do = (p @ out.T).reshape(m, WINDOW, d)
    q, k, v = x[..., :d], x[..., d:2 * d], x[..., 2 * d:3 * d]
    # Attention is s / z; the divisions go to the narrow sides.
    dz = do / z
    ds = np.matmul(dz, v.transpose(0, 2, 1))
    ds -= np.einsum("mid,mid->mi", dz, o[..., :d] - h)[..., None]
    ds *= s
    dx = np.empty((m, WINDOW, 3 * d), p.dtype)
    np.multiply(np.matmul(ds, k), _SCALE, out=dx[..., :d])
    dx[..., d:2 * d] = np.matmul(ds.transpose(0, 2, 1), q)
    dx[..., 2 * d:] = np.matmul(s.transpose(0, 2, 1), dz)
    dx = dx.reshape(-1, 3 * d)
    do += (dx @ qkv.T).reshape(m, WINDOW, d)
    last = o.reshape(-1, d + 1).T @ p
    return loss, np.concatenate([(h.reshape(-1, d).T @ dx).ravel(), do.sum(axis=0).ravel(), last.ravel()])


def windows(offsets: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window in the stream and the end of its text: the first at the text's start, then one each ``stride``."""
    n = np.diff(offsets)
    per = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
    start = np.repeat(offsets[:-1], per) + stride * (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))
    return start, np.repeat(offsets[1:], per)


def reach(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each window's tokens, its first one again past its text's end; which are real (as weights)."""
    at = start.astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    valid = at < stop.astype(np.int32)[:, None]
    np.copyto(at, start.astype(np.int32)[:, None], where=~valid)
    return at, valid.astype(np.float32)


class Trainer:
    """Adam steps on one task's windows, starting from the shared weights."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.w, self.rate = net, net.weights.copy(), rate
        self.m, self.v, self.t, self.tokens = np.zeros_like(self.w), np.zeros_like(self.w), 0, 0

    def learn(self, seq: np.ndarray, offsets: np.ndarray, end: int) -> None:
        before, target = previous(seq, offsets, end), self.net.classes[seq]
        start, stop = windows(offsets, WINDOW)
        order = np.random.default_rng(self.t).permutation(len(start))
        at, valid = reach(start[order], stop[order])
        tokens, wanted = before.astype(np.int32)[at], target.astype(np.int32)[at]
        for lo in range(0, len(order), STEP):
            hi = lo + STEP
            _, g = gradient(self.net, self.w, tokens[lo:hi], wanted[lo:hi], valid[lo:hi], False)
            self.t += 1
            self.m += np.float32(0.1) * (g - self.m)
            g *= g
            self.v += np.float32(0.01) * (g - self.v)
            step = self.rate * min(1, self.t / 20) * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.w -= np.float32(step) * self.m / (np.sqrt(self.v) + np.float32(1e-8))
        self.tokens += len(seq)


def _trainer(shared, end: int):
    @tidy(seconds=1)
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        own = Trainer(net)
        pairs = Tally(end + 1, CLASSES)
        for batch in batches:
            for raw in batch.column("data").to_pylist():
                seq = np.frombuffer(raw, "<u2").astype(np.int64)
                seq[seq == 0xFFFF] = end
                offsets = np.append(0, np.flatnonzero(seq == end) + 1)
                pairs.add(seq * CLASSES + net.classes[previous(seq, offsets, end)])
                own.learn(seq, offsets, end)
        if own.tokens:
            data = (own.w.astype(np.float64) * own.tokens).astype("<f8").tobytes()
            yield _batch([*_blocks(pairs.table(), "pairs"), {"kind": "weights", "a": 0, "n": own.tokens, "data": data}])

    return train


def _averaged(rows: DataFrame) -> np.ndarray | None:
    """The tasks' weights averaged by tokens; summed as numbers, so the driver sees one vector."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.frombuffer(raw, "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w), pa.array(np.full(len(w), n, np.int64))], ["k", "w", "n"])

    found = rows.where("kind = 'weights'").select("n", "data").mapInArrow(split, "k long, w double, n long").groupBy("k").agg((F.sum("w") / F.sum("n")).alias("w")).orderBy("k").collect()
    return np.array([r["w"] for r in found], np.float32) if found else None


def shares(pairs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 share of every subword within its class, given the class before: counts backed by the class's own shares."""
    total = pairs.sum(axis=1).astype(np.float64) + 0.05
    mass = np.bincount(classes, total, CLASSES)
    own = total / mass[classes]
    within = np.stack([np.bincount(classes, pairs[:, c], CLASSES) for c in range(CLASSES)], axis=1)
    held = 20.0
    return np.log10((pairs + held * own[:, None]) / (within[classes] + held)).astype(np.float32)


def score_texts(net: Network, seq: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of each text: every token once, in its window with most context."""
    before = previous(seq, offsets, end)
    logp = net.share[seq, net.classes[before]].astype(np.float64)
    target = net.classes[seq]
    start, stop = windows(offsets, STRIDE)
    # A window after its text's first one leaves the overlap to the one before, and only looks back at it.
    inner = np.append(False, stop[1:] == stop[:-1])
    before = before.astype(np.int32)
    for mine, first in ((np.flatnonzero(~inner), 0), (np.flatnonzero(inner), WINDOW - STRIDE)):
        for lo in range(0, len(mine), BATCH):
            some = mine[lo:lo + BATCH]
            at, valid = reach(start[some], stop[some])
            p = forward(net, net.weights, before[at], first)[0]
            k = np.flatnonzero(valid[:, first:] > 0)
            spot = at[:, first:].ravel()[k]
            logp[spot] += np.log10(np.maximum(p[k, target[spot]] / (p @ np.ones(CLASSES, p.dtype))[k], 1e-30))
    return np.add.reduceat(logp, offsets[:-1]) if len(seq) else np.zeros(0)


# --- on Spark -------------------------------------------------------------------------------

@dataclass
class Fitted:
    """What scoring needs: head words and their counts, totals, and the network."""

    head: np.ndarray
    counts: np.ndarray
    n: int
    kinds: int
    docs: int
    net: Network


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, rounds: int = ROUNDS, head: int = HEAD) -> tuple[Fitted, DataFrame]:
    """The fitted model, and the counts of the words beyond the head, from all texts that are not held out."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    train = docs.where(F.crc32(ident.cast("binary")) % 10 != 0).select(text_or_empty(text).alias("text"), F.pmod(F.xxhash64(ident, text_or_empty(text)), F.lit(rounds)).alias("part"))
    rows = saved(train.mapInArrow(_counter(path, rounds), COUNTED), "counts")
    n_docs = rows.where("kind = 'docs'").agg(F.sum("n")).first()[0] or 0
    vocabulary = saved(rows.where("kind = 'word'").select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("h")).agg(F.sum("w.counts").alias("c")), "words")
    total, kinds = vocabulary.agg(F.sum("c"), F.count("*")).first()
    # The least count whose words fit into the head.
    steps = vocabulary.groupBy(F.least("c", F.lit(10_000)).alias("c")).count().orderBy(F.desc("c")).collect()
    least, have = 10_001, 0
    for r in steps:
        if have + r["count"] > head:
            break
        least, have = r["c"], have + r["count"]
    top = vocabulary.where(F.col("c") >= least).toArrow() if have else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    size = Subwords.of(path).size
    net = fresh_network(gathered(rows, "sketch", (2 * (size + 1), SKETCH)))
    pairs = np.zeros((size + 1, CLASSES), np.int64)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(net)  # of the vocabulary's size
        ids = rows.where((F.col("kind") == "ids") & (F.col("part") == k)).select("data")
        learnt = saved(ids.mapInArrow(_trainer(shared, size), COUNTED), "learnt")
        pairs += gathered(learnt, "pairs", pairs.shape)
        weights = _averaged(learnt)
        if weights is not None:
            net = Network(net.inputs, net.classes, weights)
    net.share = shares(pairs, net.classes)
    order = np.argsort(top["h"].to_numpy().view(np.uint64), kind="stable")
    fitted = Fitted(top["h"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order].astype(np.int32 if (total or 0) < 2**31 else np.int64), (total or 0) + n_docs, kinds + (n_docs > 0), n_docs, net)
    # Where no step fits into the head, all words are in the tail.
    return fitted, vocabulary.where(F.col("c") < least) if have else vocabulary


SCORED = "row long, {id}, held_out boolean, n_words long, head_known long, head_sum double, tail array<long>, n_subwords long, score double"


class Lookup:
    """Counts of hashes by an open-addressing table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        slots = 1 << max(4, int(np.ceil(np.log2(1.33 * len(keys) + 1))))
        self.mask, self.keys, self.values = slots - 1, np.zeros(slots, np.uint64), np.zeros(slots, values.dtype)
        self.zero = int(values[keys == 0].sum())
        keys, values = keys[keys != 0], values[keys != 0]
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            on = np.ones(len(keys), bool)
            on[put] = False
            keys, values, slot = keys[on], values[on], (slot[on] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Counts, 0 where unknown."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out = np.where(hit, self.values[slot], 0)
        at = np.flatnonzero(~hit & (key != 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            key = self.keys[slot]
            hit = key == h[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            at, slot = at[on], slot[on]
        if self.zero:
            out[h == 0] = self.zero
        return out


_TABLES: dict[str, Lookup] = {}


def _scorer(shared, name: str, path: str, schema: pa.Schema):
    @tidy(seconds=1)
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, fitted = Subwords.of(path), shared.value
        end = tokens.size
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = Lookup(fitted.head, fitted.counts)
        table, next_row = _TABLES[name], TaskContext.get().partitionId() << 40
        for batch in batches:
            # Copies of a text within the batch are read once.
            texts = batch.column("text").dictionary_encode()
            data, offsets = utf8(texts.dictionary)
            copy_of = texts.indices.to_numpy(zero_copy_only=False)
            names = batch.column("name").to_pylist()
            parts = []
            for lo, hi in chunks(offsets):
                m, off = hi - lo, offsets[lo:hi + 1]
                raw, off = data[off[0]:off[-1]], off - off[0]
                h, first, ids, at = read(tokens, raw, off)
                c = table.find(h)
                row = np.repeat(np.arange(m), np.diff(first))
                known = c > 0
                rest = np.flatnonzero(~known)
                tail = pa.ListArray.from_arrays(np.searchsorted(rest, first).astype(np.int32), pa.array(h[rest].view(np.int64)))
                seq, begin = stream(ids, at, end)
                parts.append(pa.RecordBatch.from_arrays([
                    pa.array(np.diff(first)), pa.array(np.bincount(row, known, m).astype(np.int64)), pa.array(np.bincount(row, np.where(known, np.log10(c + SMOOTH), 0.0), m)),
                    tail, pa.array(np.diff(begin)), pa.array(score_texts(fitted.net, seq, begin, end)),
                ], names=schema.names[3:]))
            if parts:
                found = pa.Table.from_batches(parts).take(pa.array(copy_of)).combine_chunks()
                m = len(copy_of)
                yield pa.RecordBatch.from_arrays([
                    pa.array(next_row + np.arange(m)), batch.column("id"), pa.array([held_out(x) for x in names]), *[found.column(n).chunk(0) for n in schema.names[3:]],
                ], schema=schema)
                next_row += m

    return score


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    with small_batches(docs.sparkSession):
        return _score(docs, doc_id, text, tokenizer or default_tokenizer(), rounds, head)


def _score(docs: DataFrame, doc_id: str, text: str, path: str, rounds: int, head: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    fitted, tail = fit(docs, doc_id, text, path, rounds, head)
    kind = docs.schema[doc_id].dataType
    schema = pa.schema([("row", pa.int64()), ("id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("head_known", pa.int64()), ("head_sum", pa.float64()), ("tail", pa.list_(pa.int64())), ("n_subwords", pa.int64()), ("score", pa.float64())])
    rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_id).cast("string").alias("name"), text_or_empty(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by the head and the vocabulary
    scored = saved(rows.mapInArrow(_scorer(shared, uuid.uuid4().hex, path, schema), SCORED.format(id=f"id {kind.simpleString()}")), "scored")
    rare = scored.select("row", F.explode("tail").alias("h")).join(tail, "h", "left").groupBy("row").agg(
        F.count("c").alias("tail_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("tail_sum"),
    )
    size = math.log10(fitted.n + SMOOTH * (fitted.kinds + 1))
    n_tokens = F.col("n_words") + 1
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(doc_id), "held_out", n_tokens.alias("n_tokens"),
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(fitted.docs > 0)).cast("long").alias("n_known"), F.lit(fitted.n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + math.log10(fitted.docs + SMOOTH) - n_tokens * size).alias("base_score"), "score", "n_subwords",
    )
