"""Quality classifier from weak labels.

Heuristic labellers vote on two questions, is a text of low quality and is it toxic.  Votes are counted per vote
pattern over all texts; expectation-maximisation on those counts estimates each labeller's error rates without true
labels and gives every pattern a posterior.  Posteriors then train one hashed linear scorer per question (words, word
beginnings and votes) on a bounded sample of texts.  The toxic labellers look words up in a lexicon
that the labelled texts give: words, and beginnings of words, that occur in toxic texts far beyond chance.

Bounds, all parameters: ``LABELLED`` labelled texts for the lexicon, ``LEXICON`` entries, ``TRAINED`` texts for the scorer.
Vote counts cover every text, and every text is scored whole.

Cases: a null or empty text, or one without any word, is rejected with a quality of 0; a null id is scored like others; without labels
nothing is toxic; repeated rows are scored each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import LOWER, chunks, mix, saved, text_or_empty, tidy, utf8, word_hashes, words

BITS = 18
LABELLED, LEXICON, TRAINED = 40_000, 5_000, 6_000
#: Steps of the draw by hash.
DRAWS = 10**12
#: Bytes that make a word's beginning.
STEM = 5
SCORED = "n_words long, quality double, toxicity double, keep boolean"

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LINE = np.arange(256) != 10
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = np.isin(LOWER, np.arange(97, 123)) | (np.arange(256) >= 128)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
#: ASCII marks that running text seldom attaches to a word.
_MARK = np.isin(np.arange(256), np.frombuffer(b"#$%&*<>[\\]^`{|}~!", np.uint8))

#: Votes: (statistic, low quality from here, good up to here, fewest words to vote at all).
QUALITY = (
    ("marked", 0.15, 0.03, 4), ("upper", 0.4, 0.08, 8), ("variety", -0.35, -0.5, 40), ("repeats", 0.2, 0.03, 12), ("lines", 0.4, 0.1, 12),
    ("bare", 0.08, 0.01, 8), ("top", 0.3, 0.15, 20), ("other", 0.3, 0.05, 8),
)
#: Lexicon hits from which a text is toxic; a clean vote needs none.
TOXIC = (("words", 1), ("stems", 1), ("both", 2), ("share", 0.004))
GOOD, BAD, NONE = 0, 1, 2


@dataclass
class Stats:
    """Per text: statistics by name; and its words as (row, hash, stem hash)."""

    n: np.ndarray
    values: dict[str, np.ndarray] = field(default_factory=dict)
    row: np.ndarray | None = None
    word: np.ndarray | None = None
    stem: np.ndarray | None = None


def _per_row(row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weight, rows)


def _inside(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each run belong to ``table``."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=total[1:])
    return total[ends] - total[starts]


def _repeated(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per row and the count of its most frequent one."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row[at], count)
    return np.bincount(row[at], minlength=rows), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> Stats:
    """Statistics of every text; words are runs without white space."""
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets, ~_WHITE)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    # The word proper: marks around it do not count.
    letters = _inside(_LETTER, data, starts, ends)
    marks = _inside(_MARK, data, starts, ends)
    upper = _inside(_UPPER, data, starts, ends)
    digits = _inside(_DIGIT, data, starts, ends)
    h = word_hashes(data, starts, ends)
    some = np.maximum(n, 1)
    same = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, bool)
    kinds, top = _repeated(row, h, rows)
    ls, le, lf = words(data, offsets, _LINE)
    lrow = np.repeat(np.arange(rows), np.diff(lf))
    lines, _ = _repeated(lrow, word_hashes(data, ls, le), rows)
    per = lambda x: _per_row(row, x, rows) / some
    out = Stats(n)
    out.values = {
        "marked": per(marks > 0), "upper": per((upper == letters) & (letters > 1) & (digits == 0)), "variety": -np.minimum(1, kinds / some * np.sqrt(np.maximum(n, 200) / 200)),
        "repeats": per(same), "lines": 1 - lines / np.maximum(np.diff(lf), 1), "bare": per((letters == 0) & (digits == 0)), "top": top / some,
        "other": 1 - _per_row(row, letters + digits, rows) / np.maximum(_per_row(row, (ends - starts).astype(float), rows), 1),
    }
    ws, we, wf = words(data, offsets, _LETTER)
    out.row = np.repeat(np.arange(rows), np.diff(wf))
    out.word = word_hashes(data, ws, we)
    out.stem = mix(word_hashes(data, ws, np.minimum(we, ws + STEM)) + np.uint64(1))
    out.stem[we - ws < STEM] = 0
    return out


def votes(stats: Stats, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes on quality and on toxicity, a column for each labeller."""
    rows = len(stats.n)
    quality = np.full((rows, len(QUALITY)), NONE, np.int64)
    for k, (name, bad, good, least) in enumerate(QUALITY):
        v = stats.values[name]
        quality[v <= good, k] = GOOD
        quality[v >= bad, k] = BAD
        quality[stats.n < least, k] = NONE
    toxic = np.full((rows, len(TOXIC)), NONE, np.int64)
    if len(lexicon):
        by_word, by_stem = np.isin(stats.word, lexicon), np.isin(stats.stem, lexicon)
        hits = {"words": by_word, "stems": by_stem, "both": by_word | by_stem}
        count = {k: _per_row(stats.row, v, rows) for k, v in hits.items()}
        count["share"] = count["both"] / np.maximum(stats.n, 1)
        for k, (name, least) in enumerate(TOXIC):
            toxic[count["both"] == 0, k] = GOOD
            toxic[count[name] >= least, k] = BAD
    return quality, toxic


def patterns(v: np.ndarray) -> np.ndarray:
    """Each row's votes as one number."""
    return v @ 3 ** np.arange(v.shape[1])


def unpatterns(p: np.ndarray, width: int) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(width) % 3


@dataclass
class LabelModel:
    """Class prior and, for labellers that vote, the chance of a bad vote: bad_vote[labeller, class].  Abstaining says nothing."""

    prior: float
    bad_vote: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        for j, (clean, bad) in enumerate(self.bad_vote):
            log += np.where(v[:, j] == BAD, math.log(bad / clean), np.where(v[:, j] == GOOD, math.log((1 - bad) / (1 - clean)), 0.0))
        return 1 / (1 + np.exp(-np.clip(log, -700, 700)))


def fit_labels(v: np.ndarray, count: np.ndarray, width: int, prior: float = 0.1, weight: float = 50.0, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation from pattern counts.  Each labeller starts as, and is held by ``weight`` texts of either class to, a fair one."""
    fair = np.array([0.002, 0.3])
    model = LabelModel(prior, np.repeat(fair[None], width, axis=0))
    for _ in range(rounds):
        bad = model.posterior(v) * count
        sides = (count - bad, bad)
        model.prior = float((bad.sum() + weight * prior) / (count.sum() + weight))
        model.bad_vote = np.array([
            [(w[v[:, j] == BAD].sum() + weight * fair[c]) / (w[v[:, j] != NONE].sum() + weight) for c, w in enumerate(sides)] for j in range(width)
        ])
    return model


def features(stats: Stats, quality: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value): distinct hashed words and beginnings, scaled to one; the votes; one for all texts."""
    rows, mask = len(stats.n), np.uint64((1 << BITS) - 1)
    row = np.concatenate([stats.row, stats.row[stats.stem > 0]])
    code = np.unique(row.astype(np.uint64) << np.uint64(BITS) | np.concatenate([stats.word, stats.stem[stats.stem > 0]]) & mask)
    row, index = (code >> np.uint64(BITS)).astype(np.int64), (code & mask).astype(np.int64)
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))[row]
    both = np.concatenate([quality, toxic], axis=1)
    cast, by = np.nonzero(both != NONE)
    vote = (1 << BITS) + by * 2 + both[cast, by]
    bias = np.full(rows, SIZE - 1)
    return np.concatenate([row, cast, np.arange(rows)]), np.concatenate([index, vote, bias]), np.concatenate([value, np.ones(len(vote) + rows)])


SIZE = (1 << BITS) + 2 * (len(QUALITY) + len(TOXIC)) + 1


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 8, rate: float = 0.3, hold: float = 1e-6) -> np.ndarray:
    """Weights of a logistic scorer by adaptive gradients; posteriors are soft targets."""
    w, seen = np.zeros(SIZE), np.full(SIZE, 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value = rows[k]
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[index] @ value))))) - target[k]) * value + hold * w[index]
            seen[index] += g * g
            w[index] -= rate * g / np.sqrt(seen[index])
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# --- on Spark -------------------------------------------------------------------------------

def lexicon_of(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED, size: int = LEXICON) -> np.ndarray:
    """Hashes of words and beginnings that mark toxic texts: frequent far beyond chance among at most about ``limit`` labelled texts."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / total))
    # At most about ``limit`` ids are broadcast, so no text is shuffled.
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).join(F.broadcast(known), "doc_id").select("toxic", "text")

    @tidy
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct (word or beginning, word before its first place in the text) per class: a text counts once, as do its copies."""
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            label = np.array(batch.column("toxic").to_pylist(), np.int64) > 0
            for lo, hi in chunks(offsets):
                off = offsets[lo:hi + 1]
                s = statistics(data[off[0]:off[-1]], off - off[0])
                before = np.append(np.zeros(1, np.uint64), s.word[:-1]) if len(s.word) else s.word
                before[np.append(True, s.row[1:] != s.row[:-1])[:len(before)]] = 0
                has = s.stem > 0
                h, near, row = np.concatenate([s.word, s.stem[has]]), np.concatenate([before, before[has]]), np.concatenate([s.row, s.row[has]])
                order = np.lexsort((h, row))
                one = order[np.append(True, (np.diff(h[order]) != 0) | (np.diff(row[order]) != 0))] if len(h) else order
                pairs = np.unique(np.stack([h[one], near[one], label[lo + row[one]].astype(np.uint64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64)), pa.array(pairs[:, 2] > 0)], ["h", "near", "toxic"])

    sums = known.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("t"), F.count("*").alias("n")).first()
    t, n = sums["t"] or 0, sums["n"]
    if not t or t == n:
        return np.zeros(0, np.uint64)
    share = t / n
    pairs = rows.mapInArrow(seen, "h long, near long, toxic boolean").distinct()
    counted = pairs.groupBy("h").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.sum((~F.col("toxic")).cast("long")).alias("b"))
    a, b = F.col("a"), F.col("b")
    ratio = a / (a + b)
    # Log likelihood ratio of the toxic share among the texts that hold the word against the share of all, over distinct contexts.
    strength = a * F.log(ratio / share) + F.when(b > 0, b * F.log((1 - ratio) / (1 - share))).otherwise(0.0)
    # A word tested by chance reaches strength s about exp(-s) of the time; the bound allows for all words that are tested.
    counted = saved(counted.where(a + b >= 4), "lexicon")
    least = math.log(max(counted.count(), 1)) + 3
    best = counted.where(ratio >= 0.95).withColumn("s", strength).where(F.col("s") >= least).orderBy(F.desc("s"), "h").limit(size)
    return np.array([r["h"] for r in best.select("h").collect()], np.int64).view(np.uint64)


def _voter(lexicon: np.ndarray):
    @tidy
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            data, offsets = utf8(col)
            out = [np.zeros(0, np.int64)]
            for lo, hi in chunks(offsets):
                off = offsets[lo:hi + 1]
                q, t = votes(statistics(data[off[0]:off[-1]], off - off[0]), lexicon)
                out.append(patterns(np.concatenate([q, t], axis=1)))
            yield pa.array(np.concatenate(out))

    return vote


@dataclass
class Model:
    """What scoring needs: the lexicon and the weights of both scorers."""

    lexicon: np.ndarray
    quality: np.ndarray
    toxic: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", trained: int = TRAINED) -> tuple[Model, LabelModel, LabelModel]:
    """Lexicon, label models from the votes of all texts, and scorers trained on about ``trained`` distinct ones."""
    lexicon = lexicon_of(docs, labels, text=text)
    vote = F.arrow_udf(_voter(lexicon), "long").asNondeterministic()
    width = len(QUALITY), len(TOXIC)
    # Each distinct text once, with its copies: they weigh in the label models, and the scorers are trained on distinct texts.
    votes_of = docs.select(F.xxhash64(text_or_empty(text)).alias("h"), vote(text_or_empty(text)).alias("p"))
    texts = saved(votes_of.groupBy("h").agg(F.first("p").alias("p"), F.count("*").alias("copies")), "texts")
    counts = texts.groupBy("p").agg(F.sum("copies").alias("rows"), F.count("*").alias("texts")).collect()  # at most 3 ** labellers rows, few in fact
    p, n, distinct = np.array([r["p"] for r in counts], np.int64), np.array([r["rows"] for r in counts], np.float64), np.array([r["texts"] for r in counts], np.float64)
    v = unpatterns(p, sum(width))
    vq, vt = v[:, :width[0]], v[:, width[0]:]
    judge, warn = fit_labels(vq, n, width[0]), fit_labels(vt, n, width[1])
    if not len(n):
        return Model(lexicon, np.zeros(SIZE), np.zeros(SIZE)), judge, warn
    pq, pt = judge.posterior(vq), warn.posterior(vt)
    # Half of the training texts from patterns held good, half from the others.
    clean = (pq < 0.5) & (pt < 0.5)
    rate = [(int(k), float(trained / 2 / max(distinct[clean == c].sum(), 1))) for k, c in zip(p, clean, strict=True)]
    rates = F.broadcast(docs.sparkSession.createDataFrame(rate, "p long, rate double"))
    drawn = saved(texts.join(rates, "p").where(F.pmod("h", F.lit(DRAWS)) / DRAWS < F.col("rate")).select("h"), "drawn")  # about ``trained`` hashes
    drawn = docs.select(text_or_empty(text).alias("t")).withColumn("h", F.xxhash64("t")).join(F.broadcast(drawn), "h").select("h", "t")

    @tidy
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pattern and features of every text; of its copies in a task only the first is read."""
        seen: set[int] = set()
        for batch in batches:
            first = [k for k, h in enumerate(batch.column("h").to_pylist()) if not (h in seen or seen.add(h))]
            if not first:
                continue
            batch = batch.take(pa.array(first))
            data, offsets = utf8(batch.column("t"))
            ident = batch.column("h").to_pylist()
            for lo, hi in chunks(offsets):
                off = offsets[lo:hi + 1]
                s = statistics(data[off[0]:off[-1]], off - off[0])
                q, t = votes(s, lexicon)
                ps = patterns(np.concatenate([q, t], axis=1))
                row, index, value = features(s, q, t)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_pylist([
                    {"h": ident[lo + k], "p": int(ps[k]), "index": index[order][cut[k]:cut[k + 1]].astype("<i4").tobytes(), "value": value[order][cut[k]:cut[k + 1]].astype("<f4").tobytes()}
                    for k in range(hi - lo)
                ], pa.schema([("h", pa.int64()), ("p", pa.int64()), ("index", pa.binary()), ("value", pa.binary())]))

    once = drawn.mapInArrow(expand, "h long, p long, index binary, value binary").groupBy("h").agg(*[F.first(c).alias(c) for c in ("p", "index", "value")])
    got = sorted(once.collect(), key=lambda r: r["h"])  # about ``trained`` texts, whatever their copies
    rows = [(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in got]
    place = {int(k): j for j, k in enumerate(p)}
    at = np.array([place[r["p"]] for r in got], np.int64)
    return Model(lexicon, fit_scorer(rows, pq[at]), fit_scorer(rows, pt[at])), judge, warn


_TYPE = pa.struct([("n_words", pa.int64()), ("quality", pa.float64()), ("toxicity", pa.float64()), ("keep", pa.bool_())])


def _scorer(shared):
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for col in batches:
            data, offsets = utf8(col)
            parts = []
            for lo, hi in chunks(offsets):
                off = offsets[lo:hi + 1]
                s = statistics(data[off[0]:off[-1]], off - off[0])
                row, index, value = features(s, *votes(s, model.lexicon))
                bad = _sigmoid(np.bincount(row, model.quality[index] * value, hi - lo))
                toxic = _sigmoid(np.bincount(row, model.toxic[index] * value, hi - lo))
                bad[s.n == 0], toxic[s.n == 0] = 1, 0
                keep = (bad < 0.5) & (toxic < 0.5)
                parts.append(pa.StructArray.from_arrays([pa.array(s.n, pa.int64()), pa.array(1 - bad), pa.array(toxic), pa.array(keep)], fields=list(_TYPE)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)

    return score


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "judged") -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, quality, toxicity, keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weights a hash slot and the lexicon, whatever the input
    udf: Column = F.arrow_udf(_scorer(shared), SCORED).asNondeterministic()(text_or_empty(text))
    return docs.withColumn(name, udf)
