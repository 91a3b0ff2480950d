"""Quality rules of documents and of the hosts that they come from.

Each document is measured and judged by its own rules.  Failures are added up by host; a host's rate for a rule is shrunk towards
the rate of all hosts by a beta prior whose strength comes from how much the hosts differ (method of moments).  Hosts
whose shrunk rate for any rule exceeds its limit are rejected with all their documents.

Hosts that hold at least one in ``SHARE`` of all rows, at most ``SHARE`` hosts by arithmetic, are broadcast to their
documents; the others meet theirs in a shuffle in which no key is hot.

Cases: a null text has no words and fails as short; documents without a host are judged alone and no host is counted
for them; repeated rows count each; an empty table gives no rows; a very long text is held alone; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import chunks, fresh, hash_prefix, mix, run_hashes, saved, text_or_empty, tidy, utf8, word_hashes, words

#: Hosts with one in so many rows are hot.
SHARE = 1000
#: Shrunk failure rate beyond which a rule rejects a host.
LIMIT = 0.5
WINDOW = 3
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_EXACT = np.arange(1, 257, dtype=np.uint64)


def rules(f: Column) -> dict[str, Column]:
    """Failure of each rule on measured documents; the first two are the base rules, all are whole-number comparisons."""
    return {
        "short": f["n_words"] < 50,
        "repeats": f["n_repeat_words"] * 100 > f["n_words"] * 50,
        "symbols": f["n_symbols"] * 10 > f["n_words"],
        "lines": f["n_dup_lines"] * 2 > f["n_lines"],
    }


BASE = ("short", "repeats")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_TYPE = pa.struct([(m, pa.int64()) for m in MEASURES])


def _per_text(member: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(member) + 1, np.int64)
    np.cumsum(member, out=total[1:])
    return np.diff(total[offsets])


def _groups(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every (text, hash) and the rows of every group."""
    _, group, n = np.unique(mix(h ^ mix(text.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    return group, n


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``MEASURES`` of every text."""
    n_texts, own = len(offsets) - 1, np.arange(len(offsets) - 1)
    starts, ends, first = words(data, offsets, ~_SPACE)
    prefix = hash_prefix(data, _EXACT)
    n = np.diff(first)
    chars = _per_text(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets)
    symbols = _per_text(_SYMBOL[data], offsets)
    # Lines with a word: runs between line ends that hold a word's first byte.
    begin, end, line_first = words(data, offsets, np.arange(256) != 10)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    text = np.repeat(own, np.diff(line_first))[worded]
    lines = np.bincount(text, minlength=n_texts)
    group, _ = _groups(text, word_hashes(data, begin[worded], end[worded], prefix))
    kinds = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    kinds[group] = text
    dup = lines - np.bincount(kinds, minlength=n_texts)
    # Words in windows that occur twice or more.
    g, at = run_hashes(word_hashes(data, starts, ends, prefix), first, WINDOW)
    text = np.repeat(own, np.diff(at))
    group, count = _groups(text, g)
    again = np.flatnonzero((count[group] > 1) & (n[text] >= WINDOW))
    spot = again - at[text[again]] + first[text[again]]
    inside = np.zeros(len(starts), bool)
    for k in range(WINDOW):
        inside[spot + k] = True
    return [n, chars, symbols, lines, dup, _per_text(inside, first)]


@tidy
def _measure_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in batches:
        data, offsets = utf8(col)
        parts = []
        for lo, hi in chunks(offsets):
            part = offsets[lo:hi + 1]
            got = measure(data[part[0]:part[-1]], part - part[0])
            parts.append(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in got], fields=list(_TYPE)))
        yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)


def measured(docs: DataFrame, text: str = "text", name: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``name`` of ``MEASURES``."""
    return docs.withColumn(name, F.arrow_udf(_measure_all, ", ".join(f"{m} long" for m in MEASURES)).asNondeterministic()(text_or_empty(text)))


def shrunk_rates(docs: DataFrame, host: str, failed: dict[str, Column]) -> DataFrame:
    """(host, documents, rates): one row per host; ``rates`` holds a struct per rule: failures, rate as counted and shrunk.

    With hosts i of n_i documents, k_i failures, N documents and rate m overall, the share of variance between hosts is
    rho = (S - m(1-m)(H-1)) / (m(1-m)(N - sum n_i^2/N - H + 1)), S = sum n_i (k_i/n_i - m)^2, kept within [0, 1]; the beta prior
    weighs w = 1/rho - 1 documents of rate m, so the shrunk rate is (rho k + (1-rho) m) / (rho n + 1 - rho)."""
    per = docs.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(c.cast("int")).alias(f"k_{r}") for r, c in failed.items()])
    per = saved(per, "hosts")
    square = F.col("n").cast("double") * F.col("n")
    whole = per.agg(
        F.count("*").cast("double").alias("hosts"), F.sum("n").cast("double").alias("docs"), F.sum(square).alias("squares"),
        *[F.sum(f"k_{r}").cast("double").alias(f"k_{r}") for r in failed],
        *[F.sum(F.col(f"k_{r}").cast("double") * F.col(f"k_{r}") / F.col("n")).alias(f"s_{r}") for r in failed])
    a, n = whole.first(), F.col("n")  # one row of sums
    docs_n, hosts_n = a["docs"] or 1.0, a["hosts"]
    out = []
    for r in failed:
        k, m = F.col(f"k_{r}"), (a[f"k_{r}"] or 0.0) / docs_n
        within = m * (1 - m)
        room = within * (docs_n - (a["squares"] or 0.0) / docs_n - hosts_n + 1)
        spread = (a[f"s_{r}"] or 0.0) - docs_n * m * m
        rho = min(1.0, max(0.0, (spread - within * (hosts_n - 1)) / room)) if room > 0 else 0.0
        shrunk = (k * rho + (1 - rho) * m) / (n * rho + (1 - rho))
        out.append(F.struct(F.lit(r).alias("rule"), k.alias("failures"), (k / n).alias("rate"), shrunk.alias("shrunk")))
    return per.select("host", n.alias("documents"), F.array(*out).alias("rates"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", name: str = "rules", limit: float = LIMIT, share: int = SHARE, keep_text: bool = False) -> DataFrame:
    """``docs``, without its text unless ``keep_text``, with a struct column ``name``.

    It holds the measures, failed (names of the document's failed rules), base_failed, host_rejected, and kept: no rule
    failed and the host not rejected."""
    f = F.col(name)
    found = measured(docs, text, name)
    found = saved(found if keep_text else found.drop(text), "measured")
    verdicts = saved(shrunk_rates(found, host, rules(f)), "verdicts")
    verdict = fresh(found, "verdict")
    bad = F.exists("rates", lambda r: r["shrunk"] > limit)
    total = verdicts.agg(F.sum("documents")).first()[0] or 0
    hot = verdicts.where(F.col("documents") * share >= total).select(F.col("host").alias(verdict), bad.alias("_bad"))
    cold = verdicts.where(F.col("documents") * share < total).select(F.col("host").alias(verdict), bad.alias("_bad"))
    flag = fresh(found, "host_bad")
    known = found.join(F.broadcast(hot.withColumnRenamed("_bad", flag)), F.col(host) == F.col(verdict), "left")  # at most ``share`` hosts
    near = known.where(F.col(verdict).isNotNull() | F.col(host).isNull()).drop(verdict)
    far = known.where(F.col(verdict).isNull() & F.col(host).isNotNull()).drop(verdict, flag)
    far = far.join(cold.withColumnRenamed("_bad", flag), F.col(host) == F.col(verdict), "left").drop(verdict)
    judged = near.unionByName(far)
    failed = F.array_compact(F.array(*[F.when(c, r) for r, c in rules(f).items()]))
    rejected = F.coalesce(F.col(flag), F.lit(False))
    return judged.withColumn(name, F.struct(
        *[f[m].alias(m) for m in MEASURES], failed.alias("failed"), F.arrays_overlap(failed, F.array(*map(F.lit, BASE))).alias("base_failed"),
        rejected.alias("host_rejected"), ((F.size(failed) == 0) & ~rejected).alias("kept"))).drop(flag)
