"""Secret scans: rule spans, and tokens that a battery of randomness tests cannot tell from random.

A run of token characters is tested piece by piece: ``=`` parts names from values and belongs to a piece only as padding
at the end of the run; where no encoding holds a piece, its runs in either base64 alphabet are tested, which may overlap.
For each long piece the smallest encoding that holds its characters is inferred.  Three tests ask whether the symbols
are random in that alphabet: chi-squared uniformity, runs about the alphabet's middle, and serial correlation.  Fisher's
method combines them.  Short ordinary words can look random, so every token is paired with decoys: as many letters of
the text around it, tested alike, ``DECOYS`` times where the text has so many letters.  With runs of the ordinary prose in
``ORDINARY``, which count as ``PROSE_COUNTS`` decoys, they say how often what is not random passes a threshold.  Per length stratum the
loosest threshold is taken at which that share of all tested tokens is at most ``rate`` of what passes.  There is no
least number of tokens or of passing ones: one token among few is discovered where ordinary text of its length seldom passes.

Kinds: ``assign``, ``access``, ``hex`` by rule, ``random`` by the battery (never over a rule span).
Cases: null and empty texts have no spans; repeated rows are scanned each; an empty table gives no rows and no
thresholds; other columns pass through.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import saved, text_or_empty, tidy

KINDS = ("assign", "access", "hex", "random")
#: The rule patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+$)?")
#: What is tried of a piece that mixes the signs of both base64 alphabets.
PARTS = re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*")
#: Encodings from the smallest alphabet to the largest, symbols in code order.
ENCODINGS = (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
RANKS = [{c: k for k, c in enumerate(e)} for e in ENCODINGS]
LETTERS = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
#: Lower ends of the length strata.
STRATA = (20, 24, 32, 40, 64)
#: Decoys of a token at most; of ordinary prose a stratum, and as how many of the table's they count.
DECOYS, PROSE, PROSE_COUNTS = 32, 4_000, 100
ORDINARY = (
    "the morning train was late again so we walked along the river and talked about the house that my brother wants to buy before winter comes "
    "most people there grow fruit and keep bees but the younger ones have moved to larger towns where work is easier to find "
    "she opened the letter slowly read every line twice and put it back into the drawer without saying what it was about "
    "when a program reads a file it should check how long each record is because a broken record can spoil all that follow "
    "general questions of trade history science and government were discussed by several members while others listened quietly "
    "they had enough bread cheese and water for three days yet nobody knew which of those paths would lead them down to the village"
)
#: log10 p is counted in steps of a tenth down to this many.
BUCKETS = 80

FOUND = "base array<struct<kind:string,start:long,end:long>>, tested array<struct<start:long,end:long,stratum:int,p:int,decoys:array<int>>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_TEST = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("p", pa.int32()), ("decoys", pa.list_(pa.int32()))])
_TYPE = pa.struct([("base", pa.list_(_SPAN)), ("tested", pa.list_(_TEST))])


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(ranks: list[int], size: int) -> float:
    """Combined p-value of the three tests for symbols ``ranks`` of an alphabet of ``size``."""
    n = len(ranks)
    expected = n / size
    counts = Counter(ranks)
    chi = sum(c * c for c in counts.values()) / expected - n
    p_chi = _upper((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    mid = (size - 1) / 2
    side = [r > mid for r in ranks]
    up = sum(side)
    down = n - up
    if up and down:
        mean = 2 * up * down / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 1 + sum(a != b for a, b in zip(side, side[1:], strict=False))
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    avg = sum(ranks) / n
    spread = sum((r - avg) ** 2 for r in ranks)
    if spread:
        lag = sum((a - avg) * (b - avg) for a, b in zip(ranks, ranks[1:], strict=False)) / spread
        p_lag = 2 * _upper(abs(lag + 1 / n) * math.sqrt(n))
    else:
        p_lag = 2.0 ** (1 - n)
    half = -sum(math.log(max(min(p, 1.0), 1e-300)) for p in (p_chi, p_runs, p_lag))
    return math.exp(-half) * (1 + half + half * half / 2)


def token_p(token: str) -> float | None:
    """The battery's p-value in the inferred encoding; None where no encoding holds the token."""
    body = token.rstrip("=")
    for ranks in RANKS:
        try:
            return battery([ranks[c] for c in body], len(ranks))
        except KeyError:
            continue
    return None


def _bucket(p: float) -> int:
    return min(BUCKETS - 1, int(-10 * math.log10(max(p, 1e-300))))


def _decoys(text: str, start: int, end: int, n: int) -> list[int]:
    """The buckets of up to ``DECOYS`` runs of ``n`` letters around the token; none where there are too few letters."""
    near = text[max(0, start - DECOYS * n):start] + text[end:end + DECOYS * n]
    letters = [LETTERS[c] for c in near.lower() if c in LETTERS]
    return [_bucket(battery(letters[k * n:k * n + n], 26)) for k in range(min(DECOYS, len(letters) // n))]


@functools.cache
def _prose(n: int) -> list[int]:
    """The buckets of ``PROSE`` runs of ``n`` letters of ordinary words in mixed order, counted by bucket."""
    rng, words, letters = random.Random(n), ORDINARY.split(), []
    while len(letters) < PROSE * n:
        rng.shuffle(words)
        letters += [LETTERS[c] for w in words for c in w]
    out = [0] * BUCKETS
    for k in range(PROSE):
        out[_bucket(battery(letters[k * n:k * n + n], 26))] += 1
    return out


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three rules by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if TOKEN.search(text):
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def pieces(token: str) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of what is tested of a run of token characters."""
    out = []
    for m in PIECE.finditer(token):
        whole = _tested(token, *m.span())
        out += [whole] if whole else sorted({t for part in PARTS for k in part.finditer(m.group()) if (t := _tested(token, m.start() + k.start(), m.start() + k.end()))})
    return out


def _tested(token: str, start: int, end: int) -> tuple[int, int, float] | None:
    piece = token[start:end]
    if len(piece) < MIN_TOKEN or not (any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece)):
        return None
    p = token_p(piece)
    return None if p is None else (start, end, p)


def scan(text: str) -> dict:
    """Rule spans, and the tested pieces with the buckets of their own and of their decoys' p-values."""
    base, tested = rule_spans(text), []
    for m in TOKEN.finditer(text):
        for a, b, p in pieces(m.group()):
            start, end = m.start() + a, m.start() + b
            if any(a < end and start < b for _, a, b in base):
                continue
            n = end - start
            tested.append({"start": start, "end": end, "stratum": sum(n >= s for s in STRATA) - 1, "p": _bucket(p), "decoys": _decoys(text, start, end, n)})
    return {"base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "tested": tested}


@tidy
def _scan_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in batches:
        yield pa.array([scan(t or "") for t in col.to_pylist()], _TYPE)


def thresholds(found: DataFrame, name: str, rate: float) -> dict[int, int]:
    """Per stratum the loosest bucket at which tokens that pass like decoys are at most ``rate`` of what passes; from counts over all rows."""
    tests = found.select(F.explode(F.col(name)["tested"]).alias("t")).select("t.stratum", "t.p", "t.decoys")
    decoys = F.transform("decoys", lambda b: F.struct(F.lit(0).alias("own"), b.alias("b")))
    sides = tests.select("stratum", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("own"), F.col("p").alias("b"))), decoys)).alias("x"))
    counts = sides.groupBy("stratum", "x.own", "x.b").count().collect()  # at most strata x 2 x buckets rows
    have = {(r["stratum"], r["own"], r["b"]): r["count"] for r in counts}
    out = {}
    for s, least in enumerate(STRATA):
        tokens, near = (sum(have.get((s, own, b), 0) for b in range(BUCKETS)) for own in (1, 0))
        if not tokens:
            continue
        passed = like = prose = 0
        for b in range(BUCKETS - 1):
            passed += have.get((s, 1, b), 0)
            like += have.get((s, 0, b), 0)
            prose += _prose(least)[b]
            share = (like + PROSE_COUNTS * (1 + prose) / (1 + PROSE)) / (near + PROSE_COUNTS)
            if passed and tokens * share <= rate * passed:
                out[s] = b
    return out


def find(docs: DataFrame, text: str = "text", name: str = "secrets", rate: float = 0.05) -> DataFrame:
    """``docs`` without its text, with a struct column ``name``: base (rule spans) and spans (all spans by start, then kind)."""
    tests = F.arrow_udf(_scan_all, FOUND).asNondeterministic()
    found = saved(docs.withColumn(name, tests(text_or_empty(text))).drop(text), "secrets")
    limit = thresholds(found, name, rate)
    passes = F.lit(False)
    f = F.col(name)

    def hit(t: Column) -> Column:
        out = passes
        for s, b in limit.items():
            out = out | ((t["stratum"] == s) & (t["p"] <= b))
        return out

    more = F.transform(F.filter(f["tested"], hit), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    order = F.transform(F.concat(f["base"], more), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.withColumn(name, F.struct(f["base"].alias("base"), spans.alias("spans")))
