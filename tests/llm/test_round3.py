"""Fill-in-middle, tokenizer alignment and host rules: against plain versions, with odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metasift.llm import alignment, hosts, middle
from metasift.llm.common import saved, utf8
from metasift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "", None, "a", "é­ß", "one two  three\nfour\n\nfive", "  lead and trail \n", "<P> mark", "<M", "x" * 700 + "é" * 300 + " y" * 400,
    "\n\n\n", "日本語のテキスト" * 40, "a\tb\x0bc\x0cd", "same line\nsame line\nother\nsame line ", "a b c a b c a b c d e f", "😀 emoji 😀 emoji 😀 emoji 😀",
]


def frame(spark, texts=TEXTS):
    """Documents with clashing extra columns, a null id and a repeated row."""
    rows = [(k, t, "h", None, None, "x") for k, t in enumerate(texts)] + [(None, "no id here", None, None, None, None), (4, TEXTS[4], "h", None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, verdict string, host_bad string, n string")


# --- fill-in-middle -------------------------------------------------------------------------

def plain_units(text, unit):
    """Code-point offsets where units begin."""
    if unit == "point":
        return list(range(len(text)))
    if unit == "line":
        return [k for k in range(len(text)) if k == 0 or text[k - 1] == "\n"]
    starts = [m.start() for m in WORD.finditer(text)]
    return ([0] + starts[1:]) if text else []


@pytest.mark.parametrize("unit", middle.UNITS)
def test_skip_list_finds_every_rank(unit):
    texts = [t or "" for t in TEXTS]
    data, offsets = utf8(pa.array(texts))
    lanes = middle.SkipList(data, offsets, unit)
    assert len(lanes.lanes) > 2
    n, points = lanes.totals()
    assert points.tolist() == [len(t) for t in texts]
    own, ranks, want = [], [], []
    for k, t in enumerate(texts):
        starts = plain_units(t, unit)
        assert n[k] == len(starts)
        for r in range(len(starts) + 1):
            own.append(k)
            ranks.append(r)
            want.append(starts[r] if r < len(starts) else len(t))
    assert lanes.seek(np.array(own), np.array(ranks)).tolist() == want


def test_skip_list_without_text():
    data, offsets = utf8(pa.array(["", None]))
    lanes = middle.SkipList(data, offsets)
    assert lanes.totals()[0].tolist() == [0, 0] and lanes.seek(np.array([0, 1]), np.array([0, 0])).tolist() == [0, 0]


def plain_middle(ident, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'null' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    p, q = sorted(x % (len(t) + 1) for x in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, t
    a, b, z = t[:p], t[p:q], t[q:]
    return ("spm", p, q - p, f"<S>{z}<P>{a}<M>{b}") if h[3] % 100 < 20 else ("psm", p, q - p, f"<P>{a}<S>{z}<M>{b}")


def test_rearranged_matches_plain_and_is_undone(spark):
    docs = frame(spark, TEXTS * 4)
    found = middle.rearrange(docs)
    assert found.columns == [*docs.columns, "middle"]
    rows = found.withColumn("back", middle.restore(F.col("middle")["output"], F.col("middle")["form"])).collect()
    assert len(rows) == 4 * len(TEXTS) + 2
    for r in rows:
        assert (r.middle.form, r.middle.prefix_chars, r.middle.middle_chars, r.middle.output) == plain_middle(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.middle.n == len(r.text or "")
    assert {r.middle.form for r in rows} == {"plain", "psm", "spm"}


def test_rearranged_by_words_keeps_words_whole(spark):
    rows = middle.rearrange(frame(spark), unit="word", rearranged=100).collect()
    for r in rows:
        if r.middle.form != "plain":
            starts = {*plain_units(r.text, "word"), len(r.text)}
            assert {r.middle.prefix_chars, r.middle.prefix_chars + r.middle.middle_chars} <= starts
    assert middle.rearrange(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        middle.rearrange(frame(spark), unit="page")


# --- tokenizer alignment --------------------------------------------------------------------

ALIGNED = TEXTS + [
    "The quick brown fox, said O'Neil's unbelievable antidisestablishmentarianism.", "tabs\tand  double  spaces\n\nlines", "<|endoftext|> <s> </s> <0x41>",
    "naïve café — “quotes” … 42,000.5 % ﬁ", "▁ low", " ", "  ", "\x00 nul", "The quick brown fox", " " * 3_000 + "end",
]


def plain_alignment(texts):
    """Groups and links of every text by offsets, without windows."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = alignment.default_tokenizers()
    a_tool, b_tool = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    a_tool.encode_special_tokens = True
    letters = alignment.byte_letters()
    out = []
    for t in texts:
        if not t:
            out.append(([], [], []))
            continue
        a, b = a_tool.encode(" " + t, add_special_tokens=False), b_tool.encode(t)
        a_bytes = [bytes(letters[c] for c in a_tool.id_to_token(x)) for x in a.ids]
        b_bytes = [bytes([int(p[3:-1], 16)]) if b_tool.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, map(b_tool.id_to_piece, b))]
        if b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            out.append(([], [], []))
            continue
        ends = []
        for side in (a_bytes, b_bytes):
            at, e = 0, []
            for x in side:
                at += len(x)
                e.append(at)
            ends.append(e)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for s in shared:
            p, q = ends[0].index(s, i) + 1, ends[1].index(s, j) + 1
            groups.append((a.ids[i:p], b[j:q]))
            i, j = p, q
        out.append((a.ids, b, groups))
    return out


@pytest.mark.parametrize("head", [alignment.HEAD, 20])
def test_alignment_matches_plain(spark, head):
    docs = frame(spark, ALIGNED)
    found = alignment.align(docs)
    assert found.columns == [*docs.columns, "aligned"]
    found = saved(found, "aligned")
    rows = alignment.rated(found, alignment.pair_counts(found), head=head).collect()
    assert len(rows) == len(ALIGNED) + 2
    texts = [r.text for r in rows]
    plain = plain_alignment(texts)
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in plain for g in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for r, (a, b, groups) in zip(rows, plain):
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (r.aligned.n_a, r.aligned.n_b, r.aligned.groups) == (len(a), len(b), want), r.text[:40]
        links = [(x[-1], y[-1]) for x, y in groups]
        assert sum(r.aligned.times) == len(links)
        assert r.rated.count_sum == sum(counts[x] for x in links)
        assert r.rated.n_best == sum(counts[x] == best[x[1]] for x in links)


def test_alignment_without_rows(spark):
    found = saved(alignment.align(frame(spark).limit(0)), "aligned")
    assert alignment.rated(found, alignment.pair_counts(found)).count() == 0


def test_alignment_remembers_no_more_than_its_bound():
    tool = alignment.Aligner(*alignment.default_tokenizers(), remembered=3)
    n_a, n_b, groups, links, first = tool.align(["one two three four five six", "one two"])
    assert len(tool.memo) == 3 and groups[0].startswith(groups[1]) and first[-1] == len(links)


def test_fast_ids_equal_plain_ids(sf):
    import duckdb

    texts = [" " + (r[0] or "") for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]
    tool = alignment.ByteLevel(alignment.default_tokenizers()[0])
    assert tool.fast is not None
    assert [x.tolist() for x in tool.encode(texts)] == [x.tolist() for x in tool._plain(texts)]


def test_texts_that_the_fast_path_gives_up_on_are_encoded_all_the_same():
    tool = alignment.ByteLevel(alignment.default_tokenizers()[0])
    texts = [" one  two", " " * 50]
    want = [x.tolist() for x in tool.encode(texts)]

    class GivesUp:
        def encode_to_numpy(self, text):
            raise ValueError("backtracking")

    tool.fast = GivesUp()
    assert [x.tolist() for x in tool.encode(texts)] == want


def test_alignment_query_counts_over_the_whole_table(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op12_cross_tokenizer"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    plain = plain_alignment([d.text for d in docs])
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in plain for g in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for d, (a, b, groups) in zip(docs, plain):
        r = rows[d.doc_id]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = [(x[-1], y[-1]) for x, y in groups]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links))
        assert (r.count_sum, r.n_best) == (sum(counts[x] for x in links), sum(counts[x] == best[x[1]] for x in links))
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if groups else "")


# --- host rules -----------------------------------------------------------------------------

def plain_measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(again)


def test_measures_match_plain(spark):
    docs = frame(spark, TEXTS + ["Aa aA Aa aA Aa aA", "# * $ % & | < >", "x\r\nx\nx\r\n", "p q r " * 5000])
    for r in hosts.measured(docs).collect():
        assert tuple(r.rules) == plain_measures(r.text), r.text


GOOD = " ".join(f"word{k}" for k in range(60))


def hosted(spark, spec):
    rows = [(f"{h}{k}", GOOD if k >= bad else "too short", h) for h, (n, bad) in spec.items() for k in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string")


def plain_shrunk(spec):
    """The beta prior by moments, from the plain definitions."""
    n, k = [x for x, _ in spec.values()], [y for _, y in spec.values()]
    total, m = sum(n), sum(k) / sum(n)
    within = m * (1 - m)
    room = within * (total - sum(x * x for x in n) / total - len(n) + 1)
    rho = min(1, max(0, (sum(x * (y / x - m) ** 2 for x, y in zip(n, k)) - within * (len(n) - 1)) / room)) if room > 0 else 0
    if rho == 0:
        return dict.fromkeys(spec, m)
    if rho == 1:
        return {h: y / x for h, (x, y) in spec.items()}
    weight = 1 / rho - 1
    return {h: (y + weight * m) / (x + weight) for h, (x, y) in spec.items()}


@pytest.mark.parametrize("share", [hosts.SHARE, 1])
def test_bad_hosts_go_and_small_ones_get_the_benefit_of_the_doubt(spark, share):
    spec = {f"fine{k}": (20, k % 3) for k in range(12)} | {"bad": (40, 38), "tiny": (1, 1), "large": (400, 8)}
    docs = hosted(spark, spec)
    want = plain_shrunk(spec)
    rates = hosts.shrunk_rates(hosts.measured(docs), "source", hosts.rules(F.col("rules"))).collect()
    for r in rates:
        short = next(x for x in r.rates if x.rule == "short")
        assert abs(short.shrunk - want[r.host]) < 1e-9 and r.documents == spec[r.host][0]
    out = hosts.judge(docs, share=share)
    assert out.columns == ["doc_id", "source", "rules"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert {r.source for r in rows if r.rules.host_rejected} == {h for h, x in want.items() if x > 0.5} and want["bad"] > 0.5
    for r in rows:
        fails = int(r.doc_id[len(r.source):]) < spec[r.source][1]
        assert r.rules.base_failed == fails and r.rules.kept == (not fails and not want[r.source] > 0.5)
    assert want["tiny"] < 1


def test_host_rules_of_odd_documents(spark):
    rows = hosts.judge(frame(spark), keep_text=True).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.rules.base_failed == (r.rules.n_words < 50 or 100 * r.rules.n_repeat_words > 50 * r.rules.n_words) for r in rows)
    assert hosts.judge(frame(spark).limit(0)).count() == 0
    alone = [r for r in rows if r.source is None]
    assert alone and not any(r.rules.host_rejected for r in alone)
