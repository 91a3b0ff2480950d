import random

import numpy as np
import pyarrow as pa
import re

from metasift.llm.common import chunks, components, run_hashes, utf8, word_hashes, words

TEXTS = ["", None, "One two", "ONE  two!three", "é-É 9x", "a" * 5000, "x\ny\tz", "   "]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_words_and_hashes_agree_with_plain_reading():
    data, offsets = utf8(pa.array(TEXTS))
    starts, ends, first = words(data, offsets)
    raw = data.tobytes()
    h = word_hashes(data, starts, ends)
    seen = {}
    for k, t in enumerate(TEXTS):
        got = [raw[a:b].decode() for a, b in zip(starts[first[k]:first[k + 1]], ends[first[k]:first[k + 1]])]
        assert [lower(x) for x in got] == WORD.findall(lower(t))
        for x, y in zip(got, h[first[k]:first[k + 1]]):
            assert seen.setdefault(lower(x), y) == y
    assert len(set(seen.values())) == len(seen)


def test_chunks_cover_rows_once():
    offsets = np.cumsum([0, 5, 0, 100, 3, 3, 3])
    got = list(chunks(offsets, 10))
    assert [r for lo, hi in got for r in range(lo, hi)] == list(range(6))


def test_run_hashes_tell_runs_apart():
    data, offsets = utf8(pa.array(["a b c d e f", "b c d e f", "a b", ""]))
    s, e, first = words(data, offsets)
    g, begin = run_hashes(word_hashes(data, s, e), first, 5)
    assert np.diff(begin).tolist() == [2, 1, 1, 0]
    assert g[1] == g[2] and len(set(g.tolist())) == 3


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for x in root}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
