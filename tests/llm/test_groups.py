"""Near-duplicates of documents and vectors, packing, pages, archives, scoring."""

import collections
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metasift.llm import bagminhash, embeddings, lm, packing, warc, wrappers
from metasift.llm.common import utf8
from metasift.llm.subwords import Subwords, default_tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bags(text):
    w = WORD.findall((text or "").lower())
    return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def similar(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def groups_of(texts, threshold=0.8):
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [bags(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if own[a] and own[b] and similar(own[a], own[b]) >= threshold:
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return [top(k) for k in range(len(texts))]


def near_texts(seed=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 300))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    out += ["again and again and again and so on " * 30, "again and again and again and so on " * 32, "", None, "!!!", "two words", "Two, words"]
    return out


@pytest.mark.parametrize("tile", [bagminhash.TILE, 3])
def test_near_duplicates_match_brute_force(spark, tile):
    texts = near_texts()
    docs = spark.createDataFrame([(k + 5, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, row string, near_ long")
    found = bagminhash.near_duplicates(docs, tile=tile)
    assert found.columns == [*docs.columns, "near"]
    got = {r.doc_id - 5: r.near for r in found.collect()}
    want = groups_of(texts)
    assert [got[k].class_id - 5 for k in range(len(texts))] == want
    assert all(got[k].kept == (want[k] == k) for k in range(len(texts)))
    kept = bagminhash.deduplicate(docs, tile=tile)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id - 5 for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = "some text that is long enough to count here"
    rows = [(1, text), (1, text), (None, text), (None, "other words"), (2, None), (2, None)]
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.near.kept for r in got if r.text == text) == 1
    assert {r.near.class_id for r in got if r.text == text} == {1}
    assert all(r.near.kept for r in got if r.text != text)
    assert bagminhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(4)
    a = collections.Counter({k: rng.randint(1, 9) for k in range(60)})
    b = collections.Counter({k: max(1, v + rng.randint(-2, 2)) for k, v in a.items() if k % 6})
    truth = sum((a & b).values()) / sum((a | b).values())
    from metasift.llm.common import mix
    agree = []
    for salt in range(40):
        row = np.array([0] * len(a) + [1] * len(b))
        g = mix(np.array([*a, *b], np.uint64) + np.uint64(1000 * salt + 17))
        sig = bagminhash.signatures(row, g, np.array([*a.values(), *b.values()]), 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - truth) < 0.02


def unit_vectors(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        base = rng.standard_normal(32)
        out += [base + rng.standard_normal(32) * s for s in (0, 0.05, 0.1, 0.2, 0.4)]
    hot = rng.standard_normal(32)
    out += [hot + rng.standard_normal(32) * 0.02 for _ in range(60)]
    return [x.astype(np.float32).astype(float).tolist() for x in out]


def test_vectors_of_every_length_and_many_copies(spark):
    rng = np.random.default_rng(4)
    a, b, c = (rng.standard_normal(d) for d in (16, 16, 5))
    near = a + 0.02 * rng.standard_normal(16)
    rows = [(k, (a * (1 + k % 3)).tolist()) for k in range(5_000)] + [(6_000, near.tolist()), (6_001, b.tolist()), (7_000, c.tolist()), (7_001, (2 * c).tolist()), (7_002, [1.0]), (7_003, [2.0]), (7_004, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {got[k] for k in range(5_000)} == {(5_000, 0)} and got[6_000] == (5_000, 0) and got[6_001] == (0, 6_001)
    assert got[7_000] == got[7_001] == (1, 7_000) and got[7_002] == got[7_003] == (1, 7_002) and got[7_004] == (0, 7_004)


@pytest.mark.parametrize("tile", [embeddings.TILE, 8])
def test_embedding_links_match_brute_force(spark, tile):
    vectors = unit_vectors()
    n = len(vectors)
    odd = [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] + [1.0] * 31), (n + 3, [1.0]), (n + 4, [None] + [1.0] * 31), (None, vectors[0])]
    rows = spark.createDataFrame([*enumerate(vectors), *odd], "vec_id long, embedding array<double>").withColumn("row", F.lit("x"))
    got = {r.vec_id: r for r in embeddings.near_duplicates(rows, tile=tile).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    found = sum(got[k].n_links for k in range(n))
    assert found >= 0.97 * (close.sum() - n)
    assert all(got[k].n_links <= close[k].sum() - 1 for k in range(n))
    assert len(got) == n + 6
    for k in (n, n + 1, n + 2, n + 3, n + 4):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embeddings.near_duplicates(rows.limit(0)).count() == 0


def test_collision_rate_matches_trials():
    rng = np.random.default_rng(8)
    a = rng.standard_normal(64)
    a /= np.linalg.norm(a)
    b = a + rng.standard_normal(64) * 0.04
    b /= np.linalg.norm(b)
    p = rng.standard_normal((64, 20_000))
    s = rng.uniform(0, 1.5, 20_000)
    same = (np.floor((a @ p + s) / 1.5) == np.floor((b @ p + s) / 1.5)).mean()
    assert abs(same - embeddings.collision(float(np.linalg.norm(a - b)), 1.5)) < 0.01


ODD_TEXTS = ["a<|endoftext|>b c", "x y  z\x1c w\tq\r\nk\x0b", "é Å  ́ 가", "", "  ", "I'LL don't 've It's. IT'S", "ΑΣ Σ ÉÀ İ ſ K", "é" * 50, "a" * 5000 + " " + "1" * 3000, "'ll. .. ., Ab. ab, É. ². a,. x. ….", None]


@pytest.mark.parametrize("remembered", [2_000, 5])
def test_subwords_are_the_tokenizers(remembered):
    own = Subwords(default_tokenizer(), remembered)
    for _ in range(2):
        ids, at = own.encode(*utf8(pa.array(ODD_TEXTS)))
        for k, t in enumerate(ODD_TEXTS):
            assert ids[at[k]:at[k + 1]].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_pieces_hold_every_id_once(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["one", "two", "threefold", "x"], k=rng.choice([1, 5, 200, 3000, 9000]))) for _ in range(60)] + [None, "", "a" * 30_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, start string").coalesce(1)
    rows = packing.pack(docs, with_ids=True, segments=8).collect()
    t = Subwords(default_tokenizer()).tokenizer
    for k, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert [x for r in mine for x in r.ids] == want
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    for s in {r.sequence_id for r in rows}:
        mine = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert sum(r.length for r in mine) <= 4096 and len(mine) <= 8
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_keeps_all_three_limits():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 400, 500)
    demand = np.stack([tokens, np.ones(500, int), np.minimum(tokens, rng.integers(0, 300, 500))], axis=1)
    bins, places = packing.fill(demand, np.array([1000, 6, 700]))
    for b in range(bins.max() + 1):
        assert (demand[bins == b].sum(axis=0) <= [1000, 6, 700]).all()
        assert sorted(places[bins == b]) == list(range((bins == b).sum()))
    assert bins.max() + 1 <= 1.1 * max(demand[:, 0].sum() / 1000, 500 / 6, demand[:, 2].sum() / 700) + 1


def test_prompts_bear_no_loss(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b c", "x y")], "doc_id long, text string, p string"), prompt="p").collect()
    assert [(r.length, r.loss_tokens) for r in rows] == [(6, 4)]


PAGE = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- c > --><div class="ad">{ad}</div>{body}<footer>&copy; me</footer>'


def test_article_text(spark):
    bodies = {
        1: "<article><h1>Title&amp;amp;</h1><p><b>bold<i>er</i>  text<br>next<p>Second &eacute;</p><aside>no</aside><div class='comments'><p>mine</p></div></article>",
        2: "<article><h1>Other</h1><p>Words</p><form><p>in</p></form></article>",
        3: "<article><h1>Third</h1><p>More words</p>", 4: "<article></article>",
    }
    want = {1: "Title&amp; bolder text next Second é", 2: "Other Words", 3: "Third More words", 4: ""}
    pages = [(k, "http://h.example/" + str(k), PAGE.format(ad=f"buy {k}", body=b)) for k, b in bodies.items()] + [(5, None, None), (6, "odd", "plain text"), (7, "http://", "<p>unclosed <b attr='"), (8, "http://solo.example", "")]
    rows = wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    got = {r.page_id: r.main_text for r in rows}
    assert got == want | {5: "", 6: "plain text", 7: "unclosed", 8: ""}


def test_constant_blocks_are_template_without_declared_regions(spark):
    page = "<html><body><div class=top>Site name</div><div class=txt>{0} story of day {0}</div><div class=low>All rights kept</div></body></html>"
    pages = [(k, "http://h.example/", page.format(k)) for k in range(12)]
    rows = wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.main_text for r in rows} == {k: f"{k} story of day {k}" for k in range(12)}


def test_copies_of_a_page_are_no_template(spark):
    story = "<html><body><div><blockquote>said once</blockquote><p>by one page</p></div></body></html>"
    other = "<html><body><div><p>another day</p></div></body></html>"
    lede = lambda k, t: f"<html><body><article><div class=lede>{t}</div><p>story {k}</p></article></body></html>"
    pages = [(k, f"http://a.example/{k}", story) for k in range(2)] + [(2, "http://a.example/2", other)]
    pages += [(10 + k, f"http://b.example/{k}", lede(0, "first words")) for k in range(9)] + [(20 + k, f"http://b.example/x{k}", lede(k, f"words {k}")) for k in range(1, 4)]
    rows = wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    got = {r.page_id: r.main_text for r in rows}
    assert [got[k] for k in range(3)] == ["said once by one page"] * 2 + ["another day"]
    assert [got[10 + k] for k in range(9)] == ["first words story 0"] * 9
    assert [got[20 + k] for k in range(1, 4)] == [f"words {k} story {k}" for k in range(1, 4)]


def test_tree_matching_counts_shared_nodes():
    a, _ = wrappers.parse("<div><p>x</p><ul><li>1</li></ul><table><tr><td>c</td></tr></table></div>")
    b, _ = wrappers.parse("<div><p>x</p><table><tr><td>c</td></tr></table></div>")
    assert wrappers.match(a, b, {}) == 6
    assert wrappers.match(a, a, {}) == 8


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(3)
    body = lambda: " ".join(rng.choices(["<p>", "word", "ü", "other"], k=300))
    same = body()
    pages = [(k, f"http://x.example/{k}?a=ü b\r\n", body()) for k in range(40)] + [(k, None, same) for k in range(40, 60)] + [(60, "u", None), (61, "u", ""), (None, "u", same), (62, "http://v", "x" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(2)
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(df, folder, archive_bytes=50_000)
    rows = warc.read_archives(manifest, folder).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    for ident, _, html in pages:
        r = got[None if ident is None else str(ident)]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.digest(raw))
        best = max(i for i, _, h in pages if (h or "") == (html or "") and i is not None)
        assert r.record_type == ("response" if ident == best else "revisit")
        assert r.refers_to == (None if ident == best else str(best))
        assert bytes(r.payload).decode() == (html or "") if ident == best else r.payload is None
    assert manifest.count() > 1
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_starts_with_its_dictionary():
    records = [warc.record(str(k), None, b"<html>the same words every time " * 20 + str(k).encode(), "response", None) for k in range(50)]
    data = warc.archive(records)
    assert data[:4] == warc.SKIPPABLE
    assert [x for _, x in warc.unarchive(io.BytesIO(data), 64)] == records


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(df, min_bytes=3).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_base_scores_match_plain(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "B", "b", "ccc", "Ünd", "x y", "q,"], k=rng.randint(1, 40))) for _ in range(80)] + ["", None, "unseen\tword\x0bhere"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, held_out string")
    got = {r.doc_id: r for r in lm.score(docs, head=3).collect()}
    words = lambda t: [*(t or "").encode().lower().split(), None]
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))}
    count = collections.Counter(w for k, t in enumerate(texts) if not held[k] for w in words(t))
    n, size = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    for k, t in enumerate(texts):
        r, w = got[k], words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(count[x] + 0.1) - size for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_words_beyond_the_largest_count_step_are_known(spark):
    docs = spark.createDataFrame([(k, "a " * 1_500 + "b " * 1_500) for k in range(12)], "doc_id long, text string")
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k in range(12)]
    assert held.count(False) * 1_500 > 10_500
    for r in lm.score(docs, head=1).collect():
        assert r.n_known == r.n_tokens == 3_001


def small_network(seed=1):
    rng = np.random.default_rng(seed)
    sketch = rng.poisson(2, (2 * 201, lm.SKETCH))
    net = lm.fresh_network(sketch)
    net.share = lm.shares(rng.poisson(1, (201, lm.CLASSES)), net.classes)
    return net


def test_gradient_matches_differences():
    net = small_network()
    net.inputs, w = net.inputs.astype(np.float64), net.weights.astype(np.float64)
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 200, (3, lm.WINDOW))
    target = net.classes[rng.integers(0, 200, (3, lm.WINDOW))]
    valid = (rng.random((3, lm.WINDOW)) < 0.8).astype(float)
    _, g = lm.gradient(net, w, tokens, target, valid)
    for k in rng.integers(0, len(w), 25):
        step = np.zeros_like(w)
        step[k] = 1e-5
        up, down = lm.gradient(net, w + step, tokens, target, valid)[0], lm.gradient(net, w - step, tokens, target, valid)[0]
        assert math.isclose((up - down) / 2e-5, g[k], rel_tol=2e-2, abs_tol=2e-6)


def test_probabilities_sum_to_one():
    net = small_network()
    for start in (np.array([], int), np.array([3, 7, 9])):
        total = 0.0
        for nxt in range(201):
            seq = np.append(start, nxt)
            offsets = np.array([0, len(seq)])
            head = lm.score_texts(net, seq[:-1], np.array([0, len(start)]), 200)[0] if len(start) else 0.0
            total += 10 ** (lm.score_texts(net, seq, offsets, 200)[0] - head)
        assert math.isclose(total, 1, rel_tol=1e-3)


def test_every_token_is_scored_once_whatever_the_batch():
    net = small_network()
    rng = np.random.default_rng(5)
    lengths = [1, 5, 32, 33, 57, 56, 300, 9000]
    seqs = [np.append(rng.integers(0, 200, n - 1), 200) for n in lengths]
    offsets = np.append(0, np.cumsum(lengths))
    together = lm.score_texts(net, np.concatenate(seqs), offsets, 200)
    for k, seq in enumerate(seqs):
        alone = lm.score_texts(net, seq, np.array([0, len(seq)]), 200)[0]
        assert math.isclose(alone, together[k], rel_tol=1e-4)
        start, stop = lm.windows(np.array([0, len(seq)]), lm.STRIDE)
        seen = [p for j, s in enumerate(start) for p in range(s + (lm.WINDOW - lm.STRIDE if j else 0), min(s + lm.WINDOW, len(seq)))]
        assert seen == list(range(len(seq)))


def test_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    follow = rng.permutation(200)
    seq = [0]
    for _ in range(20_000):
        seq.append(int(follow[seq[-1]]) if rng.random() < 0.9 else int(rng.integers(0, 200)))
    seq = np.array([*seq, 200])
    before = lm.previous(seq, np.array([0, len(seq)]), 200)
    sketch = np.concatenate([np.stack([np.bincount(lm._sketch(x)[np.asarray(seq if j else before) == k], minlength=lm.SKETCH) for k in range(201)]) for j, x in enumerate((before, seq))])
    net = lm.fresh_network(sketch)
    own = lm.Trainer(net)
    offsets = np.array([0, len(seq)])
    start, _ = lm.windows(offsets, lm.WINDOW)
    at = start[:100][:, None] + np.arange(lm.WINDOW)
    loss = lambda w: lm.gradient(net, w, before[at], net.classes[seq[at]], np.ones(at.shape, np.float32))[0]
    first = loss(own.w)
    for _ in range(40):
        own.learn(seq, offsets, 200)
    assert loss(own.w) < 0.7 * first


def test_count_tables_are_summed_over_their_cells(spark):
    tables = [np.random.default_rng(k).poisson(0.05, (2 * lm.BLOCK + 3, lm.CLASSES)).astype(np.int32) for k in range(5)]
    rows = [(b["kind"], b["a"], b["data"]) for t in tables for b in lm._blocks(t, "pairs")] + [("other", 0, b"")]
    df = spark.createDataFrame(rows, "kind string, a long, data binary").repartition(3)
    assert (lm.gathered(df, "pairs", tables[0].shape) == sum(tables)).all()


def test_positions_that_only_look_back_get_no_weights():
    rng = np.random.default_rng(3)
    net = lm.fresh_network(rng.poisson(2, (2 * 41, lm.SKETCH)))
    tokens = rng.integers(0, 40, (5, lm.WINDOW))
    whole, late = lm.forward(net, net.weights, tokens)[0], lm.forward(net, net.weights, tokens, 8)[0]
    np.testing.assert_allclose(late, whole.reshape(5, lm.WINDOW, -1)[:, 8:].reshape(len(late), -1), rtol=1e-5)
