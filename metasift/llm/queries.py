"""Registered queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.llm import alignment, bagminhash, contamination, embeddings, hosts, lm, middle, packing, pii, quality, secrets, warc, wrappers
from metasift.llm.common import hex_sha256, joined_spans, saved, small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return wrap


LOWER_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = "regexp_extract_all(" + LOWER_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op8_decontaminate", f"""
with d as (select doc_id, {WORDS_SQL.format('text')} w from documents),
b as (select item_id, {WORDS_SQL.format('text')} w from benchmark),
bw as (
  select distinct item_id, least(13, len(w)) m, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) k from b where len(w) > 0)
),
lens as (select distinct m from bw),
dw as (
  select doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') g
  from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) k from d, lens where len(w) >= m)
),
occ as (select doc_id, k, bw.m, item_id from dw join bw on dw.g = bw.g and dw.m = bw.m),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(k, k + m - 1)) p from occ) group by 1),
its as (
  select doc_id, count(*) n_items, string_agg(i, ',' order by i) s
  from (select distinct doc_id, cast(item_id as varchar) i from occ) group by 1
)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hit using (doc_id) left join its using (doc_id)
""")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"), hex_sha256(F.array_join(c["items"], ",")).alias("items_sha256"),
        c["contaminated"].alias("contaminated"),
    )



@query("op10_warc", """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s from pages),
b as (
  select page_id, string_agg(lpad(bin(cast('0x' || s[2 * i - 1 : 2 * i] as integer)), 8, '0'), '' order by i) bits
  from (select page_id, s, unnest(generate_series(1, 20)) i from p) group by 1
),
d as (
  select page_id, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast('0b' || bits[5 * j - 4 : 5 * j] as integer) + 1], '' order by j) digest
  from (select page_id, bits, unnest(generate_series(1, 32)) j from b) group by 1
),
m as (select h, max(page_id) best from p group by 1)
select page_id, cast(octet_length(encode(p.h)) as bigint) payload_bytes, digest payload_digest,
  case when page_id = best then 'response' else 'revisit' end record_type, case when page_id <> best then best end refers_to
from p join m on p.h = m.h join d using (page_id)
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("secrets")["base"], F.col("secrets")["spans"]
    return found.select(
        "doc_id", _count(base, "assign"), _count(base, "access"), _count(base, "hex"),
        hex_sha256(joined_spans(base)).alias("base_sha256"), joined_spans(spans).alias("spans"),
    )


@query("op3_embedding_dedup", """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) n from v where list_dot_product(e, e) > 0),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) n_links, min(r.b) component_id, min(r.b) = e.vec_id kept
from embeddings e join r on r.a = e.vec_id group by e.vec_id
""")
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_minhash_dedup")
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "near.n_words", "near.class_id", "near.kept")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("pii")["base"], F.col("pii")["spans"]
    return found.select(
        "doc_id", *[_count(base, k) for k in pii.KINDS],
        hex_sha256(joined_spans(base)).alias("base_sha256"), joined_spans(spans).alias("spans"),
    )


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, _, _ = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "judged.n_words", "judged.quality", "judged.toxicity", "judged.keep")


@query("op1_lm_score")
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op11_fill_in_middle", """
with h as (
  select doc_id, coalesce(text, '') t, cast(length(coalesce(text, '')) as bigint) n,
    [cast('0x' || sha256('1:' || doc_id)[8 * k - 7 : 8 * k] as bigint) for k in [1, 2, 3, 4]] h
  from documents
),
c as (
  select doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) p, greatest(h[1] % (n + 1), h[2] % (n + 1)) q,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
      when h[4] % 100 < 20 then 'spm' else 'psm' end form
  from h
),
f as (select *, substring(t, 1, p) a, substring(t, p + 1, q - p) b, substring(t, q + 1) z from c)
select doc_id, n, form, case when form <> 'plain' then p end prefix_chars, case when form <> 'plain' then q - p end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) output_sha256,
  sha256(t) restored_sha256
from f
""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("middle")
    return found.select(
        "doc_id", m["n"].alias("n"), m["form"].alias("form"), m["prefix_chars"].alias("prefix_chars"), m["middle_chars"].alias("middle_chars"),
        hex_sha256(m["output"]).alias("output_sha256"), hex_sha256(middle.restore(m["output"], m["form"])).alias("restored_sha256"),
    )


@query("op12_cross_tokenizer")
def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    a, r = F.col("aligned"), F.col("rated")
    digest = F.when(a["groups"] == "", "").otherwise(hex_sha256(a["groups"]))
    with small_batches(spark, 1_000):
        found = saved(found.select("doc_id", F.struct(a["n_a"].alias("n_a"), a["n_b"].alias("n_b"), a["pairs"].alias("pairs"), a["times"].alias("times"), digest.alias("sha256")).alias("aligned")), "aligned")
    links = F.aggregate(a["times"], F.lit(0).cast("long"), lambda n, x: n + x)
    return alignment.rated(found, alignment.pair_counts(found)).select(
        F.col("doc_id").cast("long").alias("doc_id"), a["n_a"].alias("n_a"), a["n_b"].alias("n_b"), links.alias("n_groups"), links.alias("n_links"),
        r["n_best"].alias("n_best"), r["count_sum"].alias("count_sum"), a["sha256"].alias("groups_sha256"),
    )


@query("op13_host_rules", r"""
with w as (
  select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents
),
g as (select doc_id, k, w[k : k + 2] g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) k from w)),
r as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, g) n from g) where n > 1),
p as (select doc_id, count(distinct q) n from (select doc_id, unnest([k, k + 1, k + 2]) q from r) group by 1),
f as (
  select w.doc_id, source, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(len(l) as bigint) n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, coalesce(p.n, 0) n_repeat_words
  from w left join p using (doc_id)
),
j as (
  select *, [cast(n_words < 50 as int), cast(100 * n_repeat_words > 50 * n_words as int), cast(10 * n_symbols > n_words as int), cast(2 * n_dup_lines > n_lines as int)] x from f
),
s as (select source, r, count(*)::double n, sum(x[r])::double k from j, (values (1), (2), (3), (4)) v(r) where source is not null group by 1, 2),
a as (select r, count(*)::double h, sum(n) n, sum(n * n) n2, sum(k) / sum(n) m, sum(k * k / n) s from s group by r),
q as (select r, m, m * (1 - m) v, m * (1 - m) * (n - n2 / n - h + 1) room, s - n * m * m - m * (1 - m) * (h - 1) more from a),
b as (select r, m, case when room > 0 then least(1, greatest(0, more / room)) else 0 end rho from q),
e as (select source, max((rho * k + (1 - rho) * m) / (rho * n + 1 - rho)) > 0.5 bad from s join b using (r) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, x[1] + x[2] > 0 base_failed,
  list_sum(x) = 0 and not coalesce(bad, false) kept
from j left join e using (source)
""")
def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hosts.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    r = F.col("rules")
    return found.select("doc_id", *[r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
