"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metasift.operators import quality as dq
from metasift.plans.catalog import fixture, query, table

DIRTY = "fx_dirty"


def one(key: str, column: str, fails: str, source: str) -> str:
    return f"""select '{key}' as check_key, '{column}' as "column", count(*) as total, count(*) filter ({fails}) as failing,
 count(*) filter ({fails}) = 0 as pass from {source}"""


def check_query(ident, key, kind, column, build, fails, source):
    fx = (source,) if source.startswith("fx_") else ()

    @query(ident, key, one(kind, column, fails, source), fx)
    def run(spark, sf):
        df = fixture(spark, sf, source) if fx else table(spark, sf, source)
        return dq.scorecard(df, [build()])


EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
for spec in [
    ("Q01", "dq_not_null", "not_null", "custkey", lambda: dq.not_null("custkey"), "custkey is null", DIRTY),
    ("Q03", "dq_between", "between", "l_quantity", lambda: dq.between("l_quantity", 2, 45), "l_quantity not between 2 and 45", "lineitem"),
    ("Q04", "dq_regex", "regex", "c_name", lambda: dq.matches("c_name", r"^Customer#\d{8}[0-7]$"),
     r"not regexp_matches(c_name, '^Customer#[0-9]{8}[0-7]$')", "customer"),
    ("Q05", "dq_in_set", "in_set", "o_orderstatus", lambda: dq.in_set("o_orderstatus", ["O", "F"]), "o_orderstatus not in ('O','F')", "orders"),
    ("Q05", "dq_not_in_set", "not_in_set", "o_orderpriority", lambda: dq.not_in_set("o_orderpriority", ["1-URGENT"]),
     "o_orderpriority in ('1-URGENT')", "orders"),
    ("Q08", "dq_pair_equal", "pair_equal", "l_returnflag,l_linestatus", lambda: dq.pair_equal("l_returnflag", "l_linestatus"),
     "l_returnflag is distinct from l_linestatus", "lineitem"),
    ("Q09", "dq_multicolumn_sum", "multicolumn_sum", "l_tax,l_discount",
     lambda: dq.sum_equals(["l_tax", "l_discount"], F.lit(0.1)), "abs(l_tax + l_discount - 0.1) > 1e-6", "lineitem"),
    ("Q10", "dq_type", "type", "amount_text", lambda: dq.of_type("amount_text", "bigint"),
     "try_cast(amount_text as bigint) is null and amount_text is not null", DIRTY),
    ("Q18", "dq_custom_sql", "custom_sql", "price_by_status", lambda: dq.custom_sql("price_by_status", "o_orderstatus = 'F' and o_totalprice > 400000"),
     "o_orderstatus = 'F' and o_totalprice > 400000", "orders"),
    ("Q20", "dq_date_range", "date_range", "o_orderdate", lambda: dq.date_range("o_orderdate", "1996-01-01", "2000-12-31"),
     "o_orderdate not between timestamp '1996-01-01' and timestamp '2000-12-31'", "orders"),
]:
    check_query(*spec)


@query("Q02", "dq_unique", """
with n as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)
select 'unique' as check_key, 'l_orderkey,l_linenumber' as "column", sum(n)::bigint as total, coalesce(sum(n) filter (n > 1), 0)::bigint as failing,
 coalesce(sum(n) filter (n > 1), 0) = 0 as pass from n""")
def dq_unique(spark, sf):
    return dq.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q06", "dq_row_count_between", """
select 'row_count_between' as check_key, '*' as "column", count(*) as total, (case when count(*) between 1000 and 10000 then 0 else 1 end)::bigint as failing,
 count(*) between 1000 and 10000 as pass from orders""")
def dq_row_count_between(spark, sf):
    return dq.row_count_between(table(spark, sf, "orders"), 1000, 10000)


@query("Q07", "dq_mean_between", """
select 'mean_between' as check_key, 'l_quantity' as "column", round(avg(l_quantity), 4) as value, round(avg(l_quantity), 4) between 20 and 30 as pass from lineitem""")
def dq_mean_between(spark, sf):
    return dq.statistic_between(table(spark, sf, "lineitem"), "l_quantity", "mean", 20, 30)


@query("Q07", "dq_stdev_between", """
select 'stdev_between' as check_key, 'l_quantity' as "column", round(stddev_samp(l_quantity), 4) as value, round(stddev_samp(l_quantity), 4) between 1 and 10 as pass from lineitem""")
def dq_stdev_between(spark, sf):
    return dq.statistic_between(table(spark, sf, "lineitem"), "l_quantity", "stdev", 1, 10)


@query("Q11", "dq_columns_match", """
select 'columns_match' as check_key, 'id,custkey,amount_text,email' as "column", count(*) as total, count(*) filter (custkey is null) as failing,
 count(*) filter (custkey is null) = 0 as pass from fx_dirty""", DIRTY)
def dq_columns_match(spark, sf):
    cols = ["id", "custkey", "amount_text", "email"]
    records = fixture(spark, sf, DIRTY).select(F.to_json(F.struct(*cols)).alias("doc"))
    return dq.columns_match(records, "doc", cols)


@query("Q12", "dq_sum_assertion", """
select 'sum_assertion' as check_key, 'l_quantity' as "column", round(sum(l_quantity), 2) as value, round(sum(l_quantity), 2) >= 1000 as pass from lineitem""")
def dq_sum_assertion(spark, sf):
    return dq.sum_assertion(table(spark, sf, "lineitem"), "l_quantity", 1000)


@query("Q13", "dq_distinct_count", """
select 'distinct_count' as check_key, 'l_partkey' as "column", count(*) as total, count(distinct l_partkey) as distinct_values from lineitem""")
def dq_distinct_count(spark, sf):
    return dq.distinct_count(table(spark, sf, "lineitem"), "l_partkey")


@query("Q13", "dq_distinct_count_approx")
def dq_distinct_count_approx(spark, sf):
    return dq.distinct_count(table(spark, sf, "lineitem"), "l_partkey", approximate=True)


@query("Q13", "dq_distinct_sketch", """
select l_returnflag, count(*)::bigint as total, true as within, true as same_as_whole from lineitem group by 1""")
def dq_distinct_sketch(spark, sf):
    """Sketches per ship mode, merged per return flag: within 3 % of the exact count, and the same as a sketch of all rows."""
    rows = table(spark, sf, "lineitem")
    parts = dq.distinct_sketches(rows, "l_partkey", ["l_returnflag", "l_linestatus", "l_linenumber"])
    merged = dq.merged_distinct(parts, "l_partkey", ["l_returnflag"])
    whole = dq.merged_distinct(dq.distinct_sketches(rows, "l_partkey", ["l_returnflag"]), "l_partkey", ["l_returnflag"])
    exact = rows.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"))
    n, m = F.col("n"), F.col("distinct_values")
    return merged.join(exact, "l_returnflag").join(whole.select("l_returnflag", F.col("distinct_values").alias("all")), "l_returnflag").select(
        "l_returnflag", "total", (F.abs(m - n) <= n * 0.03 + 1).alias("within"), (F.abs(m - F.col("all")) <= n * 0.03 + 1).alias("same_as_whole"))


@query("Q14", "dq_referential", """
select 'referential' as check_key, 'l_orderkey' as "column", count(*) as total, count(*) filter (o_orderkey is null) as failing,
 count(*) filter (o_orderkey is null) = 0 as pass
from lineitem left join (select o_orderkey from orders where o_orderstatus <> 'P') on o_orderkey = l_orderkey""")
def dq_referential(spark, sf):
    return dq.referential(table(spark, sf, "lineitem"), "l_orderkey",
                          table(spark, sf, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


@query("Q15", "dq_freshness", """
select 'freshness' as check_key, 'ts' as "column", floor((epoch(timestamp '2024-02-01') - floor(epoch(max(ts)))) / 3600)::bigint as age_hours,
 floor((epoch(timestamp '2024-02-01') - floor(epoch(max(ts)))) / 3600) <= 24 as pass from events""")
def dq_freshness(spark, sf):
    return dq.freshness(table(spark, sf, "events"), "ts", "2024-02-01 00:00:00", 24)


@query("Q16", "dq_duplicate_rows", """
with n as (select *, count(*) as n from fx_dirty group by all)
select 'duplicate_rows' as check_key, '*' as "column", sum(n)::bigint as total, sum(n - 1)::bigint as failing, sum(n - 1) = 0 as pass from n""", DIRTY)
def dq_duplicate_rows(spark, sf):
    return dq.duplicate_rows(fixture(spark, sf, DIRTY))


@query("Q17", "dq_not_empty_column", """
select 'not_empty' as check_key, 'custkey' as "column", count(*) as total, (case when count(custkey) > 0 then 0 else 1 end)::bigint as failing,
 count(custkey) > 0 as pass from fx_dirty""", DIRTY)
def dq_not_empty_column(spark, sf):
    return dq.not_empty(fixture(spark, sf, DIRTY), "custkey")


@query("Q19", "dq_completeness_ratio", """
select 'completeness' as check_key, 'custkey' as "column", round(count(custkey) / count(*), 6) as ratio, round(count(custkey) / count(*), 6) > 0.98 as pass from fx_dirty""", DIRTY)
def dq_completeness_ratio(spark, sf):
    return dq.completeness(fixture(spark, sf, DIRTY), "custkey")


def dirty_checks():
    return [dq.not_null("custkey", severity="quarantine"), dq.of_type("amount_text", "bigint", severity="drop"),
            dq.matches("email", EMAIL, severity="warn"), dq.custom_sql("late", "order_date > timestamp_ntz '2001-01-01'", severity="reject")]


@query("Q21", "dq_actions_split", r"""
with t as (select *, custkey is null as q, try_cast(amount_text as bigint) is null as d, email = 'bad' as w, order_date > timestamp '2001-01-01' as r from fx_dirty)
select case when q or r then 'quarantine' else 'clean' end as part, id, amount_text,
 array_to_string(list_filter([case when q then 'quarantine:not_null:custkey' end, case when w then 'warn:regex:email' end, case when r then 'reject:custom_sql:late' end], lambda x: x is not null), '|') as codes
from t where not d""", DIRTY)
def dq_actions_split(spark, sf):
    clean, held = dq.actions_split(fixture(spark, sf, DIRTY), dirty_checks())
    pick = lambda df, part: df.select(F.lit(part).alias("part"), "id", "amount_text", F.array_join("codes", "|").alias("codes"))
    return pick(clean, "clean").unionByName(pick(held, "quarantine"))


SCORE = [("not_null", "l_shipdate", "l_shipdate is null"), ("between", "l_discount", "l_discount not between 0 and 0.05"),
         ("in_set", "l_returnflag", "l_returnflag not in ('A','R')"), ("custom_sql", "tax", "l_tax > 0.07")]


@query("Q22", "dq_scorecard", " union all ".join(one(k, c, f, "lineitem") for k, c, f in SCORE))
def dq_scorecard(spark, sf):
    return dq.scorecard(table(spark, sf, "lineitem"), [
        dq.not_null("l_shipdate"), dq.between("l_discount", 0, 0.05), dq.in_set("l_returnflag", ["A", "R"]),
        dq.custom_sql("tax", "l_tax > 0.07")])
