"""Registry of checked queries: inventory id, key, Spark callable and oracle text."""

from __future__ import annotations

import textwrap
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from metasift.plans.fixtures import FIXTURES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    ident: str
    key: str
    run: Query
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixtures as CTEs."""
    sql = textwrap.dedent(sql).strip()
    if not names:
        return sql
    ctes = ",\n".join(f"{n} as materialized ({FIXTURES[n].strip()})" for n in names)
    low = sql.lower()
    if low.startswith("with recursive "):
        return f"with recursive {ctes},\n{sql[15:]}"
    if low.startswith("with "):
        return f"with {ctes},\n{sql[5:]}"
    return f"with {ctes}\n{sql}"


def query(ident: str, key: str, oracle: str | None = None, fx: tuple[str, ...] | str = ()):
    """Register a query; ``fx`` names the fixtures its oracle text uses as CTEs."""
    names = (fx,) if isinstance(fx, str) else fx

    def wrap(fn: Query) -> Query:
        if key in ENTRIES:
            raise ValueError(f"query {key} registered twice")
        text = with_fixtures(oracle, *names) if oracle else None
        ENTRIES[key] = Entry(ident, key, fn, text)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_current_views: dict[int, str] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input table, built by the same text the oracle uses."""
    if _current_views.get(id(spark)) != sf_dir or not spark.catalog.tableExists("conversations"):
        for t in TABLES:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        _current_views[id(spark)] = sf_dir
    base = DOCUMENTS.get(name)
    if base is None:
        return spark.sql(FIXTURES[name])
    plain = table(spark, sf_dir, base)
    spread(plain).createOrReplaceTempView(base)
    df = spark.sql(FIXTURES[name])
    plain.createOrReplaceTempView(base)
    return df


# Fixtures of JSON or code texts, whose queries are bound by the processor, and the tables they come from.
DOCUMENTS = {"fx_payload": "orders", "fx_expectation": "orders", "fx_connector": "orders", "fx_adf": "orders", "fx_fabric": "part",
             "fx_config": "customer", "fx_merge": "orders", "fx_code": "part", "fx_jobspec": "orders"}

#: Rows whose documents one task builds and reads.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Round robin over as many tasks as the rows call for, at least one per core.

    A text costs far more than the narrow row it comes from, so splits by bytes, or by the files' row groups, make
    tasks that grow with the table.  The rows are counted from the footers of the files; no key ever lands in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))
