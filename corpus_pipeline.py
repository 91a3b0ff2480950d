"""Training corpus from raw documents: judge, deduplicate, decontaminate, remove personal data, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next one's
documents.  All but the last return the columns of documents.  The other tables come from ``sf_dir``.

Stages that read texts in Python set the session's Arrow batches to 2,000 rows at most and leave it so: a stage's
result is only planned when its caller writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.llm import bagminhash, contamination, packing, pii, quality
from metasift.llm.common import fresh, lean, saved, table


#: Chunks whose ids a worker remembers; workers live through all stages, so the table is small.
REMEMBERED = 300_000


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    lean(spark)
    name = fresh(docs, "judged")
    model, _, _ = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name=name).where(F.col(name)["keep"]).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    lean(spark)
    return bagminhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much benchmark text."""
    lean(spark)
    name = fresh(docs, "contamination")
    found = contamination.annotate(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.where(~F.col(name)["contaminated"]).select(*docs.columns)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` counts the new text."""
    name = fresh(docs, "pii")
    found = pii.find(docs, name=name, keep_text=True)
    cleaned = found.withColumn("text", pii.redact(F.col("text"), F.col(name)["spans"]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.size(F.col(name)["spans"]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the sequences they lie in."""
    lean(spark)
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [("quality", judge), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("pii", remove_pii), ("packing", pack)]

#: SQL cannot express the trained classifier; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
