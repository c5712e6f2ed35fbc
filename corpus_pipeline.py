"""From raw documents to token ids: quality rules, near-duplicates, benchmark decontamination, secrets, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever they are called; the last replaces text, ids and
n_tokens. Rows with a null doc_id go through the quality rules and lose their secrets like any other; the two stages that
name documents by id cannot name them, so they stay. Null and empty texts fail the quality rules; the other stages pass
them on as they are. Repeated rows are judged alike, and one of them is left after near_duplicates. Very long texts are
worked on whole. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumspark.llm import bpe, decontaminate, near_dup, quality, secrets
from quorumspark.llm.common import fresh, materialize, table

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    column, verdict = fresh("measured"), fresh("verdict")
    measured = materialize(quality.measure(docs, out=column), "quality")
    judged = quality.judge(measured, quality.references(measured, column=column), column=column, out=verdict)
    return judged.where(F.col(verdict)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class (word 5-grams, similarity 0.8): that with the least doc_id. Of rows that repeat
    its doc_id and text one stays; rows of its doc_id with another text stay, too."""
    classes = near_dup.near_duplicates(docs, k=5, percent=80)
    kept, rows = fresh("kept"), fresh("rows")
    special = classes.groupBy("doc_id").agg(F.bool_or("kept").alias(kept), F.count("*").alias(rows))
    special = materialize(special.where(F.col("doc_id").isNotNull() & (~F.col(kept) | (F.col(rows) > 1))), "classes")
    rest = docs.join(special.where(~F.col(kept)), "doc_id", "left_anti").select(*docs.columns)
    repeated = special.where(F.col(kept))
    once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    leaks = materialize(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    before = fresh("text")
    clean = secrets.redact(docs.withColumn(before, F.col("text")), known=secrets.vocabulary(docs))
    if "n_chars" in docs.columns:
        changed = ~clean["text"].eqNullSafe(F.col(before))
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, in place of its text."""
    encoded = bpe.encode(docs, bpe.read_definition(bpe.tokenizer_path()), remember=False)
    return encoded.select(*(c for c in docs.columns if c not in ("text", "ids", "n_tokens")), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokenization", tokenization),
]

#: SQL can express neither the near-duplicate classes nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
