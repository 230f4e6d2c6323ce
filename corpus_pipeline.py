"""A training corpus from raw documents: toxicity, near-duplicates, decontamination, mixing, token codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm import codes, mixing, simhash, toxicity, winnowing
from metricloom.llm.queries import table, tokenizer_definition
from metricloom.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Null, empty and wordless texts stay; equal texts, repeated rows too, stay or
    go together; null ids are judged by their text. No documents give none."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id, null ids last, and of rows that agree in id
    and text one. Texts without words, null ones too, are one group. No documents give none."""
    return simhash.one_of_each(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten or more words of a benchmark item in a row go, or with all words of a shorter item. Null and empty texts
    stay; equal texts go together, whatever their ids. No documents give none."""
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass over a document that the mix takes. A document without words is never taken; a null source is one of
    its own; repeated rows are taken on their own. No documents give none."""
    return mixing.mixed_documents(docs)


def write_token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token codes, and what their files hold of each: null texts as empty ones, null ids first, repeated rows each.
    No documents give none."""
    path = scratch_path(spark, "pipeline-codes")
    codes.write_tokens(docs, path, tokenizer_definition())
    return codes.read_documents(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
    ("token codes", write_token_codes),
]

# the first stage is a trained classifier, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
