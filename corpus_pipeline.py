"""A training corpus from the documents table, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next stage's documents. All stages
but the last return the columns of documents.

1. toxicity: documents that the counterfactual-regularised classifier marks go;
2. near copies: of every n-gram Jaccard component the smallest id stays;
3. decontamination: documents that hold a benchmark window go;
4. mixing: documents are repeated by their rates so that the expected token
   totals of the quality domains meet the targets; every document stays at
   least once;
5. token files: ids are encoded, written, and read back as an index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from feedloom.llm.common import stored, table
from feedloom.llm.queries import tokenizer_file

# Target shares of the tokens by domain.
TARGETS = {"good": 0.84, "low": 0.14, "toxic": 0.02}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, table(spark, sf_dir, "labels"), targets=TARGETS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_index(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_to_targets", mix),
    ("token_files", write_tokens),
]

# Training, similarity components and tokenizing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
