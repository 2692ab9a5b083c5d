"""The corpus pipeline: documents without toxic ones and copies, mixed to target weights and encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tradelens.llm.bpe_codec import encode_texts
from tradelens.llm.exact_dedup import exact_duplicates_dropped
from tradelens.llm.mixing import labelled_domains, mixed_documents
from tradelens.llm.ngram_join import near_duplicates_kept
from tradelens.llm.queries import MIX_WEIGHTS, encoder, vocabulary
from tradelens.llm.shared import table
from tradelens.sources.staging import own_folder
from tradelens.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_duplicates_dropped(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_kept(docs).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays at least once; those of domains under their weight are repeated."""
    return mixed_documents(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), MIX_WEIGHTS, encoder(), floor=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe encoding", encode),
]

#: The classifiers, the components and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder and reread as the next one's documents.

    Null and empty texts pass as clean documents (null and empty ones are one group of copies). Rows are told apart by
    themselves, not by their ids: of rows with equal texts one stays, whatever their ids, and a unique text stays where
    its id is null or another row's too. More columns of documents stay, whatever their names, up to the last stage, whose
    columns are fixed. An empty table gives an empty result.
    """
    folder, docs = f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
