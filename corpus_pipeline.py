"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""
from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, langid, minhash, mixing, secrets
from tidewire.llm.shared import carried, remove, shared_dir

#: Columns that stages work on; any others are carried along under names that clash with nothing.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose language is known with less than this probability is no language's text.
LEAST_SCORE = 0.35


def carrying(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that gets documents with columns of any names and returns them all, in their order.

    For every stage: an empty table gives an empty one, rows that repeat are rows of their own
    unless the stage says otherwise, and very long texts are worked on whole.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, named = carried(docs, OWN)
        return named(stage(spark, plain, sf_dir).select(plain.columns))

    return run


@carrying
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language: those with a letter and a score of LEAST_SCORE or more.

    The model learns from the labelled rows of the stage's own input, those with a text and a
    lang.  A null text, or one without a letter, is rejected; of ties the first language counts.
    """
    judged = langid.predict(docs, langid.fit(docs), keep=True)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document with the smallest doc_id.

    Documents without words or text have no duplicates and stay; so do rows with a null doc_id.
    Rows that share a doc_id stay or go together.
    """
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


@carrying
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts, encoded ones included, and count characters anew; a null text stays null, with a null count."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each piece of a document in a block of the mix, with that document's id.

    Texts that are null or have no words go, as nothing can be mixed of them.
    """
    mixed = mixing.mix_texts(docs, block=512)
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their digest and the digest of what they decode to."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        raw = file.read()
    return bpe.encode(docs, raw, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: A learned model and hashed permutations are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder.

    A stage's rows go when the next stage has written its own; only the last ones stay, for
    the result.  Nothing stays after an exception.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tidewire-pipeline-{uuid.uuid4().hex}"
    try:
        for i, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if i:
                remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    except BaseException:
        remove(spark, folder)
        raise
    return docs
