"""From raw documents to a mix of token ids: each stage writes its rows and the next one reads them.

Language ID rejects documents without a language and sets ``lang``; line dedup
deletes later copies of line runs; near-dedup keeps one document of each class;
mixing takes the sources at their target weights, whole texts, repeated where the
mix repeats them; the last stage encodes the texts and checks that they decode.

Defined results: null and empty texts and texts without a letter go in the first
stage; of repeated rows and of null ids with equal texts one row stays after the
third; very long texts pass through whole; ties are broken by text and row; extra
columns are kept by all stages but the last, whatever their names (one named lang
or n_chars is brought up to date); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import free_name, new_path
from terrace.llm.language_id import annotate
from terrace.llm.line_dedup import line_dedup
from terrace.llm.mixing import mixed_documents
from terrace.llm.near_dedup import near_dedup
from terrace.llm.sentencepiece_codec import written_round_trip


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; ``lang`` becomes the predicted language."""
    lang, score = free_name(docs, "predicted"), free_name(docs, "sure")
    known = annotate(docs, to=(lang, score)).where(F.col(lang) != "und")
    return known.select(*[F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted from ``text``; ``n_chars`` follows."""
    left = line_dedup(docs, to=(free_name(docs, "runs"), free_name(docs, "lines")))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text and whether they decode to it exactly."""
    return written_round_trip(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "ids", "n_ids", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A trained model, signatures and a Viterbi search aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
