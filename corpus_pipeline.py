"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

In every stage an empty table stays empty, texts of any length are taken whole, and columns beside doc_id, text,
lang and n_chars pass through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import langid, linechunks, neardup, packing, pii
from tallyglass.llm.common import discard, materialize


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, text and ``own``, with all other columns in one struct, out of the way of the operators' names."""
    named = ("doc_id", "text", *own)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in named] or [F.lit(0).alias("none")]
    return docs.select(*named, F.struct(*rest).alias("rest"))


def _unpacked(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """``found`` in the columns of ``docs``, of which some are ``new``; a new text brings its length as n_chars."""
    if "text" in new:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    column = lambda c: new[c] if c in new else F.col(c) if c in ("doc_id", "text") else F.col("rest")[c]
    return found.select(*[column(c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label every document with its language; those of none (no letters, or like no known language) go.

    A null text has no letters. Documents with a null id or lang teach nothing and are labelled like others; repeated rows each
    count and stay; equal cosines go to the first language by name.
    """
    found = langid.identify(_packed(docs, "lang")).where(langid.known())
    return _unpacked(found, docs, lang=F.col("lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated chunks of lines; documents of which nothing is left go.

    A null or empty text stays as it is. The first place is in the smallest doc_id, a null one before all; repeated rows of an id and text are
    one document, and treated alike.
    """
    found = linechunks.remove_repeats(_packed(docs)).where("n_removed = 0 or kept_text <> ''")
    return _unpacked(found, docs, text=F.col("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more.

    Texts without words, null ones too, are alike. The smallest doc_id stays, a null one only where there is no other; of different texts of one id the one
    with the smallest hash; of repeated rows one.
    """
    return _unpacked(neardup.deduplicate(_packed(docs)), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind. Every row stays; a null text stays null."""
    return _unpacked(pii.detect(_packed(docs), keep=("doc_id", "rest"), mask=True), docs, text=F.col("masked"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack everything that is left. A null text is empty; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: SQL expresses neither the language model nor the random field nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
