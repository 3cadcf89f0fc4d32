"""A training-data pipeline over ``documents``; every stage is written as Parquet and read again by the next.

In every stage null and empty texts, very long texts, repeated rows, an empty table and further columns of any name have a
defined result, stated there. All stages but the last return the columns they were given. Tables of stages are deleted once
the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import langid, packing, repeats, secrets, simhash
from siltstone.session import drop_path, fresh_path, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognisable language, or with an ambiguous one, go.

    So null and empty texts and those without a letter go; if no row has a label nothing can be recognised and all go.
    Texts count whole; repeated rows stay or go together, each once more; an empty table stays empty. Of two languages that
    are equally near neither is clear, so the document goes.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = langid.identify(rows, langid.train(docs), ["row"])
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each class of texts linked by a 5-word Jaccard similarity of 0.8 or more the one with the smallest id stays.

    Links come from multi-index hashing of 256-bit fingerprints and are compared in full (see ``simhash.alike``): none is
    false, and a few of those near 0.8 are not met.
    Null ids come last, of equal ids the smallest text hash wins. Texts without words (null, empty, blank) are one class.
    Of repeated rows one stays. Very long texts count whole; an empty table stays empty.
    """
    return simhash.one_of_each(docs, width=5, like=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages that occur elsewhere too are cut out of the texts; no document goes.

    Null texts stay null. A text that is repeated through and through becomes empty, so repeated rows do. A character that
    loses a byte goes whole. Very long texts count whole; an empty table stays empty.
    """
    return repeats.remove_repeats(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: the value of every span is replaced by a mark; no document goes.

    Null texts stay null, empty ones empty. Overlapping values get one mark. Texts of any length are read once; repeated rows
    get equal texts; an empty table stays empty.
    """
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the tokens of all documents into sequences, one row a piece.

    A null or empty text is its end id alone; long texts are cut into pieces; repeated rows and null ids are packed as often
    as they stand there; pieces of one length may change places; an empty table gives an empty result. Further columns are
    left out.
    """
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), 0)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", without_repeats),
    ("secret scans", redact),
    ("best-fit packing", pack),
]
#: Classifier, fingerprints, suffix arrays and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        docs = materialize(stage(spark, docs, sf_dir), name, path)
        if last:
            drop_path(spark, last)
        last = path
    return docs
