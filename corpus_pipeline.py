"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes whatever its predecessor kept, whole, and returns the columns
of its input; the last returns the packed pieces.  Defined results, for each:
null and empty texts stay (a null text is packed as the end token alone);
repeated rows are judged alike and stay or go together, but for near-duplicates,
where rows with one id are one document; an empty table gives an empty result;
other columns are carried along whatever their names, up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathework.llm import decontam, neardup, packing, quality, secrets_scan
from lathework.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from this stage's input and the labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words a shingle, 0.8 or more) the document with the smallest id stays."""
    return neardup.keep_one(docs, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are benchmark passages by a twentieth or more go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan reports, base or linked, is replaced in the text; no document goes."""
    return secrets_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens at most."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: The classifier and the packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
