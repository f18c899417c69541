"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and rereads as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultlens.llm import jaccard_join, mixing, packing, quality_rules, secrets
from faultlens.llm.common import Stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose source fails as a whole, go.

    A null or empty text fails; a null source fails no document; rows that repeat are judged alike.
    """
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts (five words, 0.8) the document of the smallest id stays.

    A null id counts as the largest; of several texts of one id in a component, and of rows that
    repeat, one stays; a text without words is linked with nothing and stays.
    """
    return jaccard_join.keep_one(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows. Null and empty texts stay as they are, no row goes."""
    return secrets.redact(docs, count="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as its rate says, a fraction being decided by a hash of the id.

    A text without words has rate 1; rows that repeat an id with the same text stay equally often.
    """
    return mixing.mixed(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its bin and place there.

    A text without words has a row without a bin; rows that repeat never share a bin; documents of
    equal length are placed in the order of their ids, null last.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("secret_scans", redaction), ("mixing", mix), ("best_fit_packing", pack)]

#: Components of a similarity join, the fitted rates and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = len(Stored.made)
        own = Stored(stage(spark, docs, sf_dir), name)
        # The stage's result is written: what it kept on the way, and its input, aren't read any more.
        for old in Stored.made[before - bool(name != STAGES[0][0]) : -1]:
            old.drop()
        docs = own.df
    return docs
