"""A corpus pipeline of five operators: each stage works on what the one before it kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``; the
last adds how many words the mix takes of each document. An empty table stays
empty in every stage; texts of any length are read whole; other columns are
carried as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.llm import decontaminate, mixing, pii, quality, simhash
from lodestead.llm.common import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer rejects go; null and empty texts are rejected; repeated rows score alike."""
    return quality.keep_accepted(docs, quality.fit(docs)[1])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least id, rows without an id last.

    Near are fingerprints of three-word shingles that are two or fewer bits
    apart, as in op7; copies with more than a word or two changed stay. Texts
    without words are one group; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows are known by id and text, null and empty texts stay, repeated rows go together."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; ``n_chars`` follows the text; null and empty texts stay, repeated rows change alike."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's size and target, and the words taken.

    Null sources are one source; null and empty texts have no words, so they go;
    repeated rows are separate documents; a column that has the name of an added
    one comes as ``<name>_before``.
    """
    return mixing.mix(docs, carry=docs.columns).filter(F.col("taken") > 0)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Classifier, transducers and fingerprints can't be put as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again for the next.

    What a stage wrote is removed when the next one has been written, so one copy stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
