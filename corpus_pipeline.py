"""From documents to packed token sequences: quality, exact and near duplicates, mix, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import stored
from foliant.llm.cuckoo import without_duplicates
from foliant.llm.encoding import KEPT_BESIDE_OTHERS
from foliant.llm.minhash import without_near_duplicates
from foliant.llm.mixing import mixed
from foliant.llm.packing import pack
from foliant.llm.quality import score, train
from foliant.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.3 or more), as learnt from the labels of these documents."""
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, threshold=0.3).where("predicted = 1").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the largest id."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more the one with the smallest id."""
    return without_near_duplicates(docs, shingle=5, similarity=(4, 5))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times: sources weigh 1, 2, 3 in turn."""
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 4096."""
    return pack(docs, tokenizer_path(), capacity=4096, end_id=1, kept=KEPT_BESIDE_OTHERS)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]
#: The classifier's network and the mix's coins have no SQL; tests hold every stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
