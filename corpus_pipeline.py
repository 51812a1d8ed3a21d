"""A corpus pipeline: quality, near copies, repeated passages, benchmark leaks, token ids.

Each stage reads what its predecessor kept.  ``run`` writes every stage's result as Parquet in
the shared folder of the cluster and reads it again, so a stage's work is not repeated when
executors are lost.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import bpe, decontam, minhash, quality, substring
from parlance.llm.common import shared_dir, table

STAGES = [
    ("quality_classifier", quality.stage),
    ("minhash_near_dedup", minhash.stage),
    ("substring_dedup", substring.stage),
    ("benchmark_decontamination", decontam.stage),
    ("byte_level_bpe", bpe.stage),
]

#: No SQL: the classifier and the tokenizer cannot be expressed; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
