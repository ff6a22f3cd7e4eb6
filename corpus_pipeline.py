"""The corpus pipeline: toxicity, quality rules, near-duplicates, benchmark
passages, and BPE ids of what is left.

Defined cases: a null text is an empty one (the quality rules reject it); a null
or repeated id costs no other row anything, as rows are told apart by a stored
key; of a group of near copies the row with the least id (nulls last), then text
hash, then row key stays; an empty table gives an empty result; all stages but
the last give every column of a row back as it was, whatever it is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import bpe, decontaminate, quality, simhash, toxicity
from llm._batches import shared_folder, table

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("quality rules", quality.keep_good),
    ("SimHash near-dedup", simhash.keep_one),
    ("benchmark decontamination", decontaminate.drop_leaks),
    ("BPE encoding and decoding", bpe.encode_stage),
]

#: Models, fingerprints and tokenizers are beyond SQL: see tests/llm/test_queries.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = shared_folder(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
