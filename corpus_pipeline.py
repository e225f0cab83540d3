"""The training-data pipeline: language ID, near-dedup, substring dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from gridloom.llm.queries import STAGES, run_stages

#: No stage but the last but one can be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The documents that pass every stage: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text."""
    return run_stages(spark, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
