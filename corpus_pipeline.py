"""Training-corpus pipeline over ``documents``.

Each stage works on all that its predecessor kept and its decisions take
effect: texts without an identified language go, of equal texts one stays, of
near duplicates one stays, sources are taken up to their target weights (a
document taken twice is there twice), and what is left is packed into
sequences.  ``run`` writes every stage's result as Parquet in the shared
checkpoint folder and rereads it.  Language identification and packing have no
SQL form, so there is no oracle; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import langid, mixing, packing, quotient, simhash
from fathom.llm.common import documents, stored
from fathom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or in no learned language."""
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the row with the smallest doc_id stays; a null text counts as empty."""
    return quotient.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays (3-word shingles, 3 bits)."""
    return simhash.drop_near_duplicates(docs, shingle=3, radius=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup),
          ("mixing_sources", mix_sources), ("best_fit_packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
