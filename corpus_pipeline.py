"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and hands the table to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyrank.llm import langid, minhash, mixing, pieces, substrings
from polyrank.llm.common import drop_table, scratch, written

#: A text whose language is surer than this stays; at 4 languages a guess is 0.25.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and those whose language is anyone's guess."""
    named = langid.predict(docs, langid.fit(docs), docs.columns)
    return named.where((named["_lang_pred"] != langid.UNKNOWN) & (named["_score"] >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return minhash.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 100-byte strings are cut out of the texts; every document stays, if with an empty text."""
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, one of each source cut at its last word."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and digests of ids and decoded text; one row per row."""
    return pieces.encode_documents(docs, pieces.model_path(), with_ids=True).drop("decoded")


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", substring_dedup), ("mixing sources", mix), ("SentencePiece encoding", encode)]
#: A trained network and suffix arrays are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # only a stage's result outlives it, until the next one's is there
            docs = keep(written(stage(spark, docs, sf_dir), "stage-" + "-".join(name.lower().split())))
        if last is not None:
            drop_table(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
