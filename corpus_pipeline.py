"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs, and other columns of docs,
whatever their names, go along unchanged: columns that a stage needs for itself never stand beside them.

In every stage repeated rows are rows of their own unless it says otherwise, the order of rows means nothing, ties are
settled by doc_id or by hashes of rows, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import discard, row_key, scratch, stage, table, workspace
from reelspark.llm.op4_decontaminate import clean
from reelspark.llm.op5_language import UND, identify, language_model
from reelspark.llm.op6_minhash import near_duplicates
from reelspark.llm.op8_mix import mix_documents
from reelspark.llm.op10_tokens import token_output

#: A text goes when the sample of learned languages holds less than this share of its words' trigrams.
LEAST_KNOWN = 0.4
#: Items of fewer words than a word shingle are everyday phrases and no sign of contamination.
LEAST_ITEM_WORDS = 5


def _row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name can clash with a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: null, empty and other texts without a letter, and texts in no learned language (LEAST_KNOWN).

    The evidence does not depend on how many languages there are, nor on lang, source or doc_id. Null labels are not
    learned from; without any label nothing is known and nothing stays. A null doc_id is a row like any other.
    """
    rows = docs.select(_row(docs).alias("row"), F.col("text").alias("text"))
    named = identify(rows, language_model(docs), ("row", "text"), ("label", "score", "known"))
    return named.where((F.col("label") != UND) & (F.col("known") >= LEAST_KNOWN)).select("row.*")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least doc_id; of rows equal in id and text one stays.

    Five-word shingles and a similarity of 0.8, as all stages on word shingles unless a contract says otherwise; the
    query op6 takes the two words of its own contract, which finds more near copies among short texts. Null, empty and
    blank texts have no shingles and are copies of nothing; neither are rows with a null doc_id, of which only rows
    equal in text are taken for one.
    """
    gone = stage(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select(_row(docs).alias("row")).join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti")
    first, second = row_key(F.col("row.text"))
    rows = rows.withColumns({"first": first, "second": second, "has_text": F.col("row.text").isNotNull()})
    again = Window.partitionBy("row.doc_id", "first", "second", "has_text").orderBy("first")
    return rows.withColumn("again", F.row_number().over(again)).where("again = 1").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark of at least LEAST_ITEM_WORDS words go, at a similarity of 0.8.

    Every row is judged by its own text, also where ids are null or shared; null and empty texts and items hold nothing.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"), least_words=LEAST_ITEM_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; those that it does not take go, among them null, empty and blank texts.

    A null source is a source of its own; rows with null, shared or repeated ids are taken each for itself.
    """
    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files.

    Null doc_ids come first, equal ones in the order of their ids; null and empty texts are the end id alone.
    """
    return token_output(docs)


STAGES = [("language_id", language_id), ("minhash_dedup", minhash_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_files", token_files)]

#: Learned labels, sketches and code books have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for _, function in STAGES[:-1]:
        before, path = path, scratch(spark)
        with workspace(spark):  # what the stage put aside for itself goes when its result is written
            docs = stage(function(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
