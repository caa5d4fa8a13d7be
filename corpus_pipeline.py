"""Raw documents to packed training sequences: five stages, each reread from what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, minhash, packing, suffix_dedup, toxicity
from graphloom.llm.common import cut, drop, table

#: Columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: words in a shingle, least similarity in percent, and bands that miss such a pair once in 10 million.
SHINGLE, PERCENT, SKETCH = 5, 80, minhash.Sketch(bands=30, rows=4)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language stays open (ambiguous with a score under 0.35).

    Null, empty and letterless texts go; texts of any length are read whole; equal rows fare alike, and all that stay are kept;
    a score of just 0.35 stays. No documents give an empty result; other columns than the five are dropped.
    """
    docs = docs.select(*COLUMNS)
    scored = docs.withColumn("_language", langid.language_udf(langid.fit_languages(docs))("text"))
    keep = (F.col("_language.lang") != "und") & ~(F.col("_language.ambiguous") & (F.col("_language.score") < 0.35))
    return scored.where(keep).select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more.

    Null and empty texts have no toxic words and stay; texts of any length are scored whole; equal rows fare alike. Without
    labels of both kinds nothing is rejected. No documents give an empty result; other columns than the five are dropped.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_toxic", toxicity.score_udf(model)("text")).where("_toxic < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id.

    Of rows that repeat that doc_id one stays, and of null doc_ids the least text. Null, empty and blank texts are near nothing
    and stay; texts of any length are compared whole. No documents give an empty result; other columns are dropped.
    """
    return minhash.near_duplicate_rows(docs.select(*COLUMNS), SHINGLE, PERCENT, SKETCH).where("first").select(*COLUMNS)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every byte that a repeated 400-byte string covers; characters cut in two by that go as well.

    All documents stay, if need be with an empty text. Null texts stay null; repeated rows of 400 bytes and more lose all of them,
    as their strings also start elsewhere; texts of any length are searched whole. No documents give an empty result.
    """
    done = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    whole = F.col("n_removed") == 0
    left = {"text": F.when(whole, F.col("text")).otherwise(F.col("kept_text")), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))}
    return done.withColumns(left).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their place in sequences of 1024 tokens.

    Null and empty texts are one piece that holds the end id; longer texts are cut into pieces; each of several equal rows has
    pieces of its own. No documents give an empty result.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", remove_repeated_strings),
    ("packing", pack),
]

#: Learned models and hashing decide most stages, which SQL can't express; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; null texts are rejected by the first (they have no language)."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if hasattr(before, "written"):
            drop(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # the pieces are written by then, and the documents are read no more
    drop(docs)
    return packed
