"""Token counts of whole texts, through a cache of content digests."""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, cut, drop, shared_dir, slices, table

#: Texts that differ in these only, between words, have equal counts in vocabularies that drop white space.
ASCII_SPACE = "[\\t\\n\\x0B\\f\\r ]+"


@lru_cache(maxsize=4)
def word_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def word_counts(path: str) -> Memo:
    """Word (bytes without ASCII white space) -> tokens that the library makes of it."""
    tokenizer = word_tokenizer(path)
    return Memo(lambda word: len(tokenizer.encode(word.decode(), add_special_tokens=False).ids))


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Token counts of texts by a vocabulary whose tokens never hold white space.

    Such a vocabulary treats the words between ASCII white space alone, so a text's count is the sum of
    its words' counts; the library encodes each word that the worker has not seen before.
    """
    memo, split = word_counts(path), [t.encode("utf-8", "surrogatepass").split() for t in texts]
    new = list({w for words in split for w in words if w not in memo})
    if len(memo) + len(new) > memo.bound:
        memo.clear()
        new = list({w for words in split for w in words})
    for at in range(0, len(new), 20_000):
        part = new[at : at + 20_000]
        found = word_tokenizer(path).encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
        memo.update(zip(part, (len(x) for x in found)))
    return [sum(map(memo.__getitem__, words)) for words in split]


def version_digest(path: str) -> str:
    """Names the vocabulary file's bytes and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """Counts the tokens of ``docs(doc_id, text)`` and flags counts above ``limit``.

    ``tokenizer`` is the path of a white-space-dropping vocabulary for ``tokenizers``; ``cache`` is a folder that
    driver and executors share. Contents are normalised (runs of ASCII white space become one blank, none at
    the ends) and digested; digests are joined to the counts stored for this vocabulary and library version (a folder
    of the cache named by their digest, which is the version part of the key: other folders are never read),
    one row of each unknown digest is encoded, and its count is appended to the cache.

    Null texts count as empty: 0 tokens. Repeated rows, repeated or null doc_ids and other columns are fine: there is
    one row out for each row in. No rows give an empty result. Texts of any length are counted whole.
    Returns doc_id, n_bytes long, n_tokens long, over_limit boolean.
    """
    spark = docs.sparkSession
    stored = f"{cache.rstrip('/')}/version={version_digest(tokenizer)}"
    schema = "content string, n_tokens long"
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.sha2(F.trim(F.regexp_replace(text, ASCII_SPACE, " ")), 256)
    whole = docs.select("doc_id", text.alias("text"), content.alias("content"))
    keys = cut(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "token-keys")
    known = spark.read.schema(schema).parquet(stored) if _exists(spark, stored) else spark.createDataFrame([], schema)
    # aggregates are written before they are joined, or the join would keep their partitions and could not split a hot digest
    # of each unknown content the doc_id that has it in the fewest rows, one where there is such a doc_id
    rows = keys.groupBy("content", "doc_id").agg(F.count("*").alias("rows")).groupBy("content").agg(F.min(F.struct("rows", "doc_id")).alias("least"))
    misses = cut(rows.select("content", "least.doc_id", "least.rows").join(known, "content", "left_anti"), "token-misses")
    todo = whole.alias("w").join(misses.alias("m"), F.col("w.content").eqNullSafe(F.col("m.content")) & F.col("w.doc_id").eqNullSafe(F.col("m.doc_id"))).select("w.content", "w.text", "m.rows")
    # only rows that repeat a doc_id with its text have to be told apart, and only their texts are shuffled for it
    todo = todo.where("rows = 1").union(todo.where("rows > 1").dropDuplicates(["content"])).drop("rows")

    def encode(batches):
        for pdf in batches:
            for s in slices(pdf.text):
                yield pd.DataFrame({"content": pdf.content[s], "n_tokens": count_tokens(pdf.text[s].tolist(), tokenizer)})

    fresh = todo.mapInPandas(encode, schema)
    fresh.write.mode("append").parquet(stored)
    drop(misses)
    counts = cut(spark.read.schema(schema).parquet(stored).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    done = keys.join(counts.hint("merge"), "content")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call starts from a cache of its own, so that it does its work in full."""
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
