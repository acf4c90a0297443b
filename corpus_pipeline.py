"""The training-data pipeline over ``documents``: quality, near duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontaminate, jaccard, mixing, quality, tokens
from vigil.llm.common import ascii_lower, columns, fresh, new_dir, table, without, written


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named d0, d1, ...: an operator's own columns then replace none of them."""
    return docs.toDF(*[f"d{k}" for k in range(len(docs.columns))])


def at(docs: DataFrame, name: str) -> str:
    return f"d{docs.columns.index(name)}"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text lies in the range of their language."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    scores = quality.judge(quality.perplexity(docs.select("doc_id", "text", "lang"), trusted))
    key = fresh(docs, "_key")
    rejected = scores.filter("NOT keep").select(F.col("id").alias("doc_id"), F.col("key").alias(key))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("lang", F.lit("und")), "text"))
    return without(keyed, rejected, ["doc_id", key]).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard.survivors(docs, k=5, num=4, den=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item; an item of fewer words has no such window."""
    plain = numbered(docs)
    items = table(spark, sf_dir, "benchmark").filter(F.size(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(decontaminate.WORD), F.lit(0))) >= 10)
    found = decontaminate.scan(plain, items, text_col=at(docs, "text"), window=10)
    return found.filter(F.size("spans") == 0).select(*plain.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root weights of their sources, globally shuffled."""
    plain = numbered(docs)
    mixed = mixing.mix(plain, id_col=at(docs, "doc_id"), source_col=at(docs, "source"), alpha=0.5, seed=17)
    return mixed.select(*plain.columns).toDF(*docs.columns)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """``docs`` and a column that ascends with file and row, where it is read from Parquet: the order in which it was written."""
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:  # rows that come from no file have no such order
        return docs, None
    name = fresh(docs, "_order")
    place = F.concat("_metadata.file_name", F.lit(":"), F.lpad(F.col("_metadata.row_index").cast("string"), 15, "0"))
    return docs.select("*", place.alias(name)), name


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet-matrix shards, in the order of mixing (by id where ``docs`` comes from no file); what the files say of each document."""
    path = new_dir(spark, "pipeline-tokens")
    docs, order = in_file_order(docs)
    tokens.write_tokens(docs, path, order_col=order, vocabulary=public_tokenizers.path("byte_bpe_50k.json"), end_id=0, added_tokens=True)
    return tokens.read_documents(spark, path)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_token_files),
]

#: The language model and the byte-pair encoding have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = written(docs, f"pipeline-{name}")
    return docs
