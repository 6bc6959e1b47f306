"""A corpus, from documents to packed sequences, in five stages; each is written as Parquet and read by the next.

No stage but the last changes the columns of documents. Two stages have no form in SQL (a fitted model, and ids of a
tokeniser), so the whole has none and is tested against plain Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.common import written
from sievewright.llm.language import identify_languages
from sievewright.llm.line_dedup import dedup_lines
from sievewright.llm.mixing import mix_sources
from sievewright.llm.ngram_join import ngram_components
from sievewright.llm.packing import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too improbable in every language learnt, go; a language that was missing is filled in.

    Nothing goes and nothing is filled in if no document has a language. Null and empty texts have no letter and go; very long
    ones are scored whole. Ties go to the first language by code point. Repeated rows are judged alike, each for itself.
    """
    found = identify_languages(docs, docs, keep=COLUMNS).filter("likely")
    return found.withColumn("lang", F.coalesce("lang", F.expr("nullif(lang_pred, 'und')"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that have lost all of theirs.

    Null and empty texts have no lines to lose and stay. The first place of a line, by doc_id, text and position, keeps it; null
    doc_ids come last. Rows alike in doc_id and text lose nothing to each other. Very long texts are compared whole.
    """
    out = dedup_lines(docs, keep=("lang", "source", "n_chars")).withColumn("_lost", F.col("n_repeated") + F.col("n_near"))
    out = out.filter("_lost = 0 OR n_left > 0")
    n_chars = F.when(F.col("_lost") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _matched(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Documents that decided has (doc_id, th), once each, with its other columns."""
    decided = decided.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    both = docs.select(*COLUMNS).withColumn("_th", _text_hash()).join(decided, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    return both.dropDuplicates(["doc_id", "_th"])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    It is the one of the least doc_id, of ties the one of the least text hash; null doc_ids come last. Rows alike in doc_id and text
    count as one document. Null and empty texts link with nothing and stay. Very long texts are compared whole.
    """
    stays = ngram_components(docs).filter("stays").select("doc_id", "th").distinct()
    return _matched(docs, written(stays, "stays")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target has it.

    Null and empty texts have no words: they come as often as their place in the order has it, as do ties, in any order. Null is a
    source of its own. Of rows alike in doc_id and text the copies are added up. Very long texts are counted whole.
    """
    times = mix_sources(docs).groupBy("doc_id", "th").agg(F.sum("copies").cast("int").alias("_times")).filter("_times > 0")
    return _matched(docs, written(times, "times")).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a row for each piece of a document.

    Null and empty texts have the end id only; very long ones fill windows of their own. Repeated rows are packed each. Ties between
    neighbours go to the least place in the shard.
    """
    return pack_documents(docs)


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", ngram_jaccard),
    ("source mixing", source_mixing),
    ("retrieval packing", retrieval_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
