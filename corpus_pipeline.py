"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing, one stage after another.

Every stage but the last returns the columns of documents; a column that a stage recomputes
(n_chars after redaction) keeps its name and type. Columns that no stage knows, whatever their names
and types, are folded into one while a stage works and pass through as they are. An empty table
goes through all stages and packs to no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import langid, mixing, packing, pii, simhash, similar
from feedlake.llm.common import bounded_batches, cleared, drop_durable, durable, named

KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _folded(docs: DataFrame) -> DataFrame:
    """The known columns of ``docs``, and a struct ``row`` of the others."""
    rest = [f.name for f in docs.schema.fields if f.name not in KNOWN]
    others = F.struct(*(named(c).alias(f"c{n}") for n, c in enumerate(rest)), F.lit(True).alias("told"))
    return docs.select(*(c for c in docs.columns if c in KNOWN), others.alias("row"))


def _like(docs: DataFrame, result: DataFrame) -> DataFrame:
    """``result``, which came of ``_folded(docs)``, with the columns of ``docs`` in order and of their types."""
    rest = [f.name for f in docs.schema.fields if f.name not in KNOWN]
    return result.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in KNOWN else F.col("row")[f"c{rest.index(f.name)}"].alias(f.name) for f in docs.schema.fields))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those that the language models reject go.

    Null, empty and letterless texts are rejected; copies of a row stay or go together. Where no text
    has a label nothing can be learnt, and every document stays.
    """
    bounded_batches(spark)
    model = langid.fit(docs, F.col("doc_id").isNotNull())
    if not model.languages:
        return docs
    return _like(docs, langid.identify(_folded(docs), model).where("not rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a Jaccard similarity of 0.8 or more in five-word shingles: the one with the least doc_id.

    Texts without words are all alike. Of rows with that one id, the first by text and other columns
    stays; rows without an id all stay.
    """
    bounded_batches(spark)
    return _like(docs, simhash.keep_one(_folded(docs), similar.near_duplicates))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; a null text stays null and counts 0."""
    bounded_batches(spark)
    found = pii.find(_folded(docs), redacted=True).withColumn("text", F.col("redacted"))
    return _like(docs, found.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by output shard and in its shuffled order; texts without words are never taken."""
    bounded_batches(spark)
    return _like(docs, mixing.mix(_folded(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeated ones too, placed in sequences of 1024 tokens; a null or empty text is its end id alone."""
    bounded_batches(spark)
    packed = packing.pack(docs.select("doc_id", "source", "text"), packing.default_tokenizer())
    return packed.select("doc_id", "source", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before has written; a stage's input and leftovers go once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        if n + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with cleared() as keep:
            before, docs = docs, durable(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
        if n:
            drop_durable(before)
    return docs
