"""The stages of corpus_pipeline.py: functions of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, queries
from .bpe import encode
from .fuzzy_lines import drop_fuzzy_lines
from .minhash import near_duplicates
from .mixing import mix, mixed_texts


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language recognised; documents in which none is go."""
    profiles = langid.learn(docs)
    judged = langid.predict(docs, profiles).filter(F.col("lang_pred") != langid.UNKNOWN)
    return judged.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; documents of which no text is left go."""
    kept = drop_fuzzy_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    lost = near_duplicates(docs, percent=80).filter("not kept").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    _, blocks = mix(docs)
    return mixed_texts(docs, blocks).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, n_tokens) of each text."""
    rows = encode(docs.withColumn("doc_id", F.struct("doc_id", "source", "lang")), queries.vocabulary_path(), decode=False)
    return rows.select("doc_id.*", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]
