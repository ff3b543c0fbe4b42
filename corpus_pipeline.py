"""A corpus pipeline of five stages over `documents`; each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import language_id, mixing, packing, simhash, suffix_dedup
from shelfmark.llm.common import keyed, materialize, packed, unpacked
from shelfmark.llm.queries import BYTE_BPE, PIECES

#: Lowest posterior of the predicted language for a document to stay.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told (und, or a posterior under SURE) go; lang becomes the prediction."""
    model = language_id.learn(docs, "text", "lang", "doc_id", public_tokenizers.path(PIECES))
    found = language_id.predict(docs.select(packed(docs, ("text", "lang")), "text"), model, language="_lang", score="_score")
    sure = found.where((F.col("_lang") != "und") & (F.col("_score") >= SURE))
    known = {"lang": F.col("_lang"), "text": F.col("text")}
    return sure.select(*[known.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays: five-word shingles, cosine similarity of 0.8 or more.

    SimHash blocks join the texts within three bits; texts at 0.8 that these don't reach meet by smallest hashes.
    """
    known = keyed(docs.select(packed(docs), F.col("doc_id").alias("_id"), F.col("text").alias("_t")), "_id", "_t")
    groups = simhash.similar_components(known, "_k", "_t", shingle=5, similarity=0.8)
    return known.join(groups.where("_k = component_id").select("_k"), "_k", "left_semi").select(*unpacked(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out; documents of nothing else go; n_chars follows the text."""
    cut = suffix_dedup.deduplicate(docs, rewrite=True)
    return cut.where("text IS NOT NULL AND text <> ''").withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs.select(packed(docs), "doc_id", "text", "source")).where("_taken > 0")
    copies = F.sequence(F.lit(1), (F.col("_taken") / F.col("_size")).cast("int"))
    return mixed.select("_row", F.explode(copies)).select(*unpacked(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_to_targets", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
