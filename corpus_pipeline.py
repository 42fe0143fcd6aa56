"""A training corpus from raw documents in five stages, each written as Parquet and read by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of `documents` for the rows that stay; the last returns the token ids of each document.

Documents without an id are treated like any other; in near-dedup and suffix dedup they come after all documents with an
id. Rows that share an id but not a text are different documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm import common, decontaminate, language_id, near_copies, simhash_dedup, substring_dedup, word_table_bpe

TOKENIZER = "byte_bpe_50k.json"
MARGIN = 1.05  #: a text is rejected if its language is less than this many times as likely as chance


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; their lang, where it was null, becomes the recognised one.

    Rejected are texts without a letter and those whose score is no better than chance among the learned languages.
    Where nothing can be learned (no row has a lang) every text with a letter stays; with one language, too.
    """
    docs = docs.select(COLUMNS)
    model = language_id.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    chance = 1 / len(model.langs) if len(model.langs) > 1 else 0.0
    found = language_id.annotate(docs, model)
    sure = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MARGIN * chance))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of op7's fingerprints stays: the one with the smallest id. No stage by itself."""
    kept = simhash_dedup.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = named.groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS)).alias("row"))
    return first.select("row.*").unionByName(docs.where("doc_id is null").select(COLUMNS))


def similar_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Near copies are all texts whose five-word shingles have Jaccard similarity 0.8 or more: SimHash BK-trees, then an
    exact way for what they miss. Rows of one id with different texts are different documents; of several rows with the
    smallest id of a group, the one with the smallest hash stays; rows without an id come last.
    """
    return near_copies.keep_first(docs.select(COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which nothing stays goes."""
    cut = substring_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"), whole_characters=True)
    whole = F.size("spans") == 0
    text = F.col("kept").cast("string")
    return (
        cut.where(whole | (F.octet_length("kept") > 0))
        .select(
            "doc_id", text.alias("text"), "carried.lang", "carried.source",
            F.when(whole, F.col("carried.n_chars")).otherwise(F.char_length(text).cast("bigint")).alias("n_chars"),
        )
        .select(COLUMNS)
    )


def benchmark_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its error budget, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_leaks(docs, benchmark).where(F.size("leaks") == 0).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token ids and the text decoded from them."""
    coded = word_table_bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language", language),
    ("near_dedup", similar_dedup),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_clean", benchmark_clean),
    ("encode", encode),
]

ORACLE_SQL = None  #: no stage can be said in SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"corpus-{name}")
    return docs
