"""Training-corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.
Stages work on whatever rows they are given: null or empty texts pass the filters (nothing tells against them,
but for language, where a text without a letter has none and goes), repeated rows are near duplicates, and
extra columns are carried along. A stage before the last keeps every clean document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import op1_toxicity, op3_packing, op5_minhash, op6_suffix_dedup, op8_language
from offerlake.llm.common import saved, table
from offerlake.operators.ranking import global_rank

REPEATED_BYTES = 250  # a passage of some 50 words; shorter repeats are left alone
LEAST_LANGUAGE_SCORE = 0.3  # below it no language stands out among the learned ones


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below 0.5."""
    model = op1_toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("__score", op1_toxicity.toxicity(model))
    return scored.where("__score < 0.5").drop("__score")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some learned language is found."""
    model = op8_language.train(docs)
    found = docs.withColumn("__language", op8_language.language(model))
    return found.where((F.col("__language.lang_pred") != op8_language.UNKNOWN) & (F.col("__language.score") >= LEAST_LANGUAGE_SCORE)).drop("__language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id. Where ids repeat, rows are numbered
    by id and text, so that rows with one id are near duplicates only if their texts are; equal rows are one row."""
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = op5_minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
        return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    named = docs.where("doc_id is not null").withColumn("__h1", F.xxhash64("text")).withColumn("__h2", F.xxhash64(F.lit(1), "text"))
    rows = saved(global_rank(named, [F.col("doc_id").asc(), F.col("__h1").asc(), F.col("__h2").asc()], "__row"), "numbered-rows")
    kept = op5_minhash.near_duplicates(rows, id_col="__row").where("kept").select(F.col("doc_id").alias("__row"))
    first = rows.groupBy("doc_id", "__h1", "__h2").agg(F.min("__row").alias("__row")).select("__row")
    single = rows.join(kept, "__row", "left_semi").join(first, "__row", "left_semi")
    return single.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEATED_BYTES`` bytes that occur elsewhere; n_chars follows. A character cut in two goes whole.
    A null text stays null."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = op6_suffix_dedup.removed(docs.withColumn("__null", F.col("text").isNull()), op6_suffix_dedup.Config(length=REPEATED_BYTES), keep=(*rest, "__null"))
    text = F.when(~F.col("__null"), _text(F.col("kept")))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _text(kept):
    """The bytes as text. A removed run may begin or end inside a character; what is left of it goes."""
    text = kept.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with their ids."""
    import public_tokenizers

    return op3_packing.pack(docs, public_tokenizers.path(op3_packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None  # trained models and tokenizer files have no SQL form; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
