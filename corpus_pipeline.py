"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm import decontaminate, langid, linededup, neardup, packing
from triage_spark.llm.common import BATCH, forget, shared_folder, stored

ORACLE_SQL = None  # language models, retrieval and tokenizers are beyond SQL; tests/llm holds a plain version


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: those without text or letters, and those whose words are not the predicted language's.

    The model learns from seven eighths of the labelled documents, all of them; the last eighth, which it has not seen, says what share of a text's
    words and 4-grams a language has at least. A text goes if its share is surely lower (langid.coverage_limit()), or if nothing in
    it is known; without any labelled document all texts with letters stay. A document without a `lang` gets the predicted
    one. Null texts go; other nulls, repeated rows and very long texts are treated as all others, extra columns are
    carried whatever their names, and an empty table stays empty.
    """
    unseen = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(8)) == 0, F.lit(False))
    model = langid.fit(docs.filter(~unseen))
    limit = langid.coverage_limit(docs.filter(unseen & F.col("lang").isNotNull()), model)
    said = langid.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model, coverage=True)
    guess = 1.0001 / max(len(model.langs), 2)  # the score of a text of which no language has any part
    known = (F.col("lang_pred") != "und") & (F.col("coverage") >= limit) & ((F.col("score") > guess) | F.lit(len(model.langs) == 1)) if model.langs else F.col("text").rlike(r"\p{L}")
    filled = lambda c: F.coalesce("row.lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred"))) if c == "lang" else F.col("row").getField(c)
    kept = said.filter(known).select(*[filled(c).alias(c) for c in docs.columns])
    return stored(kept, BATCH)  # small Arrow batches: a worker holds few texts at a time


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document left with white space alone goes with them.

    n_chars, where there is one, follows the text. Documents without such runs, null and empty texts too, stay as
    they are; repeated rows are cut alike; any other columns are carried; an empty table stays empty.
    """
    cut = linededup.remove_runs(docs, linededup.repeated_runs(docs, whole=False))  # the lines are the same, however runs are told apart
    kept = cut.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, of likeness 0.80 or more, stays: that of the smallest doc_id.

    Decided row by row: of rows equal in doc_id and text one stays, and other texts under that doc_id are not
    touched. Rows with a null doc_id come last in their class. Texts without words stay, and so do all columns.
    """
    return neardup.keep_one(docs, percent=80).select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go, by 128 bits of hash of their text: another text under the same doc_id stays.

    Null and empty texts hold no item; repeated rows go or stay together; columns of any name are carried; very long texts
    are read whole; an empty benchmark lets all stay.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5("text").alias("content"))
    found = decontaminate.find_leaks(docs.select(F.md5("text").alias("content"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="content")
    kept = own.join(stored(found.select("content").distinct(), BATCH), "content", "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, in sequences; empty and null texts are their end token, repeated rows come again."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added, with_ids=True)


STAGES = [("language", language), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written and read again in the shared folder, and goes once the next one is there."""
    out = f"{shared_folder(spark)}/table-pipeline-{spark.sparkContext.applicationId}-{os.urandom(4).hex()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        if k:
            forget(docs)
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
