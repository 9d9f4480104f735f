"""The language stage turns away what no labelled language holds, and stages carry columns of any name."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triage_spark.llm import langid, linededup

SF = "/root/testdata/sf0.01"


def test_language_turns_nonsense_and_a_fifth_language_away(spark):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(10, 60)))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"
    extra = spark.createDataFrame([(10**6 + k, noise()) for k in range(100)] + [(2 * 10**6, finnish), (3 * 10**6, "12 34 !"), (3 * 10**6 + 1, None)], "doc_id long, text string")
    kept = corpus_pipeline.language(spark, docs.unionByName(extra, allowMissingColumns=True), SF)
    assert kept.filter("doc_id >= 1000000").count() == 0
    assert kept.count() == docs.count()
    fewer = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    kept = corpus_pipeline.language(spark, fewer, SF).join(docs.select("doc_id", F.col("lang").alias("was")), "doc_id")
    n = {r["was"]: r["count"] for r in kept.groupBy("was").count().collect()}
    all_of = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert n.get("fr", 0) < 0.1 * all_of["fr"] and all(n[k] == all_of[k] for k in all_of if k != "fr")


@pytest.mark.parametrize("stage", [corpus_pipeline.leaks, corpus_pipeline.near_duplicates, corpus_pipeline.language])
def test_stages_carry_columns_of_any_name(spark, stage):
    names = ["gone_content", "content", "content__", "key__", "row", "key", "coverage", "score", "lang_pred", "h1", "n"]
    text = " ".join(f"the words of document number {k} are these" for k in range(30))
    docs = spark.createDataFrame([(k, text + f" and {k}", "en", *range(len(names))) for k in range(3)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in names))
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == (1 if stage is corpus_pipeline.near_duplicates else 3) and all(tuple(r)[3:] == tuple(range(len(names))) for r in rows)


def test_texts_are_read_once(spark, monkeypatch):
    """A filter on the predicted language runs no second worker; lines are cut once, from small batches."""
    d = spark.createDataFrame([(k, "one two three " * 20 + "\n" + "four " * 40, "en") for k in range(4)], "doc_id long, text string, lang string")
    said = langid.identify(d, langid.fit(d), coverage=True).filter("lang_pred = 'en' AND coverage > 0").select("doc_id")
    assert said._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and said.count() == 4
    sizes, kept = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, n=None: sizes.append(n) or kept(df, n))
    assert linededup.repeated_runs(d).count() == 3 and sizes[0] == 1024
