"""The registered query of each corpus operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm import alignment, decontaminate, fingerprints, langid, linededup, neardup, packing, periods, quality, secretscan, sharding, suffixdedup, urlfilter
from triage_spark.llm.common import table


def fold(key: str, n: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.filter(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))
    as_text = lambda c: fingerprints.fingerprint_text(F.col(c))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), as_text("anchors").alias("fingerprint"), as_text("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next",
        F.size("anchors").alias("n_anchors"), F.col("match_edited.offset").alias("edited_offset"), F.col("match_edited.anchors").alias("edited_matched"),
        F.col("match_next.offset").alias("next_offset"), F.col("match_next.anchors").alias("next_matched"),
    )


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = quality.fit(docs.filter(~held), labels.filter(~held))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


DAYS = 730  # of the lists and captures below


def url_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries that Spark derives from the pages' hosts: every third byte-class of a host is listed.

    Each listed host is added on a day between its shortest URL's length and the span, taken off 90 to 215
    days later, and every second one is added again.
    """
    hosts = pages.select(urlfilter.host_of(F.coalesce("url", F.lit(""))).alias("host"), F.length("url").alias("n")).filter("host <> ''")
    by = hosts.groupBy("host").agg(F.min("n").alias("least"), F.count("*").alias("pages"))
    code = F.col("least") * 31 + F.length("host") * 17 + F.ascii("host") * 7
    listed = by.withColumn("code", code.cast("int")).filter("code % 3 <> 1").withColumn("day", F.expr("(code * 13) % 500"))
    domain = F.expr("if(code % 2 = 0, host, regexp_replace(host, '^[^.]*[.](?=[^.]*[.])', ''))")
    named = listed.select(domain.alias("domain"), F.concat(F.lit("list"), (F.col("code") % 4).cast("string")).alias("list_name"), "code", "day")
    moves = F.array(
        F.struct(F.lit("add").alias("action"), F.col("day").alias("day")),
        F.struct(F.lit("remove").alias("action"), F.expr("day + 90 + code % 126").alias("day")),
        F.struct(F.expr("if(code % 2 = 1, 'add', 'remove')").alias("action"), F.expr("day + 230").alias("day")),
    )
    return named.select("domain", "list_name", F.explode(moves).alias("m")).select("domain", "list_name", "m.action", "m.day")


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_day", ((F.col("page_id") * 37) % DAYS).cast("int"))
    return urlfilter.evaluate(captures, url_entries(pages))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op10_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = linededup.repeated_runs(table(spark, sf_dir, "documents"))
    return runs.select("doc_id", "line_start", "line_end", F.col("first_key").alias("first_doc_id"), "first_line")


def op11_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (a, s) -> s - a)")  # of start, end, start, end ...: the ends less the starts
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _ = alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return d.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenth document, by hash, the words from one on are replaced by periods of themselves first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    placed = words.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    edited = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, element_at(words, CAST(a + (i - a) % p + 1 AS INT)))), ' ')")
    d = periods.repeated_words(placed.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text")))
    best = F.expr("array_sort(runs, (x, y) -> CAST(CASE WHEN x.length <> y.length THEN sign(y.length - x.length) WHEN x.start <> y.start THEN sign(x.start - y.start) ELSE sign(x.period - y.period) END AS INT))")
    longest = d.withColumn("best", F.get(best, F.lit(0)))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    ops = (op1_shards, op2_language, op3_fingerprints, op4_leaks, op5_quality, op6_packing, op7_url_lists, op8_near_duplicates, op9_secrets, op10_repeated_lines, op11_repeated_strings, op12_alignment, op13_periods)
    return {f.__name__: f for f in ops}
