"""Tables, VCF text, annotation text, cached documents, evidence, vectors, reply frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.functions import variants as V
from triage_spark.sources import blocks

SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def suffix_of(path: str) -> str:
    name = path.rstrip("/").lower().removesuffix(".gz")
    return name[name.rfind(".") :] if "." in name.rsplit("/", 1)[-1] else ""


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or TSV (also gz) by suffix; any other suffix is an error. Text columns stay strings without a schema."""
    suffix = suffix_of(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix not in SEPARATORS:
        raise ValueError(f"unsupported table suffix: {path}")
    reader = spark.read.option("header", True).option("sep", SEPARATORS[suffix])
    return (reader.schema(schema) if schema else reader).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    suffix = suffix_of(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if suffix == ".parquet":
        writer.parquet(path)
    elif suffix in SEPARATORS:
        writer.option("header", True).option("sep", SEPARATORS[suffix]).csv(path)
    else:
        raise ValueError(f"unsupported table suffix: {path}")


FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter")


def parse_info(info: Column) -> Column:
    """INFO to a map; flags get 'true'; of a repeated key the last stands. Sorted by key and place, so that no key is compared with all others."""
    parts = F.filter(F.split(info, ";"), lambda p: p != "")
    value = lambda p: F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p))).otherwise("true")
    entries = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), value(p).alias("v"))))
    last = lambda a: F.filter(a, lambda e, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["k"] != e["k"]))
    kept = F.get(F.transform(F.array(entries), last), F.lit(0))  # the array is named by a lambda, and so is made once
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


def with_info(rows: DataFrame, keys: tuple[str, ...], text: str = "info_text", name: str = "info__") -> DataFrame:
    """rows with a struct `name` of the wanted INFO keys' values, from one pass over the text; of a repeated key the last stands,
    and one that is not there, or is empty, is null.

    A generator stands between the steps, since Spark would write the parse out again for each use of a value: first the
    text becomes the few wanted parts, then these become the values.
    """
    wanted = F.array(*[F.lit(k) for k in keys])
    parts = F.filter(F.split(text, ";"), lambda p: F.array_contains(wanted, F.substring_index(p, "=", 1)))
    found = rows.select("*", F.explode(F.array(F.struct(parts.alias("parts")))).alias(f"{name}p"))

    def value(key: str) -> Column:
        own = F.try_element_at(F.filter(F.col(f"{name}p.parts"), lambda p: F.startswith(p, F.lit(f"{key}="))), F.lit(-1))
        return F.nullif(own.substr(F.lit(len(key) + 2), F.length(own)), F.lit(""))

    return found.select("*", F.explode(F.array(F.struct(*[value(k).alias(k) for k in keys]))).alias(name)).drop(f"{name}p")


def parse_vcf(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of VCF text lines; blank and '#' lines are skipped, rows with under 8 fields are rejects.

    INFO comes as the map `info` and as the text `info_text`, from which single keys are read at less cost.
    """
    body = lines.select(F.col(line).alias("line")).filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    split = body.select("line", F.explode(F.array(F.split("line", "\t"))).alias("f"))  # a generator, so that the line is split once for all its fields
    good = split.filter(F.size("f") >= 8)
    cols = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(FIXED)]
    text = F.get("f", F.lit(7))
    rows = good.select(*cols, parse_info(text).alias("info"), text.alias("info_text")).withColumn("pos", F.col("pos").try_cast("int"))
    return rows, split.filter(F.size("f") < 8).select("line")


def read_vcf(spark: SparkSession, path: str, with_rejects: bool = False):
    """Rows of a VCF text. Block-compressed gz, as such files are, splits by its blocks; another gz is one task, whose rows are spread after it.

    A row of under 8 fields is an error when the rows are read, or comes back with the rejects.
    """
    if path.endswith((".gz", ".bgz")) and blocks.is_blocks(path):
        lines = blocks.read_lines(spark, path)
    else:
        lines = spark.read.text(path)
        if path.endswith(".gz"):
            lines = lines.repartition(spark.sparkContext.defaultParallelism)
    rows, rejects = parse_vcf(lines)
    if with_rejects:
        return rows, rejects
    bad = rejects.limit(1).collect()
    if bad:
        raise ValueError(f"VCF row with under 8 fields: {bad[0]['line'][:200]}")
    return rows


def wrong_assembly(lines: DataFrame, line: str = "value") -> DataFrame:
    """Reference header lines that name another assembly; none for a good file."""
    return lines.filter(F.col(line).startswith("##reference=") & F.col(line).rlike("(?i)grch37|hg19|b37"))


def read_dbnsfp(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated strings with a '#' header; every named column must be there; ragged rows fail the read.

    Block-compressed gz splits by its blocks, and only the named columns are built.
    """
    if path.endswith((".gz", ".bgz")) and blocks.is_blocks(path):
        missing = [c for c in columns if c not in blocks.header_of(path)]
        if missing:
            raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
        return blocks.read_columns(spark, path, columns)
    df = spark.read.option("header", True).option("sep", "\t").option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("#") for c in df.columns])
    require_columns(df, columns, path)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def require_columns(df: DataFrame, columns: list[str], source: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks columns: {', '.join(missing)}")


def gene_constraints(table: DataFrame, cohort: DataFrame, order: str, names: tuple[str, str, str] = ("Gene_name", "gnomAD_LOEUF", "gnomAD_MOEUF")) -> DataFrame:
    """gene, gnomad_loeuf, gnomad_moeuf of the cohort's genes: the first row by `order` of each."""
    gene, loeuf, moeuf = names
    rows = table.select(F.col(gene).alias("gene"), V.parse_number(F.col(loeuf).cast("string")).alias("gnomad_loeuf"), V.parse_number(F.col(moeuf).cast("string")).alias("gnomad_moeuf"), F.col(order).alias("o__"))
    wanted = rows.join(cohort.select("gene").distinct(), "gene", "left_semi")
    return wanted.groupBy("gene").agg(F.min_by(F.struct("gnomad_loeuf", "gnomad_moeuf"), "o__").alias("x")).select("gene", "x.gnomad_loeuf", "x.gnomad_moeuf")


def read_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Cached JSON documents of a fixed schema, one per line, or one per file with multi_line; a bad one fails the read."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def read_summaries(spark: SparkSession, path: str, summary: str, multi_line: bool = False) -> DataFrame:
    """variation_id, raw_summary of cached database documents; a null summary means not found, one without a uid is an error."""
    d = read_documents(spark, path, f"variation_id bigint, raw_summary struct<{summary}>", multi_line)
    bad = F.col("raw_summary").isNotNull() & F.col("raw_summary.uid").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no summary of "), F.coalesce(F.col("variation_id").cast("string"), F.lit("?"))))).otherwise(F.col("variation_id"))
    return d.select(checked.alias("variation_id"), "raw_summary")


# The four kinds of cached literature documents, by folder.
LITERATURE = {
    "links": "variation_id bigint, pmids array<string>",
    "articles": "pmid string, raw struct<title: string, fulljournalname: string, source: string, pubdate: string, authors: array<struct<name: string>>, articleids: array<struct<idtype: string, value: string>>>",
    "abstracts": "pmid string, content struct<abstract: string, mesh_terms: array<string>, keywords: array<string>>",
    "searches": "query string, count int, pmids array<string>",
}


def read_literature(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """Links, articles, abstracts and searches, each from its own folder; null payloads mean not found."""
    return {kind: read_documents(spark, f"{folder}/{kind}", schema, multi_line) for kind, schema in LITERATURE.items()}


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line or an empty input is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not df.limit(1).collect():
        raise ValueError(f"no evidence records in {path}")
    return df


def write_evidence(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parse_pubmed_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """pmid, abstract (labelled sections, one per line), mesh_terms, keywords of each article's XML.

    Inner tags of an abstract are dropped and their text kept in place; terms are distinct, in order.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    x = F.col(xml)
    section = F.regexp_extract_all(x, F.lit("(?s)<AbstractText[^>]*>.*?</AbstractText>"), F.lit(0))
    label = lambda s: F.regexp_extract(s, r'^<AbstractText[^>]*\bLabel="([^"]*)"', 1)
    texts = F.filter(F.transform(section, lambda s: F.when(label(s) != "", F.concat(label(s), F.lit(": "), clean(s))).otherwise(clean(s))), lambda t: t != "")
    terms = lambda tag: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(f"(?s)<{tag}[^>]*>.*?</{tag}>"), F.lit(0)), clean))
    return df.withColumn("pmid", F.regexp_extract(x, r"<PMID[^>]*>\s*(\d+)", 1)).withColumn("abstract", F.array_join(texts, "\n")).withColumn("mesh_terms", terms("DescriptorName")).withColumn("keywords", terms("Keyword"))


LINKS = "linksets array<struct<ids: array<string>, linksetdbs: array<struct<dbto: string, links: array<string>>>>>"
SEARCH = "esearchresult struct<count: string, idlist: array<string>, querytranslation: string>"


def flatten_links(df: DataFrame, payload: str = "payload") -> DataFrame:
    """variation_id, pmid, position: distinct links to pubmed in order; a link set must have one id."""
    sets = df.select(F.explode(F.from_json(payload, LINKS)["linksets"]).alias("s"))
    one = F.when(F.size("s.ids") == 1, F.col("s.ids")[0]).otherwise(F.raise_error(F.lit("a link set must have one id")))
    pmids = F.array_distinct(F.flatten(F.transform(F.filter("s.linksetdbs", lambda d: d["dbto"] == "pubmed"), lambda d: d["links"])))
    return sets.select(one.alias("variation_id"), F.posexplode(pmids).alias("position", "pmid"))


def flatten_search(df: DataFrame, payload: str = "payload") -> DataFrame:
    r = F.from_json(payload, SEARCH)["esearchresult"]
    ids = F.array_distinct(F.coalesce(r["idlist"], F.array().cast("array<string>")))
    return df.withColumn("count", F.coalesce(r["count"].try_cast("int"), F.size(ids))).withColumn("pmids", ids).withColumn("query_translation", r["querytranslation"])


def signed(hex_text: Column, bits: int) -> Column:
    n = F.conv(hex_text, 16, 10).cast("bigint")
    return F.when(n >= 1 << (bits - 1), n - (1 << bits)).otherwise(n)


def decode_vectors(df: DataFrame, line: str = "value", width: int = 16) -> DataFrame:
    """features array<int>, score int from lines of 2 * width + 8 hex digits; other lines are an error."""
    c = F.trim(F.col(line))
    good = F.when(c.rlike(f"^[0-9A-Fa-f]{{{2 * width + 8}}}$"), c).otherwise(F.raise_error(F.concat(F.lit("bad vector line: "), c)))
    d = df.withColumn("hex__", good)
    features = F.array(*[signed(F.substring("hex__", 2 * i + 1, 2), 8).cast("int") for i in range(width)])
    return d.withColumn("features", features).withColumn("score", signed(F.substring("hex__", 2 * width + 1, 8), 32).cast("int")).drop("hex__")


def encode_vectors(df: DataFrame, features: str = "features", score: str = "score") -> Column:
    byte = lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(F.array_join(F.transform(features, byte), ""), F.lpad(F.hex(F.col(score).cast("bigint").bitwiseAND(F.lit(4294967295))), 8, "0"))


def decode_reply_frames(df: DataFrame, threshold: int, frame: str = "frame") -> DataFrame:
    """Typed replies of 12-byte frames: version 1, type 2, sequence (4 bytes), score (4), classification, deep flag.

    Adds version, sequence, score, classification, deep_review, reject_reason (null: good) and flag_mismatch.
    Big-endian; a frame of another length, version or type, or with a flag that is not 0 or 1, is rejected.
    """
    num = lambda at, n: F.conv(F.hex(F.substring(frame, at, n)), 16, 10).cast("bigint")
    d = df.withColumn("version", num(1, 1)).withColumn("kind", num(2, 1)).withColumn("sequence", num(3, 4)).withColumn("score", signed(F.hex(F.substring(frame, 7, 4)), 32).cast("int"))
    d = d.withColumn("classification", num(11, 1).cast("int")).withColumn("deep_review", num(12, 1).cast("int"))
    reason = (
        F.when(F.octet_length(frame) != 12, "length").when(F.col("version") != 1, "version").when(F.col("kind") != 2, "type")
        .when(~F.col("classification").isin(0, 1) | ~F.col("deep_review").isin(0, 1), "flag")
    )
    wrong = (F.col("classification") != (F.col("score") >= 0).cast("int")) | (F.col("deep_review") != (F.col("score") >= threshold).cast("int"))
    return d.withColumn("reject_reason", reason).withColumn("flag_mismatch", F.when(reason.isNull(), wrong)).drop("kind")


MOST_SCORES = 32  # of one batch frame


def decode_batch_frames(df: DataFrame, threshold: int, frame: str = "frame") -> DataFrame:
    """Batch replies, one row per score: version 1, type 2, sequence (4 bytes), count (1 to 32), a zero byte, then
    count times score (4 bytes), classification and deep flag. Bytes after them are padding.

    Adds sequence, place, score, classification, deep_review, reject_reason. A malformed frame gives one row with
    its reason (length, version, type, count) and nulls; one with any flag that its score denies is rejected whole (flag).
    """
    num = lambda at, n: F.conv(F.hex(F.substring(F.col(frame), F.lit(at), F.lit(n))), 16, 10).cast("bigint")
    field = lambda i, at, n: F.hex(F.substring(F.col(frame), (i * 6 + at).cast("int"), F.lit(n)))
    flag = lambda i, at: F.conv(field(i, at, 1), 16, 10).cast("int")
    d = df.withColumn("sequence", num(3, 4)).withColumn("count__", num(7, 1))
    reason = (
        F.when(F.octet_length(frame) < 8, "length").when(num(1, 1) != 1, "version").when(num(2, 1) != 2, "type")
        .when(~F.col("count__").between(1, MOST_SCORES) | (num(8, 1) != 0), "count").when(F.octet_length(frame) < 8 + 6 * F.col("count__"), "length")
    )
    item = lambda i: F.struct(i.alias("place"), signed(field(i, 9, 4), 32).cast("int").alias("score"), flag(i, 13).alias("classification"), flag(i, 14).alias("deep_review"))
    items = F.transform(F.sequence(F.lit(0), (F.col("count__") - 1).cast("int")), item)
    none = F.array(F.lit(None).cast("struct<place:int,score:int,classification:int,deep_review:int>"))
    d = d.withColumn("reason__", reason).withColumn("items__", F.when(F.col("reason__").isNull(), items).otherwise(none))
    wrong = lambda x: (x["classification"] != (x["score"] >= 0).cast("int")) | (x["deep_review"] != (x["score"] >= threshold).cast("int"))
    d = d.withColumn("reject_reason", F.coalesce("reason__", F.when(F.exists("items__", wrong), "flag")))
    # explode() would be given a filter on the array's size, pushed down with the whole parse written out for each use of it; the array is never empty
    return d.withColumn("item__", F.explode_outer("items__")).select(*df.columns, "sequence", "item__.*", "reject_reason")


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """One row: name, rows, hash_xor, hash_sum; the same for the same rows in any order.

    A row's hash is the first 60 bits of the md5 of its columns as text, in the order of their names, which other
    engines can make too.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"))


def write_manifest(tables: dict[str, DataFrame], run: str, path: str) -> None:
    """Append the fingerprints of a run's tables to the manifest at path."""
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for name, df in tables.items():
        one = table_fingerprint(df, name)
        rows = one if rows is None else rows.unionByName(one)
    rows.withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(path)
    spark.catalog.refreshByPath(path)


def check_manifest(tables: dict[str, DataFrame], run: str, path: str) -> None:
    """An error unless the tables are what the run of that name wrote down."""
    spark = next(iter(tables.values())).sparkSession
    now = None
    for name, df in tables.items():
        one = table_fingerprint(df, name)
        now = one if now is None else now.unionByName(one)
    odd = [r["name"] for r in changed_tables(spark.read.parquet(path).filter(F.col("run") == run), now).collect()]
    if odd:
        raise ValueError(f"tables that are not those of run {run}: {sorted(odd)}")


def changed_tables(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Names whose fingerprints differ, or that are gone, between a stored manifest and one made now."""
    a, b = manifest.alias("a"), now.alias("b")
    same = (F.col("a.rows") == F.col("b.rows")) & (F.col("a.hash_xor") == F.col("b.hash_xor")) & (F.col("a.hash_sum") == F.col("b.hash_sum"))
    return a.join(b, F.col("a.name") == F.col("b.name"), "full_outer").filter(~F.coalesce(same, F.lit(False))).select(F.coalesce("a.name", "b.name").alias("name"))
