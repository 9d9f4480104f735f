"""Cohorts, annotation joins and identifier repair."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage_spark.functions import variants as V
from triage_spark.sources.scratch import stored
from triage_spark.sources.tables import with_info


def require_unique(df: DataFrame, key: str, source: str, allow_null: bool = False) -> None:
    """Null or repeated keys are an error that names up to five; one aggregate, five rows to the driver."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1" if allow_null else f"n > 1 OR `{key}` IS NULL").limit(5).collect()
    if bad:
        raise ValueError(f"{source}: null or repeated {key}: {[r[key] for r in bad]}")


INFO_KEYS = ("MC", "ALLELEID", "GENEINFO", "CLNSIG", "CLNREVSTAT")


def build_cohort(vcf: DataFrame, min_review_stars: int = 1) -> DataFrame:
    """Labelled missense SNVs of a parsed VCF; every copy of a repeated key is dropped, none is chosen.

    The wanted keys come from `info_text` in one pass, so the INFO map is never built; a table without it needs `info`.
    """
    snv = vcf.filter(V.is_snv(F.col("filter"), F.col("ref"), F.col("alt")))
    by_text = "info_text" in vcf.columns
    if by_text:
        snv = with_info(snv.select("chrom", "pos", "ref", "alt", "id", "info_text"), INFO_KEYS)
    at = lambda k: F.col(f"info__.{k}") if by_text else F.try_element_at("info", F.lit(k))
    rows = snv.filter(V.is_missense(at("MC")))
    one = lambda k: V.allele_value(at(k), F.lit(0), F.lit(1))
    rows = rows.select(
        V.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant_key"), V.normalize_chrom(F.col("chrom")).alias("chrom"), "pos",
        F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.col("id").alias("variation_id"), at("ALLELEID").alias("allele_id"),
        V.unique_gene(F.coalesce(at("GENEINFO"), F.lit(""))).alias("gene"), V.classify_significance(one("CLNSIG")).alias("label"),
        one("CLNSIG").alias("clinical_significance"), one("CLNREVSTAT").alias("review_status"), V.review_stars(one("CLNREVSTAT")).alias("review_stars"),
    )
    rows = rows.filter(F.col("label").isNotNull() & F.col("gene").isNotNull() & (F.col("review_stars") >= min_review_stars) & F.col("variation_id").rlike(r"^\d+$"))
    return rows.withColumn("n__", F.count("*").over(Window.partitionBy("variant_key"))).filter("n__ = 1").drop("n__")


def choose_transcript(transcripts: Column, genes: Column, mane: Column, canonical: Column, appris: Column, preferred_gene: Column) -> Column:
    """struct<index, reason> over ';' lists: of the preferred gene's transcripts (or all), the first MANE
    Select, else canonical YES, else APPRIS principal, else the first."""
    items = F.split(transcripts, ";")
    last = F.size(items) - 1
    own = F.split(genes, ";")
    value = lambda c, i: F.trim(F.coalesce(F.get(F.split(c, ";"), i), F.get(F.split(c, ";"), F.lit(0))))
    all_of = F.sequence(F.lit(0), last)
    of_gene = F.filter(all_of, lambda i: F.upper(F.trim(F.coalesce(F.get(own, i), F.get(own, F.lit(0))))) == F.upper(preferred_gene))
    pool = F.when(F.size(of_gene) > 0, of_gene).otherwise(all_of)
    rank = lambda i: F.when(value(mane, i) == "Select", 0).when(value(canonical, i) == "YES", 1).when(value(appris, i).startswith("principal"), 2).otherwise(3)
    best = F.array_min(F.transform(pool, lambda i: F.struct(rank(i).alias("rank"), i.alias("index"))))
    names = F.array(F.lit("MANE Select"), F.lit("Ensembl canonical"), F.lit("APPRIS principal"), F.lit("first"))
    return F.struct(best["index"].alias("index"), F.get(names, best["rank"]).alias("reason"))


def join_variant_annotations(variants: DataFrame, source: DataFrame, order: str, genes: str = "genename", on: tuple[str, ...] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """Each variant with its source row: of several, the first by `order` that names its gene, else the first.

    Unmatched variants stay with dbnsfp_match false. The source is summed up first, to a row for each place and a row for
    each place and gene, so a variant meets two rows at most, however many stand at its place.
    """
    extra = [c for c in source.columns if c not in on]
    first = F.min_by(F.struct(*extra), F.struct(F.col(order)))  # in a struct, a null comes first and is not left out
    named = F.transform(F.split(F.upper(genes), ";"), lambda s: F.trim(s))
    any_gene = source.groupBy(*on).agg(first.alias("any__"))
    own_gene = source.withColumn("gene__", F.explode(F.array_distinct(named))).groupBy(*on, "gene__").agg(first.alias("own__"))
    both = variants.withColumn("gene__", F.upper("gene")).join(own_gene, [*on, "gene__"], "left").join(any_gene, list(on), "left").withColumn("s__", F.coalesce("own__", "any__"))
    return both.select(*variants.columns, F.col("any__").isNotNull().alias("dbnsfp_match"), *[F.col(f"s__.{c}").alias(c) for c in extra if c not in variants.columns])


def annotate_records(matched: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Transcript-level values at the chosen transcript, amino-acid scores and the domain status.

    scores: raw column to output name.
    """
    t = choose_transcript(*[F.col(c) for c in ("Ensembl_transcriptid", "genename", "MANE", "Ensembl_canonical", "APPRIS", "gene")])
    d = V.substitution_scores(matched).withColumn("t__", F.when(F.col("dbnsfp_match"), t))
    pick = lambda c: V.pick_aligned(F.col(c), F.col("t__.index"))
    return d.select(
        *[c for c in matched.columns if c.lower() not in {n.lower() for n in (*scores, *scores.values())}], pick("Ensembl_transcriptid").alias("selected_transcript"), F.col("t__.reason").alias("transcript_selection"),
        "grantham_distance", "blosum62_score", F.when(pick("Interpro_domain").isNotNull(), "overlap").otherwise("no_overlap").alias("interpro_domain_status"),
        *[V.parse_number(pick(raw)).alias(name) for raw, name in scores.items()],
    )


def join_annotations(base: DataFrame, frames: list[DataFrame], key: str = "variant_key") -> DataFrame:
    """Left joins 1:1 on the key; repeated keys or common columns are errors; the row count cannot change."""
    if key not in base.columns:
        base = base.withColumn(key, V.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    require_unique(base, key, "base")
    for k, f in enumerate(frames):
        both = (set(base.columns) & set(f.columns)) - {key}
        if both:
            raise ValueError(f"annotation {k} repeats columns {sorted(both)}")
        require_unique(f, key, f"annotation {k}")
        base = base.join(f, key, "left")
    return base


def assemble(variants: DataFrame, scores: DataFrame, genes: DataFrame) -> DataFrame:
    """Variants with variant scores (1:1 on the key), then gene scores (N:1 on the gene). Spark sizes the broadcast."""
    require_unique(variants, "variant_key", "variants")
    require_unique(scores, "variant_key", "scores")
    require_unique(genes, "gene", "genes")
    return variants.join(scores, "variant_key", "left").join(genes, "gene", "left")


CHUNKS = 64


def chunk_keys(df: DataFrame, key: str) -> DataFrame:
    """chunk, rows, keys: how many keys each chunk has, and a sum of their hashes that does not depend on their order."""
    return df.groupBy("chunk").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("keys"))


def resumable_extract(work: DataFrame, extract, path: str, key: str = "variant_key", chunks: int = CHUNKS) -> DataFrame:
    """extract(work) in path, chunk by chunk of the key's hash; returns all of it, a rerun does only what is missing.

    A chunk that is there counts as finished if it holds exactly the keys of the work; any other one is made again
    as a whole, and replaced in one step. Finished keys that are not in the work are an error.
    """
    spark = work.sparkSession
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")
    work = work.withColumn("chunk", chunk)
    left = work
    try:
        done = spark.read.parquet(path)
    except AnalysisException as e:  # nothing written yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        want = {tuple(r) for r in chunk_keys(work, key).collect()}  # a row per chunk
        finished = want & {tuple(r) for r in chunk_keys(done, key).collect()}
        open_chunk = ~F.col("chunk").isin([r[0] for r in finished]) if finished else F.lit(True)
        left = work.filter(open_chunk)
        stray = done.filter(open_chunk).join(left, key, "left_anti").limit(5).collect()  # a finished chunk has none
        if stray:
            raise ValueError(f"finished keys not in the work: {[r[key] for r in stray]}")
    out = extract(left.drop("chunk")).withColumn("chunk", chunk)
    out.repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)  # a file per chunk
    return spark.read.parquet(path).drop("chunk")


def annotation_coverage(df: DataFrame, columns: list[str], match: str | None = None, reason: str | None = None) -> DataFrame:
    """measure, name, present, fraction: each raw column's values, the matched rows, and the rows of each transcript reason."""
    flags = {("column", c): ~V.is_missing(F.col(c).cast("string")) for c in columns} | ({("match", match): F.col(match)} if match else {})
    one = df.agg(F.count("*").alias("n"), *[F.count_if(f).alias(f"m{k}") for k, f in enumerate(flags.values())])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(c).alias("name"), F.col(f"m{k}").alias("present")) for k, (m, c) in enumerate(flags)])
    out = one.select("n", F.inline(rows)).select("measure", "name", "present", F.try_divide("present", "n").alias("fraction"))
    if not reason:
        return out
    total = df.agg(F.count("*").alias("n"))
    by = df.groupBy(reason).agg(F.count("*").alias("present")).join(total, F.lit(True))
    return out.unionByName(by.select(F.lit("reason").alias("measure"), F.col(reason).alias("name"), "present", F.try_divide("present", "n").alias("fraction")))


def repair_identifiers(table: DataFrame, vcf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with variation_id and allele_id from the VCF, one summary row). Nothing else changes.

    Every key must be in the VCF once, name the table's gene, and the old id must be either of the two.
    """
    require_unique(vcf, "variant_key", "VCF")
    new = vcf.select("variant_key", F.col("variation_id").alias("v__"), F.col("allele_id").alias("a__"), F.col("genes").alias("g__"))
    both = stored(table.join(new, "variant_key", "left"))
    bad = F.col("v__").isNull() | ~F.array_contains("g__", F.col("gene")) | ((F.col("variation_id") != F.col("v__")) & (F.col("variation_id") != F.col("a__")))
    wrong = both.filter(bad).limit(5).collect()
    if wrong:
        raise ValueError(f"identifiers that cannot be repaired: {[r['variant_key'] for r in wrong]}")
    fixed = both.withColumn("changed__", F.col("variation_id") != F.col("v__"))
    summary = fixed.agg(F.count("*").alias("rows"), F.count_if("changed__").alias("changed"))
    cols = [F.col("v__").alias(c) if c == "variation_id" else F.col("a__").alias(c) if c == "allele_id" else F.col(c) for c in table.columns]
    return fixed.select(*cols), summary


def complete_one_to_one_join(a: DataFrame, b: DataFrame, key: str = "variant_key") -> DataFrame:
    """Two tables that must hold the same unique keys; one count by key tells, and only a bad one is looked into."""
    sides = a.select(key, F.lit(1).alias("l__"), F.lit(0).alias("r__")).unionByName(b.select(key, F.lit(0).alias("l__"), F.lit(1).alias("r__")))
    if sides.groupBy(key).agg(F.sum("l__").alias("l__"), F.sum("r__").alias("r__")).filter(f"l__ <> 1 OR r__ <> 1 OR `{key}` IS NULL").limit(1).collect():
        require_unique(a, key, "left")
        require_unique(b, key, "right")
        odd = a.select(key, F.lit(1).alias("l__")).join(b.select(key, F.lit(1).alias("r__")), key, "full_outer").filter("l__ IS NULL OR r__ IS NULL").limit(5).collect()
        raise ValueError(f"keys on one side only: {[r[key] for r in odd]}")
    return a.join(b, key)


def key_set_difference(a: DataFrame, b: DataFrame, key: str = "variant_key") -> DataFrame:
    """One row: keys only in a, only in b."""
    both = a.select(key).distinct().withColumn("l__", F.lit(1)).join(b.select(key).distinct().withColumn("r__", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("r__").isNull()).alias("only_left"), F.count_if(F.col("l__").isNull()).alias("only_right"))
