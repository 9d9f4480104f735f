"""Database and literature evidence: documents to structs, identifiers, search plans, relevance, reconciliation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage_spark.functions import variants as V

# Terms that mark variant, functional and clinical context.
VARIANT_TERMS = ("variant", "mutation", "missense", "substitution", "genotype", "allele")
FUNCTIONAL_TERMS = ("functional", "assay", "activity", "expression", "splicing", "reporter", "electrophysiology", "transactivation", "rescue")
CLINICAL_TERMS = ("patient", "cohort", "case", "control", "family", "segregation", "phenotype")
RSID = r"(?i)\brs\d+\b"
HGVS = r"(?i)(?:[A-Z]{1,8}_\d+(?:\.\d+)?:)?\b[cgmnpr]\.[A-Za-z0-9_*?+>\-=\[\]()]+"
NO_STRINGS = "array<string>"


def none_of(kind: str = NO_STRINGS) -> Column:
    return F.array().cast(kind)


def unique(c: Column) -> Column:
    """Trimmed, non-empty, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, none_of()), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))


def normalize_clinvar(docs: DataFrame) -> DataFrame:
    """variation_id and `evidence`: the raw summary as a struct; no summary gives status not_found.

    A source uid that differs from the requested id is an error.
    """
    r = F.col("raw_summary")
    uid = r["uid"].try_cast("bigint")
    checked = F.when(uid.isNull() | (uid == F.col("variation_id")), uid).otherwise(F.raise_error(F.lit("source UID does not match the requested id")).cast("bigint"))
    sets, germline = r["variation_set"], r["germline_classification"]
    xref = lambda x: F.struct(F.coalesce(x["db_source"], F.lit("")).alias("database"), F.coalesce(x["db_id"], F.lit("")).alias("identifier"))
    nn = lambda c, n: F.coalesce(F.size(c), F.lit(0)).alias(n)
    found = F.struct(
        F.lit("found").alias("status"), F.col("variation_id"), checked.alias("source_variation_id"), r["accession"].alias("accession"), r["title"].alias("title"),
        F.struct(germline["description"].alias("description"), germline["review_status"].alias("review_status"), F.transform(germline["trait_set"], lambda t: F.coalesce(t["trait_name"], F.lit(""))).alias("traits")).alias("germline_classification"),
        F.transform(r["genes"], lambda g: g["symbol"]).alias("genes"), r["molecular_consequence_list"].alias("molecular_consequences"), r["protein_change"].alias("protein_change"),
        unique(F.transform(sets, lambda s: s["canonical_spdi"])).alias("canonical_spdi"),
        F.flatten(F.transform(sets, lambda s: F.transform(s["variation_xrefs"], xref))).alias("database_cross_references"),
        nn(r["supporting_submissions"]["scv"], "scv"), nn(r["supporting_submissions"]["rcv"], "rcv"),
    )
    missing = F.struct(F.lit("not_found").alias("status"), F.col("variation_id"))
    return docs.select("variation_id", F.when(r.isNotNull(), found).otherwise(F.from_json(F.to_json(missing), docs.select(found.alias("x")).schema["x"].dataType)).alias("evidence"))


def normalize_article(docs: DataFrame) -> DataFrame:
    """pmid and `article`: DOI and PMC id by id type, named authors, journal with its fallback."""
    r = F.col("raw")
    by_type = lambda t: F.nullif(F.get(F.filter(r["articleids"], lambda a: a["idtype"] == t), F.lit(0))["value"], F.lit(""))
    named = F.filter(F.transform(r["authors"], lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    journal = F.coalesce(F.nullif(r["fulljournalname"], F.lit("")), r["source"])
    return docs.select(
        "pmid", F.when(r.isNull(), "not_found").otherwise("found").alias("status"), r["title"].alias("title"), F.coalesce(named, none_of()).alias("authors"), journal.alias("journal"),
        r["pubdate"].alias("publication_date"), by_type("doi").alias("doi"), by_type("pmc").alias("pmc_id"),
    )


def collect_clinvar(requests: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request rows with their evidence and status, one summary row). Ids are looked up once each."""
    rows = requests.join(evidence, requests["clinvar_variation_id"] == evidence["variation_id"], "left").drop("variation_id")
    rows = rows.withColumn("status", F.coalesce(F.col("evidence.status"), F.lit("not_found")))
    return rows, rows.agg(F.count("*").alias("variants"), F.count_if(F.col("status") == "found").alias("found"), F.count_if(F.col("status") != "found").alias("not_found"), F.countDistinct("clinvar_variation_id").alias("unique_ids"))


def collect_linked_literature(variants: DataFrame, links: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants with `articles` in link order and a status, one summary row)."""
    every = links.select("variation_id", F.posexplode(F.array_distinct("pmids")).alias("position", "pmid"))
    both = every.join(articles, "pmid", "left")
    fields = [c for c in articles.columns if c != "pmid"]
    lists = both.groupBy("variation_id").agg(F.sort_array(F.collect_list(F.struct("position", "pmid", *fields))).alias("articles"))
    rows = variants.join(lists, variants["clinvar_variation_id"] == lists["variation_id"], "left").drop("variation_id")
    rows = rows.withColumn("status", F.when(F.size("articles") > 0, "found").otherwise("no_linked_articles"))
    per = variants.join(every, variants["clinvar_variation_id"] == every["variation_id"])
    counts = per.agg(F.countDistinct("pmid").alias("unique_articles"), F.count("*").alias("article_instances"))
    return rows, counts


def extract_identifiers(df: DataFrame) -> DataFrame:
    """Adds rsids, hgvs, protein_changes, canonical_spdi, traits (ordered, distinct) and coordinates.

    Reads variant_key, gene, title, xrefs (array<struct<database, identifier>>), protein_change, spdi, trait_names.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    own = F.filter(F.coalesce(F.col("xrefs"), none_of("array<struct<database:string,identifier:string>>")), lambda x: F.lower(x["database"]).isin("dbsnp", "snp"))
    found = F.flatten(F.transform(own, lambda x: F.regexp_extract_all(x["identifier"], F.lit(RSID), F.lit(0))))
    rsids = F.concat(found, F.regexp_extract_all(title, F.lit(RSID), F.lit(0)))
    hgvs = F.transform(F.regexp_extract_all(title, F.lit(HGVS), F.lit(0)), lambda h: F.regexp_replace(h, r"[.,;:)]+$", ""))
    key = F.split("variant_key", ":")
    coordinates = F.when(F.col("variant_key").rlike(r"(?i)^(?:chr)?[0-9XYMT]+:\d+:[ACGT]+:[ACGT]+$"), F.struct(key[0].alias("chrom"), key[1].try_cast("int").alias("pos"), key[2].alias("ref"), key[3].alias("alt")))
    return df.withColumns({
        "rsids": unique(F.transform(rsids, F.lower)), "hgvs": unique(hgvs), "protein_changes": unique(F.split(F.coalesce("protein_change", F.lit("")), r"[,;|]")),
        "canonical_spdi": unique(F.col("spdi")), "traits": unique(F.col("trait_names")), "coordinates": coordinates,
    })


def pubmed_term(c: Column) -> Column:
    return F.concat(F.lit('"'), F.trim(F.replace(c, F.lit('"'), F.lit(" "))), F.lit('"[Title/Abstract]'))


def exact_candidate(candidate, strategy: str, query, identifier: Column) -> Column:
    return candidate(strategy, query(identifier), identifier, "exact_variant_identifier")


def build_search_plans(ids: DataFrame, max_queries: int = 4, context: bool = True, key: str = "variant_key") -> DataFrame:
    """key, place, strategy, query, identifier, specificity: exact identifiers first, then one context query.

    A query that an earlier candidate of the variant has already is dropped; the first max_queries stay.
    """
    gene = F.when(F.trim("gene") != "", pubmed_term(F.col("gene")))
    candidate = lambda s, q, i, kind: F.struct(F.lit(s).alias("strategy"), q.alias("query"), i.alias("identifier"), F.lit(kind).alias("specificity"))
    parts = []
    for strategy, column in (("rsid_exact", "rsids"), ("hgvs_exact", "hgvs"), ("protein_change_exact", "protein_changes"), ("spdi_exact", "canonical_spdi")):
        alone = strategy in ("rsid_exact", "spdi_exact")
        query = (lambda i: pubmed_term(i)) if alone else (lambda i: F.concat_ws(" AND ", pubmed_term(i), gene))
        make = partial(exact_candidate, candidate, strategy, query)
        parts.append(F.transform(F.coalesce(F.col(column), none_of()), lambda i: make(i)))
    if context:
        tail = F.lit("(variant[Title/Abstract] OR mutation[Title/Abstract])")
        trait = F.get("traits", F.lit(0))
        with_trait = candidate("gene_trait_context", F.concat_ws(" AND ", gene, pubmed_term(trait), tail), trait, "contextual")
        alone = candidate("gene_variant_context", F.concat_ws(" AND ", gene, tail), F.lit(None).cast("string"), "contextual")
        parts.append(F.when(gene.isNotNull(), F.array(F.when(F.size(F.coalesce("traits", none_of())) > 0, with_trait).otherwise(alone))).otherwise(F.array().cast("array<struct<strategy:string,query:string,identifier:string,specificity:string>>")))
    plans = F.concat(*parts)
    first = F.filter(plans, lambda x, i: ~F.exists(F.slice(plans, 1, i), lambda y: y["query"] == x["query"]))
    return ids.select(key, F.posexplode(F.slice(first, 1, max_queries)).alias("place", "plan")).select(key, "place", "plan.*")


def identifier_audit(ids: DataFrame, plans: DataFrame, key: str = "variant_key") -> tuple[DataFrame, DataFrame]:
    """(per variant: its numbers of identifiers and plans, measure and name and rows: variants with each kind of identifier, plans per strategy)."""
    kinds = ("rsids", "hgvs", "protein_changes", "canonical_spdi", "traits")
    planned = plans.groupBy(key).agg(F.count("*").alias("plans"))
    per = ids.select(key, *[F.coalesce(F.size(k), F.lit(0)).alias(k) for k in kinds]).join(planned, key, "left").withColumn("plans", F.coalesce("plans", F.lit(0)))
    counts = per.agg(F.count("*").alias("variants"), *[F.count_if(F.col(k) > 0).alias(k) for k in kinds]).unpivot([], ["variants", *kinds], "name", "rows")
    strategies = plans.groupBy(F.col("strategy").alias("name")).agg(F.count("*").alias("rows"))
    return per, counts.withColumn("measure", F.lit("identifier")).unionByName(strategies.withColumn("measure", F.lit("strategy")))


def contains_gene(text: Column, gene: Column) -> Column:
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), gene, F.lit(r"\E(?![A-Za-z0-9])"))
    return F.coalesce((F.trim(gene) != "") & F.regexp_like(text, quoted), F.lit(False))


def retrieval_relevance(df: DataFrame) -> DataFrame:
    """Adds relevance_score and tier of an article for a variant.

    Reads title, abstract, keywords, mesh_terms and the variant's gene, rsids, hgvs, protein_changes,
    canonical_spdi, traits. Text is lower-cased once.
    """
    d = df.withColumn("text__", F.lower(F.concat_ws("\n", "title", "abstract", F.array_join("keywords", " "), F.array_join("mesh_terms", " "))))
    held = lambda c: F.filter(F.coalesce(F.col(c), none_of()), lambda v: (F.trim(v) != "") & F.contains(F.col("text__"), F.lower(v)))
    terms = lambda ts: sum((F.contains(F.col("text__"), F.lit(t)).cast("int") for t in ts), F.lit(0))
    d = d.withColumns({"gene_match__": contains_gene(F.col("text__"), F.col("gene")), "sure__": F.array_distinct(F.concat(held("rsids"), held("canonical_spdi"))), "leaning__": F.array_distinct(F.concat(held("hgvs"), held("protein_changes"))), "traits__": F.size(F.array_distinct(held("traits"))), "context__": terms(VARIANT_TERMS)})
    d = d.withColumn("exact__", F.size(F.when(F.col("gene_match__"), F.array_union("sure__", "leaning__")).otherwise(F.col("sure__"))))
    unsupported = F.when(F.col("gene_match__"), 0).otherwise(F.size("leaning__"))
    score = F.when(F.col("exact__") > 0, 100).otherwise(0) + 10 * F.col("exact__") + 5 * unsupported + 20 * F.col("gene_match__").cast("int") + 5 * F.col("traits__") + 3 * F.col("context__") + 2 * terms(FUNCTIONAL_TERMS) + terms(CLINICAL_TERMS)
    tier = (
        F.when(F.col("exact__") > 0, "exact_variant").when(F.col("gene_match__") & (F.col("context__") > 0), "gene_variant_context")
        .when(F.col("gene_match__") & (F.col("traits__") > 0), "gene_trait_context").when(F.col("gene_match__"), "gene_only").otherwise("unverified_search_hit")
    )
    return d.withColumns({"relevance_score": score.cast("int"), "tier": tier}).drop("text__", "gene_match__", "sure__", "leaning__", "traits__", "context__", "exact__")


def assemble_direct_search(plans: DataFrame, hits: DataFrame, identifiers: DataFrame, articles: DataFrame, links: DataFrame, key: str = "variant_key") -> DataFrame:
    """key, pmid, strategies (first seen first), membership, relevance_score, tier, place (relevance desc, pmid asc).

    hits: query, pmids. links: key, pmid of linked articles.
    """
    found = plans.join(hits.select("query", F.posexplode(F.array_distinct("pmids")).alias("at", "pmid")), "query")
    per = found.groupBy(key, "pmid").agg(F.sort_array(F.collect_list(F.struct("place", "at", "strategy"))).alias("s")).withColumn("strategies", F.array_distinct(F.col("s.strategy"))).drop("s")
    rows = per.join(articles, "pmid", "left").join(identifiers, key)
    rows = retrieval_relevance(rows).join(links.select(key, "pmid", F.lit(True).alias("linked__")).distinct(), [key, "pmid"], "left")
    w = Window.partitionBy(key).orderBy(F.desc("relevance_score"), F.col("pmid").cast("bigint"))
    return rows.select(key, "pmid", "strategies", F.when(F.col("linked__"), "both").otherwise("direct_search").alias("membership"), "relevance_score", "tier", F.row_number().over(w).alias("place"))


def linked_pmid_overlap(linked: DataFrame, direct: DataFrame, key: str = "variant_key") -> DataFrame:
    """key, overlap, direct_only: of each variant's directly found articles, those linked already and those new."""
    flags = direct.select(key, "pmid").distinct().join(linked.select(key, "pmid", F.lit(1).alias("l__")).distinct(), [key, "pmid"], "left")
    return flags.groupBy(key).agg(F.count("l__").alias("overlap"), F.count_if(F.col("l__").isNull()).alias("direct_only"))


def direct_search_summary(variants: DataFrame, plans: DataFrame, direct: DataFrame, key: str = "variant_key") -> tuple[DataFrame, DataFrame]:
    """(one row of totals, article instances per tier). A variant with a plan is searchable."""
    n = direct.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("membership") == "both").alias("b"))
    has = variants.select(key).distinct().join(n, key, "left").join(plans.select(key, F.lit(1).alias("s__")).distinct(), key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = has.agg(
        F.count("*").alias("variants"), F.count("s__").alias("searchable"), F.count("n").alias("with_articles"), F.count_if(F.col("n").isNull()).alias("without_articles"),
        total("n").alias("instances"), total("b").alias("overlap"), (total("n") - total("b")).alias("direct_only"),
    )
    unique = direct.agg(F.countDistinct("pmid").alias("unique_articles"))
    return one.join(unique, F.lit(True)), direct.groupBy("tier").agg(F.count("*").alias("articles"))


SUBJECT = ("gene", "score", "route", "prediction", "clinvar_variation_id")


def reconcile(clinvar: DataFrame, pubmed: DataFrame, direct: DataFrame | None = None, key: str = "variant_key") -> DataFrame:
    """One row per variant of providers with equal key sets; fields that disagree and gaps become `issues`.

    clinvar: key, subject fields, status, classification. pubmed and direct: key, subject fields, n_articles.
    """
    parts = {"pubmed": pubmed} | ({"direct": direct} if direct is not None else {})
    out = clinvar
    for name, df in parts.items():
        odd = clinvar.select(key, F.lit(1).alias("l__")).join(df.select(key, F.lit(1).alias("r__")), key, "full_outer").filter("l__ IS NULL OR r__ IS NULL").limit(5).collect()
        if odd:
            raise ValueError(f"key sets differ: {[r[key] for r in odd]}")
        out = out.join(df.select(key, *[F.col(c).alias(f"{c}_{name}") for c in (*SUBJECT, "n_articles")]), key)
    checks = [(f"{c}_mismatch_{n}", ~F.col(c).eqNullSafe(F.col(f"{c}_{n}"))) for n in parts for c in SUBJECT]
    checks += [
        ("clinvar_record_not_found", F.col("status") != "found"), ("clinvar_germline_classification_missing", (F.col("status") == "found") & (F.coalesce(F.trim("classification"), F.lit("")) == "")),
        ("no_clinvar_linked_pubmed_articles", F.col("n_articles_pubmed") == 0), *([("no_direct_pubmed_articles", F.col("n_articles_direct") == 0)] if direct is not None else []),
    ]
    issues = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda i: i.isNotNull())
    return out.withColumn("issues", issues).select(key, *SUBJECT, "status", "classification", *[f"n_articles_{n}" for n in parts], "issues")


def reconcile_summary(records: DataFrame) -> DataFrame:
    return records.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("variants"))


def reconcile_counts(records: DataFrame) -> DataFrame:
    """One row: records, those without any issue, those whose subjects agree, and for each subject field the records that disagree."""
    held = lambda prefix: F.exists("issues", lambda i: i.startswith(prefix))
    differs = [held(f"{c}_mismatch_") for c in SUBJECT]
    return records.agg(
        F.count("*").alias("records"), F.count_if(F.size("issues") == 0).alias("without_issues"), F.count_if(~F.exists("issues", lambda i: i.contains("_mismatch_"))).alias("verified"),
        *[F.count_if(d).alias(f"{c}_mismatches") for c, d in zip(SUBJECT, differs)],
    )


def variant_report(records: DataFrame) -> DataFrame:
    """Adds group (of the classification), comparison (with the prediction) and warnings."""
    group = V.significance_group(F.col("classification"))
    warnings = F.filter(F.array(F.when(F.col("status") != "found", "no database record"), F.when(group == "conflicting", "conflicting classifications"), F.when(group == "missing", "no classification")), lambda w: w.isNotNull())
    return records.withColumns({"significance": group, "comparison": V.comparison_group(F.col("prediction"), group), "warnings": warnings})


def aggregate_reports(reports: DataFrame) -> DataFrame:
    """dimension, value, variants: counts by status, route, significance, comparison and review status in one pass of
    grouping sets, and two rows of dimension `total`: variants and genes."""
    dims = ("status", "route", "significance", "comparison", "review_status")
    rows = reports.withColumn("review_status", F.coalesce(F.nullif("review_status", F.lit("")), F.lit("missing")))
    sets = rows.select(*dims).groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("variants"), F.grouping_id(*dims).alias("g"))
    mask = lambda k: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - k))
    dimension = F.coalesce(*[F.when(F.col("g") == mask(k), F.lit(d)) for k, d in enumerate(dims)])
    value = F.coalesce(*[F.when(F.col("g") == mask(k), F.col(d)) for k, d in enumerate(dims)])
    totals = reports.agg(F.count("*").alias("variants"), F.countDistinct(F.nullif("gene", F.lit(""))).alias("genes")).unpivot([], ["variants", "genes"], "value", "n")
    return sets.select(dimension.alias("dimension"), value.alias("value"), "variants").unionByName(totals.select(F.lit("total").alias("dimension"), "value", F.col("n").alias("variants")))


def report_preview(reports: DataFrame, n: int = 20, key: str = "variant_key") -> DataFrame:
    return reports.select(key, "gene", "score", "route", "status", "significance", "comparison").orderBy(F.desc("score"), key).limit(n)
