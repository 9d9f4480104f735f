"""Queries of groups A to E: sources, scalar rules, cohorts, splits, features, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.functions import variants as V
from triage_spark.operators import cohort, features
from triage_spark.plans.views import Views, query
from triage_spark.sources import tables
from triage_spark.sources.scratch import new_folder, stored

R6 = lambda c: F.round(c, 6)


# ---- A: sources and sinks ----


@query("a01_read_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def read_table(v: Views) -> DataFrame:
    return tables.read_table(v.spark, f"{v.sf_dir}/supplier.parquet")


@query("a02_write_table", "SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def write_table(v: Views) -> DataFrame:
    path = f"{scratch(v)}/a02.tsv"
    tables.write_table(v.customer, path)
    back = tables.read_table(v.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def scratch(v: Views) -> str:
    """A new folder, shared by driver and executors, for what a query writes and reads again."""
    return new_folder(v.spark, "query")


def vcf_lines(v: Views) -> DataFrame:
    """VCF text made from every variant row."""
    info = F.concat(
        F.lit("CLNSIG="), F.when(F.col("label") == 1, "Pathogenic").when(F.col("l_partkey") % 5 == 0, "Uncertain_significance").otherwise("Likely_benign"),
        F.lit(";CLNREVSTAT="), F.when(F.col("l_suppkey") % 3 == 0, "criteria_provided,_multiple_submitters,_no_conflicts").when(F.col("l_suppkey") % 3 == 1, "criteria_provided,_single_submitter").otherwise("no_assertion_criteria_provided"),
        F.lit(";GENEINFO="), F.col("gene"), F.lit(":1"), F.lit(";MC=SO:0001583|missense_variant;ALLELEID="), F.col("l_orderkey").cast("string"),
    )
    return v.variants.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom")), F.col("pos").cast("string"), F.col("l_suppkey").cast("string"), "ref", "alt", F.lit("."), F.when(F.col("l_linenumber") == 7, "q10").otherwise("PASS"), info).alias("value"))


@query("a03_read_vcf", "SELECT chrom, pos, ref, alt, CAST(l_suppkey AS STRING) AS id, CASE WHEN l_linenumber = 7 THEN 'q10' ELSE 'PASS' END AS filter, gene || ':1' AS geneinfo FROM {variants}")
def read_vcf(v: Views) -> DataFrame:
    path = scratch(v) + "/vcf"
    vcf_lines(v).write.text(path)
    rows = tables.read_vcf(v.spark, path)
    return rows.select(V.normalize_chrom(F.col("chrom")).alias("chrom"), "pos", "ref", "alt", "id", "filter", F.try_element_at("info", F.lit("GENEINFO")).alias("geneinfo"))


@query("a04_wrong_assembly", "SELECT '##reference=' || n_name || CASE WHEN n_nationkey % 5 = 0 THEN ' GRCh37' ELSE ' GRCh38' END AS value FROM nation WHERE n_nationkey % 5 = 0")
def wrong_assembly(v: Views) -> DataFrame:
    lines = v.nation.select(F.concat(F.lit("##reference="), "n_name", F.when(F.col("n_nationkey") % 5 == 0, " GRCh37").otherwise(" GRCh38")).alias("value"))
    return tables.wrong_assembly(lines)


def dbnsfp_rows(v: Views) -> DataFrame:
    """Packed transcript rows of every part, all strings."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    return v.part.select(
        k.alias("place"), text(k % 24 + 1).alias("chr"), text(k).alias("pos(1-based)"), F.concat(F.lit("ENST_A"), text(k), F.lit(";ENST_B"), text(k)).alias("Ensembl_transcriptid"),
        F.concat(F.lit("GENE"), text(k % 97), F.lit(";GENE"), text((k + 1) % 97)).alias("genename"), F.when(k % 3 == 0, ".;Select").otherwise(".;.").alias("MANE"), F.when(k % 3 == 1, "YES;.").otherwise(".;.").alias("Ensembl_canonical"),
        F.when(k % 2 == 0, ".;principal_1").otherwise(".;.").alias("APPRIS"), F.substring(F.lit("ARNDCQEGHILKMFPSTWYV"), (k % 20 + 1).cast("int"), F.lit(1)).alias("aaref"), F.substring(F.lit("ARNDCQEGHILKMFPSTWYV"), ((k + 7) % 20 + 1).cast("int"), F.lit(1)).alias("aaalt"),
        F.when(k % 4 == 0, ".;domain").otherwise(".;.").alias("Interpro_domain"), F.concat(text(F.col("p_size")), F.lit(";"), F.when(k % 7 == 0, ".").otherwise(text(F.col("p_size") + 1))).alias("REVEL_score"), F.concat(F.lit("GENE"), text((k + F.col("p_size") % 2) % 97)).alias("gene"),
    )


@query("a05_read_dbnsfp", "SELECT CAST(p_partkey % 24 + 1 AS STRING) AS chr, 'GENE' || CAST(p_partkey % 97 AS STRING) || ';GENE' || CAST((p_partkey + 1) % 97 AS STRING) AS genename FROM part")
def read_dbnsfp(v: Views) -> DataFrame:
    path = scratch(v) + "/dbnsfp"
    rows = dbnsfp_rows(v).drop("place", "gene")
    rows.toDF(*["#chr" if c == "chr" else c for c in rows.columns]).write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_dbnsfp(v.spark, path, ["chr", "genename"])


@query("a06_gene_constraints", """
    SELECT gene, arg_min(loeuf, l_orderkey * 10 + l_linenumber) AS gnomad_loeuf, arg_min(moeuf, l_orderkey * 10 + l_linenumber) AS gnomad_moeuf
    FROM (SELECT 'GENE' || CAST(l_partkey % 120 AS STRING) AS gene, CAST(l_quantity AS DOUBLE) AS loeuf, l_tax AS moeuf, l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey * 10 + l_linenumber IN
      (SELECT l_orderkey * 10 + l_linenumber FROM {lineitem} GROUP BY 1 HAVING count(*) = 1)) t
    WHERE gene IN (SELECT gene FROM {variants}) GROUP BY gene""")
def gene_constraints(v: Views) -> DataFrame:
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    once = v.lineitem.withColumn("place", place).groupBy("place").agg(F.count("*").alias("n"), F.first("l_partkey").alias("p"), F.first("l_quantity").alias("q"), F.first("l_tax").alias("t")).filter("n = 1")
    t = once.select("place", F.concat(F.lit("GENE"), (F.col("p") % 120).cast("string")).alias("Gene_name"), F.col("q").cast("string").alias("gnomAD_LOEUF"), F.col("t").cast("string").alias("gnomAD_MOEUF"))
    return tables.gene_constraints(t, v.variants, "place")


@query("a07_read_documents", "SELECT doc_id AS variation_id, lang AS uid, source AS title FROM documents WHERE doc_id % 7 <> 0")
def read_documents(v: Views) -> DataFrame:
    path = scratch(v) + "/docs"
    v.documents.select(F.to_json(F.struct(F.col("doc_id").alias("variation_id"), F.when(F.col("doc_id") % 7 != 0, F.struct(F.col("lang").alias("uid"), F.col("source").alias("title"))).alias("raw_summary"))).alias("value")).write.text(path)
    return tables.read_summaries(v.spark, path, "uid: string, title: string").filter("raw_summary IS NOT NULL").select("variation_id", "raw_summary.*")


@query("a08_pubmed_documents", """
    SELECT doc_id % 50 AS variation_id, count(*) AS articles, count(*) FILTER (WHERE doc_id % 8 <> 0) AS found, count(DISTINCT source) FILTER (WHERE doc_id % 8 <> 0) AS titles, CAST(sum(length(text)) AS BIGINT) AS chars,
           count(*) FILTER (WHERE doc_id % 3 = 0) AS searched FROM documents GROUP BY 1""")
def pubmed_documents(v: Views) -> DataFrame:
    """All four kinds of cached documents are written, read and joined: links to articles, abstracts and searches."""
    folder, pmid = scratch(v), F.col("doc_id").cast("string")
    cached = {
        "links": v.documents.groupBy((F.col("doc_id") % 50).alias("variation_id")).agg(F.collect_list(pmid).alias("pmids")),
        "articles": v.documents.select(pmid.alias("pmid"), F.when(F.col("doc_id") % 8 != 0, F.struct(F.col("source").alias("title"))).alias("raw")),
        "abstracts": v.documents.select(pmid.alias("pmid"), F.struct(F.col("text").alias("abstract")).alias("content")),
        "searches": v.documents.select(F.concat(F.lit("query "), pmid).alias("query"), F.when(F.col("doc_id") % 3 == 0, F.array(pmid)).otherwise(F.array()).alias("pmids")),
    }
    for kind, d in cached.items():
        d.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/{kind}")
    d = tables.read_literature(v.spark, folder)
    searched = d["searches"].select(F.explode("pmids").alias("pmid"), F.lit(1).alias("searched"))
    rows = d["links"].select("variation_id", F.explode("pmids").alias("pmid")).join(d["articles"], "pmid").join(d["abstracts"], "pmid").join(searched, "pmid", "left")
    return rows.groupBy("variation_id").agg(F.count("*").alias("articles"), F.count("raw").alias("found"), F.countDistinct("raw.title").alias("titles"), F.sum(F.char_length("content.abstract")).alias("chars"), F.count("searched").alias("searched"))


@query("a09_parse_pubmed_xml", "SELECT CAST(doc_id AS STRING) AS pmid, 'BACKGROUND: ' || lang || chr(10) || 'tail ' || source || ' end' AS abstract, source || '|' || lang AS mesh, lang AS keywords FROM documents")
def parse_pubmed_xml(v: Views) -> DataFrame:
    xml = F.concat(F.lit("<PubmedArticle><PMID Version=\"1\">"), F.col("doc_id").cast("string"), F.lit("</PMID><AbstractText Label=\"BACKGROUND\">"), "lang", F.lit("</AbstractText><AbstractText>tail <i>"), "source", F.lit("</i> end</AbstractText><DescriptorName>"), "source", F.lit("</DescriptorName><DescriptorName>"), "lang", F.lit("</DescriptorName><DescriptorName>"), "source", F.lit("</DescriptorName><Keyword>"), "lang", F.lit("</Keyword></PubmedArticle>"))
    d = tables.parse_pubmed_xml(v.documents.select(xml.alias("xml")))
    return d.select("pmid", "abstract", F.array_join("mesh_terms", "|").alias("mesh"), F.array_join("keywords", "|").alias("keywords"))


@query("a10_flatten_links", "SELECT CAST(doc_id AS STRING) AS variation_id, 0 AS position, 'p' || CAST(doc_id % 9 AS STRING) AS pmid FROM documents UNION ALL SELECT CAST(doc_id AS STRING), 1, 'q' || CAST(doc_id % 5 AS STRING) FROM documents")
def flatten_links(v: Views) -> DataFrame:
    p, q = F.concat(F.lit("p"), (F.col("doc_id") % 9).cast("string")), F.concat(F.lit("q"), (F.col("doc_id") % 5).cast("string"))
    dbs = F.array(F.struct(F.lit("pubmed").alias("dbto"), F.array(p, q, p).alias("links")), F.struct(F.lit("gene").alias("dbto"), F.array(F.lit("x")).alias("links")))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.col("doc_id").cast("string")).alias("ids"), dbs.alias("linksetdbs"))).alias("linksets")))
    return tables.flatten_links(v.documents.select(payload.alias("payload")))


@query("a11_flatten_search", "SELECT source AS query_translation, CAST(doc_id % 4 + 2 AS INT) AS count, CAST(doc_id AS STRING) || ',' || lang AS pmids FROM documents")
def flatten_search(v: Views) -> DataFrame:
    i = F.col("doc_id").cast("string")
    payload = F.to_json(F.struct(F.struct((F.col("doc_id") % 4 + 2).cast("string").alias("count"), F.array(i, F.col("lang"), i).alias("idlist"), F.col("source").alias("querytranslation")).alias("esearchresult")))
    d = tables.flatten_search(v.documents.select(payload.alias("payload")))
    return d.select("query_translation", "count", F.array_join("pmids", ",").alias("pmids"))


@query("a12_evidence_round_trip", "SELECT variant_key, score, route FROM {routed}")
def evidence_round_trip(v: Views) -> DataFrame:
    path = scratch(v) + "/evidence"
    tables.write_evidence(v.routed.select(F.struct("variant_key", "score", "route").alias("variant")), path)
    return tables.read_evidence(v.spark, path, "variant struct<variant_key: string, score: int, route: string>").select("variant.*")


@query("a13_golden_vectors", "SELECT variant_key, " + ", ".join(f"f{k}" for k in range(16)) + ", f0 * 1000 + f1 AS score FROM {small16}")
def golden_vectors(v: Views) -> DataFrame:
    d = v.small16.select("variant_key", F.array(*[f"f{k}" for k in range(16)]).alias("features"), (F.col("f0") * 1000 + F.col("f1")).alias("score"))
    back = tables.decode_vectors(d.select("variant_key", tables.encode_vectors(d).alias("value")))
    return back.select("variant_key", *[F.col("features")[k].alias(f"f{k}") for k in range(16)], "score")


@query("a14_reply_frames", """
    SELECT reply_id, abs(sequence) AS sequence, score, classification, deep_review,
           CASE WHEN reply_id % 23 = 0 THEN 'version' ELSE NULL END AS reject_reason,
           CASE WHEN reply_id % 23 = 0 THEN NULL ELSE classification <> CASE WHEN score >= 0 THEN 1 ELSE 0 END OR deep_review <> CASE WHEN score >= -276 THEN 1 ELSE 0 END END AS flag_mismatch
    FROM {replies}""")
def reply_frames(v: Views) -> DataFrame:
    hexed = lambda c, n: F.lpad(F.hex(c.cast("bigint").bitwiseAND(F.lit(4294967295))), n, "0")
    version = F.when(F.col("reply_id") % 23 == 0, "02").otherwise("01")
    frame = F.unhex(F.concat(version, F.lit("02"), hexed(F.abs("sequence"), 8), hexed(F.col("score"), 8), hexed(F.col("classification"), 2), hexed(F.col("deep_review"), 2)))
    d = tables.decode_reply_frames(v.replies.select("reply_id", frame.alias("frame")), -276)
    return d.select("reply_id", "sequence", "score", "classification", "deep_review", "reject_reason", "flag_mismatch")


def batch_frame(v: Views) -> DataFrame:
    """A batch frame of one to five scores for every reply; some are malformed."""
    hexed = lambda c, n: F.lpad(F.hex(c.cast("bigint").bitwiseAND(F.lit(4294967295))), n, "0")
    i = F.col("reply_id")
    item = lambda k: F.concat(hexed(F.col("score") + k, 8), hexed((F.col("score") + k >= 0).cast("int"), 2), hexed(((F.col("score") + k >= -276) == (i % 37 != 0)).cast("int"), 2))
    n = (i % 5 + 1).cast("int")
    items = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), item), "")
    head = F.concat(F.when(i % 23 == 0, "02").otherwise("01"), F.when(i % 29 == 0, "03").otherwise("02"), hexed(F.abs("sequence"), 8), hexed(F.when(i % 31 == 0, F.lit(33)).otherwise(n), 2), F.lit("00"))
    return v.replies.select("reply_id", F.unhex(F.concat(head, items, F.lit("0000"))).alias("frame"))


@query("a14_batch_frames", """
    SELECT reply_id, abs(sequence) AS sequence, k AS place, CASE WHEN k IS NOT NULL THEN CAST(score + k AS INT) END AS score, CASE WHEN k IS NOT NULL THEN CAST(score + k >= 0 AS INT) END AS classification,
           CASE WHEN k IS NOT NULL THEN CAST((score + k >= -276) = (reply_id % 37 <> 0) AS INT) END AS deep_review, coalesce(malformed, CASE WHEN reply_id % 37 = 0 THEN 'flag' END) AS reject_reason
    FROM (SELECT *, unnest(CASE WHEN malformed IS NULL THEN range(CAST(reply_id % 5 + 1 AS INT)) ELSE [NULL] END)::INT AS k FROM
      (SELECT *, CASE WHEN reply_id % 23 = 0 THEN 'version' WHEN reply_id % 29 = 0 THEN 'type' WHEN reply_id % 31 = 0 THEN 'count' END AS malformed FROM {replies}) m) r""")
def batch_frames(v: Views) -> DataFrame:
    return tables.decode_batch_frames(batch_frame(v), -276).drop("frame")


FINGERPRINTED = ("region", "nation", "supplier", "part", "customer", "documents")
COLUMNS = {
    "region": ("r_name", "r_regionkey"), "nation": ("n_name", "n_nationkey", "n_regionkey"), "supplier": ("s_acctbal", "s_name", "s_nationkey", "s_suppkey"),
    "part": ("p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type"), "customer": ("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"), "documents": ("doc_id", "lang", "n_chars", "source", "text"),
}


def fingerprint_sql(name: str) -> str:
    text = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in COLUMNS[name])
    return f"SELECT '{name}' AS name, count(*) AS rows, bit_xor(h) AS hash_xor, CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS hash_sum FROM (SELECT CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) AS h FROM {name}) t"


@query("a15_table_fingerprint", " UNION ALL ".join(map(fingerprint_sql, FINGERPRINTED)))
def table_fingerprint(v: Views) -> DataFrame:
    """Fingerprints by way of a run's manifest, which is written, checked and read."""
    path, own = scratch(v) + "/manifest", {n: getattr(v, n).select(*COLUMNS[n]) for n in FINGERPRINTED}
    tables.write_manifest(own, "first", path)
    tables.check_manifest(own, "first", path)
    return v.spark.read.parquet(path).drop("run")


# ---- B: scalar rules ----


@query("b01_variant_key", "SELECT chrom || ':' || CAST(pos AS STRING) || ':' || ref || ':' || alt AS variant_key FROM {variants}")
def variant_key(v: Views) -> DataFrame:
    return v.variants.select(V.variant_key(F.concat(F.lit(" chr"), "chrom"), F.col("pos"), F.lower("ref"), F.col("alt")).alias("variant_key"))


@query("b02_filter_snv", "SELECT count(*) AS snvs FROM {variants} WHERE l_linenumber <> 7 AND l_partkey % 3 <> 0")
def filter_snv(v: Views) -> DataFrame:
    alt = F.when(F.col("l_partkey") % 3 == 0, F.concat("alt", F.lit(","), "ref")).otherwise(F.col("alt"))
    status = F.when(F.col("l_linenumber") == 7, "q10").when(F.col("l_linenumber") % 2 == 0, ".").otherwise("PASS")
    return v.variants.filter(V.is_snv(status, F.col("ref"), alt)).agg(F.count("*").alias("snvs"))


@query("b03_is_missense", "SELECT gene, count(*) AS missense FROM {variants} WHERE l_linenumber % 3 < 2 GROUP BY gene")
def is_missense(v: Views) -> DataFrame:
    mc = F.when(F.col("l_linenumber") % 3 == 0, "SO:0001583|x").when(F.col("l_linenumber") % 3 == 1, "Missense_variant").otherwise("synonymous")
    return v.variants.filter(V.is_missense(mc)).groupBy("gene").agg(F.count("*").alias("missense"))


SIGNIFICANCE = ("Pathogenic", "Likely pathogenic", "Pathogenic/Likely_pathogenic", "Benign", "likely_benign", "Uncertain significance", "Conflicting classifications", " ", "risk factor")
SIGNIFICANCE_SQL = "CASE l_partkey % 9 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SIGNIFICANCE)) + " END"


def significance(v: Views) -> DataFrame:
    return v.variants.withColumn("text", F.get(F.array(*[F.lit(s) for s in SIGNIFICANCE]), (F.col("l_partkey") % 9).cast("int")))


@query("b04_classify_significance", f"SELECT text, CASE WHEN k < 3 THEN 1 WHEN k < 5 THEN 0 ELSE NULL END AS class, count(*) AS n FROM (SELECT {SIGNIFICANCE_SQL} AS text, l_partkey % 9 AS k FROM {{variants}}) t GROUP BY 1, 2")
def classify_significance(v: Views) -> DataFrame:
    return significance(v).withColumn("class", V.classify_significance(F.col("text"))).groupBy("text", "class").agg(F.count("*").alias("n"))


@query("b05_review_stars", "SELECT CASE l_suppkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS stars, count(*) AS n FROM {variants} GROUP BY 1")
def review_stars(v: Views) -> DataFrame:
    texts = ("no assertion criteria provided", "practice guideline", "Reviewed by expert panel", "criteria_provided,_multiple_submitters,_no_conflicts", "criteria provided, single submitter", "other")
    c = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("l_suppkey") % 6).cast("int"))
    return v.variants.select(V.review_stars(c).alias("stars")).groupBy("stars").agg(F.count("*").alias("n"))


@query("b06_allele_value", "SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN gene ELSE ref || ',' || alt || ',' || gene END AS value, count(*) AS n FROM {variants} GROUP BY 1, 2")
def allele_value(v: Views) -> DataFrame:
    packed = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(",", "ref", "gene")).otherwise(F.concat_ws(",", "ref", "alt", "gene"))
    return v.variants.select("l_linenumber", V.allele_value(packed, F.lit(1), F.lit(2)).alias("value")).groupBy("l_linenumber", "value").agg(F.count("*").alias("n"))


@query("b07_unique_gene", "SELECT CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE gene END AS symbol, count(*) AS n FROM {variants} GROUP BY 1")
def unique_gene(v: Views) -> DataFrame:
    info = F.when(F.col("l_suppkey") % 3 == 0, F.concat("gene", F.lit(":1|OTHER:2"))).otherwise(F.concat("gene", F.lit(":1|"), "gene", F.lit(":7")))
    return v.variants.select(V.unique_gene(info).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("b08_parse_variation_id", "SELECT CASE WHEN l_suppkey % 5 = 4 OR l_partkey = 0 THEN NULL ELSE l_partkey END AS variation_id, count(*) AS n FROM {variants} GROUP BY 1")
def parse_variation_id(v: Views) -> DataFrame:
    k = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_suppkey") % 5 == 0, k).when(F.col("l_suppkey") % 5 == 1, F.concat(k, F.lit(".0"))).when(F.col("l_suppkey") % 5 == 2, F.concat(F.lit("VCV"), F.lpad(k, 9, "0"), F.lit(".4"))).when(F.col("l_suppkey") % 5 == 3, F.concat(F.lit("Variation ID: "), k)).otherwise(F.concat(F.lit("x"), k))
    return v.variants.select(V.parse_variation_id(text).alias("variation_id")).groupBy("variation_id").agg(F.count("*").alias("n"))


@query("b09_pick_aligned", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size + 1 AS DOUBLE) END AS second, CAST(p_size AS DOUBLE) AS past_end FROM part")
def pick_aligned(v: Views) -> DataFrame:
    pick = lambda i: V.parse_number(V.pick_aligned(F.col("REVEL_score"), F.lit(i)))
    return dbnsfp_rows(v).select(F.col("place").alias("p_partkey"), pick(1).alias("second"), pick(5).alias("past_end"))


PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}', {g}, {s})" for a, b, g, s in V.substitution_rows()) + ") AS s (ref, alt, grantham, blosum62)"
AMINO = "substr('ARNDCQEGHILKMFPSTWYV', CAST({} % 20 + 1 AS INT), 1)"


@query("b10_substitution_scores", f"SELECT p_partkey AS place, grantham AS grantham_distance, blosum62 AS blosum62_score FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'X' ELSE {AMINO.format('p_partkey')} END AS r, {AMINO.format('(p_partkey + p_size)')} AS a FROM part) p LEFT JOIN {PAIRS} ON r = ref AND a = alt")
def substitution_scores(v: Views) -> DataFrame:
    letter = lambda c: F.substring(F.lit(V.AMINO_ACIDS), (c % 20 + 1).cast("int"), F.lit(1))
    k = F.col("p_partkey")
    d = v.part.select(k.alias("place"), F.when(k % 13 == 0, "X").otherwise(F.lower(letter(k))).alias("aaref"), letter(k + F.col("p_size")).alias("aaalt"))
    return V.substitution_scores(d).select("place", "grantham_distance", "blosum62_score")


@query("b11_significance_group", f"""
    SELECT grp AS "group", CASE WHEN grp NOT IN ('pathogenic', 'benign') THEN 'not_binary_comparable' WHEN (grp = 'pathogenic') = (label = 1) THEN 'same_binary_direction' ELSE 'different_binary_direction' END AS comparison, count(*) AS n
    FROM (SELECT label, CASE l_partkey % 9 WHEN 0 THEN 'pathogenic' WHEN 1 THEN 'pathogenic' WHEN 2 THEN 'pathogenic' WHEN 3 THEN 'benign' WHEN 4 THEN 'benign' WHEN 5 THEN 'uncertain' WHEN 6 THEN 'conflicting' WHEN 7 THEN 'missing' ELSE 'other' END AS grp FROM {{variants}}) t GROUP BY 1, 2""")
def significance_group(v: Views) -> DataFrame:
    d = significance(v).withColumn("group", V.significance_group(F.col("text")))
    return d.withColumn("comparison", V.comparison_group(F.col("label"), F.col("group"))).groupBy("group", "comparison").agg(F.count("*").alias("n"))


@query("b12_apply_route", "SELECT route, prediction, count(*) AS n FROM {routed} GROUP BY 1, 2")
def apply_route(v: Views) -> DataFrame:
    return v.scores.select(V.apply_route(F.col("score"), -276).alias("route"), V.prediction(F.col("score")).alias("prediction")).groupBy("route", "prediction").agg(F.count("*").alias("n"))


# ---- C: cohort and annotation ----


@query("c01_build_cohort", """
    SELECT k AS variant_key, gene, label, stars AS review_stars FROM (
      SELECT chrom || ':' || CAST(pos AS STRING) || ':' || ref || ':' || alt AS k, gene, label, CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END AS stars,
             count(*) OVER (PARTITION BY chrom, pos, ref, alt) AS n
      FROM {variants} WHERE l_linenumber <> 7 AND l_suppkey % 3 <> 2 AND NOT (label = 0 AND l_partkey % 5 = 0)) t WHERE n = 1""")
def build_cohort(v: Views) -> DataFrame:
    rows, _ = tables.parse_vcf(vcf_lines(v))
    return cohort.build_cohort(rows).select("variant_key", "gene", "label", "review_stars")


@query("c02_join_variant_annotations", """
    SELECT u.variant_key, m.p_partkey IS NOT NULL AS dbnsfp_match, m.p_partkey AS place FROM {unique_variants} u LEFT JOIN
      (SELECT variant_key, arg_min(p_partkey, (CASE WHEN hit THEN 0 ELSE 1 END) * 1000000000 + p_partkey) AS p_partkey FROM (
         SELECT u.variant_key, p.p_partkey, u.gene = 'GENE' || CAST(p.p_partkey % 97 AS STRING) AS hit FROM {unique_variants} u JOIN {part} p ON u.chrom = CAST(p.p_partkey % 24 + 1 AS STRING) AND u.pos % 50 = p.p_partkey % 50) x GROUP BY variant_key) m
    ON u.variant_key = m.variant_key""")
def join_variant_annotations(v: Views) -> DataFrame:
    u = v.unique_variants.select("variant_key", "gene", "chrom", (F.col("pos") % 50).alias("slot"))
    s = v.part.select((F.col("p_partkey") % 24 + 1).cast("string").alias("chrom"), (F.col("p_partkey") % 50).cast("int").alias("slot"), F.concat(F.lit("GENE"), (F.col("p_partkey") % 97).cast("string")).alias("genename"), F.col("p_partkey").alias("place"))
    return cohort.join_variant_annotations(u, s, "place", on=("chrom", "slot")).select("variant_key", "dbnsfp_match", "place")


CHOSEN = """SELECT p_partkey AS place, CASE WHEN pool = 'all' THEN CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE 0 END WHEN pool = 'first' THEN 0 ELSE 1 END AS idx,
  CASE WHEN (pool <> 'first') AND k % 3 = 0 THEN 'MANE Select' WHEN (pool <> 'second') AND k % 3 = 1 THEN 'Ensembl canonical' WHEN (pool <> 'first') AND k % 2 = 0 THEN 'APPRIS principal' ELSE 'first' END AS reason
  FROM (SELECT p_partkey, p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'first' ELSE 'second' END AS pool FROM {part}) t"""


@query("c03_choose_transcript", f"SELECT place, idx AS index, reason FROM ({CHOSEN}) c")
def choose_transcript(v: Views) -> DataFrame:
    t = cohort.choose_transcript(*[F.col(c) for c in ("Ensembl_transcriptid", "genename", "MANE", "Ensembl_canonical", "APPRIS", "gene")])
    return dbnsfp_rows(v).select("place", t.alias("t")).select("place", "t.index", "t.reason")


@query("c04_annotate_records", f"""
    SELECT c.place, CASE WHEN idx = 0 THEN 'ENST_A' ELSE 'ENST_B' END || CAST(c.place AS STRING) AS selected_transcript, reason AS transcript_selection, grantham AS grantham_distance, blosum62 AS blosum62_score,
           CASE WHEN idx = 1 AND c.place % 4 = 0 THEN 'overlap' ELSE 'no_overlap' END AS interpro_domain_status,
           CASE WHEN idx = 0 THEN CAST(p_size AS DOUBLE) WHEN c.place % 7 = 0 THEN NULL ELSE CAST(p_size + 1 AS DOUBLE) END AS revel_score
    FROM ({CHOSEN}) c JOIN {{part}} p ON c.place = p.p_partkey LEFT JOIN {PAIRS} ON {AMINO.format('c.place')} = ref AND {AMINO.format('(c.place + 7)')} = alt""")
def annotate_records(v: Views) -> DataFrame:
    d = cohort.annotate_records(dbnsfp_rows(v).withColumn("dbnsfp_match", F.lit(True)), {"REVEL_score": "revel_score"})
    return d.select("place", "selected_transcript", "transcript_selection", "grantham_distance", "blosum62_score", "interpro_domain_status", "revel_score")


@query("c05_join_annotations", "SELECT o_orderkey, o_custkey, o_totalprice, n.lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) n ON o_orderkey = l_orderkey")
def join_annotations(v: Views) -> DataFrame:
    lines = v.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return cohort.join_annotations(v.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [lines], "o_orderkey")


@query("c06_assemble", """
    SELECT u.variant_key, u.gene, s.score, g.genes_rows FROM {unique_variants} u LEFT JOIN {scores} s ON u.variant_key = s.variant_key
    LEFT JOIN (SELECT gene, count(*) AS genes_rows FROM {variants} GROUP BY gene) g ON u.gene = g.gene""")
def assemble(v: Views) -> DataFrame:
    u = stored(v.unique_variants.select("variant_key", "gene"))  # checked, then joined
    s = stored(v.scores.join(u.select("variant_key"), "variant_key", "left_semi").select("variant_key", "score"))
    return cohort.assemble(u, s, v.variants.groupBy("gene").agg(F.count("*").alias("genes_rows")))


@query("c07_resumable_extract", "SELECT variant_key, pos * 2 AS doubled FROM {unique_variants}")
def resumable_extract(v: Views) -> DataFrame:
    path, u = scratch(v) + "/extract", stored(v.unique_variants.select("variant_key", "pos"))
    double = lambda d: d.select("variant_key", (F.col("pos") * 2).alias("doubled"))
    cohort.resumable_extract(u.filter("pos % 3 = 0"), double, path)  # chunks that are not whole, which the next run makes again
    cohort.resumable_extract(u, double, path)
    return cohort.resumable_extract(u, double, path)


RAW16 = ("gnomad_popmax_af", "cadd_phred", "revel_score", "alphamissense_score", "esm1b_rankscore", "sift_score", "polyphen2_hvar_score", "mpc_score", "phylop_100way", "phastcons_100way", "gerp_rs", "grantham_distance", "blosum62_score", "gnomad_loeuf", "gnomad_moeuf", "interpro_domain_status")
SHARE = "round({0} / count(*), 6) AS fraction FROM {{raw16}}"


@query("c08_annotation_coverage", " UNION ALL ".join(f"SELECT 'column' AS measure, '{c}' AS name, count({c}) AS present, {SHARE.format(f'count({c})')}" for c in RAW16) + f"""
    UNION ALL SELECT 'match', 'matched', count(*) FILTER (WHERE cadd_phred IS NOT NULL), {SHARE.format('count(*) FILTER (WHERE cadd_phred IS NOT NULL)')}
    UNION ALL SELECT 'reason', interpro_domain_status, count(*), round(count(*) / (SELECT count(*) FROM {{raw16}}), 6) FROM {{raw16}} GROUP BY interpro_domain_status""")
def annotation_coverage(v: Views) -> DataFrame:
    d = v.raw16.withColumn("matched", F.col("cadd_phred").isNotNull()).withColumn("why", F.col("interpro_domain_status"))
    return cohort.annotation_coverage(d, list(RAW16), "matched", "why").withColumn("fraction", R6(F.col("fraction")))


@query("c09_repair_identifiers", "SELECT variant_key, gene, CAST(l_suppkey + 1 AS STRING) AS variation_id, CAST(l_orderkey AS STRING) AS allele_id FROM {unique_variants}")
def repair_identifiers(v: Views) -> DataFrame:
    u = stored(v.unique_variants.select("variant_key", "gene", "pos", "l_suppkey", "l_orderkey"))
    old = u.select("variant_key", "gene", F.when(F.col("pos") % 2 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_orderkey")).cast("string").alias("variation_id"), F.lit("").alias("allele_id"))
    vcf = u.select("variant_key", (F.col("l_suppkey") + 1).cast("string").alias("variation_id"), F.col("l_orderkey").cast("string").alias("allele_id"), F.array("gene").alias("genes"))
    return cohort.repair_identifiers(old, vcf)[0]


@query("c10_complete_join", "SELECT u.variant_key, u.pos, s.score FROM {unique_variants} u JOIN {scores} s ON u.variant_key = s.variant_key")
def complete_join(v: Views) -> DataFrame:
    u = stored(v.unique_variants.select("variant_key", "pos"))
    return cohort.complete_one_to_one_join(u, stored(v.scores.join(u, "variant_key", "left_semi").select("variant_key", "score")))


@query("c11_key_set_difference", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity < 10 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) a) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity < 10) b) AS only_right")
def key_set_difference(v: Views) -> DataFrame:
    return cohort.key_set_difference(v.lineitem.filter("l_quantity < 10"), v.lineitem.filter("l_quantity > 40"), "l_orderkey")


# ---- D: splits and features ----


@query("d01_group_splits")
def group_splits(v: Views) -> DataFrame:
    return features.split_summary(features.assign_group_splits(v.keyed.drop("split")))


HASH_CODE = "(CAST(substr(gene, 5) AS INT) * 103) % 10000"


@query("d02_hash_splits", f"SELECT gene, CASE WHEN c < 7000 THEN 'train' WHEN c < 8500 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM (SELECT gene, {HASH_CODE} AS c FROM {{keyed}}) t GROUP BY 1, 2")
def hash_splits(v: Views) -> DataFrame:
    return features.assign_hash_splits(v.keyed.drop("split"), code=F.expr(HASH_CODE)).groupBy("gene", "split").agg(F.count("*").alias("n"))


@query("d03_split_summary", "SELECT split, count(*) AS variants, count(DISTINCT gene) AS genes, CAST(sum(label) AS BIGINT) AS positives FROM {keyed} GROUP BY split")
def split_summary(v: Views) -> DataFrame:
    return features.split_summary(v.keyed)


ROBUST = ("phylop_100way", "gerp_rs", "gnomad_moeuf_intolerance", "gnomad_loeuf_intolerance")
RAW_OF = {f.id: f.raw[0] for f in features.CONTRACT}


@query("d04_fit_percentiles", " UNION ALL ".join(f"SELECT '{i}' AS feature, round(quantile_cont({RAW_OF[i]}, 0.01), 6) AS lower, round(quantile_cont({RAW_OF[i]}, 0.99), 6) AS upper FROM {{raw16}} WHERE split = 'train'" for i in ROBUST))
def fit_percentiles(v: Views) -> DataFrame:
    bounds = features.fit_percentiles(v.raw16.filter("split = 'train'"), features.CONTRACT)
    return v.spark.createDataFrame([(k, round(lo, 6), round(hi, 6)) for k, (lo, hi) in bounds.items()], "feature string, lower double, upper double")


SIMPLE = {
    "gnomad_popmax_rarity": "CASE WHEN gnomad_popmax_af >= 0 THEN -log10(greatest(gnomad_popmax_af, 1e-6)) / 6.0 END", "cadd_phred": "cadd_phred / 50.0", "revel_score": "revel_score", "alphamissense_score": "alphamissense_score",
    "esm1b_deleteriousness": "esm1b_rankscore", "sift_deleterious": "1 - sift_score", "polyphen2_hvar": "polyphen2_hvar_score", "mpc_score": "mpc_score / 5.0", "phastcons_100way": "phastcons_100way",
    "grantham_distance": "grantham_distance / 215.0", "blosum62_unfavorability": "(11.0 - blosum62_score) / 15.0",
}


def clipped(sql: str) -> str:
    return f"CASE WHEN {sql} IS NULL THEN NULL ELSE least(greatest({sql}, 0.0), 1.0) END"


@query("d05_fit_medians", " UNION ALL ".join(f"SELECT '{k}' AS feature, round(median({clipped(s)}), 6) AS median FROM {{raw16}} WHERE split = 'train'" for k, s in SIMPLE.items()))
def fit_medians(v: Views) -> DataFrame:
    contract = tuple(f for f in features.CONTRACT if f.id in SIMPLE)
    medians = features.fit_medians(v.raw16.filter("split = 'train'"), contract, {})
    return v.spark.createDataFrame([(k, round(m, 6)) for k, m in medians.items()], "feature string, median double")


def transformed(v: Views, ids: list[str]) -> DataFrame:
    by = {f.id: f for f in features.CONTRACT}
    return v.raw16.groupBy("gene").agg(*[R6(F.sum(features.transform_feature(by[i]))).alias(i) for i in ids])


def transformed_sql(ids: list[str]) -> str:
    return "SELECT gene, " + ", ".join(f"round(sum({clipped(SIMPLE[i])}), 6) AS {i}" for i in ids) + " FROM {raw16} GROUP BY gene"


IDENTITY = ["revel_score", "alphamissense_score", "sift_deleterious", "polyphen2_hvar"]


@query("d06a_identity", transformed_sql(IDENTITY))
def identity(v: Views) -> DataFrame:
    return transformed(v, IDENTITY)


@query("d06b_clip_scale", transformed_sql(["cadd_phred", "mpc_score", "grantham_distance"]))
def clip_scale(v: Views) -> DataFrame:
    return transformed(v, ["cadd_phred", "mpc_score", "grantham_distance"])


@query("d06c_log_rarity", transformed_sql(["gnomad_popmax_rarity"]))
def log_rarity(v: Views) -> DataFrame:
    return transformed(v, ["gnomad_popmax_rarity"])


@query("d06d_reverse_range", transformed_sql(["blosum62_unfavorability"]))
def reverse_range(v: Views) -> DataFrame:
    return transformed(v, ["blosum62_unfavorability"])


@query("d06e_robust_percentile", """
    SELECT gene, round(sum(least(greatest((gerp_rs - lo) / (hi - lo), 0.0), 1.0)), 4) AS gerp, round(sum(least(greatest(1 - (gnomad_moeuf - lo2) / (hi2 - lo2), 0.0), 1.0)), 4) AS moeuf
    FROM {raw16}, (SELECT quantile_cont(gerp_rs, 0.01) AS lo, quantile_cont(gerp_rs, 0.99) AS hi, quantile_cont(gnomad_moeuf, 0.01) AS lo2, quantile_cont(gnomad_moeuf, 0.99) AS hi2 FROM {raw16} WHERE split = 'train') b GROUP BY gene""")
def robust_percentile(v: Views) -> DataFrame:
    b = features.fit_percentiles(v.raw16.filter("split = 'train'"), features.CONTRACT)
    by = {f.id: f for f in features.CONTRACT}
    total = lambda i: F.round(F.sum(features.transform_feature(by[i], b[i])), 4)
    return v.raw16.groupBy("gene").agg(total("gerp_rs").alias("gerp"), total("gnomad_moeuf_intolerance").alias("moeuf"))


@query("d06f_domain_ternary", "SELECT interpro_domain_status, CASE interpro_domain_status WHEN 'overlap' THEN 1.0 WHEN 'no_overlap' THEN 0.0 ELSE 0.5 END::DOUBLE AS value, count(*) AS n FROM {raw16} GROUP BY 1, 2")
def domain_ternary(v: Views) -> DataFrame:
    return v.raw16.select("interpro_domain_status", V.domain_ternary(F.col("interpro_domain_status")).alias("value")).groupBy("interpro_domain_status", "value").agg(F.count("*").alias("n"))


@query("d06g_row_max", "SELECT gene, round(sum(least(greatest(coalesce(greatest(revel_score, esm1b_rankscore), revel_score), 0.0), 1.0)), 6) AS row_max FROM {raw16} GROUP BY gene")
def row_max(v: Views) -> DataFrame:
    f = features.Feature("m", ("revel_score", "esm1b_rankscore"), "row_max")
    return v.raw16.groupBy("gene").agg(R6(F.sum(features.transform_feature(f))).alias("row_max"))


RAW_ID = {f.id: f.raw[0] for f in features.CONTRACT}


@query("d07_missingness_audit", "SELECT split, " + ", ".join(f"CAST(sum(CASE WHEN {c} {'NOT IN (' + chr(39) + 'overlap' + chr(39) + ', ' + chr(39) + 'no_overlap' + chr(39) + ')' if i == 'interpro_domain_hit' else 'IS NULL'} THEN 1 ELSE 0 END) AS BIGINT) AS {i}" for i, c in RAW_ID.items()) + " FROM {raw16} GROUP BY split")
def missingness_audit(v: Views) -> DataFrame:
    m = features.FeatureModel(features.CONTRACT, {}, {}).audit(v.raw16)
    return m.groupBy("split").agg(*[F.count_if(i).alias(i) for i in RAW_ID])


BOUNDS = "(SELECT " + ", ".join(f"quantile_cont({RAW_ID[i]}, 0.01) AS lo_{i}, quantile_cont({RAW_ID[i]}, 0.99) AS hi_{i}" for i in ROBUST) + " FROM {raw16} WHERE split = 'train')"


def scaled_sql(i: str) -> str:
    """A feature between 0 and 1 in SQL, null kept; needs BOUNDS beside it."""
    if i == "interpro_domain_hit":
        return "CASE interpro_domain_status WHEN 'overlap' THEN 1.0 WHEN 'no_overlap' THEN 0.0 ELSE 0.5 END"
    if i not in ROBUST:
        return clipped(SIMPLE[i])
    part = f"({RAW_ID[i]} - lo_{i}) / (hi_{i} - lo_{i})"
    return clipped(part if i in ("phylop_100way", "gerp_rs") else f"1 - {part}")


SCALED = "(SELECT variant_key, gene, split, " + ", ".join(f"CAST({scaled_sql(i)} AS DOUBLE) AS {i}" for i in RAW_ID) + f" FROM {{raw16}}, {BOUNDS} b)"
MEDIANS = f"(SELECT {', '.join(f'median({i}) AS m_{i}' for i in RAW_ID)} FROM {SCALED} s WHERE split = 'train')"
FILLED = f"(SELECT variant_key, gene, split, {', '.join(f'CAST(coalesce({i}, m_{i}) AS FLOAT) AS {i}' for i in RAW_ID)} FROM {SCALED} s, {MEDIANS} m)"


@query("d08_impute", "SELECT split, round(sum(least(coalesce(cadd_phred / 50.0, (SELECT median(cadd_phred / 50.0) FROM {raw16} WHERE split = 'train')), 1.0)), 3) AS cadd_phred FROM {raw16} GROUP BY split")
def impute(v: Views) -> DataFrame:
    m = features.fit_encoder(v.raw16, tuple(f for f in features.CONTRACT if f.id == "cadd_phred"))
    return v.raw16.select("split", F.coalesce(features.transform_feature(m.contract[0]), F.lit(m.medians["cadd_phred"])).alias("x")).groupBy("split").agg(F.round(F.sum("x"), 3).alias("cadd_phred"))


@query("d09_encode_int8", "SELECT variant_key, CASE WHEN cadd_phred IS NOT NULL THEN CAST(least(greatest(round_even(254.0::DOUBLE * least(cadd_phred / 50.0, 1.0) - 127.0, 0), -127), 127) AS TINYINT) END AS q FROM {raw16}")
def encode_int8(v: Views) -> DataFrame:
    by = {f.id: f for f in features.CONTRACT}
    return v.raw16.select("variant_key", V.encode_int8(features.transform_feature(by["cadd_phred"])).alias("q"))


def feature_tables(v: Views, kind: str) -> DataFrame:
    splits = v.raw16.select("gene", "split").distinct()
    return features.build_feature_tables(v.raw16, splits)[1][kind]


@query("d10_build_feature_tables", f"SELECT variant_key, gene, split, {', '.join(f'CAST(least(greatest(round_even(254.0::FLOAT * {i} - 127.0::FLOAT, 0), -127), 127) AS TINYINT) AS {i}' for i in RAW_ID)} FROM {FILLED} f")
def build_feature_tables(v: Views) -> DataFrame:
    return feature_tables(v, "int8").drop("label")


@query("d10_float_table", "SELECT variant_key, gene, split, " + ", ".join(f"round(CAST({i} AS DOUBLE), 6) AS {i}" for i in RAW_ID) + f" FROM {FILLED} f")
def float_table(v: Views) -> DataFrame:
    return feature_tables(v, "float").select("variant_key", "gene", "split", *[R6(F.col(i).cast("double")).alias(i) for i in RAW_ID])


@query("d10_state", f"SELECT x.feature, round(x.lower, 6) AS lower, round(x.upper, 6) AS upper, round(x.median, 6) AS median FROM {BOUNDS} b, {MEDIANS} m, unnest([" + ", ".join(f"{{'feature': '{i}', 'lower': {f'lo_{i}' if i in ROBUST else 'CAST(NULL AS DOUBLE)'}, 'upper': {f'hi_{i}' if i in ROBUST else 'CAST(NULL AS DOUBLE)'}, 'median': m_{i}}}" for i in RAW_ID) + "]) AS u (x)")
def feature_state(v: Views) -> DataFrame:
    return feature_tables(v, "state").select("feature", *[R6(F.col(c)).alias(c) for c in ("lower", "upper", "median")])


# ---- E: checks and samples ----

F16 = [f"f{k}" for k in range(16)]


@query("e02_validate_dataset", """
    SELECT CASE WHEN count(*) = count(DISTINCT variant_key) THEN 'passed' ELSE 'failed' END AS status, CASE WHEN count(*) = count(DISTINCT variant_key) THEN '' ELSE 'repeated keys' END AS errors, count(*) AS rows,
           (SELECT string_agg(split || ':' || CAST(n AS VARCHAR) || ':' || CAST(p AS VARCHAR), ',' ORDER BY split) FROM (SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p FROM {small16} GROUP BY split) s) AS per_split FROM {small16}""")
def validate_dataset(v: Views) -> DataFrame:
    text = F.array_join(F.transform("per_split", lambda s: F.concat_ws(":", s["split"], s["rows"].cast("string"), s["positives"].cast("string"))), ",")
    return features.validate_dataset(v.small16, F16).select("status", F.array_join("errors", ",").alias("errors"), "rows", text.alias("per_split"))


@query("e03_group_leakage", "SELECT chrom AS gene, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM {keyed} GROUP BY chrom HAVING count(DISTINCT split) > 1")
def group_leakage(v: Views) -> DataFrame:
    return features.group_leakage(v.keyed.select(F.col("chrom").alias("gene"), "split")).select("gene", F.array_join("splits", ",").alias("splits"))


CHECKED = ("cadd_phred", "phylop_100way", "gerp_rs", "grantham_distance")


@query("e04_scoring_input", "SELECT count(*) - count(DISTINCT variant_key) AS repeated_keys, " + ", ".join(f"CAST(sum(CASE WHEN {' OR '.join(t.format(c) for c in CHECKED)} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, t in (("null_rows", "{} IS NULL"), ("fractional_rows", "coalesce({0} <> round({0}), false)"), ("range_rows", "coalesce({0} < -128 OR {0} > 127, false)"))) + " FROM {raw16}")
def scoring_input_errors(v: Views) -> DataFrame:
    return features.scoring_input_errors(v.raw16, list(CHECKED))


@query("e04_checked_input", "SELECT variant_key, split, " + ", ".join(F16) + " FROM {small16} WHERE split = 'test' AND variant_key IN (SELECT variant_key FROM {unique_variants}) ORDER BY variant_key LIMIT 400")
def checked_input(v: Views) -> DataFrame:
    """The limit of the operator: the least keys of one split, once all its rows have passed."""
    rows = v.small16.join(v.unique_variants.select("variant_key"), "variant_key", "left_semi")
    return features.scoring_input(rows, F16, "test", 400).select("variant_key", "split", *F16)


@query("e05_balanced_sample", """
    SELECT label, count(*) AS n, min(variant_key) AS least FROM (
      (SELECT variant_key, label FROM {unique_variants} WHERE label = 1 ORDER BY (CAST(pos AS BIGINT) * 7919) % 10007, variant_key LIMIT 250) UNION ALL
      (SELECT variant_key, label FROM {unique_variants} WHERE label = 0 ORDER BY (CAST(pos AS BIGINT) * 7919) % 10007, variant_key LIMIT 250)) t GROUP BY label""")
def balanced_sample(v: Views) -> DataFrame:
    s = features.balanced_sample(v.unique_variants, 500, code=(F.col("pos").cast("bigint") * 7919) % 10007)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.min("variant_key").alias("least"))


@query("e06_seeded_sample", "SELECT variant_key FROM {unique_variants} ORDER BY (CAST(pos AS BIGINT) * 104729) % 100003, variant_key LIMIT 300")
def seeded_sample(v: Views) -> DataFrame:
    return features.seeded_sample(v.unique_variants, 300, code=(F.col("pos").cast("bigint") * 104729) % 100003).select("variant_key")


@query("e07_activation_coverage", " UNION ALL ".join(f"SELECT 'f{k}' AS unit, CAST(sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_rows FROM {{small16}}" for k in range(16)))
def activation_coverage(v: Views) -> DataFrame:
    return features.activation_coverage(v.small16, F16)
