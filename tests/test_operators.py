"""Worked examples, ties, nulls and repeated keys of the reference operators."""

import gzip
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triage_spark.functions import variants as V
from triage_spark.operators import claims, cohort, evidence, features, replies, scoring
from triage_spark.sources import blocks, tables
from triage_spark.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(v):
    return F.lit(v).cast("string")


def vcf_row(pos, ref, alt, info, id_="7", status="PASS"):
    return "\t".join(["chr4", str(pos), id_, ref, alt, "50", status, info])


EXPERT = "CLNREVSTAT=reviewed_by_expert_panel;MC=SO:0001583|missense_variant"
VCF = [
    "##fileformat=VCFv4.2", "", vcf_row(11, "g", "c", f"GENEINFO=TP:1;CLNSIG=Likely_pathogenic;{EXPERT};CLNSIG=Pathogenic", "31"),  # the last of a repeated key stands
    vcf_row(12, "T", "A", f"{EXPERT};GENEINFO=XY:2|XY:3;CLNSIG=Likely_benign", "32", "."), vcf_row(13, "T", "A", f"{EXPERT};GENEINFO=XY:2|ZZ:3;CLNSIG=Benign", "33"),
    vcf_row(14, "C", "G", "CLNSIG=Benign;GENEINFO=Q:1;MC=SO:0001583|missense_variant", "34"), vcf_row(15, "C", "G", f"{EXPERT};GENEINFO=Q:1;CLNSIG=Conflicting", "35"),
    vcf_row(16, "C", "G", f"{EXPERT};GENEINFO=Q:1;CLNSIG=Benign", "36"), vcf_row(16, "C", "G", f"{EXPERT};GENEINFO=Q:1;CLNSIG=Pathogenic", "37"),  # two rows of one key
    vcf_row(17, "CA", "G", f"{EXPERT};GENEINFO=Q:1;CLNSIG=Benign", "38"), vcf_row(18, "C", "G", f"{EXPERT};GENEINFO=Q:1;CLNSIG=Benign", "rs9"),
    vcf_row(19, "C", "G", "GENEINFO=Q:1;CLNSIG=Benign;CLNREVSTAT=practice_guideline;MC=SO:0001819|synonymous_variant", "39"), vcf_row(20, "C", "G", "SEEN;A=b=c;A=d=e", "40", "low"), "chr4\t21\tshort",
]


def test_vcf_to_cohort(spark):
    lines = spark.createDataFrame([(x,) for x in VCF], "value string")
    rows, rejects = tables.parse_vcf(lines)
    assert [r["line"] for r in rejects.collect()] == [VCF[-1]]
    for d in (rows, rows.drop("info_text")):
        got = {r["variant_key"]: (r["label"], r["review_stars"], r["gene"]) for r in cohort.build_cohort(d).collect()}
        assert got == {"4:11:G:C": (1, 3, "TP"), "4:12:T:A": (0, 3, "XY")}
    assert rows.filter("pos = 20").first()["info"] == {"SEEN": "true", "A": "d=e"}
    assert rows.filter("pos = 11").first()["info"]["CLNSIG"] == "Pathogenic"
    assert tables.wrong_assembly(lines).count() == 0
    values = tables.with_info(rows, ("A", "CLNSIG")).select("pos", F.col("info__.A").alias("a"), F.col("info__.CLNSIG").alias("s"))
    assert {r["pos"]: (r["a"], r["s"]) for r in values.filter("pos IN (11, 20)").collect()} == {11: (None, "Pathogenic"), 20: ("d=e", None)}


def test_scalars(spark):
    for raw, want in (("chrM", "MT"), ("MT", "MT"), (" chr1 ", "1"), ("x", "x")):
        assert one(spark, V.normalize_chrom(text(raw))) == want
    for raw, want in (("12", 12), ("12.0", 12), ("VCV000123.4", 123), ("variation: 9", 9), ("0", None), ("x", None), (None, None)):
        assert one(spark, V.parse_variation_id(text(raw))) == want
    assert one(spark, V.parse_number(text("nan"))) is None
    assert one(spark, V.parse_number(text("."))) is None
    assert one(spark, V.unique_gene(text("A:1|B:2"))) is None
    pairs = spark.createDataFrame([("L", "I"), (" w ", "W"), ("D", "E"), ("K", "?"), (None, "A")], "aaref string, aaalt string")
    got = [(r["grantham_distance"], r["blosum62_score"]) for r in V.substitution_scores(pairs).orderBy(F.desc("aaref")).collect()]
    assert sorted(got, key=str) == sorted([(5, 2), (0, 11), (45, 2), (None, None), (None, None)], key=str)
    table = {(a, b): (d, s) for a, b, d, s in V.substitution_rows()}
    assert len(table) == 400 and all(table[a, b] == table[b, a] and (table[a, b][0] == 0) == (a == b) for a, b in table)
    assert V.resolve_id_column(["x", "clinvar_id", "ID"]) == "clinvar_id" and V.resolve_id_column(["x", "ID"], "x") == "x"
    for columns, wanted in ((["x"], None), (["ID"], "x")):
        with pytest.raises(ValueError):
            V.resolve_id_column(columns, wanted)
    assert one(spark, V.clip01(F.lit(None).cast("double"))) is None
    for h, want in ((-1, 0), (0, 0), (1, 0), (7, 0), (8, 1), (15, 1), (16, 1), (5000, 127)):
        assert one(spark, V.requantize(F.lit(h).cast("bigint"))) == want


def test_transcripts(spark):
    cols = "Ensembl_transcriptid string, genename string, MANE string, Ensembl_canonical string, APPRIS string, aaref string, aaalt string, Interpro_domain string, s string, gene string, dbnsfp_match boolean"
    rows = [
        ("t1;t2;t3", "P;Q;Q", "Select;.;.", ".;.;YES", ".;principal_2;.", "N", "D", ".;.;kinase", "1;2;3", "q", True),  # of gene Q: the canonical one before the APPRIS one
        ("t1;t2;t3", "P;P;P", ".;.;Select", "YES;.;.", "principal_1;.;.", "N", "D", "x;y;.", "1;2;.", "Q", True),  # no transcript of the gene: all of them
        (*[None] * 9, "Q", False),
    ]
    got = cohort.annotate_records(spark.createDataFrame(rows, cols), {"s": "score"}).orderBy("gene", F.desc("selected_transcript")).collect()
    assert [(r["selected_transcript"], r["transcript_selection"], r["score"], r["grantham_distance"], r["blosum62_score"], r["interpro_domain_status"]) for r in sorted(got, key=lambda r: str(r["transcript_selection"]))] == [
        ("t3", "Ensembl canonical", 3.0, 23, 1, "overlap"), ("t3", "MANE Select", None, 23, 1, "no_overlap"), (None, None, None, None, None, "no_overlap"),
    ]


def test_joins_refuse_bad_keys(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2)], "variant_key string, a int")
    b = spark.createDataFrame([("k", 1)], "variant_key string, b int")
    with pytest.raises(ValueError, match="repeated"):
        cohort.join_annotations(b, [a])
    with pytest.raises(ValueError, match="repeats columns"):
        cohort.join_annotations(b, [b])
    with pytest.raises(ValueError, match="one side"):
        cohort.complete_one_to_one_join(b, spark.createDataFrame([("z", 1)], "variant_key string, c int"))


# Positives 9, 7, 7, 2, -6: with a target the threshold is the ceil(target * 5)-th of them from above.
ROUTING = [([9, 8, 7, 7, 3, 2, -6, -7], [1, 0, 1, 1, 0, 1, 1, 0], target, want) for target, want in ((0.2, 9), (0.21, 7), (0.6, 7), (0.61, 2), (0.8, 2), (1.0, -6))]


@pytest.mark.parametrize("scores,labels,target,want", ROUTING)
def test_routing_threshold(spark, scores, labels, target, want):
    d = spark.createDataFrame(list(zip(scores, labels)), "score int, label int")
    assert scoring.select_routing_threshold(scoring.score_curve(d), target).first()["threshold"] == want


def test_routing_errors(spark):
    d = spark.createDataFrame([(4, 0), (-4, 0), (4, 0)], "score int, label int")
    with pytest.raises(ValueError, match="no pathogenic"):
        scoring.select_routing_threshold(scoring.score_curve(d), 0.9)
    with pytest.raises(ValueError, match="0 or 1"):
        scoring.check_labels(spark.createDataFrame([(1, 2)], "score int, label int"))


def test_curve_ties(spark):
    d = spark.createDataFrame([(5, 1), (5, 0), (3, 1), (1, 0)], "score int, label int")
    c = scoring.score_curve(d)
    assert [(r["score"], r["tp"], r["fp"]) for r in c.orderBy(F.desc("score")).collect()] == [(5, 1, 1), (3, 2, 1), (1, 2, 2)]
    assert scoring.roc_auc(c).first()[0] == 0.625
    assert scoring.best_f1_threshold(c).first()["threshold"] == 3


def test_engines_agree_and_models_are_checked(spark):
    w = tuple(tuple((u * i) % 9 - 4 for i in range(4)) for u in range(3))
    m = scoring.Model(("a", "b", "c", "d"), (w, ((3, -2, 5),)), ((8, -3, 0), (7,)))
    rows = [(str(k), "G", k % 255 - 127, (k * 7) % 255 - 127, 127, -128) for k in range(300)]
    d = spark.createDataFrame(rows, "variant_key string, gene string, a int, b int, c int, d int")
    odd = spark.createDataFrame([("none", "G", None, 1, 2, 3)], d.schema)
    big = scoring.Model(m.features, (tuple(tuple(127 for _ in range(4)) for _ in range(3)), ((127, 127, 127),)), ((1 << 26, 0, -(1 << 26)), (9,)))  # beyond float32
    for model in (m, big):
        assert scoring.compare_scores(scoring.score(d, model, "expr"), scoring.score(d, model, "arrow")).count() == 0
        assert scoring.score(odd, model, "arrow").first()["score"] is None and scoring.score(odd, model, "expr").first()["score"] is None
    policy = scoring.build_policy(5, 0.9, 0.95, "validation", m)
    assert scoring.load_policy(policy, scoring.Model(m.features, m.weights, m.biases)) == 5
    assert policy["model"] == "3249263829414e8b958c63508ffbeac26734e16ca4647f1b21b6003a598bb1a1"
    with pytest.raises(ValueError, match="another model"):
        scoring.load_policy(policy, big)
    made = scoring.load_model({"feature_order": ["a"], "hidden_weights": [[2], [-3]], "hidden_biases": [1, 0], "output_weights": [4, 5], "folded_output_bias": 6, "qshift": 4})
    assert made.weights == (((2,), (-3,)), ((4, 5),)) and made.biases == ((1, 0), (6,))
    with pytest.raises(ValueError, match="lacks"):
        scoring.load_model({"qshift": 4})
    rows = spark.createDataFrame([("validation", 1), ("validation", 2), ("test", 3)], "split string, x int")
    assert scoring.guard_selection(rows, 2).count() == 2
    for n, split in ((3, "validation"), (1, "test")):
        with pytest.raises(ValueError):
            scoring.guard_selection(rows, n, split)
    assert scoring.fold_threshold(m, -276).biases[-1] == (283,)
    with pytest.raises(ValueError, match="int8"):
        scoring.Model(("a",), (((300,),),), ((0,),))
    with pytest.raises(ValueError, match="test split"):
        scoring.build_policy(1, 0.9, 0.95, "test", m)


def test_vectors_round_trip(spark):
    line = "".join(f"{(k * 37 - 300) % 256:02X}" for k in range(16)) + "FFFFFF38"
    d = tables.decode_vectors(spark.createDataFrame([(f" {line.lower()} ",)], "value string"))
    r = d.first()
    assert r["score"] == -200 and r["features"] == [(k * 37 - 300 + 128) % 256 - 128 for k in range(16)]
    assert d.select(tables.encode_vectors(d).alias("v")).first()["v"] == line


def reply(sequence, score, classification=None, deep=None):
    """A reply with the flags of its score at a threshold of -30, or with others."""
    return sequence, score, int(score >= 0) if classification is None else classification, int(score >= -30) if deep is None else deep


# unique, correct, missing, duplicates, out of order, unrelated, mismatches
REPLIES = [
    ([(5, 40), (6, -40), (7, -20), (8, 0)], [reply(5, 40), reply(6, -40), reply(7, -20), reply(8, 0)], (4, 4, 0, 0, 0, 0, 0)),
    ([(5, 40), (6, -40), (7, -20)], [reply(7, -20), reply(5, 40), reply(7, -20), reply(7, -20)], (2, 2, 1, 2, 1, 0, 0)),
    ([(5, 40), (6, -40), (7, -20)], [reply(5, 41), reply(6, -40, deep=1), reply(7, -20, classification=1), reply(7, -20)], (3, 1, 0, 1, 0, 0, 3)),
    ([(5, 40)], [reply(4, 40), reply(6, 40), reply(5, 40)], (1, 1, 0, 0, 0, 2, 0)),
]


@pytest.mark.parametrize("expected,got,want", REPLIES)
def test_reply_summary(spark, expected, got, want):
    e = spark.createDataFrame([(1, s, x, 0.0) for s, x in expected], "stream_id long, sequence long, score int, started double")
    r = spark.createDataFrame([(1, s, x, c, d, float(k), k) for k, (s, x, c, d) in enumerate(got)], "stream_id long, sequence long, score int, classification int, deep_review int, arrival double, reply_id long")
    x = replies.reply_summary(e, r, -30).first()
    assert tuple(x[c] for c in ("received_unique", "correct_unique", "missing", "duplicates", "out_of_order", "unrelated_replies", "mismatches")) == want


def test_features_and_splits(spark):
    rows = [(f"k{g}_{j}", f"G{g}", j % 2, None if (g, j) == (0, 0) else float(g * 3 + j), 0.3, "overlap" if g % 2 else "odd") for g in range(12) for j in range(2)]
    d = spark.createDataFrame(rows, "variant_key string, gene string, label int, cadd_phred double, revel_score double, interpro_domain_status string")
    s = features.assign_group_splits(d)
    assert features.group_leakage(s).count() == 0 and s.count() == 24
    assert {r["split"] for r in s.select("split").distinct().collect()} == set(features.SPLITS)
    contract = tuple(f for f in features.CONTRACT if f.id in ("cadd_phred", "revel_score", "interpro_domain_hit"))
    m = features.fit_encoder(s, contract)
    e = m.encode(s)
    ids = [f.id for f in contract]
    assert features.validate_dataset(e, ids).first()["status"] == "passed"
    assert e.filter("revel_score <> -51").count() == 0
    assert m.audit(s).filter("cadd_phred").count() == 1
    assert m.audit(s).filter("interpro_domain_hit").count() == 12
    assert features.balanced_sample(d, 10).groupBy("label").count().filter("count <> 5").count() == 0
    few = spark.createDataFrame([(f"k{k}", int(k < 18)) for k in range(20)], "variant_key string, label int")
    for n, pos, neg in ((10, 8, 2), (3, 1, 2), (20, 18, 2), (30, 18, 2)):
        got = {r["label"]: r["count"] for r in features.balanced_sample(few, n).groupBy("label").count().collect()}
        assert (got.get(1, 0), got.get(0, 0)) == (pos, neg)
    with pytest.raises(ValueError, match="exactly one split"):
        features.build_feature_tables(d, spark.createDataFrame([("G1", "train"), ("G1", "test")], "gene string, split string"), contract)
    entries = [{"index": 0, "id": "a", "raw_columns": ["x"], "transform": "robust_percentile", "lower_percentile": 0.1, "upper_percentile": 0.9, "missing": "median"}]
    assert features.load_contract(entries)[0].params == {"lower": 0.1, "upper": 0.9}
    with pytest.raises(ValueError):
        features.load_contract([entries[0] | {"index": 1}])


def test_exact_quantiles(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    for most in (20_000, 50):  # all values at once, and many passes
        monkeypatch.setattr(features, "VALUES", most)
        data = {"a": rng.normal(size=3000), "b": rng.integers(0, 5, 3000).astype(float), "c": np.exp(rng.normal(0, 20, 3000)), "d": np.full(3000, 2.5)}
        rows = [(*map(float, r), None) for r in zip(*data.values())] + [(None, float("nan"), None, 2.5, None)]
        d = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
        at = (0.0, 0.01, 0.3333, 0.5, 0.99, 1.0)
        got = features.quantiles(d, {c: F.col(c) for c in "abcde"}, {c: at for c in "abcde"})
        assert got["e"] is None
        for c in "abc":
            assert got[c] == pytest.approx(tuple(np.quantile(data[c], at)), rel=1e-12)
        assert set(got["d"]) == {2.5}


def test_dead_units_and_summaries_are_errors(spark, tmp_path):
    d = spark.createDataFrame([(1, 0), (2, -1)], "h0 int, h1 int")
    assert features.activation_coverage(d.select("h0"), ["h0"]).first()["active_rows"] == 2
    with pytest.raises(Exception, match="no active row for unit h1"):
        features.activation_coverage(d, ["h0", "h1"]).collect()
    spark.createDataFrame([('{"variation_id": 3, "raw_summary": {"title": "t"}}',)], "value string").write.text(str(tmp_path / "s"))
    with pytest.raises(Exception, match="no summary of 3"):
        tables.read_summaries(spark, str(tmp_path / "s"), "uid: string, title: string").collect()


def test_manifests_and_chunks(spark, tmp_path):
    d = spark.range(100).selectExpr("id", "cast(id as string) AS variant_key")
    tables.write_manifest({"d": d, "e": d.limit(5)}, "r1", str(tmp_path / "m"))
    tables.check_manifest({"d": d.repartition(7), "e": d.limit(5)}, "r1", str(tmp_path / "m"))
    with pytest.raises(ValueError, match="d"):
        tables.check_manifest({"d": d.filter("id <> 7"), "e": d.limit(5)}, "r1", str(tmp_path / "m"))
    seen = []

    def extract(rows):
        seen.append(rows.count())
        return rows.select("variant_key", (F.col("id") + 1).alias("x"))

    path = str(tmp_path / "x")
    assert cohort.resumable_extract(d.filter("id < 40"), extract, path, chunks=4).count() == 40
    assert cohort.resumable_extract(d, extract, path, chunks=4).count() == 100
    assert cohort.resumable_extract(d, extract, path, chunks=4).agg(F.sum("x")).first()[0] == 5050
    assert seen[0] == 40 and seen[2] == 0
    with pytest.raises(ValueError, match="not in the work"):
        cohort.resumable_extract(d.filter("id > 5"), extract, path, chunks=4)


def test_group_split_beside_plain_python(spark):
    rows = [(f"g{g}", (g * j) % 3 == 0) for g in range(1, 25) for j in range(1 + (g * 7) % 11)]
    d = spark.createDataFrame([(g, int(x)) for g, x in rows], "gene string, label int")
    ties = {r["gene"]: r["t"] for r in d.select("gene", F.xxhash64("gene", F.lit(42)).alias("t")).distinct().collect()}
    total = {g: (sum(1 for a, _ in rows if a == g), sum(int(x) for a, x in rows if a == g)) for g in ties}
    order = sorted(ties, key=lambda g: (-total[g][0], ties[g]))
    share, filled, want = (0.70, 0.15, 0.15), [[0, 0, 0] for _ in range(3)], {}
    whole = [sum(n for n, _ in total.values()), sum(p for _, p in total.values()), sum(n - p for n, p in total.values())]
    for k, g in enumerate(order):
        n, p = total[g]
        fill = [sum(w * filled[s][m] / (share[s] * whole[m]) for m, w in enumerate((0.5, 0.25, 0.25))) for s in range(3)]
        s = k if k < 3 else fill.index(min(fill))
        filled[s] = [a + b for a, b in zip(filled[s], (n, p, n - p))]
        want[g] = features.SPLITS[s]
    assert {r["gene"]: r["split"] for r in features.assign_group_splits(d).select("gene", "split").distinct().collect()} == want


def test_identifiers_and_plans(spark):
    d = spark.createDataFrame([("1:5000:T:C", "KIN7", "NM_004444.5(KIN7):c.88T>C (p.Ser30Pro)", [("dbSNP", "rs77001")], "S30P", ["NC_000001.11:4999:T:C"], ["Some trait"])], "variant_key string, gene string, title string, xrefs array<struct<database: string, identifier: string>>, protein_change string, spdi array<string>, trait_names array<string>")
    ids = evidence.extract_identifiers(d)
    r = ids.first()
    assert r["rsids"] == ["rs77001"] and r["hgvs"] == ["c.88T>C", "p.Ser30Pro"] and r["coordinates"]["pos"] == 5000
    plans = evidence.build_search_plans(ids).orderBy("place").collect()
    assert plans[0]["query"] == '"rs77001"[Title/Abstract]' and len(plans) == 4


def test_identity(spark):
    d = spark.createDataFrame([("2:900:C:T", "G", 7, ["g"], 7, 7, None, "found", ["NC_000002.12:899:C:T"]), ("2:900:C:T", "G", 7, ["X"], 7, 7, None, "found", ["NC_000002.12:899:C:T"]), ("VCV7", "G", 7, ["G"], 7, 7, None, "found", [])], "variant_key string, gene string, clinvar_variation_id long, genes array<string>, variation_id long, source_variation_id long, accession string, status string, canonical_spdi array<string>")
    got = [(r["identity"], r["method"], r["identity_issues"]) for r in claims.identity_check(d).collect()]
    assert got == [("verified", "grch38_snv_spdi", []), ("blocked", "grch38_snv_spdi", ["clinvar_gene_mismatch"]), ("verified", "variation_id_key", [])]


def test_group_splits_deal_the_tail(spark):
    """Many small groups beside three large ones: the splits fill up to one small group, and groups stay whole."""
    rows = [(f"big{k}", j % 2) for k in range(3) for j in range(400)] + [(f"g{k}", (k + j) % 2) for k in range(3000) for j in range(1 + k % 4)] + [(None, 1)] * 3
    d = spark.createDataFrame(rows, "gene string, label int")
    got = features.assign_group_splits(d, large=50)
    assert got.count() == len(rows) and got.groupBy("gene").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    have = {r["split"]: r for r in features.split_summary(got).collect()}
    for split, share in zip(features.SPLITS, (0.70, 0.15, 0.15)):
        assert abs(have[split]["variants"] - share * len(rows)) <= 4
        assert abs(have[split]["positives"] / have[split]["variants"] - sum(x for _, x in rows) / len(rows)) < 0.06


def test_quantiles_beside_numpy(spark, monkeypatch):
    """Order statistics by sketch and brackets: ties, skew, few rows, nulls, NaN, infinite values, and brackets that have to be split again."""
    rng = np.random.default_rng(3)
    n = 30_000
    table = {"even": rng.random(n), "ties": rng.integers(0, 4, n).astype(float), "skew": np.exp(rng.normal(0, 30, n)), "same": np.full(n, 2.5), "wide": np.concatenate([[-1e308, 1e308, np.inf, -np.inf], rng.normal(0, 1, n - 4)])}
    d = spark.createDataFrame(pd.DataFrame(table))
    d = d.withColumn("rare", F.when(F.col("even") < 0.0005, F.col("skew"))).withColumn("none", F.lit(None).cast("double")).withColumn("nan", F.when(F.col("even") > 0.5, F.lit(float("nan"))).otherwise(F.col("even")))
    at = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    pdf = d.toPandas()
    for values in (features.VALUES, 3):
        monkeypatch.setattr(features, "VALUES", values)
        got = features.quantiles(d, {c: F.col(c) for c in d.columns}, {c: at for c in d.columns})
        assert got.pop("none") is None
        for c, v in got.items():
            x = pdf[c].to_numpy()
            x = np.sort(x[~np.isnan(x)])
            t = [p * (len(x) - 1) for p in at]
            want = [x[int(np.floor(k))] if x[int(np.floor(k))] == x[int(np.ceil(k))] else (np.ceil(k) - k) * x[int(np.floor(k))] + (k - np.floor(k)) * x[int(np.ceil(k))] for k in t]
            assert list(v) == pytest.approx(want, rel=1e-12, nan_ok=True), c


def test_first_rows_beside_sorting(spark, monkeypatch):
    rows = [(f"k{k % 700:04d}{'x' * (k % 3)}", (k * 37) % 5 if k % 50 else None) for k in range(3000)]
    d = spark.createDataFrame(rows, "variant_key string, code int")
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for ties in (features.TIES, 2):
        monkeypatch.setattr(features, "TIES", ties)
        for n in (0, 1, 59, 60, 61, 777, 2999, 3000, 4000):
            got = sorted(tuple(r) for r in features.seeded_sample(d, n, code=F.col("code")).collect())
            assert got == sorted(order[:n], key=lambda r: (r[0], r[1] is not None, r[1] or 0)) or sorted(map(str, got)) == sorted(map(str, order[:n]))
    sizes = {r["label"]: r["n"] for r in features.balanced_sample(d.withColumn("label", (F.col("code") == 0).cast("int")), 1000).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 500, 1: 500}


def test_published_model_beside_a_loop(spark):
    from triage_spark.plans.scoring_queries import F16, PUBLISHED

    rng = np.random.default_rng(4)
    x = rng.integers(-127, 128, (50, 16))
    d = spark.createDataFrame(pd.DataFrame(x, columns=list(F16)).assign(k=range(50)))
    d = d.withColumn("f3", F.when(F.col("k") != 7, F.col("f3")))

    def score(v):
        for w, b in list(zip(PUBLISHED.weights, PUBLISHED.biases))[:-1]:
            v = [min(max((sum(p * q for p, q in zip(row, v)) + c + (1 << PUBLISHED.qshift - 1)) >> PUBLISHED.qshift, 0), 127) for row, c in zip(w, b)]
        return sum(p * q for p, q in zip(PUBLISHED.weights[-1][0], v)) + PUBLISHED.biases[-1][0]

    for rows in (7, 2048):
        got = {r["k"]: r["score"] for r in scoring.arrow_scores(d, PUBLISHED, rows).collect()}
        assert got == {k: None if k == 7 else score([int(y) for y in x[k]]) for k in range(50)}


def test_info_is_read_once(spark):
    """Flags, repeats, empty values, keys that begin alike; and one parse in the plan of a cohort."""
    text = ["A=1;AB=2;A=3", "AB=2", "A=;AB=x=y", "A", None, "", "A=1;A="]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "k int, info_text string")
    got = {r["k"]: (r["info__"]["A"], r["info__"]["AB"]) for r in tables.with_info(rows, ("A", "AB")).collect()}
    assert got == {0: ("3", "2"), 1: (None, "2"), 2: (None, "x=y"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    maps = {r["k"]: r["m"] for r in rows.select("k", tables.parse_info(F.col("info_text")).alias("m")).collect()}
    assert maps == {0: {"A": "3", "AB": "2"}, 1: {"AB": "2"}, 2: {"A": "", "AB": "x=y"}, 3: {"A": "true"}, 4: None, 5: {}, 6: {"A": ""}}
    vcf, _ = tables.parse_vcf(spark.createDataFrame([(line,) for line in VCF], "value string"))
    plan = cohort.build_cohort(vcf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(line") == 1 and plan.count("split(info_text") == 1


def block_compressed(text: bytes, size: int) -> bytes:
    """Text in gzip blocks of `size` bytes with their own size in the header, and the empty block that ends such a file."""
    out = b""
    for part in [*(text[k : k + size] for k in range(0, len(text), size)), b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_block_compressed_text_splits(spark, tmp_path):
    """Every line once, wherever the splits fall."""
    rng = np.random.default_rng(1)
    lines = ["x" * int(n) + str(k) for k, n in enumerate(rng.integers(0, 300, 120))] + ["", "no line end"]
    path = str(tmp_path / "t.gz")
    for size, split in ((100, 1), (37, 11), (5000, 700), (64, 1 << 20), (1 << 15, 5)):
        (tmp_path / "t.gz").write_bytes(block_compressed("\n".join(lines).encode(), size))
        total = (tmp_path / "t.gz").stat().st_size
        got = [line.decode() for at in range(0, total, split) for line in blocks.lines_between(path, at, min(at + split, total))]
        assert got == lines
    (tmp_path / "t.gz").write_bytes(block_compressed("\n".join(lines).encode(), 300))
    read = blocks.read_lines(spark, path, 1000)
    assert sorted(r["value"] for r in read.collect()) == sorted(lines) and read.rdd.getNumPartitions() >= 3


def test_block_compressed_tables(spark, tmp_path):
    head, rows = "#chr\tpos\tgene\tx", [f"{k % 3}\t{k}\tG{k % 7}\t." for k in range(500)]
    (tmp_path / "d.gz").write_bytes(block_compressed("\n".join([head, *rows, ""]).encode(), 200))
    path = str(tmp_path / "d.gz")
    got = tables.read_dbnsfp(spark, path, ["gene", "chr"])
    assert got.columns == ["gene", "chr"] and sorted(map(tuple, got.collect())) == sorted((f"G{k % 7}", str(k % 3)) for k in range(500))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert blocks.read_columns(spark, path, ["chr", "pos"], 300).filter("chr = '1'").count() == 167
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError, match="lacks columns: no"):
        tables.read_dbnsfp(spark, path, ["no"])
    (tmp_path / "ragged.gz").write_bytes(block_compressed("\n".join([head, rows[0], "1\t2"]).encode(), 200))
    with pytest.raises(Exception, match="a row of 2 fields"):
        tables.read_dbnsfp(spark, str(tmp_path / "ragged.gz"), ["chr"]).collect()
    (tmp_path / "v.vcf.gz").write_bytes(block_compressed("\n".join(VCF).encode(), 90))
    (tmp_path / "v.vcf").write_text("\n".join(VCF))
    split, whole = (tables.read_vcf(spark, str(tmp_path / n), with_rejects=True) for n in ("v.vcf.gz", "v.vcf"))
    for a, b in zip(split, whole):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    (tmp_path / "plain.vcf.gz").write_bytes(gzip.compress("\n".join(VCF).encode()))
    assert tables.read_vcf(spark, str(tmp_path / "plain.vcf.gz"), with_rejects=True)[0].count() == whole[0].count()


def test_reply_state_is_bounded_and_restarts(spark, tmp_path):
    """Counters go on from the checkpoint; blocks older than the horizon go, so that a sparse stream keeps few of them."""
    source, rows = tmp_path / "in", []
    schema = "stream_id bigint, sequence bigint, arrived timestamp"

    def more(part: list[tuple[int, int, int]]) -> tuple[dict, int]:
        d = spark.createDataFrame(part, "stream_id bigint, sequence bigint, s bigint").select("stream_id", "sequence", F.timestamp_seconds("s").alias("arrived"))
        d.coalesce(1).write.mode("append").parquet(str(source))
        got = {}
        with streams.use_rocksdb(spark):
            q = streams.stream_reply_state(spark.readStream.schema(schema).parquet(str(source)), "100 seconds", "1 second").writeStream.outputMode("update")
            q = q.foreachBatch(lambda b, _: got.update({r["stream_id"]: tuple(r)[1:] for r in b.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        return got, max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:])

    got, _ = more([(1, 5, 10), (1, 4, 11), (1, 5, 12), (1, 6, 13), (2, 9, 10)])
    assert got == {1: (3, 1, 1), 2: (1, 0, 0)}
    got, _ = more([(1, 5, 20), (1, 3, 21)])  # a new query on the old checkpoint
    assert got == {1: (4, 2, 2)}
    sizes = []
    for k in range(4):  # sequences with gaps of a whole block, 50 seconds apart: old blocks go as new ones come
        _, size = more([(1, 10**6 + (10 * k + j) * 2 * streams.BLOCK, 100 + 500 * k + 50 * j) for j in range(10)])
        sizes.append(size)
    assert max(sizes) <= sizes[0] + 12 and sizes[-1] <= 30
    got, _ = more([(1, 5, 3000), (2, 9, 3001)])  # stream 2 was dropped after its silence, and 5 is no longer remembered
    assert got[2] == (1, 0, 0) and got[1][1] == 2


class _Store:
    """A state variable of one stream that counts the calls."""

    def __init__(self):
        self.value, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*a):
            self.calls += 1
            if name in ("get", "getValue"):
                return self.value.get(a)
            if name in ("exists", "containsKey"):
                return (a or ()) in self.value
            if name in ("update", "updateValue"):
                self.value[a[:-1]] = a[-1]
            return iter([])

        return call


def test_reply_state_reads_pages_not_replies():
    """A few calls to the state store for a batch, though no two replies share a block; counters as in plain Python."""
    state, stores = streams.ReplyState(10**9), []
    handle = _Store()
    handle.getValueState = handle.getMapState = lambda *_: stores.append(_Store()) or stores[-1]
    state.init(handle)
    rng, seen, want, previous = np.random.default_rng(4), set(), [0, 0, 0], None
    for start in (0, 5000):
        sequence = rng.integers(-100, 100, 200) * streams.BLOCK + rng.integers(0, 2, 200) * 7
        rows = pd.DataFrame({"sequence": sequence, "arrived": pd.to_datetime(start + rng.permutation(200), unit="ms")})
        before = handle.calls + sum(s.calls for s in stores)
        got = next(iter(state.handleInputRows((1,), iter([rows[:90], rows[90:]]), None))).iloc[0].tolist()
        assert handle.calls + sum(s.calls for s in stores) - before <= 10
        for s in rows.sort_values("arrived").sequence:
            if s in seen:
                want[1] += 1
            else:
                want[0], want[2], previous = want[0] + 1, want[2] + (previous is not None and s < previous), s
                seen.add(s)
        assert got == [1, *want]


def test_a_hot_stream_is_many_windows(spark):
    """90 % of the rows in one stream: the row before and exact quantiles as in plain Python, over several tasks."""
    rng = np.random.default_rng(6)
    n = 4000
    rows = pd.DataFrame({"stream_id": np.where(rng.random(n) < 0.9, 1, rng.integers(2, 30, n)), "sequence": rng.permutation(n), "arrival": np.round(rng.random(n) * 500, 2), "reply_id": np.arange(n)})
    rows["sent"] = rows.arrival - rng.random(n)
    d = spark.createDataFrame(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = replies.before_in_stream(d, "stream_id", ["arrival", "reply_id"], "sequence", "before")
        assert out.filter("stream_id = 1").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = rows.sort_values(["stream_id", "arrival", "reply_id"])
    want["before"] = want.groupby("stream_id").sequence.shift()
    assert {r["reply_id"]: r["before"] for r in out.collect()} == {k: None if np.isnan(b) else int(b) for k, b in zip(want.reply_id, want.before)}
    got = {r["stream_id"]: r for r in replies.timing_statistics(d, arrived="arrival").collect()}
    for stream, part in rows.sort_values(["arrival", "sequence"]).groupby("stream_id"):
        latency, spacing = part.arrival - part.sent, part.arrival.diff().dropna()
        assert got[stream]["samples"] == len(part) and got[stream]["spacings"] == len(spacing)
        for c, x in (("latency", latency), ("spacing", spacing)):
            assert [got[stream][f"{c}_{k}"] for k in ("median", "p95", "max")] == (pytest.approx([x.quantile(0.5), x.quantile(0.95), x.max()], abs=2e-6) if len(x) else [None] * 3)
    batches = replies.batch_requests(d.withColumn("score", F.lit(1)), 32, key="sequence").collect()
    assert sorted((r["batch"], r["first_sequence"], len(r["rows"])) for r in batches) == [(k, 32 * k, 32) for k in range(125)]


def test_annotation_join_sums_the_source_up_first(spark):
    v = spark.createDataFrame([("a", "g1", 1), ("b", "g2", 1), ("c", "g9", 1), ("d", "g1", 2), ("e", None, 1)], "variant_key string, gene string, slot int")
    s = spark.createDataFrame([(1, None, 3), (1, "G3;G1", 5), (1, "g1 ; g1", 7), (1, "G2", 6), (1, "G2", 9)], "slot int, genename string, place int")
    d = cohort.join_variant_annotations(v, s, "place", on=("slot",))
    assert {r["variant_key"]: (r["dbnsfp_match"], r["place"]) for r in d.collect()} == {"a": (True, 5), "b": (True, 6), "c": (True, 3), "d": (False, None), "e": (True, 3)}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.rindex("Join") < plan.index("Aggregate")  # no pairs of variants and source rows


def reads(spark, run):
    """What run() returns, and how many rows its jobs read from a table of 1,000 rows, counted by an accumulator-like column."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.range(1000).selectExpr("concat('k', lpad(id, 4, '0')) AS variant_key", "cast(id % 2 AS int) AS label", "id AS code", "cast(id AS string) AS variation_id", "'g' AS gene", "'test' AS split", "cast(id % 7 AS int) AS score")
    out = run(d.mapInArrow(count, d.schema))
    return out, seen.value


def test_checks_and_samples_read_their_input_a_few_times(spark, tmp_path):
    """A table that is dear to make is not made anew for each pass."""
    rows, n = reads(spark, lambda d: features.balanced_sample(d, 100, code=F.col("code")).collect())
    assert sorted(r["code"] for r in rows) == list(range(100)) and n <= 2000
    one, n = reads(spark, lambda d: scoring.evaluation_report(d, 3, 2).collect())
    assert one[0]["genes"] == 1 and n == 1000
    vcf = spark.range(1000).selectExpr("concat('k', lpad(id, 4, '0')) AS variant_key", "concat('v', id) AS variation_id", "cast(id AS string) AS allele_id", "array('g') AS genes")
    both, n = reads(spark, lambda d: cohort.repair_identifiers(d.withColumn("allele_id", F.lit("")), vcf)[0].collect())
    assert len(both) == 1000 and n == 1000
    ten, n = reads(spark, lambda d: cohort.complete_one_to_one_join(d.select("variant_key", "code"), vcf.select("variant_key", "allele_id")).collect())
    assert len(ten) == 1000 and n == 2000


def test_resumed_extract_writes_a_file_per_chunk(spark, tmp_path):
    d, path = spark.range(100).selectExpr("concat('k', id) AS variant_key", "id").repartition(4), str(tmp_path / "x")
    done = cohort.resumable_extract(d, lambda x: x, path, chunks=4)
    files = sorted(done.inputFiles())
    assert len(files) == 4
    assert sorted(cohort.resumable_extract(d, lambda x: x, path, chunks=4).inputFiles()) == files  # nothing is written again


def test_validate_dataset_counts(spark):
    rows = [("a", "train", 0, 1), ("b", "train", 1, 2), ("c", "validation", 0, None), ("c", "test", 2, 300), (None, None, 1, 0)]
    r = features.validate_dataset(spark.createDataFrame(rows, "variant_key string, split string, label int, f int"), ["f"]).first()
    assert r["errors"] == ["repeated keys", "labels outside 0 and 1", "null features", "features out of range", "a split without both classes"] and r["rows"] == 5
    assert [tuple(x) for x in r["per_split"]] == [(None, 1, 1), ("test", 1, 0), ("train", 2, 1), ("validation", 1, 0)]
    empty = features.validate_dataset(spark.createDataFrame([], "variant_key string, split string, label int, f int"), ["f"]).first()
    assert empty["rows"] == 0 and empty["errors"] == ["wrong splits", "a split without both classes"]


def test_cache_plan_has_no_single_task_sort(spark):
    d = spark.range(300).selectExpr("concat('text ', id % 200) AS text")
    cache = d.limit(50).select(claims.request_key(d, ["text"]).alias("request_key"))
    wanted = sorted(r[0] for r in d.distinct().select(claims.request_key(d, ["text"])).collect())
    known = {r[0] for r in cache.collect()}
    plan = claims.response_cache_plan(d, cache, ["text"], 40)
    assert sorted(r["request_key"] for r in plan.collect()) == [k for k in wanted if k not in known][:40]
    whole = claims.response_cache_plan(d, cache, ["text"], 10_000)
    assert whole.count() == len(wanted) - len(known)
    text = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit 10000" not in text and "LocalLimit 10000" not in text


def test_texts_of_sources_are_hashed_before_a_shuffle(spark):
    s = spark.createDataFrame([("v", "abstract:1", "abstract", "a text", "exact_variant", False, "1")], "variant_key string, source_id string, kind string, text string, scope string, truncated boolean, pmid string")
    a = spark.createDataFrame([("v", "2", "", True, 1, 0)], "variant_key string, pmid string, abstract string, abstract_conflict boolean, place int, omitted bigint")
    p = claims.build_packages(spark.createDataFrame([("v", "verified")], "variant_key string, identity string"), s, a)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("LeftAnti") < plan.index("sha2(cast(text") and p.first()["sources"][0]["source_id"] == "abstract:1"


def test_batch_frames_are_parsed_once(spark):
    """No filter on the size of the scores, into which the whole parse is written out again."""
    frame = F.unhex(F.concat(F.lit("0102"), F.lpad(F.hex("id"), 8, "0"), F.lit("0200"), F.lit("0000000501" + "01"), F.lit("FFFFFFFB0001")))
    d = tables.decode_batch_frames(spark.range(3).select("id", frame.alias("frame")), -276)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("octet_length") == 2
    assert sorted(tuple(r)[2:] for r in d.filter("id = 2").collect()) == [(2, 0, 5, 1, 1, None), (2, 1, -5, 0, 1, None)]


def test_feature_tables_make_code_that_the_jvm_compiles(spark):
    """Methods of more than 8,000 bytes of code are never compiled; splits are a table of known size, so no row is shuffled for them."""
    raws = dict.fromkeys(f.raw[0] for f in features.CONTRACT)
    columns = [F.when(F.col("id") % 7 != 0, (F.col("id") % 50) / 40).alias(c) if c != "interpro_domain_status" else F.lit("no").alias(c) for c in raws]
    d = spark.range(400).select(F.concat(F.lit("v"), "id").alias("variant_key"), F.concat(F.lit("g"), F.col("id") % 9).alias("gene"), *columns)
    splits = d.select("gene").distinct().withColumn("split", F.when(F.col("gene") < "g5", "train").otherwise("test"))
    model, made = features.build_feature_tables(d, splits)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kind in ("float", "int8"):
            plan = made[kind].select("*")._jdf.queryExecution().executedPlan()
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
            assert max(int(x.split(")")[0].split(";")[0]) for x in code.split("maxMethodCodeSize:")[1:]) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    wanted = {f.id: F.coalesce(features.transform_feature(f, model.bounds.get(f.id), d), F.lit(model.medians[f.id])).cast("float").alias(f.id) for f in features.CONTRACT}
    for kind, finish in (("float", lambda c: c), ("int8", V.encode_int8)):
        plain = d.select("variant_key", *[finish(c).alias(k) for k, c in wanted.items()])
        assert sorted(map(tuple, made[kind].select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
