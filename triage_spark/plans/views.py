"""Views of the driver's tables that stand in for variant data: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "variants": """
        SELECT CAST(l_suppkey % 24 + 1 AS STRING) AS chrom, CAST(l_orderkey * 10 + l_linenumber AS INT) AS pos,
               substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS ref, substr('ACGT', CAST((l_partkey + 1) % 4 AS INT) + 1, 1) AS alt,
               'GENE' || CAST(l_partkey % 97 AS STRING) AS gene, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
               CAST(CASE WHEN l_partkey % 97 < 68 THEN 'train' WHEN l_partkey % 97 < 83 THEN 'validation' ELSE 'test' END AS STRING) AS split,
               l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
        FROM {lineitem}""",
    "keyed": """
        SELECT chrom || ':' || CAST(pos AS STRING) || ':' || ref || ':' || alt AS variant_key, v.* FROM {variants} v""",
    "unique_variants": """
        SELECT variant_key, chrom, pos, ref, alt, gene, label, split, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
        FROM (SELECT k.*, count(*) OVER (PARTITION BY variant_key) AS copies FROM {keyed} k) c WHERE copies = 1""",
    "raw16": """
        SELECT variant_key, gene, label, split, l_discount / 1000 AS gnomad_popmax_af, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS cadd_phred,
               l_discount * 10 AS revel_score, l_tax * 10 AS alphamissense_score, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_quantity / 50 END AS esm1b_rankscore,
               l_tax * 12 AS sift_score, l_discount AS polyphen2_hvar_score, l_quantity / 10 AS mpc_score, l_extendedprice / 10000 AS phylop_100way,
               l_tax * 5 AS phastcons_100way, l_extendedprice / 9000 - 3 AS gerp_rs, CAST(l_partkey % 216 AS DOUBLE) AS grantham_distance,
               CAST(l_partkey % 16 AS DOUBLE) - 4 AS blosum62_score, l_quantity / 25 AS gnomad_loeuf, l_extendedprice / 50000 AS gnomad_moeuf,
               CASE WHEN l_linestatus = 'F' THEN 'overlap' WHEN l_partkey % 7 = 0 THEN 'unknown' ELSE 'no_overlap' END AS interpro_domain_status
        FROM {keyed}""",
    "small16": """
        SELECT variant_key, gene, label, split, """
    + ", ".join(f"CAST((l_partkey * {k + 3} + l_suppkey * {k + 1} + CAST(l_quantity AS INT) * {2 * k + 1}) % 255 - 127 AS INT) AS f{k}" for k in range(16))
    + " FROM {keyed}",
    "scores": """
        SELECT variant_key, gene, label, split, CAST(l_suppkey AS INT) AS sup, CAST((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 5) % 2001 - 1000 + label * 300 AS INT) AS score, chrom, pos, ref, alt
        FROM {keyed}""",
    "routed": """
        SELECT s.*, CASE WHEN score >= -276 THEN 'deep' ELSE 'light' END AS route, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS prediction, CAST(abs(score) % 60 AS BIGINT) AS clinvar_variation_id FROM {scores} s""",
    "requests": """
        SELECT event_id AS sequence, user_id AS stream_id, CAST((event_id * 7919) % 4001 - 2000 AS INT) AS score, CAST(event_id AS DOUBLE) / 8 AS started FROM {events}""",
    "replies": """
        SELECT sequence, stream_id, CAST(score + CASE WHEN sequence % 19 = 0 THEN 1 ELSE 0 END AS INT) AS score, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS classification,
               CASE WHEN score >= -276 THEN 1 ELSE 0 END AS deep_review, started + CAST((sequence * 31) % 97 AS DOUBLE) / 16 AS arrival, sequence AS reply_id
        FROM {requests} WHERE sequence % 13 <> 0
        UNION ALL
        SELECT CASE WHEN sequence % 34 = 0 THEN -sequence ELSE sequence END, stream_id, score, CASE WHEN score >= 0 THEN 1 ELSE 0 END, CASE WHEN score >= -276 THEN 1 ELSE 0 END, started + 9, sequence + 100000000
        FROM {requests} WHERE sequence % 17 = 0""",
    "doc_rows": """
        SELECT doc_id, text, lang, source, 'GENE' || CAST(doc_id % 97 AS STRING) AS gene, '1:' || CAST(doc_id % 60 + 101 AS STRING) || ':A:G' AS variant_key FROM {documents}""",
}


def expand(sql: str) -> str:
    """The text with every {view} written out, for an engine that has only the tables."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else f"({expand(VIEWS[m[1]])})", sql)


class Views:
    """Tables and views of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(VIEWS[name])
        return self._made[name]

    def folder(self, name: str, make) -> str:
        key = f"folder {name}"
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def made(self, name: str, make, path: str) -> DataFrame:
        """make() written to path, the first time it is asked for, and read from there."""
        key = f"stored {name}"
        if key not in self._made:
            make().write.parquet(path)
            self._made[key] = self.spark.read.parquet(path)
        return self._made[key]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})


REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Register a query with its SQL twin; one without (group splits, with ties by hash) is held against plain Python in the tests."""

    def wrap(f):
        REGISTRY[name] = (f, sql)
        return f

    return wrap
