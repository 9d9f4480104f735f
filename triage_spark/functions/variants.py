"""Scalar rules of variants as Column expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Significance classes, the missense term, missing tokens, id column names in order of preference.
POSITIVE = ("pathogenic", "likely_pathogenic", "pathogenic/likely_pathogenic")
NEGATIVE = ("benign", "likely_benign", "benign/likely_benign")
MISSENSE_SO = "SO:0001583"
MISSING = ("", ".", "NA", "nan", "None")
ID_COLUMNS = ("clinvar_variation_id", "variation_id", "variationid", "clinvar_id", "VariationID", "ID")


def underscored(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def normalize_chrom(c: Column) -> Column:
    """Without blanks and 'chr'; M, MT and chrM all give MT."""
    bare = F.regexp_replace(F.trim(c), "(?i)^chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), "MT").otherwise(bare)


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", normalize_chrom(chrom), pos.cast("string"), F.upper(ref), F.upper(alt))


def is_snv(filter_: Column, ref: Column, alt: Column) -> Column:
    """FILTER passed and exactly one base on either side."""
    return filter_.isin("PASS", ".") & ref.rlike("(?i)^[ACGT]$") & alt.rlike("(?i)^[ACGT]$")


def is_missense(consequence: Column) -> Column:
    """The molecular consequence (MC) of INFO names the missense term; null: no."""
    mc = F.coalesce(consequence, F.lit(""))
    return mc.contains(MISSENSE_SO) | F.lower(mc).contains("missense_variant")


def classify_significance(c: Column) -> Column:
    n = underscored(c)
    return F.when(n.isin(*POSITIVE), 1).when(n.isin(*NEGATIVE), 0).cast("int")


def review_stars(c: Column) -> Column:
    n = F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    return (
        F.when(n.contains("no_assertion_criteria_provided") | n.contains("no_assertion_provided"), 0)
        .when(n.contains("practice_guideline"), 4)
        .when(n.contains("reviewed_by_expert_panel"), 3)
        .when(n.contains("multiple_submitters") & n.contains("no_conflicts"), 2)
        .when(n.contains("criteria_provided"), 1)
        .otherwise(0)
    )


def allele_value(c: Column, index: Column, count: Column) -> Column:
    """The allele's item where the list is as long as there are alleles; else the text as it is; null: empty."""
    items = F.split(c, ",")
    return F.coalesce(F.when(F.size(items) == count, F.get(items, index)).otherwise(c), F.lit(""))


def unique_gene(c: Column) -> Column:
    """The one distinct symbol of SYM:ID entries, else null."""
    symbols = F.array_distinct(F.filter(F.transform(F.split(c, r"\|"), lambda e: F.trim(F.split(e, ":")[0])), lambda s: s != ""))
    return F.when(F.size(symbols) == 1, F.get(symbols, F.lit(0)))


def parse_variation_id(c: Column) -> Column:
    """A positive id from 12, 12.0, VCV000000012.4 or a labelled form like 'variation: 12'; else null."""
    text = F.trim(c.cast("string"))
    forms = (r"^(\d+)(?:\.0+)?$", r"(?i)^VCV0*(\d+)(?:\.\d+)?$", r"(?i)^(?:clinvar|variation)[ _-]*(?:variation)?[ _-]*(?:id)?\s*[:=#]?\s*(\d+)$")
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, f, 1), F.lit("")) for f in forms])
    number = found.try_cast("bigint")
    return F.when(number > 0, number)


def is_missing(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin(*MISSING)


def pick_aligned(c: Column, index: Column) -> Column:
    """The value of a ';' list at the transcript's index; one value is shared; past the end, the first."""
    items = F.split(c, ";")
    at = F.when((F.size(items) == 1) | (index >= F.size(items)), 0).otherwise(index)
    value = F.get(items, at)
    return F.when(~is_missing(value), F.trim(value))


def parse_number(c: Column) -> Column:
    """Text to double; missing tokens, bad text and NaN give null."""
    number = F.trim(c).try_cast("double")
    return F.when(~is_missing(c) & ~F.isnan(number), number)


def significance_group(c: Column) -> Column:
    n = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | (n == ""), "missing")
        .when(n.contains("conflict"), "conflicting")
        .when(n.contains("uncertain") | n.contains("vus"), "uncertain")
        .when(n.contains("benign"), "benign")
        .when(n.contains("pathogenic"), "pathogenic")
        .otherwise("other")
    )


def comparison_group(prediction: Column, group: Column) -> Column:
    same = ((group == "pathogenic") & (prediction == 1)) | ((group == "benign") & (prediction == 0))
    return F.when(~group.isin("pathogenic", "benign"), "not_binary_comparable").when(same, "same_binary_direction").otherwise("different_binary_direction")


def prediction(score: Column) -> Column:
    return (score >= 0).cast("int")


def apply_route(score: Column, threshold: int) -> Column:
    return F.when(score >= threshold, "deep").otherwise("light")


# Distances of each amino acid to those after it, in this order.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
DISTANCES = """
112 111 126 195 91 107 60 86 94 96 106 84 113 27 99 58 148 112 64
86 96 180 43 54 125 29 97 102 26 91 97 103 110 71 101 77 96
23 139 46 42 80 68 149 153 94 142 158 91 46 65 174 143 133
154 61 45 94 81 168 172 101 160 177 108 65 85 181 160 152
154 170 159 174 198 198 202 196 205 169 112 149 215 194 192
29 87 24 109 113 53 101 116 76 68 42 130 99 96
98 40 134 138 56 126 140 93 80 65 152 122 121
98 135 138 127 127 153 42 56 59 184 147 109
94 99 32 87 100 77 89 47 115 83 84
5 102 10 21 95 142 89 61 33 29
107 15 22 98 145 92 61 36 32
95 102 103 121 78 110 85 97
28 87 135 81 67 36 21
114 155 103 40 22 50
74 38 147 110 68
58 177 144 124
128 92 69
37 88
55
"""


# BLOSUM62, a row per amino acid, columns in the order of AMINO_ACIDS.
BLOSUM62 = """
A  4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
R -1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
N -2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
D -2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
C  0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
Q -1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
E -1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
G  0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
H -2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def substitution_rows() -> list[tuple[str, str, int, int]]:
    """(from, to, Grantham distance, BLOSUM62 score) of all 400 pairs; equal letters have distance 0."""
    distance = {}
    for k, row in enumerate(DISTANCES.split("\n")[1:-1]):
        for j, d in enumerate(row.split(), k + 1):
            distance[AMINO_ACIDS[k], AMINO_ACIDS[j]] = distance[AMINO_ACIDS[j], AMINO_ACIDS[k]] = int(d)
    lines = [line.split() for line in BLOSUM62.split("\n")[1:-1]]
    return [(line[0], to, distance.get((line[0], to), 0), int(x)) for line in lines for to, x in zip(AMINO_ACIDS, line[1:])]


def substitution_scores(df: DataFrame, ref: str = "aaref", alt: str = "aaalt") -> DataFrame:
    """Adds grantham_distance and blosum62_score by a join with the 400 pairs; other letters give null."""
    pairs = df.sparkSession.createDataFrame(substitution_rows(), "ref__ string, alt__ string, grantham_distance int, blosum62_score int")
    letter = lambda c: F.upper(F.trim(F.col(c)))
    return df.join(F.broadcast(pairs), (letter(ref) == F.col("ref__")) & (letter(alt) == F.col("alt__")), "left").drop("ref__", "alt__")


def resolve_id_column(columns: list[str], requested: str | None = None) -> str:
    """The column of variation ids: the requested one, which must be there, or the first of ID_COLUMNS that is."""
    found = [requested] if requested else [c for c in ID_COLUMNS if c in columns]
    if not found or found[0] not in columns:
        raise ValueError(f"no column {requested or ' or '.join(ID_COLUMNS)}")
    return found[0]


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def log_rarity(x: Column, floor: float, denominator: float) -> Column:
    return F.when(x >= 0, -F.log10(F.greatest(x, F.lit(floor))) / denominator)


def domain_ternary(c: Column) -> Column:
    n = F.lower(F.trim(c))
    return F.when(n.isin("overlap", "yes", "true", "1"), 1.0).when(n.isin("no_overlap", "no", "false", "0"), 0.0).otherwise(0.5)


def encode_int8(x: Column) -> Column:
    """clip(round half to even(254 x - 127), -127, 127) in float32."""
    y = F.rint(F.lit(254.0).cast("float") * x.cast("float") - F.lit(127.0).cast("float"))
    return F.when(x.isNotNull(), F.least(F.greatest(y, F.lit(-127.0)), F.lit(127.0))).cast("tinyint")


def requantize(h: Column, qshift: int = 4) -> Column:
    """Half-up shift with saturation: 0 below 0, at most 127; null stays null."""
    return F.when(h.isNotNull(), F.least(F.greatest(F.shiftright(h + (1 << (qshift - 1)), qshift), F.lit(0).cast("bigint")), F.lit(127).cast("bigint")))
