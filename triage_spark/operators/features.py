"""Splits, the feature contract, fitting and encoding, data checks and exact samples."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage_spark.functions import variants as V
from triage_spark.sources.scratch import forget, stored

SPLITS = ("train", "validation", "test")
LARGE = 20_000  # a group of at least this part of all rows is placed greedily; there are at most so many
TAIL_RANGES = 65_536  # ranges of the tail's hashes


def assign_group_splits(df: DataFrame, group: str = "gene", label: str = "label", fractions: tuple[float, ...] = (0.70, 0.15, 0.15), seed: int = 42, large: int = LARGE) -> DataFrame:
    """Whole groups to splits by the least fill: 0.5 rows + 0.25 positives + 0.25 negatives, each against its target.

    Groups of at least 1 / large of all rows (so at most `large` groups, whatever the data) are placed one by one,
    largest first, ties by hash; the first three seed one split each. The tail, of smaller groups, is dealt in the order of its hashes:
    running row counts, by ranges of the hash and then inside them, are cut where each split's share of the rows is full.
    A cut falls at most one tail group beside its target, so a split has its share of the tail's rows but for
    1 / large of all rows, and of the labels as a random order of groups gives it. Rows of a null group
    stay together as any other group.
    """
    totals = stored(df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).withColumn("tie", F.xxhash64(group, F.lit(seed))))
    every = totals.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    all_rows, all_of = every["n"] or 0, (every["n"] or 0, every["pos"] or 0, (every["n"] or 0) - (every["pos"] or 0))
    is_large = F.col("n") * large >= all_rows
    head = totals.filter(is_large).select("n", "pos", "tie", group).collect()  # at most `large` rows
    fill = [[0.0, 0.0, 0.0] for _ in fractions]
    placed = []
    for k, r in enumerate(sorted(head, key=lambda r: (-r["n"], r["tie"]))):
        n, pos = r["n"], r["pos"] or 0
        share = [sum(w * f / (fr * t) for w, f, t in zip((0.5, 0.25, 0.25), own, all_of) if t) for own, fr in zip(fill, fractions)]
        at = k if k < len(fractions) else min(range(len(fractions)), key=lambda i: (share[i], i))
        for j, v in enumerate((n, pos, n - pos)):
            fill[at][j] += v
        placed.append((r[group], SPLITS[at]))
    chosen = df.sparkSession.createDataFrame(placed, T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("split", T.StringType())]))
    left = [max(fr * all_rows - own[0], 0.0) for fr, own in zip(fractions, fill)]
    tail_rows = all_rows - sum(own[0] for own in fill)
    if tail_rows:
        cuts = [sum(left[: k + 1]) / sum(left) * tail_rows for k in range(len(left) - 1)]
        tail = totals.filter(~is_large).withColumn("range", F.pmod("tie", F.lit(TAIL_RANGES)))
        ranges = tail.groupBy("range").agg(F.sum("n").alias("rows"))  # TAIL_RANGES rows at most, so one task may add them up
        offset = ranges.select("range", (F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
        inside = F.sum("n").over(Window.partitionBy("range").orderBy("tie", group).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        middle = F.col("before") + F.col("inside") + F.col("n") / 2
        which = F.lit(SPLITS[len(fractions) - 1])
        for k in reversed(range(len(cuts))):
            which = F.when(middle < cuts[k], SPLITS[k]).otherwise(which)
        chosen = chosen.unionByName(tail.withColumn("inside", inside).join(F.broadcast(offset), "range").select(group, which.alias("split")))
    right = chosen.withColumnRenamed(group, "group__")
    return df.join(right, df[group].eqNullSafe(F.col("group__"))).drop("group__")


def assign_hash_splits(df: DataFrame, group: str = "gene", fractions: tuple[float, ...] = (0.70, 0.15, 0.15), seed: int = 42, code: Column | None = None) -> DataFrame:
    """Whole groups to splits by hash; no shuffle. `code` (0 to 9999) may replace the hash."""
    at = code if code is not None else F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(10_000))
    a, b = round(10_000 * fractions[0]), round(10_000 * (fractions[0] + fractions[1]))
    return df.withColumn("split", F.when(at < a, "train").when(at < b, "validation").otherwise("test"))


def split_summary(df: DataFrame, group: str = "gene", label: str = "label") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("variants"), F.countDistinct(group).alias("genes"), F.sum(F.col(label).cast("long")).alias("positives"))


@dataclass(frozen=True)
class Feature:
    id: str
    raw: tuple[str, ...]
    transform: str
    params: dict = field(default_factory=dict)


# The feature contract, in order.
CONTRACT = (
    Feature("gnomad_popmax_rarity", ("gnomad_popmax_af",), "log_rarity", {"floor": 1e-6, "denominator": 6.0}),
    Feature("cadd_phred", ("cadd_phred",), "clip_scale", {"denominator": 50.0}),
    Feature("revel_score", ("revel_score",), "identity"),
    Feature("alphamissense_score", ("alphamissense_score",), "identity"),
    Feature("esm1b_deleteriousness", ("esm1b_rankscore",), "identity"),
    Feature("sift_deleterious", ("sift_score",), "reverse_identity"),
    Feature("polyphen2_hvar", ("polyphen2_hvar_score",), "identity"),
    Feature("mpc_score", ("mpc_score",), "clip_scale", {"denominator": 5.0}),
    Feature("phylop_100way", ("phylop_100way",), "robust_percentile", {"lower": 0.01, "upper": 0.99}),
    Feature("phastcons_100way", ("phastcons_100way",), "identity"),
    Feature("gerp_rs", ("gerp_rs",), "robust_percentile", {"lower": 0.01, "upper": 0.99}),
    Feature("grantham_distance", ("grantham_distance",), "clip_scale", {"denominator": 215.0}),
    Feature("blosum62_unfavorability", ("blosum62_score",), "reverse_range", {"minimum": -4.0, "maximum": 11.0}),
    Feature("gnomad_moeuf_intolerance", ("gnomad_moeuf",), "reverse_robust_percentile", {"lower": 0.01, "upper": 0.99}),
    Feature("gnomad_loeuf_intolerance", ("gnomad_loeuf",), "reverse_robust_percentile", {"lower": 0.01, "upper": 0.99}),
    Feature("interpro_domain_hit", ("interpro_domain_status",), "domain_ternary"),
)


def load_contract(entries: list[dict]) -> tuple[Feature, ...]:
    """A contract from parsed entries (index, id, raw_columns, transform, parameters); indices must be 0..n-1."""
    if [e["index"] for e in entries] != list(range(len(entries))):
        raise ValueError("feature indices must be 0..n-1 in order")
    names = {"lower_percentile": "lower", "upper_percentile": "upper"}
    skip = {"index", "id", "raw_columns", "transform", "missing"}
    return tuple(Feature(e["id"], tuple(e["raw_columns"]), e["transform"], {names.get(k, k): v for k, v in e.items() if k not in skip}) for e in entries)


def number(name: str, df: DataFrame | None = None) -> Column:
    """A raw column as a number; one that `df` holds as a number already is not read as text."""
    if df is not None and isinstance(df.schema[name].dataType, T.NumericType):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return V.parse_number(F.col(name).cast("string"))


def raw_number(df: DataFrame, f: Feature) -> Column:
    return number(f.raw[0], df)


def transform_feature(f: Feature, bounds: tuple[float, float] | None = None, train: DataFrame | None = None) -> Column:
    """The feature's raw columns to [0, 1], null kept; `train` tells which of them are numbers already."""
    return V.clip01(unclipped(f, bounds, train))


def unclipped(f: Feature, bounds: tuple[float, float] | None = None, train: DataFrame | None = None) -> Column:
    p = f.params
    if f.transform == "domain_ternary":
        return V.domain_ternary(F.col(f.raw[0]))
    x = number(f.raw[0], train)
    if f.transform == "row_max":
        x = F.greatest(*[number(r, train) for r in f.raw]) if len(f.raw) > 1 else x
    elif f.transform == "reverse_identity":
        x = 1 - x
    elif f.transform == "clip_scale":
        x = x / p["denominator"]
    elif f.transform == "log_rarity":
        x = V.log_rarity(x, p["floor"], p["denominator"])
    elif f.transform == "reverse_range":
        x = (p["maximum"] - x) / (p["maximum"] - p["minimum"])
    elif f.transform.endswith("robust_percentile"):
        lo, hi = bounds
        x = (x - lo) / (hi - lo)
        x = 1 - x if f.transform.startswith("reverse") else x
    elif f.transform != "identity":
        raise ValueError(f"unknown transform: {f.transform}")
    return x


ACCURACY = 10_000  # of the sketch: 1 / ACCURACY of the rows is the most by which a rank is off
VALUES = 50_000  # distinct values that the last pass brings to the driver


@dataclass
class Bracket:
    """A range of one column's values that holds the rows of some ranks (from 0, among the column's values)."""

    column: int
    ranks: list[int]
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0

    def has(self, x: Column) -> Column:
        return x.isNotNull() if self.low == -math.inf and self.high == math.inf else x.between(self.low, self.high)


def order_statistics(df: DataFrame, columns: list[str], wanted: dict[str, tuple[float, ...]]) -> dict[str, list[tuple[float, float, float]]]:
    """For each column and share p the exact values around rank p * (n - 1): (rank, value below it, value above it).

    columns: doubles; nulls do not count. One pass sketches all columns together (mergeable quantile summaries) and so brackets
    every rank; a second counts what lies under and in the brackets; a third reads the few values in them. Only where ties or a wide
    bracket leave more than VALUES distinct values, the bracket itself is sketched again. A column without values has none.
    """
    slack = 2 / ACCURACY
    edges = lambda p: (max(0.0, p - slack), min(1.0, p + slack))
    col = [F.col(f"`{c}`") for c in columns]
    sketch = df.agg(*[F.count(x).alias(f"n{k}") for k, x in enumerate(col)], *[F.percentile_approx(x, [e for p in wanted[c] for e in edges(p)], ACCURACY).alias(f"s{k}") for k, (c, x) in enumerate(zip(columns, col))]).first()
    due = []
    for k, c in enumerate(columns):
        for j, p in enumerate(wanted[c] if sketch[f"n{k}"] else ()):
            at = p * (sketch[f"n{k}"] - 1)
            due.append(Bracket(k, sorted({math.floor(at), math.ceil(at)}), sketch[f"s{k}"][2 * j], sketch[f"s{k}"][2 * j + 1]))
    value: dict[tuple[int, int], float] = {}
    most = VALUES
    while due:
        count = df.agg(*[F.count_if(col[b.column] < b.low).alias(f"b{j}") for j, b in enumerate(due)], *[F.count_if(b.has(col[b.column])).alias(f"i{j}") for j, b in enumerate(due)]).first()
        rest = []
        for j, b in enumerate(due):
            b.below, b.inside = count[f"b{j}"], count[f"i{j}"]
            if b.ranks[0] < b.below or b.ranks[-1] >= b.below + b.inside:  # the sketch missed it: every rank is found in the whole
                rest.append(Bracket(b.column, b.ranks))
            elif b.low == b.high:
                value |= {(b.column, r): b.low for r in b.ranks}
            else:
                rest.append(b)
        due = rest
        if not due or any(b.inside == 0 for b in due):
            continue
        held = F.array_compact(F.array(*[F.when(b.has(col[b.column]), F.struct(F.lit(j).alias("j"), col[b.column].alias("x"))) for j, b in enumerate(due)]))
        few = df.select(F.explode(held).alias("v")).groupBy("v.j", "v.x").count().limit(most + 1).collect()
        if len(few) <= most:
            for j, b in enumerate(due):
                at, own = b.below, iter(sorted((r["x"], r["count"]) for r in few if r["j"] == j))
                x, n = next(own)
                for rank in b.ranks:
                    while rank >= at + n:
                        at += n
                        x, n = next(own)
                    value[b.column, rank] = x
            break
        most *= 2  # a bracket shrinks by far more than that a round, down to the values of its ranks
        inner = [F.percentile_approx(F.when(b.has(col[b.column]), col[b.column]), list(edges((b.ranks[0] - b.below) / max(b.inside - 1, 1))[:1] + edges((b.ranks[-1] - b.below) / max(b.inside - 1, 1))[1:]), ACCURACY).alias(f"s{j}") for j, b in enumerate(due)]
        narrow = df.agg(*inner).first()
        due = [Bracket(b.column, b.ranks, *narrow[f"s{j}"]) for j, b in enumerate(due)]
    ranked = lambda k, t: (t, value[k, math.floor(t)], value[k, math.ceil(t)])
    return {c: [ranked(k, p * (sketch[f"n{k}"] - 1)) for p in wanted[c]] if sketch[f"n{k}"] else [] for k, c in enumerate(columns)}


def between(t: float, a: float, b: float) -> float:
    """Linear interpolation at rank t between the values around it."""
    return a if a == b else (math.ceil(t) - t) * a + (t - math.floor(t)) * b


def quantiles(df: DataFrame, columns: dict[str, Column], at: dict[str, tuple[float, ...]]) -> dict[str, tuple[float, ...] | None]:
    """Exact, linearly interpolated quantiles of many columns together; None for a column without values. NaN counts as missing."""
    rows = df.select(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(k) for k, c in columns.items()])
    found = order_statistics(rows, list(columns), at)
    return {k: tuple(between(*x) for x in v) or None for k, v in found.items()}


def fit_percentiles(train: DataFrame, contract: tuple[Feature, ...]) -> dict[str, tuple[float, float]]:
    """Exact percentile bounds of all robust features; upper <= lower becomes lower + 1."""
    return fit_features(train, tuple(f for f in contract if is_robust(f)), medians=False)[0]


def fit_medians(train: DataFrame, contract: tuple[Feature, ...], bounds: dict) -> dict[str, float]:
    """Exact medians of all transformed features."""
    return fit_features(train, contract, bounds)[1]


def is_robust(f: Feature) -> bool:
    return f.transform.endswith("robust_percentile")


def fit_features(train: DataFrame, contract: tuple[Feature, ...], bounds: dict | None = None, medians: bool = True) -> tuple[dict, dict]:
    """Bounds of the robust features (unless given) and medians of all transformed ones, from the same passes.

    The numbers of all features are written once, as doubles, and read by the passes. A robust feature is not
    scaled for that: its bounds are not known yet. Scaling keeps or turns round the order, so the values
    around the middle rank of the raw column, scaled, are those around the middle of the scaled one. So does clipping.
    """
    if not contract:
        return {}, {}
    bounds = dict(bounds or {})
    shares = {f.id: (*((f.params["lower"], f.params["upper"]) if is_robust(f) and f.id not in bounds else ()), *((0.5,) if medians else ())) for f in contract}
    columns = [raw_number(train, f) if is_robust(f) else unclipped(f, train=train) for f in contract]
    numbers = stored(train.select(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f.id) for f, c in zip(contract, columns)]))
    found = order_statistics(numbers, list(shares), shares)
    forget(numbers)
    if empty := [k for k, v in found.items() if not v]:
        raise ValueError(f"no training values for {empty}")
    middle = {}
    for f in contract:
        if is_robust(f) and f.id not in bounds:
            lo, hi = (between(*x) for x in found[f.id][:2])
            bounds[f.id] = lo, hi if hi > lo else lo + 1.0
        if medians:
            t, a, b = found[f.id][-1]
            middle[f.id] = between(t, *(scaled(f, x, bounds[f.id]) if is_robust(f) else min(max(x, 0.0), 1.0) for x in (a, b)))
    return {f.id: bounds[f.id] for f in contract if f.id in bounds}, middle


def scaled(f: Feature, x: float, bounds: tuple[float, float]) -> float:
    """One value of a robust feature, as transform_feature has it."""
    y = (x - bounds[0]) / (bounds[1] - bounds[0])
    return min(max(1 - y if f.transform.startswith("reverse") else y, 0.0), 1.0)


@dataclass(frozen=True)
class FeatureModel:
    contract: tuple[Feature, ...]
    bounds: dict
    medians: dict

    def keep(self, df: DataFrame) -> list[str]:
        raw = {r for f in self.contract for r in f.raw} | {f.id for f in self.contract}
        return [c for c in df.columns if c not in raw]

    def filled(self, df: DataFrame, finish: Callable[[Column], Column]) -> DataFrame:
        """Metadata and the features, clipped, with missing values at the training median, then `finish`ed.

        What all features share is written once, over an array of them. As a column each, it makes a generated method of more
        than 8,000 bytes of code, which the JVM does not compile.
        """
        if not self.contract:
            return df.select(*self.keep(df))
        values = F.array(*[unclipped(f, self.bounds.get(f.id), df).cast("double") for f in self.contract])
        medians = F.array(*[F.lit(float(self.medians[f.id])) for f in self.contract])
        each = F.zip_with(values, medians, lambda x, m: finish(F.coalesce(V.clip01(x), m).cast("float")))
        d = df.select(*self.keep(df), each.alias("features__"))
        return d.select(*self.keep(df), *[F.col("features__")[k].alias(f.id) for k, f in enumerate(self.contract)])

    def transform(self, df: DataFrame) -> DataFrame:
        """Metadata and the float features, with missing values at the training median."""
        return self.filled(df, lambda x: x)

    def encode(self, df: DataFrame) -> DataFrame:
        """Metadata and the int8 features."""
        return self.filled(df, V.encode_int8)

    def state(self, df: DataFrame) -> DataFrame:
        """What was fitted: feature, lower, upper (null where there are no bounds), median."""
        rows = [(f.id, *self.bounds.get(f.id, (None, None)), self.medians[f.id]) for f in self.contract]
        return df.sparkSession.createDataFrame(rows, "feature string, lower double, upper double, median double")

    def audit(self, df: DataFrame) -> DataFrame:
        """Metadata and one flag per feature: was the raw value missing?"""
        return df.select(*self.keep(df), *[missing_flag(f, df).alias(f.id) for f in self.contract])


def missing_flag(f: Feature, df: DataFrame | None = None) -> Column:
    if f.transform == "domain_ternary":
        return ~F.coalesce(F.lower(F.trim(F.col(f.raw[0]))).isin("overlap", "yes", "true", "1", "no_overlap", "no", "false", "0"), F.lit(False))
    return F.greatest(*[number(r, df) for r in f.raw]).isNull() if len(f.raw) > 1 else number(f.raw[0], df).isNull()


def fit_encoder(df: DataFrame, contract: tuple[Feature, ...] = CONTRACT, split: str = "split") -> FeatureModel:
    """Bounds, then medians, from training rows only."""
    return FeatureModel(contract, *fit_features(df.filter(F.col(split) == "train"), contract))


def build_feature_tables(annotated: DataFrame, splits: DataFrame, contract: tuple[Feature, ...] = CONTRACT, group: str = "gene") -> tuple[FeatureModel, dict[str, DataFrame]]:
    """The model fitted on the training rows, and the tables float, int8, audit and state.

    splits: group, split. A group with no split, or with two, is an error. state: feature, lower, upper, median.
    """
    many = stored(splits.groupBy(group, "split").agg(F.count("*").alias("rows")).groupBy(group).agg(F.sum("rows").alias("n"), F.first("split").alias("split")))  # a table of groups, of known size for the joins
    odd = annotated.select(group).distinct().join(many, group, "left").filter("n IS NULL OR n > 1").limit(5).collect()
    if odd:
        raise ValueError(f"groups without exactly one split: {[r[group] for r in odd]}")
    rows = annotated.drop("split").join(many.select(group, "split"), group)
    model = fit_encoder(rows, contract)
    return model, {"float": model.transform(rows), "int8": model.encode(rows), "audit": model.audit(rows), "state": model.state(annotated)}


def validate_dataset(df: DataFrame, features: list[str], key: str = "variant_key", label: str = "label", split: str = "split") -> DataFrame:
    """One row: status, errors, rows, per_split (split, rows, positives, in the splits' order). Keys unique, labels 0 or 1, the three splits, no nulls, whole types, range, both classes."""
    kinds = [f for f in features if df.schema[f].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint")]
    numbers = [F.col(f) for f in features]
    null = F.count_if(functools.reduce(Column.__or__, [c.isNull() for c in numbers], F.lit(False)))
    outside = (F.least(*numbers, F.lit(0)) < -127) | (F.greatest(*numbers, F.lit(0)) > 127)  # nulls do not count
    own = df.groupBy(F.col(split).alias("s__"), F.col(label).alias("l__")).agg(  # counts alone; the keys are counted apart, by a hash aggregate
        F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad_labels"), null.alias("null_features"), F.count_if(outside).alias("out_of_range"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    positive = F.coalesce(F.sum(F.when(F.col("l__") == 1, F.col("rows"))), F.lit(0)).alias("positives")
    by = own.groupBy("s__").agg(total("rows"), positive, total("bad_labels"), total("null_features"), total("out_of_range"), F.collect_set(F.concat_ws(":", "s__", F.col("l__").cast("string"))).alias("c__"))
    one = by.agg(
        total("rows"), total("bad_labels"), total("null_features"), total("out_of_range"), F.sort_array(F.collect_set("s__")).alias("splits"), F.size(F.array_distinct(F.flatten(F.collect_list("c__")))).alias("classes"),
        F.sort_array(F.collect_list(F.struct(F.col("s__").alias("split"), "rows", "positives"))).alias("per_split"),
    ).join(df.groupBy(key).agg(F.lit(1).alias("k__")).agg(F.count(key).alias("keys")), F.lit(True))
    checks = [
        (F.col("keys") != F.col("rows"), "repeated keys"), (F.col("bad_labels") > 0, "labels outside 0 and 1"), (F.col("splits") != F.array(*[F.lit(s) for s in sorted(SPLITS)]), "wrong splits"),
        (F.col("null_features") > 0, "null features"), (F.lit(bool(kinds)), "features that are not integers"), (F.col("out_of_range") > 0, "features out of range"),
        (F.col("classes") < 2 * len(SPLITS), "a split without both classes"),
    ]
    errors = F.filter(F.array(*[F.when(c, m) for c, m in checks]), lambda e: e.isNotNull())
    return one.select(F.when(F.size(errors) == 0, "passed").otherwise("failed").alias("status"), errors.alias("errors"), "rows", "per_split")


def group_leakage(df: DataFrame, group: str = "gene", split: str = "split") -> DataFrame:
    """Groups found in more than one split."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def scoring_input_errors(df: DataFrame, features: list[str], key: str = "variant_key") -> DataFrame:
    """One row of counts: repeated keys, null, fractional and out-of-range feature values."""
    any_of = lambda test: F.count_if(F.greatest(*[F.coalesce(test(F.col(f)), F.lit(False)) for f in features], F.lit(False)))
    return df.agg(
        (F.count("*") - F.countDistinct(key)).alias("repeated_keys"), F.count_if(F.greatest(*[F.col(f).isNull() for f in features], F.lit(False))).alias("null_rows"),
        any_of(lambda c: c != F.rint(c)).alias("fractional_rows"), any_of(lambda c: ~c.between(-128, 127)).alias("range_rows"),
    )


def scoring_input(df: DataFrame, features: list[str], split: str | None = None, limit: int | None = None, key: str = "variant_key") -> DataFrame:
    """The rows to score, checked; a limit takes the least keys."""
    rows = df.filter(F.col("split") == split) if split else df
    bad = scoring_input_errors(rows, features, key).first().asDict()
    if any(bad.values()):
        raise ValueError(f"scoring input: {bad}")
    return rows.orderBy(key).limit(limit) if limit else rows


def seeded(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


TIES = 100_000  # rows of one code that one ordered limit takes


def first_rows(df: DataFrame, n: int, code: Column, key: str) -> DataFrame:
    """The n rows of least (code, key), all if fewer, without sorting the table."""
    return least_rows(df.withColumn("code__", code.cast("double")), lambda _: {None: n}, key)


def least_rows(df: DataFrame, wanted: Callable[[DataFrame], dict], key: str, label: str | None = None) -> DataFrame:
    """For each label (or of all rows) as many rows of least (code__, key) as `wanted` says, which is given the labels and codes.

    The passes read codes and keys alone, which are written once; df itself is read once more, for the rows under the cuts.
    """
    codes = stored(df.select("code__", key, *([label] if label else [])))
    at = {k: cut(codes.filter(F.col(label) == k) if label else codes, n, key) for k, n in wanted(codes).items() if n > 0}
    own = lambda k, c: c & (F.col(label) == k) if label else c
    forget(codes)
    if not at:
        return df.drop("code__").limit(0)
    held = stored(df.filter(F.coalesce(functools.reduce(Column.__or__, [own(k, under | tied) for k, (under, tied, _) in at.items()]), F.lit(False))))
    parts = [p for k, (under, tied, rest) in at.items() for p in (held.filter(own(k, under)), held.filter(own(k, tied)).orderBy(key).limit(rest))]
    return functools.reduce(DataFrame.unionByName, parts).drop("code__")


def key_code(key: str, at: int) -> Column:
    """Six bytes of the key as a number, in the keys' order."""
    text = F.encode(F.col(key).cast("string"), "UTF-8")
    return F.conv(F.rpad(F.hex(F.substring(text, at, 6)), 12, "0"), 16, 10).cast("double")


def cut(rows: DataFrame, n: int, key: str) -> tuple[Column, Column, int]:
    """(rows that are taken, rows that tie at the end, how many of these are taken by their keys) for the n least (code__, key).

    The n-th least code is an order statistic of one column; rows under it are taken as they are, and of the rows that tie
    with it the least keys. Many ties are cut by the key's first bytes in the same way, and so on. Whole codes up to 2^53
    are exact doubles.
    """
    code, among, under, at = F.col("code__"), F.lit(True), F.lit(False), 1
    while True:
        have = rows.agg(F.count("*").alias("n"), F.count(code).alias("known")).first()
        if have["n"] <= n:
            return under | among, F.lit(False), 0
        nulls = have["n"] - have["known"]  # nulls come first, as in an order
        if n <= nulls:
            tie = code.isNull()
        else:
            share = (n - nulls - 1) / max(have["known"] - 1, 1)
            limit = order_statistics(rows.select(code.alias("x")), ["x"], {"x": (share,)})["x"][0]
            x = limit[1] if abs(limit[0] - math.floor(limit[0] + 0.5)) > 0.25 or math.floor(limit[0] + 0.5) == math.floor(limit[0]) else limit[2]
            less, tie = code.isNull() | F.coalesce(code < x, F.lit(False)), F.coalesce(code == x, F.lit(False))
            n -= rows.filter(less).count()
            under = under | (among & less)
        rows, among = rows.filter(tie), among & tie
        if rows.count() <= TIES or at > 600:  # past that, equal keys: any of them
            return under, among, n
        code, at = key_code(key, at), at + 6


def balanced_sample(df: DataFrame, n: int, label: str = "label", key: str = "variant_key", seed: int = 42, code: Column | None = None) -> DataFrame:
    """Exactly min(n, available) rows: n / 2 of each label, and where one has fewer, more of the other; an odd row is a negative."""
    c = code if code is not None else sample_code(key, seed)

    def share(codes: DataFrame) -> dict:
        have = {r[label]: r["count"] for r in codes.groupBy(label).count().collect()}
        pos = min(have.get(1, 0), max(n // 2, n - have.get(0, 0)))
        return {1: pos, 0: n - pos}

    return least_rows(df.withColumn("code__", c.cast("double")), share, key, label)


def seeded_sample(df: DataFrame, n: int, key: str = "variant_key", seed: int = 42, code: Column | None = None) -> DataFrame:
    """Exactly n rows (all if fewer), the same ones on every run."""
    return first_rows(df, n, code if code is not None else sample_code(key, seed), key)


def sample_code(key: str, seed: int) -> Column:
    """52 bits of the seeded hash, which a double holds exactly."""
    return F.shiftrightunsigned(seeded(key, seed), 12)


def activation_coverage(df: DataFrame, hidden: list[str]) -> DataFrame:
    """unit, active_rows: rows in which each hidden unit is above 0; a unit without any is an error when the rows are read."""
    counts = df.agg(*[F.count_if(F.col(h) > 0).alias(h) for h in hidden]).unpivot([], hidden, "unit", "active_rows")
    dead = F.raise_error(F.concat(F.lit("no active row for unit "), F.col("unit"))).cast("long")
    return counts.withColumn("active_rows", F.when(F.col("active_rows") > 0, F.col("active_rows")).otherwise(dead))
