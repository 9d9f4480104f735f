"""Integer models over feature rows, score curves, evaluation and routing."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage_spark.functions import variants as V
from triage_spark.sources.scratch import stored

INT32 = (-(1 << 31), (1 << 31) - 1)


@dataclass(frozen=True)
class Model:
    """Integer layers: weights[k] has a row per unit of layer k; the last layer has one unit and no requantization."""

    features: tuple[str, ...]
    weights: tuple[tuple[tuple[int, ...], ...], ...]
    biases: tuple[tuple[int, ...], ...]
    qshift: int = 4

    def __post_init__(self):
        width = len(self.features)
        for w, b in zip(self.weights, self.biases, strict=True):
            if any(len(row) != width for row in w) or len(w) != len(b):
                raise ValueError("layer shapes do not fit")
            if any(not -128 <= x <= 127 for row in w for x in row):
                raise ValueError("weights must be int8")
            width = len(w)
        if width != 1:
            raise ValueError("the last layer must have one unit")
        if max(self.worst_case()) > INT32[1]:
            raise ValueError("accumulators may leave int32")

    def worst_case(self) -> list[int]:
        """The largest magnitude each layer's accumulators can have."""
        out, top = [], 128
        for w, b in zip(self.weights, self.biases):
            out.append(max(abs(c) + top * sum(map(abs, row)) for row, c in zip(w, b)))
            top = 127
        return out


    def identity(self) -> str:
        """sha256 of the model as text: the same in every process."""
        return hashlib.sha256(json.dumps([self.features, self.weights, self.biases, self.qshift]).encode()).hexdigest()


def fold_threshold(model: Model, threshold: int) -> Model:
    """The same model with score >= threshold moved to score >= 0."""
    return Model(model.features, model.weights, (*model.biases[:-1], (model.biases[-1][0] - threshold,)), model.qshift)


def load_model(manifest: dict) -> Model:
    """A two-layer manifest: feature_order, hidden_weights, hidden_biases, output_weights, folded_output_bias, qshift."""
    missing = {"feature_order", "hidden_weights", "hidden_biases", "output_weights", "folded_output_bias", "qshift"} - manifest.keys()
    if missing:
        raise ValueError(f"manifest lacks {sorted(missing)}")
    rows = lambda m: tuple(tuple(map(int, r)) for r in m)
    return Model(tuple(manifest["feature_order"]), (rows(manifest["hidden_weights"]), (tuple(map(int, manifest["output_weights"])),)), (tuple(map(int, manifest["hidden_biases"])), (int(manifest["folded_output_bias"]),)), int(manifest["qshift"]))


def expression_layers(df: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """df with hidden columns h0, h1, ... and score, by column expressions alone.

    A unit is a fold over arrays: written out, the products of a layer make one method, which is too large for the JVM to compile.
    """
    d, x, hidden = df, F.array(*[F.col(n).cast("bigint") for n in model.features]), []
    for k, (w, b) in enumerate(zip(model.weights, model.biases)):
        d = d.withColumn(f"x{k}__", x)
        dot = lambda row, c, x=F.col(f"x{k}__"): F.aggregate(F.zip_with(x, F.array(*[F.lit(int(v)).cast("bigint") for v in row]), lambda p, q: p * q), F.lit(int(c)).cast("bigint"), lambda t, p: t + p)
        if k == len(model.weights) - 1:
            return d.withColumn("score", dot(w[0], b[0]).cast("int")).drop(*[f"x{j}__" for j in range(k + 1)]), hidden
        new = [f"h{len(hidden) + i}" for i in range(len(w))]
        d = d.withColumn("sums__", F.array(*[dot(row, c) for row, c in zip(w, b)]))  # named, as each sum is used twice
        d = d.withColumns({n: V.requantize(F.get("sums__", F.lit(i)), model.qshift) for i, n in enumerate(new)}).drop("sums__")
        x, hidden = F.array(*new), hidden + new
    raise ValueError("model without layers")


ROWS = 2048  # of one matrix product: the widest layer's numbers of so many rows stay in a core's cache


def arrow_scores(df: DataFrame, model: Model, rows: int = ROWS) -> DataFrame:
    """df with score, one matrix product per layer and `rows` rows; only the features go to Python, and a score comes back.

    A column of features is a row of the matrix, so it is copied in one piece, and units times rows keep that layout
    through all layers. float32 is exact while accumulators stay under 2^24 (a shift is then a product with a power of
    two); else all is computed in int64. The weights travel once a task; Spark holds a worker's BLAS to its
    cores. A row with a null feature has a null score.
    """
    exact = max(model.worst_case()) + (1 << model.qshift) < 1 << 24
    kind = np.float32 if exact else np.int64
    half, shift = 1 << (model.qshift - 1), model.qshift
    scale, last = (kind(1 / (1 << shift)) if exact else None), len(model.weights) - 1
    layers = [(np.array(w, dtype=kind), np.array(b, dtype=kind)[:, None] + kind(half if k < last else 0)) for k, (w, b) in enumerate(zip(model.weights, model.biases))]

    def forward(x: np.ndarray) -> np.ndarray:
        for w, b in layers[:-1]:
            x = w @ x
            x += b
            if exact:
                x *= scale
                np.floor(x, out=x)
            else:
                x >>= shift
            np.clip(x, 0, 127, out=x)
        w, b = layers[-1]
        return (w @ x + b)[0]

    @F.arrow_udf("int")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            n = len(columns[0])
            x, out, null = np.empty((len(columns), n), dtype=kind), np.empty(n, dtype=np.int32), np.zeros(n, dtype=bool)
            for k, c in enumerate(columns):
                if c.null_count:
                    null |= np.asarray(c.is_null())
                    c = c.fill_null(0)
                x[k] = c.to_numpy(zero_copy_only=False)
            for at in range(0, n, rows):
                out[at : at + rows] = forward(np.ascontiguousarray(x[:, at : at + rows]))
            yield pa.array(out, mask=null)

    return df.withColumn("score", run(*[F.col(n) for n in model.features]))


def score(df: DataFrame, model: Model, engine: str = "arrow", keep_hidden: bool = False) -> DataFrame:
    """df with score and prediction: by Arrow batches, or by column expressions, which also can keep the hidden units."""
    if engine not in ("arrow", "expr"):
        raise ValueError(f"unknown engine: {engine}")
    if engine == "arrow" and not keep_hidden:
        out = arrow_scores(df, model)
    else:
        out, hidden = expression_layers(df, model)
        out = out if keep_hidden else out.drop(*hidden)
    return out.withColumn("prediction", V.prediction(F.col("score")))


SCORERS = {"expr": lambda df, m: score(df, m, "expr"), "arrow": lambda df, m: score(df, m, "arrow")}


def score_table(df: DataFrame, model: Model, threshold: int, key: str = "variant_key", group: str = "gene", backend: str | None = None) -> DataFrame:
    """key, group, score, prediction, route, deep_review_required."""
    scored = SCORERS[backend](df, model) if backend else score(df, model)
    return scored.select(key, group, "score", "prediction", V.apply_route(F.col("score"), threshold).alias("route"), (F.col("score") >= threshold).alias("deep_review_required"))


def compare_scores(a: DataFrame, b: DataFrame, key: str = "variant_key") -> DataFrame:
    """Keys whose scores differ, or that one side lacks; empty when exact."""
    both = a.select(key, F.col("score").alias("score_a")).join(b.select(key, F.col("score").alias("score_b")), key, "full_outer")
    return both.filter(~F.col("score_a").eqNullSafe(F.col("score_b")))


def triage_summary(scores: DataFrame) -> DataFrame:
    """One row: rows, least and largest score, prediction and route counts, deep fraction."""
    deep = F.count_if(F.col("route") == "deep")
    return scores.agg(
        F.count("*").alias("variants"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count_if(F.col("prediction") == 1).alias("predicted_pathogenic"),
        F.count_if(F.col("prediction") == 0).alias("predicted_benign"), deep.alias("deep"), F.count_if(F.col("route") == "light").alias("light"), F.round(F.try_divide(deep, F.count("*")), 6).alias("deep_fraction"),
    )


def triage(df: DataFrame, model: Model, threshold: int, policy_model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, summary); a policy made for another model is an error."""
    if policy_model is not None and policy_model != model:
        raise ValueError("the policy belongs to another model")
    scores = score_table(df, model, threshold)
    return scores, triage_summary(scores)


def hidden_activity(df: DataFrame, hidden: list[str]) -> DataFrame:
    """One row: share of hidden values above 0, and at 127 or more."""
    share = lambda test: F.round(sum((F.avg(test(F.col(h)).cast("int")) for h in hidden), F.lit(0.0)) / len(hidden), 6)
    return df.agg(share(lambda c: c > 0).alias("active"), share(lambda c: c >= 127).alias("saturated"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.try_divide(F.sum(1 - F.col(label)), F.sum(label)).alias("positive_weight"))


def classification_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: int = 0, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and the usual ratios, 0 where undefined; one row, or one per `by`."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    counts = {"tp": hit & true, "fp": hit & ~true, "fn": ~hit & true, "tn": ~hit & ~true}
    c = (df.groupBy(*by) if by else df.groupBy()).agg(*[F.count_if(t).alias(n) for n, t in counts.items()])
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall, specificity = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    ratios = {
        "accuracy": div(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": div(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (recall + specificity) / 2, "mcc": div(tp * tn - fp * fn, root),
    }
    return c.select(*(by or []), *counts, *[F.round(v, 6).alias(k) for k, v in ratios.items()])


def score_curve(df: DataFrame, score: str = "score", label: str = "label", buckets: int | None = None) -> DataFrame:
    """score, pos, neg and, counted from the largest score down, tp and fp, for every distinct score.

    Two levels: counts per score are dealt to ranges of about equally many scores (as many ranges as the session has
    shuffle partitions, unless `buckets` is given), the ranges' totals, a row each, are added up, and a window
    runs inside each range. No window spans all rows, however the scores are spread. Null scores are left out.
    """
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    cuts = sorted(set(by.agg(F.percentile_approx("score", [k / n for k in range(1, n)], 10_000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("score"))) if cuts else F.lit(0)  # once per distinct score
    by = by.withColumn("bucket", bucket)
    totals = by.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = totals.select("bucket", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"))
    w = Window.partitionBy("bucket").orderBy(F.desc("score"))
    return by.join(F.broadcast(before), "bucket").select("score", "pos", "neg", (F.sum("pos").over(w) + F.col("p_above")).alias("tp"), (F.sum("neg").over(w) + F.col("n_above")).alias("fp"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """One row; ties count half; null without both classes."""
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    return curve.agg(F.round(F.try_divide(won, F.sum("pos") * F.sum("neg")), 6).alias("roc_auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    part = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve.agg(F.round(F.try_divide(part, F.sum("pos")), 6).alias("average_precision"))


def best_f1_threshold(curve: DataFrame) -> DataFrame:
    """The lowest score among those with the largest F1; 0 without positives."""
    total = curve.agg(F.sum("pos")).first()[0] or 0
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + total)
    best = curve.filter("tp > 0").agg(F.max_by("score", F.struct(f1, -F.col("score"))).alias("t"), F.max(f1).alias("f"))
    return best.select(F.coalesce("t", F.lit(0)).cast("long").alias("threshold"), F.round(F.coalesce("f", F.lit(0.0)), 6).alias("f1"))


def evaluation_report(df: DataFrame, threshold: int, routing_threshold: int, split: str = "test", key: str = "variant_key", expected: str | None = None) -> DataFrame:
    """One row for one locked split: metrics, curve areas, genes, routing recall; repeated keys are an error.

    expected: a column of scores from another engine; `mismatches` counts the rows whose score differs from it.
    """
    used = dict.fromkeys([key, "label", "score", "gene", *([expected] if expected else [])])
    rows = stored(df.filter(F.col("split") == split).select(*used))
    if rows.groupBy(key).count().filter("count > 1").limit(1).collect():
        raise ValueError("repeated keys in the evaluated split")
    curve = score_curve(rows)
    extra = rows.agg(F.countDistinct("gene").alias("genes"), F.round(F.try_divide(F.count_if((F.col("label") == 1) & (F.col("score") >= routing_threshold)), F.count_if(F.col("label") == 1)), 6).alias("routing_recall"), *([F.count_if(~F.col("score").eqNullSafe(F.col(expected))).alias("mismatches")] if expected else []))
    one = F.lit(1)
    return classification_metrics(rows, threshold=threshold).join(roc_auc(curve), one == one).join(average_precision(curve), one == one).join(extra, one == one)


def select_routing_threshold(curve: DataFrame, target: float) -> DataFrame:
    """The largest score with at least ceil(target * positives) positives at or above it."""
    if not 0 < target <= 1:
        raise ValueError("target must be in (0, 1]")
    total = curve.agg(F.sum("pos")).first()[0] or 0
    if not total:
        raise ValueError("no pathogenic rows")
    return curve.filter(F.col("tp") >= math.ceil(target * total)).agg(F.max("score").alias("threshold"), F.round(F.min_by("tp", -F.col("score")) / total, 6).alias("recall"))


def select_routing_threshold_floor(curve: DataFrame, miss: float = 0.005, class_threshold: int = 0) -> DataFrame:
    """The ascending positives' score at index floor(miss * positives), less the class threshold."""
    total = curve.agg(F.sum("pos")).first()[0] or 0
    if not total:
        raise ValueError("no pathogenic rows")
    return curve.filter((F.col("pos") > 0) & (total - F.col("tp") + F.col("pos") > math.floor(miss * total))).agg((F.min("score") - class_threshold).alias("threshold"))


def check_labels(df: DataFrame, label: str = "label") -> None:
    if df.filter(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).limit(1).collect():
        raise ValueError("labels must be 0 or 1")


def build_policy(threshold: int, target: float, achieved: float, split: str, model: Model) -> dict:
    """A checked policy: INT32 threshold, recall at least the target, never chosen on the test split."""
    if split == "test":
        raise ValueError("a threshold must not be chosen on the test split")
    if not INT32[0] <= threshold <= INT32[1] or not 0 < target <= achieved <= 1:
        raise ValueError("threshold or recall out of range")
    return {"version": 1, "rule": "score >= threshold", "threshold": int(threshold), "target_recall": target, "achieved_recall": achieved, "split": split, "model": model.identity()}


def load_policy(policy: dict, model: Model) -> int:
    if policy.get("version") != 1 or policy.get("rule") != "score >= threshold" or policy.get("split") == "test":
        raise ValueError("unknown or unlawful policy")
    if policy["model"] != model.identity():
        raise ValueError("the policy belongs to another model")
    return int(policy["threshold"])


def guard_selection(df: DataFrame, expected_rows: int, split: str = "validation") -> DataFrame:
    """Rows to choose a threshold on: not the test split, whole, one split only."""
    if split == "test":
        raise ValueError("a threshold must not be chosen on the test split")
    rows = df.filter(F.col("split") == split)
    if rows.count() != expected_rows:
        raise ValueError("the split is not whole")
    return rows


def routing_statistics(df: DataFrame, threshold: int, score: str = "score", label: str = "label") -> DataFrame:
    deep, path = F.col(score) >= threshold, F.col(label) == 1
    n, p = F.count("*"), F.count_if(path)
    return df.agg(
        F.count_if(deep & path).alias("deep_pathogenic"), F.count_if(~deep & path).alias("light_pathogenic"), F.count_if(deep & ~path).alias("deep_benign"), F.count_if(~deep & ~path).alias("light_benign"),
        F.round(F.try_divide(F.count_if(deep), n), 6).alias("deep_fraction"), F.round(F.try_divide(F.count_if(deep & path), p), 6).alias("recall"),
    )


def prepare_requests(scores: DataFrame, variants: DataFrame, threshold: int, id_column: str, route: str = "deep", limit: int | None = None, key: str = "variant_key") -> DataFrame:
    """variant_key, gene, score, route, clinvar_variation_id of one route; recorded routes and ids are checked first; the limit comes last."""
    wrong = scores.filter(F.col("route") != V.apply_route(F.col("score"), threshold)).limit(1).collect()
    if wrong:
        raise ValueError(f"a recorded route is not the policy's: {wrong[0][key]}")
    rows = scores.drop("clinvar_variation_id").filter(F.col("route") == route).join(variants.select(key, V.parse_variation_id(F.col(id_column)).alias("clinvar_variation_id")), key, "left")
    lost = rows.filter("clinvar_variation_id IS NULL").limit(5).collect()
    if lost:
        raise ValueError(f"no variation id for {[r[key] for r in lost]}")
    out = rows.select(key, "gene", "score", "route", "clinvar_variation_id")
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out
