"""Queries of groups F, G, H and K: scoring, curves, routing, replies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.operators import features, replies, scoring
from triage_spark.plans.dataset_queries import scratch
from triage_spark.plans.views import VIEWS, Views, query
from triage_spark.sources.scratch import stored
from triage_spark.streaming import streams

F16 = tuple(f"f{k}" for k in range(16))


def rule_model(*widths: int) -> scoring.Model:
    """Weights from a rule, so that the SQL twin can write them out: w(layer, unit, input)."""
    weight = lambda layer, u, i: (u * 7 + i * 5 + layer * 3) % 15 - 7
    sizes = [16, *widths, 1]
    weights = tuple(tuple(tuple(weight(k, u, i) for i in range(sizes[k])) for u in range(sizes[k + 1])) for k in range(len(sizes) - 1))
    biases = tuple(tuple((u * 13 + k) % 31 - 15 for u in range(sizes[k + 1])) for k in range(len(sizes) - 1))
    return scoring.Model(F16, weights, biases)


def model_sql(model: scoring.Model, source: str, keep: str) -> str:
    """The integer model as nested SELECTs."""
    names, sql = list(model.features), source
    for k, (w, b) in enumerate(zip(model.weights, model.biases)):
        dot = lambda row, c: f"({c}" + "".join(f" + ({x}) * {n}" for x, n in zip(row, names) if x) + ")"
        if k == len(model.weights) - 1:
            return f"SELECT {keep}, CAST({dot(w[0], b[0])} AS INT) AS score{''.join(f', {n}' for n in names if n[0] == 'h')} FROM ({sql}) l{k}"
        new = [f"h{k}_{u}" for u in range(len(w))]
        sql = f"SELECT {keep}, " + ", ".join(f"least(greatest(CAST(floor(({dot(row, c)} + 8) / 16.0) AS BIGINT), 0), 127) AS {n}" for n, row, c in zip(new, w, b)) + f" FROM ({sql}) l{k}"
        names = new
    raise ValueError("model without layers")


TWO = rule_model(8)
KEEP = "variant_key, gene, label, split"
TWO_SQL = model_sql(TWO, VIEWS["small16"], KEEP)
THREE = rule_model(16, 8)
WIDE = rule_model(256)


@query("f03_score_two_layer", f"SELECT variant_key, score, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS prediction FROM ({TWO_SQL}) s")
def score_two_layer(v: Views) -> DataFrame:
    return scoring.score(v.small16, TWO).select("variant_key", "score", "prediction")


@query("f04_score_three_layer", f"SELECT variant_key, score FROM ({model_sql(THREE, VIEWS['small16'], KEEP)}) s")
def score_three_layer(v: Views) -> DataFrame:
    return scoring.score(v.small16, THREE, "arrow").select("variant_key", "score")


def matrix_sql(model: scoring.Model) -> str:
    """A wide two-layer model with lists in place of columns: a product of lists for each unit."""
    w, out = model.weights[0], model.weights[1][0]
    units = "[" + ", ".join(f"{{'w': {list(row)}, 'b': {b}, 'o': {o}}}" for row, b, o in zip(w, model.biases[0], out)) + "]"
    x = "[" + ", ".join(model.features) + "]"
    unit = "u.o * least(greatest(CAST(floor((list_inner_product(CAST(x AS DOUBLE[]), CAST(u.w AS DOUBLE[])) + u.b + 8) / 16.0) AS BIGINT), 0), 127)"
    return f"SELECT variant_key, CAST(list_sum(list_transform({units}, lambda u: {unit})) + {model.biases[1][0]} AS INT) AS score FROM (SELECT variant_key, {x} AS x FROM {{small16}}) s"


@query("f04_score_wide", f"SELECT variant_key, score, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS prediction FROM ({matrix_sql(WIDE)}) s")
def score_wide(v: Views) -> DataFrame:
    return scoring.score(v.small16, WIDE).select("variant_key", "score", "prediction")


PUBLISHED = rule_model(256, 256)


def published_sql(model: scoring.Model) -> str:
    """The 16-256-256-1 model with lists. By the rule, a weight of the second layer depends on its input's number modulo 3 alone, so three sums of hidden units stand in for 256 products a unit."""
    first = "[" + ", ".join(f"{{'w': {list(row)}, 'b': {b}}}" for row, b in zip(model.weights[0], model.biases[0])) + "]"
    second = "[" + ", ".join(f"{{'w0': {row[0]}, 'w1': {row[1]}, 'w2': {row[2]}, 'b': {b}, 'o': {o}}}" for row, b, o in zip(model.weights[1], model.biases[1], model.weights[2][0])) + "]"
    unit = lambda acc: f"least(greatest(CAST(floor(({acc} + u.b + 8) / 16.0) AS BIGINT), 0), 127)"
    hidden = f"list_transform({first}, lambda u: {unit('list_inner_product(CAST(x AS DOUBLE[]), CAST(u.w AS DOUBLE[]))')})"
    sums = ", ".join(f"CAST(list_sum(h[{r + 1}:256:3]) AS BIGINT) AS s{r}" for r in range(3))
    x = "[" + ", ".join(model.features) + "]"
    return f"""SELECT variant_key, CAST(list_sum(list_transform({second}, lambda u: u.o * {unit('u.w0 * s0 + u.w1 * s1 + u.w2 * s2')})) + {model.biases[2][0]} AS INT) AS score
    FROM (SELECT variant_key, {sums} FROM (SELECT variant_key, {hidden} AS h FROM (SELECT variant_key, {x} AS x FROM {{small16}}) a) b) c"""


@query("f04_score_published", published_sql(PUBLISHED))
def score_published(v: Views) -> DataFrame:
    """The published shape, 16-256-256-1."""
    return scoring.score(v.small16, PUBLISHED).select("variant_key", "score")


@query("f05_score_table", f"SELECT variant_key, gene, score, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS prediction, CASE WHEN score >= -276 THEN 'deep' ELSE 'light' END AS route, score >= -276 AS deep_review_required FROM ({TWO_SQL}) s")
def score_table(v: Views) -> DataFrame:
    return scoring.score_table(v.small16, TWO, -276)


@query("f06_compare_scores", f"SELECT variant_key, score AS score_a, score + 1 AS score_b FROM ({TWO_SQL}) s WHERE variant_key IN (SELECT variant_key FROM {{unique_variants}}) AND score % 50 = 0")
def compare_scores(v: Views) -> DataFrame:
    rows = stored(v.small16.select("variant_key", *TWO.features).join(v.unique_variants.select("variant_key"), "variant_key", "left_semi"))  # read by both
    a, b = scoring.SCORERS["expr"](rows, TWO), scoring.SCORERS["arrow"](rows, TWO)
    return scoring.compare_scores(a, b.withColumn("score", F.when(F.col("score") % 50 == 0, F.col("score") + 1).otherwise(F.col("score"))))


@query("f07_triage_run", f"""
    SELECT count(*) AS variants, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (WHERE score >= 0) AS predicted_pathogenic, count(*) FILTER (WHERE score < 0) AS predicted_benign,
           count(*) FILTER (WHERE score >= -276) AS deep, count(*) FILTER (WHERE score < -276) AS light, round(count(*) FILTER (WHERE score >= -276) / count(*), 6) AS deep_fraction FROM ({TWO_SQL}) s""")
def triage_run(v: Views) -> DataFrame:
    return scoring.triage(v.small16, TWO, -276, TWO)[1]


@query("f08_hidden_activity", f"SELECT round(({' + '.join(f'avg(CASE WHEN h0_{u} > 0 THEN 1 ELSE 0 END)' for u in range(8))}) / 8, 6) AS active, round(({' + '.join(f'avg(CASE WHEN h0_{u} >= 127 THEN 1 ELSE 0 END)' for u in range(8))}) / 8, 6) AS saturated FROM ({TWO_SQL}) s")
def hidden_activity(v: Views) -> DataFrame:
    return scoring.hidden_activity(scoring.score(v.small16, TWO, keep_hidden=True), [f"h{u}" for u in range(8)])


@query("f09_class_weight", "SELECT round(sum(1 - label) / sum(label), 9) AS positive_weight FROM {keyed} WHERE split = 'train'")
def class_weight(v: Views) -> DataFrame:
    return scoring.class_weight(v.keyed.filter("split = 'train'")).select(F.round("positive_weight", 9).alias("positive_weight"))


METRICS = """SELECT {by} tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS "precision", coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall,
  coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
  coalesce(round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6), 0) AS mcc
  FROM (SELECT {by} count(*) FILTER (WHERE score >= 0 AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= 0 AND label = 0)::DOUBLE AS fp, count(*) FILTER (WHERE score < 0 AND label = 1)::DOUBLE AS fn, count(*) FILTER (WHERE score < 0 AND label = 0)::DOUBLE AS tn FROM {scores} {where} {group}) c"""
METRICS_SQL = lambda by="", group="", where="": METRICS.replace("{by}", by).replace("{group}", group).replace("{where}", where)
COUNTS_AS_LONG = 'SELECT * REPLACE (CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn) FROM ({}) m'


@query("g01_classification_metrics", COUNTS_AS_LONG.format(METRICS_SQL("split,", "GROUP BY split")))
def classification_metrics(v: Views) -> DataFrame:
    return scoring.classification_metrics(v.scores, by=["split"])


CURVE = "SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {scores} GROUP BY score) g"


@query("g02_score_curve", CURVE)
def score_curve(v: Views) -> DataFrame:
    return scoring.score_curve(v.scores)


@query("g03_roc_auc", f"SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM ({CURVE}) c")
def roc_auc(v: Views) -> DataFrame:
    return scoring.roc_auc(scoring.score_curve(v.scores))


@query("g04_average_precision", f"SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM ({CURVE}) c")
def average_precision(v: Views) -> DataFrame:
    return scoring.average_precision(scoring.score_curve(v.scores))


F1 = f"SELECT score, 2 * tp / (tp + fp + (SELECT count(*) FROM {{scores}} WHERE label = 1)) AS f FROM ({CURVE}) c WHERE tp > 0"


@query("g05_best_f1_threshold", f"SELECT CAST(min(score) AS BIGINT) AS threshold, round(max(f), 6) AS f1 FROM ({F1}) x WHERE f = (SELECT max(f) FROM ({F1}) y)")
def best_f1_threshold(v: Views) -> DataFrame:
    return scoring.best_f1_threshold(scoring.score_curve(v.scores))


TEST_CURVE = CURVE.replace("{scores}", "(SELECT * FROM {scores} WHERE split = 'test') t")


@query("g06_evaluation_report", f"""
    SELECT m.*, a.roc_auc, p.average_precision, e.genes, e.routing_recall, e.mismatches FROM ({COUNTS_AS_LONG.format(METRICS.replace('{by}', '').replace('{group}', '').replace('{where}', "WHERE split = 'test' AND variant_key IN (SELECT variant_key FROM {unique_variants})"))}) m,
      (SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM ({TEST_CURVE.replace("WHERE split = 'test'", "WHERE split = 'test' AND variant_key IN (SELECT variant_key FROM {unique_variants})")}) c) a,
      (SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM ({TEST_CURVE.replace("WHERE split = 'test'", "WHERE split = 'test' AND variant_key IN (SELECT variant_key FROM {unique_variants})")}) c) p,
      (SELECT count(DISTINCT gene) AS genes, round(count(*) FILTER (WHERE label = 1 AND score >= -276) / count(*) FILTER (WHERE label = 1), 6) AS routing_recall, count(*) FILTER (WHERE sup % 7 = 0) AS mismatches FROM {{scores}} WHERE split = 'test' AND variant_key IN (SELECT variant_key FROM {{unique_variants}})) e""")
def evaluation_report(v: Views) -> DataFrame:
    rows = v.scores.join(v.unique_variants.select("variant_key"), "variant_key", "left_semi")
    return scoring.evaluation_report(rows.withColumn("other", F.col("score") + F.when(F.col("sup") % 7 == 0, 1).otherwise(0)), 0, -276, expected="other")


@query("h01_routing_threshold", f"SELECT max(score) AS threshold, round(min(tp) / (SELECT count(*) FROM {{scores}} WHERE label = 1), 6) AS recall FROM ({CURVE}) c WHERE tp >= ceil(0.995::DOUBLE * (SELECT count(*) FROM {{scores}} WHERE label = 1))")
def routing_threshold(v: Views) -> DataFrame:
    return scoring.select_routing_threshold(scoring.score_curve(v.scores), 0.995)


@query("h02_routing_threshold_floor", "SELECT score - 5 AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i FROM {scores} WHERE label = 1) r WHERE i = floor(0.005::DOUBLE * (SELECT count(*) FROM {scores} WHERE label = 1))")
def routing_threshold_floor(v: Views) -> DataFrame:
    return scoring.select_routing_threshold_floor(scoring.score_curve(v.scores), 0.005, 5)


@query("h03_routing_statistics", """
    SELECT count(*) FILTER (WHERE score >= -276 AND label = 1) AS deep_pathogenic, count(*) FILTER (WHERE score < -276 AND label = 1) AS light_pathogenic, count(*) FILTER (WHERE score >= -276 AND label = 0) AS deep_benign,
           count(*) FILTER (WHERE score < -276 AND label = 0) AS light_benign, round(count(*) FILTER (WHERE score >= -276) / count(*), 6) AS deep_fraction, round(count(*) FILTER (WHERE score >= -276 AND label = 1) / count(*) FILTER (WHERE label = 1), 6) AS recall FROM {scores}""")
def routing_statistics(v: Views) -> DataFrame:
    return scoring.routing_statistics(v.scores, -276)


@query("h06_prepare_requests", "SELECT r.variant_key, r.gene, r.score, r.route, CAST(r.pos AS BIGINT) AS clinvar_variation_id FROM {routed} r WHERE route = 'deep' AND variant_key IN (SELECT variant_key FROM {unique_variants}) ORDER BY score DESC, variant_key LIMIT 500")
def prepare_requests(v: Views) -> DataFrame:
    u = v.unique_variants.select("variant_key", F.concat(F.lit("VCV"), F.col("pos").cast("string")).alias("ClinVar"))
    return scoring.prepare_requests(v.routed.join(u.select("variant_key"), "variant_key", "left_semi"), u, -276, "ClinVar", limit=500)


# ---- K: requests and replies ----


@query("k01_batch_requests", "SELECT batch, min(sequence) AS first_sequence, count(*) AS n, min(event_id) AS least, CAST(sum(score) AS BIGINT) AS total FROM (SELECT sequence AS event_id, score, row_number() OVER (ORDER BY sequence) + 99 AS sequence, CAST(floor((row_number() OVER (ORDER BY sequence) - 1) / 32) AS BIGINT) AS batch FROM {requests}) t GROUP BY batch")
def batch_requests(v: Views) -> DataFrame:
    d = replies.batch_requests(v.requests.select(F.col("sequence").alias("event_id"), "score"), 32, 100, key="event_id")
    return d.select("batch", "first_sequence", F.size("rows").cast("bigint").alias("n"), F.col("rows")[0]["event_id"].alias("least"), F.expr("aggregate(rows, 0L, (a, r) -> a + r.score)").alias("total"))


JUDGED = """SELECT r.*, e.score AS expected_score, e.sequence IS NOT NULL AS known, e.sequence IS NOT NULL AND row_number() OVER (PARTITION BY r.stream_id, r.sequence ORDER BY r.arrival, r.reply_id) = 1 AS first,
  coalesce(r.score = e.score AND r.classification = CASE WHEN e.score >= 0 THEN 1 ELSE 0 END AND r.deep_review = CASE WHEN e.score >= -276 THEN 1 ELSE 0 END, false) AS correct
  FROM {replies} r LEFT JOIN {requests} e ON r.stream_id = e.stream_id AND r.sequence = e.sequence"""


@query("k02_reply_summary", f"""
    WITH j AS ({JUDGED}), b AS (SELECT stream_id, count(*) FILTER (WHERE sequence < before) AS out_of_order FROM (SELECT stream_id, sequence, lag(sequence) OVER (PARTITION BY stream_id ORDER BY arrival, reply_id) AS before FROM j WHERE first) x GROUP BY stream_id),
         p AS (SELECT stream_id, count(*) FILTER (WHERE first) AS received_unique, count(DISTINCT CASE WHEN correct THEN sequence END) AS correct_unique, count(*) FILTER (WHERE known AND NOT first) AS duplicates, count(*) FILTER (WHERE NOT known) AS unrelated_replies, count(*) FILTER (WHERE known AND NOT correct) AS mismatches FROM j GROUP BY stream_id)
    SELECT a.stream_id, a.requested, coalesce(p.received_unique, 0) AS received_unique, coalesce(p.correct_unique, 0) AS correct_unique, a.requested - coalesce(p.received_unique, 0) AS missing, coalesce(p.duplicates, 0) AS duplicates,
           coalesce(b.out_of_order, 0) AS out_of_order, coalesce(p.unrelated_replies, 0) AS unrelated_replies, coalesce(p.mismatches, 0) AS mismatches
    FROM (SELECT stream_id, count(*) AS requested FROM {{requests}} GROUP BY stream_id) a LEFT JOIN p ON a.stream_id = p.stream_id LEFT JOIN b ON a.stream_id = b.stream_id""")
def reply_summary(v: Views) -> DataFrame:
    return replies.reply_summary(v.requests, v.replies, -276)


@query("k02_missing_sequences", "SELECT stream_id, sequence FROM {requests} WHERE sequence % 13 = 0 AND NOT (sequence % 17 = 0 AND (sequence % 34 <> 0 OR sequence = 0))")
def missing_sequences(v: Views) -> DataFrame:
    return replies.missing_sequences(v.requests, v.replies)


PACKED = "SELECT CAST(floor(sequence / 32) AS BIGINT) AS batch, sequence, score FROM {requests}"


@query("k03_batch_reply_summary", f"""
    SELECT batch, count(*) AS rows, CASE WHEN batch % 11 = 0 THEN 0 WHEN batch % 7 = 0 THEN 2 ELSE 1 END AS replies, batch % 11 <> 0 AND batch % 5 = 0 AND max(short) AS count_error,
           CASE WHEN batch % 11 = 0 OR (batch % 5 = 0 AND max(short)) THEN count(*) ELSE count(*) FILTER (WHERE sequence % 19 = 0) END AS wrong_scores,
           batch % 11 <> 0 AND NOT (batch % 5 = 0 AND max(short)) AND count(*) FILTER (WHERE sequence % 19 = 0) = 0 AS complete
    FROM (SELECT *, sequence % 32 = 31 AS short FROM ({PACKED}) p) q GROUP BY batch""")
def batch_reply_summary(v: Views) -> DataFrame:
    p = v.requests.select(F.floor(F.col("sequence") / 32).cast("bigint").alias("batch"), "sequence", "score")
    lists = lambda d, s: d.groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", s.alias("s")))), lambda x: x["s"]).alias("scores"))
    got = p.filter("batch % 11 <> 0 AND NOT (batch % 5 = 0 AND sequence % 32 = 31)")
    first = lists(got, F.col("score") + F.when(F.col("sequence") % 19 == 0, 1).otherwise(0)).withColumn("arrival", F.lit(1.0))
    again = lists(got.filter("batch % 7 = 0"), F.col("score")).withColumn("arrival", F.lit(2.0))
    d = replies.batch_reply_summary(lists(p, F.col("score")), first.unionByName(again), -276)
    return d.withColumns({c: F.col(c).cast("bigint") for c in ("rows", "replies", "wrong_scores")}).withColumn("replies", F.col("replies").cast("int"))


@query("k04_completion_rate", f"""
    WITH c AS (SELECT stream_id, sequence, min(arrival) AS first_at FROM ({JUDGED}) j WHERE correct GROUP BY 1, 2), p AS (SELECT stream_id, count(*) AS correct, max(first_at) AS last_at FROM c GROUP BY 1)
    SELECT a.stream_id, requested, coalesce(p.correct, 0) AS correct, CASE WHEN p.correct = requested THEN round(last_at - start, 6) END AS seconds, CASE WHEN p.correct = requested THEN round(requested / (last_at - start), 6) END AS rows_per_second
    FROM (SELECT stream_id, count(*) AS requested, min(started) AS start FROM {{requests}} GROUP BY 1) a LEFT JOIN p ON a.stream_id = p.stream_id""")
def completion_rate(v: Views) -> DataFrame:
    return replies.completion_rate(v.requests, v.replies, -276)


@query("k05_timing_statistics", """
    SELECT stream_id, count(l) AS samples, round(sum(l), 6) AS latency_total, round(quantile_cont(l, 0.5), 6) AS latency_median, round(quantile_cont(l, 0.95), 6) AS latency_p95, round(max(l), 6) AS latency_max, count(s) AS spacings, round(sum(s), 6) AS spacing_total, round(quantile_cont(s, 0.5), 6) AS spacing_median,
           round(quantile_cont(s, 0.95), 6) AS spacing_p95, round(max(s), 6) AS spacing_max, count(*) FILTER (WHERE l < 0) AS negative_latencies
    FROM (SELECT stream_id, arrival - (sequence::DOUBLE / 8) AS l, arrival - lag(arrival) OVER (PARTITION BY stream_id ORDER BY arrival, sequence) AS s FROM {replies} WHERE sequence >= 0) t GROUP BY stream_id""")
def timing_statistics(v: Views) -> DataFrame:
    d = v.replies.filter("sequence >= 0").withColumn("sent", F.col("sequence").cast("double") / 8)
    return replies.timing_statistics(d, arrived="arrival")


@query("k06_cross_path_check", "SELECT count(*) AS requests, count(*) FILTER (WHERE sequence % 29 = 0) AS wrong_a, count(*) FILTER (WHERE sequence % 31 = 0) AS wrong_b, count(*) FILTER (WHERE sequence % 29 = 0 OR sequence % 31 = 0) - count(*) FILTER (WHERE sequence % 899 = 0) AS paths_differ, count(*) FILTER (WHERE sequence > 0 AND sequence % 41 = 0) AS breaks_a, count(*) FILTER (WHERE sequence > 0 AND sequence % 43 = 0) AS breaks_b FROM {requests}")
def cross_path_check(v: Views) -> DataFrame:
    path = lambda n, jump: v.requests.select(F.col("sequence").alias("request"), (F.col("score") + F.when(F.col("sequence") % n == 0, 1).otherwise(0)).alias("score"), (F.lit(4294967290) + F.col("sequence") + F.floor(F.col("sequence") / jump)).bitwiseAND(F.lit(4294967295)).alias("path_sequence"))
    return replies.cross_path_check(path(29, 41), path(31, 43), v.requests.select(F.col("sequence").alias("request"), "score"))


def drained(v: Views, sdf: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over the files there are, into Parquet in a shared folder, and read the result."""
    at = f"{scratch(v)}/{name}"
    if mode == "update":
        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch_id", F.lit(number)).write.mode("append").parquet(f"{at}/out")

        q = sdf.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        q = sdf.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.parquet(f"{at}/out")


def event_stream(v: Views) -> DataFrame:
    return streams.read_events(v.spark, v.sf_dir, v.events.schema)


STREAM16 = ", ".join(f"CAST((event_id * {k + 3} + user_id * {k + 1}) % 255 - 127 AS INT) AS f{k}" for k in range(16))


@query("k07_stream_score", f"SELECT event_id, score, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS prediction, CASE WHEN score >= -276 THEN 'deep' ELSE 'light' END AS route FROM ({model_sql(TWO, f'SELECT event_id, {STREAM16} FROM {{events}}', 'event_id')}) s")
def stream_score(v: Views) -> DataFrame:
    rows = event_stream(v).selectExpr("event_id", *[x.strip() for x in STREAM16.split(", CAST") if x][:1], *["CAST" + x for x in STREAM16.split(", CAST")[1:]])
    return drained(v, streams.stream_score(rows, TWO, -276).select("event_id", "score", "prediction", "route"), "append", "k07")


@query("k08_stream_match_replies", "SELECT CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN event_id % 19 = 0 THEN 'score_mismatch' ELSE 'matched' END AS status, count(*) AS n FROM {events} WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM {events}) GROUP BY 1")
def stream_match_replies(v: Views) -> DataFrame:
    e = event_stream(v).select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("sequence"), "ts", F.lit(5).alias("expected_score"))
    requests = e.withColumnRenamed("ts", "sent")
    answers = event_stream(v).filter("event_id % 13 <> 0").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("sequence"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("arrived"), F.when(F.col("event_id") % 19 == 0, 4).otherwise(5).alias("score"), F.lit(1).alias("classification"), F.lit(1).alias("deep_review"))
    out = drained(v, streams.stream_match_replies(requests, answers), "append", "k08")
    last = v.events.agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 HOUR")).alias("t"))
    return out.join(F.broadcast(last), F.col("sent") < F.col("t")).groupBy("status").agg(F.count("*").alias("n"))


@query("k09_stream_reply_state", "SELECT user_id AS stream_id, count(*) AS received_unique, count(*) FILTER (WHERE event_id % 17 = 0) AS duplicates, CAST(0 AS BIGINT) AS out_of_order FROM {events} GROUP BY 1")
def stream_reply_state(v: Views) -> DataFrame:
    e = event_stream(v).select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("sequence"), F.timestamp_millis(F.col("event_id") + 86_400_000).alias("arrived"))
    repeated = e.withColumn("copy", F.explode(F.when(F.col("sequence") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    with streams.use_rocksdb(v.spark):
        out = drained(v, streams.stream_reply_state(repeated, delay="365 days"), "update", "k09")  # the table's files may come in any order
    return out.groupBy("stream_id").agg(*[F.max_by(c, "batch_id").alias(c) for c in ("received_unique", "duplicates", "out_of_order")])
