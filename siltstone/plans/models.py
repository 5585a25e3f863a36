"""Queries of boosted models, their inputs and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import models, scores
from siltstone.plans import query
from siltstone.sources.tables import table


@query(
    "score_average_precision",
    """WITH t AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(l_extendedprice AS DOUBLE) AS s FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL),
       c AS (SELECT s, sum(y) AS pos, count(*) AS n FROM t GROUP BY s),
       r AS (SELECT pos, n, sum(pos) OVER (ORDER BY s DESC) AS hits, sum(n) OVER (ORDER BY s DESC) AS upto FROM c)
       SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(pos * CAST(hits AS DOUBLE) / upto) / sum(pos), 9) AS ap FROM r""",
)
def _average_precision(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), "l_extendedprice")
    return scores.average_precision(t, "y", "l_extendedprice").select("n", F.round("ap", 9).alias("ap"))


@query(
    "channel_features",
    """WITH e AS (SELECT event_id, user_id, value, event_id % 7 AS load, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS dv, event_id % 7 - lag(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS dl FROM events)
       SELECT event_id, round(avg(value) OVER w, 6) AS value_mean, round(stddev_pop(value) OVER w, 5) AS value_sd, round(coalesce(avg(dv * dv) OVER w, 0), 7) AS value_roughness,
              CAST(max(load) OVER w AS DOUBLE) AS load_high, round(coalesce(avg(dl * dl) OVER w, 0), 7) AS load_roughness FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def _features(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.col("event_id") % 7).alias("load"))
    out, _ = models.channel_features(e, ["user_id"], "event_id", ["value", "load"], 6)
    return out.select("event_id", F.round("value mean", 6).alias("value_mean"), F.round("value sd", 5).alias("value_sd"), F.round("value roughness", 7).alias("value_roughness"), F.col("load high").alias("load_high"), F.round("load roughness", 7).alias("load_roughness"))


@query("failure_model")
def _failures(spark, sf_dir):
    """Errors of a user within ten events, from what values did before; tests hold the model against a planted signal."""
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error").withColumn("gap", F.col("event_id").cast("double"))
    model = models.MaintenanceModel(width=6, trees=10).fit(e, ["user_id"], "event_id", "failed", ["value"])
    found = model.evaluate(e)
    names = ["n_rows", "n_positive", "accuracy", "roc_auc", "average_precision"]
    return spark.createDataFrame([tuple(None if found[k] is None else float(found[k]) for k in names)], ", ".join(f"{k} double" for k in names))


@query("quality_model")
def _quality(spark, sf_dir):
    """What tells good documents from bad: held-out scores and each input's share of the trees' gain."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    inputs = docs.join(labels, "doc_id").select(
        F.col("quality").cast("string").alias("quality"), "lang", "source", F.char_length(text).alias("chars"), F.size(F.array_distinct(lines)).alias("lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("repeats"), F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]", "")).alias("symbols"),
        F.char_length(F.regexp_replace(text, r"[^0-9]", "")).alias("digits"),
    )
    model = models.QualityModel(trees=10).fit(inputs, "quality", good="1")
    rows = [("score", k, v) for k, v in model.metrics.items()] + [("importance", k, v) for k, v in model.importance.items()]
    return spark.createDataFrame(rows, "kind string, name string, value double")
