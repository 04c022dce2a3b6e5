"""The match report and its error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headmint.operators.subset import EPSILON, PLACES


def labels(picked: DataFrame, cands: DataFrame) -> DataFrame:
    """name, picked_keys: the keys of the masks in candidate order; `shared:`, `from+:` and `to+:`
    where one direction has keys of its own."""
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), n - 1 - position)")
    met = picked.join(cands, "name")
    keys = lambda m: F.transform(F.array_sort(F.collect_list(F.when(F.col(m).bitwiseAND(bit) != 0, F.struct("position", "search_key")))), lambda x: x["search_key"])
    masks = ["picked", "sender_extras", "recipient_extras"]
    by_name = met.groupBy("name").agg(*(keys(m).alias(m) for m in masks))
    shared = F.array_join("picked", ", ")
    more = F.concat(F.transform("sender_extras", lambda k: F.concat(F.lit("from+: "), k)), F.transform("recipient_extras", lambda k: F.concat(F.lit("to+: "), k)))
    text = F.when(F.size(more) > 0, F.array_join(F.concat(F.array(F.concat(F.lit("shared: "), shared)), more), ", ")).otherwise(shared)
    return by_name.select("name", text.alias("picked_keys"))


def match_report(targets: DataFrame, best: DataFrame, cands: DataFrame) -> DataFrame:
    """One row a target, by falling target_total: what was matched and how far off it is.

    best: name, picked, sender_extras, recipient_extras, sent, received, score. A target
    without any match keeps its row, with nulls.
    """
    met = targets.select("name", F.col("ratio").alias("target_ratio"), F.col("total_emails").alias("target_total")).join(best, "name", "left").join(labels(best, cands), "name", "left")
    total = F.col("sent") + F.col("received")
    matched = F.col("sent") / F.col("received")
    return met.select(
        "name",
        "target_ratio",
        F.round(matched, PLACES).alias("matched_ratio"),
        F.round(F.abs(F.ln((matched + EPSILON) / F.col("target_ratio"))), PLACES).alias("ratio_log_error"),
        "target_total",
        total.alias("matched_total"),
        (total - F.col("target_total")).alias("delta_total"),
        F.round(F.abs(total - F.col("target_total")) / F.col("target_total"), PLACES).alias("total_error"),
        F.col("score").alias("person_error"),
        F.col("sent").alias("sent_to_focus"),
        F.col("received").alias("received_from_focus"),
        "picked_keys",
    ).orderBy(F.desc("target_total"), "name")


def match_metrics(report: DataFrame) -> DataFrame:
    """metric, value: combined_error, total_abs_delta, ratio_log_error, worst_person_error, matched_rows."""
    names = {
        "combined_error": F.sum("person_error"),
        "total_abs_delta": F.sum(F.abs("delta_total")).cast("double"),
        "ratio_log_error": F.sum("ratio_log_error"),
        "worst_person_error": F.max("person_error"),
        "matched_rows": F.count(F.lit(1)).cast("double"),
    }
    one = report.agg(*(v.alias(k) for k, v in names.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.round(F.coalesce(F.col(k), F.lit(0.0)), 6).alias("value")) for k in names)))
    return one.select(pairs.alias("p")).select("p.metric", "p.value")
