"""SQL functions for sessions: plain SQL bodies that Spark inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "sigmoid": ("(x DOUBLE)", "DOUBLE", "CASE WHEN x > 60 THEN 1.0D WHEN x < -60 THEN 0.0D ELSE 1 / (1 + exp(-x)) END"),
    "logit": ("(p DOUBLE)", "DOUBLE", "CASE WHEN p > 0 AND p < 1 THEN ln(p / (1 - p)) END"),
    "robust_z": ("(v DOUBLE, med DOUBLE, mad DOUBLE)", "DOUBLE", "CASE WHEN mad <> 0 THEN (v - med) / (1.4826D * mad) END"),
    "card_key": ("(customer STRING, part STRING)", "STRING", "concat(customer, '|', coalesce(part, '_'))"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{args} RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
