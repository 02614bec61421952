"""Entry A of the reference: appointments -> one model-ready row per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import model_table, patient_features
from ..sources.appointments import appointments_from_events, appointments_from_orders

VIEWS = {"orders": appointments_from_orders, "events": appointments_from_events}


def appointments(spark: SparkSession, sf_dir: str, view: str = "orders") -> DataFrame:
    return VIEWS[view](spark, sf_dir)


def feature_table(spark: SparkSession, sf_dir: str, view: str = "orders",
                  min_count: int = 500, days: int = 90, **kw) -> DataFrame:
    """G1/G2/G5 on a driver view."""
    return patient_features(appointments(spark, sf_dir, view), min_count=min_count,
                            days=days, **kw)


def model_ready(spark: SparkSession, sf_dir: str, view: str = "orders",
                min_count: int = 500, days: int = 90, prune: bool = True) -> DataFrame:
    """Display-named numeric table with the label ``dna_flag``."""
    return model_table(feature_table(spark, sf_dir, view, min_count, days), prune=prune)
