"""Comparing models: long form, pivot, ranking, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import band, score

#: Metrics of the comparison table, in order; others can be named.
COMPARED = ["otc", "aorc", "oid", "sar", "afo", "re", "oc", "composite"]


def long(metrics: DataFrame, names: list[str] = COMPARED) -> DataFrame:
    """(model, metric, value)."""
    return metrics.select("model", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("model", names, "metric", "value")


def table(metrics: DataFrame, models: list[str], names: list[str] = COMPARED) -> DataFrame:
    """A row per metric, a column per model (named by its first 14 characters, and a number where those are taken); the models are given, so nothing is collected."""
    heads: list[str] = []
    for m in models:
        taken = heads.count(m[:14])
        heads.append(m[:14] if not taken else f"{m[:12]}~{len(heads)}")
    wide = long(metrics, names).groupBy("metric").pivot("model", models).agg(F.first("value"))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric"))
    return wide.orderBy(order).select("metric", *[F.col(f"`{m}`").alias(h) for m, h in zip(models, heads, strict=True)])


def ranking(metrics: DataFrame) -> DataFrame:
    """(rank, model, composite) by falling composite; ties keep the order of the models (``seq`` if there is one, else the name).

    One row a model, so the single window is small.
    """
    tie = "seq" if "seq" in metrics.columns else "model"
    order = Window.orderBy(F.desc("composite"), F.asc(tie))
    return metrics.select(F.row_number().over(order).alias("rank"), "model", "composite")


def bands(metrics: DataFrame) -> DataFrame:
    """(model, percent, level, colour, description)."""
    return metrics.select("model", score(F.col("composite")).alias("percent")).select("*", *[band(F.col("percent"), k).alias(c) for k, c in enumerate(("level", "colour", "description"))])
