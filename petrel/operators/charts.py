"""Chart-ready datasets: interaction graph, bipartite layout, radar, bars, gauge, metric table. Pictures are optional."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import compare, graph
from .extract import Model
from .metrics import LABELS

RADAR = ["oid", "sar", "afo_norm", "re_norm"]


def graph_nodes(m: Model) -> DataFrame:
    """(model, object_type, n_activities, degree, size, colour): size 300 + 200 an activity, colour by relative degree."""
    acts = m.relations.groupBy("model", "object_type").agg(F.count(F.lit(1)).alias("n_activities"))
    d = graph.degrees(m.objects, graph.edges(m.relations)).join(acts, ["model", "object_type"], "left").na.fill(0, ["n_activities"])
    most = F.greatest(F.max("degree").over(Window.partitionBy("model")), F.lit(1))
    return d.withColumn("size", 300 + 200 * F.col("n_activities")).withColumn("colour", 0.35 + 0.55 * F.col("degree") / most)


def graph_links(m: Model) -> DataFrame:
    """(model, o1, o2, weight, width, label)."""
    e = graph.edges(m.relations)
    return e.select("model", "o1", "o2", "weight", (1 + 1.5 * F.col("weight")).alias("width"), F.concat(F.lit("x"), F.col("weight").cast("string")).alias("label"))


def bipartite_nodes(m: Model) -> DataFrame:
    """(model, kind, name, x, y): activities at x 0, object types at x 1, by name from the top."""
    both = m.activities.select("model", F.lit("activity").alias("kind"), F.col("activity").alias("name"), F.lit(0.0).alias("x"))
    both = both.unionByName(m.objects.select("model", F.lit("object_type").alias("kind"), F.col("object_type").alias("name"), F.lit(1.0).alias("x")))
    side = Window.partitionBy("model", "kind")
    place, n = F.row_number().over(side.orderBy("name")) - 1, F.count(F.lit(1)).over(side)
    return both.withColumn("y", 1 - place / F.greatest(n - 1, F.lit(1)))


def radar(metrics: DataFrame) -> DataFrame:
    return compare.long(metrics, RADAR)


def bars(metrics: DataFrame) -> DataFrame:
    return compare.long(metrics, [*RADAR, "composite"])


def metric_table(metrics: DataFrame) -> DataFrame:
    """(model, metric, category, value)."""
    kind = F.when(F.col("metric").isin("otc", "aorc", "oc"), "informational").when(F.col("metric").isin("oii", "diam"), "diagnostic").when(F.col("metric") == "composite", "composite").otherwise("core")
    return compare.long(metrics, [c for c in LABELS if c in metrics.columns]).select("model", "metric", kind.alias("category"), "value")


def slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def datasets(result) -> dict[str, DataFrame]:
    return {
        "graph_nodes": graph_nodes(result.model), "graph_links": graph_links(result.model), "bipartite_nodes": bipartite_nodes(result.model),
        "bipartite_links": result.model.relations, "radar": radar(result.metrics), "bars": bars(result.metrics),
        "gauge": compare.bands(result.metrics), "metric_table": metric_table(result.metrics),
    }


def save(result, folder: str, formats: tuple[str, ...] = ("json",)) -> dict[str, str]:
    """Each dataset in each format ("json", "csv", "parquet", "png"); returns where. A "png" needs a plotting library and raises ImportError without it."""
    out = {}
    for name, df in datasets(result).items():
        for f in formats:
            path = f"{folder}/{slug('_'.join(result.names))[:60]}_{name}"
            if f == "png":
                if name in ("radar", "bars", "gauge"):
                    out[f"{name}.png"] = _picture(df, name, f"{path}.png")
            else:
                getattr(df.coalesce(1).write.mode("overwrite"), f)(f"{path}.{f}")
                out[f"{name}.{f}"] = f"{path}.{f}"
    return out


def _picture(df: DataFrame, name: str, path: str) -> str:
    import matplotlib  # optional

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    rows = [r.asDict() for r in df.orderBy(*df.columns[:2]).collect()]
    figure, axes = plt.subplots(figsize=(9, 5))
    values = [r.get("value", r.get("percent")) for r in rows]
    axes.barh([f"{r['model']} {r.get('metric', r.get('level'))}" for r in rows], values)
    axes.set_title(name)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    figure.savefig(path, bbox_inches="tight")
    plt.close(figure)
    return path


def to_json(metrics: DataFrame) -> list[dict]:
    return [json.loads(r) for r in metrics.toJSON().collect()]
