"""The object-interaction graph: edges, degrees, components, distances, diameter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(relations: DataFrame) -> DataFrame:
    """(model, o1, o2, weight, shared_activities), o1 < o2: object types that share activities.

    An equi-join on the activity in place of all pairs of types; the relations are distinct pairs, so an activity has
    as many rows as object types.
    """
    r1, r2 = (relations.select("model", "activity", F.col("object_type").alias(o)) for o in ("o1", "o2"))
    met = r1.join(r2, ["model", "activity"]).where("o1 < o2")
    return met.groupBy("model", "o1", "o2").agg(F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_list("activity")).alias("shared_activities"))


def degrees(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(model, object_type, degree), isolated ones with 0."""
    ends = links.select("model", F.explode(F.array("o1", "o2")).alias("object_type")).groupBy("model", "object_type").agg(F.count(F.lit(1)).alias("degree"))
    return objects.select("model", "object_type").join(ends, ["model", "object_type"], "left").na.fill(0, ["degree"])


def _searched(key, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Breadth-first search from every node of one model: component (its smallest node), its size, eccentricity."""
    near: dict[str, set[str]] = {n: set() for n in nodes["object_type"]}
    for a, b in zip(links["o1"], links["o2"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rows = []
    for start in near:
        seen, front, far = {start}, [start], 0
        while True:
            front = [y for x in front for y in near[x] if y not in seen and not seen.add(y)]
            if not front:
                break
            far += 1
        rows.append((key[0], start, min(seen), len(seen), far))
    return pd.DataFrame(rows, columns=["model", "object_type", "component", "size", "eccentricity"])


def components(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(model, object_type, component, size, eccentricity); a component is named by its smallest node.

    One task searches one model's graph, whose nodes are object types: hundreds, not data. All models run in one job.
    """
    nodes = objects.select(F.col("model").alias("model"), "object_type")  # attributes of its own: both sides may stem from one table
    pairs = links.select(F.col("model").alias("model"), "o1", "o2")
    schema = "model string, object_type string, component string, size long, eccentricity long"
    return nodes.groupBy("model").cogroup(pairs.groupBy("model")).applyInPandas(_searched, schema)


def diameter(found: DataFrame) -> DataFrame:
    """(model, diam): of the largest component; among equally large ones of that with the smallest name."""
    per = found.groupBy("model", "component").agg(F.max("size").alias("size"), F.max("eccentricity").alias("diam"))
    return per.groupBy("model").agg(F.min(F.struct((-F.col("size")).alias("s"), "component", "diam"))["diam"].alias("diam"))
