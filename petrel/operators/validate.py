"""Findings about a model: one SELECT per rule over a statistics row per model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round4
from . import graph
from .extract import Model, integrity_violations

MAX_DENSITY = 0.9
#: Numbers of the rules by the code of their findings.
RULES = {
    "NO_OBJECTS": "V1", "NO_ACTIVITIES": "V1", "NO_RELATIONS": "V1", "ISOLATED_ACTIVITIES": "V3", "ISOLATED_OBJECTS": "V4", "SINGLE_OBJECT": "V5",
    "NO_INTERACTION": "V6", "DENSE": "V7", "DENSITY": "V7", "SINGLE_ACTIVITY": "V8",
}


def statistics(m: Model) -> DataFrame:
    """One row a model: counts, isolated names, edges, violations."""
    lone = []
    for table, key in ((m.activities, "activity"), (m.objects, "object_type")):
        alone = table.join(m.relations, ["model", key], "left_anti").groupBy("model").agg(F.array_sort(F.collect_list(key)).alias(f"isolated_{key}"))
        lone.append(alone)
    parts = [
        m.objects.groupBy("model").agg(F.count(F.lit(1)).alias("n_o")),
        m.activities.groupBy("model").agg(F.count(F.lit(1)).alias("n_a")),
        m.relations.groupBy("model").agg(F.count(F.lit(1)).alias("n_r")),
        graph.edges(m.relations).groupBy("model").agg(F.count(F.lit(1)).alias("n_e")),
        integrity_violations(m).groupBy("model").agg(F.count(F.lit(1)).alias("n_bad")),
        *lone,
    ]
    out = reduce(lambda a, b: a.join(b, "model", "left"), parts, m.models.select("model"))
    none = F.array().cast("array<string>")
    out = out.na.fill(0, ["n_o", "n_a", "n_r", "n_e", "n_bad"])
    return out.withColumns({c: F.coalesce(c, none) for c in ("isolated_activity", "isolated_object_type")})


def findings(m: Model, max_density: float = MAX_DENSITY) -> DataFrame:
    """(model, seq, rule, level, code, message). Rules in order; the last, "all clear", holds if no other does.

    Relation ends that are not declared are a finding each, so a model's findings are rows, never a list.
    """
    c = F.col
    shown = lambda x: F.concat(F.array_join(F.slice(x, 1, 5), ", "), F.when(F.size(x) > 5, ", ...").otherwise(""))
    whole = (c("n_o") > 0) & (c("n_a") > 0)
    density = round4(c("n_r") / F.greatest(c("n_a") * c("n_o"), F.lit(1)))
    said = F.concat(F.lit("relation density "), F.format_number(density, 2))
    rules = [
        ("ERROR", "NO_OBJECTS", c("n_o") == 0, F.lit("the model has no object types")),
        ("ERROR", "NO_ACTIVITIES", c("n_a") == 0, F.lit("the model has no activities")),
        ("ERROR", "NO_RELATIONS", c("n_r") == 0, F.lit("the model has no relations")),
        ("WARNING", "ISOLATED_ACTIVITIES", F.size("isolated_activity") > 0, F.concat(F.lit("activities without relation: "), shown("isolated_activity"))),
        ("WARNING", "ISOLATED_OBJECTS", F.size("isolated_object_type") > 0, F.concat(F.lit("object types without relation: "), shown("isolated_object_type"))),
        ("WARNING", "SINGLE_OBJECT", c("n_o") == 1, F.lit("the model has a single object type")),
        ("WARNING", "NO_INTERACTION", (c("n_o") >= 2) & (c("n_e") == 0), F.lit("no two object types share an activity")),
        ("WARNING", "DENSE", whole & (density > max_density), said),
        ("INFO", "DENSITY", whole & (density <= max_density), said),
        ("WARNING", "SINGLE_ACTIVITY", c("n_a") == 1, F.lit("the model has a single activity")),
    ]
    held = [F.when(when, F.struct(F.lit(k + 1).alias("seq"), F.lit(RULES[code]).alias("rule"), F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"))) for k, (level, code, when, text) in enumerate(rules)]
    clear = F.struct(F.lit(len(rules) + 1).alias("seq"), F.lit("V0").alias("rule"), F.lit("INFO").alias("level"), F.lit("ALL_CLEAR").alias("code"), F.lit("no finding").alias("message"))
    found = F.array_compact(F.array(*held))
    found = F.when((F.size(found) > 0) | (c("n_bad") > 0), found).otherwise(F.array(clear))
    out = statistics(m).select("model", F.explode(found).alias("f")).select("model", "f.*")
    kind = F.when(c("missing") == "activity", "activity").otherwise("object type")
    said = F.concat(F.lit("the relation of "), "activity", F.lit(" and "), "object_type", F.lit(" names an unknown "), kind)
    bad = integrity_violations(m).select("model", F.lit(4).alias("seq"), F.lit("V2").alias("rule"), F.lit("ERROR").alias("level"), F.lit("UNKNOWN_ENDS").alias("code"), said.alias("message"))
    return out.unionByName(bad)


def is_valid(found: DataFrame) -> DataFrame:
    """(model, is_valid, errors, warnings)."""
    level = lambda x: F.count_if(F.col("level") == x)
    return found.groupBy("model").agg(level("ERROR").alias("errors"), level("WARNING").alias("warnings")).withColumn("is_valid", F.col("errors") == 0)
