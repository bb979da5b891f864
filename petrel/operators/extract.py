"""From a clean event table to the model G = (O, A, R): objects, activities, relations, with support and a report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExtractConfig:
    min_relation_support: int = 1
    include_orphan_nodes: bool = False


@dataclass(frozen=True)
class Model:
    """Lazy tables, each keyed by ``model``: models(model, seq), objects, activities, relations, support."""

    models: DataFrame
    objects: DataFrame
    activities: DataFrame
    relations: DataFrame
    support: DataFrame | None = None

    def cached(self) -> Model:
        """With the relations kept: they are small, and every metric reads them."""
        return replace(self, relations=self.relations.cache(), objects=self.objects.cache(), activities=self.activities.cache())


def relation_support(events: DataFrame) -> DataFrame:
    """(model, activity, object_type, support): records of each pair; one aggregation with partial counts."""
    return events.groupBy("model", "activity", "object_type").agg(F.count(F.lit(1)).alias("support"))


def extract(events: DataFrame, config: ExtractConfig = ExtractConfig(), models: DataFrame | None = None) -> Model:
    """``models``: all models to report on, so that one without any record still has a row."""
    support = relation_support(events)
    relations = support.where(F.col("support") >= config.min_relation_support).select("model", "activity", "object_type")
    # With orphans all names of the log are nodes; they are read off the support, so the log is aggregated once.
    nodes = support if config.include_orphan_nodes else relations
    models = models if models is not None else events.select("model").distinct()
    return Model(models, nodes.select("model", "object_type").distinct(), nodes.select("model", "activity").distinct(), relations, support)


def orphans(support: DataFrame, min_support: int = 1) -> DataFrame:
    """(model, kind, name): names of the log that no relation of enough support touches."""
    out = None
    for kind in ("activity", "object_type"):
        best = support.groupBy("model", F.col(kind).alias("name")).agg(F.max("support").alias("best")).where(F.col("best") < min_support)
        part = best.select("model", F.lit(kind).alias("kind"), "name")
        out = part if out is None else out.unionByName(part)
    return out


def report(events: DataFrame, config: ExtractConfig = ExtractConfig(), models: DataFrame | None = None) -> DataFrame:
    """One row a model: pairs found, kept and suppressed, orphan names, warnings. ``models``: as in ``extract``."""
    s = relation_support(events)
    kept = F.col("support") >= config.min_relation_support
    totals = s.groupBy("model").agg(
        F.sum("support").alias("records"), F.count(F.lit(1)).alias("pairs"), F.count_if(kept).alias("relations"), F.count_if(~kept).alias("suppressed"),
        F.array_sort(F.collect_list(F.when(~kept, F.concat("activity", F.lit(" -> "), "object_type")))).alias("suppressed_pairs"),
    )
    lost = orphans(s, config.min_relation_support).groupBy("model").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))).alias(f"orphan_{n}") for k, n in (("activity", "activities"), ("object_type", "objects"))]
    )
    out = totals.join(lost, "model", "left")
    if models is not None:
        out = models.select("model").join(out, "model", "left").na.fill(0, ["records", "pairs", "relations", "suppressed"])
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("orphan_activities", "orphan_objects", "suppressed_pairs")})
    shown = lambda c: F.concat(F.array_join(F.slice(c, 1, 5), ", "), F.when(F.size(c) > 5, ", ...").otherwise(""))
    warnings = F.array(
        F.when(F.col("records") == 0, F.lit("the log is empty: no model")),
        F.when(F.col("suppressed") > 0, F.concat("suppressed", F.lit(" relations below the least support: "), shown("suppressed_pairs"))),
        F.when(F.size("orphan_activities") > 0, F.concat(F.lit("activities without a relation: "), shown("orphan_activities"))),
        F.when(F.size("orphan_objects") > 0, F.concat(F.lit("object types without a relation: "), shown("orphan_objects"))),
        F.when((F.col("records") > 0) & (F.col("relations") == 0), F.lit("no relation survived")),
    )
    return out.withColumn("warnings", F.array_compact(warnings)).drop("suppressed_pairs")


def integrity_violations(m: Model) -> DataFrame:
    """(model, activity, object_type, missing): relations whose activity or object type is not declared."""
    no_a = m.relations.join(m.activities, ["model", "activity"], "left_anti").withColumn("missing", F.lit("activity"))
    no_o = m.relations.join(m.objects, ["model", "object_type"], "left_anti").withColumn("missing", F.lit("object_type"))
    columns = ["model", "activity", "object_type", "missing"]
    return no_a.select(*columns).unionByName(no_o.select(*columns))


def from_dicts(spark: SparkSession, models: list[tuple[str, dict]]) -> Model:
    """Models given as (name, {"objects", "activities", "relations"}); raises ValueError for a relation to an unknown name."""
    named, objects, activities, relations = [], [], [], []
    for seq, (name, d) in enumerate(models):
        own_o, own_a = set(d.get("objects", ())), set(d.get("activities", ()))
        named.append((name, seq))
        objects += [(name, x) for x in sorted(own_o)]
        activities += [(name, x) for x in sorted(own_a)]
        for a, o in sorted({tuple(r) for r in d.get("relations", ())}):
            if a not in own_a or o not in own_o:
                raise ValueError(f"{name}: relation ({a}, {o}) has an undeclared end")
            relations.append((name, a, o))
    return Model(
        spark.createDataFrame(named, "model string, seq int"),
        spark.createDataFrame(objects, "model string, object_type string"),
        spark.createDataFrame(activities, "model string, activity string"),
        spark.createDataFrame(relations, "model string, activity string, object_type string"),
    )


def summary(events: DataFrame, total_raw_rows: DataFrame | None = None) -> DataFrame:
    """One row a model: records, distinct activities, object types and relations, and, given (model, total_raw_rows), the discard rate.

    The rate may be negative: one row can give several records.
    """
    from ..functions.rounding import round4

    s = relation_support(events)
    out = s.groupBy("model").agg(
        F.sum("support").alias("records"), F.count_distinct("activity").alias("activities"), F.count_distinct("object_type").alias("object_types"), F.count(F.lit(1)).alias("relations")
    )
    if total_raw_rows is None:
        return out
    out = total_raw_rows.join(out, "model", "left").na.fill(0, ["records", "activities", "object_types", "relations"])
    rate = F.when(F.col("total_raw_rows") > 0, 1 - F.col("records") / F.col("total_raw_rows")).otherwise(0.0)
    return out.withColumn("discard_rate", round4(rate))
