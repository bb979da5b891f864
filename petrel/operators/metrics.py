"""The complexity metrics of every model in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_round, round4
from . import graph
from .extract import Model

#: Weights of the composite.
WEIGHTS = {"oid": 0.25, "sar": 0.25, "afo_norm": 0.25, "re_norm": 0.25}
#: Other names of the weights.
WEIGHT_NAMES = {"w_oid": "oid", "w_sar": "sar", "w_afo": "afo_norm", "w_re": "re_norm"}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def counts(m: Model, with_diameter: bool = True) -> DataFrame:
    """One row a model, empty ones too: integers and the entropy's sum, from which every metric follows."""
    links = graph.edges(m.relations)
    n_o = m.objects.groupBy("model").agg(F.count(F.lit(1)).alias("otc"))
    n_a = m.activities.groupBy("model").agg(F.count(F.lit(1)).alias("n_activities"))
    per_a = m.relations.groupBy("model", "activity").agg(F.count(F.lit(1)).alias("k"))
    per_a = per_a.groupBy("model").agg(F.sum("k").alias("aorc"), F.count_if(F.col("k") > 1).alias("n_shared"))
    per_o = m.relations.groupBy("model", "object_type").agg(F.count(F.lit(1)).alias("k"))
    # sum of -p log2 p over k of n: log2 n - sum(k log2 k) / n, so that one pass without n is enough
    per_o = per_o.groupBy("model").agg(F.count(F.lit(1)).alias("n_related"), F.sum(F.col("k") * F.log2(F.col("k"))).alias("k_log_k"))
    n_e = links.groupBy("model").agg(F.count(F.lit(1)).alias("n_edges"))
    out = m.models
    for part in (n_o, n_a, per_a, per_o, n_e, *([graph.diameter(graph.components(m.objects, links))] if with_diameter else [])):
        out = out.join(part, "model", "left")
    fill = ["otc", "n_activities", "aorc", "n_shared", "n_related", "n_edges", *(["diam"] if with_diameter else [])]
    return out.na.fill(0, fill).na.fill(0.0, ["k_log_k"])


def metrics(m: Model, weights: dict[str, float] | None = None, rounding: Callable[[Column], Column] = round4, with_diameter: bool = True) -> DataFrame:
    """``counts`` with oid, sar, afo, afo_norm, re, re_norm, oc, oii, composite. Each is rounded before the next uses it.

    ``weights`` override the defaults by name; unknown names are ignored and nothing is normalised.
    """
    given = {WEIGHT_NAMES.get(k, k): v for k, v in (weights or {}).items()}
    w = {k: float(given.get(k, v)) for k, v in WEIGHTS.items()}
    c, r = F.col, rounding
    out = counts(m, with_diameter)
    pairs = c("otc") * (c("otc") - 1) / F.lit(2)
    out = out.withColumn("oc", r(_ratio(2 * c("n_edges"), c("otc"))))
    out = out.withColumn("oid", r(F.when(c("otc") >= 2, _ratio(c("n_edges"), pairs)).otherwise(F.lit(0.0))))
    out = out.withColumn("sar", r(_ratio(c("n_shared"), c("n_activities"))))
    out = out.withColumn("afo", r(_ratio(c("aorc"), c("n_activities"))))
    out = out.withColumn("afo_norm", r(F.least(F.lit(1.0), _ratio(c("afo"), c("otc")))))
    entropy = F.when(c("aorc") > 0, F.log2(F.greatest(c("aorc"), F.lit(1))) - c("k_log_k") / F.greatest(c("aorc"), F.lit(1))).otherwise(F.lit(0.0))
    out = out.withColumn("re", r(F.greatest(F.lit(0.0), entropy)))
    most = F.when(c("otc") > 1, F.log2(F.greatest(c("otc"), F.lit(1)).cast("double"))).otherwise(F.lit(1.0))
    out = out.withColumn("re_norm", r(F.least(F.lit(1.0), c("re") / most)))
    out = out.withColumn("oii", r(_ratio(c("otc") - c("n_related"), c("otc"))))
    total = sum((c(k) * F.lit(v) for k, v in w.items()), F.lit(0.0))
    return out.withColumn("composite", r(F.least(F.lit(1.0), total))).drop("k_log_k", "n_shared", "n_related")


def exact_metrics(m: Model, weights: dict[str, float] | None = None) -> DataFrame:
    """``metrics`` rounded half even on the binary value, by an Arrow UDF over one row a model."""
    return metrics(m, weights, exact_round)


#: Labels of a metrics row in reports, in order.
LABELS = {
    "otc": "Object-type count", "aorc": "Relation count", "oid": "Interaction density", "sar": "Shared-activity ratio", "afo": "Activity fan-out",
    "re": "Relation entropy (bits)", "afo_norm": "Activity fan-out, 0 to 1", "re_norm": "Relation entropy, 0 to 1", "oc": "Object coupling",
    "composite": "Composite complexity", "oii": "Object isolation index", "diam": "Graph diameter",
}


def score(composite: Column) -> Column:
    """The composite as a percentage with one decimal."""
    return F.floor(F.least(F.lit(100.0), composite * 100) * 10 + 0.5).cast("double") / F.lit(10.0)


#: Upper bounds of the bands, their names, colours and descriptions.
BANDS = [
    (25, "Low", "#2ECC71", "Few cross-object dependencies"),
    (50, "Medium", "#F39C12", "Moderate inter-object coordination"),
    (75, "High", "#E67E22", "Dense cross-object interactions"),
    (None, "Very High", "#E74C3C", "Highly coupled, many shared activities"),
]


def band(percent: Column, part: int = 0) -> Column:
    """The name (0), colour (1) or description (2) of the band of a percentage."""
    out = F
    for top, *said in BANDS[:-1]:
        out = out.when(percent < top, said[part])
    return out.otherwise(BANDS[-1][1 + part])
