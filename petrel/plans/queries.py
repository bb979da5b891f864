"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug, split_objects
from ..operators import charts, clean, compare, extract, graph, metrics, validate
from ..operators.clean import CleanConfig
from ..operators.extract import Model
from ..shipping import ship
from ..sources import ocel, rows, samples, tables
from . import cases

_ALL = CleanConfig(min_activity_freq=50, min_object_freq=20)


def _model(relations: DataFrame, declared: DataFrame | None = None) -> Model:
    models = relations.select("model").distinct()
    objects = declared if declared is not None else relations.select("model", "object_type").distinct()
    return Model(models, objects, relations.select("model", "activity").distinct(), relations)


def _structural(spark: SparkSession, sf_dir: str) -> Model:
    """The structural log's model; its support is twelve counts, so everything after it is tiny."""
    ship(spark)
    return _model(tables.structural_support(spark, sf_dir).select("model", "activity", "object_type"))


def _market(spark: SparkSession, sf_dir: str) -> Model:
    """Five models by segment, with every nation declared, so that some are isolated. The relations are kept, as several parts read them."""
    ship(spark)
    relations = tables.market_relations(spark, sf_dir).cache()
    nations = tables.read(spark, sf_dir, "nation").select(F.col("n_name").alias("object_type"))
    return _model(relations, relations.select("model").distinct().crossJoin(F.broadcast(nations)))  # models x 25 nations


# ------------------------------------------------------------------ support and relations


def relation_support(spark, sf_dir):
    return tables.structural_support(spark, sf_dir)


def relation_support_of_log(spark, sf_dir):
    return extract.relation_support(tables.structural_log(spark, sf_dir))


def relations_min_support(spark, sf_dir):
    return tables.market_relations(spark, sf_dir)


def orphans(spark, sf_dir):
    return extract.orphans(tables.market_support(spark, sf_dir).withColumn("support", F.col("support") % 7), 6)


def integrity_violations(spark, sf_dir):
    m = _market(spark, sf_dir)
    known = m.objects.where(F.length("object_type") > 5)
    return extract.integrity_violations(Model(m.models, known, m.activities.where("activity <> 'Brand#11'"), m.relations))


# ------------------------------------------------------------------ cleaning


def clean_normalise(spark, sf_dir):
    t = clean.tagged(tables.noisy_log(spark, sf_dir), CleanConfig(deduplicate=False)).where("drop_reason is null")
    return t.select("source_row", "activity", "object_type")


def clean_placeholders(spark, sf_dir):
    t = clean.tagged(tables.noisy_log(spark, sf_dir), CleanConfig(deduplicate=False)).where("drop_reason = 'placeholder'")
    return t.select("source_row", "raw_activity", "raw_object_type")


def clean_drop_counts(spark, sf_dir):
    r = clean.report(tables.noisy_log(spark, sf_dir), _ALL)
    return r.select("model", "rows_in", "rows_out", "total_dropped", *[f"dropped_{x}" for x in clean.REASONS])


def rare_activity_filter(spark, sf_dir):
    c = clean.clean(tables.noisy_log(spark, sf_dir), CleanConfig(min_activity_freq=50, deduplicate=False))
    return c.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


def rare_object_filter(spark, sf_dir):
    c = clean.clean(tables.noisy_log(spark, sf_dir), CleanConfig(min_activity_freq=50, min_object_freq=20, deduplicate=False))
    return c.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


def dedup_first_wins(spark, sf_dir):
    return clean.clean(tables.noisy_log(spark, sf_dir)).select("source_row", "activity", "object_type", "event_id")


# ------------------------------------------------------------------ parsing


def expand_multi_object(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    k = F.col("event_id")
    cell = F.when(k % 4 == 0, "User|Cart").when(k % 4 == 1, '["User", "Item", null]').when(k % 4 == 2, " User ;; Device, ").otherwise("['User', 'Cart']")
    return e.select("event_id", F.posexplode(split_objects(cell)).alias("pos", "object_type"))


def alias_projection(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    k = F.col("event_id")
    keys = F.when(k % 2 == 0, F.array(*map(F.lit, ["Event_Name ", "entity", "id", "region"]))).otherwise(F.array(*map(F.lit, ["action", "TYPE", "task"])))
    even = F.create_map(F.lit("Event_Name "), F.col("event_type"), F.lit("entity"), F.lit("User"), F.lit("id"), k.cast("string"), F.lit("region"), F.lit("EU"))
    odd = F.create_map(F.lit("action"), F.lit("x"), F.lit("TYPE"), F.lit("User;Cart"), F.lit("task"), F.when(k % 3 == 0, F.col("event_type")))
    r = rows.from_maps(e.select(F.lit("m").alias("model"), k.alias("source_row"), keys.alias("keys"), F.when(k % 2 == 0, even).otherwise(odd).alias("row")))
    return r.select("source_row", "pos", "activity", "object_type", "event_id", F.try_element_at("extra", F.lit("region")).alias("region"))


def timestamp_cascade(spark, sf_dir):
    return tables.stamped(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def _orders_log(spark, sf_dir) -> DataFrame:
    """(doc, o_orderkey, status, refs): an order and the parts of its lineitems as object references."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    l = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return o.join(l, o.o_orderkey == l.l_orderkey).select("o_orderkey", "o_orderstatus", "parts")


def ocel2_join(spark, sf_dir):
    """Each order as an OCEL 2.0 document of one event: parts with an even key are declared objects, others are not."""
    log = _orders_log(spark, sf_dir)
    objects = F.transform(F.filter("parts", lambda p: p % 2 == 0), lambda p: F.struct(F.concat(F.lit("part:"), p).alias("id"), F.lit("Declared").alias("type")))
    refs = F.transform("parts", lambda p: F.struct(F.concat(F.lit("part:"), p).alias("objectId")))
    event = F.struct(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("status "), "o_orderstatus").alias("type"), F.lit("2024-01-02T03:04:05+02:00").alias("time"), refs.alias("relationships"))
    docs = log.select(F.to_json(F.struct(F.array(event).alias("events"), objects.alias("objects"))).alias("value"))
    return ocel.parse_ocel2(docs, "orders").groupBy("activity", "object_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.date_format("ts", "HH:mm:ss")).alias("at"))


def ocel1_map_explode(spark, sf_dir):
    """Each order as an OCEL 1.0 document; undeclared parts have no prefix, so they are "unknown"."""
    log = _orders_log(spark, sf_dir)
    declared = F.transform(F.filter("parts", lambda p: p % 2 == 0), lambda p: F.struct(F.concat(F.lit("p"), p).alias("k"), F.struct(F.lit("Part").alias("ocel:type")).alias("v")))
    event = F.struct(F.concat(F.lit("status "), "o_orderstatus").alias("ocel:activity"), F.lit("2024-01-02").alias("ocel:timestamp"), F.transform("parts", lambda p: F.concat(F.lit("p"), p)).alias("ocel:omap"))
    docs = log.select(F.to_json(F.struct(F.map_from_entries(declared).alias("ocel:objects"), F.create_map(F.concat(F.lit("o"), "o_orderkey"), event).alias("ocel:events"))).alias("value"))
    return ocel.parse_ocel1(docs, "orders").groupBy("activity", "object_type").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_ts"))


def ocel_csv_unpivot(spark, sf_dir):
    log = _orders_log(spark, sf_dir)
    cell = F.when(F.col("o_orderkey") % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: F.concat(F.lit("'p"), p, F.lit("'"))), ", "), F.lit("]")))
    wide = log.select(F.concat(F.lit("o"), "o_orderkey").alias("ocel:eid"), F.col("o_orderstatus").alias("ocel:activity"), cell.alias("ocel:type:part"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("o"), "o_orderkey")).alias("ocel:type:order"))
    return ocel.from_csv(wide, "orders").groupBy("activity", "object_type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ graph and metrics


def interaction_edges(spark, sf_dir):
    return graph.edges(_market(spark, sf_dir).relations).select("model", "o1", "o2", "weight", F.array_join("shared_activities", ",").alias("shared_activities"))


def node_degree(spark, sf_dir):
    m = _market(spark, sf_dir)
    return graph.degrees(m.objects, graph.edges(m.relations))


def _metric(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: metrics.metrics(_market(spark, sf_dir), with_diameter=False).select("model", *names)


_WIDE = ["model", "otc", "n_activities", "aorc", "n_edges", "oc", "oid", "sar", "afo", "afo_norm", "re", "re_norm", "oii", "composite"]


def metrics_all_by_model(spark, sf_dir):
    m, s = _market(spark, sf_dir), _structural(spark, sf_dir)
    both = Model(*[getattr(m, c).unionByName(getattr(s, c)) for c in ("models", "objects", "activities", "relations")])
    return metrics.metrics(both, with_diameter=False).select(*_WIDE)


def graph_components(spark, sf_dir):
    m = _structural(spark, sf_dir)
    return graph.components(m.objects, graph.edges(m.relations))


def graph_diameter(spark, sf_dir):
    return graph.diameter(graph_components(spark, sf_dir))


def validation_findings(spark, sf_dir):
    return validate.findings(_market(spark, sf_dir)).select("model", "level", "code")


def comparison_long(spark, sf_dir):
    return compare.long(metrics.metrics(_market(spark, sf_dir), with_diameter=False))


def comparison_rank(spark, sf_dir):
    return compare.ranking(metrics.metrics(_market(spark, sf_dir), with_diameter=False))


def complexity_band(spark, sf_dir):
    return compare.bands(metrics.metrics(_market(spark, sf_dir), with_diameter=False))


def sample_models_metrics(spark, sf_dir):
    ship(spark)
    return metrics.exact_metrics(extract.from_dicts(spark, samples.models())).select(*_WIDE, "diam")


def log_summary(spark, sf_dir):
    return extract.summary(tables.noisy_log(spark, sf_dir))


def discard_rate(spark, sf_dir):
    raw = tables.noisy_log(spark, sf_dir)
    total = raw.groupBy("model").agg(F.count_distinct("source_row").alias("total_raw_rows"))
    return extract.summary(clean.clean(raw), total).select("model", "total_raw_rows", "records", "discard_rate")


def chart_nodes(spark, sf_dir):
    return charts.graph_nodes(_structural(spark, sf_dir)).select("model", "object_type", "n_activities", "degree", "size")


def chart_bipartite(spark, sf_dir):
    return charts.bipartite_nodes(_structural(spark, sf_dir))


def name_slugs(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
    for name, columns in (
        ("metric_oid", ("oid",)), ("metric_sar", ("sar",)), ("metric_afo", ("afo", "afo_norm")), ("metric_re", ("re", "re_norm")), ("metric_oc", ("oc",)),
        ("metric_oii", ("oii",)), ("metric_counts", ("otc", "aorc")), ("metric_composite", ("composite",)),
    ):
        own[name] = _metric(*columns)
    return own | cases.queries()
