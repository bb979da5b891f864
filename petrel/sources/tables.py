"""Relational tables -> object-centric logs: the mappings that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import round4
from ..functions.time import generic_timestamp
from ..schema import COLUMNS

#: Object types that an event of each kind touches.
TOUCHES = {
    "AF": ["Order", "Part"], "AO": ["Part", "Supplier"], "NF": ["Supplier", "Nation"], "NO": ["Supplier"], "RF": ["Customer", "Order"], "RO": ["Order", "Part"],
    "place": ["Order", "Customer"], "click": ["User"], "view": ["User"], "signup": ["User"], "purchase": ["User", "Cart"], "error": ["Device"],
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _touched(activity: Column) -> Column:
    table = F.create_map(*[x for a, types in TOUCHES.items() for x in (F.lit(a), F.array(*map(F.lit, types)))])
    return F.try_element_at(table, activity)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(activity, event_id, ts) of every lineitem, order and event; only the columns needed are read."""
    l, o, e = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "events"))
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias("ts")
    out = l.select(F.concat("l_returnflag", "l_linestatus").alias("activity"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("event_id"), naive("l_shipdate"))
    out = out.unionAll(o.select(F.lit("place").alias("activity"), F.concat_ws("-", F.lit("o"), "o_orderkey").alias("event_id"), naive("o_orderdate")))
    return out.unionAll(e.select(F.col("event_type").alias("activity"), F.concat_ws("-", F.lit("e"), "event_id").alias("event_id"), naive("ts")))


def structural_log(spark: SparkSession, sf_dir: str, model: str = "tpch") -> DataFrame:
    """The canonical table of all three; the object types are a literal map, so nothing is joined or shuffled."""
    a = activities(spark, sf_dir).select("*", F.posexplode(_touched(F.col("activity"))).alias("pos", "object_type"))
    empty = F.lit("")
    return a.select(
        F.lit(model).alias("model"), "activity", "object_type", empty.alias("object_id"), empty.alias("case_id"), "ts", "event_id",
        F.lit(0).cast("long").alias("source_row"), "pos", F.create_map().cast("map<string,string>").alias("extra"),
    ).select(*COLUMNS)


def structural_support(spark: SparkSession, sf_dir: str, model: str = "tpch") -> DataFrame:
    """The relation support of ``structural_log``: events are counted by activity first, so the twelve counts are exploded, not the events."""
    n = activities(spark, sf_dir).groupBy("activity").agg(F.count(F.lit(1)).alias("support"))
    return n.select(F.lit(model).alias("model"), "activity", F.explode(_touched(F.col("activity"))).alias("object_type"), "support")


def market_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, activity, object_type, support): lineitems by market segment, brand and nation of the customer.

    Lineitems are summed by (order, part) columns as early as the joins allow: the fact table is joined to two dimensions by
    key, and only four narrow columns take part.
    """
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    of_order = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).select("o_orderkey", "c_mktsegment", "n_name")
    j = l.join(p, l.l_partkey == p.p_partkey).join(of_order, l.l_orderkey == of_order.o_orderkey)
    return j.groupBy(F.col("c_mktsegment").alias("model"), F.col("p_brand").alias("activity"), F.col("n_name").alias("object_type")).agg(F.count(F.lit(1)).alias("support"))


def market_relations(spark: SparkSession, sf_dir: str, spread: float = 1.5) -> DataFrame:
    """Pairs whose support stands out in their model: above mean + spread * standard deviation."""
    s = market_support(spark, sf_dir)
    limit = s.groupBy("model").agg(round4(F.avg("support") + F.lit(spread) * F.stddev_pop("support")).alias("least"))
    return s.join(limit, "model").where(F.col("support") > F.col("least")).select("model", "activity", "object_type")


def noisy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with noise that follows from the key: empty and placeholder names, odd case, rare names, repeated event ids."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    activity = (
        F.when(k % 11 == 0, "").when(k % 11 == 1, " N/A ").when(k % 11 == 2, F.concat(F.upper("event_type"), F.lit("  (core)")))
        .when(k % 11 == 3, F.concat(F.lit(" "), F.col("event_type"), F.lit("\tstep"))).when(k % 997 == 5, F.concat(F.lit("rare_"), (k % 5).cast("string"))).otherwise(F.col("event_type"))
    )
    kind = F.when(k % 13 == 0, "Unknown").when(k % 13 == 1, "purchase_order").when(k % 13 == 2, "o'neil").when(k % 499 == 7, F.concat(F.lit("once "), (k % 3).cast("string"))).otherwise("user")
    empty = F.lit("")
    return e.select(
        F.lit("noisy").alias("model"), activity.alias("activity"), kind.alias("object_type"), empty.alias("object_id"), empty.alias("case_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("e"), F.floor(k / 3).cast("string")).alias("event_id"), k.alias("source_row"),
        F.lit(0).alias("pos"), F.create_map().cast("map<string,string>").alias("extra"),
    ).select(*COLUMNS)


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, text, ts): event times written in several formats and parsed back by the cascade."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    f = lambda p: F.date_format("ts", p)
    text = (
        F.when(k % 7 == 0, f("yyyy-MM-dd'T'HH:mm:ss")).when(k % 7 == 1, f("yyyy-MM-dd HH:mm")).when(k % 7 == 2, f("dd/MM/yyyy")).when(k % 7 == 3, f("dd-MM-yyyy"))
        .when(k % 7 == 4, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))).when(k % 7 == 5, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(f("yyyy-MM-dd"))
    )
    return e.select("event_id", text.alias("text")).withColumn("ts", generic_timestamp(F.col("text")))
