"""Rows of any shape -> the canonical event table.

Rows arrive as ``MAP<STRING,STRING>`` with the order of their keys, so that a key that is absent and one whose value is null stay apart: a
present null reads as the text "None" (and is later dropped as a placeholder), an absent key as the field's default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_objects, strip
from ..functions.time import generic_timestamp
from ..schema import COLUMNS, FIELD_OF


def canonical_key(key: Column) -> Column:
    """The canonical field of a header, or null: an alias lookup in a literal map."""
    table = F.create_map(*[F.lit(x) for pair in FIELD_OF.items() for x in pair])
    return F.try_element_at(table, F.lower(strip(key)))


def from_maps(rows: DataFrame) -> DataFrame:
    """``rows``: (model, source_row, keys ARRAY<STRING>, row MAP<STRING,STRING>) -> the canonical event table.

    If several columns map to one field, the last in key order wins. Rows without an activity or an object type give nothing.
    """
    known = F.transform("keys", lambda k: F.struct(k.alias("key"), canonical_key(k).alias("field")))
    r = rows.withColumn("_k", known)

    def field(name: str) -> Column:
        last = F.try_element_at(F.filter("_k", lambda k: k["field"] == name), F.lit(-1))
        return F.when(last.isNotNull(), F.coalesce(F.try_element_at("row", last["key"]), F.lit("None")))

    others = F.transform(F.filter("_k", lambda k: k["field"].isNull()), lambda k: k["key"])
    r = r.select(
        "model", "source_row", *[field(n).alias(n) for n in ("activity", "object_type", "object_id", "case_id", "timestamp", "event_id")],
        F.map_filter("row", lambda k, v: F.array_contains(others, k)).alias("extra"),
    )
    r = r.withColumn("activity", strip(F.coalesce("activity", F.lit(""))))
    r = r.select("*", F.posexplode(split_objects(F.coalesce("object_type", F.lit("")))).alias("pos", "_type")).where("activity <> ''")
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    return r.select(
        "model", "activity", F.col("_type").alias("object_type"), text("object_id").alias("object_id"), text("case_id").alias("case_id"),
        generic_timestamp(F.col("timestamp")).alias("ts"), F.coalesce(strip(F.col("event_id")), F.format_string("evt_%06d", "source_row")).alias("event_id"),
        "source_row", "pos", "extra",
    ).select(*COLUMNS)


def from_dicts(spark: SparkSession, rows: list[dict], model: str) -> DataFrame:
    """Python dictionaries. Lists become JSON text, other values their text."""
    import json

    def text(v):
        return None if v is None else json.dumps(v) if isinstance(v, list | dict) else str(v)

    data = [(model, i, [str(k) for k in r], {str(k): text(v) for k, v in r.items()}) for i, r in enumerate(rows)]
    return from_maps(spark.createDataFrame(data, "model string, source_row long, keys array<string>, row map<string,string>"))


def _settled(df: DataFrame) -> DataFrame:
    """``df`` over the partitions of one execution of its plan, so that all who read it see the same rows in each: two plans of one shuffle
    may merge its partitions differently. Its shuffles run here, what follows the last one whenever it is read; nothing is stored."""
    spark, frame = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False), spark)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a dense 0-based ``source_row`` in input order.

    A row's number is its place in its partition after the rows of the partitions before. These are counted by one small aggregation over the same
    partitions; its result, a row per partition, is what the window runs over and what is sent to the rows.
    """
    at = _settled(df).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = at.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_p").alias("_of"), (before - F.col("first")).alias("_offset"))
    return at.join(F.broadcast(offsets), F.col("_p") == F.col("_of")).withColumn("source_row", F.col("_m") + F.col("_offset")).drop("_p", "_m", "_of", "_offset")


def from_dataframe(df: DataFrame, model: str) -> DataFrame:
    """A Spark DataFrame with any columns; its own column order decides between aliases."""
    columns = df.columns
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    rows = numbered(df).select(F.lit(model).alias("model"), "source_row", F.array(*map(F.lit, columns)).alias("keys"), F.create_map(*pairs).alias("row"))
    return from_maps(rows)


def from_pandas(spark: SparkSession, pdf, model: str) -> DataFrame:
    return from_dicts(spark, pdf.to_dict("records"), model)
