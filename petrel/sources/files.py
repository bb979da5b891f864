"""CSV and JSON files or texts -> the canonical event table; the dispatcher over all kinds of source."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS
from . import ocel
from .rows import from_dataframe, from_dicts, from_maps, from_pandas

_CSV = {"header": "true", "multiLine": "true", "escape": '"', "emptyValue": "", "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str, model: str) -> DataFrame:
    """A CSV file; all values are text and an empty cell is an empty text."""
    df = spark.read.options(**_CSV).csv(path)
    return from_dataframe(df.na.fill(""), model)


def csv_text(spark: SparkSession, text: str, model: str) -> DataFrame:
    import csv
    import io

    return from_dicts(spark, [{k: ("" if v is None else v) for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(text.strip()))], model)


def from_json_documents(docs: DataFrame, model: str) -> DataFrame:
    """``docs``: (value), one JSON document a row. An array gives its elements as rows, an object with "events" is a
    simplified object-centric log, any other object is one row."""
    value = F.trim("value")
    is_list = value.startswith("[")
    has_events = F.coalesce(F.array_contains(F.json_object_keys(value), "events"), F.lit(False)) & ~is_list
    items = docs.select(F.when(is_list, F.from_json(value, "array<string>")).otherwise(F.array(value)).alias("items")).where(~has_events)
    rows = items.select(F.posexplode("items").alias("source_row", "item"))
    rows = rows.select(
        F.lit(model).alias("model"), F.col("source_row").cast("long").alias("source_row"), F.json_object_keys("item").alias("keys"),
        F.from_json("item", "map<string,string>").alias("row"),
    ).where("keys is not null")
    return from_maps(rows).unionByName(ocel.simplified(docs.where(has_events), model))


def read_json(spark: SparkSession, path: str, model: str) -> DataFrame:
    return from_json_documents(spark.read.text(path, wholetext=True), model)


def json_text(spark: SparkSession, text: str, model: str) -> DataFrame:
    if not isinstance(json.loads(text), list | dict):
        raise ValueError("a JSON document must be an array or an object")
    return from_json_documents(spark.createDataFrame([(text,)], "value string"), model)


def parse(spark: SparkSession, source, model: str = "Dataset", format: str | None = None) -> DataFrame:
    """Any supported source: a canonical or other DataFrame, pandas, dictionaries, a path, or CSV or JSON text.

    A path that ends in .json is JSON, any other one CSV, unless ``format`` ("csv", "json", "ocel2", "ocel1", "ocel_csv") says otherwise.
    """
    if isinstance(source, DataFrame):
        if set(COLUMNS) <= set(source.columns):
            return source.select(*COLUMNS).withColumn("model", F.lit(model))
        return from_dataframe(source, model)
    if hasattr(source, "to_dict") and hasattr(source, "columns"):
        return from_pandas(spark, source, model)
    if isinstance(source, list):
        return from_dicts(spark, source, model)
    if isinstance(source, Path) or (isinstance(source, str) and "\n" not in source and source.lstrip()[:1] not in ("{", "[") and (os.path.exists(source) or "://" in source)):
        path = str(source)
        kind = format or ("json" if path.endswith(".json") else "csv")
        if kind in ("ocel2", "ocel1"):
            return ocel.parse_json(spark.read.text(path, wholetext=True), model, kind)
        if kind == "ocel_csv":
            return ocel.read_csv(spark, path, model)
        return read_json(spark, path, model) if kind == "json" else read_csv(spark, path, model)
    if isinstance(source, str):
        return json_text(spark, source, model) if source.lstrip()[:1] in ("{", "[") else csv_text(spark, source, model)
    raise TypeError(f"cannot read a source of type {type(source).__name__}")
