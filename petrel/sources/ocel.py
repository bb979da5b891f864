"""Object-centric event logs: OCEL 2.0 and 1.0 JSON, a simplified JSON, and CSV -> the canonical event table.

A JSON log is one document, so one task parses it, once. Object types are looked up in a map of the document's own objects while its references
are exploded: nothing is joined or shuffled, and documents do not see each other's objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.time import generic_timestamp, ocel_timestamp
from ..schema import COLUMNS

OCEL2 = (
    "objects array<struct<id:string,type:string>>, events array<struct<id:string,type:string,activity:string,time:string,"
    "timestamp:string,relationships:array<struct<objectId:string,qualifier:string>>>>"
)
OCEL1 = (
    "`ocel:objects` map<string,struct<`ocel:type`:string>>, `ocel:events` map<string,struct<`ocel:activity`:string,"
    "`ocel:timestamp`:string,`ocel:omap`:array<string>>>"
)
SIMPLE = (
    "objects array<struct<id:string,type:string,object_type:string>>, events array<struct<id:string,event_id:string,activity:string,activity_name:string,"
    "timestamp:string,time:string,case_id:string,omap:array<string>,objects:array<string>>>"
)


def _first_part(ref: Column) -> Column:
    return F.split_part(ref, F.lit(":"), F.lit(1))


def _typed(log: DataFrame, objects: Column) -> DataFrame:
    """``log`` with ``types``: a map from object id to type for each document. ``objects``: its array of (id, type).

    Empty ids and types are left out, and the last type of an id counts: the entries are sorted by (id, place) and all but the last of an id dropped.
    """
    entries = F.transform(F.coalesce(objects, F.array()), lambda o, k: F.struct(strip(o["id"]).alias("id"), k.alias("place"), strip(o["type"]).alias("type")))
    named = F.filter(entries, lambda e: (e["id"] != "") & (e["type"] != ""))
    log = log.withColumn("_sorted", F.array_sort(named))
    last = F.filter("_sorted", lambda e, k: ~F.coalesce(F.get(F.col("_sorted"), k + 1)["id"] == e["id"], F.lit(False)))
    return log.withColumn("types", F.map_from_entries(F.transform(last, lambda e: F.struct(e["id"], e["type"])))).drop("_sorted")


def _finished(rows: DataFrame, model: str, ts: Column) -> DataFrame:
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    return rows.select(
        F.lit(model).alias("model"), text("activity").alias("activity"), text("object_type").alias("object_type"), text("object_id").alias("object_id"),
        text("case_id").alias("case_id"), ts.alias("ts"), text("event_id").alias("event_id"), F.col("source_row").cast("long").alias("source_row"),
        F.col("pos").cast("int").alias("pos"), F.create_map().cast("map<string,string>").alias("extra"),
    ).select(*COLUMNS)


def parse_ocel2(docs: DataFrame, model: str) -> DataFrame:
    """OCEL 2.0. An event without relationships gives no row; an unknown object's type is the part of its id before ":"."""
    log = docs.select(F.from_json("value", OCEL2).alias("log"))
    log = _typed(log, F.transform("log.objects", lambda o: F.struct(o["id"].alias("id"), o["type"].alias("type"))))
    events = log.select("types", F.posexplode("log.events").alias("source_row", "e"))
    refs = events.select("types", "source_row", "e", F.posexplode("e.relationships").alias("pos", "r")).withColumn("object_id", strip(F.coalesce("r.objectId", F.lit(""))))
    rows = refs.select(
        "source_row", "pos", F.coalesce("e.type", "e.activity", F.lit("")).alias("activity"), "object_id",
        F.coalesce("e.time", "e.timestamp").alias("time"), F.coalesce(F.col("e.id"), F.concat(F.lit("evt_"), F.col("source_row") + 1)).alias("event_id"), F.lit("").alias("case_id"),
        F.coalesce(F.try_element_at("types", F.col("object_id")), _first_part(F.col("object_id"))).alias("object_type"),
    )
    return _finished(_named(rows), model, ocel_timestamp(F.col("time")))


def _named(rows: DataFrame) -> DataFrame:
    """The rows with an activity and an object type."""
    return rows.where((strip(F.coalesce("activity", F.lit(""))) != "") & (strip(F.coalesce("object_type", F.lit(""))) != ""))


def parse_ocel1(docs: DataFrame, model: str) -> DataFrame:
    """OCEL 1.0: objects and events are maps by id. An unknown object's type is the part of its id before ":", else "unknown"."""
    log = docs.select(F.from_json("value", OCEL1).alias("log"))
    log = _typed(log, F.transform(F.map_entries("log.`ocel:objects`"), lambda o: F.struct(o["key"].alias("id"), o["value"]["ocel:type"].alias("type"))))
    events = log.select("types", F.posexplode(F.map_entries("log.`ocel:events`")).alias("source_row", "e"))
    refs = events.select("types", "source_row", "e", F.posexplode("e.value.`ocel:omap`").alias("pos", "ref")).withColumn("object_id", strip(F.coalesce("ref", F.lit(""))))
    unknown = F.when(F.col("object_id").contains(":"), _first_part(F.col("object_id"))).otherwise("unknown")
    rows = refs.select(
        "source_row", "pos", F.col("e.value.`ocel:activity`").alias("activity"), "object_id", F.col("e.value.`ocel:timestamp`").alias("time"),
        F.col("e.key").alias("event_id"), F.lit("").alias("case_id"), F.coalesce(F.try_element_at("types", F.col("object_id")), unknown).alias("object_type"),
    )
    return _finished(_named(rows), model, ocel_timestamp(F.col("time")))


def parse_json(docs: DataFrame, model: str, kind: str | None = None) -> DataFrame:
    """``docs``: (value), whole documents. Without ``kind`` the keys of the first one tell the version: OCEL 2.0 has both "events" and "objects", OCEL 1.0
    has "ocel:events"; neither raises ValueError."""
    if kind is None:
        keys = set(docs.select(F.json_object_keys("value").alias("k")).first().k or [])
        kind = "ocel2" if {"events", "objects"} <= keys else "ocel1" if "ocel:events" in keys else None
    if kind not in ("ocel1", "ocel2"):
        raise ValueError("neither an OCEL 2.0 nor an OCEL 1.0 document")
    return parse_ocel2(docs, model) if kind == "ocel2" else parse_ocel1(docs, model)


def simplified(docs: DataFrame, model: str) -> DataFrame:
    """Events with ``omap`` or ``objects`` lists of ids. An id that is unknown or has no type is its own type; an event's id is its ``id`` or ``event_id``."""
    log = docs.select(F.from_json("value", SIMPLE).alias("log"))
    log = _typed(log, F.transform("log.objects", lambda o: F.struct(o["id"].alias("id"), F.coalesce(o["type"], o["object_type"]).alias("type"))))
    events = log.select("types", F.posexplode("log.events").alias("source_row", "e"))
    refs = events.select("types", "source_row", "e", F.posexplode(F.coalesce("e.omap", "e.objects")).alias("pos", "object_id"))
    rows = refs.select(
        "source_row", "pos", F.coalesce("e.activity", "e.activity_name", F.lit("")).alias("activity"), "object_id",
        F.coalesce("e.timestamp", "e.time").alias("time"), F.coalesce("e.id", "e.event_id").alias("event_id"), F.col("e.case_id").alias("case_id"),
        F.coalesce(F.try_element_at("types", F.col("object_id")), F.col("object_id")).alias("object_type"),
    )
    return _finished(_named(rows), model, generic_timestamp(F.col("time")))


#: Columns of a CSV log that hold no objects, if none is named ocel:type:*.
NO_OBJECTS = ["ocel:eid", "ocel:activity", "ocel:timestamp", "ocel:eid:complete", "time:timestamp", "concept:name"]


def from_csv(df: DataFrame, model: str, max_rows: int | None = None) -> DataFrame:
    """A CSV log: each object column holds ids, "[...]" or separated by commas. A row without any gives a row with an empty object type.
    ``max_rows``: only the first rows of the file. An event has the id in its cell, be it empty, or its row's number if there is no column of ids."""
    from .rows import numbered

    df = numbered(df)
    df = df.where(F.col("source_row") < max_rows) if max_rows else df
    named = {c: c.removeprefix("ocel:type:") for c in df.columns if c.startswith("ocel:type:")}
    named = named or {c: c for c in df.columns if c not in [*NO_OBJECTS, "source_row"]}
    get = lambda *cs: F.coalesce(*[F.col(f"`{c}`") for c in cs if c in df.columns][:1], F.lit(""))

    def ids(cell: Column) -> Column:
        whole = strip(F.coalesce(cell, F.lit("")))
        text = F.when(F.lower(whole).isin("nan", "none"), "").otherwise(F.btrim(whole, F.lit("[]")))
        parts = F.transform(F.split(text, ","), lambda x: F.btrim(strip(x), F.lit("'\"")))
        return F.filter(parts, lambda x: x != "")

    def typed(kind: str, cell: Column) -> Column:
        return F.transform(ids(cell), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("id")))

    each = [typed(t, F.col(f"`{c}`")) for c, t in named.items()]
    found = F.flatten(F.array(*each)) if each else F.array().cast("array<struct<type:string,id:string>>")
    rows = df.select(
        "source_row", get("ocel:activity", "concept:name").alias("activity"), get("ocel:timestamp", "time:timestamp").alias("time"),
        (get("ocel:eid") if "ocel:eid" in df.columns else F.concat(F.lit("row_"), F.col("source_row") + 1)).alias("event_id"), F.lit("").alias("case_id"), F.posexplode_outer(found).alias("pos", "o"),
    )
    rows = rows.select("*", F.coalesce("o.type", F.lit("")).alias("object_type"), F.coalesce("o.id", F.lit("")).alias("object_id")).na.fill(0, ["pos"])
    return _finished(rows.where(strip(F.col("activity")) != ""), model, ocel_timestamp(F.col("time")))


def read_csv(spark: SparkSession, path: str, model: str, max_rows: int | None = None) -> DataFrame:
    return from_csv(spark.read.options(header="true", multiLine="true", escape='"').csv(path), model, max_rows)
