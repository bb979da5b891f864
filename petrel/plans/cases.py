"""Queries for the operators whose inputs are small logs and models: each beside the SQL that it must agree with.

The logs are made of ``nation``, which has 25 rows at every scale; operators on whole tables are in ``queries``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, clean, compare, extract, graph, metrics, validate
from ..operators.extract import ExtractConfig, Model
from ..sources import files, ocel, registry, rows, tables
from .pipeline import Pipeline

#: Relations of the structural log below this support are suppressed in the cases.
LEAST = 1500


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return tables.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def _visits(spark: SparkSession, sf_dir: str) -> list[dict]:
    return [{"activity": f"visit {r.n_regionkey}", "object_type": r.n_name} for r in _nations(spark, sf_dir)]


def _document(spark: SparkSession, doc: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(doc),)], "value string")


# ------------------------------------------------------------------ sources


def source_kinds(spark, sf_dir):
    """One log as every kind of source that the dispatcher takes."""
    import pandas as pd

    data = _visits(spark, sf_dir)
    text = "activity,object_type\n" + "\n".join(f"{r['activity']},{r['object_type']}" for r in data) + "\n"
    frame = spark.createDataFrame([(r["activity"], r["object_type"]) for r in data], "activity string, object_type string").coalesce(1)
    kinds = {"list": data, "pandas": pd.DataFrame(data), "csv": text, "json": json.dumps(data), "frame": frame, "parsed": rows.from_dicts(spark, data, "x")}
    parsed = [files.parse(spark, source, kind) for kind, source in kinds.items()]
    return reduce(DataFrame.unionByName, parsed).select("model", "activity", "object_type", "source_row")


def simplified_log(spark, sf_dir):
    """Events with ids under either name; objects of an empty type and unknown ones are their own types."""
    found = _nations(spark, sf_dir)
    events = [{("event_id" if r.n_nationkey % 2 else "id"): f"e{r.n_nationkey}", "activity": f"visit {r.n_regionkey}", "omap": [r.n_name, "lost"]} for r in found]
    doc = {"events": [*events, {"id": "idle", "activity": "idle", "omap": []}], "objects": [{"id": r.n_name, "type": "Nation" if r.n_nationkey % 2 else " "} for r in found]}
    return files.parse(spark, json.dumps(doc), "m").select("event_id", "activity", "object_type", "object_id")


def ocel_dispatch(spark, sf_dir):
    """Both versions of the JSON format, told apart by their keys; the last type of an id counts, empty ones do not."""
    found = _nations(spark, sf_dir)
    two = {
        "objects": [{"id": r.n_name, "type": t} for t in ("First", "Nation", " ") for r in found if r.n_nationkey % 3],
        "events": [{"id": f"e{r.n_nationkey}", "type": "visit", "time": "2024-01-02T03:04:05Z", "relationships": [{"objectId": r.n_name}, {"objectId": f"key:{r.n_nationkey}"}]} for r in found],
    }
    one = {
        "ocel:objects": {r.n_name: {"ocel:type": "Nation" if r.n_nationkey % 3 else ""} for r in found},
        "ocel:events": {f"e{r.n_nationkey}": {"ocel:activity": "visit", "ocel:timestamp": "2024-01-02T03:04:05", "ocel:omap": [r.n_name, f"key:{r.n_nationkey}"]} for r in found},
    }
    both = [ocel.parse_json(_document(spark, doc), model) for doc, model in ((two, "two"), (one, "one"))]
    return reduce(DataFrame.unionByName, both).select("model", "event_id", "object_type", F.date_format("ts", "HH:mm:ss").alias("at"))


def ocel_csv_rows(spark, sf_dir):
    """The first ten rows of a CSV log: empty ids stay empty, "nan" counts only as a whole cell."""
    cell = F.when(F.col("n_nationkey") % 4 == 0, "nan").when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("['"), "n_name", F.lit("', 'none']"))).otherwise(F.col("n_name"))
    n = tables.read(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1)
    wide = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("ocel:eid"), F.lit("visit").alias("ocel:activity"), cell.alias("ocel:type:nation"))
    return ocel.from_csv(wide, "m", max_rows=10).select("source_row", "event_id", "object_type", "object_id")


def numbered_rows(spark, sf_dir):
    n = rows.numbered(tables.read(spark, sf_dir, "orders").select("o_orderkey"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.min("source_row").alias("low"), F.max("source_row").alias("high"), F.count_distinct("source_row").alias("different"))


def generated_logs(spark, sf_dir):
    """What the stand-ins of public logs relate."""
    made = reduce(DataFrame.unionByName, [make(spark) for make in registry.MOCKS.values()])
    s = extract.relation_support(made)
    return s.groupBy("model").agg(F.count_distinct("activity").alias("activities"), F.count_distinct("object_type").alias("object_types"), F.count(F.lit(1)).alias("relations"))


# ------------------------------------------------------------------ extraction


def min_support_relations(spark, sf_dir):
    return extract.extract(tables.structural_log(spark, sf_dir), ExtractConfig(LEAST)).relations


def orphan_switch(spark, sf_dir):
    """Object types and activities of a model with and without those that no relation touches."""
    out = []
    for orphans in (False, True):
        m = extract.extract(tables.structural_log(spark, sf_dir), ExtractConfig(LEAST, orphans))
        out.append(m.objects.select(F.lit(orphans).alias("orphans"), F.lit("object_type").alias("kind"), F.col("object_type").alias("name")))
        out.append(m.activities.select(F.lit(orphans).alias("orphans"), F.lit("activity").alias("kind"), F.col("activity").alias("name")))
    return reduce(DataFrame.unionByName, out)


def extraction_report(spark, sf_dir):
    models = spark.createDataFrame([("nothing", 0), ("tpch", 1)], "model string, seq int")
    r = extract.report(tables.structural_log(spark, sf_dir), ExtractConfig(LEAST), models)
    names = [F.array_join(f"orphan_{k}", ",").alias(f"orphan_{k}") for k in ("activities", "objects")]
    return r.select("model", "records", "pairs", "relations", "suppressed", *names, (F.array_position("warnings", "the log is empty: no model") > 0).alias("empty"))


def cleaning_report(spark, sf_dir):
    """Every count of the report, and a model without a row."""
    models = spark.createDataFrame([("nothing", 0), ("noisy", 1)], "model string, seq int")
    r = clean.report(tables.noisy_log(spark, sf_dir), models=models)
    return r.select("model", "rows_in", "rows_out", "dropped_null", "dropped_placeholder", "dropped_duplicate", "total_dropped")


# ------------------------------------------------------------------ models, findings, metrics


def _small(spark: SparkSession) -> Model:
    given = [
        ("empty", {}),
        ("one type", {"objects": ["A"], "activities": ["x", "y"], "relations": [("x", "A"), ("y", "A")]}),
        ("apart", {"objects": ["A", "B"], "activities": ["x", "y"], "relations": [("x", "A"), ("y", "B")]}),
        ("alone", {"objects": ["A", "B"], "activities": [f"i{k}" for k in range(7)] + ["x"], "relations": [("x", "A"), ("x", "B")]}),
        ("one activity", {"objects": ["A", "B", "C"], "activities": ["x"], "relations": [("x", "A"), ("x", "B")]}),
    ]
    m = extract.from_dicts(spark, given)
    odd = spark.createDataFrame([("odd", "x", "A"), ("odd", "x", "B"), ("odd", "y", "C"), ("odd", "z", "A")], "model string, activity string, object_type string")
    none = lambda columns, data: spark.createDataFrame(data, columns)
    return Model(
        m.models.unionByName(none("model string, seq int", [("odd", 5)])),
        m.objects.unionByName(none("model string, object_type string", [("odd", "A"), ("odd", "B")])),
        m.activities.unionByName(none("model string, activity string", [("odd", "x"), ("odd", "y")])),
        m.relations.unionByName(odd),
    )


def findings_of_small_models(spark, sf_dir):
    return validate.findings(_small(spark)).select("model", "rule", "level", "code", "message")


def valid_models(spark, sf_dir):
    return validate.is_valid(validate.findings(_small(spark)))


def weighted_composite(spark, sf_dir):
    from .queries import _market

    return metrics.metrics(_market(spark, sf_dir), {"w_oid": 0.4, "w_sar": 0.3, "afo_norm": 0.2, "w_re": 0.1, "other": 9.0}, with_diameter=False).select("model", "composite")


def comparison_table(spark, sf_dir):
    from .queries import _market

    segments = sorted(r[0] for r in tables.read(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect())  # five names
    return compare.table(metrics.metrics(_market(spark, sf_dir), with_diameter=False), segments)


def run_of_equal_names(spark, sf_dir):
    """Two logs of one name in one run stay two models; compared by their measured metrics."""
    p, data = Pipeline(spark), _visits(spark, sf_dir)
    result = p.run_many([([r for r in data if r["activity"] < "visit 3"], "Dataset"), ([r for r in data if r["activity"] >= "visit 3"], "Dataset")])
    table = p.compare(result).where(F.col("metric").isin("otc", "aorc", "sar"))
    return table.unpivot("metric", ["Dataset", "Dataset (2)"], "model", "value")


# ------------------------------------------------------------------ charts


def chart_links(spark, sf_dir):
    from .queries import _market

    return charts.graph_links(_market(spark, sf_dir))


def chart_colours(spark, sf_dir):
    from .queries import _structural

    return charts.graph_nodes(_structural(spark, sf_dir)).select("model", "object_type", F.round("colour", 6).alias("colour"))


def chart_values(spark, sf_dir):
    """The data of the radar and the bars, and the categories of the metric table."""
    from .queries import _market

    m = metrics.metrics(_market(spark, sf_dir), with_diameter=False)
    none = F.lit(None).cast("string").alias("category")
    parts = [charts.radar(m).select(F.lit("radar").alias("chart"), "model", "metric", none, "value"), charts.bars(m).select(F.lit("bars").alias("chart"), "model", "metric", none, "value")]
    return reduce(DataFrame.unionByName, [*parts, charts.metric_table(m).select(F.lit("table").alias("chart"), "model", "metric", "category", "value")])


def graph_degrees_of_small_models(spark, sf_dir):
    m = _small(spark)
    return graph.degrees(m.objects, graph.edges(m.relations))


def queries() -> dict:
    return {k: globals()[k] for k in oracle_sql()}


def oracle_sql() -> dict[str, str]:
    from .oracles import _CLEAN, _EDGES, _MARKET, _METRICS, _STRUCT_MODEL, _STRUCT_SUPPORT, _r4

    kinds = ", ".join(f"('{k}')" for k in ("list", "pandas", "csv", "json", "frame", "parsed"))
    radar, bars = ("oid", "sar", "afo_norm", "re_norm"), ("oid", "sar", "afo_norm", "re_norm", "composite")
    categories = {"otc": "informational", "aorc": "informational", "oid": "core", "sar": "core", "afo": "core", "re": "core", "afo_norm": "core", "re_norm": "core", "oc": "informational", "composite": "composite", "oii": "diagnostic"}
    value = lambda chart, k, c: f"SELECT '{chart}' AS chart, model, '{k}' AS metric, {c} AS category, CAST({k} AS DOUBLE) AS value FROM met"
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    compared = ("otc", "aorc", "oid", "sar", "afo", "re", "oc", "composite")
    kept = f"WITH {_STRUCT_SUPPORT}, kept AS (SELECT * FROM sup WHERE support >= {LEAST})"
    lost = lambda c: f"(SELECT coalesce(string_agg({c}, ',' ORDER BY {c}), '') FROM (SELECT {c} FROM sup GROUP BY {c} HAVING max(support) < {LEAST}))"
    return {
        "source_kinds": f"SELECT k AS model, 'visit ' || n_regionkey AS activity, n_name AS object_type, CAST(n_nationkey AS BIGINT) AS source_row FROM nation, (VALUES {kinds}) v(k)",
        "simplified_log": """SELECT 'e' || n_nationkey AS event_id, 'visit ' || n_regionkey AS activity, CASE WHEN n_nationkey % 2 = 1 THEN 'Nation' ELSE n_name END AS object_type, n_name AS object_id FROM nation
            UNION ALL SELECT 'e' || n_nationkey, 'visit ' || n_regionkey, 'lost', 'lost' FROM nation""",
        "ocel_dispatch": """WITH m AS (SELECT 'two' AS model UNION ALL SELECT 'one')
            SELECT model, 'e' || n_nationkey AS event_id, CASE WHEN n_nationkey % 3 > 0 THEN 'Nation' WHEN model = 'two' THEN n_name ELSE 'unknown' END AS object_type, '03:04:05' AS "at" FROM nation, m
            UNION ALL SELECT model, 'e' || n_nationkey, 'key', '03:04:05' FROM nation, m""",
        "ocel_csv_rows": """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS e FROM nation WHERE n_nationkey < 10)
            SELECT k AS source_row, e AS event_id, CASE WHEN k % 4 = 0 THEN '' ELSE 'nation' END AS object_type, CASE WHEN k % 4 = 0 THEN '' ELSE n_name END AS object_id FROM n
            UNION ALL SELECT k, e, 'nation', 'none' FROM n WHERE k % 4 = 1""",
        "numbered_rows": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, count(*) AS different FROM orders",
        "generated_logs": "SELECT * FROM (VALUES ('p2p', CAST(10 AS BIGINT), CAST(7 AS BIGINT), CAST(19 AS BIGINT)), ('order_management', 9, 3, 13), ('angular', 66, 2, 132)) v(model, activities, object_types, relations)",
        "min_support_relations": f"{kept} SELECT model, activity, object_type FROM kept",
        "orphan_switch": f"""{kept}, b AS (SELECT false AS orphans, activity, object_type FROM kept UNION ALL SELECT true, activity, object_type FROM sup)
            SELECT DISTINCT orphans, 'object_type' AS kind, object_type AS name FROM b UNION ALL SELECT DISTINCT orphans, 'activity', activity FROM b""",
        "extraction_report": f"""{kept} SELECT 'tpch' AS model, CAST(sum(support) AS BIGINT) AS records, count(*) AS pairs, count(*) FILTER (support >= {LEAST}) AS relations, count(*) FILTER (support < {LEAST}) AS suppressed,
            {lost("activity")} AS orphan_activities, {lost("object_type")} AS orphan_objects, false AS empty FROM sup
            UNION ALL SELECT 'nothing', 0, 0, 0, 0, '', '', true""",
        "cleaning_report": f"""WITH {_CLEAN}, k AS (SELECT 1 FROM norm QUALIFY row_number() OVER (PARTITION BY activity, object_type, event_id ORDER BY source_row) = 1), c AS (SELECT count(*) AS kept FROM k)
            SELECT 'noisy' AS model, count(*) AS rows_in, kept AS rows_out, count(*) FILTER (r0 = 'null') AS dropped_null, count(*) FILTER (r0 = 'placeholder') AS dropped_placeholder,
              count(*) FILTER (r0 IS NULL) - kept AS dropped_duplicate, count(*) - kept AS total_dropped FROM why, c GROUP BY kept
            UNION ALL SELECT 'nothing', 0, 0, 0, 0, 0, 0""",
        "findings_of_small_models": """SELECT * FROM (VALUES
            ('empty', 'V1', 'ERROR', 'NO_OBJECTS', 'the model has no object types'), ('empty', 'V1', 'ERROR', 'NO_ACTIVITIES', 'the model has no activities'),
            ('empty', 'V1', 'ERROR', 'NO_RELATIONS', 'the model has no relations'),
            ('one type', 'V5', 'WARNING', 'SINGLE_OBJECT', 'the model has a single object type'), ('one type', 'V7', 'WARNING', 'DENSE', 'relation density 1.00'),
            ('apart', 'V6', 'WARNING', 'NO_INTERACTION', 'no two object types share an activity'), ('apart', 'V7', 'INFO', 'DENSITY', 'relation density 0.50'),
            ('alone', 'V3', 'WARNING', 'ISOLATED_ACTIVITIES', 'activities without relation: i0, i1, i2, i3, i4, ...'), ('alone', 'V7', 'INFO', 'DENSITY', 'relation density 0.12'),
            ('one activity', 'V4', 'WARNING', 'ISOLATED_OBJECTS', 'object types without relation: C'), ('one activity', 'V7', 'INFO', 'DENSITY', 'relation density 0.67'),
            ('one activity', 'V8', 'WARNING', 'SINGLE_ACTIVITY', 'the model has a single activity'),
            ('odd', 'V2', 'ERROR', 'UNKNOWN_ENDS', 'the relation of y and C names an unknown object type'), ('odd', 'V2', 'ERROR', 'UNKNOWN_ENDS', 'the relation of z and A names an unknown activity'),
            ('odd', 'V7', 'WARNING', 'DENSE', 'relation density 1.00')) v(model, rule, level, code, message)""",
        "valid_models": """SELECT * FROM (VALUES ('empty', CAST(3 AS BIGINT), CAST(0 AS BIGINT), false), ('one type', 0, 2, true), ('apart', 0, 1, true), ('alone', 0, 1, true), ('one activity', 0, 2, true), ('odd', 2, 1, false))
            v(model, errors, warnings, is_valid)""",
        "weighted_composite": f"WITH {_MARKET}, {_METRICS} SELECT model, {_r4('least(1.0, 0.4 * oid + 0.3 * sar + 0.2 * afo_norm + 0.1 * re_norm)')} AS composite FROM met",
        "comparison_table": f"WITH {_MARKET}, {_METRICS} "
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, {', '.join(f'''max(CASE WHEN model = '{s}' THEN CAST({m} AS DOUBLE) END) AS "{s}"''' for s in segments)} FROM met" for m in compared),
        "run_of_equal_names": """WITH v AS (SELECT CASE WHEN n_regionkey < 3 THEN 'Dataset' ELSE 'Dataset (2)' END AS model, n_regionkey, n_name FROM nation),
            m AS (SELECT model, count(DISTINCT n_name) AS otc, count(*) AS aorc FROM v GROUP BY model)
            SELECT 'otc' AS metric, model, CAST(otc AS DOUBLE) AS value FROM m UNION ALL SELECT 'aorc', model, CAST(aorc AS DOUBLE) FROM m UNION ALL SELECT 'sar', model, 1.0 FROM m""",
        "chart_links": f"WITH {_MARKET}, {_EDGES} SELECT model, o1, o2, weight, CAST(1 + 1.5 * weight AS DOUBLE) AS width, 'x' || weight AS label FROM edges",
        "chart_colours": f"""WITH {_STRUCT_MODEL}, e AS (SELECT o1 AS o FROM edges UNION ALL SELECT o2 FROM edges), d AS (SELECT model, object_type, (SELECT count(*) FROM e WHERE o = object_type) AS degree FROM objects)
            SELECT model, object_type, round(0.35 + CAST(0.55 AS DOUBLE) * degree / greatest(1, (SELECT max(degree) FROM d)), 6) AS colour FROM d""",
        "chart_values": f"WITH {_MARKET}, {_METRICS} "
        + " UNION ALL ".join([*[value("radar", k, "CAST(NULL AS VARCHAR)") for k in radar], *[value("bars", k, "CAST(NULL AS VARCHAR)") for k in bars], *[value("table", k, f"'{c}'") for k, c in categories.items()]]),
        "graph_degrees_of_small_models": """SELECT * FROM (VALUES ('one type', 'A', CAST(0 AS BIGINT)), ('apart', 'A', 0), ('apart', 'B', 0), ('alone', 'A', 1), ('alone', 'B', 1), ('one activity', 'A', 1), ('one activity', 'B', 1),
            ('one activity', 'C', 0), ('odd', 'A', 1), ('odd', 'B', 1)) v(model, object_type, degree)""",
    }
