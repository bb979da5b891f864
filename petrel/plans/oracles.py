"""The same queries as SQL for an independent engine."""

from __future__ import annotations

from ..schema import PLACEHOLDERS
from ..sources import samples, tables
from . import cases

_R4 = "floor(({0}) * 10000.0 + 0.5) / 10000.0"


def _r4(x: str) -> str:
    return _R4.format(f"CAST({x} AS DOUBLE)")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


_TOUCH = f"touch(activity, pos, object_type) AS (SELECT a, CAST(p AS INTEGER), o FROM (VALUES {_values([(a, k, o) for a, types in tables.TOUCHES.items() for k, o in enumerate(types)])}) v(a, p, o))"
_ACTIVITIES = """acts AS (
  SELECT l_returnflag || l_linestatus AS activity FROM lineitem UNION ALL SELECT 'place' FROM orders UNION ALL SELECT event_type FROM events)"""
_STRUCT_SUPPORT = f"""{_TOUCH}, {_ACTIVITIES},
sup AS (SELECT 'tpch' AS model, a.activity, t.object_type, count(*) AS support FROM acts a JOIN touch t ON a.activity = t.activity GROUP BY ALL)"""
_MARKET_SUPPORT = """msup AS (
  SELECT c_mktsegment AS model, p_brand AS activity, n_name AS object_type, count(*) AS support
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""
_MARKET = f"""{_MARKET_SUPPORT},
lim AS (SELECT model, {_r4("avg(support) + 1.5 * stddev_pop(support)")} AS least FROM msup GROUP BY model),
rel AS (SELECT m.model, m.activity, m.object_type FROM msup m JOIN lim l ON m.model = l.model WHERE support > least),
models AS (SELECT DISTINCT model FROM rel),
objects AS (SELECT model, n_name AS object_type FROM models, nation),
acti AS (SELECT DISTINCT model, activity FROM rel)"""
_EDGES = """edges AS (
  SELECT r1.model, r1.object_type AS o1, r2.object_type AS o2, count(*) AS weight, string_agg(r1.activity, ',' ORDER BY r1.activity) AS shared_activities
  FROM rel r1 JOIN rel r2 ON r1.model = r2.model AND r1.activity = r2.activity AND r1.object_type < r2.object_type GROUP BY ALL)"""
_METRICS = f"""{_EDGES},
cnt AS (
  SELECT m.model,
    (SELECT count(*) FROM objects o WHERE o.model = m.model) AS otc,
    (SELECT count(*) FROM acti a WHERE a.model = m.model) AS n_activities,
    (SELECT count(*) FROM rel r WHERE r.model = m.model) AS aorc,
    (SELECT count(*) FROM edges e WHERE e.model = m.model) AS n_edges,
    (SELECT count(*) FROM (SELECT model, activity, count(*) AS k FROM rel GROUP BY ALL) x WHERE x.model = m.model AND k > 1) AS n_shared,
    (SELECT count(DISTINCT object_type) FROM rel r WHERE r.model = m.model) AS n_related,
    (SELECT coalesce(sum(k * log2(k)), 0) FROM (SELECT model, object_type, count(*) AS k FROM rel GROUP BY ALL) x WHERE x.model = m.model) AS klk
  FROM models m),
m1 AS (
  SELECT *, {_r4("CASE WHEN otc > 0 THEN 2.0 * n_edges / otc ELSE 0 END")} AS oc,
    {_r4("CASE WHEN otc >= 2 THEN n_edges / (otc * (otc - 1) / 2.0) ELSE 0 END")} AS oid,
    {_r4("CASE WHEN n_activities > 0 THEN CAST(n_shared AS DOUBLE) / n_activities ELSE 0 END")} AS sar,
    {_r4("CASE WHEN n_activities > 0 THEN CAST(aorc AS DOUBLE) / n_activities ELSE 0 END")} AS afo,
    {_r4("CASE WHEN aorc > 0 THEN greatest(0, log2(aorc) - klk / aorc) ELSE 0 END")} AS re,
    {_r4("CASE WHEN otc > 0 THEN CAST(otc - n_related AS DOUBLE) / otc ELSE 0 END")} AS oii
  FROM cnt),
m2 AS (
  SELECT *, {_r4("CASE WHEN otc > 0 THEN least(1.0, afo / otc) ELSE 0 END")} AS afo_norm,
    {_r4("least(1.0, re / CASE WHEN otc > 1 THEN log2(otc) ELSE 1.0 END)")} AS re_norm
  FROM m1),
met AS (SELECT *, {_r4("least(1.0, 0.25 * CAST(oid AS DOUBLE) + 0.25 * CAST(sar AS DOUBLE) + 0.25 * CAST(afo_norm AS DOUBLE) + 0.25 * CAST(re_norm AS DOUBLE))")} AS composite FROM m2)"""

_NOISY = """noisy AS (
  SELECT 'noisy' AS model, event_id AS source_row, 'e' || CAST(event_id // 3 AS VARCHAR) AS event_id,
    CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN ' N/A ' WHEN event_id % 11 = 2 THEN upper(event_type) || '  (core)'
         WHEN event_id % 11 = 3 THEN ' ' || event_type || chr(9) || 'step' WHEN event_id % 997 = 5 THEN 'rare_' || CAST(event_id % 5 AS VARCHAR) ELSE event_type END AS activity,
    CASE WHEN event_id % 13 = 0 THEN 'Unknown' WHEN event_id % 13 = 1 THEN 'purchase_order' WHEN event_id % 13 = 2 THEN 'o''neil'
         WHEN event_id % 499 = 7 THEN 'once ' || CAST(event_id % 3 AS VARCHAR) ELSE 'user' END AS object_type
  FROM events)"""


def _cleaned(c: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"array_to_string(list_transform(regexp_extract_all({plain}, '([\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+)'), lambda t: upper(t[1]) || lower(t[2:])), '')"


_BAD = "(" + ", ".join("'" + p + "'" for p in PLACEHOLDERS) + ")"
_CLEAN = f"""{_NOISY},
why AS (
  SELECT *, CASE WHEN trim(activity) = '' OR trim(object_type) = '' THEN 'null'
                 WHEN lower(trim(activity)) IN {_BAD} OR lower(trim(object_type)) IN {_BAD} THEN 'placeholder' END AS r0 FROM noisy),
norm AS (SELECT source_row, event_id, {_cleaned("activity")} AS activity, {_cleaned("object_type")} AS object_type FROM why WHERE r0 IS NULL)"""
_FREQ = f"""{_CLEAN},
f1 AS (SELECT * FROM norm QUALIFY count(*) OVER (PARTITION BY activity) >= 50),
f2 AS (SELECT * FROM f1 QUALIFY count(*) OVER (PARTITION BY object_type) >= 20),
f3 AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY activity, object_type, event_id ORDER BY source_row) = 1)"""

_ORDERS = "parts AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), ol AS (SELECT o_orderkey, o_orderstatus, l_partkey FROM orders JOIN parts ON o_orderkey = l_orderkey)"
_STRUCT_MODEL = f"""{_STRUCT_SUPPORT}, rel AS (SELECT model, activity, object_type FROM sup), objects AS (SELECT DISTINCT model, object_type FROM rel), acti AS (SELECT DISTINCT model, activity FROM rel), {_EDGES}"""
_REACH = """both_ways AS (SELECT o1 AS a, o2 AS b FROM edges UNION SELECT o2, o1 FROM edges),
reach AS (
  SELECT object_type AS s, object_type AS t, 0 AS d FROM objects
  UNION SELECT s, b, d + 1 FROM reach JOIN both_ways ON t = a WHERE d < (SELECT count(*) FROM objects)),
dist AS (SELECT s, t, min(d) AS d FROM reach GROUP BY ALL),
comp AS (SELECT 'tpch' AS model, s AS object_type, min(t) AS component, count(*) AS size, max(d) AS eccentricity FROM dist GROUP BY s)"""

_WIDE = "model, otc, n_activities, aorc, n_edges, oc, oid, sar, afo, afo_norm, re, re_norm, oii, composite"
_LONG = " UNION ALL ".join(f"SELECT model, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM met" for c in ("otc", "aorc", "oid", "sar", "afo", "re", "oc", "composite"))


def _sample_models() -> str:
    """Inline values of the sample models and, as their metrics are rounded half even, the metrics that follow by hand."""
    golden = [
        ("Simple Logistics", 3, 3, 5, 1, 0.6667, 0.3333, 0.6667, 1.6667, 0.5556, 1.5219, 0.9602, 0.0, 0.629, 1),
        ("E-Commerce Fulfilment", 5, 6, 12, 5, 2.0, 0.5, 1.0, 2.0, 0.4, 2.1175, 0.912, 0.0, 0.703, 2),
        ("Hospital Patient Management", 6, 8, 20, 10, 3.3333, 0.6667, 1.0, 2.5, 0.4167, 2.4016, 0.9291, 0.0, 0.7531, 2),
    ]
    assert [g[0] for g in golden] == [n for n, _ in samples.models()]
    rows = ", ".join("('" + g[0] + "', " + ", ".join(str(v) for v in g[1:]) + ")" for g in golden)
    ints = {"otc", "n_activities", "aorc", "n_edges", "diam"}
    names = [*_WIDE.split(", ")[1:], "diam"]
    return f"SELECT model, {', '.join(f'CAST({n} AS {"BIGINT" if n in ints else "DOUBLE"}) AS {n}' for n in names)} FROM (VALUES {rows}) v(model, {', '.join(names)})"


def oracle_sql() -> dict[str, str]:
    metric = lambda *c: f"WITH {_MARKET}, {_METRICS} SELECT model, {', '.join(c)} FROM met"
    counted = {k: f"count(*) FILTER (r = '{k}') AS dropped_{k}" for k in ("null", "placeholder", "rare_activity", "rare_object", "duplicate")}
    return cases.oracle_sql() | {
        "relation_support": f"WITH {_STRUCT_SUPPORT} SELECT * FROM sup",
        "relation_support_of_log": f"WITH {_STRUCT_SUPPORT} SELECT * FROM sup",
        "relations_min_support": f"WITH {_MARKET} SELECT * FROM rel",
        "orphans": f"""WITH {_MARKET_SUPPORT}, s AS (SELECT model, activity, object_type, support % 7 AS support FROM msup)
            SELECT model, 'activity' AS kind, activity AS name FROM s GROUP BY ALL HAVING max(support) < 6
            UNION ALL SELECT model, 'object_type', object_type FROM s GROUP BY ALL HAVING max(support) < 6""",
        "integrity_violations": f"""WITH {_MARKET} SELECT model, activity, object_type, 'activity' AS missing FROM rel WHERE activity = 'Brand#11'
            UNION ALL SELECT model, activity, object_type, 'object_type' FROM rel WHERE length(object_type) <= 5""",
        "clean_normalise": f"WITH {_CLEAN} SELECT source_row, activity, object_type FROM norm",
        "clean_placeholders": f"WITH {_CLEAN} SELECT source_row, activity AS raw_activity, object_type AS raw_object_type FROM why WHERE r0 = 'placeholder'",
        "clean_drop_counts": f"""WITH {_FREQ}, t AS (
              SELECT why.model, coalesce(r0, CASE WHEN f1.source_row IS NULL THEN 'rare_activity' WHEN f2.source_row IS NULL THEN 'rare_object' WHEN f3.source_row IS NULL THEN 'duplicate' END) AS r
              FROM why LEFT JOIN f1 ON why.source_row = f1.source_row LEFT JOIN f2 ON why.source_row = f2.source_row LEFT JOIN f3 ON why.source_row = f3.source_row)
            SELECT model, count(*) AS rows_in, count(*) FILTER (r IS NULL) AS rows_out, count(*) FILTER (r IS NOT NULL) AS total_dropped, {', '.join(counted.values())} FROM t GROUP BY model""",
        "rare_activity_filter": f"WITH {_FREQ} SELECT activity, count(*) AS n FROM f1 GROUP BY activity",
        "rare_object_filter": f"WITH {_FREQ} SELECT object_type, count(*) AS n FROM f2 GROUP BY object_type",
        "dedup_first_wins": f"""WITH {_CLEAN} SELECT source_row, activity, object_type, event_id FROM norm
            QUALIFY row_number() OVER (PARTITION BY activity, object_type, event_id ORDER BY source_row) = 1""",
        "expand_multi_object": """WITH c(r, pos, object_type) AS (VALUES (0, 0, 'User'), (0, 1, 'Cart'), (1, 0, 'User'), (1, 1, 'Item'), (1, 2, 'None'), (2, 0, 'User'), (2, 1, 'Device'), (3, 0, '[''User'''), (3, 1, '''Cart'']'))
            SELECT event_id, CAST(pos AS INTEGER) AS pos, object_type FROM events JOIN c ON event_id % 4 = r""",
        "alias_projection": """WITH e AS (SELECT event_id AS source_row, event_type, event_id % 2 = 0 AS even FROM events)
            SELECT source_row, CAST(0 AS INTEGER) AS pos, event_type AS activity, 'User' AS object_type, CAST(source_row AS VARCHAR) AS event_id, 'EU' AS region FROM e WHERE even
            UNION ALL SELECT source_row, CAST(p.pos AS INTEGER), CASE WHEN source_row % 3 = 0 THEN event_type ELSE 'None' END, p.o, 'evt_' || lpad(CAST(source_row AS VARCHAR), CAST(greatest(6, length(CAST(source_row AS VARCHAR))) AS INTEGER), '0'), NULL
            FROM e, (VALUES (0, 'User'), (1, 'Cart')) p(pos, o) WHERE NOT even""",
        "timestamp_cascade": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 4 THEN NULL
            WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS ts FROM events""",
        "ocel2_join": f"""WITH {_ORDERS} SELECT 'status ' || o_orderstatus AS activity, CASE WHEN l_partkey % 2 = 0 THEN 'Declared' ELSE 'part' END AS object_type, count(*) AS n, '03:04:05' AS "at" FROM ol GROUP BY ALL""",
        "ocel1_map_explode": f"""WITH {_ORDERS} SELECT 'status ' || o_orderstatus AS activity, CASE WHEN l_partkey % 2 = 0 THEN 'Part' ELSE 'unknown' END AS object_type, count(*) AS n, CAST(0 AS BIGINT) AS n_ts FROM ol GROUP BY ALL""",
        "ocel_csv_unpivot": f"""WITH {_ORDERS}, o AS (SELECT DISTINCT o_orderkey, o_orderstatus FROM ol), u AS (
              SELECT o_orderstatus AS activity, 'part' AS object_type FROM ol WHERE o_orderkey % 5 <> 0
              UNION ALL SELECT o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'order' END FROM o)
            SELECT activity, object_type, count(*) AS n FROM u GROUP BY ALL""",
        "interaction_edges": f"WITH {_MARKET}, {_EDGES} SELECT * FROM edges",
        "node_degree": f"""WITH {_MARKET}, {_EDGES}, e AS (SELECT model, o1 AS o FROM edges UNION ALL SELECT model, o2 FROM edges)
            SELECT objects.model, object_type, count(e.o) AS degree FROM objects LEFT JOIN e ON objects.model = e.model AND object_type = e.o GROUP BY ALL""",
        "metric_oid": metric("oid"),
        "metric_sar": metric("sar"),
        "metric_afo": metric("afo", "afo_norm"),
        "metric_re": metric("re", "re_norm"),
        "metric_oc": metric("oc"),
        "metric_oii": metric("oii"),
        "metric_counts": metric("otc", "aorc"),
        "metric_composite": metric("composite"),
        "metrics_all_by_model": f"""WITH {_MARKET.replace("rel AS (", "mrel AS (").replace("FROM rel)", "FROM mrel)", 1).replace("objects AS (SELECT model", "mobjects AS (SELECT model").replace("models AS (", "mmodels AS (").replace("FROM models, nation", "FROM mmodels, nation").replace("acti AS (SELECT DISTINCT model, activity FROM rel)", "acti0 AS (SELECT 1)")},
            {_STRUCT_SUPPORT}, rel AS (SELECT * FROM mrel UNION ALL SELECT model, activity, object_type FROM sup), models AS (SELECT DISTINCT model FROM rel),
            objects AS (SELECT * FROM mobjects UNION ALL SELECT DISTINCT model, object_type FROM sup), acti AS (SELECT DISTINCT model, activity FROM rel), {_METRICS}
            SELECT {_WIDE} FROM met""",
        "graph_components": f"WITH RECURSIVE {_STRUCT_MODEL}, {_REACH} SELECT * FROM comp",
        "graph_diameter": f"""WITH RECURSIVE {_STRUCT_MODEL}, {_REACH}, c AS (SELECT component, max(size) AS size, max(eccentricity) AS diam FROM comp GROUP BY component)
            SELECT 'tpch' AS model, CAST(diam AS BIGINT) AS diam FROM c ORDER BY size DESC, component LIMIT 1""",
        "validation_findings": f"""WITH {_MARKET}, {_EDGES}, s AS (
              SELECT model, (SELECT count(*) FROM objects o WHERE o.model = m.model) AS n_o, (SELECT count(*) FROM acti a WHERE a.model = m.model) AS n_a,
                (SELECT count(*) FROM rel r WHERE r.model = m.model) AS n_r, (SELECT count(*) FROM edges e WHERE e.model = m.model) AS n_e,
                (SELECT count(DISTINCT object_type) FROM rel r WHERE r.model = m.model) AS related FROM models m)
            SELECT model, 'WARNING' AS level, 'ISOLATED_OBJECTS' AS code FROM s WHERE related < n_o
            UNION ALL SELECT model, 'WARNING', 'NO_INTERACTION' FROM s WHERE n_o >= 2 AND n_e = 0
            UNION ALL SELECT model, 'WARNING', 'SINGLE_ACTIVITY' FROM s WHERE n_a = 1
            UNION ALL SELECT model, CASE WHEN n_r > 0.9 * n_a * n_o THEN 'WARNING' ELSE 'INFO' END, CASE WHEN n_r > 0.9 * n_a * n_o THEN 'DENSE' ELSE 'DENSITY' END FROM s""",
        "comparison_long": f"WITH {_MARKET}, {_METRICS} {_LONG}",
        "comparison_rank": f'WITH {_MARKET}, {_METRICS} SELECT CAST(row_number() OVER (ORDER BY composite DESC, model) AS INTEGER) AS "rank", model, composite FROM met',
        "complexity_band": f"""WITH {_MARKET}, {_METRICS}, p AS (SELECT model, floor(least(100.0, composite * 100) * 10 + 0.5) / 10.0 AS percent FROM met)
            SELECT model, percent, CASE WHEN percent < 25 THEN 'Low' WHEN percent < 50 THEN 'Medium' WHEN percent < 75 THEN 'High' ELSE 'Very High' END AS level,
              CASE WHEN percent < 25 THEN '#2ECC71' WHEN percent < 50 THEN '#F39C12' WHEN percent < 75 THEN '#E67E22' ELSE '#E74C3C' END AS colour,
              CASE WHEN percent < 25 THEN 'Few cross-object dependencies' WHEN percent < 50 THEN 'Moderate inter-object coordination' WHEN percent < 75 THEN 'Dense cross-object interactions'
                ELSE 'Highly coupled, many shared activities' END AS description FROM p""",
        "sample_models_metrics": _sample_models(),
        "log_summary": f"""WITH {_NOISY} SELECT model, count(*) AS records, count(DISTINCT activity) AS activities, count(DISTINCT object_type) AS object_types,
            count(DISTINCT (activity, object_type)) AS relations FROM noisy GROUP BY model""",
        "discard_rate": f"""WITH {_CLEAN}, d AS (SELECT 1 FROM norm QUALIFY row_number() OVER (PARTITION BY activity, object_type, event_id ORDER BY source_row) = 1),
            n AS (SELECT (SELECT count(*) FROM noisy) AS total, (SELECT count(*) FROM d) AS kept)
            SELECT 'noisy' AS model, total AS total_raw_rows, kept AS records, {_r4("1 - CAST(kept AS DOUBLE) / total")} AS discard_rate FROM n""",
        "chart_nodes": f"""WITH {_STRUCT_MODEL}, e AS (SELECT o1 AS o FROM edges UNION ALL SELECT o2 FROM edges)
            SELECT model, object_type, n_activities, degree, 300 + 200 * n_activities AS size FROM (
              SELECT model, object_type, (SELECT count(*) FROM rel r WHERE r.object_type = objects.object_type) AS n_activities, (SELECT count(*) FROM e WHERE o = object_type) AS degree FROM objects)""",
        "chart_bipartite": f"""WITH {_STRUCT_MODEL}, b AS (SELECT model, 'activity' AS kind, activity AS name, CAST(0 AS DOUBLE) AS x FROM acti UNION ALL SELECT model, 'object_type', object_type, 1 FROM objects)
            SELECT *, 1 - CAST(row_number() OVER (PARTITION BY kind ORDER BY name) - 1 AS DOUBLE) / greatest(count(*) OVER (PARTITION BY kind) - 1, 1) AS y FROM b""",
        "name_slugs": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
    }
