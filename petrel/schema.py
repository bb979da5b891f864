"""The canonical event table, column aliases and placeholder values."""

from __future__ import annotations

#: One row per (event, object); every table of the engine is keyed by ``model``.
EVENT_OBJECT = (
    "model string, activity string, object_type string, object_id string, case_id string, ts timestamp_ntz, "
    "event_id string, source_row long, pos int, extra map<string,string>"
)
COLUMNS = [c.strip().split(" ")[0] for c in EVENT_OBJECT.split(", ")]

#: Header names (trimmed, lower case) of each canonical field.
ALIASES = {
    "activity": ["activity", "activity_name", "action", "event", "event_name", "task", "task_name", "concept:name"],
    "object_type": ["object_type", "objecttype", "object", "entity", "entity_type", "resource_type", "type"],
    "object_id": ["object_id", "objectid", "instance_id", "entity_id", "resource_id"],
    "case_id": ["case_id", "caseid", "case:concept:name", "trace_id", "process_id", "order_id"],
    "timestamp": ["timestamp", "time", "time:timestamp", "date", "datetime", "event_time"],
    "event_id": ["event_id", "eventid", "id", "row_id"],
}
FIELD_OF = {alias: field for field, aliases in ALIASES.items() for alias in aliases}

#: Texts that stand for a missing name, compared after trimming and lower-casing.
PLACEHOLDERS = ["", "n/a", "na", "nan", "null", "none", "unknown", "undefined", "-", "--", "?", "??", "tbd", "tbc", "nil", "missing"]
