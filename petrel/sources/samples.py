"""Three sample models and three noisy logs for demonstrations and tests."""

from __future__ import annotations

import json
import random

#: Activities of each model with the object types that they touch.
_SAMPLES = {
    "Simple Logistics": {"Create Order": ["Order"], "Load Cargo": ["Item", "Vehicle"], "Start Route": ["Vehicle", "Item"]},
    "E-Commerce Fulfilment": {
        "Place Order": ["Order", "Customer"], "Verify Payment": ["Payment", "Order"], "Pick Items": ["Item", "Order"],
        "Pack Order": ["Item", "Order"], "Ship Order": ["Shipment", "Order"], "Deliver Order": ["Shipment", "Customer"],
    },
    "Hospital Patient Management": {
        "Admit Patient": ["Patient", "Doctor", "Nurse"], "Assign Room": ["Patient", "Room"], "Prescribe Medication": ["Doctor", "Medication", "Patient"],
        "Administer Medication": ["Nurse", "Medication", "Patient"], "Run Lab Test": ["Lab", "Patient"], "Review Results": ["Doctor", "Lab"],
        "Discharge Patient": ["Patient", "Doctor"], "Transfer Patient": ["Patient", "Room", "Nurse"],
    },
}


def models() -> list[tuple[str, dict]]:
    """(name, {"objects", "activities", "relations"}) of each."""
    out = []
    for name, touched in _SAMPLES.items():
        relations = [(a, o) for a, objects in touched.items() for o in objects]
        out.append((name, {"objects": sorted({o for _, o in relations}), "activities": list(touched), "relations": relations}))
    return out


def shop_rows(cases: int = 40, seed: int = 42) -> list[dict]:
    """A noisy log as dictionaries: some null activities, placeholder types, repeated rows and one cell of two types."""
    r, rows = random.Random(seed), []
    for case in range(cases):
        for activity, objects in _SAMPLES["E-Commerce Fulfilment"].items():
            for o in objects:
                row = {"activity": activity, "object_type": o, "object_id": f"{o}-{case}", "case_id": f"C{case}", "timestamp": f"2024-03-{1 + case % 28:02d}T08:00:00", "region": r.choice(["EU", "US"])}
                if r.random() < 0.05:
                    row["activity"] = None
                if r.random() < 0.05:
                    row["object_type"] = r.choice(["N/A", "unknown", "-"])
                rows.append(row)
                if r.random() < 0.03:
                    rows.append(dict(row))
    rows.append({"activity": "Verify Payment", "object_type": "Payment|Order", "object_id": "", "case_id": "C0", "timestamp": "", "region": "EU"})
    return rows


def hospital_csv(cases: int = 30, seed: int = 42) -> str:
    """A noisy log as CSV text with other headers, empty names, missing times and one activity that occurs once."""
    r, lines = random.Random(seed), ["event_name,entity_type,entity_id,trace_id,event_time,ward"]
    for case in range(cases):
        for activity, objects in _SAMPLES["Hospital Patient Management"].items():
            for o in objects:
                name = "" if r.random() < 0.04 else activity
                kind = "TBD" if r.random() < 0.04 else o.lower()
                time = "" if r.random() < 0.1 else f"{1 + case % 28:02d}/05/2024 09:30:00"
                lines.append(f"{name},{kind},{o[:1]}{case},T{case},{time},W{case % 4}")
    return "\n".join([*lines, "fire drill,Room,R0,T0,,W0"])


def logistics_json(cases: int = 35, seed: int = 42) -> str:
    """A simplified object-centric log as JSON text; vehicles are shared and some events have no objects."""
    r, events = random.Random(seed), []
    objects = [{"id": f"V{k}", "type": "Vehicle"} for k in range(5)]
    for case in range(cases):
        objects += [{"id": f"O{case}", "type": "Order"}, {"id": f"I{case}", "type": "Item"}]
        for activity, refs in (("create order", [f"O{case}"]), ("load cargo", [f"I{case}", f"V{case % 5}"]), ("start route", [f"V{case % 5}", f"I{case}"])):
            events.append({"id": f"e{len(events)}", "activity": activity, "timestamp": "2024-01-01T10:00:00", "omap": [] if r.random() < 0.04 else refs})
    return json.dumps({"events": events, "objects": objects})


def all_logs() -> list[tuple[object, str]]:
    return [(shop_rows(), "E-Commerce"), (hospital_csv(), "Hospital"), (logistics_json(), "Logistics")]
