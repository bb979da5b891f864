"""Text reports from the small result tables."""

from __future__ import annotations

from .metrics import LABELS


def _block(title: str, rows: list[tuple[str, object]]) -> str:
    return "\n".join([title, "-" * len(title), *[f"{k:<28}{v}" for k, v in rows], ""])


def metric_report(row: dict) -> str:
    return _block(f"Metrics of {row['model']}", [(LABELS[k], row[k]) for k in LABELS if k in row])


def as_dict(row: dict) -> dict:
    """A metrics row under its labels."""
    return {"Model": row["model"]} | {LABELS[k]: row[k] for k in LABELS if k in row}


def cleaning_report(row: dict) -> str:
    shown = [(k.replace("_", " "), v) for k, v in row.items() if k not in ("model", "warnings")]
    return _block(f"Cleaning of {row['model']}", [*shown, *[("warning", w) for w in row["warnings"][:10]]])


def extraction_report(row: dict) -> str:
    lists = ("orphan_activities", "orphan_objects")
    shown = [(k.replace("_", " "), ", ".join(v[:5]) if k in lists else v) for k, v in row.items() if k not in ("model", "warnings")]
    return _block(f"Extraction of {row['model']}", [*shown, *[("warning", w) for w in row["warnings"][:8]]])


def findings_report(rows: list[dict]) -> str:
    return _block("Findings", [(f"{r['model']} {r['level']}", f"{r['code']}: {r['message']}") for r in rows])


def comparison_report(table, ranking) -> str:
    """The comparison table and the ranking as text."""
    head = table.columns
    lines = ["  ".join(f"{c:<16}" for c in head), *["  ".join(f"{v!s:<16}" for v in r) for r in table.collect()], ""]
    return "\n".join([*lines, *[f"{r['rank']}. {r['model']} {r['composite']}" for r in ranking.orderBy("rank").collect()]])


def full(result) -> str:
    """Everything about a run; each table is one row per model."""
    parts = [cleaning_report(r.asDict()) for r in result.cleaning.orderBy("model").collect()]
    parts += [extraction_report(r.asDict()) for r in result.extraction.orderBy("model").collect()]
    parts.append(findings_report([r.asDict() for r in result.findings.orderBy("model", "seq").collect()]))
    parts += [metric_report(r.asDict()) for r in result.metrics.orderBy("model").collect()]
    return "\n".join(parts)
