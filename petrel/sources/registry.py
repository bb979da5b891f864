"""Known and discovered datasets, and generated stand-ins for them. Nothing is downloaded."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS
from . import files, ocel

#: Public logs by key: file, format, events and object types as published, identifier.
DATASETS = {
    "p2p": {"filename": "ocel2-p2p.json", "format": "ocel2", "events": 14671, "object_types": 7, "doi": "10.5281/zenodo.8412920"},
    "order_management": {"filename": "order-management.jsonocel", "format": "ocel1", "events": 22, "object_types": 3, "doi": "ocel-standard.org"},
    "angular": {"filename": "angular_github_commits_ocel.csv", "format": "ocel_csv", "events": 27847, "object_types": 2, "doi": "10.5281/zenodo.8430332"},
    "email": {"filename": "enron_top_10000.json", "format": "ocel2", "events": 27847, "object_types": 2, "doi": "10.5281/zenodo.18334093"},
}
#: A CSV log of a dataset is read up to this many rows.
CSV_ROWS = 50_000


def info(key: str) -> dict:
    if key not in DATASETS:
        raise KeyError(f"unknown dataset {key!r}; known: {', '.join(DATASETS)}")
    return DATASETS[key]


def path_of(key: str, folder: str) -> Path:
    return Path(folder) / info(key)["filename"]


def is_cached(key: str, folder: str) -> bool:
    return path_of(key, folder).is_file()


def detect_format(filename: str) -> str:
    return "ocel_csv" if filename.endswith(".csv") else "ocel1" if filename.endswith(".jsonocel") else "ocel2"


def discover(folder: str) -> dict[str, dict]:
    """Datasets for the *.json, *.csv and *.jsonocel files of a folder, by stem, in order."""
    found = sorted(p for p in Path(folder).glob("*") if p.suffix in (".json", ".csv", ".jsonocel"))
    return {p.stem: {"filename": p.name, "format": detect_format(p.name), "label": p.stem.replace("_", " ").title()} for p in found}


def load(spark: SparkSession, key: str, folder: str, allow_mock: bool = False) -> tuple[DataFrame, str]:
    """(events, "real" or "mock"). Without its file a dataset is generated if that is allowed, else RuntimeError."""
    known = discover(folder) if Path(folder).is_dir() else {}
    entry = known.get(key) or (DATASETS.get(key) if key in DATASETS and is_cached(key, folder) else None)
    if entry is None:
        if allow_mock and key in MOCKS:
            return MOCKS[key](spark), "mock"
        raise RuntimeError(f"no file for dataset {key!r} in {folder}")
    path = str(Path(folder) / entry["filename"])
    if entry["format"] == "ocel_csv":
        return ocel.read_csv(spark, path, key, CSV_ROWS), "real"
    if entry["format"] == "ocel2":  # the version shows in the document
        return ocel.parse_json(spark.read.text(path, wholetext=True), key), "real"
    return files.parse(spark, path, key, entry["format"]), "real"


def _draw(seed: int, *parts) -> Column:
    """A reproducible number from 0 to 2**31 of a row."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 31))


def _pick(options: list[str], seed: int, *parts) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (_draw(seed, *parts) % len(options) + 1).cast("int"))


def _canonical(e: DataFrame, model: str, event_id: Column, object_id: Column) -> DataFrame:
    """(source_row, pos, activity, object_type) as canonical events; times a minute apart, eight events a case."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return e.select(
        F.lit(model).alias("model"), "activity", "object_type", object_id.alias("object_id"), F.concat(F.lit("case_"), F.floor(F.col("source_row") / 8).cast("string")).alias("case_id"),
        (start + F.make_dt_interval(mins=F.col("source_row").cast("int"))).alias("ts"), event_id.alias("event_id"), "source_row", F.col("pos").cast("int").alias("pos"),
        F.create_map().cast("map<string,string>").alias("extra"),
    ).select(*COLUMNS)


def generated(spark: SparkSession, model: str, events: int, touches: dict[str, list[str]], seed: int) -> DataFrame:
    """``events`` random events: each draws an activity and touches the object types of that activity; reproducible, generated where it is read."""
    table = F.create_map(*[x for a, types in touches.items() for x in (F.lit(a), F.array(*map(F.lit, types)))])
    e = spark.range(events).select(F.col("id").alias("source_row"), _pick(list(touches), seed, F.lit("a"), "id").alias("activity"))
    e = e.select("*", F.posexplode(table[F.col("activity")]).alias("pos", "object_type"))
    object_id = F.concat("object_type", F.lit(":"), _draw(seed, F.lit("i"), "source_row", "pos") % 5000)
    return _canonical(e, model, F.concat(F.format_string("evt_%06d", "source_row"), F.lit("_"), "pos"), object_id)


def generated_commits(spark: SparkSession, model: str, events: int, activities: list[str], seed: int) -> DataFrame:
    """``events`` commits: each on 1 to 3 branches (80, 15 and 5 in a hundred), and in 85 of a hundred with 1, 2, 3, 5 or 10 files."""
    share = lambda part: _draw(seed, F.lit(part), "source_row") % 100
    e = spark.range(events).select(F.col("id").alias("source_row"), _pick(activities, seed, F.lit("a"), "id").alias("activity"))
    branches = F.when(share("b") < 80, 1).when(share("b") < 95, 2).otherwise(3)
    files_ = F.when(share("f") >= 85, 0).otherwise(F.when(share("n") < 40, 1).when(share("n") < 65, 2).when(share("n") < 80, 3).when(share("n") < 90, 5).otherwise(10))
    e = e.select("*", F.posexplode(F.concat(F.array_repeat(F.lit("branch"), branches), F.array_repeat(F.lit("file"), files_))).alias("pos", "object_type"))
    number = _draw(seed, F.lit("i"), "source_row") + F.col("pos")  # consecutive, so no object twice in an event
    object_id = F.when(F.col("object_type") == "branch", F.concat(F.lit("branch_"), number % 119)).otherwise(F.concat(F.lit("packages/core/src/file_"), number % 5000, F.lit(".ts")))
    return _canonical(e, model, F.format_string("commit_%06d", "source_row"), object_id)


#: The object types that each activity of the published purchase log touches.
P2P = {
    "Create Purchase Requisition": ["purchase_requisition"],
    "Approve Purchase Requisition": ["purchase_requisition"],
    "Delegate Purchase Requisition Approval": ["purchase_requisition"],
    "Create Request for Quotation": ["quotation", "purchase_requisition"],
    "Create Purchase Order": ["purchase_order", "quotation", "material"],
    "Approve Purchase Order": ["purchase_order"],
    "Create Goods Receipt": ["goods_receipt", "purchase_order", "material"],
    "Create Invoice Receipt": ["invoice_receipt", "goods_receipt"],
    "Perform Two-Way Match": ["invoice_receipt", "purchase_order", "goods_receipt"],
    "Execute Payment": ["payment", "invoice_receipt"],
}
#: The same of the published order log.
ORDERS = {
    "place order": ["order", "item"],
    "confirm order": ["order"],
    "pick item": ["item"],
    "create package": ["package", "item"],
    "send package": ["package", "order"],
    "receive payment": ["order"],
    "deliver package": ["package"],
    "payment reminder": ["order"],
    "failed delivery": ["package", "order"],
}
#: Labels of commits.
COMMITS = """feat, fix, docs, style, refactor, test, chore, perf, ci, build, revert, merge, release, feat(compiler), feat(core), feat(router), feat(forms), fix(compiler),
fix(core), fix(router), fix(forms), fix(http), fix(animations), fix(platform-browser), docs(changelog), docs(readme), docs(api), refactor(core), refactor(compiler), refactor(router),
test(core), test(router), test(compiler), chore(deps), chore(release), chore(bazel), ci(github-actions), build(bazel), build(npm), perf(core), perf(router), feat(ivy), fix(ivy),
refactor(ivy), feat(service-worker), fix(service-worker), feat(elements), fix(elements), feat(localize), fix(localize), feat(common), fix(common), feat(upgrade), fix(upgrade),
feat(zone.js), fix(zone.js), feat(language-service), fix(language-service), release, merge branch, revert feat, revert fix, chore(aio), docs(aio), fix(aio), feat(aio), chore(triage)"""

MOCKS = {
    "p2p": lambda s: generated(s, "p2p", 14671, P2P, 0),
    "order_management": lambda s: generated(s, "order_management", 1500, ORDERS, 1),
    "angular": lambda s: generated_commits(s, "angular", 27847, [x.strip() for x in COMMITS.split(",")], 2),
}
