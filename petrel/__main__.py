"""Command line: ``python -m petrel samples | demo | run FILE... | datasets FOLDER``."""

from __future__ import annotations

import argparse
from pathlib import Path

from .operators import compare, extract, metrics, report, validate
from .operators.clean import CleanConfig
from .operators.extract import ExtractConfig
from .plans.pipeline import Pipeline, Result
from .session import session
from .sources import registry, samples


def _compared(table, names: list[str]) -> str:
    return report.comparison_report(compare.table(table, names), compare.ranking(table))


def _measured(result: Result, charts: str | None, p: Pipeline) -> None:
    print(result.full_report())
    print(_compared(result.metrics, result.names))
    if charts:
        for name, path in p.visualise(result, charts).items():
            print(f"{name}: {path}")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="petrel", description="Complexity of object-centric event logs.")
    parser.add_argument("command", choices=["samples", "demo", "run", "datasets"])
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--min-activity-freq", type=int, default=1)
    parser.add_argument("--min-object-freq", type=int, default=1)
    parser.add_argument("--min-support", type=int, default=1)
    parser.add_argument("--charts", help="folder for chart datasets")
    parser.add_argument("--mock", action="store_true", help="generate datasets whose file is missing")
    a = parser.parse_args(arguments)
    spark = session()
    if a.command == "samples":
        model = extract.from_dicts(spark, samples.models())
        table = metrics.exact_metrics(model)
        print(report.findings_report([r.asDict() for r in validate.findings(model).orderBy("model", "seq").collect()]))
        print(_compared(table, [n for n, _ in samples.models()]))
        return
    p = Pipeline(spark, CleanConfig(a.min_activity_freq, a.min_object_freq), ExtractConfig(a.min_support))
    if a.command == "demo":
        sources = samples.all_logs()
    elif a.command == "run":
        sources = [(path, Path(path).stem) for path in a.paths]
    else:
        folder = a.paths[0]
        found = list(registry.discover(folder)) or (list(registry.MOCKS) if a.mock else [])
        sources = []
        for key in found:
            log, provenance = registry.load(spark, key, folder, a.mock)
            print(f"{key}: {provenance}")
            sources.append((log, key))
    if not sources:
        parser.error("no source")
    _measured(p.run_many(sources), a.charts, p)


if __name__ == "__main__":
    main()
