"""From sources to metrics in one lazy plan for any number of logs."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, compare, extract, metrics, report, validate
from ..operators.clean import CleanConfig
from ..operators.extract import ExtractConfig, Model
from ..sources import files


@dataclass
class Result:
    """The tables of a run, keyed by ``model``. Metrics are computed and kept, the other tables when they are asked for."""

    raw: DataFrame
    events: DataFrame
    model: Model
    cleaning: DataFrame
    extraction: DataFrame
    findings: DataFrame
    metrics: DataFrame
    names: list[str]
    elapsed_seconds: float = 0.0
    notes: list[str] = field(default_factory=list)

    def is_valid(self) -> bool:
        return self.findings.where("level = 'ERROR'").limit(1).count() == 0

    def full_report(self) -> str:
        return report.full(self)


@dataclass(frozen=True)
class Pipeline:
    """Parse, clean, extract, validate and measure. Findings of level ERROR do not stop a run."""

    spark: SparkSession
    cleaning: CleanConfig = CleanConfig()
    extraction: ExtractConfig = ExtractConfig()
    max_density: float = validate.MAX_DENSITY
    weights: dict[str, float] | None = None

    def run(self, source, name: str = "Dataset") -> Result:
        return self.run_many([(source, name)])

    def run_many(self, sources: list[tuple[object, str]]) -> Result:
        """All logs as one job: their events are united under ``model`` and every later step groups by it.

        Logs stay apart when their names are equal: the second "D" is the model "D (2)". The model and its metrics, a few rows a log, are computed here and
        kept; ``elapsed_seconds`` is the time from reading to these metrics.
        """
        began = time.perf_counter()
        names: list[str] = []
        for _, n in sources:
            key, k = n, 2
            while key in names:
                key, k = f"{n} ({k})", k + 1
            names.append(key)
        parsed = [files.parse(self.spark, s, n) for (s, _), n in zip(sources, names, strict=True)]
        raw = reduce(DataFrame.unionByName, parsed)
        models = self.spark.createDataFrame([(n, k) for k, n in enumerate(names)], "model string, seq int")
        events = clean.clean(raw, self.cleaning)
        model = extract.extract(events, self.extraction, models).cached()
        measured = metrics.exact_metrics(model, self.weights).cache()
        measured.count()
        return Result(
            raw, events, model, clean.report(raw, self.cleaning, models), extract.report(events, self.extraction, models), validate.findings(model, self.max_density),
            measured, names, round(time.perf_counter() - began, 3),
        )

    def compare(self, *results: Result) -> DataFrame:
        """The comparison table of the models of some runs, by their metrics as measured."""
        every = reduce(DataFrame.unionByName, [r.metrics for r in results])
        return compare.table(every, [n for r in results for n in r.names])

    def visualise(self, result: Result, folder: str, formats: tuple[str, ...] = ("json",)) -> dict[str, str]:
        """Chart datasets written below ``folder``; pictures too if a plotting library can be imported."""
        from ..operators import charts

        return charts.save(result, folder, formats)


def relations_to_metrics(relations: DataFrame, models: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Metrics of given (model, activity, object_type) pairs."""
    r = relations.select("model", "activity", "object_type").distinct()
    models = models if models is not None else r.select("model").distinct()
    m = Model(models, r.select("model", "object_type").distinct(), r.select("model", "activity").distinct(), r)
    return metrics.metrics(m, weights)


def totals(raw: DataFrame) -> DataFrame:
    """(model, total_raw_rows): distinct source rows."""
    return raw.groupBy("model").agg(F.count_distinct("source_row").alias("total_raw_rows"))
