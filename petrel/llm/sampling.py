"""Bounded samples of labelled documents for the models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pieces

_UNIT = 1 << 30
#: Rows that every label gets, however many labels there are.
LEAST = 8


def class_sample(labelled: DataFrame, label: str, per_class: int, most: int) -> DataFrame:
    """About ``per_class`` rows of each label, or ``most`` over the number of labels if that is less, chosen by a hash of doc_id.

    The number of rows is bounded whatever the input, by the rates alone; every label is in it. Labels are counted by one
    aggregation without the texts; the counts are as many rows as the model has classes.
    """
    counts = {r[label]: r.n for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(per_class, max(LEAST, most // max(1, len(counts))))
    if not counts:
        return labelled.where("false")
    rates = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(_UNIT, _UNIT * share // n + 1))])
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(_UNIT)) < rates[F.col(label)])


def collected(sample: DataFrame, label: str, featurise: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, list]:
    """(features, labels) of a bounded sample, in an order that does not depend on the tasks."""
    kind = sample.schema[label].dataType.simpleString()
    wide = "text" in sample.columns

    def run(batches):
        forget()
        for b in pieces(batches, rows=200, most_bytes=2 << 20) if wide else batches:
            rows = [x.astype(np.float16).tobytes() for x in featurise(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(label), pa.array(rows, pa.binary())], ["doc_id", label, "x"])

    got = sample.mapInArrow(run, f"doc_id long, {label} {kind}, x binary").collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.x)))
    if not got:
        return np.empty((0, 0), np.float32), []
    return np.stack([np.frombuffer(bytes(r.x), np.float16) for r in got]).astype(np.float32), [r[label] for r in got]
