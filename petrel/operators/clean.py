"""Cleaning an event table: null, placeholder, normalise, rare activity, rare object type, first-wins dedup; and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean as clean_text
from ..functions.text import is_placeholder, strip


@dataclass(frozen=True)
class CleanConfig:
    min_activity_freq: int = 1
    min_object_freq: int = 1
    title_case: bool = True
    deduplicate: bool = True
    reject_placeholders: bool = True


#: Reasons in the order of the steps.
REASONS = ["null", "placeholder", "rare_activity", "rare_object", "duplicate"]
_KEY = ["model", "activity", "object_type", "event_id"]


def _empty(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit(""))) == ""


def _without_duplicates(events: DataFrame, config: CleanConfig) -> DataFrame:
    """``tagged`` up to the frequency steps.

    Both frequency steps need counts of pairs of names only: one aggregation of the log gives them, and what is rare follows from that small
    table. So the log is read twice, once to count and once to tag, however many steps are on.
    """
    reason = F.when(_empty("activity") | _empty("object_type"), "null")
    if config.reject_placeholders:
        reason = reason.when(is_placeholder(F.col("activity")) | is_placeholder(F.col("object_type")), "placeholder")
    t = events.withColumn("drop_reason", reason)
    for c in ("activity", "object_type"):
        t = t.withColumn(f"raw_{c}", F.col(c)).withColumn(c, F.when(F.col("drop_reason").isNull(), clean_text(F.col(c), config.title_case)).otherwise(F.col(c)))
    if config.min_activity_freq <= 1 and config.min_object_freq <= 1:
        return t
    pairs = t.where("drop_reason is null").groupBy("model", "activity", "object_type").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda column: F.sum("_n").over(Window.partitionBy("model", column))
    pairs = pairs.withColumn("_rare", F.when(of("activity") < config.min_activity_freq, "rare_activity"))
    left = F.sum(F.when(F.col("_rare").isNull(), F.col("_n"))).over(Window.partitionBy("model", "object_type"))
    pairs = pairs.withColumn("_rare", F.when(F.col("_rare").isNull() & (left < config.min_object_freq), "rare_object").otherwise(F.col("_rare")))
    rare = pairs.where("_rare is not null").select("model", "activity", "object_type", "_rare")
    t = t.join(rare, ["model", "activity", "object_type"], "left")
    return t.withColumn("drop_reason", F.when(F.col("drop_reason").isNull(), F.col("_rare")).otherwise(F.col("drop_reason"))).drop("_rare")


def tagged(events: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """``events`` with names normalised, raw names kept, and ``drop_reason``: the first step that drops the row, or null."""
    t = _without_duplicates(events, config)
    return _mark_duplicates(t) if config.deduplicate else t


def _mark_duplicates(t: DataFrame) -> DataFrame:
    """The first row of (activity, object_type, event_id) by (source_row, pos) stays.

    The key holds the event's id, so its groups are of the size of an event; a log whose ids are all equal is the
    exception, for which the first row is found by an aggregation that combines before the shuffle.
    """
    key = _KEY
    first = t.where("drop_reason is null").groupBy(*key).agg(F.min(F.struct("source_row", "pos")).alias("_first"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key]
    joined = t.alias("t").join(first.alias("f"), same[0] & same[1] & same[2] & same[3], "left")
    later = F.col("t.drop_reason").isNull() & (F.struct("t.source_row", "t.pos") > F.col("f._first"))
    return joined.select(*[F.col(f"t.{c}") for c in t.columns if c != "drop_reason"], F.when(later, "duplicate").otherwise(F.col("t.drop_reason")).alias("drop_reason"))


def clean(events: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """The rows that stay, normalised. Of rows of one key the first is found by an aggregation that combines before the shuffle, so neither
    a join nor a group in one task is needed."""
    t = _without_duplicates(events, config).where("drop_reason is null").select(*events.columns)
    if not config.deduplicate:
        return t
    rest = [c for c in t.columns if c not in _KEY]
    first = t.groupBy(*_KEY).agg(F.min_by(F.struct(*rest), F.struct("source_row", "pos")).alias("_first"))
    return first.select(*[F.col(c) if c in _KEY else F.col(f"_first.{c}").alias(c) for c in t.columns])


def report(events: DataFrame, config: CleanConfig = CleanConfig(), models: DataFrame | None = None) -> DataFrame:
    """One row a model: rows in and out, drops by reason, altered names, warnings. ``models``: all to report on, so that one without any
    record has a row too.

    Duplicates are counted, not marked: rows are summed by key, and all but one of a key are duplicates.
    """
    t = _without_duplicates(events, config)
    survived = ~F.coalesce(F.col("drop_reason").isin("null", "placeholder"), F.lit(False))
    altered = [F.count_if(survived & (strip(F.col(f"raw_{c}")) != F.col(c))).alias(f"altered_{c}") for c in ("activity", "object_type")]
    event = F.when(F.col("drop_reason").isNull(), F.col("event_id")).alias("event_id")  # other rows need not be told apart
    each = t.groupBy("model", "drop_reason", "activity", "object_type", event).agg(F.count(F.lit(1)).alias("n"), *altered)
    kept = F.col("drop_reason").isNull()
    again = F.sum(F.when(kept, F.col("n") - 1).otherwise(0)) if config.deduplicate else F.lit(0).cast("long")
    counts = [(again if r == "duplicate" else F.sum(F.when(F.col("drop_reason") == r, F.col("n")).otherwise(0))).alias(f"dropped_{r}") for r in REASONS]
    names = [F.array_sort(F.collect_set(F.when(F.col("drop_reason") == r, F.col(c)))).alias(f"names_{r}") for r, c in (("rare_activity", "activity"), ("rare_object", "object_type"))]
    stay = F.count_if(kept) if config.deduplicate else F.sum(F.when(kept, F.col("n")).otherwise(0))
    sums = [F.sum(f"altered_{c}").alias(f"altered_{c}") for c in ("activity", "object_type")]
    out = each.groupBy("model").agg(F.sum("n").alias("rows_in"), stay.alias("rows_out"), *counts, *sums, *names)
    if models is not None:
        out = models.select("model").join(out, "model", "left").na.fill(0)
        out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("names_rare_activity", "names_rare_object")})
    out = out.withColumn("total_dropped", F.col("rows_in") - F.col("rows_out"))
    shown = lambda c: F.concat(F.array_join(F.slice(c, 1, 5), ", "), F.when(F.size(c) > 5, ", ...").otherwise(""))
    warnings = F.array(
        F.when(F.size("names_rare_activity") > 0, F.concat(F.size("names_rare_activity"), F.lit(" rare activities removed: "), shown("names_rare_activity"))),
        F.when(F.size("names_rare_object") > 0, F.concat(F.size("names_rare_object"), F.lit(" rare object types removed: "), shown("names_rare_object"))),
        F.when((F.col("rows_in") > 0) & (F.col("rows_out") == 0), F.lit("every row was dropped")),
        F.when((F.col("rows_out") > 0) & (F.col("rows_out") < 5), F.concat(F.lit("only "), F.col("rows_out"), F.lit(" rows remain"))),
    )
    return out.withColumn("warnings", F.array_compact(warnings)).drop("names_rare_activity", "names_rare_object")
