"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each document has a 60-bit hash of its id. A source that should give ``target`` words out of ``size`` gives every
document ``floor(target / size)`` times, and those below a hash threshold once more. The threshold is found without
sorting documents: words are summed by (source, 12 hash bits), the bucket in which the budget runs out is the
boundary bucket, and only that one is summed again by the next 12 bits, five times in all. A smaller budget takes a
subset of what a larger one takes (budgets are nested), and reruns agree, as nothing but ids and sizes decides.

Defined results: a null text or one without words has size 0 and takes 0; a null source is a source of its own,
after all others; rows that share an id share their hash and are taken or left together; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick, pick_with_row

#: Weights by position of the source, repeated.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MOST_EPOCHS = 3
HASH_BITS, LEVEL_BITS = 60, 12
#: Tables of a row per source are broadcast up to this many sources; beyond, they are joined by shuffling.
MOST_BROADCAST = 50_000
_SPACE = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than U+0020 and U+0009 to U+000D; 0 for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, f"[{_SPACE}]+"))).otherwise(0).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's digits (an empty string for null), as every SQL engine can compute them."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to a table (source, source_size) of one row per source.

    Shares follow the weights; a source stops at ``most_epochs`` times its size and the excess is shared again by
    weight, until none is above. That ends at the one level at which target = min(cap, weight * level), found from
    running sums over the sources ordered by cap / weight. Sources are few; this is the only step in one task.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    s = s.withColumn("at", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    before, everything = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("shares", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    uncapped = F.col("cap").cast("double") * F.col("shares") >= F.col("weight").cast("double") * F.col("rest")
    s = s.withColumn("level", F.min(F.when(uncapped, F.struct("at", "rest", "shares"))).over(everything))
    shared = (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.shares").cast("double")
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), shared).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, few: bool = False) -> DataFrame:
    """(source, threshold) for (source, budget): documents of a hash below the threshold fill the budget best. ``few``: sources to broadcast.

    ``sized``: (source, size, hash). One narrow aggregation per level; beyond the first it reads one bucket of each
    source only. The boundary hash itself is taken if that comes closer to the budget than leaving it.
    """
    state = budgets.select(F.col("source").alias("of"), "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("taken"))
    for level in range(HASH_BITS // LEVEL_BITS):
        above, shift = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level + 1)
        here = sized.join(F.broadcast(state) if few else state, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", above) == F.shiftright("low", above)))
        hist = here.groupBy("of", "budget", "taken", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = F.col("taken") + F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
        over = hist.withColumn("up_to", up_to).where(F.col("up_to") > F.col("budget"))
        first = over.groupBy("of", "budget").agg(F.min(F.struct("bucket", (F.col("up_to") - F.col("words")).alias("taken"), "up_to")).alias("b"))
        state = first.select("of", "budget", F.shiftleft("b.bucket", shift).alias("low"), F.col("b.taken").alias("taken"), F.col("b.up_to").alias("up_to"))
    closer = (F.col("taken") + F.col("up_to")).cast("double") < 2 * F.col("budget")
    return state.select(F.col("of").alias("source"), (F.col("low") + closer.cast("long")).alias("threshold"))


def plan(sized: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> tuple[DataFrame, bool]:
    """(of, source_size, target, whole, threshold) per source, and whether the sources are few enough to be broadcast.

    ``sized``: (source, size, hash). A document of hash h is taken ``whole`` times and once more if h is below the threshold.
    """
    sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    few = sources.count() <= MOST_BROADCAST
    limits = thresholds(sized, sources.where("source_size > 0").select("source", "budget"), few)
    s = sources.alias("s").join(limits.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
    return s.select(F.col("s.source").alias("of"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")), few


def _sized(docs: DataFrame) -> DataFrame:
    d = pick(docs, doc_id="long", text="string", source="string")
    return materialise(d.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash")), "mix-sizes")


def _epochs() -> Column:
    return F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, epochs."""
    sized = _sized(docs)
    s, few = plan(sized, weights, most_epochs)
    out = sized.join(F.broadcast(s) if few else s, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _epochs()).alias("taken"), _epochs().alias("epochs"))


def repeated(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever their names.

    A row's times follow from its own id and source, so the texts stay where they are: only the table of sources comes to them.
    """
    s, few = plan(_sized(docs), weights, most_epochs)
    d = pick_with_row(docs, doc_id="long", source="string").select("row", "source", doc_hash(F.col("doc_id")).alias("hash"))
    taken = d.join(F.broadcast(s) if few else s, F.col("source").eqNullSafe(F.col("of"))).where(_epochs() > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), _epochs()))).select("row.*")


QUERY_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM {documents}),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * 3 AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS pos FROM s),
r AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0) AS rest,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER b, 0) AS shares
  FROM o WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest, shares FROM r WHERE CAST(cap AS DOUBLE) * shares >= CAST(weight AS DOUBLE) * rest ORDER BY pos LIMIT 1),
t AS (
  SELECT r.source, r.source_size, least(CAST(r.cap AS DOUBLE), CAST(r.weight * l.rest AS DOUBLE) / CAST(l.shares AS DOUBLE)) AS target
  FROM r, l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS up_to,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN CAST(2 * up_to - here AS DOUBLE) < 2 * budget AND source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
