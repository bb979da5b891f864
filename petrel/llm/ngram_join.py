"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct runs of five words. Under any one order of all runs, two sets that link share at least
``l`` runs among the first ``n - ceil(0.8 n) + l`` of each (an l-prefix), for every l; if they use different l, they share
the smaller one. The order puts frequent runs last. Each document picks its l by estimated cost: a longer prefix costs more postings
but asks for more matches, so fewer candidates are verified. Every candidate is verified on the whole texts. (With both sizes known a pair needs even more matches; see ``prefix_pairs``.)

Steps, all distributed:
 1. how frequent runs are (a statistic over all documents; it sets the order and the costs and cannot change the result);
 2. each document's signature: fingerprint of its set, prefix, and 16 min-hash keys;
 3. documents with equal sets become one class; only its smallest id goes on;
 4. stars: the documents of a min-hash key are held against the smallest of them, and verified links are merged. This costs one
    pair a document and key, and turns large groups of near copies into components without their pairs;
 5. the prefix join, between documents that are not in one component already; candidates with enough matches are verified;
 6. components of all links;
 7. the number of links: all links lie within components, so every pair of classes of a component is verified. A component's texts
    are dealt into cells of two blocks, whose shared runs are counted by products of matrices; a cell gives back counts, not pairs.
Step 5 alone finds the components; step 4 only spares it pairs whose link could not change one. Step 7 leaves out no pair.

Defined results: a null or empty text has an empty set and is linked with nothing; a text of fewer than five words is one run; rows that share
an id are one node; a row without id is linked with nothing and has no component; an empty table gives an empty result; other columns are ignored.
A document's links are counted to other documents, which differ in id or set: rows that share both count once, and rows that share an id but
not the set have counts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, discard, encoded, forget, materialise, mixed, ngrams, pick, pieces
from .components import components

SHINGLE, PERCENT = 5, 80
#: The most matches that a document may ask for; its prefix grows by one run for each.
MOST_MATCHES = 128
#: Min-hash keys a document, and how many two documents share before a star verifies them.
KEYS, SHARED_KEYS = 16, 4
#: A run is frequent from this many documents on.
FREQUENT = 8
#: Frequent runs that a worker holds at most (16 bytes each), and ids that are broadcast at most; more ids are joined by a shuffle.
MOST_FREQUENT, MOST_IDS = 1 << 21, 1 << 20
#: Counting: runs summed at once, runs of a range of hashes, bits of a slot within its range.
CHUNK_RUNS, RANGE_RUNS, SLOT_BITS = 1 << 21, 1 << 22, 24
#: Classes and bytes of text that a block of a component holds, about, and the runs that one product takes.
CELL_ROWS, CELL_BYTES, CELL_RUNS = 512, 4 << 20, 4096


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of a text."""
    words = (text or b"").translate(LOWER).split()
    if len(words) >= SHINGLE:
        return np.unique(ngrams(hashes.of(words), SHINGLE))
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)


def run_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """((slot, n), bits): in how many documents the runs of each slot occur, and how many top bits of a run's hash make its slot.

    Exact over all documents, but for copies that lie together, which count once. Tasks sum runs over chunks of documents and send them packed:
    per chunk and range of hashes one row, of the differences of its sorted slots and their counts, compressed (some 1.5 bytes
    a run). A range holds some ``RANGE_RUNS`` runs whatever the input, and a run is in it once a chunk, however frequent it is.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = max(0, (total // (6 * RANGE_RUNS)).bit_length())
    drop = np.uint64(64 - ranges - SLOT_BITS)

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots, n = np.unique(np.concatenate(held) >> drop, return_counts=True)
        part = (slots >> np.uint64(SLOT_BITS)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for x, c in zip(np.split(slots & np.uint64((1 << SLOT_BITS) - 1), starts[1:]), np.split(n, starts[1:]), strict=True):
            planes = np.stack([np.diff(x.astype(np.int64), prepend=0), c]).astype("<u4").view(np.uint8).reshape(2, -1, 4)
            rows.append(zstandard.compress(planes.transpose(0, 2, 1).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(rows, pa.binary())], ["part", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, held, size = WordHashes(), [], 0
        for b in pieces(batches, rows=4000):
            own = {u.tobytes(): u for u in (shingles(t, hashes) for t in encoded(b.column("text"))) if len(u)}
            held += own.values()
            size += sum(map(len, own.values()))
            if size >= CHUNK_RUNS:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def add(table: pa.Table) -> pa.Table:
        part, slots, n = table["part"][0].as_py(), [], []
        for x in table["packed"].to_pylist():
            a, c = np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4")[:, :, 0]
            slots.append(np.cumsum(a, dtype=np.uint32))
            n.append(c)
        slots, n = np.concatenate(slots), np.concatenate(n)
        order = np.argsort(slots)
        slots, n = slots[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        total = np.add.reduceat(n, first)
        often = total >= FREQUENT
        rest = total[~often]
        # what is not frequent is summed up in one row: slot -1 with the postings, slot -2 with those of other documents
        return pa.table(
            [
                pa.array(np.concatenate([(part << SLOT_BITS) | slots[first][often].astype(np.int64), [-1, -2]])),
                pa.array(np.concatenate([total[often], [rest.sum(), (rest * (rest - 1)).sum()]])),
            ],
            ["slot", "n"],
        )

    counted = docs.select("text").mapInArrow(count, "part long, packed binary").groupBy("part").applyInArrow(add, "slot long, n long")
    return materialise(counted, "ngram-runs"), 64 - int(drop)


def run_statistics(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(sorted slots of frequent runs, their document counts, other documents that hold a run which is not frequent, bits of a slot).

    Frequent are runs of at least ``FREQUENT`` documents. Workers hold at most ``MOST_FREQUENT`` of them: where there are more, the
    least frequent of them are ordered like rare ones, by hash. That bounds memory and can cost pairs, but changes no result.
    """
    counts, bits = run_counts(docs)
    totals = {r.slot: r.n for r in counts.where("slot < 0").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    often, least, held = counts.where("slot >= 0"), FREQUENT, 0
    level = F.floor(F.log2("n") * 4)
    for r in often.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():  # some 100 rows
        held += r.k
        if held > MOST_FREQUENT:
            break
        least = r.least
    found = often.where(F.col("n") >= least).toArrow()
    slots, n = np.asarray(found["slot"]).astype(np.int64), np.asarray(found["n"]).astype(np.int64)
    order = np.argsort(slots)
    return slots[order].astype(np.uint64), n[order], totals.get(-2, 0) / max(1, totals.get(-1, 0)), bits


def frequency_of(runs: np.ndarray, frequent: np.ndarray, counts: np.ndarray, bits: int = 64) -> np.ndarray:
    """In how many documents each run occurs if it is frequent, else 0."""
    if not len(frequent):
        return np.zeros(len(runs))
    slots = runs >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(frequent, slots), len(frequent) - 1)
    return np.where(frequent[at] == slots, counts[at], 0)


def prefix_by(runs: np.ndarray, often: np.ndarray, others: float) -> tuple[np.ndarray, int]:
    """(prefix, l): the l-prefix of the least estimated cost, in the global order (frequency, hash).

    The cost, in postings: those written, those read (the other documents of each run), and candidates verified, at a cost that
    follows the document's length. A candidate takes l matches and, by ``prefix_pairs``, some 0.04 n more on average over
    the sizes that can link, so there are at most (postings read) / (l + 0.04 n) of them.
    """
    n = len(runs)
    order = np.lexsort((runs, often))
    need = -(-PERCENT * n // 100)
    longest = n - need + min(MOST_MATCHES, need)
    read = np.cumsum(np.where(often > 0, often - 1, others)[order[:longest]])
    lengths = np.arange(n - need + 1, longest + 1)
    matches = lengths - (n - need)
    cost = lengths + read[lengths - 1] * (1 + max(4, n / 8) / (matches + 0.04 * n))
    best = int(np.argmin(cost))
    return runs[order[: lengths[best]]], int(matches[best])


def prefix_of(runs: np.ndarray, frequent: np.ndarray, counts: np.ndarray, others: float) -> tuple[np.ndarray, int]:
    return prefix_by(runs, frequency_of(runs, frequent, counts), others)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n, a, b, matches, often, prefix, keys) of each document; t is a hash of its text, often its number of frequent runs."""
    shared = docs.sparkSession.sparkContext.broadcast(run_statistics(docs))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        frequent, counts, others, slot_bits = shared.value
        hashes = WordHashes()
        bins = np.uint64(KEYS)
        for b in pieces(batches):
            sizes, prints, matches, often, prefixes, keys = [], [], [], [], [], []
            for t in encoded(b.column("text")):
                u = shingles(t, hashes)
                sizes.append(len(u))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), np.int64))
                f = frequency_of(u, frequent, counts, slot_bits)
                p, m = prefix_by(u, f, others) if len(u) else (u, 0)
                matches.append(m)
                often.append(np.count_nonzero(f))
                prefixes.append(p)
                x = np.sort(mixed(u ^ np.uint64(0x5BD1E995)))
                at = np.unique(x % bins, return_index=True)[1]
                keys.append(x[at])  # the smallest of each bin; the bin shows in the value itself
            prints = np.stack(prints)
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in col])]).astype(np.int32), pa.array(np.concatenate(col).view(np.int64))) for col in (prefixes, keys)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("t"), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(matches, pa.int32()), pa.array(often, pa.int32()), *lists],
                ["doc_id", "t", "n", "a", "b", "matches", "often", "prefix", "keys"],
            )

    return docs.withColumn("t", F.xxhash64("text")).mapInArrow(sign, "doc_id long, t long, n long, a long, b long, matches int, often int, prefix array<long>, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts link. Only texts of ids in a pair are shuffled."""
    pairs = materialise(pairs.select("a", "b"), "ngram-pairs")
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ngram-ids")
    few = ids.count() <= MOST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")
    texts = materialise(texts.select("doc_id", "text"), "ngram-texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, last, left = WordHashes(), None, None
        for batch in batches:
            for b in pieces([batch], rows=500, most_bytes=4 << 20):
                ok = []
                for x, y in zip(encoded(b.column("text")), encoded(b.column("other")), strict=True):
                    if x != last:
                        last, left = x, shingles(x, hashes)
                    right = shingles(y, hashes)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= PERCENT * (len(left) + len(right) - both))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
    with_both = with_b.join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    links = materialise(with_both.select("a", "text", "b", "other").mapInArrow(check, "a long, b long").distinct(), "ngram-links")
    discard(pairs, ids, texts)
    return links


def _alike(n: str, m: str):
    """Whether sets of these sizes can link."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def star_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b): each document of a key and the centre of the key, if they share enough keys. ``keyed``: (doc_id, n, keys).

    The centre is the document whose own keys are the most common: of copies that were each changed elsewhere that is the one that
    most others lie next to, be it their source or not. Every step is a sum or a minimum per key or document.
    """
    each = keyed.select("doc_id", "n", F.explode("keys").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    each = each.join(common, "key")
    central = each.groupBy("doc_id").agg(F.sum("docs").alias("central"))
    each = each.join(central, "doc_id")
    centre = each.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("less"), "doc_id", "n")).alias("c"))
    met = each.join(centre.select("key", F.col("c.doc_id").alias("a"), F.col("c.n").alias("m")), "key").where((F.col("doc_id") != F.col("a")) & _alike("n", "m"))
    return met.groupBy(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= SHARED_KEYS)


def prefix_pairs(prefixed: DataFrame) -> DataFrame:
    """(a, b): documents of different components whose prefixes share enough runs.

    ``prefixed``: (doc_id, component, n, matches, often, prefix).

    Copies that were each changed elsewhere share their frequent runs with all others of their group. If two sets hold fewer frequent
    runs than a link needs, they must share rare ones, and as rare runs come first in the order, a prefix that reaches a frequent run holds
    all rare ones. So such pairs need not meet at frequent runs at all: those that can link meet at a rare one.
    """
    post = prefixed.select("doc_id", "component", F.col("n").cast("int").alias("n"), "matches", "often", F.posexplode("prefix").alias("pos", "run"))
    post = post.withColumn("frequent", F.col("pos") >= F.col("n") - F.col("often"))
    columns = ("doc_id", "component", "n", "matches", "often", "frequent")
    left, right = (post.select("run", *[F.col(c).alias(c + side) for c in columns]) for side in ("_a", "_b"))
    # Linked sets share ceil(0.8 / 1.8 * (n_a + n_b)) runs at least.
    least = "(80 * (n_a + n_b) + 179) div 180"
    can = F.col("doc_id_a") < F.col("doc_id_b")
    can &= (F.col("component_a") != F.col("component_b")) & _alike("n_a", "n_b")
    met = left.join(right, "run").where(can & F.expr(f"NOT (frequent_a AND frequent_b) OR least(often_a, often_b) >= {least}"))
    # Shared runs beyond the prefix that ends first are at most its set's rest, ceil(0.8 n) - matches; the others lie in both prefixes.
    rest = "greatest((80 * n_a + 99) div 100 - matches_a, (80 * n_b + 99) div 100 - matches_b)"
    whole = " AND ".join(f"n_{x} - (80 * n_{x} + 99) div 100 + matches_{x} >= n_{x} - often_{x}" for x in "ab")  # both hold all rare runs
    need = F.min(F.expr(f"CASE WHEN least(often_a, often_b) < {least} AND {whole} THEN {least} - least(often_a, often_b) ELSE {least} - {rest} END"))
    pairs = met.groupBy(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), need.alias("need"))
    return pairs.where("shared >= need")


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``left`` links with each of ``right``."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    runs = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(*runs)
    places = []
    for n, r in zip(sizes, runs, strict=True):
        column = np.searchsorted(common, r)
        keep = np.flatnonzero(common[np.minimum(column, len(common) - 1)] == r) if len(common) else np.empty(0, np.int64)
        keep = keep[np.argsort(column[keep], kind="stable")]
        places.append((np.repeat(np.arange(len(n)), n)[keep], column[keep]))
    both = np.zeros((len(left), len(right)))
    for start in range(0, len(common), CELL_RUNS):
        parts = []
        for (row, column), side in zip(places, (left, right), strict=True):
            a, b = np.searchsorted(column, [start, start + CELL_RUNS])
            parts.append(np.zeros((len(side), min(CELL_RUNS, len(common) - start)), np.float32))
            parts[-1][row[a:b], column[a:b] - start] = 1
        both += parts[0] @ parts[1].T
    return (both > 0) & (100 * both >= PERCENT * (sizes[0][:, None] + sizes[1][None] - both))


def link_counts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, n): the documents in other classes that each class links with. ``members``: (node, doc_id, t, size, component) of the classes
    that have a component.
    """
    keyed = docs.where("doc_id is not null").withColumn("t", F.xxhash64("text"))
    texts = materialise(keyed.join(members, ["doc_id", "t"]).select("node", "size", "component", "text"), "ngram-linked")
    wide = F.octet_length("text")
    of = materialise(texts.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum(wide).alias("w")), "ngram-sizes")
    blocks = F.greatest(F.ceil(F.col("m") / CELL_ROWS), F.ceil(F.col("w") / CELL_BYTES))
    large = of.select("component", blocks.alias("blocks")).where("blocks > 1")
    total = of.agg(F.sum("m").alias("m"), F.sum("w").alias("w")).first()
    buckets = max(1, -(-(total.m or 0) // CELL_ROWS), -(-(total.w or 0) // CELL_BYTES))

    # A small component lies whole in a bucket of several; each block of a large one meets every block of it.
    dealt = texts.join(F.broadcast(large), "component", "left").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("blocks", F.lit(1))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    group = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))
    dealt = dealt.select(
        group.alias("g"), F.col("blocks").isNotNull().alias("large"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "component", "node", "size", "text",
    )

    def cell(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        node, first = np.unique(np.asarray(table["node"]), return_index=True)  # repeated rows once
        size, component, block = (np.asarray(table[c])[first] for c in ("size", "component", "block"))
        text = table["text"].take(pa.array(first)).combine_chunks()
        sets = [shingles(t, hashes) for t in encoded(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)]
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        n = np.zeros(len(node), np.int64)
        order = np.lexsort((block, component))
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            a, b = at[block[at] == low], at[block[at] == high]
            if not len(a) or not len(b):
                continue
            ok = linked([sets[k] for k in a], [sets[k] for k in b])
            if low == high:
                np.fill_diagonal(ok, False)
            else:
                n[b] += ok.T @ size[a]
            n[a] += ok @ size[b]
        return pa.table([pa.array(node), pa.array(n)], ["node", "n"])

    return dealt.groupBy("g", "large", "low", "high").applyInArrow(cell, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def join(docs: DataFrame, count: bool = True) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_id (the smallest id with an equal set), and, unless ``count`` is off, n_links."""
    d = pick(docs, doc_id="long", text="string")
    signed = materialise(signatures(d), "ngram-signatures")
    named = signed.where("n > 0 and doc_id is not null")
    each = named.groupBy("doc_id", "a", "b").agg(F.min("t").alias("t"))
    classes = each.groupBy("a", "b").agg(F.min(F.struct("doc_id", "t")).alias("c"), F.count(F.lit(1)).alias("size"))
    classes = classes.select("a", "b", F.col("c.doc_id").alias("class_id"), F.col("c.t").alias("t"), "size", F.monotonically_increasing_id().alias("id"))
    classes = materialise(classes, "ngram-classes")
    of_class = named.select("doc_id", "a", "b").join(classes, ["a", "b"]).select("doc_id", "class_id").distinct()
    of_class = materialise(of_class, "ngram-members")
    own = of_class.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("z")).where("b < z")
    same_id = of_class.join(own, "doc_id").where("class_id <> b").select(F.col("class_id").alias("a"), "b")

    heads = classes.select(F.col("class_id").alias("doc_id")).distinct()
    stars = verified(star_pairs(named.select("doc_id", "n", "keys").join(heads, "doc_id", "left_semi")), d)
    found = components(stars, "ngram-stars")
    labelled = heads.join(found, heads.doc_id == found.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    links = verified(prefix_pairs(named.select("doc_id", "n", "matches", "often", "prefix").join(labelled, "doc_id")), d)

    final = components(stars.union(links).union(same_id.select("a", "b")), "ngram-components")
    columns = ["a", "b", "class_id"]
    if count:
        members = classes.join(final, classes.class_id == final.node)
        met = link_counts(members.select(F.col("id").alias("node"), F.col("class_id").alias("doc_id"), "t", "size", "component"), d)
        columns.append((F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
        classes = classes.join(met.withColumnRenamed("node", "id"), "id", "left")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "a", "b").join(classes.select(*columns), ["a", "b"], "left")
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("class_id", F.when(known, F.col("class_id")).otherwise(F.col("doc_id")))
    out = out.join(final, out.class_id == final.node, "left")
    links = [F.when(known, F.col("n_links")).otherwise(0).alias("n_links")] if count else []
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id", *links)


#: For tables of unique ids that are not null; links between texts of equal sets count like others.
QUERY_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) >= {n} THEN array_to_string(words[i : i + {n} - 1], ' ') ELSE array_to_string(words, ' ') || chr(10) END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - {n} + 2))) AS i FROM d WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(9) ORDER BY g)) AS whole FROM s GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM size),
head AS (SELECT class_id, any_value(n) AS n, count(*) AS members FROM class GROUP BY class_id),
hs AS (SELECT s.doc_id, s.g FROM s JOIN head ON s.doc_id = head.class_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM hs x JOIN hs y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN head p ON a = p.class_id JOIN head q ON b = q.class_id WHERE 100 * k >= {percent} * (p.n + q.n - k)),
reach AS (SELECT class_id AS a, class_id AS b FROM head UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
near AS (SELECT a, sum(members) AS n FROM link JOIN head ON b = class_id GROUP BY a)
SELECT d.doc_id, coalesce(class.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(class.class_id, d.doc_id) AS class_id,
  CAST(CASE WHEN class.n IS NULL THEN 0 ELSE members - 1 + coalesce(near.n, 0) END AS BIGINT) AS n_links
FROM d LEFT JOIN class ON d.doc_id = class.doc_id LEFT JOIN head ON class.class_id = head.class_id
  LEFT JOIN component ON class.class_id = component.a LEFT JOIN near ON class.class_id = near.a
""".replace("{n}", str(SHINGLE)).replace("{percent}", str(PERCENT))
