"""Substring dedup by relative Lempel-Ziv parsing over blocks of the corpus.

The corpus is dealt into reference blocks of bounded size. Each block has an index: the sorted hashes of its phrases, that is
of every run of ``WINDOW`` consecutive words, with their first place. A document is factored greedily from left to right: where the next ``WINDOW``
words occur earlier, in any block, a factor begins at the earliest place that has them, its source, and grows by a word as long as the next
phrase's earliest place is the next of the source. Then the phrases that reach over the factor's end are looked up too, as they may come from another
source; the first of them that occurs earlier begins the next factor. Factors have ``WINDOW`` words at least, so their union is exactly what the phrases that
occur earlier cover: a duplicate span.

Every block's index is asked through an exchange of phrases, so that no block is sent to all others. Each phrase has an anchor, the smallest hash of the
8-word runs within it, which depends on its words alone; neighbouring phrases mostly share one. Blocks first exchange their distinct anchors (about one in seven
phrases has a new one); only phrases whose anchor another block has too are exchanged themselves, each once a block, and the earliest place comes back. So a
passage that a third of all documents share is one row a block, and the exchange reads its sorted rows as a stream, however many there are.

Equal hashes are not taken for equal words. Phrases carry a second hash, independent of the first, wherever they go, 96 bits in all; of a factor whose source is in the
same block, the words at both of its ends are compared with the source's.

Order: by doc_id, then by place; a null id comes before all others. Defined results: a null text has no words; texts of fewer
than ``WINDOW`` words lose nothing; rows that share an id, and those without one, are ordered by their texts and lie in one block, so a repeated row is a copy of
the first; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, forget, mixed, ngrams, pick, word_hashes

WINDOW = 20
#: Words of the runs that anchor a phrase.
ANCHOR = 8
#: Bytes of text that a reference block holds, about; a task holds one block at a time. A small corpus has this many blocks of a megabyte or more.
BLOCK_BYTES, SMALL = 6 << 20, 12
_FIRST = np.int64(-(2**63))
_SALT = np.uint64(0x5851F42D4C957F2D)


def _check(words: np.ndarray) -> np.ndarray:
    """A second hash of every phrase, independent of the first."""
    return (ngrams(mixed(words ^ _SALT), WINDOW) >> np.uint64(32)).astype(np.uint32)


class Block:
    """The documents of a block in order, their words' hashes, phrases and anchors.

    ``at``: the word at which each phrase begins; ``which``: its number in the index; ``first``: the phrase that is the first of each number.
    """

    def __init__(self, table: pa.Table):
        ids = [(_FIRST if i is None else i) for i in table["doc_id"].to_pylist()]
        texts = [t for c in table["text"].chunks for t in encoded(c)]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k] is not None, texts[k] or b""))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.rows, self.texts = order, [texts[k] for k in order]
        self.words, self.lengths = word_hashes(self.texts)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.n = len(self.words)
        self.doc = np.repeat(np.arange(len(order)), self.lengths)
        phrases = ngrams(self.words, WINDOW)
        whole = self.doc[: len(phrases)] == self.doc[WINDOW - 1 :] if len(phrases) else np.empty(0, bool)
        self.at = np.flatnonzero(whole)
        self.phrases = phrases[self.at]
        self.checks = _check(self.words)[self.at] if len(self.at) else np.empty(0, np.uint32)
        order = np.argsort(self.phrases, kind="stable")
        new = self._begins(order)
        if (new[1:] & (self.phrases[order[1:]] == self.phrases[order[:-1]])).any():  # two phrases of one hash
            order = np.lexsort((self.checks, self.phrases))
            new = self._begins(order)
        self.first = order[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def _begins(self, order: np.ndarray) -> np.ndarray:
        p, c = self.phrases[order], self.checks[order]
        return np.concatenate([[True] * min(1, len(p)), (p[1:] != p[:-1]) | (c[1:] != c[:-1])]).astype(bool)

    def anchors(self) -> np.ndarray:
        """The anchor of each phrase of the index."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        least, width, wide = ngrams(self.words, ANCHOR), 1, WINDOW - ANCHOR + 1
        while width * 2 <= wide:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        begin = self.at[self.first]
        return np.minimum(least[begin], least[begin + wide - width])


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    d = pick(docs, doc_id="long", text="string")
    total = d.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(-(-total // block_bytes), min(SMALL, total >> 20), 1)
    return d.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(blocks)).cast("int"))


def shared_anchors(docs: DataFrame) -> DataFrame:
    """(block, anchor): the anchors of each block that another block has too."""

    def own(table: pa.Table) -> pa.Table:
        forget()
        anchors = np.unique(Block(table).anchors())
        k = table["block"][0].as_py() if table.num_rows else 0
        return pa.table([pa.array(anchors.view(np.int64)), pa.array(np.full(len(anchors), k, np.int32))], ["anchor", "block"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = (np.empty(0, np.int64), np.empty(0, np.int32)), False  # the last row, and whether it equals the one before
        for b in batches:
            anchor, block = (np.concatenate([h, np.asarray(b.column(x))]) for h, x in zip(held, ("anchor", "block"), strict=True))
            if not len(anchor):
                continue
            same = anchor[1:] == anchor[:-1]
            keep = same | np.concatenate([[again], same[:-1]])[: len(same)]
            yield pa.RecordBatch.from_arrays([pa.array(block[:-1][keep]), pa.array(anchor[:-1][keep])], ["block", "anchor"])
            held, again = (anchor[-1:], block[-1:]), bool(same[-1]) if len(same) else again
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[0])], ["block", "anchor"])

    each = docs.groupBy("block").applyInArrow(own, "anchor long, block int")
    return each.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(common, "block int, anchor long")


def earlier_elsewhere(docs: DataFrame) -> DataFrame:
    """(block, place, source_block, source): the indexed phrases of each block that occur earlier in another block, and the earliest place of all.

    ``place`` is the word of the block at which the phrase of its index begins, ``source`` the word of the source block at which it begins there.
    """

    def sent(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        if left.num_rows and right.num_rows:
            b = Block(left)
            anchors = np.sort(np.concatenate([np.asarray(c) for c in right["anchor"].chunks]).view(np.uint64))
            mine = b.anchors()
            found = np.flatnonzero(anchors[np.minimum(np.searchsorted(anchors, mine), len(anchors) - 1)] == mine)
            first = b.first[found]
            place = (np.int64(left["block"][0].as_py()) << np.int64(32)) | b.at[first].astype(np.int64)
            cols = [b.phrases[first].view(np.int64), b.checks[first].view(np.int32), b.ids[b.doc[b.at[first]]], place]
        return pa.table([pa.array(c) for c in cols], ["phrase", "again", "doc", "place"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (phrase, second hash, the earliest place)
        for b in batches:
            phrase, again, place = (np.asarray(b.column(x)) for x in ("phrase", "again", "place"))
            if not len(phrase):
                continue
            goes_on = last is not None and (phrase[0], again[0]) == last[:2]
            same = np.concatenate([[goes_on], (phrase[1:] == phrase[:-1]) & (again[1:] == again[:-1])])
            begin = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
            source = np.where(begin < 0, last[2] if goes_on else 0, place[begin])
            last = (phrase[-1], again[-1], source[-1])
            mine, from_ = place[same], source[same]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int32)) for x in (mine >> 32, mine & 0xFFFFFFFF, from_ >> 32, from_ & 0xFFFFFFFF)], ["block", "place", "source_block", "source"]
            )

    phrases = docs.groupBy("block").cogroup(shared_anchors(docs).groupBy("block")).applyInArrow(sent, "phrase long, again int, doc long, place long")
    dealt = phrases.repartition("phrase").sortWithinPartitions("phrase", "again", "doc", "place").select("phrase", "again", "place")
    return dealt.mapInArrow(later, "block int, place int, source_block int, source int")


def factors_of(b: Block, block: int, places: np.ndarray, source_block: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The factors of the block's documents: rows (first word in the block, length, source block, first word of the source).

    The phrases that begin at ``places`` and are in the index occur earlier elsewhere, first at the given sources.
    """
    places = b.which[np.searchsorted(b.at, places)] if len(places) else places
    fresh = np.zeros(len(b.at), bool)
    fresh[b.first] = True  # the first of its kind here
    from_block, from_word = np.full(len(b.first), block, np.int64), b.at[b.first].astype(np.int64)
    from_block[places], from_word[places] = source_block, source
    fresh[b.first[places]] = False  # but not everywhere
    phrase = np.flatnonzero(~fresh)
    begin, which = b.at[phrase], b.which[phrase]
    from_block, from_word = from_block[which], from_word[which]
    # A factor goes on while the next phrase follows in the text and in the source.
    goes_on = (np.diff(begin) == 1) & (np.diff(from_block) == 0) & (np.diff(from_word) == 1) & (b.doc[begin[1:]] == b.doc[begin[:-1]])
    heads = np.flatnonzero(np.concatenate([[True] * min(1, len(begin)), ~goes_on]).astype(bool))
    tails = np.append(heads[1:], len(begin))[: len(heads)] - 1
    own, run = from_block[heads] == block, np.arange(WINDOW)
    for end in (heads, tails):  # the words at both ends, where the source is at hand
        here = np.flatnonzero(own)
        ok = (b.words[begin[end[here]][:, None] + run] == b.words[from_word[end[here]][:, None] + run]).all(1)
        own[here] &= ok
    good = own | (from_block[heads] != block)
    out = np.stack([begin[heads], begin[tails] - begin[heads] + WINDOW, from_block[heads], from_word[heads]], 1)
    return out[good]


def _spans(covered: np.ndarray) -> np.ndarray:
    """(start, length) of each run of covered words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], 1)


_SPAN, _FACTOR = "start:long,length:long", "start:long,length:long,block:long,source:long"


def _structs(rows: list[np.ndarray], names: list[str]) -> pa.Array:
    """A list of structs per document."""
    flat = np.concatenate([*rows, np.empty((0, len(names)), np.int64)])
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k].astype(np.int64)) for k in range(len(names))], names))


def parse(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans (start, length in words), factors (start, length, block and word of the source),
    text (the words left, joined by one space)."""
    d = blocked(docs, block_bytes)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sizes, gone, spans, parsed, texts = [], [], [], [], [], []
        if left.num_rows:
            b = Block(left)
            back = [np.concatenate([np.empty(0, np.int32), *[np.asarray(c) for c in right[x].chunks]]).astype(np.int64) for x in ("place", "source_block", "source")]
            factors, own = factors_of(b, left["block"][0].as_py(), *back), left["doc_id"].to_pylist()
            edges = np.zeros(b.n + 1, np.int64)
            np.add.at(edges, factors[:, 0], 1)
            np.add.at(edges, factors[:, 0] + factors[:, 1], -1)
            covered = np.cumsum(edges)[: b.n] > 0
            bounds = np.searchsorted(factors[:, 0], np.append(b.starts, b.n))
            for k, (row, text, at, n) in enumerate(zip(b.rows, b.texts, b.starts, b.lengths, strict=True)):
                c, words = covered[at : at + n], (text or b"").split()
                some = bounds[k] < bounds[k + 1]
                ids.append(own[row])
                sizes.append(int(n))
                gone.append(int(c.sum()) if some else 0)
                spans.append(_spans(c) if some else np.empty((0, 2), np.int64))
                parsed.append(factors[bounds[k] : bounds[k + 1]] - np.array([at, 0, 0, 0]))
                texts.append(b" ".join([w for w, x in zip(words, c.tolist(), strict=True) if not x] if some else words))
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), _structs(spans, ["start", "length"]), _structs(parsed, ["start", "length", "block", "source"]), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "spans", "factors", "text"],
        )

    schema = f"doc_id long, n_words long, n_removed long, spans array<struct<{_SPAN}>>, factors array<struct<{_FACTOR}>>, text string"
    return d.groupBy("block").cogroup(earlier_elsewhere(d).groupBy("block")).applyInArrow(cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    return parse(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, doc_id, text, i, array_to_string(words[i : i + {last}], ' ') AS g FROM (SELECT r, doc_id, text, words, unnest(range(1, len(words) - {last} + 1)) AS i FROM d)),
later AS (SELECT r, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, text, r, i) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS p FROM later),
kept AS (
  SELECT e.r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (gone.p IS NULL) AS kept
  FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d) e LEFT JOIN gone ON e.r = gone.r AND e.p = gone.p GROUP BY e.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
""".replace("{window}", str(WINDOW)).replace("{last}", str(WINDOW - 1))
