"""Benchmark decontamination: a generalised suffix automaton of the normalised test items, run over every document.

The automaton accepts every run of words of every item. A document is streamed through it word by word, keeping the
length of the longest run that ends at the word and occurs in an item. Wherever that length reaches ``window`` words,
the last ``window`` of them are hit; an item shorter than a window is hit where the whole of it occurs, which is seen
on the suffix links above the state. Spans are the runs of hit words; a document is cleaned by removing spans, or
dropped if too much of it is hit.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

Defined results: a null text has no words and is never contaminated; an item that is null, has no words or has no id is never
found; items with equal texts are found together; items that share an id are one item; texts of any length are streamed whole; rows of documents
that share an id are judged each by itself; with an empty benchmark nothing is hit; other columns of either table are ignored
(``clean`` passes those of the documents on).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, field, keep, pick, pieces

WINDOW = 10
#: One automaton has at most about this many words of items; a larger benchmark is split into several, one after another.
AUTOMATON_WORDS = 400_000
#: With several automata, texts that a worker runs through one of them before it builds the next, in bytes.
HELD_BYTES = 48 << 20
#: A span of at least this many words is removed; above this share of hit words the whole document goes.
SPAN_WORDS, COVERAGE = 10, 0.5

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over words; state 0 is the empty run.

    ``found[state]`` is what a match of at least ``window`` words in the state proves: the items that contain its last
    window. ``short[state]`` lists (length, items) of the short items that end a match in the state.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w, owners)
        # Each state learns which items hold its runs: along every item's own path and up the suffix links.
        for item, words in items:
            state = 0
            for w in words:
                state = self.next[state][w]
                up = state
                while up > 0 and item not in owners[up]:
                    owners[up].add(item)
                    up = self.link[up]
        ends: dict[int, tuple[int, set[int]]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                ends.setdefault(state, (len(words), set()))[1].add(item)
        n = len(self.next)
        self.found: list[frozenset[int] | None] = [None] * n
        self.short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= window:
                self.found[state] = self.found[up] if self.length[up] >= window else frozenset(owners[state])
            own = ends.get(state)
            self.short[state] = (*self.short[up], (own[0], frozenset(own[1]))) if own else self.short[up]
        self.reports = [bool(self.found[s] or self.short[s]) for s in range(n)]

    def _state(self, length: int, link: int, edges: dict[bytes, int], owners: list[set[int]]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        owners.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int, owners: list[set[int]]) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), owners)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes, owners: list[set[int]]) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, owners)
        state, p = self._state(self.length[last] + 1, 0, {}, owners), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, owners)
        return state

    def scan(self, words: list[bytes], hit: bytearray) -> set[int]:
        """Marks the hit words of a document; the items found."""
        nexts, link, length, reports, window = self.next, self.link, self.length, self.reports, self.window
        found: set[int] = set()
        state = run = 0
        for i, w in enumerate(words):
            to = nexts[state].get(w)
            if to is None:
                if not state:
                    continue
                while to is None and state:
                    state = link[state]
                    to = nexts[state].get(w)
                if to is None:
                    run = 0
                    continue
                run = length[state]
            state = to
            run += 1
            if reports[state]:
                if run >= window and self.found[state]:
                    # a state whose own runs include the window: shorter runs of it lie up the links
                    hit[i + 1 - window : i + 1] = b"\x01" * window
                    found |= self.found[state]
                for n, items in self.short[state]:
                    if run >= n:
                        hit[i + 1 - n : i + 1] = b"\x01" * n
                        found |= items
        return found


def automata(benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> list:
    """The items as broadcast lists that each fit into one automaton.

    The benchmark is the stated query set of the operator: it is read to the driver as a stream, one bounded list at a time,
    which is sent before the next is read.
    """
    send = benchmark.sparkSession.sparkContext.broadcast
    lists, items, room = [], [], most_words
    for r in pick(benchmark, item_id="long", text="string").orderBy("item_id", "text").toLocalIterator():
        words = words_of(r.text.encode() if r.text is not None else None)
        if not words or r.item_id is None:
            continue
        if len(words) > room and items:
            lists.append(send(items))
            items, room = [], most_words
        items.append((r.item_id, words))
        room -= len(words)
    return [*lists, send(items)] if items else lists


def spans_of(hit: bytes | bytearray) -> list[tuple[int, int]]:
    """(start, length) of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(hit) + b"\0", np.int8)))
    return [(int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]


def _built(items, window: int) -> Automaton:
    made = Automaton(items.value, window)
    items.__dict__.pop("_value", None)  # the automaton is enough; the worker reads the broadcast file again if it must
    return made


def _scanned(batches: Iterator[pa.RecordBatch], lists: list, token: str, window: int) -> Iterator[tuple[pa.RecordBatch, list[bytearray], list[set[int]]]]:
    """(slice, which words of each text are hit, items found in each).

    With one list of items its automaton is kept between tasks and slices are streamed. With several, a worker holds one automaton and
    ``HELD_BYTES`` of texts, which it runs through one automaton after the other.
    """

    def through(held: list[pa.RecordBatch]):
        out = [[(bytearray(len(words_of(t))), set()) for t in encoded(field(b, "text", pa.string()))] for b in held]
        for k, items in enumerate(lists):
            a = keep((token, k), lambda items=items: _built(items, window))
            for b, each in zip(held, out, strict=True):
                for t, (hit, found) in zip(encoded(field(b, "text", pa.string())), each, strict=True):
                    found |= a.scan(words_of(t), hit)
        for b, each in zip(held, out, strict=True):
            yield b, [hit for hit, _ in each], [found for _, found in each]

    held, size = [], 0
    for b in pieces(batches, most_bytes=2 << 20):
        held.append(b)
        size += field(b, "text", pa.string()).nbytes
        if len(lists) < 2 or size >= HELD_BYTES:
            yield from through(held)
            held, size = [], 0
    yield from through(held)


def scan(self, words: list[bytes], hit: bytearray) -> set[int]:
        """Marks the hit words of a document; the items found."""
        nexts, link, length, reports, window = self.next, self.link, self.length, self.reports, self.window
        found: set[int] = set()
        state = run = 0
        for i, w in enumerate(words):
            to = nexts[state].get(w)
            if to is None:
                if not state:
                    continue
                while to is None and state:
                    state = link[state]
                    to = nexts[state].get(w)
                if to is None:
                    run = 0
                    continue
                run = length[state]
            state = to
            run += 1
            if reports[state]:
                if run >= window and self.found[state]:
                    # a state whose own runs include the window: shorter runs of it lie up the links
                    hit[i + 1 - window : i + 1] = b"\x01" * window
                    found |= self.found[state]
                for n, items in self.short[state]:
                    if run >= n:
                        hit[i + 1 - n : i + 1] = b"\x01" * n
                        found |= items
        return found


def automata(benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> list:
    """The items as broadcast lists that each fit into one automaton.

    The benchmark is the stated query set of the operator: it is read to the driver as a stream, one bounded list at a time,
    which is sent before the next is read.
    """
    send = benchmark.sparkSession.sparkContext.broadcast
    lists, items, room = [], [], most_words
    for r in pick(benchmark, item_id="long", text="string").orderBy("item_id", "text").toLocalIterator():
        words = words_of(r.text.encode() if r.text is not None else None)
        if not words or r.item_id is None:
            continue
        if len(words) > room and items:
            lists.append(send(items))
            items, room = [], most_words
        items.append((r.item_id, words))
        room -= len(words)
    return [*lists, send(items)] if items else lists


def spans_of(hit: bytes | bytearray) -> list[tuple[int, int]]:
    """(start, length) of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(hit) + b"\0", np.int8)))
    return [(int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]


def _built(items, window: int) -> Automaton:
    made = Automaton(items.value, window)
    items.__dict__.pop("_value", None)  # the automaton is enough; the worker reads the broadcast file again if it must
    return made


def _scanned(batches: Iterator[pa.RecordBatch], lists: list, token: str, window: int) -> Iterator[tuple[pa.RecordBatch, list[bytearray], list[set[int]]]]:
    """(slice, which words of each text are hit, items found in each).

    With one list of items its automaton is kept between tasks and slices are streamed. With several, a worker holds one automaton and
    ``HELD_BYTES`` of texts, which it runs through one automaton after the other.
    """

    def through(held: list[pa.RecordBatch]):
        out = [[(bytearray(len(words_of(t))), set()) for t in encoded(field(b, "text", pa.string()))] for b in held]
        for k, items in enumerate(lists):
            a = keep((token, k), lambda items=items: _built(items, window))
            for b, each in zip(held, out, strict=True):
                for t, (hit, found) in zip(encoded(field(b, "text", pa.string())), each, strict=True):
                    found |= a.scan(words_of(t), hit)
        for b, each in zip(held, out, strict=True):
            yield b, [hit for hit, _ in each], [found for _, found in each]

    held, size = [], 0
    for b in pieces(batches, most_bytes=2 << 20):
        held.append(b)
        size += field(b, "text", pa.string()).nbytes
        if len(lists) < 2 or size >= HELD_BYTES:
            yield from through(held)
            held, size = [], 0
    yield from through(held)


def _sent(spark: SparkSession, benchmark: DataFrame, window: int) -> tuple[list, str]:
    """The lists of items, each a broadcast of bounded size, and a name for them."""
    return [spark.sparkContext.broadcast(x) for x in automata(benchmark, window)], uuid.uuid4().hex


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted strings), spans (start, length).

    One pass over the documents for all automata: no shuffle, and the only thing sent to the executors is the items.
    """
    lists, token = automata(benchmark, window), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits, found in _scanned(batches, lists, token, window):
            spans = [spans_of(h) if f else [] for h, f in zip(hits, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(h) for h in hits], pa.int64()),
                    pa.array([sum(h) for h in hits], pa.int64()),
                    pa.array([sorted(map(str, f)) for f in found], pa.list_(pa.string())),
                    pa.array([[{"start": s, "length": n} for s, n in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,length:long>>"
    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)


def remove(text: str, spans: list[tuple[int, int]], least: int = SPAN_WORDS) -> str:
    """``text`` without the words of the spans of at least ``least`` words and what stands between those words."""
    found = [m.span() for m in re.finditer(r"(?:[A-Z]|[^\x00-\x2F\x3A-\x60\x7B-\x7F])+", text)]
    out, at = [], 0
    for start, length in spans:
        if length >= least:
            out.append(text[at : found[start][0]])
            at = found[start + length - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span_words: int = SPAN_WORDS, coverage: float = COVERAGE, whole: bool = False) -> DataFrame:
    """The rows of ``docs``, all their columns, whose share of hit words is at most ``coverage``, with spans of ``span_words`` or more removed
    from their texts. With ``whole``, a document that has such a span goes as a whole and no text is changed.

    Short items alone (below ``span_words`` words) thus cost a document nothing unless they cover much of it.
    """
    lists, token = automata(benchmark, window), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits, found in _scanned(batches, lists, token, window):
            kept, texts = [], {}
            for k, (h, f) in enumerate(zip(hits, found, strict=True)):
                spans = [x for x in spans_of(h) if x[1] >= span_words] if f else []
                kept.append(sum(h) <= coverage * len(h) and not (whole and spans))
                if kept[-1] and spans:
                    texts[k] = spans
            if texts:
                at = b.schema.get_field_index("text")
                new = [remove(t, texts[k], span_words) if k in texts else t for k, t in enumerate(b.column(at).to_pylist())]
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    s = scan(docs, benchmark, window)
    return s.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERY_SQL = r"""
WITH it AS (
  SELECT item_id, words, least({window}, len(words)) AS n FROM (
    SELECT item_id, regexp_extract_all({lower}, '{word}') AS words FROM benchmark WHERE item_id IS NOT NULL) WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS g FROM it, unnest(range(1, len(words) - n + 2)) t(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{word}') AS words FROM documents),
dg AS (
  SELECT r, n, i, array_to_string(words[i : i + n - 1], ' ') AS g
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM it))),
hits AS (SELECT r, i, dg.n, item_id FROM dg JOIN w ON dg.n = w.n AND dg.g = w.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN items ON d.r = items.r
""".replace("{lower}", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("{word}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").replace("{window}", str(WINDOW))
