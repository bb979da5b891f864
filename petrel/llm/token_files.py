"""Token ids of documents in binary files, each document compressed by itself under one shared zstandard dictionary.

File format (little-endian), one file per range of ids, ``tokens-00000.bin`` and so on in ascending order of doc_id:

    "PTOK0001"                 magic, 8 bytes
    dictionary id              32 bytes, SHA-256 of the dictionary (zeros: no dictionary)
    documents                  one zstandard frame each, of its ids as unsigned 32-bit integers
    index                      one frame of the rows (doc_id int64, null flag uint8, offset uint64, bytes uint32, ids uint32)
    footer                     offset of the index uint64, documents uint64, ids uint64, "PTOKEND1"

The dictionary lies beside them as ``<sha256>.dict``; it is trained on the serialized ids of a bounded sample, and a
reader refuses a file whose dictionary it does not have. A short document is read by one index lookup and one small
frame, without touching its neighbours.

Defined results: a null or empty text has only the end id; a null doc_id comes first; rows that share an id are kept,
each with its own entry, in the order of their texts (those whose texts also begin alike lie in one file); an empty table gives no file and an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, keep, pick, pieces, publish, release, scratch

MAGIC, END = b"PTOK0001", b"PTOKEND1"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
FOOTER = "<QQQ8s"
#: The dictionary is trained on about this many documents, chosen by a hash of their ids, and is of at most this size.
SAMPLE_DOCS, DICTIONARY_BYTES = 1500, 64 << 10
#: Bytes of text that one file takes, about. A small corpus has this many files of a megabyte or more.
FILE_BYTES, SMALL = 64 << 20, 12
#: Characters of a text that its range is found by, after the doc_id; rows are sorted by the whole text.
RANGE_CHARS = 64
LEVEL = 3
#: Words whose ids a Python worker remembers, about, and how many new ones are encoded together.
REMEMBERED, TOGETHER = 250_000, 2000
#: Bytes of text whose different words are found together, about, and texts whose ids are copied together.
WORDS_BYTES, TEXTS = 6 << 20, 500
#: Words that end in a letter of the Latin alphabets and one of these marks, which the tokenizer makes a piece of its own.
MARKS = ".,;:!?"
MARKED = rf"[A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}][{MARKS}]\z"
#: Words whose texts are encoded in one call: nothing (two spaces, or one at an end) or a line feed alone (one beside other white
#: space), any other white space (Python's notion is wider than the tokenizer's); the tokenizer's special tokens are added to these.
ODD = r"\A\n?\z|[\x{09}\x{0B}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _literal(text: str) -> str:
    """A pattern of RE2 that matches the text."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in text)


def _flags(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of ``n`` numbers each, in turn."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _cuts_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer is byte-level BPE that changes no text first and cuts it by that library's own pattern."""
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = spec["normalizer"] is None and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]


class Encoder:
    """Ids of whole texts by the tokenizers library, with a bounded memory of the chunks between white space.

    Byte-level BPE first cuts a text by a pattern none of whose pieces goes on from a word into the white space after it. So
    where every white-space character stands alone, the ids of a text are those of its chunks in turn, a chunk being a space or
    line feed and what follows up to the next one. New chunks are encoded many at once, run together; as every id stands for a
    known number of bytes, the ids of each are found by its length. Words and ids are held in arrays, no objects. Other texts, and those with a special token or with characters that
    Python alone takes for white space, are encoded in one call; so is every text where the tokenizer is not of that kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in spec["added_tokens"]]
        self.by_word = _cuts_at_white_space(spec) and not any(re.search(r"\s", t) for t in special)
        self.odd = "|".join([ODD, *map(_literal, special)])
        if not self.by_word:
            return
        sizes = [0] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            sizes[i] = len(token)  # byte-level tokens have a letter per byte
        self.sizes = np.array(sizes, np.int64)
        self.marks = np.concatenate([np.frombuffer(self._whole(m), "<u4") for m in MARKS])
        # the words known, how many ids each has, those in turn, and the last part of a text that had each
        self.known, self.size, self.ids = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, "<u4")
        self.part, self.used = 0, np.empty(0, np.int64)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, words: pa.Array, before: str) -> None:
        """Encodes new words, each after ``before``, many at once."""
        ids, size = [self.ids], [self.size]
        width = np.asarray(pc.binary_length(words)) + len(before)
        for at in range(0, len(words), TOGETHER):
            text = before + before.join(words.slice(at, TOGETHER).to_pylist())
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(width[at : at + TOGETHER])
            after = np.cumsum(self.sizes[got])
            cuts = np.searchsorted(after, ends)
            if len(got) == 0 or cuts[-1] != len(got) - 1 or (after[cuts] != ends).any():
                raise ValueError("the tokenizer does not cut at white space")
            ids.append(got)
            size.append(np.diff(cuts, prepend=-1))
        self.known = pa.concat_arrays([self.known, words])
        self.ids, self.size = np.concatenate(ids), np.concatenate(size)
        self.used = np.append(self.used, np.full(len(words), self.part))

    def _places_of(self, words: pa.Array) -> np.ndarray:
        """Where each of some different words is in ``known``; learns those that are not. Forgets what neither this part nor the last one had if there are many."""
        self.part += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        self.used[at[at >= 0]] = self.part
        if len(self.known) > REMEMBERED:
            stay = self.used >= self.part - 1
            moved = np.append(np.cumsum(stay) - 1, -1)
            self.ids = self.ids[np.repeat(stay, self.size)]
            self.known, self.size, self.used, at = self.known.filter(pa.array(stay)), self.size[stay], self.used[stay], moved[at]
        new = at < 0
        fed = new & _flags(words, r"\A\n")
        for which, before in ((new & ~fed, " "), (fed, "")):
            at[which] = np.arange(which.sum()) + len(self.known)
            self._learn(words.filter(pa.array(which)), before)
        return at

    def _values(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some different words: the ids of all in turn, how many each has, and which are those whose texts are encoded whole (they have none here)."""
        odd = _flags(words, self.odd)
        # a mark after a letter is a piece of its own, so such a word is its stem and the mark
        marked = _flags(words, MARKED) & ~odd
        plain = ~odd & ~marked
        ended = words.filter(pa.array(marked))
        stems = pa.concat_arrays([words.filter(pa.array(plain)), pc.utf8_slice_codeunits(ended, 0, -1)]).dictionary_encode()
        at = self._places_of(stems.dictionary)[np.asarray(stems.indices)]
        first, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts = np.cumsum(self.size) - self.size
        for which, found in ((plain, at[: plain.sum()]), (marked, at[plain.sum() :])):
            first[which], n[which] = starts[found], self.size[found]
        size = n + marked
        pool = np.empty(size.sum(), "<u4")
        ends = np.cumsum(size)
        pool[_places(ends - size, n)] = self.ids[_places(first, n)]
        mark = pc.index_in(pc.utf8_slice_codeunits(ended, -1), value_set=pa.array(list(MARKS), pa.large_string()))
        pool[ends[marked] - 1] = self.marks[mark.to_numpy()]
        return pool, size, odd

    def all(self, texts: pa.Array | list[str | None], end_id: int) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, the end id last.

        Texts are cut and their different words found in Arrow; the ids of all words are then copied from those of the different ones.
        """
        end = _packed([end_id])
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.by_word:
            return [self._whole(x.as_py() or "") + end for x in column]
        # a line feed before the first word, whose id is taken off again, makes a chunk of it too
        feed, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        cut = pc.split_pattern(pc.binary_join_element_wise(feed, pc.replace_substring(column, "\n", " \n"), nothing), " ")
        edges = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(cut), 0)))])
        words = cut.flatten()
        del cut
        words = words.dictionary_encode()
        code, words = words.indices, words.dictionary
        release()
        pool, size, odd = self._values(words)
        code = np.asarray(code)
        first = np.cumsum(size) - size
        del words
        out = []
        for low in range(0, len(column), TEXTS):
            words_at = edges[low : low + TEXTS + 1]
            of = code[words_at[0] : words_at[-1]]
            n = size[of]
            ends = np.cumsum(n)
            ids = pool[_places(first[of], n)]
            at = np.concatenate([[0], ends])[words_at - words_at[0]].tolist()
            out += [ids[a + 1 : b].tobytes() + end for a, b in zip(at[:-1], at[1:], strict=True)]
        whole = np.diff(np.concatenate([[0], np.cumsum(odd[code])])[edges]) > 0
        for k in np.flatnonzero(whole):
            out[k] = self._whole(column[int(k)].as_py()) + end
        return out

    def __call__(self, text: str | None, end_id: int) -> bytes:
        return self.all([text], end_id)[0]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``WORDS_BYTES``, of as many batches as that takes: the more text, the fewer different words in each part of it."""
    held, size = [], 0
    for b in pieces(batches, rows=1 << 20, most_bytes=WORDS_BYTES):
        held.append(b)
        size += b.column("text").nbytes
        if size >= WORDS_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encoder(path: str) -> Encoder:
    """The encoder of this process, which later tasks of a worker find warm."""
    return keep(("encoder", path), lambda: Encoder(path))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 0, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the ids of about ``sample_docs`` documents (b"" if they are too few to train on).

    The sample is bounded whatever the input: each document is in it by a hash of its id, at a rate that its count sets,
    and of a long one the first 64 KB of ids are used.
    """
    n = docs.count()
    if n == 0:
        return b""
    rate = min(1.0, sample_docs / n)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in pieces(batches):
            out = [x[: 64 << 10] for x in e.all(b.column("text"), end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    samples = sorted(bytes(r.ids) for r in chosen.mapInArrow(encode, "ids binary").limit(4 * sample_docs).collect())
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True).compress


def _decompressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d).decompress


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (doc_id, text) of ``docs`` to files in ``folder``; returns (file, first, docs, ids), a row per file.

    ``first`` counts the ids in all files before. The documents are dealt by range of doc_id and of how their texts begin, so the
    files follow each other and rows that share an id, or have none, need not lie in one; how many files there are depends on the
    corpus alone. A task writes one file as a stream and holds a few megabytes of text and the index at a time.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id="long", text="string")
    dictionary = train_dictionary(d, tokenizer, end_id)
    key = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    publish(f"{folder}/{key.hex()}.dict", lambda out: out.write(dictionary))
    total = d.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    files = max(1, -(-total // file_bytes), min(SMALL, total >> 20))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, rows, ids, encode, compress = f"tokens-{TaskContext.get().partitionId():05d}.bin", [], 0, encoder(tokenizer).all, _compressor(dictionary)
        batches = iter(batches)
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return

        def body(out) -> None:
            nonlocal ids
            at = out.write(MAGIC + key)
            for b in _merged(x for part in ([first], batches) for x in part):
                for doc, got in zip(b.column("doc_id").to_pylist(), encode(b.column("text"), end_id), strict=True):
                    frame = compress(got)
                    out.write(frame)
                    rows.append((doc or 0, doc is None, at, len(frame), len(got) // 4))
                    at += len(frame)
                    ids += len(got) // 4
            out.write(zstandard.ZstdCompressor().compress(np.array(rows, ENTRY).tobytes()))
            out.write(struct.pack(FOOTER, at, len(rows), ids, END))

        publish(f"{folder}/{name}", body)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([ids], pa.int64())], ["file", "docs", "ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = d.repartitionByRange(files, order[0], F.substring("text", 1, RANGE_CHARS).asc_nulls_first()).sortWithinPartitions(*order)
    made = sorted(dealt.mapInArrow(save, "file string, docs long, ids long").collect())
    rows, first = [], 0
    for r in made:  # one row per file, not per document
        rows.append((r.file, first, r.docs, r.ids))
        first += r.ids
    return spark.createDataFrame(rows, "file string, first long, docs long, ids long")


def _index(source, size: int) -> tuple[np.ndarray, bytes]:
    """(index, dictionary id) of an open file of ``size`` bytes."""
    source.seek(size - struct.calcsize(FOOTER))
    at, docs, _, end = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
    source.seek(0)
    head = source.read(len(MAGIC) + 32)
    if end != END or head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a complete token file")
    source.seek(at)
    index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(size - struct.calcsize(FOOTER) - at)), ENTRY)
    if len(index) != docs:
        raise ValueError("the index does not match the footer")
    return index, head[len(MAGIC) :]


def _dictionary(folder: str, key: bytes) -> bytes:
    system, path = filesystem(f"{folder}/{key.hex()}.dict")
    with system.open_input_stream(path, compression=None) as f:
        found = f.read()
    if hashlib.sha256(found).digest() != key and any(key):
        raise ValueError("the dictionary's hash differs from the file's")
    return found


def read_document(folder: str, file: str, doc_id: int) -> list[np.ndarray]:
    """Ids of each document ``doc_id`` of one file, by the index alone."""
    system, path = filesystem(f"{folder}/{file}")
    with system.open_input_file(path) as f:
        index, key = _index(f, f.size())
        decompress, out = _decompressor(_dictionary(folder, key)), []
        for e in index[(index["doc_id"] == doc_id) & (index["null"] == 0)]:
            f.seek(int(e["offset"]))
            out.append(np.frombuffer(decompress(f.read(int(e["bytes"]))), "<u4"))
    return out


def read(spark: SparkSession, folder: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` the ids themselves."""
    n = max(1, files.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Callable] = {}
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(f"{folder}/{row['file']}")
                with system.open_input_file(path) as f:
                    index, key = _index(f, f.size())
                    if key not in known:
                        known[key] = _decompressor(_dictionary(folder, key))
                    starts = row["first"] + np.cumsum(index["ids"], dtype=np.int64) - index["ids"]
                    f.seek(len(MAGIC) + 32)
                    for a in range(0, len(index), 1000):  # frames lie one after the other, so this reads on
                        part, raw = index[a : a + 1000], []
                        for e in part:
                            raw.append(known[key](f.read(int(e["bytes"]))))
                            if len(raw[-1]) != 4 * int(e["ids"]):
                                raise ValueError("a document's length differs from the index")
                        cols = [
                            pa.array(part["doc_id"], pa.int64(), mask=part["null"].astype(bool)),
                            pa.array(starts[a : a + 1000], pa.int64()),
                            pa.array(part["ids"].astype(np.int64)),
                            pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        ]
                        if with_ids:
                            cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in raw], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in schema.split(", ")])

    return files.select("file", "first").repartition(n).mapInArrow(load, schema)


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` and reads the digests of every document back from the files."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    return read(spark, folder, write(docs, folder, tokenizer))
