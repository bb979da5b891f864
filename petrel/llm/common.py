"""Helpers shared by the operators of this subpackage: shared storage, words and hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..shipping import is_local, ship

#: Documents per Arrow batch that the Python stages cut their input into.
BATCH_ROWS = 1000
#: Rows and bytes of the Arrow batches that Spark sends: a row may hold two texts of hundreds of kilobytes.
SENT = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}
#: Words whose hashes one Python worker remembers before it starts anew.
VOCABULARY = 100_000


def prepare(spark: SparkSession) -> None:
    """Ships the package. Where the session has Spark's defaults, makes the Arrow batches smaller, as long texts need; the registered
    queries and the pipeline call this, the operators themselves leave the session's settings alone."""
    ship(spark)
    for setting, (default, ours) in SENT.items():
        if spark.conf.get(setting, default) == default:
            spark.conf.set(setting, ours)


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local a temporary folder is made and set; on a cluster this raises, as
    executors could not read what others wrote to folders of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="petrel-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/petrel/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = getattr(df, "_petrel_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and reread: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._petrel_path = path
    return out


def filesystem(uri: str):
    """(filesystem, path) of a URI, on the driver or on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"^[a-z0-9]+:", uri) else (fs.LocalFileSystem(), uri)


def publish(uri: str, write) -> None:
    """Calls ``write(stream)`` on a hidden file and then renames it to ``uri``.

    A task that is tried again or runs twice replaces the file by an equal one; no reader sees half a file.
    """
    system, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(hidden, compression=None) as out:
        write(out)
    system.move(hidden, path)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns cast to the given types; columns that ``df`` lacks are null, all others are left out."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def pick_with_row(df: DataFrame, **types: str) -> DataFrame:
    """``pick``, and the whole row of ``df`` in a struct ``row``, which no name in it can clash with."""
    from pyspark.sql import functions as F

    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    have = set(df.columns)
    return whole.select("row", *[(F.col(f"row.`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


# ---------------------------------------------------------------- texts in Arrow batches


def pieces(batches, rows: int = BATCH_ROWS, most_bytes: int = 4 << 20, text: str = "text"):
    """Arrow batches cut into slices of at most ``rows`` rows and about ``most_bytes`` bytes of text."""
    for batch in batches:
        at = 0
        sizes = np.asarray(pc.fill_null(pc.binary_length(field(batch, text, pa.string())), 0)) if len(batch) else []
        while at < len(batch):
            ends = np.cumsum(sizes[at : at + rows])
            n = max(1, int(np.searchsorted(ends, most_bytes, "right")))
            yield batch.slice(at, n)
            at += n
        del batch
    release()


def release() -> None:
    """Gives memory that the worker's allocators hold but do not use back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What a Python worker keeps between tasks: one thing at a time, by key.
_KEPT: dict = {}


def keep(key, make):
    """``make()``, or what an earlier task of this worker made under the same key. Asking for another key forgets the last."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Frees what an earlier task kept: a stage that keeps nothing must not carry the memory of the one before."""
    if _KEPT:
        _KEPT.clear()
        release()


def field(batch: pa.RecordBatch, name: str, kind: pa.DataType) -> pa.Array:
    """A column of a batch cast to a type; nulls if there is none."""
    at = batch.schema.get_field_index(name)
    return batch.column(at).cast(kind) if at >= 0 else pa.nulls(len(batch), kind)


def encoded(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each string of an Arrow array."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: A-Z to a-z, every other byte itself.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    return x ^ (x >> np.uint64(29))


#: Bytes whose words are hashed at once.
HASHED_BYTES = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _TABLES or len(_TABLES[0]) < n:
        n = max(n, HASHED_BYTES + (1 << 12))
        made = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        if n > 2 * HASHED_BYTES:  # for one very long word
            return made
        _TABLES[:] = made
    return _TABLES


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of some text: a polynomial of its bytes, found by differences of running sums."""
    x = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[x], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    power, inverse = _powers(len(x))
    sums = np.cumsum(power[: len(x)] * (x.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)
    whole = sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
    return mixed(whole * inverse[start] + (end - start).astype(np.uint64) * _MIX[0]), start


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in turn, words of each text). Works on bounded pieces of the texts, cut at white space."""
    hashes, counts, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            h, start = _hashed(b" ".join(held))
            ends = np.cumsum([len(t) + 1 for t in held])
            hashes.append(h)
            counts.append(np.diff(np.searchsorted(start, ends), prepend=0))
        held, size = [], 0

    for t in texts:
        t = t or b""
        if size + len(t) > HASHED_BYTES:
            flush()
        if len(t) <= HASHED_BYTES:
            held.append(t)
            size += len(t)
            continue
        at, n = 0, 0
        while at < len(t):
            end = at + HASHED_BYTES
            while end < len(t) and not _SPACE[t[end]]:
                end += 1
            h, _ = _hashed(t[at:end])
            hashes.append(h)
            n += len(h)
            at = end
        counts.append(np.array([n]))
    flush()
    return np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the concatenations of two equally long rows of hashed phrases."""
    return mixed(left * _MIX[0] + right * _MIX[1])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive words, built by doubling."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    power, out, width, rest = words, None, 1, n
    while rest:
        if rest & 1:
            out, have = (power, width) if out is None else (joined(out[: len(power) - have], power[have:][: len(out)]), have + width)
        rest >>= 1
        if rest:
            power = joined(power[: len(power) - width], power[width:])
            width *= 2
    return out[: len(words) - n + 1]
