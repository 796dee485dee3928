"""What the operators of this subpackage share: scratch tables, size-checked broadcasts and vectorised word hashing.

Texts reach Python as Arrow string columns.  They are never turned into per-word Python objects on a hot path: words are
found with a byte table and hashed with a prefix sum over the raw UTF-8 buffer, so the work per byte is a few numpy passes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; callers pass the bytes of one row.  Beyond BROADCAST_BYTES joins shuffle.
BROADCAST_BYTES = 24 << 20
#: Text bytes that are worked on at once in a task.
BLOCK_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\t\n\x0b\x0c\r "
U = np.uint64


#: Rows and bytes of an Arrow batch at most: texts are long, and a batch is held several times on its way.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


#: Python workers live long and are several to an executor: what they free goes back to the system.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}


def ready(spark: SparkSession) -> None:
    """Bounds Arrow batches for the rest of the session (plans are lazy, so the bound has to outlast the call), and lets
    Python workers on this machine import the package when it is not installed (a cluster ships it with --py-files)."""
    for name, most in BATCH.items():
        now = str(spark.conf.get(name)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for name, value in WORKERS.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Folders of applications that have none set, by application.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session, `spark.checkpoint.dir`; only where that is not set (tests, one machine) a
    temporary folder of our own, which executors on other machines would not see: there that is an error."""
    context = spark.sparkContext
    own = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="facetry-")
    return _OWN[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later jobs read it, a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/facetry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, more: str = "0") -> DataFrame:
    """Marks a written table for broadcast if its rows fit in BROADCAST_BYTES; otherwise the join shuffles.

    row_bytes: of the fixed part of a row; more: an expression for the bytes of the rest."""
    size = df.agg(F.sum(F.expr(f"{row_bytes} + {more}"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fold(text):
    """A string column with A-Z lower-cased and nothing else changed.  `lower` does that, fast, for ASCII strings only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def by_id(left: DataFrame, right: DataFrame, on: str = "doc_id", how: str = "left") -> DataFrame:
    """Equi-join on one column where null meets null; keeps the left column only."""
    return left.join(right.withColumnRenamed(on, "__on"), F.col(on).eqNullSafe(F.col("__on")), how).drop("__on")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- hashing --------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finalizer, elementwise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_table(word: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit values of the bytes that make up words, 0 for separators; fold: A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    if fold:
        values[65:91] = values[97:123]
    return np.where(word, values, U(0))


_BYTES = np.arange(256)
#: Words of everything but ASCII white space; words of ASCII letters, digits and all beyond ASCII.
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
BASE, STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93)


#: Fixed values of XXH64.
_X1, _X2, _X3, _X4, _X5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many pieces of a buffer at once, unsigned.  The buffer has at least 8 bytes behind the last piece."""
    lanes = np.ndarray((max(0, len(buf) - 7),), np.dtype("<u8"), buf.data, strides=(1,))
    at, left = start.astype(np.int64), length.astype(np.int64)
    h = np.full(len(at), U(seed) + _X5, U)
    long = np.flatnonzero(left >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            v = [np.full(len(long), x, U) for x in (U(seed) + _X1 + _X2, U(seed) + _X2, U(seed), U(seed) - _X1)]
        places, stripes = at[long], left[long] // 32
        live = np.arange(len(long))
        for k in range(int(stripes.max())):
            live = live[stripes[live] > k]
            for j in range(4):
                v[j][live] = _turned(v[j][live] + lanes[places[live] + 32 * k + 8 * j] * _X2, 31) * _X1
        own = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
        for x in v:
            own = (own ^ (_turned(x * _X2, 31) * _X1)) * _X1 + _X4
        h[long] = own
        at[long] += 32 * stripes
        left[long] -= 32 * stripes
    h += length.astype(U)
    for k in range(3):
        some = np.flatnonzero(left >= 8 * (k + 1))
        if len(some):
            h[some] = _turned(h[some] ^ (_turned(lanes[at[some] + 8 * k] * _X2, 31) * _X1), 27) * _X1 + _X4
    at += left & ~7
    left &= 7
    tail = lanes[at] if len(at) else np.zeros(0, U)
    some = np.flatnonzero(left >= 4)
    if len(some):
        h[some] = _turned(h[some] ^ ((tail[some] & U(0xFFFFFFFF)) * _X1), 23) * _X2 + _X3
        tail[some] >>= U(32)
    left &= 3
    for k in range(3):
        some = np.flatnonzero(left > k)
        if len(some):
            h[some] = _turned(h[some] ^ (((tail[some] >> U(8 * k)) & U(0xFF)) * _X5), 11) * _X1
    h ^= h >> U(33)
    h *= _X2
    h ^= h >> U(29)
    h *= _X3
    h ^= h >> U(32)
    return h


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = U(base), U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(n + n // 2, base, dtype=U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = Powers(int(BASE)), Powers(int(STEP))


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets of its rows) of consecutive rows of about `size` bytes, at least one row each."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, n)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _cut(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(begin of a piece, values of its bytes, starts and ends of its words).

    A very long row is worked on in pieces that end at separators, so memory follows the piece and not the row."""
    a, n = 0, len(buf)
    first = np.zeros(0, np.int64) if n == 0 else offsets[:-1][offsets[:-1] < n]
    while a < n:
        b = min(n, a + 4 * BLOCK_BYTES)
        while b < n and table[buf[b]] != 0 and not (b in first):
            gap = np.flatnonzero(table[buf[b : b + 65536]] == 0)
            b = b + int(gap[0]) if len(gap) else min(n, b + 65536)
        values = table[buf[a:b]]
        member = values != 0
        edge = np.zeros(b - a + 1, bool)
        edge[first[(first >= a) & (first < b)] - a] = True
        begins = member.copy()
        begins[1:] &= ~member[:-1] | edge[1:-1]
        ends = member.copy()
        ends[:-1] &= ~member[1:] | edge[1:-1]
        yield a, values, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        a = b


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of each word of a block; start and end are byte positions in the block.

    The hash is a polynomial: good for features and for tests without false negatives, but long words made to collide do."""
    parts = []
    for a, values, s, e in _cut(buf, offsets, table):
        up, down = _BYTE_POWERS.of(len(values) + 1)
        total = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=total[1:])
        parts.append((s + a, e + a, mix((total[e] - total[s]) * down[s])))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    s, e, h = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts))
    return s, e, np.searchsorted(offsets, s, side="right") - 1, h


def bounds(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word of a block."""
    parts = [(s + a, e + a) for a, _, s, e in _cut(buf, offsets, table)]
    s, e = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    return s, e, np.searchsorted(offsets, s, side="right") - 1


#: Bytes of a word from which it is hashed on its own.
ALONE = 256


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each word of a block, of any length."""
    length = end - start
    out, short = np.empty(len(start), U), length < ALONE
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    out[short] = xxh64(padded, start[short], length[short], seed)
    for k in np.flatnonzero(~short).tolist():
        out[k] = xxhash.xxh64_intdigest(buf[start[k] : end[k]].tobytes(), seed)
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values (len(h) - k + 1 of them); callers mask those that cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _WORD_POWERS.of(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers | None = None) -> np.ndarray:
    """Hashes of the runs h[start:end], each of any length; other powers, other hashes."""
    up, down = (powers or _WORD_POWERS).of(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def counts_by(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)
