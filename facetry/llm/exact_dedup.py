"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each task sorts the fingerprints of its documents, cuts them at the owners' borders and sends each owner the Golomb-Rice
code of the gaps: about 64 - log2(n) + 2 bits for each distinct fingerprint.  The owner answers with a bitmap of those
that also came from elsewhere.  Only documents behind a set bit are suspects; their texts alone are shuffled, grouped by
their bytes.  What tasks have sent is a written table, so bitmaps keep meeting the rows they were made from when an
executor is lost.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, U, by_id, small, written

#: Documents of one chunk, the unit that is sent and answered.
CHUNK = 1 << 16
#: Distinct fingerprints that one owner is meant to hold.
OWNED = 1 << 19


def golomb(values: np.ndarray, span: int) -> bytes:
    """Golomb-Rice code of sorted distinct values below span (a power of two): a byte with the parameter, then gaps."""
    gaps = np.diff(np.concatenate(([U(0)], values.astype(U))))
    r = max(0, int(span).bit_length() - 1 - max(1, len(values)).bit_length())
    quotient, rest = (gaps >> U(r)).astype(np.int64), gaps & U((1 << r) - 1)
    length = quotient + 1 + r
    end = np.cumsum(length)
    bits = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    begin = end - length
    ones = np.repeat(begin, quotient) + (np.arange(int(quotient.sum())) - np.repeat(np.cumsum(quotient) - quotient, quotient))
    bits[ones] = 1  # quotient in unary, closed by a zero
    at = begin + quotient + 1
    for k in range(r):
        bits[at + k] = (rest >> U(r - 1 - k)) & U(1)
    return bytes([r]) + np.packbits(bits).tobytes()


def ungolomb(code: bytes, n: int) -> np.ndarray:
    """The n values of a code."""
    r = code[0]
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=1))
    zeros = np.flatnonzero(bits == 0)
    # the end of each unary part is the first zero at or after the begin; begins follow one another
    following = np.searchsorted(zeros, np.arange(len(bits) + 1)) if n else zeros
    stops, begins, at = np.empty(n, np.int64), np.empty(n, np.int64), 0
    stop_of = np.append(zeros, len(bits))[following].tolist() if n else []
    for k in range(n):
        begins[k] = at
        stops[k] = stop = stop_of[at]
        at = stop + 1 + r
    rest = np.zeros(n, U)
    for k in range(r):
        rest = (rest << U(1)) | bits[stops + 1 + k].astype(U)
    return np.cumsum(((stops - begins).astype(U) << U(r)) + rest, dtype=U)


def _send(owners_log2: int):
    """Rows (chunk, owner, n, code, repeated, at, ids, digests) of a task's documents, in chunks.

    For an owner: its n distinct fingerprints coded, a bitmap of those that several documents of the chunk have, and what
    stays with the sender: for each document the place of its fingerprint, its id and the SHA-256 of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, prints = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            h, doc = np.array(prints, U), np.array(ids, np.int64)
            digest = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
            chunk = uuid.uuid4().hex
            order = np.argsort(h, kind="stable")
            owner = (h[order] >> U(64 - owners_log2)).astype(np.int64) if owners_log2 else np.zeros(len(h), np.int64)
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(owner)) + 1):
                value, place, times = np.unique(h[part], return_inverse=True, return_counts=True)
                own = int(value[0] >> U(64 - owners_log2)) if owners_log2 else 0
                low = value & U((1 << (64 - owners_log2)) - 1)
                rows.append((chunk, own, len(value), golomb(low, 1 << (64 - owners_log2)), np.packbits(times > 1).tobytes(), place.astype("<i4").tobytes(), doc[part].astype("<i8").tobytes(), digest[part].tobytes()))
            ids.clear(), digests.clear(), prints.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 5))], names=["chunk", "owner", "n", "code", "repeated", "at", "ids", "digests"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_buffer().to_pybytes().lower() if t.is_valid else b""
                ids.append(i), prints.append(xxhash.xxh3_64_intdigest(text)), digests.append(hashlib.sha256(text).digest())
                if len(ids) >= CHUNK:
                    yield from flush()
        yield from flush()

    return run


def _answer(owners_log2: int):
    def run(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        """An owner's bitmaps: which of a chunk's fingerprints a second document has, in the chunk or in another."""
        values = [ungolomb(c, n) for c, n in zip(sent["code"], sent["n"])]
        every, times = np.unique(np.concatenate(values), return_counts=True)
        shared = times > 1
        maps = [np.packbits(shared[np.searchsorted(every, v)] | np.unpackbits(np.frombuffer(r, np.uint8), count=n).astype(bool)).tobytes() for v, r, n in zip(values, sent["repeated"], sent["n"])]
        return pd.DataFrame({"chunk": sent["chunk"], "owner": sent["owner"], "bitmap": maps})

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, suspect) of each document that was sent."""
    for b in batches:
        for n, at, ids, digests, bitmap in zip(*(b.column(k).to_pylist() for k in range(5))):
            place, doc = np.frombuffer(at, "<i4"), np.frombuffer(ids, "<i8")
            suspect = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)[place]
            for k in range(0, len(doc), 8192):
                part = slice(k, k + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.Array.from_buffers(pa.binary(32), len(doc[part]), [None, pa.py_buffer(digests[k * 32 : (k + 8192) * 32])]).cast(pa.binary()), pa.array(suspect[part])], names=["doc_id", "digest", "suspect"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners_log2: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of `docs`, extra columns are ignored.

    Texts are equal if their bytes are, after lower-casing A-Z; null counts as empty.  Of a group the row with the
    largest id stays.  Rows that repeat an id count each, and are kept or dropped together (a table in which they
    must not be is told apart by ids of its own).  Ids are whole numbers or text of such; anything else is an error.  Null
    ids order lowest and count as the smallest long.  An empty table gives no rows; a text of any length is one value.

    A text that a third of all documents share is one fingerprint of each chunk and one row of each task's partial
    grouping."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.expr("-9223372036854775808L")).alias("doc_id"), F.col(text_col).alias("text"))
    if owners_log2 is None:
        owners_log2 = max(0, (base.count() // OWNED).bit_length())
    sent = written(base.mapInArrow(_send(owners_log2), "chunk string, owner int, n int, code binary, repeated binary, at binary, ids binary, digests binary"), "sent")
    bitmaps = sent.select("chunk", "owner", "n", "code", "repeated").groupBy("owner").applyInPandas(_answer(owners_log2), "chunk string, owner int, bitmap binary")
    met = sent.select("chunk", "owner", "n", "at", "ids", "digests").join(bitmaps, ["chunk", "owner"])
    marked = written(met.select("n", "at", "ids", "digests", "bitmap").mapInArrow(_unpack, "doc_id long, digest binary, suspect boolean"), "marked")
    suspects = small(marked.where("suspect").select("doc_id").distinct(), 16)
    texts = base.join(suspects, "doc_id", "left_semi").select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("norm"))
    groups = texts.groupBy("norm").agg(F.count("*").alias("size"), F.max("doc_id").alias("last")).where("size > 1")
    # a group is named by the SHA-256 of its bytes, so the way back to its documents carries no text
    named = written(groups.select(F.unhex(F.sha2("norm", 256)).alias("of"), "size", "last"), "groups")
    out = marked.join(small(named, 64), F.col("digest") == F.col("of"), "left")
    keep = F.coalesce("last", "doc_id")
    real = lambda c: F.when(c != F.expr("-9223372036854775808L"), c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), real(keep).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), (F.col("doc_id") == keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
