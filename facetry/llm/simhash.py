"""SimHash near-duplicate groups over an inverted index of fingerprint bytes with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so at least 5 positions hold
equal bytes.  The index has a posting list for each value of four given byte positions; the 14 sets of positions are the
blocks of the Steiner system S(3, 4, 8), which has, for any three positions, a block that avoids all of them.  So each
pair within reach shares a list.

A list that is too long for a task is split before it is shuffled: what its members do not share yet is cut into four
pieces (at first the other four bytes), of which two members within reach share at least one, so a posting under each
piece loses no pair.  Splitting goes on while lists are long; a list with few open bits cannot be, as it holds distinct
fingerprints.  Within a list, shared positional bytes are tallied for each pair, pairs with fewer than the guaranteed
five are dropped and the rest verified by counting bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, blocks, small, written, xxh64
from .components import components

SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
MOST_BITS = 3
#: Positions that two linked fingerprints share at least.
LEAST_BYTES = 8 - MOST_BITS
#: The longest list that is compared pair by pair; a power of two.
LONG = 1 << 11
#: Postings that are compared at once in a task.
HELD = 1 << 16


def blocks_of_four() -> list[tuple[int, ...]]:
    """The 14 blocks of S(3, 4, 8): sets of four 3-bit positions whose exclusive or is zero."""
    return [(a, b, c, a ^ b ^ c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8) if c < a ^ b ^ c]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(positions: tuple[int, ...]) -> int:
    return signed(sum(0xFF << (8 * p) for p in positions))


def pieces_of(mask: int) -> list[int]:
    """A mask widened by each of four pieces of the bits that it leaves open."""
    own = mask % (1 << 64)
    free = [b for b in range(64) if not own >> b & 1]
    return [signed(own | sum(1 << int(b) for b in part)) for part in np.array_split(free, MOST_BITS + 1) if len(part)]


# --- fingerprints


#: Bytes of a text whose words are objects at once.
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists that follow pieces of bounded size (or one word)."""
    at, n = 0, len(text)
    while at < n:
        end = at + PIECE
        if end < n and (rest := _SPACE.search(text, end)):
            end = rest.start()
        elif end < n:
            end = n
        yield text[at:end].lower().split()  # bytes: A-Z and ASCII white space only
        at = end


def tally(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of one word or more, with one space between words: how many shingles of k words each has (one, if it has
    fewer words), and how many of their hashes have each bit."""
    buf = np.frombuffer(b"\n".join(texts) + bytes(9), np.uint8)
    cut = np.flatnonzero((buf[:-9] == 32) | (buf[:-9] == 10))
    start, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(buf) - 9]))
    n = np.array([t.count(b" ") + 1 for t in texts])
    total = np.maximum(1, n - k + 1)
    begin = np.concatenate(([0], np.cumsum(total)))
    first = np.arange(begin[-1]) + np.repeat(np.cumsum(n) - n - begin[:-1], total)
    last = first + np.repeat(np.minimum(n, k) - 1, total)
    h = xxh64(buf, start[first], end[last] - start[first], SEED)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # counters of a byte, eight to a number, for up to 255 shingles; then those of a text
    parts = -(-total // 255)
    edge = np.cumsum(parts) - parts
    at = np.repeat(begin[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(edge, parts))
    bytewise = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8)
    return total, np.add.reduceat(bytewise, edge, axis=0, dtype=np.int32)


def _majority(total, ones: np.ndarray) -> np.ndarray:
    return np.packbits(2 * ones.astype(np.int64) > total, axis=-1, bitorder="little").view("<u8")[..., 0]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text (see near_duplicates), of any length; unsigned."""
    total, ones, held = 0, np.zeros(64, np.int64), []
    for words in _pieces(text):
        parts = held + words
        if len(parts) < shingle:
            held = parts
            continue
        n, own = tally([b" ".join(parts)], shingle)
        total, ones = total + int(n[0]), ones + own[0]
        held = parts[len(parts) - shingle + 1 :]
    if not total and held:  # fewer words than a shingle has
        n, own = tally([b" ".join(held)], shingle)
        total, ones = int(n[0]), own[0]
    return int(_majority(max(1, total), ones))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.zeros(b.num_rows, U)
        for row, buf, offsets in blocks(b.column(1)):
            if len(buf) > PIECE:
                for i in range(len(offsets) - 1):
                    fp[row + i] = fingerprint(buf[offsets[i] : offsets[i + 1]].tobytes())
                continue
            raw = buf.tobytes().lower()
            texts = [b" ".join(raw[i:j].split()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            some = [i for i, t in enumerate(texts) if t]
            if some:
                total, ones = tally([texts[i] for i in some], 3)
                fp[row + np.array(some)] = _majority(total[:, None], ones)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


# --- the index


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """At how many of the eight positions two fingerprints hold the same byte, from their exclusive or."""
    x = x | (x >> U(4))
    x |= x >> U(2)
    x |= x >> U(1)
    return 8 - np.bitwise_count(x & U(0x0101010101010101))


def _pairs(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs pass the count filter and then the check of their bits."""
    x = fp[i] ^ fp[j]
    ok = shared_bytes(x) >= LEAST_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= MOST_BITS
    return ok


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Adds links to labels: each label becomes the smallest index that its set holds."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def linked(fp: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) within consecutive lists of the given lengths, a spanning forest of all that there are.  Every
    pair of a list is compared unless its two ends are joined already."""
    start = np.cumsum(length) - length
    size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    found = []
    for k in np.unique(size[length > 1]):  # lists of like lengths go together
        own = np.flatnonzero((size == k) & (length > 1))
        n = length[own]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(start[own], n) + place
        left, f, root = np.repeat(n, n) - place, fp[at], np.arange(len(at))
        i, lag = np.arange(len(at)), 0
        while len(i):
            lag += 1
            i = i[left[i] > lag]
            a = i[root[i] != root[i + lag]]
            ok = _pairs(f, a, a + lag)
            if ok.any():
                _roots(root, a[ok], a[ok] + lag)
        low = np.flatnonzero(root != np.arange(len(root)))
        found.append((at[low], at[root[low]]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the posting lists (mask, key, fp) of a partition that is sorted by list."""

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        mask, key, fp = cols
        edge = np.concatenate(([0], np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1, [len(fp)]))
        a, b = linked(fp.view(U), np.diff(edge))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([np.asarray(b.column(i)) for i in range(3)])
        rows += b.num_rows
        if rows < HELD:
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        # the last list may go on in the next batch
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held, rows = [[c[cut:] for c in cols]], rows - cut
        if cut:
            yield out([c[:cut] for c in cols])
    if rows:
        yield out([np.concatenate(x) for x in zip(*held)])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each posting (mask, key, fp) under the four wider masks."""
    for b in batches:
        mask, fp = np.asarray(b.column(0)), np.asarray(b.column(2))
        for m in np.unique(mask):
            own = fp[mask == m]
            for wide in pieces_of(int(m)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), wide, np.int64)), pa.array(own & np.int64(wide)), pa.array(own)], names=["mask", "key", "fp"])


def postings(classes: DataFrame) -> DataFrame:
    """(mask, key, fp) of the distinct fingerprints `fp`; no list is longer than LONG."""
    entries = F.array(*(F.struct(F.lit(mask_of(b)).alias("mask"), F.col("fp").bitwiseAND(F.lit(mask_of(b))).alias("key")) for b in blocks_of_four()))
    open_ = classes.select(F.explode(entries).alias("e"), "fp").select("e.mask", "e.key", "fp")
    done = None
    while True:
        long = written(open_.groupBy("mask", "key").count().where(F.col("count") > LONG).select(F.col("mask").alias("m"), F.col("key").alias("k")), "long-lists")
        if long.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        on = (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k"))
        short = open_.join(small(long, 16), on, "left_anti")
        done = short if done is None else done.unionByName(short)
        open_ = written(open_.join(small(long, 16), on, "left_semi").mapInArrow(_split, "mask long, key long, fp long"), "split-lists")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, component): one row per row of `docs`; columns in `carry` come along, others are
    ignored.

    Texts are lower-cased in A-Z; words are runs of anything but ASCII white space; a text of fewer than three words is
    one shingle, one without words (empty, null) has fingerprint 0 and links like any other.  component_id is the
    smallest id that a chain of links reaches, whatever the ids on the way; component, the smallest fingerprint (as a
    signed number), tells groups apart; ids keep their type.  Rows with a null id link like others, and component_id is null only if no row
    of the group has an id.  Repeated rows are equal fingerprints.  Texts of any length
    are read whole, of which long ones a piece at a time.  An empty table gives no rows.

    Copies meet in one group by fingerprint before the index, so a hot text is one entry; each list holds distinct
    fingerprints only and gives at most a spanning forest."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in carry))
    kinds = "".join(f", {c} {base.schema[c].dataType.simpleString()}" for c in carry)
    kind = base.schema["doc_id"].dataType.simpleString()
    prints = written(base.mapInArrow(_fingerprints, f"doc_id {kind}, fp long{kinds}"), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = postings(classes).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_links, "a long, b long")
    met = written(components(links).join(classes, F.col("node") == F.col("fp")).select("node", "root", "rep"), "members")
    low = met.groupBy("root").agg(F.min("rep").alias("low")).select(F.col("root").alias("of"), "low")
    groups = met.join(low, F.col("root") == F.col("of")).select("node", "root", "low")
    named = classes.join(groups, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("own"), F.coalesce("root", "fp").alias("component"), F.coalesce("low", "rep").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("own")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", *carry)
