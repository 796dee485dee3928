"""Substring deduplication with compressed FM-indexes.

A window is `window` consecutive words.  Each window is led by its anchor, the smallest hash among its word runs of
GRAM words (the leftmost if tied); the windows of a document that follow one another under the same anchor are a
segment.  Equal windows have equal anchors, so they lie in segments that share one, and no window lies in two segments:
anchors that occur once in the corpus are out, and a shard that gets all segments of its anchors can count windows
exactly.  Equal segments are one entry with a weight.

Hashes only bring together what may be equal: words are hashed by XXH64, classes of segments named by 192 bits, and a
shard numbers its words by their bytes (a long word's SHA-256 stands for them), so different words never count as one.

Each shard builds an FM-index of its segments (Burrows-Wheeler transform in a wavelet matrix whose bit vectors are coded
block by block, with rank counts) and streams the segments backwards through it.  The matching statistics, how far a match with a second occurrence reaches
to the left of each word, are followed up to the window's length; intervals above the threshold are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Powers, U, blocks, bounds, by_id, byte_table, grams, mix, small, spans, word_hashes, written

GRAM = 12
#: Distinct segments that a shard is meant to hold; an anchor with more than CROWDED is dealt out window by window.
SHARD, CROWDED = 12_000, 4_096
_TABLE = byte_table(NOT_SPACE, fold=False)
#: A second family of hashes for runs of words.
_MORE, _OTHER = U(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB)
#: Bytes of a word from which its digest is sent in its place; what is sent is longer, so it is never mistaken for a word.
LONG_WORD = 64


def segments(h: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each segment of a block's words; window numbers are places in the block."""
    wide = window - gram + 1
    x = grams(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, length = np.arange(len(x)), 1  # at[i]: the leftmost smallest of x[i : i + length]
    while length < wide:
        step = min(length, wide - length)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        length += step
    ok = row[:n] == row[window - 1 :]
    edge = np.flatnonzero(np.concatenate(([True], (at[1:n] != at[: n - 1]) | (row[1:n] != row[: n - 1]) | ~ok[: n - 1])))
    count = np.diff(np.concatenate((edge, [n])))
    # windows that cross rows are dropped: within a piece they follow the valid ones
    valid = np.add.reduceat(ok, edge, dtype=np.int64) if len(edge) else np.zeros(0, np.int64)
    keep = ok[edge]
    return x[at[edge[keep]]], edge[keep], np.minimum(valid, count)[keep]


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row0, buf, offsets in blocks(b.column(1)):
                s, e, row = bounds(buf, offsets, _TABLE)
                h = word_hashes(buf, s, e)
                anchor, first, n = segments(h, row, window, gram)
                last = first + n + window - 1
                seg, more = spans(h, first, last), spans(mix(h ^ _MORE), first, last, _OTHER)
                begin = np.searchsorted(row, row[first]) if len(first) else first
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row0 + row[first])), *(pa.array(x.view(np.int64)) for x in (anchor, seg, more)), pa.array((first - begin).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "anchor", "seg", "more", "start", "n"])

    return run


def _sent(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\x00" + hashlib.sha256(word).hexdigest().encode()


def _texts(window: int):
    """The words of chosen segments: a row (anchor, seg, more, times, crowded, place, content) for each; crowded ones window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, chosen in zip(b.column(0), b.column(1).to_pylist()):
                raw = t.as_buffer().to_pybytes()
                begin, end, _ = bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _TABLE)
                for x in chosen:
                    n = x["n"]
                    own = slice(x["start"], x["start"] + n + window - 1)
                    parts = [_sent(raw[i:j]) for i, j in zip(begin[own].tolist(), end[own].tolist())]
                    name = x["anchor"], x["seg"], x["more"], x["times"]
                    if x["crowded"]:
                        out += [(*name, True, k, b" ".join(parts[k : k + window])) for k in range(n)]
                    else:
                        out.append((*name, False, 0, b" ".join(parts)))
                    if len(out) >= 8192:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["anchor", "seg", "more", "times", "crowded", "place", "content"])


# --- the index ---------------------------------------------------------------------------------------------------------


class BitVector:
    """Bits with rank counts, coded in blocks of 64: each distinct block is stored once, and blocks hold its number.  The
    bits of a transform whose texts repeat are mostly blocks of equal bits, so there are few distinct ones."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
        padded[: len(bit)] = bit
        packed = np.packbits(padded, bitorder="little").view("<u8")
        self.blocks, code = np.unique(packed, return_inverse=True)
        self.code = code.astype(np.uint16 if len(self.blocks) <= 1 << 16 else np.uint32)
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        block = at >> 6
        return self.ranks[block] + np.bitwise_count(self.blocks[self.code[block]] & ((U(1) << (at & 63).astype(U)) - U(1)))


class WaveletMatrix:
    """Bits of a sequence, level by level from the highest."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.n, self.bits, self.zeros = len(values), [], []
        v = values
        for level in range(self.levels - 1, -1, -1):
            bit = (v >> level) & 1
            self.bits.append(BitVector(bit))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each position ends up after the levels of a symbol's bits: start of the symbol plus its rank there."""
        for k in range(self.levels):
            ones = self.bits[k].ones(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over texts of symbols from 1 on, each closed by 0."""

    def __init__(self, texts: np.ndarray, symbols: int, longest: int, weights: np.ndarray):
        """texts: all texts one after another; weights: what each place counts as an occurrence."""
        n = len(texts)
        order, rank = None, texts.astype(np.int64)
        length = 1
        while True:  # prefix doubling, far enough for the longest text
            later = np.concatenate((rank[length:], np.zeros(min(length, n), np.int64))) if order is not None else None
            key = rank if later is None else rank * (n + 1) + later
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([1], 1 + np.cumsum(np.diff(key[order]) != 0)))
            if later is not None:
                length *= 2
            rank = new
            if length >= longest or new[order[-1]] == n:
                break
        bwt = texts[order - 1]
        self.matrix = WaveletMatrix(bwt.astype(np.int32), symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=symbols)))).astype(np.int64)
        every = np.arange(symbols)
        self.begin = self.matrix.down(every, np.zeros(symbols, np.int64))
        self.weight = np.concatenate(([0], np.cumsum(weights[order])))
        self.n = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with a symbol put before them."""
        both = self.matrix.down(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = self.before[symbol] - self.begin[symbol]
        k = len(symbol)
        return both[:k] + base, both[k:] + base

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]

    def reach(self, texts: np.ndarray, last: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Matching statistics: how many words up to place `last` occur, counted by weight, at least twice; up to `most`."""
        m = len(last)
        out, live = np.zeros(m, np.int64), np.arange(m)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        depth = 0
        while len(live):
            low, high = self.step(texts[last[live] - depth], low, high)
            depth += 1
            ok = self.count(low, high) >= 2
            out[live[ok]] = depth
            ok &= most[live] > depth
            live, low, high = live[ok], low[ok], high[ok]
        return out


def repeated(contents: list[bytes], times: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice among all (a segment counts `times`)."""
    n = np.array([c.count(b" ") + 1 for c in contents])
    row = np.repeat(np.arange(len(contents)), n)
    numbered = pa.array(b" ".join(contents).split(b" "), pa.binary()).dictionary_encode()  # words by their bytes
    known, symbol = numbered.dictionary, np.asarray(numbered.indices).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n + 1)))
    texts = np.zeros(int(begin[-1]), np.int64)
    place = np.arange(len(symbol)) + row  # one separator behind each segment
    texts[place] = symbol + 1
    weights = np.zeros(len(texts), np.int64)
    weights[place] = times[row]
    index = FMIndex(texts, len(known) + 1, int(n.max()) + 1, weights)
    first, windows = begin[:-1], np.maximum(0, n - window + 1)
    # whole segments first: one search settles all their windows
    whole = index.reach(texts, first + n - 1, n) == n
    flags, place = np.repeat(whole, windows), np.cumsum(windows) - windows
    # then the rest, from left to right: a word's match is longer than the one before it by one word at most, so where it
    # falls short of a window by k words, the next k - 1 windows are not repeated either
    live = np.flatnonzero(~whole & (windows > 0))
    end = np.full(len(live), window - 1)
    while len(live):
        short = window - index.reach(texts, first[live] + end, np.full(len(live), window))
        flags[place[live] + end - window + 1] = short == 0
        end += np.maximum(1, short)
        more = end < n[live]
        live, end = live[more], end[more]
    return np.split(flags, np.cumsum(windows)[:-1])


def _runs(flags: np.ndarray) -> list[int]:
    """Runs of set flags, each as one number: its begin in the upper 32 bits, its end in the lower."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return ((edge[::2] << 32) | edge[1::2]).tolist()


def _indexed(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flags = repeated(list(rows["content"]), rows["times"].to_numpy(np.int64), window)
        found = [_runs(f) for f in flags]
        some = [bool(f) for f in found]
        return rows.loc[some, ["anchor", "seg", "more", "crowded"]].assign(runs=[f for f in found if f])

    return run


#: Bytes of a text whose words may all be objects at once.
LONG = 1 << 20


def _kept(raw: bytes, runs: list[int], window: int) -> tuple[bytes, int, int]:
    """The words outside the runs of windows joined by spaces, how many words there are and how many stay."""
    begin, end, _ = bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _TABLE)
    keep = np.ones(len(begin), bool)
    for r in runs:
        keep[r >> 32 : (r & 0xFFFFFFFF) + window - 1] = False
    a, b = begin[keep], end[keep]
    step = 1 << 16
    return b" ".join(b" ".join([raw[i:j] for i, j in zip(a[k : k + step].tolist(), b[k : k + step].tolist())]) for k in range(0, len(a), step)), len(begin), len(a)


def _removed(window: int):
    """(doc_id, text, n_words, n_removed) with the words outside the runs of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts, total, gone = [], [], []
                for t, runs in zip(part.column(1), part.column(2).to_pylist()):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    if runs or len(raw) > LONG:
                        kept, n, left = _kept(raw, runs or [], window)
                    else:
                        own = raw.split()
                        kept, n, left = b" ".join(own), len(own), len(own)
                    total.append(n), gone.append(n - left), texts.append(kept)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def repeated_runs(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """(doc_id, runs) of `docs` (doc_id names a row, text): runs of the windows of each document that occur elsewhere (see _runs)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = written(docs.mapInArrow(_anchors(window, gram), f"doc_id {kind}, anchor long, seg long, more long, start int, n int"), "segments")
    twice = written(marks.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("of")), "anchors")
    met = written(marks.join(twice, F.col("anchor") == F.col("of"), "left_semi"), "met")
    classes = met.groupBy("anchor", "seg", "more").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "start", "n")).alias("at"))
    classes = written(classes.select("anchor", "seg", "more", "times", "at.doc_id", "at.start", "at.n"), "classes")
    # anchors before very many different words: their segments are dealt out by window
    crowded = written(classes.groupBy("anchor").count().where(F.col("count") > CROWDED).select(F.col("anchor").alias("of"), F.lit(True).alias("crowded")), "crowded")
    named = classes.join(small(crowded, 24), F.col("anchor") == F.col("of"), "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    chosen = written(named.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "seg", "more", "times", "start", "n", "crowded")).alias("chosen")), "chosen")
    total = classes.count()
    texts = by_id(docs.select("doc_id", "text"), chosen, how="inner").select("text", "chosen").mapInArrow(_texts(window), "anchor long, seg long, more long, times long, crowded boolean, place int, content binary")
    texts = written(texts, "contents")
    shards = max(1, -(-total // SHARD))
    names = ("anchor", "seg", "more")
    plain = texts.where("not crowded").select(*names, "crowded", "times", "content", F.pmod("anchor", F.lit(shards)).alias("shard"))
    # a crowded anchor's windows: equal ones, which share the anchor and 128 bits more, are summed on the way
    units = (F.xxhash64("content").alias("seg"), F.xxhash64(F.lit(1), "content").alias("more"))
    apart = texts.where("crowded").select("anchor", F.struct("seg", "more").alias("of"), "place", *units, "times", "content")
    dealt = apart.groupBy(*names).agg(F.sum("times").alias("times"), F.first("content").alias("content"))
    dealt = dealt.select(*names, F.lit(True).alias("crowded"), "times", "content", F.pmod("seg", F.lit(shards)).alias("shard"))
    found = written(plain.unionByName(dealt).groupBy("shard").applyInPandas(_indexed(window), "anchor long, seg long, more long, crowded boolean, runs array<bigint>"), "found")
    other = lambda df: df.withColumnsRenamed({n: f"{n}_2" for n in names})
    same = lambda: (F.col("anchor") == F.col("anchor_2")) & (F.col("seg") == F.col("seg_2")) & (F.col("more") == F.col("more_2"))
    hit = other(found.where("crowded").select(*names))
    back = apart.select(*names, "of", "place").join(small(hit, 32), same()).groupBy("anchor", "of").agg(F.collect_set("place").alias("p"))
    back = back.select("anchor", "of.seg", "of.more", F.transform("p", lambda p: F.shiftleft(p.cast("long"), 32) + p + 1).alias("runs"))
    runs = other(written(found.where("not crowded").drop("crowded").unionByName(back), "runs"))
    hits = met.join(runs, same())
    start = F.col("start").cast("long")
    return hits.select("doc_id", F.explode("runs").alias("r"), "start").select("doc_id", (F.col("r") + F.shiftleft(start, 32) + start).alias("r")).groupBy("doc_id").agg(F.collect_list("r").alias("runs"))


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed): each row of `docs` without the words that a repeated window covers.

    Words are runs of anything but ASCII white space, unchanged and of any length.  A window is repeated if its words in
    order also start anywhere else, in the same document or another; all occurrences go.  The words that stay are joined
    by one space.  Null and empty texts have no words; texts of fewer words than a window lose none; texts of any length
    are read whole, of which long ones a piece at a time.  Rows that repeat an id, or have none, are documents of their
    own; the occurrences in equal rows count each.  Ids keep their type.  An empty table gives no rows."""
    # the id and a hash of the text, so rows that repeat an id are told apart unless they are equal
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    base = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    runs = written(repeated_runs(base, window), "document-runs")
    out = by_id(base, runs).mapInArrow(_removed(window), f"doc_id {kind}, text string, n_words long, n_removed long")
    return out.select(F.col("doc_id.id").alias("doc_id"), "text", "n_words", "n_removed")
