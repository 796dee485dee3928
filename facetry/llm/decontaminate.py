"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words are written as a table of parts, dealt to chunks of bounded size, each with an automaton.  Words that
cannot be part of a match (their pair with the next word is in no item) are skipped by a vectorised test that has no false
negatives; the rest step through an automaton as real words.

A benchmark of one chunk goes to all tasks, and the documents stream past its automaton without a shuffle.  With more
chunks the documents are read once as well: a set of bits of bounded size tests pairs against all chunks, and only the
runs of words that pass are written.  Each is sent to the chunks that hold one of its pairs (of those a window apart, one
of which any match has), whose automata run in tasks, several to a chunk where many runs meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U, blocks, byte_table, grams, small, words, written

WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of item words that one automaton is meant to hold, and words of a part of an item; parts overlap by a window less one.
CHUNK_BYTES, PART_WORDS = 1 << 19, 2048
_TABLE = byte_table(ALNUM, fold=True)


class SuffixAutomaton:
    """Generalised suffix automaton over word ids with, for each state, the items that its strings occur in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ended = []
        for _, item in items:
            last = 0
            for w in item:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
            ended.append(last)
        # items by state: each prefix state of an item and all its suffixes, up to those already marked for the item;
        # kept for the states that hold strings of a window's length
        self.items: dict[int, set] = {}
        self.whole: dict[int, list[tuple[int, str | None]]] = {}
        for (name, item), end in zip(items, ended):
            state, seen = 0, set()
            for w in item:
                state = self.next[state][self.ids[w]]
                up = state
                while up > 0 and up not in seen:
                    seen.add(up)
                    if self.len[self.link[up]] < window <= self.len[up]:
                        self.items.setdefault(up, set()).add(name)
                    up = self.link[up]
            if len(item) < window:
                self.whole.setdefault(state, []).append((len(item), name))
        self.least = min([window, *(len(i) for _, i in items)])
        #: The state of the last `window` words, and the nearest suffix states with whole short items.
        self._window_state: dict[int, int] = {}
        self._short: dict[int, list[tuple[int, str | None]]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(length)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(length)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def window_state(self, s: int) -> int:
        if s not in self._window_state:
            t = s
            while self.len[self.link[t]] >= self.window:
                t = self.link[t]
            self._window_state[s] = t
        return self._window_state[s]

    def short(self, s: int) -> list[tuple[int, str | None]]:
        if s not in self._short:
            found, t = [], s
            while t > 0:
                found += self.whole.get(t, ())
                t = self.link[t]
            self._short[s] = found
        return self._short[s]

    def scan(self, stream: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [start, end) of a run of words, and the items whose windows occur in it."""
        state = length = 0
        found, names = [], set()
        for at, w in enumerate(stream, 1):
            c = self.ids.get(w)
            if c is None:
                state = length = 0
                continue
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c not in self.next[state]:
                continue
            state, length = self.next[state][c], length + 1
            if length >= self.window:
                found.append((at - self.window, at))
                names |= self.items[self.window_state(state)]
            for k, name in self.short(state):
                if k <= length:
                    found.append((at - k, at))
                    names.add(name)
        return found, names


class Scanner:
    """An automaton and the tables of the vectorised test."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.automaton = SuffixAutomaton(items, window)
        self.pairs = self.automaton.least > 1
        keys = [self._hashes(w) for _, w in items]
        keys = np.unique(np.concatenate([grams(k, 2) if self.pairs else k for k in keys]))
        self.keys, self.coarse = keys, np.zeros(1 << 22, bool)
        self.coarse[(keys >> U(42)).astype(np.int64)] = True

    @staticmethod
    def _hashes(item: list[bytes]) -> np.ndarray:
        buf = np.frombuffer(b" ".join(item), np.uint8)
        return words(buf, np.array([0, len(buf)]), _TABLE)[3]

    def rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple]]:
        """Words in each row, and for rows with hits: (spans as (start, end, from, to) in words and bytes, items)."""
        s, e, row, h = words(buf, offsets, _TABLE)
        n, least = np.bincount(row, minlength=len(offsets) - 1), self.automaton.least
        first = np.concatenate(([0], np.cumsum(n)))
        key = grams(h, 2) if self.pairs else h
        maybe = np.flatnonzero(self.coarse[(key >> U(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            maybe = maybe[self.keys[at] == key[maybe]]
        if self.pairs and len(maybe):
            maybe = maybe[row[maybe] == row[maybe + 1]]
        found: dict[int, tuple] = {}
        if not len(maybe):
            return n, found
        cut = np.flatnonzero((np.diff(maybe) != 1) | (row[maybe[1:]] != row[maybe[:-1]]))
        begin, stop = maybe[np.concatenate(([0], cut + 1))], maybe[np.concatenate((cut, [len(maybe) - 1]))] + 1 + self.pairs
        long = stop - begin >= least
        raw = buf.tobytes() if long.any() else b""
        for a, b in zip(begin[long].tolist(), stop[long].tolist()):
            hits, names = self.automaton.scan([raw[x:y].lower() for x, y in zip(s[a:b].tolist(), e[a:b].tolist())])
            if hits:
                r = int(row[a])
                own = found.setdefault(r, ([], set()))
                own[0].extend((x + a - int(first[r]), y + a - int(first[r])) for x, y in hits)
                own[1].update(names)
        out = {}
        for r, (hits, names) in found.items():
            own, at = merge(hits), int(first[r])
            out[r] = [(x, y, int(s[at + x] - offsets[r]), int(e[at + y - 1] - offsets[r])) for x, y in own], names
        return n, out


def merge(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Disjoint, ascending spans (start, end, more bounds) that cover the same places; spans that touch become one."""
    out: list[list[int]] = []
    for x in sorted(spans):
        if out and x[0] <= out[-1][1]:
            out[-1][1::2] = map(max, out[-1][1::2], x[1::2])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


_SCANNERS: dict[str, Scanner] = {}


# --- many chunks


#: Bits of the test of all chunks' pairs, at most, and bits for each pair.
MOST_BITS, PAIR_BITS = 1 << 27, 16
#: Runs that a task scans under one automaton.
TASK_RUNS = 20_000


def _pairs_of(pairs: bool):
    """(pair, chunk) of the parts' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, item in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = Scanner._hashes(item.split(b" "))
                own = np.unique(grams(h, 2) if pairs else h)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), chunk, np.int64))], names=["pair", "chunk"])

    return run


def _bits(block_bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << block_bits, np.uint8)
        own[rows["at"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    return run


def pair_bits(pairs: DataFrame) -> np.ndarray:
    """A set of bits, one for the upper bits of each pair's hash: built block by block in tasks, of bounded size."""
    n = max(1, pairs.count())
    level = min(MOST_BITS.bit_length() - 1, max(16, (PAIR_BITS * n - 1).bit_length()))
    inner = max(0, level - 8)
    at = F.shiftrightunsigned("pair", 64 - level)
    placed = pairs.select(F.shiftright(at, inner).cast("int").alias("block"), at.bitwiseAND(F.lit((1 << inner) - 1)).cast("int").alias("at")).distinct()
    found = placed.groupBy("block").applyInPandas(_bits(inner), "block int, bits binary").collect()
    out = np.zeros(1 << level - 3, np.uint8)
    for r in found:
        out[r["block"] << inner - 3 : r["block"] + 1 << inner - 3] = np.frombuffer(r["bits"], np.uint8)
    return out


_RUN = pa.struct([("at", pa.int32()), ("words", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary()), ("probes", pa.list_(pa.int64()))])
_RUN_SQL = "struct<at:int,words:binary,starts:binary,ends:binary,probes:array<bigint>>"


def _candidates(bits, least: int):
    """(doc_id, text_hash, n_words, runs) of each document: the runs of `least` words and more whose pairs all pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bits.value
        level, pairs = U(64 - (8 * len(own)).bit_length() + 1), least > 1
        for b in batches:
            n, runs = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for row0, buf, offsets in blocks(b.column(2)):
                s, e, row, h = words(buf, offsets, _TABLE)
                n[row0 : row0 + len(offsets) - 1] = np.bincount(row, minlength=len(offsets) - 1)
                key = grams(h, 2) if pairs else h
                bit = (key >> level).astype(np.int64)
                ok = (own[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if pairs:
                    ok &= row[:-1] == row[1:]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(np.int8), [0]))))
                raw = None
                for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    i, j = (i, j + pairs) if pairs else (i, j)
                    cuts = [i] if pairs else [i, *(np.flatnonzero(np.diff(row[i:j])) + i + 1).tolist()]
                    for a, z in zip(cuts, [*cuts[1:], j]):
                        if z - a < least:
                            continue
                        raw = buf.tobytes().lower() if raw is None else raw
                        r = int(row[a])
                        parts = [raw[x:y] for x, y in zip(s[a:z].tolist(), e[a:z].tolist())]
                        starts, ends = (x[a:z] - offsets[r] for x in (s, e))
                        first = int(np.searchsorted(row, r))
                        probes = key[a : z - pairs : max(1, least - 1)]
                        runs[row0 + r].append((a - first, b" ".join(parts), starts.astype("<i4").tobytes(), ends.astype("<i4").tobytes(), probes.view(np.int64).tolist()))
            lists = pa.array([[dict(zip(("at", "words", "starts", "ends", "probes"), x)) for x in own_runs] for own_runs in runs], pa.list_(_RUN))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), lists], names=["doc_id", "text_hash", "n_words", "runs"])

    return run


def _met(window: int):
    """(run, spans, items) for a partition's rows (chunk, share, run, name, words): of each chunk its items come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, automaton = None, [], None
        for b in batches:
            out = []
            for chunk, share, number, name, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (chunk, share) != key:
                    key, items, automaton = (chunk, share), [], None
                own = raw.split(b" ")
                if number is None:
                    items.append((name, own))
                    continue
                if automaton is None and items:
                    automaton = SuffixAutomaton(items, window)
                hits, names = automaton.scan(own) if automaton else ((), ())
                if hits:
                    out.append((number, [{"start": x, "end": y} for x, y in merge(hits)], sorted(x for x in names if x is not None)))
            kinds = (pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["run", "spans", "items"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans within runs as spans of their documents, in words and in bytes."""
    for b in batches:
        spans = []
        for at, starts, ends, own in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
            s, e = np.frombuffer(starts, "<i4"), np.frombuffer(ends, "<i4")
            spans.append([(at + x["start"], at + x["end"], int(s[x["start"]]), int(e[x["end"] - 1])) for x in own])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _spans(spans), b.column(6)], names=["doc_id", "text_hash", "spans", "items"])


def _in_chunks(own: DataFrame, dealt: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, n_words) of all documents, (doc_id, text_hash, spans, items) of those that are hit); dealt:
    (item, words, n, chunk)."""
    kind, spark = own.schema["doc_id"].dataType.simpleString(), own.sparkSession
    least = min(window, dealt.agg(F.min("n")).first()[0])
    pairs = written(dealt.select("chunk", "words").mapInArrow(_pairs_of(least > 1), "pair long, chunk long").distinct(), "pairs")
    bits = spark.sparkContext.broadcast(pair_bits(pairs.select("pair").distinct()))
    scanned = written(own.mapInArrow(_candidates(bits, least), f"doc_id {kind}, text_hash long, n_words long, runs array<{_RUN_SQL}>"), "candidates")
    runs = scanned.select("doc_id", "text_hash", F.explode("runs").alias("r")).select("doc_id", "text_hash", "r.*")
    # equal runs are scanned once
    named = runs.withColumn("run", F.sha2("words", 256))
    texts = named.groupBy("run").agg(F.first("words").alias("words"), F.first("probes").alias("probes"))
    sent = texts.select("run", "words", F.explode("probes").alias("probe")).join(pairs, F.col("probe") == F.col("pair")).select("chunk", "run", "words").distinct()
    sent = written(sent, "sent")
    shares = sent.groupBy(F.col("chunk").alias("of")).agg(F.ceil(F.count("*") / TASK_RUNS).cast("int").alias("shares"))
    shares = written(shares, "shares")
    rows = sent.join(shares, F.col("chunk") == F.col("of")).select("chunk", F.pmod(F.xxhash64("run"), "shares").cast("int").alias("share"), "run", F.lit(None).cast("string").alias("item"), "words")
    items = dealt.join(shares, F.col("chunk") == F.col("of")).select("chunk", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("string").alias("run"), "item", "words")
    streamed = items.unionByName(rows).repartition("chunk", "share").sortWithinPartitions("chunk", "share", F.col("run").asc_nulls_first())
    met = streamed.mapInArrow(_met(window), "run string, spans array<struct<start:int,end:int>>, items array<string>")
    met = written(met, "met").select(F.col("run").alias("of"), "spans", "items")
    hits = named.join(met, F.col("run") == F.col("of")).select("doc_id", "text_hash", "at", "starts", "ends", "spans", "items")
    hits = hits.mapInArrow(_placed, f"doc_id {kind}, text_hash long, spans {_SPANS}, items array<string>")
    hits = written(hits.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")), "hits")
    return scanned.select("doc_id", "text_hash", "n_words"), hits.mapInArrow(_together, f"doc_id {kind}, text_hash long, spans {_SPANS}, items array<string>")


_SPANS = "array<struct<start:int,end:int,from:int,to:int>>"
_SPAN = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "from", "to")]))


def _spans(rows: list) -> pa.Array:
    return pa.array([None if own is None else [dict(zip(("start", "end", "from", "to"), x)) for x in own] for own in rows], _SPAN)


def _scanned(name: str, items, window: int):
    """One automaton's pass over (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[name] = Scanner(items.value, window)
        scanner = _SCANNERS[name]
        for b in batches:
            n, spans, names = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for row, buf, offsets in blocks(b.column(2)):
                count, found = scanner.rows(buf, offsets)
                n[row : row + len(count)] = count
                for r, (own, items_of) in found.items():
                    spans[row + r], names[row + r] = own, sorted(x for x in items_of if x is not None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), _spans(spans), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans and items of a document from several automata as one list each."""
    for b in batches:
        spans = [merge([tuple(x.values()) for x in own]) for own in b.column(2).to_pylist()]
        names = [sorted(set(own)) for own in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _spans(spans), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text_hash", "spans", "items"])


def item_parts(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, n) of the benchmark: normalised words joined by spaces, in parts of bounded length that hold all windows;
    items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                item = WORD.findall(text.as_buffer().to_pybytes().lower()) if text.is_valid else []
                if item:
                    parts = [item[at : at + PART_WORDS + window - 1] for at in range(0, max(1, len(item) - window + 1), PART_WORDS)]
                    out += [(name, b" ".join(own), len(own)) for own in parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.int32()))], names=["item", "words", "n"])

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item string, words binary, n int")


def row_hash(text_col: str = "text"):
    """With the id, what names a row: equal rows have equal results."""
    return F.xxhash64(F.col(text_col)).alias("text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, spans, items, contaminated): one row per row of `docs`, extra columns ignored.

    Words are runs of letters, digits and everything beyond ASCII, A-Z lower-cased.  A window is `window` consecutive
    words of an item, or all of a shorter item.  A word inside any occurrence of a window is hit; spans are the hit
    words as disjoint [start, end), and as bytes [from, to) of the text (null if there are none).  contaminated: some
    word is hit and at least the share `coverage` (a fraction) of all words.

    Null or empty texts have no words; items without words have no windows; items with a null id hit but are not listed;
    items with the same id count once.  Texts of any length are read whole.  Rows that repeat an id are told apart by
    text_hash, and repeated rows come out as often.  An empty benchmark hits nothing; no documents give no rows."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), row_hash(text_col), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    parts = written(item_parts(benchmark, window, item_col, item_text_col), "benchmark")
    chunks = max(1, -(-(parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // CHUNK_BYTES))
    if chunks == 1:
        # the rows of one chunk, of bounded size; with none, words are still counted: an item that no text can hold
        chunk = [(r["item"], bytes(r["words"]).split(b" ")) for r in parts.collect()] or [(None, [b"\x00"] * window)]
        sent = spark.sparkContext.broadcast(chunk)
        out = own.mapInArrow(_scanned(uuid.uuid4().hex, sent, window), f"doc_id {kind}, text_hash long, n_words long, spans {_SPANS}, items array<string>")
    else:
        every, hits = _in_chunks(own, parts.withColumn("chunk", F.pmod(F.xxhash64("item", "words"), F.lit(chunks))), window)
        met = hits.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
        out = every.join(met, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]), F.lit(0).cast("long"))
    out = out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage[1] >= F.col("n_words") * coverage[0]))


def remove_spans(docs: DataFrame, found: DataFrame, longest: int = 1 << 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, without benchmark passages: contaminated texts lose all spans that
    `found` (the result of decontaminate over the same rows) has of them, others the spans of `longest` words or more.

    Null texts stay null, texts without spans as they are; repeated rows fare alike; an empty table, or an empty `found`,
    is fine.  Columns may have any names but __id, __hash and __gone."""
    gone = F.when(F.col("contaminated"), F.col("spans")).otherwise(F.filter("spans", lambda x: x["end"] - x["start"] >= longest))
    marks = found.where("spans is not null").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), gone.alias("__gone")).where("size(__gone) > 0")
    marks = written(marks.dropDuplicates(["__id", "__hash"]), "removed")
    met = docs.join(small(marks, 40, "16 * size(__gone)"), docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left")
    raw = F.encode(docs[text_col], "UTF-8")
    begins = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda x: x["to"]))
    ends = F.concat(F.transform("__gone", lambda x: x["from"]), F.array(F.octet_length(docs[text_col])))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")), "")
    return met.select(*(F.when(F.col("__gone").isNull(), docs[c]).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns))
