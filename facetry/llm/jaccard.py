"""Exact Jaccard join of documents' word shingles in the metric space of their distance, 1 - J.

Distances between unrelated documents are all 1, so pivots drawn from a corpus at random would part nothing.  The first
pivots are therefore found by shingles: under one order of all shingles (common ones last), two sets within reach share
a number of those that come first in each (see `need`), and the sets that hold one there belong to the region of the
smallest of them, their pivot.  Sets that share fewer belong to none, and a set may leave the regions in which it shares
least as long as it cannot miss a link by that.  A region that fits in a task is joined there, all pairs at once.  A larger one is cut again: pivots are drawn
from its members, every member's distance to each is computed, a member belongs to the Voronoi cell of the nearest and
is replicated to each cell that the triangle inequality leaves open (no farther than the nearest plus twice the reach),
so that two linked members meet in the home of either.  Cells are regions of the next round.

Links to pivots are kept, and what they connect needs no comparing: a region whose members are one component is done,
however large a group of near copies it is.  A region that pivots do not part, as its members lie at like distances, is
joined in blocks, members outside its largest component against all.

Equal sets are one node.  Shingles are named by XXH64 and sets by 64 bits of BLAKE2b over these."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, blocks, by_id, small, written, xxh64
from .components import components
from .simhash import PIECE, SEED, _pieces, _roots

SHINGLE = 5
#: Shares of a union that are a link: five times the intersection is at least four times the union.
NUMERATOR, DENOMINATOR = 4, 5
REACH = 1 - NUMERATOR / DENOMINATOR
#: Sets that a task joins at once, and bytes of one that counts once (a larger one counts as often as it has them).
LONG, UNIT_BYTES = 512, 1 << 15
#: What heads hold beyond the least that two sets within reach share a shingle in, as a share of a set.
EXTRA = (1, 10)
#: Pivots drawn from a region.
PIVOTS = 12
#: Shingles that a task counts at once, in how many sets of these one is common, and the most that are sent to all tasks.
COUNTED, COMMON, MOST_COMMON = 1 << 22, 8, 1 << 19


# --- sets


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of one word or more, with one space between words: how many shingles each has, and their hashes."""
    buf = np.frombuffer(b"\n".join(texts) + bytes(9), np.uint8)
    cut = np.flatnonzero((buf[:-9] == 32) | (buf[:-9] == 10))
    start, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(buf) - 9]))
    n = np.array([t.count(b" ") + 1 for t in texts])
    total = np.maximum(1, n - k + 1)
    own = np.repeat(np.cumsum(n) - n - np.cumsum(total) + total, total)
    first = np.arange(total.sum()) + own
    last = first + np.repeat(np.minimum(n, k) - 1, total)
    return total, xxh64(buf, start[first], end[last] - start[first], SEED)


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The set of one text of any length: distinct hashes, ascending."""
    parts, held = [], []
    for words in _pieces(text):
        held = held + words
        if len(held) >= k:
            parts.append(np.unique(shingles([b" ".join(held)], k)[1]))
            held = held[len(held) - k + 1 :]
    if not parts:
        return np.unique(shingles([b" ".join(held)], k)[1]) if held else np.zeros(0, U)
    return np.unique(np.concatenate(parts))


def sets_of(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of each row."""
    for _, buf, offsets in blocks(texts):
        if len(buf) > PIECE:
            for i in range(len(offsets) - 1):
                yield shingle_set(buf[offsets[i] : offsets[i + 1]].tobytes(), k)
            continue
        raw = buf.tobytes().lower()
        own = [b" ".join(raw[i:j].split()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        some = [t for t in own if t]
        total, h = shingles(some, k) if some else (np.zeros(0, int), np.zeros(0, U))
        each = iter(np.split(h, np.cumsum(total)[:-1]) if some else ())
        for t in own:
            yield np.unique(next(each)) if t else np.zeros(0, U)


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _nodes(k: int):
    """(key, n, node) of each document, and rows of (shingle, times) of what is common in a task's part."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= COMMON
        return rows(pa.nulls(int(some.sum()), _KEY), np.zeros(int(some.sum()), np.int32), np.zeros(int(some.sum()), np.int64), s[some].view(np.int64), n[some])

    def rows(key: pa.Array, n: np.ndarray, node: np.ndarray, shingle: np.ndarray | None, times: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int32()), pa.array(node, pa.int64()), none if shingle is None else pa.array(shingle), none if times is None else pa.array(times)], names=["key", "n", "node", "shingle", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            n, node = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for i, own in enumerate(sets_of(b.column(1), k)):
                n[i], node[i] = len(own), node_of(own)
                held.append(own)
                size += len(own)
            key = pa.StructArray.from_arrays(b.column(0).flatten(), fields=list(_KEY))
            yield rows(key, n, node, None, None)
            if size >= COUNTED:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    return run


_KEY = pa.struct([("id", pa.int64()), ("text", pa.int64())])
_KEY_SQL = "struct<id:bigint,text:bigint>"


def _common(counted: DataFrame) -> np.ndarray:
    """Common shingles, ascending, and their ranks by frequency: a bounded list, the most frequent first to be in it.  Any
    list gives right results; a good one keeps passages that many texts share out of the heads."""
    total = counted.groupBy("shingle").agg(F.sum("times").alias("times"))
    total = written(total, "common")
    level = total.groupBy(F.floor(F.log2("times")).cast("int").alias("level")).count().collect()
    least, room = 62, MOST_COMMON
    for r in sorted(level, key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    rows = total.where(F.col("times") >= 2**least).collect()
    s, n = np.array([r["shingle"] for r in rows], np.int64).view(U), np.array([r["times"] for r in rows], np.int64)
    order = np.argsort(s)
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, n))] = np.arange(len(s))
    return np.stack((s[order], rank[order].astype(U)))


def need(n: int) -> int:
    """How many shingles two sets within reach share among their heads, at least, if one has n.

    The other has at least four fifths of n, and a fifth of either set at most is not shared.  The head that ends first
    in the order of all holds that fifth, one more and EXTRA of its set, and what it shares is in the other's head, too."""
    return 1 + EXTRA[0] * NUMERATOR * n // (EXTRA[1] * DENOMINATOR)


def head(own: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the order of all, as (rare ones, common ones)."""
    length = min(len(own), len(own) - -(-NUMERATOR * len(own) // DENOMINATOR) + 1 + EXTRA[0] * len(own) // EXTRA[1])
    if not common.shape[1]:
        return own[:length], own[:0]
    at = np.minimum(np.searchsorted(common[0], own), common.shape[1] - 1)
    hit = common[0][at] == own
    rare = own[~hit][:length]
    return rare, own[hit][np.argsort(common[1][at[hit]])][: length - len(rare)]


def _heads(k: int, common):
    """(node, n, rare, common) of each text with words."""

    def listed(parts: list[np.ndarray]) -> pa.ListArray:
        edge = np.concatenate(([0], np.cumsum([len(h) for h in parts], dtype=np.int64))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*parts, np.zeros(0, U)]).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [s for s in sets_of(b.column(0), k) if len(s)]
            heads = [head(s, common.value) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int32()), *(listed([h[i] for h in heads]) for i in (0, 1))], names=["node", "n", "rare", "common"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, node, times): for the lists (s, node) of a partition that is sorted by both, the smallest node with each,
    if there are two; a list that goes on in the next batch is told by its first node and its last, so none is held."""
    s, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        s, node = np.concatenate((s, np.asarray(b.column(0)))), np.concatenate((node, np.asarray(b.column(1))))
        fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])))
        s, node = s[fresh], node[fresh]
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.concatenate((edge, [len(s)])))
        own = np.repeat(size > 1, size)
        pairs, times = np.unique(np.stack((np.repeat(node[edge], size)[own], node[own]), axis=1), axis=0, return_counts=True) if own.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(times.astype(np.int64))], names=["region", "node", "times"])
        last = [edge[-1], len(s) - 1] if size[-1] > 1 else [len(s) - 1]
        s, node = s[last], node[last]


def regions_of(heads: DataFrame) -> DataFrame:
    """(region, node): the first regions, by the lists of the heads' shingles; heads: (node, n, rare, common)."""
    cold = heads.select(F.explode("rare").alias("s"), "node").repartition("s").sortWithinPartitions("s", "node").mapInArrow(_shared, "region long, node long, times long")
    # lists of common shingles, which any number of sets may hold: summed on the map side, and of bounded number
    hot = heads.select(F.explode("common").alias("s"), "node")
    lists = hot.groupBy(F.col("s").alias("of")).agg(F.min("node").alias("region"), F.max("node").alias("last")).where("region <> last").drop("last")
    hot = hot.join(small(written(lists, "lists"), 16), F.col("s") == F.col("of")).select("region", "node", F.lit(1).cast("long").alias("times"))
    met = written(cold.unionByName(hot).groupBy("region", "node").agg(F.sum("times").alias("times")), "met")
    sizes = written(heads.select(F.col("node").alias("of"), "n").distinct(), "sizes")
    least = F.expr(f"1 + {EXTRA[0] * NUMERATOR} * n div {EXTRA[1] * DENOMINATOR}")
    by = Window.partitionBy("node")
    sofar = F.sum("times").over(by.orderBy("times", "region").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = met.join(small(sizes, 16), F.col("node") == F.col("of")).withColumn("least", least)
    met = met.withColumns({"all": F.sum("times").over(by), "sofar": sofar}).where("all >= least and 2 * sofar > least - 1")
    members = written(met.select("region", "node"), "members")
    many = members.groupBy(F.col("region").alias("of")).count().where("count > 1")
    return members.join(many, F.col("region") == F.col("of"), "left_semi")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(sets_of(b.column(0), k))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary()), pa.array([max(1, s.nbytes // UNIT_BYTES) for s in own], pa.int64())], names=["node", "own", "weight"])

    return run


# --- joining


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of `a` with each of `b`: products of 0/1 matrices, some columns at a time."""
    sizes = [len(s) for s in (*a, *b)]
    value, of = np.concatenate((*a, *b)), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    of, column = of[shared], np.cumsum(new & shared)[shared] - 1
    out, wide = np.zeros((len(a), len(b)), np.float32), 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, (at, at + wide))
        x = np.zeros((len(sizes), wide), np.float32)
        x[of[lo:hi], column[lo:hi] - at] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out.astype(np.int64)


def near(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs of a set of `a` and one of `b` are links, their distances)."""
    both = overlaps(a, b)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
    return DENOMINATOR * both >= NUMERATOR * union, 1 - both / np.maximum(union, 1)


def forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links among sets, as places, that span all that there are."""
    if len(sets) == 2:
        n, both = len(sets[0]) + len(sets[1]), len(np.intersect1d(*sets, assume_unique=True))
        ok = DENOMINATOR * both >= NUMERATOR * (n - both)
        return (np.array([1]), np.array([0])) if ok else (np.zeros(0, int),) * 2
    i, j = np.nonzero(np.tril(near(sets, sets)[0], -1))
    root = np.arange(len(sets))
    _roots(root, i, j)
    low = np.flatnonzero(root != np.arange(len(root)))
    return low, root[low]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of the groups of a partition that is sorted by its first columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held[0][:keys], held
                held = []
            held.append(row)
    if held:
        yield held[0][:keys], held


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links within each group (key, node, label, own); groups under one label are done."""
    a, b = [], []
    for _, rows in _groups(batches, 1):
        if len({r[2] for r in rows}) < 2:
            continue
        i, j = forest([np.frombuffer(r[3], U) for r in rows])
        a += [rows[k][1] for k in i.tolist()]
        b += [rows[k][1] for k in j.tolist()]
        if len(a) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, node, links, cells) of each member of the groups (region, bucket, member, node, own), whose pivots come
    first: the pivots within reach, and those whose cells it belongs to or is replicated to."""
    for (region, _), rows in _groups(batches, 2):
        pivots = [r for r in rows if not r[2]]
        sets, names = [np.frombuffer(r[4], U) for r in pivots], np.array([r[3] for r in pivots])
        for at in range(len(pivots), len(rows), LONG):
            part = rows[at : at + LONG]
            linked, d = near([np.frombuffer(r[4], U) for r in part], sets)
            within = d <= d.min(axis=1, keepdims=True) + 2 * REACH + 1e-9
            pick = lambda m: [names[x].tolist() for x in m]
            yield pa.RecordBatch.from_arrays([pa.array([region] * len(part), pa.int64()), pa.array([r[3] for r in part], pa.int64()), pa.array(pick(linked), pa.list_(pa.int64())), pa.array(pick(within), pa.list_(pa.int64()))], names=["region", "node", "links", "cells"])


def _streamed(rows: DataFrame, by: list[str], order: list[str], f: Callable, kind: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(f, kind)


class Regions:
    """Regions in the making: the links found so far and what is left to compare."""

    def __init__(self, members: DataFrame, sets: DataFrame):
        """members: (region, node), distinct; sets: (node, own, weight)."""
        self.sets, self.links = sets, sets.sparkSession.createDataFrame([], "a long, b long")
        self.weights = sets.select(F.col("node").alias("of"), "weight")
        self.left = self._sized(members.withColumn("label", F.col("node")))

    def _sized(self, members: DataFrame) -> DataFrame:
        """(region, node, label, size) of the regions with two labels at least."""
        members = written(members, "members")
        size = members.join(self.weights, F.col("node") == F.col("of")).groupBy("region").agg(F.sum("weight").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
        size = written(size.where("low <> high").select(F.col("region").alias("r"), "size"), "sizes")
        return members.join(size, F.col("region") == F.col("r")).drop("r")

    def _with_sets(self, rows: DataFrame) -> DataFrame:
        """Rows that name nodes, with the nodes' sets: the sets stay where they are if the rows are few."""
        return self.sets.select(F.col("node").alias("of"), "own").join(small(rows, 40), F.col("node") == F.col("of"))

    def _join(self, rows: DataFrame) -> None:
        """Joins groups (key, node, label) in one task each."""
        met = self._with_sets(rows).select("key", "node", "label", "own")
        self.links = self.links.unionByName(written(_streamed(met, ["key"], ["node"], _joined, "a long, b long"), "links"))

    def run(self) -> DataFrame:
        """(a, b): links that span all there are."""
        level = 0
        while True:
            left = written(self.left, "regions")
            self._join(left.where(F.col("size") <= LONG).select(F.col("region").alias("key"), "node", "label"))
            large = left.where(F.col("size") > LONG)
            if large.isEmpty():
                return self.links
            self.left = self._cut(large, level)
            level += 1

    def _cut(self, large: DataFrame, level: int) -> DataFrame:
        """The cells of large regions; those that pivots do not part are joined in blocks."""
        drawn = (F.col("node") == F.col("region")) | (F.pmod(F.xxhash64("node", F.lit(level)), F.col("size")) < PIVOTS)
        buckets = F.ceil(F.col("size") / (2 * LONG)).cast("int")
        own = large.select("region", F.pmod(F.xxhash64("node", F.lit("bucket")), buckets).cast("int").alias("bucket"), F.lit(1).alias("member"), "node")
        pivots = large.where(drawn).select("region", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"), F.lit(0).alias("member"), "node")
        rows = self._with_sets(own.unionByName(pivots)).select("region", "bucket", "member", "node", "own")
        found = written(_streamed(rows, ["region", "bucket"], ["member", "node"], _cells, "region long, node long, links array<bigint>, cells array<bigint>"), "cells")
        self.links = self.links.unionByName(written(found.select(F.col("node").alias("a"), F.explode("links").alias("b")).where("a <> b"), "links"))
        labels = written(components(self.links), "labels").select(F.col("node").alias("of"), "root")
        labelled = lambda df: df.join(labels, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("root", "node")).drop("of", "root")
        open_ = self._sized(labelled(large.select("region", "node")))
        open_ = written(open_, "open")
        sizes = open_.groupBy(F.col("region").alias("r")).agg(F.first("size").alias("most"))
        cells = labelled(found.select("region", "node", F.explode("cells").alias("pivot")).join(sizes, F.col("region") == F.col("r")).select(F.xxhash64("region", "pivot", F.lit(level)).alias("cell"), "region", "most", "node"))
        cells = written(cells.select(F.col("cell").alias("region"), F.col("region").alias("parent"), "most", "node", "label"), "children")
        left = written(self._sized(cells), "children")
        # a region is parted if no cell has half of it
        whole = written(left.where(2 * F.col("size") > F.col("most")).select(F.col("parent").alias("r")).distinct(), "whole")
        self._blocks(open_.join(whole, F.col("region") == F.col("r"), "left_semi"))
        return left.join(whole, F.col("parent") == F.col("r"), "left_anti").select("region", "node", "label", "size")

    def _blocks(self, rows: DataFrame) -> None:
        """Joins regions (region, node, label, size) block against block: those outside the largest label with all."""
        if rows.isEmpty():
            return
        sizes = rows.groupBy("region", "label").agg(F.count("*").alias("n"))
        core = sizes.groupBy(F.col("region").alias("r")).agg(F.max(F.struct("n", "label")).alias("core"), F.sum("n").alias("n"))
        met = rows.join(core, F.col("region") == F.col("r")).withColumn("rest", F.col("label") != F.col("core.label"))
        per = F.col("size") / F.col("n")  # the mean weight of a member
        inner, outer = (F.greatest(F.lit(1), F.ceil(x * per / LONG)).cast("int") for x in (F.col("core.n"), F.col("n") - F.col("core.n")))
        met = met.select("region", "node", "label", "rest", inner.alias("inner"), outer.alias("outer"))
        at = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("rest"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
        met = met.withColumn("at", at)
        to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        with_core = F.transform(to("inner"), lambda j: F.struct(F.lit(0).alias("kind"), F.col("at").alias("i"), j.alias("j")))
        with_rest = F.transform(to("outer"), lambda j: F.struct(F.lit(1).alias("kind"), F.least("at", j).alias("i"), F.greatest("at", j).alias("j")))
        of_core = F.transform(to("outer"), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("at").alias("j")))
        pairs = F.explode(F.when(F.col("rest"), F.concat(with_core, with_rest)).otherwise(of_core))
        self._join(met.select("region", "node", "label", pairs.alias("x")).select(F.xxhash64("region", "x.kind", "x.i", "x.j").alias("key"), "node", "label"))


def near_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of `docs`, other columns ignored.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text's set is its distinct runs of `shingle`
    words, or all of its words if they are fewer.  Texts whose sets share four fifths of their union are linked;
    component_id is the smallest id that a chain of links reaches.  Texts without words, null ones included, have an empty
    set and are linked with nothing: component_id is their own id.  Rows with a null id link like others, and component_id
    is null only if no row of the group has an id.  Repeated rows are one set.  Texts of any length are read whole; a set
    takes eight bytes a word.  Ids are whole numbers, or text of such.  An empty table gives no rows."""
    spark: SparkSession = docs.sparkSession
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"))
    base = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    rows = written(base.mapInArrow(_nodes(shingle), f"key {_KEY_SQL}, n int, node long, shingle long, times long"), "sets")
    prints, counted = rows.where("shingle is null").select("key", "n", "node"), rows.where("shingle is not null")
    common = spark.sparkContext.broadcast(_common(counted))
    heads = written(base.select("text").mapInArrow(_heads(shingle, common), "node long, n int, rare array<bigint>, common array<bigint>"), "heads")
    members = written(regions_of(heads), "members")
    met = members.select(F.col("node").alias("of")).distinct()
    chosen = written(prints.join(met, F.col("node") == F.col("of"), "left_semi").groupBy("node").agg(F.min("key").alias("key")), "chosen")
    texts = by_id(base, small(chosen, 32), on="key", how="inner").select("text")
    sets = written(texts.mapInArrow(_sets(shingle), "node long, own binary, weight long"), "members-sets")
    if sets.count() > chosen.count():  # rows that repeat id and text
        sets = written(sets.dropDuplicates(["node"]), "members-sets")
    links = Regions(members, sets).run()
    roots = written(components(links), "roots")
    ids = written(prints.where("n > 0").groupBy("node").agg(F.min("key.id").alias("id"), F.count("*").alias("n")), "ids")
    grouped = roots.join(ids.select(F.col("node").alias("of"), "id"), F.col("node") == F.col("of")).select("node", "root", "id")
    low = grouped.groupBy("root").agg(F.min("id").alias("low")).select(F.col("root").alias("of"), "low")
    named = grouped.join(low, F.col("root") == F.col("of")).select("node", "low")
    copies = ids.where("n > 1").join(roots.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_anti").select("node", F.col("id").alias("low"))
    named = written(named.unionByName(copies), "named").select(F.col("node").alias("of"), "low")
    out = prints.join(small(named, 16), (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select(F.col("key.id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("of").isNotNull(), F.col("low")).otherwise(F.col("key.id")).alias("component_id"))
