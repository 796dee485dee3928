"""Language identification by inference of a multilingual mixture.

A language is a distribution over hashed byte trigrams, counted over all labelled texts.  A document is a mixture of
languages; expectation-maximisation estimates the proportions, and the set of languages is the one with the best
likelihood after a penalty for each language beyond the first.

Languages are fitted in blocks of BLOCK, those that hold a share of some block's mixture are fitted together.  The model
is a written table of the trigrams seen in each language; blocks are sent to the tasks in broadcasts of bounded size.  A
model that needs several broadcasts takes as many passes over the documents, whose candidates meet in a shuffle; as the
blocks are the same, so are the results, for any number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, blocks, small, written

BINS_LOG2 = 15
BINS = 1 << BINS_LOG2
#: Languages that are fitted together at first; all their trigrams fit in one broadcast.
BLOCK = 32
#: Bytes of one trigram of a language in a broadcast.
ENTRY_BYTES = 12
#: Languages whose counts a task holds at once.
HELD = 128
#: A language with less than this share after the first fit is not a candidate.
LEAST_SHARE = 0.01


def _classes() -> np.ndarray:
    """0 for what separates words (ASCII that isn't a letter), A-Z as a-z, bytes beyond ASCII as they are."""
    c = np.zeros(256, np.uint32)
    c[97:123] = c[65:91] = np.arange(1, 27)
    c[128:] = np.arange(128, 256)
    return c


_CLASS = _classes()


#: Bytes of a text that are worked on at once.
PIECE = 1 << 20


def trigram_bins(text: np.ndarray, at: int = 0, end: int | None = None) -> np.ndarray:
    """The bin of each trigram around a letter in text[at:end]; the text counts as standing between spaces."""
    end = len(text) if end is None else end
    c = np.zeros(end - at + 2, np.uint32)
    a, b = max(0, at - 1), min(len(text), end + 1)
    c[a - at + 1 : b - at + 1] = _CLASS[text[a:b]]
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return ((code[c[1:-1] != 0] * np.uint32(2654435761)) >> np.uint32(32 - BINS_LOG2)).astype(np.int64)


def trigram_counts(text: np.ndarray) -> np.ndarray:
    """How often each bin occurs, piece by piece."""
    n = np.zeros(BINS, np.int64)
    for at in range(0, len(text), PIECE):
        n += np.bincount(trigram_bins(text, at, min(len(text), at + PIECE)), minlength=BINS)
    return n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            bins = np.flatnonzero(n)
            if len(bins):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins.astype(np.int32)), pa.array(n[bins])], names=["lang", "bin", "n"])
        total.clear()

    for b in batches:
        langs = b.column(0).to_pylist()
        for row, buf, offsets in blocks(b.column(1)):
            for i in range(len(offsets) - 1):
                if langs[row + i] not in total and len(total) >= HELD:
                    yield from flush()
                own = total.setdefault(langs[row + i], np.zeros(BINS, np.int64))
                own += trigram_counts(buf[offsets[i] : offsets[i + 1]])
    yield from flush()


@dataclass
class Model:
    """Written tables: the languages (no, lang, total) in order of their names, and the trigrams seen (no, bin, n); and the
    ranges of languages whose trigrams are broadcast together."""

    languages: DataFrame
    trigrams: DataFrame
    passes: list[tuple[int, int]]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts trigrams by language over all rows with a text and a label; tasks send sums, never texts.

    A label whose texts hold no letter is not learned.  Repeated rows count as often as they come."""
    base = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = written(base.mapInArrow(_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "trigrams")
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = written(totals.select((F.row_number().over(Window.orderBy("lang")) - 1).alias("no"), "lang", "total"), "languages")
    own = small(languages.select("no", F.col("lang").alias("of")), 24, "octet_length(of)")
    trigrams = written(sums.join(own, F.col("lang") == F.col("of")).select("no", "bin", "n"), "model")
    passes: list[tuple[int, int]] = []
    size = 0
    for block, n in sorted(trigrams.groupBy(F.expr(f"no div {BLOCK}").alias("block")).count().collect()):
        size += n * ENTRY_BYTES
        if not passes or size > BROADCAST_BYTES:
            passes.append((block * BLOCK, 0))
            size = n * ENTRY_BYTES
        passes[-1] = (passes[-1][0], (block + 1) * BLOCK)
    return Model(languages, trigrams, passes)


class Part:
    """Languages as distributions: a floor for what was not seen, and the probabilities of the trigrams seen, by bin."""

    def __init__(self, names: list[str], total: np.ndarray, no: np.ndarray, bins: np.ndarray, n: np.ndarray):
        self.names, self.floor = names, 0.1 / (total + 0.1 * BINS)
        order = np.lexsort((no, bins))
        self.no, self.p = no[order].astype(np.int32), (n[order] + 0.1) / (total[no[order]] + 0.1 * BINS)
        self.offsets = np.concatenate(([0], np.cumsum(np.bincount(bins, minlength=BINS)))).astype(np.int32)

    @classmethod
    def of(cls, model: Model, low: int, high: int) -> Part:
        names = sorted(model.languages.where((F.col("no") >= low) & (F.col("no") < high)).collect())
        rows = model.trigrams.where((F.col("no") >= low) & (F.col("no") < high)).select((F.col("no") - low).alias("no"), "bin", "n").toPandas()
        return cls([r["lang"] for r in names], np.array([r["total"] for r in names], float), rows["no"].to_numpy(np.int64), rows["bin"].to_numpy(np.int64), rows["n"].to_numpy(float))

    def blocks(self, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first language, probabilities of the bins by language) of each block."""
        low, n = self.offsets[bins], np.diff(np.stack((self.offsets[bins], self.offsets[bins + 1])), axis=0)[0]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        col, no, p = np.repeat(np.arange(len(bins)), n), self.no[at], self.p[at]
        if len(self.names) > BLOCK:
            order = np.argsort(no, kind="stable")
            col, no, p = col[order], no[order], p[order]
        for first in range(0, len(self.names), BLOCK):
            a, b = np.searchsorted(no, (first, first + BLOCK)) if len(self.names) > BLOCK else (0, len(no))
            own = np.repeat(self.floor[first : first + BLOCK, None], len(bins), axis=1)
            own[no[a:b] - first, col[a:b]] = p[a:b]
            yield first, own


def fit(p: np.ndarray, counts: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """Proportions of the languages with probabilities p (languages x trigrams), and the log-likelihood, by EM."""
    share = np.full(len(p), 1 / len(p))
    n = counts.sum()
    if len(p) == 1:
        return share, float(counts @ np.log(p[0]))
    for _ in range(steps):
        new = share * (p @ (counts / (share @ p))) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < 2e-3:
            break
    return share, float(counts @ np.log(share @ p))


def features(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a text's trigrams and how often each occurs."""
    if len(text) > 8192:
        n = trigram_counts(text)
        bins = np.flatnonzero(n)
        return bins, n[bins].astype(float)
    bins, counts = np.unique(trigram_bins(text), return_counts=True)
    return bins, counts.astype(float)


def candidates(bins: np.ndarray, counts: np.ndarray, part: Part) -> tuple[np.ndarray, np.ndarray]:
    """The languages that are likeliest alone in their block or hold a share of its mixture, and their probabilities."""
    own, rows = [], []
    for first, p in part.blocks(bins):
        keep = fit(p, counts)[0] >= LEAST_SHARE if len(bins) and len(p) > 1 else np.zeros(len(p), bool)
        keep[(np.log(p) @ counts).argmax()] = True
        own.append(first + np.flatnonzero(keep)), rows.append(p[keep])
    return np.concatenate(own), np.concatenate(rows)


def decide(p: np.ndarray, counts: np.ndarray, penalty: float) -> list[tuple[int, float]]:
    """The chosen rows of p (candidates x trigrams) with their proportions, largest first."""
    single = np.log(p) @ counts
    best = ([(int(single.argmax()), 1.0)], float(single.max()))
    if len(p) == 1 or not len(counts):
        return best[0]
    cost = penalty * np.log(counts.sum() + 1)
    share, _ = fit(p, counts)
    order = np.argsort(-share, kind="stable")
    order = order[share[order] >= LEAST_SHARE]
    for k in range(2, len(order) + 1):
        own, value = fit(p[order[:k]], counts)
        value -= cost * (k - 1)
        if value <= best[1]:
            break
        best = (sorted(((int(j), float(w)) for j, w in zip(order[:k], own)), key=lambda x: (-x[1], x[0])), value)
    return best[0]


_FOUND = "lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
_MIXTURE = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _verdicts(found: list[list[tuple[str, float]]]) -> list[pa.Array]:
    """The columns lang_pred, score and mixture."""
    pred = [x[0][0] if x else "und" for x in found]
    return [pa.array(pred, pa.string()), pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()), pa.array([[{"lang": k, "share": w} for k, w in x] for x in found], _MIXTURE)]


def _detected(sent, penalty: float):
    """(doc_id, more columns, lang_pred, score, mixture) from (doc_id, text, lettered, more columns), the whole model at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Part = sent.value
        for b in batches:
            lettered, found = b.column(2).to_pylist(), [[] for _ in range(b.num_rows)]
            for row, buf, offsets in blocks(b.column(1)):
                for i in range(len(offsets) - 1):
                    if lettered[row + i]:
                        bins, counts = features(buf[offsets[i] : offsets[i + 1]])
                        own, p = candidates(bins, counts, part)
                        found[row + i] = [(part.names[own[j]], w) for j, w in decide(p, counts, penalty)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[3:], *_verdicts(found)], names=["doc_id", "text", *b.schema.names[3:], "lang_pred", "score", "mixture"])

    return run


_CANDIDATE = "lang:string,p:array<double>"


def _proposed(sent, counted: bool):
    """The candidates of a part of the model: (doc_id, text_hash, counts, candidates) for texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Part = sent.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("p", pa.list_(pa.float64()))]))
        for b in batches:
            for row, buf, offsets in blocks(b.column(2)):
                n, proposed = [], []
                for i in range(len(offsets) - 1):
                    bins, counts = features(buf[offsets[i] : offsets[i + 1]])
                    own, p = candidates(bins, counts, part)
                    n.append(counts if counted else None)
                    proposed.append([{"lang": part.names[k], "p": x} for k, x in zip(own, p)])
                same = b.slice(row, len(n))
                yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), pa.array(n, pa.list_(pa.float64())), pa.array(proposed, kind)], names=["doc_id", "text_hash", "counts", "candidates"])

    return run


def _decided(penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                by_name = sorted({x["lang"]: x["p"] for x in row.column(3)[0].as_py()}.items())
                chosen = decide(np.array([p for _, p in by_name]), np.array(row.column(2)[0].as_py()), penalty)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), *_verdicts([[(by_name[j][0], w) for j, w in chosen]])], names=["doc_id", "text_hash", "lang_pred", "score", "mixture"])

    return run


def detect(docs: DataFrame, model: Model, penalty: float = 3.0, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns of `carry`, lang_pred, score, mixture): one row per row of `docs`, other columns ignored.

    mixture is an array of (lang, share), largest first; lang_pred is the first and score its share.  A null text, one
    without a letter, and every text if no language was learned: `und`, score 0, empty mixture.  Ties go to the language
    that sorts first.  Whole texts of any length are used, piece by piece.  Repeated rows come out as often, equal texts
    with equal results; an empty table gives no rows."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry if c != text_col)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lettered.alias("__lettered"), *(F.col(c) for c in carry if c != text_col))
    names = ("doc_id", *("text" if c == text_col else c for c in carry))
    if not model.passes:
        return given.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<struct<lang:string,share:double>>").alias("mixture"))
    if len(model.passes) == 1:
        sent = spark.sparkContext.broadcast(Part.of(model, *model.passes[0]))
        return given.mapInArrow(_detected(sent, penalty), f"doc_id {kind}, text string{kinds}, {_FOUND}").select(*names, "lang_pred", "score", "mixture")
    every = None
    for k, (low, high) in enumerate(model.passes):
        sent = spark.sparkContext.broadcast(Part.of(model, low, high))
        keyed = given.where("__lettered").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        own = written(keyed.mapInArrow(_proposed(sent, k == 0), f"doc_id {kind}, text_hash long, counts array<double>, candidates array<struct<{_CANDIDATE}>>"), "candidates")
        sent.unpersist()
        every = own if every is None else every.unionByName(own)
    met = every.groupBy("doc_id", "text_hash").agg(F.first("counts", ignorenulls=True).alias("counts"), F.flatten(F.collect_list("candidates")).alias("candidates"))
    found = met.mapInArrow(_decided(penalty), f"doc_id {kind}, text_hash long, {_FOUND}").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    out = given.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    return out.select(*names, F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("mixture", F.array().cast("array<struct<lang:string,share:double>>")).alias("mixture"))
