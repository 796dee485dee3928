"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

The features of a text are the hashed words and word pairs, and the same of their shapes (which kinds of characters a
word holds); a pair of equal words also counts as a repetition.  Each counts as its share of the words.  Training deals
a bounded sample of labelled rows to a fixed number of shards, each runs FTRL-proximal over its rows and the weights are
averaged.  A score is a sparse dot product: the mean of the weights that a text's n-grams select.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, U, blocks, byte_table, grams, mix, small, words

FEATURES_LOG2 = 18
FEATURES = 1 << FEATURES_LOG2
#: Labelled rows that are fitted at most (those with the smallest hashes of their ids), and the shards they are dealt to.
MOST_ROWS, SHARDS = 24_000, 8
#: Bytes of their texts that are fitted at most, about, and of one text: longer texts are not learned from.
MOST_BYTES, LONGEST_BYTES = 64 << 20, 1 << 18
#: What a share of all words is worth: the scale of the inputs.
SCALE = 4.0
_TABLE = byte_table(NOT_SPACE, fold=True)


def _kinds() -> np.ndarray:
    """Bits for the kinds of characters: small and capital letters, digits, beyond ASCII, and twelve sorts of marks."""
    k = np.zeros(256, np.uint16)
    k[33:127] = [1 << (4 + i % 12) for i in range(94)]
    k[97:123], k[65:91], k[48:58], k[128:] = 1, 2, 4, 8
    return k


_KINDS = _kinds()


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of each n-gram of a block's texts, and the words in each row."""
    s, _, row, h = words(buf, offsets, _TABLE)
    n = np.bincount(row, minlength=len(offsets) - 1)
    if not len(s):
        return row, np.zeros(0, np.int64), n
    shape = mix(np.bitwise_or.reduceat(_KINDS[buf], s).astype(U) + U(1 << 40))
    inside = row[1:] == row[:-1]
    again = np.where(h[1:] == h[:-1], U(1), U(2))  # one feature for all repetitions, one for all other pairs
    key = np.concatenate([h, shape, grams(h, 2)[inside], mix(grams(shape, 2))[inside], mix(again)[inside]])
    return np.concatenate([row, row, *[row[1:][inside]] * 3]), (key >> U(64 - FEATURES_LOG2)).astype(np.int64), n


@dataclass
class Model:
    bias: float
    weights: np.ndarray


def ftrl(texts: pa.Array, labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[float, np.ndarray]:
    """Bias and weights by FTRL-proximal, one row after another."""
    rows = []
    for _, buf, offsets in blocks(texts):
        row, f, n = features(buf, offsets)
        order = np.argsort(row, kind="stable")
        for own in np.split(f[order], np.cumsum(np.bincount(row, minlength=len(n)))[:-1]):
            rows.append(np.unique(own, return_counts=True))
        for k, total in enumerate(n, len(rows) - len(n)):
            at, c = rows[k]
            rows[k] = (np.append(at, FEATURES), np.append(c * (SCALE / max(1, total)), 1.0))
    z, q = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)

    def weight(at):
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(q[at])) / alpha + l2))

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(q[at] + g * g) - np.sqrt(q[at])) / alpha * w
            q[at] += g * g
    w = weight(np.arange(FEATURES + 1))
    return float(w[-1]), w[:-1]


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> Model:
    """Fits on the rows given, (shard, text, label); rows with a null label are left out, null texts are empty."""
    own = labelled.select("shard", F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label")).where("label is not null")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "label"], kind="stable").sample(frac=1, random_state=7)
        bias, w = ftrl(pa.array(rows["text"], pa.string()), rows["label"].to_numpy(), epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(at, FEATURES).astype("int32"), "weight": np.append(w[at], bias), "rows": len(rows)})

    fitted = own.groupBy("shard").applyInPandas(run, "feature int, weight double, rows long")
    table = fitted.groupBy("feature").agg(F.sum(F.col("weight") * F.col("rows")).alias("w"), F.sum(F.when(F.col("feature") == FEATURES, F.col("rows"))).alias("rows")).toPandas()
    weights = np.zeros(FEATURES + 1)
    if len(table):
        weights[table["feature"].to_numpy()] = table["w"].to_numpy() / table["rows"].sum()
    return Model(float(weights[-1]), weights[:-1].astype(np.float32))


def sample(documents: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = MOST_ROWS, size: int = MOST_BYTES, longest: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, text, label) of at most `rows` labelled documents with about `size` bytes of text: a bounded set of ids, so
    the texts are not shuffled to find them.  Documents without a label, and labels without a document, are left out; a
    text of more than `longest` bytes (LONGEST_BYTES) as well; an id that is repeated in either table is a row for each match."""
    own = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__of"), F.col(label_col).alias("label"))
    n = own.count()
    if n > rows:  # by hash, a little less than the bound, which the limit then never has to enforce but for repeated ids
        own = own.where(F.pmod(F.xxhash64("__of"), F.lit(1 << 40)) < int(0.95 * rows / n * (1 << 40)))
    ids = own.limit(rows)
    met = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(small(ids, 40), F.col("__id") == F.col("__of"))
    met = met.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= (LONGEST_BYTES if longest is None else longest))
    total = met.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > size:
        met = met.where(F.pmod(F.xxhash64("__id", F.lit(2)), F.lit(1 << 40)) < int(size / total * (1 << 40)))
    return met.select(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"), "text", "label")


#: Bytes of a text whose features are in memory at once.
PIECE = 4 << 20


def long_dot(text: np.ndarray, weights: np.ndarray) -> tuple[float, int]:
    """The sum of the weights that a long text's n-grams select, and its words, piece by piece."""
    dot, n, at, before = 0.0, 0, 0, b""
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _TABLE[text[end]]:
            gap = np.flatnonzero(_TABLE[text[end : end + 65536]] == 0)
            end = end + int(gap[0]) if len(gap) else min(len(text), end + 65536)
        piece, at = text[at:end], end
        own = piece.tobytes().strip()
        if not own:
            continue
        _, f, count = features(piece, np.array([0, len(piece)]))
        dot, n = dot + float(weights[f].sum(dtype=np.float64)), n + int(count[0])
        if before:  # the pair of words that meet between two pieces: what two words have beyond themselves and their shapes
            both = np.frombuffer(before + b" " + own.split(None, 1)[0], np.uint8)
            dot += float(weights[features(both, np.array([0, len(both)]))[1][4:]].sum(dtype=np.float64))
        before = own.rsplit(None, 1)[-1]
    return dot, n


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row of `docs`, extra columns ignored; a text without words (empty, null) gets the bias's
    score.  Whole texts of any length are scored; repeated rows come out as often, equal texts with equal scores; an
    empty table gives no rows."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for row, buf, offsets in blocks(b.column(1)):
                if len(buf) > PIECE:
                    for i in range(len(offsets) - 1):
                        dot, n = long_dot(buf[offsets[i] : offsets[i + 1]], m.weights)
                        out[row + i] = dot * SCALE / max(n, 1)
                    continue
                at, f, n = features(buf, offsets)
                dot = np.bincount(at, weights=m.weights[f], minlength=len(n))
                out[row : row + len(n)] = dot * SCALE / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + m.bias, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
