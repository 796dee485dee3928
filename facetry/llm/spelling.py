"""Spelling variants by a symmetric-delete join.

Every distinct word emits a key for itself and one for each distinct word that a single deletion makes of it.  Words that
are one edit apart share a key: an inserted or deleted letter makes one word a deletion of the other, a replaced one
leaves both with the same deletion.  Keys are joined by equality, the pairs verified exactly, and only they are
aggregated.  A key is a hash, computed for all deletions of a word in one pass; a word of m letters takes m + 1 keys of
fixed size, so no list grows with the square of a word's length.  A key's group holds at most one word and its
insertions, so it is bounded by the alphabet and the word's length, whatever a word's frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, U, fold, mix, written

#: Maximal runs of these are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Of how many occurrences one is misspelt, by a hash of the document and the run.
EVERY = 31
_POWERS = Powers(0x9E3779B97F4A7C15)


def occurrences(docs: DataFrame, shortest: int, every: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of each run that leaves at least `shortest` letters: A-Z lower-cased and, for one in `every` (0: none), a
    letter deleted.  The greedy pattern matches whole runs only, as it starts at the first letter that it can."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.expr(f"regexp_extract_all({text_col}, '[{LETTERS}]{{{shortest},}}', 0)")).alias("run"))
    runs = runs.select("id", fold(F.col("run")).alias("run"))
    if not every:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    own = runs.select("run", h.alias("h"), F.length("run").alias("m"))
    at = F.pmod("h", "m").cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("m")))
    return own.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key) for each word itself and its distinct single deletions."""
    texts = words.to_pylist()
    length = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(U)
    end = np.cumsum(length)
    start = end - length
    up, down = _POWERS.of(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(mix(codes + U(1)) * up[:-1], out=total[1:])
    whole = (total[end] - total[start]) * down[start] + mix(length.astype(U))
    # deleting any letter of a run of equal ones gives the same word: the first of each stands for all
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    first[start[length > 0]] = True
    at = np.flatnonzero(first)
    of = np.searchsorted(end, at, side="right")
    a, b = start[of], end[of]
    left, right = (total[at] - total[a]) * down[a], (total[b] - total[at + 1]) * down[a] * _POWERS.inverse
    return np.concatenate((np.arange(len(texts)), of)), mix(np.concatenate((whole, left + right + mix((length[of] - 1).astype(U)))))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.cumsum(np.asarray(pc.utf8_length(b.column(1)), np.int64))
        at = 0
        while at < b.num_rows:  # about a million letters at once, or one word
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), side="right")))
            of, key = deletion_keys(b.column(1).slice(at, stop - at))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(at + of))], names=["key", "id"])
            at = stop


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of the words (word, n; distinct) that are one edit apart."""
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")
    keys = written(named.select("id", "word").mapInArrow(_keys, "key long, id long"), "deletions")
    a, b = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
    met = written(a.join(b, "key").where("a < b").select("a", "b").distinct(), "candidates")
    side = lambda p: named.select(*(F.col(c).alias(p + c) for c in ("id", "word", "n")))
    both = met.join(side("x_"), F.col("a") == F.col("x_id")).join(side("y_"), F.col("b") == F.col("y_id"))
    ok = written(both.where(F.levenshtein("x_word", "y_word", 1) == 1).select("x_word", "x_n", "y_word", "y_n"), "near-words")
    names = ("word", "n", "near", "near_n")
    return ok.toDF(*names).unionByName(ok.select("y_word", "y_n", "x_word", "x_n").toDF(*names))


def forms_of(pairs: DataFrame, times: int) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones; form is null unless it is `times` as frequent."""
    best = pairs.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    held = -F.col("best.less") >= times * F.col("n")
    return best.select("word", "n_near", F.when(held, F.col("best.form")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of (word, form): where following forms ends.  Each round halves what is left of a chain."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        up = now.select(F.col("word").alias("of"), F.col("root").alias("next"))
        now = written(now.join(up, F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each distinct word of `shortest` letters and `least` occurrences.

    Words are maximal runs of LETTERS in whole texts, A-Z lower-cased and nothing else; of one in `every` occurrences, by
    the CRC-32 of `<id>:<run>`, a letter is deleted first (0: none).  n counts a word's occurrences, n_near the words
    one inserted, deleted or replaced code point away, form is the most frequent of these (ties: the smallest in
    code-point order) if it is at least `times` as frequent as the word, form_n its n; root is where following forms
    ends, the word itself if it has none.

    Null and empty texts have no words; a null id counts as an empty one; rows that repeat, ids included, count each.
    An empty table gives no rows.  Words of any length are compared exactly.  Other columns are ignored."""
    if times < 2:
        raise ValueError("a form must be more frequent than its word: times is 2 at least")
    words = occurrences(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shortest, every)
    words = written(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), "words")
    forms = written(forms_of(near_pairs(words), times), "forms")
    roots = roots_of(forms.where("form is not null").select("word", "form"))
    met = words.join(forms, "word", "left").join(roots, "word", "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
