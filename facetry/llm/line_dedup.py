"""Line deduplication with DataFrame functions only.

Lines travel as hashes: they are range-partitioned by hash with a secondary sort by document and position, the sorted
streams yield first occurrences, and what comes back to the documents is a compressed keep bitmap, never text.  A line
that many documents hold is dealt over SALTS parts, so it can fill as many ranges; each range streams its own parts, sums
them by line and sends one row for each line that it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, by_id, fold, small, written

#: More than the ranges that a third of all lines would fill on a large cluster; parts cost nothing, as ranges sum them.
SALTS = 4096


def line_key(line):
    """A line without white space at both ends and with A-Z lower-cased."""
    return fold(F.btrim(line, F.lit(SPACES)))


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words): the bitmap of each row that loses lines; other rows have none.  doc_id is (id, hash of the text).

    words is an array of (word, bits): bit b of word w is set where line 64 * w + b is dropped; words without a set bit
    are left out, which is the compression.  Null texts are one empty line.  Rows with the same id count as one document.
    Rows with a null id hold lines like one document that comes before all others."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("of"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    # folding keeps the length, so lines that are too short once stripped are never folded
    long = lines.where((F.length("line") >= least_chars) & (F.length(F.btrim("line", F.lit(SPACES))) >= least_chars))
    keys = long.select("doc_id", "of", "pos", line_key(F.col("line")).alias("key"))
    # 96 bits stand for a line: two hashes of other families
    hashed = written(keys.select("doc_id", "of", "pos", F.xxhash64("key").alias("h"), F.hash("key", F.length("key")).alias("g")), "lines")
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    dealt = salted.repartitionByRange("h", "g", "salt").sortWithinPartitions("h", "g", "salt", F.desc_nulls_last("doc_id"), "pos")
    stream = Window.partitionBy("h", "g", "salt").orderBy(F.desc_nulls_last("doc_id"), "pos")
    before = F.lag(F.struct("doc_id")).over(stream)
    first = dealt.withColumn("first", (before.isNull() | ~before["doc_id"].eqNullSafe(F.col("doc_id"))).cast("int"))
    parts = first.where("first = 1").groupBy("h", "g", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    found = parts.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= least_docs)
    common = written(found.select(F.col("h").alias("h2"), F.col("g").alias("g2"), "last"), "common-lines")
    own = small(common, 24)
    dropped = hashed.join(own, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2"))).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    bits = dropped.groupBy(F.struct(F.col("doc_id").alias("id"), "of").alias("doc_id"), F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return bits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


#: The sparse bitmap spread out, so that a line's word is found by its index.
_DENSE = """flatten(transform(words, (x, i) -> concat(
    array_repeat(0L, x.word - if(i = 0, 0, words[i - 1].word + 1)), array(x.bits))))"""
_KEPT = "filter(split(coalesce(text, ''), '\n'), (x, i) -> coalesce(getbit(get(dense, shiftright(i, 6)), i & 63), 0) = 0)"


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each row of `docs` with the lines that stay, joined by newlines.

    Keys of at least least_chars code points in at least least_docs documents lose all lines but those in the document
    with the largest id.  n_lines counts the lines before; a null text counts as empty.  Documents keep their row even
    when all lines go.  Columns named in `carry` come along; other columns are ignored.  Ids keep their type.  Rows that
    repeat an id lose and keep their lines as one document does.  An empty table gives no rows; a text of any length is one
    value, as is the array of its lines."""
    maps = written(keep_bitmaps(docs, least_chars, least_docs, id_col, text_col), "bitmaps")
    base = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of")).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in carry))
    marked = by_id(base, small(maps, 64, "24 * size(words)")).withColumn("dense", F.expr(_DENSE))
    kept = F.expr(_KEPT)
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return marked.select(
        F.col("doc_id.id").alias("doc_id"),
        F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
        n.alias("n_lines"),
        F.expr("coalesce(aggregate(words, 0L, (n, x) -> n + bit_count(x.bits)), 0L)").alias("n_dropped"),
        *carry,
    )
