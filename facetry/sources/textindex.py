"""An index of text for searches by words: trigram postings in a table that is partitioned by trigram.

A search word that a text holds lies within one of its words, so all trigrams of the search word are among the text's.
Postings (trigram, key) are written in buckets of trigrams, each a folder; a search reads the folders of a few of its
trigrams, the rarest by a table of counts, and keeps the keys that are in all of their lists.  They are candidates: the
search itself is still applied to their texts, so results are the same as without an index."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import shared

#: Buckets of an index unless asked otherwise, lists that a search intersects, letters of a text that are cut at once, and
#: parts that lists are dealt to: this many of a bucket at least, and this many in all.
BUCKETS, LISTS, PIECE, SHARES, LEAST = 256, 3, 65_536, 16, 256
_RUN = re.compile(r"[\x21-\x7e]{3,}")


def trigrams_of(search: str) -> list[str]:
    """The trigrams that a text must hold if it holds each word of a search: those of its ASCII parts, whose lower case is
    the same in any place."""
    found = (run[k : k + 3].lower() for token in search.split() for run in _RUN.findall(token) for k in range(len(run) - 2))
    return list(dict.fromkeys(found))


def _bucket(trigram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(buckets)).cast("int")


def postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """(trigram, key) of the trigrams that a search can ask for, those of ASCII letters; texts are cut in pieces that overlap
    by two letters, and each piece tells its trigrams once."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(column) - 2), F.lit(PIECE - 2))
    pieces = df.where(F.length(column) >= 3).select(F.col(key).alias("key"), F.explode(F.transform(starts, lambda at: F.substring(column, at, F.lit(PIECE)))).alias("piece"))
    each = F.regexp_extract_all(F.lower("piece"), F.lit(r"(?=([\x21-\x7e]{3}))"), F.lit(1))
    return pieces.select(F.explode(F.array_distinct(each)).alias("trigram"), "key")


@dataclass(frozen=True)
class TextIndex:
    """A written index of one text column: its folder, and the buckets of it."""

    spark: SparkSession
    folder: str
    buckets: int

    @classmethod
    def build(cls, df: DataFrame, key: str, column: str, folder: str | None = None, buckets: int = BUCKETS) -> TextIndex:
        """Writes the index of a frame's texts under `folder` (None: one in the shared folder).  Null texts are in no list."""
        spark = df.sparkSession
        folder = folder or f"{shared(spark)}/store/text-{uuid.uuid4().hex}"
        share = F.pmod(F.hash("key"), F.lit(max(SHARES, LEAST // buckets)))
        rows = postings(df, key, column).select("trigram", "key", _bucket(F.col("trigram"), buckets).alias("bucket"), share.alias("share"))
        # a list may be of any length, so a bucket is dealt out in shares of its keys, and texts are read once; files are in order of trigrams
        dealt = rows.repartition("bucket", "share").distinct().drop("share").sortWithinPartitions("bucket", "trigram", "key")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        own = spark.read.schema(cls._schema(df, key)).parquet(f"{folder}/postings")
        counts = own.groupBy("bucket", "trigram").agg(F.count("*").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "trigram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/counts")
        return cls(spark, folder, buckets)

    @staticmethod
    def _schema(df: DataFrame, key: str) -> str:
        return f"trigram string, key {df.schema[key].dataType.simpleString()}, bucket int"

    def _at(self, table: str, trigrams: list[str]) -> DataFrame:
        """A table's rows of some trigrams, from their buckets' folders only."""
        numbers = self.spark.range(1).select(*(_bucket(F.lit(t), self.buckets) for t in trigrams)).first()
        df = self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}")
        return df.where(F.col("bucket").isin(*set(numbers)) & F.col("trigram").isin(*trigrams))

    def candidates(self, search: str) -> DataFrame | None:
        """(key) of the texts that may hold each word of a search; None if the index can't tell."""
        asked = trigrams_of(search)
        if not asked:
            return None
        n = {r["trigram"]: r["n"] for r in self._at("counts", asked).select("trigram", "n").collect()}
        rarest = sorted(asked, key=lambda t: n.get(t, 0))[:LISTS]
        held = self._at("postings", rarest)
        if not n.get(rarest[0]):
            return held.select("key").limit(0)
        return held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("key")
