"""The corpus pipeline: five stages over `documents`, each on all that the one before has kept.

Stages keep every column of the table that they are given, whatever its name; those they work on are doc_id, text, lang
and n_chars.  Names that they add on the way are made so that they clash with none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import bpe, decontaminate, langid, line_dedup, simhash
from facetry.llm.common import by_id, documents, ready, small, written
from facetry.llm.queries import held_out, vocabulary


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns in one, so none of their names meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).dropFields("text").alias("rest"))


def _unpacked(out: DataFrame, like: DataFrame, **changed: str) -> DataFrame:
    """The columns of `like`, from a packed frame; `changed` are read from columns of `out`."""
    own = {"text": "text", **changed}
    return out.select(*(F.col(own[c]).cast(like.schema[c].dataType).alias(c) if c in own else F.col("rest").getField(c).alias(c) for c in like.columns))


def _named(packed: DataFrame) -> DataFrame:
    """What tells rows apart: id and a hash of the text, so rows that repeat an id, or have none, are judged on their own."""
    return packed.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("doc_id"), "text", "rest")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: Sequence[str] | None = None, least: float = 0.5) -> DataFrame:
    """Keeps the documents with a main language: the model's `lang_pred`, with a share of at least `least`, and one of
    `wanted` (None: any learned one).  `lang` becomes what the model says.  Null texts, texts without a letter and mixtures
    in which no language holds that share go.  Repeated rows are kept or go together; an empty table stays empty."""
    ready(spark)
    model = langid.train(docs.where(~held_out()))
    found = langid.detect(_packed(docs), model, carry=("text", "rest"))
    keep = (F.col("lang_pred") != "und") & (F.col("score") >= least)
    return _unpacked(found.where(keep & F.col("lang_pred").isin(*wanted) if wanted is not None else keep), docs, lang="lang_pred")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text.  A document keeps its row even if nothing else is left of it; a null
    text becomes empty.  Rows that repeat an id count as one document and keep their lines alike; an empty table stays empty."""
    ready(spark)
    out = line_dedup.dedup_lines(_packed(docs), carry=("rest",)).withColumn("n_chars", F.length("text"))
    return _unpacked(out, docs, n_chars="n_chars")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id (rows without an id come last) and,
    among rows that repeat it, the smallest hash of the text; of rows that repeat both, the one whose columns come first as JSON.  Null and empty texts are
    one group.  An empty table stays empty."""
    ready(spark)
    packed = _named(_packed(docs))
    plain = packed.select(F.col("doc_id.id").alias("doc_id"), "text", F.col("doc_id").alias("name"))
    rows = written(simhash.near_duplicates(plain, carry=("name",)).select("component", "name"), "near-duplicates")
    # one row a name with how often it comes; the first of a group's names stays
    first = F.min(F.struct(F.col("name.id").isNull().alias("none"), F.col("name.id").alias("id"), F.col("name.hash").alias("hash")))
    groups = rows.groupBy("component").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select(F.col("component").alias("of"), F.struct("first.id", "first.hash").alias("keeper")), "groups")
    met = rows.join(small(groups, 32), F.col("component") == F.col("of"))
    verdicts = met.groupBy("name").agg(F.count("*").alias("n"), F.first(F.col("name") != F.col("keeper")).alias("gone")).where("gone or n > 1")
    verdicts = written(verdicts.withColumnRenamed("name", "doc_id"), "verdicts")
    marked = by_id(packed, small(verdicts, 40))
    kept = marked.where("not coalesce(gone, false)")
    out = kept.where("n is null").select("doc_id", "text", "rest")
    if not verdicts.where("not gone").isEmpty():  # rows that come more than once
        repeated = kept.where("n > 1").select("doc_id", "text", "rest")
        first = F.min_by(F.struct("text", "rest"), F.to_json(F.struct("text", "rest"))).alias("x")
        out = out.unionByName(repeated.groupBy("doc_id").agg(first).select("doc_id", "x.text", "x.rest"))
    return _unpacked(out, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, passages_only: bool = False, longest: int = 1 << 30) -> DataFrame:
    """Drops documents that benchmark windows cover to a twentieth or more.

    passages_only: they stay, without the passages; so do other documents, without passages of `longest` words or more;
    n_chars follows the text.  Null and empty texts have no passages; repeated rows fare alike; empty tables are fine."""
    ready(spark)
    packed = _packed(docs)
    found = decontaminate.decontaminate(packed, documents(spark, sf_dir, "benchmark"))
    if passages_only:
        out = decontaminate.remove_spans(packed, found, longest)
        return _unpacked(out.withColumn("n_chars", F.length("text")), docs, n_chars="n_chars")
    key = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("doc_id")
    names = written(found.where("contaminated").select(key).distinct(), "verdicts")
    return _unpacked(by_id(_named(packed), small(names, 32), how="left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): what a trainer reads; ids are little-endian unsigned 32-bit integers.  One row a row; a null
    or empty text has no ids; an empty table gives no rows."""
    ready(spark)
    words = vocabulary()
    return bpe.encode(docs, words, bpe.build_lexicon(docs, words))


STAGES = [("language ID", identify_languages), ("line dedup", dedup_lines), ("SimHash near-dedup", dedup_near), ("benchmark decontamination", drop_contaminated), ("BPE encoding", encode)]
#: Language ID, SimHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written to the shared folder and read again."""
    ready(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
