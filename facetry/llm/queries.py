"""The numbered queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, fim, jaccard, langid, line_dedup, quality, simhash, spelling, substring, token_counts
from .common import documents, ready

#: The vocabulary that tokens are counted and encoded with; a parameter, as the file is not part of this library.
VOCABULARY = "byte_bpe_50k.json"


def held_out(doc_id="doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def vocabulary() -> str:
    return bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = documents(spark, sf_dir, "labels").where(~held_out())
    model = quality.train(quality.sample(docs, labels))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_chats(turns.unionByName(extra))
    read = chat.read_back(F.col("formatted"))
    each = F.array_join(F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select(
        "conv_id", F.size(read).cast("long").alias("n_turns"), F.sha2(each, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def passages_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents without their benchmark passages, others as they are."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = decontaminate.remove_spans(docs, decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark")))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(~held_out()))
    return langid.detect(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(documents(spark, sf_dir), vocabulary()))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, words = documents(spark, sf_dir), vocabulary()
    out = bpe.decode(bpe.encode(docs, words, bpe.build_lexicon(docs, words)), words)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_sets(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(documents(spark, sf_dir)).drop("output")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


_ALL = (op1_quality_classifier, op2_chat_formatting, op3_simhash_near_dedup, op4_decontamination, op5_language_id, op6_exact_dedup, op7_token_counts, op8_bpe, op9_substring_dedup, op10_line_dedup, op11_jaccard_join, op12_fill_in_middle, op13_spelling_variants, passages_removed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def called(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: called(f) for f in _ALL}


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL = {
    "op2_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
        sized AS (
            SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '#', '#\'), '<', '<\'), ':', ':\')) AS n,
                length(replace(replace(replace(replace(role, '\', '\\'), '#', '#\'), '<', '<\'), ':', ':\')) AS m,
                lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
            CAST(sum(4 + m + 2 + n + 9) AS BIGINT) AS formatted_chars,
            last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AND bool_and(
                role = CASE before WHEN 'system' THEN 'user' WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'user' END
                OR (before IS NULL AND role = 'system')) AS valid
        FROM sized GROUP BY conv_id""",
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(FOLD_TEXT, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(FOLD_TEXT, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item, k, array_to_string(w[a : a + k - 1], ' ') AS s
            FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS a FROM sized)),
        lengths AS (SELECT DISTINCT k FROM windows),
        starts AS (
            SELECT doc_id, k, a, array_to_string(w[a : a + k - 1], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS a FROM d, lengths WHERE len(w) >= k)),
        hits AS (SELECT doc_id, item, k, a FROM starts JOIN windows USING (k, s)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(a, a + k - 1)) AS p FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
        SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= coalesce(len(w), 0) AS contaminated
        FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items x USING (doc_id)""".replace("FOLD_TEXT", _FOLD.format("coalesce(text, '')")),
    "passages_removed": r"""
        WITH d AS (
            SELECT doc_id, text, regexp_extract_all(FOLD_TEXT, 'W+') AS w, regexp_extract_all(coalesce(text, ''), 'S*W+') AS pieces, regexp_extract(coalesce(text, ''), 'S*$') AS rest FROM documents),
        sized AS (SELECT w, least(13, len(w)) AS k FROM (SELECT regexp_extract_all(FOLD_TEXT, 'W+') AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT k, array_to_string(w[a : a + k - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS a FROM sized)),
        starts AS (
            SELECT doc_id, k, a, array_to_string(w[a : a + k - 1], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS a FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
        hit AS (SELECT DISTINCT doc_id, unnest(generate_series(a, a + k - 1)) AS p FROM starts SEMI JOIN windows USING (k, s)),
        gone AS (SELECT doc_id FROM hit JOIN d USING (doc_id) GROUP BY doc_id, len(w) HAVING 20 * count(*) >= len(w)),
        every AS (SELECT doc_id, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS p FROM d SEMI JOIN gone USING (doc_id)),
        marked AS (SELECT e.*, h.p IS NOT NULL AS hit, lag(h.p IS NOT NULL, 1, false) OVER (PARTITION BY e.doc_id ORDER BY e.p) AS before FROM every e LEFT JOIN hit h ON h.doc_id = e.doc_id AND h.p = e.p),
        kept AS (SELECT doc_id, string_agg(CASE WHEN hit AND before THEN '' WHEN hit THEN regexp_extract(piece, '^S*') ELSE piece END, '' ORDER BY p) AS t FROM marked GROUP BY doc_id)
        SELECT doc_id, CAST(length(CASE WHEN kept.t IS NULL THEN text ELSE kept.t || rest END) AS BIGINT) AS n_chars, sha256(CASE WHEN kept.t IS NULL THEN text ELSE kept.t || rest END) AS text_sha256
        FROM d LEFT JOIN kept USING (doc_id)""".replace("FOLD_TEXT", _FOLD.format("coalesce(text, '')")).replace("W+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").replace("S*", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"),
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, a, md5(array_to_string(w[a : a + 34], ' ')) AS s
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS a FROM d WHERE len(w) >= 35)),
        twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, a + 34)) AS p FROM windows SEMI JOIN twice USING (s)),
        each_word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS p
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (SELECT *, FOLD_LINE AS k FROM lines),
        common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT doc_id, line, p, common.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""".replace("FOLD_LINE", _FOLD.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")),
    "op11_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(FOLD_TEXT, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[a : a + 4], ' ')) AS x
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS a FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
        sized AS (SELECT doc_id, x, n FROM sets JOIN sizes USING (doc_id)),
        links AS (
            SELECT a.doc_id AS i, b.doc_id AS j FROM sized a JOIN sized b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n
            GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach(node, low) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT j, low FROM reach JOIN links ON i = node)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
        FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN (SELECT node, min(low) AS component FROM reach GROUP BY 1) ON node = d.doc_id""".replace("FOLD_TEXT", _FOLD.format("coalesce(text, '')")),
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        seeded AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS p, CAST('0x' || h[25:32] AS BIGINT) % 100 AS q FROM d),
        formed AS (
            SELECT *, least(x, y) AS a, greatest(x, y) AS b,
                CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM seeded),
        parts AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM formed)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM parts""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
