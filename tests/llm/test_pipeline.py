"""The pipeline's stages, each on a table with odd rows, against brute force; and the whole run."""

from collections import Counter

import numpy as np
import pytest
from test_text_operators import brute_groups, brute_hits, brute_lines, brute_print, some_languages, texts

import corpus_pipeline

#: With columns that bear names of the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, of string, row_name string, component long, rest string, __hash long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "of", "row_name", "component", "rest", "__hash"]


@pytest.fixture(scope="module")
def rows():
    more = ("a", "b", 3, "c", 4)
    own = [(k, t, "en" if k % 2 else "fr", "s", None if t is None else len(t), *more) for k, t in enumerate(texts())]
    return [*own, own[20], own[26], (26, "another text under the same id", "en", None, 3, *more), (None, texts()[12], *[None] * 8), (None, "all alone here", *[None] * 8), (None, "all alone here", *[None] * 8), (None, *[None] * 9)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    t = [x or "" for x in texts()]
    own = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, t[11]), (2, None)], "item_id long, text string").write.parquet(f"{own}/benchmark.parquet")
    return own


def stage(name, spark, docs, folder):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    return out.columns, Counter(tuple(r) for r in out.collect())


def test_language(spark, docs, rows, folder):
    columns, have = stage("language ID", spark, docs, folder)
    assert columns == COLUMNS
    from facetry.llm import langid
    from facetry.llm.queries import held_out

    found = {(r["doc_id"], r["text"]): r for r in langid.detect(docs, langid.train(docs.where(~held_out())), carry=("text",)).collect()}
    verdict = lambda r: found[r[0], r[1]]
    want = Counter((*r[:2], verdict(r)["lang_pred"], *r[3:]) for r in rows if verdict(r)["lang_pred"] != "und" and verdict(r)["score"] >= 0.5)
    assert have == want and sum(have.values()) < len(rows)
    own = {r[1] for r in corpus_pipeline.identify_languages(spark, docs, folder, wanted=["fr"]).collect()}
    assert own == {r[1] for r in want if r[2] == "fr"}


def test_the_model_decides_on_language(spark, folder):
    """Texts that no pattern tells apart: of languages that are not wanted, and of three languages at once."""
    names, say = some_languages(4)
    known = [(1000 + k, say(k % 4, 60), names[k % 4], "s", 1) for k in range(60)]
    rows = [(k, say(k, 50), None, "s", 1) for k in range(4)] + [(10, f"{say(0, 40)} {say(1, 40)} {say(2, 40)}", None, "s", 1), (11, f"{say(0, 50)} {say(1, 20)}", None, "s", 1)]
    docs = spark.createDataFrame([*known, *rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_languages(spark, docs, folder).where("doc_id < 1000").collect()}
    assert out == {0: names[0], 1: names[1], 2: names[2], 3: names[3], 11: names[0]}
    assert {r["doc_id"] for r in corpus_pipeline.identify_languages(spark, docs, folder, wanted=names[1:3]).where("doc_id < 1000").collect()} == {1, 2}
    assert {r["doc_id"] for r in corpus_pipeline.identify_languages(spark, docs, folder, least=0.9).where("doc_id < 1000").collect()} == {0, 1, 2, 3}


def test_lines(spark, docs, rows, folder):
    columns, have = stage("line dedup", spark, docs, folder)
    assert columns == COLUMNS
    want = Counter()
    for (i, t, _, _), n in brute_lines(rows).items():
        want[i, t] += n
    assert Counter({(r[0], r[1]): 0 for r in have}) == Counter({k: 0 for k in want})
    assert all(r[4] == len(r[1]) for r in have) and sum(have.values()) == len(rows)


def test_near(spark, docs, rows, folder):
    columns, have = stage("SimHash near-dedup", spark, docs, folder)
    assert columns == COLUMNS
    prints = [(k, brute_print(r[1])) for k, r in enumerate(rows)]
    groups = {}
    for k, _, c in brute_groups(prints):
        groups.setdefault(c, []).append(rows[k])
    best = {c: min((r[0] is None, r[0] or 0) for r in g) for c, g in groups.items()}
    assert sum(have.values()) == len(groups) and all(n == 1 for n in have.values())
    for r in have:
        own = [c for c, g in groups.items() if r in g]
        assert len(own) == 1 and (r[0] is None, r[0] or 0) == best[own[0]]


def test_benchmark(spark, docs, rows, folder):
    columns, have = stage("benchmark decontamination", spark, docs, folder)
    assert columns == COLUMNS
    items = [(1, texts()[11]), (2, None)]
    hit = lambda r: next(iter(brute_hits([r], items)))
    assert have == Counter(r for r in rows if not hit(r)[4]) and sum(have.values()) < len(rows)
    cut = corpus_pipeline.drop_contaminated(spark, docs, folder, passages_only=True).collect()
    assert len(cut) == len(rows) and all(not hit(r)[4] for r in cut) and cut[0].__fields__ == COLUMNS
    assert Counter(tuple(r) for r in cut if r["text"] in {x[1] for x in rows}) >= Counter(r for r in rows if r[1] and not hit(r)[2] and r[4] == len(r[1]))


def test_encoding(spark, docs, rows, folder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    columns, have = stage("BPE encoding", spark, docs, folder)
    assert columns == ["doc_id", "n_tokens", "ids"]
    ids = [np.array(t.encode(r[1] or "", add_special_tokens=False).ids, "<u4") for r in rows]
    assert {(k[0], k[1], bytes(k[2])): n for k, n in have.items()} == Counter((r[0], len(i), i.tobytes()) for r, i in zip(rows, ids))


def test_empty_tables(spark, docs, folder):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), folder).count() == 0, name


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    n = out.count()
    assert 100 < n < spark.read.parquet(f"{sf_dir}/documents.parquet").count() and out.select("doc_id").distinct().count() == n
    assert out.where("n_tokens * 4 <> length(ids)").count() == 0
