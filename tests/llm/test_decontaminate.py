"""Benchmarks of very many chunks: one scan of the documents, results as with one chunk."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import decontaminate
from facetry.llm.queries import oracle_sql, queries


def tables(spark, folder):
    r = random.Random(9)
    draw = lambda n: " ".join(f"w{r.randrange(700)}" for _ in range(n))
    items = [(f"i{k}", draw(r.choice((1, 2, 5, 12, 13, 14, 60, 200)))) for k in range(300)]
    rows = []
    for k in range(150):
        own = r.choice(items)[1].split()
        a = r.randrange(len(own))
        rows.append((k, f"{draw(r.randint(0, 300))}, {' '.join(own[a : a + 40]).upper()}! {draw(r.randint(0, 300))}"))
    rows += [(k, " ".join(t for _, t in items[:40])) for k in (7, 8, 9)] * 2 + [(200, None), (None, items[5][1]), (201, "x" * 5000 + " " + items[6][1]), (202, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents")
    return spark.read.parquet(f"{folder}/documents"), spark.createDataFrame(items, "item_id string, text string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("bench"))


def rows_of(df):
    return Counter((r["doc_id"], r["text_hash"], r["n_words"], r["n_hit"], tuple(map(tuple, r["spans"] or ())), tuple(r["items"]), r["contaminated"]) for r in df.collect())


@pytest.mark.parametrize("least", [1, 2, 13])
def test_a_hundred_chunks_are_one_scan(spark, made, monkeypatch, least):
    docs, bench = made
    bench = bench.where(F.size(F.split("text", " ")) >= least)
    want = rows_of(decontaminate.decontaminate(docs, bench))
    size = bench.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", size // 100)
    monkeypatch.setattr(decontaminate, "TASK_RUNS", 20)
    seen = []
    own = decontaminate.written

    def watched(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("/documents"))
        return own(df, name)

    monkeypatch.setattr(decontaminate, "written", watched)
    out = decontaminate.decontaminate(docs, bench)
    assert sum(x > 0 for x in seen) == 1 and "/documents" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows_of(out) == want and sum(bool(k[3]) for k in want) > 40


def test_words_of_a_thousand_bytes(spark, monkeypatch):
    t = lambda a, b: "".join((a, b)[k.bit_count() & 1] for k in range(1024))
    lead = " ".join(f"v{k}" for k in range(12))
    bench = spark.createDataFrame([(1, f"{lead} {t('a', 'b')}"), (2, "z " * 2000 + "y" * (1 << 20))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{lead} {t('a', 'b')}"), (2, f"{lead} {t('b', 'a')}"), (3, "z " * 12 + "y" * (1 << 20)), (4, "z " * 12 + "y" * ((1 << 20) - 1))], "doc_id long, text string")
    for size in (decontaminate.CHUNK_BYTES, 1000):
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", size)
        assert {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(docs, bench).collect()} == {1: 13, 2: 0, 3: 13, 4: 0}


def test_bits_hold_each_pair(spark, monkeypatch):
    r = np.random.default_rng(3)
    pairs = r.integers(-(1 << 63), (1 << 63) - 1, 5000)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 18)
    bits = decontaminate.pair_bits(spark.createDataFrame([(int(x),) for x in pairs], "pair long"))
    level = (8 * len(bits)).bit_length() - 1
    at = (pairs.view(np.uint64) >> np.uint64(64 - level)).astype(np.int64)
    assert level == 17 and ((bits[at >> 3] >> (at & 7)) & 1).all() and int(np.bitwise_count(bits).sum()) == len(set(at.tolist()))


def test_passages_removed_have_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = queries()["passages_removed"](spark, sf_dir)
    want = con.execute(oracle_sql()["passages_removed"]).fetchdf()
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))
