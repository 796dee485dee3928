"""Fill-in-middle against a plain version of its contract, and exact round trips."""

import hashlib
import random

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetry.llm import fim
from facetry.llm.queries import queries

FIELDS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h4 % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return doc_id, n, form, a, b - a, sha(out), sha(text)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    own = [None, "", "a", "\n", "é😀́x", "<P> in it", "ends <M>", "a<S", "P><", "\r\n\x00\x1f", "word " * 40000]
    own += ["".join(r.choice("ab <>PSM\n€😀") for _ in range(r.randint(0, 60))) for _ in range(300)]
    own = list(enumerate(own))
    return [*own, own[9], own[9], (None, "text of a row without an id"), (None, None), (-5, "negative"), (9007199254740993, "wide")]


def test_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, output string").repartition(3)
    out = fim.fill_in_middle(docs)
    key = lambda x: tuple((y is None, y) for y in x)
    want = sorted((brute(i, t) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in out.select(*FIELDS).collect()), key=key) == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    for r in out.collect():
        assert sha(r["output"]) == r["output_sha256"]
        assert sha(fim.restored(r["output"], r["form"])) == r["restored_sha256"]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_other_units_and_ids(spark):
    docs = spark.createDataFrame([("a", "one two  three\nfour ", 7), (None, "one", 8), ("z", None, 9)], "id string, body string, more int")
    out = {r["doc_id"]: r for r in fim.fill_in_middle(docs, unit=r"\S+\s*", plain_percent=0, spm_percent=100, id_col="id", text_col="body", carry=("more",)).collect()}
    assert out["a"]["n"] == 4 and out["a"]["form"] == "spm" and out["a"]["more"] == 7
    assert fim.restored(out["a"]["output"], "spm") == "one two  three\nfour "
    ends = {0, 4, 9, 15, 20}
    assert {out["a"]["prefix_chars"], out["a"]["prefix_chars"] + out["a"]["middle_chars"]} <= ends
    assert out["z"]["form"] == "plain" and out["z"]["output"] == "" and out[None]["n"] == 1


@given(st.text(), st.integers())
def test_round_trip(text, doc_id):
    own = fim.transformed(text.encode("utf-8", "ignore").decode(), doc_id, regex.compile(fim.CODE_POINTS), 0, 50, "1")
    assert own[5] == sha(own[4]) and own[6] == sha(text.encode("utf-8", "ignore").decode())


def test_query(spark, sf_dir):
    out = queries()["op12_fill_in_middle"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in out.select(*FIELDS).orderBy("doc_id").collect()) == sorted(brute(*r) for r in docs)
    assert out.where(F.col("form") == "spm").count() > 0
