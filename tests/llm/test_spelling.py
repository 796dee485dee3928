"""Spelling variants against a brute-force version of the contract."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.llm import spelling
from facetry.llm.queries import queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(rows):
    n = brute_words(rows)
    near = {w: [] for w in n}
    by = sorted(n, key=len)
    for i, a in enumerate(by):
        for b in by[i + 1 :]:
            if len(b) > len(a) + 1:
                break
            if apart_by_one(a, b):
                near[a].append(b), near[b].append(a)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    stems = ["".join(r.choice("abcdéÿà") for _ in range(r.randint(6, 10))) for _ in range(40)] + ["aaaaaaaa", "Government", "GOVERNMENT", "ab×cdefgh"]
    long = ["x" * 200, "xy" * 100, "z" * 3000, "q" * 64, "q" * 65, "".join(r.choice("abc") for _ in range(900))]
    long += [long[-1][:400] + long[-1][401:], long[-1][:700] + "é" + long[-1][701:], "q" * 66]
    rows = [(None, None), (1, ""), (2, " \n\t 123 !!"), (3, "short Ok"), (4, "Government " * 300), (5, "GOVERNMEnt goverment govermennt gavernment " * 2), (6, "governmënt " * 40), (None, "gouvernment " * 4), (7, "×÷" * 10 + "_" + "a" * 9), (8, "mmmmmmmm " * 900 + "mmmmmmmn " * 60 + "mmmmmmnn " * 4)]
    for k in range(10, 400):
        words = []
        for _ in range(r.randint(1, 60)):
            w = r.choice(stems)
            for _ in range(r.choice((0, 0, 0, 1, 2))):
                i = r.randrange(len(w))
                w = r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abé") + w[i + 1 :]))
            words.append(w)
        rows.append((k, r.choice((" ", "-", "1")).join(words)))
    rows += [(500 + k, " ".join(long)) for k in range(3)]
    return [*rows, rows[12], rows[12]]


def test_variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, word string, form string, n int").repartition(5)
    want = brute(rows)
    out = [tuple(x) for x in spelling.spelling_variants(docs).select(*COLUMNS).collect()]
    assert len(out) == len(set(out)) and set(out) == want
    chains = {w: f for w, f, *_ in want if f}
    assert any(f in chains for f in chains.values()) and any(len(w) > 800 and k for w, _, _, _, k, _ in want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_no_noise_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "Spellings spellings speling"), ("b", "spelings spelings")], "id string, body string")
    out = {r["word"]: r for r in spelling.spelling_variants(docs, shortest=8, times=2, every=0, id_col="id", text_col="body").collect()}
    assert set(out) == {"spellings", "spelings"} and out["spellings"]["n_near"] == 1 and out["spelings"]["form"] is None
    with pytest.raises(ValueError, match="times"):
        spelling.spelling_variants(docs, times=1, id_col="id", text_col="body")


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("v", "w30")], "word string, form string")
    out = {r["word"]: r["root"] for r in spelling.roots_of(forms).collect()}
    assert set(out.values()) == {"w37"} and len(out) == 38


@settings(max_examples=200)
@given(st.lists(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=12, unique=True))
def test_keys_meet_where_words_are_one_edit_apart(words):
    of, key = spelling.deletion_keys(pa.array(words))
    sets = [set(key[of == k].tolist()) for k in range(len(words))]
    for w, s in zip(words, sets):
        assert len(s) == 1 + len({w[:i] + w[i + 1 :] for i in range(len(w))}) == int(np.sum(of == words.index(w)))
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            shared = bool(({a} | {a[:k] + a[k + 1 :] for k in range(len(a))}) & ({b} | {b[:k] + b[k + 1 :] for k in range(len(b))}))
            assert bool(sets[i] & sets[j]) == shared


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = queries()["op13_spelling_variants"](spark, sf_dir)
    assert {tuple(r) for r in out.select(*COLUMNS).collect()} == brute(rows)
