"""The Jaccard join against all pairs by sets of Python, with regions of every kind."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.llm import jaccard
from facetry.llm.queries import queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return sorted(((i, len(s), min(low[find(k)], default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: f"{r.choice('abcdé')}{r.randrange(5000)}"
    draw = lambda n: [word() for _ in range(n)]
    out = [None, None, "", " \t\n", "one", "One", "one two three", "ONE  two\nthree ", "a b c d e", "a b c d e f", "é x", "É x", "w " * 400, "w " * 30, " ".join(draw(30000))]
    passage = draw(60)
    out += [" ".join(draw(r.randint(5, 60)) + passage + draw(r.randint(5, 60))) for _ in range(60)]
    for n, copies, edits in ((80, 50, 1), (200, 60, 4), (120, 60, 8), (60, 40, 5), (300, 20, 30)):
        base = draw(n)
        for k in range(copies):  # copies of a base, and copies of copies
            own = base.copy()
            for _ in range(r.randint(0, edits)):
                own[r.randrange(n)] = word()
            if k % 7 == 0:
                base = own
            out.append(" ".join(own[: n - r.choice((0, 0, 0, 3, n // 6))]))
    out += [out[-1], out[-1].upper(), out[-30]]
    rows = [(3 * k % 1009, t) for k, t in enumerate(out)]
    return [*rows, rows[40], rows[40], (None, out[-5]), (None, "only rows without an id hold this text"), (None, "only rows without an id hold this text")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, component_id int, node int, own string").repartition(3).cache()


def test_small_regions(docs, rows):
    want = brute(rows)
    assert got(jaccard.near_sets(docs)) == want
    assert len({c for _, _, c in want}) < len(want) - 100


@pytest.mark.parametrize(("long", "pivots"), [(16, 3), (4, 2)])
def test_cells_and_blocks(docs, rows, monkeypatch, long, pivots):
    """Regions are cut by pivots, cells recurse, and what pivots do not part is joined in blocks."""
    seen = []
    own, cut = jaccard.Regions._blocks, jaccard.Regions._cut
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard.Regions, "_blocks", lambda self, r: (seen.append("blocks") if not r.isEmpty() else None, own(self, r))[1])
    monkeypatch.setattr(jaccard.Regions, "_cut", lambda self, r, k: (seen.append(k), cut(self, r, k))[1])
    assert got(jaccard.near_sets(docs)) == brute(rows)
    assert 0 in seen


def test_any_common_list(spark, docs, rows, monkeypatch):
    """Right whatever is held to be common."""
    sets = [np.array(sorted(hash(x) % (1 << 63) for x in range(5)), np.uint64)]
    every = np.unique(np.concatenate([*sets, *(s for s in jaccard.sets_of(pa.array([t or "" for _, t in rows])))]))
    some = every[::3]
    monkeypatch.setattr(jaccard, "_common", lambda _: np.stack((some, np.arange(len(some))[::-1].astype(np.uint64))))
    assert got(jaccard.near_sets(docs)) == brute(rows)


def test_empty_tables(docs):
    assert jaccard.near_sets(docs.limit(0)).count() == 0
    assert got(jaccard.near_sets(docs.where("text is null or text = ''").where("doc_id is not null"))) == [(0, 0, 0), (3, 0, 3), (6, 0, 6)]


def test_long_texts_in_pieces(monkeypatch):
    from facetry.llm import simhash

    r = random.Random(2)
    text = " ".join(f"{r.choice('ABcd')}{r.randrange(30)}" for _ in range(3000)).lower().encode()
    whole = jaccard.shingle_set(text)
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert (jaccard.shingle_set(text) == whole).all() and len(whole) == len(brute_set(text.decode()))


@settings(max_examples=400, deadline=None)
@given(st.sets(st.integers(0, 90), min_size=1), st.sets(st.integers(0, 90), max_size=6), st.sets(st.integers(0, 90), max_size=6), st.lists(st.integers(0, 90), unique=True))
def test_heads_of_linked_sets_share_enough(a, more, less, common):
    b = (a | more) - less or a
    own = [np.array(sorted(x), np.uint64) for x in (a, b)]
    c = np.array(sorted(common), np.uint64)
    ranks = np.array([common.index(int(x)) for x in c], np.uint64)
    heads = [set(np.concatenate(jaccard.head(x, np.stack((c, ranks)))).tolist()) for x in own]
    if 100 * len(a & b) >= 80 * len(a | b):
        assert len(heads[0] & heads[1]) >= max(jaccard.need(len(a)), jaccard.need(len(b)))
    linked, d = jaccard.near([own[0]], [own[1]])
    assert bool(linked[0, 0]) == (100 * len(a & b) >= 80 * len(a | b)) and abs(d[0, 0] - (1 - len(a & b) / len(a | b))) < 1e-12


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_lists_stream_in_batches(rows):
    r = random.Random(rows)
    own = sorted((r.randrange(40), r.randrange(25)) for _ in range(300)) + [(41, k) for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in own[k : k + rows]], pa.int64()), pa.array([y for _, y in own[k : k + rows]], pa.int64())], names=["s", "node"]) for k in range(0, len(own), rows)]
    found = defaultdict(int)
    for b in jaccard._shared(iter(batches)):
        for region, node, times in zip(*(c.to_pylist() for c in b.columns)):
            found[region, node] += times
    want = defaultdict(int)
    for s in {x for x, _ in own}:
        nodes = sorted({y for x, y in own if x == s})
        for y in nodes if len(nodes) > 1 else ():
            want[nodes[0], y] += 1
    assert set(found) == set(want) and all(found[k] >= want[k] for k in want)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries()["op11_jaccard_join"](spark, sf_dir)) == brute(rows)
