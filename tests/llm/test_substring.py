"""Substring removal where words are made to collide, are very long, or ids are texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from facetry.llm import substring
from facetry.llm.common import NOT_SPACE, bounds, byte_table, word_hashes


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


def brute(rows, window=35):
    seen = defaultdict(list)
    words = [(t or "").split() for _, t in rows]
    for d, w in enumerate(words):
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])].append((d, k))
    gone = [set() for _ in rows]
    for places in seen.values():
        for d, k in places if len(places) > 1 else ():
            gone[d] |= set(range(k, k + window))
    return Counter((i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _), w, g in zip(rows, words, gone))


def rows():
    lead = [f"w{k}" for k in range(34)]
    t, u = thue_morse(1024), thue_morse(1024, "b", "a")
    long, other = "x" * (1 << 20), "x" * ((1 << 20) - 1) + "y"
    out = [(1, [*lead, t]), (2, [*lead, u]), (3, [*lead[::-1], long]), (4, [*lead[::-1], other]), (5, ["z", *lead[::-1], long, "end"]), (6, [*lead[5:], *[long] * 4, t, u]), (7, [*lead[5:], *[long] * 4, t, t])]
    # 64 and 65 bytes, and a word that looks like what is sent for a long one
    edge, posed = "e" * 64, "\x00" + hashlib.sha256(long.encode()).hexdigest()
    out += [(8, [*lead[3:], edge, "e" * 65, "k", "l"]), (9, [*lead[3:], edge, "e" * 65, "k", "m"]), (10, [*lead[::-1], posed])]
    # a run of two words in the order of a Thue-Morse sequence, and its complement
    out += [(11, [*thue_morse(4096)]), (12, [*thue_morse(4096, "b", "a")])]
    return [(i, " ".join(w)) for i, w in out] + [(13, None), (None, ""), (14, "few words"), (14, "few words")]


@pytest.mark.parametrize("crowded", [substring.CROWDED, 1])
def test_words_count_by_their_bytes(spark, crowded, monkeypatch):
    monkeypatch.setattr(substring, "CROWDED", crowded)
    own = rows()
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(2)
    out = substring.dedup_substrings(docs)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect())
    assert got == brute(own)
    assert {(i, k) for i, _, k, _ in got} >= {(1, 0), (2, 0), (4, 0), (10, 0), (3, 35), (5, 35)}


def test_ids_keep_their_type(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = spark.createDataFrame([("a", passage), ("b", "more " + passage), (None, "other")], "name string, body string")
    out = substring.dedup_substrings(docs, id_col="name", text_col="body")
    assert {(r["doc_id"], r["n_removed"]) for r in out.collect()} == {("a", 40), ("b", 40), (None, 0)}
    assert substring.dedup_substrings(docs.limit(0), id_col="name", text_col="body").count() == 0


def test_hashes_of_words_of_any_length():
    own = [b"a", b"ab" * 20, thue_morse(1024).encode(), thue_morse(1024, "b", "a").encode(), b"a", b"q" * 255, b"q" * 256, b"q" * 257]
    buf = np.frombuffer(b" ".join(own), np.uint8)
    s, e, _ = bounds(buf, np.array([0, len(buf)]), byte_table(NOT_SPACE, fold=False))
    assert [buf[i:j].tobytes() for i, j in zip(s, e)] == own
    h = word_hashes(buf, s, e)
    assert h[0] == h[4] and len(set(h.tolist())) == len(own) - 1


def test_bit_vectors_are_compressed_and_count():
    r = np.random.default_rng(1)
    for bit in (np.zeros(100_000, np.uint8), np.repeat(r.integers(0, 2, 200), 500), r.integers(0, 2, 5000), np.zeros(0, np.uint8)):
        v = substring.BitVector(bit)
        at = np.arange(len(bit) + 1)
        assert (v.ones(at) == np.concatenate(([0], np.cumsum(bit)))).all()
    assert len(substring.BitVector(np.repeat(r.integers(0, 2, 200), 640)).blocks) == 2
