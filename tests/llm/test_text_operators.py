"""Each operator against a brute-force version on a table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from facetry.llm import bpe, chat, decontaminate, exact_dedup, langid, line_dedup, quality, simhash, substring, token_counts
from facetry.llm.queries import queries, vocabulary

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, word string"


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    draw = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = draw(50), draw(12) + " and this line is long enough to count"
    out = [None, "", " \t\n ", "\n\n", "one", "One", "two words", " ", "İstanbul ÀÉ", "x" * 5000, "!!! ***", passage, passage.upper(), draw(34), draw(35)]
    out += [f"{draw(20)}\n{line if k % 2 else '  ' + line.upper() + chr(13)}\n{draw(15)}" for k in range(9)]
    out += [f"{draw(k)} {passage} {draw(40)}" for k in range(6)] + [f"{draw(60)}{w}" for w in ("", "\x0b", "  z")]
    near = draw(120).split()
    for k in range(6):
        own = near.copy()
        own[10 * k + 3] = "changed"
        out.append(" ".join(own))
    out += [out[-1], out[-1].upper(), " ".join(near) + " " + " ".join(near), draw(6000)]
    return out


@pytest.fixture(scope="module")
def rows():
    own = [(k, t, "en" if k % 2 else "fr", None, None, "clash", "clash") for k, t in enumerate(texts())]
    return [*own, own[20], (None, texts()[12], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- near duplicates


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(FOLD).encode())
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest reachable id for (id, fingerprint) pairs."""
    by = sorted({p for _, p in prints})
    root = {p: p for p in by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(by):
        for b in by[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for i, p in prints:
        if i is not None:
            low[find(p)].append(i)
    return [(i, p, min(low[find(p)], default=None)) for i, p in prints]


def test_near_duplicates(docs, rows, empty):
    want = Counter((i, f"{p:016x}", c) for i, p, c in brute_groups([(r[0], brute_print(r[1])) for r in rows]))
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert len({c for _, _, c in want}) < len(want)
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprints_use_sparks_hash(spark):
    own = spark.sql("select xxhash64('abc') as h").first()[0]
    assert own % (1 << 64) == xxhash.xxh64_intdigest(b"abc", seed=simhash.SEED)


def test_blocks_cover_any_three_bytes():
    from itertools import combinations

    blocks = simhash.blocks_of_four()
    assert len(blocks) == 14
    assert all(any(not set(b) & set(c) for b in blocks) for c in combinations(range(8), 3))


def test_a_bridge_without_an_id_links(spark):
    """Two rows out of reach of each other, both near one that has no id; and groups whose rows have none."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = " ".join(words)
    found = {}
    while len(found) < 3000:
        own = words.copy()
        own[r.randrange(400)] = f"x{r.randrange(10**6)}"
        found[" ".join(own)] = brute_print(" ".join(own))
    middle = brute_print(base)
    near = [(t, p) for t, p in found.items() if 1 <= (p ^ middle).bit_count() <= 3]
    a, b = next((a, b) for a, p in near for b, q in near if (p ^ q).bit_count() > 3)
    rows = [(1, a), (None, base), (3, b), (None, "quite another text"), (None, "quite another text")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "fingerprint", "component_id") == Counter((i, f"{p:016x}", c) for i, p, c in brute_groups([(i, brute_print(t)) for i, t in rows]))
    assert {r["component_id"] for r in out.collect() if r["doc_id"]} == {1}


def brute_links(fp):
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    root = np.arange(len(fp))
    simhash._roots(root, i, j)
    return root


def dense(size, seed=3):
    """Distinct fingerprints with four bytes in common, in clouds around a few centres."""
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 32, size // 6 + 1, dtype=np.uint64)
    fp = centres[r.integers(0, len(centres), size)]
    for _ in range(3):
        fp ^= np.where(r.random(size) < 0.5, np.uint64(1) << r.integers(0, 32, size).astype(np.uint64), np.uint64(0))
    return np.unique(fp | np.uint64(0xABCD1234 << 32))


def same_sets(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_a_list_keeps_all_links():
    fp = np.concatenate([dense(1500), dense(40, 4), dense(2, 5)])
    length = np.array([len(dense(1500)), len(dense(40, 4)), len(dense(2, 5))])
    i, j = simhash.linked(fp, length)
    root = np.arange(len(fp))
    simhash._roots(root, i, j)
    at = np.cumsum(length) - length
    assert len(i) < len(fp)
    for a, n in zip(at, length):
        assert same_sets(root[a : a + n], brute_links(fp[a : a + n]))


def test_long_lists_are_split_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 64)
    monkeypatch.setattr(simhash, "HELD", 100)
    fp = dense(3000)
    classes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    index = simhash.postings(classes).cache()
    assert index.groupBy("mask", "key").count().agg(F.max("count")).first()[0] <= 64
    links = index.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(simhash._links, "a long, b long").collect()
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    root = np.arange(len(fp))
    simhash._roots(root, np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
    assert same_sets(root, brute_links(fp))


def test_masks_widen_until_lists_are_short():
    for block in simhash.blocks_of_four():
        own = [simhash.mask_of(block)]
        assert sorted(simhash.pieces_of(own[0])) == sorted(simhash.mask_of((*block, p)) for p in range(8) if p not in block)
        while own:
            wide = [w for m in own[:2] for w in simhash.pieces_of(m)]
            assert all((m & w) == m and m != w for m in own[:1] for w in simhash.pieces_of(m))
            own = [w for w in wide if 2 ** (64 - (w % (1 << 64)).bit_count()) > simhash.LONG]


def test_a_list_of_very_many_fingerprints(spark):
    """200,000 fingerprints that share five bytes: lists stay short, and every link that bits tell is kept."""
    r = np.random.default_rng(8)
    fp = np.unique(r.integers(0, 1 << 24, 210_000, dtype=np.uint64) | np.uint64(0x123456789A << 24))[:200_000]
    classes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    index = simhash.postings(classes).cache()
    assert index.groupBy("mask", "key").count().agg(F.max("count")).first()[0] <= simhash.LONG
    from facetry.llm.components import components

    links = index.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(simhash._links, "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    values = set(fp.tolist())
    for x in fp[:400].tolist():
        for bit in range(24):
            if x ^ (1 << bit) in values:
                assert roots[x] == roots[x ^ (1 << bit)]


def test_components(spark):
    from facetry.llm.components import components

    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7), (8, 9), (9, 8)]
    want = {}
    for a, b in edges * 200:
        if a != b:
            want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    have = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["root"] for x in have} == want and len(have) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact duplicates


def test_exact_duplicates(docs, rows, empty):
    norm = [(r[1] or "").translate(FOLD) for r in rows]
    low = -(1 << 63)
    last = {t: max((low if r[0] is None else r[0]) for r, u in zip(rows, norm) if u == t) for t in norm}
    n = Counter(norm)
    want = Counter((r[0], last[t] if last[t] != low else None, n[t], (low if r[0] is None else r[0]) == last[t], sha(t)) for r, t in zip(rows, norm))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for owners in (None, 3):
        assert got(exact_dedup.exact_duplicates(docs, owners_log2=owners), *columns) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("n,bits", [(0, 8), (1, 8), (5, 3), (3000, 40), (2000, 60), (200, 8)])
def test_golomb_round_trip(n, bits):
    r = np.random.default_rng(n)
    v = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64))
    code = exact_dedup.golomb(v, 1 << bits)
    assert (exact_dedup.ungolomb(code, len(v)) == v).all()
    assert len(code) <= 2 + (len(v) * (bits - np.log2(max(1, len(v))) + 3)) / 8


# --- lines


def brute_lines(rows, least_chars=40, least_docs=5):
    space = "\t\n\x0b\x0c\r "
    order = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[line.strip(space).translate(FOLD)].add(order(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        keys = [line.strip(space).translate(FOLD) for line in lines]
        kept = [line for line, k in zip(lines, keys) if len(k) < least_chars or len(holders[k]) < least_docs or max(holders[k]) == order(r[0])]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_lines(docs, rows, empty, spark):
    want = brute_lines(rows)
    assert got(line_dedup.dedup_lines(docs), "doc_id", "text", "n_lines", "n_dropped") == want
    assert sum(k[3] for k in want) >= 4
    assert line_dedup.dedup_lines(empty).count() == 0
    many = [(k, "\n".join([f"line {k} {n} with its own words, long enough to count" if n % 67 else f"common line {n % 5} with the same words all over" for n in range(150 + k)])) for k in range(7)]
    assert got(line_dedup.dedup_lines(spark.createDataFrame(many, "doc_id long, text string")), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(many)


def test_lines_run_no_python(docs, capsys):
    line_dedup.dedup_lines(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# --- substrings


def brute_substrings(rows, window=35):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, lists):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((r[0], " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return Counter(out)


@pytest.mark.parametrize("crowded", [substring.CROWDED, 1])
def test_substrings(docs, rows, empty, crowded, monkeypatch):
    monkeypatch.setattr(substring, "CROWDED", crowded)
    want = brute_substrings(rows)
    assert got(substring.dedup_substrings(docs), "doc_id", "text", "n_words", "n_removed") == want
    assert sum(k[3] for k in want) > 500
    assert substring.dedup_substrings(empty).count() == 0


def test_index_counts_like_a_scan():
    r = random.Random(2)
    contents = [b" ".join(r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(4, 12))) for _ in range(60)]
    times = np.array([r.choice([1, 1, 1, 2]) for _ in contents])
    flags = substring.repeated(contents, times, 4)
    seen = Counter()
    for c, n in zip(contents, times):
        w = c.split()
        for i in range(len(w) - 3):
            seen[tuple(w[i : i + 4])] += int(n)
    for c, f in zip(contents, flags):
        w = c.split()
        assert f.tolist() == [seen[tuple(w[i : i + 4])] > 1 for i in range(len(w) - 3)]


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, window=13):
    lists = [(i, WORD.findall((t or "").translate(FOLD))) for i, t in items]
    out = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(FOLD))
        hit, names = set(), set()
        for name, item in lists:
            k = min(window, len(item))
            if not k:
                continue
            own = {tuple(item[a : a + k]) for a in range(len(item) - k + 1)}
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in own:
                    hit.update(range(a, a + k))
                    names.add(name)
        out.append((r[0], len(w), len(hit), tuple(sorted(str(n) for n in names if n is not None)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("chunk,part", [(decontaminate.CHUNK_BYTES, decontaminate.PART_WORDS), (400, 20)])
def test_decontamination(spark, docs, rows, empty, chunk, part, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    t = [x or "" for x in texts()]
    items = [(1, t[11]), (2, " ".join(t[30].split()[4:18]).upper()), (3, "two, words"), (4, None), (5, " - "), (None, " ".join(t[-1].split()[100:120])), (7, t[11]), (8, " ".join(t[-1].split()[3000:3120])), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    have = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in out.collect())
    assert have == brute_hits(rows, items)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench.limit(0))
    assert clean.where("n_hit > 0 or contaminated").count() == 0 and clean.count() == len(rows)


def test_a_benchmark_of_many_chunks_is_one_pass_and_writes_no_texts(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    draw = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    items = [(k, draw(300)) for k in range(60)]
    rows = [(k, f"{draw(2000)} {items[k % 60][1] if k % 3 == 0 else ''} {draw(2000)}") for k in range(60)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", sum(len(t) for _, t in items) // 10)
    written = []
    monkeypatch.setattr(decontaminate, "written", lambda df, name, own=decontaminate.written: written.append(own(df, name)) or written[-1])
    out = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate.decontaminate(docs, bench).collect())
    assert out == brute_hits(rows, items)
    size = sum(os.path.getsize(f.removeprefix("file://")) for df in written for f in df.inputFiles())
    assert size < sum(len(t) for _, t in rows) / 2


def test_spans_are_removed(spark):
    rows = [(1, "a b C d, é e f g h", "x"), (2, "x y z", "x"), (3, "c d é " + "w " * 100, "x"), (None, None, "x"), (3, "c d é " + "w " * 100, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone string")
    bench = spark.createDataFrame([(1, "c-d é"), (2, "g H")], "item_id long, text string")
    found = decontaminate.decontaminate(docs, bench)
    assert [tuple(s)[:2] for s in found.where("doc_id = 1").first()["spans"]] == [(2, 5), (7, 9)]
    docs = docs.withColumnRenamed("__gone", "spans")
    keep = {r[0]: r[1] for r in decontaminate.remove_spans(docs, found).collect()}
    assert keep == {1: "a b  e f ", 2: "x y z", 3: rows[2][1], None: None}
    short = decontaminate.remove_spans(docs, found, longest=3).collect()
    assert Counter(r[1] for r in short) == Counter(["a b  e f ", "x y z", *[" " + "w " * 100] * 2, None]) and short[0].asDict().keys() == {"doc_id", "text", "spans"}


# --- language


def test_mixture_finds_both_languages():
    r = np.random.default_rng(1)
    p = r.dirichlet(np.full(200, 0.05), size=3) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    counts = r.multinomial(3000, 0.7 * p[0] + 0.3 * p[2]).astype(float)
    share, _ = langid.fit(p, counts)
    assert abs(share[0] - 0.7) < 0.05 and abs(share[2] - 0.3) < 0.05 and share[1] < 0.02


def plain_trigrams(text):
    """Trigrams around letters as bins, by a plain loop."""
    raw = (text or "").encode()
    kind = lambda x: x if x >= 128 else x - 96 if 97 <= x <= 122 else x - 64 if 65 <= x <= 90 else 0
    c = [0, *map(kind, raw), 0]
    return Counter(((c[k - 1] << 16 | c[k] << 8 | c[k + 1]) * 2654435761 % (1 << 32)) >> (32 - langid.BINS_LOG2) for k in range(1, len(c) - 1) if c[k])


def plain_fit(p, n, steps=25):
    share = {k: 1 / len(p) for k in p}
    value = lambda: sum(c * math.log(sum(share[k] * p[k][b] for k in p)) for b, c in n.items())
    if len(p) == 1:
        return share, value()
    for _ in range(steps):
        new = {k: share[k] * sum(c * p[k][b] / sum(share[j] * p[j][b] for j in p) for b, c in n.items()) / sum(n.values()) for k in p}
        moved = max(abs(new[k] - share[k]) for k in p)
        share = new
        if moved < 2e-3:
            break
    return share, value()


def plain_detect(text, seen, penalty=3.0):
    """[(lang, share)] with the best penalised likelihood, by plain loops over counts by language."""
    n = plain_trigrams(text)
    if not any(c.isalpha() for c in text or ""):
        return []
    p = {k: {b: (own[b] + 0.1) / (sum(own.values()) + 0.1 * langid.BINS) for b in n} for k, own in seen.items()}
    single = {k: sum(c * math.log(p[k][b]) for b, c in n.items()) for k in p}
    names, near = sorted(p), set()
    for at in range(0, len(names), langid.BLOCK):
        block = names[at : at + langid.BLOCK]
        near.add(max(block, key=lambda k: single[k]))
        near |= {k for k, w in plain_fit({k: p[k] for k in block}, n)[0].items() if w >= langid.LEAST_SHARE and len(block) > 1}
    p = {k: p[k] for k in sorted(near)}
    first = max(p, key=lambda k: single[k])
    best, value = [(first, 1.0)], single[first]
    share, _ = plain_fit(p, n)
    order = [k for k in sorted(p, key=lambda k: -share[k]) if share[k] >= langid.LEAST_SHARE]
    for size in range(2, len(order) + 1):
        own, v = plain_fit({k: p[k] for k in order[:size]}, n)
        v -= penalty * math.log(sum(n.values()) + 1) * (size - 1)
        if v <= value:
            break
        best, value = sorted(own.items(), key=lambda x: -x[1]), v
    return best


def some_languages(n, seed=4):
    """Texts of made-up languages, each with an alphabet of its own."""
    r = random.Random(seed)
    words = [["".join(r.choice(own) for _ in range(r.randint(2, 6))) for _ in range(25)] for own in (r.sample("abcdefghijklmnopqrstuvwxyzéßñø", 8) for _ in range(n))]
    return [f"l{k:04}" for k in range(n)], lambda k, size: " ".join(r.choice(words[k]) for _ in range(size))


@pytest.mark.parametrize("block,broadcast", [(32, 1 << 24), (2, 1 << 24), (2, 4000)])
def test_mixtures_are_the_plain_ones(spark, block, broadcast, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "BROADCAST_BYTES", broadcast)
    names, say = some_languages(5)
    known = [(say(k, 40), names[k]) for k in range(5) for _ in range(6)]
    model = langid.train(spark.createDataFrame([*known, (None, "l0000"), ("x", None)], "text string, lang string"))
    assert (len(model.passes) > 1) == (broadcast < 10_000)
    seen = {k: sum((plain_trigrams(t) for t, lang in known if lang == k), Counter()) for k in names}
    rows = [(k, f"{say(k % 5, 30)} {say((k + 2) % 5, (0, 3, 12, 30)[k % 4])}", "clash") for k in range(24)] + [(90, None, ""), (91, "12 !", ""), (None, say(3, 5), ""), (92, "Q", ""), (93, "zz qq xx", ""), (93, "zz qq xx", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_x string")
    out = langid.detect(docs, model, carry=("text", "lang_x")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = plain_detect(r["text"], seen)
        assert r["lang_pred"] == (want[0][0] if want else "und") and [m["lang"] for m in r["mixture"]] == [k for k, _ in want]
        assert all(abs(m["share"] - w) < 1e-6 for m, (_, w) in zip(r["mixture"], want)) and abs(r["score"] - (want[0][1] if want else 0)) < 1e-6
    assert sum(len(r["mixture"]) > 1 for r in out) > 5


def test_a_thousand_languages(spark):
    names, say = some_languages(1000)
    model = langid.train(spark.createDataFrame([(say(k, 60), names[k]) for k in range(1000)], "text string, lang string").repartition(4))
    docs = spark.createDataFrame([(k, say(k, 60)) for k in range(0, 1000, 9)], "doc_id long, text string")
    out = {r["doc_id"]: r["lang_pred"] for r in langid.detect(docs, model).collect()}
    assert sum(out[k] == names[k] for k in out) > 0.95 * len(out)


def test_language_edges(spark, docs, rows, empty):
    model = langid.train(docs)
    assert [r["lang"] for r in model.languages.orderBy("no").collect()] == ["en", "fr"]
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.detect(docs, model).collect()}
    assert len(out) >= 40 and {(0, "und"), (1, "und"), (10, "und"), (None, "und")} <= out
    assert not {(4, "und"), (8, "und")} & out
    assert langid.detect(empty, model).count() == 0
    none = langid.detect(docs, langid.train(empty))
    assert none.where("lang_pred <> 'und' or score <> 0").count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    q = queries()
    lang = q["op5_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = q["op1_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert good.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


# --- quality


def plain_ftrl(texts, labels, epochs, alpha, beta, l1, l2):
    """FTRL-proximal by plain loops over named features."""
    rows = []
    for t in texts:
        buf = np.frombuffer(t.encode(), np.uint8)
        _, f, n = quality.features(buf, np.array([0, len(buf)]))
        rows.append({**{k: c * quality.SCALE / max(1, int(n[0])) for k, c in Counter(f.tolist()).items()}, "bias": 1.0})
    z, q = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(q[k])) / alpha + l2)
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(q[k] + g * g) - math.sqrt(q[k])) / alpha
                z[k] += g - s * w[k]
                q[k] += g * g
    return {k: weight(k) for k in z}


def test_ftrl_is_the_plain_one():
    own = [t or "" for t in texts()[:40]]
    labels = np.array([float(k % 3 == 0) for k in range(40)])
    bias, w = quality.ftrl(pa.array(own), labels, 3, 0.5, 1.0, 0.002, 0.02)
    want = plain_ftrl(own, labels, 3, 0.5, 1.0, 0.002, 0.02)
    assert abs(bias - want.pop("bias")) < 1e-9
    have = {int(k): float(w[k]) for k in np.flatnonzero(w)}
    assert have.keys() == {k for k, v in want.items() if v} and all(abs(v - want[k]) < 1e-9 for k, v in have.items())


def test_scores_are_sparse_dot_products(spark, monkeypatch):
    r = np.random.default_rng(2)
    model = quality.Model(0.3, r.normal(size=quality.FEATURES).astype(np.float32))
    own = texts()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    out = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    for k, t in enumerate(own):
        buf = np.frombuffer((t or "").encode(), np.uint8)
        _, f, n = quality.features(buf, np.array([0, len(buf)]))
        want = 1 / (1 + math.exp(-max(-35, min(35, 0.3 + quality.SCALE * float(model.weights[f].astype(float).sum()) / max(1, int(n[0]))))))
        assert abs(out[k] - want) < 1e-6
        if t:
            monkeypatch.setattr(quality, "PIECE", 50)
            dot, words = quality.long_dot(buf, model.weights)
            assert words == int(n[0]) and abs(dot - float(model.weights[f].astype(float).sum())) < 1e-3
            monkeypatch.undo()


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * 500) for k in range(300)] + [(900, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(300), 900]], "doc_id long, quality int")
    monkeypatch.setattr(quality, "LONGEST_BYTES", 4000)
    assert quality.sample(docs, labels).count() == 300
    assert 20 < quality.sample(docs, labels, size=60_000).count() < 120


def test_quality_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(31, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(quality.sample(docs, labels))
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (0, 1, 2)}) == 1
    assert quality.score(empty, model).count() == 0
    nothing = quality.train(quality.sample(docs, labels.limit(0)))
    assert quality.score(docs, nothing).where("score <> 0.5").count() == 0
    assert quality.sample(docs, labels, rows=7).count() <= 7


# --- chat


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 1, "assistant", "b\\"), (2, 0, "user", None), (3, 0, "assistant", "x"), (4, 0, "we:ird\\ ### ro</turn>le", "<</turn>/turn>###:"), (4, None, None, ""), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "é😀"), (5, 2, "assistant", "é😀"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_chats(df).withColumn("read", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    rows = {r["conv_id"]: r for r in out.collect()}
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=key)
        assert [(x["role"], x["text"]) for x in rows[conv]["read"]] == [(t[2] or "", t[3] or "") for t in own]
        assert rows[conv]["loss"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
    assert {c: rows[c]["valid"] for c in rows} == {1: True, 2: True, 3: False, 4: False, 5: False, None: False}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_no_mark_is_left_in_a_text(spark):
    hard = [f"{'#' * n} Assistant: x" for n in range(3, 10)] + ["\\" * n + "### : </turn>\n" for n in range(4)] + [": ", ":: :", " </turn>\n", "< </turn>\n/turn>", "#\\# ", "###", "x #", "x:", " <"]
    turns = [(k, j, role, text) for k, t in enumerate(hard) for j, (role, text) in enumerate((("user", t), (t, "x"), ("assistant", t)))]
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    t = chat.Template()
    for r in out.withColumn("read", chat.read_back(F.col("formatted"))).collect():
        t0 = hard[r["conv_id"]]
        assert [tuple(x) for x in r["read"]] == [("user", t0), (t0, "x"), ("assistant", t0)]
        assert not any(m in s["text"] for k, s in enumerate(r["segments"]) if k % 3 == 1 for m in (t.open, t.colon, t.close))
        assert r["formatted"].count(t.open) == r["formatted"].count(t.colon) == r["formatted"].count(t.close) == 3
    for bad in ("#", " \\x", "a\\"):
        with pytest.raises(ValueError):
            chat.Template(open=bad)


def test_long_roles_and_texts_are_read_back(spark):
    long = ["a:" * 500_000, "\\" * 1_000_000, "#" * 1_000_000]
    df = spark.createDataFrame([(k, 0, t, t) for k, t in enumerate(long)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("conv_id", chat.read_back(F.col("formatted")).alias("read"))
    assert {r["conv_id"]: [tuple(x) for x in r["read"]] for r in out.collect()} == {k: [(t, t)] for k, t in enumerate(long)}


def test_the_state_machine_runs_in_the_query(spark, sf_dir, capsys):
    queries()["op2_chat_formatting"](spark, sf_dir).explain("extended")
    plan = capsys.readouterr().out.split("Physical Plan")[1]
    assert "try_element_at" in plan or "map(" in plan or "keys: [" in plan
    assert not re.search("Python|Pandas|Arrow", plan)


# --- tokens


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")


def test_encoding_is_the_librarys(spark, docs, rows, empty, tokenizer, monkeypatch):
    v = vocabulary()
    monkeypatch.setattr(bpe, "LEAST_COUNT", 2)
    name = bpe.build_lexicon(docs, v, words=500)
    out = bpe.decode(bpe.encode(docs, v, name), v)
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in out.collect()) == want
    assert bpe.decode(bpe.encode(empty, v, bpe.build_lexicon(empty, v)), v).count() == 0


def test_encoder_on_hard_texts(tokenizer):
    e = bpe.Encoder(bpe.Vocabulary(vocabulary()))
    r = random.Random(9)
    mixed = ["".join(r.choice([" ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "a", "Bc", "é", "12", "!", "'s", "'", ".", "<|endoftext|>", "x" * 70]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    hard = [*mixed, " ", "a ", " a", "a \n", "\n a", "a\n \nb", "a \n b", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's we'LL  'd\t\n x", "   ", "  　 a", "١٢٣ ²½ Ⅷ", "a" * 3000, "ab" * 2000, "日本語テキスト", "😀👩‍👩‍👧 x", "\x00\x1c\x85 ", "é �", "don't 'S"]
    together = bpe.Encoder(e.vocabulary).encode_all(hard)
    assert together == [e.encode(t) for t in hard]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.vocabulary.merge_many([b"", b"a", b" the", b"x" * 70])] == [e.vocabulary.merge(w) for w in (b"", b"a", b" the", b"x" * 70)]
    for t in hard:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids
        assert bpe.decode_ids(e.vocabulary, e.encode(t)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_lexicon_holds_its_words_only(tmp_path):
    r = random.Random(1)
    entries = {bytes(r.choice(b"abcd") for _ in range(r.randint(1, 6))): [r.randint(0, 50000) for _ in range(r.randint(1, 3))] for _ in range(400)}
    entries[b""] = [7]
    image = bpe.compile_lexicon(entries)
    (tmp_path / "x").write_bytes(image)
    own = bpe.Lexicon(str(tmp_path / "x"))
    assert all(own.get(w) == np.array(ids, "<u4").tobytes() for w, ids in entries.items())
    assert all(own.get(w) is None for w in (b"abcdabcd", b"e", b"aaaaaaa") if w not in entries)
    asked = [*entries, b"abcdabcd", b"e", b"aaaaaaa", b"ab\xff"]
    assert own.get_many(asked) == [own.get(w) for w in asked] and own.get_many([]) == []
    (tmp_path / "y").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "y")).get_many([b"a", b""]) == [None, None]
    trie = {w[:k] for w in entries for k in range(len(w) + 1)}
    assert bpe._HEAD.unpack_from(image)[1] < len(trie)


def test_context_limits(spark, docs, rows, empty, tokenizer):
    v = vocabulary()
    n = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    out = {r["n_tokens"]: r for r in token_counts.context_limits(token_counts.length_histogram(docs, v)).collect()}
    assert set(out) == set(n)
    for limit, r in out.items():
        assert r["n_docs"] == n.count(limit) and r["docs_at_least"] == sum(x >= limit for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= limit) and r["tokens_kept"] == sum(min(x, limit) for x in n)
        assert r["tokens_cut"] == sum(n) - r["tokens_kept"] and r["total_docs"] == len(n) and r["total_tokens"] == sum(n)
        assert abs(r["share_within"] - sum(x <= limit for x in n) / len(n)) < 1e-12
    assert token_counts.context_limits(token_counts.length_histogram(empty, v)).count() == 0


# --- very long texts


def test_very_long_texts(spark):
    """A text of two million characters in one line, and one in many lines, through the operators that keep whole texts."""
    r = random.Random(12)
    one = " ".join(str(r.randrange(10**6)) for _ in range(300_000))
    many = one.replace("7 ", "\n")
    rows = [(1, one), (2, many), (3, one.upper()), (4, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {r["doc_id"]: (r["keep_id"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert exact == {1: (4, sha(one)), 2: (2, sha(many)), 3: (4, sha(one)), 4: (4, sha(one))}
    assert got(line_dedup.dedup_lines(docs), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows)
    model = quality.Model(0.0, r_weights := np.random.default_rng(1).normal(size=quality.FEATURES).astype(np.float32))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert scores[1] == scores[4] and all(0 <= x <= 1 for x in scores.values()) and len(r_weights)
    assert {r["doc_id"] for r in simhash.near_duplicates(docs).where("component_id = 1").collect()} >= {1, 3, 4}
    pytest.importorskip("tokenizers")
    counts = token_counts.context_limits(token_counts.length_histogram(docs.where("doc_id in (1, 4)"), vocabulary())).collect()
    assert len(counts) == 1 and counts[0]["n_docs"] == 2 and counts[0]["n_tokens"] > 300_000


def test_pieces_change_nothing(monkeypatch, tokenizer):
    r = random.Random(4)
    text = "".join(r.choice(["aB", "é", " ", "  ", "\n", "x", "1", "'s", "!", "\x0b", "日本"]) for _ in range(4000))
    raw, array = text.encode(), np.frombuffer(text.encode(), np.uint8)
    whole = simhash.fingerprint(raw), langid.trigram_counts(array), substring._kept(raw, [(5 << 32) + 9], 3)
    assert whole[0] == brute_print(text) and (whole[1] == np.bincount(langid.trigram_bins(array), minlength=langid.BINS)).all()
    own = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    assert whole[2] == (b" ".join(own[:5] + own[11:]), len(own), len(own) - 6)
    for module in (simhash, langid, bpe):
        monkeypatch.setattr(module, "PIECE", 7)
    assert simhash.fingerprint(raw) == whole[0] and (langid.trigram_counts(array) == whole[1]).all()
    assert [simhash.fingerprint(t.encode()) for t in ("a" * 40, "a" * 40 + " b", " " * 50)] == [brute_print(t) for t in ("a" * 40, "a" * 40 + " b", " " * 50)]
    e = bpe.Encoder(bpe.Vocabulary(vocabulary()))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text), "<u4").tolist() == ids and bpe.decode_ids(e.vocabulary, e.encode(text)) == text


def test_words_are_found_in_pieces(monkeypatch):
    from facetry.llm import common

    r = random.Random(6)
    rows = ["".join(r.choice(["ab", "é", " ", "\n", "Q", "-"]) for _ in range(r.randint(0, 60))) for _ in range(50)] + ["x" * 300, ""]
    raw = [t.encode() for t in rows]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    for table, pattern in ((common.byte_table(common.NOT_SPACE, False), rb"[^\x20\x09-\x0D]+"), (common.byte_table(common.ALNUM, True), rb"[0-9A-Za-z\x80-\xff]+")):
        whole = common.words(buf, offsets, table)
        want = [(k, m.group()) for k, x in enumerate(raw) for m in re.finditer(pattern, x)]
        assert [(int(k), bytes(buf[s:e])) for s, e, k in zip(*whole[:3])] == want
        monkeypatch.setattr(common, "BLOCK_BYTES", 3)
        for a, b in zip(whole, common.words(buf, offsets, table)):
            assert (a == b).all()
        monkeypatch.undo()
        hashes = {}
        for (_, w), h in zip(want, whole[3].tolist()):
            assert hashes.setdefault(w.lower() if table[65] == table[97] else w, h) == h
        assert len(set(hashes.values())) == len(hashes)
