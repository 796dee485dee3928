"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are compiled, with the ids they encode to, into a minimal acyclic automaton that
shares prefixes and suffixes; sums along a word's path number the words, and the number selects the ids.  The automaton
is one file in the shared folder, which each executor maps into memory.  Words it does not hold are merged pair by pair,
exactly as the vocabulary's ranks ask.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import scratch, written

#: The byte-level pre-tokenizer's pattern, a fixed value of this kind of vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Marks that are a pre-token of their own behind a word's letters.
_MARKS = frozenset(",.")
_CUT = regex.compile(r"\S\s")
#: A space that more white space follows, or nothing; and one that something else follows.
_WIDE, _SPACE = re.compile(r" (?:\s|$)"), re.compile(r" (?=\S)")
#: Characters of a text whose words are objects at once.
PIECE = 1 << 20
#: Words of the lexicon, and words whose ids a task keeps at hand.
LEXICON_WORDS, REMEMBERED = 1 << 15, 1 << 17
#: Words longer than this are neither remembered nor compiled.
LONG_WORD = 64
#: Words that occur less often are never compiled.
LEAST_COUNT = 16
#: Distinct words that a counting task holds before it hands them on.
COUNTED = 1 << 17


_ID_BITS = 32
_ID, _NEVER = (1 << _ID_BITS) - 1, 1 << 62


def byte_characters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class PairTable:
    """A hash table from 64-bit keys to values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, (1 << 64) - 1, np.uint64), np.full(1 << self.bits, _NEVER, np.int64)
        self.probes, todo = 0, np.arange(len(keys))
        while len(todo):
            at = self._place(keys[todo], self.probes)
            free = np.flatnonzero(self.values[at] == _NEVER)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], values[todo[won]]
            todo = np.delete(todo, won)
            self.probes += 1

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys, 0)
        out = np.where(self.keys[at] == keys, self.values[at], _NEVER)
        # on to the next place where another key, not a gap, was met
        todo = np.flatnonzero((self.keys[at] != keys) & (self.values[at] != _NEVER))
        for probe in range(1, self.probes):
            if not len(todo):
                break
            at = self._place(keys[todo], probe)
            same = self.keys[at] == keys[todo]
            out[todo[same]] = self.values[at[same]]
            todo = todo[~same & (self.values[at] != _NEVER)]
        return out


class Vocabulary:
    """Ids, merge ranks and special strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, file: str):
        model = json.loads(file)
        ids, back = model["model"]["vocab"], {c: b for b, c in byte_characters().items()}
        size = max([*ids.values(), *(t["id"] for t in model["added_tokens"])]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.letters = [ids[byte_characters()[b]] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        #: Pairs of ids that merge: the rank in the upper bits, the id they merge to in the lower.
        self.merges = {(ids[a], ids[b]): rank << _ID_BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.merges], np.uint64)
        self._pairs = PairTable(keys, np.array(list(self.merges.values()), np.int64))
        self._letters = np.array(self.letters, np.int64)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of lowest rank is joined, the leftmost first, until no pair has a rank."""
        ids = list(map(self.letters.__getitem__, word))
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(pair, _NEVER) for pair in pairwise(ids)]
        while found:
            best = min(found)
            if best == _NEVER:
                break
            k = found.index(best)
            ids[k] = best & _ID
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), _NEVER)
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), _NEVER)
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words (bytes of 32-bit integers): in each round every word joins its pair of lowest rank, the
        leftmost, until none of its pairs has a rank."""
        out: list[bytes] = [b""] * len(words)
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = np.array(self.merge(w), "<u4").tobytes()
        live = np.array([k for k, w in enumerate(words) if 0 < len(w) <= LONG_WORD], np.int64)
        if not len(live):
            return out
        ids = self._letters[np.frombuffer(b"".join([words[k] for k in live.tolist()]), np.uint8)]
        n = np.array([len(words[k]) for k in live.tolist()], np.int64)

        def ranks(at: np.ndarray) -> np.ndarray:
            return self._pairs.get((ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64))

        rank = np.full(len(ids), _NEVER, np.int64)  # of the pair that begins at a place
        last = np.zeros(len(ids), bool)
        last[np.cumsum(n) - 1] = True
        inner = np.flatnonzero(~last)
        rank[inner] = ranks(inner)
        while True:
            begin = np.cumsum(n) - n
            best = np.minimum.reduceat(rank, begin)
            done = best == _NEVER
            if done.any():
                stay = np.repeat(~done, n)
                flat, size = ids[~stay].astype("<u4").tobytes(), np.cumsum(n[done]) * 4
                for k, a, b in zip(live[done].tolist(), (size - n[done] * 4).tolist(), size.tolist()):
                    out[k] = flat[a:b]
                live, n, ids, rank, last, best = live[~done], n[~done], ids[stay], rank[stay], last[stay], best[~done]
                if not len(live):
                    return out
                begin = np.cumsum(n) - n
            hit = np.flatnonzero(rank == np.repeat(best, n))
            word = np.searchsorted(begin, hit, side="right") - 1
            at = hit[np.concatenate(([True], word[1:] != word[:-1]))]  # the leftmost of each word
            ids[at] = best & _ID
            last[at] |= last[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # one place has gone before each
            ids, rank, last, n = ids[keep], rank[keep], last[keep], n - 1
            rank[moved] = _NEVER
            begin = np.cumsum(n) - n
            left = moved[moved > begin] - 1
            fresh = np.concatenate((moved[~last[moved]], left))
            if len(fresh):
                rank[fresh] = ranks(fresh)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for words of any length."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = merges[a, b] & _ID, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0 and (m := merges.get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[after[x]]))
        return [i for i in ids if i >= 0]


# --- the transducer --------------------------------------------------------------------------------------------------

_HEAD = struct.Struct("<8sQQQQ")
_MAGIC = b"DAWGIDS1"


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A file image of the minimal acyclic automaton of the words, with their ids.

    Built from sorted words, one path at a time: states that no later word can extend are replaced by an equal state
    that is known, so suffixes are shared.  Each edge carries how many words of its state come before those behind it."""
    words = sorted(entries)
    finals, edges, known = [False], [[]], {}

    def close(path: list[tuple[int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, child = path.pop()
            signature = (finals[child], tuple(edges[child]))
            same = known.setdefault(signature, child)
            if same != child:
                edges[parent][-1] = (edges[parent][-1][0], same)

    path: list[tuple[int, int]] = []
    last = b""
    for w in words:
        shared = 0
        while shared < min(len(w), len(last)) and w[shared] == last[shared]:
            shared += 1
        close(path, shared)
        state = path[-1][1] if path else 0
        for c in w[shared:]:
            finals.append(False), edges.append([])
            child = len(finals) - 1
            edges[state].append((c, child))
            path.append((state, child))
            state = child
        finals[state] = True
        last = w
    close(path, 0)
    order, place, behind = [], {}, {}
    stack = [(0, False)]
    while stack:  # children before parents, to count the words behind a state
        s, done = stack.pop()
        if done:
            behind[s] = finals[s] + sum(behind[t] for _, t in edges[s])
        elif s not in place:
            place[s] = len(order)
            order.append(s)
            stack.append((s, True))
            stack.extend((t, False) for _, t in edges[s] if t not in place)
    first, labels, targets, sums = [0], bytearray(), [], []
    for s in order:
        total = int(finals[s])
        for c, t in edges[s]:
            labels.append(c), targets.append(place[t]), sums.append(total)
            total += behind[t]
        first.append(len(labels))
    at = np.concatenate(([0], np.cumsum([len(entries[w]) for w in words]))).astype("<u4")
    flat = np.array([i for w in words for i in entries[w]], "<u4")
    arrays = [np.array(first, "<u4"), np.array(targets, "<u4"), np.array(sums, "<u4"), at, flat, np.array([finals[s] for s in order], np.uint8), np.frombuffer(bytes(labels), np.uint8)]
    return _HEAD.pack(_MAGIC, len(order), len(labels), len(words), len(flat)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, edges, words, flat = _HEAD.unpack_from(self.map)
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        view, at, parts = memoryview(self.map), _HEAD.size, []
        for n in (states + 1, edges, edges, words + 1, flat):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.sums, self.at, self.flat = parts
        self.finals, self.labels = at, at + states

        # an edge's state and label, ascending: where edges are sought for many words at once
        starts, behind = np.asarray(self.first, np.int64), np.frombuffer(self.map, np.uint8, edges, at + states)
        self._edges = (np.repeat(np.arange(states), np.diff(starts)) << 8) | behind
        self._final = np.frombuffer(self.map, np.uint8, states, at)

    def get_many(self, words: list[bytes]) -> list[bytes | None]:
        """What get() says of each word; all walk through the automaton together, one byte a step."""
        out: list[bytes | None] = [None] * len(words)
        n = np.array([len(w) for w in words], np.int64)
        begin, text = np.cumsum(n) - n, np.frombuffer(b"".join(words), np.uint8)
        state, number, live = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.arange(len(n))
        targets, sums, depth = np.asarray(self.targets, np.int64), np.asarray(self.sums, np.int64), 0
        ended = []
        while len(live):
            done = n[live] == depth
            ended.append(live[done])
            live = live[~done]
            if not len(live) or not len(self._edges):
                break
            key = (state[live] << 8) | text[begin[live] + depth]
            at = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            ok = self._edges[at] == key
            live, at = live[ok], at[ok]
            number[live] += sums[at]
            state[live] = targets[at]
            depth += 1
        ended = np.concatenate(ended) if ended else live
        ended = ended[self._final[state[ended]] == 1]
        first = self.at
        for k, j in zip(ended.tolist(), number[ended].tolist()):
            out[k] = self.flat[first[j] : first[j + 1]].tobytes()
        return out

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit integers; None if it isn't in the lexicon."""
        state = number = 0
        data, base, first, targets, sums = self.map, self.labels, self.first, self.targets, self.sums
        for c in word:
            k = data.find(c.to_bytes(), base + first[state], base + first[state + 1])
            if k < 0:
                return None
            k -= base
            number += sums[k]
            state = targets[k]
        return self.flat[self.at[number] : self.at[number + 1]].tobytes() if data[self.finals + state] else None


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of bounded size: no pre-token goes from a character that is no space to one that is."""
    at, n = 0, len(text)
    while at < n:
        m = _CUT.search(text, at + PIECE) if n - at > PIECE else None
        end = m.start() + 1 if m else n
        yield text[at:end]
        at = end


def words_of(part: str) -> list[str]:
    """What stands between single spaces: the first word as it is, each other one after its space.

    A pre-token begins at every space that is followed by something else than white space: the space belongs to what
    follows it, and white space before it is a pre-token of its own.  So words can be encoded one by one."""
    return _SPACE.split(part) if _WIDE.search(part) else part.split(" ")


class Encoder(dict):
    """Encodes and decodes whole texts; as a dict it remembers the ids (bytes of 32-bit integers) of words after a space."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def __missing__(self, word: str) -> bytes:
        self.learn([word])
        return self.pop(word) if len(word) > LONG_WORD else self[word]

    def learn(self, words: list[str]) -> None:
        """Finds the ids of words after a space: in the lexicon, else by merging their pre-tokens, all at once."""
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        if self.lexicon:
            rest = []
            for w, ids in zip(words, self.lexicon.get_many([w.encode("utf-8", "surrogatepass") for w in words])):
                if ids is None:
                    rest.append(w)
                else:
                    self[w] = ids
            words = rest
        # most words are letters, or letters and a mark; those need no search for their pre-tokens
        plain = [w for w in words if w.isalpha()]
        ended = [w for w in words if w[-1:] in _MARKS and w[:-1].isalpha()]
        split = [(w, PATTERN.findall(" " + w)) for w in words if not (w.isalpha() or (w[-1:] in _MARKS and w[:-1].isalpha()))]
        raw = [f" {w}".encode() for w in plain] + [f" {w[:-1]}".encode() for w in ended] + [t.encode("utf-8", "surrogatepass") for _, ts in split for t in ts]
        ids = self.vocabulary.merge_many(raw)
        self.update(zip(plain, ids))
        marks = {m: struct.pack("<I", self.vocabulary.letters[ord(m)]) for m in _MARKS}
        self.update((w, i + marks[w[-1]]) for w, i in zip(ended, ids[len(plain) : len(plain) + len(ended)]))
        at = len(plain) + len(ended)
        for w, ts in split:
            self[w] = b"".join(ids[at : at + len(ts)])
            at += len(ts)

    def know(self, words: set[str]) -> list[str]:
        """Has all of some words at hand together; returns those that were learned."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        self.learn(new)
        return new

    def merged(self, text: str) -> bytes:
        """The ids of any text that the lexicon is not asked for."""
        return b"".join(self.vocabulary.merge_many([t.encode("utf-8", "surrogatepass") for t in PATTERN.findall(text)]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of many texts: the words that are not known are learned together first."""
        split, special = self.vocabulary.split, self.vocabulary.special
        lists, need = [], set()
        for t in texts:
            if len(t) > PIECE or (split is not None and any(s in t for s in special)):
                lists.append(None)
                continue
            words = words_of(t)
            lists.append(words)
            need.update(words[1:])
        tokens = [PATTERN.findall(words[0]) if words else [] for words in lists]
        firsts = self.vocabulary.merge_many([t.encode("utf-8", "surrogatepass") for ts in tokens for t in ts])
        new = self.know(need)
        out, at = [], 0
        for t, words, own in zip(texts, lists, tokens):
            if words is None:
                out.append(self.encode(t))
                continue
            head = firsts[at : at + len(own)]
            at += len(own)
            out.append(b"".join([*head, *map(self.__getitem__, words[1:])]))
        for w in new:
            if len(w) > LONG_WORD:
                self.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        split = self.vocabulary.split
        if split is None or not any(s in text for s in self.vocabulary.special):
            return self._plain(text)
        out = []
        for part in split.split(text):
            special = self.vocabulary.special.get(part)
            out.append(struct.pack("<I", special) if special is not None else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        out = []
        for part in parts_of(text):
            words = words_of(part)
            self.know({*words[1:]})
            out.append(self.merged(words[0]))
            out += map(self.__getitem__, words[1:])
        return b"".join(out)


def decode_ids(vocabulary: Vocabulary, ids: bytes) -> str:
    own, get = memoryview(ids).cast("I"), vocabulary.pieces.__getitem__
    return b"".join(b"".join(map(get, own[k : k + PIECE].tolist())) for k in range(0, len(own), PIECE)).decode("utf-8", "replace")


# --- on Spark --------------------------------------------------------------------------------------------------------


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read on the driver; it is a parameter of fixed size and travels as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _name(vocabulary: str) -> str:
    return hashlib.sha256(vocabulary.encode()).hexdigest()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts that follow a space; tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            own = [(w, n) for w, n in counts.items() if len(w) <= LONG_WORD]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    for part in parts_of(t.as_py()):
                        counts.update(words_of(part)[1:])
                        if len(counts) >= COUNTED:
                            yield flush()
        if counts:
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compiles the most frequent words of all texts, `words` at most, and hands the file to the executors; returns its
    name there."""
    spark, v = docs.sparkSession, Vocabulary(vocabulary)
    counts = written(word_counts(docs, text_col).where(F.col("n") >= LEAST_COUNT).withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "words")
    # the counts by eighths of powers of two: a few hundred rows say from which count on the words fit
    fit, least = 0, None
    for step, n in sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        fit += n
        if fit > words:
            break
        least = step
    top = counts.where(F.col("step") >= least).select("word") if least is not None else counts.limit(0).select("word")
    own, chosen = Encoder(v), {r[0] for r in top.collect()}
    own.know(chosen)
    image = compile_lexicon({w.encode(): np.frombuffer(own[w], "<u4").tolist() for w in chosen})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm, target = spark.sparkContext._jvm, f"{scratch(spark)}/facetry/{name}"
    path = jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(image))
    stream.close()
    spark.sparkContext.addFile(target)
    return name


#: The vocabulary and encoder of the running task; they end with it, as workers live on and do other work.
_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[tuple, Encoder] = {}


def _forget() -> None:
    _ENCODERS.clear()
    _VOCABULARIES.clear()


def _vocabulary(own, key: str) -> Vocabulary:
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(own.value)
    return _VOCABULARIES[key]


def _encoder(own, key: str, lexicon: str | None) -> Encoder:
    if (key, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key, lexicon] = Encoder(_vocabulary(own, key), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _ENCODERS[key, lexicon]


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as binary, little-endian unsigned 32-bit; extra columns are ignored.

    Whole texts of any length, part by part; null counts as empty, which has no ids.  Special strings of the vocabulary
    become their ids.  One row a row, repeated ones included; an empty table gives no rows."""
    spark: SparkSession = docs.sparkSession
    own, key, kind = spark.sparkContext.broadcast(vocabulary), _name(vocabulary), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(own, key, lexicon)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = e.encode_all([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
        e.clear()
        _forget()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns of `encoded` and `decoded`, the text of its ids; special tokens are kept.  Null ids give an empty text;
    bytes that are no UTF-8 become replacement characters; one row a row, of any length.  A column that is named `decoded`
    already has to be renamed before."""
    own, key = encoded.sparkSession.sparkContext.broadcast(vocabulary), _name(vocabulary)
    at, names = encoded.columns.index(ids_col), [*encoded.columns, "decoded"]
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(own, key)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = [decode_ids(v, x.as_buffer().to_pybytes()) if x.is_valid else "" for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)
        _forget()

    return encoded.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(n_tokens) of each text, null as empty."""
    own, key = docs.sparkSession.sparkContext.broadcast(vocabulary), _name(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(own, key, None)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids = e.encode_all([t or "" for t in b.column(0).slice(at, 512).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64())], names=["n_tokens"])
        e.clear()
        _forget()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")
