"""Searches through an index find what searches without one do, and read only the folders of their trigrams."""

import re

import pytest
from pyspark.sql import functions as F

from facetry.engine import select
from facetry.shapes import Reference, Shape, optional, string
from facetry.sources.catalog import Catalog
from facetry.sources.tables import Document, catalog
from facetry.sources.textindex import TextIndex, trigrams_of

Note = Shape("Note", {"text": optional(string, "text")})
Pin = Shape("Pin", {"note": optional(Reference(lambda: Note), "note")})
TEXTS = {
    "a": "The quick brown fox", "b": "QUICKLY, brownish", "c": None, "d": "", "e": "ab", "f": "İstanbul ΣΊΣΥΦΟΣ Straße", "g": "x" * 5000 + "needle" + "y" * 5000, "h": "tab\tand\nnewline\u00a0nbsp", "i": "quick", "j": "K\u212aelvin qu ick", "k": "a" * 64 + "bcd", "l": "nee dle",
}


@pytest.fixture(scope="module")
def bound(spark, tmp_path_factory):
    notes = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    pins = spark.createDataFrame([(f"p{k}", k) for k in TEXTS], "id string, note string")
    plain = Catalog(spark).bind(Note, notes).bind(Pin, pins)
    index = TextIndex.build(notes, "id", "text", f"file://{tmp_path_factory.mktemp('index')}/own", buckets=16)
    return plain, plain.copy().indexed(Note, "text", index), index


@pytest.mark.parametrize("search", ["quick", "QUICK brown", "ick", "qu", "needle", "nee dle", "xneedley", "ß", "istanbul", "σίσυφος", "", "nothing", "and newline", "aab", "abcd", "kelvin", "kk", "brown qu", "n\u00a0nbsp"])
def test_results_are_the_same(bound, search):
    plain, own, _ = bound
    for shape, key in ((Note, "~text"), (Pin, "~note.text")):
        ids = [sorted(r["id"] for r in select(c, shape, {"id": {}, key: search}).collect()) for c in (plain, own)]
        assert ids[0] == ids[1]
    found = sorted(r["n"] for r in select(own, Note, {"n=count:id": {}, "~text": search}).collect())
    assert found == sorted(r["n"] for r in select(plain, Note, {"n=count:id": {}, "~text": search}).collect())


def test_a_new_frame_drops_the_index(spark, bound):
    _, own, _ = bound
    again = own.copy().bind(Note, spark.createDataFrame([("z", "quick")], "id string, text string"))
    assert own.index(Note, "text") and not again.index(Note, "text")
    assert [r["id"] for r in select(again, Note, {"id": {}, "~text": "quick"}).collect()] == ["z"]


def test_trigrams():
    assert trigrams_of("Quick ab x") == ["qui", "uic", "ick"] and trigrams_of("ß éa") == [] and trigrams_of("straße-abc") == ["str", "tra", "e-a", "-ab", "abc"]


def test_documents_and_what_is_read(spark, sf_dir, tmp_path):
    c = catalog(spark, sf_dir)
    text = c.frame(Document).where("length(text) > 300").select("text").first()[0]
    word = max(re.findall("[a-z]{5,}", text.lower()), key=len)
    search = f"{word.upper()} {word[:3]}"
    want = sorted(r["id"] for r in select(c, Document, {"id": {}, "~text": search}).collect())
    index = TextIndex.build(c.frame(Document), "doc_id", "text", f"file://{tmp_path}/own", buckets=64)
    df = select(c.indexed(Document, "text", index), Document, {"id": {}, "~text": search})
    assert sorted(r["id"] for r in df.collect()) == want and want
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan")[1:] if re.search(r"PartitionFilters: \[[^]]*bucket", x))
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*)", scan)
    assert "trigram" in filters[2], scan
    assert not re.search("coalesce", select(catalog(spark, sf_dir), Document, {"id": {}, "~text": "x"})._jdf.queryExecution().optimizedPlan().toString())


def test_postings_are_made_row_by_row_and_told_once(spark, monkeypatch, tmp_path):
    """Texts are cut where they are read, whatever their length; lists hold what a search can ask for, each key once."""
    from facetry.sources import textindex

    monkeypatch.setattr(textindex, "PIECE", 10)
    notes = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    made = textindex.postings(notes, "id", "text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = {(text.lower()[k : k + 3], key) for key, text in TEXTS.items() for k in range(len((text or "").lower()) - 2) if re.fullmatch(r"[\x21-\x7e]{3}", text.lower()[k : k + 3])}
    assert {(r["trigram"], r["key"]) for r in made.collect()} == want
    TextIndex.build(notes, "id", "text", f"file://{tmp_path}/own", buckets=4)
    held = [(r["trigram"], r["key"]) for r in spark.read.parquet(f"file://{tmp_path}/own/postings").collect()]
    assert len(held) == len(want) and set(held) == want
    assert {r["trigram"]: r["n"] for r in spark.read.parquet(f"file://{tmp_path}/own/counts").collect()} == {t: sum(x == t for x, _ in want) for t, _ in want}
