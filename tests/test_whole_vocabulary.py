"""Words of all alphabets, which the queries with SQL leave out."""

import hashlib
import unicodedata

import pytest

import __spark_entry__ as entry
from conftest import DATA

TEXTS = ["• Réunion → reunion «Straße» straße", "Ответ ответ, йод и ёж", "会議 ١٢ b\ufffdd bd", "plain Plain", "", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, data string").write.parquet(f"{d}/texts.parquet")
    return d


def words(text):
    """Folded letter by letter."""
    out = []
    for c in text:
        if unicodedata.combining(c) and out and out[-1].isascii() and out[-1].isalpha() and 0x300 <= ord(c) <= 0x36F:
            continue
        base = unicodedata.normalize("NFD", c)[0]
        out.append(base if base.isascii() and base.isalpha() and unicodedata.name(c, "").startswith("LATIN") else c)
    low = "".join(out).lower()
    return {w for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in low).split(" ") if w and len(w) <= 1024}


def test_fold_terms_of_all_texts(spark, folder):
    assert [words(t) for t in TEXTS[:3]] == [{"reunion", "straße"}, {"ответ", "йод", "и", "ёж"}, {"会議", "١٢", "b", "d", "bd"}]
    for d in (folder, DATA):
        texts = {r.id: r.data for r in spark.read.parquet(f"{d}/texts.parquet").select("id", "data").collect()}
        got = {r.id: r.terms for r in entry.queries()["fold_terms"](spark, d).collect()}
        assert got.keys() == texts.keys()
        assert {i: got[i] for i, t in texts.items() if t is not None} == {i: hashlib.md5(" ".join(sorted(words(t))).encode()).hexdigest() for i, t in texts.items() if t is not None}


def test_queries_reach_all_words(spark, tmp_path):
    texts = ["barl7 barley barly7 книгами книгаs x7ings ab", "супtion подsub subй éarlß naïves barl7 ab", None]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "id long, data string").write.parquet(f"{d}/texts.parquet")
    run = lambda name: entry.queries()[name](spark, d).collect()
    vocabulary = set().union(*(words(t) for t in texts if t))
    stems = {r.term: r.stem for r in run("stems")}
    assert stems == {w: w for w in vocabulary} | {"книгаs": "книга", "naives": "naiv"}
    assert {(r.term, r.by) for r in run("vocabulary_lookup")} == {("barl7", "part"), ("barley", "part"), ("barly7", "part"), ("earlß", "part"), ("супtion", "end"), ("subй", "start")}
    assert {(r.term, r.distance) for r in run("typo_terms")} == {("barl7", 1), ("barley", 1), ("barly7", 1)}
    assert {r.term for r in run("vocabulary_append")} == words(texts[1]) - words(texts[0])
