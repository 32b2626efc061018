from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweh.functions import formats, fuzzy, paths, text


def test_osa_swaps_and_bound():
    assert text.osa("mian", "main", 1) == 1
    assert text.osa("ca", "abc", 3) == 3
    assert text.osa("abcdef", "uvwxyz", 2) == 3
    assert text.osa("", "ab", 2) == 2


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_is_symmetric_and_bounded(a, b):
    d = text.osa(a, b, 9)
    assert d == text.osa(b, a, 9) and d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_fold_composed_and_combining(spark):
    df = spark.createDataFrame([("Été é й Øl ế",)], "t string")
    assert df.select(text.fold(F.col("t"))).first()[0] == "ete e й øl e" == text.fold_py("Été é й Øl ế")


def test_kinds(spark):
    rows = [("a.PNG", False), (".bashrc", False), ("Makefile", False), ("x.tar.gz", False), ("noext.", False), ("App.app", True), ("d", True), ("readme.unknown", False)]
    df = spark.createDataFrame(rows, "n string, d boolean")
    assert [r[0] for r in df.select(paths.kind_of(F.col("n"), F.col("d"))).collect()] == ["image", "data", "code", "archive", "other", "app", "folder", "text"]


def test_identifiers_and_names(spark):
    df = spark.createDataFrame([("getHTTPResponse_v2",)], "n string")
    assert df.select(text.split_identifier(F.col("n"))).first()[0] == ["get", "HTTP", "Response", "v", "2"]
    assert df.select(text.name_tokens(F.col("n"))).first()[0] == ["getHTTPResponse", "get", "HTTP", "Response", "v2", "v", "2"]


def test_stamps(spark):
    df = spark.createDataFrame([(3725,)], "s int")
    s = df.select(formats.stamp(F.col("s")).alias("s"))
    assert s.first()[0] == "[01:02:05]" and s.select(formats.stamp_seconds("s")).first()[0] == 3725


def test_fuzzy_scores():
    terms = fuzzy.parse_terms
    assert fuzzy.path_score("src/main.rs", terms("main")) > fuzzy.path_score("src/domain.rs", terms("main"))
    assert fuzzy.path_score("src/main.rs", terms("main !src")) is None
    assert fuzzy.path_score("docs/a.md", terms(".md$ ^docs")) is not None
    assert fuzzy.path_score("x/y", terms("zz")) is None
    assert terms("'a ^b c$ ^d$ !e") == [fuzzy.Term("a", "exact"), fuzzy.Term("b", "prefix"), fuzzy.Term("c", "suffix"), fuzzy.Term("d", "equal"), fuzzy.Term("e", "exact", True)]


@settings(max_examples=100, deadline=None)
@given(st.text("ab/.", max_size=12), st.text("ab", min_size=1, max_size=4))
def test_fuzzy_matches_iff_subsequence(path, term):
    it = iter(path)
    assert (fuzzy.path_score(path, [fuzzy.Term(term)]) is not None) == all(c in it for c in term)


def test_redaction(spark):
    key = "a -----BEGIN RSA PRIVATE KEY-----\nxyz\n-----END RSA PRIVATE KEY----- b"
    df = spark.createDataFrame([(key,)], "t string")
    assert df.select(text.redact_keys(F.col("t"))).first()[0] == "a [private key removed] b"
