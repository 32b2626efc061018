import pytest

from fernweh.plans import compile as C
from fernweh.plans import query as Q

NOW = 1_706_745_600_000
DAY = 86_400_000


def test_modes_and_words():
    q = Q.parse('all: x y "p q" -z', NOW)
    assert (q.all, q.mode, q.words, q.phrases, q.without) == (True, "find", ("x", "y"), ("p q",), ("z",))
    assert Q.parse("s: what is it?", NOW).mode == "semantic"
    assert Q.parse("/foo(bar)?/i ext:md", NOW).flags == "i"
    assert not Q.parse("/etc/hosts", NOW).regex


@pytest.mark.parametrize("text,want", [("1.5k", 1536), ("2mb", 2 << 20), ("10", 10), ("x", None), ("1kk", None)])
def test_sizes(text, want):
    assert Q.size_of(text) == want


@pytest.mark.parametrize("text,want", [("7d", 7 * DAY), ("2mo", 60 * DAY), ("5min", 300_000), ("1y", 365 * DAY), ("d", None)])
def test_ages(text, want):
    assert Q.age_of(text) == want


def test_filters():
    f = Q.parse("size:1k..4k mtime:<7d created:2022 -ext:py tag:a tag:b sort:-size limit:9999", NOW).filters
    assert (f.size_min, f.size_max, f.mtime_min) == (1024, 4096, NOW - 7 * DAY)
    assert (f.created_min, f.created_max) == (1640995200000, 1672531200000)
    assert f.nots[0].exts == {"py"} and f.tags == ("a", "b") and f.sort == "-size" and f.limit == 5000


def test_warnings_and_text_that_stays():
    q = Q.parse("type:rs is:unknown size:big near:5000 -sort:name", NOW)
    assert any("did you mean ext:rs" in w for w in q.warnings) and "is:unknown" in q.text and "size:big" in q.text


def test_globs_become_name_filters_only_in_plain_text():
    assert Q.parse("*.pdf x", NOW).filters.names == ((r"^.*\.pdf$", "i"),)
    assert Q.parse("f:*.pdf", NOW).filters.names == ()


def test_groups():
    g = Q.groups("(a OR b) type:md")
    assert g.op == "and" and g.parts[0].op == "or" and g.parts[1].text == "type:md"
    assert Q.groups("plain words") is None
    for bad in ("(a", "(a OR )", "(a))"):
        with pytest.raises(ValueError):
            Q.groups(bad)
    with pytest.raises(ValueError):
        Q.groups("(" * 20 + "a" + ")" * 20)


def test_without_filters():
    assert Q.without_filters("a ext:md b size:>1k", ["ext"]) == "a b size:>1k"
    assert Q.without_filters("a ext:md", ["ext"]) == "a"


def test_arguments():
    assert Q.from_arguments("x", "find", ext=["md", "py"], in_="~/My Folder") == 'find: x ext:md,py in:"~/My Folder"'


@pytest.mark.parametrize("pattern,want", [("foo.*bar", ["foo", "bar"]), ("a(b|c)d+ef", ["ef"]), ("(ab)?cd", ["cd"]), ("foo|bar", []), (r"\bfoo\s+bar[xy]z?q", ["foo", "bar"]), ("x{0,2}abc", ["abc"])])
def test_required_literals(pattern, want):
    assert C.literals(pattern) == want


def test_literals_never_lose_a_match(spark):
    import random
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd ") for _ in range(40)) for _ in range(60)]
    for _ in range(60):
        p = "".join(rng.choice(["a", "b", "ab", "c?", "d+", "[ab]", "(ab|c)", ".", "bc", "(d)?"]) for _ in range(4))
        for t in texts:
            if re.search(p, t):
                assert all(x in t for x in C.literals(p)), p


def test_java_dialect(spark):
    from pyspark.sql import functions as F

    rows = [("café au",), ("a b",), ("ÉTUDE",)]
    df = spark.createDataFrame(rows, "t string")
    hit = lambda p, i=False: [r.t for r in df.filter(F.col("t").rlike(C.java_regex(p, i))).collect()]
    assert hit(r"a\sb") == ["a b"]
    assert hit(r"caf\b") == ["café au"]  # word boundaries are ASCII
    assert hit("étude", True) == ["ÉTUDE"]
    assert hit("[^]u$") == ["café au"]
