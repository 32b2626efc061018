import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernweh.llm import passages as P

SCHEMA = "file long, n long, hash string, start_pos long, end_pos long, prompt string, piece string, raw string"


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from("ab .\n,é́字。"), max_size=400), st.integers(12, 60))
def test_pieces_fit_cover_and_repeat(text, limit):
    overlap = limit // 5
    cuts = P.cut(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for s, e in cuts:
        assert e - s <= limit
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert a < c and b - overlap <= c <= b and d > b  # nothing is lost, at most the overlap comes again


def test_boundaries_win_over_hard_cuts():
    text = ("A sentence here. " * 200).strip()
    for s, e in P.cut(text)[:-1]:
        assert text[e - 1] == "."
    para = ("word " * 300).strip() + "\n\n" + ("word " * 300).strip()
    assert P.cut(para)[0][1] == para.index("\n\n")
    assert P.cut("x" * 5000)[0] == (0, 1800) and P.cut("x" * 5000)[1][0] == 1600


def test_offsets_map_through_squeezed_blanks():
    raw = "zz  " + "one  two\n\n three " * 10
    body = " ".join(raw[4:].split())
    state, solid, _ = P.place(body, 4, len(raw), raw)
    assert state == "exact" and raw[solid[0]] == "o"
    assert P.place(body, 0, 5, "new start " + raw)[0] == "moved"
    assert P.place("other", 0, 5, raw)[0] == "stale" and P.place("abcde", 3, 8, None) == ("assumed", None, 3)


def test_defined_cases(spark):
    long = "Word. " * 700
    rows = [
        (1, 0, "h", 0, 10, "Title\n\nshort", "x", "y"), (1, 1, "h", -1, -1, None, "x", "y"), (2, 0, "h", 0, 4200, "T\n\n" + long, "x", "y"), (2, 0, "h", 0, 4200, "T\n\n" + long, "x", "y"),
        (3, 0, "h", None, None, "no empty line " * 300, None, None), (None, 0, "h", 5, 9, "T\n\n" + long, None, None), (4, 0, "h", 0, 0, "", None, None), (5, 0, "h", 0, 9, "T\n\n" + "字" * 4000, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = P.split_oversized(df).collect()
    assert {(r.file, r.n) for r in out} == {(2, 0), (3, 0), (None, 0), (5, 0)}
    two = sorted((r for r in out if r.file == 2), key=lambda r: r.piece)
    assert two[0].offsets == "assumed" and two[0].start_pos == 0 and two[0].prompt.startswith("T\n\nWord.")
    assert all(len(r.prompt.partition("\n\n")[2] or r.prompt) <= 1800 for r in out)
    assert [(r.start_pos, r.offsets) for r in out if r.file == 3][0] == (0, "relative") and all(r.end_pos - r.start_pos <= 1800 for r in out if r.file == 3)
    assert all(r.offsets == "stale" and 0 <= r.start_pos <= r.end_pos <= 9 for r in out if r.file == 5)
    assert P.split_oversized(df.limit(0)).count() == 0


def test_offsets_in_the_texts(spark):
    raw = "Head\n\n" + "A line  of words.\n" * 300
    body = " ".join(raw[6:].split())
    p = spark.createDataFrame([(7, 0, "h", 6, len(raw), "T\n\n" + body, None, None)], SCHEMA)
    t = spark.createDataFrame([(70, raw)], "id long, data string")
    m = spark.createDataFrame([(7, 70, "h")], "id long, text long, hash string")
    for r in P.split_oversized(p, t, m).collect():
        assert r.offsets == "exact" and " ".join(raw[r.start_pos : r.end_pos].split()) == r.prompt[3:].strip()


@pytest.mark.parametrize("limit,overlap", [(50, 0), (50, 49)])
def test_extreme_overlaps_end(limit, overlap):
    cuts = P.cut("abc def " * 50, limit, overlap)
    assert cuts[-1][1] == 400 and all(c[0] > a[0] for a, c in zip(cuts, cuts[1:]))
